"""Percentiles per group from mergeable sketches with bounded error.

Method: dyadic Count-sketches. A double becomes an integer of 24 bits that keeps its order (sign, exponent, 12 bits of
the fraction: a relative error of at most 2^-13). For every binary resolution, from single values up to halves of the whole
range, a signed Count-sketch of ``ROWS`` x ``WIDTH`` counters holds how often each prefix occurs. Sketches are merged by
addition, and deleting is adding with weight -1. A rank is inverted by descending: at each resolution the lower half's
count, the median over the rows, says on which side the rank lies.

Until a sketch has more than ``CELLS`` counters' worth of distinct values it is stored as those values with their weights, from
which the same counters are built when it is read: a lossless shorter form, so answers don't depend on it.

Sketches are made per key of any grain, such as the day, and stored as a table. Partial sketches of tasks are added in a tree of
fixed fan-in, and ``running`` answers for each stored sketch, for each running total and for the whole by adding stored
sketches only.

``rank_error`` bounds how far the rank of an answer may be off, as a share of the group: three times the root of the
sum over resolutions of F2 / WIDTH, F2 being the sum of the squared counts without those of the ``HEAVY`` largest counters, with
which a given prefix practically never collides in three of the five rows. It comes from the sketch itself.

Defined results: null and NaN are no values; infinities are values; -0.0 is 0.0; a group without values gives no row; null
group keys form a group.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fjordlens.plans.runtime import Scratch

BITS, ROWS, WIDTH_BITS = 24, 5, 12
WIDTH = 1 << WIDTH_BITS
CELLS = BITS * ROWS * WIDTH
PAIRS = CELLS // 2  # a value with its weight is two numbers
HEAVY = 8
BUFFER = 1 << 20  # rows a task takes in at once
HELD = 32  # sketches' worth of memory a task holds before it hands on what it has
FAN = 16

_rng = np.random.Generator(np.random.PCG64(20240229))
_A = _rng.integers(1, 1 << 63, size=(BITS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, size=(BITS, ROWS), dtype=np.uint64)


def encode(x: np.ndarray) -> np.ndarray:
    bits = (np.asarray(x, np.float64) + 0.0).view(np.uint64)
    high = np.uint64(1 << 63)
    ordered = np.where(bits & high, ~bits, bits | high)
    return (ordered >> np.uint64(64 - BITS)).astype(np.uint64)


def decode(v: int) -> float:
    """The middle of the cell, except at zero and the infinities."""
    low, up = _back(v << (64 - BITS)), _back(((v + 1) << (64 - BITS)) - 1)
    if low == 0 or not np.isfinite(low) or not np.isfinite(up):
        return float(low) if np.isfinite(low) or np.isinf(low) else float(up)
    return float((low + up) / 2)


def _back(o: int) -> float:
    bits = o & ~(1 << 63) if o >> 63 else ~o & ((1 << 64) - 1)
    return np.array([bits], np.uint64).view(np.float64)[0]


def _places(level: int, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell and sign of prefixes in each row of a level (rows x prefixes)."""
    h = prefix[None, :] * _A[level][:, None] + _B[level][:, None]
    sign = ((h >> np.uint64(63 - WIDTH_BITS)) & np.uint64(1)).astype(np.int64) * 2 - 1
    return (h >> np.uint64(64 - WIDTH_BITS)).astype(np.int64), sign


def build(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The counters (levels x rows x width) for encoded distinct values with integer weights."""
    out = np.zeros((BITS, ROWS, WIDTH), np.int64)
    order = np.argsort(values, kind="stable")
    values, weights = values[order], weights[order]
    for level in range(BITS):
        prefix = values >> np.uint64(level)
        first = np.flatnonzero(np.concatenate(([True], prefix[1:] != prefix[:-1]))) if len(prefix) else np.zeros(0, np.int64)
        if not len(first):
            break
        weights, values = np.add.reduceat(weights, first), values[first]
        cell, sign = _places(level, prefix[first])
        for row in range(ROWS):
            np.add.at(out[level, row], cell[row], sign[row] * weights)
    return out


def count(cells: np.ndarray, level: int, prefix: int) -> float:
    cell, sign = _places(level, np.array([prefix], np.uint64))
    return float(np.median(sign[:, 0] * cells[level, np.arange(ROWS), cell[:, 0]]))


def rank_error(cells: np.ndarray) -> float:
    """The bound in rows."""
    squares = cells.astype(np.float64) ** 2
    rest = np.partition(squares, WIDTH - HEAVY, axis=2)[:, :, : WIDTH - HEAVY].sum(axis=2)
    return 3 * float(np.sqrt(np.median(rest, axis=1).sum() / WIDTH))


def invert(cells: np.ndarray, total: int, rank: float) -> int:
    """The encoded value at ``rank`` (from 1)."""
    prefix, rest, have = 0, rank, float(total)
    for level in range(BITS - 1, -1, -1):
        left = min(max(count(cells, level, 2 * prefix), 0.0), have)
        if rest <= left and left > 0:
            prefix, have = 2 * prefix, left
        elif have - left > 0:
            prefix, rest, have = 2 * prefix + 1, rest - left, have - left
        else:  # nothing above: an estimate was too low
            prefix, have, rest = 2 * prefix, left, min(rest, left)
    return prefix


class State:
    """One group's sketch: values with weights while that is the shorter form, else counters."""

    def __init__(self) -> None:
        self.values, self.weights, self.cells, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), None, 0

    def add(self, values: np.ndarray, weights: np.ndarray) -> None:
        self.n += int(weights.sum())
        values, at = np.unique(np.concatenate([self.values, values]), return_inverse=True)
        sums = np.zeros(len(values), np.int64)
        np.add.at(sums, at, np.concatenate([self.weights, weights]))
        self.values, self.weights = values[sums != 0], sums[sums != 0]
        if self.cells is not None or len(self.values) > PAIRS:
            self.cells = self.counters()
            self.values, self.weights = self.values[:0], self.weights[:0]

    def merge(self, other: State) -> None:
        if other.cells is None:
            return self.add(other.values, other.weights)
        self.n += other.n
        self.cells = self.counters() + other.cells
        self.values, self.weights = self.values[:0], self.weights[:0]

    def counters(self) -> np.ndarray:
        built = build(self.values, self.weights) if len(self.values) or self.cells is None else 0
        return built if self.cells is None else self.cells + built

    def size(self) -> int:
        return CELLS if self.cells is not None else 2 * len(self.values)

    def dump(self) -> tuple[int, bool, bytes]:
        if self.cells is None:
            return self.n, False, zlib.compress(np.concatenate([self.values.astype(np.int64), self.weights]).tobytes(), 1)
        return self.n, True, zlib.compress(self.cells.tobytes(), 1)

    @staticmethod
    def load(n: int, counters: bool, payload: bytes) -> State:
        out, flat = State(), np.frombuffer(zlib.decompress(payload), np.int64)
        out.n = n
        if counters:
            out.cells = flat.reshape(BITS, ROWS, WIDTH)
        else:
            half = len(flat) // 2
            out.values, out.weights = flat[:half].astype(np.uint64), flat[half:]
        return out


def answers(cells: np.ndarray, n: int, at: Sequence[float]) -> list[float]:
    """The values at the shares ``at``, and the bound of the rank error as a share of n."""
    return [*(decode(invert(cells, n, max(1.0, np.ceil(q * n)))) for q in at), rank_error(cells) / n]


COLUMNS = ["n", "counters", "payload"]


def _schema(keys: Sequence[str]) -> str:
    return "slot int, " + "".join(f"`{k}` string, " for k in keys) + "n bigint, counters boolean, payload binary"


def _texts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys travel to pandas as text: a null among integers would turn them into doubles."""
    return df.withColumns({k: F.col(k).cast("string") for k in keys})


def _typed(df: DataFrame, keys: Sequence[str], like: DataFrame) -> DataFrame:
    kinds = dict(like.dtypes)
    return df.withColumns({k: F.col(k).cast(kinds[k]) for k in keys})


def _dump(slot: int, keys: list[str], states: dict) -> pd.DataFrame:
    return pd.DataFrame([(slot, *k, *s.dump()) for k, s in states.items()], columns=["slot", *keys, *COLUMNS])


def _plain(key: tuple) -> tuple:
    return tuple(None if x is None or x != x else x for x in key)


def partial(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    slot, states, held, n = TaskContext.get().partitionId(), {}, [], 0

    def flush() -> None:
        nonlocal held, n
        rows = pd.concat(held)
        for k, g in rows.groupby(keys, dropna=False, sort=False):
            states.setdefault(_plain(k), State()).add(encode(g["_value"].to_numpy()), g["_weight"].to_numpy(np.int64))
        held, n = [], 0

    for b in batches:
        held.append(b)
        n += len(b)
        if n >= BUFFER:
            flush()
            if sum(s.size() for s in states.values()) > HELD * CELLS or len(states) > 20_000:  # memory stays bounded
                yield _dump(slot, keys, states)
                states = {}
    if held:
        flush()
    if states:
        yield _dump(slot, keys, states)


def sketches(df: DataFrame, keys: Sequence[str], value: str, scratch: Scratch, weight: str | None = None) -> DataFrame:
    """(keys..., n, counters, payload): the stored table of one sketch per group. Every input task makes its own partial
    sketches."""
    keys = list(keys)
    rows = df.select(
        *keys, F.col(value).cast("double").alias("_value"), (F.col(weight) if weight else F.lit(1)).cast("bigint").alias("_weight")
    ).where(F.col("_value").isNotNull() & ~F.isnan("_value"))
    parts = scratch.cut(_texts(rows, keys).mapInPandas(lambda it: partial(it, keys), _schema(keys)))
    slots = (parts.agg(F.max("slot").alias("m")).collect()[0]["m"] or 0) + 1
    return scratch.cut(_typed(_tree(parts, keys, slots), keys, df))


def _tree(parts: DataFrame, keys: list[str], slots: int) -> DataFrame:
    def one(rows: pd.DataFrame) -> pd.DataFrame:
        first, out = rows.iloc[0], State()
        for r in rows[COLUMNS].itertuples(index=False):
            out.merge(State.load(int(r.n), bool(r.counters), r.payload))
        return pd.DataFrame([(int(first["slot"]) // FAN, *(first[k] for k in keys), *out.dump())], columns=["slot", *keys, *COLUMNS])

    while True:
        parts = parts.groupBy(*keys, F.floor(F.col("slot") / FAN)).applyInPandas(one, _schema(keys))
        slots = -(-slots // FAN)
        if slots <= 1:
            return parts.drop("slot")


def add(sketched: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds stored sketches: (keys..., n, counters, payload), one per group of ``keys``, in a tree of fixed fan-in."""
    keys = list(keys)
    slots = sketched.count()  # at most so many in a group
    numbered = _texts(sketched.select(F.pmod(F.monotonically_increasing_id(), F.lit(max(1, slots))).cast("int").alias("slot"), *keys, *COLUMNS), keys)
    return _typed(_tree(numbered, keys, max(1, slots)), keys, sketched)


def _answered(keys: Sequence[str], names: Sequence[str]) -> str:
    return "".join(f"`{k}` string, " for k in keys) + "n bigint, " + "".join(f"{n} double, " for n in names) + "rank_error double"


def _names(at: Sequence[float]) -> list[str]:
    return [f"p{round(q * 100)}" for q in at]


def percentiles(sketched: DataFrame, keys: Sequence[str], at: Sequence[float]) -> DataFrame:
    """(keys..., n, p<100 q>..., rank_error) of each sketch."""
    keys, names = list(keys), _names(at)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.to_dict("records"):
                s = State.load(int(r["n"]), bool(r["counters"]), r["payload"])
                if s.n > 0:
                    rows.append((*(r[k] for k in keys), s.n, *answers(s.counters(), s.n, at)))
            yield pd.DataFrame(rows, columns=[*keys, "n", *names, "rank_error"])

    return _typed(_texts(sketched, keys).mapInPandas(read, _answered(keys, names)), keys, sketched)


def running(sketched: DataFrame, keys: Sequence[str], along: str, at: Sequence[float]) -> DataFrame:
    """(scope, along, keys..., n, p<100 q>..., rank_error) from stored sketches of ``keys`` and ``along`` (a day, say): for each
    of them (scope 'one'), for the sum of all up to it ('to_date') and for the sum of all ('all', ``along`` null). Each group is
    read in order and one sum is kept; what a task holds is bounded by the size of a sketch."""
    keys, names = list(keys), _names(at)
    columns = ["scope", along, *keys]
    # a fixed number of tasks: there are few bytes but much to invert, so they must not be coalesced by size
    tasks = int(sketched.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = _texts(sketched, [along, *keys]).repartition(tasks, *keys).sortWithinPartitions(*keys, along)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, total, n = None, None, 0

        def whole(rows: list) -> None:
            if n > 0:
                rows.append(("all", None, *key, n, *answers(total, n, at)))

        for b in batches:
            rows = []
            for r in b.to_dict("records"):
                k = _plain(tuple(r[x] for x in keys))
                if k != key:
                    whole(rows)
                    key, total, n = k, np.zeros((BITS, ROWS, WIDTH), np.int64), 0
                s = State.load(int(r["n"]), bool(r["counters"]), r["payload"])
                cells = s.counters()
                total, n = total + cells, n + s.n
                if s.n > 0:
                    rows.append(("one", r[along], *k, s.n, *answers(cells, s.n, at)))
                if n > 0:
                    rows.append(("to_date", r[along], *k, n, *answers(total, n, at)))
            yield pd.DataFrame(rows, columns=[*columns, "n", *names, "rank_error"])
        rows = []
        whole(rows)
        yield pd.DataFrame(rows, columns=[*columns, "n", *names, "rank_error"])

    out = laid.mapInPandas(read, _answered(columns, names))
    return _typed(out, [along, *keys], sketched)

"""Differences between two copies of a table, field by field.

Method: characteristic-polynomial set reconciliation over a finite field, per bucket. Every row of either side becomes a
60-bit hash; rows fall into buckets by blocks of neighbouring keys. Each side sends, per bucket, its row count and the
values of prod(z - hash) at a few sample points instead of its rows; equal buckets cancel there. For the others the
ratio of the two sides is a rational function whose numerator and denominator have the differing hashes as roots. It is
found from ``bound`` + 1 points and verified at two more. Buckets that do not verify are done again from their own hashes
only, at twice the bound; from ``widest`` on they are split in four by bits of the hash instead, so that the values sent stay
fewer than the rows they stand for. There a row that is repeated stands once, with its number of repetitions in the hash, so
every bucket ends up with no more members than the bound, and then verifies: nothing is left to another way. Last, the rows
of the differing hashes are fetched and compared.

Both sides are scanned for the spread of their keys (that column only), for the sketches, for the hashes of buckets that
did not verify, and for the fetch; what is shuffled is the sketches (where a task holds fewer rows of a bucket than there are
points, their hashes, which are the smaller form of the same polynomial) and the differing rows. Whether a small side is
broadcast is left to the planner, which knows the sizes of the tables in the shared folder.

Defined results: keys match with null equal to null; fields are compared exactly, null equal to null only; equal rows
under one key count once; where a key stands for unlike rows on a side, those with an equal row on the other side are
matched, and the rest is compared each with each, or reported as lacking if nothing is left on the other side; empty
tables give every row of the other side; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fjordlens.functions import prime61 as field
from fjordlens.plans.runtime import Scratch

HASH_BITS = 60  # hashes lie below 2^60, sample points above, so that no hash is a sample point
CHECKS = 2
SKETCH = "bucket bigint, side tinyint, n bigint, whole boolean, vals array<bigint>"
FOUND = "bucket bigint, side tinyint, hash bigint"
BATCH = 1 << 16
SPLIT_BITS = 2  # a bucket is split by so many bits of the hash at a time


def row_hash(columns: Sequence[str]) -> Column:
    """60 bits of all columns; nulls are told from values by a flag, as the hash itself skips them."""
    parts = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    return F.xxhash64(*parts).bitwiseAND(F.lit((1 << HASH_BITS) - 1))


def bucket_of(group: Sequence[str], key: str, width: Column, buckets: int) -> Column:
    """Blocks of ``width`` neighbouring keys go together, so that a task holds most of a bucket where files are sorted
    by key; blocks are hashed into buckets, so that buckets are even however the keys are spread."""
    return F.pmod(F.xxhash64(*group, F.floor(F.col(key) / width)), F.lit(buckets))


def _rows(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= most:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _runs(*keys: np.ndarray) -> np.ndarray:
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _evaluate(hashes: np.ndarray, starts: np.ndarray, points: list[int]) -> np.ndarray:
    z = np.array(points, np.uint64)
    out = np.empty((len(starts), len(points)), np.uint64)
    step = max(1, (1 << 15) // max(1, int(np.max(np.diff(np.append(starts, len(hashes))), initial=1))))
    for i in range(0, len(starts), step):  # cache-sized pieces of whole runs
        lo = starts[i]
        hi = starts[i + step] if i + step < len(starts) else len(hashes)
        out[i : i + step] = field.segment_products(
            field.vsub(z[None, :], hashes[lo:hi, None]), starts[i : i + step] - lo
        )
    return out


def sketch(batches: Iterator[pa.RecordBatch], bound: int) -> Iterator[pa.RecordBatch]:
    """(bucket, side, hash) to partial sketches."""
    points = _points(bound)
    k = len(points)
    for t in _rows(batches, BATCH):
        bucket, side = t["bucket"].to_numpy(), t["side"].to_numpy()
        order = np.lexsort((side, bucket))
        bucket, side, h = bucket[order], side[order], t["hash"].to_numpy()[order].astype(np.uint64)
        starts = _runs(bucket, side)
        n = np.diff(np.append(starts, len(h)))
        many = n >= k
        at = np.repeat(many, n)
        if many.any():
            s = np.concatenate(([0], np.cumsum(n[many])[:-1]))
            vals = _evaluate(h[at], s, points)
            yield _sketches(bucket[starts[many]], side[starts[many]], n[many], True, vals.ravel(), np.full(many.sum(), k))
        if not many.all():
            few = starts[~many]
            yield _sketches(bucket[few], side[few], n[~many], False, h[~at], n[~many])


def _points(bound: int) -> list[int]:
    return [(1 << HASH_BITS) + 1 + i for i in range(bound + 1 + CHECKS)]


def _sketches(bucket, side, n, whole, vals, sizes) -> pa.RecordBatch:
    offs = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
    lists = pa.ListArray.from_arrays(offs, pa.array(vals.astype(np.int64)))
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket), pa.array(side.astype(np.int8)), pa.array(n.astype(np.int64)), pa.array(np.full(len(bucket), whole)), lists],
        ["bucket", "side", "n", "whole", "vals"],
    )


def merge(batches: Iterator[pa.RecordBatch], bound: int) -> Iterator[pa.RecordBatch]:
    """Sketches sorted by bucket to differing hashes; hash is null where the bucket did not verify."""
    points = field.Points(bound + 1, 1 << HASH_BITS)
    every = _points(bound)
    carry: pa.Table | None = None
    for t in _rows(batches, BATCH // 16):
        t = t if carry is None else pa.concat_tables([carry, t])
        bucket = t["bucket"].to_numpy()
        last = int(np.searchsorted(bucket, bucket[-1]))
        carry = t.slice(last)
        if last:
            yield from _solve(t.slice(0, last), points, every, bound)
    if carry is not None:
        yield from _solve(carry, points, every, bound)


def _solve(t: pa.Table, points: field.Points, every: list[int], bound: int) -> Iterator[pa.RecordBatch]:
    t = t.combine_chunks()
    k = len(every)
    bucket, side, n, whole = (t[c].to_numpy() for c in ("bucket", "side", "n", "whole"))
    lists = t["vals"].chunk(0) if t["vals"].num_chunks else t["vals"].combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy().astype(np.uint64)
    in_whole = np.repeat(whole, sizes)
    vals = np.empty((len(bucket), k), np.uint64)
    vals[whole] = flat[in_whole].reshape(-1, k)
    if not whole.all():
        s = np.concatenate(([0], np.cumsum(sizes[~whole])[:-1]))
        vals[~whole] = _evaluate(flat[~in_whole], s, every)
    order = np.lexsort((side, bucket))
    bucket, side, n, vals = bucket[order], side[order], n[order], vals[order]
    starts = _runs(bucket, side)
    vals, n = field.segment_products(vals, starts), np.add.reduceat(n, starts)
    bucket, side = bucket[starts], side[starts]
    ids, of = np.unique(bucket, return_inverse=True)
    ev = np.ones((2, len(ids), k), np.uint64)
    count = np.zeros((2, len(ids)), np.int64)
    ev[side, of], count[side, of] = vals, n
    unlike = np.flatnonzero((ev[0] != ev[1]).any(axis=1) | (count[0] != count[1]))
    out: list[tuple[int, int, int | None]] = []
    for i in unlike:
        found = _differing(ev[0, i], ev[1, i], int(count[0, i] - count[1, i]), points, every, bound)
        if found is None:
            out.append((int(ids[i]), 0, None))
        else:
            out += [(int(ids[i]), s, h) for s in (0, 1) for h in found[s]]
    if out:
        b, s, h = zip(*out)
        yield pa.RecordBatch.from_arrays(
            [pa.array(b, pa.int64()), pa.array(s, pa.int8()), pa.array(h, pa.int64())], ["bucket", "side", "hash"]
        )


def _differing(a, b, more: int, points: field.Points, every: list[int], bound: int) -> tuple[list[int], list[int]] | None:
    if abs(more) > bound:
        return None
    room = bound - (bound - more) % 2
    ratio = [int(x) * pow(int(y), -1, field.P) % field.P for x, y in zip(a, b)]
    solved = points.rational(ratio[: bound + 1], (room + more) // 2, (room - more) // 2)
    if solved is None:
        return None
    top, bottom = solved
    if len(top) - len(bottom) != more:
        return None
    if any(field.value(top, z) != r * field.value(bottom, z) % field.P for z, r in zip(every[bound + 1 :], ratio[bound + 1 :])):
        return None
    found = []
    for f in (top, bottom):
        r = field.roots(f) if len(f) > 1 else []
        g = field.monic(f)
        for x in r:  # every factor must be a hash, also where one occurs several times
            while len(g) > 1 and field.value(g, x) == 0:
                g = field.divide(g, [-x % field.P, 1])[0]
        if len(g) > 1 or any(x >> HASH_BITS for x in r):
            return None
        found.append(r)
    return found[0], found[1]


def _round(hashed: DataFrame, bound: int, scratch: Scratch) -> DataFrame:
    parts = hashed.mapInArrow(lambda it: sketch(it, bound), SKETCH)
    # a fixed number of tasks: there are few bytes but much to solve, so they must not be coalesced by size
    tasks = int(hashed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = parts.repartition(tasks, "bucket").sortWithinPartitions("bucket")
    return scratch.cut(laid.mapInArrow(lambda it: merge(it, bound), FOUND))


def differing_hashes(hashed: DataFrame, scratch: Scratch, bound: int = 8, widest: int = 32) -> DataFrame:
    """(bucket, side, hash), side 0 or 1, to (bucket, hash) of those hashes that are not the same number of times on both sides."""

    def unsolved(found: DataFrame) -> DataFrame:
        return found.where(F.col("hash").isNull()).select("bucket").distinct()

    found = _round(hashed, bound, scratch)
    out = found.where(F.col("hash").isNotNull()).select("bucket", "hash")
    if unsolved(found).isEmpty():
        return out
    element = F.xxhash64("hash", "n").bitwiseAND(F.lit((1 << HASH_BITS) - 1))
    rest = scratch.cut(
        hashed.join(unsolved(found), "bucket", "left_semi")
        .groupBy("bucket", "side", "hash").agg(F.count("*").alias("n"))
        .select("bucket", "side", "hash", element.alias("element"))
    )
    work, solved, shift = rest.select("bucket", "side", F.col("element").alias("hash")), [], 0
    while True:
        if 2 * bound <= widest:
            bound *= 2
        else:
            part = F.shiftright("hash", shift).bitwiseAND(F.lit((1 << SPLIT_BITS) - 1))
            work = work.withColumn("bucket", F.shiftleft("bucket", SPLIT_BITS).bitwiseOR(part))
            shift += SPLIT_BITS
        found = _round(work, bound, scratch)
        solved.append(found.where(F.col("hash").isNotNull()).select(F.col("hash").alias("element"), "side"))
        if unsolved(found).isEmpty():
            break
        work = scratch.cut(work.join(unsolved(found), "bucket", "left_semi"))
    return out.unionByName(rest.join(reduce(DataFrame.unionByName, solved), ["element", "side"]).select("bucket", "hash"))


def differences(
    main: DataFrame,
    copy: DataFrame,
    group: str,
    key: str,
    fields: Sequence[str],
    scratch: Scratch,
    rows_per_bucket: int = 128,
) -> DataFrame:
    """(group, key, difference): ``only_main``, ``only_copy`` or the name of a field that differs.

    ``group`` is the name of the table a row belongs to, ``key`` a bigint that is unique in it.
    """
    # inner names, so that no field can clash with another column
    named = dict(zip(["_group", "_key", *(f"_f{i}" for i in range(len(fields)))], [group, key, *fields]))
    main, copy = (d.select(*(F.col(c).alias(n) for n, c in named.items())) for d in (main, copy))
    out = _differences(main, copy, list(fields), scratch, rows_per_bucket)
    return out.withColumnsRenamed({"_group": group, "_key": key})


def _differences(main: DataFrame, copy: DataFrame, titles: list[str], scratch: Scratch, rows_per_bucket: int) -> DataFrame:
    group, key, fields = "_group", "_key", [f"_f{i}" for i in range(len(titles))]
    columns = [group, key, *fields]
    keys = main.select(group, key).unionByName(copy.select(group, key))
    shape = keys.groupBy(group).agg(F.count("*").alias("n"), F.expr(f"approx_percentile({key}, array(0.1, 0.9), 100)").alias("q")).collect()  # one row per table name
    total = sum(r["n"] for r in shape) // 2  # of a side
    widths: Mapping = {
        r[group]: max(1, min(4096, rows_per_bucket * (r["q"][1] - r["q"][0]) // max(1, r["n"] * 4 // 10)))
        for r in shape
        if r[group] is not None and r["q"]
    }
    width = F.lit(64)
    for name, w in widths.items():
        width = F.when(F.col(group) == name, F.lit(w)).otherwise(width)
    where = bucket_of([group], key, width, max(1, total // rows_per_bucket))
    sides = [
        d.select(*columns).select(where.alias("bucket"), F.lit(i).cast("tinyint").alias("side"), row_hash(columns).alias("hash"), *columns)
        for i, d in enumerate((main, copy))
    ]
    hashed = [d.select("bucket", "side", "hash") for d in sides]
    odd = scratch.cut(differing_hashes(hashed[0].unionByName(hashed[1]), scratch))
    wanted = odd.distinct()

    def fetch(i: int) -> DataFrame:
        # of either side: a row that only occurs more often on one side is fetched from both, and then equal
        return sides[i].join(wanted, ["bucket", "hash"], "left_semi").select(*columns)

    a, b = fetch(0), fetch(1)
    a = a.select(*(F.col(c).alias(f"a_{c}") for c in columns), F.lit(True).alias("in_a"))
    b = b.select(*(F.col(c).alias(f"b_{c}") for c in columns), F.lit(True).alias("in_b"))
    both = a.join(
        b, F.col(f"a_{group}").eqNullSafe(F.col(f"b_{group}")) & F.col(f"a_{key}").eqNullSafe(F.col(f"b_{key}")), "full"
    )
    unlike = F.filter(
        F.array(*(F.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), F.lit(t)) for c, t in zip(fields, titles))), lambda x: x.isNotNull()
    )
    said = (
        F.when(F.col("in_b").isNull(), F.array(F.lit("only_main")))
        .when(F.col("in_a").isNull(), F.array(F.lit("only_copy")))
        .otherwise(unlike)
    )
    mine = F.col("in_a").isNotNull()
    return both.select(
        F.when(mine, F.col(f"a_{group}")).otherwise(F.col(f"b_{group}")).alias(group),
        F.when(mine, F.col(f"a_{key}")).otherwise(F.col(f"b_{key}")).alias(key),
        F.explode(said).alias("difference"),
    ).distinct()

"""A digest of a whole table that does not depend on order, layout or duplicates being together.

Every row's canonical bytes are hashed (FNV-1a, 64 bits); count, sum, exclusive or and sum of squares (modulo 2^64) are
folded per task on Arrow buffers and combined by built-in aggregates in halves of 32 bits, which cannot overflow.

Defined results: an empty table has the digest of zeros; a row with a null field has no bytes and is an error, as the
relations have no nulls (``strict``), or is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fjordlens.functions import canon, fixed


def fnv(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """FNV-1a of each row: one pass per byte position over the rows that are as long."""
    length = np.diff(offsets)
    order = np.argsort(-length, kind="stable")
    start, length = offsets[:-1][order], length[order]
    h = np.full(len(length), fixed.FNV_BASIS, np.uint64)
    prime = np.uint64(fixed.FNV_PRIME)
    ends = np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), side="right")
    for i, n in enumerate(ends):
        h[:n] = (h[:n] ^ data[start[:n] + i]) * prime
    return h


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, s, x, q = 0, np.uint64(0), np.uint64(0), np.uint64(0)
    with np.errstate(over="ignore"):
        for b in batches:
            rows = b.column(0).cast(pa.large_binary())
            if not len(rows):
                continue
            _, offs, data = rows.buffers()
            offsets = np.frombuffer(offs, np.int64)[rows.offset : rows.offset + len(rows) + 1]
            h = fnv(offsets, np.frombuffer(data, np.uint8).astype(np.uint64))
            n += len(h)
            s, x, q = s + h.sum(dtype=np.uint64), x ^ np.bitwise_xor.reduce(h), q + (h * h).sum(dtype=np.uint64)
    parts = [np.array([v], np.uint64).view(np.int64)[0] for v in (s, x, q)]
    yield pa.RecordBatch.from_pydict({"n": [n], "s": [int(parts[0])], "x": [int(parts[1])], "q": [int(parts[2])]})


def fold(df: DataFrame, row: Column) -> DataFrame:
    """(rows, digest) of the table whose rows have the canonical hex ``row``."""
    parts = df.select(F.unhex(row).alias("b")).where("b is not null").mapInArrow(_fold, "n bigint, s bigint, x bigint, q bigint")
    low = (1 << 32) - 1

    def half(c: str) -> list[Column]:
        return [
            F.sum(F.shiftrightunsigned(c, 32)).alias(f"{c}_high"),
            F.sum(F.col(c).bitwiseAND(F.lit(low))).alias(f"{c}_low"),
        ]

    def whole(c: str) -> Column:
        carry = F.coalesce(F.col(f"{c}_high"), F.lit(0)) + F.shiftright(F.coalesce(F.col(f"{c}_low"), F.lit(0)), 32)
        return F.concat(canon.be32(carry.bitwiseAND(F.lit(low))), canon.be32(F.coalesce(F.col(f"{c}_low"), F.lit(0)).bitwiseAND(F.lit(low))))

    one = parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.bit_xor("x"), F.lit(0)).alias("x"), *half("s"), *half("q"))
    return one.select("rows", canon.digest(F.concat(canon.be64("rows"), whole("s"), canon.be64("x"), whole("q"))).alias("digest"))

"""A sample that is the same in every run and layout and keeps its members as data grows.

Method: golden-ratio low-discrepancy selection. Every key gets a persistent sequence number, its place in the order of
first arrival; the number times the golden ratio, plus a fixed shift, modulo 1, is kept where it falls into [0, rate). The
multiples of the golden ratio fill the interval evenly at every length, so each stretch of arrivals gives its share, and a
key's number never changes as long as later batches arrive later; or where it was given before (``known``).

Numbers are kept in a table that ``extend`` carries on batch by batch: a number once given stays, also where a key arrives
late with a time before others. They are made by a range-partitioned sort with partition offsets; no task and no driver sees
all keys.

Defined results: null keys are not sampled; repeated keys count once, at their first arrival; keys without an
arrival time come after all others, by key; ties in time go by key; an empty table gives an empty sample.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fjordlens.plans.runtime import Scratch, global_rank

BITS = 48
ONE = 1 << BITS
STEP = ((math.isqrt(5 << (2 * BITS)) - ONE) // 2) | 1  # 2^48 / golden ratio, odd
SHIFT = 0x5D1CE_4B7_A93


def place(seq: str | Column) -> Column:
    """frac(seq * golden + shift) as an integer below 2^48; the product is taken in 24-bit halves, so nothing overflows."""
    half = 1 << (BITS // 2)
    seq = F.col(seq) if isinstance(seq, str) else seq
    lo, hi = seq.bitwiseAND(F.lit(half - 1)), F.shiftright(seq, BITS // 2).bitwiseAND(F.lit(half - 1))
    cross = (hi * F.lit(STEP % half) + lo * F.lit(STEP // half)) % F.lit(half)
    return (lo * F.lit(STEP % half) + cross * F.lit(half) + F.lit(SHIFT % ONE)) % F.lit(ONE)


def sequence(df: DataFrame, key: str, arrived: str, scratch: Scratch, known: DataFrame | None = None) -> DataFrame:
    """(key, arrived, seq) for each key. ``known`` (key, seq) holds numbers given before; new keys follow after them."""
    first = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(arrived).alias("arrived"))
    if known is None:
        return global_rank(first, [F.col("arrived").asc_nulls_last(), F.col(key)], "seq", scratch)
    start = known.agg(F.max("seq").alias("m")).collect()[0]["m"]
    new = first.join(known, key, "left_anti")
    new = global_rank(new, [F.col("arrived").asc_nulls_last(), F.col(key)], "seq", scratch)
    new = new.withColumn("seq", F.col("seq") + F.lit((start if start is not None else -1) + 1))
    old = first.join(known.select(key, "seq"), key)
    return old.select(key, "arrived", "seq").unionByName(new.select(key, "arrived", "seq"))


def extend(df: DataFrame, key: str, arrived: str, scratch: Scratch, numbers: str | None) -> str:
    """Numbers the keys of ``df`` that the table at ``numbers`` (None at first) lacks, and writes the table with old and new
    ones to a new place, which is returned; the old one stays as it was, so a failed run loses nothing."""
    spark = df.sparkSession
    known = spark.read.parquet(numbers) if numbers else None
    first = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(arrived).alias("arrived"))
    new = first if known is None else first.join(known, key, "left_anti")
    start = 0 if known is None else known.agg(F.coalesce(F.max("seq") + 1, F.lit(0)).alias("m")).collect()[0]["m"]
    new = global_rank(new, [F.col("arrived").asc_nulls_last(), F.col(key)], "seq", scratch)
    new = new.select(key, (F.col("seq") + F.lit(start)).alias("seq"))
    return scratch.cut(new if known is None else known.unionByName(new))._scratch_path


def chosen(numbered: DataFrame, rate: float) -> DataFrame:
    """The rows of ``numbered`` whose place lies in the kept interval."""
    return numbered.where(place("seq") < F.lit(round(rate * ONE)))

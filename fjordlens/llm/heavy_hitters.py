"""The most frequent values of a column in bounded memory.

Method: Misra-Gries summaries of ``k`` counters. Each task counts a batch, adds it to its summary and, beyond k counters,
subtracts the next-largest (the (k+1)-th) counter from all and drops those that reach zero. Summaries are merged the same
way, in a tree of fixed fan-in, so no task holds more than fan-in x k counters at any size of input. What was
subtracted in total (``lost``) bounds every error: a value's rows lie between its counter and counter + lost, and a value
without a counter has at most ``lost`` rows, which is at most rows / (k + 1).

Defined results: nulls are not counted; ties go to the smaller value; fewer distinct values than asked for give
all of them; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN = 32


def shrink(counts: pd.Series, k: int) -> tuple[pd.Series, int]:
    """The k-counter summary of exact or summed counters, and what was subtracted from each."""
    if len(counts) <= k:
        return counts, 0
    off = int(counts.nlargest(k + 1).iloc[-1])
    counts = counts - off
    return counts[counts > 0], off


def _row(slot: int, counts: pd.Series, lost: int, filler) -> pd.DataFrame:
    # the last row carries what was lost, also when no counter is left; its item is only a filler, since a null among
    # integers would turn them into doubles
    items = pd.Series([*counts.index, filler], dtype="int64" if filler == 0 else object)
    return pd.DataFrame({"slot": slot, "held": [True] * len(counts) + [False], "item": items, "n": [*counts.to_numpy("int64"), 0], "lost": [0] * len(counts) + [lost]})


def summarize(batches: Iterator[pd.DataFrame], k: int, filler) -> Iterator[pd.DataFrame]:
    counts, lost = None, 0
    for b in batches:
        new = b["item"].value_counts()
        counts, off = shrink(new if counts is None else counts.add(new, fill_value=0).astype("int64"), k)
        lost += off
    if counts is not None:
        yield _row(TaskContext.get().partitionId(), counts, lost, filler)


def merge(rows: pd.DataFrame, k: int, filler) -> pd.DataFrame:
    slot = int(rows["slot"].iloc[0]) // FAN
    held = rows["held"]
    counts, off = shrink(rows[held].groupby("item")["n"].sum(), k)
    return _row(slot, counts, int(rows.loc[~held, "lost"].sum()) + off, filler)


def summary(df: DataFrame, column: str, k: int) -> DataFrame:
    """(item, n, lost): one merged summary of at most k items, and a row without item; true rows lie in [n, n + the
    lost of that row]. Values that are no integers are counted as text."""
    kind = dict(df.dtypes)[column]
    whole = kind in ("tinyint", "smallint", "int", "bigint")
    inner, filler = ("bigint", 0) if whole else ("string", "")
    schema = f"slot int, held boolean, item {inner}, n bigint, lost bigint"
    one = df.select(F.col(column).cast(inner).alias("item")).where(F.col("item").isNotNull())
    tasks = one.rdd.getNumPartitions()
    out = one.mapInPandas(lambda it: summarize(it, k, filler), schema)
    while True:
        out = out.groupBy(F.floor(F.col("slot") / FAN)).applyInPandas(lambda rows: merge(rows, k, filler), schema)
        tasks = -(-tasks // FAN)
        if tasks <= 1:
            return out.select(F.when(F.col("held"), F.col("item").cast(kind)).alias("item"), "n", "lost")


def top(df: DataFrame, column: str, most: int, k: int = 8192) -> DataFrame:
    """(item, rows): the ``most`` most frequent values with exact rows.

    The summary gives at most k candidates, whose rows are counted exactly in a second scan. The answer is certain once the
    last one kept has more rows than ``lost``, the most any value without a counter can have; with k counters this holds
    for every value of more than rows / (k + 1) rows. Where values are so evenly spread that it does not, all values are
    counted by a shuffle that combines before it, spills and leaves the order to a bounded top-k: memory stays bounded, and
    neither the summary nor what the driver holds ever grows beyond k.
    """
    kind, spark = dict(df.dtypes)[column], df.sparkSession
    found = summary(df, column, k).collect()  # at most k + 1 rows
    lost = max((r["lost"] for r in found), default=0)
    items = spark.createDataFrame([(r["item"],) for r in found if r["item"] is not None], f"{column} {kind}")
    rows = df.select(column).where(F.col(column).isNotNull())

    def counted(rows: DataFrame) -> list:
        return rows.groupBy(F.col(column).alias("item")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "item").limit(most).collect()

    best = counted(rows.join(F.broadcast(items), column))  # at most k items
    if lost and not (len(best) == most and best[-1]["rows"] > lost):
        best = counted(rows)
    return spark.createDataFrame([(r["item"], r["rows"]) for r in best], f"item {kind}, rows bigint")

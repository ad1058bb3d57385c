"""Results per key when a few keys hold most rows.

Method: value-frequency compression. Rows are grouped by (key, value) before key, so the shuffle is spread over the
values and a hot key is never one task; everything per key is then derived from the weighted values, by aggregates that
combine before they shuffle. Percentiles need the order of a key's values: the weighted rows are laid out in ranges of
(key, value), and each range's running weight starts from the weight of the ranges before it, so a key may span ranges.

Defined results: a null key is a key of its own; null values count as rows but not as values (no mode, percentile
or distinct value comes from them); ties for the mode go to the smallest value; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fjordlens.plans.runtime import Scratch


def compress(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys..., value, weight): how often each value occurs under each key."""
    return df.groupBy(*keys, F.col(value).alias("value")).agg(F.count("*").alias("weight"))


def key_stats(weighted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows, distinct_values, mode and mode_rows per key from weighted values; exact."""
    best = F.max(
        F.when(F.col("value").isNotNull(), F.struct(F.col("weight").alias("w"), (-F.col("value")).alias("v")))
    )
    return (
        weighted.groupBy(*keys)
        .agg(F.sum("weight").alias("rows"), F.count("value").alias("distinct_values"), best.alias("best"))
        .select(*keys, "rows", "distinct_values", (-F.col("best.v")).alias("mode"), F.col("best.w").alias("mode_rows"))
    )


def key_percentiles(weighted: DataFrame, keys: Sequence[str], at: Sequence[float], scratch: Scratch) -> DataFrame:
    """One column ``p<100 q>`` per q of ``at``: the smallest value with a running weight of at least q of the key's."""
    wanted = {f"p{math.floor(q * 100)}": (lambda n, q=q: F.ceil(n * F.lit(q))) for q in at}
    return order_statistics(weighted, keys, wanted, scratch)


def linear_percentiles(weighted: DataFrame, keys: Sequence[str], at: dict[str, float], scratch: Scratch) -> DataFrame:
    """(keys..., n, name...): percentiles interpolated between the values around rank (n - 1) q, exact at any size."""
    wanted = {}
    for name, q in at.items():
        wanted[f"{name}_low"] = lambda n, q=q: F.floor((n - 1) * F.lit(q)) + 1
        wanted[f"{name}_high"] = lambda n, q=q: F.ceil((n - 1) * F.lit(q)) + 1
    found = order_statistics(weighted, keys, wanted, scratch)
    out = []
    for name, q in at.items():
        part = (F.col("n") - 1) * F.lit(q) - F.floor((F.col("n") - 1) * F.lit(q))
        low, high = F.col(f"{name}_low"), F.col(f"{name}_high")
        out.append((low + (high - low) * part).alias(name))
    return found.select(*keys, "n", *out)


def order_statistics(weighted: DataFrame, keys: Sequence[str], wanted: dict, scratch: Scratch) -> DataFrame:
    """(keys..., n, name...): the value at the rank (from 1) that each function of ``wanted`` gives for a key's n."""
    order = [*keys, "value"]
    laid = scratch.cut(
        weighted.where(F.col("value").isNotNull()).repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    )
    # one row per key and range; a key's ranges are few, so this window is bounded by the number of ranges
    parts = laid.groupBy(*keys, "_part").agg(F.sum("weight").alias("_in"))
    by_key = Window.partitionBy(*keys)
    ends = {k: f"_of_{k}" for k in [*keys, "_part"]}
    parts = parts.select(
        *(F.col(k).alias(n) for k, n in ends.items()),
        (F.sum("_in").over(by_key.orderBy("_part")) - F.col("_in")).alias("_before"),
        F.sum("_in").over(by_key).alias("_all"),
    )
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(n)) for k, n in ends.items()))
    joined = laid.join(parts, same).drop(*ends.values())
    run = Window.partitionBy(*keys, "_part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = joined.withColumn("_run", F.sum("weight").over(run) + F.col("_before"))
    hit = [F.min(F.when(F.col("_run") >= rank(F.col("_all")), F.col("value"))).alias(name) for name, rank in wanted.items()]
    return ranked.groupBy(*keys).agg(F.max("_all").alias("n"), *hit)


def heavy_keys(weighted: DataFrame, keys: Sequence[str], share: float, total: int) -> DataFrame:
    """Keys that hold at least ``share`` of ``total`` rows, with their rows."""
    return key_stats(weighted, keys).where(F.col("rows") >= F.lit(share) * F.lit(total))

"""Bounded upward traversal from many starts at once.

One frontier join per level over all starts; a node counts once per start, at its fewest links; the start itself is never
discovered. The number of levels is a small constant, so the levels are one plan and Catalyst may broadcast a small
frontier. The guard is a bound on visited nodes per start: a start that has more is marked, not cut.

Defined results: null starts and links are ignored, repeated ones count once; unknown starts discover nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fjordlens.functions import fixed


def ancestry(seeds: DataFrame, edges: DataFrame, depth: int = fixed.MAX_DEPTH) -> DataFrame:
    """(seed, node): nodes within ``depth`` upward links of each seed, without the seed. ``edges`` is (node, parent)."""
    seeds = seeds.where("seed is not null").distinct()
    front = seeds.select("seed", F.col("seed").alias("at"))
    levels = []
    for _ in range(depth):
        step = edges.select(F.col("node").alias("at"), F.col("parent").alias("next"))
        front = front.join(step, "at").select("seed", F.col("next").alias("at")).distinct()
        levels.append(front)
    met = reduce(DataFrame.unionByName, levels).distinct()
    return met.where("seed <> at").select("seed", F.col("at").alias("node"))


def ordered_list(df: DataFrame, key: str, node: str) -> DataFrame:
    """(key, cardinality, hexed): the sorted nodes of each key as canonical hex, for keys whose lists the guard bounds."""
    from fjordlens.functions import canon

    rows = F.transform(F.array_sort(F.collect_list(node)), lambda x: canon.be64(x))
    return df.groupBy(key).agg(F.count(node).alias("cardinality"), F.array_join(rows, "").alias("hexed"))

"""Tiers, presence and degrees of concepts.

T1 is the hash sample, T2 the endpoints of subclass links; both are columns of the concept relation. A tail concept is an
endpoint that was never seen as an item: T2, not T1 and without any text. (Its place at the end of the file is not
relational, so it is told by content.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tier() -> Column:
    return (
        F.when(F.col("in_t1") & F.col("in_t2"), "T1IntersectT2")
        .when(F.col("in_t1"), "T1Only")
        .when(F.col("tail"), "Tail")
        .when(F.col("in_t2"), "T2Only")
        .otherwise("None")
    )


def profiled(concept: DataFrame, lexical: DataFrame) -> DataFrame:
    """(qid, in_t1, in_t2, has_lexical, tail) per concept."""
    seen = lexical.select(F.col("Qid").alias("qid"), F.lit(True).alias("has")).distinct()
    rows = concept.select(F.col("Qid").alias("qid"), F.col("InT1").alias("in_t1"), F.col("InT2").alias("in_t2"))
    has = F.coalesce("has", F.lit(False))
    return rows.join(seen, "qid", "left").select(
        "qid", "in_t1", "in_t2", has.alias("has_lexical"), (F.col("in_t2") & ~F.col("in_t1") & ~has).alias("tail")
    )


def out_degree(edges: DataFrame, name: str) -> DataFrame:
    return edges.groupBy(F.col("SubjectQid").alias("qid")).agg(F.count("*").alias(name))


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("SubjectQid").alias("qid")).union(edges.select("TargetQid")).where("qid is not null").distinct()


def fanout_bin(n: Column) -> Column:
    return F.when(n == 1, "1").when(n <= 5, "2-5").when(n <= 50, "6-50").otherwise("51+")

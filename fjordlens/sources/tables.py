"""Readers of the relations. Every reader gives whole tables; pruning is left to the plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fjordlens.plans.runtime import ship

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "concept", "lexical_entry", "instance_of", "subclass_of", "candidate_row", "serving_probe", "graph_probe",
    "g1_timed_sample", "eval_item", "mix_target",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

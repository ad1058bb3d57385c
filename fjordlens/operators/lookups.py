"""Exact-key lookups, all probes of a kind in one join, and digests of ordered results.

A probe keeps its row when nothing is found. Which side is broadcast is left to the planner's size check; hot keys to
AQE. Digests of ordered lists are taken while streaming over a sorted partition, so a list of any length needs
constant memory.

Defined results: probes delivered twice count once; keys are compared exactly (no normalization); null keys find nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fjordlens.functions import canon


def probes(df: DataFrame, op: str) -> DataFrame:
    """(seq, qid, lang, value) of one kind of probe, each once."""
    return (
        df.where(F.col("Op") == op)
        .select(F.col("Seq").alias("seq"), F.col("Qid").alias("qid"), F.col("Lang").alias("lang"), F.col("Value").alias("value"))
        .distinct()
    )


def concept_lookup(wanted: DataFrame, concept: DataFrame) -> DataFrame:
    hit = concept.select(F.col("Qid").alias("qid"), F.lit(True).alias("hit"), F.col("InT1").alias("in_t1"), F.col("InT2").alias("in_t2"))
    return wanted.join(hit, "qid", "left").select("seq", "qid", F.coalesce("hit", F.lit(False)).alias("present"), "in_t1", "in_t2")


def lexical_lookup(wanted: DataFrame, lexical: DataFrame) -> DataFrame:
    rows = lexical.select(F.col("Lang").alias("lang"), F.col("Value").alias("value"), F.col("Qid").alias("found"), F.col("LexKind").alias("lex_kind"))
    return wanted.join(rows, ["lang", "value"], "left").select("seq", "lang", "value", F.col("found").alias("qid"), "lex_kind")


def lexical_of(wanted: DataFrame, lexical: DataFrame) -> DataFrame:
    rows = lexical.select(F.col("Qid").alias("qid"), F.col("Lang").alias("l"), F.col("LexKind").alias("lex_kind"), F.col("Value").alias("v"))
    return wanted.join(rows, "qid", "left").select("seq", "qid", F.col("l").alias("lang"), "lex_kind", F.col("v").alias("value"))


def targets_of(wanted: DataFrame, edges: DataFrame) -> DataFrame:
    rows = edges.select(F.col("SubjectQid").alias("qid"), F.col("TargetQid").alias("target"))
    return wanted.join(rows, "qid", "left").select("seq", "qid", "target")


def list_digests(rows: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """(keys..., cardinality, digest) of the rows of each key in ``order``; ``hexed`` is a row's canonical hex and null for
    a key without rows. The header (count and bytes) comes from an aggregation, the rest is streamed."""
    keys = list(keys)
    kinds = dict(rows.dtypes)
    head = rows.groupBy(*keys).agg(
        F.count("hexed").alias("cardinality"), F.coalesce(F.sum(F.length("hexed") / 2), F.lit(0)).cast("bigint").alias("_bytes")
    )
    ready = rows.join(head, keys).select(
        *keys, "cardinality", F.concat(canon.be64("cardinality"), canon.be32("_bytes")).alias("_head"),
        F.coalesce("hexed", F.lit("")).alias("_row"), *order,
    )
    names = [c for c in ready.columns if c not in (*keys, "cardinality", "_head", "_row")]
    laid = ready.repartition(*keys).sortWithinPartitions(*keys, *names).drop(*names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, h = None, None
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                key = tuple(r[: len(keys) + 1])
                if key != at:
                    if at is not None:
                        out.append((*at, h.hexdigest()))
                    at, h = key, hashlib.sha256(bytes.fromhex(r[-2]))
                h.update(bytes.fromhex(r[-1]))
            yield pd.DataFrame(out, columns=[*keys, "cardinality", "digest"])
        if at is not None:
            yield pd.DataFrame([(*at, h.hexdigest())], columns=[*keys, "cardinality", "digest"])

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", cardinality bigint, digest string"
    return laid.mapInPandas(run, schema)

"""Anchors: named sets of concepts and cases of names, and how a corpus covers them.

Defined results: repeated members of a set count once; a case without a concept has no surface outcome; a case without
candidates is not ambiguous; null texts and languages match nothing; empty tables give no rows, and counts of 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Name types whose names a corpus of labels and aliases can hold (fixed names of the format), with the kind of row.
HELD = {"CanonicalLabel": "label", "WikidataAlias": "alias"}


def coverage(sets: DataFrame, concept: DataFrame) -> DataFrame:
    """(set, total, in_t1, in_t2, in_both, in_t2_only, present, absent) of each named set."""
    known = concept.select(F.col("Qid").alias("qid"), F.col("InT1").alias("t1"), F.col("InT2").alias("t2"), F.lit(True).alias("here"))
    t1, t2, here = (F.coalesce(c, F.lit(False)) for c in ("t1", "t2", "here"))
    return sets.distinct().join(known, "qid", "left").groupBy("set").agg(
        F.count("*").alias("total"), F.count_if(t1).alias("in_t1"), F.count_if(t2).alias("in_t2"), F.count_if(t1 & t2).alias("in_both"),
        F.count_if(t2 & ~t1).alias("in_t2_only"), F.count_if(here).alias("present"), F.count_if(~here).alias("absent"),
    )


def surfaces(cases: DataFrame, concept: DataFrame, lexical: DataFrame) -> DataFrame:
    """(id, category, outcome) of each resolved case: whether its concept has the name as a label or an alias."""
    wanted = cases.where("status = 'resolved' and qid is not null")
    kind = F.create_map(*(F.lit(x) for pair in HELD.items() for x in pair))[F.col("name_type")]
    known = concept.select(F.col("Qid").alias("qid"), F.lit(True).alias("here")).distinct()
    named = lexical.select(F.col("Qid").alias("qid"), F.col("Lang").alias("language"), F.col("LexKind").alias("kind"), F.col("Value").alias("term"), F.lit(True).alias("named")).distinct()
    rows = wanted.withColumn("kind", kind).join(known, "qid", "left").join(named, ["qid", "language", "kind", "term"], "left")
    outcome = (
        F.when(F.col("kind").isNull(), "not_applicable_to_baseline_lexical_corpus")
        .when(F.col("here").isNull(), "concept_absent")
        .when(F.col("named").isNull(), "concept_present_surface_absent")
        .otherwise(F.concat(F.lit("concept_present_"), F.col("kind"), F.lit("_surface")))
    )
    return rows.select("id", "category", outcome.alias("outcome"))


def ambiguous(cases: DataFrame, concept: DataFrame, lexical: DataFrame) -> DataFrame:
    """(id, candidates, present, with_surface) of each ambiguous case: how many of its candidates are concepts, and have the name."""
    wanted = cases.where("status = 'ambiguous' and candidates is not null")
    each = wanted.select("id", "language", "term", F.explode_outer("candidates").alias("qid"))
    known = concept.select(F.col("Qid").alias("qid"), F.lit(True).alias("here")).distinct()
    named = lexical.select(F.col("Qid").alias("qid"), F.col("Lang").alias("language"), F.col("Value").alias("term"), F.lit(True).alias("named")).distinct()
    rows = each.join(known, "qid", "left").join(named, ["qid", "language", "term"], "left")
    return rows.groupBy("id").agg(F.count("qid").alias("candidates"), F.count("here").alias("present"), F.count("named").alias("with_surface"))


def continuity(sets: DataFrame, cases: DataFrame, concept: DataFrame, lexical: DataFrame) -> DataFrame:
    """(figure, n): members of the three sets that are concepts, cases whose text occurs in its language, and cases of which
    two candidates or more are concepts."""
    known = concept.select(F.col("Qid").alias("qid")).distinct()
    named = {"resolvedGold": "resolvedGoldPresent", "goldUnion": "goldUnionPresent", "ambiguousCand": "ambiguousCandPresent"}
    here = sets.distinct().join(known, "qid", "left_semi")
    parts = [here.agg(*(F.count_if(F.col("set") == s).alias(n) for s, n in named.items()))]
    texts = lexical.select(F.col("Lang").alias("language"), F.col("Value").alias("term")).distinct()
    parts.append(cases.join(texts, ["language", "term"], "left_semi").agg(F.count("*").alias("lexicalSurfacePresent")))
    each = cases.select("id", F.explode("candidates").alias("qid")).join(known, "qid", "left_semi").groupBy("id").count()
    parts.append(each.where("count >= 2").agg(F.count("*").alias("ambiguousMultiPresent")))
    out = None
    for p in parts:
        rows = p.select(F.inline(F.array(*(F.struct(F.lit(c).alias("figure"), F.col(c).alias("n")) for c in p.columns))))
        out = rows if out is None else out.unionByName(rows)
    return out

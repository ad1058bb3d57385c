"""Queries on anchors. Probes stand for the anchors: the concepts of each operation are the named sets, and each probed text is a
case, resolved to the one concept that has it in the corpus or ambiguous between several. Coverage is that of the second system.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fjordlens.operators import anchors
from fjordlens.plans import catalog
from fjordlens.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
SETS = {"resolvedGold": ("S1",), "goldUnion": ("S1", "S3"), "ambiguousCand": ("S4",)}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _sets(spark: SparkSession, d: str) -> DataFrame:
    probe = table(spark, d, "serving_probe").where("Qid is not null")
    named = F.array_compact(F.array(*(F.when(F.col("Op").isin(*ops), F.lit(n)) for n, ops in SETS.items())))
    return probe.select(F.explode(named).alias("set"), F.col("Qid").alias("qid"))


def _cases(spark: SparkSession, d: str) -> DataFrame:
    probe = table(spark, d, "serving_probe").where("Op = 'S2'")
    one = probe.groupBy(F.col("Lang").alias("language"), F.col("Value").alias("term")).agg(F.min("Seq").cast("string").alias("id"), F.min("Stratum").alias("category"))
    found = table(spark, d, "lexical_entry").groupBy(F.col("Lang").alias("language"), F.col("Value").alias("term")).agg(
        F.array_sort(F.collect_set("Qid")).alias("candidates"), F.max("LexKind").alias("kind")  # the concepts of one probed text
    )
    found = found.join(one.select("language", "term"), ["language", "term"], "left_semi")
    rows = one.join(found, ["language", "term"], "left")
    several = F.coalesce(F.size("candidates") > 1, F.lit(False))
    return rows.select(
        "id", "category", "language", "term",
        F.when(F.col("kind") == "label", "CanonicalLabel").when(F.col("kind") == "alias", "WikidataAlias").otherwise("Other").alias("name_type"),
        F.when(several, "ambiguous").otherwise("resolved").alias("status"),
        F.when(~several, F.coalesce(F.col("candidates")[0], F.lit(0))).alias("qid"), F.when(several, F.col("candidates")).alias("candidates"),
    )


_CANDIDATE = """
concept2 AS (SELECT Qid, InT1, InT2 FROM candidate_row WHERE Relation = 'concept'),
lexical2 AS (SELECT Qid, Lang, LexKind, Value FROM candidate_row WHERE Relation = 'lexical_entry')"""
_SETS = "sets AS (" + " UNION ".join(f"SELECT '{n}' AS set, Qid AS qid FROM serving_probe WHERE Qid IS NOT NULL AND Op IN ({', '.join(repr(o) for o in ops)})" for n, ops in SETS.items()) + ")"
_CASES = """
one AS (SELECT Lang AS language, Value AS term, CAST(min(Seq) AS VARCHAR) AS id, min(Stratum) AS category FROM serving_probe WHERE Op = 'S2' GROUP BY 1, 2),
found AS (SELECT o.id, l.Qid AS qid, l.LexKind AS kind FROM one o JOIN lexical_entry l ON l.Lang = o.language AND l.Value = o.term),
cases AS (SELECT o.*, coalesce(f.n, 0) > 1 AS several, CASE f.kind WHEN 'label' THEN 'label' WHEN 'alias' THEN 'alias' END AS kind, coalesce(f.qid, 0) AS qid
  FROM one o LEFT JOIN (SELECT id, count(DISTINCT qid) AS n, max(kind) AS kind, min(qid) AS qid FROM found GROUP BY 1) f ON f.id = o.id)"""


@query(f"""
WITH {_SETS}, {_CANDIDATE}
SELECT set, count(*) AS total, count(*) FILTER (WHERE InT1) AS in_t1, count(*) FILTER (WHERE InT2) AS in_t2, count(*) FILTER (WHERE InT1 AND InT2) AS in_both,
  count(*) FILTER (WHERE InT2 AND NOT InT1) AS in_t2_only, count(c.Qid) AS present, count(*) - count(c.Qid) AS absent
FROM sets LEFT JOIN concept2 c ON c.Qid = sets.qid GROUP BY 1""")
def anchor_coverage(spark: SparkSession, d: str) -> DataFrame:
    """The tiers of the members of each named set in the second system."""
    return anchors.coverage(_sets(spark, d), catalog.candidate(spark, d)["concept"])


@query(f"""
WITH {_CASES}, {_CANDIDATE}
SELECT category, outcome, count(*) AS n FROM (
  SELECT category, CASE WHEN kind IS NULL THEN 'not_applicable_to_baseline_lexical_corpus' WHEN qid NOT IN (SELECT Qid FROM concept2) THEN 'concept_absent'
    WHEN EXISTS (SELECT 1 FROM lexical2 l WHERE l.Qid = c.qid AND l.Lang = c.language AND l.LexKind = c.kind AND l.Value = c.term) THEN 'concept_present_' || kind || '_surface'
    ELSE 'concept_present_surface_absent' END AS outcome FROM cases c WHERE NOT several) GROUP BY 1, 2""")
def anchor_surfaces(spark: SparkSession, d: str) -> DataFrame:
    """What became of the name of each resolved case in the second system, by category."""
    other = catalog.candidate(spark, d)
    out = anchors.surfaces(_cases(spark, d), other["concept"], other["lexical_entry"])
    return out.groupBy("category", "outcome").agg(F.count("*").alias("n"))


@query(f"""
WITH {_CASES}, {_CANDIDATE}
SELECT f.id, count(*) AS candidates, count(*) FILTER (WHERE f.qid IN (SELECT Qid FROM concept2)) AS present,
  count(*) FILTER (WHERE EXISTS (SELECT 1 FROM lexical2 l WHERE l.Qid = f.qid AND l.Lang = c.language AND l.Value = c.term)) AS with_surface
FROM (SELECT DISTINCT id, qid FROM found) f JOIN cases c ON c.id = f.id WHERE several GROUP BY 1""")
def anchor_ambiguous(spark: SparkSession, d: str) -> DataFrame:
    """How many candidates of each ambiguous case the second system has, and with the name."""
    other = catalog.candidate(spark, d)
    return anchors.ambiguous(_cases(spark, d), other["concept"], other["lexical_entry"])


@query(f"""
WITH {_SETS}, {_CASES}, {_CANDIDATE}
SELECT set || 'Present' AS figure, count(c.Qid) AS n FROM sets LEFT JOIN concept2 c ON c.Qid = sets.qid GROUP BY 1
UNION ALL SELECT 'lexicalSurfacePresent', count(*) FROM cases c WHERE EXISTS (SELECT 1 FROM lexical2 l WHERE l.Lang = c.language AND l.Value = c.term)
UNION ALL SELECT 'ambiguousMultiPresent', count(*) FROM (
  SELECT f.id FROM (SELECT DISTINCT id, qid FROM found) f JOIN cases c ON c.id = f.id JOIN concept2 x ON x.Qid = f.qid WHERE several GROUP BY 1 HAVING count(*) >= 2)""")
def continuity(spark: SparkSession, d: str) -> DataFrame:
    """How much of the anchors the second system goes on with."""
    other = catalog.candidate(spark, d)
    return anchors.continuity(_sets(spark, d), _cases(spark, d), other["concept"], other["lexical_entry"])

"""Queries on the make-up of the corpus: tiers, set operations, distributions and integrity gates, with their SQL."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fjordlens.functions import canon, fixed
from fjordlens.operators import tiers
from fjordlens.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _bucket_sql(q: str) -> str:
    return f"(('0x' || substr(sha256('{fixed.SAMPLE_DOMAIN}' || chr(31) || 'uniform' || chr(31) || CAST({q} AS VARCHAR)), 1, 16))::UBIGINT % {fixed.SAMPLE_MODULUS})"


PROFILED = """
profiled AS (SELECT c.Qid AS qid, InT1 AS in_t1, InT2 AS in_t2, l.Qid IS NOT NULL AS has_lexical,
  InT2 AND NOT InT1 AND l.Qid IS NULL AS tail
  FROM concept c LEFT JOIN (SELECT DISTINCT Qid FROM lexical_entry) l ON l.Qid = c.Qid)"""
_TIER = """CASE WHEN in_t1 AND in_t2 THEN 'T1IntersectT2' WHEN in_t1 THEN 'T1Only' WHEN tail THEN 'Tail'
  WHEN in_t2 THEN 'T2Only' ELSE 'None' END"""
_ENDPOINTS = "SELECT SubjectQid AS qid FROM subclass_of UNION SELECT TargetQid FROM subclass_of"


def _profiled(spark: SparkSession, d: str) -> DataFrame:
    return tiers.profiled(table(spark, d, "concept"), table(spark, d, "lexical_entry"))


@query(f"WITH {PROFILED} SELECT qid, {_TIER} AS tier FROM profiled")
def concept_tiers(spark: SparkSession, d: str) -> DataFrame:
    """The tier of each concept."""
    return _profiled(spark, d).select("qid", tiers.tier().alias("tier"))


@query(f"WITH {PROFILED} SELECT {_TIER} AS tier, count(*) AS n FROM profiled GROUP BY 1")
def tier_counts(spark: SparkSession, d: str) -> DataFrame:
    """Concepts per tier."""
    return _profiled(spark, d).groupBy(tiers.tier().alias("tier")).agg(F.count("*").alias("n"))


@query(f"SELECT Qid AS qid, CAST({_bucket_sql('Qid')} AS BIGINT) AS bucket, {_bucket_sql('Qid')} < {fixed.SAMPLE_BELOW} AS sampled FROM concept")
def t1_membership(spark: SparkSession, d: str) -> DataFrame:
    """The sample bucket of each concept and whether it is below the bound."""
    return table(spark, d, "concept").select(
        F.col("Qid").alias("qid"), canon.sample_bucket("Qid").alias("bucket"), canon.sampled("Qid").alias("sampled")
    )


@query("""
SELECT bin, count(*) AS keys, CAST(sum(n) AS BIGINT) AS rows FROM (
  SELECT n, CASE WHEN n = 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN n <= 50 THEN '6-50' ELSE '51+' END AS bin
  FROM (SELECT count(*) AS n FROM lexical_entry GROUP BY Lang, Value)) GROUP BY 1""")
def lex_fanout_bins(spark: SparkSession, d: str) -> DataFrame:
    """How many (language, text) keys have how many rows."""
    n = table(spark, d, "lexical_entry").groupBy("Lang", "Value").agg(F.count("*").alias("n"))
    return n.groupBy(tiers.fanout_bin(F.col("n")).alias("bin")).agg(F.count("*").alias("keys"), F.sum("n").alias("rows"))


# ---- set operations ----
@query(f"WITH {PROFILED} SELECT qid FROM ({_ENDPOINTS}) EXCEPT SELECT qid FROM profiled WHERE NOT tail")
def t2_tail(spark: SparkSession, d: str) -> DataFrame:
    """Subclass endpoints that were never seen as items."""
    seen = _profiled(spark, d).where("not tail").select("qid")
    return tiers.endpoints(table(spark, d, "subclass_of")).join(seen, "qid", "left_anti")


@query(f"SELECT Qid AS qid FROM concept WHERE InT1 UNION {_ENDPOINTS}")
def t1_union_t2(spark: SparkSession, d: str) -> DataFrame:
    """Retained concepts: the sample and the endpoints."""
    t1 = table(spark, d, "concept").where("InT1").select(F.col("Qid").alias("qid"))
    return t1.union(tiers.endpoints(table(spark, d, "subclass_of"))).distinct()


@query(f"SELECT Qid AS qid FROM concept WHERE InT1 INTERSECT ({_ENDPOINTS})")
def t1_intersect_t2(spark: SparkSession, d: str) -> DataFrame:
    """Sampled concepts that are endpoints too."""
    t1 = table(spark, d, "concept").where("InT1").select(F.col("Qid").alias("qid"))
    return t1.join(tiers.endpoints(table(spark, d, "subclass_of")), "qid", "left_semi").distinct()


@query(f"""
WITH l AS (SELECT Qid, bool_or(Lang = 'en') AS en, bool_or(Lang = 'nb') AS nb FROM lexical_entry WHERE LexKind = 'label' GROUP BY 1)
SELECT count(*) AS concepts, count(*) FILTER (WHERE l.en) AS with_en, count(*) FILTER (WHERE l.nb) AS with_nb,
  count(*) FILTER (WHERE l.en AND l.nb) AS with_both
FROM concept c JOIN ({_ENDPOINTS}) e ON e.qid = c.Qid LEFT JOIN l ON l.Qid = c.Qid WHERE NOT c.InT1""")
def t2_label_presence(spark: SparkSession, d: str) -> DataFrame:
    """Labels of the endpoints outside the sample."""
    labels = (
        table(spark, d, "lexical_entry").where("LexKind = 'label'").groupBy(F.col("Qid").alias("qid"))
        .agg(F.bool_or(F.col("Lang") == "en").alias("en"), F.bool_or(F.col("Lang") == "nb").alias("nb"))
    )
    rows = table(spark, d, "concept").where("not InT1").select(F.col("Qid").alias("qid"))
    rows = rows.join(tiers.endpoints(table(spark, d, "subclass_of")), "qid", "left_semi").join(labels, "qid", "left")
    return rows.agg(
        F.count("*").alias("concepts"), F.count_if("en").alias("with_en"), F.count_if("nb").alias("with_nb"),
        F.count_if(F.col("en") & F.col("nb")).alias("with_both"),
    )


# ---- distributions ----
@query("SELECT count(DISTINCT SubjectQid) AS subjects, count(DISTINCT TargetQid) AS targets FROM subclass_of")
def subclass_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Distinct children and parents."""
    edges = table(spark, d, "subclass_of")
    # two distinct counts in one pass would expand every row; a pass each combines before it shuffles
    subjects = edges.select("SubjectQid").distinct().agg(F.count("SubjectQid").alias("subjects"))
    return subjects.withColumn("targets", edges.select("TargetQid").distinct().agg(F.count("TargetQid").alias("t")).scalar())


@query("""
SELECT Lang AS lang, LexKind AS lex_kind, count(*) AS n, CAST(sum(length(Value)) AS BIGINT) AS units,
  round(CAST(sum(length(Value)) AS DOUBLE) / count(*), 6) AS mean_length
FROM lexical_entry GROUP BY 1, 2""")
def lex_mean_len(spark: SparkSession, d: str) -> DataFrame:
    """Mean length of texts in UTF-16 units, per language and kind."""
    units = F.sum(canon.utf16_length("Value").cast("bigint"))
    return table(spark, d, "lexical_entry").groupBy(F.col("Lang").alias("lang"), F.col("LexKind").alias("lex_kind")).agg(
        F.count("*").alias("n"), units.alias("units"), F.round(units / F.count("*"), 6).alias("mean_length")
    )


def _both_edges(spark: SparkSession, d: str) -> DataFrame:
    return reduce(
        DataFrame.unionByName,
        (table(spark, d, n).select(F.lit(n).alias("relation"), "SubjectQid", "TargetQid") for n in ("instance_of", "subclass_of")),
    )


def _hist(spark: SparkSession, d: str, by: str, overflow: int | None = None) -> DataFrame:
    """(relation, degree, n): histogram of rows per ``by``; few distinct degrees, whatever the size of the relation."""
    deg = _both_edges(spark, d).groupBy("relation", by).agg(F.count("*").alias("degree"))
    value = F.least("degree", F.lit(overflow)) if overflow else F.col("degree")
    return deg.groupBy("relation", value.alias("degree")).agg(F.count("*").alias("n"))


_EDGES2 = "(SELECT 'instance_of' AS relation, SubjectQid, TargetQid FROM instance_of UNION ALL SELECT 'subclass_of', SubjectQid, TargetQid FROM subclass_of)"


@query(f"""
SELECT relation, least(c, {fixed.DEGREE_OVERFLOW}) AS degree, count(*) AS n
FROM (SELECT relation, SubjectQid, count(*) AS c FROM {_EDGES2} GROUP BY 1, 2) GROUP BY 1, 2""")
def degree_hist(spark: SparkSession, d: str) -> DataFrame:
    """Histogram of links per subject, with one bin from the overflow on."""
    return _hist(spark, d, "SubjectQid", fixed.DEGREE_OVERFLOW)


def _from_hist(hist: DataFrame, rank) -> Column:
    return F.min(F.when(F.col("upto") >= rank, F.col("degree")))


def _cumulated(hist: DataFrame) -> DataFrame:
    w = Window.partitionBy("relation")
    return hist.withColumn("upto", F.sum("n").over(w.orderBy("degree"))).withColumn("total", F.sum("n").over(w))


@query(f"""
SELECT relation, count(*) AS subjects, min(c) AS min, max(c) AS max, quantile_disc(c, 0.5) AS median, quantile_disc(c, 0.9) AS p90,
  quantile_disc(c, 0.95) AS p95, quantile_disc(c, 0.99) AS p99, round(CAST(sum(c) AS DOUBLE) / count(*), 6) AS mean
FROM (SELECT relation, SubjectQid, count(*) AS c FROM {_EDGES2} GROUP BY 1, 2) GROUP BY 1""")
def degree_stats(spark: SparkSession, d: str) -> DataFrame:
    """Distribution of links per subject; a quantile is the smallest degree that covers it."""
    cum = _cumulated(_hist(spark, d, "SubjectQid"))
    at = {"median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    return cum.groupBy("relation").agg(
        F.max("total").alias("subjects"), F.min("degree").alias("min"), F.max("degree").alias("max"),
        *(_from_hist(cum, F.ceil(F.col("total") * F.lit(q))).alias(k) for k, q in at.items()),
        F.round(F.sum(F.col("degree") * F.col("n")) / F.max("total"), 6).alias("mean"),
    )


@query(f"""
WITH f AS (SELECT relation, c, row_number() OVER (PARTITION BY relation ORDER BY c) - 1 AS k, count(*) OVER (PARTITION BY relation) AS n
  FROM (SELECT relation, TargetQid, count(*) AS c FROM {_EDGES2} GROUP BY 1, 2))
SELECT relation, max(n) AS targets, min(c) AS min, max(c) AS max, max(c) FILTER (WHERE k = floor((n - 1) * 0.5)) AS median,
  max(c) FILTER (WHERE k = floor((n - 1) * 0.9)) AS p90, max(c) FILTER (WHERE k = floor((n - 1) * 0.99)) AS p99
FROM f GROUP BY 1""")
def fanout_stats(spark: SparkSession, d: str) -> DataFrame:
    """Distribution of links per target; a quantile is the value at rank floor((n - 1) q)."""
    cum = _cumulated(_hist(spark, d, "TargetQid"))
    at = {"median": 0.5, "p90": 0.9, "p99": 0.99}
    return cum.groupBy("relation").agg(
        F.max("total").alias("targets"), F.min("degree").alias("min"), F.max("degree").alias("max"),
        *(_from_hist(cum, F.floor((F.col("total") - 1) * F.lit(q)) + 1).alias(k) for k, q in at.items()),
    )


@query(f"SELECT target, fanout, row_number() OVER (ORDER BY fanout DESC, target) AS rank FROM (SELECT TargetQid AS target, count(*) AS fanout FROM instance_of GROUP BY 1) ORDER BY rank LIMIT {fixed.PROBE_HINTS}")
def probe_hints(spark: SparkSession, d: str) -> DataFrame:
    """The 200 instance-of targets with the most links, ranked (a top-k report)."""
    fan = table(spark, d, "instance_of").groupBy(F.col("TargetQid").alias("target")).agg(F.count("*").alias("fanout"))
    top = fan.orderBy(F.desc("fanout"), "target").limit(fixed.PROBE_HINTS)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("fanout"), "target")))  # of 200 rows


@query(f"""
WITH {PROFILED}
SELECT CASE WHEN p.in_t1 THEN 'T1' ELSE 'T2Only' END AS tier, l.Lang AS lang,
  count(*) FILTER (WHERE l.LexKind = 'label') AS labels, count(*) FILTER (WHERE l.LexKind = 'alias') AS aliases,
  count(*) FILTER (WHERE l.Value = '') AS empty
FROM lexical_entry l JOIN profiled p ON p.qid = l.Qid GROUP BY 1, 2""")
def lexical_decomposition(spark: SparkSession, d: str) -> DataFrame:
    """Labels, aliases and empty texts by tier and language."""
    rows = table(spark, d, "lexical_entry").join(table(spark, d, "concept"), "Qid")
    return rows.groupBy(F.when(F.col("InT1"), "T1").otherwise("T2Only").alias("tier"), F.col("Lang").alias("lang")).agg(
        F.count_if(F.col("LexKind") == "label").alias("labels"), F.count_if(F.col("LexKind") == "alias").alias("aliases"),
        F.count_if(F.col("Value") == "").alias("empty"),
    )


@query(f"""
WITH {PROFILED}, s AS (SELECT count(*) AS n, count(*) FILTER (WHERE in_t1) AS t1 FROM profiled WHERE NOT tail)
SELECT n, t1, round(n * 0.025::DOUBLE, 6) AS expected, t1 - CAST(round_even(n * 0.025, 0) AS BIGINT) AS difference,
  round(CAST(t1 AS DOUBLE) / n, 9) AS fraction, round((t1 - n * 0.025) / sqrt(n * 0.025 * 0.975), 6) AS z FROM s""")
def sample_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """How far the sample is from its nominal share of the observed concepts."""
    s = _profiled(spark, d).where("not tail").agg(F.count("*").alias("n"), F.count_if("in_t1").alias("t1"))
    p = fixed.SAMPLE_BELOW / fixed.SAMPLE_MODULUS
    e = F.col("n") * F.lit(p)
    return s.select(
        "n", "t1", F.round(e, 6).alias("expected"), (F.col("t1") - F.bround(e, 0).cast("bigint")).alias("difference"),
        F.round(F.col("t1") / F.col("n"), 9).alias("fraction"),
        F.round((F.col("t1") - e) / F.sqrt(e * F.lit(1 - p)), 6).alias("z"),
    )


@query(f"""
WITH d AS (
  SELECT 'instance_of' AS relation, c.Qid, coalesce(n, 0) AS k FROM concept c LEFT JOIN (SELECT SubjectQid, count(*) AS n FROM instance_of GROUP BY 1) e ON e.SubjectQid = c.Qid WHERE InT1
  UNION ALL
  SELECT 'subclass_of', c.Qid, coalesce(n, 0) FROM concept c LEFT JOIN (SELECT SubjectQid, count(*) AS n FROM subclass_of GROUP BY 1) e ON e.SubjectQid = c.Qid WHERE InT1)
SELECT relation, count(*) AS concepts, count(*) FILTER (WHERE k = 0) AS zero, min(k) AS min, max(k) AS max, quantile_disc(k, 0.5) AS median,
  quantile_disc(k, 0.9) AS p90, quantile_disc(k, 0.95) AS p95, quantile_disc(k, 0.99) AS p99, round(CAST(sum(k) AS DOUBLE) / count(*), 4) AS mean
FROM d GROUP BY 1""")
def t1_degrees(spark: SparkSession, d: str) -> DataFrame:
    """Distribution of links per sampled concept, those without links filled in with 0."""
    t1 = table(spark, d, "concept").where("InT1").select(F.col("Qid").alias("qid"))
    parts = []
    for name in ("instance_of", "subclass_of"):
        deg = t1.join(tiers.out_degree(table(spark, d, name), "k"), "qid", "left").select(F.lit(name).alias("relation"), F.coalesce("k", F.lit(0)).alias("degree"))
        parts.append(deg.groupBy("relation", "degree").agg(F.count("*").alias("n")))
    cum = _cumulated(parts[0].unionByName(parts[1]))
    at = {"median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    return cum.groupBy("relation").agg(
        F.max("total").alias("concepts"), F.sum(F.when(F.col("degree") == 0, F.col("n")).otherwise(0)).alias("zero"), F.min("degree").alias("min"),
        F.max("degree").alias("max"), *(_from_hist(cum, F.ceil(F.col("total") * F.lit(q))).alias(k) for k, q in at.items()),
        F.round(F.sum(F.col("degree") * F.col("n")) / F.max("total"), 4).alias("mean"),
    )


_HINTED = "SELECT TargetQid AS target, count(*) AS full_fanout FROM (SELECT TargetQid FROM instance_of UNION ALL SELECT TargetQid FROM candidate_row WHERE Relation = 'instance_of') GROUP BY 1"


@query(f"""
WITH h AS (SELECT * FROM ({_HINTED}) ORDER BY full_fanout DESC, target LIMIT {fixed.PROBE_HINTS}),
s AS (SELECT TargetQid AS target, count(*) AS n FROM instance_of GROUP BY 1),
x AS (SELECT h.target, full_fanout, coalesce(s.n, 0) AS sampled, full_fanout * 0.025::DOUBLE AS e FROM h LEFT JOIN s ON s.target = h.target)
SELECT target, full_fanout, sampled, round(e, 4) AS expected, round(sampled / e, 4) AS ratio FROM x""")
def hint_ratios(spark: SparkSession, d: str) -> DataFrame:
    """The commonest targets of a wider source (the relation and its copy stand for it) with their links in the sample, and
    how these compare with the share that was sampled (a top-k report)."""
    inst = table(spark, d, "instance_of").select("TargetQid")
    wider = inst.unionByName(table(spark, d, "candidate_row").where("Relation = 'instance_of'").select("TargetQid"))
    fan = lambda df, n: df.groupBy(F.col("TargetQid").alias("target")).agg(F.count("*").alias(n))
    hints = fan(wider, "full_fanout").orderBy(F.desc("full_fanout"), "target").limit(fixed.PROBE_HINTS)
    e = F.col("full_fanout") * F.lit(fixed.SAMPLE_BELOW / fixed.SAMPLE_MODULUS)
    sampled = F.coalesce("n", F.lit(0))
    return hints.join(fan(inst, "n"), "target", "left").select("target", "full_fanout", sampled.alias("sampled"), F.round(e, 4).alias("expected"), F.round(sampled / e, 4).alias("ratio"))


# ---- integrity gates: (relation, gate, violations) ----
def _gate(relation: str, name: str, violations: Column) -> Column:
    return F.struct(F.lit(relation).alias("relation"), F.lit(name).alias("gate"), F.coalesce(violations.cast("bigint"), F.lit(0)).alias("violations"))


def _gates(df: DataFrame, *gates: Column) -> DataFrame:
    """One pass over ``df`` for all its gates."""
    return df.agg(F.array(*gates).alias("g")).select(F.inline("g"))


def _count(df: DataFrame, relation: str, name: str) -> DataFrame:
    return df.agg(F.count("*").alias("violations")).select(F.lit(relation).alias("relation"), F.lit(name).alias("gate"), "violations")


def _gate_sql(relation: str, name: str, source: str) -> str:
    return f"SELECT '{relation}' AS relation, '{name}' AS gate, count(*) AS violations FROM ({source})"


@query("\nUNION ALL\n".join([
    _gate_sql("concept", "no_tier", "SELECT 1 FROM concept WHERE NOT InT1 AND NOT InT2"),
    _gate_sql("concept", "t1_without_hash", f"SELECT 1 FROM concept WHERE InT1 AND {_bucket_sql('Qid')} >= {fixed.SAMPLE_BELOW}"),
    _gate_sql("concept", "hash_without_t1", f"SELECT 1 FROM concept c WHERE NOT InT1 AND {_bucket_sql('Qid')} < {fixed.SAMPLE_BELOW} AND EXISTS (SELECT 1 FROM lexical_entry l WHERE l.Qid = c.Qid)"),
    _gate_sql("concept", "repeated_qid", "SELECT Qid FROM concept GROUP BY 1 HAVING count(*) > 1"),
]))
def concept_gates(spark: SparkSession, d: str) -> DataFrame:
    """Flags, sample predicate (of concepts that are no tail) and uniqueness of concepts."""
    rows = _profiled(spark, d)
    hit = canon.sampled("qid")
    one = _gates(
        rows,
        _gate("concept", "no_tier", F.count_if(~F.col("in_t1") & ~F.col("in_t2"))),
        _gate("concept", "t1_without_hash", F.count_if(F.col("in_t1") & ~hit)),
        _gate("concept", "hash_without_t1", F.count_if(~F.col("in_t1") & hit & F.col("has_lexical"))),
    )
    again = table(spark, d, "concept").groupBy("Qid").count().where("count > 1")
    return one.unionByName(_count(again, "concept", "repeated_qid"))


@query("\nUNION ALL\n".join([
    _gate_sql("lexical_entry", "language", "SELECT 1 FROM lexical_entry WHERE Lang NOT IN ('en', 'nb')"),
    _gate_sql("lexical_entry", "kind", "SELECT 1 FROM lexical_entry WHERE LexKind NOT IN ('label', 'alias')"),
    _gate_sql("lexical_entry", "t2_only_alias", "SELECT 1 FROM lexical_entry l JOIN concept c ON c.Qid = l.Qid WHERE LexKind = 'alias' AND NOT InT1"),
    _gate_sql("lexical_entry", "no_concept", "SELECT 1 FROM lexical_entry l LEFT JOIN concept c ON c.Qid = l.Qid WHERE c.Qid IS NULL"),
    _gate_sql("lexical_entry", "repeated_row", "SELECT 1 FROM lexical_entry GROUP BY Qid, Lang, LexKind, Value HAVING count(*) > 1"),
    _gate_sql("lexical_entry", "several_labels", "SELECT 1 FROM lexical_entry WHERE LexKind = 'label' GROUP BY Qid, Lang HAVING count(*) > 1"),
]))
def lexical_gates(spark: SparkSession, d: str) -> DataFrame:
    """Domains, tiers and uniqueness of lexical rows."""
    lexical = table(spark, d, "lexical_entry")
    concept = table(spark, d, "concept").withColumn("known", F.lit(True))
    one = _gates(
        lexical.join(concept, "Qid", "left"),
        _gate("lexical_entry", "language", F.count_if(~F.col("Lang").isin("en", "nb"))),
        _gate("lexical_entry", "kind", F.count_if(~F.col("LexKind").isin("label", "alias"))),
        _gate("lexical_entry", "t2_only_alias", F.count_if((F.col("LexKind") == "alias") & ~F.col("InT1"))),
        _gate("lexical_entry", "no_concept", F.count_if(F.col("known").isNull())),
    )
    rows = lexical.groupBy("Qid", "Lang", "LexKind", "Value").count()
    labels = lexical.where("LexKind = 'label'").groupBy("Qid", "Lang").count()
    return one.unionByName(_count(rows.where("count > 1"), "lexical_entry", "repeated_row")).unionByName(
        _count(labels.where("count > 1"), "lexical_entry", "several_labels")
    )


@query("\nUNION ALL\n".join([
    _gate_sql("instance_of", "subject_unknown", "SELECT 1 FROM instance_of e LEFT JOIN concept c ON c.Qid = e.SubjectQid WHERE c.Qid IS NULL"),
    _gate_sql("instance_of", "subject_not_t1", "SELECT 1 FROM instance_of e JOIN concept c ON c.Qid = e.SubjectQid WHERE NOT InT1"),
    _gate_sql("instance_of", "target_not_positive", "SELECT 1 FROM instance_of WHERE TargetQid <= 0"),
    _gate_sql("subclass_of", "subject_not_t2", "SELECT 1 FROM subclass_of e LEFT JOIN concept c ON c.Qid = e.SubjectQid AND c.InT2 WHERE c.Qid IS NULL"),
    _gate_sql("subclass_of", "target_not_t2", "SELECT 1 FROM subclass_of e LEFT JOIN concept c ON c.Qid = e.TargetQid AND c.InT2 WHERE c.Qid IS NULL"),
    _gate_sql("subclass_of", "t2_without_link", f"SELECT Qid FROM concept WHERE InT2 EXCEPT ({_ENDPOINTS})"),
    _gate_sql("subclass_of", "repeated_link", "SELECT 1 FROM subclass_of GROUP BY SubjectQid, TargetQid HAVING count(*) > 1"),
    _gate_sql("instance_of", "repeated_link", "SELECT 1 FROM instance_of GROUP BY SubjectQid, TargetQid HAVING count(*) > 1"),
]))
def edge_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Endpoints and uniqueness of links."""
    inst, sub = table(spark, d, "instance_of"), table(spark, d, "subclass_of")
    concept = table(spark, d, "concept")
    known = concept.select(F.col("Qid").alias("SubjectQid"), F.col("InT1").alias("t1"))
    one = _gates(
        # equal links first: each is looked up once, with its number
        inst.groupBy("SubjectQid", "TargetQid").agg(F.count("*").alias("n")).join(known, "SubjectQid", "left"),
        _gate("instance_of", "subject_unknown", F.sum(F.when(F.col("t1").isNull(), F.col("n")))),
        _gate("instance_of", "subject_not_t1", F.sum(F.when(~F.col("t1"), F.col("n")))),
        _gate("instance_of", "target_not_positive", F.sum(F.when(F.col("TargetQid") <= 0, F.col("n")))),
        _gate("instance_of", "repeated_link", F.count_if(F.col("n") > 1)),
    )
    # both ends of all links against the concepts, in one join of numbers per end
    ends = (
        sub.select(F.explode(F.array(F.struct(F.lit("s").alias("end"), F.col("SubjectQid").alias("qid")), F.struct(F.lit("t").alias("end"), F.col("TargetQid").alias("qid")))).alias("e"))
        .select("e.*").groupBy("qid").agg(F.count_if(F.col("end") == "s").alias("s"), F.count_if(F.col("end") == "t").alias("t"))
    )
    t2 = concept.where("InT2").select(F.col("Qid").alias("qid"), F.lit(True).alias("t2")).distinct()
    both = _gates(
        ends.join(t2, "qid", "full"),
        _gate("subclass_of", "subject_not_t2", F.sum(F.when(F.col("t2").isNull(), F.col("s")))),
        _gate("subclass_of", "target_not_t2", F.sum(F.when(F.col("t2").isNull(), F.col("t")))),
        _gate("subclass_of", "t2_without_link", F.count_if(F.col("s").isNull())),
    )
    again = _count(sub.groupBy("SubjectQid", "TargetQid").count().where("count > 1"), "subclass_of", "repeated_link")
    return one.unionByName(both).unionByName(again)


def _order_sql(name: str, first: str, second: str) -> str:
    lag = f"SELECT {first} AS a, {second} AS b, lag({first}) OVER (ORDER BY RowId) AS pa, lag({second}) OVER (ORDER BY RowId) AS pb, row_number() OVER (ORDER BY RowId) AS r FROM {name}"
    return (
        _gate_sql(name, "group_order", f"SELECT 1 FROM ({lag}) WHERE r > 1 AND a < pa")
        + "\nUNION ALL\n"
        + _gate_sql(name, "strict_order", f"SELECT 1 FROM ({lag}) WHERE r > 1 AND a = pa AND b <= pb")
    )


_LEX_KEY = "Lang || chr(31) || CASE WHEN LexKind = 'label' THEN '0' ELSE '1' END || chr(31) || Value"


@query("\nUNION ALL\n".join([
    _order_sql("instance_of", "SubjectQid", "TargetQid"), _order_sql("subclass_of", "SubjectQid", "TargetQid"), _order_sql("lexical_entry", "Qid", _LEX_KEY),
]))
def order_gates(spark: SparkSession, d: str) -> DataFrame:
    """Rows, in the order of RowId, that go back in their group's order or do not ascend strictly within it.

    Rows are sorted by ranges; each range compares neighbours as they stream by and gives one row with its counts and its
    ends, and the ends of neighbouring ranges are compared on the driver. There is no window and no self-join."""
    lex = F.concat_ws("\x1f", "Lang", F.when(F.col("LexKind") == "label", "0").otherwise("1"), "Value")
    out = []
    for name, a, b in (("instance_of", "SubjectQid", F.col("TargetQid")), ("subclass_of", "SubjectQid", F.col("TargetQid")), ("lexical_entry", "Qid", canon.ordinal(lex))):
        rows = table(spark, d, name).select("RowId", F.col(a).alias("a"), b.alias("b"))
        kind = dict(rows.dtypes)["b"]
        schema = f"part int, back bigint, flat bigint, a0 bigint, b0 {kind}, a1 bigint, b1 {kind}"
        laid = rows.repartitionByRange("RowId").sortWithinPartitions("RowId").select("a", "b")
        ranges = laid.mapInArrow(_neighbours, schema).orderBy("part").collect()  # one row per range
        back, flat = (sum(r[c] for r in ranges) for c in ("back", "flat"))
        for before, r in zip(ranges, ranges[1:]):
            back += before.a1 is not None and r.a0 is not None and r.a0 < before.a1
            flat += before.a1 == r.a0 is not None and before.b1 is not None and r.b0 is not None and r.b0 <= before.b1
        out += [(name, "group_order", back), (name, "strict_order", flat)]
    return spark.createDataFrame(out, "relation string, gate string, violations bigint")


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of neighbours out of order in one sorted range, and its first and last row; nothing for an empty one."""
    first = last = None
    back = flat = 0
    for t in batches:
        if not t.num_rows:
            continue
        a, b = t.column(0), t.column(1)
        if last is not None:  # the last row of the batch before
            a, b = pa.concat_arrays([last[0], a]), pa.concat_arrays([last[1], b])
        first = first or (a[:1], b[:1])
        n = len(a) - 1
        same = pc.equal(a[1:], a[:n])
        back += pc.sum(pc.less(a[1:], a[:n])).as_py() or 0
        flat += pc.sum(pc.and_(same, pc.less_equal(b[1:], b[:n]))).as_py() or 0
        last = (a[n:], b[n:])
    if first is not None:
        one = lambda x: pa.array([x], pa.int64())
        part = pa.array([TaskContext.get().partitionId()], pa.int32())
        yield pa.RecordBatch.from_arrays([part, one(back), one(flat), *first, *last], ["part", "back", "flat", "a0", "b0", "a1", "b1"])

"""Queries that judge and summarize timed samples, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fjordlens.functions import fixed
from fjordlens.operators import hot_keys, repetitions
from fjordlens.plans import catalog
from fjordlens.plans.runtime import Scratch
from fjordlens.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
PERCENTS = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


# A sample that is delivered again counts once: its first delivery.
_FIRST = """
s AS (SELECT * EXCLUDE (k), upper(Operation) AS op FROM (
  SELECT *, row_number() OVER (PARTITION BY SampleId ORDER BY IngestedAt, FinishedAt) AS k FROM g1_timed_sample) WHERE k = 1 OR SampleId IS NULL)"""
_LIMIT = f"CASE WHEN op LIKE 'S%' THEN {fixed.LIMIT_POINT} WHEN op = 'G1' THEN {fixed.LIMIT_G1} ELSE {fixed.LIMIT_G2} END"
_STATUS = f"""CASE WHEN CorrectnessStatus = 'ERROR' THEN 'ERROR' WHEN CorrectnessStatus = 'INVALID' THEN 'INVALID'
  WHEN NOT isnan(WallSeconds) AND WallSeconds >= {_LIMIT} THEN 'TIMEOUT' ELSE 'VALID' END"""


def samples(spark: SparkSession, d: str) -> DataFrame:
    """Each sample once, its operation in one case (``op``). Of deliveries of the same times the smallest row counts; rows without
    an id are kept apart."""
    raw = table(spark, d, "g1_timed_sample")
    kept = ["IngestedAt", "FinishedAt", "RunId", "Repetition", "Operation", "Sequence", "Stratum", "WallSeconds", "CorrectnessStatus", "ActualCardinality", "ActualVisited", "ActualDigest"]
    lone = F.when(F.col("SampleId").isNull(), F.monotonically_increasing_id())
    first = raw.groupBy("SampleId", lone.alias("_lone")).agg(F.min(F.struct(*kept)).alias("s"))
    return first.select("SampleId", "s.*").withColumn("op", F.upper("Operation"))


def status() -> Column:
    limit = F.when(F.col("op").startswith("S"), fixed.LIMIT_POINT).when(F.col("op") == "G1", fixed.LIMIT_G1).otherwise(fixed.LIMIT_G2)
    late = ~F.isnan("WallSeconds") & (F.col("WallSeconds") >= limit)
    return (
        F.when(F.col("CorrectnessStatus") == "ERROR", "ERROR").when(F.col("CorrectnessStatus") == "INVALID", "INVALID")
        .when(late, "TIMEOUT").otherwise("VALID")
    )


@query(f"WITH {_FIRST} SELECT op AS operation, Stratum AS stratum, {_STATUS} AS status, count(*) AS n FROM s GROUP BY 1, 2, 3")
def point_status(spark: SparkSession, d: str) -> DataFrame:
    """Samples by verdict: an error beats an invalid result, which beats a time limit (NaN reaches none)."""
    return samples(spark, d).groupBy(F.col("op").alias("operation"), F.col("Stratum").alias("stratum"), status().alias("status")).agg(F.count("*").alias("n"))


_TIMED = "WallSeconds IS NOT NULL AND NOT isnan(WallSeconds) AND WallSeconds > 0"


def _timed(spark: SparkSession, d: str, *more: str) -> DataFrame:
    rows = samples(spark, d).where((status() == "VALID") & ~F.isnan("WallSeconds") & (F.col("WallSeconds") > 0))
    return rows.select(F.col("op").alias("operation"), F.col("Stratum").alias("stratum"), *more, F.col("WallSeconds").alias("seconds"))


def _percent_sql() -> str:
    return ", ".join(f"round(quantile_cont(WallSeconds, {q}), 9) AS {n}" for n, q in PERCENTS.items())


@query(f"WITH {_FIRST} SELECT op AS operation, Stratum AS stratum, count(*) AS n, {_percent_sql()} FROM s WHERE {_STATUS} = 'VALID' AND {_TIMED} GROUP BY 1, 2")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact interpolated percentiles of valid wall times; a stratum that holds most samples spans many tasks."""
    scratch, keys = Scratch(spark, "latency"), ["operation", "stratum"]
    weighted = scratch.cut(hot_keys.compress(_timed(spark, d), keys, "seconds"))
    out = hot_keys.linear_percentiles(weighted, keys, PERCENTS, scratch)
    return out.select(*keys, "n", *(F.round(n, 9).alias(n) for n in PERCENTS))


_SUM = "CAST(sum(CAST(WallSeconds AS DECIMAL(28, 10))) AS DOUBLE)"
_REP = f"""
WITH {_FIRST}
SELECT op AS operation, Stratum AS stratum, RunId AS run_id, Repetition AS repetition, count(*) AS n, min(WallSeconds) AS min, max(WallSeconds) AS max,
  {_percent_sql()}, round({_SUM} / count(*), 12) AS mean, round(count(*) / {_SUM}, 2) AS throughput
FROM s WHERE {_STATUS} = 'VALID' AND {_TIMED} GROUP BY 1, 2, 3, 4"""


@query(_REP)
def rep_summary(spark: SparkSession, d: str) -> DataFrame:
    """Summary of each repetition of each run, by operation and stratum."""
    scratch, keys = Scratch(spark, "rep"), ["operation", "stratum", "run_id", "repetition"]
    rows = _timed(spark, d, F.col("RunId").alias("run_id"), F.col("Repetition").alias("repetition"))
    weighted = scratch.cut(hot_keys.compress(rows, keys, "seconds"))
    total = F.sum(F.col("value").cast("decimal(18,10)") * F.col("weight").cast("decimal(18,0)")).cast("double")
    sums = weighted.groupBy(*keys).agg(
        F.min("value").alias("min"), F.max("value").alias("max"), F.round(total / F.sum("weight"), 12).alias("mean"),
        F.round(F.sum("weight") / total, 2).alias("throughput"),
    ).withColumnsRenamed({k: f"_{k}" for k in keys})
    out = hot_keys.linear_percentiles(weighted, keys, PERCENTS, scratch)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return out.join(sums, same).select(*keys, "n", "min", "max", *(F.round(n, 9).alias(n) for n in PERCENTS), "mean", "throughput")


@query(f"""
SELECT operation, stratum, count(*) AS repetitions, round(median(p50), 9) AS p50, round(median(p95), 9) AS p95, round(median(throughput), 2) AS throughput
FROM ({_REP}) GROUP BY 1, 2""")
def cross_rep_median(spark: SparkSession, d: str) -> DataFrame:
    """Medians over the repetitions' summaries, of which there are few."""
    return rep_summary(spark, d).groupBy("operation", "stratum").agg(
        F.count("*").alias("repetitions"), F.round(F.median("p50"), 9).alias("p50"), F.round(F.median("p95"), 9).alias("p95"),
        F.round(F.median("throughput"), 2).alias("throughput"),
    )


@query(f"""
WITH {_FIRST},
need AS (SELECT Op AS op, Stratum, count(DISTINCT Seq) AS n FROM graph_probe WHERE Measured GROUP BY 1, 2),
got AS (SELECT op, Stratum, RunId, Repetition, count(DISTINCT Sequence) AS n, bool_or(st = 'INVALID') AS i, bool_or(st = 'TIMEOUT') AS t, bool_or(st = 'ERROR') AS e
  FROM (SELECT *, {_STATUS} AS st FROM s) GROUP BY 1, 2, 3, 4)
SELECT got.op AS operation, got.Stratum AS stratum, RunId AS run_id, Repetition AS repetition, got.n AS sequences,
  array_to_string(list_filter([CASE WHEN got.n < coalesce(need.n, 0) THEN 'MissingSamples' END, CASE WHEN i THEN 'InvalidSample' END,
    CASE WHEN t THEN 'TimeoutSample' END, CASE WHEN e THEN 'ErrorSample' END], lambda x: x IS NOT NULL), ',') AS reasons
FROM got LEFT JOIN need ON need.op = got.op AND need.Stratum = got.Stratum""")
def rep_readiness(spark: SparkSession, d: str) -> DataFrame:
    """Why a repetition is not complete: missing, invalid, late or failed samples, in that order."""
    probes = table(spark, d, "graph_probe").where("Measured")
    need = probes.groupBy(F.col("Op").alias("operation"), F.col("Stratum").alias("stratum")).agg(F.countDistinct("Seq").alias("need"))
    rows = samples(spark, d).withColumn("st", status())
    got = rows.groupBy(F.col("op").alias("operation"), F.col("Stratum").alias("stratum"), F.col("RunId").alias("run_id"), F.col("Repetition").alias("repetition")).agg(
        F.countDistinct("Sequence").alias("sequences"), *(F.bool_or(F.col("st") == x).alias(x) for x in ("INVALID", "TIMEOUT", "ERROR"))
    )
    why = F.array_compact(F.array(
        F.when(F.col("sequences") < F.coalesce("need", F.lit(0)), "MissingSamples"), F.when(F.col("INVALID"), "InvalidSample"),
        F.when(F.col("TIMEOUT"), "TimeoutSample"), F.when(F.col("ERROR"), "ErrorSample"),
    ))
    return got.join(need, ["operation", "stratum"], "left").select("operation", "stratum", "run_id", "repetition", "sequences", F.array_join(why, ",").alias("reasons"))


# ---- three repetitions of a campaign ----
_CAMPAIGN = f"""
WITH {_FIRST},
need AS (SELECT Op AS operation, Stratum AS stratum, count(DISTINCT Seq) AS expected FROM graph_probe WHERE Measured AND Stratum IS NOT NULL GROUP BY 1, 2),
x AS (SELECT regexp_replace(RunId, '-[0-9]+$', '') AS campaign, Repetition AS repetition, op AS operation, Stratum AS stratum, Sequence, {_STATUS} AS st FROM s),
runs AS (SELECT DISTINCT campaign, repetition FROM x),
grid AS (SELECT c.campaign, r.repetition, need.* FROM (SELECT DISTINCT campaign FROM runs) c, (VALUES (1), (2), (3)) r(repetition), need),
got AS (SELECT campaign, repetition, operation, stratum, count(*) AS observed, count(DISTINCT Sequence) AS sequences, count(*) FILTER (WHERE st = 'VALID') AS valid,
  count(*) FILTER (WHERE st = 'INVALID') AS invalid, count(*) FILTER (WHERE st = 'TIMEOUT') AS timeout, count(*) FILTER (WHERE st = 'ERROR') AS error FROM x GROUP BY 1, 2, 3, 4),
j AS (SELECT g.*, runs.campaign IS NOT NULL AS attempted, coalesce(sequences, 0) AS sequences, coalesce(observed, 0) AS observed, coalesce(valid, 0) AS valid,
  coalesce(invalid, 0) AS invalid, coalesce(timeout, 0) AS timeout, coalesce(error, 0) AS error
  FROM grid g LEFT JOIN runs ON runs.campaign = g.campaign AND runs.repetition = g.repetition
  LEFT JOIN got ON got.campaign = g.campaign AND got.repetition = g.repetition AND got.operation = g.operation AND got.stratum = g.stratum),
summary AS (SELECT campaign, operation, stratum, repetition, expected, observed, valid, invalid, timeout, error, array_to_string(list_filter([
    CASE WHEN attempted AND sequences < expected THEN 'MeasuredSequenceIncomplete' END, CASE WHEN attempted AND observed <> expected THEN 'MissingSamples' END,
    CASE WHEN invalid > 0 THEN 'InvalidSample' END, CASE WHEN timeout > 0 THEN 'TimeoutSample' END, CASE WHEN error > 0 THEN 'ErrorSample' END,
    CASE WHEN NOT attempted THEN 'NotAttemptedDueToHalt' END], lambda y: y IS NOT NULL), ',') AS reasons FROM j)"""


def _campaigns(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The summaries of every campaign (runs named alike but for their last number), and what was asked for. The table says nothing
    about evidence, artifacts, processes and envelopes, so they count as good."""
    probes = table(spark, d, "graph_probe").where("Measured and Stratum is not null")
    expected = probes.groupBy(F.col("Op").alias("operation"), F.col("Stratum").alias("stratum")).agg(F.countDistinct("Seq").alias("expected"))
    rows = Scratch(spark, "campaigns").cut(samples(spark, d).select(
        F.regexp_replace("RunId", "-[0-9]+$", "").alias("campaign"), F.col("Repetition").alias("repetition"), F.col("op").alias("operation"),
        F.col("Stratum").alias("stratum"), F.col("Sequence").alias("sequence"), status().alias("status"), F.col("WallSeconds").alias("seconds"),
    ))
    good = [F.lit(True).alias(c) for c in ("evidence", "artifacts", "process")]
    runs = rows.select("campaign", "repetition").distinct().select("campaign", "repetition", *good, F.lit("VALID").alias("envelope"))
    return repetitions.summaries(rows, expected, runs), expected


@query(f"{_CAMPAIGN} SELECT *, reasons = '' AS complete FROM summary")
def rep_status(spark: SparkSession, d: str) -> DataFrame:
    """Counts and reasons of every repetition of every campaign, for every group of probes that was asked for."""
    return _campaigns(spark, d)[0].drop(*repetitions.FIGURES)


@query(f"""
{_CAMPAIGN} SELECT campaign, operation, stratum, max(expected) AS expected, count(*) FILTER (WHERE reasons = '') AS valid_repetitions,
  coalesce(string_agg(CAST(repetition AS VARCHAR), ',' ORDER BY repetition) FILTER (WHERE reasons <> ''), '') AS incomplete, bool_and(reasons = '') AS ready
FROM summary GROUP BY 1, 2, 3""")
def cross_status(spark: SparkSession, d: str) -> DataFrame:
    """Whether the three repetitions of a campaign can be compared."""
    return repetitions.cross(_campaigns(spark, d)[0]).drop(*repetitions.FIGURES)


@query("SELECT CAST(0 AS BIGINT) AS problems")
def cross_problems(spark: SparkSession, d: str) -> DataFrame:
    """Problems of the matrix of summaries: none, as the summaries are made from what was asked for."""
    return repetitions.problems(*_campaigns(spark, d)).agg(F.count("*").alias("problems"))


@query(f"""
WITH {_FIRST},
g AS ({catalog.SQL['g1_summary']}),
p AS (SELECT DISTINCT Seq, StartQid FROM graph_probe WHERE Op = 'G1'),
x AS (SELECT p.Seq, g.cardinality, g.visited, g.digest FROM p JOIN g ON g.start = p.StartQid),
v AS (SELECT s.CorrectnessStatus AS claimed, CASE WHEN x.Seq IS NULL THEN 'unknown'
    WHEN s.ActualDigest IS NULL OR s.ActualCardinality IS NULL OR s.ActualVisited IS NULL THEN 'no_result'
    WHEN s.ActualCardinality <> x.cardinality THEN 'cardinality' WHEN s.ActualVisited <> x.visited THEN 'visited'
    WHEN s.ActualDigest <> x.digest THEN 'digest' ELSE 'equal' END AS verdict
  FROM s LEFT JOIN x ON x.Seq = s.Sequence WHERE s.op = 'G1')
SELECT claimed, verdict, count(*) AS n FROM v GROUP BY 1, 2""")
def claim_check(spark: SparkSession, d: str) -> DataFrame:
    """The results that G1 samples claim against the results computed here."""
    known = catalog.g1_summary(spark, d)
    probe = table(spark, d, "graph_probe").where("Op = 'G1'").select(F.col("Seq").alias("Sequence"), F.col("StartQid").alias("start")).distinct()
    expected = probe.join(known, "start").select("Sequence", "cardinality", "visited", "digest", F.lit(True).alias("known"))
    rows = samples(spark, d).where("op = 'G1'").join(expected, "Sequence", "left")
    verdict = (
        F.when(F.col("known").isNull(), "unknown")
        .when(F.col("ActualDigest").isNull() | F.col("ActualCardinality").isNull() | F.col("ActualVisited").isNull(), "no_result")
        .when(F.col("ActualCardinality") != F.col("cardinality"), "cardinality")
        .when(F.col("ActualVisited") != F.col("visited"), "visited")
        .when(F.col("ActualDigest") != F.col("digest"), "digest").otherwise("equal")
    )
    return rows.groupBy(F.col("CorrectnessStatus").alias("claimed"), verdict.alias("verdict")).agg(F.count("*").alias("n"))

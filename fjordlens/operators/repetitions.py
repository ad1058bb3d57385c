"""Summaries of repetitions of timed runs, and what three repetitions together say.

A campaign is measured in repetitions 1 to 3. For each campaign, operation, stratum and repetition there is one summary: counts by
status, the reasons why it is incomplete, in a fixed order, and figures of the wall times only if it is complete. Three
complete summaries give the medians of each figure; anything wrong with the matrix of summaries is a problem with a code.

Figures are taken of complete groups only, whose samples are exactly as many as were asked for, so an exact percentile is bounded
by the contract.
Defined results: a repetition that was not run has the reason NotAttempted; without trusted evidence samples are not
looked at, so counts are 0; an empty table of samples gives incomplete summaries; strata that were not asked for are problems.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPETITIONS = (1, 2, 3)
KEY = ["campaign", "operation", "stratum"]
PERCENTS = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
FIGURES = ("min", *PERCENTS, "max", "mean", "throughput")
#: Reasons in their order (fixed names of the format).
REASONS = (
    "ExecutionEvidenceInvalid", "StableArtifactCaptureFailed", "ProcessIncomplete", "EnvelopeNotValid", "MeasuredSequenceIncomplete",
    "MissingSamples", "InvalidSample", "TimeoutSample", "ErrorSample", "NotAttemptedDueToHalt",
)


def _asked(campaigns: DataFrame, expected: DataFrame) -> DataFrame:
    """(campaign, operation, stratum, expected): each campaign with every group that was asked for, of which a contract has few."""
    groups = [F.struct(F.lit(r["operation"]).alias("operation"), F.lit(r["stratum"]).alias("stratum"), F.lit(r["expected"]).cast("bigint").alias("expected")) for r in expected.collect()]
    if not groups:
        return campaigns.limit(0).select("campaign", F.lit("").alias("operation"), F.lit("").alias("stratum"), F.lit(0).cast("bigint").alias("expected"))
    return campaigns.select("campaign", F.inline(F.array(*groups)))


def summaries(samples: DataFrame, expected: DataFrame, runs: DataFrame) -> DataFrame:
    """(campaign, operation, stratum, repetition, expected, observed, valid, invalid, timeout, error, reasons, complete, figures...).

    ``samples``: (campaign, repetition, operation, stratum, sequence, status, seconds), each once. ``expected``: (operation,
    stratum, expected). ``runs``: (campaign, repetition, evidence, artifacts, process, envelope), one row per run that
    was attempted; ``envelope`` is its status."""
    grid = _asked(runs.select("campaign").distinct(), expected).withColumn("repetition", F.explode(F.array(*map(F.lit, REPETITIONS))))
    facts = runs.withColumn("attempted", F.lit(True))
    counts = samples.groupBy(*KEY, "repetition").agg(
        F.count("*").alias("n"), F.countDistinct("sequence").alias("sequences"),
        *(F.count_if(F.col("status") == s).alias(s.lower()) for s in ("VALID", "INVALID", "TIMEOUT", "ERROR")),
    )
    rows = grid.join(facts, ["campaign", "repetition"], "left").join(counts, [*KEY, "repetition"], "left")
    attempted = F.coalesce("attempted", F.lit(False))
    trusted = attempted & F.col("evidence") & F.col("artifacts") & F.col("process")
    seen = lambda c: F.when(trusted, F.coalesce(c, F.lit(0))).otherwise(0)
    rows = rows.select(
        *KEY, "repetition", "expected", attempted.alias("attempted"), trusted.alias("trusted"), "evidence", "artifacts", "process", "envelope",
        F.coalesce("sequences", F.lit(0)).alias("sequences"), seen("n").alias("observed"),
        *(seen(c).alias(c) for c in ("valid", "invalid", "timeout", "error")),
    )
    why = {
        "ExecutionEvidenceInvalid": F.col("attempted") & ~F.col("evidence"), "StableArtifactCaptureFailed": F.col("attempted") & ~F.col("artifacts"),
        "ProcessIncomplete": F.col("attempted") & ~F.col("process"), "EnvelopeNotValid": F.col("attempted") & (F.col("envelope") != "VALID"),
        "MeasuredSequenceIncomplete": F.col("attempted") & (F.col("sequences") < F.col("expected")),
        "MissingSamples": F.col("trusted") & (F.col("observed") != F.col("expected")), "InvalidSample": F.col("invalid") > 0,
        "TimeoutSample": F.col("timeout") > 0, "ErrorSample": F.col("error") > 0, "NotAttemptedDueToHalt": ~F.col("attempted"),
    }
    reasons = F.array_compact(F.array(*(F.when(why[r], F.lit(r)) for r in REASONS)))
    rows = rows.withColumn("reasons", reasons).withColumn("complete", F.size("reasons") == 0)
    rows = rows.select(*KEY, "repetition", "expected", "observed", "valid", "invalid", "timeout", "error", F.array_join("reasons", ",").alias("reasons"), "complete")
    whole = rows.where("complete").select(*KEY, "repetition")
    total = F.sum(F.col("seconds"))
    timed = samples.join(whole, [*KEY, "repetition"], "left_semi").groupBy(*KEY, "repetition").agg(
        F.min("seconds").alias("min"), *(F.percentile("seconds", F.lit(q)).alias(n) for n, q in PERCENTS.items()), F.max("seconds").alias("max"),
        (total / F.count("*")).alias("mean"), F.round(F.count("*") / total, 2).alias("throughput"),
    )
    return rows.join(timed, [*KEY, "repetition"], "left")


def cross(summary: DataFrame) -> DataFrame:
    """(campaign, operation, stratum, expected, valid_repetitions, incomplete, ready, figures...): the medians of each figure where
    all three repetitions are complete; ``incomplete`` lists the others. A repetition given twice, or missing, makes the
    matrix unusable."""
    inside = F.col("repetition").isin(*REPETITIONS)
    rows = summary.where(inside).groupBy(*KEY).agg(
        F.max("expected").alias("expected"), F.count("*").alias("n"), F.countDistinct("repetition").alias("distinct"), F.count_if("complete").alias("valid"),
        F.array_sort(F.collect_list(F.when(~F.col("complete"), F.col("repetition")))).alias("left"),  # of three
        *(F.median(f).alias(f) for f in FIGURES),
    )
    usable = (F.col("n") == len(REPETITIONS)) & (F.col("distinct") == len(REPETITIONS))
    ready = usable & (F.col("valid") == len(REPETITIONS))
    return rows.select(
        *KEY, "expected", F.when(usable, F.col("valid")).otherwise(0).alias("valid_repetitions"),
        F.when(usable, F.array_join(F.col("left").cast("array<string>"), ",")).otherwise("").alias("incomplete"), ready.alias("ready"),
        *(F.when(ready, F.col(f)).alias(f) for f in FIGURES),
    )


def problems(summary: DataFrame, expected: DataFrame) -> DataFrame:
    """(campaign, operation, stratum, repetition, code): what is wrong with the summaries of each campaign."""
    inside = F.col("repetition").isin(*REPETITIONS)
    asked = expected.select("operation", "stratum", F.col("expected").alias("asked"))
    known = summary.join(F.broadcast(asked), ["operation", "stratum"], "left")  # one row per stratum
    none = F.lit(None).cast("int")
    stray = known.where(F.col("asked").isNull()).select(*KEY, "repetition", F.lit("UnexpectedRepetitionSummary").alias("code")).distinct()
    known = known.where(F.col("asked").isNotNull())
    number = known.where(~inside).select(*KEY, "repetition", F.lit("UnexpectedRepetitionNumber").alias("code"))
    known = known.where(inside)
    figures = F.coalesce(*(F.col(f) for f in FIGURES)).isNotNull()
    counts = (F.col("observed") != F.col("asked")) | (F.col("valid") != F.col("asked")) | (F.col("invalid") + F.col("timeout") + F.col("error") != 0)

    def code(when: Column, name: str) -> Column:
        return F.when(when, F.lit(name))

    shape = F.array_compact(F.array(
        code(F.col("expected") != F.col("asked"), "ExpectedCountMismatch"), code(F.col("complete") & (F.col("reasons") != ""), "ValidSummaryHasReasons"),
        code(F.col("complete") & ~figures, "ValidSummaryMissingMetrics"), code(F.col("complete") & counts, "ValidSummaryCountsMismatch"),
        code(~F.col("complete") & (F.col("reasons") == ""), "IncompleteSummaryMissingReasons"), code(~F.col("complete") & figures, "IncompleteSummaryHasMetrics"),
    ))
    shapes = known.select(*KEY, "repetition", F.explode(shape).alias("code"))
    seen = known.groupBy(*KEY, "repetition").agg(F.count("*").alias("n"))
    twice = seen.where("n > 1").select(*KEY, "repetition", F.lit("DuplicateRepetitionSummary").alias("code"))
    have = known.groupBy(*KEY).agg(F.collect_set("repetition").alias("have"))  # of three
    grid = _asked(summary.select("campaign").distinct(), expected).join(have, KEY, "left")
    gaps = F.when(F.col("have").isNull(), F.array(none)).otherwise(F.array_except(F.array(*map(F.lit, REPETITIONS)), F.col("have")))
    missing = grid.select(*KEY, F.explode(gaps).alias("repetition"), F.lit("MissingRepetitionSummary").alias("code"))
    return stray.unionByName(number).unionByName(shapes).unionByName(twice).unionByName(missing)

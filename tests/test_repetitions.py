import pytest
from pyspark.sql import functions as F

from fjordlens.operators import repetitions as rp

SAMPLES = "campaign string, repetition int, operation string, stratum string, sequence bigint, status string, seconds double, error string"
RUNS = "campaign string, repetition int, evidence boolean, artifacts boolean, process boolean, envelope string"


@pytest.fixture(scope="module")
def world(spark):
    """Campaign a is complete; b has an invalid and a late sample, a missing one and a run that was not attempted; c has bad
    evidence, an unstable artifact and an incomplete process."""
    samples = [("a", r, "G1", "D1", i, "VALID", float(i + r), "") for r in (1, 2, 3) for i in range(5)]
    samples += [("b", 1, "G1", "D1", i, s, 1.0, None) for i, s in enumerate(("VALID", "INVALID", "TIMEOUT", "VALID", "VALID"))]
    samples += [("b", 2, "G1", "D1", i, "VALID", 1.0, None) for i in range(4)]
    samples += [("c", r, "G1", "D1", i, "VALID", 1.0, None) for r in (1, 2, 3) for i in range(5)]
    runs = [("a", r, True, True, True, "VALID") for r in (1, 2, 3)] + [("b", r, True, True, True, "VALID") for r in (1, 2)]
    runs += [("c", 1, False, True, True, "VALID"), ("c", 2, True, False, True, "HOLD"), ("c", 3, True, True, False, "VALID")]
    expected = spark.createDataFrame([("G1", "D1", 5)], "operation string, stratum string, expected bigint")
    return rp.summaries(spark.createDataFrame(samples, SAMPLES), expected, spark.createDataFrame(runs, RUNS)).cache(), expected


def test_reasons_and_counts(world):
    got = {(r.campaign, r.repetition): (r.reasons, r.observed, r.valid) for r in world[0].collect()}
    assert {k: v for k, v in got.items() if k[0] == "a"} == {("a", r): ("", 5, 5) for r in (1, 2, 3)}
    assert got["b", 1] == ("InvalidSample,TimeoutSample", 5, 3)
    assert got["b", 2] == ("MeasuredSequenceIncomplete,MissingSamples", 4, 4)
    assert got["b", 3] == ("NotAttemptedDueToHalt", 0, 0)
    assert got["c", 1] == ("ExecutionEvidenceInvalid", 0, 0)
    assert got["c", 2] == ("StableArtifactCaptureFailed,EnvelopeNotValid", 0, 0)
    assert got["c", 3] == ("ProcessIncomplete", 0, 0)


def test_medians_of_three(world):
    got = {r.campaign: r for r in rp.cross(world[0]).collect()}
    a = got["a"]
    assert (a.ready, a.min, a.p50, a.p90, a.max, a.mean, a.throughput) == (True, 2.0, 4.0, 5.6, 6.0, 4.0, 0.25)
    assert (got["b"].ready, got["b"].valid_repetitions, got["b"].incomplete, got["b"].p50) == (False, 0, "1,2,3", None)


def test_problems(world):
    summary, expected = world
    assert rp.problems(summary, expected).count() == 0
    one = summary.where("campaign = 'a' and repetition = 1")
    odd = summary.where("campaign = 'a' and repetition < 3").unionByName(one)
    odd = odd.unionByName(one.withColumn("repetition", F.lit(4))).unionByName(one.withColumn("stratum", F.lit("other")))
    odd = odd.unionByName(one.withColumns({"campaign": F.lit("z"), "expected": F.lit(6).cast("bigint"), "reasons": F.lit("x"), "valid": F.lit(1).cast("bigint"), "min": F.lit(None).cast("double")}))
    got = sorted((r.campaign, r.stratum, r.repetition or 0, r.code) for r in rp.problems(odd, expected).collect())
    assert got == [
        ("a", "D1", 1, "DuplicateRepetitionSummary"), ("a", "D1", 3, "MissingRepetitionSummary"), ("a", "D1", 4, "UnexpectedRepetitionNumber"),
        ("a", "other", 1, "UnexpectedRepetitionSummary"), ("z", "D1", 1, "ExpectedCountMismatch"), ("z", "D1", 1, "ValidSummaryCountsMismatch"),
        ("z", "D1", 1, "ValidSummaryHasReasons"), ("z", "D1", 2, "MissingRepetitionSummary"), ("z", "D1", 3, "MissingRepetitionSummary"),
    ]
    assert not any(r.ready for r in rp.cross(odd).collect())


def test_empty(spark, world):
    _, expected = world
    runs = spark.createDataFrame([("a", 1, True, True, True, "VALID")], RUNS)
    got = rp.summaries(spark.createDataFrame([], SAMPLES), expected, runs).collect()
    assert {r.repetition: r.reasons for r in got} == {1: "MeasuredSequenceIncomplete,MissingSamples", 2: "NotAttemptedDueToHalt", 3: "NotAttemptedDueToHalt"}

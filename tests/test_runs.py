import hashlib

import pytest

from fjordlens.plans import runner
from fjordlens.sources import evidence, records

IDENTITY = {k: "x" for k in evidence.IDENTITY}


def test_evidence(spark, tmp_path):
    place = f"file://{tmp_path}/run"
    at = evidence.stage(spark, place, IDENTITY)
    spark.createDataFrame([("S1", 1, "A", 0.5, "VALID")], "operation string, sequence bigint, stratum string, wall_seconds double, correctness_status string").write.json(f"{at}/samples")
    with pytest.raises(evidence.EvidenceError):
        evidence.promote(spark, at, place)  # still running
    assert evidence.finalize(spark, at, ["samples"])["state"] == "Complete"
    assert evidence.problems(spark, at) == []
    evidence.promote(spark, at, place)
    assert evidence.problems(spark, place) == []
    with pytest.raises(FileExistsError):
        evidence.stage(spark, place, IDENTITY)
    part = next(p for p in (tmp_path / "run" / "samples").iterdir() if p.name.startswith("part"))
    assert evidence.files(spark, place)[f"samples/{part.name}"]["sha256"] == hashlib.sha256(part.read_bytes()).hexdigest()
    (tmp_path / "run" / "more").write_text("x")
    (part.parent / f".{part.name}.crc").unlink()
    part.write_text("changed")
    assert evidence.problems(spark, place) == ["more: more", f"differs: samples/{part.name}"]


def test_evidence_on_hold(spark, tmp_path):
    at = evidence.stage(spark, f"file://{tmp_path}/a", IDENTITY)
    assert evidence.finalize(spark, at, ["samples"], ["late"]) | {"run_id": ""} == {**IDENTITY, "run_id": "", "evidence_schema_version": 1, "state": "Hold", "reasons": ["late", "missing: samples"]}
    with pytest.raises(evidence.EvidenceError):
        evidence.promote(spark, at, f"file://{tmp_path}/a")
    with pytest.raises(evidence.EvidenceError):
        evidence.finalize(spark, at, [])
    failed = evidence.stage(spark, f"file://{tmp_path}/b", IDENTITY)
    assert evidence.finalize(spark, failed, [], failed=True)["state"] == "Failed"
    with pytest.raises(evidence.EvidenceError):
        evidence.stage(spark, f"file://{tmp_path}/c", {"run_id": "x"})


GOOD = '{"operation":"G1","sequence":3,"stratum":"A","wall_seconds":1,"correctness_status":"VALID","actual_cardinality":null}'
LINES = {
    GOOD: None, "": "blank", "{": "broken JSON", "[1]": "no object", GOOD.replace("}", ',"x":1}'): "unknown field", GOOD.replace("}", ',"stratum":"B"}'): "broken JSON",
    GOOD.replace('"sequence":3,', ""): "sequence: missing", GOOD.replace(":3", ":3.5"): "sequence: other type", GOOD.replace(":3", ':"3"'): "sequence: other type",
    GOOD.replace('"A"', '""'): "stratum: out of range", GOOD.replace(":1,", ":-1,"): "wall_seconds: out of range", GOOD.replace("VALID", "MAYBE"): "correctness_status: out of range",
    GOOD.replace("null", '"x"'): "actual_cardinality: other type", GOOD + "\r": "line ends or mark", "﻿" + GOOD: "line ends or mark",
}


def test_strict_lines(spark, tmp_path):
    (tmp_path / "lines").write_bytes("\n".join(LINES).encode() + b'\n{"operation":"\xff"}\n')
    got = records.read(spark, f"file://{tmp_path}/lines", records.SAMPLE).coalesce(1).collect()
    assert [r.problem for r in got] == [*LINES.values(), "not UTF-8"]
    assert (got[0].operation, got[0].sequence, got[0].wall_seconds, got[0].actual_cardinality) == ("G1", 3, 1.0, None)
    assert all(r.operation is None for r in got[1:])


def test_records_come_back(spark, tmp_path):
    rows = [("S2", "Miss", 1, True, None, "nb", 'a"\\\næ'), ("S1", "A", 0, True, 5, None, None)]
    df = spark.createDataFrame(rows, "op string, stratum string, seq bigint, measured boolean, qid bigint, lang string, value string")
    records.write(df, f"file://{tmp_path}/p", records.PROBE, ["seq"])
    back = records.read(spark, f"file://{tmp_path}/p", records.PROBE)
    assert records.problems(back) == {} and sorted(tuple(r)[:-1] for r in back.collect()) == sorted(rows)
    with pytest.raises(Exception, match="exists"):
        records.write(df, f"file://{tmp_path}/p", records.PROBE, ["seq"])


def probes(n=4):
    return [runner.Probe("S1", i, "A", True, i) for i in range(n)] + [runner.Probe("S1", 99, "Tail", False, 99), runner.Probe("S2", 1, "B", True, 1)]


def go(run, expected=None):
    expected = expected or {(p.operation, p.sequence): (1, str(p.key)) for p in probes()}
    ticks = iter(range(10_000))
    return runner.timed("S1", 2, probes(), expected, run, lambda p, r: (1, str(r)), lambda: float(next(ticks)))


def test_a_pass():
    p = go(lambda p: p.key)
    assert (p.correctness, p.repetition, [s.sequence for s in p.samples], {s.wall_seconds for s in p.samples}, p.seconds) == ("VALID", 2, [0, 1, 2, 3], {1.0}, 9.0)


def test_passes_that_go_wrong():
    seen = []

    def breaks(p, at, when):
        seen.append(p.sequence)
        if p.sequence == at and seen.count(at) == when:
            raise ValueError("broken")
        return p.key

    p = go(lambda p: breaks(p, 2, 1))
    assert (p.correctness, p.failed_in, p.samples) == ("ERROR", "warmup", [])
    seen.clear()
    p = go(lambda p: breaks(p, 2, 2))
    assert (p.correctness, p.failed_in, [s.correctness_status for s in p.samples], p.samples[-1].error) == ("ERROR", "timed-probe", ["VALID", "VALID", "ERROR"], "broken")
    seen.clear()
    p = go(lambda p: breaks(p, 99, 1))
    assert (p.correctness, p.failed_in, len(p.samples)) == ("ERROR", "tail", 4)
    assert go(lambda p: p.key if p.sequence < 3 else "other").correctness == "INVALID"


def test_a_campaign_halts():
    one = lambda op, r: runner.Pass(op, r, "VALID")
    done, left = runner.campaign(("S1", "S2"), one, lambda p: (p.operation, p.repetition) != ("S1", 2))
    assert [(p.operation, p.repetition) for p in done] == [("S1", 1), ("S2", 1), ("S1", 2)] and left == [("S2", 2), ("S1", 3), ("S2", 3)]
    assert runner.campaign(("S1",), one, lambda p: True)[1] == []

import gzip
import hashlib
import json
import struct

import numpy as np
import pytest

from fjordlens.sources import binary, contracts, evidence, packages


def contract(**change):
    out = dict.fromkeys(contracts.WORDS, "x") | dict.fromkeys(contracts.NUMBERS, 3) | {"fullPassWarmup": True} | contracts.SUPPORTED
    out["strata"] = [
        {"operation": "S1", "stratum": "A", "selectionMode": "sha256-ranked-sample", "measuredCount": 5},
        {"operation": "S1", "stratum": "Absent", "selectionMode": "generated-miss", "measuredCount": 5},
        {"operation": "S2", "stratum": "B", "selectionMode": "all-eligible", "measuredCount": 2, "expectedEligibleCount": 2, "fanoutMin": 1, "fanoutMax": None},
    ]
    out["correctnessOnly"], out["g2Strata"] = [], [{"stratum": "P", "count": 1}, {"stratum": "Q", "count": 2}]
    return json.dumps(out | change)


def test_contract():
    c = contracts.parse(contract())
    assert (c.max_depth, c.guard, c.g2, c.strata[2].fanout) == (3, 3, (("P", 1), ("Q", 2)), (1, None))
    assert contracts.verdict(c, {"S1/A": 5, "S2/B": 2}) == ("GO", [])
    assert contracts.verdict(c, {"S1/A": 4, "S2/B": 3}) == ("HOLD", ["S1/A: 4 eligible, 5 needed", "S2/B: 3 eligible, 2 expected"])


def test_identity():
    """The image does not depend on the layout of the file, and the id on the order of the artifacts."""
    c, again = contracts.parse(contract()), contracts.parse(json.dumps(dict(reversed(json.loads(contract()).items())), indent=3))
    text = lambda x: struct.pack(">i", len(x)) + x.encode()
    assert c.image == again.image and c.image.startswith(text("x") + struct.pack(">4q", 1, 1, 1, 1) + text("x") * 4 + text("raw-exact-lang-value"))
    assert c.image.endswith(text("S2") + text("B") + text("all-eligible") + struct.pack(">4q", 2, 1, -1, 2) + text("P") + struct.pack(">q", 1) + text("Q") + struct.pack(">q", 2))
    want = hashlib.sha256(struct.pack(">i", len(c.image)) + c.image + b"".join(map(text, ("corpus", "a", "1", "b", "2", "f")))).hexdigest()
    assert contracts.identity(c, "corpus", {"b": "2", "a": "1"}, "f") == contracts.identity(c, "corpus", {"a": "1", "b": "2"}, "f") == want
    assert contracts.parse(contract(maxDepth=4)).image != c.image


def test_preflight(spark, tmp_path):
    at, run = f"file://{tmp_path}/pack", f"file://{tmp_path}/run"
    assert packages.preflight(spark, at) == [f"not found: {at}"]
    packages.publish(spark, at, {"t": spark.range(3).toDF("id")})
    stage = evidence.stage(spark, run, {k: "x" for k in evidence.IDENTITY})
    evidence.finalize(spark, stage, [])
    evidence.promote(spark, stage, run)
    assert packages.preflight(spark, at, [run]) == []
    (tmp_path / "run" / "more").write_text("x")
    spark.range(4).toDF("id").write.mode("overwrite").parquet(f"{at}/t")
    assert packages.preflight(spark, at, [run, f"{run}2"]) == [f"{at}: t: rows", f"{at}: t: digest", f"{run}: more: more", f"{run}2: EvidenceError"]


BAD = {
    "unknown": contract(more=1),
    "type": contract(maxDepth="3"),
    "boolean for number": contract(maxDepth=True),
    "not positive": contract(maxDepth=0),
    "sum": contract(g2BatchConcepts=9),
    "mode": contract(strata=[{"operation": "S1", "stratum": "A", "selectionMode": "other", "measuredCount": 5}]),
    "twice": contract(strata=[{"operation": "S1", "stratum": "A", "selectionMode": "all-eligible", "measuredCount": 5}] * 2),
    "version": contract(generatorVersion=2),
    "gap": contract(strata=[{"operation": "S2", "stratum": n, "selectionMode": "sha256-ranked-sample", "measuredCount": 5, "fanoutMin": a, "fanoutMax": b} for n, a, b in (("A", 1, 5), ("B", 7, None))]),
    "no open range": contract(strata=[{"operation": "S2", "stratum": "A", "selectionMode": "sha256-ranked-sample", "measuredCount": 5, "fanoutMin": 1, "fanoutMax": 5}]),
    "whole without number": contract(strata=[{"operation": "S1", "stratum": "A", "selectionMode": "all-eligible", "measuredCount": 5}]),
    "range": contract(strata=[{"operation": "S2", "stratum": "A", "selectionMode": "all-eligible", "measuredCount": 5, "fanoutMin": 5, "fanoutMax": 4}]),
    "missing": '{"schema": "x"}',
    "broken": "{",
    "key twice": '{"schema": "x", "schema": "y"}',
}


@pytest.mark.parametrize("case", BAD)
def test_bad_contract(case):
    with pytest.raises(contracts.ContractError):
        contracts.parse(BAD[case])


def test_ids(spark, tmp_path):
    at = f"file://{tmp_path}/ids.bin"
    df = spark.createDataFrame([(5,), (-1,), (5,), (None,), (2**60,)], "q bigint")
    assert binary.write_ids(df, "q", at) == 3
    assert np.fromfile(tmp_path / "ids.bin", "<i8").tolist() == [-1, 5, 2**60]
    assert [r.qid for r in binary.read_ids(spark, at).collect()] == [-1, 5, 2**60]
    assert binary.write_ids(df.limit(0), "q", f"file://{tmp_path}/none.bin") == 0
    for name, content in (("short.bin", b"1234567"), ("order.bin", np.array([3, 2], "<i8").tobytes())):
        (tmp_path / name).write_bytes(content)
        with pytest.raises(Exception, match="ids"):
            binary.read_ids(spark, f"file://{tmp_path}/{name}").collect()


def test_gzip_that_is_cut_short(spark, tmp_path):
    whole = gzip.compress(b"a\n\xff\nc") + gzip.compress(b"d\n")
    (tmp_path / "w.gz").write_bytes(whole)
    long = gzip.compress("\n".join(str(i * 7919 % 10007) for i in range(5000)).encode())
    (tmp_path / "t.gz").write_bytes(long[: len(long) // 2])
    got = binary.tolerant_lines(spark, f"file://{tmp_path}/w.gz").collect()
    assert [(r.value, r.truncated) for r in got] == [("a", False), (None, False), ("cd", False)]
    cut = binary.tolerant_lines(spark, f"file://{tmp_path}/t.gz").collect()
    assert 100 < len(cut) < 5000 and all(r.truncated for r in cut)
    assert [r.value for r in cut[:-1]] == [str(i * 7919 % 10007) for i in range(len(cut) - 1)]

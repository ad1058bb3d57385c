import json

import pytest
from pyspark.sql import functions as F

from fjordlens.functions import canon
from fjordlens.operators import anchors, multiset_fold, tiers, traversal
from fjordlens.sources import entities, packages

CONCEPT = "Qid bigint, InT1 boolean, InT2 boolean"
EDGE = "SubjectQid bigint, TargetQid bigint"


def test_fold_golden(spark):
    rows = [(5, True, False), (9, False, True), (12, True, True)]
    df = spark.createDataFrame(rows, CONCEPT)
    want = "0d3d91f881881180d56c1c220d39a5697a2f649ef0058c4c49080d1fa1c8523b"
    for part in (1, 3):  # order and layout don't matter
        assert multiset_fold.fold(df.orderBy(F.rand(part)).repartition(part), canon.concept_row()).collect()[0].digest == want
    empty = multiset_fold.fold(df.limit(0), canon.concept_row()).collect()[0]
    assert (empty.rows, empty.digest) == (0, "66687aadf862bd776c8fc18b8e9f8e20089714856ee233b3902a591d0d5f2925")
    twice = spark.createDataFrame([(1, 5), (1, 5)], EDGE)
    assert multiset_fold.fold(twice, canon.edge_row()).collect()[0].digest == "2445adc0e42f8030d1a7be4897169a009d8bd46352daac1dd832d17c004c70bd"


def test_digest_golden(spark):
    one = spark.range(1)
    rows = F.concat(*(canon.be64(F.lit(x)) for x in (0, 5, 0, 6)))
    got = one.select(
        canon.sized(F.lit(2), rows).alias("adjacency"),
        canon.sized(F.lit(0), F.lit("")).alias("nothing"),
        canon.digest(F.concat(*(canon.be64(F.lit(x)) for x in (3, 2, 3, 4, 4)))).alias("g1"),
        canon.sized(F.lit(1), F.concat(canon.text(F.lit("en")), canon.text(F.lit("label")), canon.be64(F.lit(2)))).alias("a2"),
    ).collect()[0]
    assert got.adjacency == "a4fb4b050a4d4f47a8b4e5f6787b46b3f60a799ce0fb762b4a0221fcbf9881a2"
    assert got.nothing == "15ec7bf0b50732b49f8228e07d24365338f9e3ab994b00af08e5a3bffe55fd8b"
    assert got.g1 == "1b6b595da3d4bb190adcea63befee319cf1143c882df8cc87c43f9eecdcf1e34"
    assert got.a2 == "1df86b40c6bbff2d71cb5de5e25c3df39a5d0f41557042018bc73f236864b4d3"


def test_sample_buckets(spark):
    want = {1: 469, 5: 729, 31: 260, 9143: 525, 123456: 144, 5233394: 110, 107: 14, 164: 5, 190: 8, 197: 3, 218: 8, 254: 1}
    df = spark.createDataFrame([(q,) for q in want], "q bigint")
    assert {r.q: r.b for r in df.select("q", canon.sample_bucket("q").alias("b")).collect()} == want


def test_ordinal_order(spark):
    df = spark.createDataFrame([("～",), ("😀",), ("a",)], "v string")
    assert [r.v for r in df.orderBy(canon.ordinal("v")).collect()] == ["a", "😀", "～"]
    assert df.where("v = '😀'").select(canon.utf16_length("v").alias("n")).collect()[0].n == 2


@pytest.mark.parametrize("depth,want", [(1, [2, 3]), (3, [2, 3, 4])])
def test_traversal(spark, depth, want):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 2), (4, 1)], "node bigint, parent bigint")
    seeds = spark.createDataFrame([(1,), (1,), (None,), (77,)], "seed bigint")
    got = traversal.ancestry(seeds, edges, depth).collect()
    assert sorted((r.seed, r.node) for r in got) == [(1, n) for n in want]


def test_deep_nodes_stay_out(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 2), (3, 5), (4, 6), (6, 7)], "node bigint, parent bigint")
    got = traversal.ancestry(spark.createDataFrame([(1,)], "seed bigint"), edges).collect()
    assert sorted(r.node for r in got) == [2, 3, 4, 5, 6]


def test_tail(spark):
    concept = spark.createDataFrame([(1, True, False), (2, False, True), (3, False, True)], CONCEPT)
    lexical = spark.createDataFrame([(1,), (2,), (2,)], "Qid bigint")
    got = tiers.profiled(concept, lexical).select("qid", tiers.tier().alias("t")).collect()
    assert {r.qid: r.t for r in got} == {1: "T1Only", 2: "T2Only", 3: "Tail"}


LINES = [
    ("[", "Ignore", False, None),
    ('{"type":"item","id":"Q5"},', "Item", False, 5),
    (' {"type":"item","id":"Q5"} ', "Item", False, 5),
    ('{"type":"property","id":"P5"}', "NonItem", False, None),
    ("{broken", "Malformed", True, None),
    ('{"id":5}', "Malformed", False, None),
    ('{"missing":null,"id":"Q1","type":"item"}', "Missing", False, None),
    ('{"type":"item","id":"Q0"}', "Malformed", True, None),
    ('{"type":"item","id":"Q99999999999999999999"}', "Malformed", True, None),
    ("", "Ignore", False, None),
]


def test_outcomes(spark):
    df = spark.createDataFrame([(x[0],) for x in LINES], "value string")
    got = {r["value"]: (r.outcome, r.counted, r.qid if r.outcome == "Item" else None) for r in entities.parsed(df).collect()}
    assert got == {x[0]: x[1:] for x in LINES}


def test_item_parts(spark):
    line = (
        '{"type":"item","id":"Q5","labels":{"en":{"value":5},"nb":{}},"aliases":{"en":[{"value":"x"},{"value":"x"},3,{}]},'
        '"claims":{"P31":[{"mainsnak":{"snaktype":"value","datavalue":{"type":"wikibase-entityid","value":{"numeric-id":7}}}},'
        '{"mainsnak":{"snaktype":"novalue"}},{"mainsnak":{"snaktype":"value","datavalue":{"type":"string","value":"7"}}}],"P279":4}}'
    )
    r = entities.items(spark.createDataFrame([(line,)], "value string")).collect()[0]
    assert (r.qid, r.label_en, r.label_nb, r.alias_en, r.alias_nb, r.p31, r.p279) == (5, "", None, ["x", ""], [], [7], [])


def test_packages(spark, tmp_path):
    at = f"file://{tmp_path}/pack"
    df = spark.createDataFrame([(1, "a"), (2, None)], "id bigint, t string")
    packages.publish(spark, at, {"t": df})
    assert packages.problems(spark, at) == []
    with pytest.raises(FileExistsError):
        packages.publish(spark, at, {"t": df})
    df.limit(1).write.mode("overwrite").parquet(f"{at}/t")
    assert packages.problems(spark, at) == ["t: rows", "t: digest"]


def anchor_file(**change):
    case = {"category": "c", "language": "en", "term": "L5", "status": "resolved", "nameType": "CanonicalLabel", "evidenceClass": "x"}
    cases = [
        case | {"id": "label", "qid": "Q5"}, case | {"id": "alias", "qid": "Q5", "nameType": "WikidataAlias", "term": "A5"}, case | {"id": "other kind", "qid": "Q5", "nameType": "WikidataAlias"},
        case | {"id": "gone", "qid": "Q6"}, case | {"id": "exonym", "qid": "Q5", "nameType": "Exonym"}, case | {"id": "other language", "qid": "Q5", "language": "nb"},
        case | {"id": "two", "status": "ambiguous", "candidateQids": ["Q5", "Q8", "Q6"]}, case | {"id": "no qid"},
    ]
    out = {"schema": "s", "phase0_commit": "c", "sources": [{"path": "p", "sha256": "h"}], "sets": {"resolvedGold": ["Q5", "Q6"], "goldUnion": ["Q8"], "ambiguousCand": []}, "goldCases": cases}
    return json.dumps(out | change)


def test_anchors(spark, tmp_path):
    f = tmp_path / "a.json"
    f.write_text(anchor_file())
    sets, cases = packages.anchors(spark, f"file://{f}", {"p": "h"}, {"resolvedGold": 2, "goldUnion": 1, "ambiguousCand": 0}, 8)
    concept = spark.createDataFrame([(5, True, True), (8, False, True)], CONCEPT)
    lexical = spark.createDataFrame([(5, "en", "label", "L5"), (5, "en", "label", "L5"), (5, "en", "alias", "A5"), (8, "en", "alias", "L5")], "Qid bigint, Lang string, LexKind string, Value string")
    got = {r.set: tuple(r)[1:] for r in anchors.coverage(sets, concept).collect()}
    assert got == {"resolvedGold": (2, 1, 1, 1, 0, 1, 1), "goldUnion": (1, 0, 1, 0, 1, 1, 0)}
    present = "concept_present_surface_absent"
    assert {r.id: r.outcome for r in anchors.surfaces(cases, concept, lexical).collect()} == {
        "label": "concept_present_label_surface", "alias": "concept_present_alias_surface", "other kind": present, "gone": "concept_absent",
        "exonym": "not_applicable_to_baseline_lexical_corpus", "other language": present,
    }
    assert [tuple(r) for r in anchors.ambiguous(cases, concept, lexical).collect()] == [("two", 3, 2, 2)]
    assert {r.figure: r.n for r in anchors.continuity(sets, cases, concept, lexical).collect()} == {
        "resolvedGoldPresent": 1, "goldUnionPresent": 1, "ambiguousCandPresent": 0, "lexicalSurfacePresent": 7, "ambiguousMultiPresent": 1,
    }


@pytest.mark.parametrize("change", [{"more": 1}, {"sets": {"resolvedGold": []}}, {"sets": {"resolvedGold": ["Q5", "Q5"], "goldUnion": [], "ambiguousCand": []}}, {"sets": {"resolvedGold": ["5"], "goldUnion": [], "ambiguousCand": []}}, {"goldCases": [{"id": 1, "x": 2}]}])
def test_bad_anchors(spark, tmp_path, change):
    f = tmp_path / "a.json"
    f.write_text(anchor_file(**change))
    with pytest.raises(packages.AnchorError):
        packages.anchors(spark, f"file://{f}")


def test_anchors_that_were_not_asked_for(spark, tmp_path):
    f = tmp_path / "a.json"
    f.write_text(anchor_file())
    for how in ({"sources": {"p": "other"}}, {"sizes": {"resolvedGold": 2}}, {"n_cases": 3}):
        with pytest.raises(packages.AnchorError):
            packages.anchors(spark, f"file://{f}", **how)

import math
from collections import Counter

from fjordlens.operators import hot_keys
from fjordlens.plans.runtime import Scratch

SCHEMA = "k string, v bigint, other string"


def rows():
    out = [("hot", i * i % 97, "x") for i in range(3000)] + [(f"k{i % 40}", i % 7, None) for i in range(400)]
    return out + [("hot", None, ""), (None, 4, ""), (None, 4, ""), (None, None, ""), ("nulls", None, "")]


def test_against_brute_force(spark):
    weighted = hot_keys.compress(spark.createDataFrame(rows(), SCHEMA), ["k"], "v")
    groups = {}
    for k, v, _ in rows():
        groups.setdefault(k, []).append(v)
    stats = {r.k: r for r in hot_keys.key_stats(weighted, ["k"]).collect()}
    assert set(stats) == set(groups)
    for k, vs in groups.items():
        known = Counter(v for v in vs if v is not None)
        assert (stats[k].rows, stats[k].distinct_values) == (len(vs), len(known))
        if known:
            mode, n = min(known.items(), key=lambda x: (-x[1], x[0]))
            assert (stats[k].mode, stats[k].mode_rows) == (mode, n)
        else:
            assert stats[k].mode is None
    at = (0.1, 0.5, 0.99)
    scratch = Scratch(spark, "t")
    got = {r.k: r for r in hot_keys.key_percentiles(weighted, ["k"], at, scratch).collect()}
    lin = {r.k: r for r in hot_keys.linear_percentiles(weighted, ["k"], {"m": 0.5, "h": 0.9}, scratch).collect()}
    for k, vs in groups.items():
        vs = sorted(v for v in vs if v is not None)
        if not vs:
            assert k not in got
            continue
        assert [got[k][f"p{math.floor(q * 100)}"] for q in at] == [vs[math.ceil(q * len(vs)) - 1] for q in at]
        for name, q in (("m", 0.5), ("h", 0.9)):
            x = (len(vs) - 1) * q
            want = vs[math.floor(x)] + (vs[math.ceil(x)] - vs[math.floor(x)]) * (x - math.floor(x))
            assert abs(lin[k][name] - want) < 1e-9


def test_heavy_and_empty(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    heavy = hot_keys.heavy_keys(hot_keys.compress(df, ["k"], "v"), ["k"], 0.5, df.count())
    assert [r.k for r in heavy.collect()] == ["hot"]
    none = hot_keys.compress(df.limit(0), ["k"], "v")
    assert hot_keys.key_stats(none, ["k"]).count() == 0
    assert hot_keys.key_percentiles(none, ["k"], (0.5,), Scratch(spark, "t")).count() == 0

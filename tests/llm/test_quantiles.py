import math

import numpy as np
import pytest

from fjordlens.llm import quantile_sketch as qs
from fjordlens.plans.runtime import Scratch

SCHEMA = "g string, day int, x double, w bigint, slot string"
AT = (0.01, 0.25, 0.5, 0.9, 0.99)


def data(n=60_000, seed=3):
    r = np.random.default_rng(seed)
    big = np.exp(r.normal(-8, 1.5, n))
    return [("big", int(d), float(v), 1, "") for d, v in zip(r.integers(0, 5, n), big)] + [("small", 0, float(v), 1, "") for v in r.normal(0, 5, 300)]


def check(rows, got, slack):
    for g in {r[0] for r in rows}:
        v = np.sort([r[2] for r in rows if r[0] == g])
        assert got[g].n == len(v)
        for q in AT:
            x = got[g][f"p{round(q * 100)}"]
            low, up = np.searchsorted(v, x * (1 - 2**-11 * np.sign(x))), np.searchsorted(v, x * (1 + 2**-11 * np.sign(x)), side="right")
            assert low / len(v) - slack <= q <= up / len(v) + slack, (g, q, x)


def result(sketched, keys=("g",)):
    return {r.g: r for r in qs.percentiles(sketched, list(keys), AT).collect()}


def test_error_bound(spark):
    rows = data()
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = result(qs.sketches(df, ["g"], "x", Scratch(spark, "t")))
    assert got["small"].rank_error < 0.02 and 0 < got["big"].rank_error < 0.02
    check(rows, got, got["big"].rank_error + 0.001)


def test_days_add_up(spark):
    rows = data()
    df = spark.createDataFrame(rows, SCHEMA)
    stored = qs.sketches(df, ["day", "g"], "x", Scratch(spark, "t"))
    added, whole = result(qs.add(stored, ["g"])), result(qs.sketches(df, ["g"], "x", Scratch(spark, "t")))
    answers = {g: [r[f"p{round(q * 100)}"] for q in AT] for g, r in whole.items()}
    assert {g: [r[f"p{round(q * 100)}"] for q in AT] for g, r in added.items()} == answers
    ran = qs.running(stored, ["g"], "day", AT).collect()
    assert {r.g: [r[f"p{round(q * 100)}"] for q in AT] for r in ran if r.scope == "all"} == answers
    assert {(r.day, r.g): r.n for r in ran if r.scope == "one"} == {(r.day, r.g): r.n for r in stored.collect()}
    first = result(qs.sketches(df.where("day <= 1"), ["g"], "x", Scratch(spark, "t")))
    assert {r.g: (r.n, r.p50, r.rank_error) for r in ran if r.scope == "to_date" and r.day == 1 and r.g == "big"} == {"big": (first["big"].n, first["big"].p50, first["big"].rank_error)}


def test_answers_do_not_depend_on_the_stored_form(spark, monkeypatch):
    df = spark.createDataFrame(data(5000), SCHEMA)
    values, weights = np.unique(qs.encode(np.array([r[2] for r in data(5000)])), return_counts=True)
    one, two = qs.State(), qs.State()
    one.add(values, weights)
    monkeypatch.setattr(qs, "PAIRS", 100)  # counters from the second piece on
    for part in np.array_split(np.arange(len(values)), 7):
        two.add(values[part], weights[part])
    assert one.cells is None and two.cells is not None and (one.counters() == two.cells).all() and one.n == two.n == df.count()
    again = qs.State.load(*two.dump())
    again.merge(qs.State.load(*one.dump()))
    assert (again.counters() == 2 * one.counters()).all()


def test_deletions(spark):
    rows = data(20_000)
    gone = [(g, d, x * 1000, 1, s) for g, d, x, _, s in rows[:9000]]
    both = rows + gone + [(g, d, x, -1, s) for g, d, x, _, s in gone]
    got = result(qs.sketches(spark.createDataFrame(both, SCHEMA), ["g"], "x", Scratch(spark, "t"), "w"))
    check(rows, got, got["big"].rank_error + 0.001)


def test_odd_values(spark):
    odd = [("a", 0, x, 1, "") for x in (None, float("nan"), 0.0, -0.0, -1.5, float("inf"), float("-inf"))]
    rows = odd + [(None, 0, 2.0, 1, ""), ("none", 0, None, 1, "")] + [("ties", 0, 5.0, 1, "")] * 50
    got = result(qs.sketches(spark.createDataFrame(rows, SCHEMA), ["g"], "x", Scratch(spark, "t")))
    assert set(got) == {"a", None, "ties"}
    assert got["a"].n == 5 and got["a"].p50 == 0.0 and got["a"].p1 == -math.inf and got["a"].p99 == math.inf
    assert abs(got["ties"].p50 - 5) < 5 * 2**-11 and abs(got[None].p50 - 2) < 2 * 2**-11


def test_big_keys_and_empty(spark):
    df = spark.createDataFrame([(2**62 + 1, 1.0), (None, 2.0)], "k bigint, x double")
    got = {r.k: r.n for r in qs.percentiles(qs.sketches(df, ["k"], "x", Scratch(spark, "t")), ["k"], (0.5,)).collect()}
    assert got == {2**62 + 1: 1, None: 1}
    assert qs.percentiles(qs.sketches(df.limit(0), ["k"], "x", Scratch(spark, "t")), ["k"], (0.5,)).count() == 0


@pytest.mark.parametrize("x", [1e-9, 0.25, 1.0, 123456.789, -3.5])
def test_encoding_keeps_order_and_value(x):
    assert abs(qs.decode(int(qs.encode(np.array([x]))[0])) - x) <= abs(x) * 2**-12
    v = np.sort(np.random.default_rng(1).normal(0, 1e3, 1000))
    assert (np.diff(qs.encode(v).astype(np.int64)) >= 0).all()

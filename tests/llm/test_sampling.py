import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fjordlens.llm import heavy_hitters, stable_sample
from fjordlens.plans.runtime import Scratch

T0 = datetime(2026, 1, 1)


def arrivals(n, seed=1):
    r = random.Random(seed)
    return [(r.randrange(n // 2), T0 + timedelta(minutes=r.randrange(n)), "x") for _ in range(n)]


def sample(spark, rows, parts=3, known=None):
    df = spark.createDataFrame(rows, "q bigint, t timestamp, seq string").repartition(parts)
    numbered = stable_sample.sequence(df, "q", "t", Scratch(spark, "t"), known)
    return numbered, {r.q for r in stable_sample.chosen(numbered, 0.2).collect()}


def test_stable_in_layout_and_growth(spark):
    rows = arrivals(3000)
    cut = T0 + timedelta(minutes=1500)
    _, whole = sample(spark, rows)
    _, again = sample(spark, rows[::-1], parts=7)
    assert whole == again
    before = [r for r in rows if r[1] <= cut]
    _, early = sample(spark, before)
    assert early and early <= whole
    assert {q for q in whole if q in {r[0] for r in before}} == early


def test_even_over_growth(spark):
    numbered, _ = sample(spark, arrivals(4000))
    kept = sorted(r.seq for r in stable_sample.chosen(numbered, 0.2).collect())
    n = numbered.count()
    assert sorted(r.seq for r in numbered.collect()) == list(range(n))
    for lo in range(0, n - 100, 100):
        assert 17 <= sum(lo <= s < lo + 100 for s in kept) <= 23


def test_place_is_exact(spark):
    want = [(i * stable_sample.STEP + stable_sample.SHIFT) % stable_sample.ONE for i in (0, 1, 5, 2**31, 2**40 + 7)]
    df = spark.createDataFrame([(i,) for i in (0, 1, 5, 2**31, 2**40 + 7)], "seq bigint").coalesce(1)
    assert [r.p for r in df.select(stable_sample.place("seq").alias("p")).collect()] == want


def test_known_numbers_are_kept(spark):
    first, early = sample(spark, arrivals(500))
    known = spark.createDataFrame([(r.q, r.seq) for r in first.collect()], "q bigint, seq bigint")
    late = [(q + 10_000, T0 - timedelta(days=1), "late though early") for q in range(50)]
    both, all_ = sample(spark, arrivals(500) + late, known=known)
    assert early <= all_
    assert {r.q: r.seq for r in both.collect() if r.q < 10_000} == {r.q: r.seq for r in known.collect()}


def test_late_arrivals_move_no_number(spark):
    """The kept table of numbers: members stay, though a key comes later with an earlier, an equal or no time."""
    scratch, schema = Scratch(spark, "t"), "q bigint, t timestamp"
    first = [r[:2] for r in arrivals(2000)]
    at = stable_sample.extend(spark.createDataFrame(first, schema), "q", "t", scratch, None)
    before = {r.q: r.seq for r in spark.read.parquet(at).collect()}
    late = [(50_000, T0 - timedelta(days=9)), (50_001, T0), (50_002, None), (None, T0)]
    later = stable_sample.extend(spark.createDataFrame(first + late, schema).repartition(5), "q", "t", scratch, at)
    after = {r.q: r.seq for r in spark.read.parquet(later).collect()}
    assert {q: after[q] for q in before} == before
    assert sorted(after.values()) == list(range(len(after))) and [after[50_000 + i] for i in range(3)] == [len(before) + i for i in range(3)]
    kept = lambda at: {r.q for r in stable_sample.chosen(spark.read.parquet(at), 0.2).collect()}
    assert kept(at) <= kept(later)
    none = stable_sample.extend(spark.createDataFrame([], schema), "q", "t", scratch, None)
    assert spark.read.parquet(stable_sample.extend(spark.createDataFrame(late, schema), "q", "t", scratch, none)).count() == 3


def test_nulls_ties_and_empty(spark):
    rows = [(None, T0, ""), (1, None, ""), (2, T0, ""), (3, T0, None), (3, T0, None), (1, T0, "")]
    numbered, _ = sample(spark, rows)
    assert {r.q: r.seq for r in numbered.collect()} == {1: 0, 2: 1, 3: 2}  # ties go by key
    assert sample(spark, [(5, None, ""), (6, T0, "")])[0].orderBy("seq").collect()[0].q == 6
    assert sample(spark, [])[0].count() == 0


def values(seed):
    r = random.Random(seed)
    out = [int(r.paretovariate(1)) for _ in range(8000)]
    return out + [-7] * 900 + list(range(10**6, 10**6 + 3000))  # common only in a stretch, and many rare values


@pytest.mark.parametrize("seed", range(2))
def test_bounds_and_top(spark, seed):
    vs = values(seed)
    true = Counter(vs)
    df = spark.createDataFrame([(v, "a") for v in vs], "v bigint, item string").repartition(40)  # two merge levels
    k = 50
    rows = heavy_hitters.summary(df, "v", k).collect()
    lost = max(r.lost for r in rows)
    held = {r.item: r.n for r in rows if r.item is not None}
    assert len(held) <= k and lost <= len(vs) / (k + 1)
    assert all(held[v] <= true[v] <= held[v] + lost for v in held)
    assert all(n <= lost for v, n in true.items() if v not in held)
    want = sorted(true.items(), key=lambda x: (-x[1], x[0]))[:20]
    assert [tuple(r) for r in heavy_hitters.top(df, "v", 20, k=8).collect()] == want


def test_evenly_spread_values_need_no_larger_summary(spark, monkeypatch):
    """Values of two rows each: no summary can tell them apart. The exact count does, and the summary is made once."""
    df = spark.range(40_000).select((F.col("id") % 20_000).alias("v")).repartition(7)
    asked = []
    made = heavy_hitters.summary
    monkeypatch.setattr(heavy_hitters, "summary", lambda df, column, k: asked.append(k) or made(df, column, k))
    assert [tuple(r) for r in heavy_hitters.top(df, "v", 5, k=64).collect()] == [(i, 2) for i in range(5)]
    assert asked == [64]


def test_text_nulls_big_numbers_and_empty(spark):
    df = spark.createDataFrame([("b",), ("b",), (None,), (None,), (None,), ("a",), ("",), ("",), ("x" * 100_000,)], "v string")
    assert [tuple(r) for r in heavy_hitters.top(df, "v", 3).collect()] == [("", 2), ("b", 2), ("a", 1)]
    big = spark.createDataFrame([(2**62 + 1,), (2**62 + 1,), (2**62,), (None,)], "v bigint")
    assert [tuple(r) for r in heavy_hitters.top(big, "v", 9).collect()] == [(2**62 + 1, 2), (2**62, 1)]
    assert heavy_hitters.top(df.limit(0), "v", 3).count() == 0
    assert heavy_hitters.top(df.where(F.col("v").isNull()), "v", 3).count() == 0

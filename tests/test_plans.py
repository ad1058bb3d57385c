"""Plans and selections over small tables of their own."""

import base64

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as e
from fjordlens.functions import canon
from tests.oracle import compare


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """400 concepts; those above 380 are endpoints without text and outside the sample."""
    d = str(tmp_path_factory.mktemp("small"))
    q = spark.range(1, 401).select(F.col("id").alias("Qid"))
    q.select("Qid", (F.col("Qid") % 3 == 0).alias("InT1"), F.expr("Qid % 2 = 0 and Qid % 5 > 0 or Qid > 380").alias("InT2")).withColumn(
        "InT1", F.col("InT1") & (F.col("Qid") <= 380)
    ).write.parquet(f"{d}/concept.parquet")
    text = q.where("Qid <= 380 and Qid % 5 > 0")
    text.select("Qid", F.lit("en").alias("Lang"), F.concat(F.lit("v"), F.col("Qid") % 3).alias("Value")).write.parquet(f"{d}/lexical_entry.parquet")
    q.select(F.col("Qid").alias("SubjectQid"), (F.col("Qid") % 7 + 1).alias("TargetQid")).write.parquet(f"{d}/instance_of.parquet")
    q.where("Qid > 8").select(F.col("Qid").alias("SubjectQid"), F.expr("Qid div 2").alias("TargetQid")).write.parquet(f"{d}/subclass_of.parquet")
    return d


def check(spark, d, name):
    compare(spark, d, e.queries()[name], e.oracle_sql()[name])
    return e.queries()[name](spark, d)


def test_plan_ends_with_every_tail_concept(spark, small):
    rows = check(spark, small, "small_serving_plan").orderBy("seq").collect()
    assert [r.seq for r in rows] == list(range(len(rows)))
    tail = [r for r in rows if not r.measured]
    assert [(r.op, r.stratum, r.qid) for r in tail] == [("S1", "Tail", q) for q in range(381, 401)]
    assert rows[-len(tail) :] == tail


def test_contract_guard(spark, tmp_path):
    """A start of 5,000 visited nodes is within the contract's guard, one of 5,001 is not."""
    d = str(tmp_path)
    wide = spark.range(4999).select(F.lit(1).cast("bigint").alias("SubjectQid"), (F.col("id") + 100).alias("TargetQid"))
    wider = spark.range(5000).select(F.lit(2).cast("bigint").alias("SubjectQid"), (F.col("id") + 100).alias("TargetQid"))
    more = spark.createDataFrame([(q, 100 + q + k) for q in (3, 4) for k in range(40)], "SubjectQid bigint, TargetQid bigint")
    wide.union(wider).union(more).write.parquet(f"{d}/subclass_of.parquet")
    spark.range(1, 20).select(F.col("id").alias("Qid"), F.lit(True).alias("InT1"), F.lit(False).alias("InT2")).write.parquet(f"{d}/concept.parquet")
    spark.createDataFrame([(1, "en", "a")], "Qid bigint, Lang string, Value string").write.parquet(f"{d}/lexical_entry.parquet")
    spark.createDataFrame([(11, 1), (12, 2), (13, 3)], "SubjectQid bigint, TargetQid bigint").write.parquet(f"{d}/instance_of.parquet")
    g1 = {r.qid: r.visited for r in check(spark, d, "g1_selection").collect()}
    assert g1 == {1: 5000, 3: 41, 4: 41}
    g2 = {r.qid: r.max_visited for r in check(spark, d, "g2_batch_selection").collect()}
    assert g2 == {11: 5000, 13: 41}


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """30 texts of 51 rows each and 1,200 concepts, all within the sample."""
    d = str(tmp_path_factory.mktemp("many"))
    q = spark.range(1, 1201).select(F.col("id").alias("Qid"))
    q.select("Qid", F.lit(True).alias("InT1"), F.lit(False).alias("InT2")).write.parquet(f"{d}/concept.parquet")
    spark.range(30 * 51).select((F.col("id") % 51 + 1).alias("Qid"), F.lit("en").alias("Lang"), F.concat(F.lit("v"), F.expr("id div 51")).alias("Value")).write.parquet(
        f"{d}/lexical_entry.parquet"
    )
    q.where("Qid <= 500").select(F.col("Qid").alias("SubjectQid"), F.lit(7).cast("bigint").alias("TargetQid")).write.parquet(f"{d}/instance_of.parquet")
    q.limit(0).select(F.col("Qid").alias("SubjectQid"), F.col("Qid").alias("TargetQid")).write.parquet(f"{d}/subclass_of.parquet")
    return d


def test_contract_takes_whole_pools_and_its_counts(spark, many):
    n = {r.pool: r["count"] for name in ("rank_sample", "rank_sample_lexical") for r in check(spark, many, name).groupBy("pool").count().collect()}
    assert n == {"S1/T1Only": 1200, "S2/Fanout51Plus": 30, "S3/T1WithLexical": 51, "S3/ConceptNoLexical": 1000, "S4/Degree0": 700, "S4/Degree1": 500, "S4/HighDegree": 500, "S5/Degree0": 1200}
    plan = {(r.op, r.stratum): r["count"] for r in check(spark, many, "serving_plan").groupBy("op", "stratum").count().collect()}
    assert plan == {tuple(k.split("/")): v for k, v in n.items()} | {("S1", "Absent"): 4000, ("S2", "Miss"): 4000}
    small = {r.pool: r["count"] for r in check(spark, many, "small_rank_sample_lexical").groupBy("pool").count().collect()}
    assert small == {"S2/Fanout51Plus": 30}  # taken whole, though 20 are expected


def test_misses_are_made_until_enough(spark):
    """The first 200 candidates are refused, more than the first attempt makes."""
    from fjordlens.plans import workload

    got = workload._made(spark, 10, "x", "S1/Absent", lambda made: made.where("counter >= 200"))
    assert sorted(r.counter for r in got.collect()) == list(range(200, 210))


def test_contract_gates(spark, many):
    got = {r.pool: (r.needed, r.have, r.verdict) for r in check(spark, many, "census_gates").collect()}
    assert got["S2/Fanout51Plus"] == (380, 30, "HOLD") and got["S1/Tail"] == (20, 0, "HOLD")
    assert got["S3/ConceptNoLexical"] == (1000, 1149, "GO") and got["S4/HighDegree"] == (500, 500, "GO")
    assert got["S1/T1Only"] == (4000, 1200, "HOLD") and "S1/Absent" not in got


def test_long_keys_are_ranked_in_one_line(spark):
    row = spark.range(1).select(canon.lexical_identity(F.lit("en"), F.lit("A" * 60)).alias("i")).collect()[0]
    assert row.i == base64.b64encode(b"\0\0\0\2en\0\0\0<" + b"A" * 60).decode()

"""Workload packages: probes and expected results as JSON lines, read back strictly and judged by gates; and sample artifacts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fjordlens.functions import canon
from fjordlens.operators import multiset_fold
from fjordlens.plans import catalog, timing, workload
from fjordlens.plans.runtime import Scratch
from fjordlens.sources import records
from fjordlens.sources.contracts import Contract
from fjordlens.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
FOLDS = {"A1Concept": ("concept", canon.concept_row), "A1LexicalEntry": ("lexical_entry", canon.lexical_row), "A1InstanceOf": ("instance_of", canon.edge_row), "A1SubclassOf": ("subclass_of", canon.edge_row)}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _turns(rows: DataFrame) -> DataFrame:
    """Strata take turns by rank; the contract bounds the rows."""
    return rows.withColumn("seq", F.row_number().over(Window.orderBy("rank", "stratum")) - 1)


def write_package(spark: SparkSession, d: str, c: Contract, at: str) -> None:
    """serving, graph, expected and analytical records of one contract below ``at``."""
    scratch = Scratch(spark, "package")
    serving = scratch.cut(workload.plan(spark, d, c))
    records.write(serving, f"{at}/serving", records.PROBE, ["seq"])
    named = serving.select(F.col("op").alias("Op"), F.col("seq").alias("Seq"), F.col("qid").alias("Qid"), F.col("lang").alias("Lang"), F.col("value").alias("Value"))
    found = catalog.results(named, catalog.relations(spark, d)).join(serving.select("op", "seq", "measured"), ["op", "seq"])
    g1 = scratch.cut(_turns(workload.g1_starts(spark, d, c)).select("seq", "stratum", F.col("qid").alias("start")))
    n1 = g1.count()
    g2 = scratch.cut(_turns(workload.g2_inputs(spark, d, c)).select(F.col("seq").alias("item"), F.col("stratum").alias("source_stratum"), "qid"))
    listed = F.array_sort(F.collect_list(F.struct("item", "qid", "source_stratum")))  # the contract's batch
    batch = g2.agg(F.transform(listed, lambda x: F.struct(x.qid.alias("qid"), x.source_stratum.alias("source_stratum"))).alias("concepts")).select(
        F.lit("G2").alias("op"), F.lit("Batch").alias("stratum"), F.lit(n1).alias("seq"), F.lit(True).alias("measured"), "concepts"
    )
    graph = g1.select(F.lit("G1").alias("op"), "stratum", "seq", F.lit(True).alias("measured"), "start")
    records.write(graph.unionByName(batch, allowMissingColumns=True), f"{at}/graph", records.GRAPH_PROBE, ["op", "seq"])
    g1_found = catalog.g1_results(spark, d, g1.select(F.col("start").alias("seed")).distinct(), c.guard).withColumnRenamed("start", "seed")
    g1_found = g1.join(g1_found, g1["start"] == g1_found["seed"]).select(
        F.lit("G1").alias("op"), "seq", F.lit(True).alias("measured"), "cardinality", "visited", "digest"
    )
    each = scratch.cut(g2.join(catalog.g2_results(spark, d, g2.select(F.col("qid").alias("input")), c.guard), "qid"))
    per_input = each.select(
        F.lit("G2").alias("op"), F.lit(n1).alias("seq"), F.lit("PerInput").alias("kind"), F.lit(False).alias("measured"), "item", "qid", "source_stratum", "cardinality", "digest"
    )
    whole = catalog.stream_digest(each, [F.col("item")], F.concat(canon.be64("qid"), canon.be64("cardinality"), "hexed")).select(
        F.lit("G2").alias("op"), F.lit(n1).alias("seq"), F.lit("Batch").alias("kind"), F.lit(True).alias("measured"), F.col("n").alias("cardinality"), "digest"
    )
    parts = [found, g1_found, per_input, whole]
    # written as tables first: sorting by ranges reads its input twice
    records.write(scratch.cut(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)), f"{at}/expected", records.EXPECTED, ["op", "seq", "item"])
    folds = [multiset_fold.fold(table(spark, d, n), row()).select(F.lit(op).alias("op"), F.col("rows").alias("cardinality"), "digest") for op, (n, row) in FOLDS.items()]
    analytical = reduce(DataFrame.unionByName, [*folds, catalog.aggregates(catalog.relations(spark, d))])
    records.write(scratch.cut(analytical), f"{at}/analytical", records.ANALYTICAL, ["op"])


def judge(spark: SparkSession, at: str, c: Contract) -> DataFrame:
    """(gate, ok) of a package: every gate of counts, keys and places. Unreadable records fail the first one."""
    scratch = Scratch(spark, "judge")
    serving, graph, expected, analytical = (
        scratch.cut(records.read(spark, f"{at}/{n}", f))
        for n, f in (("serving", records.PROBE), ("graph", records.GRAPH_PROBE), ("expected", records.EXPECTED), ("analytical", records.ANALYTICAL))
    )
    ok = {"records_read": not any(map(records.problems, (serving, graph, expected, analytical)))}
    serving_keys, graph_rows = serving.select("op", "seq"), graph.where("op = 'G1'").select("seq")
    results = expected.where("op not in ('G1', 'G2')").select("op", "seq")
    n = serving.agg(
        F.count_if("measured").alias("measured"), F.count_if((F.col("op") == "S1") & (F.col("stratum") == "Tail")).alias("tail"),
        F.count_if((F.col("stratum") == "Tail") & F.col("measured")).alias("tail_measured"),
    ).collect()[0]

    def unique(df: DataFrame) -> bool:
        return df.groupBy(*df.columns).count().where("count > 1").isEmpty()

    def same(a: DataFrame, b: DataFrame) -> bool:
        return a.join(b, a.columns, "left_anti").isEmpty() and b.join(a, a.columns, "left_anti").isEmpty()

    ok["serving_measured"] = n["measured"] == sum(s.count for s in c.strata if s.operation != "G1")
    ok["serving_keys_unique"], ok["expected_keys_unique"] = unique(serving_keys), unique(results)
    ok["serving_keys_equal"] = same(serving_keys, results)
    ok["tail_count"], ok["tail_unmeasured"] = n["tail"] == sum(s.count for s in c.tail), n["tail_measured"] == 0
    wanted = sum(s.count for s in c.strata if s.operation == "G1")
    starts, found = graph_rows.count(), expected.where("op = 'G1'").select("seq")
    ok["g1_count"] = starts == wanted and found.count() == wanted
    ok["g1_keys_equal"] = unique(graph_rows) and unique(found) and same(graph_rows, found)
    ok["g1_contiguous"] = same(graph_rows, spark.range(starts).select(F.col("id").alias("seq")))
    batches = graph.where("op = 'G2' and measured").select("seq", F.size("concepts").alias("n")).collect()  # one is expected
    ok["g2_one_batch"] = len(batches) == 1
    listed = graph.where("op = 'G2' and measured").select(F.posexplode("concepts").alias("item", "x")).select("item", "x.*")
    sources = {r["source_stratum"]: r["count"] for r in listed.groupBy("source_stratum").count().collect()}
    total = sum(k for _, k in c.g2)
    ok["g2_size"] = len(batches) == 1 and batches[0]["n"] == total
    ok["g2_unique"], ok["g2_sources"] = unique(listed.select("qid")), sources == dict(c.g2)
    ok["g2_seq"] = len(batches) == 1 and batches[0]["seq"] == starts and expected.where("op = 'G2'").where(F.col("seq") != starts).isEmpty()
    inputs = expected.where("op = 'G2' and kind = 'PerInput'")
    ok["g2_inputs"] = inputs.count() == total and inputs.where("measured").isEmpty() and expected.where("op = 'G2' and kind = 'Batch'").count() == 1
    ok["g2_places"] = same(listed.select(F.col("item").cast("bigint").alias("item"), "qid", "source_stratum"), inputs.select("item", "qid", "source_stratum"))
    ops = sorted(r["op"] for r in analytical.select("op").collect())  # eight are expected
    ok["analytical_operations"] = ops == sorted([*FOLDS, "A2", "A3", "A4", "A5"])
    return spark.createDataFrame(list(ok.items()), "gate string, ok boolean")


_SMALL = workload.CONTRACTS["small_"]
_STATEMENTS = workload.Statements(_SMALL)
_TRUE = (
    "records_read", "serving_keys_unique", "expected_keys_unique", "serving_keys_equal", "tail_unmeasured", "g1_keys_equal", "g1_contiguous", "g2_one_batch",
    "g2_unique", "g2_seq", "g2_places", "analytical_operations",
)


@query(f"""
SELECT unnest([{', '.join(f"'{g}'" for g in _TRUE)}]) AS gate, TRUE AS ok
UNION ALL SELECT 'serving_measured', (SELECT count(*) FROM ({_STATEMENTS.plan}) WHERE measured) = {sum(s.count for s in _SMALL.strata if s.operation != "G1")}
UNION ALL SELECT 'tail_count', (SELECT count(*) FROM ({_STATEMENTS.plan}) WHERE NOT measured) = {sum(s.count for s in _SMALL.tail)}
UNION ALL SELECT 'g1_count', (SELECT count(*) FROM ({_STATEMENTS.g1})) = {sum(s.count for s in _SMALL.strata if s.operation == "G1")}
UNION ALL SELECT unnest(['g2_size', 'g2_inputs']), (SELECT count(*) FROM ({_STATEMENTS.g2})) = {sum(n for _, n in _SMALL.g2)}
UNION ALL SELECT 'g2_sources', (SELECT {' AND '.join(f"count(*) FILTER (WHERE stratum = '{s}') = {n}" for s, n in _SMALL.g2)} FROM ({_STATEMENTS.g2}))""")
def package_gates(spark: SparkSession, d: str) -> DataFrame:
    """A workload package of the small contract, written, read back and judged. Pools that are too small show as failed counts."""
    at = f"{Scratch(spark, 'workload').root}/package"
    write_package(spark, d, _SMALL, at)
    return judge(spark, at, _SMALL)


def _artifact_problem(wall: str) -> str:
    return f"""CASE WHEN Stratum IS NULL AND {wall} IS NULL THEN 'stratum: missing' WHEN Stratum IS NULL THEN 'stratum: missing' WHEN {wall} IS NULL THEN 'wall_seconds: missing'
  WHEN isnan({wall}) THEN 'wall_seconds: other type' WHEN {wall} < 0 THEN 'wall_seconds: out of range' END"""


@query(f"WITH {timing._FIRST} SELECT {_artifact_problem('WallSeconds')} AS problem, count(*) AS n FROM s GROUP BY 1")
def sample_artifact(spark: SparkSession, d: str) -> DataFrame:
    """All timed samples written as an artifact and read back strictly: good ones (null) and problems by name."""
    at = f"{Scratch(spark, 'artifact').root}/samples"
    named = {
        "operation": F.col("op"), "sequence": F.col("Sequence"), "stratum": F.col("Stratum"), "wall_seconds": F.col("WallSeconds"), "correctness_status": F.col("CorrectnessStatus"),
        "actual_cardinality": F.col("ActualCardinality"), "actual_visited": F.col("ActualVisited"), "actual_digest": F.col("ActualDigest"),
    }
    rows: list[Column] = [c.alias(n) for n, c in named.items()]
    records.write(timing.samples(spark, d).select(*rows), at, records.SAMPLE, ["operation", "sequence"])
    return records.read(spark, at, records.SAMPLE).groupBy("problem").agg(F.count("*").alias("n"))

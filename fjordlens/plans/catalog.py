"""Queries of the catalog: lookups, traversals, full scans and their digests, with their SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fjordlens.functions import canon, fixed
from fjordlens.operators import hierarchy, lookups, multiset_fold, traversal
from fjordlens.plans.runtime import Scratch, global_rank
from fjordlens.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL if it has one."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


# Pieces of DuckDB SQL for the canonical encodings.
def d64(x: str) -> str:
    return f"lpad(hex(CAST({x} AS BIGINT)), 16, '0')"


def d32(x: str) -> str:
    return f"lpad(hex(CAST({x} AS BIGINT)), 8, '0')"


def dtext(x: str) -> str:
    return f"({d32(f'strlen({x})')} || hex({x}))"


def dsized(n: str, h: str) -> str:
    return f"sha256(unhex({d64(n)} || {d32(f'length({h}) // 2')} || {h}))"


def dflag(x: str) -> str:
    return f"CASE WHEN {x} THEN '01' ELSE '00' END"


DUCK_CONCEPT = f"{d64('Qid')} || {dflag('InT1')} || {dflag('InT2')}"
DUCK_LEXICAL = f"{d64('Qid')} || {dtext('Lang')} || {dtext('LexKind')} || {dtext('Value')}"
DUCK_EDGE = f"{d64('SubjectQid')} || {d64('TargetQid')}"


def _probes(op: str) -> str:
    return f"(SELECT DISTINCT Seq AS seq, Qid AS qid, Lang AS lang, Value AS value FROM serving_probe WHERE Op = '{op}')"


# ---- exact-key lookups ----
@query(f"""
SELECT p.seq, p.qid, c.Qid IS NOT NULL AS present, c.InT1 AS in_t1, c.InT2 AS in_t2
FROM {_probes('S1')} p LEFT JOIN concept c ON c.Qid = p.qid""")
def s1_concept_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Whether each probed concept exists, and its tiers."""
    return lookups.concept_lookup(lookups.probes(table(spark, d, "serving_probe"), "S1"), table(spark, d, "concept"))


@query(f"""
SELECT p.seq, p.lang, p.value, l.Qid AS qid, l.LexKind AS lex_kind
FROM {_probes('S2')} p LEFT JOIN lexical_entry l ON l.Lang = p.lang AND l.Value = p.value""")
def s2_lexical_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The concepts that have exactly the probed language and text."""
    return lookups.lexical_lookup(lookups.probes(table(spark, d, "serving_probe"), "S2"), table(spark, d, "lexical_entry"))


@query(f"""
SELECT p.seq, p.qid, l.Lang AS lang, l.LexKind AS lex_kind, l.Value AS value
FROM {_probes('S3')} p LEFT JOIN lexical_entry l ON l.Qid = p.qid""")
def s3_lexical_by_qid(spark: SparkSession, d: str) -> DataFrame:
    """All texts of each probed concept."""
    return lookups.lexical_of(lookups.probes(table(spark, d, "serving_probe"), "S3"), table(spark, d, "lexical_entry"))


def _targets_sql(op: str, name: str) -> str:
    return f"SELECT p.seq, p.qid, e.TargetQid AS target FROM {_probes(op)} p LEFT JOIN {name} e ON e.SubjectQid = p.qid"


@query(_targets_sql("S4", "instance_of"))
def s4_instance_of(spark: SparkSession, d: str) -> DataFrame:
    """The instance-of targets of each probed concept."""
    return lookups.targets_of(lookups.probes(table(spark, d, "serving_probe"), "S4"), table(spark, d, "instance_of"))


@query(_targets_sql("S5", "subclass_of"))
def s5_subclass_of(spark: SparkSession, d: str) -> DataFrame:
    """The subclass-of targets of each probed concept."""
    return lookups.targets_of(lookups.probes(table(spark, d, "serving_probe"), "S5"), table(spark, d, "subclass_of"))


_LISTS = f"""
SELECT op, seq, count(h) AS cardinality, {dsized('count(h)', "coalesce(string_agg(h, '' ORDER BY o1, o2, o3), '')")} AS digest
FROM (
  SELECT 'S3' AS op, p.seq, l.Lang AS o1, l.LexKind AS o2, l.Value AS o3,
    {d64('l.Qid')} || {dtext('l.Lang')} || {dtext('l.LexKind')} || {dtext('l.Value')} AS h
  FROM {_probes('S3')} p LEFT JOIN lexical_entry l ON l.Qid = p.qid
  UNION ALL
  SELECT 'S4', p.seq, {d64('e.TargetQid')}, '', '', {d64('0')} || {d64('e.TargetQid')}
  FROM {_probes('S4')} p LEFT JOIN instance_of e ON e.SubjectQid = p.qid
  UNION ALL
  SELECT 'S5', p.seq, {d64('e.TargetQid')}, '', '', {d64('0')} || {d64('e.TargetQid')}
  FROM {_probes('S5')} p LEFT JOIN subclass_of e ON e.SubjectQid = p.qid
  UNION ALL
  SELECT 'S2', p.seq, {d64('l.Qid')}, l.LexKind, '', {d64('l.Qid')} || {dtext('l.LexKind')}
  FROM {_probes('S2')} p JOIN lexical_entry l ON l.Lang = p.lang AND l.Value = p.value)
GROUP BY op, seq"""


_SERVING = f"""
{_LISTS}
UNION ALL
SELECT 'S1', p.seq, CAST((c.Qid IS NOT NULL) AS BIGINT), CASE WHEN c.Qid IS NULL
  THEN sha256(unhex({d64('0')} || {d64('p.qid')}))
  ELSE sha256(unhex({d64('1')} || {d32('10')} || {d64('c.Qid')} || {dflag('c.InT1')} || {dflag('c.InT2')})) END
FROM {_probes('S1')} p LEFT JOIN concept c ON c.Qid = p.qid
UNION ALL
SELECT 'S2', p.seq, 0, sha256(unhex({d64('0')} || {dtext('p.lang')} || {dtext('p.value')}))
FROM {_probes('S2')} p WHERE NOT EXISTS (SELECT 1 FROM lexical_entry l WHERE l.Lang = p.lang AND l.Value = p.value)"""


def results(probe: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(op, seq, cardinality, digest) of every lookup probe (Op, Seq, Qid, Lang, Value) over the four relations."""
    lexical = tables["lexical_entry"]
    none = F.lit("")
    s3 = lookups.lexical_of(lookups.probes(probe, "S3"), lexical).select(
        F.lit("S3").alias("op"), "seq", canon.ordinal("lang").alias("o1"), canon.ordinal("lex_kind").alias("o2"), canon.ordinal("value").alias("o3"),
        F.concat(canon.be64("qid"), canon.text("lang"), canon.text("lex_kind"), canon.text("value")).alias("hexed"),
    )
    s2 = lookups.lexical_lookup(lookups.probes(probe, "S2"), lexical)
    hit2 = s2.where("qid is not null").select(
        F.lit("S2").alias("op"), "seq", canon.ordinal(canon.be64("qid")).alias("o1"), canon.ordinal("lex_kind").alias("o2"), canon.ordinal(none).alias("o3"),
        F.concat(canon.be64("qid"), canon.text("lex_kind")).alias("hexed"),
    )

    def edges(op: str, name: str) -> DataFrame:
        found = lookups.targets_of(lookups.probes(probe, op), tables[name])
        return found.select(
            F.lit(op).alias("op"), "seq", canon.ordinal(canon.be64("target")).alias("o1"), canon.ordinal(none).alias("o2"), canon.ordinal(none).alias("o3"),
            F.concat(canon.be64(F.lit(0)), canon.be64("target")).alias("hexed"),
        )

    lists = s3.unionByName(hit2).unionByName(edges("S4", "instance_of")).unionByName(edges("S5", "subclass_of"))
    out = lookups.list_digests(lists, ["op", "seq"], ["o1", "o2", "o3"])
    s1 = lookups.concept_lookup(lookups.probes(probe, "S1"), tables["concept"]).select(
        F.lit("S1").alias("op"), "seq", F.col("present").cast("bigint").alias("cardinality"),
        F.when(F.col("present"), canon.digest(F.concat(canon.be64(F.lit(1)), canon.be32(F.lit(10)), canon.be64("qid"), canon.flag("in_t1"), canon.flag("in_t2"))))
        .otherwise(canon.digest(F.concat(canon.be64(F.lit(0)), canon.be64("qid")))).alias("digest"),
    )
    miss2 = s2.where("qid is null").select(
        F.lit("S2").alias("op"), "seq", F.lit(0).cast("bigint").alias("cardinality"),
        canon.digest(F.concat(canon.be64(F.lit(0)), canon.text("lang"), canon.text("value"))).alias("digest"),
    )
    return out.unionByName(s1).unionByName(miss2)


RELATIONS = ("concept", "lexical_entry", "instance_of", "subclass_of")


def relations(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {n: table(spark, d, n) for n in RELATIONS}


def candidate(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The second system: its copy of three relations, and subclass_of, which it does not copy."""
    copy = table(spark, d, "candidate_row")
    part = lambda n, *c: copy.where(F.col("Relation") == n).select("RowId", *c)
    return {
        "concept": part("concept", "Qid", "InT1", "InT2"), "lexical_entry": part("lexical_entry", "Qid", "Lang", "LexKind", "Value"),
        "instance_of": part("instance_of", "SubjectQid", "TargetQid"), "subclass_of": table(spark, d, "subclass_of"),
    }


def _of_candidate(sql: str) -> str:
    """The same SQL over the copy: common table expressions take the names of the relations."""
    return f"""WITH concept AS (SELECT RowId, Qid, InT1, InT2 FROM candidate_row WHERE Relation = 'concept'),
lexical_entry AS (SELECT RowId, Qid, Lang, LexKind, Value FROM candidate_row WHERE Relation = 'lexical_entry'),
instance_of AS (SELECT RowId, SubjectQid, TargetQid FROM candidate_row WHERE Relation = 'instance_of')
SELECT * FROM ({sql})"""


def verdicts(actual: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., verdict): VALID if cardinality and digest are equal, INVALID if not, ERROR where one side lacks the key or an
    actual result has no digest."""
    a = actual.select(*keys, F.col("cardinality").alias("_c"), F.col("digest").alias("_d"), F.lit(True).alias("_a"))
    e = expected.select(*keys, "cardinality", "digest", F.lit(True).alias("_e"))
    equal = (F.col("_c") == F.col("cardinality")) & (F.col("_d") == F.col("digest"))
    verdict = F.when(F.col("_a").isNull() | F.col("_e").isNull() | F.col("_d").isNull(), "ERROR").when(equal, "VALID").otherwise("INVALID")
    return a.join(e, keys, "full").select(*keys, verdict.alias("verdict"))


def _verdict_sql(actual: str, expected: str, keys: str) -> str:
    return f"""
SELECT {keys}, CASE WHEN a.digest IS NULL OR e.digest IS NULL THEN 'ERROR' WHEN a.cardinality = e.cardinality AND a.digest = e.digest THEN 'VALID' ELSE 'INVALID' END AS verdict
FROM ({actual}) a FULL JOIN ({expected}) e USING ({keys})"""


@query(_SERVING)
def serving_digests(spark: SparkSession, d: str) -> DataFrame:
    """The expected cardinality and digest of every lookup probe."""
    return results(table(spark, d, "serving_probe"), relations(spark, d))


@query(f"SELECT op, verdict, count(*) AS n FROM ({_verdict_sql(_of_candidate(_SERVING), _SERVING, 'op, seq')}) GROUP BY 1, 2")
def serving_check(spark: SparkSession, d: str) -> DataFrame:
    """The lookups of the second system against the expected results, by operation and verdict."""
    probe = table(spark, d, "serving_probe")
    out = verdicts(results(probe, candidate(spark, d)), results(probe, relations(spark, d)), ["op", "seq"])
    return out.groupBy("op", "verdict").agg(F.count("*").alias("n"))


# ---- traversals ----
_EDGES = "SELECT DISTINCT SubjectQid AS node, TargetQid AS parent FROM subclass_of"
_WALK = f"""
e AS ({_EDGES}),
walk(seed, node, k) AS (
  SELECT seed, seed, 0 FROM seeds
  UNION
  SELECT w.seed, e.parent, w.k + 1 FROM walk w JOIN e ON e.node = w.node WHERE w.k < {fixed.MAX_DEPTH}),
met AS (SELECT DISTINCT seed, node FROM walk WHERE node <> seed)"""
_STARTS = "SELECT DISTINCT StartQid AS seed FROM graph_probe WHERE Op = 'G1' AND StartQid IS NOT NULL"
_G2_INPUTS = "SELECT DISTINCT Qid AS input FROM serving_probe WHERE Op = 'S4' AND Qid IS NOT NULL"


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.links(table(spark, d, "subclass_of"), "SubjectQid", "TargetQid")


def _starts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "graph_probe").where("Op = 'G1' and StartQid is not null").select(F.col("StartQid").alias("seed")).distinct()


@query(f"WITH RECURSIVE seeds AS ({_STARTS}), {_WALK} SELECT seed AS start, node FROM met")
def g1_ancestry(spark: SparkSession, d: str) -> DataFrame:
    """Every node within three upward links of each probed start."""
    return traversal.ancestry(_starts(spark, d), _edges(spark, d)).withColumnRenamed("seed", "start")


def g1_results(spark: SparkSession, d: str, starts: DataFrame, guard: int) -> DataFrame:
    """(start, cardinality, visited, exceeded, digest) of each seed of ``starts``."""
    met = traversal.ancestry(starts, _edges(spark, d))
    sizes = starts.join(met.groupBy("seed").agg(F.count("*").alias("n")), "seed", "left").select("seed", F.coalesce("n", F.lit(0)).alias("n"))
    over = F.col("n") + 1 > guard
    within = sizes.where(~over)
    listed = traversal.ordered_list(within.join(met, "seed", "left"), "seed", "node")
    return (
        sizes.join(listed, "seed", "left")
        .select(
            F.col("seed").alias("start"),
            F.when(~over, F.col("n")).alias("cardinality"),
            F.least(F.col("n") + 1, F.lit(guard)).alias("visited"),
            over.alias("exceeded"),
            F.when(~over, canon.digest(F.concat(canon.be64("n"), "hexed", canon.be64(F.col("n") + 1)))).alias("digest"),
        )
    )


def _g1_summary_sql(guard: int) -> str:
    digest = f"sha256(unhex({d64('n')} || coalesce(h, '') || {d64('n + 1')}))"
    return f"""
WITH RECURSIVE seeds AS ({_STARTS}), {_WALK},
s AS (SELECT seeds.seed, count(node) AS n, string_agg({d64('node')}, '' ORDER BY node) AS h
  FROM seeds LEFT JOIN met ON met.seed = seeds.seed GROUP BY 1)
SELECT seed AS start, CASE WHEN n + 1 <= {guard} THEN n END AS cardinality, least(n + 1, {guard}) AS visited,
  n + 1 > {guard} AS exceeded, CASE WHEN n + 1 <= {guard} THEN {digest} END AS digest FROM s"""


@query(_g1_summary_sql(fixed.VISITED_GUARD))
def g1_summary(spark: SparkSession, d: str) -> DataFrame:
    """Cardinality, visited nodes and digest of each start's ancestry under the guard."""
    return g1_results(spark, d, _starts(spark, d), fixed.VISITED_GUARD)


@query(_g1_summary_sql(12))
def g1_guarded(spark: SparkSession, d: str) -> DataFrame:
    """The same under a guard of 12, which some starts exceed."""
    return g1_results(spark, d, _starts(spark, d), 12)


def _g2_inputs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "serving_probe").where("Op = 'S4' and Qid is not null").select(F.col("Qid").alias("input")).distinct()


def _g2(spark: SparkSession, d: str, inputs: DataFrame, guard: int = fixed.VISITED_GUARD) -> tuple[DataFrame, DataFrame]:
    """(input, exceeded) of each input, exceeded if the ancestry of one of its targets goes beyond the guard; and
    (input, node) of those that don't: targets and their ancestry."""
    direct = inputs.join(table(spark, d, "instance_of").select(F.col("SubjectQid").alias("input"), F.col("TargetQid").alias("seed")), "input").distinct()
    met = traversal.ancestry(direct.select("seed"), _edges(spark, d))
    over = met.groupBy("seed").agg(F.count("*").alias("n")).where(F.col("n") + 1 > guard).select("seed")
    bad = direct.join(over, "seed", "left_semi").select("input", F.lit(True).alias("bad")).distinct()
    judged = inputs.join(bad, "input", "left").select("input", F.coalesce("bad", F.lit(False)).alias("exceeded"))
    fit = direct.join(bad, "input", "left_anti")
    far = fit.join(met, "seed").select("input", "node")
    return judged, fit.select("input", F.col("seed").alias("node")).unionByName(far).distinct()


def _g2_sql(guard: int = fixed.VISITED_GUARD) -> str:
    return f"""
WITH RECURSIVE inputs AS ({_G2_INPUTS}),
direct AS (SELECT DISTINCT i.input, e.TargetQid AS seed FROM inputs i JOIN instance_of e ON e.SubjectQid = i.input),
seeds AS (SELECT DISTINCT seed FROM direct), {_WALK},
over AS (SELECT seed FROM met GROUP BY 1 HAVING count(*) + 1 > {guard}),
bad AS (SELECT DISTINCT input FROM direct WHERE seed IN (SELECT seed FROM over)),
found AS (SELECT input, node FROM (SELECT input, seed AS node FROM direct UNION SELECT d.input, m.node FROM direct d JOIN met m ON m.seed = d.seed)
  WHERE input NOT IN (SELECT input FROM bad)),
listed AS (SELECT i.input, i.input IN (SELECT input FROM bad) AS exceeded, count(node) AS n, string_agg({d64('node')}, '' ORDER BY node) AS h
  FROM inputs i LEFT JOIN found f ON f.input = i.input GROUP BY 1)"""


@query(f"{_g2_sql()} SELECT input AS qid, node FROM found")
def g2_structural(spark: SparkSession, d: str) -> DataFrame:
    """For each input concept its instance-of targets and their ancestry; nothing for inputs beyond the guard."""
    return _g2(spark, d, _g2_inputs(spark, d))[1].withColumnRenamed("input", "qid")


def _g2_listed(spark: SparkSession, d: str, inputs: DataFrame, guard: int = fixed.VISITED_GUARD) -> DataFrame:
    """(input, exceeded, cardinality, hexed): lists are bounded, as every target's ancestry is within the guard."""
    judged, found = _g2(spark, d, inputs, guard)
    listed = traversal.ordered_list(judged.where("not exceeded").join(found, "input", "left"), "input", "node")
    return judged.join(listed, "input", "left")


def g2_results(spark: SparkSession, d: str, inputs: DataFrame, guard: int) -> DataFrame:
    """(qid, cardinality, digest, error, hexed) of each ``input``."""
    over = F.col("exceeded")
    return _g2_listed(spark, d, inputs, guard).select(
        F.col("input").alias("qid"),
        "hexed",
        F.when(~over, F.col("cardinality")).alias("cardinality"),
        F.when(~over, canon.digest(F.concat(canon.be64("cardinality"), "hexed"))).alias("digest"),
        F.when(over, F.lit(f"guard exceeded ({guard}) during G2 ancestry")).alias("error"),
    )


def _g2_summary_sql(guard: int) -> str:
    return f"""{_g2_sql(guard)} SELECT input AS qid, CASE WHEN NOT exceeded THEN n END AS cardinality,
  CASE WHEN NOT exceeded THEN sha256(unhex({d64('n')} || coalesce(h, ''))) END AS digest,
  CASE WHEN exceeded THEN 'guard exceeded ({guard}) during G2 ancestry' END AS error FROM listed"""


@query(_g2_summary_sql(fixed.VISITED_GUARD))
def g2_summary(spark: SparkSession, d: str) -> DataFrame:
    """Cardinality and digest of each input's structural set, or its error."""
    return g2_results(spark, d, _g2_inputs(spark, d), fixed.VISITED_GUARD).drop("hexed")


@query(_g2_summary_sql(12))
def g2_guarded(spark: SparkSession, d: str) -> DataFrame:
    """The same under a guard of 12, which some inputs exceed."""
    return g2_results(spark, d, _g2_inputs(spark, d), 12).drop("hexed")


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    h, n = hashlib.sha256(), 0
    for b in batches:
        for x in b.column(0).to_pylist():
            h.update(bytes.fromhex(x))
            n += 1
    yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([h.hexdigest()])], ["n", "digest"])


def stream_digest(rows: DataFrame, order: list, hexed: Column, head: Column | None = None) -> DataFrame:
    """(n, digest): the hash of the hex strings of all rows in order, after those of ``head``. The hash is sequential by
    definition, so one task takes it in constant memory; the sort before it is spread over ranges and merged by
    rank (``global_rank``), and the driver sees one row."""
    scratch = Scratch(rows.sparkSession, "stream")
    ranked = global_rank(rows.select(hexed.alias("_hex"), *(c.alias(f"_o{i}") for i, c in enumerate(order))), [f"_o{i}" for i in range(len(order))], "_rank", scratch)
    body = ranked.select("_rank", "_hex")
    if head is not None:
        first = body.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("_hex") / 2), F.lit(0)).cast("bigint").alias("bytes"))
        body = body.unionByName(first.select(F.lit(-1).cast("bigint").alias("_rank"), head.alias("_hex")))
    laid = body.repartition(1).sortWithinPartitions("_rank").select("_hex")
    out = laid.mapInArrow(_stream, "n bigint, digest string")
    return out if head is None else out.withColumn("n", F.col("n") - 1)


@query(f"""
{_g2_sql()} SELECT count(*) AS inputs, CASE WHEN bool_or(exceeded) THEN 'ERROR' ELSE 'VALID' END AS status,
  CASE WHEN NOT bool_or(exceeded) THEN sha256(unhex(string_agg({d64('input')} || {d64('n')} || coalesce(h, ''), '' ORDER BY input))) END AS digest
FROM listed""")
def g2_batch_digest(spark: SparkSession, d: str) -> DataFrame:
    """The digest of the whole batch of inputs in order; none, and ERROR, if an input has an error."""
    listed = Scratch(spark, "g2").cut(_g2_listed(spark, d, _g2_inputs(spark, d)))
    digest = stream_digest(listed, [F.col("input")], F.concat(canon.be64("input"), canon.be64(F.coalesce("cardinality", F.lit(0))), F.coalesce("hexed", F.lit(""))))
    bad = listed.agg(F.coalesce(F.bool_or("exceeded"), F.lit(False)).alias("bad"))
    return digest.withColumn("bad", bad.scalar()).select(
        F.col("n").alias("inputs"), F.when(F.col("bad"), "ERROR").otherwise("VALID").alias("status"), F.when(~F.col("bad"), F.col("digest")).alias("digest")
    )


# ---- full scans ----
def _fold_sql(name: str, row: str) -> str:
    m = "18446744073709551616"
    parts = [f"lpad(to_hex(CAST({x} AS UBIGINT)), 16, '0')" for x in (f"s % {m}::HUGEINT", "x", f"q % {m}::HUGEINT")]
    return f"""
WITH r AS (SELECT {row} AS h FROM {name}),
f AS (SELECT list_reduce(list_prepend({fixed.FNV_BASIS}::UHUGEINT,
    list_transform(range(1, length(h), 2), lambda i: CAST(CAST('0x' || substr(h, CAST(i AS INTEGER), 2) AS UTINYINT) AS UHUGEINT))),
    lambda a, b: xor(a, b) * {fixed.FNV_PRIME}::UHUGEINT % {m}::UHUGEINT) AS v FROM r),
t AS (SELECT count(*) AS n, coalesce(sum(v::HUGEINT), 0) AS s, coalesce(bit_xor(v), 0)::UHUGEINT AS x,
  coalesce(sum((((v % 4294967296) * (v % 4294967296) + (((v // 4294967296) * (v % 4294967296) * 2) % 4294967296) * 4294967296) % {m}::UHUGEINT)::HUGEINT), 0) AS q FROM f)
SELECT n AS rows, sha256(unhex({d64('n')} || {' || '.join(parts)})) AS digest FROM t"""


@query(_fold_sql("concept", DUCK_CONCEPT))
def a1_concept(spark: SparkSession, d: str) -> DataFrame:
    """Row count and order-free digest of concept."""
    return multiset_fold.fold(table(spark, d, "concept"), canon.concept_row())


@query(_fold_sql("lexical_entry", DUCK_LEXICAL))
def a1_lexical_entry(spark: SparkSession, d: str) -> DataFrame:
    """Row count and order-free digest of lexical_entry."""
    return multiset_fold.fold(table(spark, d, "lexical_entry"), canon.lexical_row())


@query(_fold_sql("instance_of", DUCK_EDGE))
def a1_instance_of(spark: SparkSession, d: str) -> DataFrame:
    """Row count and order-free digest of instance_of."""
    return multiset_fold.fold(table(spark, d, "instance_of"), canon.edge_row())


@query(_fold_sql("subclass_of", DUCK_EDGE))
def a1_subclass_of(spark: SparkSession, d: str) -> DataFrame:
    """Row count and order-free digest of subclass_of."""
    return multiset_fold.fold(table(spark, d, "subclass_of"), canon.edge_row())


@query("SELECT Lang AS lang, LexKind AS lex_kind, count(*) AS n FROM lexical_entry GROUP BY 1, 2")
def a2_lang_kind(spark: SparkSession, d: str) -> DataFrame:
    """Lexical rows by language and kind."""
    return _lang_kind(table(spark, d, "lexical_entry"))


def _lang_kind(lexical: DataFrame) -> DataFrame:
    return lexical.groupBy(F.col("Lang").alias("lang"), F.col("LexKind").alias("lex_kind")).agg(F.count("*").alias("n"))


def _fanout(df: DataFrame) -> DataFrame:
    return df.groupBy(F.col("TargetQid").alias("target")).agg(F.count("*").alias("fanout"))


@query("SELECT TargetQid AS target, count(*) AS fanout FROM instance_of GROUP BY 1")
def a3_p31_fanout(spark: SparkSession, d: str) -> DataFrame:
    """Links per instance-of target."""
    return _fanout(table(spark, d, "instance_of"))


@query("SELECT TargetQid AS target, count(*) AS fanout FROM subclass_of GROUP BY 1")
def a4_p279_fanout(spark: SparkSession, d: str) -> DataFrame:
    """Links per subclass-of target."""
    return _fanout(table(spark, d, "subclass_of"))


_A5 = """
SELECT f.target, f.fanout, l.en_label, l.nb_label
FROM (SELECT TargetQid AS target, count(*) AS fanout FROM instance_of GROUP BY 1) f
LEFT JOIN (SELECT Qid, min(Value) FILTER (WHERE Lang = 'en') AS en_label, min(Value) FILTER (WHERE Lang = 'nb') AS nb_label
  FROM lexical_entry WHERE LexKind = 'label' AND Lang IN ('en', 'nb') GROUP BY 1) l ON l.Qid = f.target"""


@query(_A5)
def a5_p31_labels(spark: SparkSession, d: str) -> DataFrame:
    """Links per instance-of target with its English and Norwegian label, null where there is none."""
    return _labelled(table(spark, d, "instance_of"), table(spark, d, "lexical_entry"))


def _labelled(instance: DataFrame, lexical: DataFrame) -> DataFrame:
    labels = (
        lexical.where("LexKind = 'label' and Lang in ('en', 'nb')").groupBy(F.col("Qid").alias("target"))
        .agg(F.min(F.when(F.col("Lang") == "en", F.col("Value"))).alias("en_label"), F.min(F.when(F.col("Lang") == "nb", F.col("Value"))).alias("nb_label"))
    )
    return _fanout(instance).join(labels, "target", "left")


def _dmaybe(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '00' ELSE '01' || {dtext(x)} END"


def _sorted_sql(op: str, row: str, order: str, source: str) -> str:
    return f"SELECT '{op}' AS op, count(*) AS cardinality, {dsized('count(*)', f'''string_agg({row}, '' ORDER BY {order})''')} AS digest FROM ({source})"


_ANALYTICAL = "\nUNION ALL\n".join([
    _sorted_sql("A2", f"{dtext('lang')} || {dtext('lex_kind')} || {d64('n')}", "lang, lex_kind", SQL["a2_lang_kind"]),
    _sorted_sql("A3", f"{d64('target')} || {d64('fanout')}", "target", SQL["a3_p31_fanout"]),
    _sorted_sql("A4", f"{d64('target')} || {d64('fanout')}", "target", SQL["a4_p279_fanout"]),
    _sorted_sql("A5", f"{d64('target')} || {d64('fanout')} || {_dmaybe('en_label')} || {_dmaybe('nb_label')}", "target", _A5),
])


def aggregates(tables: dict[str, DataFrame]) -> DataFrame:
    """(op, cardinality, digest) of A2 to A5 over the four relations."""
    edge = F.concat(canon.be64("target"), canon.be64("fanout"))
    parts = {
        "A2": (_lang_kind(tables["lexical_entry"]), [canon.ordinal("lang"), canon.ordinal("lex_kind")], F.concat(canon.text("lang"), canon.text("lex_kind"), canon.be64("n"))),
        "A3": (_fanout(tables["instance_of"]), [F.col("target")], edge),
        "A4": (_fanout(tables["subclass_of"]), [F.col("target")], edge),
        "A5": (_labelled(tables["instance_of"], tables["lexical_entry"]), [F.col("target")], F.concat(edge, canon.maybe_text("en_label"), canon.maybe_text("nb_label"))),
    }
    head = F.concat(canon.be64("n"), canon.be32("bytes"))
    out = [
        stream_digest(df, order, row, head).select(F.lit(op).alias("op"), F.col("n").alias("cardinality"), "digest")
        for op, (df, order, row) in parts.items()
    ]
    return reduce(DataFrame.unionByName, out)


@query(_ANALYTICAL)
def analytical_digests(spark: SparkSession, d: str) -> DataFrame:
    """The digest of each aggregate in its order."""
    return aggregates(relations(spark, d))


@query(_verdict_sql(_of_candidate(_ANALYTICAL), _ANALYTICAL, "op"))
def analytical_check(spark: SparkSession, d: str) -> DataFrame:
    """The aggregates of the second system against the expected ones."""
    return verdicts(aggregates(candidate(spark, d)), aggregates(relations(spark, d)), ["op"])

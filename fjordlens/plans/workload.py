"""Queries that choose deterministic probes: pools, hash-ranked samples, misses, plans and guarded selections.

All of it follows a workload contract: strata and their counts, fanout ranges, guard, depth, hash domains and the language of
misses. The queries are registered under the full contract and, with the prefix ``small_``, under a smaller one whose
counts and guard the test tables exercise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fjordlens.functions import canon, fixed
from fjordlens.operators import hierarchy, tiers, traversal
from fjordlens.plans.corpus import PROFILED
from fjordlens.plans.runtime import Scratch, global_rank
from fjordlens.sources import contracts
from fjordlens.sources.contracts import Contract
from fjordlens.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
SERVING = ("S1", "S2", "S3", "S4", "S5")
MADE = ("S1/Absent", "S2/Miss")


def degrees(spark: SparkSession, d: str) -> DataFrame:
    """Each concept with its tiers, presence and degrees (p279 null without links)."""
    rows = tiers.profiled(table(spark, d, "concept"), table(spark, d, "lexical_entry"))
    return (
        rows.join(tiers.out_degree(table(spark, d, "instance_of"), "p31"), "qid", "left")
        .join(tiers.out_degree(table(spark, d, "subclass_of"), "p279"), "qid", "left")
        .withColumn("p31", F.coalesce("p31", F.lit(0)))
    )


def high_degree(deg: DataFrame, domain: str) -> DataFrame:
    """The 500 T1 concepts with the most links: by degree, then hash, then id (a top-k report)."""
    h = canon.rank_hash("S4", "HighDegree", F.col("qid").cast("string"), domain)
    return deg.where("in_t1 and p31 >= 1").withColumn("h", h).orderBy(F.desc("p31"), "h", "qid").limit(fixed.HIGH_DEGREE)


def pools(spark: SparkSession, d: str, c: Contract) -> DataFrame:
    """(qid, pool): every pool a concept belongs to."""
    deg = degrees(spark, d)
    deg = deg.join(F.broadcast(high_degree(deg, c.selection_domain).select("qid", F.lit(True).alias("high"))), "qid", "left")  # 500 rows
    t1, t2, tail, lex = (F.col(c) for c in ("in_t1", "in_t2", "tail", "has_lexical"))
    high = F.coalesce("high", F.lit(False))
    p31, p279 = F.col("p31"), F.col("p279")
    rules = {
        "S1/T1Only": t1 & ~t2, "S1/T2Only": ~t1 & t2 & ~tail, "S1/T1IntersectT2": t1 & t2,
        "S3/T1WithLexical": t1 & lex, "S3/T2OnlyWithLexical": ~t1 & t2 & ~tail & lex, "S3/ConceptNoLexical": ~lex & ~tail,
        "S4/Degree0": t1 & (p31 == 0), "S4/Degree1": t1 & (p31 == 1), "S4/Degree2Plus": t1 & (p31 >= 2) & ~high, "S4/HighDegree": high,
        "S5/Degree0": p279.isNull(), "S5/Degree1": p279 == 1, "S5/Degree2Plus": p279 >= 2,
        "G1/Degree1": p279 == 1, "G1/Degree2Plus": p279 >= 2,
        "G2/P31Degree1": t1 & (p31 == 1), "G2/P31Degree2Plus": t1 & (p31 >= 2),
    }
    named = F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())))
    return deg.select("qid", F.explode(named).alias("pool"))


def ranges(c: Contract) -> list[tuple[str, int]]:
    """(pool, least fanout) of the contract's S2 ranges, from the highest: they are one partition, so the least is enough."""
    return sorted(((f"S2/{s.stratum}", s.fanout[0]) for s in c.strata if s.operation == "S2" and s.fanout), key=lambda x: -x[1])


def lexical_pools(spark: SparkSession, d: str, c: Contract) -> DataFrame:
    """(lang, value, pool) of each (language, text) key by its number of rows."""
    n = table(spark, d, "lexical_entry").groupBy(F.col("Lang").alias("lang"), F.col("Value").alias("value")).agg(F.count("*").alias("n"))
    pool = F.coalesce(*(F.when(F.col("n") >= low, F.lit(name)) for name, low in ranges(c)))
    return n.select("lang", "value", pool.alias("pool"))


def tails(spark: SparkSession, d: str) -> DataFrame:
    return tiers.profiled(table(spark, d, "concept"), table(spark, d, "lexical_entry")).where("tail").select("qid")


def pool_sizes(spark: SparkSession, d: str, c: Contract) -> DataFrame:
    """(pool, n): members of each pool that has any, the tail among them."""
    named = tails(spark, d).select(F.lit("S1/Tail").alias("pool"))
    every = pools(spark, d, c).select("pool").unionByName(lexical_pools(spark, d, c).select("pool")).unionByName(named)
    return every.groupBy("pool").agg(F.count("*").alias("n"))


def gated(c: Contract) -> list[tuple[str, str, int]]:
    return [(f"{s.operation}/{s.stratum}", s.mode, s.count) for s in c.strata + c.tail if s.mode != "generated-miss"] + [
        (f"G2/{name}", "sha256-ranked-sample", n) for name, n in c.g2
    ]


def gates(spark: SparkSession, d: str, c: Contract) -> DataFrame:
    """(pool, mode, needed, have, verdict): whether each pool has the contract's count, and those that are taken whole
    exactly the expected one."""
    names = spark.createDataFrame(gated(c), "pool string, mode string, needed int")
    have = F.coalesce("n", F.lit(0))
    go = F.when(F.col("mode") == "all-eligible", have == F.col("needed")).otherwise(have >= F.col("needed"))
    return names.join(pool_sizes(spark, d, c), "pool", "left").select("pool", "mode", "needed", have.alias("have"), F.when(go, "GO").otherwise("HOLD").alias("verdict"))


def ranked(rows: DataFrame, identity: Column, tie: list[Column], needs: dict[str, int | None], domain: str) -> DataFrame:
    """The first ones of each pool of ``needs`` by hash, as many as it says, all where it says None. Each task keeps its own
    first ones before the shuffle (window group limit)."""
    parts = F.split("pool", "/")
    out = []
    counts = {p: n for p, n in needs.items() if n}
    whole = [p for p, n in needs.items() if n is None]
    for wanted, most in ((list(counts), max(counts.values(), default=0)), (whole, None)):
        if not wanted:
            continue
        hashed = rows.where(F.col("pool").isin(wanted)).withColumn("h", canon.rank_hash(parts[0], parts[1], identity, domain))
        first = hashed.withColumn("rank", F.row_number().over(Window.partitionBy("pool").orderBy("h", *tie)))
        if most:
            limit = F.create_map(*(F.lit(x) for pair in counts.items() for x in pair))
            first = first.where(F.col("rank") <= most).where(F.col("rank") <= limit[F.col("pool")])
        out.append(first)
    return reduce(DataFrame.unionByName, out) if out else rows.limit(0).withColumns({"h": F.lit(""), "rank": F.lit(1)})


def samples(spark: SparkSession, d: str, c: Contract) -> DataFrame:
    """(pool, rank, qid) of every sampled pool of concepts."""
    needs = {p: n for p, n in c.needs("S1", "S3", "S4", "S5").items() if p not in MADE}
    return ranked(pools(spark, d, c), F.col("qid").cast("string"), [F.col("qid")], needs, c.selection_domain).select("pool", "rank", "qid")


def lexical_samples(spark: SparkSession, d: str, c: Contract) -> DataFrame:
    """(pool, rank, lang, value) of every pool of (language, text) keys."""
    needs = {p: n for p, n in c.needs("S2").items() if p not in MADE}
    out = ranked(lexical_pools(spark, d, c), canon.lexical_identity("lang", "value"), [canon.ordinal("lang"), canon.ordinal("value")], needs, c.selection_domain)
    return out.select("pool", "rank", "lang", "value")


def _made(spark: SparkSession, n: int, domain: str, pool: str, keep) -> DataFrame:
    """The first ``n`` by counter of what ``keep`` leaves of generated candidates. More are generated until there are enough."""
    op, stratum = pool.split("/")
    most = n + 64
    while True:
        made = spark.range(most).select(F.col("id").alias("counter"), canon.rank_hash(op, stratum, F.col("id").cast("string"), domain).alias("h"))
        kept = keep(made).orderBy("counter").limit(n)
        if n == 0 or kept.count() == n:
            return kept
        most *= 2


def concept_misses(spark: SparkSession, d: str, c: Contract) -> DataFrame:
    """(rank, qid): generated concept ids that are proven absent."""
    known = table(spark, d, "concept").select(F.col("Qid").alias("qid"))

    def keep(made: DataFrame) -> DataFrame:
        high, low = (F.conv(F.substring("h", i, 8), 16, 10).cast("bigint") for i in (1, 9))
        ids = made.withColumn("qid", F.shiftleft(high.bitwiseAND(F.lit(0x7FFFFFFF)), 32).bitwiseOR(low))
        absent = ids.where("qid > 0").join(known, "qid", "left_anti")
        return absent.groupBy("qid").agg(F.min("counter").alias("counter"), F.min_by("h", "counter").alias("h"))

    first = _made(spark, c.needs("S1")["S1/Absent"], c.concept_miss_domain, "S1/Absent", keep)
    return first.select(F.row_number().over(Window.orderBy("h", "qid")).alias("rank"), "qid")  # of the contract's count


def lexical_misses(spark: SparkSession, d: str, c: Contract) -> DataFrame:
    """(rank, lang, value): generated (language, text) keys that are proven absent."""
    known = table(spark, d, "lexical_entry").where(F.col("Lang") == c.miss_language).select(F.col("Value").alias("value"))

    def keep(made: DataFrame) -> DataFrame:
        return made.withColumn("value", F.concat(F.lit(fixed.MISS_PREFIX), F.substring("h", 1, 24))).join(known, "value", "left_anti")

    first = _made(spark, c.needs("S2")["S2/Miss"], c.lexical_miss_domain, "S2/Miss", keep)
    rank = F.row_number().over(Window.orderBy("h", "value"))  # of the contract's count
    return first.select(rank.alias("rank"), F.lit(c.miss_language).alias("lang"), "value")


def places(c: Contract) -> list[tuple[str, int, int]]:
    """(pool, place of the operation, place of the stratum in it)."""
    out = []
    for i, op in enumerate(SERVING):
        out += [(f"{op}/{s.stratum}", i, j) for j, s in enumerate(s for s in c.strata if s.operation == op)]
    return out


def plan(spark: SparkSession, d: str, c: Contract) -> DataFrame:
    """(seq, op, stratum, qid, lang, value, measured): the probes of all lookups in their sequence, strata of an operation
    taking turns by rank; after them every tail concept by id, unmeasured. A pool that is too small gives what it has (see
    ``gates``). Pools that are taken whole and tails grow with the data, so both are numbered by ranges."""
    scratch = Scratch(spark, "plan")
    none = F.lit(None).cast("string")
    chosen = [
        samples(spark, d, c).select("pool", "rank", "qid", none.alias("lang"), none.alias("value")),
        lexical_samples(spark, d, c).select("pool", "rank", none.cast("bigint").alias("qid"), "lang", "value"),
        concept_misses(spark, d, c).select(F.lit("S1/Absent").alias("pool"), "rank", "qid", none.alias("lang"), none.alias("value")),
        lexical_misses(spark, d, c).select(F.lit("S2/Miss").alias("pool"), "rank", none.cast("bigint").alias("qid"), "lang", "value"),
    ]
    place = spark.createDataFrame(places(c), "pool string, at int, stratum_at int")
    rows = reduce(DataFrame.unionByName, chosen).join(F.broadcast(place), "pool")  # one row per stratum
    parts = F.split("pool", "/")
    laid = scratch.cut(global_rank(rows, ["at", "rank", "stratum_at"], "seq", scratch).select("seq", parts[0].alias("op"), parts[1].alias("stratum"), "qid", "lang", "value"))
    tail = global_rank(tails(spark, d), ["qid"], "i", scratch).select(
        (F.col("i") + laid.count()).alias("seq"), F.lit("S1").alias("op"), F.lit("Tail").alias("stratum"), "qid", none.alias("lang"), none.alias("value"),
        F.lit(False).alias("measured"),
    )
    return laid.withColumn("measured", F.lit(True)).unionByName(tail)


def g1_starts(spark: SparkSession, d: str, c: Contract) -> DataFrame:
    """(stratum, rank, qid, visited): the first starts of each stratum by hash whose ancestry stays within the guard."""
    cand = pools(spark, d, c).where("pool like 'G1/%'")
    met = traversal.ancestry(cand.select(F.col("qid").alias("seed")), hierarchy.links(table(spark, d, "subclass_of"), "SubjectQid", "TargetQid"), c.max_depth)
    n = met.groupBy(F.col("seed").alias("qid")).agg((F.count("*") + 1).alias("n"))
    fit = cand.join(n, "qid", "left").withColumn("visited", F.coalesce("n", F.lit(1))).where(F.col("visited") <= c.guard)
    out = ranked(fit.select("pool", "qid", "visited"), F.col("qid").cast("string"), [F.col("qid")], c.needs("G1"), c.selection_domain)
    return out.select(F.split("pool", "/")[1].alias("stratum"), "rank", "qid", "visited")


def g2_inputs(spark: SparkSession, d: str, c: Contract) -> DataFrame:
    """(stratum, rank, qid, max_visited): the first concepts of each stratum by hash none of whose targets has an ancestry
    beyond the guard."""
    cand = pools(spark, d, c).where("pool like 'G2/%'")
    direct = table(spark, d, "instance_of").select(F.col("SubjectQid").alias("qid"), F.col("TargetQid").alias("seed")).distinct()
    direct = direct.join(cand.select("qid").distinct(), "qid", "left_semi")
    met = traversal.ancestry(direct.select("seed"), hierarchy.links(table(spark, d, "subclass_of"), "SubjectQid", "TargetQid"), c.max_depth)
    n = met.groupBy("seed").agg((F.count("*") + 1).alias("n"))
    most = direct.join(n, "seed", "left").groupBy("qid").agg(F.max(F.coalesce("n", F.lit(1))).alias("max_visited"))
    fit = cand.join(most, "qid").where(F.col("max_visited") <= c.guard)
    needs = {f"G2/{name}": n for name, n in c.g2}
    out = ranked(fit.select("pool", "qid", "max_visited"), F.col("qid").cast("string"), [F.col("qid")], needs, c.selection_domain)
    return out.select(F.split("pool", "/")[1].alias("stratum"), "rank", "qid", "max_visited")


def interleaved(spark: SparkSession, d: str, c: Contract) -> DataFrame:
    """(place, stratum, qid): the order in which the strata of one lookup take turns."""
    place = F.row_number().over(Window.partitionBy("op").orderBy("seq")) - 1  # of the contract's count
    return plan(spark, d, c).where("op = 'S5'").select(place.alias("place"), "stratum", "qid")


def top_degrees(spark: SparkSession, d: str, c: Contract) -> DataFrame:
    """(rank, qid, degree): the 500 concepts with the most instance-of links."""
    top = high_degree(degrees(spark, d), c.selection_domain)
    rank = F.row_number().over(Window.orderBy(F.desc("p31"), "h", "qid"))  # of 500 rows
    return top.select(rank.alias("rank"), "qid", F.col("p31").alias("degree"))


# ---- the same in SQL ----
def _hash_sql(op: str, stratum: str, identity: str, domain: str) -> str:
    return f"sha256('{domain}' || chr(31) || {op} || chr(31) || {stratum} || chr(31) || {identity})"


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("CAST(NULL AS BIGINT)" if x is None else f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


class Statements:
    """The SQL of every query under one contract."""

    def __init__(self, c: Contract):
        dom = c.selection_domain
        own = _hash_sql("split_part(pool, '/', 1)", "split_part(pool, '/', 2)", "CAST(qid AS VARCHAR)", dom)
        key = "to_base64(unhex(lpad(hex(CAST(strlen(lang) AS BIGINT)), 8, '0') || hex(lang) || lpad(hex(CAST(strlen(value) AS BIGINT)), 8, '0') || hex(value)))"
        bins = " ".join(f"WHEN n >= {low} THEN '{name}'" for name, low in ranges(c))
        deg = f"""
{PROFILED},
deg AS (SELECT p.*, coalesce(i.n, 0) AS p31, s.n AS p279 FROM profiled p
  LEFT JOIN (SELECT SubjectQid, count(*) AS n FROM instance_of GROUP BY 1) i ON i.SubjectQid = p.qid
  LEFT JOIN (SELECT SubjectQid, count(*) AS n FROM subclass_of GROUP BY 1) s ON s.SubjectQid = p.qid),
high AS (SELECT qid, p31 AS degree, row_number() OVER (ORDER BY p31 DESC, {_hash_sql("'S4'", "'HighDegree'", 'CAST(qid AS VARCHAR)', dom)}, qid) AS rank
  FROM deg WHERE in_t1 AND p31 >= 1),
pools AS (
  SELECT qid, unnest(list_filter([
    CASE WHEN in_t1 AND NOT in_t2 THEN 'S1/T1Only' END, CASE WHEN NOT in_t1 AND in_t2 AND NOT tail THEN 'S1/T2Only' END,
    CASE WHEN in_t1 AND in_t2 THEN 'S1/T1IntersectT2' END, CASE WHEN in_t1 AND has_lexical THEN 'S3/T1WithLexical' END,
    CASE WHEN NOT in_t1 AND in_t2 AND NOT tail AND has_lexical THEN 'S3/T2OnlyWithLexical' END,
    CASE WHEN NOT has_lexical AND NOT tail THEN 'S3/ConceptNoLexical' END,
    CASE WHEN in_t1 AND p31 = 0 THEN 'S4/Degree0' END, CASE WHEN in_t1 AND p31 = 1 THEN 'S4/Degree1' END,
    CASE WHEN in_t1 AND p31 >= 2 AND qid NOT IN (SELECT qid FROM high WHERE rank <= {fixed.HIGH_DEGREE}) THEN 'S4/Degree2Plus' END,
    CASE WHEN qid IN (SELECT qid FROM high WHERE rank <= {fixed.HIGH_DEGREE}) THEN 'S4/HighDegree' END,
    CASE WHEN p279 IS NULL THEN 'S5/Degree0' END, CASE WHEN p279 = 1 THEN 'S5/Degree1' END, CASE WHEN p279 >= 2 THEN 'S5/Degree2Plus' END,
    CASE WHEN p279 = 1 THEN 'G1/Degree1' END, CASE WHEN p279 >= 2 THEN 'G1/Degree2Plus' END,
    CASE WHEN in_t1 AND p31 = 1 THEN 'G2/P31Degree1' END, CASE WHEN in_t1 AND p31 >= 2 THEN 'G2/P31Degree2Plus' END],
    lambda x: x IS NOT NULL)) AS pool FROM deg),
lex_pools AS (
  SELECT Lang AS lang, Value AS value, CASE {bins} END AS pool FROM (SELECT Lang, Value, count(*) AS n FROM lexical_entry GROUP BY 1, 2))"""
        rank = f"""
need(pool, n) AS (VALUES {_values([(p, n) for p, n in c.needs(*SERVING).items() if p not in MADE])}),
r AS (SELECT pool, qid, row_number() OVER (PARTITION BY pool ORDER BY {own}, qid) AS rank FROM pools),
lr AS (SELECT pool, lang, value, row_number() OVER (PARTITION BY pool ORDER BY
  {_hash_sql("split_part(pool, '/', 1)", "split_part(pool, '/', 2)", key, dom)}, lang, value) AS rank FROM lex_pools)"""
        self.sizes = f"""WITH {deg} SELECT pool, count(*) AS n FROM (SELECT pool FROM pools UNION ALL SELECT pool FROM lex_pools
  UNION ALL SELECT 'S1/Tail' FROM profiled WHERE tail) GROUP BY 1"""
        self.gates = f"""
SELECT g.pool, g.mode, g.needed, coalesce(s.n, 0) AS have,
  CASE WHEN g.mode = 'all-eligible' AND coalesce(s.n, 0) = g.needed OR g.mode <> 'all-eligible' AND coalesce(s.n, 0) >= g.needed THEN 'GO' ELSE 'HOLD' END AS verdict
FROM (VALUES {_values(gated(c))}) g(pool, mode, needed) LEFT JOIN ({self.sizes}) s ON s.pool = g.pool"""
        self.samples = f"WITH {deg}, {rank} SELECT r.pool, rank, qid FROM r JOIN need ON need.pool = r.pool WHERE n IS NULL OR rank <= n"
        self.lexical_samples = f"WITH {deg}, {rank} SELECT lr.pool, rank, lang, value FROM lr JOIN need ON need.pool = lr.pool WHERE n IS NULL OR rank <= n"
        self.high = f"WITH {deg} SELECT rank, qid, degree FROM high WHERE rank <= {fixed.HIGH_DEGREE}"
        # twice what is asked for and a thousand: that so many of them exist already has no chance worth a number
        n, m = c.needs("S1")["S1/Absent"], c.needs("S2")["S2/Miss"]
        self.concept_misses = f"""
WITH g AS (SELECT range AS counter, {_hash_sql("'S1'", "'Absent'", 'CAST(range AS VARCHAR)', c.concept_miss_domain)} AS h FROM range({2 * n + 1000})),
c AS (SELECT counter, h, CAST(('0x' || substr(h, 1, 16))::UBIGINT & 9223372036854775807::UBIGINT AS BIGINT) AS qid FROM g),
a AS (SELECT qid, min(counter) AS counter, min_by(h, counter) AS h FROM c WHERE qid > 0 AND qid NOT IN (SELECT Qid FROM concept) GROUP BY 1),
f AS (SELECT * FROM a ORDER BY counter LIMIT {n})
SELECT row_number() OVER (ORDER BY h, qid) AS rank, qid FROM f"""
        self.lexical_misses = f"""
WITH g AS (SELECT range AS counter, {_hash_sql("'S2'", "'Miss'", 'CAST(range AS VARCHAR)', c.lexical_miss_domain)} AS h FROM range({2 * m + 1000})),
c AS (SELECT counter, h, '{c.miss_language}' AS lang, '{fixed.MISS_PREFIX}' || substr(h, 1, 24) AS value FROM g),
a AS (SELECT c.* FROM c WHERE NOT EXISTS (SELECT 1 FROM lexical_entry l WHERE l.Lang = c.lang AND l.Value = c.value)),
f AS (SELECT * FROM a ORDER BY counter LIMIT {m})
SELECT row_number() OVER (ORDER BY h, value) AS rank, lang, value FROM f"""
        measured = f"""
WITH chosen AS (
  SELECT pool, rank, qid, CAST(NULL AS VARCHAR) AS lang, CAST(NULL AS VARCHAR) AS value FROM ({self.samples})
  UNION ALL SELECT pool, rank, NULL, lang, value FROM ({self.lexical_samples})
  UNION ALL SELECT 'S1/Absent', rank, qid, NULL, NULL FROM ({self.concept_misses})
  UNION ALL SELECT 'S2/Miss', rank, NULL, lang, value FROM ({self.lexical_misses})),
place(pool, op, stratum) AS (VALUES {_values(places(c))})
SELECT row_number() OVER (ORDER BY p.op, c.rank, p.stratum) - 1 AS seq, split_part(c.pool, '/', 1) AS op, split_part(c.pool, '/', 2) AS stratum,
  c.qid, c.lang, c.value FROM chosen c JOIN place p ON p.pool = c.pool"""
        self.plan = f"""
WITH {PROFILED}, plan AS ({measured}), tails AS (SELECT qid, row_number() OVER (ORDER BY qid) - 1 AS i FROM profiled WHERE tail)
SELECT seq, op, stratum, qid, lang, value, true AS measured FROM plan
UNION ALL SELECT (SELECT count(*) FROM plan) + i, 'S1', 'Tail', qid, NULL, NULL, false FROM tails"""
        self.interleaved = f"SELECT row_number() OVER (ORDER BY seq) - 1 AS place, stratum, qid FROM ({measured}) WHERE op = 'S5'"
        cand = f"WITH RECURSIVE {deg},\ncand AS (SELECT pool, qid, {own} AS h FROM pools)"

        def visited(seeds: str) -> str:
            return f"""
e AS (SELECT DISTINCT SubjectQid AS node, TargetQid AS parent FROM subclass_of),
walk(seed, node, k) AS (SELECT seed, seed, 0 FROM ({seeds}) UNION SELECT w.seed, e.parent, w.k + 1 FROM walk w JOIN e ON e.node = w.node WHERE w.k < {c.max_depth}),
visited AS (SELECT seed, count(DISTINCT node) AS n FROM walk GROUP BY 1)"""

        self.g1 = f"""
{cand}, {visited("SELECT DISTINCT qid AS seed FROM cand WHERE pool LIKE 'G1/%'")}, need(pool, most) AS (VALUES {_values(list(c.needs("G1").items()))}),
ok AS (SELECT c.*, v.n, row_number() OVER (PARTITION BY pool ORDER BY h, qid) AS rank FROM cand c JOIN visited v ON v.seed = c.qid
  WHERE pool LIKE 'G1/%' AND v.n <= {c.guard})
SELECT split_part(ok.pool, '/', 2) AS stratum, rank, qid, n AS visited FROM ok JOIN need ON need.pool = ok.pool WHERE rank <= most"""
        self.g2 = f"""
{cand}, need(pool, most) AS (VALUES {_values([(f"G2/{name}", k) for name, k in c.g2])}),
direct AS (SELECT DISTINCT SubjectQid AS qid, TargetQid AS target FROM instance_of WHERE SubjectQid IN (SELECT qid FROM cand WHERE pool LIKE 'G2/%')),
{visited("SELECT DISTINCT target AS seed FROM direct")},
most AS (SELECT d.qid, max(v.n) AS n FROM direct d JOIN visited v ON v.seed = d.target GROUP BY 1),
ok AS (SELECT c.*, m.n, row_number() OVER (PARTITION BY pool ORDER BY h, c.qid) AS rank FROM cand c JOIN most m ON m.qid = c.qid
  WHERE pool LIKE 'G2/%' AND m.n <= {c.guard})
SELECT split_part(ok.pool, '/', 2) AS stratum, rank, qid, n AS max_visited FROM ok JOIN need ON need.pool = ok.pool WHERE rank <= most"""


CONTRACTS = {"": contracts.workload(), "small_": contracts.workload("workload_contract_small.json")}
_NAMED = {
    "census_gates": (gates, "gates"), "rank_sample": (samples, "samples"), "rank_sample_lexical": (lexical_samples, "lexical_samples"),
    "concept_misses": (concept_misses, "concept_misses"), "lexical_misses": (lexical_misses, "lexical_misses"), "serving_plan": (plan, "plan"),
    "g1_selection": (g1_starts, "g1"), "g2_batch_selection": (g2_inputs, "g2"),
}


def _bound(f, c: Contract):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return f(spark, d, c)

    run.__doc__ = f.__doc__
    return run


for _prefix, _contract in CONTRACTS.items():
    _sql = Statements(_contract)
    _named = _NAMED if _prefix else _NAMED | {"pool_cardinalities": (pool_sizes, "sizes"), "s4_high_degree": (top_degrees, "high"), "probe_interleave": (interleaved, "interleaved")}
    for _name, (_f, _attribute) in _named.items():
        QUERIES[_prefix + _name] = _bound(_f, _contract)
        SQL[_prefix + _name] = getattr(_sql, _attribute)

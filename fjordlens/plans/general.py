"""Queries of the general data problems (1, 4 and 5) over the relations, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fjordlens.operators import hierarchy, hot_keys, set_reconcile
from fjordlens.plans.runtime import Scratch
from fjordlens.sources.tables import table

COPY_FIELDS = ["Qid", "InT1", "InT2", "Lang", "LexKind", "Value", "SubjectQid", "TargetQid"]
SQL: dict[str, str] = {}


def _links(spark: SparkSession, d: str) -> tuple[DataFrame, Scratch]:
    scratch = Scratch(spark, "p1")
    return scratch.cut(hierarchy.links(table(spark, d, "subclass_of"), "SubjectQid", "TargetQid")), scratch


def _world(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, Scratch]:
    edges, scratch = _links(spark, d)
    return edges, scratch.cut(hierarchy.ancestor_pairs(edges, scratch)), scratch


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Each concept and each closed set of upward links it lies in or reaches."""
    return hierarchy.reached_cycles(*_links(spark, d))


def p1_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Depth, root, numbers of roots, ancestors and descendants of each concept."""
    edges, pairs, scratch = _world(spark, d)
    return hierarchy.node_summary(edges, pairs, scratch)


def p1_paths(spark: SparkSession, d: str) -> DataFrame:
    """One shortest path from each root to each concept below it."""
    edges, pairs, scratch = _world(spark, d)
    return hierarchy.root_paths(edges, pairs, scratch)


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every concept with each of its descendants and the fewest links between them."""
    _, pairs, _ = _world(spark, d)
    return pairs.where(F.col("node") != F.col("ancestor")).select(
        F.col("ancestor").alias("qid"), F.col("node").alias("descendant"), F.col("steps").cast("bigint").alias("steps")
    )


def copies(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The three relations in the layout of their copy, and the copy."""
    copy = table(spark, d, "candidate_row")
    kinds = dict(copy.dtypes)

    def lay(name: str, key: str) -> DataFrame:
        df = table(spark, d, name)
        return df.select(
            F.lit(name).alias("Relation"),
            F.col(key).alias("RowId"),
            *((F.col(c) if c in df.columns else F.lit(None).cast(kinds[c])).alias(c) for c in COPY_FIELDS),
        )

    main = lay("concept", "Qid").unionByName(lay("lexical_entry", "RowId")).unionByName(lay("instance_of", "RowId"))
    return main, copy.select("Relation", "RowId", *COPY_FIELDS)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows that lack their copy or original, and the fields in which copies differ."""
    main, copy = copies(spark, d)
    out = set_reconcile.differences(main, copy, "Relation", "RowId", COPY_FIELDS, Scratch(spark, "p4"))
    return out.select(F.col("Relation").alias("relation"), F.col("RowId").alias("row_id"), "difference")


def p4_summary(spark: SparkSession, d: str) -> DataFrame:
    """How many differences of each kind each relation has."""
    return p4_found(spark, d).groupBy("relation", "difference").agg(F.count("*").alias("n"))


def _weighted(spark: SparkSession, d: str) -> tuple[DataFrame, dict[str, int]]:
    both, totals = None, {}
    for name in ("instance_of", "subclass_of"):
        df = table(spark, d, name)
        totals[name] = df.count()
        part = df.select(F.lit(name).alias("relation"), "TargetQid", "SubjectQid")
        both = part if both is None else both.unionByName(part)
    return hot_keys.compress(both, ["relation", "TargetQid"], "SubjectQid"), totals


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Targets that hold at least one hundredth of their table's rows."""
    weighted, totals = _weighted(spark, d)
    stats = hot_keys.key_stats(weighted, ["relation", "TargetQid"])
    least = F.lit(None)
    for name, n in totals.items():
        least = F.when(F.col("relation") == name, F.lit(n)).otherwise(least)
    return stats.where(F.col("rows") * 100 >= least).select("relation", F.col("TargetQid").alias("target_qid"))


def p5_targets(spark: SparkSession, d: str) -> DataFrame:
    """Per target: links, distinct subjects, the most repeated subject and exact quartiles of the subjects."""
    weighted, _ = _weighted(spark, d)
    scratch = Scratch(spark, "p5")
    weighted = scratch.cut(weighted)
    keys = ["relation", "TargetQid"]
    stats = hot_keys.key_stats(weighted, keys)
    return (
        stats.join(hot_keys.key_percentiles(weighted, keys, (0.25, 0.5, 0.75), scratch).drop("n"), keys)
        .withColumnsRenamed({"TargetQid": "target_qid", "rows": "links", "distinct_values": "subjects", "mode": "top_subject", "mode_rows": "top_links"})
    )


_PAIRS = """
WITH RECURSIVE e AS (
  SELECT DISTINCT SubjectQid AS node, TargetQid AS parent FROM subclass_of
  WHERE SubjectQid IS NOT NULL AND TargetQid IS NOT NULL),
walk(node, ancestor) AS (
  SELECT node, parent FROM e
  UNION
  SELECT w.node, e.parent FROM walk w JOIN e ON w.ancestor = e.node),
looped AS (SELECT node FROM walk WHERE node = ancestor),
cyc AS (
  SELECT a.node, min(a.ancestor) AS cycle FROM walk a JOIN walk b ON a.node = b.ancestor AND a.ancestor = b.node
  GROUP BY a.node)"""
# Shortest distances by keyed recursion: a pair that is known is not made again, so there is no bound on depth.
SQL["p1_found"] = (
    _PAIRS
    + """,
dist(node, cycle, steps) USING KEY (node, cycle) AS (
  SELECT node, cycle, 0 FROM cyc
  UNION
  SELECT e.node, d.cycle, min(d.steps) + 1 FROM dist d JOIN e ON e.parent = d.node
    LEFT JOIN recurring.dist k ON k.node = e.node AND k.cycle = d.cycle WHERE k.node IS NULL GROUP BY 1, 2)
SELECT node AS qid, cycle AS cycle_qid, CAST(steps AS BIGINT) AS steps FROM dist"""
)
_ROOTED = """,
nodes AS (SELECT node FROM e UNION SELECT parent FROM e),
roots AS (SELECT node FROM nodes WHERE node NOT IN (SELECT node FROM e)),
near(node, root, steps) USING KEY (node, root) AS (
  SELECT node, node, 0 FROM roots
  UNION
  SELECT e.node, d.root, min(d.steps) + 1 FROM near d JOIN e ON e.parent = d.node
    LEFT JOIN recurring.near k ON k.node = e.node AND k.root = d.root WHERE k.node IS NULL GROUP BY 1, 2)"""
SQL["p1_nodes"] = (
    _PAIRS
    + _ROOTED
    + """,
up AS (SELECT node, count(*) FILTER (WHERE node <> ancestor) AS n, bool_or(node = ancestor) AS c FROM walk GROUP BY 1),
down AS (SELECT ancestor AS node, count(*) AS n FROM walk WHERE node <> ancestor GROUP BY 1),
top AS (SELECT node, min(steps) AS depth, count(*) AS n FROM near GROUP BY 1),
first AS (SELECT n.node, min(n.root) AS root FROM near n JOIN top t ON n.node = t.node AND n.steps = t.depth GROUP BY 1)
SELECT x.node AS qid, CAST(top.depth AS BIGINT) AS depth, first.root, coalesce(top.n, 0) AS roots,
  coalesce(up.n, 0) AS ancestors, coalesce(down.n, 0) AS descendants, coalesce(up.c, FALSE) AS in_cycle
FROM nodes x LEFT JOIN up ON up.node = x.node LEFT JOIN down ON down.node = x.node
  LEFT JOIN top ON top.node = x.node LEFT JOIN first ON first.node = x.node"""
)
SQL["p1_paths"] = (
    _PAIRS
    + _ROOTED
    + """,
step AS (
  SELECT a.node, a.root, a.steps, min(e.parent) AS at FROM near a JOIN e ON e.node = a.node
    JOIN near b ON b.node = e.parent AND b.root = a.root AND b.steps = a.steps - 1 GROUP BY 1, 2, 3),
way(node, root, steps, path) AS (
  SELECT node, node, 0, CAST(node AS VARCHAR) FROM roots
  UNION ALL
  SELECT s.node, s.root, s.steps, w.path || '>' || s.node FROM way w JOIN step s ON s.root = w.root AND s.at = w.node)
SELECT node AS qid, root, CAST(steps AS BIGINT) AS depth, path FROM way"""
)
SQL["p4_found"] = """
WITH m AS (
  SELECT 'concept' AS Relation, Qid AS RowId, Qid, InT1, InT2, CAST(NULL AS VARCHAR) AS Lang,
    CAST(NULL AS VARCHAR) AS LexKind, CAST(NULL AS VARCHAR) AS Value, CAST(NULL AS BIGINT) AS SubjectQid,
    CAST(NULL AS BIGINT) AS TargetQid FROM concept
  UNION ALL
  SELECT 'lexical_entry', RowId, Qid, NULL, NULL, Lang, LexKind, Value, NULL, NULL FROM lexical_entry
  UNION ALL
  SELECT 'instance_of', RowId, NULL, NULL, NULL, NULL, NULL, NULL, SubjectQid, TargetQid FROM instance_of),
j AS (
  SELECT coalesce(m.Relation, c.Relation) AS relation, coalesce(m.RowId, c.RowId) AS row_id,
    CASE WHEN c.Relation IS NULL THEN ['only_main'] WHEN m.Relation IS NULL THEN ['only_copy'] ELSE list_filter([
      CASE WHEN m.Qid IS DISTINCT FROM c.Qid THEN 'Qid' END, CASE WHEN m.InT1 IS DISTINCT FROM c.InT1 THEN 'InT1' END,
      CASE WHEN m.InT2 IS DISTINCT FROM c.InT2 THEN 'InT2' END, CASE WHEN m.Lang IS DISTINCT FROM c.Lang THEN 'Lang' END,
      CASE WHEN m.LexKind IS DISTINCT FROM c.LexKind THEN 'LexKind' END,
      CASE WHEN m.Value IS DISTINCT FROM c.Value THEN 'Value' END,
      CASE WHEN m.SubjectQid IS DISTINCT FROM c.SubjectQid THEN 'SubjectQid' END,
      CASE WHEN m.TargetQid IS DISTINCT FROM c.TargetQid THEN 'TargetQid' END], lambda x: x IS NOT NULL) END AS d
  FROM m FULL JOIN candidate_row c ON m.Relation = c.Relation AND m.RowId = c.RowId)
SELECT relation, row_id, unnest(d) AS difference FROM j"""
SQL["p4_summary"] = f"SELECT relation, difference, count(*) AS n FROM ({SQL['p4_found']}) GROUP BY 1, 2"
SQL["p1_descendants"] = (
    _PAIRS
    + """,
dist(node, ancestor, steps) USING KEY (node, ancestor) AS (
  SELECT node, parent, 1 FROM e
  UNION
  SELECT d.node, e.parent, min(d.steps) + 1 FROM dist d JOIN e ON d.ancestor = e.node
    LEFT JOIN recurring.dist k ON k.node = d.node AND k.ancestor = e.parent WHERE k.node IS NULL GROUP BY 1, 2)
SELECT ancestor AS qid, node AS descendant, CAST(steps AS BIGINT) AS steps FROM dist WHERE node <> ancestor"""
)
_BOTH = """
SELECT 'instance_of' AS relation, TargetQid AS target_qid, SubjectQid FROM instance_of
UNION ALL SELECT 'subclass_of', TargetQid, SubjectQid FROM subclass_of"""
SQL["p5_found"] = f"""
WITH b AS ({_BOTH}), t AS (SELECT relation, count(*) AS n FROM b GROUP BY 1)
SELECT b.relation, b.target_qid FROM b JOIN t ON b.relation = t.relation
GROUP BY b.relation, b.target_qid, t.n HAVING count(*) * 100 >= t.n"""
SQL["p5_targets"] = f"""
WITH b AS ({_BOTH}),
w AS (SELECT relation, target_qid, SubjectQid, count(*) AS n FROM b GROUP BY 1, 2, 3),
m AS (SELECT *, row_number() OVER (PARTITION BY relation, target_qid ORDER BY n DESC, SubjectQid) AS k FROM w),
s AS (SELECT relation, target_qid, count(*) AS links, count(DISTINCT SubjectQid) AS subjects,
  quantile_disc(SubjectQid, 0.25) AS p25, quantile_disc(SubjectQid, 0.5) AS p50, quantile_disc(SubjectQid, 0.75) AS p75
  FROM b GROUP BY 1, 2)
SELECT s.relation, s.target_qid, links, subjects, m.SubjectQid AS top_subject, m.n AS top_links, p25, p50, p75
FROM s JOIN m ON m.relation = s.relation AND m.target_qid = s.target_qid AND m.k = 1"""

QUERIES = {f.__name__: f for f in (p1_found, p1_nodes, p1_paths, p1_descendants, p4_found, p4_summary, p5_found, p5_targets)}

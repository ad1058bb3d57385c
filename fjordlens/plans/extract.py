"""Queries that read entity lines, take them apart and build the corpus from them, with their SQL.

The lines are written from the relations first (gzip text in the shared folder, with a few odd lines), so every query is a
whole round trip: relations to nested text and back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fjordlens.functions import canon, fixed
from fjordlens.operators import tiers
from fjordlens.plans.corpus import _ENDPOINTS, _bucket_sql
from fjordlens.plans.runtime import Scratch
from fjordlens.sources import binary, entities, packages
from fjordlens.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
RELATIONS = ("concept", "lexical_entry", "instance_of", "subclass_of")

#: Lines that are no items of the corpus, with their outcome.
ODD = (
    ("[", "Ignore"), ("]", "Ignore"), ('{"type":"property","id":"P31"},', "NonItem"), ('{"type":"item","id":', "Malformed"),
    ('{"type":"item","id":7}', "Malformed"), ('{"type":"item","id":"Q7","missing":""}', "Missing"), ('{"type":"item","id":"X7"}', "Malformed"),
)

NOT_UTF8 = b'{"type":"item","id":"Q9","note":"\xff"}'


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _lines(spark: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(spark, "lines")
    made = entities.written(*(table(spark, d, n) for n in ("concept", "lexical_entry", "instance_of", "subclass_of")))
    odd = spark.createDataFrame([(bytearray(x.encode()),) for x, _ in ODD] + [(bytearray(NOT_UTF8),)], "b binary").select(F.col("b").cast("string").alias("value"))
    at = f"{scratch.root}/dump"
    made.unionByName(odd).write.option("compression", "gzip").text(at)
    return entities.lines(spark, at)


_FIRST_LABEL = "SELECT Qid, Lang, min(Value) AS v FROM lexical_entry WHERE LexKind = 'label' AND Lang IN ('en', 'nb') GROUP BY 1, 2"
_LABELS = f"""
SELECT c.Qid AS qid, e.v AS label_en, n.v AS label_nb FROM concept c
LEFT JOIN ({_FIRST_LABEL}) e ON e.Qid = c.Qid AND e.Lang = 'en' LEFT JOIN ({_FIRST_LABEL}) n ON n.Qid = c.Qid AND n.Lang = 'nb'"""
_ALIASES = "SELECT DISTINCT Qid AS qid, Lang AS lang, Value AS alias FROM lexical_entry WHERE LexKind = 'alias' AND Lang IN ('en', 'nb')"
_CLAIMS = """
SELECT DISTINCT SubjectQid AS qid, 'P31' AS property, TargetQid AS target FROM instance_of
UNION ALL SELECT DISTINCT SubjectQid, 'P279', TargetQid FROM subclass_of"""


@query("\nUNION ALL\n".join(
    f"SELECT '{o}' AS outcome, {sum(x == o for _, x in ODD) + (o == 'Malformed')} + (SELECT count(*) FROM concept WHERE {o == 'Item'}) AS n"
    for o in ("Ignore", "Malformed", "Missing", "NonItem", "Item")
))
def parse_outcome(spark: SparkSession, d: str) -> DataFrame:
    """Lines by outcome."""
    return entities.parsed(_lines(spark, d)).groupBy("outcome").agg(F.count("*").alias("n"))


@query(_LABELS)
def parse_labels(spark: SparkSession, d: str) -> DataFrame:
    """The labels of each item."""
    return entities.items(_lines(spark, d)).select("qid", "label_en", "label_nb")


@query(_ALIASES)
def parse_aliases(spark: SparkSession, d: str) -> DataFrame:
    """The aliases of each item."""
    rows = _parsed_once(spark, d)
    return rows.select("qid", F.lit("en").alias("lang"), F.explode("alias_en").alias("alias")).unionByName(
        rows.select("qid", F.lit("nb").alias("lang"), F.explode("alias_nb").alias("alias"))
    )


def _claims(rows: DataFrame) -> DataFrame:
    return rows.select("qid", F.lit("P31").alias("property"), F.explode("p31").alias("target")).unionByName(
        rows.select("qid", F.lit("P279").alias("property"), F.explode("p279").alias("target"))
    )


@query(_CLAIMS)
def parse_claims(spark: SparkSession, d: str) -> DataFrame:
    """The links of each item."""
    return _claims(_parsed_once(spark, d))


@query(f"""
SELECT (SELECT count(*) FROM concept) + 3 AS source_records, (SELECT count(*) FROM concept) AS items, CAST(1 AS BIGINT) AS non_items,
  CAST(4 AS BIGINT) AS malformed, CAST(1 AS BIGINT) AS missing, (SELECT count(*) FROM ({_LABELS}) WHERE label_en IS NOT NULL) AS labels_en,
  (SELECT count(*) FROM ({_LABELS}) WHERE label_nb IS NOT NULL) AS labels_nb, (SELECT count(*) FROM ({_ALIASES}) WHERE lang = 'en') AS aliases_en,
  (SELECT count(*) FROM ({_ALIASES}) WHERE lang = 'nb') AS aliases_nb, (SELECT count(*) FROM ({_CLAIMS}) WHERE property = 'P31') AS p31_pairs,
  (SELECT count(*) FROM ({_CLAIMS}) WHERE property = 'P279') AS p279_pairs""")
def scan_totals(spark: SparkSession, d: str) -> DataFrame:
    """The totals of a scan in one aggregation."""
    return entities.totals(_lines(spark, d))


@query(f"SELECT 'valid' AS state, {len(ODD)} + (SELECT count(*) FROM concept) AS n UNION ALL SELECT 'not_utf8', CAST(1 AS BIGINT)")
def scan_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the dump that are valid text, and those that are not."""
    return _lines(spark, d).groupBy(F.when(F.col("value").isNull(), "not_utf8").otherwise("valid").alias("state")).agg(F.count("*").alias("n"))


_LINE = "concat_ws(chr(9), CAST(item_id AS VARCHAR), split, coalesce(lang, ''), coalesce(passage, ''))"


@query(f"SELECT CAST(sum(strlen({_LINE}) + 1) AS BIGINT) AS bytes, sha256(string_agg({_LINE} || chr(10), '' ORDER BY item_id)) AS sha256 FROM eval_item")
def src_identity(spark: SparkSession, d: str) -> DataFrame:
    """Size and hash of a source file, here the evaluation items written as one text file."""
    at = f"{Scratch(spark, 'identity').root}/items"
    line = F.concat_ws("\t", F.col("item_id").cast("string"), "split", F.coalesce("lang", F.lit("")), F.coalesce("passage", F.lit("")))
    table(spark, d, "eval_item").orderBy("item_id").select(line.alias("value")).coalesce(1).write.text(at)  # a fixed table of few rows
    return entities.identity(spark, at).select("bytes", "sha256")


@query(_ENDPOINTS)
def t2_ids(spark: SparkSession, d: str) -> DataFrame:
    """The endpoints written to a flat file of ascending ids and read back."""
    at = f"{Scratch(spark, 't2').root}/t2.bin"
    binary.write_ids(tiers.endpoints(table(spark, d, "subclass_of")), "qid", at)
    return binary.read_ids(spark, at)


@query("\nUNION ALL\n".join(f"SELECT '{n}' AS name, count(*) AS rows, CAST(0 AS BIGINT) AS problems FROM {n}" for n in RELATIONS))
def package_tables(spark: SparkSession, d: str) -> DataFrame:
    """The relations published as a package, checked and listed by its manifest."""
    at = f"{Scratch(spark, 'package').root}/catalogue"
    said = packages.publish(spark, at, {n: table(spark, d, n) for n in RELATIONS})
    wrong = packages.problems(spark, at)
    rows = [(n, t["rows"], sum(p.startswith(f"{n}:") for p in wrong)) for n, t in said["tables"].items()]
    return spark.createDataFrame(rows, "name string, rows bigint, problems bigint")


def _parsed_once(spark: SparkSession, d: str) -> DataFrame:
    """The parsed items as a table: everything that is built from them reads it instead of the lines."""
    return Scratch(spark, "items").cut(entities.items(_lines(spark, d)))


def build(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """concept, lexical_entry, instance_of and subclass_of from items: the hash sample T1, the endpoints T2, and what is
    kept of each. Both passes over the source become one parsed table."""
    claims = _claims(rows)
    sub = claims.where("property = 'P279'").select(F.col("qid").alias("SubjectQid"), F.col("target").alias("TargetQid"))
    ends = sub.select(F.col("SubjectQid").alias("qid")).union(sub.select("TargetQid")).distinct().withColumn("t2", F.lit(True))
    seen = rows.select("qid", canon.sampled("qid").alias("t1"), F.lit(True).alias("seen"))
    flags = seen.join(ends, "qid", "full").select(
        "qid", F.coalesce("t1", F.lit(False)).alias("t1"), F.coalesce("t2", F.lit(False)).alias("t2"), F.coalesce("seen", F.lit(False)).alias("seen")
    ).where("t1 or t2")
    concept = flags.select(F.col("qid").alias("Qid"), F.col("t1").alias("InT1"), F.col("t2").alias("InT2"))
    kept = rows.join(flags.where("seen").select("qid", "t1"), "qid")
    texts = [
        kept.where(F.col(f"label_{g}").isNotNull()).select(F.col("qid").alias("Qid"), F.lit(g).alias("Lang"), F.lit("label").alias("LexKind"), F.col(f"label_{g}").alias("Value"))
        for g in ("en", "nb")
    ] + [
        kept.where("t1").select(F.col("qid").alias("Qid"), F.lit(g).alias("Lang"), F.lit("alias").alias("LexKind"), F.explode(f"alias_{g}").alias("Value"))
        for g in ("en", "nb")
    ]
    inst = claims.where("property = 'P31'").join(flags.where("t1").select("qid"), "qid", "left_semi")
    return concept, reduce(DataFrame.unionByName, texts), inst.select(F.col("qid").alias("SubjectQid"), F.col("target").alias("TargetQid")), sub


_HIT = f"{_bucket_sql('Qid')} < {fixed.SAMPLE_BELOW}"


@query(f"""
SELECT coalesce(c.Qid, e.qid) AS Qid, coalesce({_HIT.replace('Qid', 'c.Qid')}, FALSE) AS InT1, e.qid IS NOT NULL AS InT2
FROM concept c FULL JOIN ({_ENDPOINTS}) e ON e.qid = c.Qid WHERE e.qid IS NOT NULL OR {_HIT.replace('Qid', 'c.Qid')}""")
def build_concept(spark: SparkSession, d: str) -> DataFrame:
    """The concept relation built from entity lines."""
    return build(_parsed_once(spark, d))[0]


@query(f"""
SELECT qid AS Qid, 'en' AS Lang, 'label' AS LexKind, label_en AS Value FROM ({_LABELS}) l
WHERE label_en IS NOT NULL AND ({_HIT} OR qid IN ({_ENDPOINTS}))
UNION ALL SELECT qid, 'nb', 'label', label_nb FROM ({_LABELS}) l WHERE label_nb IS NOT NULL AND ({_HIT} OR qid IN ({_ENDPOINTS}))
UNION ALL SELECT qid, lang, 'alias', alias FROM ({_ALIASES}) WHERE {_HIT}""")
def build_lexical(spark: SparkSession, d: str) -> DataFrame:
    """The lexical relation built from entity lines: labels of all kept concepts, aliases of the sample."""
    return build(_parsed_once(spark, d))[1]


@query(f"""
SELECT 'instance_of' AS relation, qid AS subject, target FROM ({_CLAIMS}) WHERE property = 'P31' AND {_HIT}
UNION ALL SELECT 'subclass_of', qid, target FROM ({_CLAIMS}) WHERE property = 'P279'""")
def build_edges(spark: SparkSession, d: str) -> DataFrame:
    """The link relations built from entity lines: instance-of of the sample, all of subclass-of."""
    _, _, inst, sub = build(_parsed_once(spark, d))
    lay = lambda df, n: df.select(F.lit(n).alias("relation"), F.col("SubjectQid").alias("subject"), F.col("TargetQid").alias("target"))
    return lay(inst, "instance_of").unionByName(lay(sub, "subclass_of"))

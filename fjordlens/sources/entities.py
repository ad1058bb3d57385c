"""Nested entity lines: reading, classifying and taking apart; and writing them from the relations.

A dump holds one JSON object a line, in an array. Each line is parsed once into a VARIANT and classified by the first rule
that fits: not an object (ignored), broken JSON (malformed), a ``missing`` key (missing), no text id (malformed, not
counted), an item with a Q id (item), a property with a P id (non-item), anything else (malformed). All of it is built-in
expressions.

Known differences, kept on purpose: an object with the same key twice is malformed here; claims whose parts are of
unexpected types are skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fjordlens.plans.runtime import ship



def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): the lines of text or gzip files, null for a line that is not valid UTF-8. A gzip file cannot be split, so
    where there are fewer files than cores the rows are dealt out right after reading."""
    ship(spark)
    raw = spark.read.text(path)
    cores = spark.sparkContext.defaultParallelism
    if raw.rdd.getNumPartitions() < cores:
        raw = raw.repartition(2 * cores)
    return raw.select(F.when(F.is_valid_utf8("value"), F.col("value")).alias("value"))


def identity(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of each file in a folder, or of one file: the hash of what is stored, taken while streaming through
    it, in constant memory at any size."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(conf)
    rows = []
    for f in fs.listStatus(place):
        name = f.getPath().getName()
        if f.isFile() and not name.startswith(("_", ".")):
            stream = fs.open(f.getPath())
            try:
                rows.append((f.getPath().toString(), f.getLen(), jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)))
            finally:
                stream.close()
    return spark.createDataFrame(rows, "path string, bytes bigint, sha256 string")


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns behind a generator, so that they are computed once a row however often they are used; a projection
    would be merged into its users and parse the text again for each."""
    made = F.array(F.struct(*(c.alias(n) for n, c in columns.items())))
    return df.select("*", F.inline(made))


def parsed(raw: DataFrame) -> DataFrame:
    """(value, v, outcome, counted, qid)."""
    body = F.regexp_replace(F.regexp_replace("value", r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""), r",$", "")
    rows = _once(raw.select("value"), body=body)
    is_object = F.col("body").startswith("{")
    rows = _once(rows.select("value", is_object.alias("is_object"), F.when(is_object, F.col("body")).alias("body")), v=F.try_parse_json("body"))
    raw_id = F.try_variant_get("v", "$.id", "variant")
    rows = _once(
        rows.select("value", "is_object", "v"),
        id=F.when(F.schema_of_variant(raw_id) == "STRING", F.try_variant_get("v", "$.id", "string")),
        type=F.try_variant_get("v", "$.type", "string"),
        missing=F.try_variant_get("v", "$.missing", "variant").isNotNull(),
    )
    qid = F.when((F.col("type") == "item") & F.col("id").rlike("^Q[1-9][0-9]*$"), F.expr("try_cast(substr(id, 2) as bigint)"))
    rows = rows.withColumn("qid", qid)
    outcome = (
        F.when(F.col("value").isNull(), "Malformed")  # not UTF-8
        .when(~F.col("is_object"), "Ignore")
        .when(F.col("v").isNull(), "Malformed")
        .when(F.col("missing"), "Missing")
        .when(F.col("id").isNull(), "Malformed")
        .when(F.col("qid").isNotNull(), "Item")
        .when((F.col("type") == "property") & F.col("id").rlike("^P[1-9][0-9]*$"), "NonItem")
        .otherwise("Malformed")
    )
    rows = rows.withColumn("outcome", outcome)
    counted = (F.col("outcome") == "Malformed") & F.col("value").isNotNull() & (F.col("v").isNull() | F.col("id").isNotNull())
    return rows.select("value", "v", "outcome", counted.alias("counted"), "qid")


def _variant(path: str) -> Column:
    return F.try_variant_get("v", path, "variant")


def _is_object(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("OBJECT<") & (F.schema_of_variant(v) != "OBJECT<>")


def label(lang: str) -> Column:
    """The label in a language: null if absent, '' if its value is missing or no text."""
    v = _variant(f"$.labels.{lang}")
    text = _variant(f"$.labels.{lang}.value")
    value = F.when(F.schema_of_variant(text) == "STRING", F.try_variant_get("v", f"$.labels.{lang}.value", "string"))
    return F.when(_is_object(v), F.coalesce(value, F.lit("")))


def aliases(lang: str) -> Column:
    """The distinct aliases in a language; '' for one without a value, elements that are no objects are skipped."""
    every = F.coalesce(F.try_variant_get("v", f"$.aliases.{lang}", "array<variant>"), F.array().cast("array<variant>"))
    objects = F.filter(every, lambda x: F.schema_of_variant(x).startswith("OBJECT<"))
    return F.array_distinct(F.transform(objects, lambda x: F.coalesce(F.try_variant_get(x, "$.value", "string"), F.lit(""))))


def targets(prop: str) -> Column:
    """The distinct ids that a property's claims point to."""
    claims = F.coalesce(F.try_variant_get("v", f"$.claims.{prop}", "array<variant>"), F.array().cast("array<variant>"))
    good = F.filter(
        claims,
        lambda x: (F.try_variant_get(x, "$.mainsnak.snaktype", "string") == "value")
        & (F.try_variant_get(x, "$.mainsnak.datavalue.type", "string") == "wikibase-entityid"),
    )
    ids = F.transform(good, lambda x: F.try_variant_get(x, "$.mainsnak.datavalue.value.numeric-id", "bigint"))
    return F.array_distinct(F.array_compact(ids))


def taken_apart(rows: DataFrame) -> DataFrame:
    """``rows`` of ``parsed`` with label_en, label_nb, alias_en, alias_nb, p31 and p279 instead of v."""
    return _once(
        rows, label_en=label("en"), label_nb=label("nb"), alias_en=aliases("en"), alias_nb=aliases("nb"),
        p31=targets("P31"), p279=targets("P279"),
    ).drop("v")


def items(raw: DataFrame) -> DataFrame:
    """(qid, label_en, label_nb, alias_en, alias_nb, p31, p279) of each item line."""
    return taken_apart(parsed(raw).where("outcome = 'Item'").select("qid", "v"))


def totals(raw: DataFrame) -> DataFrame:
    """The eleven totals of a scan in one pass. Items, non-items and counted malformed lines are source records."""
    rows = taken_apart(parsed(raw).select("outcome", "counted", "v"))
    item = F.col("outcome") == "Item"
    of = lambda c: F.coalesce(F.sum(F.when(item, F.size(c))), F.lit(0)).cast("bigint")
    return rows.agg(
        F.count_if(item | (F.col("outcome") == "NonItem") | F.col("counted")).alias("source_records"), F.count_if(item).alias("items"),
        F.count_if(F.col("outcome") == "NonItem").alias("non_items"), F.count_if(F.col("outcome") == "Malformed").alias("malformed"),
        F.count_if(F.col("outcome") == "Missing").alias("missing"), F.count_if(item & F.col("label_en").isNotNull()).alias("labels_en"),
        F.count_if(item & F.col("label_nb").isNotNull()).alias("labels_nb"), of("alias_en").alias("aliases_en"), of("alias_nb").alias("aliases_nb"),
        of("p31").alias("p31_pairs"), of("p279").alias("p279_pairs"),
    )


def written(concept: DataFrame, lexical: DataFrame, instance: DataFrame, subclass: DataFrame) -> DataFrame:
    """(value): an entity line for each concept, with its texts in every language and its links. The format has one label a
    language, so of several labels the smallest is written; a language code is written as it is, dirty ones too."""
    texts = lexical.where("Lang is not null and Value is not null")

    def per(kind: str, name: str, how: Column) -> DataFrame:
        one = texts.where(F.col("LexKind") == kind).groupBy("Qid", "Lang").agg(how.alias("x"))
        return one.groupBy("Qid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("Lang", "x")))).alias(name))  # a concept's languages

    def links(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(F.col("SubjectQid").alias("Qid")).agg(F.array_sort(F.collect_set("TargetQid")).alias(name))

    rows = concept.select("Qid")
    label = F.struct(F.min("Value").alias("value"))
    alias = F.transform(F.array_sort(F.collect_set("Value")), lambda x: F.struct(x.alias("value")))  # a concept's own texts
    for part in (per("label", "labels", label), per("alias", "aliases", alias), links(instance, "p31"), links(subclass, "p279")):
        rows = rows.join(part, "Qid", "left")

    def claim(c: str) -> Column:
        return F.transform(
            c,
            lambda x: F.struct(F.struct(
                F.lit("value").alias("snaktype"),
                F.struct(F.lit("wikibase-entityid").alias("type"), F.struct(x.alias("numeric-id")).alias("value")).alias("datavalue"),
            ).alias("mainsnak")),
        )

    return rows.select(F.concat(F.to_json(F.struct(
        F.lit("item").alias("type"), F.concat(F.lit("Q"), F.col("Qid")).alias("id"), "labels", "aliases",
        F.struct(claim("p31").alias("P31"), claim("p279").alias("P279")).alias("claims"),
    )), F.lit(",")).alias("value"))

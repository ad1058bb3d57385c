"""Queries of the training-data problems (2, 3, 6 to 10) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fjordlens.llm import canonical_text, contamination, heavy_hitters, mixing, quantile_sketch, stable_sample, text_quality
from fjordlens.plans.runtime import Scratch
from fjordlens.sources.tables import table

SAMPLE_RATE = 0.1
SQL: dict[str, str] = {}


def p2_probe_sample(spark: SparkSession, d: str) -> DataFrame:
    """A tenth of the probed concepts, stable as later batches arrive. They are numbered in two batches, before and after the
    middle day, as they would come in: the second one finds the numbers of the first in their table."""
    probes = (
        table(spark, d, "serving_probe").select(F.col("Qid").alias("qid"), "AddedAt")
        .unionByName(table(spark, d, "graph_probe").select(F.col("StartQid").alias("qid"), "AddedAt"))
    )
    scratch = Scratch(spark, "p2")
    ends = probes.agg(F.min("AddedAt").alias("a"), F.max("AddedAt").alias("z")).collect()[0]
    early = F.coalesce(F.col("AddedAt") < F.lit(ends["a"] + (ends["z"] - ends["a"]) / 2 if ends["a"] else None), F.lit(False))
    numbers = stable_sample.extend(probes.where(early), "qid", "AddedAt", scratch, None)
    numbers = stable_sample.extend(probes, "qid", "AddedAt", scratch, numbers)
    return stable_sample.chosen(spark.read.parquet(numbers), SAMPLE_RATE).select("qid", "seq")


SQL["p2_probe_sample"] = f"""
WITH p AS (SELECT Qid AS qid, AddedAt FROM serving_probe UNION ALL SELECT StartQid, AddedAt FROM graph_probe),
f AS (SELECT qid, min(AddedAt) AS t FROM p WHERE qid IS NOT NULL GROUP BY 1),
s AS (SELECT qid, row_number() OVER (ORDER BY t NULLS LAST, qid) - 1 AS seq FROM f)
SELECT qid, seq FROM s
WHERE (CAST(seq AS HUGEINT) * {stable_sample.STEP} + {stable_sample.SHIFT % stable_sample.ONE}) % {stable_sample.ONE}
  < {round(SAMPLE_RATE * stable_sample.ONE)}"""


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The 12 commonest targets of instance_of."""
    best = heavy_hitters.top(table(spark, d, "instance_of").select("TargetQid"), "TargetQid", 12)
    return best.select(F.col("item").alias("target_qid"))


def p3_top50(spark: SparkSession, d: str) -> DataFrame:
    """The 50 commonest targets of instance_of with their rows."""
    best = heavy_hitters.top(table(spark, d, "instance_of").select("TargetQid"), "TargetQid", 50)
    return best.select(F.col("item").alias("target_qid"), "rows")


def p3_estimates(spark: SparkSession, d: str) -> DataFrame:
    """The summary itself: candidates with a lower and an upper bound of their rows."""
    s = heavy_hitters.summary(table(spark, d, "instance_of").select("TargetQid"), "TargetQid", 1024)
    lost = s.agg(F.max("lost").alias("lost")).collect()
    lost = lost[0]["lost"] or 0
    return s.where(F.col("item").isNotNull()).select(
        F.col("item").alias("target_qid"), F.col("n").alias("at_least"), (F.col("n") + F.lit(lost)).alias("at_most")
    )


def p3_bounds(spark: SparkSession, d: str) -> DataFrame:
    """How many values there are, and how many have rows outside the bounds that the summary states for them: between their
    counter and counter + lost, or at most lost without a counter."""
    rows = table(spark, d, "instance_of").select("TargetQid").where("TargetQid is not null")
    s = Scratch(spark, "p3").cut(heavy_hitters.summary(rows, "TargetQid", 1024))
    lost = F.lit(s.agg(F.coalesce(F.max("lost"), F.lit(0)).alias("lost")).collect()[0]["lost"])
    true = rows.groupBy(F.col("TargetQid").alias("item")).agg(F.count("*").alias("rows"))
    both = true.join(s.where("item is not null").select("item", "n"), "item", "full")
    low = F.coalesce("n", F.lit(0))
    right = F.coalesce((F.col("rows") >= low) & (F.col("rows") <= low + lost), F.lit(False))
    return both.agg(F.count("*").alias("values"), F.count_if(~right).alias("wrong"))


SQL["p3_bounds"] = "SELECT count(DISTINCT TargetQid) AS values, CAST(0 AS BIGINT) AS wrong FROM instance_of"
SQL["p3_found"] = """
SELECT TargetQid AS target_qid FROM instance_of WHERE TargetQid IS NOT NULL
GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 12"""
SQL["p3_top50"] = """
SELECT TargetQid AS target_qid, count(*) AS rows FROM instance_of WHERE TargetQid IS NOT NULL
GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 50"""


def wall_times(spark: SparkSession, d: str) -> DataFrame:
    """(day, operation, stratum, seconds) of timed samples: each SampleId once (its first delivery), operations in
    one case, wall times above zero (null, NaN, zero and negative ones are no times)."""
    raw = table(spark, d, "g1_timed_sample")
    one = F.struct("IngestedAt", "FinishedAt", F.upper("Operation").alias("operation"), "Stratum", "WallSeconds")
    lone = F.when(F.col("SampleId").isNull(), F.monotonically_increasing_id())  # rows without an id are kept apart
    first = raw.groupBy("SampleId", lone.alias("_lone")).agg(F.min(one).alias("s"))
    seconds = F.col("s.WallSeconds")
    return first.select(
        F.to_date("s.FinishedAt").alias("day"), F.col("s.operation").alias("operation"), F.col("s.Stratum").alias("stratum"), seconds.alias("seconds")
    ).where(~F.isnan("seconds") & (F.col("seconds") > 0))


P6_AT = (0.5, 0.9, 0.95, 0.99)
P6_KEYS = ["operation", "stratum"]


def p6_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """p50, p90, p95 and p99 of wall times per operation and stratum: of each day ('one'), of all days up to it ('to_date') and
    of all. One sketch a day, operation and stratum is stored; everything else is made by adding stored sketches."""
    stored = quantile_sketch.sketches(wall_times(spark, d), ["day", *P6_KEYS], "seconds", Scratch(spark, "p6"))
    return quantile_sketch.running(stored, P6_KEYS, "day", P6_AT)


def p6_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Whether each answer of p6_percentiles for a day or for all of them lies within its stated bound: its exact rank is
    counted over all wall times."""
    scratch = Scratch(spark, "p6")
    times = scratch.cut(wall_times(spark, d))
    stored = quantile_sketch.sketches(times, ["day", *P6_KEYS], "seconds", scratch)
    said = scratch.cut(quantile_sketch.running(stored, P6_KEYS, "day", P6_AT).where("scope <> 'to_date'"))
    each = times.select(F.explode(F.array(F.lit("one"), F.lit("all"))).alias("scope"), "day", *P6_KEYS, "seconds")
    each = each.withColumn("day", F.when(F.col("scope") == "one", F.col("day")))
    # one row per group and share: values below and up to the answer, give or take the resolution of the code
    names = [f"p{round(q * 100)}" for q in P6_AT]
    keys = ["scope", "day", *P6_KEYS]
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}"))
    near = 2.0**-12
    counted = each.alias("t").join(said.alias("s"), same).groupBy(*(F.col(f"s.{k}").alias(k) for k in keys)).agg(
        F.first("s.n").alias("n"), F.count("*").alias("rows"), F.first("s.rank_error").alias("e"),
        *(F.count_if(F.col("t.seconds") < F.col(f"s.{p}") * (1 - near)).alias(f"{p}_low") for p in names),
        *(F.count_if(F.col("t.seconds") <= F.col(f"s.{p}") * (1 + near)).alias(f"{p}_up") for p in names),
    )
    slack = F.col("e") * F.col("rows") + 1
    within = F.col("n") == F.col("rows")
    for p, q in zip(names, P6_AT):
        within = within & (F.col(f"{p}_low") - slack <= F.col("rows") * q) & (F.col(f"{p}_up") + slack >= F.col("rows") * q)
    return counted.select(*keys, "n", within.alias("within"))


SQL["p6_bounds"] = """
WITH f AS (SELECT * EXCLUDE (k) FROM (
  SELECT *, row_number() OVER (PARTITION BY SampleId ORDER BY IngestedAt, FinishedAt) AS k FROM g1_timed_sample) WHERE k = 1 OR SampleId IS NULL),
t AS (SELECT CAST(FinishedAt AS DATE) AS day, upper(Operation) AS operation, Stratum AS stratum FROM f
  WHERE WallSeconds IS NOT NULL AND NOT isnan(WallSeconds) AND WallSeconds > 0)
SELECT 'one' AS scope, day, operation, stratum, count(*) AS n, TRUE AS within FROM t GROUP BY 2, 3, 4
UNION ALL SELECT 'all', NULL, operation, stratum, count(*), TRUE FROM t GROUP BY 3, 4"""


def _canonical(spark: SparkSession, d: str) -> DataFrame:
    entries = table(spark, d, "lexical_entry")
    looks = canonical_text.Looks(canonical_text.heads(spark))
    counts = canonical_text.train(entries, "Value", looks)
    return canonical_text.canonical(
        entries.select("RowId", "Qid", "Lang", "Value"), {"Lang": "c_Lang", "Value": "c_Value"}, looks, counts
    )


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of entries of one concept that look the same but are not written the same."""
    return canonical_text.lookalike_pairs(_canonical(spark, d), "RowId", "Qid", ["Lang", "Value"], Scratch(spark, "p7"))


def p7_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every lexical entry with the consistent form of its language code and text."""
    return _canonical(spark, d).select("RowId", F.col("c_Lang").alias("lang"), F.col("c_Value").alias("value"))


# The same forms in SQL, for the characters that occur in the tables. Letters that look like a Latin one, and it.
FOREIGN = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧνοАВЕКМНОРСТХаеорсухіѕјԁ‐‑"
LATIN = "ABEZHIKMNOPTYXvoABEKMHOPCTXaeopcyxisjd--"
NUMERALS = {"Ⅷ": "VIII", "Ⅶ": "VII", "Ⅲ": "III", "Ⅱ": "II", "Ⅳ": "IV", "Ⅵ": "VI", "Ⅸ": "IX", "Ⅰ": "I", "Ⅴ": "V", "Ⅹ": "X"}


def _form_sql(column: str) -> str:
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    narrow = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''")
    out = f"regexp_replace({column}, '[\u00AD\u200B-\u200F\u2060\uFEFF]', '', 'g')"
    out = f"regexp_replace({out}, '[\u00A0\u2000-\u200A\u202F\u205F\u3000]', ' ', 'g')"
    out = f"translate(translate(translate({out}, '{wide}', '{narrow}'), '{FOREIGN}', '{LATIN}'), 'K', 'K')"
    for one, many in NUMERALS.items():
        out = f"replace({out}, '{one}', '{many}')"
    return f"trim(nfc_normalize({out}), ' ')"


SQL["p7_forms"] = f"SELECT RowId, {_form_sql('Lang')} AS lang, {_form_sql('Value')} AS value FROM lexical_entry"
SQL["p7_found"] = f"""
WITH f AS (SELECT RowId, Qid, Lang, Value, {_form_sql('Lang')} AS l, {_form_sql('Value')} AS v FROM lexical_entry)
SELECT a.RowId AS row_id_1, b.RowId AS row_id_2 FROM f a JOIN f b ON a.Qid = b.Qid AND a.l = b.l AND a.v = b.v AND a.RowId < b.RowId
WHERE a.Lang <> b.Lang OR a.Value <> b.Value"""


def p8_regions(spark: SparkSession, d: str) -> DataFrame:
    """Each document and passage that share a stretch as long as 13 words with at most two edits."""
    found = contamination.regions(
        table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_item"), "item_id", "passage"
    )
    return found.withColumnsRenamed({"doc": "doc_id", "item": "item_id"})


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Each document and passage of which it holds at least 13 consecutive words."""
    return p8_regions(spark, d).where("run >= 13").select("doc_id", "item_id")


def _shingles_sql(key: str, text: str, source: str) -> str:
    return f"""
SELECT {key}, array_to_string(w[i:i + 12], ' ') AS s FROM (
  SELECT {key}, w, unnest(range(1, len(w) - 11)) AS i FROM (
    SELECT {key}, regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+') AS w FROM {source} WHERE {text} IS NOT NULL) WHERE len(w) >= 13)"""


SQL["p8_found"] = f"""
SELECT DISTINCT d.doc_id, i.item_id
FROM ({_shingles_sql('doc_id', 'text', 'documents')}) d JOIN ({_shingles_sql('item_id', 'passage', 'eval_item')}) i ON i.s = d.s"""


def _counted(spark: SparkSession, d: str, scratch: Scratch) -> DataFrame:
    return scratch.cut(mixing.with_tokens(table(spark, d, "documents"), "text", ["doc_id", "source"]))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources that cannot fill their share."""
    rated = mixing.rates(_counted(spark, d, Scratch(spark, "p9")), table(spark, d, "mix_target"))
    return mixing.short(rated).select("source")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mixture: one row per emitted copy of a document."""
    scratch = Scratch(spark, "p9")
    counted = _counted(spark, d, scratch)
    rated = scratch.cut(mixing.rates(counted, table(spark, d, "mix_target")))  # a table, so that the planner knows how small it is
    return mixing.mixed(counted, rated, "doc_id")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of each named source."""
    scratch = Scratch(spark, "p9")
    counted = _counted(spark, d, scratch)
    rated = scratch.cut(mixing.rates(counted, table(spark, d, "mix_target")))
    return mixing.shares(scratch.cut(mixing.mixed(counted, rated, "doc_id")), rated)


def p9_rules(spark: SparkSession, d: str) -> DataFrame:
    """Per named source its documents and how many of them are used other than floor(rate) or one more times, or more often than
    ``max_repeats``; and whether the tokens reached are within a document's chance of what the rate asks for."""
    scratch = Scratch(spark, "p9")
    counted = _counted(spark, d, scratch)
    rated = scratch.cut(mixing.rates(counted, table(spark, d, "mix_target")))
    used = scratch.cut(mixing.mixed(counted, rated, "doc_id")).groupBy("doc_id").agg(F.count("*").alias("copies"))
    each = counted.where("source is not null").join(used, "doc_id", "left").join(rated.select("source", "rate", "max_repeats"), "source")
    copies = F.coalesce("copies", F.lit(0))
    wrong = (copies < F.floor("rate")) | (copies > F.floor("rate") + 1) | (copies > F.coalesce("max_repeats", copies))
    # the variance of the last copies: p (1 - p) tokens^2
    part = F.col("rate") - F.floor("rate")
    by = each.where("tokens > 0").groupBy("source").agg(
        F.count_if(wrong).alias("wrong"), F.sum(F.col("tokens") * copies).alias("got"), F.sum(F.col("tokens") * F.col("rate")).alias("asked"),
        F.sqrt(F.sum(F.col("tokens") * F.col("tokens") * part * (1 - part))).alias("sd"),
    )
    near = F.abs(F.col("got") - F.col("asked")) <= 5 * F.col("sd") + 1
    return rated.join(by, "source", "left").select("source", "documents", F.coalesce("wrong", F.lit(0)).alias("wrong"), F.coalesce(near, F.lit(True)).alias("near"))


SQL["p9_rules"] = """
SELECT t.source, count(d.source) AS documents, CAST(0 AS BIGINT) AS wrong, TRUE AS near FROM mix_target t LEFT JOIN documents d ON d.source = t.source GROUP BY 1"""


def p10_common(spark: SparkSession, d: str) -> DataFrame:
    """The common words of each language, as learned from all documents."""
    docs = table(spark, d, "documents").withColumn("lang", text_quality.language("lang"))
    usage = text_quality.learn(docs, "text", Scratch(spark, "p10"))
    return spark.createDataFrame([(lang, w) for w, langs in usage.words.items() for lang in langs], "lang string, word string")


SQL["p10_common"] = f"""
WITH d AS (SELECT CASE split_part(replace(lower(trim(coalesce(lang, ''))), '_', '-'), '-', 1) WHEN 'eng' THEN 'en' WHEN 'no' THEN 'nb' WHEN 'nor' THEN 'nb' WHEN 'nob' THEN 'nb' WHEN 'nn' THEN 'nb'
    ELSE split_part(replace(lower(trim(coalesce(lang, ''))), '_', '-'), '-', 1) END AS lang, list_distinct(regexp_extract_all(lower(text), '\\p{{L}}+')) AS w
  FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '\\S')),
n AS (SELECT lang, count(*) + {text_quality.PRIOR} AS n FROM d GROUP BY 1),
c AS (SELECT lang, word, count(*) AS k FROM (SELECT lang, unnest(w) AS word FROM d) GROUP BY 1, 2)
SELECT c.lang, word FROM c JOIN n ON n.lang = c.lang WHERE k >= {text_quality.COMMON_SHARE} * n.n"""


def _quality(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    scratch = Scratch(spark, "p10")
    docs = table(spark, d, "documents").withColumn("lang", text_quality.language("lang"))
    usage = text_quality.learn(docs, "text", scratch)
    stats = scratch.cut(text_quality.with_statistics(docs, "text", ["doc_id", "lang"], usage))
    return stats, text_quality.scored(stats, "doc_id", scratch)


def p10_stats(spark: SparkSession, d: str) -> DataFrame:
    """The statistics of each document and its outlier score."""
    stats, scores = _quality(spark, d)
    return stats.join(scores, "doc_id", "left")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are no running text: those whose outlier score reaches the cut."""
    _, scores = _quality(spark, d)
    return scores.where(F.col("score") >= text_quality.CUT).select("doc_id")


QUERIES = {
    f.__name__: f
    for f in (p2_probe_sample, p3_found, p3_top50, p3_estimates, p3_bounds, p6_percentiles, p6_bounds, p7_found, p7_forms, p8_found, p8_regions, p9_found, p9_mix, p9_shares, p9_rules, p10_found, p10_stats, p10_common)
}

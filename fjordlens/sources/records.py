"""Records as JSON lines: written in a fixed order of fields, read back strictly.

A line is a record or it has a problem, which is the first of: not UTF-8, a carriage return or byte-order mark, blank, broken JSON (a
field given twice is broken), no object, an unknown field, a field that is missing, a field of another type, and a value
out of range. Reading is built-in expressions over the text lines, so a file of any size is read by all tasks; whoever needs all
or nothing asks ``problems`` first.

Fields that are null are not written; an existing folder is never overwritten.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    name: str
    kind: str  # string, bigint, double, boolean or a nested type
    required: bool = True
    among: tuple[str, ...] = ()
    least: float | None = None


STATUSES = ("VALID", "INVALID", "ERROR")
#: Fields of timed samples (fixed names of the format).
SAMPLE = (
    Field("operation", "string"), Field("sequence", "bigint"), Field("stratum", "string"), Field("wall_seconds", "double", least=0.0),
    Field("correctness_status", "string", among=STATUSES), Field("actual_cardinality", "bigint", False), Field("actual_visited", "bigint", False),
    Field("actual_digest", "string", False), Field("error", "string", False),
)
PROBE = (
    Field("op", "string"), Field("stratum", "string"), Field("seq", "bigint"), Field("measured", "boolean"), Field("qid", "bigint", False),
    Field("lang", "string", False), Field("value", "string", False),
)
GRAPH_PROBE = (
    Field("op", "string"), Field("stratum", "string"), Field("seq", "bigint"), Field("measured", "boolean"), Field("start", "bigint", False),
    Field("concepts", "array<struct<qid:bigint,source_stratum:string>>", False),
)
EXPECTED = (
    Field("op", "string"), Field("seq", "bigint"), Field("kind", "string", False), Field("measured", "boolean"), Field("item", "bigint", False),
    Field("qid", "bigint", False), Field("source_stratum", "string", False), Field("cardinality", "bigint"), Field("visited", "bigint", False),
    Field("digest", "string"),
)
ANALYTICAL = (Field("op", "string"), Field("cardinality", "bigint"), Field("digest", "string"))
_TYPES = {"string": ("STRING",), "bigint": ("BIGINT",), "boolean": ("BOOLEAN",)}


def write(df: DataFrame, path: str, fields: tuple[Field, ...], order: list[str]) -> None:
    """Writes the records in order of ``order``, by ranges; the names of the parts keep the order of the ranges."""
    columns = set(df.columns)
    laid = df.orderBy(*order)
    laid.select(F.to_json(F.struct(*(F.col(f.name).cast(f.kind).alias(f.name) for f in fields if f.name in columns))).alias("value")).write.text(path)


def read(spark: SparkSession, path: str, fields: tuple[Field, ...]) -> DataFrame:
    """The fields of each line, and ``problem``, null for a good one; a line with a problem has null fields."""
    raw = spark.read.option("lineSep", "\n").text(path)
    valid = F.is_valid_utf8("value")
    text = F.when(valid, F.col("value"))
    rows = raw.select(text.alias("line"), F.try_parse_json(text).alias("v"))
    found = [F.try_variant_get("v", f"$.{f.name}", "variant") for f in fields]
    kinds = [F.when(x.isNotNull() & ~F.is_variant_null(x), F.schema_of_variant(x)) for x in found]
    values = [F.try_variant_get("v", f"$.{f.name}", f.kind) for f in fields]

    def bad_type(f: Field, kind: Column) -> Column:
        if f.kind == "double":
            return ~(kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL"))
        return ~kind.isin(*_TYPES[f.kind]) if f.kind in _TYPES else ~kind.startswith("ARRAY")

    def out_of_range(f: Field, value: Column) -> Column:
        wrong = F.lit(False)
        if f.among:
            wrong = wrong | ~value.isin(*f.among)
        if f.least is not None:
            wrong = wrong | (value < f.least) | F.isnan(value)
        if f.required and f.kind == "string":
            wrong = wrong | (value == "")
        return F.coalesce(wrong, F.lit(False))

    unknown = F.array_except(F.json_object_keys("line"), F.array(*(F.lit(f.name) for f in fields)))
    checks = [
        (F.col("line").isNull(), "not UTF-8"), (F.col("line").contains("\r") | F.col("line").startswith("﻿"), "line ends or mark"),
        (F.trim("line") == "", "blank"), (F.col("v").isNull(), "broken JSON"), (~F.schema_of_variant("v").startswith("OBJECT<"), "no object"),
        (F.size(unknown) > 0, "unknown field"),
        *((k.isNull(), f"{f.name}: missing") for f, k in zip(fields, kinds) if f.required),
        *((bad_type(f, k), f"{f.name}: other type") for f, k in zip(fields, kinds)),
        *((out_of_range(f, x), f"{f.name}: out of range") for f, x in zip(fields, values)),
    ]
    problem = F.coalesce(*(F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for c, name in checks), F.lit(None).cast("string"))
    judged = rows.select(F.inline(F.array(F.struct(problem.alias("problem"), *(x.alias(f.name) for f, x in zip(fields, values))))))  # once a line
    return judged.select(*(F.when(F.col("problem").isNull(), F.col(f.name)).alias(f.name) for f in fields), "problem")


def problems(rows: DataFrame) -> dict[str, int]:
    """Problems by name; kinds of problems are few."""
    return {r["problem"]: r["count"] for r in rows.where("problem is not null").groupBy("problem").count().collect()}

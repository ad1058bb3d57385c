"""Packages of tables: staged, checked, published by one rename, and read back with gates.

A package is a folder of Parquet tables, each written by the cluster, and a ``manifest.json`` with every table's rows and
order-free digest. It is written beside its place and renamed when complete, so a reader sees all or nothing; a package
that exists is never overwritten. Works on any file system of the session.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fjordlens.functions import canon
from fjordlens.operators import multiset_fold
from fjordlens.sources import evidence


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def row_bytes(df: DataFrame):
    """Canonical hex of any row: each column as its text, with a presence byte."""
    return F.concat(*(canon.maybe_text(F.col(c).cast("string")) for c in df.columns))


def digest(df: DataFrame) -> dict:
    r = multiset_fold.fold(df, row_bytes(df)).collect()[0]
    return {"rows": r["rows"], "digest": r["digest"], "schema": df.schema.jsonValue()}


def publish(spark: SparkSession, path: str, tables: dict[str, DataFrame]) -> dict:
    """Writes the tables and their manifest; raises FileExistsError if the package exists."""
    fs, place = _fs(spark, path)
    if fs.exists(place):
        raise FileExistsError(path)
    stage = f"{path}._staging-{uuid.uuid4().hex}"
    manifest = {"state": "Complete", "tables": {}}
    for name, df in tables.items():
        df.write.parquet(f"{stage}/{name}")
        manifest["tables"][name] = digest(spark.read.parquet(f"{stage}/{name}"))
    out = fs.create(_fs(spark, f"{stage}/manifest.json")[1], False)
    out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
    out.close()
    if not fs.rename(_fs(spark, stage)[1], place):
        raise OSError(f"cannot rename to {path}")
    return manifest


def manifest(spark: SparkSession, path: str) -> dict:
    text = "\n".join(r["value"] for r in spark.read.text(f"{path}/manifest.json").collect())
    return json.loads(text)


def problems(spark: SparkSession, path: str) -> list[str]:
    """What is wrong with a package: its state, a missing table, other rows, another digest or schema."""
    said, out = manifest(spark, path), []
    if said.get("state") != "Complete":
        out.append("state")
    fs, _ = _fs(spark, path)
    for name, want in said["tables"].items():
        if not fs.exists(_fs(spark, f"{path}/{name}")[1]):
            out.append(f"{name}: missing")
            continue
        got = digest(spark.read.parquet(f"{path}/{name}"))
        out += [f"{name}: {k}" for k in ("rows", "digest", "schema") if got[k] != want[k]]
    return out


def preflight(spark: SparkSession, package: str, runs: list[str] = ()) -> list[str]:
    """Why the inputs of a build cannot be used: a package that lacks, is not complete or has changed, or evidence that has; an
    empty list lets it go ahead. Nothing is raised."""
    fs, place = _fs(spark, package)
    if not fs.exists(place):
        return [f"not found: {package}"]
    out = []
    for name, check in [(package, problems), *((r, evidence.problems) for r in runs)]:
        try:
            out += [f"{name}: {p}" for p in check(spark, name)]
        except Exception as e:  # noqa: BLE001  a missing or broken list is a reason like others
            out.append(f"{name}: {type(e).__name__}")
    return out


SET_NAMES = ("resolvedGold", "goldUnion", "ambiguousCand")  # fixed names of the format


class AnchorError(ValueError):
    pass


def anchors(
    spark: SparkSession, path: str, sources: dict[str, str] | None = None, sizes: dict[str, int] | None = None, n_cases: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(set, qid) and the cases (id, category, language, term, name_type, status, qid, candidates) of an anchor file: one small
    JSON object, so it is read and checked on the driver. Unknown or missing fields, ids that are no Q ids and sets or cases
    that occur twice are errors; so are other sources (path to hash), sizes of sets and numbers of cases than those asked for."""
    raw = json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))
    if not isinstance(raw, dict) or raw.keys() != {"schema", "phase0_commit", "sources", "sets", "goldCases"}:
        raise AnchorError("fields of the file")
    if missing := [n for n in SET_NAMES if n not in raw["sets"]]:
        raise AnchorError(f"missing sets: {missing}")

    def number(q: str) -> int:
        if not isinstance(q, str) or not re.fullmatch(r"Q[1-9][0-9]*", q):
            raise AnchorError(f"no Q id: {q}")
        return int(q[1:])

    members = []
    for name, ids in raw["sets"].items():
        if len(set(ids)) != len(ids):
            raise AnchorError(f"{name}: an id occurs twice")
        members += [(name, number(q)) for q in ids]
    cases = []
    for c in raw["goldCases"]:
        if extra := c.keys() - {"id", "category", "language", "term", "nameType", "status", "qid", "candidateQids", "evidenceClass"}:
            raise AnchorError(f"unknown fields of a case: {sorted(extra)}")
        found = c.get("candidateQids")
        cases.append((
            str(c["id"]), c["category"], c["language"], c["term"], c.get("nameType"), c["status"], number(c["qid"]) if c.get("qid") else None,
            None if found is None else [number(q) for q in found],
        ))
    if len({c[0] for c in cases}) != len(cases):
        raise AnchorError("a case occurs twice")
    if sources and not sources.items() <= {(x["path"], x["sha256"]) for x in raw["sources"]}:
        raise AnchorError("provenance")
    if sizes and {n: len(ids) for n, ids in raw["sets"].items()} != sizes or n_cases is not None and len(cases) != n_cases:
        raise AnchorError("number of members or cases")
    return spark.createDataFrame(members, "set string, qid bigint"), spark.createDataFrame(cases, CASES)


CASES = "id string, category string, language string, term string, name_type string, status string, qid bigint, candidates array<bigint>"

"""Session-level helpers: lineage cuts in the shared folder and ranks without a single task."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session. Only local mode, where driver and executors
    are one process, may lack it and gets a folder of its own; on a cluster a machine's own folder would lose tables."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + os.path.join(tempfile.gettempdir(), f"fjordlens-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers once per application, so that it need not be installed there."""
    context = spark.sparkContext
    if getattr(context, "_fjordlens_sent", None):
        return
    root = Path(__file__).resolve().parents[1]
    at = os.path.join(tempfile.mkdtemp(), f"{root.name}.zip")
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(q for q in root.rglob("*") if q.suffix in (".py", ".json")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(at)
    context._fjordlens_sent = True


_roots: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _clean() -> None:
    """Removes the tables of this application when it ends; results that are read lazily may need them until then."""
    for spark, at in _roots:
        try:
            _delete(spark, at)
        except Exception:  # noqa: BLE001  the JVM may be gone already
            return


class Scratch:
    """Tables written to the shared folder to cut lineage.

    A written table survives the loss of any executor, is compressed and columnar, and gives the planner true
    sizes, so that its own threshold decides on broadcasts. ``drop`` removes a table that is no longer read.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        _roots.append((spark, self.root))

    def cut(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and read it again; the plan behind it is gone."""
        self.n += 1
        at = f"{self.root}/{self.n}"
        df.write.parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._scratch_path = at
        return out

    def drop(self, df: DataFrame) -> None:
        if at := getattr(df, "_scratch_path", None):
            _delete(self.spark, at)


def offsets(counts: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """(part, rows) to (part, rows of all parts before it)."""
    out, total = [], 0
    for part, n in sorted(counts):
        out.append((part, total))
        total += n
    return out


def global_rank(df: DataFrame, order: Sequence[str | Column], rank: str, scratch: Scratch) -> DataFrame:
    """Adds ``rank`` (bigint, from 0) in the order of ``order``, which must be total.

    Rows are split into ranges and sorted within each (no single-task window); a range's rank is its position plus the
    rows of the ranges before it. Only one count per range goes to the driver, and the same small table comes back.
    """
    spark = df.sparkSession
    laid = scratch.cut(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    part, pos = F.shiftright("_at", 33).cast("int"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = [(r["p"], r["n"]) for r in laid.groupBy(part.alias("p")).count().withColumnRenamed("count", "n").collect()]
    starts = spark.createDataFrame(offsets(counts), "_part int, _start bigint")
    return (
        laid.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")  # one row per range
        .withColumn(rank, pos + F.col("_start"))
        .drop("_at", "_part", "_start")
    )

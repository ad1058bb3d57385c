"""Flat binary files of ids, and gzip files that may be cut short."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fjordlens.plans.runtime import ship


def write_ids(df: DataFrame, column: str, path: str) -> int:
    """Ascending distinct ids as little-endian int64 in one file. The cluster sorts; the driver streams partition by
    partition, as the format is one ordered stream. Returns how many were written; an existing file is an error."""
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, False)
    n, held = 0, []
    try:
        for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).toLocalIterator():
            held.append(r[0])
            if len(held) == 1 << 16:
                out.write(bytearray(np.array(held, "<i8").tobytes()))
                n, held = n + len(held), []
        out.write(bytearray(np.array(held, "<i8").tobytes()))
    finally:
        out.close()
    return n + len(held)


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for content in b.column(0):
            raw = content.as_buffer()
            if raw.size % 8:
                raise ValueError("the file is not a whole number of ids")
            ids = np.frombuffer(raw, "<i8")
            if (np.diff(ids) <= 0).any():
                raise ValueError("ids do not ascend strictly")
            yield pa.RecordBatch.from_arrays([pa.array(ids)], ["qid"])


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(qid) of each file; a file is one value, so files are bounded by the 2 GB of a binary column."""
    ship(spark)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_ids, "qid bigint")


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, content in zip(b.column(0).to_pylist(), b.column(1)):
            rest, text, cut = bytes(content.as_buffer()), b"", False
            while rest and not cut:
                z = zlib.decompressobj(31)
                try:
                    text += z.decompress(rest)
                except zlib.error:
                    cut = True
                cut, rest = cut or not z.eof, z.unused_data
            found = text.split(b"\n")
            if found and not found[-1]:
                found.pop()
            good = []
            for line in found:
                try:
                    good.append(line.decode())
                except UnicodeDecodeError:
                    good.append(None)
            yield pa.RecordBatch.from_arrays(
                [pa.array([path] * len(good), pa.string()), pa.array(good, pa.string()), pa.array([cut] * len(good), pa.bool_())],
                ["path", "value", "truncated"],
            )


def tolerant_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, value, truncated): the lines of gzip files, also of one that is cut short, whose last partial line is kept;
    value is null where a line is not UTF-8. For small files; whole dumps go through ``entities.lines``."""
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_lines, "path string, value string, truncated boolean")

"""Mixing sources to target shares of tokens.

Method: tokens are added up per source; a source's rate is the tokens it should have over the tokens it has, at most its
``max_repeats``; every document is emitted floor(rate) times and once more with a probability of the rest, decided by a
hash of its id and a seed, so that the mixture is the same in every run and layout and no source is ever sorted or
collected.

Defined results: null and empty texts have no tokens; a null source belongs to no target; targets that are null count as
0 and null max_repeats as no cap; sources without documents have no rate; sources that are not named are left out of the
mixture but count towards its size.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public splitting pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_loaded: dict = {}


def encoder(path: str):
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        _loaded[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def with_tokens(df: DataFrame, text: str, keep: list[str], path: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``tokens``, the tokens of the whole text."""
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_ordinary
        for b in batches:  # the kept columns stay Arrow arrays, so their nulls and types do too
            n = [len(encode(t)) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], [*keep, "tokens"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", tokens bigint"
    return df.select(*keep, text).mapInArrow(run, schema)


def rates(counted: DataFrame, targets: DataFrame) -> DataFrame:
    """Per named source: documents, tokens, wanted tokens and rate. ``counted`` is (source, tokens, ...), of any size."""
    total = counted.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).collect()[0]["t"]
    have = counted.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"))
    share = F.coalesce("target_share", F.lit(0.0))
    wanted = share * F.lit(float(total))
    return targets.select("source", "target_share", "max_repeats").join(have, "source", "left").select(
        "source",
        share.alias("target_share"),
        "max_repeats",
        F.coalesce("documents", F.lit(0)).alias("documents"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"),
        wanted.alias("wanted"),
        F.when(F.col("tokens") > 0, F.least(wanted / F.col("tokens"), F.coalesce(F.col("max_repeats").cast("double"), wanted))).alias("rate"),
    )


def short(rated: DataFrame) -> DataFrame:
    """Sources that stay under their share even with all documents ``max_repeats`` times."""
    most = F.col("tokens") * F.coalesce(F.col("max_repeats").cast("double"), F.lit(float("inf")))
    return rated.where(F.when(F.col("tokens") > 0, most).otherwise(0.0) < F.col("wanted"))


def mixed(counted: DataFrame, rated: DataFrame, key: str, seed: int = 7) -> DataFrame:
    """(key, source, tokens, copy): each emitted copy of a document; copies are numbered from 1."""
    chance = F.pmod(F.xxhash64(F.lit(seed), F.col("source"), F.col(key)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    copies = (F.floor("rate") + F.when(chance < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")
    return (
        counted.join(rated.select("source", "rate").where("rate > 0"), "source")
        .withColumn("copies", copies)
        .where("copies > 0")
        .select(key, "source", "tokens", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    )


def shares(mixture: DataFrame, rated: DataFrame) -> DataFrame:
    """Per named source the target and what the mixture reached."""
    got = mixture.groupBy("source").agg(F.sum("tokens").alias("mixed_tokens"), F.count("*").alias("copies"))
    whole = got.agg(F.sum("mixed_tokens").alias("t")).collect()[0]["t"] or 0
    mine = F.coalesce("mixed_tokens", F.lit(0))
    return rated.join(got, "source", "left").select(
        "source", "target_share", "max_repeats", "documents", "tokens", "rate",
        F.coalesce("copies", F.lit(0)).alias("copies"), mine.alias("mixed_tokens"),
        (mine / F.lit(float(whole)) if whole else F.lit(0.0)).alias("actual_share"),
    )

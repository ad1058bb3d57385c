"""Canonical encodings and hashes as column expressions.

Bytes are written as upper-case hex strings, which join by concatenation and turn into bytes once, before a hash: bigints
take 8 bytes, lengths 4, big-endian; strings are a length and UTF-8. All of it stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fjordlens.functions import fixed


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def be64(c: str | Column) -> Column:
    return F.lpad(F.hex(_col(c).cast("bigint")), 16, "0")


def be32(c: str | Column) -> Column:
    return F.lpad(F.hex(_col(c).cast("bigint")), 8, "0")


def flag(c: str | Column) -> Column:
    return F.when(_col(c), "01").otherwise("00")


def text(c: str | Column) -> Column:
    return F.concat(be32(F.octet_length(_col(c))), F.hex(F.encode(_col(c), "UTF-8")))


def maybe_text(c: str | Column) -> Column:
    """A presence byte, and the text if there is one."""
    return F.when(_col(c).isNull(), "00").otherwise(F.concat(F.lit("01"), text(c)))


def concept_row() -> Column:
    return F.concat(be64("Qid"), flag("InT1"), flag("InT2"))


def lexical_row() -> Column:
    return F.concat(be64("Qid"), text("Lang"), text("LexKind"), text("Value"))


def edge_row() -> Column:
    return F.concat(be64("SubjectQid"), be64("TargetQid"))


def digest(hexed: Column) -> Column:
    return F.sha2(F.unhex(hexed), 256)


def sized(count: Column, hexed: Column) -> Column:
    """Digest of a counted list of rows: count, length in bytes, bytes."""
    return digest(F.concat(be64(count), be32(F.length(hexed) / 2), hexed))


def ordinal(c: str | Column) -> Column:
    """Sort key of UTF-16 code units, in which astral characters come before U+E000 to U+FFFF."""
    return F.encode(_col(c), "UTF-16BE")


def utf16_length(c: str | Column) -> Column:
    return F.octet_length(F.encode(_col(c), "UTF-16BE")) / 2


def selector(domain: str, operation: Column, stratum: Column, identity: Column) -> Column:
    return F.concat_ws("\x1f", F.lit(domain), operation, stratum, identity)


def rank_hash(operation: str | Column, stratum: str | Column, identity: Column, domain: str) -> Column:
    """64 hex digits; their order is the order of the 256-bit hash."""
    op = F.lit(operation) if isinstance(operation, str) else operation
    st = F.lit(stratum) if isinstance(stratum, str) else stratum
    return F.sha2(selector(domain, op, st, identity), 256)


def lexical_identity(lang: str | Column, value: str | Column) -> Column:
    return F.regexp_replace(F.base64(F.unhex(F.concat(text(lang), text(value)))), "\r\n", "")  # Spark breaks lines at 76 characters


def sample_bucket(qid: str | Column) -> Column:
    """The first 64 bits of the hash modulo 1000, from two halves of 32 bits so that nothing overflows."""
    h = F.sha2(F.concat_ws("\x1f", F.lit(fixed.SAMPLE_DOMAIN), F.lit("uniform"), _col(qid).cast("string")), 256)
    high, low = (F.conv(F.substring(h, i, 8), 16, 10).cast("bigint") for i in (1, 9))
    m = fixed.SAMPLE_MODULUS
    return (high % m * ((1 << 32) % m) + low) % m


def sampled(qid: str | Column) -> Column:
    return sample_bucket(qid) < fixed.SAMPLE_BELOW

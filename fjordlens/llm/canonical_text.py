"""One consistent form for texts that look the same.

Method: compatibility normalization, deletion of characters that print nothing, every blank to a space; then each
look-alike character becomes the class of characters with its look, and the readings of a token (one character of the
class per place, from one script or another) form a lattice in which Viterbi search finds the best path under character
bigrams of the corpus and a price for each change of script. Classes are disjoint and the lattice depends on the
classes only, so tokens of the same look get the same form, and tokens of other looks never do.

Classes come from the public confusables data that the JVM's ICU library holds: all characters of one look. Case, digits
and signs are visible differences, so a look that ASCII writes in several kinds (capital, small, digit, sign) is parted by
kind, and so is one that has both capitals and small letters; ASCII characters are never joined with one another. A
class is headed by its ASCII character, or else by its smallest one. A token in which some letter has no reading outside Latin
is Latin without search; this is what the search would give, as a change of script costs more than any bigrams can.

Equality of forms is therefore equality of classes: the search cannot join or part texts, it chooses the spelling in which
the common form is written.

Defined results: null stays null; a text of blanks and ignorable characters becomes empty; blanks at the ends go, blanks
inside stay as many as they were; texts of any length are done whole.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SWITCH = 1000.0  # price of a change of script
SCRIPTS = ("LATIN", "CYRILLIC", "GREEK")  # scripts of readings
# Default-ignorable characters outside category Cf, and Cf characters that are visible.
IGNORABLE = "͏ᅟᅠ឴឵᠋᠌᠍᠏⁥ㅤﾠ"
VISIBLE_CF = "؀؁؂؃؄؅۝܏࢐࢑࣢"


def kind(c: str) -> str:
    """Capital, small, other letter, digit or sign."""
    k = unicodedata.category(c)
    return k if k in ("Lu", "Ll", "Nd") else k[0] if k[0] in "LM" else "S"


def script(c: str) -> str | None:
    return unicodedata.name(c, "").split(" ")[0] if unicodedata.category(c)[0] == "L" else None


def classes(looks: dict[str, str]) -> dict[str, str]:
    """Character to the head of its class, from each character's skeleton; heads themselves and lone characters are left out."""
    by_look: dict[str, list[str]] = {}
    for c in sorted(looks):
        by_look.setdefault(looks[c], []).append(c)
    out: dict[str, str] = {}
    for look, members in by_look.items():
        plain = [c for c in members if c.isascii()]
        kinds = {kind(c) for c in plain}
        letters = {kind(c) for c in members} & {"Lu", "Ll"}
        # what is told apart by kind within this look
        apart = len(kinds) > 1 or len(letters) > 1
        groups: dict[str, list[str]] = {}
        for c in members:
            k = kind(c)
            groups.setdefault(k if apart or k == "Nd" and kinds != {"Nd"} else "", []).append(c)
        for group in groups.values():
            own = [c for c in group if c.isascii()]
            # of several ASCII signs of one look, such as ' and `, the one that is its own skeleton stands for the others
            head = (look if look in own else own[0]) if own else group[0]
            out.update({c: head for c in group if c != head and not c.isascii()})
    return out


_heads: dict[str, str] = {}


def heads(spark: SparkSession) -> dict[str, str]:
    """Character to the head of its class, for every character that has one and is not its head."""
    if not _heads:
        checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
        every = [c for c in map(chr, range(33, sys.maxunicode + 1)) if unicodedata.category(c)[0] in "LNPS" and unicodedata.normalize("NFKD", c) == c]
        looks: dict[str, str] = {}
        for i in range(0, len(every), 1 << 15):
            part = every[i : i + (1 << 15)]
            looks.update(zip(part, checker.getSkeleton("\n".join(part)).split("\n"), strict=True))
        # hyphens and quotes that ICU keeps apart from their ASCII sign
        _heads.update(classes(looks) | {"‐": "-", "‑": "-", "‘": "'", "’": "'", "“": '"', "”": '"'})
    return _heads


class Looks:
    """What the normalizer needs on every worker: the classes and the readings of each head."""

    def __init__(self, head: dict[str, str]):
        self.head = head
        self.readings: dict[str, dict[str, str]] = {}  # head -> script -> character
        for a in sorted(set(head.values())):
            if a.isalpha() and (s := script(a)) in SCRIPTS:
                self.readings[a] = {s: a}
        for c in sorted(head):
            s = script(c)
            if s in SCRIPTS and head[c] in self.readings:
                self.readings[head[c]].setdefault(s, c)
        foreign = {s: "".join(a for a, r in self.readings.items() if s in r) for s in SCRIPTS[1:]}
        whole = "|".join(rf"(?<!\w)[{re.escape(f)}]+(?!\w)" for f in foreign.values() if f)
        #: tokens with more than one reading: all letters readable in one other script, or some letter of no class
        self.open = re.compile(rf"{whole}|[^\W\d_]*[^\W\d_\u0000-ɏḀ-ỿ][^\W\d_]*" if whole else r"(?!)")
        self.table = {ord(c): a for c, a in head.items()}
        for c in IGNORABLE:
            self.table[ord(c)] = None
        for lo, hi in ((0xAD, 0xAE), (0xFE00, 0xFE10), (0xE0000, 0xE1000)):
            self.table.update(dict.fromkeys(range(lo, hi)))
        for c in map(chr, [*range(0x600, 0x3000), 0xFEFF, *range(0xFFF0, 0xFFFC), *range(0x1BCA0, 0x1BCA4), *range(0x1D173, 0x1D17B)]):
            if unicodedata.category(c) == "Cf" and c not in VISIBLE_CF:
                self.table[ord(c)] = None
        self.blank = re.compile("[\\s  -     ⠀　\xa0\x85]")

    def plain(self, text: str) -> str:
        """Normalized, without ignorable characters, look-alikes at the heads of their classes."""
        if text.isascii():
            return self.blank.sub(" ", text).strip(" ")
        text = self.blank.sub(" ", text)
        text = unicodedata.normalize("NFKD", text).translate(self.table)
        return self.blank.sub(" ", unicodedata.normalize("NFC", text)).strip(" ")


class Model:
    """Bigrams of the characters that readings are made of, backed by how frequent a character is at all."""

    WEIGHT = 10.0

    def __init__(self, counts: dict[str, int]):
        self.pair, self.first, self.second = counts, Counter(), Counter()
        for p, n in counts.items():
            self.first[p[0]] += n
            self.second[p[1]] += n
        self.total = sum(counts.values())
        self.size = max(1, len(self.second))

    def score(self, a: str, b: str) -> float:
        alone = (self.second.get(b, 0) + 1) / (self.total + self.size)
        return math.log((self.pair.get(a + b, 0) + self.WEIGHT * alone) / (self.first.get(a, 0) + self.WEIGHT))


def best_reading(token: str, looks: Looks, model: Model) -> str:
    """Viterbi search through the readings of a token of heads; among equals the reading listed first. Linear in length."""
    ends = [(0.0, " ", None, None)]  # cost, character, script, node before
    for h in token:
        options = looks.readings.get(h)
        options = list(options.items()) if options else [(script(h), h)]
        step = []
        for s, c in options:
            costs = [e[0] - model.score(e[1], c) + (SWITCH if s and e[2] and s != e[2] else 0.0) for e in ends]
            i = costs.index(min(costs))
            step.append((costs[i], c, s or ends[i][2], ends[i]))
        ends = step
    node = min(ends, key=lambda e: e[0] - model.score(e[1], " "))
    out = []
    while node[3] is not None:
        out.append(node[1])
        node = node[3]
    return "".join(reversed(out))


def train(df: DataFrame, column: str, looks: Looks) -> dict[str, int]:
    """Bigram counts over all rows, of characters of readings and token ends only: at most the square of their number,
    whatever the size of the corpus."""
    wanted = {c for r in looks.readings.values() for c in r.values()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        keep = {ord(c): c for c in wanted}
        for b in batches:
            texts: Counter = Counter()
            for t, n in Counter(b.column(0).to_pylist()).items():
                t = unicodedata.normalize("NFKC", t)
                clean = " " + "".join(keep.get(o, " ") for o in map(ord, t)) + " "
                texts[clean] += n
            for t, n in texts.items():
                for a, c in zip(t, t[1:]):
                    seen[a + c] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.string()), pa.array(list(seen.values()), pa.int64())], ["pair", "n"])

    parts = df.select(F.col(column).alias("text")).where("text is not null").mapInArrow(run, "pair string, n bigint")
    return {r["pair"]: r["n"] for r in parts.groupBy("pair").agg(F.sum("n").alias("n")).collect()}


def normalizer(looks: Looks, counts: dict[str, int]):
    model, known = Model(counts), {}

    def reading(m: re.Match) -> str:
        token = m.group()
        if len(token) > 64:
            return best_reading(token, looks, model)
        if token not in known:
            if len(known) > 100_000:
                known.clear()
            known[token] = best_reading(token, looks, model)
        return known[token]

    return lambda text: looks.open.sub(reading, looks.plain(text))


def canonical(df: DataFrame, columns: dict[str, str], looks: Looks, counts: dict[str, int]) -> DataFrame:
    """``df`` with a canonical column for each text column: {column: new name}."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + "".join(f", `{n}` string" for n in columns.values())
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = normalizer(looks, counts)
        for b in batches:
            added = []
            for c in columns:
                coded = b.column(names.index(c)).dictionary_encode()  # a text that is repeated in a batch is done once
                forms = pa.array([form(t) for t in coded.dictionary.to_pylist()], pa.string())
                added.append(pa.DictionaryArray.from_arrays(coded.indices, forms).dictionary_decode())
            yield pa.RecordBatch.from_arrays([*b.columns, *added], [*names, *columns.values()])

    return df.mapInArrow(run, schema)


def lookalike_pairs(df: DataFrame, row: str, within: str, columns: list[str], scratch) -> DataFrame:
    """(row_id_1, row_id_2): pairs of rows with the same ``within`` whose canonical columns ``c_<column>`` are all
    equal while some column is not. Forms are made once and kept as a table. Groups with more than one spelling are found by
    hashes of 64 bits, so that only numbers are shuffled; equality within them is of the texts. Rows with a null in
    ``within`` or a column are in no pair."""
    forms = [f"c_{c}" for c in columns]
    ready = scratch.cut(df.select(row, within, *columns, *forms).dropna().withColumn("_look", F.xxhash64(*forms)))
    written = F.xxhash64(*columns)
    groups = ready.groupBy(within, "_look").agg(F.min(written).alias("lo"), F.max(written).alias("hi")).where("lo <> hi")
    odd = scratch.cut(ready.join(scratch.cut(groups.select(within, "_look")), [within, "_look"], "left_semi"))
    spelled = F.struct(*columns)
    a = odd.select(within, *forms, F.col(row).alias("row_id_1"), spelled.alias("s1"))
    b = odd.select(within, *forms, F.col(row).alias("row_id_2"), spelled.alias("s2"))
    return a.join(b, [within, *forms]).where("row_id_1 < row_id_2 and s1 <> s2").select("row_id_1", "row_id_2")

"""Per-document text statistics, their outlier scores, and documents that are no running text.

Method: the statistics know no language. What is common is learned from the corpus: the words that stand in at least
``COMMON_SHARE`` of a language's documents, and the pairs of such words that follow one another in at least ``PAIR_SHARE`` of
them. Each side of a statistic on which lists, tables and junk lie is one row (side, language, value); all rows are sorted once
by range, ranks are the position in the range plus the offset of the ranges before it, ties share the rank of the first of
them, and a value's tail probability is the share of its language's documents that are at least as extreme. A document's
score is the weighted sum of -ln(tail), at most ``CAP`` each, the larger of the one within its language and the one among all
documents. A document is reported where its score reaches ``CUT``; nothing else decides.

Weights and cut were fitted once, offline (logistic regression with weights of zero or more), on a bounded sample of
``LABELLED`` documents and nine short hand-written texts; README states the labels and the accuracy on the rest.

A hot language or value spans ranges: only per-range counts and boundary keys go to the driver, and the common words and pairs,
of which there can be no more than a few times the words of a mean document for each language.

Defined results: null and blank texts have statistics of null and no score; a null or unknown language is a group of
its own (codes are compared by their first part, in lower case); languages of few documents have no common words of their own;
common words count in whichever language fits a text best, so a wrong code does no harm; a repeated id gets the mean score
of its rows; texts of any length are read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fjordlens.plans.runtime import Scratch

COMMON_SHARE, PAIR_SHARE, PRIOR = 0.4, 0.003, 20  # shares of a language's documents, counted as 20 more than there are
SENTENCE = 4  # words of the shortest sentence
CAP = 5.0
LABELLED = 1000
CUT = 12.61
#: side of a statistic -> weight; '+' is the upper tail, '-' the lower one
WEIGHTS = {
    "mean_word_length+": 0.92, "mean_word_length-": 0.86, "symbol_ratio+": 0.32, "digit_ratio+": 0.55, "line_end_ratio-": 0.46,
    "words_per_line-": 0.83, "common_ratio+": 0.24, "common_ratio-": 1.01, "odd_pair_ratio+": 0.86, "sentence_ratio-": 0.88,
    "sentence_words+": 2.47, "sentence_words-": 1.04,
}

LETTERS = re.compile(r"[^\W\d_]+")
WORD = re.compile(r"[^\W_]+")
BULLET = re.compile(r"\s*(?:[-*•·–]|\d+[.)])\s+")
QUOTED = re.compile(r"(?:>\s*)+")
CLOSE = "\"'»”’)]"
SPLIT = re.compile(rf"(?<=[.!?…])[{re.escape(CLOSE)}]*\s+")

STATS = (
    "words", "mean_word_length", "symbol_ratio", "digit_ratio", "line_end_ratio", "words_per_line", "common_ratio", "odd_pair_ratio",
    "sentence_ratio", "sentence_words", "distinct_ratio",
)
EVERY = "-"  # all documents as one group; a code is cut at its first hyphen, so none is called so
SCHEMA = ", ".join(f"{s} double" for s in STATS)


def _ends(s: str) -> bool:
    s = s.rstrip(CLOSE)
    return bool(s) and s[-1] in ".!?…"


def blocks(text: str) -> Iterator[str]:
    """Lines put back together where a sentence may be wrapped, at any width; list items and table rows stay by
    themselves. Lines of a list without marks are joined too, but then hold no sentence end."""
    held: list[str] = []
    before = ""
    for line in text.split("\n"):
        line = line.strip()
        if line.startswith(">"):
            line = QUOTED.sub("", line, count=1)
        if not line:
            if held:
                yield " ".join(held)
            held, before = [], ""
            continue
        bullet = BULLET.match(line)
        goes_on = before and not bullet and not any(x in before or x in line for x in "|\t")
        if held and not goes_on:
            yield " ".join(held)
            held = []
        held.append(line[bullet.end() :] if bullet else line)
        before = line
    if held:
        yield " ".join(held)


class Usage:
    """What is common in a corpus: words with the languages they are common in, and pairs of them that follow one another."""

    def __init__(self, words: dict[str, tuple[str, ...]], pairs: set[tuple[str, str]] = frozenset()):
        self.words, self.pairs = words, pairs


def statistics(text: str, usage: Usage) -> tuple[float, ...]:
    """The values of STATS for a text that is not blank. ``sentence_ratio`` is the share of words in stretches that end like a
    sentence, ``sentence_words`` the length of the stretch in which the middle word stands when stretches are laid out by
    length, ``odd_pair_ratio`` the share of word pairs that are both common but do not commonly follow one another."""
    total = running = 0
    lengths, found = [], []
    for block in blocks(text.lower()):
        for piece in SPLIT.split(block):
            w = WORD.findall(piece)
            if w:
                n = len(w)
                total += n
                lengths.append(n)
                found += w
                if n >= SENTENCE and _ends(piece):
                    running += n
    letters, in_language = sum(map(len, found)), Counter()
    known, pairs = usage.words, usage.pairs
    for at, n in Counter(map(known.get, found)).items():
        for lang in at or ():
            in_language[lang] += n
    odd = sum(1 for x in zip(found, found[1:]) if x[0] in known and x[1] in known and x not in pairs)
    middle, upto = 0, 0
    for n in sorted(lengths):
        upto += n
        if 2 * upto >= total:
            middle = n
            break
    lines = [x for x in text.split("\n") if x.strip()]
    shown = len("".join(text.split()))
    digits = sum(map(text.count, "0123456789"))
    return (
        float(total),
        letters / len(found) if found else 0.0,
        1 - letters / shown if shown else 0.0,
        digits / shown if shown else 0.0,
        sum(_ends(x.rstrip()) for x in lines) / len(lines) if lines else 0.0,
        total / len(lines) if lines else 0.0,
        max(in_language.values(), default=0) / len(found) if found else 0.0,
        odd / (len(found) - 1) if len(found) > 1 else 0.0,
        running / total if total else 0.0,
        float(middle),
        len(set(found)) / len(found) if found else 0.0,
    )


def _counted(df: DataFrame, text: str, of, schema: str, keys: list[str]) -> DataFrame:
    """(lang, keys..., n): how many documents of each language have what ``of`` finds in them. Each task adds up its own first, in
    bounded memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        held = 0

        def out() -> pa.RecordBatch:
            flat = [(lang, *k) for lang, c in seen.items() for k in (c if len(keys) > 1 else zip(c))]
            columns = [pa.array([k[i] for k in flat], pa.string()) for i in range(len(keys) + 1)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([n for c in seen.values() for n in c.values()], pa.int64())], ["lang", *keys, "n"])

        for b in batches:
            for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t and t.strip():
                    c = seen.setdefault(lang, Counter())
                    held -= len(c)
                    c.update(of(t))
                    held += len(c)
            if held > 500_000:
                yield out()
                seen, held = {}, 0
        yield out()

    return df.select("lang", text).mapInArrow(run, schema).groupBy("lang", *keys).agg(F.sum("n").alias("n"))


def learn(df: DataFrame, text: str, scratch: Scratch) -> Usage:
    """The common words and pairs of the corpus, from all documents of ``df`` (lang, text)."""
    counts = scratch.cut(_counted(df, text, lambda t: {"", *LETTERS.findall(t.lower())}, "lang string, word string, n bigint", ["word"]))
    of_lang = counts.where("word = ''").select("lang", (F.col("n") + PRIOR).alias("documents"))
    common = counts.where("word <> ''").join(of_lang, "lang").where(F.col("n") >= COMMON_SHARE * F.col("documents")).select("lang", "word").collect()
    words: dict[str, tuple[str, ...]] = {}
    for r in common:
        words[r["word"]] = (*words.get(r["word"], ()), r["lang"])
    known = frozenset(words)

    def pairs(t: str) -> set[tuple[str, str]]:
        found = WORD.findall(t.lower())
        return {x for x in zip(found, found[1:]) if x[0] in known and x[1] in known}

    if not known:
        return Usage(words)
    follow = _counted(df, text, pairs, "lang string, a string, b string, n bigint", ["a", "b"])
    usual = follow.join(of_lang, "lang").where(F.col("n") >= PAIR_SHARE * F.col("documents")).select("a", "b").distinct().collect()
    return Usage(words, {(r["a"], r["b"]) for r in usual})


def with_statistics(df: DataFrame, text: str, keep: list[str], usage: Usage) -> DataFrame:
    """The columns ``keep`` and one column for each of STATS."""
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = (None,) * len(STATS)
        for b in batches:
            rows = [statistics(t, usage) if t and t.strip() else nothing for t in b.column(b.num_columns - 1).to_pylist()]
            cols = [pa.array(c, pa.float64()) for c in zip(*rows)] if rows else [pa.array([], pa.float64())] * len(STATS)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], [*keep, *STATS])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", " + SCHEMA
    return df.select(*keep, text).mapInArrow(run, schema)


def language(column: str) -> Column:
    """The first part of a code in lower case, three-letter and older codes by their usual two letters; '' for none."""
    first = F.lower(F.split(F.trim(F.coalesce(column, F.lit(""))), "[-_]")[0])
    return F.when(first == "eng", "en").when(first.isin("no", "nor", "nob", "nn"), "nb").otherwise(first)


#: the least that a side can be, where a share has one: there its tail is 1, whatever the corpus
LEAST = {"symbol_ratio+": 0.0, "digit_ratio+": 0.0, "common_ratio+": 0.0, "odd_pair_ratio+": 0.0, "line_end_ratio-": -1.0, "common_ratio-": -1.0, "sentence_ratio-": -1.0}


def oddities(stats: DataFrame, key: str) -> DataFrame:
    """(key, lang, stat, value) for each side of a statistic, high where extreme; ``stat`` is its place in WEIGHTS. Rows at the
    least that a share can be are left out: they add nothing to a score, and ranks are counted from above."""
    pairs = []
    for i, side in enumerate(WEIGHTS):
        value = F.col(side[:-1]) if side[-1] == "+" else -F.col(side[:-1])
        pair = F.struct(F.lit(i).cast("tinyint").alias("stat"), value.alias("value"))
        pairs.append(F.when(value > LEAST[side], pair) if side in LEAST else pair)
    made = F.explode(F.array_compact(F.array(*pairs)))
    return stats.where("words is not null").select(key, "lang", made.alias("_p")).select(key, "lang", "_p.stat", "_p.value")


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the range's number and, within the range, where a row's ties and its group begin."""
    part, n, last = TaskContext.get().partitionId(), 0, (None, None, None, 0, 0)
    for b in batches:
        stat, lang = b["stat"].to_numpy(zero_copy_only=False), b["lang"].to_numpy(zero_copy_only=False)
        value = b["value"].to_numpy(zero_copy_only=False)
        if not len(value):
            continue
        same_group = np.empty(len(value), bool)
        same_group[1:] = (stat[1:] == stat[:-1]) & (lang[1:] == lang[:-1])
        same_group[0] = last[0] == stat[0] and last[1] == lang[0]
        same_tie = same_group.copy()
        same_tie[1:] &= value[1:] == value[:-1]
        same_tie[0] &= last[2] == value[0]
        pos = np.arange(n, n + len(value))
        tie = np.maximum.accumulate(np.where(same_tie, last[3], pos))
        group = np.maximum.accumulate(np.where(same_group, last[4], pos))
        n += len(value)
        last = (stat[-1], lang[-1], value[-1], int(tie[-1]), int(group[-1]))
        yield pa.RecordBatch.from_arrays(
            [*b.columns, pa.array(np.full(len(value), part, np.int32)), pa.array(pos), pa.array(tie), pa.array(group)],
            [*b.schema.names, "part", "pos", "tie", "grp"],
        )


def tail_probabilities(rows: DataFrame, key: str, scratch: Scratch, documents: DataFrame | None = None) -> DataFrame:
    """``rows`` (key, lang, stat, value) with ``tail``: the exact share of the rows of its lang and stat with a value of
    at least its own. Where rows of lowest value were left out, ``documents`` (lang, size) says how many there are. Group sizes are a table of their own, whose size decides whether the planner broadcasts it; where it
    does not, AQE splits a hot group."""
    order = ["stat", "lang", "value", key]
    kind = dict(rows.dtypes)[key]
    schema = f"`{key}` {kind}, lang string, stat tinyint, value double, part int, pos bigint, tie bigint, grp bigint"
    laid = scratch.cut(
        rows.select(key, "lang", "stat", "value").repartitionByRange(*order).sortWithinPartitions(*order)
        .mapInArrow(_starts, schema)
    )
    where = F.struct("stat", "lang", "value")
    ends = laid.groupBy("part").agg(
        F.count("*").alias("n"), F.min(where).alias("first"), F.max(where).alias("last"),
        F.max_by("tie", "pos").alias("tie"), F.max_by("grp", "pos").alias("grp"),
    ).orderBy("part").collect()  # one row per range
    fixed, offset, tie_from, group_from, before = [], 0, 0, 0, None
    for r in ends:
        first, last = tuple(r["first"]), tuple(r["last"])
        if before is None or first != before:
            tie_from = offset
        if before is None or first[:2] != before[:2]:
            group_from = offset
        fixed.append((r["part"], offset, tie_from, group_from))
        tie_from = tie_from if r["tie"] == 0 else offset + r["tie"]
        group_from = group_from if r["grp"] == 0 else offset + r["grp"]
        offset, before = offset + r["n"], last
    starts = laid.sparkSession.createDataFrame(fixed, "part int, off bigint, tie0 bigint, grp0 bigint")
    sizes = laid.groupBy("stat", "lang").agg(F.count("*").alias("kept"))
    sizes = scratch.cut(sizes.withColumn("size", F.col("kept")) if documents is None else sizes.join(documents, "lang"))
    tie = F.when(F.col("tie") == 0, F.col("tie0")).otherwise(F.col("off") + F.col("tie"))
    group = F.when(F.col("grp") == 0, F.col("grp0")).otherwise(F.col("off") + F.col("grp"))
    return (
        laid.join(F.broadcast(starts), "part")  # one row per range
        .withColumn("below", tie - group)
        .join(sizes, ["stat", "lang"])
        .select(key, "lang", "stat", "value", ((F.col("kept") - F.col("below")) / F.col("size")).alias("tail"))
    )


def scored(stats: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """(key, score): the weighted sum of -ln(tail) over the sides of WEIGHTS, among the documents of its language or among all,
    whichever is larger: a group of few or mostly odd documents does not hide its members."""
    rows = oddities(stats, key)
    size = stats.where("words is not null").groupBy("lang").agg(F.count("*").alias("size"))
    every = size.agg(F.sum("size").alias("size")).select(F.lit(EVERY).alias("lang"), "size")
    tails = tail_probabilities(rows.unionByName(rows.withColumn("lang", F.lit(EVERY))), key, scratch, size.unionByName(every))
    weight = reduce(lambda e, x: e.when(F.col("stat") == x[0], x[1]), list(enumerate(WEIGHTS.values()))[1:], F.when(F.col("stat") == 0, list(WEIGHTS.values())[0]))
    part = weight * F.least(-F.ln("tail"), F.lit(CAP))
    two = tails.groupBy(key, (F.col("lang") == EVERY).alias("of_all")).agg((F.sum(part) / F.count_if(F.col("stat") == 0)).alias("score"))
    return two.groupBy(key).agg(F.max("score").alias("score"))

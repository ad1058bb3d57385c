import random
import time

import pytest
from pyspark.sql import functions as F

from fjordlens.llm import canonical_text as ct
from fjordlens.llm import contamination as cn
from fjordlens.llm import mixing, text_quality
from fjordlens.plans.runtime import Scratch

# ---- canonical text ----
SAME = [
    ("Old mill", "Old　mill"), ("Old mill", "Old mill "), ("Old mill", "O​ld m⁠ill"), ("Old mill", "Ｏｌｄ　ｍｉｌｌ"),
    ("Old mill", "Οld mіll"), ("Blåfjé", "Blåfjé"), ("VII", "Ⅶ"), ("III", "IIΙ"), ("a-b", "a‑b"), ("Parent 3", "Рarеnt ３"),
    ("K", "K"), ("cop", "сор"), ("", " ​　"), ("жар", "жap"),
]
UNLIKE = [("I", "l"), ("I", "1"), ("|", "l"), ("O", "0"), ("o", "0"), ("Π", "π"), ("'", "`"), ("ø", "o"), ("Æ", "æ"), ("B", "ß"), ("Old mill", "old mill"), ("Blå", "Bla"), ("a-b", "a b"), ("a-b", "ab"), ("x1", "x2"), ("x1", "xl"), ("mill", "mille"), ("O0", "OO"), ("é", "e")]


@pytest.fixture(scope="module")
def form(spark):
    looks = ct.Looks(ct.heads(spark))
    counts = ct.train(spark.createDataFrame([("Old mill copper",), ("жар пар",), (None,)], "v string"), "v", looks)
    return ct.normalizer(looks, counts)


@pytest.mark.parametrize("a,b", SAME)
def test_same_look(form, a, b):
    assert form(a) == form(b)


@pytest.mark.parametrize("a,b", UNLIKE)
def test_other_look(form, a, b):
    assert form(a) != form(b)


def test_forms_are_readable_and_stable(form):
    assert form("Οld mіll") == "Old mill" and form("жap") == "жар"
    for a, b in SAME:
        assert form(form(b)) == form(b)


def test_long_text(form):
    began = time.time()
    assert len(form("жар" * 100_000 + " Ｏｌｄ" * 100_000)) == 700_000
    assert time.time() - began < 60


def test_pairs(spark):
    rows = [
        (1, 5, "en", "Old mill", "x"), (2, 5, "еn", "Old mill", None), (3, 5, "en", "Οld mill", None), (4, 5, "en", "Old mill", None), (5, 6, "en", "Οld mill", None),
        (6, 5, "nb", "Οld mill", None), (7, 5, "en", None, None), (8, 5, "en", None, None), (9, None, "en", "Old mill", None), (10, 7, "en", "", None), (11, 7, "en", "​", None),
    ]
    df = spark.createDataFrame(rows, "id bigint, q bigint, lang string, v string, c_x string")
    looks = ct.Looks(ct.heads(spark))
    named = ct.canonical(df, {"lang": "c_lang", "v": "c_v"}, looks, ct.train(df, "v", looks))
    got = ct.lookalike_pairs(named, "id", "q", ["lang", "v"], Scratch(spark, "t"))
    assert {tuple(r) for r in got.collect()} == {(1, 2), (1, 3), (2, 3), (2, 4), (3, 4), (10, 11)}
    none = ct.canonical(df.limit(0), {"lang": "c_lang", "v": "c_v"}, looks, {})
    assert ct.lookalike_pairs(none, "id", "q", ["lang", "v"], Scratch(spark, "t")).count() == 0


# ---- contamination ----
def passages(n, seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(1, 9)))
    return [(i, " ".join(word() for _ in range(r.randrange(10, 60)))) for i in range(n)]


def brute(docs, items):
    out = set()
    for i, p in items:
        w = cn.words(p or "")
        grams = {tuple(w[a : a + 13]) for a in range(len(w) - 12)}
        for d, t in docs:
            x = cn.words(t or "")
            if any(tuple(x[a : a + 13]) in grams for a in range(len(x) - 12)):
                out.add((d, i))
    return out


def found(spark, docs, items, **how):
    a = spark.createDataFrame(docs, "doc bigint, text string")
    b = spark.createDataFrame(items, "item bigint, text string")
    return cn.regions(a, "doc", "text", b, "item", "text", **how).collect()


def test_against_brute_force(spark, monkeypatch):
    items = passages(30) + [(98, None), (99, "too short")]
    items.append((100, items[3][1]))  # a repeated passage
    r = random.Random(7)
    docs = []
    for d in range(150):
        i, p = items[r.randrange(30)]
        w = p.split()
        k = r.randrange(5, 20)
        a = r.randrange(max(1, len(w) - k))
        part = ", ".join(w[a : a + k]).upper() if d % 2 else "\n> ".join(w[a : a + k])
        docs.append((d, " ".join(x for _, x in passages(2, d + 50)) + "! " + part + " (" + passages(1, d + 900)[0][1]))
    docs += [(500, None), (501, ""), (502, " ".join([items[0][1]] * 400)), (None, items[1][1])]
    want = brute(docs, items)
    assert len(want) > 20
    assert {(r.doc, r.item) for r in found(spark, docs, items) if r.run >= 13} == want
    monkeypatch.setattr(cn, "BLOCK_CHARS", 500)  # many blocks
    assert {(r.doc, r.item) for r in found(spark, docs, items) if r.run >= 13} == want


def test_edits_within_budget(spark):
    (item,) = passages(1, 4)
    w = item[1].split()
    typo = " ".join([*w[:6], w[6] + "z", *w[7:]])
    got = found(spark, [(1, typo), (2, " ".join(reversed(w)))], [item], edits=2, q=8)
    assert [r.doc for r in got] == [1]


def test_a_passage_finds_the_same_whatever_it_is_searched_with(spark, monkeypatch):
    """A passage of one-letter words asks for a small q; it must not change what others find."""
    items = passages(12, 5)
    r = random.Random(3)
    docs = []
    for d in range(80):
        w = items[r.randrange(12)][1].split()[: r.randrange(12, 40)]
        w[r.randrange(len(w))] += "z"
        docs.append((d, " ".join([*passages(1, d + 70)[0][1].split(), *w])))
    short = (900, "a b c d e f g h i j k l m n")
    docs.append((99, "x " + short[1] + " y"))
    alone = {tuple(x) for x in found(spark, docs, items)}
    both = {tuple(x) for x in found(spark, docs, [*items, short])}
    assert alone and {x for x in both if x[1] != 900} == alone and (99, 900) in {x[:2] for x in both}
    monkeypatch.setattr(cn, "BLOCK_CHARS", 300)
    assert {tuple(x) for x in found(spark, docs, [short, *items])} == both


def test_empty_tables(spark):
    assert found(spark, [], passages(2)) == []
    assert found(spark, passages(2), []) == []


# ---- mixing ----
def test_mixing(spark):
    docs = [(i, "big" if i % 3 else "small", 10) for i in range(3000)] + [(9000, None, 500), (9001, "other", 100), (9002, "big", 0), (9003, "big", None)]
    counted = spark.createDataFrame(docs, "doc bigint, source string, tokens bigint").repartition(5)
    targets = spark.createDataFrame([("big", 0.5, 3, 1), ("small", 0.4, 1, 1), ("absent", 0.1, 5, 1), ("odd", None, None, 1)], "source string, target_share double, max_repeats int, tokens int")
    rated = mixing.rates(counted, targets)
    by = {r.source: r for r in rated.collect()}
    total = sum(t or 0 for _, _, t in docs)
    assert abs(by["big"].rate - 0.5 * total / 20_000) < 1e-9 and by["small"].rate == 1.0 and by["absent"].rate is None
    assert {r.source for r in mixing.short(rated).collect()} == {"small", "absent"}
    mix = mixing.mixed(counted, rated, "doc")
    again = mixing.mixed(counted.repartition(2), rated, "doc")
    assert sorted(map(tuple, mix.collect()), key=str) == sorted(map(tuple, again.collect()), key=str)
    assert mix.where("source = 'small'").groupBy("doc").count().where("count > 1").count() == 0
    shares = {r.source: r for r in mixing.shares(mix, rated).collect()}
    assert abs(sum(r.actual_share for r in shares.values()) - 1) < 1e-9
    assert abs(shares["big"].mixed_tokens - 0.5 * total) < 0.1 * total
    assert mixing.shares(mixing.mixed(counted.limit(0), mixing.rates(counted.limit(0), targets), "doc"), mixing.rates(counted.limit(0), targets)).count() == 4


def test_tokens_of_whole_texts(spark):
    import tiktoken  # noqa: F401

    long = "word and more " * 50_000
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (4, long), (None, "x")], "doc bigint, text string")
    got = {r.doc: r.tokens for r in mixing.with_tokens(df, "text", ["doc"]).collect()}
    assert (got[1], got[2], got[3], got[None]) == (2, 0, 0, 1)
    assert got[4] == len(mixing.encoder(mixing.VOCABULARY).encode_ordinary(long)) > 100_000


# ---- quality ----
# Prose in languages of few or no other documents, or without the corpus's common words. The first six fitted the weights.
FOREIGN = [
    ('de', 'Die Forscher haben im vergangenen Jahr die Brücke über den Fluss untersucht und dabei festgestellt, dass der Beton nicht mehr sicher ist. Deshalb wird der Verkehr jetzt umgeleitet. Niemand weiß, wie lange die Arbeiten dauern werden.'),
    ('fr', "Les chercheurs ont mesuré la température de la mer pendant trois ans. Ils ont découvert que l'eau est plus chaude au printemps. Personne ne sait encore pourquoi les poissons quittent la côte."),
    ('sv', 'Forskarna undersökte den gamla bron under hela sommaren. De fann att stenarna hade flyttats av isen. Ingen vet varför vattnet stiger så snabbt på våren.'),
    ('en', 'Researchers measured neutrino oscillation parameters using underground detectors. Cosmic radiation produces muons continuously. Scintillator panels surrounding detectors identify background events precisely.'),
    ('en', 'Gradient descent minimizes differentiable objective functions iteratively. Momentum accumulates previous updates, accelerating convergence. Adaptive methods rescale individual parameters automatically, improving robustness considerably.'),
    ('es', 'El ayuntamiento decidió cerrar la biblioteca durante el invierno porque la calefacción ya no funciona. Los vecinos protestaron en la plaza. Nadie sabe cuándo volverá a abrir.'),
    ('de', 'Am frühen Morgen lag noch Nebel über den Feldern, und die Bauern warteten auf den Regen. Der Wetterbericht hatte ein Gewitter angekündigt. Am Ende blieb es trocken, und die Ernte begann einen Tag später.'),
    ('fr', "Le vieux pont traverse la rivière depuis deux siècles. La mairie voudrait le réparer avant l'hiver, mais les travaux coûtent trop cher. On attend donc une décision du conseil."),
    ('sv', 'Biblioteket stängdes i förra veckan eftersom taket läckte. Böckerna flyttades till skolan. Kommunen hoppas att allt ska vara klart innan jul.'),
    ('en', 'Enzymes catalyze biochemical reactions, lowering activation energy substantially. Substrate concentration influences reaction velocity. Competitive inhibitors occupy active sites temporarily, reducing catalytic efficiency.'),
    ('en', 'Compilers translate source programs, optimizing intermediate representations aggressively. Register allocation assigns variables efficiently. Instruction scheduling hides pipeline latency, exploiting available parallelism.'),
    ('nl', 'De oude molen werd vorig jaar verplaatst omdat de rivier steeds hoger kwam te staan. Niemand had verwacht dat het zo snel zou gaan. Nu zoekt het dorp een nieuwe plek voor de markt.'),
]
# Common words in no order, with full stops. The first three fitted the weights.
SALAD = [
    ('en', 'The of and to in. A the is of that it. And or but not with from the at. To the of a in is was it by.'),
    ('en', 'of the and it was. to in that is for on. with as at by the or. an be this had not are but from.'),
    ('nb', 'Og i det som en av. Den til er på de for at. Med ikke har så men om. Var et fra vi kan eller når.'),
    ('en', 'It the for a with and. That of to in the is at. By from as not or was. The a an of to it be this.'),
    ('en', 'and the of to a. in is it that was for. on with as at by. from or had not are this but be an.'),
    ('nb', 'På er den det og i. Av til en som for. Ikke med at har de var. Om men så et fra ved når eller.'),
]
PROSE = [
    "The mill was moved before the harbour had been counted. It is not clear who wrote that the class was lost.",
    "> The mill was moved before the harbour had\n> been counted. It is not clear who wrote\n> that the class was lost.",
    "the mill was moved before the harbour was counted. it is not clear who wrote it.",
    "THE MILL WAS MOVED BEFORE THE HARBOUR HAD BEEN COUNTED.",
    "Both of them are in the valley, and none of the rows was lost.\n- mill\n- harbour\nThe rest of it was kept as it had been for most of the years.",
    "Det er ikke klart om hagen eller gruppen ble forklart først. «En måling uten rot er ikke en feil.»",
]
JUNK = [
    "- mill\n- harbour\n- late valley\n- class 7", "mill; harbour; late valley; class 7; row", "| a | 3 |\n|---|---|\n| b | 4 |", "16:21:53 [info] scan rows=510498 wall=0.84\n07:02:02 [warn] load rows=993",
    '{"seq": 3, "op": "S4", "value": "mill"}\n{"seq": 4, "op": "S5", "value": "row"}', "4gC+/VjvjTzG2RcIqQvJnk9xzHZ7X55pMYJ", "#&& $}!$| =$=& #=<&", "From the edge to Nysshi\nOn the plain row and the mill\nThe tier of Vinros",
    "the at to the lookup from was loop at at this was reader canal", "Record.\nPelnelton child;\nOrchard 78;", "It is a mill of the valley.\n1. late mill\n2. harbour\n3. valley 7\n4. row\n5. class\n6. degree\n7. alias\n8. tier",
]




@pytest.fixture(scope="module")
def judged(spark):
    """The texts above put into the documents of sf0.01: (language, text) to whether it is reported."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    own = [*FOREIGN, *SALAD, *(("en" if t.isascii() else "nb", t) for t in PROSE + JUNK)]
    more = spark.createDataFrame([(-1 - i, t, lang) for i, (lang, t) in enumerate(own)], "doc_id bigint, text string, lang string")
    every, scratch = docs.unionByName(more).withColumn("lang", text_quality.language("lang")), Scratch(spark, "t")
    stats = scratch.cut(text_quality.with_statistics(every, "text", ["doc_id", "lang"], text_quality.learn(every, "text", scratch)))
    scores = text_quality.scored(stats, "doc_id", scratch).where("doc_id < 0").collect()
    return {own[-1 - r.doc_id]: r.score >= text_quality.CUT for r in scores}


def test_prose_of_any_language_is_kept_and_salad_reported(judged):
    assert [x for x in FOREIGN if judged[x]] == []
    assert [x for x in SALAD if not judged[x]] == []


def test_accuracy_on_texts_of_the_kinds(judged):
    """Texts written for the rules of an earlier version, many of them shorter than any document: most come out right."""
    prose, junk = ([judged["en" if t.isascii() else "nb", t] for t in kind] for kind in (PROSE, JUNK))
    assert sum(prose) <= 1 and sum(junk) >= len(junk) - 2


def test_common_words_and_pairs_are_learned(spark):
    rows = [(f"the cat {i} sat on the mat{chr(97 + i % 20)}x", "en") for i in range(40)] + [("le chat", "fr")] * 3 + [(None, "en"), (" ", "en")]
    usage = text_quality.learn(spark.createDataFrame(rows, "text string, lang string").repartition(3), "text", Scratch(spark, "t"))
    assert usage.words == {w: ("en",) for w in ("the", "cat", "sat", "on")}
    assert usage.pairs == {("the", "cat"), ("sat", "on"), ("on", "the")}
    got = dict(zip(text_quality.STATS, text_quality.statistics("On the cat: the on.\nA dog sat there. Why not?", usage)))
    assert (got["words"], got["line_end_ratio"], got["sentence_ratio"], got["sentence_words"]) == (11.0, 1.0, 9 / 11, 4.0)  # stretches of 2, 4 and 5 words
    assert (got["common_ratio"], got["odd_pair_ratio"], got["distinct_ratio"]) == (6 / 11, 2 / 10, 9 / 11)


def test_tails_against_brute_force(spark):
    r = random.Random(2)
    rows = [(i, r.choice(["en", "en", "en", "nb", ""]), r.choice([0, 1]), r.choice([0.0, 1.0, float(r.randrange(50))])) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc bigint, lang string, stat int, value double").withColumn("stat", F.col("stat").cast("tinyint"))
    for parts in ("1", "9"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {t.doc: t.tail for t in text_quality.tail_probabilities(df, "doc", Scratch(spark, "t")).collect()}
        for d, lang, stat, v in rows[::17]:
            same = [x[3] for x in rows if x[1:3] == (lang, stat)]
            assert abs(got[d] - sum(x >= v for x in same) / len(same)) < 1e-12
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_rows_of_the_least_value_are_not_needed(spark):
    r = random.Random(4)
    rows = [(i, r.choice(["en", "nb"]), 0, max(0.0, r.random() - 0.6)) for i in range(500)]
    df = spark.createDataFrame(rows, "doc bigint, lang string, stat int, value double").withColumn("stat", F.col("stat").cast("tinyint"))
    size = df.groupBy("lang").agg(F.count("*").alias("size"))
    whole = {t.doc: t.tail for t in text_quality.tail_probabilities(df, "doc", Scratch(spark, "t")).collect()}
    part = {t.doc: t.tail for t in text_quality.tail_probabilities(df.where("value > 0"), "doc", Scratch(spark, "t"), size).collect()}
    assert 0 < len(part) < 300 and all(abs(whole[d] - t) < 1e-12 for d, t in part.items())
    assert all(abs(t - 1) < 1e-12 for d, t in whole.items() if d not in part)


def test_odd_documents(spark):
    rows = [(1, "en", PROSE[0]), (2, None, None), (3, "EN-gb", " \n "), (4, "no", JUNK[0]), (4, "no", JUNK[0]), (5, "eng", "x" * 500_000), (6, "en", "​"), (None, "en", PROSE[1])]
    df = spark.createDataFrame(rows, "doc bigint, lang string, text string").withColumn("lang", text_quality.language("lang"))
    usage = text_quality.learn(df, "text", Scratch(spark, "t"))
    stats = text_quality.with_statistics(df, "text", ["doc", "lang"], usage)
    got = {r.doc: r for r in stats.collect()}
    assert got[2].words is None and got[3].words is None and got[6].words == 0 and got[4].lang == "nb" and got[5].lang == "en"
    scores = {r.doc: r.score for r in text_quality.scored(stats, "doc", Scratch(spark, "t")).collect()}
    assert set(scores) == {1, 4, 5, 6, None} and all(s >= 0 for s in scores.values())
    none = text_quality.with_statistics(df.limit(0), "text", ["doc", "lang"], text_quality.learn(df.limit(0), "text", Scratch(spark, "t")))
    assert text_quality.scored(none, "doc", Scratch(spark, "t")).count() == 0


def test_a_group_of_odd_documents_hides_none(spark):
    rows = [(i, "en", PROSE[i % len(PROSE)] + f" It was kept {i}.") for i in range(60)] + [(100, "xx", JUNK[0])] + [(200 + i, "yy", JUNK[1]) for i in range(4)]
    df = spark.createDataFrame(rows, "doc bigint, lang string, text string")
    stats = text_quality.with_statistics(df, "text", ["doc", "lang"], text_quality.learn(df, "text", Scratch(spark, "t")))
    scores = {r.doc: r.score for r in text_quality.scored(stats, "doc", Scratch(spark, "t")).collect()}
    assert min(scores[d] for d in (100, 200, 201, 202, 203)) > max(scores[i] for i in range(60))

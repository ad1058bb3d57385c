import random

import pytest
from pyspark.sql import functions as F

from fjordlens.functions import prime61 as field
from fjordlens.operators import set_reconcile
from fjordlens.plans.runtime import Scratch

SCHEMA = "kind string, id bigint, hash string, bucket bigint, extra string"


def brute(main, copy):
    out = set()
    a, b = {}, {}
    for side, rows in ((a, main), (b, copy)):
        for r in rows:
            side.setdefault(r[:2], set()).add(r[2:4])
    for k in a.keys() | b.keys():
        if k not in b:
            out.add((*k, "only_main"))
        elif k not in a:
            out.add((*k, "only_copy"))
        elif a[k] != b[k]:
            for x in a[k] - b[k]:
                for y in b[k] - a[k]:
                    out |= {(*k, n) for i, n in enumerate(("hash", "bucket")) if x[i] != y[i]}
    return out


def run(spark, main, copy):
    frames = [spark.createDataFrame([(*r, f"{i}{r}") for r in rows], SCHEMA) for i, rows in enumerate((main, copy))]
    out = set_reconcile.differences(*frames, "kind", "id", ["hash", "bucket"], Scratch(spark, "t"))
    rows = [tuple(r) for r in out.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("seed", range(3))
def test_random_differences(spark, seed):
    r = random.Random(seed)
    main = [(k, i, f"v{i}", r.choice([None, i])) for k in ("a", "b") for i in range(0, 4000, 3)]
    copy = list(main)
    for _ in range(60):
        copy.pop(r.randrange(len(copy)))
    for _ in range(60):
        i = r.randrange(len(copy))
        k, n, v, w = copy[i]
        copy[i] = (k, n, r.choice([v, "", None, v + "x"]), r.choice([w, 7]))
    copy += [("a", 10_001 + i, "new", 1) for i in range(20)] + [("unknown", 1, None, None)]
    r.shuffle(copy)
    assert run(spark, main, copy) == brute(main, copy)


def test_block_that_differs_wholly(spark):
    """Needs the bound doubled, and buckets split beyond it."""
    main = [("a", i, "v", i) for i in range(3000)]
    copy = [(k, i, "w" if 500 <= i < 1800 else v, n) for k, i, v, n in main if not 2000 <= i < 2100]
    assert run(spark, main, copy) == brute(main, copy)


def test_rows_repeated_and_keys_that_hold_a_third(spark):
    """One row is thousands of times on one side only, and one key stands for thousands of unlike rows."""
    main = [("a", i, "v", i) for i in range(1500)]
    copy = main + [("a", 7, "v", 7)] * 3000 + [("b", 5, "new", 0)] * 3000 + [("c", 5, f"w{i}", 0) for i in range(3000)]
    main = main + [("c", 5, f"w{i}", 0) for i in range(0, 3000, 2)]
    frames = [spark.createDataFrame([(*r, "") for r in rows], SCHEMA) for rows in (main, copy)]
    hashed = None
    for side, df in enumerate(frames):
        part = df.select(F.col("id").alias("bucket"), F.lit(side).cast("tinyint").alias("side"), set_reconcile.row_hash(["kind", "id", "hash", "bucket"]).alias("hash"), F.col("hash").alias("v"))
        hashed = part if hashed is None else hashed.unionByName(part)
    want = {(r.bucket, r.hash) for r in hashed.groupBy("bucket", "hash").agg(F.sum(F.when(F.col("side") == 0, 1).otherwise(-1)).alias("m")).where("m <> 0").collect()}
    got = set_reconcile.differing_hashes(hashed.select("bucket", "side", "hash"), Scratch(spark, "t"))
    assert {tuple(r) for r in got.collect()} == want and len(want) == 1502
    assert run(spark, main, copy) == {("b", 5, "only_copy"), ("c", 5, "only_copy")}


def test_nulls_repeats_and_long_texts(spark):
    main = [("a", 1, None, None), ("a", 2, "", 5), ("a", 3, "x" * 200_000, 1), ("a", 4, "v", 1), ("a", 4, "v", 1), ("a", 5, "v", 1), ("a", 5, "w", 1), (None, 9, "n", 1)]
    copy = [("a", 1, "", None), ("a", 2, None, 5), ("a", 3, "x" * 199_999 + "y", 1), ("a", 4, "v", 1), ("a", 5, "v", 1), (None, 9, "n", 2)]
    want = {("a", 1, "hash"), ("a", 2, "hash"), ("a", 3, "hash"), (None, 9, "bucket"), ("a", 5, "only_main")}
    assert run(spark, main, copy) == want


def test_empty(spark):
    rows = [("a", 1, "v", 1)]
    assert run(spark, [], []) == set()
    assert run(spark, rows, []) == {("a", 1, "only_main")}
    assert run(spark, [], rows) == {("a", 1, "only_copy")}


def test_field():
    r = random.Random(5)
    for d in (1, 2, 3, 9, 40, 300):
        want = sorted(r.randrange(1 << 60) for _ in range(d))
        f = [1]
        for x in want:
            f = field.mul(f, [-x % field.P, 1])
        assert field.roots(f) == want
    twice = field.mul(f, [-want[0] % field.P, 1])
    assert field.roots(twice) == want

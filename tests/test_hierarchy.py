import random

import pytest

from fjordlens.operators import hierarchy
from fjordlens.plans.runtime import Scratch


def brute(edges):
    up = {}
    for a, b in edges:
        up.setdefault(a, set()).add(b)
    nodes = {x for e in edges for x in e}
    pairs = {}
    for s in nodes:
        front, k = {s}, 0
        while front:
            k += 1
            front = {b for a in front for b in up.get(a, ())}
            front = {b for b in front if (s, b) not in pairs}
            for b in front:
                pairs[s, b] = k
    return nodes, up, pairs


def run(spark, rows):
    df = spark.createDataFrame(rows, "child bigint, parent_id bigint, steps string, node string")
    scratch = Scratch(spark, "t")
    edges = scratch.cut(hierarchy.links(df, "child", "parent_id"))
    return edges, hierarchy.ancestor_pairs(edges, scratch), scratch


def clean(rows):
    return {(a, b) for a, b, *_ in rows if a is not None and b is not None}


CASES = {
    "chain": [(i, i + 1) for i in range(1, 70)],
    "diamond": [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5)],
    "loops": [(1, 1), (2, 3), (3, 2), (4, 3), (5, 4), (5, 1), (6, 7), (7, 8), (8, 6), (8, 2)],
    "one way": [(1, 2)],
    # a long chain above, between and below loops, and wide levels that peel off at once
    "chained loops": [(i, i + 1) for i in range(1, 90)] + [(30, 20), (60, 55)] + [(200 + i, 1 + i % 3) for i in range(60)] + [(300 + i, 200 + i) for i in range(60)],
    "random": [(random.Random(i).randrange(40), random.Random(i + 999).randrange(40)) for i in range(60)],
}


@pytest.mark.parametrize("case", CASES)
def test_against_brute_force(spark, case):
    rows = [(a, b, "x", None) for a, b in CASES[case]]
    rows += rows[:2] + [(None, 1, "", ""), (1, None, "", ""), (None, None, None, None)]  # repeated links and nulls
    edges, pairs, scratch = run(spark, rows)
    nodes, up, want = brute(clean(rows))
    assert {(r.node, r.ancestor): r.steps for r in pairs.collect()} == want
    sets = {n: min(m for m in nodes if (n, m) in want and (m, n) in want) for n in nodes if (n, n) in want}
    found = {(n, c): 0 for n, c in sets.items()}
    for (n, a), k in want.items():
        if a in sets:
            found[n, sets[a]] = min(found.get((n, sets[a]), k), k)
    assert {(r.qid, r.cycle_qid): r.steps for r in hierarchy.reached_cycles(edges, scratch).collect()} == found
    roots = {n for n in nodes if not up.get(n)}
    got = {(r.qid, r.root): (r.depth, r.path) for r in hierarchy.root_paths(edges, pairs, scratch).collect()}
    assert {k: v[0] for k, v in got.items()} == {(n, r): (0 if n == r else want[n, r]) for n in nodes for r in roots if n == r or (n, r) in want}
    for (n, r), (depth, path) in got.items():
        p = [int(x) for x in path.split(">")]
        assert (p[0], p[-1], len(p)) == (r, n, depth + 1)
        assert all(a in up[b] for a, b in zip(p, p[1:]))
    summary = {r.qid: r for r in hierarchy.node_summary(edges, pairs, scratch).collect()}
    assert set(summary) == nodes
    for n, r in summary.items():
        assert r.ancestors == sum(a == n and b != n for a, b in want)
        assert r.descendants == sum(b == n and a != n for a, b in want)
        assert r.in_cycle == ((n, n) in want)


def test_long_chains_are_set_aside(spark):
    rows = [(i, i + 1, "", "") for i in range(1, 40)] + [(1000 + i, 40, "", "") for i in range(900)]
    _, pairs, _ = run(spark, rows)
    assert {(r.node, r.ancestor): r.steps for r in pairs.collect()} == brute(clean(rows))[2]


def test_empty(spark):
    edges, pairs, scratch = run(spark, [])
    assert pairs.count() == 0
    assert hierarchy.reached_cycles(edges, scratch).count() == 0
    assert hierarchy.root_paths(edges, pairs, scratch).count() == 0
    assert hierarchy.node_summary(edges, pairs, scratch).count() == 0

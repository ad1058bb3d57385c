"""Child-to-parent links to full hierarchies: ancestor pairs, closed sets, roots, depths and paths.

Method: frontier joins level by level. Closed sets are found by peeling: level-wise, nodes without parents (roots) and nodes
without children are taken off from both ends, since neither lies on a cycle; ancestor pairs are made of what is left
only, where a node that reaches itself is repeated, hence in a closed set. Going back over the levels taken off at the
lower end gives every node below a closed set and its distance. Where all descendants are asked for, ancestor pairs are made of
all links, and the frontier doubles: a pair that lies more than k and at most 2k links apart is a pair exactly k apart
joined with a pair at most k apart, so levels 1, 2, 4, 8, ... are enough and a chain of 160 links takes 8 joins instead
of 160. A node without a root among its ancestors is unreached.

Inputs: any table with a child and a parent column of bigint; further columns are ignored.
Defined results for odd inputs: a null child or parent is no link; repeated links count once; a node linked to
itself is a closed set of one; an empty table gives empty results; ties between parents go to the smallest id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fjordlens.plans.runtime import Scratch


def links(df: DataFrame, child: str, parent: str) -> DataFrame:
    """Distinct (node, parent) without nulls."""
    return (
        df.select(F.col(child).cast("bigint").alias("node"), F.col(parent).cast("bigint").alias("parent"))
        .where(F.col("node").isNotNull() & F.col("parent").isNotNull())
        .distinct()
    )


def ancestor_pairs(edges: DataFrame, scratch: Scratch, settle: bool = True) -> DataFrame:
    """(node, ancestor, steps): the fewest upward links, 1 or more; (x, x) says that x reaches itself.

    ``edges`` is (node, parent), distinct. The rounds are the logarithm of the longest distance; a round writes the
    pairs of the nodes that still go on and shuffles them by (node, ancestor), which no single key dominates. The join on
    the middle node is left to AQE, which splits a node that holds many pairs. After each round a node that has nothing
    exactly k links away, and is not itself k links away from a node, is final: its pairs are set aside. Without ``settle``
    they are carried along, which saves jobs where most nodes go on to the end, as in a peeled core.
    """
    work = edges.select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("steps"))
    done, k = [], 1
    while True:
        far = work.where(F.col("steps") == k).select("node", F.col("ancestor").alias("mid"))
        near = work.select(F.col("node").alias("mid"), "ancestor", F.col("steps").alias("more"))
        longer = far.join(near, "mid").select("node", "ancestor", (F.col("more") + k).cast("int").alias("steps"))
        grown = scratch.cut(
            work.unionByName(longer).groupBy("node", "ancestor").agg(F.min("steps").cast("int").alias("steps"))
        )
        k *= 2
        # a node with something 2k away, and the nodes k away from it, have something k away or are that themselves
        far = grown.where(F.col("steps") == k)
        if far.isEmpty():  # nothing lies exactly k apart, so nothing further
            return reduce(DataFrame.unionByName, [*done, grown])
        if not settle:
            scratch.drop(work)
            work = grown
            continue
        alive = scratch.cut(far.select("node").union(far.select("ancestor")).distinct())
        done.append(grown.join(alive, "node", "left_anti").select("node", "ancestor", "steps"))
        work = grown.join(alive, "node", "left_semi").select("node", "ancestor", "steps")


def peel(edges: DataFrame, scratch: Scratch, least: float = 0.125) -> tuple[DataFrame, list[DataFrame]]:
    """(core, levels): what is left of the links when both ends are taken off level by level, and the links taken off at
    the lower end, in that order.

    A level drops the links to nodes without parents (nothing above them closes) and sets aside the links of nodes without
    children. Links of cycles and between cycles stay. It ends when a level takes off less than ``least`` of what
    there was: what is left then are cycles and a few long chains, so the levels are few, whatever the depth."""
    core, n, levels = edges, edges.count(), []
    while n:
        above = core.select(F.col("node").alias("parent")).distinct()  # parents that have parents
        below = core.select(F.col("parent").alias("node"), F.lit(True).alias("_under")).distinct()
        kept = scratch.cut(core.join(above, "parent", "left_semi").join(below, "node", "left").select("node", "parent", "_under"))
        levels.append(kept.where("_under is null").select("node", "parent"))
        core = kept.where("_under").select("node", "parent")
        left = core.count()
        if n - left < least * n:
            break
        n = left
    return core, levels


def closed_sets(pairs: DataFrame) -> DataFrame:
    """(node, cycle): every node that reaches itself, with the smallest node of its closed set."""
    looped = pairs.where(F.col("node") == F.col("ancestor")).select("node")
    inner = pairs.join(looped, "node", "left_semi").join(
        looped.withColumnRenamed("node", "ancestor"), "ancestor", "left_semi"
    )
    back = inner.select(F.col("ancestor").alias("node"), F.col("node").alias("ancestor"))
    return (
        inner.select("node", "ancestor")
        .join(back, ["node", "ancestor"], "left_semi")
        .groupBy("node")
        .agg(F.min("ancestor").alias("cycle"))
    )


def reached_cycles(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(qid, cycle_qid, steps): each node and each closed set it lies in (steps 0) or reaches upwards.

    Closed sets lie in the peeled core; its ancestor pairs give them and the core's distances. The levels taken off at the
    lower end are gone back over, the last one first: a node's distance is one more than its nearest parent's."""
    core, levels = peel(edges, scratch)
    pairs = ancestor_pairs(core, scratch, settle=False)
    sets = scratch.cut(closed_sets(pairs))
    up = pairs.join(sets.withColumnRenamed("node", "ancestor"), "ancestor").select("node", "cycle", "steps")
    own = sets.select("node", "cycle", F.lit(0).alias("steps"))
    known = scratch.cut(up.unionByName(own).groupBy("node", "cycle").agg(F.min("steps").alias("steps")))
    for level in reversed(levels):
        at = known.withColumnRenamed("node", "parent")
        below = level.join(at, "parent").groupBy("node", "cycle").agg((F.min("steps") + 1).alias("steps"))
        known = known.unionByName(scratch.cut(below))
    return known.select(F.col("node").alias("qid"), F.col("cycle").alias("cycle_qid"), F.col("steps").cast("bigint").alias("steps"))


def node_summary(edges: DataFrame, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per node: depth (fewest links to a root, null if unreached), root (the smallest of the nearest
    ones), roots, ancestors, descendants (each without the node itself) and whether it lies in a closed set."""
    nodes = edges.select("node").union(edges.select("parent")).distinct()
    roots = scratch.cut(nodes.join(edges.select("node").distinct(), "node", "left_anti"))
    other = F.col("node") != F.col("ancestor")
    up = pairs.groupBy("node").agg(
        F.count_if(other).alias("ancestors"), F.max(F.when(~other, True).otherwise(False)).alias("in_cycle")
    )
    down = pairs.where(other).groupBy(F.col("ancestor").alias("node")).agg(F.count("*").alias("descendants"))
    to_root = (
        pairs.join(roots.withColumnRenamed("node", "ancestor"), "ancestor", "left_semi")
        .select("node", F.col("ancestor").alias("root"), "steps")
        .unionByName(roots.select("node", F.col("node").alias("root"), F.lit(0).alias("steps")))
    )
    top = to_root.groupBy("node").agg(
        F.min(F.struct("steps", "root")).alias("near"), F.count("*").alias("roots")
    )
    return (
        nodes.join(up, "node", "left").join(down, "node", "left").join(top, "node", "left")
        .select(
            F.col("node").alias("qid"),
            F.col("near.steps").cast("bigint").alias("depth"),
            F.col("near.root").alias("root"),
            F.coalesce("roots", F.lit(0)).alias("roots"),
            F.coalesce("ancestors", F.lit(0)).alias("ancestors"),
            F.coalesce("descendants", F.lit(0)).alias("descendants"),
            F.coalesce("in_cycle", F.lit(False)).alias("in_cycle"),
        )
    )


def root_paths(edges: DataFrame, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """(qid, root, depth, path): for each node and each root above it one shortest path, root first, joined by '>'.

    Among shortest paths each step goes to the smallest parent that is one link nearer. Paths are put together by
    pointer doubling: every round appends to a path the path of its present end.
    """
    nodes = edges.select("node").union(edges.select("parent")).distinct()
    roots = scratch.cut(nodes.join(edges.select("node").distinct(), "node", "left_anti"))
    depth = scratch.cut(
        pairs.join(roots.withColumnRenamed("node", "ancestor"), "ancestor", "left_semi")
        .select("node", F.col("ancestor").alias("root"), "steps")
        .unionByName(roots.select("node", F.col("node").alias("root"), F.lit(0).alias("steps")))
    )
    above = depth.select(F.col("node").alias("parent"), "root", F.col("steps").alias("less"))
    step = (
        depth.where("steps > 0").join(edges, "node").join(above, ["parent", "root"])
        .where(F.col("less") == F.col("steps") - 1)
        .groupBy("node", "root", "steps").agg(F.min("parent").alias("at"))
    )
    walk = scratch.cut(
        step.select("node", "root", "steps", "at", F.array("at").alias("path"))
        .unionByName(depth.where("steps = 0").select("node", "root", "steps", F.col("node").alias("at"), F.array().cast("array<bigint>").alias("path")))
    )
    while not walk.where(F.col("at") != F.col("root")).isEmpty():
        on = walk.where("steps > 0").select(F.col("node").alias("at"), "root", F.col("at").alias("next"), F.col("path").alias("more"))
        longer = scratch.cut(
            walk.join(on, ["at", "root"], "left").select(
                "node", "root", "steps",
                F.coalesce("next", "at").alias("at"),
                F.when(F.col("more").isNull(), F.col("path")).otherwise(F.concat("path", "more")).alias("path"),
            )
        )
        scratch.drop(walk)
        walk = longer
    whole = F.reverse(F.concat(F.array("node"), "path"))
    return walk.select(
        F.col("node").alias("qid"), "root", F.col("steps").cast("bigint").alias("depth"),
        F.array_join(whole.cast("array<string>"), ">").alias("path"),
    )

"""Consolidating pairwise matches into groups by deterministic Boruvka hooking."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomstone.operators.skew import HEAVY_FLOOR, HEAVY_PARTS, lookup
from loomstone.runtime import Scratch


def star(groups: DataFrame, members: str) -> DataFrame:
    """Edges (a, b), a < b, tying all members of an array column together: the smallest to each other one."""
    ids = F.array_distinct(F.filter(members, lambda x: x.isNotNull()))
    low = groups.select(ids.alias("_ids")).select(F.array_min("_ids").alias("a"), F.explode("_ids").alias("b"))
    return low.where("a < b")


def group(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, group_id) of every id that an edge ties to another; group_id is the smallest id of the group.

    Edges with a null end and self-links tie nothing. Repeated edges, either
    direction and any order of rows give the same result; other columns are
    ignored. No edges give an empty result.

    Plan, one Boruvka round: every component selects its smallest outgoing edge
    in the total order (smaller end, larger end), which is the edge to its
    smallest neighbour; a pair that selected each other is rooted at its smaller
    member; the trees collapse by pointer doubling; the edges take the roots'
    labels, lose self-links and are deduplicated. Each round at least halves the
    components that still have edges, so the rounds are logarithmic in the ids.
    The degree of each component comes with its smallest edge, so edges at the
    few components of very high degree are relabelled by broadcast (at most
    2 * HEAVY_PARTS rows by pigeonhole), all others through the shuffle. The root
    that one giant component's members share, and the neighbour that many name as
    their smallest, are looked up the same way (see ``skew.lookup``).
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "boruvka")
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where(F.col("a") != F.col("b"))
    live, seen = scratch.save(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), n=F.count(F.lit(1)))
    steps: list[tuple[DataFrame, int]] = []  # (id, root) of each round and their number, over the labels that then had edges
    while seen["n"]:
        hooks, labels = _hook(live, scratch)
        steps.append((hooks, labels))
        fresh, seen = scratch.save(_relabel(live, hooks, seen["n"]), n=F.count(F.lit(1)))
        scratch.drop(live)
        live = fresh
    if not steps:
        return ends.select(F.col("a").alias("id"), F.col("b").alias("group_id")).where(F.lit(False))
    # carry the labels of the first round through the later ones, which are ever smaller
    first, rows = steps[0]
    label = first.select("id", "root")
    for later, _ in steps[1:]:
        onward = later.select(F.col("id").alias("root"), F.col("root").alias("_next"))
        label, _ = scratch.save(lookup(label, "root", onward, rows, "left").select("id", F.coalesce("_next", "root").alias("root")))
    low = label.groupBy("root").agg(F.min("id").alias("group_id"))  # partial minima before the shuffle
    return lookup(label, "root", low, rows).select("id", "group_id")


def _hook(live: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """(id, root, degree), and their number: each label's tree root after smallest-edge hooking and pointer doubling."""
    both = live.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("to")), F.struct(F.col("b").alias("id"), F.col("a").alias("to")))).alias("e"))
    best = both.select("e.*").groupBy("id").agg(F.min("to").alias("to"), F.count(F.lit(1)).alias("degree"))
    best, seen = scratch.save(best, n=F.count(F.lit(1)))
    rows = seen["n"]
    back = best.select(F.col("id").alias("to"), F.col("to").alias("_back"))
    mutual = (F.col("_back") == F.col("id")) & (F.col("id") < F.col("to"))
    tree = lookup(best, "to", back, rows).select("id", F.when(mutual, F.col("id")).otherwise(F.col("to")).alias("root"), "degree")
    tree, _ = scratch.save(tree)
    scratch.drop(best)
    while True:
        up = tree.select(F.col("id").alias("root"), F.col("root").alias("_root"))
        jumped = lookup(tree, "root", up, rows).select("id", F.col("_root").alias("root"), "degree", (F.col("_root") != F.col("root")).alias("_moved"))
        fresh, seen = scratch.save(jumped, moved=F.sum(F.col("_moved").cast("long")))
        scratch.drop(tree)
        tree = fresh
        if not seen["moved"]:
            return tree.select("id", "root", "degree"), rows


def _relabel(live: DataFrame, hooks: DataFrame, n: int) -> DataFrame:
    limit = max(HEAVY_FLOOR, n // HEAVY_PARTS)
    for end in ("a", "b"):
        names = hooks.select(F.col("id").alias(end), F.col("root").alias("_root"), "degree")
        other = "b" if end == "a" else "a"
        take = lambda df: df.select(F.col("_root").alias(end), other)  # noqa: B023, E731
        if n <= HEAVY_FLOOR:
            live = take(live.join(names, end))
        else:
            hot = F.broadcast(names.where(F.col("degree") > limit))
            live = take(live.join(hot, end)).unionByName(take(live.join(hot, end, "left_anti").join(names, end)))
    return live.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

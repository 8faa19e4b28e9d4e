"""Parent-child rows to full hierarchies by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomstone.operators.skew import lookup
from loomstone.runtime import Scratch


def links(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """One row (id, parent) for each node; a parent without a row of its own counts as none.

    Null node ids do not count. A node given with several parents keeps the
    smallest. Repeated rows count once.
    """
    known = nodes.where(F.col(node).isNotNull()).groupBy(F.col(node).alias("id")).agg(F.min(F.col(parent)).alias("parent"))
    ids = known.select(F.col("id").alias("parent"), F.lit(True).alias("_there"))
    return known.join(ids, "parent", "left").select("id", F.when(F.col("_there"), F.col("parent")).alias("parent"))


def resolve(nodes: DataFrame, node: str, parent: str, with_path: bool = False) -> DataFrame:
    """(id, root_id, depth[, path]) of every node.

    A root is its own ``root_id`` at depth 0. A node on a loop, or whose
    ancestors run into one, has depth -1, as root the smallest id on that loop,
    and the one-element path of itself. ``path`` lists the ids from the root to
    the node. Repeated rows count once, null ids not at all, a parent without a
    row is no parent; an empty table gives an empty result.

    Plan: each round joins the unfinished nodes' ancestor pointers with the
    pointers of those ancestors, doubling the distance and joining the path
    segments, so a line of descent of length d takes log2(d) rounds. A round
    that finishes no node proves that the rest runs into loops, since ancestors
    of a finite depth finish before their descendants. Each round writes the nodes
    that it moved, so a finished node is written once; an ancestor pointed at by a large
    share of the nodes is looked up by broadcast, see ``skew.lookup``.
    """
    spark = nodes.sparkSession
    scratch = Scratch(spark, "hierarchy")
    start = links(nodes, node, parent)
    loose = F.col("parent").isNull()
    path = [F.when(loose, F.array().cast("array<string>")).otherwise(F.array("parent")).alias("path")] if with_path else []
    first = start.select("id", F.coalesce("parent", "id").alias("ptr"), F.when(loose, 0).otherwise(1).cast("long").alias("dist"), loose.alias("done"), *path)
    todo = ~F.col("done")
    state, seen = scratch.save(first, left=F.sum(todo.cast("long")))
    done, open_ = state.where("done"), state.where(todo)
    joined = [F.concat("_path", "path").alias("path")] if with_path else []
    while seen["left"]:
        known = done.unionByName(open_)
        far = known.select(F.col("id").alias("ptr"), *[F.col(c).alias(f"_{c}") for c in known.columns if c != "id"])
        moved = lookup(open_, "ptr", far, seen["left"]).select("id", F.col("_ptr").alias("ptr"), (F.col("dist") + F.col("_dist")).alias("dist"), F.col("_done").alias("done"), *joined)
        before = seen["left"]
        fresh, seen = scratch.save(moved, left=F.sum(todo.cast("long")))
        done, open_ = done.unionByName(fresh.where("done")), fresh.where(todo)
        if seen["left"] == before:
            break
    cyclic = start.sparkSession.createDataFrame([], "id string, root_id string")
    if seen["left"]:
        cyclic = _loops(open_.select("id"), start, scratch, seen["left"])
    shape = lambda df, depth, path: df.select("id", "root_id", depth.cast("long").alias("depth"), *([path.alias("path")] if with_path else []))
    finished = done.withColumnRenamed("ptr", "root_id")
    return shape(finished, F.col("dist"), F.concat("path", F.array("id")) if with_path else None).unionByName(shape(cyclic, F.lit(-1), F.array("id")))


def _loops(ids: DataFrame, start: DataFrame, scratch: Scratch, rows: int) -> DataFrame:
    """(id, root_id) of nodes that run into loops: jumps double until every pointer stands on a loop, then minima spread along the loops."""
    step = start.join(ids, "id", "left_semi").select("id", F.col("parent").alias("ptr"))
    jump, seen = scratch.save(step, rows=F.count(F.lit(1)))
    one = jump  # single steps, needed again below
    images = jump.select("ptr").distinct().count()
    while True:
        far = jump.select(F.col("id").alias("ptr"), F.col("ptr").alias("_ptr"))
        fresh, _ = scratch.save(lookup(jump, "ptr", far, rows).select("id", F.col("_ptr").alias("ptr")))
        if jump is not one:
            scratch.drop(jump)
        jump = fresh
        now = jump.select("ptr").distinct().count()
        if now == images:  # the jump permutes its image, so the image holds loop nodes only
            break
        images = now
    on_loop = jump.select(F.col("ptr").alias("id")).distinct()
    ring, _ = scratch.save(one.join(on_loop, "id", "left_semi").select("id", "ptr", F.least("id", "ptr").alias("low")))
    while True:
        far = ring.select(F.col("id").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("low").alias("_low"))
        grown = ring.join(far, "ptr").select("id", F.col("_ptr").alias("ptr"), F.least("low", "_low").alias("low"), (F.col("_low") != F.col("low")).alias("_moved"))
        fresh, seen = scratch.save(grown, moved=F.sum(F.col("_moved").cast("long")))
        scratch.drop(ring)
        ring = fresh.drop("_moved")
        ring._scratch_path = fresh._scratch_path
        if not seen["moved"]:
            break
    low = ring.select(F.col("id").alias("ptr"), F.col("low").alias("root_id"))
    return lookup(jump, "ptr", low, rows).select("id", "root_id")


def descendants(hierarchy: DataFrame) -> DataFrame:
    """(ancestor_id, descendant_id, distance) for all proper descendants, from ``resolve(..., with_path=True)``.

    Nodes that run into loops have no defined ancestors and give no row.
    """
    walk = hierarchy.where("depth > 0").select("id", "depth", F.posexplode("path").alias("pos", "ancestor_id")).where("pos < depth")
    return walk.select("ancestor_id", F.col("id").alias("descendant_id"), (F.col("depth") - F.col("pos")).cast("long").alias("distance"))

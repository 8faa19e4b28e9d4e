"""Graph projection, traversal and analytics over edge frames (src, dst, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from loomstone.operators import hierarchy
from loomstone.operators.skew import lookup
from loomstone.runtime import Scratch

MAX_HOPS = 30


def survivors(entities: DataFrame) -> DataFrame:
    """(id, root_id, depth) of every entity after following merge redirects; depth -1 marks a redirect loop."""
    return hierarchy.resolve(entities.select("entity_id", "merged_into"), "entity_id", "merged_into")


def unresolved(entities: DataFrame, resolved: DataFrame) -> DataFrame:
    """Entities whose survivor is itself merged away; an export must not go on unless this is empty."""
    bad = entities.where(F.col("merged_into").isNotNull()).select(F.col("entity_id").alias("root_id"))
    return resolved.join(bad, "root_id", "left_semi").select("id", "root_id")


def relates(relations: DataFrame, resolved: DataFrame, active: DataFrame) -> DataFrame:
    """Relation edges between active survivors, invalidated and parallel ones kept, direction as stored."""
    root = lambda end: resolved.select(F.col("id").alias(end), F.col("root_id").alias(f"{end}_root"))
    out = relations.join(root("subject"), "subject").join(root("object"), "object")
    alive = active.where("status = 'active'").select("entity_id")
    out = out.join(alive.withColumnRenamed("entity_id", "subject_root"), "subject_root", "left_semi").join(alive.withColumnRenamed("entity_id", "object_root"), "object_root", "left_semi")
    return out.select(F.col("subject_root").alias("src"), F.col("object_root").alias("dst"), *[c for c in relations.columns if c not in ("subject", "object")])


def mentions(pairs: DataFrame, resolved: DataFrame) -> DataFrame:
    """(entity_id, doc_id, mentions, first_seen) per survivor and document."""
    named = pairs.join(resolved.select(F.col("id").alias("entity_id"), "root_id"), "entity_id")
    return named.groupBy(F.col("root_id").alias("entity_id"), "doc_id").agg(F.count(F.lit(1)).alias("mentions"), F.min("seen_at").alias("first_seen"))


def crossrefs(refs: DataFrame, documents: DataFrame) -> DataFrame:
    """(src, dst) of references between documents that exist, deleted or not; null targets go, repeated ones count once."""
    known = documents.select(F.col("doc_id").alias("dst")).distinct()
    each = refs.where("src is not null and dst is not null").select("src", "dst").distinct()
    return each.join(known, "dst", "left_semi").join(known.withColumnRenamed("dst", "src"), "src", "left_semi").select("src", "dst")


def both_ways(edges: DataFrame, *extra: str) -> DataFrame:
    """Each edge in either direction, stored direction lost."""
    ways = F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))
    return edges.select(F.explode(ways).alias("e"), *extra).select("e.*", *extra)


def neighborhood(edges: DataFrame, start: str, hops: int = 2) -> DataFrame:
    """(id, hops) of every other node within ``hops`` (1 to 30) of the start, at its least distance, over undirected edges.

    The frontier holds distinct nodes only, so a hub is expanded once.
    """
    hops = max(1, min(hops, MAX_HOPS))
    scratch = Scratch(edges.sparkSession, "bfs")
    links, _ = scratch.save(both_ways(edges).distinct())
    seen = edges.sparkSession.createDataFrame([(start, 0)], "id string, hops int")
    front, rows = seen, 1
    for hop in range(1, hops + 1):
        reached = links.join(front.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        front, got = scratch.save(reached.join(seen, "id", "left_anti").withColumn("hops", F.lit(hop)), n=F.count(F.lit(1)))
        if not got["n"]:
            break
        seen = seen.unionByName(front)
        rows += got["n"]
    return seen.where("hops > 0")


def path(edges: DataFrame, start: str, end: str, max_hops: int = 4, directed: bool = False) -> DataFrame:
    """The shortest path as (hop, node, edge_id, src, dst), hop 0 being the start; empty if there is none.

    Of equally short paths the smallest (node ids, then edge ids). Edges keep their
    stored direction; ``directed`` follows it, as citations do.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "path")
    one = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "edge_id", "src", "dst")
    links = one if directed else one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "edge_id", "src", "dst"))
    # of parallel edges only the smallest can be on the smallest path
    links, _ = scratch.save(links.groupBy("a", "b").agg(F.min(F.struct("edge_id", "src", "dst")).alias("e")))
    step = "array<struct<node:string,edge_id:string,src:string,dst:string>>"
    front = spark.createDataFrame([(start, [(start, None, None, None)])], f"id string, path {step}")
    seen = front.select("id")
    for _ in range(min(max_hops, MAX_HOPS)):
        nxt = front.join(links, front.id == links.a).select(
            F.col("b").alias("id"), F.concat("path", F.array(F.struct(F.col("b").alias("node"), F.col("e.edge_id"), F.col("e.src"), F.col("e.dst")))).cast(step).alias("path")
        )
        nodes = F.transform("path", lambda x: x["node"])
        best = nxt.join(seen, "id", "left_anti").groupBy("id").agg(F.min_by("path", F.struct(nodes, F.transform("path", lambda x: F.coalesce(x["edge_id"], F.lit(""))))).alias("path"))
        front, got = scratch.save(best, n=F.count(F.lit(1)), hit=F.max((F.col("id") == end).cast("int")))
        if not got["n"] or got["hit"]:
            break
        seen = seen.unionByName(front.select("id"))
    return front.where(F.col("id") == end).select(F.posexplode("path").alias("hop", "s")).select("hop", "s.*").orderBy("hop")


def live_edges(edges: DataFrame, at: str) -> DataFrame:
    """Edges that analytics count: believed and not ended; a begin in the future does not exclude."""
    from loomstone.operators.temporal import instant

    return edges.where(F.col("invalidated_at").isNull() & (F.col("valid_until").isNull() | (F.col("valid_until") > instant(at))))


def degree(edges: DataFrame) -> DataFrame:
    """(id, degree): ends of edges at each node, a self-link counting twice."""
    return both_ways(edges).groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over undirected edges.

    Each round every node hears its neighbours' least label, hands it on to the
    node its own label names (hooking), and takes the label of its label
    (shortcut), so the rounds are logarithmic; a label shared by a large part of
    the nodes is looked up by broadcast.
    """
    scratch = Scratch(edges.sparkSession, "wcc")
    links, _ = scratch.save(both_ways(edges).distinct())
    labels, got = scratch.save(links.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("label")), n=F.count(F.lit(1)))
    rows = got["n"]
    while rows:
        heard = links.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        heard, _ = scratch.save(labels.join(heard, "id"))
        hook = heard.groupBy("label").agg(F.min("near").alias("hook"))
        low = lookup(heard, "label", hook, rows).select("id", F.least("label", "near", "hook").alias("label"), F.col("label").alias("old"))
        low, _ = scratch.save(low)
        jump = lookup(low, "label", low.select(F.col("id").alias("label"), F.col("label").alias("next")), rows)
        fresh, got = scratch.save(jump.select("id", F.col("next").alias("label"), (F.col("next") != F.col("old")).cast("long").alias("moved")), moved=F.sum("moved"))
        scratch.drop(labels, heard, low)
        path_ = fresh._scratch_path
        labels = fresh.select("id", "label")
        labels._scratch_path = path_
        if not got["moved"]:
            break
    return labels.select("id", F.col("label").alias("component"))


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 20) -> DataFrame:
    """(id, rank) after a fixed number of rounds over undirected edges (parallel ones count); ranks sum to 1.

    Every node of an undirected edge set has an out-link, so no rank dangles.
    """
    scratch = Scratch(edges.sparkSession, "rank")
    links, _ = scratch.save(both_ways(edges).groupBy("a", "b").agg(F.count(F.lit(1)).alias("w")))
    out = links.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("out"))
    ranks, got = scratch.save(out.select("id", "out", F.lit(1.0).alias("rank")), n=F.count(F.lit(1)))
    for _ in range(rounds):
        flow = links.join(ranks.select(F.col("id").alias("a"), (F.col("rank") / F.col("out")).alias("each")), "a").groupBy(F.col("b").alias("id")).agg(F.sum(F.col("w") * F.col("each")).alias("in"))
        fresh, _ = scratch.save(ranks.join(flow, "id").select("id", "out", (F.lit(1 - damping) + damping * F.col("in")).alias("rank")))
        scratch.drop(ranks)
        ranks = fresh
    return ranks.select("id", (F.col("rank") / F.lit(max(got["n"] or 1, 1))).alias("rank"))


def core_numbers(edges: DataFrame) -> DataFrame:
    """(id, core): the largest k such that the node is in a subgraph of nodes with k neighbours each, by h-index iteration.

    Each round every node takes the largest h such that h neighbours hold at least
    h; started from the degrees this settles at the core numbers, and only counts move.
    """
    scratch = Scratch(edges.sparkSession, "core")
    links, _ = scratch.save(both_ways(edges.where("src <> dst")).distinct())
    cores, _ = scratch.save(links.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("core")))
    while True:
        held = links.join(cores.select(F.col("id").alias("b"), "core"), "b").join(cores.select(F.col("id").alias("a"), F.col("core").alias("own")), "a")
        # neighbours by value, at most the own value: rows a node are bounded by its distinct values
        counts = held.groupBy("a", "own", F.least("core", "own").alias("v")).agg(F.count(F.lit(1)).alias("n"))
        w = Window.partitionBy("a").orderBy(F.desc("v"))
        h = counts.withColumn("least", F.sum("n").over(w)).groupBy("a", "own").agg(F.max(F.least("v", "least")).alias("core"))
        fresh, got = scratch.save(h.select(F.col("a").alias("id"), "core", (F.col("core") != F.col("own")).cast("long").alias("moved")), moved=F.sum("moved"))
        scratch.drop(cores)
        path_ = fresh._scratch_path
        cores = fresh.select("id", "core")
        cores._scratch_path = path_
        if not got["moved"]:
            return cores.select("id", "core")


def communities(edges: DataFrame, levels: int = 4, sweeps: int = 4) -> DataFrame:
    """(id, community): Louvain communities, deterministic and distributed; community is the smallest member id.

    A sweep lets the nodes of one hash parity move to the neighbouring community of
    largest modularity gain (ties: smallest id), so two nodes never swap for ever;
    a level ends when a pair of sweeps moves nothing, and its communities become
    the nodes of the next.
    """
    scratch = Scratch(edges.sparkSession, "louvain")
    weights = both_ways(edges).groupBy("a", "b").agg(F.sum(F.lit(1.0)).alias("w"))
    links, got = scratch.save(weights, total=F.sum("w"))
    total = got["total"] or 1.0
    member, _ = scratch.save(links.select(F.col("a").alias("id")).distinct().withColumn("community", F.col("id")))
    for level in range(levels):
        strength = links.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("k"))
        home, got = scratch.save(strength.withColumn("c", F.col("id")), n=F.count(F.lit(1)))
        nodes = got["n"]
        moved_level, still = 0, 0
        for sweep in range(sweeps * 2):
            heavy = home.groupBy("c").agg(F.sum("k").alias("tot"))
            to = links.where("a <> b").join(home.select(F.col("id").alias("b"), F.col("c").alias("to")), "b").groupBy(F.col("a").alias("id"), "to").agg(F.sum("w").alias("into"))
            to, seen = scratch.save(to, n=F.count(F.lit(1)))
            cand = lookup(to.join(home.select("id", "c", "k"), "id"), "to", heavy.select(F.col("c").alias("to"), "tot"), seen["n"])
            others = F.col("tot") - F.when(F.col("to") == F.col("c"), F.col("k")).otherwise(0.0)
            gain = F.round(F.col("into") - F.col("k") * others / total, 9)
            best = cand.withColumn("gain", gain).groupBy("id").agg(
                F.min_by("to", F.struct(-F.col("gain"), F.col("to") != F.col("c"), F.col("to"))).alias("to"), F.max("gain").alias("gain"), F.max(F.when(F.col("to") == F.col("c"), F.col("gain"))).alias("stay")
            )
            turn = F.pmod(F.xxhash64("id", F.lit(level)), F.lit(2)) == sweep % 2
            go = turn & (F.col("gain") > F.coalesce("stay", F.lit(0.0))) & (F.col("to") != F.col("c"))
            fresh, got = scratch.save(home.join(best, "id", "left").select("id", "k", F.when(go, F.col("to")).otherwise(F.col("c")).alias("c"), F.coalesce(go, F.lit(False)).cast("long").alias("m")), moved=F.sum("m"))
            scratch.drop(home, to)
            path_ = fresh._scratch_path
            home = fresh.select("id", "k", "c")
            home._scratch_path = path_
            moved_level += got["moved"] or 0
            still = 0 if got["moved"] else still + 1
            if still == 2:
                break
        if not moved_level:
            break
        name = home.groupBy("c").agg(F.min("id").alias("name"))
        renamed, _ = scratch.save(lookup(home.select("id", "c"), "c", name, nodes).select("id", "name"))
        member, _ = scratch.save(member.join(renamed.select(F.col("id").alias("community"), "name"), "community").select("id", F.col("name").alias("community")))
        end = lambda e: renamed.select(F.col("id").alias(e), F.col("name").alias(f"{e}2"))
        fresh, _ = scratch.save(links.join(end("a"), "a").join(end("b"), "b").groupBy(F.col("a2").alias("a"), F.col("b2").alias("b")).agg(F.sum("w").alias("w")))
        scratch.drop(links)
        links = fresh
    low = member.groupBy("community").agg(F.min("id").alias("name"))
    return member.join(low, "community").select("id", F.col("name").alias("community"))

"""Histories, hierarchies and orphan references against brute force."""

import datetime as dt
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomstone import runtime
from loomstone.operators import hierarchy, history, references, skew

T0 = dt.datetime(2024, 1, 1)
READINGS = "key string, at timestamp, recorded timestamp, a string, b int, version_no string, valid_to string"


def brute_versions(rows):
    best = {}
    for key, at, rec, a, b, *_ in rows:
        if key is None or at is None:
            continue
        rank = (rec is not None, rec, a is not None, a or "", b is not None, b or 0)
        if (key, at) not in best or rank > best[key, at][0]:
            best[key, at] = (rank, (a, b))
    out, seen = [], {}
    for key, at in sorted(best):
        state = best[key, at][1]
        if key not in seen or seen[key][1] != state:
            if key in seen:
                out[-1] = (*out[-1][:3], at, *out[-1][4:])
            n = seen[key][0] + 1 if key in seen else 1
            seen[key] = (n, state)
            out.append((key, n, at, None, *state))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_versions_match_brute_force_with_a_hot_key(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(3000):
        key = "hot" if rng.random() < 0.4 else rng.choice([None, *"abcdefg"])
        at = None if rng.random() < 0.02 else T0 + dt.timedelta(hours=rng.randrange(600))
        rec = None if rng.random() < 0.05 else T0 + dt.timedelta(minutes=rng.randrange(2000))
        rows.append((key, at, rec, rng.choice([None, "", "x", "y"]), rng.choice([None, 0, 1]), "clash", "clash"))
    rows += rows[:200]
    df = spark.createDataFrame(rows, READINGS).repartition(5)
    got = history.versions(df, "key", "at", ["a", "b"], "recorded")
    assert got.columns == ["key", "version_no", "at", "valid_to", "a", "b"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute_versions(rows), key=str)


def test_versions_of_nothing(spark):
    assert history.versions(spark.createDataFrame([], READINGS), "key", "at", ["a"], "recorded").count() == 0


def test_stitch_joins_a_version_over_three_partitions():
    edge = lambda p, h, t, k, n, at, to, s: {"_part": p, "_head": h, "_tail": t, "key": k, "version_no": n, "at": at, "valid_to": to, "_state": s}
    edges = [
        edge(0, True, True, "k", 1, 1, None, {"a": 1}),
        edge(1, True, True, "k", 1, 5, None, {"a": 1}),  # goes on
        edge(2, True, False, "k", 1, 7, 8, {"a": 1}),
        edge(2, False, True, "k", 2, 8, None, {"a": 2}),
        edge(4, True, True, "m", 1, 2, None, {"a": 2}),
    ]
    assert history._stitch(edges, "key", "at") == [(0, "k", 0, False, 8), (1, "k", 0, True, 8), (2, "k", 0, True, None), (4, "m", 0, False, None)]


def brute_tree(pairs):
    parent = {}
    for n, p in pairs:
        if n is not None:
            parent[n] = min(x for x in (parent.get(n), p) if x is not None) if (parent.get(n) or p) else None
    parent = {n: p if p in parent else None for n, p in parent.items()}
    out = {}
    for n in parent:
        walk = [n]
        while parent[walk[-1]] is not None and parent[walk[-1]] not in walk:
            walk.append(parent[walk[-1]])
        nxt = parent[walk[-1]]
        out[n] = (walk[-1], len(walk) - 1, walk[::-1]) if nxt is None else (min(walk[walk.index(nxt) :]), -1, [n])
    return out


@pytest.mark.parametrize("seed", range(3))
def test_hierarchy_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    ids = [f"n{i:03}" for i in range(150)]
    pairs = [(n, rng.choice([None, "gone", *rng.choices(ids, k=4)])) for n in ids if rng.random() < 0.9]
    pairs += [(f"d{i:02}", f"d{i - 1:02}" if i else None) for i in range(70)]  # a long line
    pairs += [("s", "s"), ("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("t1", "r2"), ("t2", "t1"), (None, "s"), ("t2", "t1")]
    df = spark.createDataFrame([(*p, "x", 1) for p in pairs], "node string, parent string, path string, depth int")
    got = {r.id: (r.root_id, r.depth, list(r.path)) for r in hierarchy.resolve(df, "node", "parent", with_path=True).collect()}
    assert got == brute_tree(pairs)
    bare = {r.id: (r.root_id, r.depth) for r in hierarchy.resolve(df, "node", "parent").collect()}
    assert bare == {n: v[:2] for n, v in got.items()}


def test_descendants(spark):
    df = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x")], "node string, parent string")
    got = hierarchy.descendants(hierarchy.resolve(df, "node", "parent", with_path=True)).collect()
    assert sorted(map(tuple, got)) == [("a", "b", 1), ("a", "c", 2), ("b", "c", 1)]


def test_hierarchy_of_nothing(spark):
    assert hierarchy.resolve(spark.createDataFrame([], "node string, parent string"), "node", "parent").count() == 0


def test_orphans_by_case(spark):
    day = lambda n: T0 + dt.timedelta(days=n)
    docs = spark.createDataFrame(
        [("live", day(1), None), ("dead", day(1), day(0)), ("both", day(1), day(3)), ("both", day(9), None), ("late", day(8), None), (None, day(1), None), ("live", day(1), None)],
        "doc string, came timestamp, gone timestamp",
    )
    refs = spark.createDataFrame(
        [("doc", k, at, i) for i, (k, at) in enumerate([("live", day(5)), ("dead", day(5)), ("both", day(5)), ("late", day(5)), ("late", day(9)), ("nope", day(5)), (None, day(5)), ("late", None), ("nope", day(5))])],
        "field string, key string, at timestamp, link int",
    ).withColumns({"live": F.lit("clash"), "first_live": F.lit("clash"), "_n": F.lit(0)})
    got = references.orphans(refs, {"doc": references.target_state(docs, "doc", "came", "gone")})
    assert sorted((r.link, r.orphan_state) for r in got.collect()) == [(1, "deleted"), (2, "late"), (3, "late"), (5, "missing"), (8, "missing")]
    counts = references.report(got.withColumn("month", F.date_format("at", "yyyy-MM")), "month").collect()
    assert {(r.orphan_state, r.references, r["keys"]) for r in counts} == {("deleted", 1, 1), ("late", 2, 2), ("missing", 2, 1)}
    empty = references.target_state(docs.limit(0), "doc", "came", "gone")
    assert {r.orphan_state for r in references.orphans(refs, {"doc": empty}).collect()} == {"missing"}
    assert references.orphans(refs.limit(0), {"doc": empty}).count() == 0


def test_heavy_keys_take_the_broadcast_way_with_the_same_result(spark, monkeypatch):
    monkeypatch.setattr(skew, "HEAVY_FLOOR", 10)
    monkeypatch.setattr(references, "HEAVY_FLOOR", 10)
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 700)).alias("k"), "id")
    right = left.select("k").distinct().withColumn("v", F.length("k"))
    a = skew.lookup(left, "k", right, 3000)
    assert a.count() == 3000 and a.exceptAll(left.join(right, "k").select(a.columns)).count() == 0
    assert skew.heavy_keys(left, "k", 3000).collect()[0].k == "hot"
    refs = left.select(F.lit("doc").alias("field"), F.col("k").alias("key"), F.lit(T0).alias("at"), "id")
    none = references.target_state(spark.createDataFrame([], "doc string, came timestamp"), "doc", "came")
    assert references.orphans(refs, {"doc": none}).count() == 3000


def test_scratch_tables_are_released(spark):
    df = spark.createDataFrame([("a", None), ("b", "a")], "node string, parent string")
    runtime.release(spark)
    root = Path(runtime.scratch_root(spark))
    before = set(root.iterdir()) if root.exists() else set()
    assert hierarchy.resolve(df, "node", "parent").count() == 2 and set(root.iterdir()) - before
    assert runtime.release(spark) > 0 and set(root.iterdir()) <= before and runtime.release(spark) == 0


def test_hot_references_never_reach_the_shuffle(spark, monkeypatch):
    """60 % of the references on an orphaned and on a valid key each: the shuffled side holds neither, so no task gets much more than another."""
    monkeypatch.setattr(references, "HEAVY_FLOOR", 10)
    hot = F.when(F.col("id") % 10 < 3, "gone").when(F.col("id") % 10 < 6, "there").otherwise(F.concat(F.lit("k"), F.col("id") % 1000))
    refs = spark.range(20_000).select(F.lit("doc").alias("field"), hot.alias("key"), F.lit(T0).alias("at"), "id")
    there = references.target_state(spark.createDataFrame([("there", T0), ("k6", T0)], "doc string, came timestamp"), "doc", "came")
    judged = refs.groupBy("field", "key").agg(F.count(F.lit(1)).alias("_n"), F.min("at").alias("_first")).join(there.withColumn("field", F.lit("doc")), ["field", "key"], "left")
    (head, heavy), (tail, _) = references.split(refs, judged, F.col("target_live").isNull(), 20_000)
    assert head.count() == 20_000 and {r.key for r in heavy.collect()} == {"gone"}
    sizes = sorted(r.n for r in tail.repartition(8, "key").groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect())
    assert tail.where(F.col("key").isin("gone", "there")).count() == 0 and sum(sizes) == 8000 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    got = references.orphans(refs, {"doc": there})
    assert got.count() == refs.where("key not in ('there', 'k6')").count() and {r.orphan_state for r in got.select("orphan_state").distinct().collect()} == {"missing"}

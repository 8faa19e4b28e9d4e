"""Operators that SQL cannot state, against brute force, published values and small worlds."""

import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F, types as T

from loomstone.functions import text as tx
from loomstone.operators import documents as D, facts, graph, lifecycle, primitives as P, ranking, resolve, temporal, tree
from loomstone.plans import engine, recipes
from loomstone.sources import snapshots
from loomstone import streaming

# --- text -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("word, codes", [
    ("Auerbach", ["097400", "097500"]), ("Peters", ["734000", "739400"]), ("Jackson", ["145460", "154600", "445460", "454600"]), ("Moskowitz", ["645740"]),
    ("Rosochowaciec", ["944744", "944745", "944754", "944755", "945744", "945745", "945754", "945755"]), ("", []), (None, []), ("123", []),
])
def test_sound_codes_are_the_published_ones(word, codes):
    assert tx.sound_codes(word) == codes


def test_lemma_trigrams_and_slug(spark):
    df = spark.createDataFrame([("  Čtvrtá  ŠKOLA ", "word", "Über uns & Co. — 42!"), (None, None, None)], "a string, b string, c string")
    row = df.select(tx.lemma("a").alias("l"), tx.trigrams(F.col("b")).alias("g"), tx.slug(F.col("c")).alias("s"), tx.tokens(F.col("a")).alias("n")).collect()
    assert (row[0].l, row[0].g, row[0].s, row[0].n) == ("ctvrta skola", ["  w", " wo", "wor", "ord", "rd "], "über-uns-co-42", 2)
    assert (row[1].l, row[1].n) == (None, 0)


# --- documents ------------------------------------------------------------------------------------------------------

MARKDOWN = """# Title

A paragraph that
wraps over lines.

Sub
---

| a | b |
|---|---|
| 1 | 2 |

- one
  - nested

  more of one
- two

```py
x = 1

# no heading
```

> quoted
> still

Last café line.
"""


def kinds(text):
    return [(k, text[a:b]) for k, a, b in D.blockize(text)]


def test_blocks_of_a_mixed_document():
    got = kinds(MARKDOWN)
    assert [k for k, _ in got] == ["heading", "paragraph", "heading", "table", "list_item", "list_item", "code", "quote", "paragraph"]
    assert got[4][1].endswith("more of one") and got[6][1].startswith("```py") and got[6][1].endswith("```")


def test_block_hashes_ignore_reflow_and_line_ends_and_change_alone():
    hashes = lambda t: [D.block_text(raw) for _, raw in kinds(t)]
    base = hashes(MARKDOWN)
    assert hashes(MARKDOWN.replace("\n", "\r\n")) == base
    assert hashes(MARKDOWN.replace("that\nwraps", "that wraps")) == base
    changed = hashes(MARKDOWN.replace("still", "changed"))
    assert sum(a != b for a, b in zip(base, changed)) == 1 and len(base) == len(changed)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab #>-*`|~\n\r\t1.=_", max_size=120))
def test_blocks_are_ordered_disjoint_and_lose_no_words(text):
    spans = D.blockize(text)
    assert all(a < b for _, a, b in spans) and all(x[2] <= y[1] for x, y in zip(spans, spans[1:]))
    covered = set()
    for _, a, b in spans:
        covered.update(range(a, b))
    assert all(i in covered for i, c in enumerate(text) if c in "ab")


SECTION = "doc_id long, section_id string, title string, role string, char_start int, char_end int, summary string, children array<string>"


def snapped(spark, blocks, proposed):
    b = spark.createDataFrame(blocks, "doc_id long, ordinal int, char_start int, char_end int")
    return {(r.doc_id, r.node_path): r for r in D.snapped_sections(b, spark.createDataFrame(proposed, SECTION)).collect()}


def test_snapped_sections_tile_their_parents(spark):
    rng = random.Random(5)
    blocks, proposed = [], []
    for doc in range(60):
        n = rng.randrange(13)
        blocks += [(doc, i, i * 10, i * 10 + 8) for i in range(n)] * rng.choice([1, 1, 2])
        for i in range(rng.randrange(12)):
            a = rng.randrange(-5, 130)
            kids = [f"s{rng.randrange(14)}" for _ in range(rng.randrange(3))]
            proposed.append((doc, f"s{i}", "t", rng.choice(["body", " Methods", "odd", None]), a, a + rng.randrange(-10, 90), None, kids or None))
    out = snapped(spark, blocks, proposed)
    size = {doc: len({o for d, o, *_ in blocks if d == doc}) for doc in range(60)}
    for (doc, path), r in out.items():
        if path == "0":
            assert (r.parent_path, r.block_start, r.block_end) == (None, 0, size[doc] - 1)
        else:
            up = out[doc, r.parent_path]
            assert up.block_start <= r.block_start <= r.block_end <= up.block_end and r.role in ("body", "methods")
        kids = sorted((k.block_start, k.block_end) for (d, _), k in out.items() if d == doc and k.parent_path == path)
        assert all(x[1] + 1 == y[0] for x, y in zip(kids, kids[1:])) and (not kids or kids[-1][1] == r.block_end)
    assert len(out) > 100 and max(p.count(".") for _, p in out) > 2


def test_siblings_on_one_block_leave_their_children_to_the_longest(spark):
    blocks = [(1, i, i * 100, i * 100 + 99) for i in range(10)]
    tree = [
        (1, "a", "Short", "body", 3, 40, None, ["adopted"]), (1, "b", "Long", " Methods", 1, 1000, "how", ["kept"]),
        (1, "kept", "Kept", "body", 200, 260, None, None), (1, "adopted", "Adopted", "body", 300, 360, None, None),
    ]
    out = snapped(spark, blocks, tree)
    assert [(p, r.title, r.block_start, r.block_end) for (_, p), r in sorted(out.items())] == [("0", "", 0, 9), ("0.0", "Long", 0, 9), ("0.0.0", "Kept", 2, 2), ("0.0.1", "Adopted", 3, 9)]
    assert out[1, "0.0"].role == "methods" and out[1, "0.0"].summary == "how" and (out[1, "0.0.0"].char_start, out[1, "0.0.0"].char_end) == (200, 299)


def test_odd_proposals_end_at_the_root(spark):
    blocks = [(doc, i, i * 10, i * 10 + 9) for doc in (1, 2, 3, 5) for i in range(5)]
    chain = [(3, f"c{i:02}", f"level {i}", "body", 5, 45, None, [f"c{i + 1:02}"]) for i in range(40)]
    rows = [
        (1, "far", "Far", "body", 10_000, 10_100, None, None), (1, "back", "Back", "body", 30, 20, None, None), (1, "point", "Point", "body", 20, 20, None, None), (1, "open", "Open", "body", None, 5, None, None),
        (2, "mid", "Middle", "methods", 20, 40, None, ["out", "in", "mid"]), (2, "out", "Escapee", "body", 0, 10, None, None), (2, "in", "Inner", "body", 30, 35, None, ["mid"]),
        (4, "x", "Nothing", "body", 0, 9, None, None), (None, "y", "No document", "body", 0, 9, None, None), (5, None, "No id", "body", 0, 9, None, None), *chain,
    ]
    out = snapped(spark, blocks, rows)
    assert [p for d, p in sorted(out) if d == 1] == ["0"] and out[4, "0"].block_end == -1 and [p for d, p in sorted(out) if d == 5] == ["0"]
    assert {(p, r.title) for (d, p), r in out.items() if d == 2} == {("0", "")}  # the listed ones loop, so none is a root
    assert max(p.count(".") for d, p in out if d == 3) == D.DEPTH - 1
    straight = [r if r[1] != "in" else (*r[:7], None) for r in rows]
    out = snapped(spark, blocks, straight)
    assert {(p, r.title) for (d, p), r in out.items() if d == 2} == {("0", ""), ("0.0", "Middle"), ("0.0.0", "Inner")}
    assert snapped(spark, [], []) == {}


BLOCK = "doc_id long, ordinal int, section int, char_start int, char_end int, tokens int, block_hash string"


def test_chunks_keep_sections_and_anchors(spark):
    rows = [(1, i, 0 if i < 30 else 30, i * 10, i * 10 + 9, 60 if i != 11 else 900, ("0" * 16 if i == 20 else "f" * 15 + "1") + "x") for i in range(40)]
    got = D.chunks(spark.createDataFrame(rows + rows[:3], BLOCK)).orderBy("chunk_no").collect()
    assert [r.chunk_no for r in got] == list(range(len(got)))
    assert [b for r in got for b in range(r.block_start, r.block_end + 1)] == list(range(40))
    assert all(r.tokens <= 400 for r in got if (r.block_start, r.block_end) != (11, 11)) and any((r.block_start, r.block_end) == (11, 11) for r in got)
    assert {20, 30} <= {r.block_start for r in got}
    assert D.chunks(spark.createDataFrame([], BLOCK)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.booleans()), min_size=1, max_size=40), st.integers(0, 12))
def test_cuts_fill_the_budget_and_begin_at_anchors(blocks, gap):
    tokens, anchor = np.array([t for t, _ in blocks]), np.array([a for _, a in blocks])
    begins = D.cuts(tokens, anchor, 10, gap)
    ends = [*begins[1:], len(blocks)]
    marks, last = set(), None
    for i in np.flatnonzero(anchor):  # tokens since the last anchor that counted
        if last is None or tokens[last:i].sum() >= gap:
            marks.add(int(i))
            last = i
    assert begins[0] == 0 and marks <= set(begins) and sorted(set(begins)) == begins
    for a, b in zip(begins, ends):
        assert b - a == 1 or tokens[a:b].sum() <= 10
        assert b in marks or b == len(blocks) or tokens[a : b + 1].sum() > 10


def test_an_edit_moves_chunks_only_up_to_the_next_anchor(spark):
    make = lambda head: [(1, i, 0, i * 10, i * 10 + 9, head if i == 0 else 9, f"{24 * i if i in (12, 25) else 24 * i + 1:016x}") for i in range(40)]
    first, second = ({(r.block_start, r.chunk_hash) for r in D.chunks(spark.createDataFrame(make(h), BLOCK), budget=25, gap=0).collect()} for h in (3, 20))
    assert first != second and {x for x in first if x[0] >= 12} == {x for x in second if x[0] >= 12} and {12, 25} <= {a for a, _ in first}


def test_parents_keep_the_blocks_between_their_children(spark):
    owner = [0, 0, 0, 1, 1, 0, 0, 2, 2]
    rows = [(1, i, owner[i], i * 10, i * 10 + 9, 5, "f") for i in range(9)]
    got = D.chunks(spark.createDataFrame(rows, BLOCK)).orderBy("chunk_no").collect()
    assert [(r.section, r.block_start, r.block_end) for r in got] == [("0", 0, 2), ("1", 3, 4), ("0", 5, 6), ("2", 7, 8)]


def test_owner_is_the_deepest_section(spark):
    blocks = spark.createDataFrame([(1, i) for i in range(4)], "doc_id long, ordinal int")
    sections = spark.createDataFrame([(1, "0", 0, 3), (1, "0.0", 1, 2), (1, "0.0.0", 2, 2)], "doc_id long, node_path string, block_start int, block_end int")
    assert [r.node_path for r in D.owners(blocks, sections).orderBy("ordinal").collect()] == ["0", "0.0", "0.0.0", "0"]


def test_files_and_watching(spark, tmp_path):
    (tmp_path / "a.md").write_text("x")
    (tmp_path / "b.bin").write_text("y")
    rows = D.read_files(spark, str(tmp_path)).collect()
    assert [r.source_ref.rsplit("/", 1)[1] for r in rows] == ["a.md"] and rows[0].content_hash.startswith("2d711642")


# --- graph ----------------------------------------------------------------------------------------------------------


def edges_of(spark, pairs):
    return spark.createDataFrame([(a, b, f"e{i:03}") for i, (a, b) in enumerate(pairs)], "src string, dst string, edge_id string")


CLIQUES = [(a, b) for g in ("abcd", "efgh") for i, a in enumerate(g) for b in g[i + 1 :]] + [("d", "e")]


def test_two_cliques_are_two_communities_and_one_component(spark):
    df = edges_of(spark, CLIQUES)
    got = {r.id: r.community for r in graph.communities(df).collect()}
    assert got == {**dict.fromkeys("abcd", "a"), **dict.fromkeys("efgh", "e")}
    assert {r.component for r in graph.components(df).collect()} == {"a"}
    assert {r.core for r in graph.core_numbers(df).collect()} == {3}


def test_core_numbers_and_pagerank_against_brute_force(spark):
    rng = random.Random(2)
    names = [f"n{i}" for i in range(20)]
    pairs = [tuple(rng.sample(names, 2)) for _ in range(45)]
    df = edges_of(spark, pairs)
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    core, k = {}, 0
    left = {n: set(v) for n, v in near.items()}
    while left:
        k = max(k, min(len(v) for v in left.values()))
        n = min(left, key=lambda x: len(left[x]))
        core[n] = k
        for m in left.pop(n):
            left[m].discard(n)
    assert {r.id: r.core for r in graph.core_numbers(df).collect()} == core
    order = sorted(near)
    m = np.zeros((len(order), len(order)))
    for a, b in pairs:
        m[order.index(a), order.index(b)] += 1
        m[order.index(b), order.index(a)] += 1
    m /= m.sum(axis=0)
    v = np.full(len(order), 1 / len(order))
    for _ in range(20):
        v = 0.15 / len(order) + 0.85 * m @ v
    got = {r.id: r["rank"] for r in graph.pagerank(df).collect()}
    assert all(got[n] == pytest.approx(v[i]) for i, n in enumerate(order)) and sum(got.values()) == pytest.approx(1)


def test_paths_keep_direction_and_take_the_smallest(spark):
    df = edges_of(spark, [("a", "x"), ("y", "a"), ("x", "z"), ("y", "z"), ("z", "q"), ("a", "x")])
    got = graph.path(df, "a", "q").collect()
    assert [(r.hop, r.node) for r in got] == [(0, "a"), (1, "x"), (2, "z"), (3, "q")] and got[1].edge_id == "e000"
    assert graph.path(df, "a", "q", max_hops=2).count() == 0
    assert [r.node for r in graph.path(df, "a", "q", directed=True).collect()] == ["a", "x", "z", "q"]
    back = graph.path(df, "z", "y").collect()
    assert (back[1].src, back[1].dst) == ("y", "z") and graph.path(df, "z", "y", directed=True).count() == 0


def test_neighborhood_leaves_the_start_out(spark):
    df = edges_of(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")])
    assert {(r.id, r.hops) for r in graph.neighborhood(df, "a", 2).collect()} == {("b", 1), ("c", 1), ("d", 2)}
    assert graph.neighborhood(df, "nobody", 2).count() == 0


# --- ranking and resolution -----------------------------------------------------------------------------------------


def test_a_repeated_id_does_not_forge_agreement(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "x", 2), ("a", "y", 3), ("b", "y", 1)], "channel string, id string, rank int")
    got = ranking.fuse(df).collect()
    assert [r.id for r in got] == ["y", "x"] and got[1].score == pytest.approx(1 / 61) and set(got[0].contributions) == {"a", "b"}


def test_missing_signal_sorts_last(spark):
    df = spark.createDataFrame([("a", 0.9, None, 1), ("b", 0.1, 2, None), ("c", 0.5, 1, 5)], "id string, score double, graph_distance int, evidence_count int")
    assert [r.id for r in ranking.rerank(df, "graph_distance").collect()] == ["c", "b", "a"]
    with pytest.raises(P.Boundary):
        ranking.rerank(df, "cross_encoder")


def test_cosine_of_odd_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0, 1.0], [2.0, 2.0])], "a array<double>, b array<double>")
    assert [round(r[0], 9) for r in df.select(ranking.cosine(F.col("a"), F.col("b"))).collect()] == [0, 0, 1]


def test_centroid_clusters():
    ids, vs = ["c", "a", "b", "z"], [[1, 0], [1, 0.05], [0, 1], None]
    assert resolve.agglomerate(ids, vs) == [["a", "c"], ["b"], ["z"]]
    assert resolve.agglomerate([], []) == []


def test_pair_judgement(spark):
    df = spark.createDataFrame([("Šimek", "simek", None, None), ("Kowalski", "Zeman", None, None), ("Meier", "Meyer", [1.0, 0.0], [0.0, 1.0]), ("Meier", "Meyer", None, None)], "surface_a string, surface_b string, vector_a array<double>, vector_b array<double>")
    assert [r.outcome for r in resolve.judge_pair(df).collect()] == ["accept", "reject", "reject", "escalate"]


def test_observations_of_one_subject_in_order(spark):
    rows = [("s", "1", "revenue was 5 million", 1), ("s", "2", "revenue was 5 million", 2), ("s", "3", "revenue was 7 million", 3), ("s", "4", "the office moved", 4), ("s", "5", "the office moved to town", 5), ("t", "6", "the office moved", 1)]
    got = {r.observation_id: (r.outcome, r.related_id) for r in facts.observation_batch(spark.createDataFrame(rows, "subject string, observation_id string, statement string, seq int")).collect()}
    assert got == {"1": ("add", None), "2": ("evidence", "1"), "3": ("contradict", "1"), "4": ("add", None), "5": ("supersede", "4"), "6": ("add", None)}


def test_shards_stop_where_names_no_longer_differ(spark):
    df = spark.createDataFrame([("d", f"aaaa{i}", i) for i in range(10)] + [("d", "B-1", 99), ("d", "b?", 98)], "directory string, name string, doc_id int")
    assert {r.directory for r in tree.shard(df, threshold=5).collect()} == {"d/a", "d/b"}


# --- windows, recipes, answers --------------------------------------------------------------------------------------


def test_half_open_windows(spark):
    df = spark.createDataFrame([("2024-01-01", "2024-02-01"), ("2024-01-01", "2024-01-01"), (None, "2024-01-01"), (None, None)], "a string, b string").select(F.col("a").cast("timestamp_ntz").alias("valid_from"), F.col("b").cast("timestamp_ntz").alias("valid_until"))
    assert df.where(temporal.valid_at("2024-01-01 00:00:00")).count() == 2 and df.where(temporal.valid_at("2024-02-01 00:00:00")).count() == 1


def test_linter_and_arguments():
    bad = [
        recipes.Recipe("r", 1, "fact", "lookup", ()),
        recipes.Recipe("r", 1, "fact", "lookup", (recipes.Step("a", "nothing"),)),
        recipes.Recipe("r", 1, "fact", "lookup", (recipes.Step("a", "fuse", inputs=("b",)),)),
        recipes.Recipe("r", 1, "page", "lookup", (recipes.Step("a", "fuse"),)),
        recipes.Recipe("r", 1, "evidence", "current_facts", (recipes.Step("a", "search_claims"),)),
        recipes.Recipe("r", 1, "fact", "audit", (recipes.Step("a", "lookup_relations"),)),
        recipes.Recipe("r", 1, "fact", "lookup", (recipes.Step("a", "lookup_relations", bind={"x": "y"}),)),
    ]
    for r in bad:
        with pytest.raises(recipes.RecipeError):
            recipes.lint(r)
    seeds = recipes.seeds()
    assert len(seeds.names()) == 12 and not seeds.register(recipes.Recipe("explain", 1, "evidence", "audit", (recipes.Step("w", "hydrate_relation"),)))
    params = (recipes.Param("k", "integer", False, 5, 1, 9), recipes.Param("id", "uuid"))
    assert recipes.coerce(params, {"id": "A" * 32}) == {"k": 5, "id": "aaaaaaaa-aaaa-aaaa-aaaa-aaaaaaaaaaaa"}
    for given_ in ({}, {"id": "x"}, {"id": "A" * 32, "k": 10}, {"id": "A" * 32, "z": 1}):
        with pytest.raises(recipes.RecipeError):
            recipes.coerce(params, given_)
    assert recipes.descriptor(seeds.latest("graph_path"))["inputSchema"]["properties"]["max_hops"] == {"type": "integer", "minimum": 1, "maximum": 6, "default": 4}


def test_every_seeded_recipe_runs(world):
    given_ = {"name": "Bob", "entity_id": "c", "since": "2024-01-01", "text": "alice acme", "relation_id": "r1", "to_id": "a", "predicate": "works_for"}
    for name in recipes.seeds().names():
        wanted = {p.name for p in recipes.seeds().latest(name).params}
        answer = world.recipe(name, **{k: v for k, v in given_.items() if k in wanted})
        assert answer.negative == "boundary" if answer.rows is None else answer.rows.count() >= 0, name


@pytest.fixture(scope="module")
def world(spark):
    entities = spark.createDataFrame([("a", "Person", "Alice", "active", None), ("n", "Person", "A. Nowak", "merged", "a"), ("b", "Person", "Bob", "active", None), ("c", "Organization", "Acme", "active", None)], "entity_id string, type string, canonical_name string, status string, merged_into string")
    aliases = spark.createDataFrame([("1", "n", "nowak"), ("2", "b", "bob")], "alias_id string, entity_id string, lemma string")
    stamp = lambda *cols: lambda df: df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})
    rel = spark.createDataFrame([("r1", "n", "works_for", "c", None, None, "2024-01-02", None, 3), ("r2", "b", "works_for", "c", None, "2024-02-01", "2024-01-01", None, 2), ("r3", "b", "founded", "c", None, None, "2024-01-01", "2024-01-05", 1)],
                                "relation_id string, subject string, predicate string, object string, valid_from string, valid_until string, ingested_at string, invalidated_at string, evidence_count int").transform(stamp("valid_from", "valid_until", "ingested_at", "invalidated_at")).withColumn("fact_label", F.lit(None).cast("string"))
    obs = spark.createDataFrame([("o1", "c", "ten people", None, None, "2024-01-03", None, 1)], "observation_id string, subject string, statement string, valid_from string, valid_until string, ingested_at string, invalidated_at string, evidence_count int").transform(stamp("valid_from", "valid_until", "ingested_at", "invalidated_at"))
    claims = spark.createDataFrame([("k1", "d1", "Alice works for Acme", True, "2024-01-02"), ("k2", "d2", "Bob left Acme", True, "2024-01-03"), ("k3", "d2", "Acme was sold", False, "2024-01-03")], "claim_id string, doc_id string, claim_text string, is_current boolean, ingested_at string").transform(stamp("ingested_at"))
    ev = spark.createDataFrame([("r1", "k1", "supports")], "relation_id string, claim_id string, stance string")
    return engine.Engine({"entities": entities, "aliases": aliases, "relations": rel, "observations": obs, "claims": claims, "evidence": ev}, "2024-03-01 00:00:00")


def test_answers(world):
    assert [r.entity_id for r in world.resolve("Nowak").rows.collect()] == ["a"]
    assert world.resolve("nobody").negative == "unknown_entity"
    assert [r.relation_id for r in world.lookup_relations().rows.collect()] == ["r1"]
    assert [r.relation_id for r in world.lookup_relations("2024-01-15 00:00:00").rows.collect()] == ["r1", "r2"]
    assert world.lookup_observations("a").negative == "known_empty"
    assert [r.claim_id for r in world.search_claims("who works for acme").rows.collect()] == ["k1", "k2"]
    assert [r.claim_id for r in world.recipe("claims_hybrid_rrf", text="alice acme").rows.withColumnRenamed("id", "claim_id").collect()][0] == "k1"
    assert [r.claim_id for r in world.recipe("explain", relation_id="r1").rows.collect()] == ["k1"]
    assert {r.id for r in world.neighborhood("a", 2).rows.collect()} == {"c"}
    then = {"valid_at": "2024-01-15 00:00:00", "limit": 1}
    page = world.neighborhood("a", 2, **then)
    assert page.truncated and (page.applied["returned"], page.applied["total"]) == (1, 2) and [r.id for r in page.rows.collect()] == ["c"]
    rest = world.neighborhood("a", 2, **then, continuation=page.continuation)
    assert not rest.truncated and rest.continuation is None and [r.id for r in rest.rows.collect()] == ["b"]
    assert world.neighborhood("b", 2, continuation=page.continuation).negative == "boundary" and world.neighborhood("x").negative == "unknown_entity"
    assert world.neighborhood("a", 2, predicates=("founded",)).applied["total"] == 0
    assert world.aggregate("group_by_object", limit=1, subject="b").truncated is False and world.scan("claim").rows.count() == 3 and world.scan("dream").negative == "boundary"
    assert [(r.related_id, r.outcome) for r in world.transcript("entity", "a").rows.collect()] == [("n", "merged")] and world.transcript("relation", "r1").negative == "boundary"
    assert world.rerank(world.search_claims("who works for acme"), "mood").negative == "boundary"
    assert {r.id for r in world.neighborhood("a", 2, valid_at="2024-01-15 00:00:00").rows.collect()} == {"c", "b"}
    assert [r.node for r in world.path("a", "b", valid_at="2024-01-15 00:00:00").rows.collect()] == ["a", "c", "b"]
    assert world.aggregate("median").negative == world.aggregate("timeline").negative == "boundary"


def test_paging_loses_and_repeats_nothing(world):
    got, token = [], None
    while True:
        page = world.delta("2023-01-01 00:00:00", limit=2, continuation=token)
        got += [(r.id, r.change) for r in page.rows.collect()]
        token = page.continuation
        if not page.truncated:
            break
    assert len(got) == len(set(got)) == 9
    with pytest.raises(P.Boundary):
        world.delta("2023-01-01 00:00:00", continuation="???")


# --- snapshots and streams ------------------------------------------------------------------------------------------


def test_an_older_build_never_takes_the_pointer(spark, tmp_path):
    one, two = spark.range(5), spark.range(7)
    root = str(tmp_path / "snap")
    assert snapshots.publish(spark, root, "v2", "2024-02-01", {"t": two})
    assert not snapshots.publish(spark, root, "v1", "2024-01-01", {"t": one})
    assert snapshots.latest(spark, root)["t"].count() == 7
    two.limit(6).write.mode("overwrite").parquet(f"{root}/v2/t")
    with pytest.raises(ValueError, match="damaged"):
        snapshots.latest(spark, root)


def test_tree_files_stay_below_the_root(spark, tmp_path):
    snapshots.write_tree(spark.createDataFrame([("a/b.md", "x")], "path string, content string"), str(tmp_path))
    assert (tmp_path / "a" / "b.md").read_text() == "x"


def test_streamed_windows_equal_the_batch(spark, tmp_path):
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType())])
    rows = spark.range(200).select("id", F.timestamp_seconds(1_700_000_000 + F.col("id") * 37).alias("ts"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("event_type"), (F.col("id") % 5).cast("double").alias("value")).withColumnRenamed("id", "event_id")
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = streaming.windows(streaming.appended(spark, str(tmp_path / "in"), schema, 1), "10 minutes", late="1 day")
    q = stream.writeStream.outputMode("update").foreachBatch(lambda df, i: seen.append({tuple(r[:3]): tuple(r[3:]) for r in df.collect()})).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    merged = {}
    for batch in seen:
        merged.update(batch)
    want = {tuple(r[:3]): tuple(r[3:]) for r in streaming.windows(rows, "10 minutes").collect()}
    assert merged == want and sum(n for n, _ in merged.values()) == 200


# --- conversion and extraction --------------------------------------------------------------------------------------


def test_html_and_unrouted_files(spark):
    html = b"<html><head><title>x</title><style>p{}</style></head><body><h2>Top</h2><p>One <b>two</b></p><ul><li>a</li><li>b</li></ul><pre>x = 1</pre><script>bad()</script></body></html>"
    files = spark.createDataFrame([("a", "text/html; charset=utf-8", bytearray(html)), ("b", "text/plain", bytearray(b"\xff")), ("c", "image/png", bytearray(b"x")), ("d", None, None)], "source_ref string, mime string, content binary")
    got = {r.source_ref: (r.markdown, r.error) for r in D.convert(files).collect()}
    assert got["a"][0] == "## Top\n\nOne two\n\n- a\n- b\n\n```\nx = 1\n```\n"
    assert [got[k] for k in "bcd"] == [(None, "undecodable"), (None, "unrouted"), (None, "unrouted")]


def test_sentences_slice_the_text():
    text = "# Title\n\nThe first statement has words. Is this kept? Short one.\n\nAnother long statement stands here!"
    got = D.sentences(text)
    assert all(text[a:b] == s for s, a, b, _ in got)
    assert [s for s, _, _, keep in got if keep] == ["The first statement has words.", "Another long statement stands here!"]


def test_graph_analytics_cover_the_live_projection(spark):
    import __spark_entry__ as entry

    d, queries = "/root/testdata/sf0.001", entry.queries()
    want = {r.id for r in queries["g11_degree"](spark, d).collect()}
    for name in ("g7_pagerank", "g9_live_components"):
        assert {r.id for r in queries[name](spark, d).collect()} == want, name


def test_reconciling_a_cycle_counts_and_closes(spark):
    claims = spark.createDataFrame([("k1", True), ("k2", True), ("k3", True)], "claim_id string, is_current boolean")
    ledger_ = spark.createDataFrame([], "event_id string, claim_id string, became_current boolean, seq int")
    moves = spark.createDataFrame([("e1", "k1", False, 1), ("e2", "k2", False, 1), ("e2", "k2", True, 9)], ledger_.schema)
    ev = spark.createDataFrame([("r1", "k1", "d1", "supports"), ("r2", "k2", "d1", "supports"), ("r2", "k3", "d2", "supports")], "relation_id string, claim_id string, doc_id string, stance string")
    rel = spark.createDataFrame([("r1", 1, 0, None, None), ("r2", 2, 0, None, None)], "relation_id string, evidence_count long, contradict_count long, valid_until timestamp_ntz, invalidated_at timestamp_ntz")
    none = rel.limit(0)
    out = lifecycle.reconcile(claims, ledger_, moves, ev, rel, none, "2024-01-01 00:00:00")
    assert {r.relation_id: (r.evidence_count, r.valid_until is not None) for r in out["relations"].collect()} == {"r1": (0, True), "r2": (1, False)}
    assert {r.claim_id: r.is_current for r in out["claims"].collect()} == {"k1": False, "k2": False, "k3": True} and out["ledger"].count() == 2
    lossy = lifecycle.reconcile(claims, ledger_, moves, ev, rel, none, "2024-01-01 00:00:00", lossy=True)
    assert all(r.valid_until is None for r in lossy["relations"].collect()) and lossy["closed"].count() == 0
    assert lifecycle.bound(spark.createDataFrame([("k1", "r1"), ("k9", "r1"), ("k1", "r9")], "claim_id string, relation_id string"), claims, rel).count() == 1


def test_identity_steps(spark):
    pairs = spark.createDataFrame([("same", 0.8, None), ("same", 0.7, "apart"), ("same", 0.7, None)], "verdict string, confidence double, second_verdict string")
    assert [(r.outcome, r.judge) for r in resolve.two_judges(pairs).collect()] == [("same", "first"), ("apart", "second"), ("apart", "second")]
    loose = spark.createDataFrame([("Acme", "Org", "T1"), ("ACME ", "Org", "T3"), ("Acme", "Person", "T2"), (None, "Org", "T1"), (" ", "Org", "T1")], "surface string, type string, rejected_by string")
    assert {(r.lemma, r.type, r.rejected_by) for r in resolve.mint(loose).collect()} == {("acme", "Org", "T3"), ("acme", "Person", "T2")}
    rel = spark.createDataFrame([("r1", "a"), ("r2", "b"), ("r3", "a")], "relation_id string, subject string")
    dec = spark.createDataFrame([("r1", "r2", "supersede"), ("r1", "r3", "supersede"), ("r2", "r3", "noop")], "relation_id string, related_id string, outcome string")
    parts = spark.createDataFrame([("a", 1), ("b", 2)], "entity_id string, part int")
    assert [tuple(r) for r in resolve.ripple(dec, rel, parts).collect()] == [("r1", "r2")]

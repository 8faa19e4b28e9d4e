"""Training-data operators against brute force, round trips and published tokenizers."""

import importlib
import itertools
import random
import re
import time

import pytest
from hypothesis import given, settings, strategies as st

from loomstone.operators import skew
from loomstone.llm import blocks as B, bpe, components, leaks, names, packing, residue, splitting

# --- components -----------------------------------------------------------------------------------------------------


def brute_groups(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            up[find(a)] = find(b)
    groups = {}
    for x in list(up):
        groups.setdefault(find(x), []).append(x)
    return {x: min(g) for g in groups.values() for x in g}


@pytest.mark.parametrize("shape", ["random", "chain", "star", "dirt"])
def test_components_match_union_find(spark, monkeypatch, shape):
    rng = random.Random(shape)
    if shape == "random":
        edges = [(f"{rng.randrange(400):03}", f"{rng.randrange(400):03}") for _ in range(300)]
    elif shape == "chain":
        edges = [(f"{i:03}", f"{i + 1:03}") for i in range(150)]
        rng.shuffle(edges)
    elif shape == "star":
        monkeypatch.setattr(components, "HEAVY_FLOOR", 20)
        monkeypatch.setattr(skew, "HEAVY_FLOOR", 20)
        edges = [("m", f"{i:03}") for i in range(300)] + [("000", "zz"), ("q", "r")]
    else:
        edges = [(None, "a"), ("a", None), ("a", "a"), ("b", "c"), ("c", "b"), ("b", "c"), ("", "x"), (None, None)]
    df = spark.createDataFrame([(*e, "x", 1) for e in edges], "a string, b string, id string, group_id int")
    assert {r.id: r.group_id for r in components.group(df).collect()} == brute_groups(edges)


def _largest_reads(spark, job):
    """(records read from shuffles by all tasks, median, largest) of each stage of four tasks or more that a job runs."""
    store = spark._jsc.sc().statusStore()
    stages = lambda: store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    before = {s.stageId() for s in _items(stages())}
    job()
    out = []
    for s in _items(stages()):
        if s.stageId() in before or s.numTasks() < 4:
            continue
        reads = sorted(t.taskMetrics().get().shuffleReadMetrics().recordsRead() for t in _items(store.taskList(s.stageId(), s.attemptId(), 10_000)) if t.taskMetrics().isDefined())
        if reads:
            out.append((sum(reads), reads[len(reads) // 2], reads[-1]))
    return out


def _items(seq):
    return [seq.apply(i) for i in range(seq.size())]


def test_members_of_one_giant_root_are_spread(spark, monkeypatch):
    """40 000 ids around one root: no task of a large stage reads more than twice the median."""
    monkeypatch.setattr(components, "HEAVY_FLOOR", 1000)
    monkeypatch.setattr(skew, "HEAVY_FLOOR", 1000)
    as_on_large_data = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    for name, value in as_on_large_data.items():
        spark.conf.set(name, value)
    try:
        df = spark.range(40_000).selectExpr("'m' as a", "concat(case when id % 2 = 0 then 'a' else 'z' end, id) as b")
        reads = _largest_reads(spark, lambda: components.group(df).write.format("noop").mode("overwrite").save())
    finally:
        for name in as_on_large_data:
            spark.conf.unset(name)
    large = [(m, top) for n, m, top in reads if n >= 20_000]
    assert large and all(top <= 2 * m for m, top in large), large
    assert components.group(df).select("group_id").distinct().count() == 1


def test_components_of_nothing_and_stars(spark):
    assert components.group(spark.createDataFrame([], "a string, b string")).count() == 0
    groups = spark.createDataFrame([(["b", "a", None, "b"],), ([],), (None,), (["c"],)], "ids array<string>")
    assert [tuple(r) for r in components.star(groups, "ids").collect()] == [("a", "b")]


# --- encoding -------------------------------------------------------------------------------------------------------

TEXTS = ["", " ", "  a", "Hello, world! don't WE'RE 'S", "<|endoftext|>", "\n\n x\r\n\ty  ", "日本語のテキスト", "é́ ‍👩‍🔬", "a" * 5000, "\x00\x1c\x85﻿", "ab" * 2000 + " 1234567"]


@pytest.fixture(scope="module")
def reference():
    tokenizers, vocabularies = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    t = tokenizers.Tokenizer.from_file(vocabularies.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_encoding_equals_the_published_tokenizer(reference):
    enc = bpe.Encoder(bpe.default_vocabulary())
    for text in TEXTS:
        assert enc.encode(text) == reference(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'aesdlt1.,é")), max_size=80))
def test_encoding_of_any_text(reference, text):
    assert bpe.encoder(bpe.default_vocabulary()).encode(text) == reference(text)


def test_encoded_table(spark, reference):
    rows = [(i, t, "clash") for i, t in enumerate([*TEXTS, None, "twice"])] + [(99, "twice", "clash"), (None, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.encode(df)
    assert got.columns == ["doc_id", "ids"]
    assert sorted(map(str, got.collect())) == sorted(str(type(got.first())(doc_id=k, ids=reference(t) if t else [])) for k, t, _ in rows)
    assert bpe.encode(df.limit(0)).count() == 0


# --- splitting ------------------------------------------------------------------------------------------------------


def cost(ends, total, natural, limit, overlap):
    parts = -(-(total - overlap) // (limit - overlap))
    even = (total - overlap) / parts + overlap
    sizes = [ends[0], *(b - a + overlap for a, b in zip(ends, ends[1:]))]
    return sum(natural.get(e, splitting.INSIDE) for e in ends[:-1]) + splitting.IMBALANCE * sum((s / even - 1) ** 2 for s in sizes)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 60), st.integers(5, 12), st.integers(0, 4), st.randoms(use_true_random=False))
def test_cuts_keep_the_limit_and_the_overlap(total, limit, overlap, rng):
    natural = {p: rng.choice([splitting.BLOCK_END, splitting.SENTENCE_END]) for p in range(1, total) if rng.random() < 0.25}
    ends = splitting.cuts(total, natural, limit, overlap)
    assert ends[-1] == total and ends == sorted(set(ends))
    assert ends[0] <= limit and all(b - a + overlap <= limit for a, b in zip(ends, ends[1:]))
    assert len(ends) == 1 or ends[0] >= overlap


@pytest.mark.parametrize("seed", range(12))
def test_cuts_at_natural_boundaries_cost_least(seed):
    rng = random.Random(seed)
    total, limit, overlap = 24, 10, 2
    natural = {p: rng.choice([0.0, 1.0]) for p in range(3, total, rng.choice([2, 3]))}
    best = min(
        cost([*mid, total], total, natural, limit, overlap)
        for k in range(1, 6)
        for mid in itertools.combinations(sorted(natural), k)
        if overlap < mid[0] <= limit and all(b - a + overlap <= limit for a, b in zip(mid, [*mid[1:], total]))
    )
    assert cost(splitting.cuts(total, natural, limit, overlap), total, natural, limit, overlap) == pytest.approx(best)


DOC = "doc_id long, text string, path string"
BLOCK = "doc_id long, block_ordinal int, node_path string, char_start int, char_end int, token_count int, text string"


def layout(paths_and_texts):
    """One text and its blocks."""
    text, spans = "", []
    for i, (path, part) in enumerate(paths_and_texts):
        spans.append((1, i, path, len(text), len(text) + len(part), None, "clash"))
        text += part + "\n\n"
    return text, spans


def test_pieces_of_long_sections(spark):
    sentence = "one two three four five six seven eight nine ten. "
    text, spans = layout([("0", "Title"), ("0.1", sentence * 30), ("0", "x " * 399), ("0.1", sentence * 25), ("0.2", "y" * 9000), (None, "z " * 401)])
    spans += [spans[1], (1, 90, "0.3", None, 5, 3, "t"), (1, 91, "0.3", 9, 2, 3, "t"), (None, 1, "0", 0, 5, 1, "t"), (2, 0, "0", 0, 5, 500, "t"), (1, None, "0", 0, 9, 1, "t")]
    docs = spark.createDataFrame([(1, text, "p"), (3, None, "p"), (4, "", None), (None, "x", None)], DOC)
    rows = splitting.pieces(docs, spark.createDataFrame(spans, BLOCK)).collect()
    long = sorted((r for r in rows if r.node_path == "0.1"), key=lambda r: r.piece_no)
    assert [r.section_tokens for r in long] == [550] * len(long) and len(long) == 2
    assert long[0].token_count + long[1].token_count == 590 and max(r.token_count for r in long) <= 400
    assert text[long[1].char_start : long[1].char_end].count("one") >= 25
    assert (long[0].block_start, long[1].block_end) == (1, 3)
    assert {(r.doc_id, r.node_path) for r in rows if r.section_tokens > 400} == {(1, "0.1"), (1, None)}
    assert {(r.node_path, r.token_count) for r in rows if r.doc_id == 1 and r.pieces == 1} == {("0", 400), ("0.2", 1), ("0.3", 0)}
    assert [(r.doc_id, r.token_count) for r in rows if r.doc_id != 1] == [(2, 0)]
    assert splitting.pieces(docs.limit(0), spark.createDataFrame([], BLOCK)).count() == 0


# --- packing --------------------------------------------------------------------------------------------------------


def test_hilbert_curve_visits_every_cell_and_moves_to_a_neighbour():
    np = pytest.importorskip("numpy")
    cells = np.array(list(itertools.product(range(8), repeat=3)))
    keys = packing.hilbert(cells, bits=3)
    walk = cells[np.argsort(keys)]
    assert sorted(keys) == list(range(512)) and (abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 400), max_size=40))
def test_bins_hold_every_item_once_and_leave_little_room(sizes):
    items = [(i, 0, s) for i, s in enumerate(sizes)]
    bins = list(packing.fill(items))
    assert sorted(x for b in bins for x in b) == items
    totals = [sum(t for _, _, t in b) for b in bins]
    assert all(t <= 400 for t in totals)
    assert len([t for t in totals if t <= 200]) <= 1  # two half-empty bins would have been one


def test_the_curve_decides_which_items_share_a_chunk():
    items = [(i, 0, 100) for i in range(400)]
    shuffled = random.Random(1).sample(items, 400)
    for order in (items, shuffled):
        assert list(packing.fill(order)) == [order[i : i + 4] for i in range(0, 400, 4)]
    rng = random.Random(2)
    reach = sorted(b[-1][0] - b[0][0] for b in packing.fill([(i, 0, rng.randrange(10, 200)) for i in range(3000)]))
    assert reach[len(reach) // 2] < 40


def test_little_room_is_left_beside_the_least_and_first_fit_decreasing():
    for seed in range(6):
        rng = random.Random(seed)
        items = [(i, 0, rng.choice([20, 33, 50, 77, 90, 130, 170, 230, 290, 350])) for i in range(3000)]
        bins: list[int] = []
        for t in sorted((t for _, _, t in items), reverse=True):
            at = next((i for i, b in enumerate(bins) if b + t <= 400), None)
            if at is None:
                bins.append(t)
            else:
                bins[at] += t
        mine, least = len(list(packing.fill(items))), -(-sum(t for _, _, t in items) // 400)
        assert mine <= 1.02 * least and mine <= 1.02 * len(bins)


def test_chunks_of_documents(spark, monkeypatch):
    monkeypatch.setattr(packing, "LOOK", 64)
    rng = random.Random(5)
    parts = [("0", "w%d " % i * rng.choice([0, 1, 50, 133, 200, 267, 399, 400, 401, 1000])) for i in range(300)]
    text, spans = layout(parts)
    blocks = spark.createDataFrame([*spans, spans[5], (7, 0, "0", 0, 4, None, "t"), (1, 999, "0", None, None, 4, "t")], BLOCK)
    rows = packing.pack(spark.createDataFrame([(1, text, "p"), (8, "unused", "p")], DOC), blocks).collect()
    assert all(r.token_count == sum(b.tokens for b in r.blocks) <= 400 for r in rows)
    tokens = {i: len(t.split()) for i, (_, t) in enumerate(parts)} | {999: 0}
    held = sorted((b.block_ordinal, b.part, b.tokens) for r in rows if r.doc_id == 1 for b in r.blocks)
    want = sorted((i, p, min(400, n - 400 * p)) for i, n in tokens.items() for p in range(max(1, -(-n // 400))))
    assert held == want and len({(r.doc_id, r.first_block, r.first_part) for r in rows}) == len(rows)
    assert [(r.doc_id, r.token_count) for r in rows if r.doc_id == 7] == [(7, 0)]
    needed = -(-sum(tokens.values()) // 400)
    room = {r.doc_id: r for r in packing.room(packing.pack(spark.createDataFrame([(1, text, "p")], DOC), blocks)).collect()}
    assert room[1].least_chunks == needed and room[1].tokens == sum(tokens.values()) and 0 <= room[1].unused < 0.1 and (room[7].least_chunks, room[7].unused) == (1, 1.0)
    assert sum(r.doc_id == 1 for r in rows) <= needed * 1.1 + 4


# --- leaks ----------------------------------------------------------------------------------------------------------


def test_words():
    assert leaks.words("Née, café_LE 3½ ﬁx Å\n-x") == ["nee", "cafe", "le", "31", "2", "fix", "a", "x"]
    assert leaks.words(None) == leaks.words("") == []


def test_leaks_match_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([5, 12, 25]))), " ".join(rng.choices(vocabulary, k=20))) for i in range(12)] + [(50, None, None), (51, "", "x")]
    docs = []
    for d in range(150):
        ws = rng.choices(vocabulary, k=rng.randrange(0, 60))
        if rng.random() < 0.7:
            src = rng.choice(items[:12])[rng.choice([1, 2])].split()
            a = rng.randrange(max(1, len(src) - 8))
            ws[rng.randrange(len(ws) + 1) : 0] = src[a : a + rng.randrange(7, 16)]
        docs.append((d, rng.choice([" ", "\n- ", ", ", "_"]).join(w.upper() if rng.random() < 0.1 else w for w in ws), 1))
    docs += [(900, None, 1), (901, "", 1), (None, docs[0][1], 1)]
    got = leaks.leaks(spark.createDataFrame(docs, "doc_id long, text string, item_id int"), spark.createDataFrame([*items, items[0]], "item_id long, question string, answer string"))
    found = {(r.doc_id, r.item_id) for r in got.collect() if r.run_words >= leaks.RUN}
    grams = lambda ws: {tuple(ws[i : i + 10]) for i in range(len(ws) - 9)}
    want = {(d, i) for d, t, _ in docs for i, q, a in items if d is not None and grams(leaks.words(t)) & (grams(leaks.words(q)) | grams(leaks.words(a)))}
    assert found == want and want


def test_edited_copies_are_aligned(spark):
    question = "When did the narrow gauge railway between the harbour and the old brick works close for the last time?"
    edited = "Notes. When did the narrow track railway between that harbour and the old brick works close for a final time? End."
    items = spark.createDataFrame([(1, question, "never")], "item_id long, question string, answer string")
    row = leaks.leaks(spark.createDataFrame([(5, edited)], "doc_id long, text string"), items).first()
    assert leaks.leaks(spark.createDataFrame([(5, edited), (5, edited)], "doc_id long, text string").coalesce(1), items).count() == 2  # repeated rows
    assert (row.doc_id, row.item_id, row.field) == (5, 1, "question") and row.run_words < leaks.RUN and row.score >= leaks.EDITED * 2 * row.item_words
    assert leaks.leaks(spark.createDataFrame([], "doc_id long, text string"), items).count() == 0
    assert leaks.leaks(spark.createDataFrame([(5, edited)], "doc_id long, text string"), items.limit(0)).count() == 0


def test_frequent_edited_copies_are_not_hidden_by_a_rare_one(spark):
    ws = [f"w{i}" for i in range(20)]
    edit = lambda *at: " ".join("other" if i + 1 in at else w for i, w in enumerate(ws))
    docs = [(i, edit(8, 16)) for i in range(30)] + [(99, edit(4, 12))]
    items = spark.createDataFrame([(1, " ".join(ws), None)], "item_id long, question string, answer string")
    got = leaks.leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
    assert sorted((r.doc_id, r.matched_words) for r in got) == [(d, 18) for d, _ in docs]


def test_edited_copies_of_a_part_are_aligned(spark):
    question, answer = [f"q{i}" for i in range(25)], [f"a{i}" for i in range(60)]
    part = ["before", *question[5:12], "other", *question[13:20], "after"]
    half = ["before", *("other" if i % 8 == 7 else w for i, w in enumerate(answer[:30])), "after"]
    few = ["before", *question[:7], "and", "so", "on", "until", question[20], "then"]
    items = spark.createDataFrame([(1, " ".join(question), " ".join(answer))], "item_id long, question string, answer string")
    docs = spark.createDataFrame([(i, " ".join(ws)) for i, ws in enumerate((part, half, few))], "doc_id long, text string")
    assert sorted((r.doc_id, r.field, r.matched_words) for r in leaks.leaks(docs, items).collect()) == [(0, "question", 14), (1, "answer", 27)]
    # a match before a slip counts with the nine after it; thin surroundings do not take a dense part down
    assert edited(answer, ["a0", "x", *answer[2:11]]) and not edited(answer, ["a0", "x", *answer[2:10]])
    assert edited(answer, [w if 20 <= i < 32 and i != 26 or i % 3 == 0 else "x" for i, w in enumerate(answer)])


def copied(text, begins, passage):
    parts = list(leaks.stretches(text, begins, passage))
    return parts and leaks.judged(leaks.aligned([(passage, p) for p in parts]), len(passage))


def brute_alignment(a, b):
    """Score and matched words of the best local alignment, and the longest run, cell by cell."""
    best, run, row, runs = (0, 0), 0, [(0, 0)] * (len(b) + 1), [0] * (len(b) + 1)
    for x in a:
        new, new_runs = [(0, 0)], [0]
        for j, y in enumerate(b):
            diagonal = (row[j][0] + 2, row[j][1] + 1) if x == y else (row[j][0] - 1, row[j][1])
            top = max(diagonal, (row[j + 1][0] - 1, row[j + 1][1]), (new[-1][0] - 1, new[-1][1]))
            new.append(top if top[0] > 0 else (0, 0))
            new_runs.append(runs[j] + 1 if x == y else 0)
        row, runs = new, new_runs
        best, run = max(best, *row), max(run, *runs)
    return *best, run


def test_alignment_of_many_pairs_is_that_of_each():
    rng = random.Random(10)
    pairs = [(rng.choices(range(9), k=rng.randrange(1, 30)), rng.choices(range(-1, 9), k=rng.randrange(1, 60))) for _ in range(400)]
    assert [x[:3] for x in leaks.aligned(pairs)] == [brute_alignment(a, b) for a, b in pairs]
    assert leaks.aligned([]) == []


def edited(a, b):
    words = {w: i for i, w in enumerate({*a, *b})}
    *_, run, part = leaks.aligned([([words[w] for w in a], [words[w] for w in b])])[0]
    return run >= leaks.RUN or part


def test_edited_copies_are_found_at_the_stated_rate():
    """300 planted passages of 20 words each among other words, with words replaced at random."""
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(2000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=20)), None) for i in range(300)]
    index = leaks.Index.of(items)

    def recall(rate):
        found = 0
        for i, question, _ in items:
            copy = [rng.choice(vocabulary) if rng.random() < rate else w for w in question.split()]
            text = index.read(" ".join([*rng.choices(vocabulary, k=40), *copy, *rng.choices(vocabulary, k=40)]))
            found += any(index.passages[n][0] == i and copied(text, begins, index.passages[n][2]) for n, begins in index.candidates(text))
        return found / len(items)

    assert recall(0.1) >= 0.98 and recall(0.2) >= 0.9


def test_seeds_are_those_of_brute_force():
    rng = random.Random(8)
    items = [(i, " ".join(rng.choices("abcdef", k=12)), None) for i in range(20)]
    index = leaks.Index.of(items)
    for _ in range(200):
        text = index.read(" ".join(rng.choices("abcdefx", k=rng.randrange(40))))
        want = set()
        for n, (_, _, passage) in enumerate(index.passages):
            at = [(i - j, j) for i in range(len(text) - 2) for j in range(len(passage) - 2) if text[i : i + 3] == passage[j : j + 3]]
            at.sort()
            want |= {n} if any(y[0] - x[0] <= leaks.DRIFT and x[1] != y[1] for x, y in zip(at, at[1:])) else set()
        assert {n for n, _ in index.candidates(text)} == want


def test_words_in_one_order():
    rng = random.Random(9)
    for _ in range(300):
        a, b = (rng.choices(range(6), k=rng.randrange(1, 25)) for _ in "ab")
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        assert leaks.in_order({x: sum(1 << i for i, y in enumerate(a) if x == y) for x in a}, len(a), b) == row[-1]


def test_items_in_blocks_give_the_same(spark, monkeypatch):
    items = [(i, " ".join(f"q{i}x{j}" for j in range(12)), None) for i in range(5)]
    docs = spark.createDataFrame([(i, q) for i, q, _ in items], "doc_id long, text string")
    monkeypatch.setattr(leaks, "BLOCK_WORDS", 20)
    got = leaks.leaks(docs, spark.createDataFrame(items, "item_id long, question string, answer string")).collect()
    assert sorted((r.doc_id, r.item_id, r.run_words) for r in got) == [(i, i, 12) for i in range(5)]


# --- residue --------------------------------------------------------------------------------------------------------

RESIDUE = [
    "Dear {{ first_name }}, welcome.", "Owner: [INSERT NAME]", "# Notes\n\nLorem ipsum dolor sit amet, magna urna velit.", "Error 404: Page not found", "404 Not Found",
    "Please enable JavaScript to view this page.", "THE REQUESTED VIEW COULD NOT BE LOADED.", "このページを表示するにはJavaScriptを有効にしてください。", "text text text text text.",
    "asdf asdf qwer qwer jkl asdf", "Real words stand here.\n\nAccess denied. You don't have permission to open this document.", "Due: dd/mm/yyyy", "- Site: %SITE%", "Dear __COMPANY__, hello.", "Owner: __page_title__", "Dear __insert_summary_here__.",
    "xxxxx xxx xxxx xx", "Your session has expired. Please sign in again to continue reading.", "To read this page, allow scripting in the settings.",
]
CONTENT = [
    'We removed the "lorem ipsum" blocks.', "Writers must replace every `{{ owner }}` mark.", "```\n<p>${body}</p>\n```\nThe template is above.", "The gateway answered 504 for 3 minutes, so the job kept retrying.",
    "The workspace needs JavaScript, a fact that Anna added to the list.", "In the notes [0] and [see section 4] the set {a, b} stands for two claims.", "Access to the archive was denied to Bob until noon.",
    "The key of the cabinet could not be found; Eva will look for it again.", "It rose by 5% and 6% to $4 and $5 in <b>May</b>.", "<|endoftext|> https://x.example/?a=0&b=%20", "# Title\n\n## People #1 and #2",
    "Who among them *first* noticed __that__ the grid stored 4 `slips` __at__ night?",
]


def kinds(text):
    return {kind for _, kind, sure in residue.messages(text) if sure}


@pytest.mark.parametrize("text", RESIDUE)
def test_residue_is_found(text):
    assert kinds(text), text


@pytest.mark.parametrize("text", CONTENT)
def test_talk_about_residue_is_left(text):
    assert not kinds(text), list(residue.messages(text))


@pytest.mark.parametrize("text", ["Our new product: Lorem ipsum dolor sit amet consectetur adipiscing elit", "Our new product\nLorem ipsum dolor sit amet consectetur adipiscing elit.", "Please be advised: lorem ipsum dolor sit amet, consectetur adipiscing elit"])
def test_residue_after_other_words(text):
    assert kinds(text) == {"filler"}


@pytest.mark.parametrize("n", [1, 10, 100, 5000])
def test_length_decides_nothing(n):
    assert kinds("please enable javascript and reload the page " + "x " * n) == {"script notice"}
    assert kinds("Please enable JavaScript in your browser settings " + "and then reload this page " * n) == {"script notice"}
    assert kinds("We are sorry, the page could not be loaded " + "because the server is down " * n) == {"error page"}
    assert kinds("The news of the day " * n + "lorem ipsum dolor sit amet consectetur adipiscing elit") == {"filler"}
    assert kinds("Dear {{ " + "very " * n + "long_name }}, hello") == {"placeholder"} and kinds("Dear [" + "very " * n + "long name], hello") == {"placeholder"}
    assert not kinds('"' + "Page not found. " * n + '" stood on the door.') and not kinds("`" + "page not found " * n + "` is printed.")
    assert not kinds("She told the story of the page that he could not find in the library " * n)


def flagged(lists):
    """How many texts there are, a fence with what it holds being one, and those that hold residue."""
    out, held = [], None
    for line in lists:
        if line == "```":
            held = [line] if held is None else out.append("\n".join([*held, line]))
        elif held is not None:
            held.append(line)
        else:
            out.append(line)
    return len(out), [t for t in out if kinds(t)]


@pytest.mark.parametrize("cases", ["residue_cases", "residue_heldout"])
def test_residue_of_common_pages_and_texts_that_look_like_it(cases):
    module = importlib.import_module(cases)
    all_, found = flagged(module.RESIDUE)
    others, wrong = flagged(module.LOOKALIKES)
    assert all_ >= 200 and others >= 200
    assert len(found) >= 0.9 * all_ and len(found) >= 0.9 * (len(found) + len(wrong)), (len(found) / all_, wrong)


def test_residue_of_texts_written_after_the_last_rule():
    """The blind figure that README gives: recall 0.61 on rarer wordings, nothing wrongly taken."""
    module = importlib.import_module("residue_fresh")
    all_, found = flagged(module.RESIDUE)
    assert len(found) >= 0.6 * all_ and not flagged(module.LOOKALIKES)[1]


def test_long_sentences_take_linear_time():
    began = time.perf_counter()
    for start in ("we could ", "0 0 0 0 ", "this file ", "error: error: ", "your browser ", "{{ name ", "[your ", "[" * 50, "lorem ", "%name ", "<a b "):
        list(residue.messages(start * 20_000 + "not be available"))
    assert time.perf_counter() - began < 20


PHRASES = [
    "Bitte aktivieren Sie Skripte.", "Bitte erlauben Sie Skripte in den Einstellungen.", "Aby zobaczyć te strone, włącz skrypty.", "Aby zobaczyć tę stronę, włącz obsługę.", "Twoja przeglądarka ma wyłączone skrypty.",
    "Dieser Browser blockiert Skripte.", "Váš prohlížeč má vypnuté skripty.", "Pro zobrazení stránky zapněte skripty.", "Body copy goes here", "Hier steht später Text.", "Tu będzie treść", "Tekst zastępczy", "Zde bude text",
    "Add two lines about the topic here", "Internal server error", "Too many requests", "Service unavailable", "We can't find what you're looking for", "We cannot find what you are looking for", "The page timed out",
    "Stránka nenalezena", "Nie znaleziono strony", "Seite nicht gefunden", "Die Seite konnte nicht angezeigt werden", "Blocked by the content filter", "An internal error while loading", "Strona nie istnieje",
    "The page you asked for is not on this server", "Please sign in again to read", "The file has been removed by an administrator", "The page failed to load", "Access has been limited for 5 minutes",
]


@pytest.mark.parametrize("text", PHRASES)
def test_short_messages_of_several_languages(text):
    assert kinds(text), text


def test_masks_group_equal_messages():
    assert residue.mask("HTTP 503 at 2024-01-02, see https://a.b/c?d=1 or 10.0.0.1 (id 5935f70c)") == "http 0 at 0, see @ or @ (id #)"


def test_weak_messages_need_wide_recurrence(spark):
    rows = [(i, "Try again later.", f"s{i % 2}", "x") for i in range(5)] + [(9, "Zkuste to později.", "s0", "x"), (10, None, "s", "x"), (11, " ", None, "x"), (None, "404 not found", None, "x")]
    rows += [(12, "404 not found", None, "x"), (12, "404 not found", None, "x"), (13, "y" * 100_000, "s", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, kind string")
    got = {(r.doc_id, r.kind, r.documents, r.sources) for r in residue.residue(df).collect()}
    assert got == {*((i, "recurring message", 5, 2) for i in range(5)), (12, "error page", 2, 1)}
    assert residue.residue(df.limit(0)).count() == 0


# --- names ----------------------------------------------------------------------------------------------------------

SAME = [
    ("Margaret Belminihol", "Peggy Belminihol"), ("Arnold Beltarvirji", "BELTARVIRJI, Arnold"), ("Dr. Anna K. Novotna", "anna van novotna"), ("L. Cataryorxa", "Lukas Cataryorxa"),
    ("David Belwenksahra", "David Belwenxahra"), ("Berta Bokcrodůbri", "Berta Bokcrodubro"), ("Hartwell Freight & Works Ltd", "Hartwell Freight Works Limited"), ("Hartwell F.W. s.r.o.", "Hartwell Freight Works"),
    ("Hartwell Frei. Work.", "The Hartwell Freight Works GmbH"), ("Freight Works Hartwell", "Hartwell Freight Works Inc."), ("Ida Krosten", "Ida Krosten-Malinova"), ("Hnaa Silpewenild", "Hana Silpewenild"),
]
APART = [
    ("Karel Hraholstawen", "Karela Hraholstawenova"), ("Alena Mezildund", "Ursula Mezildund"), ("Hartwell Freight Works", "Hartwell Timber Works"), ("Thomas Krosten", "Thomas Krosten Jr."),
    ("Anna", "Anna Krosten"), ("Jan Novak", "Jana Dvorak"), ("Karel Novak", "Karel Nova"), ("R. Krosten", "Ida Krosten"),
]


@pytest.mark.parametrize("a, b", SAME)
def test_spellings_of_one_name(a, b):
    x, y = names.parse(a), names.parse(b)
    assert names.same(x, y) and names.same(y, x)
    assert meet(names.block_keys(x, [1]), names.block_keys(y, [1]))


@pytest.mark.parametrize("a, b", APART)
def test_names_of_two_beings(a, b):
    assert not names.same(names.parse(a), names.parse(b)) and not names.same(names.parse(b), names.parse(a))


SHORT_CODES = [
    ("Petr Novak", "Petr Nobak"), ("Petr Novak", "Petr Novark"), ("Ivan Marek", "Ivan Malrek"), ("Ivan Kolar", "Ivan Kolsar"), ("Roger Moore", "Roger Morre"), ("Roger Moore", "Roger Moorse"), ("Adam Eliou", "Adam Eriou"), ("Adam Eliou", "Adam Eliour"),
]


@pytest.mark.parametrize("a, b", SHORT_CODES)
def test_slips_in_names_of_few_consonants_share_a_block(a, b):
    x, y = names.parse(a), names.parse(b)
    assert names.same(x, y) and meet(names.block_keys(x, [1]), names.block_keys(y, [1]))


BACKED = [("Katherine Johnson", "Kathryn Jonson"), ("Alexander Petrov", "Alex Petrov"), ("Christopher Adams", "Chris Adams"), ("Jennifer Brown", "Jen Brown"), ("Sara Lee", "Sarah Lee"), ("Karel Novak", "Karel Nova"), ("Ann Kim", "Anne Kim")]


@pytest.mark.parametrize("a, b", BACKED)
def test_common_names_with_agreeing_profiles(spark, a, b):
    df = spark.createDataFrame([("1", "person", a, "Leads cold storage in Brezna."), ("2", "person", b, "Cold storage lead at the new Brezna site."), ("3", "person", b, "Map tiles, Falkov.")], "id string, kind string, name string, profile string")
    assert {(r.id, r.group_id) for r in names.link(df).collect()} == {("1", "1"), ("2", "1")}


def test_agreeing_profiles_share_a_form(spark):
    rng = random.Random(3)
    words = "cold storage brezna map tiles falkov north seed".split()
    profiles = sorted({" ".join(sorted(rng.sample(words, rng.randrange(0, 7)))) for _ in range(250)})
    forms = {r.profile: set(r.besides) for r in names.profile_forms(spark.createDataFrame([(p,) for p in profiles], "profile string")).collect()}
    assert set(forms) == set(profiles) and any(len(f) > 3 for f in forms.values())
    for p, q in itertools.combinations(profiles, 2):
        assert not names.agree(p, q) or forms[p] & forms[q], (p, q)
    assert names.agree("", "") and not names.agree("", "cold") and names.agree("brezna cold storage", "brezna cold north storage") and not names.agree("brezna cold storage", "cold falkov storage")


def meet(x, y):
    """Whether two names share a block in which they are compared."""
    own, other = ({(k[0], k[1]) for k in keys} for keys in (x, y))
    return any(k == m and not (c and c == d) for k, c in own for m, d in other)


def test_large_blocks_are_cut_without_losing_a_link(spark, monkeypatch):
    rng = random.Random(4)
    given = ["Robert", "Bob", "R.", "Hana", "Ahna", "Jan", "Honza", "J.", "Katherine", "Kathryn", "Kate", "Ursula", "Uschi", "Viktorie", "Vicky", "Anna", "Ana", "Thomas", "Tom", "T.", "Zdenek", "Xaver", "Wolfgang", "Frie."]
    family = ["Silpewenild", "Silpewenilt", "Silpevenild", "Silpewenld"]
    people = sorted({(g, f, p) for g in given for f in family for p in ("cold storage Brezna", None) if rng.random() < 0.7}, key=str)
    df = spark.createDataFrame([(f"{i:03}", "person", f"{g} {f}", p) for i, (g, f, p) in enumerate(people)], "id string, kind string, name string, profile string")
    monkeypatch.setattr(names, "FEW", 1000)
    whole = {(r.id, r.group_id) for r in names.link(df).collect()}
    monkeypatch.setattr(names, "FEW", 2)
    assert {(r.id, r.group_id) for r in names.link(df).collect()} == whole
    monkeypatch.setattr(names, "LARGE", 5)
    assert {(r.id, r.group_id) for r in names.link(df).collect()} == whole
    for (g, f, p), (h, e, q) in itertools.combinations(people, 2):
        x, y = names.parse(f"{g} {f}"), names.parse(f"{h} {e}")
        if p == q and names.same(x, y, bool(p)):
            parts = lambda n: names.finer_keys(n, next(i for i, w in enumerate(n.words) if w.text.startswith("silp")))
            assert meet(names.block_keys(x, [0]), names.block_keys(y, [0])) and meet(parts(x), parts(y)), (x, y)


def test_names_without_profile_are_linked_by_spelling(spark):
    rows = [("1", "Robert Kelzulufal"), ("2", "Bob Kelzulufal"), ("3", "Jan Novotny"), ("4", "J. Novotny"), ("5", "Hana Silpewenild"), ("6", "Ahna Silpewenild"), ("7", "Karel Kelzulufal"), ("8", "Petr Novotny")]
    df = spark.createDataFrame([(i, "person", n, None) for i, n in rows], "id string, kind string, name string, profile string")
    assert sorted(map(tuple, names.pairs(names.link(df)).collect())) == [("1", "2"), ("3", "4"), ("5", "6")]


def test_jaro_winkler():
    assert names.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert names.jaro_winkler("dixon", "dicksonx") == pytest.approx(0.8133, abs=1e-4)
    assert names.jaro_winkler("", "a") == 0 and names.jaro_winkler("abc", "abc") == 1


def test_linked_entities(spark):
    rows = [
        ("1", "Person", "Margaret Belminihol", "Handles cold storage at the Brezna site."), ("2", "person", "Belminihol, Peggy", "Known from Brezna, cold storage desk."),
        ("3", "Concept", "M. Belminihol", "cold storage lead in BREZNA."), ("4", "Person", "Margaret Belminihol", "Contact for map tiles (Falkov)."),
        ("5", "Person", "Ida Krosten", "Based in Falkov; works on map tiles."), ("6", "Person", "Krosten Ida", None), ("7", "Person", "Margaret Belminihol", None),
        ("8", "Concept", "Blue Whale Migration", "About whales"), ("9", "Place", "Blue Whale Migration", "About whales"), ("1", "Person", "Margaret Belminihol", "Handles cold storage at the Brezna site."),
        (None, "Person", "Ida Krosten", None), ("10", "Person", None, "x"), ("11", "Person", "  ", "x"), ("12", None, "Ida Krosten", "Based in Falkov; works on map tiles."),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id string, kind string, name string, profile string, group_id string")
    got = names.link(df)
    assert {r.id: r.group_id for r in got.collect()} == {"1": "1", "2": "1", "3": "1", "5": "12", "6": "12", "12": "12"}
    assert sorted(map(tuple, names.pairs(got).collect())) == [("1", "2"), ("1", "3"), ("12", "5"), ("12", "6"), ("2", "3"), ("5", "6")]
    assert names.link(df.limit(0)).count() == 0


def test_long_text_of_one_token():
    assert len(B.TOKEN.findall("x" * 1_000_000)) == 1 and re.fullmatch(r"\S+", "x" * 10)

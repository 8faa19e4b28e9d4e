"""Queries of sources, documents, resolution, adjudication, ledger, tree and knowledge operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from loomstone.functions import text as tx
from loomstone.operators import documents as D, evals, facts, graph, knowledge as K, ledger, resolve, tree
from loomstone.plans.read import AT, S, VALID, spine, stamp
from loomstone.runtime import clean_id, table
from loomstone.sources.spine import oracle

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = oracle(sql)
        return f

    return register


# --- sources --------------------------------------------------------------------------------------------------------

_OBSERVED = "select concat('u', cast(user_id as string)) as lineage, event_type as content_hash, event_id as seq from {events}"


@query("with o as (select user_id, event_type, event_id, lag(event_type) over (partition by user_id order by event_id) as b from events) select concat('u', user_id) as lineage, row_number() over (partition by user_id order by event_id) as version_no, event_type as content_hash, event_id as seq from o where b is distinct from event_type")
def a3_version_append(spark, d):
    return D.appended_versions(spark.sql(_OBSERVED, events=table(spark, d, "events")))


@query("""with l as (select concat('r', p_partkey) as source_ref, p_size as revision, p_partkey % 7 <> 0 as quiet from part where p_partkey % 5 <> 0), k as (select concat('r', p_partkey) as source_ref, case when p_partkey % 3 = 0 then p_size + 1 else p_size end as known from part where p_partkey % 2 = 0)
 select source_ref, case when l.source_ref is null then 'deleted' when l.revision is not distinct from k.known then 'unchanged' when not quiet then 'debounced' else 'fetch' end as state from l full join k using (source_ref)""")
def a5_sync_cycle(spark, d):
    p = table(spark, d, "part").select(F.concat(F.lit("r"), "p_partkey").alias("source_ref"), "p_partkey", "p_size")
    listing = p.where("p_partkey % 5 <> 0").select("source_ref", F.col("p_size").alias("revision"), (F.col("p_partkey") % 7 != 0).alias("quiet"))
    known = p.where("p_partkey % 2 = 0").select("source_ref", F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("revision"))
    return D.poll(listing, known)


@query("with v as (select lower(trim(lineage_id)) as lineage, version_no, source from documents where deleted_at is null and trim(lineage_id) <> '') select lineage, arg_max(coalesce(source, ''), (version_no, coalesce(source, ''))) as revision from v group by lineage")
def a6_known_revisions(spark, d):
    v = table(spark, d, "documents").select(clean_id(F.col("lineage_id")).alias("lineage"), "version_no", F.coalesce("source", F.lit("")).alias("revision"), "deleted_at")
    return D.known_revisions(v.where("lineage is not null"))


@query("select distinct lower(coalesce(source, '')) as mime, case when regexp_matches(lower(coalesce(source, '')), '^(video|audio|image)/') then 'hot' else 'cold' end as class from documents")
def a10_storage_class(spark, d):
    m = table(spark, d, "documents").select(F.lower(F.coalesce("source", F.lit(""))).alias("mime")).distinct()
    return m.select("mime", D.storage_class(F.col("mime")).alias("class"))


@query("with u as (select c_custkey, c_acctbal, 0 as src, c_acctbal as ord from customer union all select c_custkey, c_acctbal + 1, 1, c_acctbal + c_custkey % 3 - 1 from customer where c_custkey % 4 = 0) select c_custkey, c_acctbal from u qualify row_number() over (partition by c_custkey order by ord desc, src desc) = 1")
def a17_upsert(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", F.col("c_acctbal").alias("ord"))
    new = c.where("c_custkey % 4 = 0").select("c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal"), (F.col("ord") + F.col("c_custkey") % 3 - 1).alias("ord"))
    return D.latest_upsert(c, new, "c_custkey", "ord").drop("ord")


@query("select vec_id, len(embedding) as n from embeddings where vec_id in (select user_id from events)")
def a18_vectors_by_id(spark, d):
    ids = table(spark, d, "events").select(F.col("user_id").alias("vec_id"))
    return table(spark, d, "embeddings").join(ids, "vec_id", "left_semi").select("vec_id", F.size("embedding").cast("long").alias("n"))


@query("""with v as (select lower(trim(lineage_id)) as l, version_no, doc_id, title from documents where deleted_at is null and trim(lineage_id) <> '') select l as lineage_id, version_no, doc_id, title from v qualify row_number() over (partition by l order by version_no desc, doc_id desc) = 1""")
def a13_corpus_export(spark, d):
    v = table(spark, d, "documents").where("deleted_at is null").select(clean_id(F.col("lineage_id")).alias("lineage_id"), "version_no", "doc_id", "title")
    return v.where("lineage_id is not null").groupBy("lineage_id").agg(F.max(F.struct("version_no", "doc_id", "title")).alias("m")).select("lineage_id", "m.*")


# --- blocks, sections, chunks ---------------------------------------------------------------------------------------


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return D.block_rows(table(spark, d, "documents"))


@query()
def j1_blocks(spark, d):
    return _blocks(spark, d)


@query()
def j2_snapped_sections(spark, d):
    b = table(spark, d, "blocks").select("doc_id", F.col("block_ordinal").alias("ordinal"), "char_start", "char_end")
    kids = F.transform("children", clean_id)
    s = table(spark, d, "proposed_sections").select("doc_id", clean_id(F.col("section_id")).alias("section_id"), "title", F.col("section_role").alias("role"), "char_start", "char_end", "summary", kids.alias("children"))
    return D.snapped_sections(b, s)


@query("""with b as (select distinct doc_id, block_ordinal as o, node_path as p from blocks where node_path is not null), x as (select doc_id, o, string_split(p, '.') as s from b),
 r as (select doc_id, array_to_string(s[1:k], '.') as path, k, min(o) as lo, max(o) as hi from (select *, unnest(range(1, len(s) + 1)) as k from x) group by all)
 select b.doc_id, b.o as ordinal, arg_max(r.path, (r.k, r.path)) as node_path from (select distinct doc_id, o from b) b join r on b.doc_id = r.doc_id and b.o between r.lo and r.hi group by all""")
def j3_owners(spark, d):
    """The deepest section whose range holds each block; ranges are those of the block grid's own paths and all their ancestors."""
    b = table(spark, d, "blocks").where("node_path is not null").select("doc_id", F.col("block_ordinal").alias("ordinal"), F.split("node_path", r"\.").alias("s")).distinct()
    each = b.select("doc_id", "ordinal", "s", F.explode(F.sequence(F.lit(1), F.size("s"))).alias("k")).select("doc_id", "ordinal", F.array_join(F.slice("s", 1, F.col("k")), ".").alias("node_path"))
    ranges = each.groupBy("doc_id", "node_path").agg(F.min("ordinal").alias("block_start"), F.max("ordinal").alias("block_end"))
    return D.owners(b.select("doc_id", "ordinal").distinct(), ranges)


def _grid(spark: SparkSession, d: str) -> DataFrame:
    """The given block grid with its heading outline, repeated rows aside."""
    b = table(spark, d, "blocks").select("doc_id", F.col("block_ordinal").alias("ordinal"), F.col("block_type").alias("type"), "char_start", "char_end", F.coalesce("token_count", F.lit(0)).alias("tokens"), "block_hash").distinct()
    return D.outline(b)


_GRID = """with b as (select distinct doc_id, block_ordinal as o, block_type, char_start, char_end, coalesce(token_count, 0) as t, block_hash as h from blocks),
g as (select *, coalesce(max(case when block_type = 'heading' then o end) over (partition by doc_id order by o), -1) as section from b)"""


@query(_GRID + " select doc_id, o as ordinal, section from g")
def j3_outline(spark, d):
    return _grid(spark, d).select("doc_id", "ordinal", "section")


# the runs of one owner, then the orbits of two jumps: from an anchor to the next that counts, and from a chunk to the next within the stretch
_CHUNKS = """with recursive b as (select doc_id, block_ordinal as o, min((coalesce(token_count, 0), coalesce(block_hash, ''), coalesce(node_path, ''))) as m from blocks group by all),
 g as (select doc_id, o, m[1] as t, m[2] as h, m[3] as p, lag(m[3]) over (partition by doc_id order by o) as q from b),
 r as (select *, sum(case when q is null or p <> q then 1 else 0 end) over (partition by doc_id order by o) as run, cast(concat('0x', substr(h, 1, 16)) as ubigint) % 24 = 0 as a from g),
 c as (select *, row_number() over w as n, (sum(t) over w) - t as bef, sum(t) over w as aft from r window w as (partition by doc_id, run order by o)),
 f as (select doc_id, run, min(n) as n from c where a group by all union all select f.doc_id, f.run, min(y.n) from f join c x on x.doc_id = f.doc_id and x.run = f.run and x.n = f.n
       join c y on y.doc_id = f.doc_id and y.run = f.run and y.n > f.n and y.a and y.bef >= x.bef + 200 group by all),
 s as (select c.*, coalesce((select max(f.n) from f where f.doc_id = c.doc_id and f.run = c.run and f.n <= c.n), 1) as seg from c),
 k as (select doc_id, run, seg, min(n) as n from s group by all union all select k.doc_id, k.run, k.seg, min(y.n) from k join s x on x.doc_id = k.doc_id and x.run = k.run and x.n = k.n
       join s y on y.doc_id = k.doc_id and y.run = k.run and y.seg = k.seg and y.n > k.n and y.aft > x.bef + 400 group by all),
 z as (select s.*, (select max(k.n) from k where k.doc_id = s.doc_id and k.run = s.run and k.n <= s.n) as cut from s)
 select doc_id, min(o) as block_start, max(o) as block_end, cast(sum(t) as int) as tokens, sha256(string_agg(h, chr(10) order by o)) as chunk_hash from z group by doc_id, run, cut"""


@query(_CHUNKS)
def j4_chunks(spark, d):
    """Chunks of the runs of each owner."""
    b = table(spark, d, "blocks").select("doc_id", F.col("block_ordinal").alias("ordinal"), F.coalesce("node_path", F.lit("")).alias("section"), "char_start", "char_end", F.col("token_count").alias("tokens"), "block_hash")
    return D.chunks(b.distinct()).select("doc_id", "block_start", "block_end", "tokens", "chunk_hash")


@query(_GRID + " select doc_id, o as ordinal, cast(concat('0x', substr(h, 1, 16)) as ubigint) % 24 = 0 as anchor from g")
def j4_anchors(spark, d):
    return _grid(spark, d).select("doc_id", "ordinal", D.anchored(F.col("block_hash")).alias("anchor"))


@query(_GRID + """, k as (select *, lag(h) over w as p, lead(h) over w as n from g window w as (partition by doc_id order by o))
 select doc_id, o as chunk_no, sha256(concat_ws(chr(30), h, concat_ws(chr(10), p, n), cast(doc_id as varchar), 'x1', 's1')) as reuse_key from k""")
def j6_reuse_keys(spark, d):
    """Reuse keys over the block grid, each block taken as a chunk."""
    g = _grid(spark, d).select("doc_id", F.col("ordinal").alias("chunk_no"), F.col("block_hash").alias("chunk_hash"))
    return D.reuse_keys(g, F.col("doc_id").cast("string"), "x1", "s1").select("doc_id", "chunk_no", "reuse_key")


_LINEAGE = """with c as (select distinct lower(trim(d.lineage_id)) as l, d.version_no as v, b.doc_id, b.block_ordinal as o, b.block_hash as h from blocks b join documents d using (doc_id) where trim(d.lineage_id) <> ''),
p as (select l, h, v, min((o, doc_id)) as own from c group by all), q as (select *, lag(own) over (partition by l, h order by v) as src from p)"""


@query(_LINEAGE + " select c.doc_id, c.o as chunk_no, src[2] as from_doc, src[1] as from_chunk from c join q on c.l = q.l and c.h = q.h and c.v = q.v where src is not null")
def j7_reused_blocks(spark, d):
    docs = table(spark, d, "documents").select("doc_id", clean_id(F.col("lineage_id")).alias("lineage_id"), "version_no").where("lineage_id is not null")
    b = table(spark, d, "blocks").select("doc_id", F.col("block_ordinal").alias("chunk_no"), F.col("block_hash").alias("reuse_key")).distinct()
    return D.reused(b.join(docs, "doc_id"))


@query(_GRID + " select doc_id, o as ordinal, lag(t) over w as before, lead(t) over w as after from g window w as (partition by doc_id, section order by o)")
def j10_context_neighbours(spark, d):
    w = Window.partitionBy("doc_id", "section").orderBy("ordinal")
    return _grid(spark, d).select("doc_id", "ordinal", F.lag("tokens").over(w).alias("before"), F.lead("tokens").over(w).alias("after"))


@query("select doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '')) as n from documents")
def f_token_count(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.tokens(F.col("text")).cast("long").alias("n"))


@query("select distinct node_path, array_to_string(list_transform(string_split(node_path, '.'), lambda x: lpad(x, 4, '0')), '.') as k from blocks where node_path is not null")
def b14_path_order(spark, d):
    p = table(spark, d, "blocks").where("node_path is not null").select("node_path").distinct()
    return p.select("node_path", F.array_join(F.transform(D.in_order(F.col("node_path")), lambda x: F.lpad(x.cast("string"), 4, "0")), ".").alias("k"))


# --- resolution -----------------------------------------------------------------------------------------------------

_SURFACES = "select concat(n_name, 'a') as surface from {nation} union all select replace(n_name, 'A', 'E') from {nation} union all select p_brand from {part}"
_GRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
_SIM = f"(len(list_intersect({_GRAMS.format('surface')}, {_GRAMS.format('alias_text')}))::double / len(list_distinct(list_concat({_GRAMS.format('surface')}, {_GRAMS.format('alias_text')}))))"


def _surfaces(spark, d):
    return spark.sql(_SURFACES, nation=table(spark, d, "nation"), part=table(spark, d, "part")).distinct()


def _aliases(spark, d):
    return spine(spark, d, "aliases")[0]


@query(f"""with s as (select distinct surface from ({_SURFACES.replace("{", "").replace("}", "")})), a as (select distinct entity_id, alias_text from s_aliases),
 p as (select surface, entity_id, max({_SIM}) as score from s, a group by all having max({_SIM}) >= 0.3) select surface, entity_id, round(score, 9) as score, row_number() over (partition by surface order by score desc, entity_id) as rank from p qualify rank <= 10""")
def k2_trigram_candidates(spark, d):
    return resolve.trigram_candidates(_surfaces(spark, d), _aliases(spark, d)).select("surface", "entity_id", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


@query()
def k2_blocked_both_tiers(spark, d):
    return resolve.block(_surfaces(spark, d), _aliases(spark, d))


@query(f"with s as (select distinct surface from ({_SURFACES.replace('{', '').replace('}', '')})) select surface, arg_min(entity_id, (first_seen, entity_id)) as entity_id from s join s_aliases on lower(surface) = lemma group by surface")
def k1_exact(spark, d):
    s = _surfaces(spark, d).withColumn("lemma", F.lower("surface"))
    return resolve.exact(s, spine(spark, d, "aliases")[0])


@query("""with c as (select distinct mention_id, lower(trim(entity_id)) as e, cast(trigram_score as double) as s, cast(embedding_score as double) as m from resolution_candidates where mention_id is not null and trim(entity_id) <> ''),
 b as (select *, case when m >= 0.88 then 'accept' when m <= 0.60 then 'reject' else 'escalate' end as band, row_number() over (partition by mention_id order by s desc nulls last, e) as r from c),
 j as (select *, max((band = 'accept')::int) over (partition by mention_id) as has, min(case when band = 'accept' then r end) over (partition by mention_id) as first, sum((band = 'escalate')::int) over (partition by mention_id order by r) as esc, max((band = 'escalate')::int) over (partition by mention_id) as open from b),
 v as (select mention_id, e, case when has = 1 and r = first then 'link' when has = 0 and band = 'escalate' and esc <= 3 then 'escalate' when open = 0 and has = 0 and r = 1 then 'mint' end as verdict from j)
 select mention_id, case when verdict <> 'mint' then e end as entity_id, verdict from v where verdict is not null""")
def k3_bands(spark, d):
    c = table(spark, d, "resolution_candidates").select("mention_id", clean_id(F.col("entity_id")).alias("entity_id"), F.col("trigram_score").cast("double").alias("score"), F.col("embedding_score").cast("double").alias("embedding_score"))
    # one row a mention and entity decides ties among repeated rows
    return resolve.decide(c.where("mention_id is not null and entity_id is not null").distinct())


@query()
def k7_pocket_clusters(spark, d):
    e = table(spark, d, "embeddings").select((F.col("label") * 1000 + F.col("vec_id") % 40).cast("long").alias("pocket"), F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"))
    return resolve.pockets(e, 0.5)


@query("""with c as (select c_nationkey as cluster, concat('cust:', c_custkey) as id, c_custkey % 3 as f, c_custkey % 7 + c_custkey % 5 as b from customer), m as (select cluster, arg_min(id, (f, id)) as survivor, count(distinct id) as n, sum(b) as blast from c group by all)
 select cluster, survivor, cast(blast as bigint) as blast, case when blast > 100 then 'review' else 'apply' end as route from m where n > 1""")
def k8_merges(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("cluster"), F.concat(F.lit("cust:"), "c_custkey").alias("id"), (F.col("c_custkey") % 3).alias("first_seen"), (F.col("c_custkey") % 7).alias("mention_count"), (F.col("c_custkey") % 5).alias("graph_degree"))
    return resolve.merges(c).select("cluster", "survivor", "blast", "route")


# --- facts ----------------------------------------------------------------------------------------------------------


@query("select predicate, count(*) as n from (select lower(trim(predicate)) as predicate from relations) where predicate in ('located_in', 'created', 'affiliated_with') or regexp_full_match(predicate, 'other:[a-z][a-z0-9_]{1,40}') group by all")
def b12_predicate_gate(spark, d):
    r = table(spark, d, "relations").select(F.lower(F.trim("predicate")).alias("predicate"))
    core = spark.createDataFrame([("located_in",), ("created",), ("affiliated_with",)], "predicate string")
    return facts.predicate_gate(r, core).groupBy("predicate").agg(F.count(F.lit(1)).alias("n"))


@query("""with t as (select lower(trim(entity_id)) as id, min(entity_type) as ty from entities group by 1), r as (select distinct lower(trim(relation_id)) as relation_id, predicate, lower(trim(subject_entity_id)) as s, lower(trim(object_entity_id)) as o from relations)
 select relation_id, predicate, a.ty as subject_type, b.ty as object_type from r join t a on a.id = s join t b on b.id = o where (predicate = 'located_in' and a.ty in ('Person', 'Organization') and b.ty in ('Person', 'Organization', 'Place')) or (predicate <> 'located_in' and a.ty in ('Person', 'Organization', 'Place') and b.ty in ('Person', 'Organization', 'Place'))""")
def b11_type_gate(spark, d):
    t = table(spark, d, "entities").select(clean_id(F.col("entity_id")).alias("id"), "entity_type").where("id is not null").groupBy("id").agg(F.min("entity_type").alias("ty"))
    r = table(spark, d, "relations").select(clean_id(F.col("relation_id")).alias("relation_id"), "predicate", clean_id(F.col("subject_entity_id")).alias("s"), clean_id(F.col("object_entity_id")).alias("o")).distinct()
    typed = r.join(t.select(F.col("id").alias("s"), F.col("ty").alias("subject_type")), "s").join(t.select(F.col("id").alias("o"), F.col("ty").alias("object_type")), "o").select("relation_id", "predicate", "subject_type", "object_type")
    types = spark.createDataFrame([("Agent", None), ("Person", "Agent"), ("Organization", "Agent"), ("Place", None)], "type string, parent string")
    signatures = spark.createDataFrame([("located_in", "Agent", "Agent"), ("located_in", "Agent", "Place")], "predicate string, subject_type string, object_type string")
    return facts.type_gate(typed, types, signatures)


@query("""with w as (select distinct subject, 'affiliated_with' as predicate, 'supp:1' as object from s_relations where predicate = 'uses'), h as (select subject, object, min(case when invalidated_at is null and valid_until is null then relation_id end) as open_id, max(valid_until) as ended from s_relations where predicate = 'affiliated_with' group by all)
 select w.subject, w.object, coalesce(open_id, 'new') as relation_id, """ + S.format("case when open_id is null then ended end") + " as valid_from from w left join h using (subject, object)")
def j14_relation_upsert(spark, d):
    r = spine(spark, d, "relations")[0]
    want = r.where("predicate = 'uses'").select("subject", F.lit("affiliated_with").alias("predicate"), F.lit("supp:1").alias("object"))
    out = facts.upsert_relations(r.where("predicate = 'affiliated_with'"), want)
    return out.select("subject", "object", F.when(F.col("is_new"), "new").otherwise(F.col("relation_id")).alias("relation_id"), stamp("valid_from").alias("valid_from"))


_RIVALS = """with recursive walk as (select entity_id as id, entity_id as cur, merged_into as nxt, 0 as depth from s_entities union all select w.id, e.entity_id, e.merged_into, w.depth + 1 from walk w join s_entities e on w.nxt = e.entity_id where w.depth < 64),
surv as (select id, arg_max(cur, depth) as root from walk group by id), l as (select relation_id, root, predicate, object from s_relations join surv on id = subject where predicate = 'affiliated_with' and invalidated_at is null and valid_until is null),
c as (select a.relation_id, b.relation_id as other, a.object = b.object as same from l a join l b on a.root = b.root and a.relation_id <> b.relation_id)"""


@query(_RIVALS + """, p as (select relation_id, min(other) filter (same) as s, list(distinct other) filter (not same) as r from c group by all)
 select l.relation_id, case when s is not null then 'noop' when len(r) > 0 then 'supersede' else 'add' end as outcome, unnest(case when s is not null then [s] when len(r) > 0 then r else [null] end) as related_id from l left join p using (relation_id)""")
def l2_adjudication_ladder(spark, d):
    r, e = spine(spark, d, "relations", "entities")
    new = r.where("predicate = 'affiliated_with' and invalidated_at is null and valid_until is null")
    rivals = facts.supersession_candidates(new, new, graph.survivors(e))
    return facts.adjudicate(new, rivals, ["affiliated_with"])


@query()
def l5_observation_batch(spark, d):
    o = table(spark, d, "orders").select(F.concat(F.lit("cust:"), "o_custkey").alias("subject"), F.concat(F.lit("o"), "o_orderkey").alias("observation_id"), F.concat_ws(" ", F.lit("order status"), "o_orderstatus", "o_orderpriority").alias("statement"), F.col("o_orderdate").alias("seq"))
    return facts.observation_batch(o)


# --- ledger ---------------------------------------------------------------------------------------------------------


@query("select cast(floor(epoch(enqueued_at) / 86400) * 86400 as bigint) as window_start, lane, cast(sum(cast(cost as decimal(12, 6))) as double) as spent, count(*) as n from s_work group by all")
def ag12_budget_windows(spark, d):
    return ledger.spend(spine(spark, d, "work")[0], 86400).withColumn("spent", F.col("spent").cast("double"))


@query("select cast(floor(epoch(enqueued_at) / 86400) * 86400 as bigint) as window_start, lane, cast(floor(epoch(enqueued_at) / 86400) * 86400 as bigint) + 86400 as resume_at from s_work group by all having sum(cast(cost as decimal(12, 6))) > 300")
def u4_parked_windows(spark, d):
    return ledger.parked(spine(spark, d, "work")[0], 86400, 300).select("window_start", "lane", "resume_at")


@query("select stage, lane, status, count(*) as n from s_work group by all")
def ag16_route_status(spark, d):
    return ledger.route_status(spine(spark, d, "work")[0])


_DEAD = "select *, concat('Traceback', chr(10), case work_id % 3 when 0 then 'TimeoutError: late' when 1 then 'pkg.BadInput: no' else 'no name here' end) as trace from s_work where status = 'dead'"


@query(f"with dl as ({_DEAD}) select stage, case work_id % 3 when 0 then 'TimeoutError' when 1 then 'pkg.BadInput' else 'unknown' end as error, version, count(*) as n, {S.format('min(enqueued_at)')} as first, {S.format('max(enqueued_at)')} as last from dl group by all")
def ag14_dead_letter_groups(spark, d):
    w = spine(spark, d, "work")[0].where("status = 'dead'")
    trace = F.concat(F.lit("Traceback\n"), F.when(F.col("work_id") % 3 == 0, "TimeoutError: late").when(F.col("work_id") % 3 == 1, "pkg.BadInput: no").otherwise("no name here"))
    return ledger.dead_letters(w.withColumn("trace", trace)).withColumns({"first": stamp("first"), "last": stamp("last")})


@query("select target, count(distinct version) as n_versions, array_to_string(list_slice(list_sort(list(distinct version)), 1, 5), ',') as versions from s_work where status = 'dead' group by target having count(distinct version) >= 2")
def ag15_poison_targets(spark, d):
    return ledger.poison(spine(spark, d, "work")[0].where("status = 'dead'"))


@query("select target, stage, max(lane) as lane from s_work group by all")
def u2_idempotent_enqueue(spark, d):
    w = spine(spark, d, "work")[0]
    return ledger.enqueue(w.where("work_id % 2 = 0"), w.where("work_id % 2 = 1"), ["target", "stage"])


@query("select work_id, attempts + 1 as attempts, case when attempts + 1 >= 4 then 'dead' else 'pending' end as status, case when attempts + 1 < 4 then least(5.0 * power(2, attempts), 15.0) end as wait_s from s_work where stage = 'error'")
def u3_retry_backoff(spark, d):
    w = spine(spark, d, "work")[0].where("stage = 'error'")
    return ledger.after_failure(w, 4, 5.0, 15.0).select("work_id", "attempts", "status", "wait_s")


@query("select work_id from s_work where status = 'pending' and attempts < 3 and enqueued_at <= timestamp '2024-01-05' order by enqueued_at, work_id limit 25")
def tk11_next_work(spark, d):
    w = spine(spark, d, "work")[0].withColumn("not_before", F.col("enqueued_at"))
    return ledger.next_work(w, F.lit("2024-01-05").cast("timestamp_ntz"), 3, 25).select("work_id")


@query("with p as (select target, arg_max(version, (enqueued_at, work_id)) as prior_version from s_work where stage = 'view' group by target), t as (select distinct target from s_work) select t.target, p.prior_version from t left join p using (target) where t.target not in (select target from s_work where stage = 'view' and version = 'v1')")
def n15_backfill(spark, d):
    """Targets that version v1 of the view stage has not reached."""
    w = spine(spark, d, "work")[0]
    return ledger.backfill(w, w.where("stage = 'view'"), "v1")


@query("with l as (select target, stage, arg_max(status, (enqueued_at, work_id)) as status from s_work group by all), t as (select distinct target from s_work), s as (select unnest(['view', 'click', 'publish']) as stage) select t.target, s.stage, coalesce(l.status, 'missing') as status from t, s left join l on l.target = t.target and l.stage = s.stage")
def n16_readiness(spark, d):
    w = spine(spark, d, "work")[0]
    return ledger.readiness(w, ["view", "click", "publish"], w)


# --- tree and knowledge ---------------------------------------------------------------------------------------------


@query("""with v as (select doc_id, coalesce(source, 'none') as source, source_modified_at as st from documents) select doc_id, concat('by-source/', regexp_replace(lower(source), '[^a-z0-9]+', '-', 'g')) as directory from v union all select doc_id, concat('by-time/', strftime(st, '%Y/%m')) from v where st is not null""")
def q1_view_paths(spark, d):
    v = table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("none")).alias("source_kind"), F.col("source_modified_at").alias("stamp"), F.lit(None).cast("string").alias("placement"))
    return tree.view_paths(v)


_PAGES = "select distinct git_path as name from knowledge_artifacts where git_path is not null"
_KEY = "case when regexp_full_match(lower(left(n, {0})), '[\\p{{L}}\\p{{N}}]+') then lower(left(n, {0})) else 'other' end"
_SHARD = "with e0 as (select substr(name, 4) as n, 'pages' as p, true as o from (" + _PAGES + "))"
for _i in range(1, 5):
    _k = _KEY.format(_i)
    _SHARD += f", c{_i} as (select *, {_k} as k, count(*) over (partition by p, o) as c, min({_k}) over (partition by p, o) as a, max({_k}) over (partition by p, o) as z from e{_i - 1})"
    _SHARD += f", e{_i} as (select n, case when o and c > 150 and a <> z then concat(p, '/', k) else p end as p, o and c > 150 and a <> z as o from c{_i})"


@query(_SHARD + " select p as directory, n as name from e4")
def q2_shards(spark, d):
    pages = table(spark, d, "knowledge_artifacts").where("git_path is not null").select(F.substring("git_path", 4, 10_000).alias("name")).distinct()
    return tree.shard(pages.withColumns({"directory": F.lit("pages"), "doc_id": F.lit(0)})).select("directory", "name")


@query()
def q3_index_pages(spark, d):
    views = tree.view_paths(table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("none")).alias("source_kind"), F.col("source_modified_at").alias("stamp"), F.lit(None).cast("string").alias("placement")))
    return tree.index_pages(tree.shard(views.withColumn("name", F.concat(F.lit("d"), "doc_id"))))


_KEYS = """fk as (select relation_id, 'entity' as key_kind, unnest([subject, object]) as key_value from s_relations union select relation_id, 'type_predicate', concat_ws('|', type, predicate) from (select relation_id, predicate, unnest([subject, object]) as e from s_relations) join s_entities on e = entity_id)"""


def _rules(spark: SparkSession) -> DataFrame:
    rows = [("r1", "entity", {"entity_id": "cust:7"}), ("r2", "predicate_beat", {"entity_type": "Place", "predicate": "part_of"}), ("r3", "entity_subtree", {"entity_id": "region:1"}), ("r4", "manual", {})]
    return spark.createDataFrame(rows, "rule_id string, kind string, params map<string,string>")


def _rule_keys(spark, d):
    r = spine(spark, d, "relations")[0].where("predicate = 'part_of'")
    return K.rule_keys(_rules(spark), r.select(F.col("subject").alias("child"), F.col("object").alias("parent")).unionByName(r.select(F.col("object").alias("child"), F.lit(None).cast("string").alias("parent")).distinct()))


_RULE_KEYS = """rk as (select 'r1' as rule_id, 'entity' as key_kind, 'cust:7' as key_value union all select 'r2', 'type_predicate', 'Place|part_of' union all select 'r3', 'entity', 'region:1' union all select 'r3', 'entity', subject from s_relations where predicate = 'part_of' and object = 'region:1')"""


@query(f"with {_RULE_KEYS} select rule_id, key_kind, key_value from rk")
def r1_rule_keys(spark, d):
    return _rule_keys(spark, d)


@query(f"with {_KEYS}, {_RULE_KEYS} select distinct rule_id, relation_id from fk join rk using (key_kind, key_value)")
def r2_rule_candidates(spark, d):
    r, e = spine(spark, d, "relations", "entities")
    return K.candidates(_rule_keys(spark, d), K.fact_keys(r, e))


@query(f"with {_KEYS}, {_RULE_KEYS} select key_value, count(distinct relation_id) as n from fk where key_kind = 'entity' and not exists (select 1 from rk where rk.key_kind = fk.key_kind and rk.key_value = fk.key_value) group by all")
def ag21_uncovered_entities(spark, d):
    r, e = spine(spark, d, "relations", "entities")
    return K.uncovered(K.fact_keys(r, e), _rule_keys(spark, d))


@query()
def r4_inputs_hash(spark, d):
    r, e = spine(spark, d, "relations", "entities")
    return K.inputs_hash(K.candidates(_rule_keys(spark, d), K.fact_keys(r, e)), r, "w1")


def _pages(spark, d):
    p = table(spark, d, "knowledge_artifacts").select(clean_id(F.col("artifact_id")).alias("page_id"), clean_id(F.col("parent_artifact_id")).alias("parent_id"), "kind", "status", "last_compiled_at")
    last = p.where("page_id is not null").groupBy("page_id").agg(F.max(F.struct("last_compiled_at", "parent_id", "kind", "status")).alias("m"))
    return last.select("page_id", "m.parent_id", "m.kind", "m.status")


@query("""with recursive p as (select lower(trim(artifact_id)) as id, nullif(lower(trim(parent_artifact_id)), '') as up, kind, status from knowledge_artifacts where trim(artifact_id) <> '' qualify row_number() over (partition by lower(trim(artifact_id)) order by last_compiled_at desc nulls last, parent_artifact_id desc nulls last, kind desc, status desc) = 1),
 n as (select a.id, b.id as up, a.kind, a.status from p a left join p b on a.up = b.id), down as (select id, up, 0::bigint as depth from n where up is null union all select n.id, n.up, d.depth + 1 from n join down d on n.up = d.id),
 need as (select id from n where status = 'tombstoned' and id in (select id from down) union select d.up from need x join down d on d.id = x.id where d.up is not null),
 allneed as (select id from need union select id from n where status = 'tombstoned')
 select a.id as page_id, coalesce(d.depth, -1) as depth, case kind when 'model_page' then 0 when 'index' then 2 else 1 end as wave from allneed a join n using (id) left join down d on d.id = a.id""")
def r6_compile_order(spark, d):
    p = _pages(spark, d)
    return K.compile_order(p, p.where("status = 'tombstoned'"))


@query(f"""with m as (select *, coalesce(nullif(trim(fact_label), ''), concat_ws(' ', subject, replace(predicate, '_', ' '), object)) as label from s_relations where subject = 'cust:7' or object = 'cust:7'),
 u as (select 'current' as section, relation_id, label, evidence_count as w from m where invalidated_at is null and {VALID} union all select 'contradictions', relation_id, label, 0 from m where contradiction_group is not null and invalidated_at is null)
 select section, cast(row_number() over (partition by section order by w desc, label, relation_id) as int) as pos, relation_id, label from u""")
def r7_fact_sheet(spark, d):
    return K.fact_sheet(spine(spark, d, "relations")[0], "cust:7", AT)


@query("""with f as (select object as rule_id, relation_id, evidence_count from s_relations where predicate = 'uses'), t as (select * from f qualify row_number() over (partition by rule_id order by evidence_count desc, relation_id) <= 20),
 e as (select distinct relation_id, claim_id from s_evidence where stance = 'supports') select relation_id, claim_id, cast(row_number() over (partition by rule_id, relation_id order by claim_id) as int) as pos from t join e using (relation_id) qualify pos <= 3""")
def r8_writer_bundle(spark, d):
    r, e = spine(spark, d, "relations", "evidence")
    f = r.where("predicate = 'uses'").select(F.col("object").alias("rule_id"), "relation_id", "evidence_count")
    return K.bundle(e, f).select("relation_id", "claim_id", "pos")


# --- checks ---------------------------------------------------------------------------------------------------------


@query("""with p as (select entity_type, case when blocking_tier = 'T1' then 'match' else 'no_match' end as label, case when embedding_score >= 0.88 then 'match' else 'no_match' end as verdict from resolution_candidates),
 s as (select entity_type, sum((label = 'match' and verdict = 'match')::int)::bigint as tp, sum((label = 'no_match' and verdict = 'match')::int)::bigint as fp, sum((label = 'match' and verdict = 'no_match')::int)::bigint as fn from p group by all)
 select entity_type, tp, fp, fn, round(case when tp + fp > 0 then tp / (tp + fp)::double end, 9) as precision, round(case when tp + fn > 0 then tp / (tp + fn)::double end, 9) as recall from s""")
def ag19_precision_recall(spark, d):
    p = table(spark, d, "resolution_candidates").select("entity_type", F.when(F.col("blocking_tier") == "T1", "match").otherwise("no_match").alias("label"), F.when(F.col("embedding_score") >= F.lit(0.88).cast("float"), "match").otherwise("no_match").alias("verdict"))
    return evals.precision_recall(p).select("entity_type", "tp", "fp", "fn", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query("with f as (select stage as generation, sum((status = 'dead')::int) as f, sum((status <> 'dead')::int) as c from s_work group by all) select generation, round(f / (f + c)::double, 9) as rate from f")
def ag18_flag_rate(spark, d):
    w = spine(spark, d, "work")[0].withColumn("generation", F.col("stage"))
    return evals.flag_rate(w.where("status = 'dead'"), w.where("status <> 'dead'")).withColumn("rate", F.round("rate", 9))


@query()
def n6_invariants(spark, d):
    r, v, e = spine(spark, d, "relations", "evidence", "entities")
    return evals.invariants(r, v, e, graph.survivors(e))

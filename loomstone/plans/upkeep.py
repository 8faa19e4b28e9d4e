"""Queries of version lifecycle, filters, transcripts, pages and routing over the corpus tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomstone.operators import documents as D, facts, graph, knowledge as K, ledger, lifecycle as L, primitives as P, tree
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


# --- versions: each distinct block of a lineage is a claim that its versions carry ------------------------------------


def _versions(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "documents").select("doc_id", clean_id(F.col("lineage_id")).alias("lineage_id"), "version_no", "deleted_at")
    return v.where("lineage_id is not null and version_no is not null")


def _occurrences(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "blocks").select("doc_id", F.col("block_hash").alias("content_key")).where("content_key is not null").distinct()
    o = b.join(_versions(spark, d), "doc_id")
    return o.select(F.concat_ws(":", "lineage_id", "content_key").alias("claim_id"), "lineage_id", "version_no", "content_key", "doc_id").distinct()


def _claims(spark: SparkSession, d: str) -> DataFrame:
    first = _occurrences(spark, d).groupBy("claim_id", "lineage_id", "content_key").agg(F.min("version_no").alias("v"))
    return first.select("claim_id", "lineage_id", "content_key", F.concat(F.lit("x"), F.col("v") % 2).alias("extractor"), (F.substring("content_key", 1, 1) != "0").alias("is_current"))


def _latest(spark: SparkSession, d: str) -> DataFrame:
    return _versions(spark, d).where("deleted_at is null").groupBy("lineage_id").agg(F.max("version_no").alias("version_no")).withColumn("mode", F.lit("living"))


_BASE = """with v as (select doc_id, lower(trim(lineage_id)) as l, version_no as n, deleted_at from documents where trim(lineage_id) <> '' and version_no is not null),
o as (select distinct concat(v.l, ':', b.block_hash) as claim_id, v.l, v.n, b.block_hash as h, v.deleted_at is null as live from blocks b join v using (doc_id) where b.block_hash is not null),
c as (select claim_id, l, h, concat('x', min(n) % 2) as x, left(h, 1) <> '0' as cur from o group by claim_id, l, h), latest as (select l, max(n) as n from v where deleted_at is null group by l) """


@query(_BASE + "select claim_id, l as lineage_id from c where cur and l in (select l from latest) and not exists (select 1 from o join latest t on o.l = t.l and o.n = t.n where o.claim_id = c.claim_id)")
def n1_stale_by_supersession(spark, d):
    return L.stale_by_supersession(_claims(spark, d), _occurrences(spark, d), _latest(spark, d))


@query(_BASE + "select claim_id, l as lineage_id from c where cur and x <> 'x1' and not exists (select 1 from c k where k.x = 'x1' and k.h = c.h)")
def n2_stale_by_reextraction(spark, d):
    c = _claims(spark, d)
    return L.stale_by_reextraction(c, c.select("lineage_id").distinct().withColumn("extractor", F.lit("x1")))


@query(_BASE + "select claim_id from c where cur and exists (select 1 from o where o.claim_id = c.claim_id and not live) and not exists (select 1 from o join v on o.l = v.l and o.n = v.n and v.deleted_at is null where o.claim_id = c.claim_id)")
def n3_stale_by_deletion(spark, d):
    return L.stale_by_deletion(_claims(spark, d), _occurrences(spark, d), _versions(spark, d).select("lineage_id", "version_no", "deleted_at").distinct())


@query(_BASE + "select claim_id from c where not cur and exists (select 1 from o join latest t on o.l = t.l and o.n = t.n where o.claim_id = c.claim_id)")
def n4_regained(spark, d):
    return L.regained(_claims(spark, d), _occurrences(spark, d), _latest(spark, d))


@query("""with t as (select claim_id, false as now, 3 as seq from s_claims where l_linenumber = 5 union all select claim_id, true, 4 from s_claims where l_linenumber = 5 and l_orderkey % 2 = 0 union all select claim_id, true, 2 from s_currency where seq = 2),
 n as (select claim_id, arg_max(now, seq) as now from t where seq > 2 group by claim_id) select c.claim_id, coalesce(n.now, c.is_current) as is_current from s_claims c left join n using (claim_id)""")
def n5_apply_transitions(spark, d):
    """Repeated events change nothing; the last new one owns the mark."""
    c, ev = spine(spark, d, "claims", "currency")
    hit = c.where("l_linenumber = 5")
    row = lambda df, seq, now: df.select(F.concat_ws(":", "claim_id", F.lit(f"t{seq}")).alias("event_id"), "claim_id", "doc_id", F.lit(now).alias("became_current"), F.lit(seq).alias("seq"), F.lit("x").alias("reason"))
    new = row(hit, 3, False).unionByName(row(hit.where("l_orderkey % 2 = 0"), 4, True)).unionByName(ev.where("seq = 2"))
    marked, _ = L.apply_transitions(c, ev, new.unionByName(new))
    return marked.select("claim_id", "is_current")


@query(f"select relation_id, {S.format(f'case when predicate = {chr(39)}uses{chr(39)} and (valid_until is null or valid_until > timestamp {chr(39)}{AT}{chr(39)}) then timestamp {chr(39)}{AT}{chr(39)} else valid_until end')} as valid_until from s_relations")
def n9_close_relations(spark, d):
    r = spine(spark, d, "relations")[0]
    return L.close_relations(r, r.where("predicate = 'uses'"), AT).select("relation_id", stamp("valid_until").alias("valid_until"))


@query("select target as cycle_id from s_work where target not in (select target from s_work where status = 'pending' and stage = 'view') group by target having sum((status = 'dead')::int) < 12")
def n11_finalisable_cycles(spark, d):
    w = spine(spark, d, "work")[0].withColumnRenamed("target", "cycle_id")
    cycles = w.groupBy("cycle_id").agg(F.sum((F.col("status") == "dead").cast("int")).alias("dead"), F.max("enqueued_at").alias("completed_at"))
    cycles = cycles.withColumns({"failures": F.when(F.col("dead") < 12, 0).otherwise(F.col("dead")), "finalised_at": F.lit(None).cast("timestamp_ntz")})
    return L.finalisable(cycles, w.where("stage = 'view'"))


@query("select 'claims' as table_name, count(*) as n from s_claims where doc_id = 'ord:7' union all select 'evidence', count(*) from s_evidence where doc_id = 'ord:7'")
def n14_forget_and_verify(spark, d):
    """What a document has in each table before it is forgotten; after the purge the same check must be empty."""
    c, e = spine(spark, d, "claims", "evidence")
    tables = {"claims": c, "evidence": e}
    before, after = L.left_behind(tables, "ord:7"), L.left_behind(L.forget(tables, "ord:7"), "ord:7")
    return before.unionByName(after)


# --- filters --------------------------------------------------------------------------------------------------------


@query("select doc_id from documents where source = 'email' or lang = 'de'")
def b6_metadata_filter(spark, d):
    return table(spark, d, "documents").where((F.col("source") == "email") | (F.col("lang") == "de")).select("doc_id")


@query("select doc_id from documents where source = 'upload' and source_modified_at between timestamp '2023-01-01' and timestamp '2024-12-31'")
def b7_doc_set_filter(spark, d):
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return table(spark, d, "documents").where((F.col("source") == "upload") & F.col("source_modified_at").between(at("2023-01-01"), at("2024-12-31"))).select("doc_id")


@query("select distinct relation_id from s_evidence e where exists (select 1 from orders where concat('ord:', o_orderkey) = e.doc_id and o_orderpriority = '1-URGENT')")
def c3_facts_of_a_doc_set(spark, d):
    docs = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("ord:"), "o_orderkey").alias("doc_id"))
    return spine(spark, d, "evidence")[0].join(docs, "doc_id", "left_semi").select("relation_id").distinct()


@query()
def j11_claim_decisions(spark, d):
    return D.extract_claims(table(spark, d, "documents"))


@query("select doc_id, count(*) > 0 as ok from documents where text is not null and trim(text, chr(32) || chr(9) || chr(10) || chr(13)) <> '' group by doc_id")
def b13_grounding(spark, d):
    """Every extracted span stands where its decision says."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    c = D.extract_claims(docs).join(docs, "doc_id").select("doc_id", F.col("claim_text").alias("span"), "text", "char_start", "char_end", F.array(F.struct(F.col("char_start").alias("begin"), F.col("char_end").alias("end"))).alias("kept"))
    good = D.grounded(c).groupBy("doc_id").agg(F.count(F.lit(1)).alias("g"))
    return c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).join(good, "doc_id").select("doc_id", (F.col("n") == F.col("g")).alias("ok"))


# --- ledgers, pages, routing ----------------------------------------------------------------------------------------

@query(f"""with p as (select distinct proposal_id, lower(trim(survivor_id)) as s, lower(trim(unnest(absorbed_ids))) as r, decided_by, decided_at from merge_proposals),
 who as (select min(lower(trim(survivor_id))) as id from merge_proposals where trim(survivor_id) <> '') select concat('m', proposal_id) as decision_id, decided_by as outcome, {S.format('decided_at')} as decided_at, case when s = id then r else s end as related_id from p, who where s = id or r = id""")
def h6_transcript(spark, d):
    """The merge decisions of the entity with the smallest id; related_id is always the other side."""
    p = table(spark, d, "merge_proposals").select("proposal_id", clean_id(F.col("survivor_id")).alias("subject_id"), F.explode("absorbed_ids").alias("r"), F.col("decided_by").alias("outcome"), "decided_at")
    dec = p.select(F.lit("entity").alias("kind"), F.concat(F.lit("m"), "proposal_id").alias("decision_id"), "subject_id", F.lower(F.trim("r")).alias("related_id"), "outcome", "decided_at").distinct()
    who = p.agg(F.min("subject_id")).first()[0]  # one id
    return P.transcript("entity", who, dec).withColumn("decided_at", stamp("decided_at"))


_PAGES = """with p as (select lower(trim(artifact_id)) as id, max((last_compiled_at, inputs_hash, status, coalesce(page_summary, ''))) as m from knowledge_artifacts where trim(artifact_id) <> '' group by 1),
 e as (select distinct lower(trim(artifact_id)) as id, lower(trim(relation_id)) as r from knowledge_artifact_evidence where trim(relation_id) <> ''), w as (select id from (select id, r, row_number() over (order by r, id) as n from e) where r = (select min(r) from e)) """


@query(_PAGES + f"select p.id as page_id, {S.format('m[1]')} as compiled_at, left(m[2], 1) in ('0', '1') as is_stale from p where m[3] <> 'tombstoned' and id in (select id from w)")
def h10_pages_about(spark, d):
    """Pages whose rules watch one relation; their rule is the page itself, its key each relation it cites."""
    p = table(spark, d, "knowledge_artifacts").select(clean_id(F.col("artifact_id")).alias("page_id"), "last_compiled_at", "inputs_hash", "status", F.coalesce("page_summary", F.lit("")).alias("s")).where("page_id is not null")
    pages = p.groupBy("page_id").agg(F.max(F.struct("last_compiled_at", "inputs_hash", "status", "s")).alias("m")).select(
        "page_id", F.col("m.s").alias("title"), F.col("m.last_compiled_at").alias("compiled_at"), F.col("m.inputs_hash").alias("inputs_hash"), F.col("m.status").alias("status"),
        F.when(F.substring("m.inputs_hash", 1, 1).isin("0", "1"), "changed").otherwise(F.col("m.inputs_hash")).alias("current_hash"),
    )
    keys = table(spark, d, "knowledge_artifact_evidence").select(clean_id(F.col("artifact_id")).alias("rule_id"), F.lit("relation").alias("key_kind"), clean_id(F.col("relation_id")).alias("key_value")).where("key_value is not null").distinct()
    rules = pages.select(F.col("page_id").alias("rule_id"), "page_id", F.lit(True).alias("active"))
    flags = spark.createDataFrame([], "page_id string, status string, redact boolean")
    value = keys.agg(F.min("key_value")).first()[0]  # one key
    return P.pages_about(pages, rules, keys, flags, "relation", value).select("page_id", stamp("compiled_at").alias("compiled_at"), "is_stale")


@query("""with v as (select doc_id, lower(trim(lineage_id)) as l, version_no from documents where trim(lineage_id) <> ''), e as (select a.doc_id as src, b.doc_id as dst from v a join v b on a.l = b.l and b.version_no = a.version_no - 1),
 big as (select max(src) as s from e where src in (select src from e) and dst in (select src from e)), h as (select min(e1.dst) as m, min(e2.dst) as t from e e1 join e e2 on e2.src = e1.dst join big on e1.src = big.s)
 select unnest([concat('d', s), concat('d', (select min(e1.dst) from e e1 join e e2 on e2.src = e1.dst, big, h where e1.src = big.s and e2.dst = h.t)), concat('d', t)]) as node, unnest([0, 1, 2])::int as hop from big, h""")
def h16_citation_path(spark, d):
    """Each version cites the one before it in its lineage; a directed path of two citations."""
    v = table(spark, d, "documents").select("doc_id", clean_id(F.col("lineage_id")).alias("l"), "version_no").where("l is not null")
    e = v.join(v.select(F.col("doc_id").alias("dst"), "l", (F.col("version_no") + 1).alias("version_no")), ["l", "version_no"]).select(F.col("doc_id").alias("src"), "dst")
    two = e.join(e.select(F.col("src").alias("dst"), F.col("dst").alias("end")), "dst")
    start = two.agg(F.max("src")).first()[0]  # one id
    end = two.where(F.col("src") == start).agg(F.min("end")).first()[0]
    name = lambda c: F.concat(F.lit("d"), F.lpad(F.col(c).cast("string"), 12, "0"))
    edges = e.select(name("src").alias("src"), name("dst").alias("dst")).withColumn("edge_id", F.concat_ws(">", "src", "dst"))
    pad = lambda i: f"d{i:012}"
    return graph.path(edges, pad(start), pad(end), 6, directed=True).select(F.concat(F.lit("d"), F.substring("node", 2, 12).cast("long")).alias("node"), "hop")


@query("select lane, cast(sum(cast(cost as decimal(12, 6))) as double) as spent, sum((status = 'pending')::int)::bigint as parked from s_work group by lane")
def ag13_tier_spend(spark, d):
    w = spine(spark, d, "work")[0]
    return w.groupBy("lane").agg(F.sum(F.col("cost").cast("decimal(12,6)")).cast("double").alias("spent"), F.sum((F.col("status") == "pending").cast("long")).alias("parked"))


@query(f"select {S.format('max(ingested_at)')} as watermark from s_relations")
def ag20_watermark(spark, d):
    return spine(spark, d, "relations")[0].agg(stamp(F.max("ingested_at")).alias("watermark"))


@query("select e.entity_id, case when e.merged_into = 'cust:2' then 'active' else e.status end as status, case when e.merged_into = 'cust:2' then null else e.merged_into end as merged_into from s_entities e")
def k9_unmerge(spark, d):
    from loomstone.operators import resolve

    return resolve.unmerge(spine(spark, d, "entities")[0], "cust:2").select("entity_id", "status", "merged_into")


_AT = "select distinct lower(trim(artifact_id)) as page, lower(trim(relation_id)) as r from knowledge_artifact_evidence where trim(relation_id) <> '' and trim(artifact_id) <> ''"


@query(f"with c as ({_AT}), ch as (select distinct lower(trim(relation_id)) as r from relations where invalidated_at is not null) select distinct page as page_id from c where r in (select r from ch)")
def r3_route_changes(spark, d):
    """Pages that invalidated relations concern, by citation."""
    ev = table(spark, d, "knowledge_artifact_evidence").select(clean_id(F.col("artifact_id")).alias("page_id"), clean_id(F.col("relation_id")).alias("relation_id")).where("page_id is not null and relation_id is not null").distinct()
    changed = table(spark, d, "relations").where("invalidated_at is not null").select(clean_id(F.col("relation_id")).alias("relation_id")).distinct()
    keyed = changed.select("relation_id", F.lit("relation").alias("key_kind"), F.col("relation_id").alias("key_value"))
    none = spark.createDataFrame([], "rule_id string, key_kind string, key_value string")
    return K.route(keyed, none, spark.createDataFrame([], "rule_id string, page_id string"), ev)


@query(_PAGES + "select id as page_id from p where left(m[2], 1) in ('0', '1')")
def r5_stale_pages(spark, d):
    p = table(spark, d, "knowledge_artifacts").select(clean_id(F.col("artifact_id")).alias("page_id"), "last_compiled_at", "inputs_hash", "status", F.coalesce("page_summary", F.lit("")).alias("s")).where("page_id is not null")
    last = p.groupBy("page_id").agg(F.max(F.struct("last_compiled_at", "inputs_hash", "status", "s")).alias("m")).select("page_id", F.col("page_id").alias("rule_id"), F.col("m.inputs_hash").alias("inputs_hash"))
    now = last.select("rule_id", F.when(F.substring("inputs_hash", 1, 1).isin("0", "1"), "changed").otherwise(F.col("inputs_hash")).alias("inputs_hash"))
    return K.stale(last, now).select("page_id")


@query("with t as (select relation_id, count(distinct claim_id) as total from s_evidence where stance = 'supports' group by 1), s as (select relation_id from s_relations where predicate = 'uses') select relation_id, total, least(total, 3) as shown, total - least(total, 3) as cut from t join s using (relation_id)")
def r8_coverage(spark, d):
    r, e = spine(spark, d, "relations", "evidence")
    f = r.where("predicate = 'uses'").select(F.col("relation_id").alias("rule_id"), "relation_id", "evidence_count")
    return K.coverage(e, K.bundle(e, f))


@query(f"select artifact_id as page_id, proposal as route from (select proposal_id as artifact_id, case when decided_by = 'human' or blast_radius * (1 - coalesce(mean_distance, 0)) > 100 then 'review' else 'apply' end as proposal from (select distinct proposal_id, decided_by, blast_radius, mean_distance from merge_proposals))")
def r11_impact_bands(spark, d):
    p = table(spark, d, "merge_proposals").select("proposal_id", "decided_by", "blast_radius", "mean_distance").distinct()
    kind = F.when(F.col("decided_by") == "human", "reflection").otherwise("plan")
    return p.select(F.col("proposal_id").alias("page_id"), K.impact(F.col("blast_radius"), F.coalesce("mean_distance", F.lit(0.0)), 100.0, kind).alias("route"))


@query("""with e as (select distinct concat('p/', regexp_replace(git_path, '^kb/', '')) as f, case when git_path is null then null else string_split(git_path, '/')[1] end as d, string_split(git_path, '/')[2] as n from knowledge_artifacts where git_path like 'kb/%')
 select '' as directory, 'kb' as child, 'directory' as kind union all select 'kb', n, 'document' from e""")
def q4_levels(spark, d):
    e = table(spark, d, "knowledge_artifacts").where("git_path like 'kb/%'").select(F.lit("kb").alias("directory"), F.substring("git_path", 4, 10_000).alias("name")).distinct()
    return tree.levels(e)


@query("with v as (select lower(trim(lineage_id)) as l, doc_id, version_no from documents where trim(lineage_id) <> ''), b as (select distinct v.l, v.doc_id, b.block_hash as h from blocks b join v using (doc_id)), k as (select doc_id, l, h from b where h not in (select h from b x where x.doc_id = (select min(doc_id) from b))) select doc_id, h as claim_id from k")
def j8_reattach(spark, d):
    """Links of (document, block) to claims that are not there yet, the first document's being known."""
    v = _versions(spark, d).select("doc_id")
    b = table(spark, d, "blocks").select("doc_id", F.col("block_hash").alias("claim_id")).distinct().join(v, "doc_id")
    known = b.join(b.agg(F.min("doc_id").alias("doc_id")), "doc_id", "left_semi").select("claim_id").distinct()
    want = b.select(F.col("claim_id").alias("fact_id"), F.col("doc_id").cast("string").alias("claim_id"))
    have = want.join(known.select(F.col("claim_id").alias("fact_id")), "fact_id", "left_semi")
    return facts.evidence_once(have, want).select(F.col("claim_id").cast("long").alias("doc_id"), F.col("fact_id").alias("claim_id"))


@query("select distinct concat('sub', user_id) as subscription from events where user_id not in (select user_id from events where event_type = 'error' and value > 60)")
def u8_dispatch_once(spark, d):
    e = table(spark, d, "events").select(F.concat(F.lit("sub"), "user_id").alias("subscription"), "event_type", "value")
    return ledger.dispatch(e, e.where("event_type = 'error' and value > 60"))


@query("""with p as (select distinct concat('cust:', o_custkey) as subject, concat('order status ', o_orderstatus) as statement from orders), l as (select subject, statement, min(observation_id) as known from s_observations where invalidated_at is null and valid_until is null group by all)
 select p.subject, p.statement, coalesce(known, sha256(concat_ws(chr(31), p.subject, p.statement))) as observation_id, known is null as is_new from p left join l using (subject, statement)""")
def j15_observation_upsert(spark, d):
    """The order statuses of all customers proposed again."""
    p = table(spark, d, "orders").select(F.concat(F.lit("cust:"), "o_custkey").alias("subject"), F.concat(F.lit("order status "), "o_orderstatus").alias("statement"))
    return facts.upsert_observations(spine(spark, d, "observations")[0], p)


_OUTCOMES = """select relation_id, related_id, case when n % 3 = 0 then 'supersede' when n % 3 = 1 then 'contradict' else 'coexist' end as outcome, moment from (
 select relation_id, lag(relation_id) over w as related_id, valid_from + interval '10' day as moment, row_number() over w as n from {s_relations} where predicate = 'affiliated_with' window w as (partition by subject order by valid_from, relation_id)) x where related_id is not null"""


@query(f"""with o as ({_OUTCOMES.replace("{s_relations}", "s_relations")}), t as (select o.*, r.valid_until as u, r.contradiction_group as g, case when outcome = 'supersede' then case when r.valid_until is null or r.valid_until > moment then 'supersede' else 'noop' end when outcome = 'contradict' then 'contradict' else 'noop' end as done
   from o join s_relations r on r.relation_id = o.related_id),
 e as (select related_id as relation_id, min(moment) as fin from t where done = 'supersede' group by 1), c as (select relation_id, related_id, coalesce(g, sha256('group:' || related_id)) as k from t where done = 'contradict'),
 k as (select relation_id, min(k) as k from (select relation_id, k from c union all select related_id, k from c) group by 1)
 select r.relation_id, {S.format('coalesce(fin, r.valid_until)')} as valid_until, coalesce(r.contradiction_group, k.k) as contradiction_group from s_relations r left join e using (relation_id) left join k using (relation_id)""")
def l4_outcomes(spark, d):
    """Supersede, contradict and coexist in turn between neighbours in the history of each customer."""
    (r,) = spine(spark, d, "relations")
    out, _ = facts.apply_outcomes(r, spark.sql(_OUTCOMES, s_relations=r).withColumnRenamed("moment", "at"))
    return out.select("relation_id", stamp("valid_until").alias("valid_until"), "contradiction_group")


@query("select event_id as review_id, row_number() over (order by value desc nulls last, ts, event_id) as pos from events where event_type = 'error' or event_id % 7 = 0")
def tk10_review_queue(spark, d):
    """Errors as pending and every seventh event as deferred reviews, all ranked."""
    from pyspark.sql import Window

    status = F.when(F.col("event_type") == "error", "pending").when(F.col("event_id") % 7 == 0, "deferred").otherwise("closed")
    q = ledger.review_queue(table(spark, d, "events").select(F.col("event_id").alias("review_id"), status.alias("status"), F.col("value").alias("expected_impact"), F.col("ts").alias("created_at")))
    return q.select("review_id", F.row_number().over(Window.orderBy(F.desc_nulls_last("expected_impact"), "created_at", "review_id")).cast("long").alias("pos"))


@query("select distinct e.doc_id as src, d.doc_id as dst from knowledge_artifact_evidence e join documents d on lower(trim(d.lineage_id)) = nullif(lower(trim(e.claim_lineage_id)), '') where e.doc_id in (select doc_id from documents)")
def g5_crossrefs(spark, d):
    """Documents cited together with a lineage refer to its versions."""
    e = table(spark, d, "knowledge_artifact_evidence").select(F.col("doc_id").alias("src"), clean_id(F.col("claim_lineage_id")).alias("l"))
    docs = table(spark, d, "documents").select("doc_id", clean_id(F.col("lineage_id")).alias("l"))
    return graph.crossrefs(e.join(docs.withColumnRenamed("doc_id", "dst"), "l", "left").select("src", "dst"), docs)


@query("""with c as (select entity_id, canonical_name as surface, coalesce(merged_into, entity_id) as root_id from s_entities where type = 'Organization') select surface, c.entity_id, c.root_id from c join s_entities r on r.entity_id = c.root_id where r.status = 'active'""")
def k6_neighbourhood(spark, d):
    """Every organisation as a candidate, merged ones under the active entity one redirect away."""
    from loomstone.operators import resolve

    (e,) = spine(spark, d, "entities")
    return resolve.neighbourhood(e.where("type = 'Organization'").select(F.col("canonical_name").alias("surface"), "entity_id"), e)


@query("""with p as (select lower(trim(artifact_id)) id, nullif(lower(trim(parent_artifact_id)), '') parent from knowledge_artifacts where nullif(trim(artifact_id), '') is not null
  qualify row_number() over (partition by lower(trim(artifact_id)) order by last_compiled_at desc nulls last, parent_artifact_id desc nulls last) = 1), n as (select a.id, b.id as parent from p a left join p b on a.parent = b.id),
 down as (select id from n where parent is null union all select c.id from down d join n c on c.parent = d.id), good as (select n.* from n semi join down using (id)),
 up as (select id as origin, parent as cur from good where parent is not null union all select u.origin, n.parent from up u join good n on n.id = u.cur where n.parent is not null)
 select p.id as page_id, count(origin) as below from p left join up on up.cur = p.id group by 1""".replace("with p as", "with recursive p as", 1))
def ag22_impact(spark, d):
    """How many pages hang below each page."""
    p = table(spark, d, "knowledge_artifacts").select(clean_id(F.col("artifact_id")).alias("page_id"), clean_id(F.col("parent_artifact_id")).alias("parent_id"), "last_compiled_at").where("page_id is not null")
    pages = p.groupBy("page_id").agg(F.max(F.struct("last_compiled_at", "parent_id")).alias("m")).select("page_id", F.col("m.parent_id").alias("parent_id"))
    return K.reach(pages, pages)

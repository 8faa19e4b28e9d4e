"""Queries of the read primitives, aggregates, ranking, identity, graph and lifecycle operators over the spine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomstone.operators import graph, lifecycle, primitives as P, ranking, temporal as t
from loomstone.runtime import clean_id, table
from loomstone.sources.spine import frame, oracle

AT, SINCE = "1998-06-01 00:00:00", "2001-06-01 00:00:00"
WHO, BRAND = "cust:7", "uses"
stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
S = "strftime({0}, '%Y-%m-%d %H:%M:%S')"
VALID = f"(valid_from is null or valid_from <= timestamp '{AT}') and (valid_until is null or valid_until > timestamp '{AT}')"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = oracle(sql)
        return f

    return register


def spine(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    return [frame(spark, d, f"s_{n}") for n in names]


def _relation_rows(df: DataFrame) -> DataFrame:
    return df.select("relation_id", "subject", "predicate", "object", "evidence_count", stamp("valid_from").alias("valid_from"), stamp("valid_until").alias("valid_until"))


_REL = f"select relation_id, subject, predicate, object, evidence_count, {S.format('valid_from')} as valid_from, {S.format('valid_until')} as valid_until from s_relations where invalidated_at is null and "


@query(_REL + VALID)
def h2_lookup_relations(spark, d):
    return _relation_rows(P.lookup_relations(*spine(spark, d, "relations"), AT))


@query(_REL + VALID + f" and subject = '{WHO}' and predicate = 'affiliated_with'")
def b2_optional_arguments(spark, d):
    return _relation_rows(P.lookup_relations(*spine(spark, d, "relations"), AT, subject=WHO, predicate="affiliated_with"))


@query(f"select relation_id, {S.format('ingested_at')} as ingested_at from s_relations where ingested_at <= timestamp '{AT}' and (invalidated_at is null or invalidated_at > timestamp '{AT}') and {VALID}")
def b1_as_of_both_clocks(spark, d):
    (r,) = spine(spark, d, "relations")
    return r.where(t.valid_at(AT) & t.believed(AT)).select("relation_id", stamp("ingested_at").alias("ingested_at"))


@query(f"select observation_id, statement, evidence_count from s_observations where subject = '{WHO}' and invalidated_at is null and {VALID}")
def h3_lookup_observations(spark, d):
    return P.lookup_observations(*spine(spark, d, "observations"), WHO, AT).select("observation_id", "statement", "evidence_count")


_SURVIVOR = """with recursive walk as (
  select entity_id as id, entity_id as cur, merged_into as nxt, 0 as depth from s_entities
  union all select w.id, e.entity_id, e.merged_into, w.depth + 1 from walk w join s_entities e on w.nxt = e.entity_id where w.depth < 64),
surv as (select id, arg_max(cur, depth) as root_id, cast(max(depth) as bigint) as depth from walk group by id) """


@query(_SURVIVOR + "select id, root_id, depth from surv")
def g1_survivors(spark, d):
    return graph.survivors(*spine(spark, d, "entities"))


@query(_SURVIVOR + "select s.id, s.root_id from surv s join s_entities e on e.entity_id = s.root_id where e.merged_into is not null")
def g2_unresolved_survivors(spark, d):
    (e,) = spine(spark, d, "entities")
    return graph.unresolved(e, graph.survivors(e))


@query(
    _SURVIVOR
    + """, found as (select distinct s.root_id as entity_id from s_aliases a join surv s on s.id = a.entity_id where a.lemma like 'customer#%'),
    ends as (select subject as entity_id, object as focal from s_relations where invalidated_at is null union all select object, subject from s_relations where invalidated_at is null),
    hits as (select entity_id, count(distinct focal) as hits from ends where focal in ('nation:3', 'region:1') group by entity_id)
    select e.entity_id, e.canonical_name, cast(coalesce(h.hits, 0) as bigint) as context_hits from found f join s_entities e using (entity_id) left join hits h using (entity_id) where e.status = 'active' and e.type = 'Organization'"""
)
def h1_resolve_all(spark, d):
    """The resolve primitive for every customer alias at once, with two context entities."""
    a, e, r = spine(spark, d, "aliases", "entities", "relations")
    named = a.where(F.col("lemma").like("customer#%")).withColumn("lemma", F.lit("all"))
    return P.resolve(named, e, graph.survivors(e), r, "all", "Organization", ("nation:3", "region:1")).select("entity_id", "canonical_name", "context_hits")


@query("""select e.relation_id, c.claim_id, c.doc_id from s_evidence e join s_claims c on e.claim_id = c.claim_id where e.relation_id = 'd:7' and e.stance = 'supports'""")
def h5_hydrate_relation(spark, d):
    r, e, c = spine(spark, d, "relations", "evidence", "claims")
    return P.hydrate_relation("d:7", r, e, c).select("relation_id", "claim_id", "doc_id")


_FEED = " union all ".join(
    f"select '{k}' as kind, '{c}' as change, {i} as id, {l} as label, {a} as at_ from {s} where {a} is not null"
    for k, c, i, l, a, s in [
        ("relation", "new", "relation_id", "coalesce(fact_label, predicate)", "ingested_at", "s_relations"),
        ("relation", "invalidated", "relation_id", "coalesce(fact_label, predicate)", "invalidated_at", "s_relations"),
        ("relation", "capped", "relation_id", "coalesce(fact_label, predicate)", "valid_until", "s_relations"),
        ("observation", "new", "observation_id", "statement", "ingested_at", "s_observations"),
        ("observation", "invalidated", "observation_id", "statement", "invalidated_at", "s_observations"),
        ("observation", "capped", "observation_id", "statement", "valid_until", "s_observations"),
        ("claim", "new", "claim_id", "left(claim_text, 80)", "ingested_at", "s_claims"),
    ]
)
_FEED_SQL = f"with feed as ({_FEED}) select kind, change, id, label, {S.format('at_')} as changed_at from feed "


@query(_FEED_SQL + f"where at_ > timestamp '{SINCE}'")
def h9_delta_all(spark, d):
    """The change feed without a page limit."""
    feed = P.feed(*spine(spark, d, "relations", "observations", "claims"))
    return feed.where(F.col("at") > t.instant(SINCE)).select("kind", "change", "id", "label", stamp("at").alias("changed_at"))


@query(_FEED_SQL + f"where at_ > timestamp '{SINCE}' order by at_ desc, id desc, change desc limit 101")
def h9_delta_page(spark, d):
    feed = P.feed(*spine(spark, d, "relations", "observations", "claims"))
    return P.delta(feed, SINCE, limit=100).select("kind", "change", "id", "label", stamp("at").alias("changed_at"))


@query(_FEED_SQL + f"where at_ > timestamp '{SINCE}' and (at_, id || chr(31) || change) < (timestamp '2001-07-01', 'o:5' || chr(31) || 'new') order by at_ desc, id desc, change desc limit 101")
def tk2_keyset_page(spark, d):
    feed = P.feed(*spine(spark, d, "relations", "observations", "claims"))
    cursor = P.encode_cursor("2001-07-01 00:00:00", "o:5\x1fnew")
    return P.delta(feed, SINCE, limit=100, continuation=cursor).select("kind", "change", "id", "label", stamp("at").alias("changed_at"))


@query(f"select 'relation' as kind, relation_id as id, coalesce(fact_label, predicate) as label, {S.format('ingested_at')} as at from s_relations")
def a11_scan_relations(spark, d):
    return P.scan("relation", *spine(spark, d, "relations")).withColumn("at", stamp("at"))


@query(f"select 'claim' as kind, claim_id as id, left(claim_text, 120) as label, {S.format('ingested_at')} as at from s_claims")
def a11_scan_claims(spark, d):
    return P.scan("claim", *spine(spark, d, "claims")).withColumn("at", stamp("at"))


@query("select count(*) as n from s_relations where invalidated_at is null and predicate = 'uses'")
def ag1_count(spark, d):
    return P.aggregate("count", *spine(spark, d, "relations"), predicate="uses")


@query(f"select predicate, count(*) as n from s_relations where invalidated_at is null and subject = '{WHO}' group by predicate order by n desc, predicate limit 51")
def ag2_group_by_predicate(spark, d):
    return P.aggregate("group_by_predicate", *spine(spark, d, "relations"), subject=WHO)


@query(f"select object, canonical_name, count(*) as n from s_relations join s_entities on object = entity_id where invalidated_at is null and subject = '{WHO}' group by all order by n desc, canonical_name, object limit 51")
def ag3_group_by_object(spark, d):
    r, e = spine(spark, d, "relations", "entities")
    return P.aggregate("group_by_object", r, entities=e, subject=WHO)


@query(f"""with u as (select coalesce(valid_from, ingested_at) as at_ from s_relations where invalidated_at is null and (subject = '{WHO}' or object = '{WHO}')
       union all select coalesce(valid_from, ingested_at) from s_observations where invalidated_at is null and subject = '{WHO}')
       select strftime(at_, '%Y') as year, count(*) as n from u group by all""")  # fmt: skip
def ag4_timeline(spark, d):
    r, o = spine(spark, d, "relations", "observations")
    return P.aggregate("timeline", r, o, subject=WHO)


@query(f"""with u as (select unnest([subject, object]) as entity_id from s_relations where ingested_at > timestamp '{SINCE}' union all select subject from s_observations where ingested_at > timestamp '{SINCE}')
       select entity_id, cast(count(*) as bigint) as n from u group by all order by n desc, entity_id limit 51""")  # fmt: skip
def ag5_delta_top_entities(spark, d):
    r, o = spine(spark, d, "relations", "observations")
    return P.aggregate("delta_top_entities", r, o, since=SINCE)


@query("""select entity_id, cast(1 as bigint) as n from s_entities where status = 'active' and type = 'Organization'
       and not exists (select 1 from s_relations where predicate = 'uses' and subject = entity_id and invalidated_at is null) order by entity_id limit 51""")  # fmt: skip
def ag6_typed_absence(spark, d):
    r, e = spine(spark, d, "relations", "entities")
    return P.aggregate("typed_absence", r, entities=e, predicate="uses", entity_type="Organization")


_CO = """with live as (select relation_id, contradiction_group g from s_relations where invalidated_at is null and contradiction_group is not null),
o as (select f.relation_id, l.relation_id as other_id, row_number() over (partition by f.relation_id order by l.relation_id) r, count(*) over (partition by f.relation_id) as co_total
      from live f join live l on f.g = l.g and f.relation_id <> l.relation_id) select relation_id, other_id, co_total from o where r <= 25"""


@query(_CO)
def tk12_contradiction_co_members(spark, d):
    (r,) = spine(spark, d, "relations")
    return P.co_members(r.where(t.believed()), r)


@query(_CO.rsplit(" select ", 1)[0] + f", k as (select relation_id, string_agg(other_id, ',' order by other_id) as c, max(co_total) as n from o where r <= 25 group by 1) select f.relation_id, coalesce(c, '') as contradicts, cast(coalesce(n, 0) as bigint) as contradicts_total, 'current' as support from s_relations f left join k using (relation_id) where invalidated_at is null and {VALID}")
def h12_enriched_lookup(spark, d):
    """What contradicts each fact of a lookup."""
    (r,) = spine(spark, d, "relations")
    return P.enriched(P.lookup_relations(r, AT), r).select("relation_id", F.concat_ws(",", "contradicts").alias("contradicts"), "contradicts_total", "support")


_REVIEW = """select concat('r', cast(event_id as string)) as review_id, case event_id % 3 when 0 then 'pending' when 1 then 'deferred' else 'closed' end as status,
             concat('{"fact_id": "d:', cast(event_id as string), '"}') as candidate from {events} where event_type = 'error'"""


@query(f"""with rv as ({_REVIEW.replace("{events}", "events").replace("{0}", "")}) select relation_id, case when exists (select 1 from rv where status in ('pending', 'deferred')
       and candidate->>'$.fact_id' = relation_id) then 'withdrawn' else 'current' end as support from s_relations""")  # fmt: skip
def b8_json_flagged_support(spark, d):
    (r,) = spine(spark, d, "relations")
    text = _REVIEW.replace('\'{"fact_id": "d:\'', "'{{\"fact_id\": \"d:'").replace("'\"}'", "'\"}}'")
    reviews = spark.sql(text, events=table(spark, d, "events"))
    return P.withdrawn(r, reviews, "relation_id").select("relation_id", "support")


@query("select relation_id, coalesce(nullif(trim(fact_label), ''), concat_ws(' ', subject, replace(predicate, '_', ' '), object)) as label from s_relations")
def b3_labels(spark, d):
    return spine(spark, d, "relations")[0].select("relation_id", t.label().alias("label"))


@query("select claim_id from s_claims where is_current and position('part 1' in lower(claim_text)) > 0")
def b5_keyword_current_claims(spark, d):
    return spine(spark, d, "claims")[0].where(F.col("is_current") & F.contains(F.lower("claim_text"), F.lit("part 1"))).select("claim_id")


@query(f"select relation_id, case when invalidated_at is not null then 'invalidated' when valid_from > timestamp '{AT}' then 'not_yet_valid' when valid_until <= timestamp '{AT}' then 'ended' else 'current' end as state from s_relations")
def b1_lifecycle(spark, d):
    return spine(spark, d, "relations")[0].select("relation_id", t.lifecycle(AT).alias("state"))


_WINDOWS = """with r as (select subject, predicate, object, relation_id, coalesce(valid_from, timestamp '0001-01-01') b, coalesce(valid_until, timestamp '9999-12-31') e from s_relations where invalidated_at is null and contradiction_group is null)
select distinct y.subject, y.predicate, y.relation_id from r x join r y on x.subject = y.subject and x.predicate = y.predicate and x.relation_id <> y.relation_id
 and (x.b, x.e, x.relation_id) < (y.b, y.e, y.relation_id) and x.e > y.b and y.b < y.e and x.b < x.e"""


@query(_WINDOWS)
def c11_overlapping_windows(spark, d):
    """Facts whose window overlaps an earlier one of the same subject and predicate."""
    return t.overlaps(spine(spark, d, "relations")[0], ["subject", "predicate"], "relation_id").select("subject", "predicate", "relation_id")


# --- ranking --------------------------------------------------------------------------------------------------------

_L2 = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: (x[1]::double - x[2]::double) * (x[1]::double - x[2]::double)))"


@query(f"""with r as (select b.vec_id as query_id, a.vec_id, {_L2} as dist from embeddings a, embeddings b where b.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
       k as (select *, row_number() over (partition by query_id order by dist, vec_id) as rank from r) select query_id, vec_id, round(dist, 6) as distance, cast(rank as int) as rank from k where rank <= 10""")  # fmt: skip
def tk5_nearest_all(spark, d):
    e = table(spark, d, "embeddings")
    return ranking.nearest_all(e, e.where("vec_id % 50 = 0"), 10).withColumn("distance", F.round("distance", 6))


@query(f"select a.vec_id, round({_L2}, 6) as distance from embeddings a, (select embedding from embeddings where vec_id = 0) b where a.label = 1 order by {_L2}, a.vec_id limit 10")
def tk5_nearest_prefiltered(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id = 0").first().embedding  # one stated query vector
    return ranking.nearest(e, list(q), 10, label=1).withColumn("distance", F.round("distance", 6))


_RANKS = """select 'price' as channel, cast(o_orderkey as string) as id, row_number() over (order by o_totalprice desc, o_orderkey) as rank from {orders}
 union all select 'date', cast(o_orderkey as string), row_number() over (order by o_orderdate, o_orderkey) from {orders}
 union all select 'date', cast(o_orderkey as string), 1 + row_number() over (order by o_orderkey) from {orders} where o_custkey = 7"""


def _ranks(spark, d):
    return spark.sql(_RANKS, orders=table(spark, d, "orders"))


@query(f"""with k as ({_RANKS.replace("{orders}", "orders")}), b as (select channel, id, 1.0::double / (60 + min(rank)) as part from k group by all) select id, round(sum(part), 9) as score from b group by id""")
def tk7_fuse(spark, d):
    return ranking.fuse(_ranks(spark, d)).select("id", F.round("score", 9).alias("score"))


_ITEMS = """select cast(o_orderkey as string) as id, o_totalprice as score, case when o_orderkey % 5 > 0 then o_orderkey % 5 end as graph_distance,
            case when o_orderkey % 7 > 0 then o_orderkey % 7 end as evidence_count from {orders}"""


@query(f"""with i as ({_ITEMS.replace("{orders}", "orders")}), m as (select max(score) s, min(graph_distance) d0, max(graph_distance) d1, min(evidence_count) e0, max(evidence_count) e1 from i)
       select id, round(score / s + 0.1 * coalesce((d1 - graph_distance) / (d1 - d0)::double, 0) + 0.1 * coalesce((evidence_count - e0) / (e1 - e0)::double, 0), 9) as final from i, m""")  # fmt: skip
def tk9_rerank_weighted(spark, d):
    return ranking.rerank_weighted(spark.sql(_ITEMS, orders=table(spark, d, "orders"))).withColumn("final", F.round("final", 9))


@query(f"with i as ({_ITEMS.replace('{orders}', 'orders')}) select id, row_number() over (order by graph_distance nulls last, score desc, id) as pos from i qualify pos <= 50")
def tk8_rerank_signal(spark, d):
    top = ranking.rerank(spark.sql(_ITEMS, orders=table(spark, d, "orders")), "graph_distance").limit(50)
    from pyspark.sql import Window

    w = Window.orderBy(F.asc_nulls_last("graph_distance"), F.desc("score"), "id")  # 50 rows
    return top.select("id", F.row_number().over(w).cast("long").alias("pos"))


# --- graph ----------------------------------------------------------------------------------------------------------


def _edges(spark, d, *predicates):
    e, r = spine(spark, d, "entities", "relations")
    if predicates:
        r = r.where(F.col("predicate").isin(*predicates))
    return graph.relates(r, graph.survivors(e), e)


_EDGES = _SURVIVOR + """, edges as (select a.root_id as src, b.root_id as dst, r.* from s_relations r join surv a on a.id = r.subject join surv b on b.id = r.object
  join s_entities x on x.entity_id = a.root_id and x.status = 'active' join s_entities y on y.entity_id = b.root_id and y.status = 'active')"""
_NARROW = _EDGES + ", e as (select * from edges where predicate in ('located_in', 'part_of', 'uses')), u as (select src a, dst b from e union select dst, src from e)"


@query(_EDGES + "select src, dst, relation_id, predicate from edges")
def g3_relates_edges(spark, d):
    return _edges(spark, d).select("src", "dst", "relation_id", "predicate")


@query(_SURVIVOR + f", m as (select concat('cust:', cast(o_custkey as string)) as entity_id, concat('ord:', cast(o_orderkey as string)) as doc_id, o_orderdate as seen_at from orders) select s.root_id as entity_id, doc_id, count(*) as mentions, {S.format('min(seen_at)')} as first_seen from m join surv s on s.id = m.entity_id group by all")
def g4_mentioned_in(spark, d):
    (e,) = spine(spark, d, "entities")
    pairs = table(spark, d, "orders").select(F.concat(F.lit("cust:"), "o_custkey").alias("entity_id"), F.concat(F.lit("ord:"), "o_orderkey").alias("doc_id"), F.col("o_orderdate").alias("seen_at"))
    return graph.mentions(pairs, graph.survivors(e)).withColumn("first_seen", stamp("first_seen"))


@query(_EDGES + f", l as (select src, dst from edges where invalidated_at is null and (valid_until is null or valid_until > timestamp '{AT}')) select id, count(*) as degree from (select src as id from l union all select dst from l) group by id")
def g11_degree(spark, d):
    return graph.degree(graph.live_edges(_edges(spark, d), AT))


@query(_NARROW.replace(" where predicate in ('located_in', 'part_of', 'uses')", "") + """, h1 as (select distinct b id from u where a = 'cust:7' and b <> 'cust:7'), h2 as (select distinct u.b id from u join h1 on u.a = h1.id where u.b <> 'cust:7' and u.b not in (select id from h1)),
       h3 as (select distinct u.b id from u join h2 on u.a = h2.id where u.b <> 'cust:7' and u.b not in (select id from h1) and u.b not in (select id from h2))
       select id, 1 as hops from h1 union all select id, 2 from h2 union all select id, 3 from h3""")  # fmt: skip
def h14_neighborhood(spark, d):
    return graph.neighborhood(_edges(spark, d), WHO, 3)


@query(_NARROW + """, p as (select ['supp:1', x.b, y.b, z.b, w.b] as nodes from u x join u y on y.a = x.b join u z on z.a = y.b join u w on w.a = z.b where x.a = 'supp:1' and w.b = 'region:2'
         and not exists (select 1 from u q join u r on r.a = q.b where q.a = 'supp:1' and r.b = 'region:2')
       union all select ['supp:1', x.b, y.b] from u x join u y on y.a = x.b where x.a = 'supp:1' and y.b = 'region:2'
       union all select ['supp:1', x.b, y.b, z.b] from u x join u y on y.a = x.b join u z on z.a = y.b where x.a = 'supp:1' and z.b = 'region:2'
         and not exists (select 1 from u q join u r on r.a = q.b where q.a = 'supp:1' and r.b = 'region:2')),
       best as (select nodes from p where len(nodes) = (select min(len(nodes)) from p) order by nodes limit 1) select unnest(nodes) as node, cast(unnest(range(len(nodes))) as int) as hop from best""")  # fmt: skip
def h15_path(spark, d):
    edges = _edges(spark, d, "located_in", "part_of", "uses").withColumnRenamed("relation_id", "edge_id")
    return graph.path(edges, "supp:1", "region:2", 4).select("node", "hop")


def _live(spark, d):
    """The whole live projection, all predicates."""
    return graph.live_edges(_edges(spark, d), AT)


def _merged(spark, d):
    """The links of the merge proposals, each survivor to each absorbed entity."""
    p = table(spark, d, "merge_proposals").select(clean_id(F.col("survivor_id")).alias("src"), F.explode("absorbed_ids").alias("dst"))
    return p.select("src", clean_id(F.col("dst")).alias("dst")).where("src is not null and dst is not null and src <> dst")


@query("""with recursive e as (select lower(trim(survivor_id)) as src, lower(trim(unnest(absorbed_ids))) as dst from merge_proposals), u as (select src a, dst b from e where src <> dst and src <> '' and dst <> '' union select dst, src from e where src <> dst and src <> '' and dst <> ''),
       c(id, root) as (select a, a from u union select u.b, c.root from c join u on c.id = u.a where u.b > c.root) select id, min(root) as component from c group by id""")  # fmt: skip
def g9_components(spark, d):
    return graph.components(_merged(spark, d))


@query()
def g7_pagerank(spark, d):
    return graph.pagerank(_live(spark, d)).select("id", F.round("rank", 12).alias("rank"))


@query()
def g8_core_numbers(spark, d):
    return graph.core_numbers(_live(spark, d))


@query()
def g10_communities(spark, d):
    return graph.communities(_live(spark, d))


@query()
def g9_live_components(spark, d):
    return graph.components(_live(spark, d))


# --- lifecycle ------------------------------------------------------------------------------------------------------

_RECOUNT = """with n as (select relation_id, count(distinct doc_id) filter (stance = 'supports' and is_current) n, count(distinct doc_id) filter (stance = 'contradicts' and is_current) m from s_evidence group by 1)
select r.relation_id, cast(coalesce(n, 0) as bigint) as evidence_count, cast(coalesce(m, 0) as bigint) as contradict_count from s_relations r left join n using (relation_id)
where coalesce(n, 0) <> evidence_count or coalesce(m, 0) <> 0"""


def _facts(spark, d):
    return spine(spark, d, "relations")[0].withColumn("contradict_count", F.lit(0).cast("long"))


@query(_RECOUNT)
def ag8_recount(spark, d):
    return lifecycle.recount(_facts(spark, d), *spine(spark, d, "evidence"))


@query("select c.claim_id, c.is_current, arg_max(became_current, seq) as ledger from s_claims c join s_currency u using (claim_id) group by c.claim_id, c.is_current having c.is_current <> ledger")
def n6_cache_audit(spark, d):
    return lifecycle.cache_audit(*spine(spark, d, "claims", "currency"))


@query("select r.relation_id from s_relations r where invalidated_at is null and valid_until is null and not exists (select 1 from s_evidence e where e.relation_id = r.relation_id and is_current and stance = 'supports') and r.relation_id not like '%:1%'")
def n8_zero_support(spark, d):
    f = _facts(spark, d)
    return lifecycle.zero_support(f, spine(spark, d, "evidence")[0], f.where("relation_id like '%:1%'"))


@query("select distinct relation_id from s_evidence e where exists (select 1 from s_currency u where u.claim_id = e.claim_id and u.reason = 'regain')")
def n7_affected_facts(spark, d):
    e, u = spine(spark, d, "evidence", "currency")
    return lifecycle.affected_facts(e, u.where("reason = 'regain'"))


@query("select relation_id from s_evidence group by relation_id having count(distinct doc_id) = 1 and min(doc_id) = 'ord:7'")
def n13_exclusive_facts(spark, d):
    e = spine(spark, d, "evidence")[0]
    return lifecycle.exclusive(e.select("relation_id").distinct(), e, "ord:7")


@query(f"select relation_id, {S.format('least(valid_until, lead(valid_from) over (partition by subject, predicate order by valid_from, relation_id))')} as valid_until from s_relations")
def l4_supersede(spark, d):
    r = spine(spark, d, "relations")[0]
    return lifecycle.supersede(r).select("relation_id", stamp("valid_until").alias("valid_until"))


@query(f"with v as (select lower(trim(lineage_id)) as lineage_id, version_no, deleted_at from documents where trim(lineage_id) <> '') select lineage_id, max(version_no) as current_version from v where deleted_at is null group by lineage_id")
def n12_repoint_current_version(spark, d):
    v = table(spark, d, "documents").select(F.lower(F.trim("lineage_id")).alias("lineage_id"), "version_no", "deleted_at", F.lit(True).alias("ready"))
    return lifecycle.repoint(v.where("lineage_id <> ''"))

"""Queries of the general data-preparation problems: histories, hierarchies, orphan references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomstone.operators import hierarchy, history, references
from loomstone.runtime import clean_id, table

STATE = ["valid_from", "valid_until", "invalidated_at"]
STAMP = "yyyy-MM-dd HH:mm:ss"


def _fact_versions(spark: SparkSession, d: str) -> DataFrame:
    readings = table(spark, d, "fact_sheet_facts").select(clean_id(F.col("fact_id")).alias("fact_id"), *STATE, "evidence_as_of", "recorded_at")
    return history.versions(readings, "fact_id", "evidence_as_of", STATE, "recorded_at")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _fact_versions(spark, d).select("fact_id", "version_no", F.date_format("evidence_as_of", STAMP).alias("version_from"))


def p2_history(spark: SparkSession, d: str) -> DataFrame:
    v = _fact_versions(spark, d)
    stamp = lambda c: F.date_format(c, STAMP)
    return v.select(
        "fact_id", "version_no", stamp("evidence_as_of").alias("version_from"), stamp("valid_to").alias("version_to"), *[stamp(c).alias(c) for c in STATE]
    )


P2_SQL = """
with r as (
  select lower(trim(fact_id)) fact_id, evidence_as_of, recorded_at, valid_from, valid_until, invalidated_at
  from fact_sheet_facts where nullif(trim(fact_id), '') is not null and evidence_as_of is not null),
u as (select * from r qualify row_number() over (partition by fact_id, evidence_as_of order by recorded_at desc nulls last,
        valid_from desc nulls last, valid_until desc nulls last, invalidated_at desc nulls last) = 1),
c as (select *, row_number() over w = 1
        or valid_from is distinct from lag(valid_from) over w
        or valid_until is distinct from lag(valid_until) over w
        or invalidated_at is distinct from lag(invalidated_at) over w as starts
      from u window w as (partition by fact_id order by evidence_as_of)),
v as (select *, row_number() over w as version_no, lead(evidence_as_of) over w as version_to
      from c where starts window w as (partition by fact_id order by evidence_as_of))
"""


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    """(kind:id, kind:parent) of pages and sections in one node space."""
    pages = table(spark, d, "knowledge_artifacts").select(
        clean_id(F.col("artifact_id")).alias("id"), clean_id(F.col("parent_artifact_id")).alias("parent"), F.col("last_compiled_at").alias("at")
    )
    pages = pages.where(F.col("id").isNotNull()).groupBy("id").agg(F.max(F.struct("at", "parent")).alias("last"))
    pages = pages.select(F.concat(F.lit("artifact:"), "id").alias("node"), F.concat(F.lit("artifact:"), F.col("last.parent")).alias("parent"))
    sections = table(spark, d, "proposed_sections").select(clean_id(F.col("section_id")).alias("id"), "children").where(F.col("id").isNotNull())
    child = sections.select("id", F.explode("children").alias("child")).select(
        F.concat(F.lit("section:"), clean_id(F.col("child"))).alias("node"), F.concat(F.lit("section:"), "id").alias("parent")
    )
    own = sections.select(F.concat(F.lit("section:"), "id").alias("node")).distinct()
    # children without a row do not count; the node side of the join is unique
    child = child.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("parent").alias("parent"))
    return pages.unionByName(own.join(child, "node", "left"))


def _split(column: str):
    return F.element_at(F.split(F.col(column), ":", 2), 2)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    tree = hierarchy.resolve(_nodes(spark, d), "node", "parent")
    return tree.select(F.split("id", ":")[0].alias("node_kind"), _split("id").alias("node_id"), _split("root_id").alias("root_id"), "depth")


def p3_paths(spark: SparkSession, d: str) -> DataFrame:
    tree = hierarchy.resolve(_nodes(spark, d), "node", "parent", with_path=True)
    clean = F.transform("path", lambda x: F.element_at(F.split(x, ":", 2), 2))
    return tree.select(
        F.split("id", ":")[0].alias("node_kind"), _split("id").alias("node_id"), _split("root_id").alias("root_id"), "depth", F.array_join(clean, "/").alias("path")
    )


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    pairs = hierarchy.descendants(hierarchy.resolve(_nodes(spark, d), "node", "parent", with_path=True))
    return pairs.select(
        F.split("ancestor_id", ":")[0].alias("node_kind"), _split("ancestor_id").alias("ancestor_id"), _split("descendant_id").alias("descendant_id"), "distance"
    )


P3_SQL = """
with recursive pages as (
  select lower(trim(artifact_id)) id, nullif(lower(trim(parent_artifact_id)), '') parent from knowledge_artifacts
  where nullif(trim(artifact_id), '') is not null
  qualify row_number() over (partition by lower(trim(artifact_id)) order by last_compiled_at desc nulls last, parent_artifact_id desc nulls last) = 1),
own as (select distinct lower(trim(section_id)) id from proposed_sections where nullif(trim(section_id), '') is not null),
kids as (select nullif(lower(trim(c)), '') id, min(lower(trim(section_id))) parent
  from (select section_id, unnest(children) c from proposed_sections) group by 1),
raw as (select 'artifact' k, id, parent from pages union all select 'section', o.id, c.parent from own o left join kids c on o.id = c.id),
n as (select a.k, a.id, b.id as parent from raw a left join raw b on a.k = b.k and a.parent = b.id),
down as (
  select k, id, id as root, 0::bigint as depth, id as path from n where parent is null
  union all select c.k, c.id, d.root, d.depth + 1, d.path || '/' || c.id from down d join n c on c.k = d.k and c.parent = d.id),
loose as (select n.* from n anti join down d on n.k = d.k and n.id = d.id),
walk as (
  select k, id as origin, parent as cur, [id] as seen, false as closed from loose
  union all select w.k, w.origin, l.parent, list_append(w.seen, l.id), list_contains(w.seen, l.parent) or l.parent = l.id
  from walk w join loose l on l.k = w.k and l.id = w.cur where not list_contains(w.seen, l.id)),
ends as (select k, origin, cur, seen from walk w where list_contains(seen, cur)),
rings as (select k, origin as id, list_min(list_slice(seen, list_position(seen, cur), len(seen))) as root from ends)
"""


def p5_refs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "knowledge_artifact_evidence")
    filled = F.array(
        F.struct(F.lit("doc_id").alias("field"), F.col("doc_id").cast("string").alias("key")),
        F.struct(F.lit("relation_id").alias("field"), clean_id(F.col("relation_id")).alias("key")),
        F.struct(F.lit("claim_lineage_id").alias("field"), clean_id(F.col("claim_lineage_id")).alias("key")),
    )
    return e.select(
        clean_id(F.col("evidence_link_id")).alias("evidence_link_id"), F.col("cited_at").alias("at"), F.inline(F.filter(filled, lambda x: x["key"].isNotNull()))
    )


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", clean_id(F.col("lineage_id")).alias("lineage_id"), "ingested_at", "deleted_at")
    rel = table(spark, d, "relations").select(clean_id(F.col("relation_id")).alias("relation_id"), "ingested_at")
    targets = {
        "doc_id": references.target_state(docs, "doc_id", "ingested_at", "deleted_at"),
        "claim_lineage_id": references.target_state(docs, "lineage_id", "ingested_at", "deleted_at"),
        "relation_id": references.target_state(rel, "relation_id", "ingested_at"),
    }
    return references.orphans(p5_refs(spark, d).distinct(), targets).withColumn("cited_month", F.date_format("at", "yyyy-MM"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("evidence_link_id", F.col("field").alias("target_field"), "orphan_state", "cited_month").distinct()


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    r = references.report(_orphans(spark, d), "cited_month")
    return r.select(F.col("field").alias("target_field"), "cited_month", "orphan_state", "references", "keys")


P5_SQL = """
with e as (
  select distinct lower(trim(evidence_link_id)) evidence_link_id, cited_at, unnest([
    {'f': 'doc_id', 'k': doc_id::varchar},
    {'f': 'relation_id', 'k': nullif(lower(trim(relation_id)), '')},
    {'f': 'claim_lineage_id', 'k': nullif(lower(trim(claim_lineage_id)), '')}]) u
  from knowledge_artifact_evidence),
r as (select evidence_link_id, cited_at, u.f f, u.k k from e where u.k is not null),
t as (
  select 'doc_id' f, doc_id::varchar k, bool_or(deleted_at is null) live, min(ingested_at) filter (deleted_at is null) first_live from documents group by all
  union all select 'claim_lineage_id', nullif(lower(trim(lineage_id)), ''), bool_or(deleted_at is null), min(ingested_at) filter (deleted_at is null) from documents group by all
  union all select 'relation_id', nullif(lower(trim(relation_id)), ''), true, min(ingested_at) from relations group by all),
o as (
  select r.*, case when t.k is null then 'missing' when not t.live then 'deleted' when t.first_live > r.cited_at then 'late' end orphan_state
  from r left join t on r.f = t.f and r.k = t.k),
x as (select *, strftime(cited_at, '%Y-%m') cited_month from o where orphan_state is not null)
"""

QUERIES = {f.__name__: f for f in (p2_found, p2_history, p3_found, p3_paths, p3_descendants, p5_found, p5_report)}

_FMT = "strftime({0}, '%Y-%m-%d %H:%M:%S')"
SQL = {
    "p2_found": P2_SQL + f"select fact_id, version_no, {_FMT.format('evidence_as_of')} as version_from from v",
    "p2_history": P2_SQL
    + f"select fact_id, version_no, {_FMT.format('evidence_as_of')} as version_from, {_FMT.format('version_to')} as version_to, "
    + ", ".join(f"{_FMT.format(c)} as {c}" for c in STATE)
    + " from v",
    "p3_found": P3_SQL + "select k as node_kind, id as node_id, root as root_id, depth from down union all select k, id, root, -1 from rings",
    "p3_paths": P3_SQL + "select k as node_kind, id as node_id, root as root_id, depth, path from down union all select k, id, root, -1, id from rings",
    "p3_descendants": P3_SQL
    + """, up as (select k, id as origin, parent as cur, 1::bigint as distance from n semi join down d on n.k = d.k and n.id = d.id where parent is not null
      union all select u.k, u.origin, n.parent, u.distance + 1 from up u join n on n.k = u.k and n.id = u.cur where n.parent is not null)
    select k as node_kind, cur as ancestor_id, origin as descendant_id, distance from up""",
    "p5_found": P5_SQL + "select distinct evidence_link_id, f as target_field, orphan_state, cited_month from x",
    "p5_report": P5_SQL
    + 'select f as target_field, cited_month, orphan_state, count(*) as "references", count(distinct k) as keys from x group by all',
}

"""Page rules, routing, input hashes, compile order, fact sheets and bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomstone.operators import hierarchy, temporal as t

RULES = ("entity", "entity_subtree", "predicate_beat", "community", "doc_set", "scope_interests", "manual")


def rule_keys(rules: DataFrame, part_of: DataFrame | None = None) -> DataFrame:
    """(rule_id, key_kind, key_value): the coarse keys of rules (rule_id, kind, params map).

    entity and entity_subtree watch entities, the latter with all parts below
    (part_of: child, parent); predicate_beat an (entity type | predicate); community,
    doc_set and scope_interests their value; manual nothing.
    """
    p = lambda name: F.element_at("params", F.lit(name))
    own = rules.where(F.col("kind").isin("entity", "entity_subtree")).select("rule_id", F.lit("entity").alias("key_kind"), p("entity_id").alias("key_value"))
    beat = rules.where(F.col("kind") == "predicate_beat").select("rule_id", F.lit("type_predicate").alias("key_kind"), F.concat_ws("|", p("entity_type"), p("predicate")).alias("key_value"))
    rest = rules.where(F.col("kind").isin("community", "doc_set", "scope_interests")).select("rule_id", F.col("kind").alias("key_kind"), p("value").alias("key_value"))
    out = own.unionByName(beat).unionByName(rest)
    if part_of is not None:
        tree = hierarchy.resolve(part_of, "child", "parent", with_path=True)
        below = hierarchy.descendants(tree).select(F.col("ancestor_id").alias("root"), "descendant_id")
        sub = rules.where(F.col("kind") == "entity_subtree").select("rule_id", p("entity_id").alias("root")).join(below, "root")
        out = out.unionByName(sub.select("rule_id", F.lit("entity").alias("key_kind"), F.col("descendant_id").alias("key_value")))
    return out.where("key_value is not null").distinct()


def fact_keys(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """(relation_id, key_kind, key_value): each fact under both its entities and their (type | predicate)."""
    ends = relations.select("relation_id", "predicate", F.explode(F.array("subject", "object")).alias("entity_id"))
    typed = ends.join(entities.select("entity_id", "type"), "entity_id", "left")
    keys = F.array(F.struct(F.lit("entity").alias("key_kind"), F.col("entity_id").alias("key_value")), F.struct(F.lit("type_predicate").alias("key_kind"), F.concat_ws("|", "type", "predicate").alias("key_value")))
    return typed.select("relation_id", F.inline(keys)).distinct()


def candidates(keys: DataFrame, facts: DataFrame) -> DataFrame:
    """(rule_id, relation_id) of facts that a rule's keys take in."""
    return keys.join(facts, ["key_kind", "key_value"]).select("rule_id", "relation_id").distinct()


def route(changed: DataFrame, keys: DataFrame, pages: DataFrame, cited: DataFrame) -> DataFrame:
    """(page_id) of pages that changed facts concern, by watched key or by citation."""
    by_key = changed.join(keys, ["key_kind", "key_value"]).select("rule_id").distinct().join(pages.select("rule_id", "page_id"), "rule_id").select("page_id")
    by_citation = cited.join(changed.select("relation_id").distinct(), "relation_id", "left_semi").select("page_id")
    return by_key.unionByName(by_citation).distinct()


def uncovered(facts: DataFrame, keys: DataFrame) -> DataFrame:
    """(key_value, n): entities whose facts no rule watches, with how many."""
    loose = facts.where("key_kind = 'entity'").join(keys.select("key_kind", "key_value"), ["key_kind", "key_value"], "left_anti")
    return loose.groupBy("key_value").agg(F.count_distinct("relation_id").alias("n"))


def inputs_hash(candidates_: DataFrame, facts: DataFrame, writer: str) -> DataFrame:
    """(rule_id, inputs_hash): hash of the sorted distinct fingerprints of a rule's facts and of the writer's version.

    Facts are reduced to (id, window, belief) hashes first, so a page's list holds
    one short text a fact.
    """
    state = F.sha2(F.to_json(F.struct("relation_id", F.col("valid_from").cast("string"), F.col("valid_until").cast("string"), F.col("invalidated_at").cast("string"))), 256)
    prints = candidates_.join(facts.select("relation_id", state.alias("print")), "relation_id").groupBy("rule_id").agg(F.array_sort(F.collect_set("print")).alias("p"))
    return prints.select("rule_id", F.sha2(F.concat_ws("\x1e", F.concat_ws("\n", "p"), F.lit(writer)), 256).alias("inputs_hash"))


def stale(recorded: DataFrame, computed: DataFrame) -> DataFrame:
    """Pages whose recorded hash differs from the computed one, or that never had one."""
    return recorded.join(computed.withColumnRenamed("inputs_hash", "now"), "rule_id").where(~F.col("inputs_hash").eqNullSafe(F.col("now"))).select("page_id", "rule_id")


def compile_order(pages: DataFrame, stale_pages: DataFrame) -> DataFrame:
    """(page_id, depth, wave): stale pages and all their ancestors; model pages first, then the deepest, the index last.

    Pages on a loop have no order and depth -1.
    """
    tree = hierarchy.resolve(pages, "page_id", "parent_id", with_path=True)
    need = tree.join(stale_pages.select(F.col("page_id").alias("id")), "id", "left_semi").select(F.explode("path").alias("id")).distinct()
    kind = pages.select(F.col("page_id").alias("id"), "kind").distinct()
    out = tree.join(need, "id", "left_semi").join(kind, "id")
    wave = F.when(F.col("kind") == "model_page", 0).when(F.col("kind") == "index", 2).otherwise(1)
    return out.select(F.col("id").alias("page_id"), "depth", wave.alias("wave"))


def fact_sheet(relations: DataFrame, entity: str, at: str) -> DataFrame:
    """(section, pos, relation_id, label): an entity's current facts by evidence, then its open contradictions."""
    mine = relations.where((F.col("subject") == entity) | (F.col("object") == entity)).withColumn("state", t.lifecycle(at)).withColumn("label", t.label())
    now = mine.where("state = 'current'").select(F.lit("current").alias("section"), "relation_id", "label", F.col("evidence_count").alias("w"))
    open_ = mine.where("contradiction_group is not null and invalidated_at is null").select(F.lit("contradictions").alias("section"), "relation_id", "label", F.lit(0).cast("long").alias("w"))
    w = Window.partitionBy("section").orderBy(F.desc("w"), "label", "relation_id")
    return now.unionByName(open_).select("section", F.row_number().over(w).alias("pos"), "relation_id", "label")


def bundle(evidence: DataFrame, facts: DataFrame, per_fact: int = 3, groups: int = 20) -> DataFrame:
    """(relation_id, claim_id, pos) of what a writer sees: the best-supported ``groups`` facts of a rule with ``per_fact`` claims each."""
    top = facts.withColumn("r", F.row_number().over(Window.partitionBy("rule_id").orderBy(F.desc("evidence_count"), "relation_id"))).where(F.col("r") <= groups)
    w = Window.partitionBy("rule_id", "relation_id").orderBy("claim_id")
    each = top.select("rule_id", "relation_id").join(evidence.where("stance = 'supports'").select("relation_id", "claim_id").distinct(), "relation_id")
    return each.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= per_fact)


def coverage(evidence: DataFrame, shown: DataFrame) -> DataFrame:
    """(relation_id, total, shown, cut) claims of each bundled fact."""
    have = evidence.where("stance = 'supports'").groupBy("relation_id").agg(F.count_distinct("claim_id").alias("total"))
    seen = shown.groupBy("relation_id").agg(F.count_distinct("claim_id").alias("shown"))
    return seen.join(have, "relation_id").withColumn("cut", F.col("total") - F.col("shown"))


def bad_links(pages: DataFrame) -> DataFrame:
    """(page_id, target): relative Markdown links of (page_id, path, body) that lead to no page."""
    found = F.regexp_extract_all("body", F.lit(r"\]\(([^)#:\s]+)(?:#[^)]*)?\)"), F.lit(1))
    links = pages.select("page_id", F.explode(found).alias("target"))
    return links.join(pages.select(F.col("path").alias("target")), "target", "left_anti").distinct()


def reach(pages: DataFrame, changed: DataFrame) -> DataFrame:
    """(page_id, below): how many pages hang below each changed page, whatever the depth; pages on loops have none."""
    tree = hierarchy.resolve(pages, "page_id", "parent_id", with_path=True)
    below = hierarchy.descendants(tree).groupBy(F.col("ancestor_id").alias("page_id")).agg(F.count(F.lit(1)).alias("below"))
    return changed.select("page_id").distinct().join(below, "page_id", "left").select("page_id", F.coalesce("below", F.lit(0)).cast("long").alias("below"))


def impact(blast: Column, confidence: Column, threshold: float, kind: Column) -> Column:
    """review where blast * (1 - confidence) passes the threshold and always for reflection and handover, else apply."""
    return F.when(kind.isin("reflection", "handover") | (blast * (1 - confidence) > threshold), "review").otherwise("apply")

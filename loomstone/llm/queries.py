"""Queries of the training-data problems and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomstone.llm import bpe, components, leaks, names, packing, residue, splitting
from loomstone.runtime import clean_id, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    ids = F.transform(F.array_append(F.coalesce("absorbed_ids", F.array().cast("array<string>")), F.col("survivor_id")), clean_id)
    groups = components.group(components.star(table(spark, d, "merge_proposals").select(ids.alias("ids")), "ids"))
    return groups.select(F.col("id").alias("entity_id"), "group_id")


P1_SQL = """
with recursive m as (select row_number() over () r, list_append(coalesce(absorbed_ids, []), survivor_id) ids from merge_proposals),
l as (select distinct r, nullif(lower(trim(id)), '') id from (select r, unnest(ids) id from m) where nullif(trim(id), '') is not null),
e as (select distinct x.id a, y.id b from l x join l y on x.r = y.r and x.id <> y.id),
c(id, root) as (select a, a from e union select e.b, c.root from c join e on c.id = e.a where e.b > c.root)
select id as entity_id, min(root) as group_id from c group by id
"""


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.pieces(table(spark, d, "documents"), table(spark, d, "blocks")).where(F.col("section_tokens") > splitting.LIMIT)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    # the first piece of each section that the operator had to cut
    return p4_pieces(spark, d).where("piece_no = 0").select("doc_id", "node_path")


P4_SQL = """
with b as (select distinct doc_id, block_ordinal, node_path, char_start, char_end from blocks),
t as (select b.doc_id, b.node_path, len(regexp_extract_all(substr(d.text, b.char_start + 1, b.char_end - b.char_start), '[^ \\t\\r\\n]+')) n
      from b join documents d using (doc_id))
select doc_id, node_path from t group by all having sum(n) > 400
"""


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "entities")
    cols = [clean_id(F.col("entity_id")).alias("id"), F.col("entity_type").alias("kind"), F.col("canonical_name").alias("name"), F.col("profile_summary").alias("profile")]
    return names.link(e.select(*cols)).select(F.col("id").alias("entity_id"), "group_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    closed = names.pairs(p6_groups(spark, d).withColumnRenamed("entity_id", "id"))
    return closed.select(F.col("a").alias("entity_id_a"), F.col("b").alias("entity_id_b"))


def p7_chunks(spark: SparkSession, d: str) -> DataFrame:
    chunks = packing.pack(table(spark, d, "documents"), table(spark, d, "blocks"))
    return chunks.select("doc_id", "first_block", "first_part", "token_count", "blocks")


def p7_room(spark: SparkSession, d: str) -> DataFrame:
    """How full the chunks of each document are, beside the fewest that its tokens could fill."""
    return packing.room(p7_chunks(spark, d))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents"))


def p9_alignments(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    # the aligned passages that hold an unbroken run
    return p9_alignments(spark, d).where(F.col("run_words") >= leaks.RUN).select("doc_id", "item_id").distinct()


_PLAIN = "regexp_extract_all(lower(strip_accents(nfc_normalize({0}))), '[\\p{{L}}\\p{{N}}]+')"
P9_SQL = f"""
with i as (select item_id, {_PLAIN.format('question')} w from eval_items union all select item_id, {_PLAIN.format('answer')} from eval_items),
g as (select distinct item_id, array_to_string(w[s:s + 9], ' ') k from (select item_id, w, unnest(range(1, len(w) - 8)) s from i)),
t as (select doc_id, {_PLAIN.format('text')} w from documents where text is not null),
h as (select doc_id, array_to_string(w[s:s + 9], ' ') k from (select doc_id, w, unnest(range(1, len(w) - 8)) s from t))
select distinct doc_id, item_id from h join g using (k)
"""

def p10_residue(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "documents"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_residue(spark, d).select("doc_id").distinct()


QUERIES = {f.__name__: f for f in (p1_found, p4_found, p4_pieces, p6_found, p6_groups, p7_chunks, p7_room, p8_ids, p9_found, p9_alignments, p10_found, p10_residue)}
SQL = {"p1_found": P1_SQL, "p4_found": P4_SQL, "p9_found": P9_SQL}

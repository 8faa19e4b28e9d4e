"""The evidence spine derived from the driver's star schema, as SQL that Spark and DuckDB both accept.

Every text names its inputs in braces; ``frame`` resolves them to lazy
DataFrames, ``oracle`` to common table expressions, so a query and its twin
start from the same definition and share nothing else.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from loomstone.runtime import table

DAY = "interval '1' day"

TABLES: dict[str, str] = {
    "s_entities": """
        select concat('cust:', cast(c_custkey as string)) as entity_id, 'Organization' as type, c_name as canonical_name, lower(c_name) as normalized_name,
               case when c_custkey % 10 in (3, 4) then 'merged' else 'active' end as status,
               case when c_custkey % 10 in (3, 4) then concat('cust:', cast(c_custkey - 1 as string)) end as merged_into,
               cast(c_custkey % 7 as int) as mention_count, cast(c_custkey % 5 as int) as graph_degree
        from {customer}
        union all select concat('supp:', cast(s_suppkey as string)), 'Organization', s_name, lower(s_name), 'active', null, 1, 1 from {supplier}
        union all select distinct concat('brand:', p_brand), 'Product', p_brand, lower(p_brand), 'active', null, 2, 0 from {part}
        union all select concat('nation:', cast(n_nationkey as string)), 'Place', n_name, lower(n_name), 'active', null, 3, 2 from {nation}
        union all select concat('region:', cast(r_regionkey as string)), 'Place', r_name, lower(r_name), 'active', null, 4, 2 from {region}""",
    "s_aliases": """
        select concat(entity_id, '#0') as alias_id, entity_id, canonical_name as alias_text, normalized_name as lemma, cast(0 as int) as first_seen from {s_entities}
        union all select concat(entity_id, '#1'), entity_id, substring(canonical_name, 1, 12), substring(normalized_name, 1, 12), 1
        from {s_entities} where length(canonical_name) % 5 = 3""",
    "s_order_supplier": "select l_orderkey, min(l_suppkey) as suppkey from {lineitem} group by l_orderkey",
    "s_relations": """
        select concat('a:c', cast(c_custkey as string)) as relation_id, concat('cust:', cast(c_custkey as string)) as subject, 'located_in' as predicate,
               concat('nation:', cast(c_nationkey as string)) as object, cast(null as timestamp) as valid_from, cast(null as timestamp) as valid_until,
               cast('1992-01-01' as timestamp) as ingested_at, cast(null as timestamp) as invalidated_at, cast(1 as bigint) as evidence_count,
               cast(null as string) as contradiction_group, cast(null as string) as fact_label from {customer}
        union all select concat('a:s', cast(s_suppkey as string)), concat('supp:', cast(s_suppkey as string)), 'located_in', concat('nation:', cast(s_nationkey as string)),
               null, null, cast('1992-01-01' as timestamp), null, 1, null, null from {supplier}
        union all select concat('b:', cast(n_nationkey as string)), concat('nation:', cast(n_nationkey as string)), 'part_of', concat('region:', cast(n_regionkey as string)),
               null, null, cast('1992-01-01' as timestamp), null, 1, null, 'lies in' from {nation}
        union all select concat('c:', cast(o_custkey as string), ':', p_brand), concat('cust:', cast(o_custkey as string)), 'uses', concat('brand:', p_brand),
               min(o_orderdate), null, min(o_orderdate) + interval '1' day, null, count(distinct l_orderkey), null, null
        from {orders} join {lineitem} on o_orderkey = l_orderkey join {part} on l_partkey = p_partkey group by o_custkey, p_brand
        union all select concat('d:', cast(o_orderkey as string)), concat('cust:', cast(o_custkey as string)), 'affiliated_with', concat('supp:', cast(suppkey as string)),
               o_orderdate, lead(o_orderdate) over (partition by o_custkey order by o_orderdate, o_orderkey), o_orderdate + interval '1' day,
               case when o_orderkey % 17 = 0 then o_orderdate + interval '31' day end, 1,
               case when count(*) over (partition by o_custkey, date_trunc('month', o_orderdate)) > 1
                    then concat('g:', cast(o_custkey as string), ':', cast(year(o_orderdate) * 100 + month(o_orderdate) as string)) end, null
        from {orders} join {s_order_supplier} on o_orderkey = l_orderkey""",
    "s_observations": """
        select concat('o:', cast(o_orderkey as string)) as observation_id, concat('cust:', cast(o_custkey as string)) as subject, concat('order status ', o_orderstatus) as statement,
               o_orderdate as valid_from, lead(o_orderdate) over (partition by o_custkey order by o_orderdate, o_orderkey) as valid_until,
               o_orderdate + interval '1' day as ingested_at, case when o_orderkey % 13 = 0 then o_orderdate + interval '20' day end as invalidated_at,
               cast(1 as bigint) as evidence_count from {orders}""",
    "s_claims": """
        select md5(concat_ws('|', cast(l_orderkey as string), cast(l_linenumber as string), cast(l_partkey as string), cast(l_suppkey as string),
                   cast(cast(l_quantity as bigint) as string), cast(cast(round(l_extendedprice * 100) as bigint) as string), cast(cast(round(l_discount * 100) as bigint) as string),
                   cast(cast(round(l_tax * 100) as bigint) as string), l_returnflag, l_linestatus)) as claim_id,
               concat('ord:', cast(l_orderkey as string)) as doc_id, concat('line ', cast(l_linenumber as string), ' supplied by ', cast(l_suppkey as string), ' of part ', cast(l_partkey as string)) as claim_text,
               l_returnflag <> 'R' as is_current, l_shipdate as ingested_at, l_linenumber, l_linestatus, l_orderkey, l_partkey from {lineitem}""",
    "s_evidence": """
        select distinct concat('c:', cast(o_custkey as string), ':', p_brand) as relation_id, claim_id, doc_id, is_current,
               case when l_linestatus = 'F' and l_linenumber = 7 then 'contradicts' else 'supports' end as stance
        from {s_claims} join {orders} on o_orderkey = l_orderkey join {part} on l_partkey = p_partkey
        union all select distinct concat('d:', cast(l_orderkey as string)), claim_id, doc_id, is_current,
               case when l_linestatus = 'F' and l_linenumber = 7 then 'contradicts' else 'supports' end from {s_claims}""",
    "s_currency": """
        select concat(claim_id, ':1') as event_id, claim_id, doc_id, false as became_current, cast(1 as int) as seq, 'supersede' as reason from {s_claims} where not is_current
        union all select concat(claim_id, ':2'), claim_id, doc_id, true, 2, 'regain' from {s_claims} where not is_current and l_linenumber % 3 = 0""",
    "s_work": """
        select event_id as work_id, event_type as stage, case when user_id % 2 = 0 then 'steady' else 'backfill' end as lane,
               case when event_type = 'error' then 'dead' when event_id % 5 = 0 then 'pending' else 'done' end as status,
               concat('t', cast(user_id as string)) as target, concat('v', cast(event_id % 3 as string)) as version, ts as enqueued_at,
               cast(event_id % 4 as int) as attempts, round(value, 2) as cost from {events}""",
}
NAMES = re.compile(r"\{(\w+)\}")


def frame(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A spine or driver table as a lazy DataFrame."""
    if name not in TABLES:
        return table(spark, d, name)
    text = TABLES[name]
    return spark.sql(text, **{n: frame(spark, d, n) for n in sorted(set(NAMES.findall(text)))})


def oracle(sql: str) -> str:
    """The SQL with the spine tables it names as leading common table expressions."""
    order: list[str] = []

    def visit(text: str) -> None:
        for n in dict.fromkeys(NAMES.findall(text) + re.findall(r"\bs_\w+\b", text)):
            if n in TABLES and n not in order:
                visit(TABLES[n])
                order.append(n)

    visit(sql)
    body = NAMES.sub(r"\1", sql).strip()
    recursive = body.lower().startswith("with recursive")
    if body.lower().startswith("with "):
        body = ", " + body[len("with recursive ") if recursive else len("with ") :]
    ctes = ", ".join(f"{n} as ({NAMES.sub(r'\1', TABLES[n])})" for n in order)
    if not ctes:
        return NAMES.sub(r"\1", sql).strip()
    return f"with {'recursive ' if recursive else ''}{ctes} {body}"

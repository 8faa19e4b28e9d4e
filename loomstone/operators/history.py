"""History of changing attributes: one version per unchanged state, built by a sorted merge."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from loomstone.runtime import Scratch


def _streamer(key: str, at: str, state: list[str], out_schema: pa.Schema):
    """Reads rows sorted by (key, time); emits each version when the next row closes it.

    Whatever the length of a history, only the open version is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last: pa.Table | None = None  # the open version: its first row
        last_state: pa.Table | None = None
        number, first_of_part = 0, True
        cols = [key, at, *state]
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch]).select(cols)
            joined = rows if last_state is None else pa.concat_tables([last_state, rows])
            # a change against the row before, null being equal to null
            n = joined.num_rows
            here, before = joined.slice(1), joined.slice(0, n - 1)

            def differs(c):
                a, b = here[c], before[c]
                ne = pc.fill_null(pc.not_equal(a, b), False)
                return pc.or_(ne, pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy()

            new_key = differs(key) if n > 1 else np.zeros(0, bool)
            starts = new_key.copy()
            for c in state:
                if n > 1:
                    starts |= differs(c)
            if last_state is None:  # the very first row of the partition opens a version
                new_key, starts = np.concatenate([[True], new_key]), np.concatenate([[True], starts])
            opened = np.flatnonzero(starts)
            last_state = rows.slice(rows.num_rows - 1)
            if not len(opened):
                continue
            # version numbers restart at each new key
            fresh = new_key[opened]
            base = np.arange(len(opened))
            since = np.maximum.accumulate(np.where(fresh, base, -1))
            numbers = np.where(since >= 0, base - since + 1, number + base + 1)
            versions = rows.take(pa.array(opened))
            numbered = versions.append_column("version_no", pa.array(numbers, pa.int64()))
            number = int(numbers[-1])
            pending = numbered if last is None else pa.concat_tables([last, numbered])
            closed = pending.slice(0, pending.num_rows - 1)
            if closed.num_rows:
                follow = pending.slice(1)
                same = pc.equal(closed[key], follow[key])
                until = pc.if_else(same, follow[at], pa.scalar(None, follow[at].type))
                yield from _emit(closed, until, part, first_of_part, False, out_schema)
                first_of_part = False
            last = pending.slice(pending.num_rows - 1)
        if last is not None:
            yield from _emit(last, pa.nulls(1, last[at].type), part, first_of_part, True, out_schema)

    return run


def _emit(rows: pa.Table, until, part: int, head: bool, tail: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    n = rows.num_rows
    flags = np.zeros(n, bool)
    heads, tails = flags.copy(), flags.copy()
    heads[0], tails[-1] = head, tail
    data = {name: rows[name] for name in rows.column_names}
    data |= {"valid_to": until, "_part": pa.array(np.full(n, part), pa.int32()), "_head": pa.array(heads), "_tail": pa.array(tails)}
    yield from pa.table({f.name: data[f.name] for f in schema}).cast(schema).combine_chunks().to_batches()


def versions(readings: DataFrame, key: str, at: str, state: list[str], recorded: str | None = None) -> DataFrame:
    """Every version of every entity: (key, version_no, valid_from=at, valid_to, state...).

    Of several readings of one key at one instant the one with the largest
    ``recorded`` counts (ties: the largest state, so the result does not depend
    on row order). A version begins at the first reading of a key and at each
    reading whose state differs from the reading before; null equals null; a
    return to an older state is a new version. ``valid_to`` is the begin of the
    next version, null while open. Columns of the result are named ``key``,
    ``version_no``, ``at``, ``valid_to`` and the state columns; any other input
    column is ignored, whatever its name.

    Readings without key or instant do not count. An empty input gives an empty
    result.

    Plan: repeated readings collapse in a partially pre-aggregated ``groupBy``,
    then a range shuffle on (key, time) with an external merge sort co-partitions
    all snapshots, so a key that holds a third of the rows spreads over many
    partitions. Each partition is one pass over the merged sorted runs that holds
    the open version only. Versions cut by a partition edge are joined from two
    rows a partition, a size given by the partition count and not by the data.
    """
    spark = readings.sparkSession
    tie = [recorded] if recorded else []
    packed = F.max(F.struct(*[F.col(c) for c in [*tie, *state]])).alias("_last")
    rows = (
        readings.where(F.col(key).isNotNull() & F.col(at).isNotNull())
        .groupBy(F.col(key).alias(key), F.col(at).alias(at))
        .agg(packed)
        .select(key, at, *[F.col(f"_last.{c}").alias(c) for c in state])
    )
    ordered = rows.repartitionByRange(F.col(key), F.col(at)).sortWithinPartitions(key, at)
    fields = [rows.schema[key], rows.schema[at], *[rows.schema[c] for c in state]]
    out = T.StructType([T.StructField(f.name, f.dataType) for f in fields] + [
        T.StructField("version_no", T.LongType()),
        T.StructField("valid_to", rows.schema[at].dataType),
        T.StructField("_part", T.IntegerType()),
        T.StructField("_head", T.BooleanType()),
        T.StructField("_tail", T.BooleanType()),
    ])
    from pyspark.sql.pandas.types import to_arrow_schema

    run = _streamer(key, at, state, to_arrow_schema(out, timestamp_utc=True))
    scratch = Scratch(spark, "history")
    pieces, _ = scratch.save(ordered.mapInArrow(run, out))
    edges = pieces.where(F.col("_head") | F.col("_tail")).select(
        "_part", "_head", "_tail", key, "version_no", at, "valid_to", F.struct(*state).alias("_state")
    )
    fixes = _stitch([r.asDict(recursive=True) for r in edges.collect()], key, at)  # two rows a partition
    fix_schema = T.StructType([
        T.StructField("_part", T.IntegerType()), T.StructField("_head_key", rows.schema[key].dataType), T.StructField("_offset", T.LongType()),
        T.StructField("_drop", T.BooleanType()), T.StructField("_tail_to", rows.schema[at].dataType),
    ])
    fix = F.broadcast(spark.createDataFrame(fixes, fix_schema))
    merged = pieces.join(fix, "_part", "left")
    return merged.where(~(F.col("_head") & F.coalesce(F.col("_drop"), F.lit(False)))).select(
        key,
        (F.col("version_no") + F.when(F.col(key) == F.col("_head_key"), F.col("_offset")).otherwise(0)).alias("version_no"),
        at,
        F.when(F.col("_tail"), F.col("_tail_to")).otherwise(F.col("valid_to")).alias("valid_to"),
        *state,
    )


def _stitch(edges: list[dict], key: str, at: str) -> list[tuple]:
    """Offsets of the first key, and the end of the last version, of each partition, from its two edge rows."""
    parts: dict[int, dict] = {}
    for e in edges:
        p = parts.setdefault(e["_part"], {})
        if e["_head"]:
            p["head"] = e
        if e["_tail"]:
            p["tail"] = e
    order, fixes, open_key, open_state, open_count = sorted(parts), {}, None, None, 0
    for p in order:
        head, tail = parts[p]["head"], parts[p]["tail"]
        goes_on = head[key] == open_key
        drop = goes_on and head["_state"] == open_state
        offset = open_count - int(drop) if goes_on else 0
        fixes[p] = [p, head[key], offset, drop, None]
        count = tail["version_no"] + (offset if tail[key] == head[key] else 0)
        open_key, open_state, open_count = tail[key], tail["_state"], count
    # the end of a partition's last version: the next kept version of the same key
    follow: tuple | None = None
    for p in reversed(order):
        head, tail = parts[p]["head"], parts[p]["tail"]
        if follow and follow[0] == tail[key]:
            fixes[p][4] = follow[1]
        if not fixes[p][3]:
            follow = (head[key], head[at])
        elif not head["_tail"]:
            # the head continues an earlier partition's version, which ends where the head ends
            follow = (head[key], head["valid_to"])
    return [tuple(f) for _, f in sorted(fixes.items())]

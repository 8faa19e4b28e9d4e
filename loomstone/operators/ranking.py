"""Distances, nearest neighbours, rank fusion and reranking as column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

#: Query vectors sent to the executors at a time.
BLOCK_ROWS = 4096
RRF_K = 60
#: Weights of graph proximity and support beside the fused score.
PROXIMITY, SUPPORT = 0.10, 0.10


def l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two vectors; null if their lengths differ."""
    diff = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.when(F.size(a) == F.size(b), F.aggregate(diff, F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 for vectors of different lengths or without length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms).otherwise(F.lit(0.0))


def nearest(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", vector: str = "embedding", **prefilter: object) -> DataFrame:
    """The k rows nearest to one query vector (L2), after the scalar prefilter: (key, distance).

    Distances are computed in the scan; a bounded heap a task keeps k rows
    (TakeOrderedAndProject), so the cost is one pass and k rows a task move.
    """
    from loomstone.operators.temporal import only

    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.where(only(**prefilter)).select(key, l2(F.col(vector), q).alias("distance")).where("distance is not null").orderBy("distance", key).limit(k)


def nearest_all(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest rows of every query row by L2: (query_id, key, distance, rank), self excluded; exact.

    The stated queries are read in blocks of at most BLOCK_ROWS and sent to every
    executor; against each block one scan of the vectors multiplies whole Arrow
    batches and keeps k rows a task and query, so k rows a task and query are all
    that is shuffled. Vectors of another length than the query's are no neighbours.
    """
    spark, block, out = vectors.sparkSession, [], None
    for row in queries.where(F.col(vector).isNotNull()).select(key, vector).toLocalIterator():
        block.append((row[0], row[1]))
        if len(block) == BLOCK_ROWS:
            found = _scan_block(vectors, block, k, key, vector)
            out, block = found if out is None else out.unionByName(found), []
    if block or out is None:
        found = _scan_block(vectors, block, k, key, vector)
        out = found if out is None else out.unionByName(found)
    w = Window.partitionBy("query_id").orderBy("distance", key)
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _scan_block(vectors: DataFrame, block: list, k: int, key: str, vector: str) -> DataFrame:
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType
    schema = T.StructType([T.StructField("query_id", kind), T.StructField(key, kind), T.StructField("distance", T.DoubleType())])
    if not block:
        return spark.createDataFrame([], schema)
    sent = spark.sparkContext.broadcast(block)  # at most BLOCK_ROWS vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_size: dict[int, list] = {}
        for q, v in sent.value:
            by_size.setdefault(len(v), []).append((q, v))
        mats = {n: ([q for q, _ in qs], np.array([v for _, v in qs], np.float64)) for n, qs in by_size.items()}
        best: dict = {q: [] for q, _ in sent.value}
        for batch in batches:
            rows = [(i, v) for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if v is not None]
            for n, (ids, qm) in mats.items():
                own = [(i, v) for i, v in rows if len(v) == n]
                if not own:
                    continue
                m = np.array([v for _, v in own], np.float64)
                for j, q in enumerate(ids):
                    dist = ((m - qm[j]) ** 2).sum(axis=1)
                    near = np.argsort(dist, kind="stable")[: k + 1] if len(own) <= k + 1 else np.flatnonzero(dist <= np.partition(dist, k)[k])
                    held = best[q] + [(float(dist[r]), own[r][0]) for r in near if own[r][0] != q]
                    best[q] = sorted(held)[:k]
        out = [(q, i, d) for q, held in best.items() for d, i in held]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [batch.schema.field(0).type] * 2 + [pa.float64()])], names=["query_id", key, "distance"])

    return vectors.select(key, vector).mapInArrow(run, schema)


def fuse(rankings: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (channel, id, rank from 1): (id, score, contributions), best first, ties by id.

    Each channel counts an id once, at its best rank, so a repeated id does not forge agreement.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    best = rankings.groupBy("channel", "id").agg((F.lit(1.0) / (k + F.min("rank"))).alias("part"))
    packed = F.sort_array(F.collect_list(F.struct("channel", "part")))
    fused = best.groupBy("id").agg(packed.alias("_p"))
    # added in channel order, so the sum does not depend on how rows arrived
    total = F.aggregate("_p", F.lit(0.0), lambda s, x: s + x["part"])
    return fused.select("id", total.alias("score"), F.map_from_entries("_p").alias("contributions")).orderBy(F.desc("score"), "id")


def rerank(items: DataFrame, signal: str) -> DataFrame:
    """Items (id, score, signal) ordered by one signal, missing last; graph_distance ascends, evidence_count descends. Scores stay."""
    order = {"graph_distance": F.asc_nulls_last, "evidence_count": F.desc_nulls_last}
    if signal not in order:
        from loomstone.operators.primitives import Boundary

        raise Boundary(f"no signal {signal}")
    return items.orderBy(order[signal](signal), F.desc("score"), "id")


def rerank_weighted(items: DataFrame) -> DataFrame:
    """(id, final): score over the largest score + 0.10 proximity + 0.10 support, each min-max scaled over the candidate set.

    A signal with one value scales to 1, a missing one to 0.
    """
    low_high = items.agg(
        F.max("score").alias("s"), F.min("graph_distance").alias("d0"), F.max("graph_distance").alias("d1"), F.min("evidence_count").alias("e0"), F.max("evidence_count").alias("e1")
    )
    scaled = lambda v, lo, hi: F.when(v.isNull(), 0.0).when(F.col(hi) == F.col(lo), 1.0).otherwise((v - F.col(lo)) / (F.col(hi) - F.col(lo)))
    near = F.when(F.col("graph_distance").isNull(), 0.0).when(F.col("d1") == F.col("d0"), 1.0).otherwise((F.col("d1") - F.col("graph_distance")) / (F.col("d1") - F.col("d0")))
    final = F.col("score") / F.col("s") + PROXIMITY * near + SUPPORT * scaled(F.col("evidence_count"), "e0", "e1")
    return items.join(F.broadcast(low_high)).select("id", final.alias("final")).orderBy(F.desc("final"), "id")

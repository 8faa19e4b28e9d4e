"""Versioned Parquet snapshots behind one pointer that an older build never takes."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _read(spark: SparkSession, path: str) -> dict | None:
    fs, at = _fs(spark, path)
    if not fs.exists(at):
        return None
    return json.loads("\n".join(r[0] for r in spark.read.text(path).collect()))  # one small file


def _write(spark: SparkSession, path: str, value: dict) -> None:
    """Written beside the target and renamed over it."""
    fs, at = _fs(spark, path)
    _, tmp = _fs(spark, f"{path}.tmp")
    out = fs.create(tmp, True)
    out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
    out.close()
    fs.delete(at, False)
    fs.rename(tmp, at)


def digest(df: DataFrame) -> dict:
    """Rows and an order-free checksum of a table, computed where the rows are; the sum beside the exclusive or tells repeated rows apart."""
    each = F.xxhash64(*df.columns)
    row = df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(each).alias("x"), F.sum(each.cast("decimal(20,0)")).alias("s")).first()
    return {"rows": row["n"], "checksum": row["x"] or 0, "sum": str(row["s"] or 0)}


def publish(spark: SparkSession, root: str, version: str, built_at: str, tables: dict[str, DataFrame]) -> bool:
    """Writes the tables and moves the pointer, unless a snapshot built later holds it already; gives whether it moved.

    Every table is read back and must hold the rows that were exported.
    """
    manifest = {}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{version}/{name}")
        manifest[name] = digest(spark.read.parquet(f"{root}/{version}/{name}"))
        if manifest[name]["rows"] != df.count():
            raise ValueError(f"{name}: exported and written rows differ")
    _write(spark, f"{root}/{version}/manifest.json", {"built_at": built_at, "tables": manifest})
    now = _read(spark, f"{root}/latest.json")
    if now and now["built_at"] > built_at:
        return False
    _write(spark, f"{root}/latest.json", {"version": version, "built_at": built_at})
    return True


def latest(spark: SparkSession, root: str, verify: bool = True) -> dict[str, DataFrame]:
    """The tables of the latest snapshot, checked against its manifest."""
    pointer = _read(spark, f"{root}/latest.json")
    if pointer is None:
        raise FileNotFoundError(f"{root} holds no snapshot")
    base = f"{root}/{pointer['version']}"
    manifest = _read(spark, f"{base}/manifest.json")["tables"]
    out = {name: spark.read.parquet(f"{base}/{name}") for name in manifest}
    if verify and (bad := [n for n, df in out.items() if digest(df) != manifest[n]]):
        raise ValueError(f"damaged tables: {', '.join(bad)}")
    return out


def write_tree(pages: DataFrame, root: str) -> None:
    """Files (path, content) below a folder, written by the executors."""

    def put(rows) -> None:
        from pathlib import Path

        for r in rows:
            at = Path(root, r.path)
            if Path(root).resolve() not in at.resolve().parents:
                raise ValueError(f"{r.path} leaves the folder")
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_text(r.content, encoding="utf-8")

    pages.select("path", "content").foreachPartition(put)

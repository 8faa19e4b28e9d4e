"""Session settings and the shared scratch space of iterative operators.

Iterative operators cut their lineage by writing a Parquet table into the
folder the cluster names in ``spark.checkpoint.dir``. That folder is shared and
reliable, so a lost executor costs a re-read, never a failed job.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F


def session(app: str = "loomstone", cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings the engine is developed under."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=1)
def _local_root() -> str:
    root = tempfile.mkdtemp(prefix="loomstone-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root


def scratch_root(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only in local mode without one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        root = _local_root()
    return root.rstrip("/")


#: Folders of the operator runs of this process, until they are released.
_RUNS: list[str] = []


def release(spark: SparkSession) -> int:
    """Deletes the scratch tables of all operator runs so far and gives their number; call it once their lazy results are written."""
    runs, _RUNS[:] = list(_RUNS), []
    for base in runs:
        at = spark._jvm.org.apache.hadoop.fs.Path(base)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(runs)


class Scratch:
    """Written intermediate tables of one operator run; superseded ones are deleted at once, the last ones by ``release``."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
        self.step = 0
        _RUNS.append(self.base)

    def save(self, df: DataFrame, **metrics) -> tuple[DataFrame, dict]:
        """Write ``df`` and read it back; ``metrics`` are aggregates observed during the same write."""
        self.step += 1
        path = f"{self.base}/{self.step}"
        seen = Observation() if metrics else None
        if metrics:
            df = df.observe(seen, *[expr.alias(name) for name, expr in metrics.items()])
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out, (seen.get if metrics else {})

    def drop(self, *frames: DataFrame | None) -> None:
        """Delete tables that no later step reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for frame in frames:
            path = getattr(frame, "_scratch_path", None)
            if path:
                at = jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(conf).delete(at, True)


def clean_id(column):
    """One spelling per id: lower case, no surrounding blanks, a blank id is no id (null)."""
    trimmed = F.lower(F.trim(F.regexp_replace(column, r"^\s+|\s+$", "")))
    return F.when(trimmed != "", trimmed)

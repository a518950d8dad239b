"""Intermediate tables in the folder that every executor shares.

Iterative jobs cut their lineage by writing a table and reading it back.  The
folder is ``spark.checkpoint.dir``; only where the session has none (tests,
notebooks) a local one is made and set.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_RUN = uuid.uuid4().hex[:12]
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session, without a trailing slash."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors and the driver share")
        if "dir" not in _OWN:
            _OWN["dir"] = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        base = _OWN["dir"]
    return base.rstrip("/")


class Scratch:
    """Tables of one run of one operator, under one folder of their own."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{_RUN}-{uuid.uuid4().hex[:8]}"
        self._n = 0
        _LIVE.append(self)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return it as read back, with its schema kept."""
        path = self.path(name)
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of ``save`` that nothing will read again."""
        for df in tables:
            if path := getattr(df, "_scratch_path", None):
                _delete(self.spark, path)


    def close(self) -> None:
        """Delete all tables; nothing may read them any more."""
        _delete(self.spark, self.root)
        _LIVE.remove(self)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


_LIVE: list[Scratch] = []


def small_batches(spark: SparkSession, most: int = 2_000) -> None:
    """Arrow batches of the session hold ``most`` rows at most from now on, as rows with whole texts are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= most:
        spark.conf.set(key, str(most))


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for scratch in _LIVE:
        try:
            if scratch.spark.sparkContext._jsc is not None:
                _delete(scratch.spark, scratch.root)
        except Exception:  # the session is gone; its folder is the cluster's to clean
            return

"""Intermediate tables in the folder that driver and executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir`` (read from the session; set to a
folder of our own only where it is unset, as in local tests) and reading it back, so a lost executor
costs a re-read and not a re-computation.  ``release(tag)`` removes the folders of one user of this
module once what was built from them has been written elsewhere; the rest goes when Python ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_open: dict[str, list[tuple[SparkSession, str]]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; local sessions without one get a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='maskwright-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _delete(spark: SparkSession, folder: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is None:
        return
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """One operator call's folder of intermediate tables."""

    def __init__(self, spark: SparkSession, tag: str = "query"):
        self.spark, self.tag = spark, tag
        self.root = f"{shared_dir(spark)}/maskwright-{uuid.uuid4().hex}"
        self.n = 0
        _open.setdefault(tag, []).append((spark, self.root))

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and return it as read from its files."""
        path = self.path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def release(tag: str) -> None:
    """Delete what Scratch(…, tag) has written; to be called when its results are stored elsewhere."""
    for spark, folder in _open.pop(tag, []):
        _delete(spark, folder)


@atexit.register
def _release_all() -> None:
    for tag in list(_open):
        try:
            release(tag)
        except Exception:  # the session may be gone already; its folder is then the cluster's to clean
            _open.pop(tag, None)

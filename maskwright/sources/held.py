"""Tables that are computed once and read many times, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import tempfile
import threading
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of text of a batch that are Python objects at once.
PIECE_ROWS, PIECE_BYTES = 1000, 4 << 20

_made: dict[str, list[tuple[SparkSession, str]]] = {}
_named: contextvars.ContextVar[str | None] = contextvars.ContextVar("owner", default=None)


def owner() -> str:
    """Whose tables `hold` writes here: the name that `owned` gives, else this thread."""
    return _named.get() or f"thread {threading.get_ident()}"


@contextlib.contextmanager
def owned(name: str) -> Iterator[None]:
    """Within it, `hold` writes for this name, so that `drop_held(name)` deletes just that."""
    before = _named.set(name)
    try:
        yield
    finally:
        _named.reset(before)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session without one gets a temporary folder, a cluster must have one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='maskwright-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def hold(df: DataFrame) -> DataFrame:
    """df as written and read back: a lost executor costs a re-read.  The files go when Python ends, or by `drop_held`."""
    path = f"{shared_folder(df.sparkSession)}/maskwright-held-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.setdefault(owner(), []).append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_held(name: str | None = None) -> None:
    """Delete what `hold` has written for this owner (by default the one here); to be called when what was built from it is stored elsewhere."""
    for spark, folder in _made.pop(name or owner(), []):
        if spark.sparkContext._jsc is not None:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _at_end() -> None:
    try:
        for name in list(_made):
            drop_held(name)
    except Exception:  # the session may be gone already; its folder is then the cluster's to clean
        _made.clear()


def pieces(batch: pa.RecordBatch, text: str = "text") -> Iterator[pa.RecordBatch]:
    """A batch in pieces of PIECE_ROWS rows and PIECE_BYTES bytes of text at most (one row at least): what Python holds as objects at once."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        end = min(max(int(np.searchsorted(ends, before + PIECE_BYTES, "right")), at + 1), at + PIECE_ROWS, batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def spread(df: DataFrame) -> DataFrame:
    """df, dealt to as many partitions as there are cores where it is a plain reading of fewer: a table of few files."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "AdaptiveSparkPlan" in df._jdf.queryExecution().executedPlan().toString():  # has a shuffle of its own; its partitions are not known yet
        return df
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df

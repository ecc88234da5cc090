"""A corpus from the documents table: toxic documents out, near duplicates out, repeated passages cut,
secrets masked, and the rest packed into sequences of tokens.

Each stage takes the whole result of the stage before it, as written to and read back from Parquet;
all but the last return the columns of documents.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import near_dedup, packing, secrets, substring_dedup, toxicity
from maskwright.llm.scratch import Scratch, release

#: A worker serves beside a JVM that four stages have filled, so it takes less at once than the operators' defaults allow.
PASSAGE_BLOCK_BYTES = substring_dedup.BLOCK_BYTES // 2
PACKING_SLICE_BYTES, PACKING_REMEMBERED = 2 << 20, 200_000
#: Rows that JVM and worker exchange at once while a stage runs: both hold a batch of texts, and the JVM does not give its buffers back.
BATCH_ROWS = 1000

#: SQL cannot express the trees of the first stage or the tokenizer of the last.
ORACLE_SQL = None


def _tag() -> str:
    """Of this thread's pipeline: one that runs in another thread keeps its tables."""
    return f"pipeline-{threading.get_ident()}"


def _scratch(spark: SparkSession) -> Scratch:
    """A stage's folder.  What earlier stages of this thread kept in theirs goes: a stage's result is to be written before the next stage is called."""
    release(_tag())
    return Scratch(spark, _tag())


def _small_batches(spark: SparkSession) -> None:
    """Batches of BATCH_ROWS for what is run from here on, unless the session asks for smaller ones."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def _with_text(docs: DataFrame, columns: list[str], changed: str = "_changed") -> DataFrame:
    """The columns of documents; n_chars is counted again where the text has changed."""
    n = F.when(F.col(changed), F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return docs.select(*[n.alias("n_chars") if c == "n_chars" else F.col(c) for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the trees, learned from the labels of sf_dir, do not predict to be toxic."""
    _small_batches(spark)
    return toxicity.keep_clean(docs, toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five words, 0.8): that with the smallest id, null last, then the first in docs.

    Rows are told by their places in docs, not by their ids: rows that repeat an id, or have none, go only as near
    duplicates of a row that stays.  docs must come in the same order whenever it is read, as files do.
    """
    _small_batches(spark)
    rows = docs.withColumn("_row", F.monotonically_increasing_id())
    groups = near_dedup.near_duplicates(rows, id_col="_row", scratch=_scratch(spark)).select("_row", "component_id")
    told = rows.select("_row", "doc_id").join(groups, "_row")
    # who stays is aggregated by group, but joined by row: a group of any size is no task
    stays = told.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "_row"))["_row"].alias("stays"))
    gone = told.select("_row").join(stays, F.col("_row") == F.col("stays"), "left_anti")
    return rows.join(gone, "_row", "left_anti").drop("_row").select(*docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 35 words that occur more than once; others stay as they are."""
    _small_batches(spark)
    release(_tag())
    keep = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = substring_dedup.remove_repeated_passages(docs, keep=keep, untouched=True, block_bytes=PASSAGE_BLOCK_BYTES)
    return _with_text(out.withColumn("text", F.col("kept_text")).withColumn("_changed", F.col("n_removed") > 0), docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with each secret found replaced by its kind."""
    found = secrets.scan_versions(docs, _scratch(spark).path("ledger"))
    some = F.size("_spans") > 0
    out = found.withColumn("text", F.when(some, secrets.redacted(F.col("text"), F.col("_spans"))).otherwise(F.col("text"))).withColumn("_changed", some)
    return _with_text(out, docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens; ids as little-endian uint32."""
    _small_batches(spark)
    release(_tag())
    return packing.pack_documents(docs, slice_bytes=PACKING_SLICE_BYTES, remembered=PACKING_REMEMBERED)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeated_passages),
    ("secrets", mask_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; the rows of the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    between = Scratch(spark, f"{_tag()}-run")
    for name, stage in STAGES[:-1]:
        docs = between.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Importance resampling towards a target: hashed n-gram counts of the corpus and of the target give each document
a weight, and Gumbel noise from its id draws without replacement.

A scan of a document keeps the running zlib states of the features that start at its last n words: each new word
extends every state by a space and the word (`zlib.crc32` goes on from a state), which hashes all n-grams
without building one.  The scan emits the features' buckets.

In Spark: one scan counts buckets, a task's counts are one row a bucket at most; the gains of all buckets (their number is
a parameter) go to the tasks, which scan again and add them up, so neither texts nor buckets are shuffled or stored.
Ranks come from one sort by ranges: the place in its range plus the sizes of the ranges before it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import segments
from .scratch import Scratch
from .words import as_array, claim, lean_stream, row_slices

N, BUCKETS, PERCENT, LEAST_WORDS, SEED = 3, 10_000, 5, 20, 42
#: Bytes of text taken at once.
SLICE = 8 << 20
# Words are runs of digits, letters a-z (A-Z lower-cased) and bytes beyond ASCII; everything else becomes a space.
_FOLD = bytes((b | 32) if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def scan(raw: bytes, n: int = N) -> Iterator[tuple[int, list[int]]]:
    """(words, CRC-32 of every run of 1 to n words that ends there) of each part of a UTF-8 text, in order."""
    ring: list[int] = []
    for part in segments(raw.translate(_FOLD)):
        words, out = part.split(), []
        for w in words:
            more = b" " + w
            ring = [crc32(more, state) for state in ring[: n - 1]]
            ring.insert(0, crc32(w))
            out += ring
        yield len(words), out


def _buckets(raw: bytes, n: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    for words, crcs in scan(raw, n):
        yield words, np.array(crcs, np.int64) % buckets


def _texts(batches, column: str = "_text"):
    """(batch, first row, texts as bytes) of all rows, some at once."""
    for batch in batches:
        text = as_array(batch[column]).cast(pa.large_binary())
        for lo, hi in row_slices(text, SLICE):
            yield batch, lo, [x or b"" for x in text[lo:hi].to_pylist()]


def bucket_counts(texts: DataFrame, text_col: str = "text", n: int = N, buckets: int = BUCKETS) -> DataFrame:
    """(bucket int, n long): features of all texts by bucket; buckets without any have no row."""

    @lean_stream
    def f(batches):
        claim("importance")
        total = np.zeros(buckets, np.int64)
        for _, _, some in _texts(batches):
            for raw in some:
                for _, b in _buckets(raw, n, buckets):
                    total += np.bincount(b, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held])], ["bucket", "n"])

    return texts.select(F.col(text_col).alias("_text")).mapInArrow(f, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", n: int = N, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln) of how much likelier each bucket is in the target, both counts raised by one: `buckets` numbers."""
    held = []
    for df in (docs, target):
        counts = np.zeros(buckets, np.int64)
        for r in bucket_counts(df, text_col, n, buckets).collect():  # one row a bucket
            counts[r["bucket"]] = r["n"]
        held.append(counts)
    s, t = (c.astype(float) for c in held)
    big_s, big_t = s.sum() + buckets, t.sum() + buckets
    return np.array([math.floor(1000 * math.log((y + 1) * big_s / ((x + 1) * big_t))) for x, y in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def feature_buckets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, buckets: int = BUCKETS) -> DataFrame:
    """Per row of docs: id and the buckets of its features, as they end, shorter ones first (array<int>)."""

    @lean_stream
    def f(batches):
        claim("importance")
        for batch, lo, some in _texts(batches):
            told = [np.concatenate([b for _, b in _buckets(raw, n, buckets)]).astype(np.int32) for raw in some]
            yield pa.RecordBatch.from_arrays([batch["_id"][lo : lo + len(some)], pa.array(told, pa.list_(pa.int32()))], ["_id", "buckets"])

    key = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(f, f"_id {key}, buckets array<int>").withColumnRenamed("_id", id_col)


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", n: int = N, seed: int = SEED) -> DataFrame:
    """Per row of docs: id, n_words, n_features, weight (sum of its features' gains) and score (weight plus noise), all long."""

    @lean_stream
    def f(batches):
        claim("importance")
        for batch, lo, some in _texts(batches):
            told = np.zeros((3, len(some)), np.int64)
            for i, raw in enumerate(some):
                for words, b in _buckets(raw, n, len(gain)):
                    told[:, i] += words, len(b), gain[b].sum()
            yield pa.RecordBatch.from_arrays([batch["_id"][lo : lo + len(some)], *map(pa.array, told)], ["_id", "n_words", "n_features", "weight"])

    key = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(f, f"_id {key}, n_words long, n_features long, weight long")
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return rows.withColumn("score", F.col("weight") + noise)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, scratch: Scratch | None = None) -> DataFrame:
    """Per row of docs: id, n_features, weight, score, rank and n_words, all but the id long.

    Of the rows with least_words words or more, floor(percent / 100) of them are drawn, by highest score, ties to the smaller
    id (null first); rank is 1, 2, 3 … in that order, null for rows that are not drawn.  Null and empty texts
    have no features and weight 0; a null id takes its noise from the empty name.  Equal rows each stay a row
    and follow each other in rank; empty docs give an empty result, an empty target counts as no features; other columns are not looked at.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    told = scratch.save(weigh(docs, gains(docs, target, text_col, n, buckets), id_col, text_col, n, seed), "weights")
    able = told.where(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    order = [F.desc("score"), F.asc("_id"), F.asc("n_features"), F.asc("weight"), F.asc("n_words")]
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # (an id that repeats often is spread over the ranges)
    ranged = able.repartitionByRange(parts, *order, F.xxhash64(F.monotonically_increasing_id())).sortWithinPartitions(*order)
    ranged = scratch.save(ranged.withColumn("_at", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("_at", 33)
    sizes = sorted((r["part"], r["count"]) for r in ranged.groupBy(part.alias("part")).count().collect())  # one row a range
    before = np.concatenate([[0], np.cumsum([c for _, c in sizes])]).tolist()
    offsets = docs.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before)], "part long, before long")
    rank = F.col("before") + (F.col("_at").bitwiseAND((1 << 33) - 1)) + 1
    ranked = ranged.withColumn("part", part.cast("long")).join(F.broadcast(offsets), "part").withColumn("rank", F.when(rank <= drawn, rank))
    none = told.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    cols = ["n_features", "weight", "score", "rank", "n_words"]
    return ranked.select("_id", *cols).union(none.select("_id", *cols)).withColumnRenamed("_id", id_col)

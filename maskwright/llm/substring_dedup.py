"""Removal of passages that occur more than once: Rabin-Karp hashes of every window, counted in Spark.

Plan, with one shuffle of the texts and one of 8 bytes (before compression) a distinct window:

1. Documents are dealt to blocks by a hash of the row, a few megabytes of text each, so that neither
   a hot source nor a group of copies decides the load of a task.
2. Every block hashes all windows of its documents and sends each *distinct* hash once, as sorted
   slices of byte-transposed deltas, one slice a bucket of the hash range.  A passage that a third of
   all rows share is thus one number a block.
3. Every bucket counts in how many blocks each hash occurs and answers each slice with one bit a hash.
   Buckets are of bounded size and at most MOST_BUCKETS; where that many do not hold all hashes,
   hashes travel as rows instead, and Spark counts them.
4. The answers meet their block again; windows with a hash seen elsewhere, or twice in the block, are
   repeated, and their union gives the maximal removal intervals.

Two windows count as equal when their 64-bit hashes are equal.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Words, as_array, claim, lean, string_array

#: Bytes of text in a block, about; a Python worker holds some twenty times as much while it works on one.
BLOCK_BYTES = 5 << 20
#: Bytes of hashes in a bucket, about, and buckets into which a block cuts its hashes at most.
BUCKET_BYTES, MOST_BUCKETS = 16 << 20, 4096
WINDOW = 35


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending uint64 as deltas with the bytes of equal weight together; Spark's codec then drops the high, empty ones."""
    d = values.copy()
    d[1:] -= values[:-1]
    return d.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_sorted(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").reshape(-1), dtype=np.uint64)


def _windows(text: pa.Array, window: int) -> tuple[Words, np.ndarray, np.ndarray]:
    claim("windows")
    w = Words(text)
    starts, h = w.windows(w.hashes(), window)
    return w, starts, h


def bucket_bounds(n: int) -> np.ndarray:
    """Inner limits of n equal ranges of uint64."""
    return np.array([(i << 64) // n for i in range(1, n)], dtype=np.uint64)


def _send(values_of, block: str, n_buckets: int):
    """Slices of the distinct values of a block, one a bucket."""
    bounds = bucket_bounds(n_buckets)

    def f(table: pa.Table) -> pa.Table:
        v = values_of(table)
        cuts = np.searchsorted(v, bounds)
        ends = np.concatenate([[0], cuts, [len(v)]])
        some = np.flatnonzero(ends[1:] > ends[:-1])
        packed = [pack_sorted(v[ends[i] : ends[i + 1]]) for i in some]
        return pa.table([pa.array([table[block][0].as_py()] * len(some), pa.int32()), pa.array(some, pa.int32()), pa.array(packed, pa.binary())], names=["block", "bucket", "hashes"])

    return lean(f)


def _send_rows(values_of, block: str):
    """The distinct values of a block, a row each."""

    def f(table: pa.Table) -> pa.Table:
        v = values_of(table)
        return pa.table([pa.array(np.full(len(v), table[block][0].as_py(), np.int32)), pa.array(v.view(np.int64))], names=["block", "hash"])

    return lean(f)


def elsewhere(dealt: DataFrame, block: str, values_of, hash_bytes: int, bucket_bytes: int = BUCKET_BYTES, most_buckets: int = MOST_BUCKETS) -> DataFrame:
    """Answers (block, …) to what `known_elsewhere` asks: which of a block's distinct values other blocks hold.

    values_of: the sorted distinct uint64 of a block's table; hash_bytes: of all blocks' values, about.
    """
    n = max(int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-hash_bytes // bucket_bytes))
    if n <= most_buckets:
        sent = dealt.groupBy(block).applyInArrow(_send(values_of, block, n), "block int, bucket int, hashes binary")
        return sent.groupBy("bucket").applyInArrow(count_elsewhere, "block int, bucket int, bits binary, n int")
    sent = dealt.groupBy(block).applyInArrow(_send_rows(values_of, block), "block int, hash long")
    twice = sent.groupBy("hash").agg(F.count("*").alias("blocks")).where("blocks > 1").select("hash")
    return sent.join(twice, "hash").select("block", "hash")


def known_elsewhere(values: np.ndarray, answers: pa.Table) -> np.ndarray:
    """One truth value for each of a block's sorted distinct values."""
    if "hash" in answers.column_names:
        return np.isin(values, answers["hash"].to_numpy().view(np.uint64))
    answers = answers.sort_by("bucket")
    bits = [np.unpackbits(np.frombuffer(b.as_py(), np.uint8), count=n.as_py()).astype(bool) for b, n in zip(answers["bits"], answers["n"], strict=True)]
    out = np.concatenate(bits) if bits else np.zeros(0, bool)
    if len(out) != len(values):
        raise ValueError("the block's values differ between two readings of it")
    return out


@lean
def count_elsewhere(table: pa.Table) -> pa.Table:
    """For each slice of a bucket, one bit a hash: whether another slice holds it too."""
    blobs = [unpack_sorted(b.as_py()) for b in table["hashes"]]
    if len(blobs) == 1:
        more = [np.zeros(len(blobs[0]), bool)]
    else:
        every = np.concatenate(blobs)
        order = np.argsort(every, kind="stable")  # runs of ascending values: close to a merge
        s = every[order]
        same = s[1:] == s[:-1]
        twice = np.zeros(len(s), bool)
        twice[1:] |= same
        twice[:-1] |= same
        back = np.empty(len(s), bool)
        back[order] = twice
        more = np.split(back, np.cumsum([len(b) for b in blobs])[:-1])
    return pa.table([table["block"], table["bucket"], pa.array([np.packbits(m).tobytes() for m in more], pa.binary()), pa.array([len(m) for m in more], pa.int32())], names=["block", "bucket", "bits", "n"])


def _apply(window: int, untouched: bool):
    def f(left: pa.Table, right: pa.Table) -> pa.Table:
        w, starts, h = _windows(as_array(left["_text"]), window)
        values, at, count = np.unique(h, return_inverse=True, return_counts=True)
        repeated = (known_elsewhere(values, right) | (count > 1))[at]
        n = len(w.starts)
        seen = np.zeros(n + 1, np.int64)
        flag = np.zeros(n, np.int64)
        flag[starts[repeated]] = 1
        np.cumsum(flag, out=seen[1:])
        i = np.arange(n)
        covered = seen[i + 1] - seen[np.maximum(i + 1 - window, 0)] > 0
        data, off = w.joined(~covered)
        removed = np.concatenate([[0], np.cumsum(covered)])
        # intervals: runs of covered words within a row
        row = w.rows()
        new = covered.copy()
        new[1:] &= ~(covered[:-1] & (row[1:] == row[:-1]))
        end = covered.copy()
        end[:-1] &= ~(covered[1:] & (row[1:] == row[:-1]))
        s, e = np.flatnonzero(new), np.flatnonzero(end) + 1
        base = w.first[row[s]] if len(s) else s
        spans = pa.StructArray.from_arrays([pa.array(s - base, pa.int32()), pa.array(e - base, pa.int32())], ["start", "end"])
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(s, w.first), pa.int32()), spans)
        lost = pa.array(removed[w.first[1:]] - removed[w.first[:-1]], pa.int64())
        text = string_array(data, off)
        if untouched:
            text = pc.if_else(pc.equal(lost, 0), as_array(left["_text"]), text)
        return pa.table([left["_id"], left["_keep"], pa.array(w.counts, pa.int64()), lost, text, lists], names=["_id", "_keep", "n_words", "n_removed", "kept_text", "removed"])

    return lean(f)


def remove_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, keep: Sequence[str] = (), untouched: bool = False, most_buckets: int = MOST_BUCKETS) -> DataFrame:
    """Per row of docs: id, n_words, n_removed (long), kept_text (kept words joined by one space) and
    removed (maximal intervals [start, end) of word numbers).

    A window is `window` consecutive words of one row; it is repeated if the same words also start
    anywhere else, in the same row (overlaps included) or another.  Windows are judged on the input.
    Null and empty texts have no words and give an empty kept_text; equal rows, null ids included,
    each stay a row and are spread over the blocks by their places in docs, which must come in the same order
    whenever it is read (as files do); an empty table gives an empty result.  The columns of keep are carried along,
    others of docs are not looked at.  untouched: rows that lose nothing keep their text as it is (null
    too) instead of with its words joined.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // block_bytes))
    key = docs.schema[id_col].dataType.simpleString()
    kept = F.struct(*keep) if keep else F.lit(0)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), kept.alias("_keep"))
    rows = rows.select("_id", "_text", "_keep", F.pmod(F.xxhash64("_id", F.monotonically_increasing_id()), F.lit(n)).cast("int").alias("_block"))
    answers = elsewhere(rows, "_block", lambda table: np.unique(_windows(as_array(table["_text"]), window)[2]), total * 4 // 3, most_buckets=most_buckets)
    out = rows.groupBy("_block").cogroup(answers.groupBy("block")).applyInArrow(_apply(window, untouched), f"_id {key}, _keep {rows.schema['_keep'].dataType.simpleString()}, n_words long, n_removed long, kept_text string, removed array<struct<start:int,end:int>>")
    return out.select(F.col("_id").alias(id_col), *(F.col("_keep")[c].alias(c) for c in keep), "n_words", "n_removed", "kept_text", "removed")

"""Cost-balanced packing of tokenised documents into sequences of a fixed length.

Documents are dealt to shards by a hash of the row, each shard a few megabytes of text, tokenised and
packed in one task.  The cost of a piece of n tokens is estimated as LINEAR * n + QUADRATIC * n * n.
A shard's sequences are fixed beforehand: as many full ones as its tokens fill, and powers of two for
what is left, so that nothing is padded.  Whole sequences are cut off documents that are longer; what
remains is assigned in descending order of cost to the lowest-cost sequence with enough remaining
capacity; where none has enough, the roomiest is filled and the rest of the piece waits its turn.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import ChunkEncoder
from .words import as_array, lean, row_slices

#: Per token: the feed-forward and projection work; per pair of tokens: the attention, for a width of 1024.
LINEAR, QUADRATIC = 1.0, 1.0 / 6144
SHARD_BYTES = 8 << 20
#: Bytes of a shard tokenised at once.
SLICE_BYTES = 8 << 20


def capacities(total: int, length: int) -> list[int]:
    """Sequence lengths that hold exactly so many tokens: full ones, then powers of two."""
    rest = total % length
    return [length] * (total // length) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(sizes: list[int], length: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(document, start, tokens, sequence, offset) of each piece; documents by their number in sizes."""
    room = np.array(capacities(sum(sizes), length), np.int64)
    used, cost = np.zeros(len(room), np.int64), np.zeros(len(room))
    out, waiting, at = [], [], 0
    for i, n in enumerate(sizes):
        start = 0
        while n - start >= length:
            out.append((i, start, length, at, 0))
            room[at], used[at], cost[at] = 0, length, linear * length + quadratic * length * length
            at, start = at + 1, start + length
        if n > start:
            waiting.append((start - n, i, start))
    heapq.heapify(waiting)  # cost rises with size, so the largest piece is the dearest
    while waiting:
        n, i, start = heapq.heappop(waiting)
        n = -n
        fits = np.flatnonzero(room >= n)
        if len(fits):
            b, part = int(fits[np.argmin(cost[fits])]), n
        else:
            b = int(np.argmax(room))
            part = int(room[b])
            heapq.heappush(waiting, (part - n, i, start + part))
        out.append((i, start, part, b, int(used[b])))
        room[b] -= part
        used[b] += part
        cost[b] += linear * part + quadratic * part * part
    return out


def _pack_shard(vocabulary: str, end_id: int, length: int, names: list[str], slice_bytes: int, remembered: int):
    def f(table: pa.Table) -> pa.Table:
        encoder = ChunkEncoder.of(vocabulary, remembered)
        text = as_array(table["_text"]).cast(pa.large_binary())
        ids: list[bytes] = []
        end = np.array([end_id], "<u4").tobytes()
        for lo, hi in row_slices(text, slice_bytes):
            ids += [x + end for x in encoder.encode([t or b"" for t in text[lo:hi].to_pylist()])]
        keys = table["_id"].to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (keys[i] is not None, keys[i] if keys[i] is not None else 0, ids[i]))
        pieces = pack([len(ids[i]) // 4 for i in order], length)
        shard = table["_shard"][0].as_py() << 32
        rows = [order[p[0]] for p in pieces]
        return pa.table(
            [
                table["_id"].take(pa.array(rows, pa.int64())),
                pa.array([p[1] for p in pieces], pa.int64()),
                pa.array([p[2] for p in pieces], pa.int64()),
                pa.array([ids[r][4 * p[1] : 4 * (p[1] + p[2])] for r, p in zip(rows, pieces, strict=True)], pa.binary()),
                pa.array([len(ids[r]) // 4 for r in rows], pa.int64()),
                pa.array([shard + p[3] for p in pieces], pa.int64()),
                pa.array([p[4] for p in pieces], pa.int64()),
            ],
            names=names,
        )

    return lean(f)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "word_bpe_49k.json", length: int = 2048, end_id: int = 1, shard_bytes: int = SHARD_BYTES, slice_bytes: int = SLICE_BYTES, remembered: int = ChunkEncoder.MOST) -> DataFrame:
    """Pieces of tokenised documents: id, start, length, ids (binary, little-endian uint32), doc_tokens, sequence_id, offset.

    A document's ids are the vocabulary's for its text, without special tokens, then end_id; a null or
    empty text gives end_id alone.  Each id lies in exactly one piece; a sequence's pieces follow one
    another without gaps from offset 0 and hold `length` tokens or a smaller power of two.  Equal rows
    and rows with a null id are documents of their own, spread over the shards by their places in docs; an empty
    table gives an empty result; other columns are not looked at.  Length must be a power of two.
    """
    if length < 1 or length & (length - 1):
        raise ValueError("length must be a power of two")
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // shard_bytes))
    key = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    rows = rows.select("_id", "_text", F.pmod(F.xxhash64("_id", F.monotonically_increasing_id()), F.lit(n)).cast("int").alias("_shard"))
    names = ["_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    out = rows.groupBy("_shard").applyInArrow(_pack_shard(vocabulary, end_id, length, names, slice_bytes, remembered), f"_id {key}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("_id", id_col)

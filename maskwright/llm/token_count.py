"""Token counts of whole texts; huge documents by overlap resynchronisation.

Documents up to `huge` characters are encoded as they are.  Longer ones are encoded in overlapping
chunks with offsets and spliced at proven stable common boundaries (bpe.Resynchroniser), so that a
worker never holds more than a few chunks of encodings, whatever the length of the text.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import ChunkEncoder, Resynchroniser
from .words import as_array, row_slices

HUGE, CHUNK, OVERLAP = 1 << 15, 1 << 15, 256


def _count(name: str, huge: int, chunk: int, overlap: int):
    def f(batches):
        encoder = ChunkEncoder.of(name)
        splicer = Resynchroniser(encoder.tokenizer, chunk, overlap)
        for batch in batches:
            text = as_array(batch["_text"]).cast(pa.large_binary())
            for lo, hi in row_slices(text, 8 << 20):
                raw = [x or b"" for x in text[lo:hi].to_pylist()]
                small = encoder.count([b"" if len(x) > huge else x for x in raw])
                n = [k if len(x) <= huge else sum(map(len, splicer.encode(x.decode()))) for k, x in zip(small, raw, strict=True)]
                yield pa.RecordBatch.from_arrays([batch["_id"][lo:hi], pa.array(map(len, raw), pa.int64()), pa.array(n, pa.int64())], ["_id", "n_bytes", "n_tokens"])

    return f


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "word_bpe_49k.json", limit: int = 2048, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per row of docs: id, n_bytes (UTF-8), n_tokens (no special tokens added) and over_limit (n_tokens > limit).

    Null texts count as empty: 0 bytes, 0 tokens.  Equal rows and rows with a null id each stay a row;
    an empty table gives an empty result; other columns are not looked at.  There is no shuffle.
    """
    key = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    out = rows.mapInArrow(_count(vocabulary, huge, chunk, overlap), f"_id {key}, n_bytes long, n_tokens long")
    return out.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

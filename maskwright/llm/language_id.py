"""Language identification by compression.

Each language has a few zstandard dictionaries of raw content: folded texts of rows that carry its name.
A text is folded alike (lower case, runs of other characters than letters one space), cut into blocks and
each block encoded with every dictionary; the language whose dictionaries give the smallest sum over all
blocks is told, and is rejected where the second is hardly larger.  Blocks are encoded one by one, so a
long text is measured against the dictionaries throughout, not against what it has said before; several
dictionaries a language give sums that are finer than whole bytes.

Bounds, documented parameters of `learn`: a language's dictionaries hold `dictionaries` times `size` bytes,
of different texts with the smallest hashes, of each its first `share` characters.  Everything else covers
all rows and whole texts.  Held-out rows (crc32 of the id as text, modulo 5, is 0) are never learned from.
Ids, sources and the language column are no inputs of a prediction.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .toxicity import is_held_out
from .words import as_array, claim, lean_stream, row_slices

DICTIONARIES, SIZE, SHARE = 2, 1 << 17, 4000
LEVEL, BLOCK = 8, 4096
#: A prediction is rejected where the second language's bytes exceed the first's by less than this share.
NARROW = 0.01
#: Bytes of difference, of one dictionary, that make a language e times likelier.
TEMPERATURE = 2.0
#: Texts with no letter have no language.
NONE = "und"
#: Bytes of text folded at once.
SLICE = 4 << 20
_LETTER, _OTHER = r"\p{L}", r"[^\p{L}\p{M}]+"


def fold(text: pa.Array) -> pa.Array:
    """Texts in lower case, with one space for each run of characters that are no letters or marks."""
    return pc.replace_substring_regex(pc.utf8_lower(text.cast(pa.large_string())), _OTHER, " ")


@dataclass
class Model:
    """Raw contents of each language's dictionaries, the languages in order of their learned texts, most first."""

    languages: list[str] = field(default_factory=list)
    contents: list[list[bytes]] = field(default_factory=list)
    level: int = LEVEL
    block: int = BLOCK

    def key(self) -> str:
        h = hashlib.sha256(repr((self.languages, self.level, self.block)).encode())
        for c in self.contents:
            for x in c:
                h.update(b"%d:" % len(x) + x)
        return h.hexdigest()


class Encoders:
    """The compressors of a model; one set for each worker process."""

    _made: dict[str, Encoders] = {}

    @classmethod
    def of(cls, model: Model, key: str) -> Encoders:
        claim("language", cls._made.clear)
        if key not in cls._made:
            cls._made.clear()
            cls._made[key] = cls(model)
        return cls._made[key]

    def __init__(self, model: Model):
        import zstandard as z

        self.block, self.each = model.block, []
        for contents in model.contents:
            mine = []
            for raw in contents:
                d = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=model.level)
                mine.append(z.ZstdCompressor(level=model.level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress)
            self.each.append(mine)

    def sizes(self, text: bytes) -> list[int]:
        """Bytes of the text's blocks by language, summed over its dictionaries."""
        out = [0] * len(self.each)
        for at in range(0, len(text), self.block):
            part = text[at : at + self.block]
            for i, mine in enumerate(self.each):
                out[i] += sum([len(compress(part)) for compress in mine])
        return out


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", dictionaries: int = DICTIONARIES, size: int = SIZE, share: int = SHARE, level: int = LEVEL, block: int = BLOCK) -> Model:
    """Dictionaries for the languages of docs from rows that are not held out and have a language and a letter.

    Texts that repeat within a language teach once.  No such rows: a model without languages.
    """
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"), is_held_out(F.col(id_col)).alias("held"))
    rows = rows.where(F.col("lang").isNotNull() & ~F.col("held") & F.col("text").rlike(_LETTER))
    told = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("texts"), F.avg(F.least(F.octet_length("text"), F.lit(share))).alias("mean"))
    # only texts with small hashes go on: about eight times as many as fill the dictionaries, of each language
    chance = F.lit(8.0 * dictionaries * size) / (F.col("texts") * F.greatest("mean", F.lit(1.0)))
    drawn = F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53)) < F.greatest(chance, 200 / F.col("texts"))
    some = rows.join(F.broadcast(told), "lang").where(drawn).groupBy("lang", "h", "texts").agg(F.min(F.substring("text", 1, share)).alias("text"))
    upto = F.sum(F.octet_length("text") + 1).over(Window.partitionBy("lang").orderBy(F.shiftrightunsigned("h", 11), "h").rowsBetween(Window.unboundedPreceding, -1))
    got = some.withColumn("upto", F.coalesce(upto, F.lit(0))).where(F.col("upto") < 2 * dictionaries * size).select("lang", "texts", "upto", "text").toArrow()
    got = got.append_column("folded", [pc.utf8_trim(fold(as_array(got["text"])), " ")]).sort_by([("lang", "ascending"), ("upto", "ascending")])
    held: dict[str, list[list[bytes]]] = {}
    rank = {}
    for lang, texts, folded in zip(got["lang"].to_pylist(), got["texts"].to_pylist(), got["folded"].to_pylist(), strict=True):
        mine = held.setdefault(lang, [[] for _ in range(dictionaries)])
        rank[lang] = (-texts, lang)
        least = min(mine, key=lambda c: sum(map(len, c)))
        if sum(map(len, least)) < size:
            least.append(folded.encode() + b" ")
    languages = sorted(held, key=rank.__getitem__)
    contents = [[b"".join(c)[:size] for c in held[lang]] for lang in languages]
    # (zstandard takes no raw content of fewer than 8 bytes)
    return Model(languages, [[c if len(c) >= 8 else (c or contents[i][0]).ljust(8) for c in mine] for i, mine in enumerate(contents)], level, block)


def identify(docs: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id", narrow: float = NARROW, temperature: float = TEMPERATURE) -> DataFrame:
    """Per row of docs: id, held_out, lang_pred, score (0 to 1), margin (bytes by which the second language is larger,
    per dictionary; null with one language) and rejected (margin under `narrow` of the first's bytes).

    The score is the first language's share where a difference of `temperature` bytes makes it e times likelier.
    Null texts and texts without a letter are `und` with score 0 and rejected, as all texts are where nothing
    was learned.  Equal sizes go to the language with more texts, then by name.  Equal rows and rows with a null id
    each stay a row; an empty table gives an empty result; other columns are not looked at.  There is no shuffle.
    """
    key, of = docs.schema[id_col].dataType.simpleString(), model.key()
    n_dictionaries = max(map(len, model.contents), default=1)

    @lean_stream
    def apply(batches):
        encoders = Encoders.of(model, of)
        for batch in batches:
            text = as_array(batch["_text"])
            for lo, hi in row_slices(text, SLICE):
                some = text[lo:hi].cast(pa.large_string())
                has = pc.fill_null(pc.match_substring_regex(some, _LETTER), False).to_pylist()
                n = hi - lo
                best, score, margin, narrow_ = [NONE] * n, np.zeros(n), [None] * n, np.ones(n, bool)
                for i, x in enumerate(fold(some).cast(pa.large_binary())):
                    if not has[i] or not model.languages:
                        continue
                    sizes = np.array(encoders.sizes(x.as_py())) / n_dictionaries
                    first = int(sizes.argmin())
                    best[i] = model.languages[first]
                    score[i] = 1 / np.exp(np.minimum(sizes[first] - sizes, 0.0) / temperature).sum()
                    if len(sizes) > 1:
                        margin[i] = float(np.partition(sizes, 1)[1] - sizes[first])
                    narrow_[i] = len(sizes) > 1 and margin[i] < narrow * sizes[first]
                yield pa.RecordBatch.from_arrays([batch["_id"][lo:hi], pa.array(best, pa.string()), pa.array(score), pa.array(margin, pa.float64()), pa.array(narrow_)], ["_id", "lang_pred", "score", "margin", "rejected"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    out = rows.mapInArrow(apply, f"_id {key}, lang_pred string, score double, margin double, rejected boolean")
    return out.select(F.col("_id").alias(id_col), is_held_out(F.col("_id")).alias("held_out"), "lang_pred", "score", "margin", "rejected")

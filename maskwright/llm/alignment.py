"""Alignment of two tokenizers over a corpus: which tokens of one cover which tokens of the other.

Each text is encoded by both; a two-pointer merge of the tokens' cumulative ends (in bytes) gives groups, cut
where tokens of both end, and links, the pairs of tokens whose byte ranges overlap.  Links are counted by pair
of ids over all documents, and each document learns how often its links occur and which of them are the most
frequent of their side.

In Spark:

1. mapInPandas encodes and merges.  Documents lie in blocks of bounded bytes and rows.  Tokens never cross a single
   space between two characters that are no white space (proven for the vocabularies when they are loaded;
   otherwise a text is one chunk), so chunks between such spaces are encoded once and remembered, and a document
   is the list of its chunks.  A block keeps each distinct chunk's links once, and sends each distinct pair
   of ids once with its count: a pair that all documents hold is one number a block.  The rows are written once.
2. groupBy counts the pairs; the maxima of each side (at most as many rows as a vocabulary has) are joined to them.
3. The counts go back to the blocks by their pairs, and each block adds them up for its chunks and documents.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import vocabulary
from .scratch import Scratch
from .words import claim, lean, lean_stream

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text and rows of a block, about.
BLOCK_BYTES, BLOCK_ROWS = 8 << 20, 20_000
#: Chunks a worker remembers between blocks, about 300 bytes each.
REMEMBERED = 300_000
#: Characters cut into chunks at once, and characters of new chunks encoded at once.
SEGMENT, AT_ONCE = 1 << 20, 1 << 15
#: Ids of the second tokenizer are below this; a pair of ids is one number.
WIDTH = 1 << 31
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_SPACE = "▁"


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes as: printable Latin-1 stands for itself, the rest follow from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def merge(a_ends: list[int], b_ends: list[int]) -> tuple[list[int], list[int], list[tuple[int, int, int]]]:
    """Links of two covers of one range (places in a and in b), and (tokens of a, tokens of b, links) after which a group ends."""
    of_a, of_b, cuts, i, j = [], [], [], 0, 0
    n = len(a_ends)
    while i < n:
        of_a.append(i)
        of_b.append(j)
        x, y = a_ends[i], b_ends[j]
        if x < y:
            i += 1
        elif y < x:
            j += 1
        else:
            i += 1
            j += 1
            cuts.append((i, j, len(of_a)))
    return of_a, of_b, cuts


class Chunks:
    """Chunks met in this process, with what both tokenizers make of them; numbers count from 0 since the last forget()."""

    _made: dict[tuple[str, str], Chunks] = {}

    @classmethod
    def of(cls, a: str, b: str) -> Chunks:
        claim(f"alignment of {a} and {b}", cls._made.clear)
        if (a, b) not in cls._made:
            cls._made[a, b] = cls(a, b)
        return cls._made[a, b]

    def __init__(self, a: str, b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(vocabulary(a))
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=vocabulary(b))
        letters, vocab = byte_letters(), self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        n = self.b.get_piece_size()
        pieces = self.b.id_to_piece(list(range(n)))
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.apart = self._separable(pieces)
        self.names = [*map(str, range(max(n, len(self.a_bytes))))]
        self.forget()

    def _separable(self, pieces: list[str]) -> bool:
        """Whether tokens of neither cross a single space between characters that are no white space.

        Of the first: nothing is normalised and the byte-level rule cuts there.  Of the second: nothing is
        normalised, a space in front is added to each text, and no piece has its sign for a space after another character.
        """
        import json

        a = json.loads(self.a.to_str())
        rule = a["pre_tokenizer"] or {}
        plain = a["normalizer"] is None and rule.get("type") == "ByteLevel" and rule.get("use_regex") and not rule.get("add_prefix_space")
        tries = ["a  b", " a ", "ﬁé é", "　x y"]
        kept = all(self.b.decode(self.b.encode(t)) == t and b"".join(self.b_bytes[i] for i in self.b.encode(t)) == f" {t}".encode() for t in tries)
        return bool(plain and kept and not any(re.search(f"[^{_SPACE}]{_SPACE}", p) for p in pieces))

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[str] = []
        self.fits, self.n_a, self.n_b, self.n_groups = bytearray(), array("q"), array("q"), array("q")
        self.pairs, self.ends = array("q"), array("q", [0])

    def learn(self, bodies: set[str]) -> None:
        """Chunks that are not known yet, many encoded as one text: no token crosses the spaces between them."""
        new = [b for b in bodies if b not in self.known]
        alone = [b for b in new if b[0].isspace() or b[-1].isspace()] if self.apart else new
        together = [b for b in new if not (b[0].isspace() or b[-1].isspace())] if self.apart else []
        at = 0
        while at < len(together):
            to, size = at, 0
            while to < len(together) and size < AT_ONCE:
                size += len(together[to])
                to += 1
            if not self._align(together[at:to]):
                alone += together[at:to]
            at = to
        for b in alone:
            if not self._align([b]):
                self.known[b] = len(self.fits)
                self._add([False], [""], [0], [0], [0], np.empty(0, np.int64), [0])

    def _align(self, bodies: list[str]) -> bool:
        """Remembers these chunks, encoded as one text; False where the tokens do not give it back."""
        text = " ".join(bodies)
        a = self.a.encode_batch_fast([f" {text}"], add_special_tokens=False)[0].ids
        b = self.b.encode(text)
        a_parts, b_parts = [self.a_bytes[i] for i in a], [self.b_bytes[i] for i in b]
        raw = f" {text}".encode()
        if b"".join(a_parts) != raw or b"".join(b_parts) != raw:
            return False
        a_ends, b_ends = (np.cumsum([*map(len, parts)]) for parts in (a_parts, b_parts))
        of_a, of_b, cuts = merge(a_ends.tolist(), b_ends.tolist())
        a_names, b_names, told, i, j = [self.names[x] for x in a], [self.names[x] for x in b], [], 0, 0
        for x, y, _ in cuts:
            told.append(f"{a_names[i] if x == i + 1 else ','.join(a_names[i:x])}|{b_names[j] if y == j + 1 else ','.join(b_names[j:y])}")
            i, j = x, y
        # the groups after which a chunk ends
        cut = np.array(cuts, np.int64).reshape(-1, 3)
        ends = np.searchsorted(a_ends[cut[:, 0] - 1], np.cumsum([len(x.encode()) + 1 for x in bodies])) + 1
        groups = [";".join(told[x:y]) for x, y in zip([0, *ends.tolist()], ends.tolist())]
        pairs = np.array(a, np.int64)[of_a] * WIDTH + np.array(b, np.int64)[of_b]
        at = np.concatenate([np.zeros((1, 3), np.int64), cut[ends - 1]])
        self.known.update(zip(bodies, range(len(self.fits), len(self.fits) + len(bodies))))
        self._add([True] * len(bodies), groups, *np.diff(at[:, :2], axis=0).T, np.diff(ends, prepend=0), pairs, at[1:, 2])
        return True

    def _add(self, fits, groups, n_a, n_b, n_groups, pairs: np.ndarray, ends) -> None:
        before = len(self.pairs)
        self.fits.extend(fits)
        self.groups += groups
        for held, more in ((self.n_a, n_a), (self.n_b, n_b), (self.n_groups, n_groups), (self.pairs, pairs), (self.ends, np.asarray(ends, np.int64) + before)):
            held.frombytes(np.ascontiguousarray(more, np.int64).tobytes())

    def bodies(self, text: str) -> Iterator[list[str]]:
        """The text's chunks, each without the space in front of it, a segment at once."""
        at = 0
        while self.apart and (cut := _SAFE.search(text, at + SEGMENT)):
            yield _SAFE.split(text[at : cut.start()])
            at = cut.end()
        yield _SAFE.split(text[at:]) if self.apart else [text]

    def numbers(self, bodies: list[str]) -> np.ndarray:
        """The numbers of these chunks, all of them learned."""
        return np.fromiter(map(self.known.__getitem__, bodies), np.int64, len(bodies))


_DOC = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, chunks binary"
_DICTIONARY = "pairs array<long>, times array<long>, links binary, ends binary"


def _encode(a: str, b: str, block_bytes: int, block_rows: int, with_groups: bool):
    def row(block: int, id_, **more):
        return {"block": block, "_id": id_, "is_doc": True, "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups_sha256": "", "chunks": b"", "groups": "" if with_groups else None, "pairs": None, "times": None, "links": None, "ends": None} | more

    def document(chunks: Chunks, block: int, id_, text: str | None, parts) -> tuple[dict, np.ndarray | None]:
        if not parts:
            return row(block, id_), None
        told, digest, first, kept = [], hashlib.sha256(), True, []
        fits = chunks.fits
        for bodies in parts:
            if len(text) > SEGMENT:
                chunks.learn(set(bodies))
            n = chunks.numbers(bodies)
            if not np.frombuffer(fits, np.uint8)[n].all():
                return row(block, id_), None
            groups = ";".join([chunks.groups[i] for i in n.tolist()])
            digest.update((groups if first else f";{groups}").encode())
            if with_groups:
                kept.append(groups)
            told.append(n)
            first = False
        n = np.concatenate(told)
        n_a, n_b, n_groups = (int(np.frombuffer(v, np.int64)[n].sum()) for v in (chunks.n_a, chunks.n_b, chunks.n_groups))
        ends = np.frombuffer(chunks.ends, np.int64)
        return row(block, id_, n_a=n_a, n_b=n_b, n_groups=n_groups, n_links=int((ends[n + 1] - ends[n]).sum()), groups_sha256=digest.hexdigest(), groups=";".join(kept) if with_groups else None), n

    def dictionary(chunks: Chunks, block: int, docs: list[tuple[dict, np.ndarray | None]]) -> dict:
        """The block's row of distinct chunks and pairs; the documents' chunks are numbered by it."""
        some = [n for _, n in docs if n is not None]
        every, local = np.unique(np.concatenate(some), return_inverse=True) if some else (np.empty(0, np.int64), np.empty(0, np.int64))
        at = 0
        for d, n in docs:
            if n is not None:
                d["chunks"] = local[at : at + len(n)].astype("<u4").tobytes()
                at += len(n)
        ends = np.frombuffer(chunks.ends, np.int64)
        sizes = ends[every + 1] - ends[every]
        cut = np.cumsum(sizes)
        flat = np.frombuffer(chunks.pairs, np.int64)[np.repeat(ends[every] - cut + sizes, sizes) + np.arange(cut[-1] if len(cut) else 0)]
        pairs, links = np.unique(flat, return_inverse=True)
        times = np.bincount(links, weights=np.repeat(np.bincount(local, minlength=len(every)), sizes), minlength=len(pairs)).astype(np.int64)
        none = dict.fromkeys(("_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "chunks", "groups"))
        return row(block, None) | none | {"is_doc": False, "pairs": pairs, "times": times, "links": links.astype("<u4").tobytes(), "ends": cut.astype("<u4").tobytes()}

    @lean_stream
    def f(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        chunks = Chunks.of(a, b)
        part = TaskContext.get().partitionId() << 32
        docs: list[tuple[dict, np.ndarray | None]] = []
        block, size = part, 0

        def dictionary_and(docs, block) -> pd.DataFrame:
            return pd.DataFrame([dictionary(chunks, block, docs), *(d for d, _ in docs)])

        for frame in frames:
            texts = [t if t and _SPACE not in t else "" for t in frame["_text"]]
            sizes = np.cumsum([*map(len, texts)])
            at = 0
            while at < len(texts):  # some short texts at once, so that many new chunks meet the libraries together
                to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + SEGMENT)))
                parts = [None if not t else [*chunks.bodies(t)] if len(t) <= SEGMENT else chunks.bodies(t) for t in texts[at:to]]
                chunks.learn({b for p in parts if isinstance(p, list) for bodies in p for b in bodies})
                for id_, text, p in zip(frame["_id"][at:to], texts[at:to], parts, strict=True):
                    docs.append(document(chunks, block, id_, text, p))
                    size += len(text) + 100
                    if size >= block_bytes or len(docs) >= block_rows:
                        yield dictionary_and(docs, block)
                        block, size, docs = block + 1, 0, []
                at = to
                if len(chunks.known) > REMEMBERED or len(chunks.pairs) > 20 * REMEMBERED:
                    if docs:
                        yield dictionary_and(docs, block)
                        block, size, docs = block + 1, 0, []
                    chunks.forget()
        if docs:
            yield dictionary_and(docs, block)

    return f


@lean
def _add_up(left: pa.Table, right: pa.Table) -> pa.Table:
    """The documents of a block with the counts of their links."""
    right = right.sort_by("pos")
    told = [right[c].to_numpy().astype(np.int64) for c in ("n", "best_a", "best_b")]
    docs = left.filter(left["is_doc"])
    held = left.filter(pc.invert(left["is_doc"]))
    links, ends = (np.frombuffer(held[c][0].as_py(), "<u4").astype(np.int64) for c in ("links", "ends"))
    chunks = [np.frombuffer(c.as_py(), "<u4") for c in docs["chunks"]]
    flat = np.concatenate(chunks) if chunks else np.empty(0, np.uint32)
    cut = np.concatenate([[0], np.cumsum([*map(len, chunks)])]).astype(np.int64)
    sums = []
    for values in (told[0], told[1], told[2], told[1] * told[2]):
        upto = np.concatenate([[0], np.cumsum(values[links])])
        of = np.diff(upto[np.concatenate([[0], ends])])
        upto = np.concatenate([[0], np.cumsum(of[flat])])
        sums.append(pa.array(upto[cut[1:]] - upto[cut[:-1]], pa.int64()))
    kept = ["_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups"]
    return pa.table([*(docs[c] for c in kept), sums[0], sums[2], sums[1], sums[3]], names=[*kept, "count_sum", "n_best", "n_best_a", "n_mutual"])


class Alignment:
    """Two tokenizers aligned over docs; what was encoded is written once to scratch.

    documents: per row of docs its id, n_a, n_b, n_groups, n_links, groups_sha256, groups (where asked for), count_sum (of
    its links' counts), n_best (links whose count is the highest of their id of the second tokenizer, ties included),
    n_best_a (of the first) and n_mutual (of both).
    pairs: a_id, b_id, count over all documents, best_a and best_b (the highest of that id of that side).

    The first tokenizer encodes a space and the text, the second adds the space itself; special tokens are not added,
    and their strings in texts are plain text.  Null and empty texts, and texts which the joined tokens do not give
    back, have no tokens: zeros and empty strings.  Equal rows and rows with a null id each stay a row; an empty table
    gives empty results; other columns are not looked at.  A run without a single space between other characters is encoded at once.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str = A, b: str = B, scratch: Scratch | None = None, groups: bool = False, block_bytes: int = BLOCK_BYTES, block_rows: int = BLOCK_ROWS):
        key, self.id_col, self.groups = docs.schema[id_col].dataType.simpleString(), id_col, groups
        scratch = scratch or Scratch(docs.sparkSession)
        rows = docs.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).alias("_text"))
        made = rows.mapInPandas(_encode(a, b, block_bytes, block_rows, groups), f"block long, _id string, is_doc boolean, {_DOC}, groups string, {_DICTIONARY}")
        self.made, self.key = scratch.save(made, "aligned"), key
        each = self.made.where(~F.col("is_doc")).select(F.col("block").alias("at"), F.posexplode(F.arrays_zip("pairs", "times")).alias("pos", "p")).select("at", "pos", F.col("p.pairs").alias("pair"), F.col("p.times").alias("n"))
        counted = scratch.save(each.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a_id", F.expr(f"cast(pair div {WIDTH} as int)")).withColumn("b_id", (F.col("pair") % WIDTH).cast("int")), "pairs")
        # at most one row for each id of a vocabulary
        tops = [F.broadcast(counted.groupBy(f"{s}_id").agg(F.max("n").alias(f"top_{s}"))) for s in "ab"]
        told = counted.join(tops[0], "a_id").join(tops[1], "b_id")
        self.told = told.select("pair", "a_id", "b_id", "n", *((F.col("n") == F.col(f"top_{s}")).alias(f"best_{s}") for s in "ab"))
        self.each = each.select("at", "pos", "pair")

    @property
    def pairs(self) -> DataFrame:
        return self.told.select("a_id", "b_id", F.col("n").alias("count"), "best_a", "best_b")

    @property
    def documents(self) -> DataFrame:
        back = self.each.join(self.told.select("pair", "n", "best_a", "best_b"), "pair").select("at", "pos", "n", "best_a", "best_b")
        left = self.made.select("block", "is_doc", "_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "chunks", "links", "ends")
        out = left.groupBy("block").cogroup(back.groupBy("at")).applyInArrow(_add_up, "_id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, count_sum long, n_best long, n_best_a long, n_mutual long")
        return out.withColumn(self.id_col, F.col("_id").cast(self.key)).select(self.id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_best_a", "n_mutual", *(["groups"] if self.groups else []))

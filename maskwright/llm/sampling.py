"""Sampled SentencePiece segmentations: forward filtering, backward sampling over the piece lattice.

A text gets one space in front and is cut into units, each a run of spaces and what follows it up to
the next space or line feed, or a line feed.  No piece of the vocabularies in view has a space after
another character or a line feed beside another, so the
lattice of a text is the chain of its units' lattices: the forward sums of a unit are computed once and
remembered, and all units of a batch are sampled backwards together, step by step, with numbers that
depend on the row's key, the unit's place and the step only.  The same key and text give the same
pieces, on whatever worker and in whatever batch.

A piece of rank r (its place among the pieces by score) weighs (r + 10)^-alpha: alpha 1 is about the
pieces' frequency, larger values come closer to the fewest and most frequent pieces.  Characters
without a piece become their UTF-8 bytes' pieces, and so does a literal U+2581, which stands for the
space in pieces: decoding gives the text back, character for character.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import vocabulary
from .words import as_array, claim, mix, row_slices, span_hashes, string_array

_UNIT = re.compile(rb" +[^ \n]*|[^ \n]+|\n")
_GOLDEN, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: The weight of the first byte of a character that has no piece.
UNKNOWN = 1e-6
#: Bytes of units learned at once.
PART = 1 << 16


class Lattice:
    """Lattices of units for one model and alpha, remembered within a bound.

    Nodes are places in a unit, by bytes; all remembered units share one set of arrays.  Each node has
    its edges in a row: the cumulative share among the node's forward sums, the
    node the edge comes from (-1: the unit's start) and its piece.
    """

    #: Units remembered; then all are forgotten. About 330 bytes each.
    MOST = 320_000
    _made: dict[tuple, Lattice] = {}

    @classmethod
    def of(cls, model: str, alpha: float) -> Lattice:
        claim(f"lattices of {model}", cls._made.clear)
        if (model, alpha) not in cls._made:
            cls._made[model, alpha] = cls(model, alpha)
        return cls._made[model, alpha]

    def __init__(self, model: str, alpha: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary(model))
        self.bytes = np.zeros(256, np.int32)
        self.out: list[bytes] = [b""] * sp.vocab_size()
        scored = []
        for i in range(sp.vocab_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.out[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                plain = piece.replace("▁", " ").encode()
                if b" " in plain.lstrip(b" ") or (b"\n" in plain and plain != b"\n"):
                    raise ValueError(f"a piece that spans units: {piece!r}")
                scored.append((-sp.get_score(i), i, plain))
                self.out[i] = plain
        self.out_data = np.frombuffer(b"".join(self.out), np.uint8)
        self.out_sizes = np.array([len(x) for x in self.out], np.int64)
        self.out_starts = np.cumsum(self.out_sizes) - self.out_sizes
        if sp.vocab_size() > 1 << 16:
            raise ValueError("more than 65536 pieces")
        ranked = [(i, plain) for _, i, plain in sorted(scored)]
        self.weight = {plain: (i, (rank + 10.0) ** -alpha) for rank, (i, plain) in enumerate(ranked)}
        # pieces by length: ascending hashes, ids and logarithms of weights; and a filter of the hashes' first bits
        self.tables = {}
        for n in sorted({len(plain) for _, plain in ranked}):
            mine = [(plain, *self.weight[plain]) for _, plain in ranked if len(plain) == n]
            data = np.frombuffer(b"".join(m[0] for m in mine), np.uint8)
            h = span_hashes(data, np.arange(len(mine)) * n, (np.arange(len(mine)) + 1) * n)
            order = np.argsort(h)
            there = np.zeros(1 << 18, bool)
            there[h >> np.uint64(46)] = True
            self.tables[n] = (h[order], np.array([m[1] for m in mine], np.int32)[order], np.log([m[2] for m in mine])[order], there)
        # kinds of edge: pieces by length, the longest, which are the likeliest, first; and single bytes
        self.sizes = np.array([*sorted(self.tables, reverse=True), 1], np.int64)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}  # unit: its last node
        self.first, self.share, self.before, self.piece = np.zeros(1, np.int32), np.empty(0, np.float32), np.empty(0, np.int32), np.empty(0, np.uint16)
        self.filled = [1, 0, 0, 0]
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.n_places = self.n_edges = 0

    def _weigh(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, kinds of edge): log weight and piece of the edge of each kind that ends with each byte, -inf for none; the kinds."""
        kinds = self.sizes[self.sizes <= (ends - starts).max()]
        limit = np.repeat(ends, ends - starts)
        low = (data & 0xC0) == 0x80
        size = np.where(data < 0x80, 1, np.where(data < 0xE0, 2, np.where(data < 0xF0, 3, 4)))
        # sums of up to 64 bytes' weights are exact enough in single precision
        log = np.full((len(data), len(kinds)), -np.inf, np.float32 if (ends - starts).max() <= 64 else np.float64)
        piece = np.zeros((len(data), len(kinds)), np.uint16)
        lead = np.flatnonzero(~low)
        alone = np.zeros(len(data), bool)  # characters with a piece of their own
        for k, n in enumerate(kinds[:-1].tolist()):
            hashes, ids, logs, there = self.tables[n]
            i = lead[lead + n <= limit[lead]]
            h = span_hashes(data, i, i + n)
            maybe = np.flatnonzero(there[h >> np.uint64(46)])
            i, h = i[maybe], h[maybe]
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            hit = hashes[at] == h
            i, at = i[hit], at[hit]
            log[i + n - 1, k], piece[i + n - 1, k] = logs[at], ids[at]
            alone[i[size[i] == n]] = True
        at = np.arange(len(data))
        raw = at[~alone[np.maximum.accumulate(np.where(low, 0, at))]]
        log[raw, -1], piece[raw, -1] = np.where(low[raw], 0.0, np.log(UNKNOWN)), self.bytes[data[raw]]
        return log, piece, kinds

    def _learn(self, units: list[bytes]) -> None:
        """Forward sums, place by place in all units at once, and each place's edges with their shares."""
        sizes = np.array([len(u) for u in units], np.int64)
        data = np.frombuffer(b"".join(units), np.uint8)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        log, piece, kinds = self._weigh(data, starts, ends)
        total = np.empty(len(data), log.dtype)  # of the place after each byte
        for depth in range(1, int(sizes.max()) + 1):
            rows = starts[sizes >= depth] + depth - 1
            sums = log[rows]
            inner = kinds < depth
            sums[:, inner] += total[rows[:, None] - kinds[inner]]
            top = sums.max(axis=1)
            top[np.isneginf(top)] = 0.0
            with np.errstate(divide="ignore"):
                total[rows] = top + np.log(np.exp(sums - top[:, None]).sum(axis=1))
            log[rows] = sums
        some = np.isfinite(log)
        depth = np.arange(len(data)) - np.repeat(starts, sizes) + 1
        log -= np.where(np.isfinite(total), total, 0.0)[:, None]
        share = np.exp(log).astype(np.float32)  # 0 where there is no edge
        np.cumsum(share, axis=1, out=share)
        counts = some.sum(axis=1)
        first = np.concatenate([[0], np.cumsum(counts)])
        share = share[some]
        share[first[1:][counts > 0] - 1] = 2.0  # the last edge takes what rounding leaves
        shift, edges = self.n_places, self.n_edges
        row, kind = np.nonzero(some)
        before = np.where(kinds[kind] == depth[row], -1, row - kinds[kind] + shift)
        self.known.update(zip(units, (ends - 1 + shift).tolist(), strict=True))
        self.parts.append(((first[1:] + edges).astype(np.int32), share, before.astype(np.int32), piece[some].astype(np.uint16)))
        self.n_places, self.n_edges = self.n_places + len(data), edges + len(share)

    def _gather(self) -> None:
        """What has been learned since, behind what was known; the arrays have room to grow by half."""
        for name, i in (("first", 0), ("share", 1), ("before", 2), ("piece", 3)):
            held, at = getattr(self, name), self.filled[i]
            end = at + sum(len(p[i]) for p in self.parts)
            if end > len(held):
                held = np.empty(end + end // 2, held.dtype)
                held[:at] = getattr(self, name)[:at]
                setattr(self, name, held)
            for p in self.parts:
                held[at : at + len(p[i])] = p[i]
                at += len(p[i])
            self.filled[i] = at
        self.parts = []

    def sample(self, texts: list[str | None], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of the texts, one after another, and the texts' offsets; keys: a uint64 for each text."""
        units: list[bytes] = []
        per_text = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if t:
                found = _UNIT.findall(b" " + t.encode())
                per_text[i] = len(found)
                units += found
        if not units:
            return np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        distinct = set(units)
        new = list(distinct - self.known.keys())
        if len(self.known) + len(new) > self.MOST:
            self._forget()
            new = list(distinct)
        size, part = 0, []
        for u in sorted(new, key=len):  # in parts of about one length that stay in the processor's cache
            part.append(u)
            size += len(u)
            if size >= PART:
                self._learn(part)
                size, part = 0, []
        if part:
            self._learn(part)
        self._gather()
        at = np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))
        text_of = np.repeat(np.arange(len(texts)), per_text)
        number = np.arange(len(units)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        seed = mix(keys[text_of] + number.astype(np.uint64) * _GOLDEN)
        live = np.arange(len(units))
        taken: list[tuple[np.ndarray, np.ndarray]] = []
        steps = np.zeros(len(units), np.int64)
        while len(live):
            turn = np.uint64((len(taken) + 1) * int(_STEP) & (1 << 64) - 1)
            u = ((mix(seed[live] + turn) >> np.uint64(40)).astype(np.float32)) * np.float32(2.0**-24)
            edge = self.first[at[live]].astype(np.int64)
            behind = np.flatnonzero(u >= self.share[edge])
            while len(behind):
                edge[behind] += 1
                behind = behind[u[behind] >= self.share[edge[behind]]]
            taken.append((live, self.piece[edge]))
            steps[live] += 1
            before = self.before[edge]
            at[live] = before
            live = live[before >= 0]
        ends = np.cumsum(steps)
        out = np.empty(int(ends[-1]), np.int32)
        for k, (who, what) in enumerate(taken):
            out[ends[who] - 1 - k] = what
        return out, np.concatenate([[0], np.concatenate([[0], ends])[np.cumsum(per_text)]]).astype(np.int64)

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.out.__getitem__, ids))
        return text[1:].decode() if text else ""

    def decode_rows(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The texts of rows of pieces, without the space that was put in front of each."""
        sizes = self.out_sizes[ids]
        ends = np.cumsum(sizes)
        where = np.repeat(self.out_starts[ids] - (ends - sizes), sizes)
        where += np.arange(len(where))
        bounds = np.concatenate([[0], ends])[offsets]
        data = np.delete(self.out_data[where], bounds[:-1][bounds[1:] > bounds[:-1]])
        return string_array(data, bounds - np.concatenate([[0], np.cumsum(bounds[1:] > bounds[:-1])]))


def _keys(ids: pa.Array, seed: int) -> np.ndarray:
    """A number for each row key; null keys count as 0."""
    values = ids.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
    return mix(values.astype(np.uint64) * _GOLDEN + np.uint64(seed))


def _encode(model: str, alpha: float, seed: int):
    def f(batches):
        lattice = Lattice.of(model, alpha)
        for batch in batches:
            text = as_array(batch["_text"])
            for lo, hi in row_slices(text, 1 << 20):
                part = batch.slice(lo, hi - lo)
                ids, off = lattice.sample(part["_text"].to_pylist(), _keys(part["_id"], seed))
                lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part[c] for c in part.schema.names if c != "_text"] + [lists], [c for c in part.schema.names if c != "_text"] + ["_pieces"])

    return f


def _decode(model: str, alpha: float):
    def f(batches):
        lattice = Lattice.of(model, alpha)
        for batch in batches:
            step = max(1, len(batch) * (1 << 20) // max(1, batch["_pieces"].nbytes))
            for lo in range(0, len(batch), step):
                part = batch.slice(lo, step)
                pieces = part["_pieces"]
                sizes = pc.fill_null(pc.list_value_length(pieces), 0).to_numpy(zero_copy_only=False)
                ids = pieces.flatten().to_numpy(zero_copy_only=False)
                texts = lattice.decode_rows(ids, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))
                if pieces.null_count:
                    texts = pc.if_else(pieces.is_valid(), texts, pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, texts], [*part.schema.names, "_text"])

    return f


def _ddl(df: DataFrame, columns: list[str]) -> str:
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in columns)


def encode_sampled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = "piece_bpe_32k.model", alpha: float = 2.0, seed: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs: id, the columns of keep, and pieces, a sampled segmentation of the text (array of piece ids).

    Rows with equal integer ids and texts get equal pieces; a null id counts as 0.  Null and empty
    texts give no pieces.  Every row stays a row; an empty table gives an empty result; columns not
    kept are not looked at.  There is no shuffle.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *keep)
    ddl = f"_id {docs.schema[id_col].dataType.simpleString()}, {_ddl(docs, list(keep))}_pieces array<int>"
    return rows.mapInArrow(_encode(model, alpha, seed), ddl).withColumnsRenamed({"_id": id_col, "_pieces": "pieces"})


def decode_pieces(encoded: DataFrame, pieces_col: str = "pieces", text_col: str = "decoded", model: str = "piece_bpe_32k.model", alpha: float = 2.0) -> DataFrame:
    """encoded with the text of its pieces as text_col; no pieces give an empty text, null gives null."""
    others = [c for c in encoded.columns if c != pieces_col]
    rows = encoded.select(*others, F.col(pieces_col).alias("_pieces"))
    return rows.mapInArrow(_decode(model, alpha), f"{_ddl(encoded, others)}_pieces array<int>, _text string").withColumnsRenamed({"_pieces": pieces_col, "_text": text_col})

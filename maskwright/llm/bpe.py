"""Token ids of whole texts, exactly as a `tokenizers` file gives them, at many times its speed.

Where a tokenizer's pre-tokenizer never makes a token of, or across, ASCII white space (as the word
level BPE with word ends: white space is dropped, every other rule looks inside a run of
non-space characters only), the ids of a text are the ids of its white-space separated chunks in a
row.  `ChunkEncoder` remembers the ids of chunks it has met, within a bound, and gives the unknown
ones to the library in batches.  Special strings inside texts stay with the library: none of them
holds white space.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np

from .words import claim

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file on this machine (each executor has its own copy)."""
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkEncoder:
    """Ids of UTF-8 texts by remembered chunks; one for each worker process and file.

    A chunk is looked up as it stands.  One not met before is first reduced: to lower case, where the
    file lower-cases anyway, and without full stops, commas and the like at its end, where a letter or
    digit stands before them and the pre-tokenizer therefore cuts; only reduced forms not known either
    go to the library.  (A chunk with `<` in it may hold a special string and is never reduced.)
    """

    #: Chunks remembered; then those met in one batch only are forgotten. About 200 bytes each.
    MOST = 800_000
    #: Longer chunks are not remembered.
    LONGEST = 200

    _made: dict[str, ChunkEncoder] = {}

    @classmethod
    def of(cls, name: str, most: int = MOST) -> ChunkEncoder:
        """This process's encoder of the file; most: chunks it remembers from now on, which changes its speed and memory, not its ids."""
        claim(f"chunks of {name}", cls._made.clear)
        if name not in cls._made:
            cls._made[name] = cls(name)
        cls._made[name].MOST = most
        return cls._made[name]

    def __init__(self, name: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary(name))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kind = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.known: dict[bytes, bytes] = {}
        self.again: set[bytes] = set()
        self.closes = self._closing()
        self.ends = {c: self._ids([c.decode()])[0] for c in _ENDS} if self._reducible() else {}

    def _closing(self) -> np.ndarray | None:
        """Which tokens end a pre-token, for a model that marks word ends; null for others."""
        import json

        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        if not suffix:
            return None
        out = np.zeros(self.tokenizer.get_vocab_size(), bool)
        out[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        return out

    def _reducible(self) -> bool:
        """Whether this file lower-cases, and cuts letters and digits from signs."""
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        return ids("ABx") == ids("abx") and all(ids(f"a{e.decode()}") == ids("a") + ids(e.decode()) and ids(f"1{e.decode()}") == ids("1") + ids(e.decode()) for e in _ENDS)

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array(self.kind, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """The same for words of letters only, each of which is one pre-token and so ends with the one token that ends it."""
        out: list[bytes] = []
        for at in range(0, len(words), 2000):
            part = words[at : at + 2000]
            ids = np.array(self.tokenizer.encode("\n".join(part), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(part):
                out += self._ids(part)
                continue
            raw, width = ids.astype(np.uint16 if self.kind == "H" else np.uint32).tobytes(), 2 if self.kind == "H" else 4
            cuts = [0, *(ends * width).tolist()]
            out += [raw[a:b] for a, b in zip(cuts, cuts[1:])]
        return out

    def _add(self, chunks: list[bytes]) -> None:
        """Chunks that are not known, as the library gives them."""
        texts = [c.decode() for c in chunks]
        if self.closes is None:
            self.known.update(zip(chunks, self._ids(texts), strict=True))
            return
        words = [i for i, t in enumerate(texts) if t.isalpha()]
        self.known.update(zip([chunks[i] for i in words], self._words([texts[i] for i in words]), strict=True))
        rest = [i for i, t in enumerate(texts) if not t.isalpha()]
        self.known.update(zip([chunks[i] for i in rest], self._ids([texts[i] for i in rest]), strict=True))

    def _learn(self, chunks: set[bytes]) -> None:
        known = self.known
        if not self.ends:
            self._add(list(chunks))
            return
        plain = [c for c in chunks if c[-1] not in _LAST and c.islower()]
        other = chunks.difference(plain)
        reduced = []
        for c in other:
            low = c if b"<" in c else c.lower()
            base = low if b"<" in c else low.rstrip(b".,;:!?")
            end = low[len(base) :]
            reduced.append((c, base, end) if end in self.ends and base[-1:].isalnum() else (c, low, b""))
        self._add(list((set(plain) | {base for _, base, _ in reduced}) - known.keys()))
        for c, base, end in reduced:
            known[c] = known[base] + self.ends[end] if end else known[base]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian uint32."""
        pieces = [(i, p) for i, t in enumerate(texts) for p in segments(t)]
        out: list[list[bytes]] = [[] for _ in texts]
        at = 0
        while at < len(pieces):
            to, size = at, 0
            while to < len(pieces) and size < SEGMENT:
                size += len(pieces[to][1])
                to += 1
            split = [p.split() for _, p in pieces[at:to]]
            needed = set().union(*split)
            unknown = needed - self.known.keys()
            self.again |= needed - unknown
            if len(self.known) + len(unknown) > self.MOST:
                self.known = {c: self.known[c] for c in self.again if c in self.known} if len(self.again) < self.MOST // 2 else {}
                self.again = set()
                unknown = needed - self.known.keys()
            self._learn(unknown)
            get = self.known.__getitem__
            for (i, _), s in zip(pieces[at:to], split, strict=True):
                out[i].append(b"".join(map(get, s)))
            for c in [c for c in unknown if len(c) > self.LONGEST]:
                del self.known[c]
            at = to
        joined = (p[0] if len(p) == 1 else b"".join(p) for p in out)
        return [np.frombuffer(x, "<u2").astype("<u4").tobytes() for x in joined] if self.kind == "H" else list(joined)

    def count(self, texts: list[bytes]) -> list[int]:
        """The number of ids of each text."""
        return [len(x) // 4 for x in self.encode(texts)]


# Signs after a word that are cut off before it is looked up.
_LAST = frozenset(b".,;:!?")
_ENDS = (b".", b",", b";", b":", b"!", b"?", b"...", b"!!", b"??")
#: Bytes split into chunks at once.
SEGMENT = 8 << 20
_SPACE = re.compile(rb"[ \t\n\v\f\r]")


def segments(text: bytes) -> Iterator[bytes]:
    """The text in pieces of about SEGMENT bytes, cut at white space (a longer run without any stays whole)."""
    at = 0
    while len(text) - at > SEGMENT:
        cut = _SPACE.search(text, at + SEGMENT)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


_SPACE_TEXT = re.compile("[ \t\n\v\f\r]")


class Resynchroniser:
    """Token ids of huge texts from overlapping chunks, spliced where both encodings agree.

    Each chunk is encoded by the library with offsets.  Two neighbours are spliced at a character of
    their overlap that is proven stable: ASCII white space, at which the pre-tokenizer cuts whatever
    stands around it, with the same tokens in both encodings from the first such character of the
    overlap up to it.  Where an overlap holds no two such characters, or the encodings differ between
    them, it is widened, twice as far each time; when it would reach the chunk's own start, the chunk
    is lengthened and encoded again instead, to the whole text at worst.
    """

    def __init__(self, tokenizer, chunk: int = 1 << 15, overlap: int = 256):
        self.tokenizer, self.chunk, self.overlap = tokenizer, chunk, overlap
        self.widened = 0

    def _tokens(self, text: str, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of text[lo:hi] and where in the text each begins."""
        e = self.tokenizer.encode(text[lo:hi], add_special_tokens=False)
        return np.asarray(e.ids, "<u4"), np.fromiter((o[0] for o in e.offsets), np.int64, len(e.ids)) + lo

    def _splice(self, text: str, ids: np.ndarray, at: np.ndarray, start: int, hi: int, end: int):
        """(where, ids and places of the next chunk from there on), or None if no common boundary is proven."""
        spaces = [m.start() for m in _SPACE_TEXT.finditer(text, start, hi)]
        if len(spaces) < 2:
            return None
        first, last = spaces[0], spaces[-1]
        more, where = self._tokens(text, start, end)
        if not np.array_equal(ids[(at >= first) & (at < last)], more[(where >= first) & (where < last)]):
            return None
        keep = where >= last
        return last, more[keep], where[keep]

    def encode(self, text: str) -> Iterator[np.ndarray]:
        """All ids of the text, part by part."""
        lo, hi = 0, min(self.chunk, len(text))
        ids, at = self._tokens(text, lo, hi)
        while hi < len(text):
            overlap, spliced = self.overlap, None
            while not spliced and hi - overlap > lo:
                end = min(hi - overlap + self.chunk + overlap, len(text))
                spliced = self._splice(text, ids, at, hi - overlap, hi, end)
                overlap *= 2
                self.widened += not spliced
            if spliced:
                yield ids[at < spliced[0]]
                lo, ids, at = spliced
                hi = end
            else:
                hi = min(hi + max(hi - lo, self.chunk), len(text))
                ids, at = self._tokens(text, lo, hi)
        yield ids

"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Three passes: a lexicon of words and word beginnings is learned from a bounded sample of the labelled
rows; the features of the same sample train the trees (on the driver: at most SAMPLE rows of some
twenty numbers); every document is then measured and scored where it lies, without a shuffle.

Bounds, documented parameters of `learn`: at most `sample` labelled rows of each class, those with the
smallest hash of their id, are learned from, each weighted so that the classes keep their shares; and
at most `lexicon` entries are kept.  Held-out rows (crc32 of the id as text, modulo 5, is 0) are never
learned from.  Ids, labels, languages and sources are no inputs of a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import Words, as_array, claim, lean_stream, row_slices, span_hashes, string_array

SAMPLE, LEXICON = 5_000, 2_000
#: Labelled rows of the rarer class from which on the lexicon and the trees learn from different halves.
HALVES = 60
#: Bytes of text measured at once; a worker holds about a hundred times as much.
SLICE = 1 << 20
#: Bytes of a word's beginning that the lexicon may hold instead of the word.
BEGINNINGS = (4, 5, 6, 7)
# Second person pronouns and insults of the languages in view, and letters that digits and signs stand for.
SECOND_PERSON = "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch ti usted ustedes vosotros tus su"
INSULTS = """idiot idiots moron morons stupid loser losers scum worthless disgusting clown imbecile bastard trash pathetic dummkopf trottel abschaum arschloch widerlich idiote imbécile salaud débile
idiota imbécil estúpido asqueroso payaso"""
#: What an entry of INSULTS weighs where the labels say nothing of it.
INSULT_WEIGHT = 3.0
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}

_kind = np.zeros(256, np.uint8)  # 1 letter, 2 digit, 3 other sign
_kind[33:127] = 3
_kind[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_kind[48:58] = 2
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_leet = _lower.copy()
for _a, _b in LEET.items():
    _leet[ord(_a)] = ord(_b)
_SIGNS = [ord(c) for c in LEET if not c.isdigit()]

FEATURES = (
    "hit_density", "word_hit_density", "begin_hit_density", "hits", "distinct_hits", "hit_weight", "leet_hit_density", "leet_extra_hits",
    "second_person_density", "hits_near_second_person", "capital_share", "shouted_words", "shouted_hits", "exclamation_density", "question_density",
    "sign_density", "digit_density", "mixed_word_rate", "single_letter_rate", "mean_word_bytes", "log_words",
)


def _compact(text: pa.Array, leet: bool) -> Words:
    """The words of a text in lower case without signs (leet: with signs and digits read as letters first)."""
    w = Words(text)
    table = _leet if leet else _lower
    keep = ~w.inside | (_kind[w.data] == 1) | (_kind[w.data] == 2)
    if leet:
        keep |= np.isin(w.data, _SIGNS)
    places = np.concatenate([[0], np.cumsum(keep)])[w.offsets]
    return Words(string_array(table[w.data][keep], places))


def term_hashes(w: Words) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Hashes of the words; and, for each length of a beginning, the words that are longer and their beginnings' hashes."""
    out = []
    size = w.ends - w.starts
    for n in BEGINNINGS:
        long = np.flatnonzero(size > n)
        out.append((long, span_hashes(w.data, w.starts[long], w.starts[long] + n) ^ np.uint64(n)))
    return w.hashes(), out


@dataclass
class Lexicon:
    """Hashes of terms, ascending, with their weights; the first table is for words, the second for beginnings."""

    words: np.ndarray
    word_weights: np.ndarray
    begins: np.ndarray
    begin_weights: np.ndarray

    def look(self, hashes: np.ndarray, words: bool) -> np.ndarray:
        """The weight of each hash, 0 for none."""
        known, weights = (self.words, self.word_weights) if words else (self.begins, self.begin_weights)
        if not len(known):
            return np.zeros(len(hashes))
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        return np.where(known[at] == hashes, weights[at], 0.0)


def _per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _hits(w: Words, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word: its weight as a word, as the best of its beginnings, and its hash."""
    words, begins = term_hashes(w)
    as_word, as_begin = lexicon.look(words, True), np.zeros(len(words))
    for long, h in begins:
        as_begin[long] = np.maximum(as_begin[long], lexicon.look(h, False))
    return as_word, as_begin, words


def features(text: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """(rows, features)."""
    raw, plain = Words(text), _compact(text, False)
    n = np.maximum(raw.counts, 1)
    as_word, as_begin, hashes = _hits(plain, lexicon)
    best = np.maximum(as_word, as_begin)
    hit = best > 0
    leet = _compact(text, True)
    leet_word, leet_begin, _ = _hits(leet, lexicon)
    leet_hits = _per_row(np.maximum(leet_word, leet_begin) > 0, leet.first)
    row = plain.rows()
    out = np.zeros((raw.n_rows, len(FEATURES)))
    hits = _per_row(hit, plain.first)
    pairs = np.unique(np.stack([row[hit].astype(np.uint64), hashes[hit]]), axis=1)[0].astype(np.int64) if hit.any() else np.empty(0, np.int64)
    you = np.isin(hashes, np.unique(Words(pa.array([SECOND_PERSON])).hashes()))
    at = np.flatnonzero(you)
    near = np.zeros(len(hashes), bool)
    if len(at) and hit.any():
        i = np.flatnonzero(hit)
        j = np.searchsorted(at, i)
        before, after = at[np.maximum(j - 1, 0)], at[np.minimum(j, len(at) - 1)]
        near[i] = ((np.abs(i - before) <= 5) & (row[before] == row[i])) | ((np.abs(after - i) <= 5) & (row[after] == row[i]))
    kinds = _kind[raw.data]
    upper = (raw.data >= 65) & (raw.data <= 90)
    lower = (raw.data >= 97) & (raw.data <= 122)
    ups, lows = np.concatenate([[0], np.cumsum(upper)]), np.concatenate([[0], np.cumsum(lower)])
    digits, letters = (np.concatenate([[0], np.cumsum(kinds == k)]) for k in (2, 1))
    per = lambda sums: sums[raw.ends] - sums[raw.starts]
    shouted = (per(ups) >= 3) & (per(lows) == 0)
    inner = np.concatenate([[0], np.cumsum(np.isin(raw.data, _SIGNS) | (kinds == 2))])
    mixed = (per(letters) >= 2) & (inner[np.maximum(raw.ends - 1, raw.starts)] - inner[np.minimum(raw.starts + 1, raw.ends - 1)] > 0)
    chars = np.maximum(_per_row(raw.inside, raw.offsets), 1)
    columns = [
        hits / n, _per_row(as_word > 0, plain.first) / n, _per_row(as_begin > 0, plain.first) / n, np.minimum(hits, 50), np.minimum(np.bincount(pairs, minlength=raw.n_rows), 50), np.minimum(_per_row(best, plain.first), 200),
        leet_hits / n, np.minimum(np.maximum(leet_hits - hits, 0), 50), _per_row(you, plain.first) / n, _per_row(near, plain.first) / n,
        _per_row(upper, raw.offsets) / np.maximum(_per_row(upper | lower, raw.offsets), 1), _per_row(shouted, raw.first) / n, np.zeros(raw.n_rows),
        _per_row(raw.data == 33, raw.offsets) / n, _per_row(raw.data == 63, raw.offsets) / n, _per_row(kinds == 3, raw.offsets) / chars, _per_row(kinds == 2, raw.offsets) / chars,
        _per_row(mixed, raw.first) / n, _per_row(raw.ends - raw.starts == 1, raw.first) / n, chars / n, np.log1p(raw.counts),
    ]
    for k, c in enumerate(columns):
        out[:, k] = c
    kept = (per(letters) + per(digits)) > 0  # the words of plain, in order
    out[:, FEATURES.index("shouted_hits")] = _per_row(shouted[kept] & hit, plain.first) / n
    return out


@lean_stream
def _terms(batches):
    """Distinct terms of each document, counted by class and half: (words or beginning, hash, toxic, reads, documents)."""
    from collections import Counter

    claim("toxicity")
    seen: Counter = Counter()
    for batch in batches:
        text, toxic = as_array(batch["_text"]), list(zip(batch["toxic"].to_pylist(), batch["reads"].to_pylist(), strict=True))
        for lo, hi in row_slices(text, SLICE):
            w = _compact(text[lo:hi], False)
            words, begins = term_hashes(w)
            row = w.rows()
            for is_word, rows, h in [(True, row, words)] + [(False, row[long], h) for long, h in begins]:
                for r in range(hi - lo):
                    a, b = np.searchsorted(rows, [r, r + 1])
                    seen.update((is_word, x, toxic[lo + r]) for x in np.unique(h[a:b]).view(np.int64).tolist())
    rows = [(k[0], k[1], *k[2], v) for k, v in seen.items()]
    for at in range(0, len(rows), 100_000):
        part = list(zip(*rows[at : at + 100_000], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.bool_()), pa.array(part[1], pa.int64()), pa.array(part[2], pa.int32()), pa.array(part[3], pa.bool_()), pa.array(part[4], pa.int64())], ["is_word", "term", "toxic", "reads", "n"])


class Trees:
    """Boosted regression trees on the logistic loss, over features cut into at most 64 bins each."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, least: float = 5.0):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        b = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], axis=1)
        share = np.clip((y * weight).sum() / weight.sum(), 1e-4, 1 - 1e-4)
        self.start, self.trees = float(np.log(share / (1 - share))), []
        z = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-z))
            tree, leaf = self._grow(b, (y - p) * weight, p * (1 - p) * weight)
            self.trees.append(tree)
            z += self.rate * leaf
        return self

    def _grow(self, b, g, h):
        """A tree as {node: (feature, bin)} or {node: value}; a node's children are 2n+1 (at most the bin) and 2n+2."""
        node = np.zeros(len(g), np.int64)
        tree: dict[int, tuple] = {}
        out = np.zeros(len(g))
        open_nodes = [0]
        for level in range(self.depth + 1):
            following = []
            for n in open_nodes:
                at = np.flatnonzero(node == n)
                gs, hs = g[at].sum(), h[at].sum()
                best = (1e-6, None)
                if level < self.depth and len(at) >= 2 * self.least:
                    for j in range(b.shape[1]):
                        k = len(self.cuts[j]) + 1
                        if k < 2:
                            continue
                        gl = np.cumsum(np.bincount(b[at, j], g[at], k))[:-1]
                        hl = np.cumsum(np.bincount(b[at, j], h[at], k))[:-1]
                        nl = np.cumsum(np.bincount(b[at, j], minlength=k))[:-1]
                        gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                        gain[(nl < self.least) | (len(at) - nl < self.least)] = -1
                        if gain.max() > best[0]:
                            best = (gain.max(), (j, int(gain.argmax())))
                if best[1] is None:
                    value = gs / (hs + 1)
                    tree[n] = (value,)
                    out[at] = value
                else:
                    j, cut = best[1]
                    tree[n] = (j, float(self.cuts[j][cut]))
                    node[at] = np.where(b[at, j] <= cut, 2 * n + 1, 2 * n + 2)
                    following += [2 * n + 1, 2 * n + 2]
            open_nodes = following
        return tree, out

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.start)
        for tree in self.trees:
            node = np.zeros(len(x), np.int64)
            for n in sorted(tree):
                if len(tree[n]) == 2:
                    j, cut = tree[n]
                    at = node == n
                    node[at] = np.where(x[at, j] <= cut, 2 * n + 1, 2 * n + 2)
            values = np.zeros(2 ** (self.depth + 1))
            for n, t in tree.items():
                if len(t) == 1:
                    values[n] = t[0]
            z += self.rate * values[node]
        return z


def isotonic(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the weighted least-squares ascending fit, by pooling adjacent violators; to be read by linear interpolation."""
    order = np.argsort(z, kind="stable")
    pools: list[list[float]] = []  # sum of weights, of weighted labels, of weighted places
    for i in order:
        pools.append([weight[i], weight[i] * y[i], weight[i] * z[i]])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    places = np.array([p[2] / p[0] for p in pools])
    # half a case of each class in every pool keeps scores off 0 and 1
    unit = float(np.mean(weight))
    return places, np.array([(p[1] + 0.05 * unit) / (p[0] + 0.1 * unit) for p in pools])


@dataclass
class Model:
    """What scores a text; without labelled rows of both classes it knows the share of toxic ones only."""

    share: float
    lexicon: Lexicon | None = None
    trees: Trees | None = None
    places: np.ndarray | None = None
    values: np.ndarray | None = None

    def score(self, text: pa.Array) -> np.ndarray:
        if self.trees is None:
            return np.full(len(text), self.share)
        z = self.trees.raw(features(text, self.lexicon))
        # what calibration pools together stays in the trees' order
        return np.clip(np.interp(z, self.places, self.values) + 1e-6 * np.tanh(z / 10), 0.0, 1.0)


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, lexicon: int = LEXICON) -> Model:
    """A model of label_col from the rows of labels that are not held out.

    Rows with a null id or label teach nothing; an id labelled twice counts as toxic if one label says so.
    """
    told = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~is_held_out(F.col(id_col))).groupBy(F.col(id_col).alias("_key")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    totals = {r["toxic"]: r["count"] for r in told.groupBy("toxic").count().collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return Model(n1 / (n1 + n0) if n1 + n0 else 0.0)
    few = [told.where(F.col("toxic") == c).orderBy(F.xxhash64("_key"), "_key").limit(sample) for c in (0, 1)]
    chosen = F.broadcast(few[0].union(few[1]))  # 2 * sample rows at most
    rows = docs.select(F.col(id_col).alias("_key"), F.col(text_col).alias("_text")).join(chosen, "_key")
    # one half teaches the lexicon that the other's trees are grown with: on what it was learned from, a lexicon looks better
    # than it is; the lexicon that scores is learned from both
    half = F.pmod(F.xxhash64("_key", F.lit(1)), F.lit(2)) == 0
    apart = min(n1, n0, sample) >= HALVES
    growers = rows.where(~half) if apart else rows
    m1, m0 = min(n1, sample), min(n0, sample)
    part = 2 if apart else 1
    tally = lambda toxic, some: F.sum(F.when((F.col("toxic") == toxic) & some, F.col("n")).otherwise(0))
    reads = F.col("reads") if apart else F.lit(True)
    rows = rows.withColumn("reads", half)
    counted = rows.mapInArrow(_terms, "is_word boolean, term long, toxic int, reads boolean, n long").groupBy("is_word", "term")
    counted = counted.agg(tally(1, F.lit(True)).alias("bad"), tally(0, F.lit(True)).alias("good"), tally(1, reads).alias("bad_read"), tally(0, reads).alias("good_read"))

    def rank(bad: str, good: str, share: int) -> tuple[Column, Column]:
        """A term's weight, and what it is chosen by: it must be found in several toxic documents, and mostly there."""
        odds = F.log((F.col(bad) + 0.5) / (m1 / share + 1)) - F.log((F.col(good) + 0.5) / (m0 / share + 1))
        fits = (F.col(bad) >= max(3, m1 // share // 400)) & (odds > 2.5)
        return odds, F.when(fits, odds * F.sqrt(bad)).otherwise(0.0)

    w, by = rank("bad", "good", 1)
    w_read, by_read = rank("bad_read", "good_read", part)
    told = counted.select("is_word", "term", w.alias("w"), by.alias("by"), w_read.alias("w_read"), by_read.alias("by_read")).where("by > 0 or by_read > 0")
    best = told.orderBy(F.desc(F.greatest("by", "by_read")), "is_word", "term").limit(2 * lexicon).collect()
    seeds = Words(pa.array([INSULTS])).hashes().tolist()

    def entries(by: str, w: str) -> Lexicon:
        chosen_terms = sorted((r for r in best if r[by] > 0), key=lambda r: (-r[by], r["is_word"], r["term"]))[:lexicon]

        def table(words: bool) -> tuple[np.ndarray, np.ndarray]:
            weights = dict.fromkeys(seeds, INSULT_WEIGHT) if words else {}
            weights |= {int(np.int64(r["term"]).view(np.uint64)): r[w] for r in chosen_terms if r["is_word"] == words}
            mine = sorted(weights.items())
            return np.array([t for t, _ in mine], np.uint64), np.array([x for _, x in mine], float)

        return Lexicon(*table(True), *table(False))

    lex, lex_read = entries("by", "w"), entries("by_read", "w_read")

    @lean_stream
    def measure(batches):
        claim("toxicity")
        for batch in batches:
            text = as_array(batch["_text"])
            for lo, hi in row_slices(text, SLICE):
                x = features(text[lo:hi], lex_read)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1) * len(FEATURES), pa.int32()), pa.array(x.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch["_key"][lo:hi].cast(pa.int64()), batch["toxic"][lo:hi], lists], ["_key", "toxic", "x"])

    got = growers.mapInArrow(measure, "_key long, toxic int, x array<double>").toArrow().sort_by([("_key", "ascending"), ("toxic", "ascending")])
    if not got.num_rows:
        return Model(n1 / (n1 + n0))
    x = np.array(got["x"].combine_chunks().flatten(), float).reshape(-1, len(FEATURES))
    y = got["toxic"].to_numpy().astype(float)
    if y.min() == y.max():
        return Model(float(y[0]))
    weight = np.where(y == 1, n1 / max((y == 1).sum(), 1), n0 / max((y == 0).sum(), 1)) / (n1 + n0) * len(y)
    fold = np.arange(len(y)) % 4 == 0  # a quarter calibrates
    if not apart or y[fold].min() == y[fold].max() or y[~fold].min() == y[~fold].max():
        fold = np.zeros(len(y), bool)
    trees = Trees().fit(x[~fold], y[~fold], weight[~fold])
    use = fold if fold.any() else ~fold
    places, values = isotonic(trees.raw(x[use]), y[use], weight[use])
    return Model(n1 / (n1 + n0), lex, trees, places, values)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, held_out, score (0 to 1) and predicted (1 if score >= 0.5).

    Null and empty texts are scored by their (zero) features; equal texts have equal scores; rows with
    a null id are not held out; each row stays a row and an empty table gives an empty result.
    """

    @lean_stream
    def apply(batches):
        claim("toxicity")
        for batch in batches:
            text = as_array(batch["_text"])
            for lo, hi in row_slices(text, SLICE):
                yield pa.RecordBatch.from_arrays([batch["_id"][lo:hi], pa.array(model.score(text[lo:hi]))], ["_id", "score"])

    key = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(apply, f"_id {key}, score double")
    return out.select(F.col("_id").alias(id_col), is_held_out(F.col("_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all columns, that are not predicted to be toxic (score below 0.5)."""

    @lean_stream
    def apply(batches):
        claim("toxicity")
        for batch in batches:
            text = as_array(batch[text_col])
            for lo, hi in row_slices(text, SLICE):
                yield batch.slice(lo, hi - lo).filter(pa.array(model.score(text[lo:hi]) < 0.5))

    return docs.mapInArrow(apply, docs.schema)

"""Quality by weak supervision: rules vote or abstain, and expectation-maximisation weighs them.

Every document gets counts; every rule turns some of them into a vote for (1) or against (-1) the
document, or abstains (0).  The model: a document is good with probability `prior`; a rule that votes
is right with one probability on good documents and another on bad ones, whatever the others say: a
rule may miss most bad documents and yet be never wrong about those it is against.  EM estimates these
from how often each pattern of votes occurs over *all* documents: at most 3^rules rows reach the driver, whatever the
corpus.  A document is kept if its posterior probability of being good is at least one half.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import Words, as_array, claim, mix, row_slices, span_hashes

# Frequent short words of the languages that the rules know.
STOP_WORDS = {
    "en": "the of and to in a is that for it with was on as be this by are at from or an have not you",
    "fr": "le la les de des du et un une en que qui dans pour par sur est au avec pas il elle ne ce",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an",
    "es": "el la los las de y en un una que del se por con para su al lo como más o es no",
}
_STOP = np.unique(np.array(sorted({w for ws in STOP_WORDS.values() for w in ws.split()}), dtype=object))
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_ALPHA = _UPPER | ((np.arange(256) >= 97) & (np.arange(256) <= 122)) | (np.arange(256) >= 128)
_ROW = np.uint64(0x9FB21C651E98DF25)


def _stop_hashes() -> np.ndarray:
    w = Words(pa.array([" ".join(_STOP)]))
    return np.sort(w.hashes())


def _per_row(marked: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(marked, dtype=np.int64)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def repeated_words(w: Words, hashes: np.ndarray, k: int = 8) -> np.ndarray:
    """Per row: words inside windows of k words that occur twice or more in the row."""
    n = len(hashes)
    starts, h = w.windows(hashes, k)
    _, inverse, counts = np.unique(mix(h + w.rows()[starts].astype(np.uint64) * _ROW), return_inverse=True, return_counts=True)
    flag = np.zeros(n, np.int64)
    flag[starts[counts[inverse] > 1]] = 1
    seen = np.concatenate([[0], np.cumsum(flag)])
    i = np.arange(n)
    return _per_row(seen[i + 1] - seen[np.maximum(i + 1 - k, 0)] > 0, w.first)


def _lines(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the lines that hold a word."""
    feeds = np.flatnonzero(w.data == 10)
    starts = np.unique(np.concatenate([w.offsets[:-1], feeds + 1]))
    starts = starts[starts < len(w.data)]
    at = np.searchsorted(feeds, starts)
    row = np.searchsorted(w.offsets, starts, side="right") - 1
    ends = np.minimum(np.append(feeds, len(w.data))[at], w.offsets[row + 1])
    has = np.concatenate([[0], np.cumsum(w.inside)])
    full = has[ends] > has[starts]
    return starts[full], ends[full], row[full]


#: Bytes of text measured at once.
SLICE = 1 << 20
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_alpha", "n_stop", "n_plain")


def counts_of(text: pa.Array, stop: np.ndarray) -> dict[str, np.ndarray]:
    w = Words(text)
    hashes = w.hashes()
    lead = (w.data & 0xC0) != 0x80
    out = {"n_words": w.counts, "word_chars": _per_row(w.inside & lead, w.offsets), "n_symbols": _per_row(_SYMBOL[w.data], w.offsets)}
    s, e, row = _lines(w)
    keys = mix(span_hashes(w.data, s, e) + row.astype(np.uint64) * _ROW)
    _, one = np.unique(keys, return_index=True)
    lines = np.bincount(row, minlength=w.n_rows)
    out |= {"n_lines": lines, "n_dup_lines": lines - np.bincount(row[one], minlength=w.n_rows), "n_repeat_words": repeated_words(w, hashes)}
    alpha = _ALPHA[w.data]
    out |= {"n_upper": _per_row(_UPPER[w.data], w.offsets), "n_alpha": _per_row(alpha & lead, w.offsets)}
    low = Words(text, lower=True).hashes()
    at = np.minimum(np.searchsorted(stop, low), len(stop) - 1)
    out["n_stop"] = _per_row(stop[at] == low, w.first)
    letters = np.concatenate([[0], np.cumsum(alpha, dtype=np.int64)])
    out["n_plain"] = _per_row(letters[w.ends] - letters[w.starts] >= 0.75 * (w.ends - w.starts), w.first)  # words mostly of letters
    return out


def _measure(batches):
    claim("quality")
    stop = _stop_hashes()
    for batch in batches:
        text = as_array(batch["_text"])
        for lo, hi in row_slices(text, SLICE):
            c = counts_of(text[lo:hi], stop)
            yield pa.RecordBatch.from_arrays([batch["_id"][lo:hi], *(pa.array(c[k].astype(np.int64)) for k in COUNTS)], ["_id", *COUNTS])


def _vote(good: str, bad: str) -> Column:
    return F.when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0)


#: Each rule: for, against.
RULES = {
    "length": ("n_words >= 60", "n_words < 20"),
    "symbols": ("100 * n_symbols <= 2 * n_words", "100 * n_symbols > 15 * n_words"),
    "lines": ("n_lines >= 3 and n_dup_lines = 0", "100 * n_dup_lines > 30 * n_lines"),
    "repetition": ("n_words >= 20 and 100 * n_repeat_words <= 5 * n_words", "100 * n_repeat_words > 20 * n_words"),
    "word_length": ("10 * word_chars between 30 * n_words and 90 * n_words and n_words > 0", "10 * word_chars < 20 * n_words or 10 * word_chars > 140 * n_words"),
    "stop_words": ("100 * n_stop >= 8 * n_words and n_words > 0", "100 * n_stop < 2 * n_words and n_words >= 20"),
    "capitals": ("n_alpha > 0 and 100 * n_upper <= 15 * n_alpha", "100 * n_upper > 50 * n_alpha and n_alpha > 0"),
    "letters": ("n_words > 0 and 100 * n_plain >= 85 * n_words", "100 * n_plain < 60 * n_words"),
}


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500) -> tuple[np.ndarray, np.ndarray, float]:
    """How often each rule that votes is right on good and on bad documents, and the prior, by EM over (patterns, rules) votes that
    occur so often.

    It starts from the documents that no rule is against as the good ones.  Weak priors (of 20 right and
    1 wrong votes on good documents, 2 and 2 on bad ones) stand in where a rule hardly votes, and no rule
    is taken to be against good documents more often than against bad ones, so that "good" keeps its
    meaning.
    """
    plus, minus = (patterns > 0).astype(float), (patterns < 0).astype(float)
    p = np.where((patterns < 0).any(axis=1), 0.05, 0.95)
    old = None
    for _ in range(rounds):
        good, bad = (p * counts)[:, None], ((1 - p) * counts)[:, None]
        on_good = ((plus * good).sum(0) + 20) / (((plus + minus) * good).sum(0) + 21)
        on_bad = ((minus * bad).sum(0) + 2) / (((plus + minus) * bad).sum(0) + 4)
        on_good = np.clip(on_good, 0.5, 1 - 1e-4)
        on_bad = np.clip(np.maximum(on_bad, 1 - on_good), 1e-4, 1 - 1e-4)
        prior = float(np.clip((p * counts).sum() / max(counts.sum(), 1), 0.05, 0.99))
        p = posterior(patterns, on_good, on_bad, prior)
        new = np.concatenate([on_good, on_bad, [prior]])
        if old is not None and np.abs(new - old).max() < 1e-9:
            break
        old = new
    return on_good, on_bad, prior


def weights(on_good: np.ndarray, on_bad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a vote for and a vote against add to the log odds of a document."""
    return np.log(on_good / (1 - on_bad)), np.log((1 - on_good) / on_bad)


def posterior(votes: np.ndarray, on_good: np.ndarray, on_bad: np.ndarray, prior: float) -> np.ndarray:
    up, down = weights(on_good, on_bad)
    z = np.log(prior / (1 - prior)) + (votes > 0) @ up + (votes < 0) @ down
    return 1 / (1 + np.exp(-z))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """Per row of docs: id, the counts of COUNTS, base_failed, votes (array in the order of RULES), quality (posterior) and kept.

    base_failed: fewer than 20 words, or over 30 % of them in repeated 8-word windows; kept: not
    base_failed and quality >= 0.5.  Null and empty texts have no words and fail.  Equal rows and rows
    with a null id each stay a row; an empty table gives an empty result; other columns are not looked at.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    key = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    measured = rows.mapInArrow(_measure, f"_id {key}, " + ", ".join(f"{c} long" for c in COUNTS))
    votes = F.array(*(_vote(*r) for r in RULES.values()))
    measured = scratch.save(measured.withColumn("votes", votes), "counts")
    seen = measured.groupBy("votes").count().collect()  # 3^8 rows at most
    patterns = np.array([r["votes"] for r in seen], float).reshape(-1, len(RULES))
    on_good, on_bad, prior = fit(patterns, np.array([r["count"] for r in seen], float))
    z = F.lit(float(np.log(prior / (1 - prior))))
    for i, (up, down) in enumerate(zip(*weights(on_good, on_bad), strict=True)):
        z = z + F.when(F.col("votes")[i] > 0, float(up)).when(F.col("votes")[i] < 0, float(down)).otherwise(0.0)
    out = measured.withColumn("base_failed", F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")).withColumn("quality", 1 / (1 + F.exp(-z)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5)).withColumnRenamed("_id", id_col)

import random
import re
from collections import Counter

import numpy as np

from maskwright.llm import quality
from tests.llm.helpers import AWKWARD, docs_frame


def brute(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if n[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside)


def sample():
    r = random.Random(4)
    lines = ["one two three", "a # b", "", " ", "x\r", "one two three ", "é漢 *"]
    many = ["\n".join(r.choice(lines) for _ in range(r.randrange(9))) for _ in range(60)]
    return AWKWARD + many + [" ".join(r.choice("ab") for _ in range(r.randrange(60))) for _ in range(40)]


def test_counts(spark):
    texts = sample()
    for r in quality.judge(docs_frame(spark, texts)).collect():
        want = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, repr(texts[r.doc_id])
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)


def test_em_finds_how_often_rules_are_right():
    rng = np.random.default_rng(3)
    good = rng.random(60_000) < 0.7
    on_good, on_bad = np.array([0.97, 0.9, 0.95, 0.85, 0.99]), np.array([0.9, 0.7, 0.6, 0.8, 0.5])
    right = rng.random((len(good), 5)) < np.where(good[:, None], on_good, on_bad)
    votes = np.where(right == good[:, None], 1, -1) * (rng.random((len(good), 5)) < 0.8)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    a, b, prior = quality.fit(patterns.astype(float), counts.astype(float))
    assert np.abs(a - on_good).max() < 0.03 and np.abs(b - on_bad).max() < 0.04 and abs(prior - 0.7) < 0.02
    p = quality.posterior(votes, a, b, prior)
    assert ((p >= 0.5) == good).mean() > ((votes >= 0).all(1) == good).mean() + 0.02


def test_clean_prose_is_kept_and_junk_is_not(spark):
    r = random.Random(1)
    prose = [". ".join("The " + " ".join(r.choice("house of the river and a boat was seen in it by them with some light".split()) + str(r.randrange(9)) * (r.random() < 0.02) for _ in range(14)) for _ in range(8)) + ".\nAnd so on.\nThe end of it." for _ in range(30)]
    junk = ["### $$$ %%% *** ||| " * 40 for _ in range(10)]
    got = {x.doc_id: x.kept for x in quality.judge(docs_frame(spark, prose + junk)).collect()}
    assert all(got[i] for i in range(30)) and not any(got[i] for i in range(30, 40))


def test_empty_null_ids_and_clashing_columns(spark):
    assert quality.judge(docs_frame(spark, [])).collect() == []
    assert quality.judge(docs_frame(spark, ["a", "a", None], [None, None, 1]).selectExpr("*", "1 as n_words", "2 as votes", "3 as kept")).count() == 3

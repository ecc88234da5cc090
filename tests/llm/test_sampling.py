import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from maskwright.llm.sampling import Lattice, decode_pieces, encode_sampled
from tests.llm.helpers import AWKWARD, docs_frame

MODEL = "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def lattice():
    return Lattice(MODEL, 1.0)


def keys(n):
    return np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=80), max_size=8))
def test_decoding_is_lossless(texts):
    lattice = Lattice.of(MODEL, 1.0)
    ids, off = lattice.sample(texts, keys(len(texts)))
    assert [lattice.decode(ids[a:b].tolist()) for a, b in zip(off[:-1], off[1:])] == texts


def segmentations(lattice, text):
    """Every segmentation of a unit with its weight, by brute force."""
    if not text:
        return {(): 1.0}
    out = {}
    for j in range(1, len(text) + 1):
        if text[:j].encode() in lattice.weight:
            i, w = lattice.weight[text[:j].encode()]
            out |= {(i, *rest): w * v for rest, v in segmentations(lattice, text[j:]).items()}
    if text[0].encode() not in lattice.weight:
        raw = tuple(int(lattice.bytes[b]) for b in text[0].encode())
        out |= {raw + rest: 1e-6 * v for rest, v in segmentations(lattice, text[1:]).items()}
    return out


@pytest.mark.parametrize("text", ["the house", "  in", "naïve ▁x", "漢er"])
def test_samples_follow_the_lattice(lattice, text):
    import re

    want = {(): 1.0}
    for unit in re.findall(r" +[^ ]*|[^ ]+", " " + text):
        want = {a + b: v * w for a, v in want.items() for b, w in segmentations(lattice, unit).items()}
    total = sum(want.values())
    n = 20_000
    ids, off = lattice.sample([text] * n, keys(n))
    seen = Counter(tuple(ids[a:b].tolist()) for a, b in zip(off[:-1], off[1:]))
    assert set(seen) <= set(want)
    for s, w in want.items():
        p = w / total
        assert abs(seen[s] - n * p) <= 5 * math.sqrt(n * p * (1 - p)) + 3


def test_pieces_depend_on_key_and_text_only(spark):
    texts = [t for t in AWKWARD if t] * 2
    df = docs_frame(spark, texts, list(range(len(texts) // 2)) * 2)
    one = sorted((r.doc_id, r.pieces) for r in encode_sampled(df).collect())
    two = sorted((r.doc_id, r.pieces) for r in encode_sampled(df.repartition(7).orderBy("text")).collect())
    assert one == two and one[0] == one[1]
    assert one != sorted((r.doc_id, r.pieces) for r in encode_sampled(df, seed=1).collect())


def test_awkward_rows(spark):
    df = docs_frame(spark, AWKWARD).selectExpr("*", "1 as pieces0", "2 as _pieces")
    got = decode_pieces(encode_sampled(df, keep=("text", "lang"))).collect()
    assert len(got) == len(AWKWARD) and all((r.text or "") == r.decoded for r in got)
    assert encode_sampled(docs_frame(spark, [])).collect() == []
    assert encode_sampled(docs_frame(spark, ["a b", "a b"], [None, None])).count() == 2


def test_long_units_keep_their_sums_in_range(lattice):
    text = "x" * 3000 + "漢字" * 500
    ids, off = lattice.sample([text], keys(1))
    assert lattice.decode(ids.tolist()) == text

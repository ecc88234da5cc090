import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from maskwright.llm.bpe import ChunkEncoder, Resynchroniser, vocabulary
from maskwright.llm.packing import capacities, pack, pack_documents
from maskwright.llm.token_count import count_tokens
from tests.llm.helpers import AWKWARD, docs_frame

NAME = "word_bpe_49k.json"
SPECIAL = ["<|endoftext|> and<|startoftext|>text", "it's we'll don't 'S 'sx", "é ́x á\ń", "ΣΑΣ İI ſ", "\x1c\x85  　x"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary(NAME))


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


letters = st.text(st.sampled_from("abZ' .\n\t́é漢<|>endoftx'sİ "), max_size=400)


@settings(max_examples=200, deadline=None)
@given(letters, st.integers(2, 60), st.integers(1, 30))
def test_chunks_and_splices_give_the_librarys_ids(text, chunk, overlap):
    encoder = ChunkEncoder.of(NAME)
    want = ids_of(encoder.tokenizer, text)
    assert np.frombuffer(encoder.encode([text.encode()])[0], "<u4").tolist() == want
    assert np.concatenate(list(Resynchroniser(encoder.tokenizer, chunk, overlap).encode(text))).tolist() == want


def test_memory_of_chunks_is_bounded():
    encoder = ChunkEncoder(NAME)
    encoder.MOST = 50
    texts = [" ".join(f"w{random.Random(i).randrange(500)}" for _ in range(40)) for i in range(60)]
    got = encoder.encode([t.encode() for t in texts])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [ids_of(encoder.tokenizer, t) for t in texts]


def test_overlaps_widen(library):
    text = "a b " + "q" * 700 + " c d " + "z" * 90 + " " + "end " * 50
    splicer = Resynchroniser(library, 100, 10)
    assert np.concatenate(list(splicer.encode(text))).tolist() == ids_of(library, text)
    assert splicer.widened


def test_counts(spark, library):
    texts = AWKWARD + SPECIAL
    got = {r.doc_id: r for r in count_tokens(docs_frame(spark, texts), huge=3000, chunk=2000, overlap=40).collect()}
    for i, t in enumerate(texts):
        n = len(ids_of(library, t))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 2048)
    assert count_tokens(docs_frame(spark, [])).collect() == []
    assert count_tokens(docs_frame(spark, ["a", "a", None], [1, 1, None]).selectExpr("*", "1 as n_tokens", "2 as _id")).count() == 3


def check_packing(rows, docs, library, length):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, t in docs:
        ids, at = [*ids_of(library, t), 1], 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            part = np.array(ids[at : at + r.length], "<u4").tobytes()
            assert bytes(r.ids) == part and zlib.crc32(bytes(r.ids)) == zlib.crc32(part)
            at += r.length
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length and at & (at - 1) == 0


def test_packing(spark, library):
    docs = list(enumerate(AWKWARD + SPECIAL))
    for length in (64, 2048):
        check_packing(pack_documents(docs_frame(spark, [t for _, t in docs]), length=length).collect(), docs, library, length)
    assert pack_documents(docs_frame(spark, [])).collect() == []
    assert pack_documents(docs_frame(spark, ["a", "a", None], [1, 1, None]).selectExpr("*", "1 as start", "2 as ids")).count() >= 3


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=60))
def test_every_token_has_one_place(sizes):
    seen, ends = [], defaultdict(int)
    for i, start, n, b, offset in pack(sizes, 64):
        assert offset == ends[b]
        ends[b] += n
        seen += [(i, j) for j in range(start, start + n)]
    assert sorted(seen) == [(i, j) for i, n in enumerate(sizes) for j in range(n)]
    assert sorted(ends.values()) == sorted(capacities(sum(sizes), 64))


def test_costs_are_balanced():
    r = random.Random(1)
    sizes = [min(2047, int(r.lognormvariate(6, 1)) + 1) for _ in range(3000)]
    cost = defaultdict(float)
    for _, _, n, b, _ in pack(sizes, 2048):
        cost[b] += n + n * n / 6144
    full = sorted(cost.values())[10:]
    assert full[-1] <= (2048 + 2048**2 / 6144) and sum(full) / len(full) > 0.75 * full[-1]


def test_packing_does_not_depend_on_what_a_worker_holds(spark):
    texts = AWKWARD + SPECIAL + [" ".join(f"w{random.Random(i).randrange(900)}" for _ in range(300)) for i in range(30)]
    rows = [sorted(map(tuple, pack_documents(docs_frame(spark, texts), **few).collect()), key=repr) for few in ({}, {"slice_bytes": 100, "remembered": 40})]
    assert rows[0] == rows[1] and len(rows[0]) >= len(texts)

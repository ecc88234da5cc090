import hashlib
import random
from collections import Counter, defaultdict

import pytest

from maskwright.llm import alignment, queries
from maskwright.llm.bpe import vocabulary
from tests.llm.helpers import AWKWARD, docs_frame


@pytest.fixture(scope="module")
def whole():
    """(ids and token bytes of both) of a whole text, by the libraries alone; None where the bytes differ."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(vocabulary(alignment.A))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=vocabulary(alignment.B))
    letters = alignment.byte_letters()

    def f(text):
        if not text:
            return None
        e = a.encode(" " + text, add_special_tokens=False)
        x = [(i, bytes(letters[c] for c in t)) for i, t in zip(e.ids, e.tokens)]
        y = []
        for i in b.encode(text):
            p = b.id_to_piece(i)
            y.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
        want = (" " + text).encode()
        return (x, y) if b"".join(t for _, t in x) == want == b"".join(t for _, t in y) else None

    return f


def brute(whole, texts):
    """Rows by the statement: every byte's token of both sides."""
    links_of, rows, count = [], [], Counter()
    for t in texts:
        both = whole(t)
        if not both:
            links_of.append([])
            rows.append((0, 0, 0, 0, "", ""))
            continue
        owner, ends = [], []
        for side in both:
            owner.append([k for k, (_, raw) in enumerate(side) for _ in raw])
            at, e = 0, set()
            for _, raw in side:
                at += len(raw)
                e.add(at)
            ends.append(e)
        pairs = sorted(set(zip(*owner)))
        cut = sorted(ends[0] & ends[1])
        groups, lo = [], 0
        for hi in cut:
            ids = [",".join(str(side[k][0]) for k in sorted(set(own[lo:hi]))) for side, own in zip(both, owner)]
            groups.append("|".join(ids))
            lo = hi
        links = [(both[0][i][0], both[1][j][0]) for i, j in pairs]
        count.update(links)
        links_of.append(links)
        told = ";".join(groups)
        rows.append((len(both[0]), len(both[1]), len(groups), len(links), hashlib.sha256(told.encode()).hexdigest(), told))
    top_a, top_b = defaultdict(int), defaultdict(int)
    for (x, y), n in count.items():
        top_a[x], top_b[y] = max(top_a[x], n), max(top_b[y], n)
    more = []
    for links in links_of:
        best_a, best_b = ([count[k] == top[k[s]] for k in links] for s, top in ((0, top_a), (1, top_b)))
        more.append((sum(best_b), sum(count[k] for k in links), sum(best_a), sum(p and q for p, q in zip(best_a, best_b))))
    return [(*r, *m) for r, m in zip(rows, more)], count, top_a, top_b


SPECIAL = [
    "<|endoftext|> and <s> </s> <unk> <0x41> plain", "two  spaces　wide hard  ", " leading and trailing ", "a▁b", "line\nline two\r\n\ttab  x",
    "it's we'll I'd 'sx '  s", "\x00 nul \x1c sep \x1c", "é ́ x ﬁ ①", "numbers 12345 67 8,9.10", "▁", " ", "  ", "ünïcödé straße 漢字 漢 字 😀😀", "​ ‍ x",
]


def check(spark, whole, texts, **more):
    got = alignment.Alignment(docs_frame(spark, texts), groups=True, **more)
    rows = {r.doc_id: r for r in got.documents.collect()}
    want, count, top_a, top_b = brute(whole, texts)
    assert sorted(rows) == list(range(len(texts)))
    for i, w in enumerate(want):
        r = rows[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256, r.groups, r.n_best, r.count_sum, r.n_best_a, r.n_mutual) == w, texts[i]
    pairs = {(r.a_id, r.b_id): (r["count"], r.best_a, r.best_b) for r in got.pairs.collect()}
    assert pairs == {k: (n, n == top_a[k[0]], n == top_b[k[1]]) for k, n in count.items()}


def test_awkward_texts_equal_brute_force(spark, whole):
    check(spark, whole, [*AWKWARD, *SPECIAL])


def test_random_texts_in_small_blocks(spark, whole, monkeypatch):
    monkeypatch.setattr(alignment, "SEGMENT", 40)
    monkeypatch.setattr(alignment, "AT_ONCE", 100)
    monkeypatch.setattr(alignment, "REMEMBERED", 500)
    r = random.Random(3)
    letters = ["a", "b", "the", " ", " ", " ", "  ", "\n", "é", " ", "1", ".", "'s", " ", "漢", "\x1d", "-", "XY"]
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(1, 120))) for _ in range(300)]
    check(spark, whole, texts + texts[:100], block_bytes=900)
    chunks = alignment.Chunks(alignment.A, alignment.B)
    assert chunks.apart
    for t in texts:
        bodies = [b for part in chunks.bodies(t) for b in part]
        assert " ".join(bodies) == t


def test_merge_is_two_pointers():
    assert alignment.merge([1, 3, 6], [3, 4, 6]) == ([0, 1, 2, 2], [0, 0, 1, 2], [(2, 1, 2), (3, 3, 4)])
    assert alignment.merge([], []) == ([], [], [])


def test_repeated_and_null_ids_clashing_columns_and_empty_tables(spark):
    docs = docs_frame(spark, ["a b", "a b", None], [7, 7, None]).selectExpr("*", "1 as block", "2 as n_a", "3 as pairs")
    got = sorted(alignment.Alignment(docs).documents.collect(), key=lambda r: r.n_a)
    assert (got[0].doc_id, got[0].n_a, got[0].count_sum, got[0].groups_sha256) == (None, 0, 0, "")
    assert got[1] == got[2] and got[1].doc_id == 7 and got[1].count_sum == 2 * got[1].n_links > 0
    empty = alignment.Alignment(docs.limit(0))
    assert empty.documents.collect() == [] and empty.pairs.collect() == []


def test_query(spark, sf, whole):
    out = queries.op12_token_alignment(spark, sf)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    assert out.dtypes[:8] == [*((n, "bigint") for n in names), ("groups_sha256", "string")]
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    want, *_ = brute(whole, [d.text for d in docs])
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(docs)
    for d, w in zip(docs, want):
        r = got[d.doc_id]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256, r.n_best, r.count_sum) == (*w[:5], *w[6:8])

import random
import re

from maskwright.llm import near_dedup
from maskwright.llm.near_dedup import near_duplicates
from tests.llm.helpers import AWKWARD, docs_frame


def brute(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                p, q = sorted((root(a), root(b)))
                up[q] = p
    return sorted((i, len(sets[i]), root(i), root(i) == i) for i in ids)


def check(spark, rows, k=5, percent=80):
    got = near_duplicates(docs_frame(spark, [t for _, t in rows], [i for i, _ in rows]), shingle=k, percent=percent).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute(rows, k, percent)


def edited(words, n, r):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = f"e{r.randrange(10**9)}"
    return words


def test_awkward_texts(spark):
    check(spark, list(enumerate(AWKWARD)))


def test_groups_at_the_limit_and_chains(spark):
    r = random.Random(5)
    rows, n = [], 0
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(150)]
        at = base
        for _ in range(25):
            at = edited(at if g % 2 else base, r.randrange(6), r)  # chains drift away, stars don't
            rows.append((n, " ".join(at)))
            n += 1
    r.shuffle(rows)
    check(spark, rows)
    check(spark, rows, 4)


def test_one_large_group_of_near_copies(spark):
    r = random.Random(6)
    base = [f"w{i}" for i in range(120)]
    check(spark, [(i, " ".join(edited(base, r.randrange(5), r))) for i in range(300)])


def test_short_documents_with_common_shingles(spark):
    r = random.Random(7)
    check(spark, [(i, "a common line of words here " + " ".join(r.choice("xyz") for _ in range(r.randrange(6)))) for i in range(150)])


def test_repeated_rows_null_ids_empty_tables_and_clashing_columns(spark):
    t = AWKWARD[5]
    got = near_duplicates(docs_frame(spark, [t, t, t, None, "other words stand here now"], [7, 7, None, None, 1])).collect()
    assert sorted((str(r.doc_id), r.component_id, r.kept) for r in got) == [("1", 1, True), ("7", 7, True), ("7", 7, True), ("None", None, True), ("None", None, True)]
    assert near_duplicates(docs_frame(spark, [])).collect() == []
    df = docs_frame(spark, AWKWARD[:8]).selectExpr("*", "1 as n", "2 as key", "'x' as bands", "3 as rid", "4 as component_id")
    assert near_duplicates(df).count() == 8


def test_a_third_of_the_rows_are_copies_and_a_third_have_no_words_or_ids(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "HOT", 10)
    same = " ".join(f"w{i}" for i in range(30))
    texts = [same] * 120 + [None, " "] * 60 + [f"{same} more{i}" if i % 2 else " ".join(f"x{i}y{j}" for j in range(25)) for i in range(60)] + [same] * 60
    ids = [*range(500, 800), *[None] * 60]
    got = near_dedup.near_duplicates(docs_frame(spark, texts, ids)).collect()
    assert len(got) == 360
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    for i, t in zip(ids[:300], texts[:300]):
        linked = bool(t) and t.startswith("w0 ")
        assert (by[i].component_id, by[i].kept) == ((500, i == 500) if linked else (i, True))
    assert [(r.component_id, r.kept, r.n_shingles) for r in got if r.doc_id is None] == [(None, True, 26)] * 60

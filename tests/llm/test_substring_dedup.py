import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from maskwright.llm.substring_dedup import pack_sorted, remove_repeated_passages, unpack_sorted
from tests.llm.helpers import AWKWARD, PASSAGE, docs_frame


def brute(rows, k):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    n = Counter(tuple(w[i : i + k]) for w in split for i in range(len(w) - k + 1))
    out = []
    for (i, _), w in zip(rows, split, strict=True):
        gone = {j for s in range(len(w) - k + 1) if n[tuple(w[s : s + k])] > 1 for j in range(s, s + k)}
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone), gone))
    return out


def check(spark, rows, k, **more):
    got = remove_repeated_passages(docs_frame(spark, [t for _, t in rows], [i for i, _ in rows]), window=k, **more).collect()
    seen = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in got)
    assert seen == sorted((str(i), n, g, t) for i, n, g, t, _ in brute(rows, k))
    for r in got:
        assert sum(s.end - s.start for s in r.removed) == r.n_removed
        assert all(a.end < b.start for a, b in zip(r.removed, r.removed[1:]))  # maximal: no two touch


@pytest.mark.parametrize("k", [1, 3, 35])
def test_awkward_texts(spark, k):
    check(spark, list(enumerate(AWKWARD)), k)
    check(spark, list(enumerate(AWKWARD)), k, block_bytes=4000)
    check(spark, list(enumerate(AWKWARD)), k, block_bytes=4000, most_buckets=0)  # hashes as rows


def test_null_and_repeated_ids_and_rows(spark):
    check(spark, [(None, AWKWARD[5]), (None, "a b"), (3, AWKWARD[7]), (3, AWKWARD[7]), (3, "other text")], 35)


def test_empty_table_and_clashing_columns(spark):
    assert remove_repeated_passages(docs_frame(spark, [])).collect() == []
    df = docs_frame(spark, AWKWARD[:8]).selectExpr("*", "1 as _block", "2 as n_words", "'x' as kept_text", "0 as bucket", "text as _text")
    assert remove_repeated_passages(df).count() == 8


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1))
def test_sorted_blobs_survive(values):
    import numpy as np

    v = np.unique(np.array(values, np.uint64))
    assert (unpack_sorted(pack_sorted(v)) == v).all()


def test_few_letters_many_windows(spark):
    import random

    r = random.Random(3)
    check(spark, [(i, " ".join(r.choice("abc") for _ in range(r.randrange(60)))) for i in range(120)], 6)


def test_equal_rows_are_spread(spark):
    rows = [(None, None)] * 3000 + [(None, PASSAGE)] * 3000
    assert {(r.n_words, r.n_removed) for r in remove_repeated_passages(docs_frame(spark, [t for _, t in rows], [i for i, _ in rows])).collect()} == {(0, 0), (60, 60)}
    dealt = docs_frame(spark, [None] * 100_000, [None] * 100_000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = remove_repeated_passages(dealt).withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r["count"] for r in out) == 100_000 and max(r["count"] for r in out) <= 80_000

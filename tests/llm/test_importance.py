import hashlib
import math
import re
import zlib
from collections import Counter

from maskwright.llm import importance, queries
from tests.llm.helpers import AWKWARD, docs_frame

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def features(text):
    words = WORD.findall((text or "").translate(LOWER))
    return len(words), [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10_000


def brute(docs, target, percent=5, least=20):
    """{row: (n_features, weight, score, rank)} of [(id, text)] by the statement."""
    s, t = (Counter(bucket(f) for x in texts for f in features(x)[1]) for texts in ([x for _, x in docs], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in range(10_000)]
    out, able = {}, []
    for row, (i, x) in enumerate(docs):
        n, fs = features(x)
        weight = sum(gain[bucket(f)] for f in fs)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[row] = [len(fs), weight, score, None]
        if n >= least:
            able.append((-score, -1 if i is None else i, len(fs), weight, row))
    for rank, (*_, row) in enumerate(sorted(able)[: len(able) * percent // 100], 1):
        out[row][3] = rank
    return {row: tuple(v) for row, v in out.items()}


def told(df):
    got = {}
    for r in df.collect():
        got.setdefault(r.doc_id, []).append((r.n_features, r.weight, r.score, r["rank"]))
    return {k: sorted(v, key=repr) for k, v in got.items()}


def wanted(docs, rows):
    out = {}
    for row, (i, _) in enumerate(docs):
        out.setdefault(i, []).append(rows[row])
    return {k: sorted(v, key=repr) for k, v in out.items()}


def test_scan_is_crc32_of_every_run(monkeypatch):
    for text in [x or "" for x in AWKWARD] + ["A-b_C 1é2 {x} \x7f~ z", "x"]:
        n, fs = features(text)
        parts = list(importance.scan(text.encode()))
        assert sum(w for w, _ in parts) == n
        assert Counter(c for _, p in parts for c in p) == Counter(zlib.crc32(f.encode()) for f in fs)
    monkeypatch.setattr("maskwright.llm.bpe.SEGMENT", 50)  # the ring goes on from part to part
    text = " ".join(f"w{i}" for i in range(200))
    parts = list(importance.scan(text.encode()))
    assert len(parts) > 5 and Counter(c for _, p in parts for c in p) == Counter(zlib.crc32(f.encode()) for f in features(text)[1])


def test_awkward_rows_equal_brute_force(spark):
    texts = [*AWKWARD, *(" ".join(f"t{i * j % 37}" for j in range(i % 50)) for i in range(300)), "y" * 200_000, "a b " * 60_000]
    docs = list(enumerate(texts))
    target = ["t1 t2 t3 t4", None, "", "lonely lonely WORD1 word2"]
    got = importance.resample(docs_frame(spark, texts).selectExpr("*", "1 as rank", "2 as weight", "3 as bucket").repartition(7), docs_frame(spark, target))
    assert told(got) == wanted(docs, brute(docs, target))


def test_repeated_and_null_ids_ties_and_empty_tables(spark):
    long, short = " ".join(f"a{i}" for i in range(25)), "one two"
    docs = [(5, long)] * 60 + [(None, long)] * 20 + [(None, short), (9, None)] + [(i, long) for i in range(100, 140)]
    df = docs_frame(spark, [t for _, t in docs], [i for i, _ in docs])
    got = importance.resample(df, docs_frame(spark, ["a1 a2"]), percent=60)
    assert told(got) == wanted(docs, brute(docs, ["a1 a2"], percent=60))
    ranks = sorted(r["rank"] for r in got.collect() if r["rank"])
    assert ranks == list(range(1, 120 * 60 // 100 + 1))
    assert importance.resample(df.limit(0), df).collect() == []
    nothing = importance.resample(df, df.limit(0))
    assert told(nothing) == wanted(docs, brute(docs, []))


def test_buckets(spark):
    rows = {r.doc_id: r.buckets for r in importance.feature_buckets(docs_frame(spark, ["B a c", None])).collect()}
    assert rows == {0: [bucket(f) for f in ("b", "a", "b a", "c", "a c", "b a c")], 1: []}


def test_query(spark, sf):
    out = queries.op13_importance_ring(spark, sf)
    assert out.dtypes[:5] == [(n, "bigint") for n in ("doc_id", "n_features", "weight", "score", "rank")]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert told(out) == wanted(docs, brute(docs, target))

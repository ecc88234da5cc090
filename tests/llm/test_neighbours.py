import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from maskwright.llm import neighbours
from maskwright.llm.graph import components
from maskwright.llm.neighbours import best, exact_scores, nearest, strings, unit
from maskwright.llm.scratch import Scratch

SCHEMA = "vec_id long, embedding array<float>"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], SCHEMA)


def brute(rows, queries, k):
    ok = {i: np.array(v, np.float32) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    out = {}
    for q in queries:
        if q in ok:
            ids = np.array([i for i in ok if i != q])
            s = exact_scores(np.array([ok[i] for i in ids]), ok[q]) if len(ids) else np.empty(0)
            out[q] = [(int(ids[j]), float(s[j])) for j in np.lexsort([ids, -s])[:k]]
    return out


def got(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        assert r.n_scored > 0
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_small_tables_are_searched_whole(spark):
    rng = np.random.default_rng(1)
    rows = [(i, v) for i, v in enumerate(rng.standard_normal((120, 8)).round(1).tolist())]
    rows += [(200 + i, rows[3][1]) for i in range(30)]  # ties
    rows += [(300, None), (301, [0.0] * 8), (302, [float("nan")] + [1.0] * 7), (303, [None] + [1.0] * 7), (304, [float("inf")] + [1.0] * 7), (305, [])]
    df = frame(spark, rows)
    ask = df.where("vec_id % 20 = 0")
    assert got(nearest(df, ask, 20)) == brute(rows, range(0, 400, 20), 20)


def test_crowded_cells_recall_and_few_candidates(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((3000, 16)) * rng.uniform(0.5, 2, (3000, 1))
    v[:1000] = v[0] + rng.standard_normal((1000, 16)) * 1e-3  # a third lie together
    v[1000:1300] = v[1000]  # and some are equal
    rows = list(enumerate(v.tolist()))
    df = frame(spark, rows)
    ask = df.where("vec_id % 20 = 0")
    found, want = got(nearest(df, ask, 20, whole=200, block_rows=10**6)), brute(rows, range(0, 3000, 20), 20)
    assert recall(found, want) >= 0.9
    assert got(nearest(df.limit(5), df.limit(5), 20)).keys() == {0, 1, 2, 3, 4}
    assert nearest(df.limit(0), df.limit(0)).collect() == []


def recall(found, want):
    return sum(sum(s >= want[q][-1][1] - 1e-9 for _, s in found.get(q, [])) for q in want) / sum(map(len, want.values()))


def test_queries_ascend_past_thin_cells_and_skewed_lengths(spark):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((4000, 16)) * rng.lognormal(0, 1.5, (4000, 1))
    for name in ("lengths", "one side"):
        rows = list(enumerate(v.tolist()))
        df = frame(spark, rows)
        ask = df.where("vec_id % 20 = 0")
        found, want = got(nearest(df, ask, 20, whole=200, block_rows=1000)), brute(rows, range(0, 4000, 20), 20)
        assert all(len(found.get(q, [])) == 20 for q in want), name
        assert recall(found, want) >= 0.95, name
        # stored vectors of one length in a few directions, queries in all directions: most cells of a query are empty
        v = rng.standard_normal((4000, 16))
        v[np.arange(4000) % 20 != 0] = rng.standard_normal((3, 16))[rng.integers(0, 3, 3800)] + rng.standard_normal((3800, 16)) * 0.05
        v /= np.linalg.norm(v, axis=1, keepdims=True)


def test_repeated_rows_and_clashing_columns(spark):
    df = frame(spark, [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (2, [0.5, 0.5]), (None, [1.0, 1.0])]).selectExpr("*", "1 as code", "2 as cell", "3 as query_id")
    assert got(nearest(df, df)) == {1: [(2, 0.5)], 2: [(1, 0.5)]}


def test_best_breaks_ties_by_id():
    vectors = np.array([[1, 0], [1, 0], [2, 0], [1, 0]], np.float32)
    ids, s = best(np.array([5, 3, 9, 1]), vectors, np.arange(4), np.array([1, 0], np.float32), 3)
    assert ids.tolist() == [9, 1, 3] and s.tolist() == [2.0, 1.0, 1.0]


def test_a_third_of_the_rows_are_one_row(spark):
    df = frame(spark, [(i, [1.0, 0.5]) for i in range(4000)] + [(4000 + i, [0.5, i / 1e4]) for i in range(40)])
    want = {q: [(i, 1.25) for i in range(22) if i != q][:20] for q in (0, 20, 3980)}
    assert got(nearest(df, df.where("vec_id in (0, 20, 3980)"), whole=8, block_rows=500)) == want
    same = spark.createDataFrame([(7, [1.0, 0.5])] * 3000 + [(8, [1.0, 0.0])], SCHEMA)
    assert got(nearest(same, same, block_rows=500)) == {7: [(8, 1.0)], 8: [(7, 1.0)]}


def test_doubles_stay_doubles_and_lengths_are_kept_apart(spark):
    rows = [(1, [1.0, 1e-12]), (2, [1.0, 2e-12]), (3, [1.0, 1.0, 1.0]), (4, [2.0, 1.0, 1.0]), (5, [1e300, 1.0]), (6, [1e-300, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = got(nearest(df, df))
    assert found[3] == [(4, 4.0)] and [i for i, _ in found[1]] == [5, 2, 6] and found[1][1] == (2, 1.0 + 2e-24)
    assert found[5][0] == (1, 1e300) or found[5][0] == (2, 1e300)


def test_strings_are_symbols_of_closest_directions():
    v = np.random.default_rng(6).standard_normal((50, 12))
    u, n = unit(v)
    assert np.allclose(u, v / np.linalg.norm(v, axis=1, keepdims=True), atol=1e-6) and np.allclose(n, np.log2(np.linalg.norm(v, axis=1)))
    codes, r = strings(u, 3), neighbours.directions(12, 3)
    for row, code in zip(u, codes.tolist()):
        for s in range(neighbours.SYMBOLS):
            p = r[s * neighbours.WAYS : (s + 1) * neighbours.WAYS] @ row
            way = int(np.abs(p).argmax())
            assert code >> 3 * (neighbours.SYMBOLS - 1 - s) & 7 == 2 * way + (p[way] > 0)


def test_chance_of_equal_symbols():
    rng = np.random.default_rng(9)
    for cosine in (0.3, 0.7, 0.99):
        x, y = rng.standard_normal((2, 400, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y -= (x * y).sum(axis=1, keepdims=True) * x
        y /= np.linalg.norm(y, axis=1, keepdims=True)
        z = cosine * x + np.sqrt(1 - cosine**2) * y
        same = [a >> np.uint64(60) == b >> np.uint64(60) for t in range(40) for a, b in [(strings(x.astype(np.float32), t), strings(z.astype(np.float32), t))]]
        assert abs(np.mean(same) - neighbours.alike(cosine)) < 0.02


def kinds():
    rng = np.random.default_rng(12)
    centres = rng.standard_normal((50, 64))
    return {
        "random": rng.standard_normal((8000, 64)),
        "clusters": centres[rng.integers(0, 50, 8000)] + 0.1 * rng.standard_normal((8000, 64)),
        "skewed": rng.standard_normal((8000, 64)) * rng.lognormal(0, 1, (8000, 1)),
    }


@pytest.mark.parametrize("kind", ["random", "clusters", "skewed"])
def test_prefixes_beyond_the_first_symbol_decide(spark, kind):
    v = kinds()[kind].astype(np.float32)
    out, share = searched(spark, v, 40)
    assert share["recall"] >= 0.9 and share["below"] > 0.9


def searched(spark, v, step):
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(v)), "embedding": list(v)}), SCHEMA)
    ask = list(range(0, len(v), step))
    out = nearest(df, df.where(f"vec_id % {step} = 0")).toPandas()
    scores = v.astype(np.float64) @ v[ask].T.astype(np.float64)
    scores[ask, np.arange(len(ask))] = -np.inf
    edge = dict(zip(ask, np.partition(scores, len(v) - 20, axis=0)[len(v) - 20], strict=True))
    hits = sum(s >= edge[q] - 1e-9 for q, s in zip(out.query_id, out.score, strict=True))
    once = out[out["rank"] == 1]
    return out, {"recall": hits / (20 * len(ask)), "scored": once.n_scored.mean() / len(v), "below": (once.shortest_prefix >= 2).mean()}


def test_symbols_after_the_first_are_not_idle():
    """With all symbols but the first cleared a search finds other rows, and fewer of the nearest."""
    v = kinds()["random"].astype(np.float32)
    ask = np.arange(0, 8000, 80)
    table = lambda ids, name: pa.table({name: pa.array(ids), "vec": pa.array([v[i].tobytes() for i in ids], pa.binary())})
    rows = {}
    for cleared in (False, True):
        with pytest.MonkeyPatch.context() as m:
            if cleared:
                m.setattr(neighbours, "strings", lambda u, t, whole=strings: whole(u, t) & ~np.uint64((1 << 60) - 1))
            out = neighbours._search(20, 20, neighbours.TREES, neighbours.MISS, neighbours.WHOLE, "<f4")(table(np.arange(8000), "_id"), table(ask, "q"))
        rows[cleared] = set(zip(out["query_id"].to_pylist(), out["vec_id"].to_pylist())), sum(out["scored"].to_pylist())
    assert rows[False] != rows[True] and abs(rows[False][1] - rows[True][1]) > 0.1 * rows[False][1]


def test_recall_holds_and_the_scored_share_falls_as_tables_grow(spark):
    rng = np.random.default_rng(13)
    told = [searched(spark, rng.standard_normal((n, 64)).astype(np.float32), n // 100)[1] for n in (4000, 16_000)]
    assert all(t["recall"] >= 0.9 and t["below"] > 0.9 for t in told)
    assert told[0]["scored"] > 1.15 * told[1]["scored"]


def test_recall_at_fifty_thousand_rows(spark):
    """Random directions, the hardest case: a tenth of the queries against brute force, with few candidates."""
    v = np.random.default_rng(8).standard_normal((50_000, 64)).astype(np.float32)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(v)), "embedding": list(v)}), SCHEMA)
    ask = list(range(0, 50_000, 500))
    out = nearest(df, df.where("vec_id % 500 = 0")).toPandas()
    scores = v.astype(np.float64) @ v[ask].T.astype(np.float64)
    scores[ask, np.arange(len(ask))] = -np.inf
    edge = dict(zip(ask, np.partition(scores, len(v) - 20, axis=0)[len(v) - 20], strict=True))
    hits = sum(s >= edge[q] - 1e-9 for q, s in zip(out.query_id, out.score, strict=True))
    assert hits / (20 * len(ask)) >= 0.9
    assert out.n_scored.max() < 0.45 * len(v)


def test_components_by_stars_and_at_once(spark):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (250, 2))] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, i) for i in range(2001, 2100)] + [(7, 7), (None, 3)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            p, q = sorted((root(a), root(b)))
            up[q] = p
    want = {x: root(x) for x in up}
    df = spark.createDataFrame(links, "a long, b long")
    for local in (0, 10**6):
        assert {r.node: r.component for r in components(df, Scratch(spark), local_links=local).collect()} == want
    assert components(df.limit(0), Scratch(spark)).collect() == []

"""Approximate nearest neighbours by a forest of hash prefixes.

Every tree gives a vector a string of SYMBOLS symbols: each is the one of WAYS random directions and their opposites that
the vector is closest to.  A tree is the sorted array of its strings.  A query descends each tree to its longest
matching prefix; then all trees ascend in step, a symbol at a time and tree by tree, and what shares the shorter prefixes is
scored, until a vector as near as the worst of the wanted ones found so far would have been missed by all trees
with probability `miss` at most.  That probability follows from the angle (two vectors at an angle have equal symbols with a known chance), so
close neighbours end a search at long prefixes and few rows, and far ones, as in random data, at shorter prefixes; as a table
grows the neighbours come closer and the share of its rows that is scored falls.  Scores are exact, in double
precision, on the original vectors.

Inner products are not angles: the rows of a forest are cut into bands of similar length (norm
ranging), each with trees of its own, searched from the longest on; the angle that counts in a band is that at
which its longest vector would reach the wanted score, and a band that cannot reach it is passed over, which loses nothing.
Bands of at most `whole` rows are searched whole.  Equal vectors are one entry with its k + 1 smallest ids: no larger
one can be among the k nearest, as ties go to the smaller id.

In Spark: rows are dealt to blocks of BLOCK_BYTES by a hash of the row, each block has its own forest,
built in the task, and every query of the stated set visits all blocks; the blocks' best are merged.  As a block is a random
share of the rows, it need not look for k neighbours of its own but for as many of the k as may lie in it.
Stored vectors are shuffled once; a query is sent once to each block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .words import as_array, claim, lean

#: Trees; symbols of a string; directions of a symbol, which has 2 * WAYS values.
TREES, SYMBOLS, WAYS = 128, 21, 4
#: Chance that a vector as near as the wanted ones is met by no tree, at which ascending stops.
MISS = 0.1
#: Rows of a band that are searched whole.
WHOLE = 512
#: Bytes of vectors in a block, least rows of one, and bytes of queries that meet a block at once.
BLOCK_BYTES, BLOCK_ROWS, QUERY_BYTES = 16 << 20, 16_384, 64 << 20
#: Queries searched at once.
AT_ONCE = 512
#: Bands of length, each down to 1/sqrt(2) of the one before; the last holds all that is shorter.
BANDS = 40
#: Rows hashed at once.
STEP = 4096

_BITS = (2 * WAYS).bit_length() - 1
_alike: list[np.ndarray] = []


def directions(dim: int, tree: int, seed: int = 7) -> np.ndarray:
    """A tree's directions, WAYS for each symbol in order, of length 1."""
    r = np.random.default_rng([seed, dim, tree]).standard_normal((SYMBOLS * WAYS, dim)).astype(np.float32)
    return r / np.linalg.norm(r, axis=1, keepdims=True)


def alike(cosine: float) -> float:
    """The chance that two vectors at this cosine have the same symbol, by trial on a grid of angles."""
    if not _alike:
        rng = np.random.default_rng(5)
        x, y = rng.standard_normal((2, 60_000, WAYS))
        angles, rows, told = np.linspace(0, np.pi / 2, 65), np.arange(len(x)), []
        for a in angles:
            z = np.cos(a) * x + np.sin(a) * y
            i, j = np.abs(x).argmax(axis=1), np.abs(z).argmax(axis=1)
            told.append(((i == j) & ((x[rows, i] > 0) == (z[rows, j] > 0))).mean())
        _alike.append(np.array([angles, np.minimum.accumulate(told)]))
    return float(np.interp(np.arccos(min(max(cosine, 0.0), 1.0)), *_alike[0]))


def share_of(k: int, blocks: int) -> int:
    """As many of the k nearest as lie in one of these blocks, but for rare cases."""
    mean = k / blocks
    return min(k, int(np.ceil(mean + 3 * np.sqrt(mean) + 1)))


def unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length 1 in single precision, and the binary logarithms of the lengths; none may be zero."""
    v = vectors.astype(np.float64)
    top = np.abs(v).max(axis=1, keepdims=True)
    v = v / top
    n = np.sqrt((v * v).sum(axis=1))
    return (v / n[:, None]).astype(np.float32), np.log2(top[:, 0]) + np.log2(n)


def strings(units: np.ndarray, tree: int) -> np.ndarray:
    """A tree's strings as uint64, the first symbol in the highest bits."""
    r = directions(units.shape[1], tree).T
    codes = np.empty(len(units), np.uint64)
    for lo in range(0, len(units), STEP):
        p = (units[lo : lo + STEP] @ r).reshape(-1, SYMBOLS, WAYS)
        way = np.abs(p).argmax(axis=2)
        up = np.take_along_axis(p, way[:, :, None], 2)[:, :, 0] > 0
        code = np.zeros(len(p), np.uint64)
        for symbol in (2 * way + up).astype(np.uint64).T:
            code = (code << np.uint64(_BITS)) | symbol
        codes[lo : lo + STEP] = code
    return codes


class Forest:
    """The trees of one band's distinct vectors."""

    def __init__(self, units: np.ndarray, trees: int):
        self.n, self.trees = len(units), trees
        self.order = np.empty((trees, self.n), np.int32)
        self.codes = np.empty((trees, self.n), np.uint64)
        for t in range(trees):
            codes = strings(units, t)
            order = np.argsort(codes, kind="stable")
            self.order[t], self.codes[t] = order, codes[order]

    def ranges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query (its strings by tree), tree and length of a prefix, from none on: where the rows that share it begin and end."""
        lo = np.zeros((len(codes), self.trees, SYMBOLS + 1), np.int32)
        hi = np.full_like(lo, self.n)
        for t in range(self.trees):
            for length in range(1, SYMBOLS + 1):
                open_ = np.flatnonzero(hi[:, t, length - 1] > lo[:, t, length - 1])  # nothing shares what is longer
                if not len(open_):
                    hi[:, t, length:] = 0
                    break
                rest = np.uint64((1 << (_BITS * (SYMBOLS - length))) - 1)
                first = codes[open_, t] & ~rest
                hi[:, t, length] = 0
                lo[open_, t, length] = np.searchsorted(self.codes[t], first)
                hi[open_, t, length] = np.searchsorted(self.codes[t], first | rest, side="right")
        return lo, hi

    def search(self, lo: np.ndarray, hi: np.ndarray, score, wanted: int, least: float, miss: float) -> tuple[np.ndarray, int]:
        """Rows met for a query (its ranges), and the length of the shortest prefix that was needed.

        score(rows): their scores in any unit, and cosines.  The farthest of the `wanted` best rows decides when to stop, but no
        farther than the cosine `least`, below which nothing here counts.
        """
        seen, got, near = np.zeros(self.n, bool), np.empty(0, np.float32), np.empty(0, np.float32)
        length = int((hi > lo).sum(axis=1).max()) - 1  # the longest prefix that any tree matches
        at, low = 0, np.log(miss)
        while length > 0:
            # trees before `at` have ascended to this length, the others share one symbol more
            farthest = max(float(near.min()), least) if len(got) >= wanted else max(least, 0.0)
            chance = min(alike(farthest), 0.999) if farthest > 0 else 0.0
            here, longer = np.log1p(-(chance**length)), np.log1p(-(chance ** (length + 1))) if length < SYMBOLS else 0.0
            if at * here + (self.trees - at) * longer <= low:
                break
            if at == self.trees:
                length, at = length - 1, 0
                continue
            if not chance:
                to = min(self.trees, max(2 * at, 1))
            elif self.trees * here > low:
                to = self.trees
            else:
                to = max(at + 1, min(self.trees, int(np.ceil((low - self.trees * longer) / (here - longer)))))
            met = np.zeros(self.n, bool)
            for t in range(at, to):
                if hi[t, length] > lo[t, length]:
                    met[self.order[t, lo[t, length] : hi[t, length]]] = True
            new = np.flatnonzero(met & ~seen)
            if len(new):
                seen |= met
                s, c = score(new)
                got, near = np.concatenate([got, s]), np.concatenate([near, c])
                if len(got) > wanted:
                    best_ = np.argpartition(-got, wanted)[:wanted]
                    got, near = got[best_], near[best_]
            at = to
        if length == 0:
            return np.arange(self.n), 0
        return np.flatnonzero(seen), length


def exact_scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision; the same two vectors give the same number anywhere."""
    with np.errstate(over="ignore", invalid="ignore"):
        return (vectors.astype(np.float64) * query.astype(np.float64)).sum(axis=1)


def merged(lists: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of lists of ids and scores, ties to the smaller id; an id counts once, with its best score."""
    ids, s = np.concatenate([x for x, _ in lists]), np.concatenate([x for _, x in lists])
    order = np.lexsort([ids, -s])
    _, one = np.unique(ids[order], return_index=True)
    order = order[np.sort(one)][:k]
    return ids[order], s[order]


def best(ids: np.ndarray, vectors: np.ndarray, rows: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k nearest of these rows, whose ids are given; ties to the smaller id, an id once."""
    if len(ids) > 2 * k:
        with np.errstate(over="ignore", invalid="ignore"):
            rough = vectors[rows] @ query
        if np.isfinite(rough).all():
            edge = np.partition(rough, len(ids) - k)[len(ids) - k]
            near = np.flatnonzero(rough >= edge - 1e-5 * (1 + abs(float(edge))))
            out = merged([(ids[near], exact_scores(vectors[rows[near]], query))], k)
            if len(out[0]) == k:  # fewer: ids repeat among the best
                return out
    return merged([(ids, exact_scores(vectors[rows], query))], k)


def _matrix(column, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _distinct(ids: np.ndarray, raw: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the distinct vectors' first rows, and by them (first, ids) the k + 1 smallest distinct ids of each."""
    held: dict[bytes, list[int]] = {}
    for i, v in enumerate(raw):
        held.setdefault(v, []).append(i)
    rows = np.array([r[0] for r in held.values()], np.int64)
    few = [np.unique(ids[r])[: k + 1] if len(r) > 1 else ids[r] for r in held.values()]
    return rows, np.concatenate([[0], np.cumsum([len(f) for f in few])]), np.concatenate(few)


def _search(k: int, wanted: int, trees: int, miss: float, whole: int, kind: str):
    names = ["query_id", "vec_id", "score", "scored", "depth"]
    types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int32()]
    empty = pa.table([pa.array([], t) for t in types], names=names)

    def f(left: pa.Table, right: pa.Table) -> pa.Table:
        claim("neighbours")
        if not len(left) or not len(right):
            return empty
        rows, first, ids = _distinct(left["_id"].to_numpy(), left["vec"].to_pylist(), k)
        vectors = _matrix(left["vec"], kind)[rows]
        units, length = unit(vectors)
        band = np.minimum(2 * (length.max() - length), BANDS - 1).astype(int)
        bands = [(np.flatnonzero(band == b), length[band == b].max()) for b in np.unique(band)]
        forests = [Forest(units[mine], trees) if len(mine) > whole else None for mine, _ in bands]
        out = []
        for lo in range(0, len(right), AT_ONCE):
            part = right.slice(lo, AT_ONCE)
            who, asked = part["q"].to_numpy(), _matrix(part["vec"], kind)
            q_units, q_length = unit(asked)
            found = [(np.empty(0, np.int64), np.empty(0))] * len(who)
            scored, depth = np.zeros(len(who), np.int64), np.full(len(who), SYMBOLS, np.int32)
            if any(forests):
                codes = np.stack([strings(q_units, t) for t in range(trees)], 1)
            for (mine, longest), forest in zip(bands, forests, strict=True):
                reach = np.exp2(np.minimum(q_length + longest, 1000.0)) * (1 + 1e-6)
                kth = np.array([s[k - 1] if len(s) >= k else -np.inf for _, s in found])
                some = np.flatnonzero(reach >= kth)
                if forest:
                    starts, ends = forest.ranges(codes[some])
                    band_units, scale = units[mine] if len(bands) > 1 else units, np.exp2(length[mine] - longest).astype(np.float32)
                for n, i in enumerate(some.tolist()):
                    chosen = mine
                    if forest:
                        # in units of the band's longest vector times the query's length
                        least = found[i][1][wanted - 1] / reach[i] if len(found[i][1]) >= wanted else -1.0

                        def score(r, q=q_units[i], u=band_units, x=scale):
                            c = u[r] @ q
                            return c * x[r], c

                        met, told = forest.search(starts[n], ends[n], score, wanted + 1, least, miss)  # (one more: the query itself may lie here)
                        chosen = mine[met]
                        depth[i] = min(depth[i], told)
                    scored[i] += len(chosen)
                    sizes = first[chosen + 1] - first[chosen]
                    row = np.repeat(chosen, sizes)
                    of = ids[np.repeat(first[chosen] - np.cumsum(sizes) + sizes, sizes) + np.arange(len(row))]
                    own = of != who[i]
                    if not own.all():
                        of, row = of[own], row[own]
                    got, s = best(of, vectors, row, asked[i], k)
                    found[i] = merged([found[i], (got, s)], k) if len(found[i][0]) else (got, s)
            sizes = [len(x) for x, _ in found]
            counted = np.zeros(sum(sizes), np.int64)  # once for each query
            firsts = np.cumsum(sizes) - sizes
            counted[firsts[np.array(sizes) > 0]] = scored[np.array(sizes) > 0]
            out.append([np.repeat(who, sizes), np.concatenate([x for x, _ in found]), np.concatenate([s for _, s in found]), counted, np.repeat(depth, sizes)])
        return pa.table([pa.array(np.concatenate([o[i] for o in out])) for i in range(5)], names=names)

    return lean(f)


def _pack(kind: str):
    def f(batches):
        for batch in batches:
            array = as_array(batch["_vec"])
            v = np.asarray(array.flatten().to_numpy(zero_copy_only=False), kind)
            ends = np.concatenate([[0], np.cumsum(np.asarray(batch["dim"]))])
            packed = [v[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch["_id"], batch["dim"], pa.array(packed, pa.binary())], ["_id", "dim", "vec"])

    return f


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", trees: int = TREES, miss: float = MISS, whole: int = WHOLE, block_bytes: int = BLOCK_BYTES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank from 1, vec_id, score, n_scored, shortest_prefix): for each row of queries, the k rows of vectors found nearest by inner product.

    Both tables have an integer id and an array of numbers, doubles kept as doubles.  A query's own id is
    no candidate; ties go to the smaller id; an id that repeats counts once, with its best score, among
    queries too.  Vectors that are null, zero, or hold a null or a non-finite
    component, and rows with a null id take no part; vectors are compared with those of their own length
    only.  Fewer candidates than k give fewer rows; empty tables give none.  n_scored: distinct vectors
    scored for the query; shortest_prefix: symbols that all rows met share with it in some tree (0: a band was searched to its
    roots; all symbols: bands of few rows only).
    """
    spark = vectors.sparkSession
    element = vectors.schema[vec_col].dataType.elementType.simpleString()
    kind = "<f4" if element == "float" else "<f8"
    width = 4 if element == "float" else 8

    def usable(df: DataFrame) -> DataFrame:
        v = F.col(vec_col).cast("array<float>" if element == "float" else "array<double>")
        rows = df.select(F.col(id_col).cast("long").alias("_id"), v.alias("_vec"))
        finite = F.forall("_vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        rows = rows.where(F.col("_id").isNotNull() & F.col("_vec").isNotNull()).where(finite & F.exists("_vec", lambda x: x != 0))
        return rows.select("_id", F.size("_vec").alias("dim"), "_vec").mapInArrow(_pack(kind), "_id long, dim int, vec binary")

    size = vectors.agg(F.count("*").alias("n"), F.sum(F.when(F.size(vec_col) > 0, F.size(vec_col))).alias("numbers")).first()
    parallel = min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size["n"] // block_rows))
    blocks = max(1, parallel, -(-(size["numbers"] or 0) * width // block_bytes))
    asked = usable(queries).distinct()
    turns = max(1, -(-(queries.agg(F.sum(F.when(F.size(vec_col) > 0, F.size(vec_col)))).first()[0] or 0) * width // QUERY_BYTES))
    # (the row's number spreads rows that are equal in id and vector)
    stored = usable(vectors).withColumn("block", F.pmod(F.xxhash64("_id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))
    stored = stored.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))) if turns > 1 else F.lit(0))
    asked = asked.select(F.col("_id").alias("q"), "dim", "vec", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("_id"), F.lit(turns)).cast("int").alias("turn"))
    of = ["dim", "block", "turn"]
    found = stored.groupBy(*of).cogroup(asked.groupBy(*of)).applyInArrow(_search(k, share_of(k, blocks), trees, miss, whole, kind), "query_id long, vec_id long, score double, scored long, depth int")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.sum("scored").alias("scored"), F.min("depth").alias("depth"))
    w = Window.partitionBy("query_id")
    ranked = once.withColumn("n_scored", F.sum("scored").over(w)).withColumn("shortest_prefix", F.min("depth").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "vec_id")).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "n_scored", "shortest_prefix")

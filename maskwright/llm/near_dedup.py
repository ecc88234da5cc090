"""Near-duplicate groups by min-max hashing, confirmed on full shingle sets.

Under each permutation both the smallest and the largest value of a document's shingles are kept, so
64 evaluations a shingle give 128 signature values, each equal between two sets with probability J.
Bands of 4 values (minimum and maximum of two permutations): two sets of similarity 0.8 meet in none
of 32 bands with probability (1 - 0.8^4)^32 = 5e-8.

Documents with equal sets first become one class (an aggregate, whatever the size of the group); only
class representatives are banded.  For those that share a bucket, private shingles (in no other such
document) are told from the rest, and the rest is counted in GROUPS groups by hash: two documents have
at most the sum of the smaller counts in common, which rules out most pairs of differently edited
copies, and its private share alone rules out many a document.

Within a bucket, members are compared with pivots, never all with all.  At first each document is
compared with that of its buckets' members that has the smallest private share; that contracts most
groups.  Every later round takes, in each bucket that still holds two components, members outside its
largest component as pivots (at most PIVOTS), joins them with the members of other components that
the bound allows (a pair in the first bucket that it shares, only), confirms on full sets, contracts,
and takes the pivots, which have now been compared with everyone, out of the bucket.  A large bucket's
members are dealt to parts of about SALTED, each of which gets the bucket's pivots, and the join is cut into
tasks by the number of pairs.  Rounds go on until each bucket holds one component: no link in a bucket is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .scratch import Scratch
from .substring_dedup import elsewhere, known_elsewhere
from .words import Words, as_array, claim, lean, lean_stream, mix, row_slices

PERMUTATIONS, BANDS, ROWS = 64, 32, 4
#: Shingle hashes are kept with so many bytes for the comparison of two sets; two sets of 500 shingles agree in one by chance with probability 1e-9.
KEPT = 6
#: Rows up to which ids are broadcast (8 bytes each); beyond, they are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: A set that more than one in so many rows has is looked up where its rows are.
HOT = 1000
#: Pivots of a bucket in a round.
PIVOTS = 1024
#: Members of a bucket that meet its pivots in one place, and pairs that a task is to look at, about.
SALTED, PAIRS = 512, 4_000_000
#: Groups in which a document's shared shingles are counted.
GROUPS = 32
#: Bytes of kept shingles in a block when private ones are counted.
BLOCK_BYTES = 8 << 20

_rng = np.random.default_rng(41)
_A = _rng.integers(1, 2**63, size=PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, size=PERMUTATIONS, dtype=np.uint64)
_BAND = _rng.integers(1, 2**63, size=(BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(text: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, one after another, and the rows' offsets."""
    w = Words(text, lower=True)
    starts, h = w.windows(w.hashes(), k, short=True)
    bounds = np.searchsorted(starts, w.first)
    sets = [np.unique(h[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return (np.concatenate(sets) if sets else np.empty(0, np.uint64)), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def signatures(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, 2 * PERMUTATIONS): minimum and maximum under each permutation; rows must not be empty."""
    out = np.empty((len(offsets) - 1, 2 * PERMUTATIONS), np.uint64)
    for i in range(PERMUTATIONS):
        v = values * _A[i] + _B[i]
        out[:, 2 * i] = np.minimum.reduceat(v, offsets[:-1])
        out[:, 2 * i + 1] = np.maximum.reduceat(v, offsets[:-1])
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """(rows, BANDS) hashes that tell the bands apart too."""
    s = mix(signature).reshape(len(signature), BANDS, ROWS)
    return mix((s * _BAND).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def _features(k: int):
    names = ["_id", "n", "d1", "d2", "bands", "shingles"]

    def f(batches):
        claim("near duplicates")
        for batch in batches:
            text = as_array(batch["_text"])
            for lo, hi in row_slices(text, 2 << 20):
                values, off = shingle_sets(text[lo:hi], k)
                n = np.diff(off)
                full = np.flatnonzero(n)
                d1, d2 = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64)
                keys = np.empty((0, BANDS), np.int64)
                if len(full):
                    at = off[:-1][full]
                    d1[full] = np.add.reduceat(mix(values), at).view(np.int64)
                    d2[full] = np.add.reduceat(mix(values ^ np.uint64(0xA5A5A5A55A5A5A5A)), at).view(np.int64)
                    keys = band_keys(signatures(values, np.append(at, off[-1]))).view(np.int64)
                low = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - KEPT :])  # the high bytes, still ascending
                blob = pa.LargeBinaryArray.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(off * KEPT), pa.py_buffer(low)]).cast(pa.binary())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]), pa.int32()), pa.array(keys.reshape(-1), pa.int64()))
                yield pa.RecordBatch.from_arrays([batch["_id"][lo:hi], pa.array(n, pa.int64()), pa.array(d1), pa.array(d2), lists, blob], names)

    return lean_stream(f)


def _block_values(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(x.as_py()) // KEPT for x in table["shingles"]], np.int64)
    values = np.concatenate([_kept(x.as_py()) for x in table["shingles"]]) << np.uint64(64 - 8 * KEPT)
    return values, np.repeat(np.arange(len(sizes)), sizes), sizes


@lean
def _private(left: pa.Table, right: pa.Table) -> pa.Table:
    values, row, sizes = _block_values(left)
    distinct, at, count = np.unique(values, return_inverse=True, return_counts=True)
    alone = ~(known_elsewhere(distinct, right) | (count > 1))[at]
    group = (values >> np.uint64(64 - 8 * KEPT)) % np.uint64(GROUPS)
    counts = np.bincount((row * GROUPS + group.astype(np.int64))[~alone], minlength=len(sizes) * GROUPS)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * GROUPS, pa.int32()), pa.array(counts, pa.int32()))
    return pa.table([left["doc"], pa.array(np.bincount(row[alone], minlength=len(sizes)), pa.int64()), lists], names=["doc", "private", "shared"])


def _kept(blob: bytes) -> np.ndarray:
    wide = np.zeros((len(blob) // KEPT, 8), np.uint8)
    wide[:, :KEPT] = np.frombuffer(blob, np.uint8).reshape(-1, KEPT)
    return wide.view("<u8").reshape(-1)


def _confirm(percent: int):
    def f(batches):
        for batch in batches:
            na, nb = batch["na"].to_pylist(), batch["nb"].to_pylist()
            ok = []
            for i, (x, y) in enumerate(zip(batch["sa"], batch["sb"], strict=True)):
                u, v = _kept(x.as_py()), _kept(y.as_py())
                if len(u) > len(v):
                    u, v = v, u
                at = np.searchsorted(v, u)
                both = int((v[np.minimum(at, len(v) - 1)] == u).sum())
                ok.append(100 * both >= percent * (na[i] + nb[i] - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in (batch["a"], batch["b"])], ["a", "b"])

    return lean_stream(f)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """Per row of docs: id, n_shingles (size of its set), component_id and kept (its id is the component's).

    A row's set: its distinct shingles of so many lower-cased (A-Z) words; of fewer words, the whole
    sequence; none for null texts and texts without words, which are linked with nothing.  Rows are
    linked if 100 * |both| >= percent * |either|; component_id is the smallest id reachable.  Equal
    rows each stay a row and share their component; a row with a null id is linked with nothing, has a
    null component and is kept; an empty table gives an empty result; other columns are not looked at.
    Ids must be integers.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    made = rows.mapInArrow(_features(shingle), "_id long, n long, d1 long, d2 long, bands array<long>, shingles binary")
    made = scratch.save(made.withColumn("rid", F.monotonically_increasing_id()), "features")
    some = made.where("n > 0 and _id is not null")
    heads = some.groupBy("d1", "d2", "n").agg(F.min(F.struct("_id", "rid")).alias("head"), F.count("*").alias("copies"))
    classes = scratch.save(heads.select("d1", "d2", "n", F.col("head._id").alias("id"), F.col("head.rid").alias("doc"), "copies"), "classes")
    banded = made.select(F.col("rid").alias("doc"), "bands").join(classes.select("doc", "n"), "doc")
    banded = banded.select("doc", "n", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("members"), F.min("doc").alias("first")).where("members > 1")
    inside = scratch.save(banded.join(shared.select("key", "first"), "key"), "buckets")

    wanted = scratch.save(inside.select("doc").distinct(), "wanted")
    n_wanted = wanted.count()
    wanted = F.broadcast(wanted) if n_wanted <= BROADCAST_IDS else wanted
    sets = scratch.save(made.select(F.col("rid").alias("doc"), "n", "shingles").join(wanted, "doc", "left_semi"), "sets")
    total = sets.agg(F.sum(F.octet_length("shingles"))).first()[0] or 0
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BLOCK_BYTES))
    dealt = sets.select("doc", "shingles", F.pmod(F.xxhash64("doc"), F.lit(blocks)).cast("int").alias("block"))
    answers = elsewhere(dealt, "block", lambda table: np.unique(_block_values(table)[0]), total * 8 // KEPT)
    private = scratch.save(dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_private, "doc long, private long, shared array<int>"), "private")
    able = inside.select("key", "doc", "n").join(private.select("doc", "private"), "doc").where(f"100 * (n - private) >= {percent} * n")
    held = able.groupBy("key").agg(F.count("*").alias("members"), F.min(F.struct((F.col("private") / F.col("n")).alias("share"), "doc")).alias("first")).where("members > 1")
    inside = scratch.save(able.select("key", "doc", "n").join(held.select("key", "first"), "key"), "able")
    own = inside.groupBy("doc", "n").agg(F.sort_array(F.collect_list("key")).alias("keys"), F.min("first").alias("first"))  # BANDS keys at most
    facts = scratch.save(own.join(private, "doc"), "facts")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        a = sets.select(F.col("doc").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
        b = sets.select(F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
        both = pairs.join(a, "a").join(b, "b").where(f"100 * na >= {percent} * nb and 100 * nb >= {percent} * na")
        return scratch.save(both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_confirm(percent), "a long, b long"), name)

    nearest = facts.select(F.col("doc").alias("a"), F.col("first.doc").alias("b")).where("a <> b")
    labels = scratch.save(components(confirmed(nearest, "links"), scratch), "labels")
    left, turn = inside.select("key", "doc"), 0
    common = " + ".join(f"least(shared[{i}], p.shared[{i}])" for i in range(GROUPS))
    while True:
        turn += 1
        told = left.join(labels, left.doc == labels.node, "left").select("key", "doc", F.coalesce("component", "doc").alias("comp"))
        # sizes of a bucket's components; one alone: the bucket is done
        sizes = told.groupBy("key", "comp").agg(F.count("*").alias("size"))
        most = sizes.groupBy("key").agg(F.max(F.struct("size", "comp")).alias("top"), F.sum("size").alias("all"), F.count("*").alias("comps")).where("comps > 1")
        most = most.select("key", F.col("top.comp").alias("top"), F.expr(f"ceil((all - top.size) / {PIVOTS})").cast("long").alias("turns"), F.expr(f"ceil(all / {SALTED})").cast("int").alias("parts"), F.expr(f"all * least(all - top.size, {PIVOTS})").alias("work"))
        most = scratch.save(most, "most")
        work = most.agg(F.sum("work")).first()[0]
        if not work:
            break
        left = scratch.save(told.join(most.drop("work"), "key"), "open")
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-work // PAIRS))
        is_pivot = (F.col("comp") != F.col("top")) & (F.pmod(F.xxhash64("doc", F.lit(turn)), F.col("turns")) == 0)
        wide = left.join(facts.select("doc", "n", "shared", "keys"), "doc")
        pivots = wide.where(is_pivot).select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.struct("doc", "comp", "n", "shared", "keys").alias("p")).repartition(tasks, "key", "part")
        members = wide.withColumn("part", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int")).repartition(tasks, "key", "part")
        bound = f"comp <> p.comp and 100 * ({common}) >= {percent} * (n + p.n - ({common})) and key = array_intersect(keys, p.keys)[0]"
        pairs = members.join(pivots, ["key", "part"]).where(bound).select(F.greatest("doc", "p.doc").alias("a"), F.least("doc", "p.doc").alias("b")).distinct()
        links = confirmed(scratch.save(pairs, "pairs"), "more")
        # what the new links join: components of components
        named = links.join(labels.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(labels.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
        joined = scratch.save(components(named.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")), scratch), "joined")
        moved = labels.join(joined.select(F.col("node").alias("old"), F.col("component").alias("new")), F.col("component") == F.col("old"), "left")
        fresh = joined.join(labels.select(F.col("node").alias("seen")), F.col("node") == F.col("seen"), "left_anti").select("node", "component")
        labels = scratch.save(moved.select("node", F.coalesce("new", "component").alias("component")).union(fresh), "labels")
        left = left.where(~is_pivot).select("key", "doc")

    named = classes.join(labels, F.col("doc") == F.col("node"), "left").select("d1", "d2", "n", "id", "copies", F.coalesce("component", "doc").alias("comp"))
    smallest = named.groupBy("comp").agg(F.min("id").alias("component_id"))
    named = scratch.save(named.join(smallest, "comp").select("d1", "d2", "n", "copies", "component_id"), "named")
    # sets that more than one in HOT rows has are fewer than HOT; their many rows stay where they are
    least = some.count() / HOT
    hot = F.broadcast(named.where(F.col("copies") > least).drop("copies"))
    every, key = made.select("_id", "n", "d1", "d2"), ["d1", "d2", "n"]
    mine = every.where("n > 0 and _id is not null")
    rest = mine.join(hot, key, "left_anti").join(named.where(F.col("copies") <= least).drop("copies"), key)
    told = mine.join(hot, key).unionByName(rest).unionByName(every.where("n = 0 or _id is null").withColumn("component_id", F.lit(None).cast("long")))
    own = F.when(F.col("_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component_id", "_id"))
    out = told.select("_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
    return out.select(F.col("_id").cast(docs.schema[id_col].dataType).alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("_id") == F.col("component_id"), F.lit(True)).alias("kept"))

"""Connected components of a table of links, by alternating large-star and small-star steps.

Up to LOCAL_LINKS links (16 bytes each), one task joins them in memory instead; results are the same.
Each step is two shuffles of the links; a node of any degree is aggregated with partial aggregates and
joined (AQE splits a hot side), so no task ever holds the neighbours of a node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Links that one task may hold.
LOCAL_LINKS = 1_000_000


def _joined(batches):
    """(node, component) of all links of the one partition."""
    import numpy as np
    import pyarrow as pa

    both = [np.stack([b["a"].to_numpy(), b["b"].to_numpy()]) for b in batches]
    ends = np.concatenate(both, axis=1) if both else np.empty((2, 0), np.int64)
    nodes, at = np.unique(ends, return_inverse=True)
    up = np.arange(len(nodes))
    a, b = at.reshape(2, -1)
    while True:  # numbers ascend as the ids do: the smallest number is the smallest id
        low = np.minimum(up[a], up[b])
        new = up.copy()
        np.minimum.at(new, up[a], low)
        np.minimum.at(new, up[b], low)
        new = new[new]
        if (new == up).all():
            break
        up = new
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(nodes[up], pa.int64())], ["node", "component"])


def _star(out_of: DataFrame, everyone: bool) -> DataFrame:
    """out_of: (a, b) as directed from a. Every neighbour of a that is larger (everyone: False, any) is tied to a's smallest."""
    low = out_of.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    tied = out_of.join(low, "a")
    if everyone:
        return tied.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.where("a <> m").select("a", F.col("m").alias("b"))).distinct()
    return tied.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first())


def components(links: DataFrame, scratch: Scratch, a: str = "a", b: str = "b", local_links: int = LOCAL_LINKS) -> DataFrame:
    """(node, component) for every node of links (two long columns); component: its smallest reachable node.

    Loops and repeated links change nothing; rows with a null end are no links; no links, no rows.
    """
    edges = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(f"{a} is not null and {b} is not null and a <> b").distinct()
    edges = scratch.save(edges, "links")
    mark = _mark(edges)
    if mark[0] <= local_links:
        return edges.coalesce(1).mapInArrow(_joined, "node long, component long")
    while mark[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = scratch.save(_star(both, False), "large")
        edges = scratch.save(_star(large, True), "small")
        before, mark = mark, _mark(edges)
        if before == mark:
            break
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

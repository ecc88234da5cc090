"""Joins on places and order: intervals, the last thing before, the longest prefix, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap_join(left: DataFrame, right: DataFrame, by: list[str], l_start: str, l_end: str, r_start: str, r_end: str, width: int) -> DataFrame:
    """Pairs of rows with equal `by` whose half-open intervals overlap.

    Both sides are cut into the cells of `width` that they touch and joined on the cell; a pair counts in
    the later of the two first cells only, so none is made twice.  Empty intervals overlap nothing.
    """
    cells = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.col(e) - 1) / width)))
    lf = left.where(F.col(l_start) < F.col(l_end)).withColumn("_cell", cells(l_start, l_end))
    rt = right.where(F.col(r_start) < F.col(r_end)).withColumn("_cell", cells(r_start, r_end))
    hit = (F.col(l_start) < F.col(r_end)) & (F.col(r_start) < F.col(l_end))
    first = F.col("_cell") == F.floor(F.greatest(F.col(l_start), F.col(r_start)) / width)
    return lf.join(rt, [*by, "_cell"]).where(hit & first).drop("_cell")


def uncovered(spans: DataFrame, cover: DataFrame, by: list[str], width: int = 1024) -> DataFrame:
    """The rows of spans (by, start, end) that no row of cover (by, start, end) overlaps."""
    c = cover.select(*by, F.col("start").alias("_s"), F.col("end").alias("_e"))
    hit = overlap_join(spans.select(*by, "start", "end").distinct(), c, by, "start", "end", "_s", "_e", width).select(*by, "start", "end").distinct()
    return spans.join(hit, [*by, "start", "end"], "left_anti")


def last_before(rows: DataFrame, by: list[str], order: list[Column], is_mark: Column, value: Column, name: str) -> DataFrame:
    """rows with the value of the last mark at or before each, in order; null where none stands before."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(F.when(is_mark, value), ignorenulls=True).over(w))


def longest_prefix(paths: DataFrame, prefixes: DataFrame, path_col: str = "path", prefix_col: str = "prefix", separator: str = "/") -> DataFrame:
    """paths left joined with the row of prefixes that is the longest whole-segment prefix of each.

    A path is cut into its own prefixes, so the join is on equality; paths without any keep nulls.
    Equal prefixes must not repeat.
    """
    p = F.col(path_col)
    parts = F.split(p, f"\\Q{separator}\\E", -1)
    cuts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), separator))
    many = paths.select(path_col).distinct().select(path_col, F.explode(cuts).alias("_cut"))
    told = many.join(prefixes.withColumn("_cut", F.rtrim(F.col(prefix_col), F.lit(separator))), "_cut")
    w = Window.partitionBy(path_col).orderBy(F.desc(F.length("_cut")))
    best = told.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_cut")
    return paths.join(best, path_col, "left")


def snapshot(files: DataFrame) -> DataFrame:
    """(path, digest) of binaryFile rows."""
    return files.select("path", F.sha2("content", 256).alias("digest"))


def changes(before: DataFrame, after: DataFrame, key: str = "path", digest: str = "digest") -> DataFrame:
    """(key, how): added, removed or changed between two snapshots; what is equal has no row."""
    b, a = before.select(key, F.col(digest).alias("_b")), after.select(key, F.col(digest).alias("_a"))
    how = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")
    return b.join(a, key, "full_outer").select(key, how.alias("how")).where(F.col("how").isNotNull())

"""Running values over one long order: ranges of rows in parallel, then what each range carries to the next.

Rows are dealt to ranges of (by, order), so that a key with most of the rows is many ranges, and written.  Within a
range values run by a window; a row for each (range, key) says what the range adds, and runs over ranges, which are
few.  Rows equal in (by, order) lie in one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.held import hold


def ranged(rows: DataFrame, by: list[str], order: list[Column], ranges: int | None = None) -> DataFrame:
    """rows with _range, ascending in (by, order); as many ranges as shuffles have partitions."""
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return hold(rows.repartitionByRange(n, *by, *order).withColumn("_range", F.spark_partition_id()))


def _earlier(by: list[str]):
    return Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)


def _met(rows: DataFrame, carried: DataFrame, by: list[str]) -> DataFrame:
    """rows with what their range and key carry; a null key is a key."""
    on = [F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in (*by, "_range")]
    both = on[0]
    for x in on[1:]:
        both &= x
    added = [F.col(f"c.{c}") for c in carried.columns if c not in (*by, "_range")]
    return rows.alias("r").join(carried.alias("c"), both).select("r.*", *added)


def running_sums(rows: DataFrame, by: list[str], order: list[Column], values: dict[str, Column], ranges: int | None = None) -> DataFrame:
    """rows with, for each name of values, the sum of its values up to and with each row of its key.  The order must be strict; nulls add nothing."""
    names = {n: f"_v{i}" for i, n in enumerate(values)}
    held = ranged(rows.select("*", *(F.coalesce(v, F.lit(0)).alias(names[n]) for n, v in values.items())), by, order, ranges)
    sums = held.groupBy(*by, "_range").agg(*(F.sum(c).alias(c) for c in names.values()))
    carried = sums.select(*by, "_range", *(F.coalesce(F.sum(c).over(_earlier(by)), F.lit(0)).alias(f"{c}_before") for c in names.values()))
    within = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = held.select("*", *(F.sum(c).over(within).alias(f"{c}_here") for c in names.values()))
    return _met(local, carried, by).select(*rows.columns, *((F.col(f"{c}_here") + F.col(f"{c}_before")).alias(n) for n, c in names.items()))


def last_marked(rows: DataFrame, by: list[str], order: list[Column], mark: Column, value: Column, name: str, ranges: int | None = None) -> DataFrame:
    """rows with the value of the last marked row at or before each of its key, null before any; the order must be strict."""
    told = F.when(mark, F.struct(value.alias("value")))
    held = ranged(rows.select("*", told.alias("_mark")), by, order, ranges)
    place = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order))
    within = Window.partitionBy(*by, "_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    local = held.withColumn("_place", place)
    ends = local.groupBy(*by, "_range").agg(F.max_by("_mark", F.when(F.col("_mark").isNotNull(), F.col("_place"))).alias("_end"))
    carried = ends.select(*by, "_range", F.last("_end", ignorenulls=True).over(_earlier(by)).alias("_before"))
    here = F.last("_mark", ignorenulls=True).over(within)
    return _met(local.withColumn("_here", here), carried, by).select(*rows.columns, F.coalesce("_here", "_before")["value"].alias(name))

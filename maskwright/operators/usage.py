"""What tasks cost: usage as providers report it, prices by the longest known model id, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WRITE_5M, WRITE_1H = 1.25, 2.0
#: Fields of a request's usage.
COUNTS = ("input", "write_5m", "write_1h", "read", "output")


def price_of(models: DataFrame, prices: DataFrame) -> DataFrame:
    """(model, price_id, input_price, output_price, read_price): the longest id that is the model or that it goes on from with - or [.

    models: model; prices: model, input, output, read (per million).  Every candidate prefix of a model
    that ends before - or [ (or is the whole) is an equality, so this is no prefix scan; no match, no row.
    """
    m = F.col("model")
    ends = F.filter(F.sequence(F.lit(1), F.length(m)), lambda i: (i == F.length(m)) | F.substr(m, i + 1, F.lit(1)).isin("-", "["))
    cuts = models.select("model").distinct().select("model", F.explode(F.transform(ends, lambda i: F.substr(m, F.lit(1), i))).alias("price_id"))
    known = prices.select(F.col("model").alias("price_id"), F.col("input").alias("input_price"), F.col("output").alias("output_price"), F.col("read").alias("read_price"))
    w = Window.partitionBy("model").orderBy(F.desc(F.length("price_id")))
    return cuts.join(known, "price_id").withColumn("_n", F.row_number().over(w)).where("_n = 1").select("model", "price_id", "input_price", "output_price", "read_price")


def _n(c: Column) -> Column:
    """A count: a positive whole number, else 0."""
    return F.greatest(F.coalesce(c.cast("long"), F.lit(0)), F.lit(0))


def from_messages(usage: Column) -> Column:
    """Counts of a usage struct (input_tokens, cache_creation_input_tokens, cache_read_input_tokens, output_tokens, cache_creation)."""
    split = usage["cache_creation"]
    written, long = _n(usage["cache_creation_input_tokens"]), F.when(split.isNotNull(), _n(split["ephemeral_1h_input_tokens"])).otherwise(0)
    short = F.when(split.isNotNull(), _n(split["ephemeral_5m_input_tokens"])).otherwise(written)
    short = F.when(split.isNotNull() & (short + long < written), written - long).otherwise(short)
    return F.struct(_n(usage["input_tokens"]).alias("input"), short.alias("write_5m"), long.alias("write_1h"), _n(usage["cache_read_input_tokens"]).alias("read"), _n(usage["output_tokens"]).alias("output"))


def from_responses(usage: Column) -> Column:
    """Counts of a usage struct whose input holds the cached part (input_tokens, input_tokens_details, output_tokens)."""
    total = _n(usage["input_tokens"])
    cached = F.least(_n(usage["input_tokens_details"]["cached_tokens"]), total)
    zero = F.lit(0).cast("long")
    return F.struct((total - cached).alias("input"), zero.alias("write_5m"), zero.alias("write_1h"), cached.alias("read"), _n(usage["output_tokens"]).alias("output"))


def totals(requests: DataFrame, by: str = "task_id") -> DataFrame:
    """Requests, models and counts of each task."""
    return requests.groupBy(by).agg(F.count("*").alias("requests"), F.array_sort(F.collect_set(F.when(F.col("model") != "", F.col("model")))).alias("models"), *(F.sum(c).alias(c) for c in COUNTS))


def task_cost(requests: DataFrame, prices: DataFrame, by: str = "task_id") -> DataFrame:
    """totals with usd, usd_without_cache and saved_usd, to four places; null where a model of the task has no price."""
    priced = requests.join(price_of(requests, prices), "model", "left")
    pin, pout, pread = F.col("input_price"), F.col("output_price"), F.col("read_price")
    cost = (F.col("input") * pin + F.col("write_5m") * pin * WRITE_5M + F.col("write_1h") * pin * WRITE_1H + F.col("read") * pread + F.col("output") * pout) / 1e6
    plain = ((F.col("input") + F.col("write_5m") + F.col("write_1h") + F.col("read")) * pin + F.col("output") * pout) / 1e6
    sums = priced.groupBy(by).agg(F.sum(cost).alias("_with"), F.sum(plain).alias("_without"), F.bool_and(pin.isNotNull()).alias("_all"))
    shown = lambda c: F.when(F.col("_all"), F.round(c, 4))
    out = totals(requests, by).join(sums, by)
    return out.select(by, "requests", "models", *COUNTS, shown(F.col("_with")).alias("usd"), shown(F.col("_without")).alias("usd_without_cache"), shown(F.col("_without") - F.col("_with")).alias("saved_usd"))

"""The one way out: what may cross, what is refused, and the record of each crossing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C

# Sensitivities in order; the first two may leave.
SENSITIVITIES = ("public", "internal", "confidential", "restricted")


def label(sensitivity: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SENSITIVITIES)), sensitivity.cast("int") + 1)


def cross(payloads: DataFrame, target: str, action: str = "send", actor_col: str = "actor_id", sensitivity_col: str = "sensitivity", text_col: str = "text", at: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(allowed, refused, audit) of redacted payloads with their entity_types and redacted_count.

    Refusal comes before anything else is looked at; the audit holds what crossed as a hash, never as text.
    """
    ok = C.may_cross(F.col(sensitivity_col))
    allowed, refused = payloads.where(ok), payloads.where(~ok)
    detail = F.struct(F.lit(target).alias("target"), F.col("entity_types"), F.col("redacted_count").cast("int").alias("redacted_count"))
    audit = allowed.select(
        (F.current_timestamp() if at is None else at).alias("at"), F.col(actor_col).cast("string").alias("actor_id"), F.lit(action).alias("action"), F.lit("privacy.cross").alias("resource_type"),
        F.lit("cloud").alias("plane"), label(F.col(sensitivity_col)).alias("sensitivity"), C.content_hash(F.col(text_col)).alias("content_hash"), detail.alias("detail"),
    )
    return allowed, refused, audit


def must_cross(payloads: DataFrame, sensitivity_col: str = "sensitivity") -> DataFrame:
    """payloads, failing the job if any of them may not cross."""
    guard = F.when(C.may_cross(F.col(sensitivity_col)), F.lit(True)).otherwise(F.raise_error(F.lit("a payload may not cross: its sensitivity is too high")).cast("boolean"))
    return payloads.where(guard)


def check_crossings(audit: DataFrame, sent: DataFrame, residual: DataFrame) -> DataFrame:
    """Each crossing (id, content_hash) with what was sent (id, text) and what of the vault still stands in it (id, found)."""
    found = F.coalesce("found", F.array().cast("array<string>"))
    out = audit.join(sent, "id", "left").join(residual.select("id", "found"), "id", "left")
    return out.withColumn("sha256_matches", F.coalesce(F.col("content_hash") == C.content_hash(F.col("text")), F.lit(False))).withColumn("found", found).withColumn("clean", F.size("found") == 0)


def observed(payloads: DataFrame, name: str) -> tuple[DataFrame, object]:
    """(payloads, observation): how many cross, what they hide and how sensitive they are, counted as they pass, without another job."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return payloads.observe(seen, F.count("*").alias("n"), F.sum("redacted_count").alias("redacted"), F.max("sensitivity").alias("most_sensitive")), seen

"""Restores that may no longer be handed out: what the model wrote in clear before the value was enrolled.

Beside the table of restores lies its index, the hashed words and word pairs of each entry, which is added to as
entries are.  When a vault grows, the tokens that are new look their entries up there, and only these are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.vault import Vault
from ..sources.held import hold
from . import filed


def restore_index(restores: DataFrame) -> DataFrame:
    """(at, unit) of restores (scope_id, key, value): what each value may be found by; to be appended to those of earlier entries."""
    return filed.units_of(_placed(restores))


def _placed(restores: DataFrame) -> DataFrame:
    known = restores.where("scope_id is not null and value is not null")
    return known.select("scope_id", F.col("value").alias("text")).withColumn("at", filed.place(F.col("scope_id"), F.col("text")))


def withdrawn(restores: DataFrame, index: DataFrame, tokens: DataFrame, aliases: DataFrame) -> DataFrame:
    """(scope_id, key, shown): the restores that show a value of these tokens, which are new, and which values.

    Entries without a scope or a value show none.  aliases: those of the tokens, or just the new ones.
    """
    texts = restores.where("scope_id is not null and value is not null").withColumn("_at", filed.place(F.col("scope_id"), F.col("value")))
    vault = hold(filed.whole(tokens, aliases))
    named = hold(filed.candidates(_placed(restores), vault, index))
    looked = texts.join(named.select(F.col("at").alias("_at")).distinct(), "_at", "left_semi")

    def f(rows: list[dict], v: Vault) -> list[dict]:
        found = [(r, v.residual(r["text"])) for r in rows]
        return [{"scope_id": r["scope_id"], "value": r["text"], "shown": shown} for r, shown in found if shown]

    shown = filed.meet_candidates(looked.select(F.lit(0).cast("long").alias("doc_id"), "scope_id", F.col("value").alias("text"), F.col("_at").alias("at")).distinct(), named, vault, f, "scope_id string, value string, shown array<string>")
    return looked.join(shown, ["scope_id", "value"]).select("scope_id", "key", "shown")


def safe_restores(restores: DataFrame, gone: DataFrame) -> DataFrame:
    """The restores that are still handed out; the others go as tokenised."""
    return restores.join(gone.select("scope_id", "key"), ["scope_id", "key"], "left_anti")

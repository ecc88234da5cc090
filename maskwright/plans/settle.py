"""What texts add to vaults, until they add nothing: semi-naive rounds over tables.

A definition that one text makes may be used by another to make the next, so texts are recalled again until no vault
grows.  A round after the first looks only at texts that may name a token which the last one touched: what a text adds
depends on the tokens it names, and on their names, only.  (Hyphens are also read away there, as domains are recalled
by their labels without them.)  Each round is written; only scopes that grew are enrolled again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.held import hold
from . import enrol, filed


def _touched(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    return after.join(before.select(*keys), keys, "left_anti").select("scope_id", "token")


def _again(docs: DataFrame, tokens: DataFrame, aliases: DataFrame, touched: DataFrame) -> DataFrame:
    """The texts that may name a touched token."""
    some = (df.join(touched, ["scope_id", "token"], "left_semi") for df in (tokens, aliases))
    read = F.concat("text", F.lit(" "), F.replace("text", F.lit("-"), F.lit("")))
    base = docs.select("scope_id", read.alias("text")).withColumn("at", filed.place(F.col("scope_id"), F.col("text")))
    named = filed.candidates(base, hold(filed.whole(*some))).select("at").distinct()
    return docs.withColumn("at", filed.place(F.col("scope_id"), read)).join(named, "at", "left_semi").drop("at")


def settle(docs: DataFrame, tokens: DataFrame, aliases: DataFrame, salts: DataFrame | None = None, id_col: str = "doc_id", scope_col: str = "source", text_col: str = "text") -> tuple[DataFrame, DataFrame, list[dict[str, int]]]:
    """(tokens, aliases, rounds) when no text adds to its scope's vault; rounds: the texts looked at and the tokens touched in each.

    Null texts and texts without a scope add nothing.  The last round touches none.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(scope_col).alias("scope_id"), F.col(text_col).alias("text")).where("scope_id is not null and text is not null")
    tokens, aliases = hold(tokens), hold(aliases)
    look, rounds = docs, []
    while True:
        found = hold(enrol.recall(look, tokens, aliases, salts, "doc_id", "scope_id", "text"))
        n_looked = look.count()
        grew = found.select("scope_id").distinct()
        old = (tokens, aliases)
        some = [df.join(grew, "scope_id", "left_semi") for df in old]
        new = enrol.enrol(*some, salts=None if salts is None else salts.join(grew, "scope_id", "left_semi"), recalled=found)
        rest = [df.join(grew, "scope_id", "left_anti") for df in old]
        tokens, aliases = (hold(a.select(*r.columns).unionByName(r)) for a, r in zip(new, rest, strict=True))
        touched = hold(_touched(old[0], tokens, ["scope_id", "token"]).unionByName(_touched(old[1], aliases, ["scope_id", "token", "surface"])).distinct())
        rounds.append({"texts": n_looked, "touched": touched.count()})
        if not rounds[-1]["touched"]:
            return tokens, aliases, rounds
        look = hold(_again(docs, tokens, aliases, touched))

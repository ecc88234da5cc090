"""The distinct people of scopes of any size, as joins: no scope is one group, one task or one Python object.

Of names that may be one person's, the first in order of rank represents them all: a name is kept if no
kept name before it is the same person's (operators.people says what that means, and holds one scope in memory; the two give
the same rows).  In Spark:

1. Two names can be one person's only if one *asks* for a pair of part stems that the other *offers*, so each name is
   exploded to its pairs, as 64-bit hashes; pairs that only one name has, or that none asks for, are dropped.
2. Names that meet in a pair of up to PAIRED names are compared there, once, and give edges from the earlier
   to the later.  In pairs of more names nobody is compared with everybody: they are settled in rounds.
3. A round keeps every open name that has no open neighbour before it by the edges, and in no large pair an open name
   before it that asks for what it offers or offers what it asks for.  What is kept is compared with the open names of its
   large pairs and edges, and takes those that are the same person's out.  A hot pair is one round where its
   names are one person's, as the first takes out the rest; a large pair of names that are m persons' takes up to m rounds.
   Large pairs are dealt to parts of SALTED names.

All comparisons are exact; a hash that two pairs share only costs a comparison.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions.udfs import _each, lazy
from ..operators.people import asked, offered, referent_score, same_person
from ..sources.held import hold, spread

#: Names of a pair that are compared with one another, and names of a part of a larger one.
PAIRED, SALTED = 512, 4096

_skeleton = _each(lambda v: list(N.skeleton(v)), "array<string>", [])


def _pairs_of(bones: pd.Series) -> pd.Series:
    """Each offered pair with whether it is asked for as well."""

    def one(b) -> list[dict]:
        parts = tuple(b)
        wants = asked(parts)
        return [{"pair": f"{x}\0{y}", "asks": (x, y) in wants} for x, y in sorted(offered(parts))]

    return bones.map(one)


def _same(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([same_person(tuple(x), tuple(y)) for x, y in zip(a, b, strict=True)], dtype=bool)


def _scores(known: pd.Series, other: pd.Series) -> pd.Series:
    return pd.Series([referent_score(tuple(x), tuple(y)) for x, y in zip(known, other, strict=True)], dtype="int32")


def _hit(p: str):
    return F.col(f"p.{p}")


pairs_of = lazy(_pairs_of, "array<struct<pair:string,asks:boolean>>")
same = lazy(_same, "boolean")
score_of = lazy(_scores, "int")


def _met(a: DataFrame, b: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join by shuffle.  Spark judges a table by the file it comes from, and a small file of names is exploded to many pairs:
    left alone, it collects them on the driver to broadcast them."""
    return a.hint("merge").join(b.hint("merge"), on, how)


def _keys(nodes: DataFrame) -> DataFrame:
    """(h, node, r, asks): each name's pairs within its scope."""
    rows = nodes.select("node", "r", "scope_id", F.explode(pairs_of("bones")).alias("p"))
    return rows.select(F.xxhash64("scope_id", _hit("pair")).alias("h"), "node", "r", _hit("asks").alias("asks"))


def distinct_people(names: DataFrame, scope_col: str = "scope_id", token_col: str = "token", name_col: str = "name", seeded_col: str = "seeded", number_col: str = "number", paired: int = PAIRED) -> DataFrame:
    """Per row of names with a part: scope_id, token, name, bones (its parts' skeletons) and kept.

    Rank: seeded names, then those of more parts, then smaller numbers, then tokens.  Tokens are one row each within their scope.
    Rows without a name, a token or a part take no part and give no row; an empty table gives an empty result.
    """
    rows = names.select(F.col(scope_col).alias("scope_id"), F.col(token_col).alias("token"), F.col(name_col).alias("name"), F.coalesce(F.col(seeded_col), F.lit(False)).alias("seeded"), F.col(number_col).cast("long").alias("number"))
    rows = spread(rows.where("token is not null and name is not null")).withColumn("bones", _skeleton("name")).where("size(bones) > 0")
    nodes = hold(rows.withColumn("node", F.monotonically_increasing_id()))
    nodes = nodes.withColumn("r", F.struct((~F.col("seeded")).alias("later"), (-F.size("bones")).alias("fewer"), "number", "token", "node"))
    kept = _settled(nodes, paired).withColumn("kept", F.lit(True))
    out = _met(nodes.select("scope_id", "token", "name", "bones", "node"), kept, "node", "left")
    return out.select("scope_id", "token", "name", "bones", F.coalesce("kept", F.lit(False)).alias("kept"))


def _edges(keys: DataFrame, bones: DataFrame, paired: int) -> DataFrame:
    """(a, b): names of one person that meet in a pair of few names, the earlier first."""
    few = keys.where(F.col("n") <= paired)
    a = few.where("asks").select("h", F.col("node").alias("x"), F.col("r").alias("rx"))
    b = few.select("h", F.col("node").alias("y"), F.col("r").alias("ry"))
    met = _met(a, b, "h").where("x <> y")
    met = met.select(F.when(F.col("rx") < F.col("ry"), F.col("x")).otherwise(F.col("y")).alias("a"), F.when(F.col("rx") < F.col("ry"), F.col("y")).otherwise(F.col("x")).alias("b")).distinct()
    return _verified(met, bones)


def _verified(met: DataFrame, bones: DataFrame) -> DataFrame:
    x, y = (bones.select(F.col("node").alias(c), F.col("bones").alias(f"b{c}")) for c in "ab")
    return _met(_met(met, x, "a"), y, "b").where(same("ba", "bb")).select("a", "b")


def _settled(nodes: DataFrame, paired: int) -> DataFrame:
    """The nodes that are kept."""
    keys = hold(_keys(nodes))
    sizes = keys.groupBy("h").agg(F.count("*").alias("n"), F.max("asks").alias("asked")).where("n > 1 and asked").select("h", "n")
    keys = hold(_met(keys, sizes, "h"))
    bones = nodes.select("node", "bones")
    edges = hold(_edges(keys, bones, paired))
    parts = F.ceil(F.col("n") / SALTED).cast("int")
    large = hold(keys.where(F.col("n") > paired).select("h", "node", "r", "asks", parts.alias("parts"), F.pmod(F.xxhash64("node"), parts.cast("long")).cast("int").alias("part")))
    # names that meet nobody are kept as they are
    met = edges.select(F.col("a").alias("node")).union(edges.select("b")).union(large.select("node")).distinct()
    alone = _met(nodes.select("node"), met, "node", "left_anti")
    open_ = hold(_met(nodes.select("node"), met, "node", "left_semi"))
    kept = [alone]
    while not open_.isEmpty():
        mine = _met(large, open_, "node", "left_semi")
        least = mine.groupBy("h", "parts").agg(F.min("r").alias("offers"), F.min(F.when(F.col("asks"), F.col("r"))).alias("asking"))
        least = least.select("h", "offers", "asking", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        before = (F.col("asks") & (F.col("offers") < F.col("r"))) | F.coalesce(F.col("asking") < F.col("r"), F.lit(False))
        held_up = _met(mine, least, ["h", "part"]).where(before).select("node")
        live = _met(_met(edges, open_.select(F.col("node").alias("a")), "a", "left_semi"), open_.select(F.col("node").alias("b")), "b", "left_semi")
        free = hold(_met(open_, held_up.union(live.select(F.col("b").alias("node"))).distinct(), "node", "left_anti"))
        kept.append(free)
        gone = _met(live, free.select(F.col("node").alias("a")), "a", "left_semi").select(F.col("b").alias("node"))
        firsts = _met(mine, free, "node", "left_semi").select("h", F.col("node").alias("x"), F.col("r").alias("rx"), F.col("asks").alias("xasks"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        met = _met(mine, firsts, ["h", "part"]).where("node <> x and (asks or xasks)").where(F.col("rx") < F.col("r"))
        gone = gone.union(_verified(met.select(F.col("x").alias("a"), F.col("node").alias("b")).distinct(), bones).select(F.col("b").alias("node")))
        open_ = hold(_met(open_, free.union(gone).distinct(), "node", "left_anti"))
    out = kept[0]
    for k in kept[1:]:
        out = out.union(k)
    return out


def resolved(people: DataFrame, names: DataFrame, scope_col: str = "scope_id", name_col: str = "name") -> DataFrame:
    """Per row of names: its columns, person (the token of the one kept person of whom two parts line up with it, else null) and several (whether that holds for more).

    people: what distinct_people gave.  A name is matched with kept people of its scope by the pairs it asks for.
    """
    rows = hold(spread(names).withColumn("_row", F.monotonically_increasing_id()))
    told = rows.select("_row", F.col(scope_col).alias("scope_id"), _skeleton(name_col).alias("bones"))
    want = told.select("_row", "bones", "scope_id", F.explode(pairs_of("bones")).alias("p")).where("p.asks").select("_row", "bones", F.xxhash64("scope_id", _hit("pair")).alias("h"))
    have = spread(people).where("kept").select("scope_id", "token", F.col("bones").alias("known"))
    have = have.select("token", "known", "scope_id", F.explode(pairs_of("known")).alias("p")).select("token", "known", F.xxhash64("scope_id", _hit("pair")).alias("h"))
    met = _met(want, have, "h").groupBy("_row", "token").agg(F.first("bones").alias("bones"), F.first("known").alias("known"))
    fits = met.where(score_of("known", "bones") >= 2).groupBy("_row").agg(F.min("token").alias("first"), F.max("token").alias("last"))
    out = _met(rows, fits, "_row", "left").drop("_row")
    one = F.col("first") == F.col("last")
    return out.withColumn("person", F.when(one, F.col("first"))).withColumn("several", F.coalesce(~one, F.lit(False))).drop("first", "last")


def claims(proposals: DataFrame, key_col: str = "key", surface_col: str = "surface", token_col: str = "token", scope_col: str = "scope_id") -> DataFrame:
    """Who claims a variant: per scope and key its surface (the smallest), owner (its one token, else null) and several.

    The smallest and the largest token tell whether there are several, so no group of all proposers is held and a
    key that a third of all rows propose is added up before the shuffle.
    """
    rows = proposals.where(F.col(key_col).isNotNull() & F.col(token_col).isNotNull())
    told = rows.groupBy(F.col(scope_col).alias("scope_id"), F.col(key_col).alias("key")).agg(F.min(surface_col).alias("surface"), F.min(token_col).alias("first"), F.max(token_col).alias("last"))
    one = F.col("first") == F.col("last")
    return told.select("scope_id", "key", "surface", F.when(one, F.col("first")).alias("owner"), (~one).alias("several"))

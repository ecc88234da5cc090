"""Known values in text that has crossed: how often each stands alone, and inside which longer words.

Texts and surfaces are compared casefolded, as Python folds them.  Surfaces become one automaton, sent to
the executors only up to MOST_BYTES; beyond that, each is looked for in the texts that hold its rarest
three characters, so neither side grows into a broadcast.  Both ways give the same rows.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fold import after_escape
from ..functions.udfs import _each
from ..sources.held import hold

#: Bytes of all surfaces together up to which they are broadcast, and surfaces looked for in a text at once beyond.
MOST_BYTES, CHUNK = 16 << 20, 1000
LEAST = 3

_casefold = _each(str.casefold, "string")


def _word_char(c: str, more: str = "_") -> bool:
    return c.isalnum() or c in more


def occurrences(text: str, machine) -> tuple[Counter, Counter]:
    """Per surface: occurrences as a word of its own; and per (surface, shape): inside longer words, what is known masked."""
    alone: Counter = Counter()
    inside: Counter = Counter()
    low = text.casefold()
    same = len(low) == len(text)
    for end, surface in machine.iter(low):
        i, j = end + 1 - len(surface), end + 1
        left = i == 0 or not _word_char(low[i - 1]) or after_escape(low, i)
        right = j == len(low) or not _word_char(low[j])
        a, b = i, j
        while a > 0 and _word_char(low[a - 1], "_-"):
            a -= 1
        while b < len(low) and _word_char(low[b], "_-"):
            b += 1
        if (left and right) or (a, b) == (i, j):
            alone[surface] += 1
        else:
            shown = text if same else low
            inside[surface, shown[a:i] + "*" * (j - i) + shown[j:b]] += 1
    return alone, inside


def automaton(surfaces):
    import ahocorasick

    machine = ahocorasick.Automaton()
    for s in surfaces:
        low = s.casefold()
        if len(low) >= LEAST:
            machine.add_word(low, low)
    if len(machine):
        machine.make_automaton()
    return machine


FOUND = "doc_id long, surface string, standalone long, inside long, shapes array<string>"


def find_known(docs: DataFrame, surfaces: DataFrame, id_col: str = "doc_id", text_col: str = "text", surface_col: str = "surface", most_bytes: int = MOST_BYTES) -> DataFrame:
    """(doc_id, surface casefolded, standalone, inside, shapes): known surfaces of three or more characters in texts.

    A surface stands alone where no letter, digit or underscore touches it (an escape before it is a
    boundary); inside a longer word its shape is shown with the surface masked.  Null texts hold none.
    """
    known = surfaces.select(_casefold(F.col(surface_col)).alias("s")).where(F.length("s") >= LEAST).distinct()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.col(text_col).isNotNull())
    if (known.agg(F.sum(F.octet_length("s"))).first()[0] or 0) > most_bytes:
        return _find_joined(rows, known)
    some = [r["s"] for r in known.collect()]

    def scan(batches):
        machine = automaton(some)
        for batch in batches:
            out = []
            for i, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                alone, inside = occurrences(text.as_py(), machine) if len(machine) else ({}, {})
                out += _rows(i, alone, inside)
            yield pa.RecordBatch.from_pylist(out, _SCHEMA)

    return rows.mapInArrow(scan, FOUND)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("surface", pa.string()), ("standalone", pa.int64()), ("inside", pa.int64()), ("shapes", pa.list_(pa.string()))])


def _rows(doc_id, alone, inside) -> list[dict]:
    out = []
    for s in sorted({*alone, *(k for k, _ in inside)}):
        shapes = sorted(x for k, x in inside if k == s)
        out.append({"doc_id": doc_id, "surface": s, "standalone": alone.get(s, 0), "inside": sum(n for (k, _), n in inside.items() if k == s), "shapes": shapes})
    return out


def _find_joined(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The same by candidates: a surface can only stand in texts that hold all its runs of three characters; its rarest is looked up.

    A text's candidates are dealt to chunks of about CHUNK, so no row grows with the number of surfaces.
    """
    rows = hold(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("low", _casefold("text")))
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substr(c, i, F.lit(3))))
    held = rows.select("row", F.explode(grams(F.col("low"))).alias("g"))
    common = held.groupBy("g").agg(F.count("*").alias("n"))
    # (a run of no text has no row here: such a surface stands nowhere)
    every = known.select("s", F.size(grams(F.col("s"))).alias("of"), F.explode(grams(F.col("s"))).alias("g")).join(common, "g")
    anchors = every.groupBy("s", "of").agg(F.min(F.struct("n", "g"))["g"].alias("g"), F.count("*").alias("here")).where("here = of").select("s", "g")
    pairs = hold(held.join(anchors, "g").select("row", "s"))
    chunks = pairs.groupBy("row").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    dealt = pairs.join(chunks, "row").groupBy("row", F.pmod(F.xxhash64("s"), F.col("chunks")).alias("chunk")).agg(F.collect_list("s").alias("some"))

    def scan(batches):
        for batch in batches:
            out = []
            for i, text, some in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), batch["some"].to_pylist(), strict=True):
                out += _rows(i, *occurrences(text, automaton(some)))
            yield pa.RecordBatch.from_pylist(out, _SCHEMA)

    return rows.select("row", "doc_id", "text").join(dealt, "row").select("doc_id", "text", "some").mapInArrow(scan, FOUND)


def report(found: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Per kind: values looked for, values too short to look for, and occurrences; a leak is an occurrence that stands alone."""
    known = surfaces.select(_casefold("surface").alias("surface"), "kind").where("surface is not null").dropDuplicates(["surface"])
    sums = found.groupBy("surface").agg(F.sum("standalone").alias("standalone"), F.sum("inside").alias("inside"))
    per = known.join(sums, "surface", "left").groupBy("kind").agg(
        F.sum((F.length("surface") >= LEAST).cast("long")).alias("n_values"), F.sum((F.length("surface") < LEAST).cast("long")).alias("skipped"),
        F.coalesce(F.sum("standalone"), F.lit(0)).alias("standalone"), F.coalesce(F.sum("inside"), F.lit(0)).alias("inside"),
    )
    return per.withColumn("leak", F.col("standalone") > 0)


def known_surfaces(tokens: DataFrame, aliases: DataFrame) -> DataFrame:
    """(scope_id, surface, kind): every surface of a scope's vault, a row's own value before aliases."""
    rows = tokens.where(F.col("real_value") != "").select("scope_id", F.col("real_value").alias("surface"), "kind", F.lit(0).alias("o"))
    more = aliases.join(tokens.select("scope_id", "token", "kind"), ["scope_id", "token"]).where(F.col("surface") != "").select("scope_id", "surface", "kind", F.lit(1).alias("o"))
    return rows.union(more).groupBy("scope_id", "surface").agg(F.min_by("kind", "o").alias("kind"))

"""Vaults that are too large to broadcast: each text meets only the tokens that it may name.

A match key can stand in a text only if all its neighbouring word pairs do (of a key of one word: the word; of one
without words: its signs).  So each key is filed under that of its pairs which the fewest texts hold, keys with a pair
that no text holds are left out, and texts meet keys by an equality on hashed pairs.  What a text may name is then
matched by the vault's own rules, with a vault of just these tokens: the result is the whole vault's, as a token that
could claim any place of the text is among them.  Hashes only choose candidates; two that collide add one, no more.

Pairs of texts pass a filter of FILTER_BITS bits over the vault's pairs, which is broadcast; its size is fixed, and
a fuller one lets more pairs through.  A token's aliases travel with it, and a text's candidates with the text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fold import blank_escapes, key
from ..operators.vault import Alias, Row, Vault
from ..sources.held import hold, pieces, spread

FILTER_BITS = 1 << 27
_WORD, _SIGN = re.compile(r"[^\W_]+"), re.compile(r"[^\w\s]|_")
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_WORDS_KEPT = 500_000
NEEDLE, CLAIM, NAMED = 0, 1, 2


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


class _Units:
    """Hashes of the words, neighbouring pairs and signs of folded texts; those of different scopes differ."""

    def __init__(self):
        self.known = _Hashes()

    def words(self, words: list[str]) -> np.ndarray:
        if len(self.known) > _WORDS_KEPT:
            self.known.clear()
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))

    @staticmethod
    def pairs(h: np.ndarray) -> np.ndarray:
        return (h[:-1] * _ODD[0]) ^ (h[1:] + _ODD[1])

    @staticmethod
    def of_scope(h: np.ndarray, scope: str) -> np.ndarray:
        mixed = (h ^ np.uint64(xxhash.xxh64_intdigest(scope, 1))) * _ODD[2]
        return mixed ^ (mixed >> np.uint64(32))

    def of_text(self, text: str | None, scope: str) -> np.ndarray:
        """All that a key in this text may be filed under, with repeats; after a backslash escape a word starts anew, too."""
        hay = key(text)
        parts = []
        for read in (hay, blank_escapes(hay)) if "\\" in hay else (hay,):
            h = self.words(_WORD.findall(read))
            parts += [h, self.pairs(h)]
        parts.append(self.words([c for c in set(hay) if _SIGN.match(c)]))
        return self.of_scope(np.concatenate(parts), scope)

    def of_needle(self, k: str, scope: str) -> np.ndarray:
        """What all texts hold that hold k; pairs are not asked for across a backslash, where words may be read otherwise."""
        h = self.words(_WORD.findall(k))
        if not len(h):
            h = self.words(_SIGN.findall(k))
        elif len(h) > 1 and "\\" not in k:
            h = self.pairs(h)
        return np.unique(self.of_scope(h, scope))

    def of_key(self, k: str, scope: str) -> int:
        return xxhash.xxh64_intdigest(f"{scope}\0{k}") - (1 << 63)


def carriers(tokens: DataFrame) -> DataFrame:
    """(scope_id, token, now): the row that carries each token's referent today."""
    at = tokens.select("scope_id", "token", F.col("token").alias("now"))
    step = hold(tokens.where("status <> 'active' and canonical_token is not null").select("scope_id", F.col("token").alias("now"), F.col("canonical_token").alias("next")))
    turns = step.count()  # no chain is longer
    while turns > 0:  # each turn doubles what a step spans, so a chain of n rows takes log2(n) turns
        at = hold(at.join(step, ["scope_id", "now"], "left").select("scope_id", "token", F.coalesce("next", "now").alias("now")))
        on = step.select("scope_id", F.col("now").alias("next"), F.col("next").alias("then"))
        step = hold(step.join(on, ["scope_id", "next"], "left").select("scope_id", "now", F.coalesce("then", "next").alias("next")))
        turns //= 2
    return at


def whole(tokens: DataFrame, aliases: DataFrame) -> DataFrame:
    """A row for each token: itself, told what carries it today, with its aliases."""
    said = aliases.groupBy("scope_id", "token").agg(F.collect_list(F.struct("seq", "surface", "normalized", "source")).alias("aliases"))
    now = carriers(tokens).where("token <> now")
    rows = tokens.join(now, ["scope_id", "token"], "left").withColumn("canonical_token", F.coalesce("now", "canonical_token")).drop("now")
    columns = ("kind", "real_value", "normalized", "status", "canonical_token", "attributes", "seq")
    return rows.join(said, ["scope_id", "token"], "left").select("scope_id", "token", F.struct(*columns).alias("row"), "aliases")


def _vault(entries: Iterable[dict]) -> Vault:
    """The vault of some tokens with their aliases, in the order of the tables."""
    rows, aliases = [], []
    for e in entries:
        r = e["row"]
        known = {k: v for k, v in (r["attributes"] or {}).items() if v is not None}
        rows.append((r["seq"] or 0, Row(e["token"], r["kind"], r["real_value"], r["normalized"], r["status"] or "active", r["canonical_token"], known)))
        aliases += [(a["seq"] or 0, Alias(e["token"], a["surface"], a["normalized"], a["source"])) for a in e["aliases"] or ()]
    ordered = lambda some: [x for _, x in sorted(some, key=lambda p: p[0])]
    return Vault(ordered(rows), ordered(aliases))


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each token is filed under, the keys that it claims, and those of the names that it is told of with."""
    units = _Units()
    for batch in batches:
        out: list[tuple] = []
        for e in batch.to_pylist():
            scope, token, v = e["scope_id"], e["token"], _vault([e])
            needles = {*v.match_keys()[0], *map(key, v.defined)} - {""}
            for n, k in enumerate(sorted(needles)):
                held = units.of_needle(k, scope).view(np.int64).tolist()
                out += [(scope, token, NEEDLE, n, len(held), u) for u in held]
            out += [(scope, token, CLAIM, 0, 0, units.of_key(k, scope)) for k in v.keys]
            a = e["row"]["attributes"] or {}
            names = [a.get("identifier_of_name"), *(r["target_name"] for r in a.get("relations") or () if r)]
            out += [(scope, token, NAMED, 0, 0, units.of_key(k, scope)) for k in {key(n) for n in names if n}]
        columns = list(zip(*out, strict=True)) if out else [()] * 6
        types = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["scope_id", "token", "what", "needle", "size", "unit"])


def _filter(index: DataFrame) -> np.ndarray:
    """FILTER_BITS bits, those of the vault's units set."""
    bit = F.shiftrightunsigned("unit", 17).bitwiseAND(F.lit(FILTER_BITS - 1))
    set_bits = index.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS >> 6, np.int64)
    out[set_bits["word"].to_numpy()] = set_bits["bits"].to_numpy()
    return out


def units_of(base: DataFrame, needles: DataFrame | None = None) -> DataFrame:
    """(at, unit): what each distinct text may be found by; of needles, if given, where the filter's bit is set."""
    held = None if needles is None else base.sparkSession.sparkContext.broadcast(_filter(needles))

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, mask = _Units(), np.uint64(FILTER_BITS - 1)
        bits = None if held is None else held.value.view(np.uint64)
        for batch in batches:
            ats, found = [], []
            for at, scope, text in zip(*(batch[c].to_pylist() for c in ("at", "scope_id", "text")), strict=True):
                u = one.of_text(text, scope)
                if bits is not None:
                    bit = (u >> np.uint64(17)) & mask
                    u = u[((bits[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1)).astype(bool)]
                u = np.unique(u)
                if len(u):
                    ats += [at] * len(u)
                    found.append(u.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ats, pa.binary()), pa.array(np.concatenate(found) if found else np.empty(0, np.int64))], ["at", "unit"])

    return base.select("at", "scope_id", "text").mapInArrow(units, "at binary, unit long").distinct()


def place(scope: Column, text: Column) -> Column:
    """What a scope's text is known by: half a SHA-256."""
    return F.unhex(F.substring(F.sha2(F.concat(F.base64(F.encode(scope, "utf-8")), F.lit(":"), F.coalesce(text, F.lit(""))), 256), 1, 32))


def candidates(base: DataFrame, vault: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(at, scope_id, token): every token that a text may name, and those that it takes to tell them apart.

    base: at, scope_id, text; vault: as `whole` gives it; known: `units_of` the texts, if it is kept.  The latter are the owners of a shared name, what carries them today, and whoever claims
    a name that a token is told of with.
    """
    index = hold(spread(vault).mapInArrow(_index, "scope_id string, token string, what int, needle int, size int, unit long"))
    needles = index.where(F.col("what") == NEEDLE)
    met = hold(units_of(base, needles) if known is None else known.join(needles.select("unit").distinct(), "unit", "left_semi").select("at", "unit").distinct())
    texts = met.groupBy("unit").agg(F.count("*").alias("texts"))
    rarest = F.min_by("unit", F.struct("texts", "unit"))
    filed = needles.join(texts, "unit").groupBy("scope_id", "token", "needle").agg(F.count("*").alias("met"), F.first("size").alias("size"), rarest.alias("unit"))
    filed = filed.where("met = size").select("scope_id", "token", "unit").distinct()
    may = hold(met.join(filed, "unit").select("at", "scope_id", "token").distinct())

    claims = index.where(F.col("what") == CLAIM).select("scope_id", "unit", F.col("token").alias("other"))
    told = index.where(F.col("what") == NAMED).join(claims, ["scope_id", "unit"]).select("scope_id", "token", "other")
    shared = vault.select("scope_id", "token", F.explode("row.attributes.shared_by").alias("other"))
    carried = vault.select("scope_id", F.col("token").alias("other"), F.col("row.canonical_token").alias("now")).where("now is not null")
    near = told.unionByName(shared).unionByName(shared.join(carried, ["scope_id", "other"]).select("scope_id", "token", F.col("now").alias("other"))).distinct()
    return may.unionByName(may.join(near, ["scope_id", "token"]).select("at", "scope_id", F.col("other").alias("token"))).distinct()


def meet(docs: DataFrame, tokens: DataFrame, aliases: DataFrame, f: Callable[[list[dict], Vault], list[dict]], ddl: str, id_col: str = "doc_id", scope_col: str = "source", text_col: str = "text") -> DataFrame:
    """f(documents of one scope, a vault of all that they may name) over all documents that have a scope.

    f may ask the vault what stands in the texts, but not what else it holds.  A text without any name meets an empty one.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(scope_col).alias("scope_id"), F.col(text_col).alias("text")).where(F.col(scope_col).isNotNull())
    base = spread(base).withColumn("at", place(F.col("scope_id"), F.col("text")))
    vault = hold(whole(tokens, aliases))
    return meet_candidates(base, candidates(base, vault), vault, f, ddl)


def meet_candidates(base: DataFrame, named: DataFrame, vault: DataFrame, f: Callable[[list[dict], Vault], list[dict]], ddl: str) -> DataFrame:
    """`meet`, of base (doc_id, scope_id, text, at) with the tokens that it names."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(ddl))
    entries = named.join(vault, ["scope_id", "token"]).groupBy("at").agg(F.collect_list(F.struct("scope_id", "token", "row", "aliases")).alias("entries"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole)):
            by_scope: dict[str, tuple[list[dict], dict]] = {}
            for r in batch.to_pylist():
                rows, named = by_scope.setdefault(r["scope_id"], ([], {}))
                for e in r.pop("entries") or ():
                    if e["scope_id"] == r["scope_id"]:  # a hash may have met another scope's
                        named[e["token"], e["row"]["normalized"]] = e
                rows.append(r)
            for rows, named in by_scope.values():
                yield pa.RecordBatch.from_pylist(f(rows, _vault(named.values())), schema=schema)

    return base.join(entries, "at", "left").select("doc_id", "scope_id", "text", "entries").mapInArrow(run, ddl)


def without_leaks(redacted: DataFrame, tokens: DataFrame, aliases: DataFrame) -> DataFrame:
    """Redactions without those lines of their glossaries that hold an enrolled value; the lines meet the vault as texts do."""
    from ..operators.glossary import leaks

    redacted = hold(redacted)
    same = F.sha2(F.to_json("glossary"), 256)
    lists = redacted.where("size(glossary) > 0").select("scope_id", same.alias("same"), "glossary").distinct()
    lines = hold(lists.select("scope_id", "same", F.posexplode("glossary").alias("n", "line")))

    def f(rows: list[dict], v: Vault) -> list[dict]:
        return [{"scope_id": r["scope_id"], "line": r["text"]} for r in rows if leaks(v, r["text"])]

    distinct = lines.select("scope_id", "line").distinct().withColumn("doc_id", F.lit(0))
    bad = meet(distinct, tokens, aliases, f, "scope_id string, line string", "doc_id", "scope_id", "line")
    kept = lines.join(bad, ["scope_id", "line"], "left_anti").groupBy("scope_id", "same").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]).alias("kept"))
    out = redacted.withColumn("same", same).join(kept, ["scope_id", "same"], "left")
    return out.withColumn("glossary", F.coalesce("kept", F.array().cast("array<string>"))).select(*redacted.columns)

"""Enrolment and redaction of whole tables: two phases, legal because a token is a function of its referent.

Phase 1 builds each scope's vault from seeds and from the *distinct* detections of all its documents,
once: the result is written to the shared folder.  A scope's vault is one group (its size is that of the
distinct names, not of the texts).  Phase 2 applies the vaults to every document.  Vaults of up to
VAULT_BYTES together are broadcast, and documents are redacted where they lie; each worker builds a
scope's vault once.  With larger ones, redaction and residuals meet candidates (`plans.filed`: no vault
is copied), and recall deals a scope's documents to slices by bytes, each of which meets its own copy of
the scope's vault, so a scope with a third of all rows is many tasks.
"""

from __future__ import annotations

import json
import math
import pickle
import uuid
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.fold import deconfuse_ascii
from ..operators.glossary import build
from ..operators.vault import Alias, Row, Vault, attributes_row, restore
from ..schemas import ALIASES, REDACTION, TOKENS
from ..sources.held import hold, pieces, spread
from . import apart, filed

#: Bytes of the texts of a slice, about, and documents of one at most.
SLICE_BYTES, SLICE_ROWS = 64 << 20, 50_000
#: Bytes of all scopes' tokens and aliases together up to which they are broadcast.
VAULT_BYTES = 32 << 20


def _vault(parts: dict[str, list[dict]]) -> Vault:
    import base64

    rows = [Row(r["token"], r["kind"], r["real_value"], r["normalized"], r.get("status") or "active", r.get("canonical_token"), {k: v for k, v in (r.get("attributes") or {}).items() if v is not None}) for r in parts.get("token", ())]
    aliases = [Alias(a["token"], a["surface"], a["normalized"], a["source"]) for a in parts.get("alias", ())]
    salt = next((base64.b64decode(s["salt"]) for s in parts.get("salt", ())), None)
    return Vault(rows, aliases, salt)


def _tagged(df: DataFrame | None, tag: str) -> DataFrame | None:
    """(scope_id, tag, seq, row as JSON) of a table of a scope."""
    if df is None:
        return None
    seq = F.col("seq") if "seq" in df.columns else F.lit(0)
    return df.select("scope_id", F.lit(tag).alias("tag"), seq.cast("decimal(38,0)").alias("seq"), F.to_json(F.struct(*df.columns)).alias("row"))


def _union(frames: list[DataFrame | None]) -> DataFrame:
    some = [f for f in frames if f is not None]
    out = some[0]
    for f in some[1:]:
        out = out.unionByName(f)
    return out


def _parts(table: pa.Table) -> dict[str, list[dict]]:
    out: dict[str, list[tuple]] = {}
    for tag, seq, row in zip(table["tag"].to_pylist(), table["seq"].to_pylist(), table["row"].to_pylist(), strict=True):
        out.setdefault(tag, []).append((seq if seq is not None else 0, row))
    return {t: [json.loads(r) for _, r in sorted(rows)] for t, rows in out.items()}


_OUT = "scope_id string, tag string, seq long, row string"


def _dump(scope: str, v: Vault) -> pa.Table:
    rows = [("token", i, {"token": r.token, "kind": r.kind, "real_value": r.real_value, "normalized": r.normalized, "status": r.status, "canonical_token": r.canonical_token, "attributes": attributes_row(r.attributes)}) for i, r in enumerate(v.rows)]
    rows += [("alias", i, {"token": a.token, "surface": a.surface, "normalized": a.normalized, "source": a.source}) for i, a in enumerate(v.aliases)]
    return pa.table({"scope_id": pa.array([scope] * len(rows), pa.string()), "tag": pa.array([t for t, _, _ in rows], pa.string()), "seq": pa.array([i for _, i, _ in rows], pa.int64()), "row": pa.array([json.dumps(r, ensure_ascii=False) for _, _, r in rows], pa.string())})


def _enrol(table: pa.Table) -> pa.Table:
    parts = _parts(table)
    v = _vault(parts)
    v.seed(parts.get("entity", ()), parts.get("party", ()))
    by_language: dict[str, list] = {}
    for d in parts.get("detection", ()):
        by_language.setdefault(d.get("language") or "en", []).append((d["span"], d["kind"]))
    for language, found in sorted(by_language.items()):
        v.absorb(found, language)
    for r in parts.get("recall", ()):
        if r["what"] == "identifier":
            v.register(r["surface"], "ID", "residual", {"identifier_of_name": r["owner"], "identifier_type": "secondary"}, variants=False)
        elif r["what"] == "defined":
            v.add_defined(r["surface"], r["owner"])
        else:
            v.add_alias(r["surface"], r["owner"], "residual")
    return _dump(table["scope_id"][0].as_py(), v)


def _reconcile(table: pa.Table) -> pa.Table:
    parts = _parts(table)
    v = _vault(parts)
    report = v.reconcile(parts.get("entity", ()), parts.get("party", ()))
    scope = table["scope_id"][0].as_py()
    note = pa.table({"scope_id": pa.array([scope]), "tag": pa.array(["report"]), "seq": pa.array([0], pa.int64()), "row": pa.array([json.dumps(report)])})
    return pa.concat_tables([_dump(scope, v), note])


def _split(out: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _parted(hold(out))


def _parted(out: DataFrame) -> tuple[DataFrame, DataFrame]:
    def part(tag: str, ddl: str) -> DataFrame:
        fields = ", ".join(f for f in _fields(ddl) if f.split()[0] not in ("scope_id", "seq"))
        return out.where(F.col("tag") == tag).select("scope_id", "seq", F.from_json("row", fields).alias("r")).select("scope_id", "r.*", "seq")

    return part("token", TOKENS), part("alias", ALIASES)


def _fields(ddl: str) -> list[str]:
    """The fields of a DDL, cut at the commas outside brackets."""
    out, depth = [""], 0
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [f.strip() for f in out]


def distinct_detections(detections: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """The first detection of each (scope, span, kind), in the order of documents; bounds what a scope's group holds."""
    w = Window.partitionBy("scope_id", "kind", F.lower("span")).orderBy("doc_id", "ord")
    firsts = detections.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    seq = F.col("doc_id").cast("decimal(20,0)") * F.lit(1 << 32) + F.col("ord")
    keep = [c for c in ("language",) if c in detections.columns]
    return firsts.select("scope_id", seq.alias("seq"), "span", "kind", *keep)


def _salts(salts: DataFrame | None) -> DataFrame | None:
    return None if salts is None else salts.select("scope_id", F.base64("salt").alias("salt"))


def enrol(tokens: DataFrame | None = None, aliases: DataFrame | None = None, salts: DataFrame | None = None, entities: DataFrame | None = None, parties: DataFrame | None = None, detections: DataFrame | None = None, recalled: DataFrame | None = None, scope_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(tokens, aliases) of every scope that any of the tables names, after seeding and absorbing.

    Large scopes of which nothing but detections and a salt is given are enrolled in parts (`plans.apart`), with the same rows.
    """
    if detections is not None and salts is not None and all(df is None for df in (tokens, aliases, entities, parties, recalled)):
        firsts = hold(distinct_detections(detections))
        large = hold(apart.large(firsts, salts, apart.SCOPE_ROWS if scope_rows is None else scope_rows))
        if not large.isEmpty():
            own = [df.join(large, "scope_id", "left_semi") for df in (firsts, salts)]
            rest = [df.join(large, "scope_id", "left_anti") for df in (firsts, salts)]
            small = _union([_tagged(_salts(rest[1]), "salt"), _tagged(rest[0], "detection")]).groupBy("scope_id").applyInArrow(_enrol, _OUT)
            return _split(apart.enrol(*own).unionByName(small))
        every = _union([_tagged(_salts(salts), "salt"), _tagged(firsts, "detection")])
        return _split(every.groupBy("scope_id").applyInArrow(_enrol, _OUT))
    every = _union([_tagged(tokens, "token"), _tagged(aliases, "alias"), _tagged(_salts(salts), "salt"), _tagged(entities, "entity"), _tagged(parties, "party"), _tagged(None if detections is None else distinct_detections(detections), "detection"), _tagged(recalled, "recall")])
    return _split(every.groupBy("scope_id").applyInArrow(_enrol, _OUT))


def reconcile(tokens: DataFrame, aliases: DataFrame, salts: DataFrame | None = None, entities: DataFrame | None = None, parties: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tokens, aliases, report) after merging duplicates and retiring what is no referent; the inputs stay as they are."""
    every = _union([_tagged(tokens, "token"), _tagged(aliases, "alias"), _tagged(_salts(salts), "salt"), _tagged(entities, "entity"), _tagged(parties, "party")])
    out = hold(every.groupBy("scope_id").applyInArrow(_reconcile, _OUT))
    report = out.where("tag = 'report'").select("scope_id", F.from_json("row", "kept int, merged int, retired int, shared_rewritten int, shared_collapsed int").alias("r")).select("scope_id", "r.*")
    return (*_parted(out), report)


# -- phase 2 ----------------------------------------------------------------------------------------


def _sliced(docs: DataFrame, id_col: str, scope_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Documents with their slice, and the slices of each scope."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(scope_col).alias("scope_id"), F.col(text_col).alias("text")).where(F.col(scope_col).isNotNull())
    slices = F.ceil(F.greatest(F.sum(F.octet_length("text")) / SLICE_BYTES, F.count("*") / SLICE_ROWS, F.lit(1))).cast("int")
    sizes = base.groupBy("scope_id").agg(slices.alias("slices"))
    # (the row's number spreads rows that are equal)
    dealt = base.join(sizes, "scope_id").withColumn("slice", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.col("slices")).cast("int")).drop("slices")
    return dealt, sizes.select("scope_id", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))


#: Vaults that a worker has built of the last broadcast, the latest ones: BUILT_ROWS rows and aliases of all together, each vault counted as VAULT_ROWS more.
_built: dict[str, Vault] = {}
_built_of: dict[str, str | int] = {}
BUILT_ROWS, VAULT_ROWS = 200_000, 1000


def _vault_of(held, scope: str) -> Vault:
    if _built_of.get("id") != held.id:
        _built.clear()
        _built_of.update(id=held.id, rows=0)
    v = _built.pop(scope, None)
    if v is None:
        packed = held.value["vaults"].get(scope)
        rows, aliases, salt = pickle.loads(packed) if packed else ((), (), None)
        v = Vault([Row(**r) for r in rows], [Alias(**a) for a in aliases], salt)
        _built_of["rows"] += _weight(v)
        while _built and _built_of["rows"] > BUILT_ROWS:
            _built_of["rows"] -= _weight(_built.pop(next(iter(_built))))
    _built[scope] = v
    return v


def _weight(v: Vault) -> int:
    return VAULT_ROWS + len(v.rows) + len(v.aliases)


class _Held:
    """Collected vaults, broadcast under a name that workers know them by."""

    def __init__(self, vaults: dict, spark):
        self.id = uuid.uuid4().hex
        self.sent = spark.sparkContext.broadcast({"vaults": vaults})

    @property
    def value(self) -> dict:
        return self.sent.value


def _collected(tokens: DataFrame, aliases: DataFrame, salts: DataFrame | None) -> dict[str, bytes]:
    """Each scope's rows, aliases and salt, packed: workers unpack those of the vaults they build."""
    out: dict[str, tuple[list, list, bytes | None]] = {}
    for r in tokens.orderBy("scope_id", "seq").toArrow().to_pylist():
        known = {k: v for k, v in (r["attributes"] or {}).items() if v is not None}
        out.setdefault(r["scope_id"], ([], [], None))[0].append({"token": r["token"], "kind": r["kind"], "real_value": r["real_value"], "normalized": r["normalized"], "status": r["status"] or "active", "canonical_token": r["canonical_token"], "attributes": known})
    for r in aliases.orderBy("scope_id", "seq").toArrow().to_pylist():
        out.setdefault(r["scope_id"], ([], [], None))[1].append({k: r[k] for k in ("token", "surface", "normalized", "source")})
    if salts is not None:
        salt = {r["scope_id"]: bytes(r["salt"]) for r in salts.join(tokens.select("scope_id").distinct(), "scope_id", "left_semi").collect()}
        out = {s: (rows, more, salt.get(s)) for s, (rows, more, _) in out.items()}
    return {s: pickle.dumps(parts) for s, parts in out.items()}


def _bytes_of(df: DataFrame) -> int:
    return df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns))))).first()[0] or 0


def _fits(tokens: DataFrame, aliases: DataFrame, vault_bytes: float | None = None) -> bool:
    """Whether all scopes' tokens and aliases together may be broadcast."""
    return vault_bytes == math.inf or _bytes_of(tokens) + _bytes_of(aliases) <= (VAULT_BYTES if vault_bytes is None else vault_bytes)


def _meet(docs: DataFrame, tokens: DataFrame, aliases: DataFrame, salts: DataFrame | None, f, ddl: str, id_col: str, scope_col: str, text_col: str, vault_bytes: float | None = None) -> DataFrame:
    """f(documents of one scope, the scope's vault) over all documents that have a scope; scopes without a vault have an empty one."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(ddl))
    spark = docs.sparkSession
    if _fits(tokens, aliases, vault_bytes):
        held = _Held(_collected(tokens, aliases, salts), spark)
        base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(scope_col).alias("scope_id"), F.col(text_col).alias("text")).where(F.col(scope_col).isNotNull())

        def here(batches):
            for batch in (piece for whole in batches for piece in pieces(whole)):
                by_scope: dict[str, list[dict]] = {}
                for r in batch.to_pylist():
                    by_scope.setdefault(r["scope_id"], []).append(r)
                for scope, rows in by_scope.items():
                    yield pa.RecordBatch.from_pylist(f(rows, _vault_of(held, scope)), schema=schema)

        return spread(base).mapInArrow(here, ddl)
    dealt, slices = _sliced(docs, id_col, scope_col, text_col)
    vaults = _union([_tagged(tokens, "token"), _tagged(aliases, "alias"), _tagged(_salts(salts), "salt")])
    right = slices.join(vaults, "scope_id").select(F.col("scope_id").alias("v_scope"), F.col("slice").alias("v_slice"), "tag", "seq", "row")

    def run(left: pa.Table, other: pa.Table) -> pa.Table:
        rows = f(left.to_pylist(), _vault(_parts(other)))
        return pa.Table.from_pylist(rows, schema=schema)

    return dealt.groupBy("scope_id", "slice").cogroup(right.groupBy("v_scope", "v_slice")).applyInArrow(run, ddl)


def redact(docs: DataFrame, tokens: DataFrame, aliases: DataFrame, salts: DataFrame | None = None, glossary: bool = True, id_col: str = "doc_id", scope_col: str = "source", text_col: str = "text", vault_bytes: float | None = None) -> DataFrame:
    """A redaction (schemas.REDACTION) for each document that has a scope; equal texts of a batch are matched once."""
    small = _fits(tokens, aliases, vault_bytes)

    def f(rows: list[dict], v: Vault) -> list[dict]:
        known: dict[str | None, dict] = {}
        out = []
        for r in rows:
            if r["text"] not in known:
                red = v.redact(r["text"], glossary and small)
                if glossary and not small and red["mapping"]:  # what its lines may leak is another text's question
                    red["glossary"] = build(v, red["mapping"], red["text"], checked=False)
                spans = [dict(zip(("start", "end", "out_start", "out_end", "token"), s, strict=True)) for s in red["spans"]]
                known[r["text"]] = red | {"spans": spans, **{k: list(red[k].items()) for k in ("mapping", "surfaces", "canonical")}}
            out.append({"doc_id": r["doc_id"], "scope_id": r["scope_id"], **known[r["text"]]})
        return out

    if small:
        return _meet(docs, tokens, aliases, salts, f, REDACTION, id_col, scope_col, text_col, math.inf)
    out = filed.meet(docs, tokens, aliases, f, REDACTION, id_col, scope_col, text_col)
    return filed.without_leaks(out, tokens, aliases) if glossary else out


RECALLED = "scope_id string, seq long, what string, surface string, owner string"


def recall(docs: DataFrame, tokens: DataFrame, aliases: DataFrame, salts: DataFrame | None = None, id_col: str = "doc_id", scope_col: str = "source", text_col: str = "text") -> DataFrame:
    """What texts add to a vault: identifiers beside enrolled ones, domains of enrolled organisations, defined short names.

    Distinct (scope, surface) rows, the first document's; to be enrolled by `enrol(recalled=…)`.
    """

    def f(rows: list[dict], v: Vault) -> list[dict]:
        v = Vault([replace(r, attributes=dict(r.attributes)) for r in v.rows], [replace(a) for a in v.aliases], v.salt)
        before = {r.token for r in v.rows}, {id(a) for a in v.aliases}
        first: dict[str, int] = {}
        for r in sorted(rows, key=lambda r: r["doc_id"]):
            n = len(v.rows), len(v.aliases)
            v.recall_identifiers(r["text"] or "")
            v.recall_domains(r["text"] or "")
            v.learn_definitions(r["text"] or "")
            for x in [*v.rows[n[0] :], *v.aliases[n[1] :]]:
                first.setdefault(getattr(x, "surface", None) or x.real_value, r["doc_id"])
        scope = rows[0]["scope_id"]
        new = [("identifier", r.real_value, r.attributes.get("identifier_of_name") or "") for r in v.rows if r.token not in before[0]]
        fresh = {r.token for r in v.rows} - before[0]
        new += [("defined" if a.source == "defined" else "domain", a.surface, a.token) for a in v.aliases if id(a) not in before[1] and a.token not in fresh]
        return [{"scope_id": scope, "seq": first.get(s, 0), "what": w, "surface": s, "owner": o} for w, s, o in new]

    found = _meet(docs, tokens, aliases, salts, f, RECALLED, id_col, scope_col, text_col)
    w = Window.partitionBy("scope_id", "what", "surface").orderBy("seq", "owner")
    return found.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def residual(docs: DataFrame, tokens: DataFrame, aliases: DataFrame, id_col: str = "doc_id", scope_col: str = "source", text_col: str = "text", vault_bytes: float | None = None) -> DataFrame:
    """(doc_id, scope_id, found): enrolled surfaces that still stand in texts; documents without any have no row."""

    def f(rows: list[dict], v: Vault) -> list[dict]:
        out = [{"doc_id": r["doc_id"], "scope_id": r["scope_id"], "found": v.residual(r["text"] or "")} for r in rows]
        return [r for r in out if r["found"]]

    ddl = "doc_id long, scope_id string, found array<string>"
    if not _fits(tokens, aliases, vault_bytes):
        return filed.meet(docs, tokens, aliases, f, ddl, id_col, scope_col, text_col)
    return _meet(docs, tokens, aliases, None, f, ddl, id_col, scope_col, text_col, math.inf)


def seed_graph(tokens: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The seeded and structural rows only, with their aliases but ordinary words."""
    from ..functions.udfs import key as _key  # noqa: F401
    from ..operators.detect import STRUCTURAL

    a = F.col("attributes")
    rows = tokens.where(F.coalesce((F.col("status") == "active") & (a["entity_type"].isNotNull() | a["identifier_of_name"].isNotNull() | (F.size(a["roles"]) > 0) | F.col("kind").isin(*STRUCTURAL)), F.lit(False)))
    from ..functions.names import is_common_word
    from ..functions.udfs import _each

    common = _each(is_common_word, "boolean", False)
    return rows, aliases.join(rows.select("scope_id", "token"), ["scope_id", "token"], "left_semi").where(~common("surface"))


def restored(text: Column, mapping: Column) -> Column:
    """A text with the tokens of a map back to what they stand for, whatever their case and look-alike letters."""
    probe = C.deconfuse_ascii(text)
    small = F.map_from_entries(F.transform(F.map_entries(mapping), lambda e: F.struct(F.lower(e["key"]).alias("k"), e["value"].alias("v"))))
    spans = C.match_spans(probe, C.TOKEN_PATTERN)

    def cuts(p: Column) -> Column:
        told = F.transform(C.sliced(p["probe"], p["spans"]), lambda t: F.try_element_at(p["small"], F.lower(t)))
        rows = F.zip_with(p["spans"], told, lambda s, v: F.struct(s["start"].alias("start"), s["end"].alias("end"), v.alias("value")))
        return F.filter(rows, lambda r: r["value"].isNotNull())

    found = C.let(F.struct(probe.alias("probe"), spans.alias("spans"), small.alias("small")), cuts)
    done = C.replaced(text, found)
    return F.when(F.contains(probe, F.lit("_")) & (F.size(mapping) > 0), done).otherwise(text)


def placed(text: Column, mapping: Column, spans: Column, surfaces: Column) -> Column:
    """A redaction's own text where a token stands for more than its one value in the mapping (a value and its neighbouring repetitions,
    say): such tokens back by their places, each to what stood there.  The others are for `restored`."""
    odd = F.map_filter(surfaces, lambda t, told: F.exists(told, lambda v: ~v.eqNullSafe(F.try_element_at(mapping, t))))

    def cuts(p: Column) -> Column:
        of = F.filter(p["spans"], lambda s: F.map_contains_key(p["odd"], s["token"]))
        # (by token, then place: the order of the surfaces of all tokens in turn)
        by_token = F.array_sort(F.transform(of, lambda s: F.struct(s["token"].alias("token"), s["out_start"].alias("start"), s["out_end"].alias("end"))))
        told = F.flatten(F.transform(F.array_sort(F.map_entries(p["odd"])), lambda e: e["value"]))
        return F.array_sort(F.zip_with(by_token, told, lambda s, v: F.struct(s["start"].alias("start"), s["end"].alias("end"), v.alias("value"))))

    return F.when(F.size(odd) > 0, C.replaced(text, C.let(F.struct(spans.alias("spans"), odd.alias("odd")), cuts))).otherwise(text)


def vault_mapping(tokens: DataFrame) -> DataFrame:
    """(scope_id, token, value) of every token, retired ones as the row that carries their referent today."""
    at = filed.carriers(tokens)
    return at.join(tokens.select("scope_id", F.col("token").alias("now"), F.col("real_value").alias("value")), ["scope_id", "now"]).select("scope_id", "token", "value")


__all__ = ["deconfuse_ascii", "enrol", "placed", "recall", "reconcile", "redact", "residual", "restore", "restored", "seed_graph", "vault_mapping"]

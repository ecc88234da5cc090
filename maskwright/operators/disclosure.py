"""What was hidden and why, what may have been overlooked, and who is named together."""

from __future__ import annotations

import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fold import key
from ..functions.names import admit_person, has_legal_form, is_common_word, is_honorific, strip_legal_form
from .ordered import last_marked, running_sums

MAX_CANDIDATES, MAX_RUN = 60, 7
#: Bodies and records of crossings that are kept.
KEEP_BODIES, KEEP_RECORDS = 64 << 20, 5000
# Words inside names, before them, and of documents' titles.
PARTICLES = frozenset("von van der den de du da di del della la le bin al ter zu".split())
OPENERS = frozenset("the a an this that der die das ein eine le la les el il dear sehr geehrte".split())
DOCUMENT_WORDS = frozenset(
    """agreement agreements contract contracts terms conditions schedule schedules annex annexes appendix appendices exhibit addendum amendment policy deed lease licence license memorandum protocol
    statement clause clauses section article chapter definitions recitals preamble order notice invoice specification regulation directive vertrag vereinbarung anlage anhang bedingungen
    geschäftsbedingungen nachtrag satzung protokoll verordnung richtlinie vollmacht договор соглашение приложение дополнение устав доверенность положение contrat accord annexe contrato acuerdo anexo
    contratto allegato""".split()
)
ENTITY_TYPES = {"person": "individual", "individual": "individual", "organization": "company", "organisation": "company", "company": "company", "vessel": "vessel", "account": "account", "other": "other", "": "other"}
_DECISION = "struct<id:string,verdict:string,valid_from:timestamp,valid_to:timestamp>"
WHY = ("added", "list", "party", "identifier", "mailbox", "pattern", "name part", "address", "vault")


def why(kind: Column, attributes: Column, added: Column | None = None) -> Column:
    """Why a token hides what it hides, the first that holds."""
    a = attributes
    return (
        F.when(F.lit(False) if added is None else F.coalesce(added, F.lit(False)), "added")
        .when(kind == "ADDRESS", "address")
        .when(a.isNull(), "vault")
        .when(a["entity_type"].isNotNull(), "list")
        .when(a["identifier_of_name"].isNotNull(), "identifier")
        .when(a["source"] == "intake", "party")
        .when(a["source"] == "mailbox", "mailbox")
        .when(a["source"] == "residual", "pattern")
        .when(F.size(a["roles"]) > 0, "party")
        .when(a["fragment"].isNotNull() | (F.size(a["shared_by"]) > 0), "name part")
        .otherwise("vault")
    )


def token_counts(spans: DataFrame, by: str = "doc_id") -> DataFrame:
    """(by, token, n, first, place): occurrences of each token in a document, in the order they are first met."""
    per = spans.groupBy(by, "token").agg(F.count("*").alias("n"), F.min("start").alias("first"))
    return per.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("first", "token")))


def kind_counts(spans: DataFrame, by: str = "doc_id") -> DataFrame:
    """(by, kind, n)."""
    return spans.groupBy(by, F.regexp_extract("token", r"^(.*)_[0-9]+$", 1).alias("kind")).agg(F.count("*").alias("n"))


def hidden(spans: DataFrame, mapping: DataFrame, tokens: DataFrame) -> DataFrame:
    """What a redaction hides: token_counts with what each token stands for (doc_id, token, value) and why; tokens of the mapping that
    stand nowhere have a count of 0 (unplaced)."""
    counts = token_counts(spans)
    facts = tokens.select("token", why(F.col("kind"), F.col("attributes")).alias("why"))
    return mapping.join(counts, ["doc_id", "token"], "left").join(facts, "token", "left").select("doc_id", "token", "value", F.coalesce("n", F.lit(0)).alias("n"), "place", F.coalesce("why", F.lit("vault")).alias("why"))


_word = regex.compile(r"\p{L}[\p{L}\-'’.&]*")


def _words(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _word.finditer(text):
        s, e = m.span()
        while e > s + 1 and text[e - 1] in "-'’.&" and not (e - s == 2 and text[e - 1] == "."):
            e -= 1
        out.append((s, e))
    return out


def capital_runs(text: str) -> list[list[tuple[int, int]]]:
    """Runs of capitalised words, one space apart, with particles between them."""
    runs, run, last = [], [], 0
    for s, e in _words(text):
        capital = text[s].isupper()
        joined = bool(run) and s == last + 1 and text[last] == " "
        if (capital or (joined and text[s:e].lower() in PARTICLES)) and (joined or not run) and len(run) < MAX_RUN:
            run.append((s, e))
        else:
            runs.append(run)
            run = [(s, e)] if capital else []
        last = e
    runs.append(run)
    for r in runs:
        while r and not text[r[-1][0]].isupper():
            r.pop()
    return [r for r in runs if r]


def _name_in(text: str, run: list[tuple[int, int]]) -> tuple[str, int, int] | None:
    words = [text[s:e] for s, e in run]
    start = 0
    while start < len(words) and (words[start].lower() in OPENERS or is_honorific(words[start])):
        start += 1
    if len(words) - start < 2:
        return None
    s, e = run[start][0], run[-1][1]
    surface = text[s:e]
    if has_legal_form(surface) and not all(map(is_common_word, strip_legal_form(surface))):
        return "organization", s, e
    if any(w.lower().strip("-'’.&") in DOCUMENT_WORDS for w in words[start:]):
        return None
    return ("person", s, e) if admit_person(surface)[0] else None


def candidates(text: str, covered: list[tuple[int, int]]) -> list[dict]:
    """At most sixty names that may have been overlooked, in the order they are first met, with their places."""
    found: dict[str, dict] = {}
    for run in capital_runs(text):
        name = _name_in(text, run) if len(run) > 1 else None
        if name is None or any(name[1] < b and a < name[2] for a, b in covered):
            continue
        kind, s, e = name
        k = key(text[s:e])
        if k and (k in found or len(found) < MAX_CANDIDATES):
            found.setdefault(k, {"text": text[s:e], "kind": kind, "at": []})["at"].append([s, e])
    return list(found.values())


def summary(text: str, spans: list[tuple[int, int, int, int, str]], mapping: dict) -> dict:
    counts: dict[str, int] = {}
    for *_, token in spans:
        kind = token.rpartition("_")[0]
        counts[kind] = counts.get(kind, 0) + 1
    left = candidates(text, [(a, b) for a, b, *_ in spans])
    return {"hidden": counts, "tokens": len(mapping), "left_in_clear": [{"text": c["text"], "kind": c["kind"]} for c in left]}


def retained(crossings: DataFrame, order: str = "id", size: str = "bytes", run: str | None = None) -> DataFrame:
    """The last KEEP_RECORDS crossings, and of which of them the body is kept: the newest that fit KEEP_BODIES.

    The cut is by rank from the newest, which TakeOrdered bounds; sums run over what is left only.
    """
    last = crossings.orderBy(F.desc(order)).limit(KEEP_RECORDS)
    w = Window.orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    out = last.withColumn("kept", F.sum(size).over(w) <= KEEP_BODIES)
    return out if run is None else out.where(F.col("run") == run)


def retention(crossings: DataFrame, by: list[str], order: str = "id", size: str = "bytes", records: int = KEEP_RECORDS, bodies: int = KEEP_BODIES) -> DataFrame:
    """All crossings of all sessions, with record_kept and body_kept, as `retained` decides for one: counts and sizes run from the newest.

    A session of any length is many ranges.  order must not repeat in a session; a null size is none.
    """
    told = running_sums(crossings, by, [F.desc(order)], {"_rank": F.lit(1), "_size": F.col(size)})
    record = F.col("_rank") <= records
    return told.select(*crossings.columns, record.alias("record_kept"), (record & (F.col("_size") <= bodies)).alias("body_kept"))


def transfers(decisions: DataFrame, summary: list[str]) -> DataFrame:
    """Decisions on transfers (id, what, run, verdict, by, at, valid_from, valid_to) as records; ids that are not letters and digits are refused.

    A decision is never rewritten: a withdrawal is a later decision.  summary: more columns that the record keeps.
    valid_to null: without an end; valid_from null: from the decision on.
    """
    fixed = ["id", "what", "run", "verdict", "by", "at"]
    kept = decisions.where(F.col("id").rlike("^[A-Za-z0-9]+$"))
    return kept.select(*fixed, F.coalesce("valid_from", "at").alias("valid_from"), "valid_to", *(c for c in summary if c not in fixed))


def standing(asked: DataFrame, decided: DataFrame, known_at: Column | None = None) -> DataFrame:
    """asked (what, at, ask_id) with the decision on it: decision and standing, as of two times.

    What rules is the last decision taken by known_at (by default when it was asked), ties to the larger id; whether it
    lets the transfer go depends on whether its period (end exclusive) covers the time asked for.  standing: allowed, refused or withdrawn as
    decided, lapsed or early outside the period of an approval, undecided before any.
    """
    q = asked.select("what", (F.col("at") if known_at is None else known_at).alias("_known"), F.lit(1).alias("_side"), F.col("ask_id").cast("string").alias("_id"), F.struct("ask_id", "at").alias("_ask"), F.lit(None).cast(_DECISION).alias("_decision"))
    rule = F.struct("id", "verdict", "valid_from", "valid_to").cast(_DECISION)
    d = decided.select("what", F.col("at").alias("_known"), F.lit(0).alias("_side"), F.col("id").alias("_id"), F.lit(None).cast(q.schema["_ask"].dataType).alias("_ask"), rule.alias("_decision"))
    order = [F.col("_known"), F.col("_side"), F.col("_id")]
    told = last_marked(q.unionByName(d), ["what"], order, F.col("_side") == 0, F.col("_decision"), "_rules").where("_side = 1")
    at, r = F.col("_ask.at"), F.col("_rules")
    period = F.when(at < r["valid_from"], "early").when(at >= r["valid_to"], "lapsed").otherwise("allowed")
    verdict = F.when(r["id"].isNull(), "undecided").when(r["verdict"] == "allowed", period).otherwise(r["verdict"])
    return told.select("what", F.col("_ask.ask_id").alias("ask_id"), at.alias("at"), r["id"].alias("decision"), verdict.alias("standing"))


def party_kind(kind: Column, attributes: Column) -> Column:
    return F.when(kind == "PERSON", "person").when(kind == "ORG", "organization").when(kind == "VESSEL", "vessel").when(kind == "ENTITY", F.when(attributes["entity_type"] == "company", "organization").otherwise("other"))


def graph(mentions: DataFrame, tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of documents and the parties they mention.

    mentions: doc, token, n; tokens: a vault's rows.  A name part with one owner counts as its owner;
    tokens that are no party count as identifiers of their document.  Weights are sums of mentions.
    """
    owner = tokens.select("token", F.when(F.size("attributes.shared_by") == 1, F.col("attributes.shared_by")[0]).otherwise(F.col("token")).alias("owner"))
    facts = tokens.select(F.col("token").alias("owner"), party_kind(F.col("kind"), F.col("attributes")).alias("kind"), F.col("real_value").alias("label"))
    told = mentions.join(owner, "token").join(facts, "owner", "left")
    edges = told.where("kind is not null").groupBy("doc", "owner").agg(F.sum("n").alias("weight"))
    edges = edges.select(F.concat(F.lit("d:"), "doc").alias("from"), F.concat(F.lit("t:"), "owner").alias("to"), F.lit("mentions").alias("kind"), "weight")
    docs = told.groupBy("doc").agg(F.sum(F.when(F.col("kind").isNull(), F.col("n")).otherwise(0)).alias("weight"))
    docs = docs.select(F.concat(F.lit("d:"), "doc").alias("id"), F.lit("document").alias("kind"), F.col("doc").cast("string").alias("label"), "weight")
    parties = told.where("kind is not null").groupBy("owner", "kind", "label").agg(F.countDistinct("doc").alias("weight"))
    return docs.unionByName(parties.select(F.concat(F.lit("t:"), "owner").alias("id"), "kind", "label", "weight")), edges

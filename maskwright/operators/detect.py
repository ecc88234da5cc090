"""Detectors: table-valued functions from documents to spans.

A detector takes rows with an id, a scope and a text and gives detections
(doc_id, scope_id, ord, span, kind, rule, start, end); places are code points of the raw text.  The
pattern detector is built of expressions only.  A named-entity model, where a deployment has one, joins
in as any DataFrame of the same columns (`scripted`), or through `from_labels`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import udfs
from ..sources.held import spread

DETECTIONS = "doc_id long, scope_id string, ord int, span string, kind string, rule string, start int, end int"
#: The kind of a span that is known to be a place: no detection, but a veto.
PLACE = "__LOCATION__"
STRUCTURAL = ("EMAIL", "PHONE", "IBAN", "CARD", "ID", "ACCOUNT", "IP")
# The kinds of a named-entity model's labels.
LABEL_KINDS = {
    "PERSON": "PERSON", "EMAIL_ADDRESS": "EMAIL", "PHONE_NUMBER": "PHONE", "IBAN_CODE": "IBAN", "CREDIT_CARD": "CARD", "US_SSN": "ID",
    "US_PASSPORT": "ID", "US_DRIVER_LICENSE": "ID", "US_BANK_NUMBER": "ACCOUNT", "MEDICAL_LICENSE": "ID", "IP_ADDRESS": "IP",
    "RU_PASSPORT": "ID", "RU_INN": "ID", "RU_OGRN": "ID", "RU_SNILS": "ID", "LOCATION": PLACE,
}


@dataclass(frozen=True)
class Pattern:
    """A rule: what matches, what of a match is kept (null: nothing), and a cheap test that a text must pass first."""

    rule: str
    kind: str
    pattern: str
    keep: object
    needs: str


# The patterns of the structural kinds, and mailboxes that nobody owns.
NOBODY = ("noreply", "no-reply", "donotreply", "do-not-reply", "mailer-daemon", "postmaster")
PATTERNS = (
    Pattern(
        "e-mail", "EMAIL", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9-])",
        lambda s: F.when(~F.lower(F.substring_index(s, "@", 1)).isin(*NOBODY), s), "@",
    ),
    Pattern("IBAN", "IBAN", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])", C.longest_iban, "[A-Z]{2}[0-9]{2}"),
    Pattern("card", "CARD", r"(?<![0-9-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9-])", lambda s: F.when(C.card_ok(s), s), "[0-9]"),
    Pattern("phone", "PHONE", r"(?<![\p{L}\p{N}_+])\+[0-9](?:[ .()-]{0,2}[0-9]){7,14}(?![0-9])", lambda s: F.when(F.length(C.digits_of(s)).between(8, 15), s), r"\+[0-9]"),
)
#: Further structural rules, not in the default set.
MORE_PATTERNS = (
    Pattern("IPv4", "IP", r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9.])", lambda s: s, r"[0-9]\.[0-9]"),
    Pattern("US phone", "PHONE", r"\([0-9]{3}\)[ \t]?[0-9]{3}-[0-9]{4}", lambda s: s, r"\([0-9]{3}\)"),
    Pattern(
        "SSN", "ID", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
        lambda s: F.when(~F.substring(s, 1, 3).isin("000", "666") & (F.substring(s, 1, 1) != "9") & (F.substring(s, 5, 2) != "00") & (F.substring(s, 8, 4) != "0000"), s), "[0-9]-[0-9]",
    ),
)


def detect_patterns(docs: DataFrame, kinds: tuple[str, ...] | None = None, patterns: tuple[Pattern, ...] = PATTERNS, id_col: str = "doc_id", scope_col: str = "source", text_col: str = "text", met: bool = False) -> DataFrame:
    """Detections of the patterns (of these kinds): the first of each (key, kind) in a document, by rule, then place.

    With `met`, also where the match's characters first stand in the text, be it a place that its rule passes over
    (beside another number, before a full stop).  Spans that hold a token are no detections; null texts have none.  A rule's matches are places
    first, in the text's own row; what a match is worth is decided on the few rows that follow, and
    only those narrow rows are shuffled, to tell the first of a key.
    """
    rules = [p for p in patterns if kinds is None or p.kind in kinds]
    text = F.col(text_col)
    base = spread(docs.select(id_col, scope_col, text_col)).select(F.col(id_col).cast("long").alias("doc_id"), F.col(scope_col).alias("scope_id"), text.alias("_raw"), C.blank_escapes(text).alias("_text")).where(text.isNotNull())
    none = F.array().cast("array<struct<start:int,end:int>>")
    places = [F.struct(F.lit(i).alias("rule"), F.when(F.col("_text").rlike(p.needs), C.match_spans(F.col("_text"), p.pattern)).otherwise(none).alias("spans")) for i, p in enumerate(rules)]
    some = base.select("*", F.explode(F.array(*places)).alias("r")).where(F.size("r.spans") > 0)
    some = some.withColumn("_matches", C.sliced(F.col("_raw"), F.col("r.spans")))
    some = some.withColumn("_met", udfs.first_places("_raw", "_matches") if met else F.col("r.spans.start"))
    cut = F.arrays_zip(F.col("r.spans").alias("span"), F.col("_matches").alias("match"), F.col("_met").alias("met"))
    hits = some.select("doc_id", "scope_id", F.col("r.rule").alias("_rule"), F.posexplode(cut).alias("_pos", "_hit"))
    hits = hits.select("doc_id", "scope_id", "_rule", "_pos", F.col("_hit.span.start").alias("start"), F.col("_hit.match").alias("_match"), F.col("_hit.met").alias("met"))
    pick = lambda f: F.coalesce(*(F.when(F.col("_rule") == i, f(p)) for i, p in enumerate(rules)))
    hits = hits.withColumn("span", pick(lambda p: p.keep(F.col("_match")))).where(F.col("span").isNotNull())
    hits = hits.withColumn("kind", pick(lambda p: F.lit(p.kind))).withColumn("rule", pick(lambda p: F.lit(p.rule)))
    hits = hits.where(~C.has_token(F.col("span")) & (F.trim("span") != ""))
    order = Window.partitionBy("doc_id", "scope_id", "kind", C.normalize_ascii(F.col("span"))).orderBy("_rule", "_pos")
    hits = hits.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return hits.select("doc_id", "scope_id", (F.col("_rule") * 1_000_000 + F.col("_pos")).alias("ord"), "span", "kind", "rule", "start", (F.col("start") + F.length("span")).alias("end"), *(["met"] if met else []))


def from_labels(labelled: DataFrame, language_col: str = "language", threshold: float = 0.5) -> DataFrame:
    """Detections from a model's rows (doc_id, scope_id, text, label, start, end, score, language).

    Labels become kinds; a place is a veto; languages other than en and ru give structural kinds only;
    spans below the threshold, blank ones and ones that hold a token are left out.
    """
    kinds = F.create_map(*[F.lit(x) for pair in LABEL_KINDS.items() for x in pair])
    span = F.substr(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
    rows = labelled.withColumn("kind", kinds[F.col("label")]).withColumn("span", span)
    fits = F.col(language_col).isin("en", "ru") | F.col("kind").isin(*STRUCTURAL)
    rows = rows.where(F.col("kind").isNotNull() & fits & (F.col("score") >= threshold) & (F.trim("span") != "") & ~C.has_token(F.col("span")))
    return rows.select("doc_id", "scope_id", F.col("start").cast("int").alias("ord"), "span", "kind", F.lit("model").alias("rule"), F.col("start").cast("int"), F.col("end").cast("int"))


def mask(docs: DataFrame, patterns: tuple[Pattern, ...] = PATTERNS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with masked: the text with what the patterns find as <KIND>, and n_masked.

    Not reversible, for where no vault is wanted.  Each pattern is applied to what the earlier ones have
    left; a match that its rule does not keep stays.  No shuffle.
    """
    out = docs.withColumn("masked", F.col(text_col)).withColumn("n_masked", F.lit(0))
    for p in patterns:
        keep = p.keep
        t = F.col("masked")
        gaps = F.split(t, p.pattern, -1)
        hits = F.regexp_extract_all(t, F.lit(p.pattern), F.lit(0))
        kept = F.transform(hits, lambda h: F.coalesce(F.length(keep(h)), F.lit(0)))  # noqa: B023
        cut = out.withColumn("_some", t.rlike(p.needs)).withColumn("_gaps", F.when(F.col("_some"), gaps)).withColumn("_hits", F.when(F.col("_some"), hits)).withColumn("_kept", F.when(F.col("_some"), kept))
        shown = F.zip_with("_hits", "_kept", lambda h, n: F.when(n > 0, F.concat(F.lit(f"<{p.kind}>"), F.substr(h, n + 1, F.length(h)))).otherwise(h))  # noqa: B023
        joined = F.array_join(F.zip_with("_gaps", F.concat(shown, F.array(F.lit(""))), lambda g, h: F.concat(g, h)), "")
        n = F.size(F.filter("_kept", lambda k: k > 0))
        out = cut.withColumn("masked", F.when(F.col("_some"), joined).otherwise(t)).withColumn("n_masked", F.col("n_masked") + F.when(F.col("_some"), n).otherwise(0)).drop("_some", "_gaps", "_hits", "_kept")
    return out

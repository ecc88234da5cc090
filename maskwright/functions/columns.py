"""Scalar operators as built-in expressions: no Python in the plan, inside whole-stage code generation.

Each has a Python twin in `fold`, `names` or `checks`; tests hold the two against one another.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fold import ECHO_FROM, ECHO_TO
from .lexicon import ORG_ROLES, PERSON_ROLES

TOKEN_PATTERN = r"(?<![0-9A-Za-z])[A-Za-z]+_[0-9]+(?![0-9A-Za-z])"


def content_hash(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def deconfuse_ascii(text: Column) -> Column:
    """Look-alikes of ASCII letters and fullwidth forms, one for one."""
    return F.translate(F.coalesce(text, F.lit("")), ECHO_FROM, ECHO_TO)


def normalize_ascii(text: Column) -> Column:
    """The comparison form of a text that `is_ascii`; other texts need `udfs.normalize`."""
    joined = F.regexp_replace(F.coalesce(text, F.lit("")), r"-[\s\x1c-\x1f]*\n[\s\x1c-\x1f]*", "")
    return F.lower(F.trim(F.regexp_replace(joined, r"[\s\x1c-\x1f]+", " ")))


def is_ascii(text: Column) -> Column:
    return F.length(text) == F.octet_length(text)


def _letters(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def script_of(text: Column) -> Column:
    """latin, cyrillic or greek, whichever has most letters, ties in this order; null without such letters."""
    latin, cyrillic, greek = (_letters(text, p) for p in ("[A-Za-z]", r"[\p{L}&&[Ѐ-ӿ]]", r"[\p{L}&&[Ͱ-Ͽἀ-῿]]"))
    top = F.greatest(latin, cyrillic, greek)
    return F.when(top == 0, None).when(latin == top, "latin").when(cyrillic == top, "cyrillic").otherwise("greek")


def mixed_script(word: Column) -> Column:
    some = [word.rlike(p).cast("int") for p in ("[A-Za-z]", r"[\p{L}&&[Ѐ-ӿ]]", r"[\p{L}&&[Ͱ-Ͽἀ-῿]]")]
    return some[0] + some[1] + some[2] > 1


def detect_language(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    letters = _letters(t, r"\p{L}")
    return F.when((letters > 0) & (_letters(t, r"[\p{L}&&[Ѐ-ӿ]]") >= 0.30 * letters), "ru").otherwise("en")


def stem_match(a: Column, b: Column) -> Column:
    """Equal, or one begins the other: at least 4 characters, at most 3 more."""
    less, more = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    return (a == b) | ((F.length(less) >= 4) & F.startswith(more, less) & (F.length(more) - F.length(less) <= 3))


def name_parts(name: Column) -> Column:
    return F.filter(F.split(F.trim(F.coalesce(name, F.lit(""))), r"""[\s,./\\()"'’]+"""), lambda p: p != "")


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn_ok(value: Column) -> Column:
    """13 to 19 digits, not all the same, with the check digit of Luhn."""
    d = digits_of(value)
    return F.length(d).between(13, 19) & (F.length(F.replace(d, F.substring(d, 1, 1), F.lit(""))) > 0) & F.call_function("luhn_check", d)


# First digits and lengths of the card networks.
CARD_NETWORKS = (
    r"^4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})$"
    r"|^(?:5[1-5]|2(?:2[2-9]|[3-6][0-9]|7[01]|720))(?<=^(?:.{2}|.{3}|.{4}))[0-9]*$(?<=^.{16})"
    r"|^3[47][0-9]{13}$"
    r"|^(?:6011|65|64[4-9])[0-9]*$(?<=^(?:.{16}|.{19}))"
    r"|^35(?:2[89]|[3-8][0-9])[0-9]*$(?<=^(?:.{16}|.{19}))"
    r"|^3(?:0[0-5]|[68])[0-9]*$(?<=^.{14})"
)


def card_ok(value: Column) -> Column:
    """A Luhn-valid number with a network's first digits and length."""
    return luhn_ok(value) & digits_of(value).rlike(CARD_NETWORKS)


def iban_ok(value: Column) -> Column:
    """15 to 34 letters and digits whose number, the first four characters moved to the end, is 1 modulo 97."""
    s = F.upper(F.replace(value, F.lit(" "), F.lit("")))
    moved = F.concat(F.substring(s, 5, 40), F.substring(s, 1, 4))
    step = lambda rest, c: F.when(c.rlike("[A-Z]"), (rest * 100 + F.ascii(c) - 55) % 97).otherwise((rest * 10 + F.ascii(c) - 48) % 97)
    chars = F.filter(F.split(moved, ""), lambda c: c != "")
    return F.length(s).between(15, 34) & s.rlike("^[0-9A-Z]+$") & (F.aggregate(chars, F.lit(0), step) == 1)


def longest_iban(match: Column) -> Column:
    """The longest prefix of a match, cut at its end or before a space, that is a valid IBAN; null for none."""
    ends = F.filter(F.sequence(F.length(match), F.lit(15), F.lit(-1)), lambda e: (e == F.length(match)) | (F.substr(match, e + 1, F.lit(1)) == " "))
    cuts = F.when(F.length(match) >= 15, F.transform(ends, lambda e: F.substr(match, F.lit(1), e)))
    return F.get(F.filter(cuts, lambda c: (c == F.rtrim(c)) & iban_ok(c)), 0)


def identifier_shaped(digits: Column) -> Column:
    """Seven digits with a ship number's check digit, or nine that begin with 2 to 7."""
    weighed = sum((F.substring(digits, i + 1, 1).cast("int") * (7 - i) for i in range(6)), F.lit(0))
    seven = digits.rlike("^[0-9]{7}$") & (weighed % 10 == F.substring(digits, 7, 1).cast("int"))
    return F.when(digits.rlike("^[0-9]{7}$"), seven).otherwise(digits.rlike("^[2-7][0-9]{8}$"))


def has_token(text: Column) -> Column:
    return text.rlike(TOKEN_PATTERN)


def may_cross(sensitivity: Column) -> Column:
    """Public and internal may leave; confidential and restricted may not; null may not."""
    return F.coalesce(sensitivity <= 1, F.lit(False))


def party_kind(role: Column, has_form: Column) -> Column:
    """(kind, individual) of a party by its role: an organisation's words first, then a person's, then a legal form."""
    r = F.lower(F.coalesce(role, F.lit("")))
    one = lambda words: F.lit(False) if not words else __import__("functools").reduce(lambda a, b: a | b, [F.contains(r, F.lit(w)) for w in words])
    org, person = one(ORG_ROLES), one(PERSON_ROLES)
    kind = F.when(org, "ORG").when(person, "PERSON").when(has_form, "ORG").otherwise("PERSON")
    return F.struct(kind.alias("kind"), (~org & person).alias("individual"))


#: Numbers of a kind in a scope, and the smallest of them.
TOKEN_SPAN, TOKEN_FLOOR = 90_000_000, 10_000_000


def hmac_sha256(secret: Column, message: Column) -> Column:
    """HMAC-SHA-256 of a binary message under a binary secret of at most 64 bytes, in hexadecimal."""
    padded = F.rpad(F.hex(secret), 128, "0")
    xor = lambda byte: F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.lpad(F.hex(F.conv(F.substr(padded, i * 2 + 1, F.lit(2)), 16, 10).cast("int").bitwiseXOR(byte)), 2, "0")), ""))
    inner = F.unhex(F.sha2(F.concat(xor(0x36), message), 256))
    return F.sha2(F.concat(xor(0x5C), inner), 256)


def derive_number(salt: Column, kind: Column, key: Column, attempt: int = 0) -> Column:
    """The number of a referent's token: a function of the scope's salt, the kind and the match key only."""
    message = F.concat(F.encode(kind, "UTF-8"), F.lit(b"\x00"), F.encode(key, "UTF-8"))
    if attempt:
        message = F.concat(message, F.lit(b"\x00" + str(attempt).encode()))
    five = F.conv(F.substring(hmac_sha256(salt, message), 1, 10), 16, 10).cast("long")
    return five % TOKEN_SPAN + TOKEN_FLOOR


def derive_token(salt: Column, kind: Column, key: Column, attempt: int = 0) -> Column:
    return F.concat(kind, F.lit("_"), derive_number(salt, kind, key, attempt).cast("string"))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, in double precision; NaN for a vector of length zero."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(float("nan"))).otherwise(1.0 - dot / size)


def share_band(pct: Column) -> Column:
    """A shareholding by the thresholds that law uses; null for none."""
    return (
        F.when(pct.isNull() | (pct <= 0), None)
        .when(pct > 100, "a recorded stake outside 0–100% (source figure is inconsistent)")
        .when(pct >= 50, "≥50%")
        .when(pct >= 25, "25–49%")
        .when(pct >= 10, "10–24%")
        .otherwise("<10%")
    )


def fold_citation(citation: Column) -> Column:
    """Greek capitals that look Latin as Latin: a key to compare by, not to show."""
    return F.translate(citation, "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX")


def citation_variants(citation: Column) -> Column:
    """The citation and its twins in the other alphabet, without repeats."""
    other = F.translate(citation, "ABEZHIKMNOPTYX", "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ")
    return F.array_distinct(F.array(citation, fold_citation(citation), other))


def jurisdiction_of(citation: Column) -> Column:
    c = citation
    return (
        F.when(F.contains(c, F.lit(" U.S.C. ")) | F.contains(c, F.lit(" CFR ")), "US")
        .when(c.rlike("^(?:CPR |MCA 1973)"), "GB")
        .when(F.startswith(c, F.lit("Cap. 113")), "CY")
        .when(c.rlike("^[СГ]К РФ"), "RU")
        .when(c.rlike(r"^(?:§§? |Art\. |Nr\. )"), "DE")
        .otherwise("")
    )


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, whatever its uses within body."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, start: int = 0, step: Callable[[Column, Column], Column] = lambda s, x: s + x) -> Column:
    """What `step` has made of start and all values before each value of an int array (sums by default), for an associative step.

    An aggregate that grows a list copies it at each value; here the array is cut into pieces of its
    size's square root, so n values cost n * sqrt(n) short copies.
    """
    none = F.array().cast("array<int>")

    def within(piece: Column) -> Column:
        first = F.struct(F.lit(start).alias("at"), none.alias("told"))
        return F.aggregate(piece, first, lambda s, x: F.struct(step(s["at"], x).alias("at"), F.concat(s["told"], F.array(s["at"])).alias("told")))

    def pieces(a: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(a))).cast("int")
        cut = F.transform(F.sequence(F.lit(1), F.size(a), size), lambda i: F.slice(a, i, size))
        return let(F.transform(cut, within), lambda t: F.flatten(F.zip_with(t, within(F.transform(t, lambda p: p["at"]))["told"], lambda p, o: F.transform(p["told"], lambda x: step(o, x)))))

    return let(values, lambda a: F.when(F.size(a) > 0, pieces(a)).otherwise(none))


def match_spans(text: Column, pattern: str) -> Column:
    """Places [start, end) of a pattern's matches, in code points; no match may be empty.

    With m1, m2, … the matches and p0, p1, … the text between them, match i begins where
    p0, m1, …, p(i-1) end, whatever the width of the characters.
    """
    hits = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda h: F.length(h))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))

    def spans(p: Column) -> Column:
        both = F.zip_with(F.slice(p["gaps"], 1, F.size(p["hits"])), p["hits"], lambda g, h: g + h)
        rows = F.arrays_zip(running(both).alias("at"), F.slice(p["gaps"], 1, F.size(p["hits"])).alias("gap"), p["hits"].alias("hit"))
        return F.transform(rows, lambda r: F.struct((r["at"] + r["gap"]).alias("start"), (r["at"] + r["gap"] + r["hit"]).alias("end")))

    none = F.array().cast("array<struct<start:int,end:int>>")
    return let(F.struct(gaps.alias("gaps"), hits.alias("hits")), lambda p: F.when(F.size(p["hits"]) > 0, spans(p)).otherwise(none))


def sliced(text: Column, spans: Column) -> Column:
    """The pieces of a text at spans (start, end), as an array; see `replaced` for the detour."""
    return let(F.encode(text, "UTF-32"), lambda raw: F.transform(spans, lambda s: F.decode(F.substring(raw, 4 * s["start"] + 1, 4 * (s["end"] - s["start"])), "UTF-32")))


def replaced(text: Column, cuts: Column) -> Column:
    """The text with each of cuts (start, end, value: ascending, apart, in code points) replaced by its value.

    Slices are taken from four bytes a character, where a place is found at once: in UTF-8 it is counted from the text's beginning.
    """
    wide = F.encode(text, "UTF-32")

    def parts(p: Column) -> Column:
        c, raw = p["cuts"], p["raw"]
        piece = lambda a, b: F.decode(F.substring(raw, 4 * a + 1, 4 * (b - a)), "UTF-32")
        before = F.concat(F.array(F.lit(0)), F.slice(F.transform(c, lambda x: x["end"]), 1, F.size(c) - 1))
        told = F.zip_with(c, before, lambda x, a: F.concat(piece(a, x["start"]), x["value"]))
        return F.concat(F.array_join(told, ""), piece(F.element_at(c, -1)["end"], F.length(raw) / 4))

    return let(F.struct(cuts.alias("cuts"), wide.alias("raw")), lambda p: F.when(F.size(p["cuts"]) > 0, parts(p)).otherwise(text))


def blank_escapes(text: Column) -> Column:
    """Backslash escapes of white space and code points as spaces of the same length; an escaped backslash is passed over."""
    held = F.regexp_replace(text, r"\\\\", "\x01\x02")
    held = F.regexp_replace(F.regexp_replace(held, r"\\[uU][0-9a-fA-F]{4}", " " * 6), r"\\[ntrfbv]", "  ")
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(held, "\x01\x02", r"\\\\")).otherwise(text)

"""Arrow-batched wrappers of the Python text functions, for use as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from . import fold as _fold
from . import names as _names
from . import variants as _variants


def _each(f, kind: str, default=None):
    """A vectorised expression that computes each distinct value of a batch once; null gives default."""

    def apply(values: pd.Series) -> pd.Series:
        known = {v: f(v) for v in values.dropna().unique()}
        return values.map(lambda v: default if v is None else known[v])

    apply.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return lazy(apply, kind)


def lazy(f, kind: str):
    """f as a column function whose type is parsed when it is used: a module must load without a session."""
    return lambda *columns: F.pandas_udf(f, kind)(*columns)


normalize = _each(_fold.normalize, "string", "")
key = _each(_fold.key, "string", "")
diacritics = _each(lambda v: _fold.diacritics(_fold.normalize(v)), "string", "")
confusable = _each(lambda v: _fold.confusable(_fold.normalize(v)), "string", "")
strip_marks = _each(lambda v: _fold.strip_marks(v)[0], "string", "")
blank_escapes = _each(_fold.blank_escapes, "string", "")
skeleton = _each(lambda v: list(_names.skeleton(v)), "array<string>")
skeleton_part = _each(_names.skeleton_part, "string", "")
legal_form = _each(_names.legal_form_of, "string")
has_legal_form = _each(_names.has_legal_form, "boolean", False)
initials = _each(_names.initials_of, "string")
person_from_email = _each(_names.person_from_email, "string")
distinctive_head = _each(_names.distinctive_head, "string")
org_variants = _each(_variants.org_variants, "array<string>")
person_variants = _each(_variants.person_variants, "array<string>")
surname_first = _each(_variants.surname_first, "array<string>")
spelling_variants = _each(_variants.spelling_variants, "array<string>")
russian_inflections = _each(_variants.russian_inflections, "array<string>")
translit_variants = _each(_variants.translit_variants, "array<string>")
cyrillic_form = _each(_variants.cyrillic_form, "string")
acronym_cyrillic = _each(_variants.acronym_cyrillic, "string")


def _person_fragments(names: pd.Series) -> pd.Series:
    return names.map(lambda n: [{"surface": s, "role": r} for s, r in _variants.person_fragments(n)] if n is not None else None)


def _admit_person(values: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_names.admit_person(v) for v in values], columns=["ok", "reason"])


def _fold_haystack(values: pd.Series) -> pd.DataFrame:
    rows = [_fold.fold_haystack(v)[1] for v in values]
    return pd.DataFrame({"text": [r.text for r in rows], "starts": [list(r.starts) for r in rows], "ends": [list(r.ends) for r in rows], "raw_len": [r.raw_len for r in rows]})


def _defined_terms(values: pd.Series) -> pd.Series:
    return values.map(lambda v: [{"term": t, "at": a} for t, a in _names.defined_terms(v)])


def _first_places(texts: pd.Series, values: pd.Series) -> pd.Series:
    import ahocorasick

    def of(text: str, some) -> list[int]:
        if len(some) == 1:
            return [text.find(some[0])]
        machine = ahocorasick.Automaton()
        for v in some:
            machine.add_word(v, v)
        machine.make_automaton()
        first: dict[str, int] = {}
        for end, v in machine.iter(text):
            first.setdefault(v, end + 1 - len(v))
        return [first[v] for v in some]

    return pd.Series([of(t, v) for t, v in zip(texts, values, strict=True)], dtype=object)


person_fragments = lazy(_person_fragments, "array<struct<surface:string,role:string>>")
admit_person = lazy(_admit_person, "struct<ok:boolean,reason:string>")
#: The folded text with its places, as `key` folds.
fold = lazy(_fold_haystack, "struct<text:string,starts:array<int>,ends:array<int>,raw_len:int>")
defined_terms = lazy(_defined_terms, "array<struct<term:string,at:int>>")
#: Where each of some values of a text first stands in it, in one pass over the text.
first_places = lazy(_first_places, "array<int>")

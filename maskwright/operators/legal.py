"""What legal documents say about who is who: companies, people by their surroundings, labelled identifiers.

Two kinds of rule.  Identifiers, vessels and names with a shape of their own are patterns, and run as
expressions (`PATTERNS`).  Companies and people are told by what stands beside a run of capitalised words:
a text is read as words with places (`Words`), and each of `CONTEXTS` looks left or right of such runs.
Most texts hold nothing of the kind: whole batches are first searched in linear time (RE2) for what each rule cannot do
without (`MARK`, `trigger`), and a rule reads only the texts that hold it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import udfs
from ..functions.checks import identifier_shaped
from ..functions.fold import has_token, key
from ..functions.lexicon import HONORIFICS
from ..functions.names import is_common_word
from ..sources.held import spread
from .detect import MORE_PATTERNS

# -- fixed values: words of titles, roles, legal forms and labels -----------------------------------

TITLES = frozenset([*HONORIFICS, "mx", "judge", "captain", "capt", "m", "monsieur", "madame", "señor", "señora", "dott", "avv"])
SECOND_TITLES = ("Justice", "Dr", "Prof")
ROLES = frozenset(
    """plaintiff claimant defendant respondent applicant appellant petitioner witness debtor creditor client individual
    director manager officer secretary chair chairman chairwoman deputy assistant associate partner founder shareholder employee employer
    accountant auditor adviser advisor consultant surveyor engineer agent broker representative contractor supervisor master clerk colleague
    counsel solicitor barrister attorney notary paralegal trustee executor beneficiary nominee guarantor landlord tenant
    husband wife son daughter father mother brother sister
    rechtsanwalt rechtsanwältin kollege kollegin avocat collègue abogado colega""".split()
)
POSSESSORS = frozenset("a an the our its their his her".split())
PARTICLES = frozenset("van von de der den da di du le la ten ter bin al del dos das y".split())
CONNECTORS = frozenset("& and of de du des van von der den di da y und et".split())
LONG_FORMS = (
    "Pty Ltd", "Pty. Ltd.", "GmbH & Co. KG", "S.à r.l.", "S.A.S.", "S.A.", "S.r.l.", "S.p.A.", "B.V.", "N.V.", "L.L.C.", "L.L.P.", "sp. z o.o.", "S.L.", "s.r.o.", "a.s.", "d.o.o.", "U.A.", "W.A.", "B.A.",
    "Limited", "LIMITED", "Ltd", "LTD", "PLC", "plc", "LLLP", "LLP", "LLC", "Inc", "INC", "Incorporated", "Corp", "Corporation", "gGmbH", "GmbH", "KGaA", "OHG", "SARL", "SAS", "SpA", "Srl", "Oyj", "ASA", "Abp",
    "A/S", "ApS", "OÜ", "Lda", "Kft", "Solicitors", "Rechtsanwälte",
)
SHORT_FORMS = ("AG", "KG", "SE", "SA", "AS", "AB", "BV", "NV", "LP", "Oy")
SHORTENED = frozenset("bros gebr intl corp".split())
LEADS = frozenset(
    """the a an and between with for from to by of in at on re dear signed messrs our your their its his her owners charterers brokers
    seller buyer landlord tenant client employer employee claimant defendant der die das zwischen und mit von le la les entre et el
    уважаемый уважаемая уважаемые господин госпожа генеральному директору адвокат""".split()
)
VERSUS = ("v", "v.", "vs", "vs.", "/", "c.", "contre", "κατά", "przeciwko", "gegen", "contro", "tegen", "contra", "против")
AND_WORDS = ("y", "and", "und", "et", "i", "και", "e", "en", "и")
CASE_MARKS = ("case", "asunto", "affaire", "rechtssache", "causa", "zaak", "sprawie")
SIGNING = ("signed by", "signed:", "by:", "name:", "attention:", "attn:", "c/o", "i,", "statement of", "affidavit of", "declaration of")
HEADERS = ("from:", "to:", "cc:", "bcc:")
FAREWELLS = ("yours sincerely", "yours faithfully", "yours truly", "very truly yours", "kind regards", "best regards", "regards", "mit freundlichen grüßen")
PRESENT = ("present", "in attendance", "attendees", "apologies", "attending")
QUERY_KEYS = ("name", "client", "customer", "party", "person", "q", "query", "search", "company")
RUSSIAN_FORMS = ("ООО", "АО", "ПАО", "ЗАО", "ОАО", "НАО", "АНО", "НКО", "ТОО", "ЧУП")
SHIP_MARKS = ("MV", "M/V", "M.V.", "MT", "M/T", "mv")
#: Label phrases, and what a value of theirs looks like.
LABELS = {
    "company number": ("company number|company no.|company registration number|registered number|registered no.|companies house number", r"[A-Z]{2}\d{6}|\d{8}"),
    "VAT number": ("VAT|VAT number|VAT no.|VAT registration number|VAT registration no.|VAT reg. no.|USt-IdNr.|USt-ID|Umsatzsteuer-Identifikationsnummer|N° TVA|BTW-nummer|Partita IVA", r"(?:[A-Z]{2} ?)?\d[\d \t]{6,13}\d"),
    "IMO number": ("IMO|IMO no.|IMO number", r"\d{7}"),
    "EIN": ("EIN|employer identification number|tax id|tax id number|tax identification|tax identification number", r"\d{2}-\d{7}"),
    "Russian registration": ("ИНН|ОГРНИП|ОГРН|КПП|СНИЛС", r"\d[\d -]{7,16}\d"),
    "passport": ("passport|passport number|passport no.", r"[A-Z0-9]{6,9}"),
    "case number": ("claim no.|claim number|case no.|case number|docket no.|index no.|Az.|Aktenzeichen|дело №|дела №|делу №", r"[A-ZА-Я0-9][A-Za-zА-Яа-я0-9/.:-]{3,30}[A-Za-zА-Яа-я0-9]"),
    "register number": ("KvK|Kamer van Koophandel|Chamber of Commerce|RCS|SIREN|SIRET|registro mercantil|CIF|NIF|DNI|NIE", r"\d[\d .]{4,16}\d|[A-Z]\d{7,8}[A-Z]?|\d{8}[A-Z]"),
    "bar number": ("State Bar no.|bar no.|bar number|SBN", r"\d{4,8}"),
    "Russian account": ("р/с|р/сч|к/с|л/с|расчетный счет|расчётный счёт", r"\d{20}"),
}
#: What may stand between such a label and its value besides a colon, "is" and blanks.
LOOSE = {"EIN": r"\D{0,12}?", "register number": r"[^\n.;]{0,40}?"}
#: Bodies of VAT numbers by country.
VAT_BODIES = {
    "DE": r"\d{9}", "ATU": r"\d{8}", "FR": r"[0-9A-Z]{2}\d{9}", "NL": r"\d{9}B\d{2}", "BE": r"0?\d{9}", "IT": r"\d{11}", "ES": r"[A-Z0-9]\d{7}[A-Z0-9]", "GB": r"\d{9}(?:\d{3})?", "IE": r"\d{7}[A-W][A-I]?",
    "PL": r"\d{10}", "SE": r"\d{12}", "DK": r"\d{8}", "FI": r"\d{8}", "PT": r"\d{9}", "CZ": r"\d{8,10}", "LU": r"\d{8}",
}
NEVER_ISSUED = ("BG", "GB", "NK", "KN", "TN", "NT", "ZZ")

# -- words that no person is called by: this library's own list, in the singular --------------------

CONTRACT_NOUNS = frozenset(
    """account act addendum address affiliate agreement amount annex appendix asset award board body breach budget buyer cash change charge
    claim clause code committee company contract contribution control cost council court credit crown customer data date day default deliverable
    department director dispute document duty employer employee equipment event exhibit expert fee flow form framework fund goods government group
    guidance holding insurance invoice island kingdom landlord law lender level liability licence license licensee licensor loss lot management
    material member milestone month nation notice objective office officer order outcome panel parent part party payment period personnel plan policy
    pollution premise price procedure process processor product project property provider public purchase purchaser rate record representative
    republic requirement resolution right risk rule sale schedule scheme section sector security seller service site software staff standard
    state statement subcontractor sub-contractor subject subsidiary supplier system team tender term trade transfer tribunal trust truth union
    unit user vendor version word work year""".split()
)
CONTRACT_ADJECTIVES = frozenset(
    "additional approved chief commercially confidential current effective eligible european executive existing expected final former general independent initial intellectual interim key new off operating other personal previous principal relevant senior special specific trading united".split()
)
NOUN_TAILS = ("tion", "sion", "ment", "ance", "ence", "ity", "ness", "ship", "ure", "ing", "er", "or", "able", "ible", "ive", "ory", "ary", "ism", "ware")


def _singular(word: str) -> str:
    return word[:-3] + "y" if word.endswith("ies") else word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def name_like(word: str) -> bool:
    """Whether a word may be of a person's name: no contract word, no long noun by its ending, no short acronym."""
    bare = regex.sub("['’]s?$", "", word)
    low = _singular(bare.casefold())
    acronym = bare.isupper() and len(bare) <= 4
    ordinary = {low, bare.casefold()} & (CONTRACT_NOUNS | CONTRACT_ADJECTIVES) or is_common_word(word)
    noun = sum(map(str.isalpha, bare)) > 6 and (low.endswith(NOUN_TAILS) or bare.casefold().endswith(NOUN_TAILS)) and low != bare.casefold() or bare.casefold().endswith(NOUN_TAILS[:16]) and len(bare) > 6
    return sum(map(str.isalpha, bare)) > 1 and not acronym and not ordinary and not noun


# -- a text as words ---------------------------------------------------------------------------------

_WORD = regex.compile(r"\p{L}[\p{L}\p{M}'’-]*\.?(?:\p{L}\.)*|\d+|[^\s\p{L}\d]")


class Word(NamedTuple):
    start: int
    end: int
    text: str

    @property
    def bare(self) -> str:
        return self.text.rstrip(".")

    @property
    def capital(self) -> bool:
        return self.text[:1].isupper()


@lru_cache(1024)
def _n_words(phrase: str) -> int:
    return len(_WORD.findall(phrase))


@lru_cache(64)
def _begins(phrases: tuple[str, ...]) -> frozenset[str]:
    return frozenset(p[:n] for p in phrases for n in range(1, len(p) + 1))


class Words:
    def __init__(self, text: str):
        self.text = text
        self.all = [Word(m.start(), m.end(), m[0]) for m in _WORD.finditer(text)]
        self.low = [w.text.casefold() for w in self.all]

    def beside(self, i: int) -> bool:
        """Whether word i stands on the line of the one before it, with blanks between them at most."""
        return 0 < i < len(self.all) and not self.text[self.all[i - 1].end : self.all[i].start].strip(" \t")

    def whole(self, i: int) -> bool:
        """Whether word i is no tail of a longer run of letters, digits and underscores, as of a key."""
        start = self.all[i].start
        return not start or not (self.text[start - 1].isalnum() or self.text[start - 1] == "_")

    def starts_line(self, i: int) -> bool:
        return not self.text[self.text.rfind("\n", 0, self.all[i].start) + 1 : self.all[i].start].strip(" \t")

    def ends_line(self, i: int) -> bool:
        """Whether nothing follows word i on its line."""
        end = self.text.find("\n", self.all[i].end)
        return not self.text[self.all[i].end : end if end >= 0 else len(self.text)].strip(" \t")

    def at(self, i: int) -> str:
        return self.all[i].text if 0 <= i < len(self.all) else ""

    def says(self, i: int, phrase: str) -> int:
        """The number of words of a phrase that begins at word i, 0 if it is another."""
        if not (i < len(self.all) and phrase.startswith(self.low[i])):
            return 0
        n = _n_words(phrase)
        some = self.all[i : i + n]
        same = len(some) == n and " ".join(self.text[some[0].start : some[-1].end].casefold().split()) == phrase
        return n if same else 0

    def starts(self, phrases: tuple[str, ...]) -> Iterator[int]:
        """The words at which one of some phrases may begin."""
        begins = _begins(phrases)
        return (i for i, low in enumerate(self.low) if low in begins)

    def name(self, i: int, least: int, most: int, title_case: bool = False) -> int:
        """Where a run of capitalised words, with particles between them, ends that begins at word i; i for none.
        A run that is longer is cut."""
        end, n, j = i, 0, i
        while j < len(self.all) and n < most and (j == i or self.beside(j)):
            word = self.all[j]
            if word.capital and word.bare and word.bare[0].isalpha():
                if title_case and not n and not word.bare[1:2].islower():
                    return i
                n, end = n + 1, j + 1
                if word.text.endswith(".") and len(word.bare) > 2:
                    break  # the end of a sentence
            elif not (n and word.text in PARTICLES):
                break
            j += 1
        return end if n >= least else i

    def span(self, i: int, j: int) -> str:
        return self.text[self.all[i].start : self.all[j - 1].end].rstrip(".")


def cited(words: Words, i: int, j: int) -> bool:
    """Whether words i to j are a party of a cited judgment: beside a "versus", with a mark of a case not far before."""
    before, after = words.text[max(0, words.all[i].start - 160) : words.all[i].start], words.at(j).casefold()
    versus = lambda w: w.casefold() in VERSUS
    joined = after in AND_WORDS and any(versus(w) for w in before.split() if w != "/")
    if not (versus(words.at(i - 1)) or versus(words.at(j)) or joined):
        return False
    about = before + words.span(i, j)  # the mark may have been read as the name's beginning
    return any(regex.search(rf"\b{m}", about.casefold()) for m in CASE_MARKS) or bool(regex.search(r"C-\d+/\d+|\[\d{4}\]", about))


def without_leads(words: Words, i: int, j: int) -> int:
    """Where the words from i to j begin without what leads up to a name; two words stay."""
    while j - i > 2 and words.all[i].capital and words.at(i).casefold() in LEADS:
        i += 1
    return i


# -- rules by context --------------------------------------------------------------------------------

Found = tuple[str, str]


def _named(words: Words, i: int, j: int) -> str | None:
    """The words from i to j as a person, unless they read like no name or like a party of a judgment."""
    i = without_leads(words, i, j)
    if any(name_like(w.bare) for w in words.all[i:j] if w.capital) and not cited(words, i, j):
        return words.span(i, j)
    return None


def _titles(words: Words) -> Iterator[str]:
    for i, (w, low) in enumerate(zip(words.all, words.low, strict=True)):
        if low.rstrip(".") in TITLES and w.capital and w.text != "M" and words.whole(i):  # "M." has its full stop
            j = i + 1
            while j < len(words.all) and words.beside(j) and words.all[j].bare in SECOND_TITLES:
                j += 1
            end = words.name(j, 1, 3) if words.beside(j) else j
            if end > j and not cited(words, i, end):
                yield f"{w.bare} {words.span(j, end)}"


@lru_cache(10_000)
def _is_role(word: str) -> bool:
    low = word.rstrip(".").casefold()
    return low in ROLES or low.removesuffix("s") in ROLES


def _after_roles(words: Words) -> Iterator[str | None]:
    for i, w in enumerate(words.all):
        if _is_role(w.text) and words.whole(i):
            j = i + 1
            j += words.at(j) in (",", ":")
            j += words.at(j).rstrip(".").casefold() in TITLES and words.beside(j + 1)
            if words.beside(j) and (end := words.name(j, 2, 3, True)) > j:
                yield _named(words, j, end)


def _before_roles(words: Words) -> Iterator[str | None]:
    last = -1
    for i, w in enumerate(words.all):
        if w.text == "," and words.at(i + 1) in POSSESSORS:
            if any(_is_role(words.at(k)) and words.whole(k) for k in range(i + 2, i + 5)):
                starts = [k for k in range(max(last + 1, i - 6), i) if words.all[k].bare.casefold() not in TITLES and words.name(k, 2, 3, True) == i]
                if starts:
                    last = i
                    yield _named(words, starts[0], i)


def _signings(words: Words) -> Iterator[str | None]:
    for i in words.starts(SIGNING):
        n = next((n for phrase in SIGNING if (n := words.says(i, phrase))), 0)
        if n and words.all[i].text != "i" and words.whole(i):
            j = i + n + (words.at(i + n) == "the")
            if words.beside(j) and (end := words.name(j, 2, 4)) > j:
                yield _named(words, j, end)


def _esquires(words: Words) -> Iterator[str | None]:
    for i, w in enumerate(words.all):
        if w.bare == "Esq":
            end = i - (words.at(i - 1) == ",")
            starts = [k for k in range(max(0, end - 7), end) if words.all[k].bare.casefold() not in TITLES and words.name(k, 2, 4) == end]
            if starts:
                yield _named(words, starts[0], end)


def _numbered(words: Words) -> Iterator[str | None]:
    for i, w in enumerate(words.all):
        if w.text == "(" and words.starts_line(i) and words.at(i + 1).isdigit() and words.at(i + 2) == ")":
            end = words.name(i + 3, 2, 4)
            if end > i + 3 and words.at(end) in ("of", ","):
                yield _named(words, i + 3, end)


def _headers(words: Words) -> Iterator[str | None]:
    for i in words.starts(HEADERS):
        if words.starts_line(i) and any(words.says(i, h) for h in HEADERS):
            end = words.name(i + 2, 2, 4) if words.beside(i + 2) else i + 2
            if end > i + 2 and (words.at(end) == "<" or words.ends_line(end - 1)):
                yield _named(words, i + 2, end)


def _farewells(words: Words) -> Iterator[str | None]:
    for i in words.starts(FAREWELLS):
        n = next((n for phrase in FAREWELLS if words.starts_line(i) and (n := words.says(i, phrase))), 0)
        j = i + n + (words.at(i + n) == ",")
        if n and words.ends_line(j - 1) and j < len(words.all):
            end = words.name(j, 2, 4)
            if end > j and words.ends_line(end - 1):
                yield _named(words, j, end)


def _attendance(words: Words) -> Iterator[str | None]:
    for line in words.text.splitlines():
        head, colon, rest = line.partition(":")
        if colon and head.strip(" \t").casefold() in PRESENT and not head[:1].isspace():
            for item in regex.split(r"[,;]|\sand\s", rest):
                one = Words(regex.sub(r"\(.*\)", "", item))
                i = int(bool(one.all) and one.all[0].bare.casefold() in TITLES)
                if i < len(one.all) and one.name(i, 2, 4) == len(one.all):
                    yield _named(one, i, len(one.all))


def _links(words: Words) -> Iterator[str | None]:
    for part in regex.findall(r"[?&]([^&#\s\"']+)", words.text):
        k, _, value = part.partition("=")
        one = value.replace("+", " ").replace("%20", " ").split()
        if k in QUERY_KEYS and len(one) > 1 and all(w[0].isupper() for w in one) and any(map(name_like, one)):
            yield " ".join(one)


_flexible = lambda phrase: "[ \t]".join(map(regex.escape, phrase.split(" ")))
_FORM = regex.compile(rf"(?<=[\p{{L}}\p{{N}}&.],?[ \t]+)(?:{'|'.join(_flexible(f) for f in sorted((*LONG_FORMS, *SHORT_FORMS), key=len, reverse=True))})(?![\p{{L}}\p{{N}}]|[\p{{L}}\p{{N}}._%+-]*@)")  # an e-mail address may begin like one


FORM_WORDS = frozenset(f for f in (*LONG_FORMS, *SHORT_FORMS) if " " not in f)


def _companies(words: Words) -> Iterator[str | None]:
    """The capitalised words before each legal form."""
    ends = {w.end: i for i, w in enumerate(words.all)}
    for m in _FORM.finditer(words.text):
        at = words.text[: m.start()].rstrip(" \t").removesuffix(",").rstrip(" \t")
        i = ends.get(len(at))
        if i is None:
            continue
        j = i + 1
        while i >= 0 and j - i <= 7 and words.all[i].bare not in FORM_WORDS and (words.all[i].capital or words.at(i).isdigit() or words.at(i) in CONNECTORS) and not (i < j - 1 and words.at(i).endswith(".") and len(words.all[i].bare) > 3):
            i -= 1
            if not words.beside(i + 1):
                break
        i += 1
        while i < j and words.at(i) in CONNECTORS:
            i += 1
        i = without_leads(words, i, j + 1)
        if i >= j:
            continue
        whole = [w.text for w in words.all[i:j]]
        loud = [w.isupper() and len(w) > 1 for w in whole]
        if loud[0] and not all(loud):  # a heading in capitals runs into the name
            first = next(k for k, w in enumerate(whole) if not loud[k] and w[0].isupper()) if any(not x and w[0].isupper() for x, w in zip(loud, whole, strict=True)) else 0
            i, whole = i + first, whole[first:]
        last = words.all[j - 1]
        if m[0] in SHORT_FORMS and last.text.endswith(".") and (i == j - 1 or not words.whole(j - 1) or len(last.bare) > 3 and last.bare.casefold() not in SHORTENED):
            continue  # a sentence ends before it
        if m[0] in SHORT_FORMS and all(is_common_word(w) or w.isdigit() or w in CONNECTORS for w in whole):
            continue
        stop = next((k for k in range(j, len(words.all)) if words.all[k].end >= m.end()), j)
        if not cited(words, i, stop + 1):
            yield words.text[words.all[i].start : m.end()]


CONTEXTS: tuple[tuple[str, str, Callable[[Words], Iterator[str | None]]], ...] = (
    ("legal form", "ORG", _companies),
    ("title", "PERSON", _titles),
    ("role before", "PERSON", _after_roles),
    ("role after", "PERSON", _before_roles),
    ("cue", "PERSON", _signings),
    ("Esq.", "PERSON", _esquires),
    ("numbered party", "PERSON", _numbered),
    ("mail header", "PERSON", _headers),
    ("valediction", "PERSON", _farewells),
    ("attendance", "PERSON", _attendance),
    ("link", "PERSON", _links),
)
_any = lambda words: "|".join(r"[\s\x0b\pZ]+".join(map(regex.escape, w.split(" "))) for w in sorted(words, key=len, reverse=True))
#: A text in which this is not found (by RE2) holds nothing for CONTEXTS.
MARK = (
    rf"(?:^|\PL)(?:(?i:{_any({*ROLES, *FAREWELLS, *PRESENT, *SIGNING})})s?|{_any({*(t.capitalize() for t in TITLES), *(t.upper() for t in TITLES), *LONG_FORMS, *SHORT_FORMS, 'Esq'})})(?:$|\PL)"
    rf"|(?:^|\PL)(?i:{_any({*HEADERS, *(p for p in SIGNING if not p[-1].isalpha())})})"
    rf"|(?:^|[\n\r\x{{85}}\x{{2028}}\x{{2029}}])[ \t]*\([0-9]+\)|[?&](?:{'|'.join(QUERY_KEYS)})="
)

# -- rules by pattern --------------------------------------------------------------------------------


@dataclass(frozen=True)
class Shape:
    """What matches (the first group that took part is the span), and which spans are kept: in expressions, and in Python."""

    rule: str
    kind: str
    pattern: str
    keep: Callable[[Column], Column] | None = None
    keeps: Callable[[str], bool] | None = None


def _labelled(rule: str) -> str:
    phrases, value = LABELS[rule]
    alone = lambda p: r"(?![\p{L}\p{N}])" if rule in LOOSE and " " not in p else ""
    words = "|".join(_loose(p) + alone(p) for p in sorted(phrases.split("|"), key=len, reverse=True))
    gap = LOOSE.get(rule, r"[ \t]*(?::[ \t]*|is[ \t]+|des[ \t]+\p{L}+:[ \t]*|№[ \t]*)?:?[ \t]*(?:№[ \t]*)?")
    return rf"(?<![\p{{L}}\p{{N}}])(?i:{words}){gap}({value})(?![\p{{L}}\p{{N}}])"


def _loose(phrase: str) -> str:
    """A phrase with any blanks, its full stops at will."""
    return r"[ \t]+".join(regex.escape(w.rstrip(".")).replace("/", r"\/") + (r"\.?" if w.endswith(".") else "") for w in phrase.split(" "))


_RU = "[А-ЯЁ][а-яё]+"
_FATHER = "(?=[А-ЯЁ][а-яё]*(?:вич|вн|ичн))[А-ЯЁ][а-яё]+"
_INITIALS = r"[А-ЯЁ]\.[ \t]?[А-ЯЁ]\."
_US = {p.rule: p for p in MORE_PATTERNS}
_ssn = lambda s: s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000"
PATTERNS = (
    Shape("Russian legal form", "ORG", rf"(?<!\p{{L}})(?:{'|'.join(RUSSIAN_FORMS)})[ \t]*[\"«“]([^\"»”\n]{{2,80}})[\"»”]"),
    Shape("Russian full name", "PERSON", rf"(?<!\p{{L}})({_RU}(?:-{_RU})?[ \t]+{_RU}[ \t]+{_FATHER})"),
    Shape("Russian initials", "PERSON", rf"(?<!\p{{L}})({_RU}[ \t]+{_INITIALS}|{_INITIALS}[ \t]?{_RU})"),
    Shape("Russian name and patronymic", "PERSON", rf"(?<!\p{{L}})({_RU}[ \t]+{_FATHER})"),
    Shape("vessel", "VESSEL", rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(map(regex.escape, SHIP_MARKS))})[ \t]+[\"“']?(\p{{Lu}}[\p{{L}}-]+(?:[ \t]+\p{{Lu}}[\p{{L}}-]+){{0,2}})"),
    Shape("US phone", "PHONE", f"({_US['US phone'].pattern})"),
    *(
        Shape(
            rule, "ACCOUNT" if rule == "Russian account" else "ID", _labelled(rule),
            {"IMO number": C.identifier_shaped, "passport": lambda s: s.rlike("[0-9]")}.get(rule), {"IMO number": identifier_shaped, "passport": lambda s: any(map(str.isdigit, s))}.get(rule),
        )
        for rule in LABELS
    ),
    Shape("VAT format", "ID", rf"(?<![\p{{L}}\p{{N}}])({'|'.join(c + body for c, body in VAT_BODIES.items())})(?![\p{{L}}\p{{N}}])"),
    Shape("Handelsregister", "ID", r"(?<![\p{L}\p{N}])(HR[AB][ \t]?\d{3,6}(?:[ \t]?[A-Z]{1,2}(?![\p{L}\p{N}]))?)"),
    Shape(
        "National Insurance number", "ID", r"(?<![\p{L}\p{N}])([A-Z]{2}(?:[ \t]?\d{2}){3}[ \t]?[A-D])(?![\p{L}\p{N}])",
        lambda s: s.rlike("^[^DFIQUV][^DFIOQUV]") & ~F.substring(s, 1, 2).isin(*NEVER_ISSUED), lambda s: s[0] not in "DFIQUV" and s[1] not in "DFIOQUV" and s[:2] not in NEVER_ISSUED,
    ),
    Shape("SSN", "ID", f"({_US['SSN'].pattern})", lambda s: _US["SSN"].keep(s).isNotNull(), _ssn),
    Shape("Russian passport", "ID", r"паспорт[а-я]*[ \t]+(?:серии[ \t]+)?(\d{2}[ \t]?\d{2}[ \t]+(?:№[ \t]*)?\d{6})(?!\d)"),
)
#: Look-arounds as RE2 has none: one that denies is a character beside, or an end of the text; one that demands is left out.
_BESIDE = ((r"(?<![\p{L}\p{N}])", r"(?:^|[^\pL\pN])"), (r"(?<!\p{L})", r"(?:^|\PL)"), (r"(?![\p{L}\p{N}])", r"(?:$|[^\pL\pN])"), (r"(?!\d)", r"(?:$|\D)"), (rf"(?=[А-ЯЁ][а-яё]*(?:вич|вн|ичн))", ""), (r"\b", ""))


def trigger(shape: Shape) -> str:
    """An expression of RE2 that is found in every text that the shape's pattern is found in, and in few others."""
    out = shape.pattern
    for beside, plain in _BESIDE:
        out = out.replace(beside, plain)
    return out


_RANK = {rule: i for i, rule in enumerate(["legal form", "Russian legal form", *(r for r, _, _ in CONTEXTS[1:]), *(s.rule for s in PATTERNS[1:])])}


@lru_cache(64)
def _compiled(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


def decoded_links(text: str) -> str | None:
    """The text with %20 and + between letters as spaces; null if there are none."""
    out = _compiled(LINK_GAPS).sub(" ", text)
    return out if out != text else None


LINK_GAPS = r"(?<=[\p{L}\p{N}.])%20(?=[\p{L}\p{N}.])|(?<=\p{L})[+](?=\p{L})"


def _contextual(text: str) -> list[tuple[str, str, str]]:
    words = Words(text)
    return [(rule, span, kind) for rule, kind, find in CONTEXTS for span in find(words) if span]


def _shaped(text: str) -> list[tuple[str, str, str]]:
    out = []
    for s in PATTERNS:
        for m in _compiled(s.pattern).finditer(text):
            if s.keeps is None or s.keeps(m[1].strip()):
                out.append((s.rule, _tidy(s.rule, m[1]), s.kind))
    return out


#: Between the series and the number of a Russian passport.
PASSPORT_GAP = r"[ \t]+(?:№[ \t]*)?(?=\d{6}$)"


def _tidy(rule: str, span: str) -> str:
    return _compiled(PASSPORT_GAP).sub(" ", span) if rule == "Russian passport" else span.strip()


def explain(text: str | None) -> list[tuple[str, str, str]]:
    """(rule, span, kind) found in a text, as it is and with its links decoded."""
    out = []
    for t in (text or "", decoded_links(text or "")):
        if t:
            out += sorted([*_contextual(t), *_shaped(t)], key=lambda x: _RANK[x[0]])
    return out


def legal_detections(text: str | None) -> list[tuple[str, str, str]]:
    """explain without repeats of a (key, kind), short spans and spans that hold a token."""
    out: dict[tuple[str, str], tuple[str, str, str]] = {}
    for rule, span, kind in explain(text):
        if len(span) >= 3 and not has_token(span):
            out.setdefault((key(span), kind), (rule, span, kind))
    return list(out.values())


_SPANS = pa.list_(pa.struct([("rank", pa.int32()), ("pos", pa.int32()), ("span", pa.string())]))
_HITS = "array<struct<rank:int,pos:int,span:string>>"


def _holds(texts: pa.Array, pattern: str) -> np.ndarray:
    return pc.fill_null(pc.match_substring_regex(texts, pattern), False).to_numpy(zero_copy_only=False)


def _read(texts: pa.Array) -> pa.Array:
    """What CONTEXTS find in each text, and which patterns may find something in it, a bit each."""
    may = np.zeros(len(texts), np.int64)
    for i, shape in enumerate(PATTERNS):  # one by one: all in one expression are too many states, and slow
        may[_holds(texts, trigger(shape))] |= 1 << i
    found = (_contextual(t.as_py()) if m else () for t, m in zip(texts, _holds(texts, MARK), strict=True))
    spans = pa.array([[{"rank": _RANK[rule], "pos": n, "span": span} for n, (rule, span, _) in enumerate(x)] for x in found], _SPANS)
    return pa.StructArray.from_arrays([pa.array(may), spans], ["may", "spans"])


def detect_legal(docs: DataFrame, id_col: str = "doc_id", scope_col: str = "source", text_col: str = "text") -> DataFrame:
    """Detections of the legal rules (start and end are null: a span may be put together of parts): the first of each
    (key, kind) of a row of docs.  Patterns are expressions; rows that repeat an id each have their own."""
    rows = docs.select(id_col, scope_col, text_col).where(F.col(text_col).isNotNull())
    # numbered where they are read: after a shuffle rows come in another order each time
    rows = spread(rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(scope_col).cast("string").alias("scope_id"), F.col(text_col).alias("text")))
    decoded = F.when(F.col("text").rlike(r"%20|[+]"), F.regexp_replace("text", LINK_GAPS, " "))
    both = rows.select("row", "doc_id", "scope_id", F.posexplode(F.array(F.col("text"), F.when(decoded != F.col("text"), decoded))).alias("turn", "text")).where("text is not null")
    both = both.withColumn("read", F.arrow_udf(_read, f"struct<may:long,spans:{_HITS}>")("text"))
    hit = lambda s: lambda span, pos: F.struct(F.lit(_RANK[s.rule]).alias("rank"), pos.alias("pos"), F.trim(span).alias("span"))
    matches = lambda s: F.transform(F.regexp_extract_all("text", F.lit(s.pattern), F.lit(1)), hit(s))
    shaped = (F.when(F.col("read.may").bitwiseAND(F.lit(1 << i)) != 0, matches(s)).otherwise(F.array().cast(_HITS)) for i, s in enumerate(PATTERNS))
    # one row a text until here: what either kind of rule finds in a text bears the text's own number
    every = both.select("row", "doc_id", "scope_id", "turn", F.explode(F.concat("read.spans", *shaped)).alias("h")).select("row", "doc_id", "scope_id", "turn", "h.*")
    for s in PATTERNS:
        if s.keep is not None:
            every = every.where(~F.coalesce((F.col("rank") == _RANK[s.rule]) & ~s.keep(F.col("span")), F.lit(False)))
    every = every.withColumn("span", F.when(F.col("rank") == _RANK["Russian passport"], F.regexp_replace("span", PASSPORT_GAP, " ")).otherwise(F.col("span")))
    every = every.where((F.length("span") >= 3) & ~C.has_token(F.col("span")))
    names = {_RANK[r]: (r, k) for r, k in [*((r, k) for r, k, _ in CONTEXTS), *((s.rule, s.kind) for s in PATTERNS)]}
    told = lambda part: F.element_at(F.array(*(F.lit(names[i][part]) for i in range(len(names)))), F.col("rank") + 1)
    every = every.withColumn("rule", told(0)).withColumn("kind", told(1)).withColumn("k", udfs.key("span"))
    first = Window.partitionBy("row", "kind", "k").orderBy("turn", "rank", "pos")
    every = every.withColumn("n", F.row_number().over(first)).where("n = 1")
    order = Window.partitionBy("row").orderBy("turn", "rank", "pos", "span")
    none = F.lit(None).cast("int")
    return every.select("doc_id", "scope_id", (F.row_number().over(order) - 1).alias("ord"), "span", "kind", "rule", none.alias("start"), none.alias("end"))

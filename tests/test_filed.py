"""Vaults met by candidates redact as whole vaults do."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from maskwright import schemas
from maskwright.functions.fold import key
from maskwright.operators.vault import Vault
from maskwright.plans import enrol, filed
from maskwright.schemas import ATTRIBUTE_NAMES
from tests.test_vault import ENTITIES, PARTIES, SALT

NOTES = {n: None for n in ATTRIBUTE_NAMES}


def whole_vault() -> Vault:
    v = Vault(salt=SALT)
    v.seed([*ENTITIES, {"type": "company", "name": "Müller & Söhne GmbH"}, {"type": "individual", "name": "Иван Петров"}, {"type": "individual", "name": "Oskar Individual", "role": "agent of Quorvane Shipping Ltd"}], PARTIES)
    v.add_alias("***!", v.token_for("Ada Brenner"), "residual")
    v.add_alias("a\\nb holdings", v.token_for("Acme Holdings"), "residual")
    v.add_defined("QSL", v.token_for("Quorvane Shipping Ltd"))
    v.register("individual", "ENTITY", "residual", variants=False)  # a word that glossaries use
    old = v.by_token[v.register("Old Harbour Lines Ltd", "ORG", "residual")]
    old.status, old.canonical_token = "retired", v.token_for("Acme Holdings")
    v.by_token[v.token_for("Zielinski")].attributes["shared_by"].append(old.token)
    v._index()
    return v


def tables(spark, vaults):
    rows, aliases = [], []
    for scope, v in vaults.items():
        rows += [(scope, r.token, r.kind, r.real_value, r.normalized, r.status, r.canonical_token, {**NOTES, **r.attributes} if r.attributes else None, i) for i, r in enumerate(v.rows)]
        aliases += [(scope, a.token, a.surface, a.normalized, a.source, i) for i, a in enumerate(v.aliases)]
    return spark.createDataFrame(rows, schemas.TOKENS), spark.createDataFrame(aliases, schemas.ALIASES)


PIECES = [
    "Henry Zielinski", "Zielinski", "H. Zielinski", "Zielinski, Henry", "Marek", "Quorvane Shipping Ltd", "QUORVANE", "QSL", "qsl", "Red River Trading", "Red River Trading B.V.", "SEA FINDER", "Sea-\nfinder", "9074729",
    "Ada Bren\u00ad ner", "Ada Brenner", "Mueller & Soehne GmbH", "Mu\u0308ller & So\u0308hne", "Ивана Петрова", "Ivan Petrov", "***!", "a\\nb holdings", "\\nAda Brenner", "\\u0041Acme Holdings", "xAda Brenner", "Ada Brennerx",
    "\\\\nAda Brenner", "Acme", "Holdings", "Old Harbour Lines Ltd", "individual", "Oskar Individual", "30 % of", ",", "(", "\t", " and ", "the ship", "Ada", "Trading B.V.",
]


def random_texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(PIECES) + r.choice([" ", " ", "", ", ", "\n"]) for _ in range(r.randint(0, 12))) for _ in range(n)]


@pytest.fixture(scope="module")
def vaults():
    other = Vault(salt=b"y" * 32)
    other.seed(ENTITIES[:3], ())
    return {"s": whole_vault(), "t": other, "no documents": whole_vault()}


def test_redactions_and_residuals_equal_those_of_whole_vaults(spark, vaults):
    tokens, aliases = tables(spark, vaults)
    texts = [*random_texts(150, 1), None, "", "   ", *random_texts(5, 1), "Ada Brenner " * 2000]
    rows = [(i, ("s", "t", "no vault", None)[i % 7 if i % 7 < 4 else 0], t, 7) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + rows[:40], "doc_id long, source string, text string, entries int")
    told = lambda df: sorted(map(str, df.collect()))
    for glossary in (True, False):
        whole = told(enrol.redact(docs, tokens, aliases, glossary=glossary))
        assert told(enrol.redact(docs, tokens, aliases, glossary=glossary, vault_bytes=0)) == whole and len(whole) > 100
    assert told(enrol.residual(docs, tokens, aliases)) == told(enrol.residual(docs, tokens, aliases, vault_bytes=0))


def test_glossaries_are_kept_and_leaking_lines_go(spark, vaults):
    tokens, aliases = tables(spark, {"s": vaults["s"]})
    docs = spark.createDataFrame([(1, "s", "Henry Zielinski of Quorvane Shipping Ltd"), (2, "s", "Red River Trading B.V. and Acme Holdings")], "doc_id long, source string, text string")
    got = {r.doc_id: r.glossary for r in enrol.redact(docs, tokens, aliases, vault_bytes=0).collect()}
    assert got == {i: vaults["s"].redact(t)["glossary"] for i, t in ((1, "Henry Zielinski of Quorvane Shipping Ltd"), (2, "Red River Trading B.V. and Acme Holdings"))}
    assert any(got.values())


def test_empty_tables(spark, vaults):
    tokens, aliases = tables(spark, {"s": vaults["s"]})
    docs = spark.createDataFrame([(1, "s", "Ada Brenner"), (2, "s", None)], "doc_id long, source string, text string")
    assert enrol.redact(docs.limit(0), tokens, aliases, vault_bytes=0).count() == 0
    bare = enrol.redact(docs, tokens.where("false"), aliases.where("false"), vault_bytes=-1).collect()
    assert {(r.doc_id, r.text) for r in bare} == {(1, "Ada Brenner"), (2, "")}
    assert {r.redacted_count for r in enrol.redact(docs, tokens, aliases.where("false"), vault_bytes=0).collect()} == {0, 1}


WHOLE = whole_vault()
ENTRIES = [{"scope_id": "s", "token": r.token, "row": {"kind": r.kind, "real_value": r.real_value, "normalized": r.normalized, "status": r.status, "canonical_token": r.canonical_token, "attributes": r.attributes, "seq": i}, "aliases": [{"seq": j, "surface": a.surface, "normalized": a.normalized, "source": a.source} for j, a in enumerate(WHOLE.aliases) if a.token == r.token]} for i, r in enumerate(WHOLE.rows)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PIECES), st.text("ab \\nu0041é\u0301*!-", max_size=6)), max_size=8).map("".join))
def test_what_a_text_names_is_filed_where_the_text_looks(text):
    units = filed._Units()
    held = set(units.of_text(text, "s").tolist())
    for token in {t for *_, t in WHOLE.apply(text).spans}:
        entry = next(e for e in ENTRIES if e["token"] == token)
        v = filed._vault([entry])
        needles = {*v.match_keys()[0], *map(key, v.defined)}
        assert any(set(units.of_needle(k, "s").tolist()) <= held for k in needles)

"""Vaults settled over a whole table, and restores withdrawn when a vault grows."""

from maskwright import schemas
from maskwright.operators.vault import Vault
from maskwright.plans import enrol, filed, settle, withdrawn
from tests.test_filed import tables
from tests.test_vault import SALT

TEXTS = [
    'Delumo Nerosa ("Nerosa") came.', 'BDN ("Delumo Nerosa") wrote.', 'Bafago Delumo Nerosa Ltd ("BDN") signed.', "see www.bafago.com and ba-fago.org", "nothing of the kind", None, "", 'Nerosa ("Bafago Delumo") left.', 'Other Party Ltd ("BDN") signed.',
]
DOCS = "doc_id long, source string, text string"


def vault():
    v = Vault(salt=SALT)
    t = v.add_row("Bafago Delumo Nerosa Ltd", "ORG", "entity")
    v.add_alias("Bafago", t, "entity")
    return v


def test_settling_equals_looking_at_all_texts_until_nothing_is_new(spark):
    tokens, aliases = tables(spark, {"s": vault(), "t": vault(), "quiet": vault()})
    salts = spark.createDataFrame([(s, SALT) for s in ("s", "t")], schemas.SALTS)
    docs = spark.createDataFrame([(i, "s", t) for i, t in enumerate(TEXTS)] + [(100, "t", TEXTS[2]), (101, "t", TEXTS[4]), (102, None, TEXTS[2]), (103, "unknown", TEXTS[2])], DOCS)
    got, names, rounds = settle.settle(docs, tokens, aliases, salts)
    look = lambda df: {(r.scope_id, r.token, r.surface, r.source) for r in df.collect()}

    v = vault()
    while any([f(t) for t in TEXTS if t for f in (v.recall_identifiers, v.recall_domains, v.learn_definitions)]):
        pass
    assert look(names.where("scope_id = 's'")) == {("s", a.token, a.surface, a.source) for a in v.aliases}
    assert {"BDN", "Delumo Nerosa", "Nerosa", "Bafago Delumo"} <= {a.surface for a in v.aliases}
    assert {r.surface for r in names.where("scope_id = 't' and source = 'defined'").collect()} == {"BDN"}
    assert names.where("scope_id = 'quiet'").count() == 2 and got.count() == tokens.count()
    looked = [r["texts"] for r in rounds]
    assert len(rounds) >= 3 and rounds[-1]["touched"] == 0 and looked[0] == 11 and max(looked[1:]) < looked[0]
    assert settle.settle(docs.limit(0), tokens, aliases, salts)[2] == [{"texts": 0, "touched": 0}]


def test_restores_that_show_a_new_value_are_withdrawn(spark):
    v = vault()
    tokens, aliases = tables(spark, {"s": v})
    rows = [("s", "1", "as BAFAGO said"), ("s", "2", "bafagos said"), ("t", "3", "Bafago said"), ("s", "4", None), (None, "5", "Bafago"), ("s", "6", "as BAFAGO said"), ("s", "7", "")]
    restores = spark.createDataFrame(rows, "scope_id string, key string, value string")
    older, newer = restores.where("key < '3'"), restores.where("key >= '3'")
    index = withdrawn.restore_index(older).unionByName(withdrawn.restore_index(newer))
    gone = withdrawn.withdrawn(restores, index, tokens, aliases)
    assert sorted((r.scope_id, r.key, tuple(r.shown)) for r in gone.collect()) == [("s", "1", ("BAFAGO",)), ("s", "6", ("BAFAGO",))]
    assert {r.key for r in withdrawn.safe_restores(restores, gone).collect()} == {"2", "3", "4", "5", "7"}
    assert withdrawn.withdrawn(restores, index, tokens.where("false"), aliases.where("false")).count() == 0
    assert filed.units_of(restores.limit(0).selectExpr("cast('' as binary) as at", "scope_id", "value as text")).count() == 0
    assert enrol.residual(restores.selectExpr("cast(key as long) as doc_id", "scope_id as source", "value as text"), tokens, aliases).count() == 2

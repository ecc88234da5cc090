import pytest
from pyspark.sql import functions as F

from maskwright import schemas
from maskwright.operators.detect import detect_patterns, mask
from maskwright.operators.vault import Vault, restore
from maskwright.plans import enrol
from tests.test_vault import ENTITIES, PARTIES, SALT

TEXTS = [
    (1, "s1", "Henry Zielinski of QUORVANE SHIPPING LIMITED wrote to ada.brenner@corvida.example on +49 30 1234567."),
    (2, "s1", 'IMO: 9074729 MMSI: 235000000 (236111111). Ada Brenner ("AB") of quorvane.example. Then AB paid.'),
    (3, "s2", "Henry Zielinski is nobody here. 4111 1111 1111 1111"),
    (4, "s1", None),
    (5, None, "no scope"),
    (6, "s1", ""),
]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, source string, text string")
    salts = spark.createDataFrame([("s1", bytearray(SALT)), ("s2", bytearray(b"2" * 32))], schemas.SALTS)
    ents = [("s1", e.get("type"), e.get("name"), e.get("identifier"), e.get("identifier_type"), e.get("jurisdiction_country"), e.get("role"), e.get("attributes"), [(r["type"], r["target"], r["shareholding_pct"]) for r in e.get("relationships", [])], i) for i, e in enumerate(ENTITIES)]
    entities = spark.createDataFrame(ents, schemas.SEED_ENTITIES)
    parties = spark.createDataFrame([("s1", p["name"], p["role"], i) for i, p in enumerate(PARTIES)], schemas.SEED_PARTIES)
    return docs, salts, entities, parties


def held(spark, df):
    return spark.createDataFrame(df.collect(), df.schema).coalesce(1)


def test_tables_give_what_one_vault_gives(spark, tables):
    docs, salts, entities, parties = tables
    found = held(spark, detect_patterns(docs).withColumn("language", F.lit("en")))
    tokens, aliases = enrol.enrol(salts=salts, entities=entities, parties=parties, detections=found)
    tokens, aliases = held(spark, tokens), held(spark, aliases)
    more = held(spark, enrol.recall(docs, tokens, aliases, salts))
    tokens, aliases = enrol.enrol(tokens, aliases, salts, recalled=more)
    tokens, aliases = held(spark, tokens), held(spark, aliases)
    v = Vault(salt=SALT)
    v.seed(ENTITIES, PARTIES)
    v.absorb([(r.span, r.kind) for r in found.where("scope_id = 's1'").orderBy("doc_id", "ord").collect()], "en")
    for _, s, t in TEXTS:
        if s == "s1" and t:
            v.recall_identifiers(t), v.recall_domains(t), v.learn_definitions(t)
    assert {r.token for r in tokens.where("scope_id = 's1'").collect()} == set(v.by_token)
    assert {(r.normalized, r.token) for r in aliases.where("scope_id = 's1'").collect()} == {(a.normalized, a.token) for a in v.aliases}
    reds = {r.doc_id: r for r in enrol.redact(docs, tokens, aliases, salts).collect()}
    assert set(reds) == {1, 2, 3, 4, 6}
    for i in (1, 2):
        want = v.redact(TEXTS[i - 1][2])
        assert reds[i].text == want["text"] and reds[i].mapping == want["mapping"] and reds[i].glossary == want["glossary"]
        assert restore(reds[i].text, reds[i].mapping).casefold().replace("limited", "ltd")[:15] == TEXTS[i - 1][2].casefold().replace("limited", "ltd")[:15]
    assert "Zielinski" in reds[3].text and "4111" not in reds[3].text and reds[4].text == ""
    back = enrol.redact(docs, tokens, aliases, salts).select("doc_id", enrol.restored(F.col("text"), F.col("mapping")).alias("t"), "text", "mapping").collect()
    assert all(r.t == restore(r.text, r.mapping) for r in back)
    left = enrol.residual(docs, tokens, aliases).collect()
    assert {r.doc_id for r in left} == {1, 2, 3}
    assert enrol.residual(spark.createDataFrame([(r.doc_id, r.scope_id, r.text) for r in reds.values()], "doc_id long, source string, text string"), tokens, aliases).count() == 0
    rows, some = enrol.seed_graph(tokens, aliases)
    assert rows.count() < tokens.count() and some.count() > 0
    t2, a2, report = enrol.reconcile(tokens, aliases, salts, entities, parties)
    assert report.count() == 2 and t2.count() >= tokens.count()


def test_empty_tables(spark, tables):
    docs, salts, entities, parties = tables
    tokens, aliases = enrol.enrol(salts=salts.limit(0), entities=entities.limit(0))
    assert tokens.count() == aliases.count() == 0
    assert {r.doc_id: r.text for r in enrol.redact(docs, tokens, aliases).collect()}[3] == TEXTS[2][2]


def test_patterns(spark):
    rows = [
        (1, "s", "a.b@c.de, A.B@C.DE noreply@x.yz \\nlena.voss@x.de"),
        (2, "s", "IBAN DE89 3704 0044 0532 0130 00 EUR and 4111-1111-1111-1111 or 1234 5678 9012 3456"),
        (3, "s", "call +49 (30) 123-456-7 or +1 or x+4930123456; PERSON_1@x.de"),
        (4, "s", None),
        (5, "s", "é😀 x@y.zz"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {}
    for r in detect_patterns(df).orderBy("doc_id", "ord").collect():
        got.setdefault(r.doc_id, []).append((r.span, r.kind))
        assert rows[r.doc_id - 1][2][r.start : r.end] == r.span
    assert got == {1: [("a.b@c.de", "EMAIL"), ("lena.voss@x.de", "EMAIL")], 2: [("DE89 3704 0044 0532 0130 00", "IBAN"), ("4111-1111-1111-1111", "CARD")], 3: [("+49 (30) 123-456-7", "PHONE")], 5: [("x@y.zz", "EMAIL")]}
    assert detect_patterns(df, ("IBAN",)).count() == 1
    masked = {r.doc_id: r.m for r in mask(df).select("doc_id", F.col("masked").alias("m")).collect()}
    assert masked[2] == "IBAN <IBAN> EUR and <CARD> or 1234 5678 9012 3456" and masked[5] == "é😀 <EMAIL>" and masked[4] is None


def test_broadcast_and_joined_vaults_redact_alike(spark, tables):
    docs, salts, entities, parties = tables
    found = held(spark, detect_patterns(docs).withColumn("language", F.lit("en")))
    tokens, aliases = enrol.enrol(salts=salts, entities=entities, parties=parties, detections=found)
    one = {r.doc_id: r for r in enrol.redact(docs, tokens, aliases, salts).collect()}
    two = {r.doc_id: r for r in enrol.redact(docs, tokens, aliases, salts, vault_bytes=0).collect()}
    assert one == two and len(one) == 5


def test_ids_of_any_size_keep_their_order(spark):
    rows = [(i, "s", o, "Ada Brenner", "PERSON", "en") for i, o in ((2**62, 0), (-5, 6_000_001), (-5, 1))]
    df = spark.createDataFrame(rows, "doc_id long, scope_id string, ord int, span string, kind string, language string")
    got = enrol.distinct_detections(df).collect()
    assert len(got) == 1 and int(got[0].seq) == -5 * 2**32 + 1
    many = enrol.distinct_detections(df.withColumn("span", F.col("doc_id").cast("string")).withColumn("kind", F.col("ord").cast("string")))
    assert [int(r.seq) // 2**32 for r in many.orderBy("seq").collect()] == [-5, -5, 2**62]


def test_retired_tokens_lead_to_the_row_of_today(spark):
    chain = [("s", f"ORG_{i}", "ORG", f"v{i}", f"v{i}", "retired" if i < 12 else "active", f"ORG_{i + 1}" if i < 12 else None, None, i) for i in range(13)]
    tokens = spark.createDataFrame(chain, schemas.TOKENS)
    assert {r.value for r in enrol.vault_mapping(tokens).collect()} == {"v12"}

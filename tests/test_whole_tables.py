"""Queries over small tables of their own: every row and every kind takes part."""

import hashlib

import pytest

import __spark_entry__ as entry


@pytest.fixture
def write(spark, tmp_path):
    def f(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return f


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(write, texts, source="s"):
    return write("documents", [(i, t, "en", source, len(t)) for i, t in enumerate(texts)], DOCS)


def test_leak_report_searches_documents_and_turns(spark, write):
    write("nation", [(1, "PERU", 9), (2, "KENYA", 9)], "n_nationkey int, n_name string, n_regionkey int")  # of no region in view: no notes on them
    write("region", [("ASIA", 0)], "r_name string, r_regionkey int")
    write("conversations", [(0, 0, "user", "from Peru")], "conv_id long, turn long, role string, text string")
    sf = documents(write, ["to Kenya and Kenya", "all of Asia", "nothing"])
    got = {r.kind: (r.standalone, r.leak) for r in entry.queries()["leak_report"](spark, sf).collect()}
    assert got == {"NATION": (3, True), "REGION": (1, True)}


def test_mask_documents_masks_every_default_kind(spark, write):
    sf = documents(write, ["a@b.org", "call +49 30 1234567", "DE89 3704 0044 0532 0130 00", "4111 1111 1111 1111", "none"])
    assert {r.doc_id: r.n_masked for r in entry.queries()["mask_documents"](spark, sf).collect()} == {0: 1, 1: 1, 2: 1, 3: 1, 4: 0}


def test_redact_documents_refuses_documents_without_a_scope(spark, write):
    write("supplier", [(1, "Acme Ltd")], "s_suppkey long, s_name string")
    sf = write("documents", [(0, "a@b.org", "en", "s", 7), (1, "c@d.org", "en", None, 7)], DOCS)
    got = {r.doc_id: r for r in entry.queries()["redact_documents"](spark, sf).collect()}
    assert got.keys() == {0, 1} and got[0].redacted_count == 1
    assert [got[1][c] for c in ("scope_id", "redacted_count", "entity_types", "n_glossary", "content_sha256")] == [None] * 5


def test_hidden_tokens_are_met_where_their_values_first_stand(spark, write):
    """A card number that an IP address runs into, and an address that ends a sentence, are no matches there, but the same values are further on."""
    texts = ["10.20.30.40 4929348385146306 then x@b.org then 4929348385146306 end", "11.2.3.44. Then y@b.org, then 11.2.3.44 end", "z@b.org then 11.2.3.45"]
    got = entry.queries()["hidden_tokens"](spark, documents(write, texts)).collect()
    assert sorted((r.doc_id, r.place, r.token, r.n) for r in got) == [(0, 1, "IP_0", 1), (0, 2, "CARD_0", 1), (0, 3, "EMAIL_0", 1), (1, 1, "IP_0", 1), (1, 2, "EMAIL_0", 1), (2, 1, "EMAIL_0", 1), (2, 2, "IP_0", 1)]


def test_restore_documents_restores_values_that_stand_beside_themselves(spark, write):
    """Neighbours of one value are one token, which stands for two there and for one elsewhere.  A number within a word is no word of its own: nothing is hidden."""
    write("supplier", [(1, "Acme Ltd")], "s_suppkey long, s_name string")
    a, b = "4929348385146306", "x@b.org"
    texts = [f"{a} {a} and again {a}.", f"{b}\n{b}, {b} {b} {b} but {a} {b} {a}  {a} {b}", f"key {a}\n{a}", f"key ab{a}cd", "none"]
    got = {r.doc_id: (r.restored_sha256, r.hidden) for r in entry.queries()["restore_documents"](spark, documents(write, texts)).collect()}
    assert got == {i: (hashlib.sha256(t.encode()).hexdigest(), i < 3) for i, t in enumerate(texts)}

"""Expressions and tables whose cost or meaning depends on size: many matches in one text, who owns held tables, equal digests."""

import os
import re
import threading
import time

from pyspark.sql import functions as F

from maskwright.functions import columns as C
from maskwright.plans import enrol, requests
from maskwright.sources import held

TEXTS = ["", "a12 b345é😀 c6 d", "no", "7" * 5, "12", "😀1😀22", " ".join(f"x{i}y" for i in range(1000))]


def test_spans_slices_and_replacements_equal_re(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    spans = C.match_spans(F.col("t"), "[0-9]+")
    cuts = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("<é>").alias("value")))
    for r in df.select("i", spans.alias("s"), C.sliced(F.col("t"), spans).alias("m"), C.replaced(F.col("t"), cuts).alias("x")).collect():
        t = TEXTS[r.i]
        assert [tuple(x) for x in r.s] == [m.span() for m in re.finditer("[0-9]+", t)]
        assert r.m == re.findall("[0-9]+", t) and r.x == re.sub("[0-9]+", "<é>", t)


def test_running_of_any_associative_step(spark):
    values = [[], [5], list(range(50)), [3, 9, 2, 9, 11, 1] * 7]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v array<int>")
    for r in df.select("i", C.running(F.col("v")).alias("sums"), C.running(F.col("v"), 0, lambda s, x: F.greatest(s, x)).alias("tops")).collect():
        v = values[r.i]
        assert r.sums == [sum(v[:k]) for k in range(len(v))] and r.tops == [max([0, *v[:k]]) for k in range(len(v))]


def test_half_a_million_tokens_in_one_text(spark):
    n = 500_000
    text = " ".join(f"PERSON_{i + 10_000_000}" for i in range(n))
    df = spark.createDataFrame([(text, {"PERSON_10000007": "Ann Äpfel", f"PERSON_{n + 9_999_999}": "Bob"})], "t string, m map<string,string>")
    before = time.time()
    got = df.select(enrol.restored(F.col("t"), F.col("m")).alias("x")).first().x
    assert time.time() - before < 30
    assert got == text.replace("PERSON_10000007 ", "Ann Äpfel ").replace(f"PERSON_{n + 9_999_999}", "Bob")


def test_held_tables_have_owners(spark):
    paths = {}

    def work(name):
        with held.owned(name) if name != "plain" else held.owned(held.owner()):
            paths[name] = held.hold(spark.range(3)).inputFiles()[0].removeprefix("file://")

    for name in ("a", "b", "plain"):
        t = threading.Thread(target=work, args=(name,))
        t.start()
        t.join()
    mine = held.hold(spark.range(3))
    held.drop_held("a")
    assert [os.path.exists(paths[n]) for n in ("a", "b", "plain")] == [False, True, True] and mine.count() == 3
    held.drop_held("b")
    held.drop_held()
    assert not os.path.exists(paths["b"]) and os.path.exists(paths["plain"])


def test_requests_are_redacted_by_scope_and_digest(spark, monkeypatch):
    monkeypatch.setattr(F, "xxhash64", lambda *_: F.lit(1).cast("long"))  # every hash meets every other
    docs = spark.createDataFrame([(1, "one", 0, "ORG", "Kestrel Ltd"), (2, "two", 0, "ORG", "Harrier Ltd")], "doc_id long, scope_id string, ord int, kind string, span string")
    salts = spark.createDataFrame([("one", b"\x11" * 32), ("two", b"\x22" * 32)], "scope_id string, salt binary")
    tokens, aliases = enrol.enrol(salts=salts, detections=docs)
    turns = spark.createDataFrame([(1, 0, "one", "Kestrel Ltd and Harrier Ltd"), (1, 1, "two", "Kestrel Ltd and Harrier Ltd"), (2, 0, "one", None), (3, 0, None, "Kestrel Ltd")], "conv_id long, turn long, scope_id string, text string")
    out, mapping = requests.redact_requests(turns, tokens, aliases, salts)
    got = {(r.conv_id, r.turn): r.redacted for r in out.collect()}
    assert re.fullmatch(r"ORG_\d+ and Harrier Ltd", got[1, 0]) and re.fullmatch(r"Kestrel Ltd and ORG_\d+", got[1, 1]) and got[3, 0] is None
    assert {(r.conv_id, r.value) for r in mapping.collect()} == {(1, "Kestrel Ltd"), (1, "Harrier Ltd")}

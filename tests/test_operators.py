import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright import schemas
from maskwright.functions import udfs
from maskwright.operators import disclosure, gateway, host, leak, reid, review, spans, usage
from maskwright.plans import requests
from maskwright.sources import sse, store
from maskwright.streaming import audit
from maskwright.streaming.restore import restore_stream
from tests.test_vault import SALT


def test_gateway(spark):
    rows = [(1, "a", 0, "x", ["EMAIL"], 2), (2, "b", 1, "y", [], 0), (3, "c", 2, "z", [], 0), (4, "d", None, "n", [], 0)]
    df = spark.createDataFrame(rows, "id long, actor_id string, sensitivity int, text string, entity_types array<string>, redacted_count int")
    allowed, refused, log = gateway.cross(df, "model")
    assert {r.id for r in allowed.collect()} == {1, 2} and {r.id for r in refused.collect()} == {3, 4}
    got = log.collect()
    assert [r.sensitivity for r in got] == ["public", "internal"] and got[0].detail.redacted_count == 2 and "text" not in log.columns
    passing, seen = gateway.observed(allowed, "crossing")
    assert passing.count() == 2 and seen.get == {"n": 2, "redacted": 2, "most_sensitive": 1}
    with pytest.raises(Exception, match="may not cross"):
        gateway.must_cross(df).collect()
    checked = gateway.check_crossings(log.withColumn("id", F.monotonically_increasing_id() * 0 + F.when(F.col("actor_id") == "a", 1).otherwise(2)), df.select("id", "text"), spark.createDataFrame([(2, ["y"])], "id long, found array<string>")).collect()
    assert {(r.id, r.sha256_matches, r.clean) for r in checked} == {(1, True, True), (2, True, False)}


def test_leaks(spark):
    docs = spark.createDataFrame([(1, "Ada Brenner, xAda Brenner and adaBRENNER; \\nAda Brenner TW"), (2, None), (3, "nothing"), (4, "Straße")], "doc_id long, text string")
    known = spark.createDataFrame([("Ada Brenner", "PERSON"), ("TW", "PERSON"), ("STRASSE", "ADDRESS"), ("brenner", "PERSON")], "surface string, kind string")
    small = {(r.doc_id, r.surface): (r.standalone, r.inside, tuple(r.shapes)) for r in leak.find_known(docs, known).collect()}
    assert small[1, "ada brenner"] == (2, 1, ("x***********",)) and small[1, "brenner"][1] == 1 and small[4, "strasse"][0] == 1
    rep = {r.kind: r for r in leak.report(leak.find_known(docs, known), known).collect()}
    assert rep["PERSON"].leak and rep["PERSON"].skipped == 1 and rep["PERSON"].n_values == 2
    joined = {(r.doc_id, r.surface): (r.standalone, r.inside, tuple(r.shapes)) for r in leak.find_known(docs, known, most_bytes=0).collect()}
    assert joined == small
    tokens = spark.createDataFrame([("s", "PERSON_1", "PERSON", "Ada", "ada", "active", None, None, 0)], schemas.TOKENS)
    aliases = spark.createDataFrame([("s", "PERSON_1", "Brenner", "brenner", "fragment", 0), ("s", "PERSON_1", "Ada", "ada", "entity", 1)], schemas.ALIASES)
    assert {(r.surface, r.kind) for r in leak.known_surfaces(tokens, aliases).collect()} == {("Ada", "PERSON"), ("Brenner", "PERSON")}


def test_leaks_of_any_number_of_surfaces_are_the_same(spark):
    r = random.Random(3)
    letters = ["ß", "ss", "İ", "i", "ı", "e\u0301", "é", "ﬁ", "fi", "K", "\u212a", "Σ", "ς", "x", " ", "_", "\n", "1"]
    word = lambda n: "".join(r.choice(letters) for _ in range(n))
    surfaces = ["Fuß", *(word(r.randrange(2, 6)) for _ in range(60))]
    texts = ["Der FUSS", "mein Fuß", "", None, *(" ".join([word(12), r.choice(surfaces), word(9), r.choice(surfaces).upper()]) for _ in range(60))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = spark.createDataFrame([(s,) for s in [*surfaces, None]], "surface string")
    a, b = (sorted(map(tuple, leak.find_known(docs, known, most_bytes=m).collect())) for m in (0, 10**6))
    assert a == b and {i for i, s, *_ in a if s == "fuss"} >= {0, 1}


def test_nearest_in_blocks_is_that_of_all_pairs(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((900, 5)).round(1)
    v[:300], v[7] = v[0], 0  # a third is one vector, and one has no length
    rows = [(i, int(i % 3), x.tolist()) for i, x in enumerate(v)] + [(1000, 0, None), (1001, 1, [1.0]), (1002, None, [1.0, 2.0, 3.0, 4.0, 5.0])]
    p = spark.createDataFrame(rows, "chunk_id long, scope_id int, vector array<double>")
    q = p.where("chunk_id % 50 = 0 or chunk_id >= 1000").selectExpr("chunk_id as query_id", "vector", "chunk_id as exclude", "scope_id as source")
    got = {}
    for r in reid.nearest(p, q, k=4).orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, r.distance))
    own = {r.query_id: r.own for r in reid.nearest_in_scope(p, q).collect()}
    usable = {i: (s, np.array(x)) for i, s, x in rows if x and len(x) == 5}
    for i in got:
        d = {j: 1 - (x * usable[i][1]).sum() / (np.sqrt((x * x).sum()) * np.sqrt((usable[i][1] ** 2).sum())) for j, (_, x) in usable.items() if j != i and x.any()}
        want = sorted(d.items(), key=lambda t: (t[1], t[0]))[:4]
        assert [j for j, _ in got[i]] == [j for j, _ in want] and np.allclose([x for _, x in got[i]], [x for _, x in want])
        mine = [x for j, x in d.items() if usable[j][0] == usable[i][0] and usable[i][0] is not None]
        assert np.isclose(own[i], min(mine)) if mine else i not in own
    assert set(got) == {i for i, _, x in rows if (i % 50 == 0 or i >= 1000) and x and len(x) == 5}


def test_probe(spark):
    p = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [0.9, 0.1]), (3, "b", [0.0, 1.0]), (4, "c", None), (5, "d", [0.0, 0.0])], "chunk_id long, scope_id string, vector array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0], 1, "a"), (2, [1.0, 0.0], None, "b"), (3, [1.0, 0.0], None, "zz")], "query_id long, vector array<float>, exclude long, source string")
    got = {r.query_id: r for r in reid.probe(p, q, k=2).collect()}
    assert got[1].source_rank == 1 and got[1].identifies and [t.scope for t in got[1].top] == ["a", "b"]
    assert got[2].source_rank is None and abs(got[2].margin - (0 - 1)) < 1e-6 and got[3].margin == pytest.approx(-2.0)
    near = [(r.chunk_id, r.distance) for r in reid.nearest(p, q.where("query_id = 2"), k=9).orderBy("place").collect()]
    assert near[0] == (1, 0.0) and near[-1][0] == 5 and near[-1][1] != near[-1][1]
    assert reid.verdict('{"reference": "A", "clue": "x"}', ["A"]) == ("A", "x") and reid.verdict("no", ["A"]) == ("UNKNOWN", "") and reid.verdict('{"reference": "B"}', ["A"])[0] == "UNKNOWN"


def test_usage(spark):
    m = json.dumps({"input_tokens": 5, "cache_creation_input_tokens": 10, "cache_read_input_tokens": 7, "output_tokens": 3, "cache_creation": {"ephemeral_1h_input_tokens": 4, "ephemeral_5m_input_tokens": 1}})
    schema = "input_tokens long, cache_creation_input_tokens long, cache_read_input_tokens long, output_tokens long, cache_creation struct<ephemeral_1h_input_tokens:long,ephemeral_5m_input_tokens:long>"
    u = spark.createDataFrame([(m,), ("{}",)], "j string").select(usage.from_messages(F.from_json("j", schema)).alias("u")).collect()
    assert tuple(u[0].u) == (5, 6, 4, 7, 3) and tuple(u[1].u) == (0, 0, 0, 0, 0)
    r = spark.createDataFrame([('{"input_tokens": 10, "input_tokens_details": {"cached_tokens": 12}, "output_tokens": 2}',)], "j string").select(usage.from_responses(F.from_json("j", "input_tokens long, input_tokens_details struct<cached_tokens:long>, output_tokens long")).alias("u")).first()
    assert tuple(r.u) == (0, 0, 0, 10, 2)
    prices = spark.createDataFrame([("m", 1.0, 2.0, 0.1), ("m-x", 3.0, 4.0, 0.3)], "model string, input double, output double, read double")
    models = spark.createDataFrame([("m-x-1",), ("m",), ("m[2]",), ("mm",)], "model string")
    assert {x.model: x.price_id for x in usage.price_of(models, prices).collect()} == {"m-x-1": "m-x", "m": "m", "m[2]": "m"}
    reqs = spark.createDataFrame([(1, "m", 1000000, 0, 0, 0, 0), (1, "m-x-1", 0, 0, 1000000, 0, 500000), (2, "mm", 1, 1, 1, 1, 1)], "task_id long, model string, input long, write_5m long, write_1h long, read long, output long")
    got = {x.task_id: x for x in usage.task_cost(reqs, prices).collect()}
    assert got[1].usd == 1 + 6 + 2 and got[1].usd_without_cache == 1 + 3 + 2 and got[1].saved_usd == -3 and got[2].usd is None and got[1].requests == 2


def test_span_joins(spark):
    a = spark.createDataFrame([(1, 0, 10), (1, 20, 30), (2, 0, 5), (1, 7, 7)], "doc long, start long, end long")
    b = spark.createDataFrame([(1, 5, 25), (2, 5, 9)], "doc long, s long, e long")
    for width in (1, 3, 100):
        assert sorted(tuple(r[:3]) for r in spans.overlap_join(a, b, ["doc"], "start", "end", "s", "e", width).collect()) == [(1, 0, 10), (1, 20, 30)]
    left = spans.uncovered(a, b.select("doc", F.col("s").alias("start"), F.col("e").alias("end")), ["doc"])
    assert sorted(tuple(r) for r in left.collect()) == [(1, 7, 7), (2, 0, 5)]
    routes = spark.createDataFrame([("/a", "s1"), ("/a/b", "s2"), ("/c/", "s3")], "prefix string, scope_id string")
    paths = spark.createDataFrame([("/a/b/c",), ("/a/bc",), ("/c/x",), ("/z",), ("/a",)], "path string")
    assert {r.path: r.scope_id for r in store.scope_of_folders(paths, routes).collect()} == {"/a/b/c": "s2", "/a/bc": "s1", "/c/x": "s3", "/z": None, "/a": "s1"}
    lines = spark.createDataFrame([(1, 0, "One {#c1}"), (1, 1, "text"), (1, 2, "Two {#c2} "), (1, 3, "more")], "doc_id long, pos long, line string")
    assert [r.clause for r in review.clauses(lines).orderBy("pos").collect()] == ["c1", "c1", "c2", "c2"]


def test_review_tables(spark):
    ann = spark.createDataFrame([("d", "w", "written", None, "agent", None, 1, True), ("d", "n", "point", None, "agent", None, 2, True), ("d", "x", "decision", "n", "p", "accepted", 3, False), ("d", "r", "revision", None, "p", None, 4, False), ("e", "q", "revision", None, "p", None, 5, False)], "doc string, id string, kind string, about string, creator string, verdict string, at long, by_agent boolean")
    assert [(r.id, r.about_kind, r.verdict) for r in review.records(ann).collect()] == [("x", "point", "accepted")]
    assert [(r.id, r.written_by) for r in review.revisions_of(ann).collect()] == [("r", "agent")]


def test_disclosure_tables(spark):
    tokens = spark.createDataFrame([("s", "PERSON_1", "PERSON", "Ada", "a", "active", None, {"entity_type": "individual"}, 0), ("s", "PERSON_2", "PERSON", "Br", "b", "active", None, {"shared_by": ["PERSON_1"], "fragment": "surname"}, 1), ("s", "EMAIL_1", "EMAIL", "x@y", "x", "active", None, {"source": "residual"}, 2), ("s", "ADDRESS_1", "ADDRESS", "z", "z", "active", None, None, 3)], schemas.TOKENS)
    spans_ = spark.createDataFrame([(1, "PERSON_1", 5), (1, "PERSON_1", 9), (1, "EMAIL_1", 2)], "doc_id long, token string, start int")
    mapping = spark.createDataFrame([(1, "PERSON_1", "Ada"), (1, "EMAIL_1", "x@y"), (1, "ADDRESS_1", "z"), (1, "PERSON_2", "Br")], "doc_id long, token string, value string")
    got = {r.token: (r.n, r.why) for r in disclosure.hidden(spans_, mapping, tokens).collect()}
    assert got == {"PERSON_1": (2, "list"), "EMAIL_1": (1, "pattern"), "ADDRESS_1": (0, "address"), "PERSON_2": (0, "name part")}
    assert {(r.kind, r.n) for r in disclosure.kind_counts(spans_).collect()} == {("PERSON", 2), ("EMAIL", 1)}
    nodes, edges = disclosure.graph(spark.createDataFrame([("d1", "PERSON_1", 2), ("d1", "PERSON_2", 3), ("d2", "EMAIL_1", 1)], "doc string, token string, n long"), tokens)
    assert {(r["from"], r["to"], r.weight) for r in edges.collect()} == {("d:d1", "t:PERSON_1", 5)}
    assert {(r.id, r.kind, r.weight) for r in nodes.collect()} == {("d:d1", "document", 0), ("d:d2", "document", 1), ("t:PERSON_1", "person", 1)}
    kept = disclosure.retained(spark.createDataFrame([(i, 30 << 20, "r") for i in range(4)], "id long, bytes long, run string"))
    assert sorted((r.id, r.kept) for r in kept.collect()) == [(0, False), (1, False), (2, True), (3, True)]
    b = host.brief(spark.createDataFrame([("m", 2, "note", "b  b"), ("m", 1, "task", "x" * 500)], "matter string, at long, kind string, text string")).first()
    assert b.brief.startswith("- task: xxx") and b.brief.endswith("…\n- note: b b")


def test_store(spark, tmp_path):
    s = store.VaultStore(spark, f"file://{tmp_path}/vault")
    assert s.load("tokens").count() == 0
    rows = spark.createDataFrame([("s1", "PERSON_1", "PERSON", "Ada", "ada", "active", None, None, 0), ("s2", "ORG_1", "ORG", "X", "x", "active", None, None, 0)], schemas.TOKENS)
    assert s.commit("tokens", rows) and not s.commit("tokens", rows.limit(0))
    changed = s.load("tokens", ["s1"]).withColumn("status", F.lit("retired"))
    assert s.commit("tokens", changed)
    assert {(r.scope_id, r.status) for r in s.load("tokens").collect()} == {("s1", "retired"), ("s2", "active")}
    a = {r.scope_id: bytes(r.salt) for r in s.ensure_salts(rows).collect()}
    assert len(a) == 2 and all(len(v) == 32 for v in a.values()) and a == {r.scope_id: bytes(r.salt) for r in s.ensure_salts(rows).collect()}
    m = store.merged(rows, rows.where("scope_id = 's1'").withColumn("real_value", F.lit("B")), ["scope_id", "token"])
    assert {r.real_value for r in m.collect()} == {"B", "X"}
    store.save_added(str(tmp_path / "added.toml"), "s1", [{"type": "individual", "name": 'A "B"', "role": ""}])
    (tmp_path / "seed.toml").write_text('[[entity]]\ntype = "company"\nname = "Q Ltd"\nattributes = {imo = 9074729}\n[[party]]\nname = "P"\nrole = "bank"\n')
    e, p = store.load_seeds(spark, [str(tmp_path / "added.toml"), str(tmp_path / "seed.toml")])
    assert [(r.scope_id, r.name) for r in e.orderBy("seq").collect()] == [("s1", 'A "B"'), ("default", "Q Ltd")] and p.first().role == "bank"
    (tmp_path / "bad.toml").write_text('[[entity]]\nname = "x"\n')
    with pytest.raises(ValueError, match="without a type"):
        store.load_seeds(spark, [str(tmp_path / "bad.toml")])
    log = f"file://{tmp_path}/log"
    store.append_log(spark.createDataFrame([(1, "x")], "n long, t string"), log)
    store.append_log(spark.createDataFrame([(2, "y")], "n long, t string"), log)
    assert store.read_log(spark, log, "n long, t string").count() == 2
    ann = [("1", json.dumps({"target": {"source": "d"}}), "d"), ("2", json.dumps({"target": {"source": "other"}}), "d")]
    store.write_annotations(spark.createDataFrame(ann, "id string, annotation string, document string"), f"file://{tmp_path}/ann")
    assert [r.id for r in store.read_annotations(spark, f"file://{tmp_path}/ann").collect()] == ["1"]
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.txt").write_text("a")
    one = store.scan_folder(spark, f"file://{tmp_path}/f").collect()
    (tmp_path / "f" / "b.txt").write_text("b")
    two = store.scan_folder(spark, f"file://{tmp_path}/f")
    diff = spans.changes(spark.createDataFrame(one), two).collect()
    assert [(r.path.rsplit("/")[-1], r.how) for r in diff] == [("b.txt", "added")]
    known = spark.createDataFrame([("k", "old", 1)], "key string, value string, at long")
    new = store.put_restores(known, spark.createDataFrame([("k", "new", 2)], "key string, value string, at long"))
    assert [r.value for r in new.collect()] == ["new"]


def test_request_tables(spark):
    bodies = spark.createDataFrame([(1, json.dumps({"a": ["x", {"b": "y"}], "n": 1})), (2, None)], "request_id long, body string")
    assert {(r.path, r.text) for r in requests.slots(bodies).collect()} == {("a/0", "x"), ("a/1/b", "y")}
    lines = spark.createDataFrame([(json.dumps({"dir": "out", "body": {"t": json.dumps({"z": "deep"})}}),), (json.dumps({"dir": "in", "body": "no"}),)], "value string")
    assert {r.text for r in requests.crossed_strings(lines).collect()} >= {"deep"} and not any(r.text == "no" for r in requests.crossed_strings(lines).collect())
    turns = spark.createDataFrame([(1, 0, "s", "mail a.b@c.de"), (1, 1, "s", "A.B@C.DE again"), (2, 0, "s", "mail a.b@c.de"), (3, 0, "s", None)], "conv_id long, turn long, scope_id string, text string")
    from maskwright.operators.detect import detect_patterns
    from maskwright.plans import enrol

    salts = spark.createDataFrame([("s", bytearray(SALT))], schemas.SALTS)
    found = detect_patterns(turns.withColumn("doc_id", F.col("conv_id") * 10 + F.col("turn")), scope_col="scope_id").withColumn("language", F.lit("en"))
    tokens, aliases = enrol.enrol(salts=salts, detections=found)
    out, mapping = requests.redact_requests(turns, tokens, aliases, salts)
    got = {(r.conv_id, r.turn): r.redacted for r in out.collect()}
    assert len(got) == 4 and got[1, 0] == got[2, 0] and "@" not in got[1, 1] and got[3, 0] == ""
    assert sorted((r.conv_id, r.value) for r in mapping.collect()) == [(1, "a.b@c.de"), (2, "a.b@c.de")]


def test_udfs(spark):
    df = spark.createDataFrame([("José Muñoz",), (None,), ("Quorvane Shipping Ltd",)], "n string")
    got = df.select(udfs.key("n").alias("k"), udfs.skeleton("n").alias("s"), udfs.admit_person("n").alias("a"), udfs.fold("n").alias("f"), udfs.org_variants("n").alias("v"), udfs.person_fragments("n").alias("p"), udfs.legal_form("n").alias("l"), udfs.has_legal_form("n").alias("h"), udfs.defined_terms("n").alias("d")).collect()
    assert got[0].k == "jose munoz" and got[0].a.ok and got[0].f.text == "jose munoz" and len(got[0].f.starts) == 10
    assert got[1].k == "" and not got[1].a.ok and got[2].l == "Ltd" and got[2].h and "Quorvane Shipping" in got[2].v


def test_streaming(spark, tmp_path):
    text = "PERSON_1 and PERSON_12 met person_1."
    mapping = {"PERSON_1": "Ada", "PERSON_12": "Bo"}
    src = tmp_path / "in"
    src.mkdir()
    parts = [text[i : i + 5] for i in range(0, len(text), 5)]
    schema = "stream_id string, block_idx int, seq long, delta string, final boolean"
    for n in range(0, len(parts), 3):
        rows = [{"stream_id": s, "block_idx": 0, "seq": i, "delta": parts[i], "final": i == len(parts) - 1} for s in ("a", "b") for i in range(n, min(n + 3, len(parts)))]
        (src / f"{n:03d}.json").write_text("\n".join(map(json.dumps, rows)))
        os.utime(src / f"{n:03d}.json", (1_700_000_000 + n, 1_700_000_000 + n))  # files are taken in the order of their times
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"file://{src}")
    q = restore_stream(stream, mapping).writeStream.format("memory").queryName("restored").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {}
    for r in spark.table("restored").orderBy("seq").collect():
        got[r.stream_id] = got.get(r.stream_id, "") + r.text
    assert got == {"a": "Ada and Bo met Ada.", "b": "Ada and Bo met Ada."}
    ev = spark.createDataFrame([(1, "x", "2024-01-01 00:10:00", 1.0), (1, "x", "2024-01-01 00:20:00", 2.0), (1, "x", "2024-01-01 02:00:00", 4.0)], "user_id long, event_type string, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r.n, r.total) for r in audit.tumbling(ev).collect()) == [(1, 4.0), (2, 3.0)] and sorted(r.n for r in audit.sessions(ev).collect()) == [1, 2]
    u = spark.createDataFrame([("s", 0, '{"message": {"usage": {"input_tokens": 5, "output_tokens": 1}}}'), ("s", 1, '{"usage": {"output_tokens": 9}}'), ("s", 2, "{}")], "stream_id string, seq long, data string")
    assert tuple(audit.stream_usage(u).first()) == ("s", 5, 9)
    assert sse.parse(spark.createDataFrame([(1, "event: a\ndata: x\n\n: c\n")], "stream_id long, body string")).count() == 2

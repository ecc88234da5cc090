import random
import zlib

import pytest

from maskwright.llm import language_id, queries
from tests.llm.helpers import AWKWARD, DOCS, LONG, docs_frame

SYLLABLES = {"aa": "tha ren lo mi sta or ent ul".split(), "bb": "üng chla kei ße ver zu ach pf".split(), "cc": "ción lle ñas ez que ó rra jo".split()}


def rows(n=300):
    r = random.Random(5)
    out = []
    for i in range(n):
        lang = r.choice(list(SYLLABLES))
        text = " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(12, 80)))
        out.append((i, text.capitalize() + ".", lang, "s", len(text)))
    return out


@pytest.fixture(scope="module")
def learned(spark):
    docs = spark.createDataFrame(rows(), DOCS)
    return docs, language_id.learn(docs, size=4096)


def test_held_out_rows_are_told_and_not_learned_from(spark, learned):
    docs, model = learned
    truth = {r[0]: r[2] for r in rows()}
    got = language_id.identify(docs, model).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    changed = docs.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 then 'other words' else text end as text", "case when crc32(cast(doc_id as string)) % 5 = 0 then 'xx' else lang end as lang")
    assert language_id.learn(changed, size=4096) == model


def test_sizes_are_those_of_zstandard_block_by_block(spark, learned):
    import zstandard as z

    _, model = learned
    text = ("Tha ren 12 Lo mi! " * 700) + "ción"
    folded = language_id.fold(language_id.pa.array([text]))[0].as_py()
    assert folded == " ".join(["tha ren lo mi"] * 700) + " ción"
    want = []
    for contents in model.contents:
        total = 0
        for raw in contents:
            c = z.ZstdCompressor(level=model.level, dict_data=z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT), write_content_size=False)
            b = folded.encode()
            total += sum(len(c.compress(b[i : i + model.block])) for i in range(0, len(b), model.block))
        want.append(total)
    assert language_id.Encoders(model).sizes(folded.encode()) == want
    r = language_id.identify(docs_frame(spark, [text]), model).first()
    assert r.lang_pred == model.languages[want.index(min(want))]
    assert r.margin == pytest.approx((sorted(want)[1] - min(want)) / len(model.contents[0]))


def test_awkward_rows(spark, learned):
    _, model = learned
    texts = [*AWKWARD, "12 345 --- !!", "x" * 300_000, LONG * 5]
    docs = docs_frame(spark, texts, [None, *range(1, len(texts))]).selectExpr("*", "1 as lang_pred", "2 as score", "3 as _text")
    got = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i if i else None]
        if t is None or not any(c.isalpha() for c in t):
            assert (r.lang_pred, r.score, r.rejected, r.margin) == ("und", 0.0, True, None)
        else:
            assert r.lang_pred in model.languages and 0 < r.score <= 1
    assert not got[None].held_out
    assert language_id.identify(docs.limit(0), model).collect() == []


def test_nothing_to_learn_narrow_margins_and_one_language(spark):
    none = language_id.learn(docs_frame(spark, []))
    assert none.languages == [] and language_id.identify(docs_frame(spark, ["a word"]), none).first().lang_pred == "und"
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    one = language_id.learn(docs_frame(spark, ["some words here"] * len(ids), ids))  # a text that repeats teaches once
    assert one.languages == ["en"] and len(one.contents[0][0]) == len("some words here ")
    r = language_id.identify(docs_frame(spark, ["zz"]), one).first()
    assert (r.lang_pred, r.margin, r.rejected, r.score) == ("en", None, False, 1.0)
    both = docs_frame(spark, ["some words here"] * len(ids), ids).selectExpr("doc_id", "text", "if(doc_id % 2 = 0, 'p', 'q') as lang")
    r = language_id.identify(docs_frame(spark, ["some words here"]), language_id.learn(both)).first()
    assert (r.lang_pred, r.margin, r.rejected, r.score) == ("p", 0.0, True, 0.5)


def test_query(spark, sf):
    out = queries.op11_compression_language(spark, sf)
    assert out.dtypes[:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = out.collect()
    assert {r.doc_id for r in got} == set(docs) and len(got) == len(docs)
    held = [r for r in got if r.held_out]
    assert sum(docs[r.doc_id] == r.lang_pred for r in held) >= 0.95 * len(held)

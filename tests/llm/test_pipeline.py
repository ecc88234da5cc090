import random
import re
import struct
import threading

import corpus_pipeline
from maskwright.llm import scratch
from tests.llm import test_near_dedup, test_substring_dedup
from tests.llm.helpers import AWKWARD, PASSAGE, docs_frame
from tests.llm.test_secrets import brute as brute_spans

SF = "/root/testdata/sf0.001"


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def sample(spark):
    r = random.Random(11)
    base = [f"b{i}" for i in range(160)]
    texts = [*AWKWARD, "key token=abcdefgh1 here", *(" ".join(test_near_dedup.edited(base, 3, r)) for _ in range(12))]
    texts += [" ".join(r.choice("qrst") + str(r.randrange(10**6)) for _ in range(80)) + f" token=secret{i}" for i in range(6)]
    return docs_frame(spark, texts)


def test_near_duplicates_and_passages_and_secrets_against_brute_force(spark):
    docs = sample(spark)
    start = rows(docs)
    want = {i for i, _, _, kept in test_near_dedup.brute([(i, r.text) for i, r in start.items()], 5, 80) if kept}
    one = rows(corpus_pipeline.drop_near_duplicates(spark, docs, SF))
    assert set(one) == want and all(one[i] == start[i] for i in want)
    kept = docs.where(docs.doc_id.isin(sorted(want)))
    two = rows(corpus_pipeline.cut_repeated_passages(spark, kept, SF))
    for i, _, gone, text, _ in test_substring_dedup.brute([(i, one[i].text) for i in sorted(want)], 35):
        assert two[i].text == (text if gone else one[i].text) and two[i].n_chars == (len(text) if gone else one[i].n_chars)
        assert (two[i].lang, two[i].source) == (one[i].lang, one[i].source)
    three = rows(corpus_pipeline.mask_secrets(spark, docs, SF))
    assert set(three) == set(start)
    for i, r in three.items():
        assert (r.text == start[i].text) == (not brute_spans(start[i].text))


def test_each_stage_takes_awkward_tables(spark):
    docs = docs_frame(spark, [*AWKWARD, "a", "a"], [*range(len(AWKWARD) - 1), None, None, 3])
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, docs.limit(0)):
            out = stage(spark, table, SF)
            if name != "packing":
                assert out.columns == docs.columns and out.count() <= table.count()
            else:
                assert out.count() >= table.count()


def test_run(spark):
    out = corpus_pipeline.run(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    left = docs[docs.doc_id.isin(out.doc_id)]
    assert 0.5 * len(docs) < len(left) < len(docs)
    assert out.groupby("doc_id").length.sum().eq(out.groupby("doc_id").doc_tokens.first()).all()
    insults = re.compile(r"\b(idiot|moron|scum|loser|clown)\b", re.I)
    hits = left.text.str.count(insults) >= 2
    assert hits.sum() <= 1


def test_repeated_and_missing_ids_lose_no_distinct_text(spark):
    other = " ".join(f"other{i}" for i in range(50))
    third = " ".join(f"third{i}" for i in range(50))
    docs = docs_frame(spark, [other, PASSAGE, PASSAGE, third, PASSAGE, third, "one", "one"], [5, 5, 5, 7, 4, None, None, None])
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted([("5", other), ("4", PASSAGE), ("7", third), ("None", "one")])


def test_pipelines_of_two_threads_keep_their_tables(spark):
    docs = sample(spark)
    mine = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    other = threading.Thread(target=lambda: corpus_pipeline.cut_repeated_passages(spark, docs, SF).count())
    other.start()
    other.join()
    assert mine.count() > 0
    held = [t for t in scratch._open if t == corpus_pipeline._tag()]
    assert len(held) == 1
    corpus_pipeline.cut_repeated_passages(spark, docs, SF)
    assert corpus_pipeline._tag() not in scratch._open


def test_pack_against_the_encoder(spark):
    from maskwright.llm.bpe import vocabulary
    from tokenizers import Tokenizer

    docs = sample(spark)
    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    ids = {}
    for r in corpus_pipeline.pack(spark, docs, SF).orderBy("doc_id", "start").collect():
        assert r.start == len(ids.setdefault(r.doc_id, [])) and r.length == len(r.ids) // 4
        ids[r.doc_id] += struct.unpack(f"<{r.length}I", r.ids)
    assert ids == {i: [*library.encode(r.text or "", add_special_tokens=False).ids, 1] for i, r in rows(docs).items()}

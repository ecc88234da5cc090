import random

import numpy as np
import pyarrow as pa
import pytest

from maskwright.llm import toxicity
from tests.llm.helpers import AWKWARD, docs_frame

LABELS = "doc_id long, quality int, toxic int"
BAD = ["moron", "scum", "vequmo", "vequte", "vequla", "vequru", "loweich", "loweibe"]


def sample(n=600):
    r = random.Random(8)
    syllables = ["tha", "ren", "lo", "mi", "sta", "or", "ent", "ul", "be", "ka"]
    texts, toxic = [], []
    for _ in range(n):
        words = ["".join(r.choice(syllables) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(15, 80))]
        t = int(r.random() < 0.25)
        for _ in range(r.randrange(2, 5) if t else 0):
            w = r.choice(BAD)
            words[r.randrange(len(words))] = r.choice([w, w.upper(), w + "!", w.replace("o", "0")])
        texts.append(" ".join(words))
        toxic.append(t)
    return texts, toxic


@pytest.fixture(scope="module")
def learned(spark):
    texts, toxic = sample()
    docs, labels = docs_frame(spark, texts), spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], LABELS)
    return docs, labels, toxic, toxicity.learn(docs, labels)


def test_held_out_accuracy(spark, learned):
    docs, _, toxic, model = learned
    rows = toxicity.score(docs, model).collect()
    import zlib

    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [(r.predicted, toxic[r.doc_id]) for r in rows if r.held_out]
    assert len(held) > 80 and sum(a == b for a, b in held) / len(held) >= 0.95
    brier = np.mean([(r.score - toxic[r.doc_id]) ** 2 for r in rows if r.held_out])
    assert brier < 0.05


def test_held_out_labels_teach_nothing(spark, learned):
    docs, labels, _, model = learned
    flipped = labels.withColumn("toxic", toxicity.F.when(toxicity.is_held_out(toxicity.F.col("doc_id")), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    other = toxicity.learn(docs.selectExpr("doc_id", "text", "'zz' as lang", "'q' as source"), flipped)
    text = pa.array(sample(40)[0])
    assert (model.score(text) == other.score(text)).all()


def test_batches_do_not_matter(learned):
    model = learned[3]
    texts = pa.array(["*** !!! you moron", "plain words here", "### moron", "", None, "MORON m0ron"])
    whole = model.score(texts)
    assert all(model.score(texts[i : i + 1])[0] == whole[i] for i in range(len(texts)))


def test_awkward_and_unlabelled_tables(spark, learned):
    docs = docs_frame(spark, AWKWARD + ["x"], [*range(len(AWKWARD)), None]).selectExpr("*", "1 as score", "2 as x", "3 as toxic")
    assert toxicity.score(docs, learned[3]).count() == len(AWKWARD) + 1
    none = toxicity.learn(docs, spark.createDataFrame([], LABELS))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}
    one = toxicity.learn(docs, spark.createDataFrame([(1, 1, 1), (2, 1, None), (None, 1, 1)], LABELS))
    assert {r.predicted for r in toxicity.score(docs, one).collect()} == {1}
    assert toxicity.score(docs_frame(spark, []), learned[3]).collect() == []
    kept = toxicity.keep_clean(docs, learned[3])
    assert kept.columns == docs.columns


def test_isotonic_is_the_best_ascending_fit():
    rng = np.random.default_rng(0)
    z = rng.standard_normal(400)
    y = (rng.random(400) < 1 / (1 + np.exp(-2 * z))).astype(float)
    places, values = toxicity.isotonic(z, y, np.ones(400))
    assert (np.diff(places) > 0).all() and (np.diff(values) >= -1e-9).all()
    assert abs(np.interp(z, places, values).mean() - y.mean()) < 0.03

"""Work that must not wait for one task, and memory that must not grow with the table."""

import time

import pyarrow as pa
import pytest

from maskwright import queries
from maskwright.functions import fold as f
from maskwright.plans import enrol
from maskwright.sources import held


def _by_clusters(raw: str) -> tuple[str, tuple, tuple]:
    """`fold`, a base and its marks at a time."""
    text, starts, ends, run = [], [], [], None
    for m in f.regex.finditer(rf"(?P<broken>{f.BROKEN})|(?s:.)\p{{M}}*", raw):
        if m.lastgroup:
            continue
        for c in f._piece(m[0]):
            if c == " ":
                run = (run[0] if run else m.start(), m.end())
                continue
            if run and text:
                text.append(" ")
                starts.append(run[0])
                ends.append(run[1])
            run = None
            text.append(c)
            starts.append(m.start())
            ends.append(m.end())
    return "".join(text), tuple(starts), tuple(ends)


@pytest.mark.parametrize("raw", ["", " a  b ", "Zßa ﬁn", "co-\n op-ed", "é aé", "x​y", "Ⅳ ½ Öl̈", "a\x1c b\x00́", "İı “q”", "й й Ёж"])
def test_letters_in_runs_fold_as_clusters_do(raw):
    got = f.fold(raw)
    assert (got.text, got.starts, got.ends) == _by_clusters(raw)
    assert f.fold_haystack(raw)[0] == f.key(raw)


def test_long_texts_are_folded_in_runs():
    text = "Größe und Maß der Straße, with plain words (and signs). " * 400
    t = time.process_time()
    _by_clusters(text)
    slow, t = time.process_time() - t, time.process_time()
    f.fold(text)
    assert time.process_time() - t < slow / 3


def test_planted_names_are_made_by_all_cores(spark):
    _, tokens, _ = queries._planted(spark, "/root/testdata/sf0.001")
    assert len(tokens.inputFiles()) > 1


def test_workers_keep_no_vault_of_every_scope():
    class Held:
        id = "held"
        value = {"vaults": {}}

    for n in range(2000):
        enrol._vault_of(Held, f"scope{n}")
    assert len(enrol._built) * enrol.VAULT_ROWS <= enrol.BUILT_ROWS
    assert enrol._vault_of(Held, "scope1999") is enrol._vault_of(Held, "scope1999")


def test_batches_become_objects_in_pieces():
    texts = ["a" * (held.PIECE_BYTES + 1), None, "", *["b"] * (2 * held.PIECE_ROWS)]
    got = list(held.pieces(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])))
    assert [t for b in got for t in b["text"].to_pylist()] == texts
    assert got[0].num_rows == 1 and max(b.num_rows for b in got) == held.PIECE_ROWS

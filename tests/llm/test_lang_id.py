import itertools
import zlib

import numpy as np
import pytest

from caseflow.llm import lang_id


@pytest.fixture(scope="module")
def model():
    en = "the of and to in that is was for with this from have are".split()
    fr = "le la les des une est dans pour qui que sur avec pas être".split()
    rng = np.random.default_rng(3)
    return lang_id.fit([(" ".join(rng.choice(ws, 60)), name) for ws, name in ((en, "en"), (fr, "fr")) for _ in range(30)])


def test_marginals_equal_enumeration(model):
    words = "the la of xyz pour".split()
    numbers = model.emissions(words)
    got = model.marginals([numbers, numbers[:2], numbers[:0]])
    for chain, g in zip([numbers, numbers[:2]], got, strict=False):
        n, want, z = len(model.labels), np.zeros((len(chain), 2)), 0.0
        for y in itertools.product(range(n), repeat=len(chain)):
            s = model.start[y[0]] + sum(model._emit[c, a] for c, a in zip(chain, y, strict=True)) + sum(model.trans[a, b] for a, b in zip(y, y[1:], strict=False))
            z += np.exp(s)
            for k, a in enumerate(y):
                want[k, a] += np.exp(s)
        assert np.allclose(g, want / z)
    assert got[2].shape == (0, 2)


def test_code_switching_is_labelled_by_word(model):
    text = "the of and to in le la les des une".split()
    g = model.marginals([model.emissions(text)])[0]
    assert (g[:5].argmax(1) == 0).all() and (g[5:].argmax(1) == 1).all()


def test_texts_without_letters(model):
    assert model.label_texts([None, "", "123 !!", "the"])[:3] == [("und", 0.0)] * 3
    assert lang_id.fit([]).label_texts(["some words"])[0][0] == "und"


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = lang_id.op10_language_id(spark, sf).collect()
    assert len(got) == len(truth)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    out = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in out) / len(out) > 0.97


def test_nulls_long_repeats_and_clashing_columns(spark):
    rows = [(1, None, "en", 1), (None, "the of", None, 2), (2, "the of and " * 50000, "en", 3), (2, "the of and", "en", 4), (3, "le la les", "fr", 5), (4, "", None, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = lang_id.language_id(spark, docs).collect()
    assert len(got) == 6 and {r.doc_id: r.lang_pred for r in got}[1] == "und"
    assert lang_id.language_id(spark, docs.limit(0)).count() == 0

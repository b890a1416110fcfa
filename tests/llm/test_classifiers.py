"""Classifiers on held-out labels, and on rows without text, labels or order."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from orderlake.llm import mil
from orderlake.llm import string_kernel as sk
from orderlake.llm.labelled import labelled_sample
from orderlake.llm.queries import op2_attention_mil_quality, op4_string_kernel_toxicity

SF = "/root/testdata/sf0.01"
ODD = [(0, ""), (1, None), (2, " \n "), (3, "word"), (3, "word"), (None, "text without an id"), (5, "ab cd " * 9000), (6, "é" * 4000)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "old", 7) for r in ODD], "doc_id long, text string, score string, extra int")


@pytest.fixture(scope="module")
def labels(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


@pytest.mark.parametrize("query, label, modulus, held, cut, least", [
    (op2_attention_mil_quality, "quality", 5, 0, 0.3, 0.95),
    (op4_string_kernel_toxicity, "toxic", 3, 1, 0.7, 0.85),
])
def test_held_out(spark, labels, query, label, modulus, held, cut, least):
    rows = query(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    right = total = 0
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == held)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= cut)
        if r.held_out and r.doc_id in labels:
            total += 1
            right += r.predicted == labels[r.doc_id][label]
    assert right >= least * total


@pytest.mark.parametrize("module, label", [(mil, "quality"), (sk, "toxic")])
def test_odd_rows(spark, odd, module, label):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    marks = spark.read.parquet(f"{SF}/labels.parquet")
    model = module.train(docs, marks, label)
    got = module.score(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert got[0].asDict().keys() == {"doc_id", "text", "extra", "score"}
    by_text = {}
    for r in got:
        assert by_text.setdefault(r.text, r.score) == r.score
    assert by_text[""] == by_text[None] == by_text[" \n "]
    assert module.score(odd.where("false"), model).count() == 0


@pytest.mark.parametrize("module, label", [(mil, "quality"), (sk, "toxic")])
def test_one_label_only(spark, odd, module, label):
    marks = spark.createDataFrame([(3, 1, 1), (3, 0, 0), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    model = module.train(odd.select("doc_id", "text"), marks, label)
    assert model == 1.0
    scores = {r.text: r.score for r in module.score(odd, model).collect()}
    assert scores["word"] == 1.0
    assert module.train(odd.where("false").select("doc_id", "text"), marks.where("false"), label) == 0


def test_scores_do_not_depend_on_neighbours():
    texts = ["Some words here, and more of them.", " lead", "", "!!! ### $$$", "tail  ", "a b c d e f g h"]
    alone = [mil.encode_passages(pa.array([t]))[0] for t in texts]
    x, bounds = mil.encode_passages(pa.array(texts))
    for i, one in enumerate(alone):
        assert np.allclose(x[bounds[i] : bounds[i + 1]], one)


def test_attention_finds_the_telling_passage():
    """A bag is bad if one of its passages is; the others are noise."""
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 6, 300)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    x = rng.normal(size=(bounds[-1], 5)).astype(np.float32)
    y = (rng.random(300) < 0.5).astype(np.float32)
    for i in np.flatnonzero(y == 0):
        x[bounds[i] + rng.integers(sizes[i]), 2] = 6
    half = bounds[:201]
    model = mil.fit(x[: half[-1]], half, y[:200], np.ones(200, np.float32))
    rest = bounds[200:] - bounds[200]
    assert ((mil.predict(model, x[bounds[200] :], rest) > 0.5) == (y[200:] == 1)).mean() > 0.95


def test_sample_is_bounded_and_repeats(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    marks = spark.read.parquet(f"{SF}/labels.parquet")
    rows, counts = labelled_sample(docs, marks, "quality", 10, 4000)
    assert len(rows) <= 20 and all(len(r[1].encode()) <= 4000 for r in rows)
    assert sum(counts.values()) == marks.where("quality is not null").count()
    assert rows == labelled_sample(docs, marks, "quality", 10, 4000)[0]


def _slow_kernel(a: bytes, b: bytes) -> float:
    def features(s):
        s = [sk._LETTER[sk._START], *(sk._LETTER[c] for c in s)]
        out = {}
        for i in range(len(s)):
            for j in range(i + 1, len(s)):
                for k in range(j + 1, min(len(s), i + sk.MAX_SPAN)):
                    if s[i] and s[j] and s[k]:
                        key = (s[i], s[j], s[k])
                        out[key] = out.get(key, 0) + sk.LAMBDA ** (k - i + 1)
        return out

    x, y = features(a), features(b)
    norm = np.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
    return sum(v * y.get(k, 0) for k, v in x.items()) / norm if norm else 0.0


def test_kernel_and_folded_weights():
    strings = [b"idiot", b"id-iot", b"iddiot", b"other", b"ab", b"banana", b"i.d.i.o.t", "crème".encode()]
    marks = [b"idiot", b"banana", b"other"]
    got = sk.kernel(strings, marks)
    assert np.allclose(got, [[_slow_kernel(s, m) for m in marks] for s in strings])
    alpha = np.array([0.7, -0.2, 0.4])
    mark, sub, value = sk.feature_rows(sk.units(marks))
    model = sk.Model(np.bincount(sub, value * alpha[mark], minlength=sk.LETTERS**3), -0.1, 1.0, 0.0)
    assert np.allclose(model.values(strings), np.maximum(sk.FLOOR, got @ alpha - 0.1))


def test_spaced_letters_are_one_unit():
    from orderlake.llm.arrow_text import Words, flat

    strings, string, row = sk.document_units(Words(*flat(pa.array(["you i d i o t here", "a b", "x y z"]))))
    assert b"idiot" in strings and b"xyz" in strings and b"ab" not in strings
    assert row[string == strings.index(b"idiot")].tolist() == [0]


def test_spaced_letters_beyond_ascii_are_one_unit():
    from orderlake.llm.arrow_text import Words, flat

    strings, string, row = sk.document_units(Words(*flat(pa.array(["ein d ü m m l i n g hier", "é è", "п л о х о"]))))
    assert "dümmling".encode() in strings and "плохо".encode() in strings and "éè".encode() not in strings
    assert row[string == strings.index("dümmling".encode())].tolist() == [0]


def test_sample_has_its_first_size():
    assert sk.SAMPLE_EACH == 2000 and sk.train.__defaults__[-1] == sk.SAMPLE_EACH

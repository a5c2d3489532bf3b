"""Language and quality: held-out accuracy, what their stages reject, edge cases."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from kinweave.llm import _common, language, quality

SF = "/root/testdata/sf0.01"
NAMES = "doc_id bigint, text string, lang string, source string, n_chars bigint, share string, n string"


def is_held_out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


@pytest.fixture(scope="module")
def model(spark):
    return language.train(language.training_sample(_common.documents(spark, SF)))


def test_languages_held_out(spark):
    rows = language.op4_language(spark, SF).collect()
    truth = {r.doc_id: r.lang for r in _common.documents(spark, SF).collect()}
    assert len(rows) == len(truth) and all(r.held_out == is_held_out(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    held = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out and truth[r.doc_id]]
    assert len(held) > 200 and sum(held) >= 0.98 * len(held)


def test_matrix_equals_brute_force(spark):
    """Posteriors from counts made by plain loops."""
    import numpy as np

    rows = [(i, t, l, None, 0, "x", "y") for i, (t, l) in enumerate([("aba abba", "p"), ("xyx yx", "q"), ("ab", "p"), ("xxy xyy yyx", "q"), ("abab", "p"), ("yx yx", "q")] * 3)]
    docs = spark.createDataFrame(rows, NAMES)
    made = language.train(language.training_sample(docs))
    counts = {"p": {}, "q": {}}
    held = {"p": 0, "q": 0}
    for i, t, l, *_ in rows:
        if not is_held_out(i):
            held[l] += 1
            for g in language.ngrams(t).tolist():
                counts[l][g] = counts[l].get(g, 0) + 1
    size = 1 << language.BUCKETS_LOG2
    for text in ("ab", "yx", "abxy"):
        evidence = []
        grams = language.ngrams(text).tolist()
        for l in ("p", "q"):
            total = sum(counts[l].values()) + language.SMOOTHING * size
            evidence.append(np.log(held[l] / sum(held.values())) + sum(np.log((counts[l].get(g, 0) + language.SMOOTHING) / total) for g in grams) * min(1, language.SHARPNESS / len(grams)))
        names, scores, _ = made.score([text])
        best = int(np.argmax(evidence))
        assert names == ["pq"[best]] and scores[0] == pytest.approx(1 / sum(np.exp(np.array(evidence) - evidence[best])), rel=1e-4)


def test_language_stage_rejects_what_it_does_not_know(spark, model):
    rng = random.Random(3)
    cyrillic = "съешь же ещё этих мягких французских булок да выпей чаю " * 5
    gibberish = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789+/", k=900))
    texts = [None, "", "123 456 !!", cyrillic, gibberish, "的一是不了人我在有他这中大来上国" * 20]
    odd = spark.createDataFrame([(-1 - i, t, "en", "s", 0, "x", "y") for i, t in enumerate(texts)], NAMES)
    assert language.keep_identified(odd, model, 0.35).count() == 0
    docs = _common.documents(spark, SF)
    assert language.keep_identified(docs, model, 0.35).count() >= 0.99 * docs.count()


def test_language_edges(spark):
    rows = [(i, t, l, None, 0, "x", "y") for i, (t, l) in enumerate([("hello there", "en"), ("hola amigo", "es"), ("hello you", "en"), ("hola tu", "es"), (None, "en"), ("", None), ("42", "es"), ("x" * 600_000, None), ("hello there", "en")])]
    docs = spark.createDataFrame(rows, NAMES)
    made = language.train(language.training_sample(docs))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(docs, made).collect()}
    assert len(got) == len(rows) and got[4] == got[5] == got[6] == ("und", 0.0) and got[7][0] in ("en", "es")
    assert language.predict(docs.where("doc_id < 0"), made).count() == 0
    none = language.train(language.training_sample(docs.where("doc_id < 0")))
    assert {r.lang_pred for r in language.predict(docs, none).collect()} == {"und"}
    assert language.keep_identified(docs, made, 0.35).columns == docs.columns
    assert language.keep_identified(docs, none, 0.35).count() == 6


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, "fine words here", None, "s", 0, "x", "y"), (2, None, "en", None, 0, None, None), (2, None, "en", None, 0, None, None), (3, "w " * 80_000, "en", None, 0, "x", "y")], NAMES)
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, None, 0), (3, 1, None), (9, 0, 0)], "doc_id bigint, quality int, toxic int")
    sample = quality.training_sample(docs, labels)
    assert all(len(t or "") <= quality.MOST_CHARS for t, _ in sample) and len(sample) <= 1
    one_label = quality.train(sample)
    assert [r.score for r in quality.predict(docs, one_label).collect()] == [1.0 if sample else 0.5] * 4
    nothing = quality.train(quality.training_sample(docs, labels.where("false")))
    assert {r.score for r in quality.predict(docs, nothing).collect()} == {0.5}
    both = quality.train([("good clean words " * 30, 1), ("BAD!!! $$$ " * 30, 0), (None, 0), ("", 1)] * 3)
    rows = quality.predict(docs, both).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows) and rows[1].score == rows[2].score
    assert quality.predict(docs.where("false"), both).count() == 0
    assert quality.keep_good(docs, both, 0.5).columns == docs.columns


def test_training_sample_is_bounded_where_an_id_repeats(spark):
    one = next(i for i in range(100) if not is_held_out(i))
    docs = spark.createDataFrame([(one, f"text {i}") for i in range(200)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(one, 1, 0)] * 3, "doc_id bigint, quality int, toxic int")
    assert len(quality.training_sample(docs, labels, per_label=10)) <= 30

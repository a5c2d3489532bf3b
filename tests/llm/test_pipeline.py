"""The stages of the pipeline, and the whole of it against a brute-force version."""

import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from kinweave.llm import _common, language, packing, quality, subwords

SF = "/root/testdata/sf0.001"


def test_quality_stage_follows_the_operator(spark):
    """Stage and query decide alike, and short clean documents that no label was learned from stay."""
    sf = "/root/testdata/sf0.1"
    docs = _common.documents(spark, sf)
    kept = {r.doc_id for r in corpus_pipeline.classify_quality(spark, docs, sf).select("doc_id").collect()}
    rows = quality.op9_quality(spark, sf).collect()
    assert kept == {r.doc_id for r in rows if r.predicted}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    short = {r.doc_id for r in docs.where("length(text) < 200").select("doc_id").collect()}
    clean = {r.doc_id for r in rows if r.held_out and r.doc_id in short and labels.get(r.doc_id) == 1}
    assert clean and clean <= kept


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def brute(spark, docs, sf):
    """The ids that stay after each stage, each decided by plain loops over the rows that the stage before kept."""
    rows = {r.doc_id: r.text for r in docs.collect()}
    part = lambda ids: docs.where(F.col("doc_id").isin(*ids))
    after = []
    model = language.train(language.training_sample(docs))
    told = {}
    for i, text in rows.items():
        names, scores, strange = model.score([text])
        told[i] = names[0] != "und" and scores[0] >= corpus_pipeline.LEAST_LANGUAGE_SCORE and not strange[0]
    ids = [i for i in rows if told[i]]
    after.append(set(ids))
    good = quality.train(quality.training_sample(part(ids), spark.read.parquet(f"{sf}/labels.parquet")))
    ids = [i for i in ids if good.score([rows[i]])[0] >= quality.LEAST_SCORE]
    after.append(set(ids))
    first = {}
    for i in sorted(ids):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[i] or ""), i)
    ids = sorted(first.values())
    after.append(set(ids))
    sets = {i: shingles(rows[i]) for i in ids}
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    ids = [i for i in ids if find(i) == i]
    after.append(set(ids))
    coder = subwords.byte_bpe(subwords.tokenizer_path(packing.VOCABULARY), subwords.tokenizer_path(packing.RANKS))
    return after, {i: len(coder.encode(rows[i])) // 4 + 1 for i in ids}


def test_pipeline_equals_brute_force(spark):
    docs = _common.documents(spark, SF)
    after, lengths = brute(spark, docs, SF)
    assert len(after[0]) > len(after[1]) > len(after[2]) > len(after[3]) > 0
    step = docs
    for (name, stage), ids in zip(corpus_pipeline.STAGES[:-1], after):
        step = _common.materialize(stage(spark, step, SF), name)
        assert step.columns == docs.columns and {r.doc_id for r in step.collect()} == ids, name
    rows = corpus_pipeline.run(spark, SF).collect()
    found = {}
    for r in rows:
        found[r.doc_id] = found.get(r.doc_id, 0) + r.length
    assert found == lengths
    places = [(r.sequence_id, r.offset + k) for r in rows for k in range(r.length)]
    assert len(set(places)) == len(places) and max(at for _, at in places) < 1024


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (1, "", "en", "s", 0), (None, "Some plain words of a text, twice.", "en", "s", 9), (None, "Some plain words of a text, twice.", "en", "s", 9), (4, "x" * 9000, None, None, 9000)]])
def test_stages_take_odd_tables(spark, rows):
    names = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame(rows, names)
    for extra in ("share", "__row__", "__id__", "id", "key", "cls", "salt"):
        docs = docs.withColumn(extra, F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() <= len(rows), name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.count() >= len(rows)

"""Operator 4: language identification by multinomial naive Bayes over hashed character n-grams.

Training takes a bounded sample: at most about ``PER_LANGUAGE`` labelled documents of each
language that are not held out, those of smallest id hash, whole texts. Executors count
hashed n-grams of the sample; the counts of all languages, BUCKETS numbers each, meet on the driver
and become one matrix of smoothed log probabilities, which is broadcast (its size depends on the
number of languages alone). Scoring gathers the rows of a batch's n-grams and sums them per
document in numpy, in blocks of bounded size, so very long texts need no more memory.

The score is the posterior of the predicted language with the log likelihood taken per
n-gram and sharpened by a fixed factor, as the plain product is 1.0 for any long text.

Defined results: a null text, an empty one and one without letters are ``und`` with score 0; without any
training rows every text is ``und``; repeated rows are scored each; an empty table gives an empty
result; other columns are ignored; languages of equal likelihood: the first in alphabetical order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import _common

BUCKETS_LOG2 = 16
ORDERS = (1, 2, 3)
#: Bound of the training sample for each language, in documents.
PER_LANGUAGE = 3000
#: Bound of the number of languages learned, those of most labelled documents; the matrix has 256 kB for each.
LANGUAGES = 128
SMOOTHING = 0.1
#: N-grams' worth of evidence that a posterior rests on at most.
SHARPNESS = 60.0
#: A text with a larger share of n-grams that training never saw (and what chance and a small sample add) is of another language.
UNSEEN = 0.12
#: N-grams that are scored at once.
BLOCK = 1 << 18
UNDETERMINED = "und"
LETTER = re.compile(r"[^\W\d_]")


def ngrams(text: str) -> np.ndarray:
    """Bucket of each character n-gram of the lower-case text, all orders together."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    out = []
    mixed = np.zeros(len(codes), np.uint32)
    for order in range(1, max(ORDERS) + 1):
        if order > len(codes):
            break
        n = len(codes) - order + 1
        mixed = (mixed[:n] * np.uint32(0x9E3779B1)) ^ ((codes[order - 1 :] + np.uint32(order)) * np.uint32(0x85EBCA77))
        if order in ORDERS:
            out.append(((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BUCKETS_LOG2))
    return np.concatenate(out)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray  # buckets x (languages + 1); the last column marks n-grams that training never saw
    missing: float = 0.0  # the share of such n-grams that texts of the learned languages are expected to have (Good-Turing)

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Language, score, and whether the text is of none of the learned languages."""
        names, scores, strange = [], [], []
        known = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if self.languages else []
        sums, counts = np.zeros((len(texts), len(self.languages) + 1)), np.zeros(len(texts))
        pending: list[np.ndarray] = []
        rows: list[int] = []
        held = 0

        def flush() -> None:
            nonlocal held
            if pending:
                starts = np.cumsum([0] + [len(p) for p in pending[:-1]])
                np.add.at(sums, rows, np.add.reduceat(self.log_prob[np.concatenate(pending)], starts, axis=0))
            pending.clear(), rows.clear()
            held = 0

        for i in known:
            text = texts[i]
            for a in range(0, len(text), BLOCK):
                grams = ngrams(text[a : a + BLOCK])
                counts[i] += len(grams)
                pending.append(grams)
                rows.append(i)
                held += len(grams)
                if held >= BLOCK:
                    flush()
        flush()
        with_text = set(known)
        for i in range(len(texts)):
            if i not in with_text:
                names.append(UNDETERMINED)
                scores.append(0.0)
                strange.append(False)
                continue
            evidence = self.log_prior + sums[i, :-1] * min(1.0, SHARPNESS / counts[i])
            strange.append(bool(sums[i, -1] / counts[i] > UNSEEN + 3 * self.missing + 1 / np.sqrt(counts[i])))
            best = int(np.argmax(evidence))
            names.append(self.languages[best])
            scores.append(float(1 / np.exp(evidence - evidence[best]).sum()))
        return names, scores, strange


def training_sample(docs: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", languages: int = LANGUAGES) -> DataFrame:
    """(lang, text) of a bounded part of the labelled documents that are not held out."""
    usable = ~_common.held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()
    labelled = docs.where(usable).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), _common.sample_order(id_col).alias("order"))
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    share = F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("n"))
    chosen = labelled.join(F.broadcast(counts.select("lang", share.alias("share"))), "lang")  # at most LANGUAGES rows
    return chosen.where(F.col("order") < F.col("share")).select("lang", "text")


def train(sample: DataFrame) -> Model:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                total = found.setdefault(lang, np.zeros(1 << BUCKETS_LOG2, np.int64))
                docs[lang] = docs.get(lang, 0) + 1
                text = text.as_py()
                for a in range(0, max(1, len(text)), BLOCK):
                    total += np.bincount(ngrams(text[a : a + BLOCK]), minlength=len(total))
        for lang, total in found.items():
            buckets = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(buckets) + 1)), pa.array(np.append(buckets, -1)), pa.array(np.append(total[buckets], docs[lang]))], ["lang", "bucket", "n"])

    counted = _common.mapped(sample, count, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counted.toPandas()  # at most BUCKETS + 1 rows for each language
    languages = sorted(table["lang"].unique())
    docs = np.zeros(len(languages))
    counts = np.zeros((1 << BUCKETS_LOG2, len(languages)))
    for j, lang in enumerate(languages):
        mine = table[table["lang"] == lang]
        rows = mine["bucket"] >= 0
        counts[mine["bucket"][rows], j] = mine["n"][rows]
        docs[j] = mine["n"][~rows].sum()
    smooth = counts + SMOOTHING
    log_prob = np.log(smooth / smooth.sum(axis=0)) if languages else counts
    total = counts.sum(axis=1)
    log_prob = np.concatenate([log_prob, (total == 0)[:, None]], axis=1)
    return Model(languages, np.log(docs / docs.sum()) if languages else docs, log_prob.astype(np.float32), float((total == 1).sum() / max(1, total.sum())))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, kept columns, lang_pred, score) of each whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    columns = [id_col, *keep]
    source = docs.select(text_col, *[F.col(c).alias(f"_{i}") for i, c in enumerate(columns)])
    schema = ", ".join(f"_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(columns)) + ", lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, _ = sent.value.score(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names[1:], "lang_pred", "score"])

    return _common.mapped(source, run, schema).toDF(*columns, "lang_pred", "score")


def keep_identified(docs: DataFrame, model: Model, least_score: float, text_col: str = "text") -> DataFrame:
    """The rows, as they are, whose language is told with at least this score and whose n-grams training has seen but for a few, so that
    other scripts, other languages and gibberish go. Without any language known: those with letters."""
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            if sent.value.languages:
                keep = [name != UNDETERMINED and score >= least_score and not strange for name, score, strange in zip(*sent.value.score(texts))]
            else:
                keep = [bool(t and LETTER.search(t)) for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return _common.mapped(docs, run, docs.schema)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _common.documents(spark, sf_dir)
    scored = predict(docs, train(training_sample(docs)))
    return scored.select("doc_id", _common.held_out("doc_id").alias("held_out"), "lang_pred", "score")

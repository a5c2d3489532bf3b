"""Operator 9: quality scores by attention-based multiple-instance learning.

A document is a bag of passages of about ``PASSAGE_WORDS`` words. Each passage is encoded as
numbers that its text alone gives (kinds of characters, word shapes, repetition, how usual its
character pairs are among good and bad training documents). A gated attention layer, tanh(Vh) * sigmoid(Uh),
weighs the passages; the weighted mean representation is scored by a linear layer. Only document labels are
learned from: attention finds which passages decide.

Training takes a bounded sample (about ``PER_LABEL`` documents for each label, not held out, whole texts of at most ``MOST_CHARS`` characters) to
the driver, with fixed seeds and full-batch Adam, so results are repeatable. Each longer text is also learned from by a
short clip of it, as few labelled documents are short. The model, some kB, is broadcast; scoring is a narrow map over whole texts.

Defined results: a null or empty text is one empty passage, so it has a score too; with one label only, or
no labelled rows, the score is the share of label 1 (0.5 without rows); repeated rows are scored each; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import _common

PASSAGE_WORDS = 60
#: Bound of the training sample for each label, in documents.
PER_LABEL = 1500
#: Longer texts aren't learned from, as the sample is on the driver; they are scored whole like all others.
MOST_CHARS = 40_000
PAIRS_LOG2 = 12
HIDDEN, ATTENTION, STEPS, RATE, DECAY = 16, 8, 300, 0.03, 1e-3
#: A document of this score or more is predicted good, in the query and in the pipeline alike.
LEAST_SCORE = 0.5
#: Texts of more words than CLIPPED are also learned from by a clip of fewer than CLIP words.
CLIPPED, CLIP = 40, (4, 20)

#: Character classes of a byte: upper, lower, digit, space, line end, sentence marks, other marks, beyond ASCII.
CLASSES = np.full(256, 6, np.uint8)
for _i, _members in enumerate((range(65, 91), range(97, 123), range(48, 58), (32, 9, 11, 12, 13), (10,), b".,;:?'\"-()")):
    CLASSES[list(_members)] = _i
CLASSES[128:] = 7
N_CLASSES = 8
N_FEATURES = N_CLASSES + 8


def passages(text: str | None) -> list[bytes]:
    """Pieces of whole words, about equally long; all of the text."""
    words = (text or "").encode("utf-8", "replace").replace(b"\n", b" \n ").split(b" ")
    n = max(1, round(len(words) / PASSAGE_WORDS))
    return [b" ".join(words[len(words) * i // n : len(words) * (i + 1) // n]) for i in range(n)]


def pair_codes(data: np.ndarray) -> np.ndarray:
    """Bucket of each pair of neighbouring bytes."""
    return ((data[:-1].astype(np.uint32) * 257 + data[1:]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - PAIRS_LOG2)


def encode(parts: list[bytes], log_odds: np.ndarray) -> np.ndarray:
    """(passages, N_FEATURES)"""
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = np.concatenate([[0], ends[:-1]])
    size = np.maximum(1, ends - starts - 1).astype(float)
    kinds = CLASSES[data]
    row = np.repeat(np.arange(len(parts)), ends - starts)
    shares = np.bincount(row * N_CLASSES + kinds, minlength=len(parts) * N_CLASSES).reshape(len(parts), N_CLASSES).astype(float)
    shares[:, 4] -= 1  # the joining line end
    odds = np.concatenate([log_odds[pair_codes(data)], [0.0]])
    usual = np.add.reduceat(odds, starts) / size
    after_space = (kinds[:-1] != 3) & (kinds[1:] == 3)
    before_space = np.concatenate([after_space, [False]])
    odd_end = np.add.reduceat((before_space & (kinds == 6)).astype(float), starts)
    mark_pairs = np.add.reduceat(np.concatenate([(kinds[:-1] == 6) & (kinds[1:] == 6), [False]]).astype(float), starts)
    upper_pairs = np.add.reduceat(np.concatenate([(kinds[:-1] == 0) & (kinds[1:] == 0), [False]]).astype(float), starts)
    out = np.zeros((len(parts), N_FEATURES))
    for i, p in enumerate(parts):
        words = p.split()
        n = max(1, len(words))
        distinct = len(set(words))
        repeats = sum(map(bytes.__eq__, words, words[1:]))
        out[i, N_CLASSES : N_CLASSES + 4] = distinct / n, repeats / n, min(20.0, len(p) / n) / 10, min(n, PASSAGE_WORDS) / PASSAGE_WORDS
    words_in = np.maximum(1.0, np.add.reduceat(before_space.astype(float), starts))
    out[:, :N_CLASSES] = shares / size[:, None] * 4
    out[:, N_CLASSES + 4] = np.clip(usual, -3, 3)
    out[:, N_CLASSES + 5] = np.minimum(1.0, odd_end / words_in)
    out[:, N_CLASSES + 6] = mark_pairs / size * 8
    out[:, N_CLASSES + 7] = upper_pairs / size * 4
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def segment_sum(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, starts, axis=0)


@dataclass(frozen=True)
class Model:
    log_odds: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    constant: float | None = None

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        bags = [passages(t) for t in texts]
        starts = np.cumsum([0] + [len(b) for b in bags[:-1]])
        x = (encode([p for b in bags for p in b], self.log_odds) - self.mean) / self.scale
        return forward(self.weights, x, starts)["p"]


def forward(w: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    h = np.tanh(x @ w["E"] + w["e"])
    t, s = np.tanh(h @ w["V"]), sigmoid(h @ w["U"])
    a = np.clip((t * s) @ w["w"], -30, 30)
    lengths = np.diff(np.append(starts, len(x)))
    bag = np.repeat(np.arange(len(starts)), lengths)
    e = np.exp(a)
    alpha = e / segment_sum(e, starts)[bag]
    z = segment_sum(alpha[:, None] * h, starts)
    return {"h": h, "t": t, "s": s, "bag": bag, "alpha": alpha, "z": z, "p": sigmoid(z @ w["c"] + w["b"])}


def gradients(w: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray, y: np.ndarray, importance: np.ndarray) -> dict[str, np.ndarray]:
    f = forward(w, x, starts)
    d = (f["p"] - y) * importance
    bag, alpha, h = f["bag"], f["alpha"], f["h"]
    dz = d[:, None] * w["c"]
    along = (h * dz[bag]).sum(1)
    da = alpha * (along - segment_sum(alpha * along, starts)[bag])
    dts = da[:, None] * w["w"]
    dt, ds = dts * f["s"] * (1 - f["t"] ** 2), dts * f["t"] * f["s"] * (1 - f["s"])
    dh = (alpha[:, None] * dz[bag] + dt @ w["V"].T + ds @ w["U"].T) * (1 - h**2)
    return {"E": x.T @ dh, "e": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": (f["t"] * f["s"]).T @ da, "c": f["z"].T @ d, "b": np.array(d.sum())}


def with_clips(rows: list[tuple[str | None, int]], seed: int) -> list[tuple[str | None, int]]:
    """The rows, and of each longer text a clip of some words at a random place, with the same label."""
    rng = np.random.default_rng(seed)
    clips = []
    for text, label in rows:
        words = (text or "").split(" ")
        if len(words) > CLIPPED:
            n = int(rng.integers(*CLIP))
            at = int(rng.integers(0, len(words) - n))
            clips.append((" ".join(words[at : at + n]), label))
    return rows + clips


def train(rows: list[tuple[str | None, int]], seed: int = 7) -> Model:
    """rows: (text, label) of the bounded sample, in any order."""
    rows = with_clips(sorted(rows, key=lambda r: (r[1], r[0] or "")), seed)
    y = np.array([label for _, label in rows], float)
    empty = np.zeros(1 << PAIRS_LOG2)
    if not len(y) or y.min() == y.max():
        return Model(empty, np.zeros(N_FEATURES), np.ones(N_FEATURES), {}, float(y.mean()) if len(y) else 0.5)
    pairs = np.full((2, 1 << PAIRS_LOG2), 1.0)
    for text, label in rows:
        data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
        pairs[int(label)] += np.bincount(pair_codes(data), minlength=1 << PAIRS_LOG2) / max(1, len(data))
    rates = pairs / pairs.sum(1, keepdims=True)
    log_odds = np.clip(np.log(rates[1] / rates[0]), -3, 3)
    bags = [passages(t) for t, _ in rows]
    starts = np.cumsum([0] + [len(b) for b in bags[:-1]])
    x = encode([p for b in bags for p in b], log_odds)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    x = (x - mean) / scale
    rng = np.random.default_rng(seed)
    shapes = {"E": (N_FEATURES, HIDDEN), "V": (HIDDEN, ATTENTION), "U": (HIDDEN, ATTENTION), "w": (ATTENTION,), "c": (HIDDEN,)}
    w = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) for k, s in shapes.items()} | {"e": np.zeros(HIDDEN), "b": np.zeros(())}
    importance = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    first, second = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
    for step in range(1, STEPS + 1):
        for k, g in gradients(w, x, starts, y, importance).items():
            g = g + DECAY * w[k] * (w[k].ndim > 0) * 0.1
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            w[k] = w[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Model(log_odds, mean, scale, w)


def training_sample(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, most_chars: int = MOST_CHARS) -> list[tuple[str | None, int]]:
    """(text, quality) of at most about per_label documents for each label that are not held out."""
    usable = labels.where(~_common.held_out("doc_id") & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("quality"))
    counts = {r["quality"]: r["n"] for r in usable.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, per_label / n)))])
    chosen = usable.where(_common.sample_order("doc_id") < share[F.col("quality")])
    # the chosen are about 2 * per_label labels, so they may be broadcast; texts on the driver are bounded in number, however often an id repeats, and in length
    picked = docs.select("doc_id", "text").where(F.coalesce(F.length("text"), F.lit(0)) <= most_chars).join(F.broadcast(chosen.distinct()), "doc_id")
    picked = picked.orderBy(_common.sample_order("doc_id"), "doc_id", "quality", F.xxhash64("text")).limit(3 * per_label)
    return [(r["text"], r["quality"]) for r in picked.select("text", "quality").collect()]


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, kept columns, score) of each whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    columns = [id_col, *keep]
    source = docs.select(text_col, *[F.col(c).alias(f"_{i}") for i, c in enumerate(columns)])
    schema = ", ".join(f"_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(columns)) + ", score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores: list[float] = []
            for a in range(0, batch.num_rows, 64):
                scores.extend(sent.value.score(batch.column(0).slice(a, 64).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores, pa.float64())], [*batch.schema.names[1:], "score"])

    return _common.mapped(source, run, schema).toDF(*columns, "score")


def keep_good(docs: DataFrame, model: Model, least_score: float, text_col: str = "text") -> DataFrame:
    """The rows, as they are, that score at least so much."""
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                yield part.filter(pa.array(sent.value.score(part.column(at).to_pylist()) >= least_score))

    return _common.mapped(docs, run, docs.schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _common.documents(spark, sf_dir)
    model = train(training_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    scored = predict(docs, model)
    return scored.select("doc_id", _common.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= LEAST_SCORE).cast("int").alias("predicted"))

"""Operator 6: MinHash near-dedup by a multi-index Hamming join.

A document's set is that of its five-word shingles, as 64-bit hashes. Documents of equal sets
(128-bit digest and size) are one class, known by a number and named by its smallest id. A class has a
signature of ``COMPONENTS`` minwise values of 16 bits. The distance of two signatures is the number of
components that differ; it is split by pigeonhole: in ``CHUNKS`` chunks, two signatures at a distance below
CHUNKS * (ERRORS + 1) agree in one chunk but for ERRORS components at most. These errors are
enumerated: each chunk is indexed once for each component left out, so agreement is equality of a key.

At the least similarity a link needs, 0.75, each chunk agrees with probability 0.63, so a linked
pair is missed by all twelve with probability 6e-6; candidates are all confirmed on full sets.

Large groups never become all pairs. Round one compares each bucket's members with one centre only,
and links found make components. Round two takes up buckets that still hold several components: each goes to one task, in
blocks of bounded size, which meet two by two there, and members of different components are decided there, by their signatures and then on full sets.
Only links that join components go out of a block, at most one for each member. Sets of more than WHOLE shingles go in
as sketches; of these, pairs near enough are confirmed afterwards. What both rounds leave out is of one component already.

Defined results: null and empty texts, and texts without words, have no shingles and are alone;
fewer than five words are one shingle; rows that repeat an id are each of their own text's component; null ids are
linked like others and a component of null ids alone has none; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import os
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import _common
from kinweave.llm.components import components

WORDS = 5
COMPONENTS, CHUNKS, PER_CHUNK = 60, 12, 5
#: One component left out of each chunk.
ERRORS = 1
#: Least similarity of a link, in hundredths.
PERCENT = 75
#: Signatures further apart aren't confirmed: a linked pair lies beyond with probability under 1e-7.
FAR = 35
#: Members of one block in round two, and bytes of a bucket's fine forms that a task holds.
BLOCK, HELD = 512, 32 << 20
#: Most bits, as a power of two, of the filter that says whose sets are needed (16 MB).
FILTER_LOG2 = 27
MEMO_LIMIT = 100_000

#: Bins of the fine sketch, a byte each: the least shingle of each bin.
BINS_LOG2 = 12
#: Sets of this size at most go into blocks whole, larger ones as sketches; 4 kB either way.
WHOLE = 512
#: Standard errors by which a sketch may understate a link's similarity; beyond them with probability under 1e-8.
SIGMAS = 6.0

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_RNG = np.random.default_rng(20240229)
_XOR = _RNG.integers(0, 1 << 32, (COMPONENTS, 1), dtype=np.uint32)
_MUL = _RNG.integers(0, 1 << 31, (COMPONENTS, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_OTHERS = np.array([[c for c in range(PER_CHUNK) if c != out] for out in range(PER_CHUNK)])
_SALT = _RNG.integers(0, 1 << 63, CHUNKS * PER_CHUNK, dtype=np.uint64)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_words = _Words()


def _memos() -> list[dict]:
    return [_words]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles. bytes.split() splits at just the contract's white space."""
    parts = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not parts:
        return np.empty(0, np.uint64)
    if len(_words) > MEMO_LIMIT:
        _words.clear()
    w = np.fromiter(map(_words.__getitem__, parts), np.uint64, len(parts))
    k = min(words, len(w))
    h = np.zeros(len(w) - k + 1, np.uint64)
    for i in range(k):
        h = (h + w[i : len(w) - k + 1 + i]) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(_mix(h + np.uint64(k)))


def signature(shingles: np.ndarray) -> np.ndarray:
    """COMPONENTS values of 16 bits."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(COMPONENTS, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(x), 8192):
        least = np.minimum(least, ((x[a : a + 8192] ^ _XOR) * _MUL).min(axis=1))
    return ((least * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype(np.uint16)


def fine_sketch(shingles: np.ndarray) -> np.ndarray:
    """A byte for each bin of the hash range: 0 if empty, else one of 1 to 255 that stands for its least shingle."""
    bins = (shingles >> np.uint64(64 - BINS_LOG2)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    out = np.zeros(1 << BINS_LOG2, np.uint8)
    out[bins[first]] = shingles[first] % np.uint64(255) + np.uint64(1)
    return out


def may_be_linked(one: np.ndarray, other: np.ndarray, size_one: np.ndarray, size_other: np.ndarray, percent: int) -> np.ndarray:
    """Whether rows of sketches, with the sizes of their sets, can reach the similarity.

    The share of equal bins among those that either set fills is an unbiased estimate, whose variance counts
    that a union of f shingles is drawn without replacement (one-permutation hashing)."""
    least = percent / 100
    sizes = 100 * np.minimum(size_one, size_other) >= percent * np.maximum(size_one, size_other)
    filled = np.maximum(((one | other) > 0).sum(1), 1)
    equal = ((one == other) & (one > 0)).sum(1)
    union = np.maximum((size_one + size_other) / (1 + least), 2.0)
    variance = least * (1 - least) * np.maximum((1 + 1 / (union - 1)) / filled - 1 / (union - 1), 0.0)
    return sizes & (equal / filled >= least - SIGMAS * np.sqrt(variance) - 1 / filled)


def digest(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for the set."""
    return int(shingles.sum(dtype=np.uint64).astype(np.int64)), int(_mix(shingles + np.uint64(1)).sum(dtype=np.uint64).astype(np.int64))


def fine_form(shingles: np.ndarray) -> bytes:
    """The set itself, or the sketch of a large one."""
    return shingles.tobytes() if len(shingles) <= WHOLE else fine_sketch(shingles).tobytes()


def signatures(docs: DataFrame) -> DataFrame:
    """(id, n_shingles, k1, k2, sig) of each row of docs (id, text); k1 and k2 digest the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text.as_py()) for text in batch.column(1)]
            digests = [digest(s) for s in sets]
            sig = [signature(s).tobytes() if len(s) else b"" for s in sets]
            arrays = [pa.array([len(s) for s in sets], pa.int64()), pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()), pa.array(sig, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["id", "n_shingles", "k1", "k2", "sig"])

    return _common.mapped(docs.select("id", "text"), run, "id bigint, n_shingles bigint, k1 bigint, k2 bigint, sig binary", memos=_memos)


def _as_signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), COMPONENTS)


def chunk_keys(sig: np.ndarray, chunk: np.ndarray, left_out: np.ndarray) -> np.ndarray:
    """For each row of signatures the key of its given chunk without the given component."""
    parts = np.take_along_axis(sig.reshape(-1, CHUNKS, PER_CHUNK)[np.arange(len(sig)), chunk], _OTHERS[left_out], 1)
    packed = (parts.astype(np.uint64) << (np.uint64(16) * np.arange(PER_CHUNK - ERRORS, dtype=np.uint64))).sum(1, dtype=np.uint64)
    return _mix(packed ^ _SALT[chunk * PER_CHUNK + left_out])


def first_shared_key(one: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of signatures the first key that both have, and whether there is one; each pair is taken up in that bucket alone."""
    equal = (one == other).reshape(-1, CHUNKS, PER_CHUNK)
    agree = equal.sum(2) >= PER_CHUNK - ERRORS
    chunk = agree.argmax(1)
    left_out = (~equal[np.arange(len(equal)), chunk]).argmax(1)
    return chunk_keys(one, chunk, left_out), agree.any(1)


def index_keys(classes: DataFrame) -> DataFrame:
    """(key, cls): CHUNKS * PER_CHUNK rows of each class, one for each chunk and component left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = _as_signatures(batch.column(1))
            rows, at = np.repeat(np.arange(len(sig)), CHUNKS * PER_CHUNK), np.tile(np.arange(CHUNKS * PER_CHUNK), len(sig))
            keys = chunk_keys(sig[rows], at // PER_CHUNK, at % PER_CHUNK).reshape(len(sig), -1)
            cls = np.repeat(np.asarray(batch.column(0)), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().astype(np.int64)), pa.array(cls)], ["key", "cls"])

    return _common.mapped(classes.select("cls", "sig"), run, "key bigint, cls bigint", rows=2048)


def near_pairs(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures are near enough."""
    one, other = classes.select(F.col("cls").alias("a"), F.col("sig").alias("sig_a")), classes.select(F.col("cls").alias("b"), F.col("sig").alias("sig_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = (_as_signatures(batch.column(2)) != _as_signatures(batch.column(3))).sum(1) <= FAR
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(near)) for c in batch.columns[:2]], ["a", "b"])

    return _common.mapped(pairs.join(one, "a").join(other, "b").select("a", "b", "sig_a", "sig_b"), run, "a bigint, b bigint", rows=4096)


def needed_sets(docs: DataFrame, wanted: DataFrame, as_fine: bool = False) -> DataFrame:
    """(cls, n_shingles, shingles) of the wanted classes, (cls, id, k1, k2, n_shingles), without moving texts.

    Rows whose id is that of a wanted class make their set, its digest says whose it is. A bit map of bounded size tells most
    other rows apart before that; where it is full, sets are made that the join then drops. as_fine: fine forms in place of sets."""
    log2 = min(FILTER_LOG2, max(15, math.ceil(math.log2(8 * max(1, wanted.count())))))
    position = F.pmod(F.xxhash64(F.col("id")), F.lit(1 << log2))
    places = wanted.select(position.alias("p"))
    maps = places.groupBy(F.expr("bitmap_bucket_number(p)").alias("part")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("bits"))
    bits = np.zeros((1 << log2) // 8 + 8192, np.uint8)
    for row in maps.collect():  # 4 kB for each of at most 2^FILTER_LOG2 / 32768 + 1 parts
        a = row["part"] * 4096
        part = np.frombuffer(row["bits"], np.uint8)
        bits[a : a + len(part)] |= part
    sent = docs.sparkSession.sparkContext.broadcast(bits)
    # bucket and bit as Spark numbers them
    column = docs.select("text", F.expr(f"(bitmap_bucket_number(pmod(xxhash64(id), {1 << log2})) * 32768) + bitmap_bit_position(pmod(xxhash64(id), {1 << log2}))").alias("bit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.asarray(batch.column(1))
            hit = np.flatnonzero((sent.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
            found = [s for s in (shingle_set(batch.column(0)[int(i)].as_py()) for i in hit) if len(s)]
            if found:
                digests = [digest(s) for s in found]
                sets = [fine_form(s) if as_fine else s.tobytes() for s in found]
                arrays = [pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()), pa.array([len(s) for s in found], pa.int64()), pa.array(sets, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["k1", "k2", "n_shingles", "shingles"])

    made = _common.mapped(column, run, "k1 bigint, k2 bigint, n_shingles bigint, shingles binary", memos=_memos)
    keys = ["k1", "k2", "n_shingles"]
    return made.dropDuplicates(keys).join(wanted.select("cls", *keys), keys).select("cls", "n_shingles", "shingles")


def confirmed(docs: DataFrame, pairs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs whose full sets are similar enough. The larger classes' sets move first, so a hot smaller one's set isn't copied through a shuffle."""
    ends = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    wanted, wanted_path = _common.stored(classes.select("cls", "id", "k1", "k2", "n_shingles").join(ends, "cls", "left_semi"), "wanted")
    sets = _common.materialize(needed_sets(docs, wanted).select("cls", "shingles"), "sets")
    _common.discard(docs.sparkSession, wanted_path)
    others = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("set_b"))
    centres = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("set_a"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                linked.append(100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(linked, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    return _common.mapped(pairs.join(others, "b").join(centres, "a").select("a", "b", "set_a", "set_b"), run, "a bigint, b bigint")


class Forest:
    """Union-find over the components that meet in one block: keeps the links that join two of them."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (y := self.parent.get(x, x)) != x:
            self.parent[x] = self.parent.get(y, y)
            x = y
        return x

    def joins(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y


def shared_counts(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets at x and y: a product of 0/1 matrices over shingles that two sets have, in blocks of columns."""
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, counts = np.unique(flat, return_inverse=True, return_counts=True)
    held = np.cumsum(counts > 1) - 1
    keep = counts[column] > 1
    row, column = row[keep], held[column[keep]]
    rows_x, rows_y = np.unique(x), np.unique(y)
    at_x, at_y = np.searchsorted(rows_x, x), np.searchsorted(rows_y, y)
    out = np.zeros(len(x), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for a in range(0, int(held[-1]) + 1, 2048):
        low, high = np.searchsorted(column, [a, a + 2048])
        part = np.zeros((len(sets), 2048), np.float32)
        part[row[low:high], column[low:high] - a] = 1
        out += (part[rows_x] @ part[rows_y].T)[at_x, at_y]
    return np.rint(out).astype(np.int64)


def block_links(key: int, left: np.ndarray, right: np.ndarray, cls: np.ndarray, component: np.ndarray, sig: np.ndarray, size: np.ndarray, fine: list[np.ndarray] | Bucket, percent: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Of rows left and right of one bucket that lie in different components: links between them, on full sets, as a
    spanning forest; and pairs with a set too large for that, whose sketches are near enough, to be confirmed.

    A pair that shares several buckets is taken up in the first of them only. left is right: one block with itself, each pair once."""
    xs, ys = [], []
    for a in range(0, len(left), 64):
        some = left[a : a + 64]
        one, other = component[some][:, None], component[right][None, :]
        ok = (one < other if left is right else one != other) & (100 * np.minimum(size[some][:, None], size[right]) >= percent * np.maximum(size[some][:, None], size[right]))
        x, y = np.nonzero(ok)
        x, y = some[x], right[y]
        near = (sig[x] != sig[y]).sum(1) <= FAR
        x, y = x[near], y[near]
        shared_key, shares = first_shared_key(sig[x], sig[y])
        here = shares & (shared_key.astype(np.int64) == key)
        xs.append(x[here]), ys.append(y[here])
    x, y = np.concatenate(xs), np.concatenate(ys)
    small = (size[x] <= WHOLE) & (size[y] <= WHOLE)
    links: list[tuple[int, int]] = []
    if small.any():
        u, v = x[small], y[small]
        if len(u) > 64:
            members, inverse = np.unique(np.concatenate([u, v]), return_inverse=True)
            common = shared_counts([fine[m] for m in members], inverse[: len(u)], inverse[len(u) :])
        else:
            common = np.array([len(np.intersect1d(fine[i], fine[j], assume_unique=True)) for i, j in zip(u, v)])
        linked = 100 * common >= percent * (size[u] + size[v] - common)
        forest = Forest()
        for i, j in zip(u[linked].tolist(), v[linked].tolist()):
            if forest.joins(int(component[i]), int(component[j])):
                links.append((int(cls[i]), int(cls[j])))
    u, v = x[~small], y[~small]
    pairs: list[tuple[int, int]] = []
    for a in range(0, len(u), 1024):
        i, j = u[a : a + 1024], v[a : a + 1024]
        one, other = (np.stack([fine[m] if size[m] > WHOLE else fine_sketch(fine[m]) for m in side]) for side in (i, j))
        near = may_be_linked(one, other, size[i], size[j], percent)
        pairs += zip(cls[i[near]].tolist(), cls[j[near]].tolist())
    return links, pairs


def across_components(docs: DataFrame, shared: DataFrame, labels: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b, sure) of buckets' members that lie in different components: links of blocks, and pairs yet to be confirmed.

    shared: (key, cls, centre, n). The centre was compared with all in round one. A bucket's members go to one task, once; there they make blocks of
    bounded size, which meet two by two, so what is sent and what goes out both grow with the members."""
    rows = shared.where("n > 2 AND cls <> centre").join(labels, F.col("cls") == F.col("node"), "left").select("key", "cls", F.coalesce("component", "cls").alias("component"))
    rows = _common.materialize(rows, "labelled")
    several = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    apart = _common.materialize(rows.join(several, "key"), "apart")
    members = apart.select("cls").distinct()
    wanted = _common.materialize(classes.join(members, "cls", "left_semi").select("cls", "id", "k1", "k2", "n_shingles", "sig"), "wanted")
    fine = needed_sets(docs, wanted, as_fine=True).withColumnRenamed("shingles", "fine")
    known = _common.materialize(wanted.select("cls", "sig").join(fine, "cls"), "fine")
    dealt = apart.join(known, "cls").repartition("key").sortWithinPartitions("key", "component")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket: Bucket | None = None
        for batch in batches:
            key = np.asarray(batch.column(0))
            cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
            for a, b in zip([0, *cuts], [*cuts, len(key)]):
                if bucket is not None and bucket.key != key[a]:
                    yield from bucket.met(percent)
                    bucket = None
                bucket = bucket or Bucket(int(key[a]))
                bucket.add(batch.slice(a, b - a))
        if bucket is not None:
            yield from bucket.met(percent)

    return _common.mapped(dealt.select("key", "cls", "component", "n_shingles", "sig", "fine"), run, "a bigint, b bigint, sure boolean", rows=4096)


class Bucket:
    """Members of one bucket in ascending order of component; their fine forms beyond HELD bytes lie in a file of the task."""

    def __init__(self, key: int):
        self.key, self.parts, self.fine, self.bytes, self.file = key, [], [], 0, None

    def add(self, batch: pa.RecordBatch) -> None:
        self.parts.append([*(np.array(batch.column(i)) for i in (1, 2, 3)), _as_signatures(batch.column(4))])
        for data in batch.column(5).to_pylist():
            if self.bytes + len(data) <= HELD:
                self.fine.append(data)
                self.bytes += len(data)
            else:
                self.file = self.file or tempfile.TemporaryFile(buffering=0)
                self.fine.append((self.file.tell(), len(data)))
                self.file.write(data)

    def __getitem__(self, m: int) -> np.ndarray:
        data = self.fine[m]
        data = data if isinstance(data, bytes) else os.pread(self.file.fileno(), data[1], data[0])
        return np.frombuffer(data, np.uint64 if self.size[m] <= WHOLE else np.uint8)

    def met(self, percent: int) -> Iterator[pa.RecordBatch]:
        """(a, b, sure) of all blocks with all; links join components for the blocks that follow."""
        cls, component, self.size, sig = (np.concatenate(c) for c in zip(*self.parts))
        blocks = np.split(np.arange(len(cls)), range(BLOCK, len(cls), BLOCK))
        at, forest = dict(zip(cls.tolist(), range(len(cls)))), Forest()
        for i, left in enumerate(blocks):
            for right in blocks[i:]:
                least, most = min(component[left].min(), component[right].min()), max(component[left].max(), component[right].max())
                if least == most:
                    continue
                links, pairs = block_links(self.key, left, right, cls, component, sig, self.size, self, percent)
                links = [(a, b) for a, b in links if forest.joins(int(component[at[a]]), int(component[at[b]]))]
                if links:
                    known, back = np.unique(component, return_inverse=True)
                    component = np.array([forest.find(int(c)) for c in known])[back]
                out = links + pairs
                if out:
                    a, b = np.array(out, np.int64).T
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.arange(len(out)) < len(links))], ["a", "b", "sure"])
        if self.file:
            self.file.close()


@dataclass(frozen=True)
class NearGroups:
    """documents: (id, n_shingles, cls); classes: (cls, id, k1, k2, n_shingles, sig); links: (a, b) between classes; labels: (node, component) of linked classes."""

    marks: DataFrame
    classes: DataFrame
    links: DataFrame
    labels: DataFrame


def near_groups(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> NearGroups:
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    marks = _common.materialize(signatures(docs), "signatures")
    grouped = marks.where("n_shingles > 0").groupBy("k1", "k2", "n_shingles").agg(F.min("id").alias("id"), F.any_value("sig").alias("sig"))
    # a class is known by a number of its own, as ids may be missing or stand for several texts; the written table keeps it
    classes = _common.materialize(grouped.withColumn("cls", F.monotonically_increasing_id()), "classes")
    # sets of one or two shingles are linked with equal sets only
    indexed = classes.where("n_shingles > 2")
    keys = index_keys(indexed)
    buckets = keys.groupBy("key").agg(F.min("cls").alias("centre"), F.count("*").alias("n")).where("n > 1")
    shared, shared_path = _common.stored(keys.join(buckets, "key").select("key", "cls", "centre", "n"), "shared")
    stars = shared.where("cls <> centre").select(F.col("centre").alias("a"), F.col("cls").alias("b")).distinct()
    first = _common.materialize(near_pairs(stars, indexed), "pairs")
    links = _common.materialize(confirmed(docs, first, indexed, percent), "links")
    labels = components(links)
    second = _common.materialize(across_components(docs, shared, labels, indexed, percent), "second")
    _common.discard(spark, shared_path)
    more = second.where("sure").select("a", "b").distinct()
    unsure = second.where("NOT sure").select("a", "b").distinct().join(first, ["a", "b"], "left_anti")
    unsure = _common.materialize(unsure, "pairs")
    if not unsure.isEmpty():
        more = more.unionByName(confirmed(docs, unsure, indexed, percent))
    more = _common.materialize(more, "links")
    if not more.isEmpty():
        links = links.unionByName(more)
        labels = components(links)
    return NearGroups(marks, classes, links, labels)


def near_duplicates(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of each row."""
    found = near_groups(docs, percent, id_col, text_col)
    classes = found.classes.select("cls", "id", "k1", "k2", "n_shingles")
    linked = found.labels.join(classes.select("cls", "id"), F.col("node") == F.col("cls")).select("node", "component", "id")
    least = linked.groupBy("component").agg(F.min("id").alias("least"))
    linked = linked.join(least, "component").select("node", "least")
    named = classes.join(linked, F.col("cls") == F.col("node"), "left").select("k1", "k2", "n_shingles", F.coalesce("least", "id").alias("component_id"))
    joined = found.marks.select("id", "n_shingles", "k1", "k2").join(named, ["k1", "k2", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id"))
    return joined.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def keep_representatives(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, as they are, of documents that represent their component. Rows that share an id stay if one of them represents; rows without id stay."""
    verdict = near_duplicates(docs, percent, id_col, text_col)
    gone = _common.free_name(docs, "__id__")
    dropped = verdict.groupBy(id_col).agg(F.max("kept").alias("kept")).where("NOT kept").select(F.col(id_col).alias(gone))
    return docs.join(dropped, F.col(id_col) == F.col(gone), "left_anti")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_common.documents(spark, sf_dir))

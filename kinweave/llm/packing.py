"""Operator 5: best-fit packing by exact-complement hashing.

1. Texts are tokenized and cut into pieces of at most ``window`` ids (one pass, table of
   small rows: piece, start, length, checksum).
2. The histogram of lengths, at most ``window`` numbers however large the input, is all that
   the plan depends on. Lengths and sums of pairs are indexed by their sum, sums of triples through the pairs'.
   From the longest length down, the gap it leaves is looked up among singles, then pairs, then triples;
   a combination that fills it exactly is consumed as often as its lengths' availability counts allow. What
   remains is packed best-fit decreasing, again by counts. Of the ways to spend combinations the one with the fewest sequences is taken.
3. A plan row says: pieces of length L with ranks [first, first + times) are the k-th
   part of ``times`` sequences of one pattern. Ranks within a length come from counts per
   (length, salt) and a row number within each; a length has as many salts as it has rows, so none gathers in one task.

Defined results: null and empty texts have the end id alone, a piece of length 1; repeated
rows are packed each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweave.llm import _common, subwords

WINDOW = 1024
END_ID = 2
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: About how many pieces of one length are ranked in one go.
ROWS = 50_000
#: Parts that the ranks of a length are looked up in.
BLOCKS = 64


def pieces(docs: DataFrame, path: str, ranks_path: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32): texts longer than the window are cut, the first piece takes the rest."""
    field = docs.schema[id_col].dataType.simpleString()
    names = ["id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = subwords.byte_bpe(path, ranks_path), subwords.pack_ids([END_ID])
        for batch in batches:
            rows, out = [], [[], [], [], []]
            for row, text in enumerate(batch.column(1)):
                packed = memoryview(coder.encode(text.as_py()) + end)
                n = len(packed) // 4
                cuts = [0, *range(n % window or window, n, window), n]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    rows.append(row)
                    for column, value in zip(out, (k, a, b - a, zlib.crc32(packed[4 * a : 4 * b]))):
                        column.append(value)
            arrays = [pa.array(out[0], pa.int32()), *(pa.array(x, pa.int64()) for x in out[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *arrays], names)

    schema = f"id {field}, piece int, start bigint, length bigint, ids_crc32 bigint"
    return _common.mapped(docs.select(id_col, text_col), run, schema, memos=subwords.memos).withColumnRenamed("id", id_col)


class Sums:
    """Lengths that are left and the sums of one, two and three of them; a combination is found by its sum, the gap to fill."""

    def __init__(self, left: dict[int, int], even: bool):
        """even: of several pairs that have a sum, the most even one comes first, else the one with the longest part."""
        self.left, self.lengths = left, sorted(left, reverse=True)
        self.pairs: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, a in enumerate(self.lengths):
            for b in self.lengths[i:]:
                self.pairs[a + b].append((a, b))
        if not even:
            for found in self.pairs.values():
                found.reverse()

    def enough(self, parts: tuple[int, ...], beside: tuple[int, ...]) -> bool:
        held = parts + beside
        return all(self.left[x] >= held.count(x) for x in parts)

    def single(self, total: int, beside: tuple[int, ...]) -> tuple[int, ...] | None:
        return (total,) if total in self.left and self.enough((total,), beside) else None

    def pair(self, total: int, beside: tuple[int, ...]) -> tuple[int, ...] | None:
        found = self.pairs.get(total, [])
        while found and not self.enough(found[-1], ()):
            found.pop()  # counts only fall, so it will not be available again
        return next((p for p in reversed(found) if self.enough(p, beside)), None)

    def triple(self, total: int, beside: tuple[int, ...]) -> tuple[int, ...] | None:
        for a in self.lengths:
            if a < total and self.enough((a,), beside) and (rest := self.pair(total - a, (a, *beside))):
                return (a, *rest)
        return None


def best_fit(left: dict[int, int], window: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing by counts: each length, longest first, goes where the least room is left that holds it."""
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []

    def put(room: int, pattern: tuple[int, ...], times: int) -> None:
        if room not in bins:
            bins[room] = []
            bisect.insort(rooms, room)
        bins[room].append((pattern, times))

    for x in sorted(left, reverse=True):
        count = left[x]
        while count:
            at = bisect.bisect_left(rooms, x)
            if at == len(rooms):
                room, pattern, times = window, (), count
            else:
                room = rooms[at]
                pattern, times = bins[room].pop()
                if not bins[room]:
                    del bins[room], rooms[at]
            each = min(room // x, count)  # a bin that took one is the tightest for the next
            n = min(times, count // each)
            if pattern and times > n:
                put(room, pattern, times - n)
            put(room - each * x, pattern + (x,) * each, n)
            count -= n * each
    return [p for found in bins.values() for p in found]


def filled(histogram: dict[int, int], window: int, parts: int, even: bool) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, how often): gaps are filled exactly by up to ``parts`` lengths, singles before pairs before triples; the rest best-fit."""
    sums = Sums({x: n for x, n in histogram.items() if n > 0}, even)
    left, out = sums.left, []
    for find in (sums.single, sums.pair, sums.triple)[:parts]:
        for size in sums.lengths:
            while left[size]:
                more = find(window - size, (size,)) if size < window else ()
                if more is None:
                    break
                pattern = (size, *more)
                times = min(left[x] // pattern.count(x) for x in pattern)
                out.append((pattern, times))
                for x in pattern:
                    left[x] -= times
    return out + best_fit({x: n for x, n in left.items() if n}, window)


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, how often) that use up the histogram, in as few sequences as any order of filling gives.

    Work is bounded by the number of lengths, at most ``window``, for any counts. Which combinations to spend on gaps is a choice: small
    pieces spent early are missed later, so the ways, from singles alone to triples, are all planned and the best is taken."""
    ways = [filled(histogram, window, parts, even) for parts in (1, 2, 3) for even in (True, False)]
    return min(ways, key=lambda w: sum(times for _, times in w))


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, times, first sequence, offset) for each part of each pattern."""
    ranks: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for lengths, times in patterns:
        offset = 0
        for x in lengths:
            rows.append((x, ranks[x], times, sequence, offset))
            ranks[x] += times
            offset += x
        sequence += times
    return rows


def pack(parts: DataFrame, window: int = WINDOW, id_col: str = "doc_id") -> DataFrame:
    """Adds sequence_id and offset. parts: a table (not a plan), as it is read several times."""
    spark = parts.sparkSession
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most window rows
    # ranks of a length are cut in BLOCKS, so that a row meets few slots; at most window * BLOCKS rows beside one for each slot
    width = {x: -(-n // BLOCKS) for x, n in histogram.items()}
    rows = [(x, block, *slot) for x, *slot in slots(plan(histogram, window)) for block in range(slot[0] // width[x], (slot[0] + slot[1] - 1) // width[x] + 1)]
    salts = spark.createDataFrame([(x, -(-n // ROWS), width[x]) for x, n in histogram.items()], "length bigint, salts bigint, width bigint")
    salted = parts.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64(id_col, "start", "ids_crc32"), F.col("salts")).cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    in_salt = F.row_number().over(Window.partitionBy("length", "salt").orderBy(id_col, "start", "ids_crc32"))
    ranked = salted.withColumn("in_salt", in_salt).join(counts.select("length", "salt", before.alias("before")), ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("in_salt") - 1).withColumn("block", F.floor(F.col("rank") / F.col("width")))
    places = spark.createDataFrame(rows, "length bigint, block bigint, first bigint, times bigint, first_sequence bigint, offset bigint")
    here = (F.col("r.length") == F.col("p.length")) & (F.col("r.block") == F.col("p.block")) & (F.col("r.rank") >= F.col("p.first")) & (F.col("r.rank") < F.col("p.first") + F.col("p.times"))
    placed = ranked.alias("r").join(F.broadcast(places).alias("p"), here)
    return placed.select(*(F.col(f"r.{c}") for c in parts.columns), (F.col("p.first_sequence") + F.col("r.rank") - F.col("p.first")).alias("sequence_id"), F.col("p.offset").alias("offset"))


def pack_documents(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    parts = _common.materialize(pieces(docs, subwords.tokenizer_path(VOCABULARY), subwords.tokenizer_path(RANKS), window), "pieces")
    return pack(parts, window)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_common.documents(spark, sf_dir))

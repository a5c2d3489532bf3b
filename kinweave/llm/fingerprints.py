"""Operator 10 [native]: document fingerprints by Order MinHash.

K-mers are two consecutive units of text, a unit being a word or, within longer words, up to
12 characters. They start at each word and, within words of more than 12 characters (unspaced scripts, encoded text), at
each character up to the last 12, so an insertion changes only the k-mers about it. Each k-mer carries its occurrence number, so repeats count. A k-mer's hash
deals it to one of ``BINS`` bins (one-permutation hashing); in each bin the two
occurrence-numbered k-mers of smallest hash are selected, kept in text order, and
hashed as a tuple: moving text about changes the tuples, as it changes the edit
distance. The likeness of two fingerprints is the share of equal tuples among the bins that
either one fills. A text is read once, sorted by hash and folded, O(n log n) for any n.

The edited text takes its second half from the next document by ascending id. The order of ids is
found from ids alone (range partitions, and the first id of each following one), then each
text moves once and half of it once more.

Defined results: null counts as empty; texts without k-mers have the whole text as their one
k-mer; rows that repeat id and text count as one document and each get its result; rows that repeat only
the id are ordered by a hash of the text; after the last document comes the first, so a single document
follows itself; null ids come first; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweave.llm import _common

BINS_LOG2 = 6
UNIT = r"\S{1,12}"
#: What a k-mer's start moves on by: a word's last 12 characters or less with the white space after them, else one character.
STEP = r"(?:\S{1,12}+(?!\S)\s*|\S)"
#: Bits of a k-mer's hash beside those of its position, 63 in all.
HASH_BITS, POSITION_BITS = 39, 24


def _entries(text: str) -> str:
    """SQL: sorted longs of hash and position for each k-mer. Positions beyond 2^24 are scaled down, order kept."""
    kmers = rf"regexp_extract_all({text}, r'(?=({UNIT}\s*{UNIT})){STEP}', 1)"
    some = f"transform(array({kmers}), k -> if(size(k) = 0, array({text}), k))[0]"
    entry = f"shiftleft(pmod(xxhash64(s), {1 << HASH_BITS}L), {POSITION_BITS}) + if(size(k) <= {1 << POSITION_BITS}, i, cast(floor(i * {float(1 << POSITION_BITS)}D / size(k)) AS int))"
    return f"transform(array({some}), k -> sort_array(transform(k, (s, i) -> {entry})))[0]"


def _tuples(entries: str) -> str:
    """SQL: the fold over sorted entries; an int for each filled bin, its number in the high bits."""
    top = (1 << 63) - 1
    bin_shift = HASH_BITS - BINS_LOG2
    pair = "if(a.k2 = {top}L, xxhash64(a.k1), if(a.p1 < a.p2, xxhash64(a.k1, a.k2), xxhash64(a.k2, a.k1)))".format(top=top)
    flushed = f"concat(a.out, array(shiftleft(a.b, {32 - BINS_LOG2}) + cast(pmod({pair}, {1 << (32 - BINS_LOG2)}L) AS int)))"

    def state(b, k1, p1, k2, p2, out="a.out"):
        return f"named_struct('h', s.h, 'occ', s.occ, 'b', {b}, 'k1', {k1}, 'p1', {p1}, 'k2', {k2}, 'p2', {p2}, 'out', {out})"

    start = f"named_struct('h', -1L, 'occ', 0, 'b', -1, 'k1', {top}L, 'p1', 0L, 'k2', {top}L, 'p2', 0L, 'out', cast(array() AS array<int>))"
    step = f"""
      transform(array(named_struct('h', shiftright(x, {POSITION_BITS}), 'p', x & {(1 << POSITION_BITS) - 1}L, 'occ', if(shiftright(x, {POSITION_BITS}) = a.h, a.occ + 1, 0))), s ->
        transform(array(xxhash64(s.h, s.occ)), k ->
          if(cast(shiftright(s.h, {bin_shift}) AS int) = a.b,
             if(k < a.k1, {state("a.b", "k", "s.p", "a.k1", "a.p1")},
                if(k < a.k2, {state("a.b", "a.k1", "a.p1", "k", "s.p")}, {state("a.b", "a.k1", "a.p1", "a.k2", "a.p2")})),
             {state(f"cast(shiftright(s.h, {bin_shift}) AS int)", "k", "s.p", f"{top}L", "0L", f"if(a.b < 0, a.out, {flushed})")}))[0])[0]"""
    return f"aggregate({entries}, {start}, (a, x) -> {step}, a -> {flushed})"


def signature(text: str) -> Column:
    """The tuples of a text expression in SQL, one int for each filled bin."""
    return F.expr(_tuples(_entries(text)))


def shown(tuples: str) -> Column:
    return F.expr(f"array_join(transform({tuples}, x -> lower(lpad(hex(x & 4294967295L), 8, '0'))), '')")


def likeness(one: str, other: str) -> Column:
    shift = 32 - BINS_LOG2
    bins = f"size(array_union(transform({one}, x -> shiftrightunsigned(x, {shift})), transform({other}, x -> shiftrightunsigned(x, {shift}))))"
    return F.expr(f"size(array_intersect({one}, {other})) / cast({bins} AS double)")


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, fingerprint array<int>) without any shuffle."""
    rows = docs.select(F.col(id_col), F.coalesce(text_col, F.lit("")).alias("text"))
    return rows.select(id_col, F.length("text").cast("bigint").alias("n_chars"), signature("text").alias("fingerprint"))


def following(keys: DataFrame) -> DataFrame:
    """(key, n_chars, next_key): each key's successor in ascending order, the first one after the last."""
    ranged = keys.repartitionByRange("key").withColumn("part", F.spark_partition_id())
    ranged = _common.materialize(ranged, "order")
    firsts = ranged.groupBy("part").agg(F.min("key").alias("first"))  # a row for each range
    everywhere = Window.orderBy("part")
    firsts = firsts.select("part", F.coalesce(F.lead("first").over(everywhere), F.first("first").over(everywhere)).alias("then"))
    inside = F.lead("key").over(Window.partitionBy("part").orderBy("key"))
    return ranged.withColumn("inside", inside).join(F.broadcast(firsts), "part").select("key", "n_chars", F.coalesce("inside", "then").alias("next_key"))


def with_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)"""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("h")).alias("key"), text.alias("text"))
    keys = rows.groupBy("key").agg(F.max(F.length("text")).alias("n_chars"), F.count("*").alias("copies"))
    keys = _common.materialize(keys, "keys")
    links = _common.materialize(following(keys.select("key", "n_chars")), "links")
    # each text's signature is made once; from then on it moves alone
    marks = _common.materialize(rows.select("key", signature("text").alias("marks")), "marks")
    if not keys.where("copies > 1").isEmpty():
        marks = marks.dropDuplicates(["key"])
        texts = rows.dropDuplicates(["key"])
    else:
        texts = rows
    heads = links.select(F.col("key").alias("owner"), F.col("next_key").alias("key"), F.floor(F.col("n_chars") / 2).cast("int").alias("half")).join(texts, "key")
    heads = heads.select(F.col("owner").alias("key"), F.col("key").alias("next_key"), F.expr("substring(text, 1, half)").alias("head"))
    both = rows.join(heads, "key").withColumn("n", F.length("text"))
    edited = both.withColumn("edited", F.expr("concat(substring(text, 1, n - cast(floor(n / 2) AS int)), head)"))
    done = edited.select("key", "next_key", F.col("n").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), signature("edited").alias("edited_marks"))
    done = done.join(marks, "key").join(marks.select(F.col("key").alias("next_key"), F.col("marks").alias("next_marks")), "next_key")
    return done.select(
        F.col("key.id").alias(id_col), "n_chars", "edited_sha256", shown("marks").alias("fingerprint"), shown("edited_marks").alias("edited_fingerprint"),
        likeness("marks", "edited_marks").alias("near_edited"), likeness("marks", "next_marks").alias("near_next"),
    )


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_edited(_common.documents(spark, sf_dir))

"""Operator 8 [native]: exact dedup by content-defined chunk recipes.

Normalised texts (each run of white space is one space) are cut where a local pattern of
characters occurs, at 4096 characters at the latest, so equal stretches give equal chunks. A
recipe is the ordered list of a text's chunk identifiers. Each chunk's text moves once, is
deduplicated before and after the shuffle, and so verifies the identifiers: where one hash
stands for several chunk texts, these are numbered and the number joins the identifier. From
then on only recipes are compared, by equality of whole lists, so long documents
don't move again.

Texts of any script are cut by their content: the patterns name Latin letters, marks that end sentences, and some frequent
letters of other scripts. Text that none of them meets, such as encoded data, has chunks of 4096 characters.

Defined results: a null text counts as empty; empty texts are equal to each other; of equal texts
the smallest id stays; rows that repeat id and text share one verdict (the stage keeps one of
them); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import _common

#: Matches each run of white space that isn't one plain space already.
RUNS = r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]"
#: A chunk ends after a letter b to d that starts a word after one that ends in d to t, in other scripts after a mark that ends a sentence or after the first of some
#: characters frequent there, or at most after 4096 characters. Shorter look-behinds are implied by the longer ones and fail sooner.
CHUNK = (
    r"(?s)(?:.{1,4096}?(?:(?<=[b-d])(?<=\x20[b-d])(?<=[d-t][.,]?\x20[b-d])"
    r"|(?<=[^\x00-\x7f])(?:(?<=[。！？؟।不了のは가])|(?<=\x20[внτהو]))|\z))|.{1,4096}"
)


def normalised(text: str | Column) -> Column:
    col = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(col, F.lit("")), RUNS, " ")


def chunk_hash(chunk: Column, bits: int = 64) -> Column:
    """bits below 64 are for tests of what happens when hashes coincide."""
    h = F.xxhash64(chunk)
    return h if bits >= 64 else F.pmod(h, F.lit(1 << bits))


def chunked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_sha256, chunks): each normalised text cut into its chunks, in their order."""
    norm = docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("norm"))
    return norm.select("id", F.sha2("norm", 256).alias("text_sha256"), F.regexp_extract_all("norm", F.lit(CHUNK), F.lit(0)).alias("chunks"))


def colliding(cut: DataFrame, bits: int = 64) -> DataFrame:
    """(h, chunk, number) of the chunk texts that share a hash with another one; cut: (chunks).

    Distinct chunk texts move once, pre-aggregated in each task; hot chunks are thus one row a task. Only if a hash stands for
    several, which 64 bits make rare, are their texts gathered."""
    distinct = cut.select(F.explode("chunks").alias("chunk")).select(chunk_hash(F.col("chunk"), bits).alias("h"), "chunk").distinct()
    shared = _common.materialize(distinct.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "shared")
    if shared.isEmpty():
        return shared.select("h", F.lit("").alias("chunk"), F.lit(0).alias("number"))
    numbers = distinct.join(shared, "h", "left_semi").groupBy("h").agg(F.array_sort(F.collect_list("chunk")).alias("all"))
    return numbers.select("h", F.posexplode("all").alias("number", "chunk")).select("h", "chunk", "number")


def identified(docs: DataFrame, bits: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_sha256, ids): each text's list of verified chunk identifiers. Texts are cut once and stored as chunks."""
    cut = _common.materialize(chunked(docs, id_col, text_col), "chunks")
    clash = _common.materialize(colliding(cut, bits), "clash")
    if clash.isEmpty():
        return cut.select("id", "text_sha256", F.transform("chunks", lambda c: F.struct(chunk_hash(c, bits).alias("h"), F.lit(0).alias("number"))).alias("ids"))
    # a chunk's number is looked up by its text; equal texts have equal numbers, so the digest of the text says whose they are
    parts = cut.select("text_sha256", F.posexplode("chunks").alias("pos", "chunk"))
    numbered = (
        parts.withColumn("h", chunk_hash(F.col("chunk"), bits))
        .join(clash, ["h", "chunk"])
        .groupBy("text_sha256")
        .agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("pos", "number")))).alias("numbers"))
    )
    ids = F.transform("chunks", lambda c, i: F.struct(chunk_hash(c, bits).alias("h"), F.coalesce(F.try_element_at("numbers", i), F.lit(0)).alias("number")))
    return cut.join(numbered, "text_sha256", "left").select("id", "text_sha256", ids.alias("ids"))


def exact_groups(docs: DataFrame, bits: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of each row."""
    rows = _common.materialize(identified(docs, bits, id_col, text_col).withColumn("key", F.xxhash64("ids")), "recipes")
    # groups are a table of their own, so that the rows of a large group may be split in the join
    groups = _common.materialize(rows.groupBy("key", "ids").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1"), "groups")
    joined = rows.alias("r").join(groups.alias("g"), (F.col("r.key") == F.col("g.key")) & (F.col("r.ids") == F.col("g.ids")), "left")
    own = F.col("r.id")
    keep = F.coalesce("g.keep_id", own)
    return joined.select(own.alias(id_col), keep.alias("keep_id"), F.coalesce("g.group_size", F.lit(1)).alias("group_size"), own.eqNullSafe(keep).alias("kept"), F.col("r.text_sha256").alias("text_sha256"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, as they are, without those whose text another row with a smaller id has. Of rows that repeat id and text one stays, whatever
    their other columns hold, as they are copies of one text; only such rows move. Rows without id stay only if no row with one has their text."""
    name = _common.free_name(docs, "__row__")
    row = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"))
    verdict = _common.materialize(exact_groups(docs.select(row.alias(name), text_col), id_col=name, text_col=text_col), "verdict")
    rows = docs.withColumn(name, row)
    left = rows.join(verdict.where("NOT kept").select(name), name, "left_anti")
    repeated = _common.materialize(verdict.where("kept").groupBy(name).agg(F.count("*").alias("n")).where("n > 1").select(name), "repeated")
    if repeated.isEmpty():
        return left.drop(name)
    once = left.join(repeated, name, "left_semi").dropDuplicates([name, text_col])
    return left.join(repeated, name, "left_anti").unionByName(once).drop(name)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_common.documents(spark, sf_dir))


OP8_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""

"""Operator 3 [native]: removal of lines that many sites share, by distinct-site spread.

A line (trimmed) of at least ``min_chars`` characters, by default any that is not blank, is boilerplate if it stands in documents
of at least ``min_sites`` distinct sources. Sites are counted by HyperLogLog sketches per line
hash, merged by partial and final aggregation; hot lines are thus one small sketch per
task. Lines whose estimate is near the threshold (within the sketch's error bounds) get exact
distinct counts, so the verdict is that of exact counts. A document keeps its other lines, in
order and as they were.

Defined results: a null text stays null, with no lines; an empty text has one empty line; a null source
is a site of its own; lines repeated within a document are removed each; repeated rows are
cleaned each; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import _common

MIN_SITES, MIN_CHARS, LG_K = 6, 1, 10
#: Estimates closer to the threshold than this many standard errors (and 1.5 sites) are counted exactly.
SIGMAS = 6


def counts(line: Column, min_chars: int) -> Column:
    """Whether a line is long enough and has more than white space."""
    return (F.length(F.trim(line)) >= min_chars) & line.rlike(r"[^\x20\x09-\x0D]")


def line_hash(line: Column) -> Column:
    """96 bits of two unlike hashes stand for a trimmed line; 64 of them alone might meet by chance in a very large corpus."""
    return F.struct(F.xxhash64(F.trim(line)).alias("a"), F.hash(F.trim(line)).alias("b"))


def hashes(text: str, min_chars: int) -> Column:
    """The distinct line hashes of a text."""
    return F.array_distinct(F.transform(F.filter(F.split(text, "\n"), lambda x: counts(x, min_chars)), line_hash))


def lines(docs: DataFrame, min_chars: int, site_col: str, text_col: str) -> DataFrame:
    """(site, line_hash) of each line that is long enough, once a document."""
    return docs.select(F.coalesce(F.col(site_col), F.lit("")).alias("site"), F.explode(hashes(text_col, min_chars)).alias("line_hash"))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, lg_k: int = LG_K, site_col: str = "source", text_col: str = "text") -> DataFrame:
    """(line_hash) of the lines on at least min_sites sites."""
    seen = lines(docs, min_chars, site_col, text_col)
    spread = seen.groupBy("line_hash").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"))
    width = max(1.5, SIGMAS * 1.04 / 2 ** (lg_k / 2) * min_sites)
    estimate = F.hll_sketch_estimate("sketch")
    judged = _common.materialize(spread.select("line_hash", estimate.alias("sites")).where(F.col("sites") >= min_sites - width), "spread")
    sure = judged.where(F.col("sites") > min_sites + width).select("line_hash")
    near = judged.where(F.col("sites") <= min_sites + width).select("line_hash")
    exact = seen.join(near, "line_hash", "left_semi").groupBy("line_hash", "site").agg(F.count("*").alias("n")).groupBy("line_hash").agg(F.count("*").alias("sites"))
    return sure.unionByName(exact.where(F.col("sites") >= min_sites).select("line_hash"))


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, lg_k: int = LG_K, id_col: str = "doc_id", site_col: str = "source", text_col: str = "text") -> DataFrame:
    """(id, clean_text, n_lines, n_removed). Verdicts meet hashes, not texts; each text moves once at most."""
    common = _common.materialize(boilerplate(docs, min_sites, min_chars, lg_k, site_col, text_col), "boilerplate")
    long = docs.select(F.struct(id_col, F.xxhash64(text_col).alias("text_hash")).alias("row"), F.explode(hashes(text_col, min_chars)).alias("line_hash"))
    found = long.join(common, "line_hash").groupBy("row").agg(F.collect_set("line_hash").alias("removed"))
    split = F.split(text_col, "\n")
    rows = docs.select(F.struct(id_col, F.xxhash64(text_col).alias("text_hash")).alias("row"), F.col(text_col)).join(found, "row", "left")
    keep = F.filter(split, lambda x: ~(counts(x, min_chars) & F.array_contains(F.coalesce("removed", F.array().cast("array<struct<a: bigint, b: int>>")), line_hash(x))))
    cleaned = rows.select(F.col(f"row.{id_col}").alias(id_col), text_col, "removed", F.when(F.col("removed").isNull(), split).otherwise(keep).alias("kept"))
    return cleaned.select(
        id_col,
        F.when(F.col("removed").isNull(), F.col(text_col)).otherwise(F.array_join("kept", "\n")).alias("clean_text"),
        F.when(F.col(text_col).isNull(), 0).otherwise(F.size(split)).cast("bigint").alias("n_lines"),
        F.when(F.col(text_col).isNull(), 0).otherwise(F.size(split) - F.size("kept")).cast("bigint").alias("n_removed"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = remove_boilerplate(_common.documents(spark, sf_dir))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.length("clean_text").cast("bigint").alias("clean_chars"), F.sha2("clean_text", 256).alias("clean_sha256"))


OP3_SQL = rf"""
WITH l AS (SELECT doc_id, coalesce(source, '') AS site, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
b AS (SELECT trim(line) AS line FROM l WHERE length(trim(line)) >= {MIN_CHARS} AND regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1 HAVING count(DISTINCT site) >= {MIN_SITES}),
c AS (SELECT l.doc_id, l.pos, l.line, b.line IS NOT NULL AS gone FROM l LEFT JOIN b ON trim(l.line) = b.line),
d AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS clean FROM c GROUP BY doc_id)
SELECT doc_id, n_lines::BIGINT AS n_lines, n_removed::BIGINT AS n_removed, length(clean)::BIGINT AS clean_chars, sha256(clean) AS clean_sha256 FROM d
"""

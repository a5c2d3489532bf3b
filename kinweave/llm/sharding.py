"""Operator 1 [native]: sharding by fixed virtual slots and a versioned slot-to-shard map.

Rows hash into ``n_slots`` virtual slots, which never change. Version 1 of the map gives each
shard the same number of slots. Bytes are summed per slot (partial sums before the
shuffle), and version 2 is version 1 edited: each shard keeps its largest slots up to an
equal share of the bytes, and only slots beyond that move, the largest first, each to the
shard with the fewest bytes. The edit is a fold over at most ``n_slots`` entries in one row.

Law: ``bytes``, sizes near equal. A row's ``slot`` is its place within its shard, gapless from
0; ``virtual_slot`` is the hash slot. The hash is of the document id, so groups of equal texts
are spread.

Defined results: a null text counts 0 bytes plus the row overhead and has the checksum of no
bytes; a null id hashes like any value; repeated rows are placed each; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweave.llm import _common

N_SHARDS, N_SLOTS, ROW_BYTES = 24, 4096, 8


def sized_rows(docs: DataFrame, n_slots: int = N_SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, virtual_slot): all that moves of a row."""
    text = F.col(text_col).cast("binary")
    return docs.select(
        F.col(id_col),
        (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("bigint").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("bigint").alias("text_crc32"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(n_slots)).cast("int").alias("virtual_slot"),
    )


def first_map(spark: SparkSession, n_shards: int = N_SHARDS, n_slots: int = N_SLOTS) -> DataFrame:
    """Version 1: (version, virtual_slot, shard), as many slots for each shard."""
    slot = F.col("id").cast("int")
    return spark.range(n_slots).select(F.lit(1).alias("version"), slot.alias("virtual_slot"), F.floor(F.col("id") * n_shards / n_slots).cast("int").alias("shard"))


def rebalance(slot_map: DataFrame, slot_bytes: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """The next version of the map. slot_bytes: (virtual_slot, bytes). Only slots beyond a shard's equal share move."""
    loaded = slot_map.join(F.broadcast(slot_bytes), "virtual_slot", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0)))
    largest_first = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot").rowsBetween(Window.unboundedPreceding, 0)
    entries = (
        loaded.withColumn("upto", F.sum("bytes").over(largest_first))
        .groupBy()
        .agg(F.max("version").alias("version"), F.sum("bytes").alias("total"), F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("key"), "virtual_slot", "shard", "bytes", "upto"))).alias("slots"))
    )
    share = f"total / {n_shards}D"
    folded = entries.selectExpr(
        "version",
        f"filter(slots, s -> s.bytes = 0 OR s.upto <= {share}) AS kept",
        f"filter(slots, s -> s.bytes > 0 AND s.upto > {share}) AS over",
    ).selectExpr(
        "version",
        "kept",
        f"""aggregate(over,
            named_struct('loads', transform(sequence(0, {n_shards - 1}), n -> aggregate(filter(kept, s -> s.shard = n), 0L, (a, s) -> a + s.bytes)),
                         'moved', cast(array() AS array<struct<virtual_slot: int, shard: int>>)),
            (acc, s) -> transform(array(cast(array_position(acc.loads, array_min(acc.loads)) - 1 AS int)), best ->
                named_struct('loads', transform(acc.loads, (x, i) -> if(i = best, x + s.bytes, x)),
                             'moved', concat(acc.moved, array(named_struct('virtual_slot', s.virtual_slot, 'shard', best)))))[0]
        ).moved AS moved""",
    )
    rows = folded.selectExpr("version + 1 AS version", "inline(concat(transform(kept, s -> named_struct('virtual_slot', s.virtual_slot, 'shard', s.shard)), moved))")
    return rows.select("version", "virtual_slot", "shard")


def store_map(slot_map: DataFrame, path: str) -> None:
    """Adds the map's versions to a table with a folder for each version."""
    slot_map.write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version, the latest one by default."""
    table = spark.read.parquet(path)
    if version is None:
        return table.join(F.broadcast(table.agg(F.max("version").alias("version"))), "version").select("version", "virtual_slot", "shard")
    return table.where(F.col("version") == version).select("version", "virtual_slot", "shard")


def edit_map(spark: SparkSession, path: str, slot_bytes: DataFrame, n_shards: int = N_SHARDS, n_slots: int = N_SLOTS) -> DataFrame:
    """The map stored at path with one more version, edited from its latest for these bytes; a path without a map starts at version 1."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        store_map(first_map(spark, n_shards, n_slots), path)
    latest = _common.materialize(load_map(spark, path).coalesce(1), "map")
    store_map(rebalance(latest, slot_bytes, n_shards).coalesce(1), path)
    return load_map(spark, path)


def shard(docs: DataFrame, n_shards: int = N_SHARDS, n_slots: int = N_SLOTS, id_col: str = "doc_id", text_col: str = "text", map_path: str | None = None) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot) of each row.

    map_path: the stored map to edit, so that rows move only where sizes ask for it; without one a new map is stored."""
    spark = docs.sparkSession
    rows = sized_rows(docs, n_slots, id_col, text_col)
    per_slot = _common.materialize(rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).coalesce(1), "slots")
    slot_map = edit_map(spark, map_path or _common.scratch_path(spark, "slot-map"), per_slot.select("virtual_slot", "bytes"), n_shards, n_slots)
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    places = (
        slot_map.join(F.broadcast(per_slot), "virtual_slot")
        .select("virtual_slot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    )  # at most n_slots rows
    in_slot = F.row_number().over(Window.partitionBy("virtual_slot").orderBy(id_col, "text_crc32", "size"))
    return (
        rows.withColumn("in_slot", in_slot)
        .join(F.broadcast(places), "virtual_slot")
        .select(
            id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("in_slot") - 1).cast("bigint").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
        )
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(_common.documents(spark, sf_dir))

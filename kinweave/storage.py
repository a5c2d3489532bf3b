"""Tables in the folder that all executors share, which cut the lineage of loops."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a session on one machine may go without."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="kinweave-scratch-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


_scopes: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[list[str]]:
    """Tables written inside are deleted at the end, but for paths taken out of the list."""
    _scopes.append(made := [])
    try:
        yield made
    finally:
        _scopes.remove(made)
        discard(spark, *made)


def stored(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Writes df as a table, reads it again, and gives its path, for discard(). A lost executor loses nothing of it."""
    path = f"{scratch_dir(df.sparkSession)}/kinweave/{label}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, label: str) -> DataFrame:
    return stored(df, label)[0]


def swept(df: DataFrame) -> DataFrame:
    """The same, after the driver has collected garbage: shuffle files of ended jobs go then, else only when its memory happens to fill."""
    gc.collect()
    df.sparkSession._jvm.System.gc()
    return df


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that no later plan reads."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

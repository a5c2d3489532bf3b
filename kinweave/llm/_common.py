"""What the training-data operators share: inputs, shared scratch tables, the labelled split, lean Python workers."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave import storage
from kinweave.storage import discard, materialize, stored

__all__ = ["SPACE", "discard", "documents", "free_name", "held_out", "mapped", "materialize", "release", "sample_order", "scratch_path", "stored"]

#: White space as the contracts define it.
SPACE = r"[\x20\x09-\x0D]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{storage.scratch_dir(spark)}/kinweave/{label}-{uuid.uuid4().hex}"


#: Rows that Spark hands to a Python worker at once; its default of 10,000 whole texts is tens of MB in the JVM and again in Python.
ARROW_ROWS, _ARROW_SETTING = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, rows: int = 256, memos: Callable[[], list] = list) -> DataFrame:
    """df.mapInArrow(run, schema) that leaves a reused worker as small as it was.

    Batches come in parts of few rows, so copies of their texts are small; after a partition the memos (of pre-tokens, words) are emptied
    and freed memory goes back to the system. Larger batches than ARROW_ROWS are turned down in the session, as plans take the setting from there."""
    session = df.sparkSession
    if int(session.conf.get(_ARROW_SETTING)) > ARROW_ROWS:
        session.conf.set(_ARROW_SETTING, str(ARROW_ROWS))

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(part for batch in batches for part in _parts(batch, rows))
        finally:
            for memo in memos():
                memo.clear()
            release()

    return df.mapInArrow(wrapped, schema)


def _parts(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    for a in range(0, batch.num_rows, rows):
        yield batch.slice(a, rows)


def release() -> None:
    """Gives memory that is free, but held by allocators, back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library without it keeps its memory
        pass


def free_name(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have, in any case of letters."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(doc_id: str | Column) -> Column:
    """True for the third of the documents that no label may be learned from."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample_order(doc_id: str | Column) -> Column:
    """A number in [0, 1) that depends on the document id alone; orders bounded training samples."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.xxhash64(col, F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))

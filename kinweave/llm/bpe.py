"""Operator 2: BPE encoding and decoding by tree concatenation.

Every text is encoded as the ``tokenizers`` library does with the given file. Long texts are
halved down to leaves; each join re-encodes a window that grows until both sides agree
(``subwords``). Work on a row needs nothing of another, so a lost executor costs only its
own partitions, and memory is bounded by one Arrow batch and the longest text.

Defined results: null and empty texts have no ids and decode to the empty text; repeated
rows give repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from kinweave.llm import _common, subwords

VOCABULARY = "word_bpe_49k.json"


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of each whole text."""
    field = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = subwords.word_bpe(path)
        for batch in batches:
            ids = [subwords.unpack_ids(coder.encode(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    return _common.mapped(docs.select(id_col, text_col), run, f"id {field}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of each list of ids; null lists give empty texts."""
    field = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = subwords.word_bpe(path)
        for batch in batches:
            texts = [coder.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"id {field}, text string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes in one pass: (id, n_tokens, ids_sha256, decoded_sha256)."""
    field = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = subwords.word_bpe(path)
        for batch in batches:
            n, a, b = [], [], []
            for text in batch.column(1):
                packed = coder.encode(text.as_py())
                n.append(len(packed) // 4)
                a.append(hashlib.sha256(packed).hexdigest())
                b.append(hashlib.sha256(coder.decode(subwords.unpack_ids(packed)).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = f"id {field}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return _common.mapped(docs.select(id_col, text_col), run, schema).withColumnRenamed("id", id_col)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(_common.documents(spark, sf_dir), subwords.tokenizer_path(VOCABULARY))

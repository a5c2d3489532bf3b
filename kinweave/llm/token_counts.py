"""Operator 7: token counts of a unigram tokenizer by a count-only Viterbi pass.

The text is cut as a sentencepiece-style pre-tokenizer does: spaces become the word mark, one
stands in front, and each mark starts a word. For a word, an Aho-Corasick automaton over the
vocabulary enumerates all pieces that end at each character; dynamic programming carries, for
each end, the best score, the number of pieces on that path and whether it ends in an unknown
character. Ties go to the path found first, which is the one whose last piece starts
first; a character that no piece covers alone is unknown, at the lowest score less 10, and
neighbouring unknown characters count as one. No path is kept, so memory is three numbers a
character. Words' counts are remembered in a bounded table.

The vocabulary is that of a public file; its merge-order scores serve as the unigram scores. Pieces with the
file's lowest score (runs of marks) are left out, as words hold one mark.

Defined results: null and empty texts have no tokens; repeated rows are counted each; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from kinweave.llm import _common, subwords

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0


@lru_cache(maxsize=2)
def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece file, without control, byte and run-of-marks pieces; the unknown piece first."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [("<unk>", 0.0)]
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or MARK in piece[1:]):
            pieces.append((piece, float(model.get_score(i))))
    return pieces


class Counter:
    memo_limit = 150_000

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces[1:]:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.memo: dict[str, int] = {}

    def word(self, word: str) -> int:
        """The number of pieces of the best path."""
        n = len(word)
        ends: list[list] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(word):
            ends[end].append(match)
        score, count, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for end, matches in enumerate(ends, 1):
            best, pieces, ends_unknown = None, 0, False
            alone = False
            for length, value in sorted(matches, reverse=True):
                start = end - length
                alone |= length == 1
                total = value + score[start]
                if best is None or total > best:
                    best, pieces, ends_unknown = total, count[start] + 1, False
            if not alone:
                total = self.unknown + score[end - 1]
                if best is None or total > best:
                    best, pieces, ends_unknown = total, count[end - 1] + (not unknown[end - 1]), True
            score[end], count[end], unknown[end] = best, pieces, ends_unknown
        return count[n]

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        memo, words = self.memo, text.replace(MARK, " ").split(" ")
        if words[0] == "" and len(words) > 1:
            words = words[1:]  # a text that starts with a mark gets no other
        try:
            return sum([memo[w] for w in words])
        except KeyError:
            pass
        if len(memo) > self.memo_limit:
            memo.clear()
        total = 0
        for w in words:
            n = memo.get(w)
            if n is None:
                n = self.word(MARK + w)
                if len(w) <= 256:
                    memo[w] = n
            total += n
        return total


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(vocabulary(path))


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens) of each whole text."""
    field = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).text
        for batch in batches:
            n = [count(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["id", "n_tokens"])

    return _common.mapped(docs.select(id_col, text_col), run, f"id {field}, n_tokens bigint").withColumnRenamed("id", id_col)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_common.documents(spark, sf_dir), subwords.tokenizer_path(VOCABULARY))

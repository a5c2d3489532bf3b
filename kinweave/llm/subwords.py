"""Subword encoders that agree with the public tokenizer files, id by id.

A text whose characters all lie in ASCII and Latin-1 (no rare controls) is split by
``re`` patterns that equal the tokenizer's own on that range, and each pre-token's ids
are remembered in a bounded table. Other texts are split by the library itself, as
regular expression engines and Unicode versions differ there. Texts with the name of a
special token go to the library too, which takes it as one id.

Long pre-tokens (text that no pattern splits) are encoded by *tree concatenation*:
halves are encoded on their own, the leaves by parallel threads, and each join is
repaired by encoding a window around it again, growing until its first id equals the left
half's id there and its last id the right half's. Byte-pair encodings are exact exactly if
each adjacent pair of ids is the encoding of its own text, so agreement on both
sides proves the joined list equal to the encoding of the whole.
"""

from __future__ import annotations

import base64
import json
import os
import re
from array import array
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property, lru_cache

LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
DIGITS = "0-9\xb2\xb3\xb9\xbc-\xbe"
#: Characters outside the range on which the patterns below are known to agree.
UNUSUAL = re.compile("[^\x09-\x0d\x20-\x7e\xa1-\xff]")
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
#: Ids are handed on as little-endian unsigned 32-bit integers.
EMPTY = b""


#: Each encoder's memory of pre-tokens in this process.
MEMOS: list[dict] = []


def memos() -> list[dict]:
    return MEMOS


def pack_ids(ids) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    return out.tobytes()


def unpack_ids(data: bytes) -> list[int]:
    out = array("I")
    out.frombytes(data)
    return out.tolist()


class TreeBpe:
    """Exact byte-pair encoding of one long pre-token by halves and re-encoded joins."""

    threads = 2

    def __init__(self, encode_open, encode_closed, lengths, leaf: int = 512):
        """encode_open/encode_closed: lists of symbol strings to lists of ids, without and with the
        word end on the last symbol; lengths: id to its number of symbols."""
        self.encode_open, self.encode_closed, self.lengths, self.leaf = encode_open, encode_closed, lengths, max(2, leaf)

    def encode(self, symbols: str) -> list[int]:
        n = len(symbols)
        if n <= self.leaf:
            return self.encode_closed([symbols])[0]
        cuts = [0]
        parts = 1 << max(1, (n - 1) // self.leaf).bit_length()
        cuts += [n * i // parts for i in range(1, parts)] + [n]
        spans = [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]
        leaves = [symbols[a:b] for a, b in spans[:-1]]
        # the library leaves the interpreter free while it encodes, so threads run side by side
        share = -(-len(leaves) // self.threads)
        with ThreadPoolExecutor(self.threads) as pool:
            opened = pool.map(self.encode_open, [leaves[i : i + share] for i in range(0, len(leaves), share)])
            ids = [x for part in opened for x in part] + self.encode_closed([symbols[spans[-1][0] :]])
        level = [(a, b, x) for (a, b), x in zip(spans, ids)]
        while len(level) > 1:
            joined = [self.join(symbols, level[i], level[i + 1]) for i in range(0, len(level) - 1, 2)]
            level = joined + level[len(joined) * 2 :]
        return level[0][2]

    def join(self, symbols: str, left: tuple, right: tuple) -> tuple:
        (a, m, x), (_, b, y) = left, right
        k = 4
        while True:
            i, j = max(0, len(x) - k), min(len(y), k)
            start = m - sum(map(self.lengths, x[i:]))
            end = m + sum(map(self.lengths, y[:j]))
            last = end == len(symbols)
            window = (self.encode_closed if last else self.encode_open)([symbols[start:end]])[0]
            left_agrees = i == 0 or window[0] == x[i]
            right_agrees = j == len(y) or window[-1] == y[j - 1]
            if left_agrees and right_agrees:
                return a, b, x[:i] + window + y[j:]
            k *= 2


class Subwords:
    """Common part: bounded memory of pre-tokens, and the library for what is unusual."""

    memo_limit = 150_000
    long_piece = 1024

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.path, self.library = path, Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.memo: dict[str, bytes] = {}
        MEMOS.append(self.memo)

    def plain(self, text: str) -> bool:
        return not UNUSUAL.search(text) and not any(s in text for s in self.specials)

    def pieces_packed(self, pieces: list[str]) -> bytes:
        """The ids of pre-tokens, one after another."""
        memo = self.memo
        try:
            return EMPTY.join([memo[p] for p in pieces])
        except KeyError:
            pass
        missing = list({p for p in pieces if p not in memo})
        if len(memo) + len(missing) > self.memo_limit:
            memo.clear()
            missing = list(set(pieces))
        short = [p for p in missing if len(p) <= self.long_piece]
        memo.update(zip(short, map(pack_ids, self.encode_pieces(short))))
        long = {p: pack_ids(self.encode_long(p)) for p in missing if len(p) > self.long_piece}
        return EMPTY.join([long[p] if p in long else memo[p] for p in pieces])


class WordBpe(Subwords):
    """BPE with word ends: normalised (NFC, white space, lower case), split, ``</w>`` on each last symbol."""

    pattern = re.compile(f"{CONTRACTIONS}|[{LETTERS}]+|[{DIGITS}]|[^\\s{LETTERS}{DIGITS}]+")
    #: How much text one leaf of the document's tree holds.
    leaf_chars = 16_384

    @cached_property
    def tree(self) -> TreeBpe:
        from tokenizers import Tokenizer

        with open(self.path, encoding="utf-8") as f:
            spec = json.load(f)
        spec["normalizer"] = spec["pre_tokenizer"] = None
        spec["added_tokens"] = []
        closed = Tokenizer.from_str(json.dumps(spec))
        suffix = spec["model"]["end_of_word_suffix"]
        spec["model"]["end_of_word_suffix"] = None
        vocab = spec["model"]["vocab"]
        # without the suffix only merges of symbols inside a word can apply
        spec["model"]["merges"] = [m for m in spec["model"]["merges"] if not m[1].endswith(suffix)]
        opened = Tokenizer.from_str(json.dumps(spec))
        size = {i: len(t[: -len(suffix)] if t.endswith(suffix) and len(t) > len(suffix) else t) for t, i in vocab.items()}
        many = lambda t: lambda texts: [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]
        return TreeBpe(many(opened), many(closed), size.__getitem__)

    @cached_property
    def byte_symbols(self) -> dict[int, str]:
        """Byte to the printable character that stands for it: printable Latin-1 bytes stand for themselves, others follow from 256."""
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        rest = [b for b in range(256) if b not in set(shown)]
        return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(pieces, add_special_tokens=False)]

    def encode_long(self, piece: str) -> list[int]:
        return self.tree.encode(piece.encode().decode("latin-1").translate(self.byte_symbols))

    def encode(self, text: str | None) -> bytes:
        """Packed ids of a whole text; none for null."""
        if not text:
            return EMPTY
        if self.plain(text):
            return self.by_halves(text.lower())
        return self.unusual(text)

    def by_halves(self, text: str) -> bytes:
        """Long texts: leaves on their own, then joins; each join re-encodes a window of pre-tokens."""
        if len(text) <= self.leaf_chars:
            return self.pieces_packed(self.pattern.findall(text))
        parts = 1 << ((len(text) - 1) // self.leaf_chars).bit_length()
        cuts = [len(text) * i // parts for i in range(parts + 1)]
        level = [(a, b, [m.span() for m in self.pattern.finditer(text, a, b)]) for a, b in zip(cuts, cuts[1:])]
        while len(level) > 1:
            level = [self.join(text, *level[i : i + 2]) for i in range(0, len(level), 2)]
        return self.pieces_packed([text[a:b] for a, b in level[0][2]])

    def join(self, text: str, left: tuple, right: tuple) -> tuple:
        """Splits of two neighbours become that of their union. A window that starts where the left has a pre-token
        and ends in a pre-token that the right has too agrees with both, as matching only looks ahead."""
        (a, m, x), (_, b, y) = left, right
        k = 2
        while True:
            i, j = max(0, len(x) - k), min(len(y), k)
            start = x[i][0] if i else a
            end = y[j - 1][1] if j < len(y) else b
            window = [w.span() for w in self.pattern.finditer(text, start, end)]
            left_agrees = i == 0 or window[:1] == x[i : i + 1]
            right_agrees = j == len(y) or window[-1:] == y[j - 1 : j]
            if left_agrees and right_agrees:
                return a, b, x[:i] + window + y[j:]
            k *= 2

    def unusual(self, text: str) -> bytes:
        """Split by the library; pre-tokens too long for it by the tree."""
        if len(text) > self.long_piece and not any(s in text for s in self.specials):
            normal = self.library.normalizer.normalize_str(text)
            runs = normal.split(" ")
            if max(map(len, runs)) > self.long_piece:
                out = []
                for run in runs:
                    pieces = [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(run)] if run else []
                    for p in pieces:
                        out.append(pack_ids(self.tree.encode(p)) if len(p) > self.long_piece else pack_ids(self.tree.encode_closed([p])[0]))
                return EMPTY.join(out)
        return pack_ids(self.library.encode(text, add_special_tokens=False).ids)

    @cached_property
    def tokens(self) -> list[str]:
        n = self.library.get_vocab_size(with_added_tokens=True)
        return [self.library.id_to_token(i) or "" for i in range(n)]

    def decode(self, ids: list[int]) -> str:
        """As the library without a decoder: the tokens with spaces between."""
        return " ".join(map(self.tokens.__getitem__, ids))


class ByteBpe(Subwords):
    """Byte-level BPE without normalisation. Pre-tokens are encoded from the same vocabulary's ranks."""

    pattern = re.compile(f"{CONTRACTIONS}| ?[{LETTERS}]+| ?[{DIGITS}]+| ?[^\\s{LETTERS}{DIGITS}]+|\\s+(?!\\S)|\\s+")

    def __init__(self, path: str, ranks_path: str):
        super().__init__(path)
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = tiktoken.Encoding("ranks", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        return list(map(self.ranks.encode_ordinary, pieces))

    def encode_long(self, piece: str) -> list[int]:
        return self.ranks.encode_ordinary(piece)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return EMPTY
        if self.plain(text):
            return self.pieces_packed(self.pattern.findall(text))
        return pack_ids(self.library.encode(text, add_special_tokens=False).ids)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def word_bpe(path: str) -> WordBpe:
    """One per worker process."""
    return WordBpe(path)


@lru_cache(maxsize=4)
def byte_bpe(path: str, ranks_path: str) -> ByteBpe:
    return ByteBpe(path, ranks_path)



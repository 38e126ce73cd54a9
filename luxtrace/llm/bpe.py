"""Byte-level BPE encoding and decoding (operator 1).

A piece of text is scanned once by an Aho-Corasick automaton over its bytes, mapped to Latin-1, which gives the longest
vocabulary entry at each position. The encoder then walks from longest matches and steps back to shorter prefixes where
two neighbours could not have come out of the merges side by side. Whether a pair is compatible depends on the two tokens
alone, so it is memoised; a position that was left once is never tried again. Time is linear in the text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from luxtrace.llm.common import bounded_batches, columns, map_rows, read_table, tokenizer_path

#: Pieces kept with their ids, and pairs kept with their verdict, in each Python worker.
PIECES_KEPT = 150_000
PAIRS_KEPT = 300_000
#: Longer pieces are encoded each time.
PIECE_CHARS = 64


class BytePairCodec:
    """Exact encoder and decoder for a rank file, one id for each rank.

    ``ranks`` must hold all 256 single bytes, and each longer entry must come out of merges of entries of lower rank.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split_text = regex.compile(pattern).findall
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.sizes = [len(t) for t in self.tokens]
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        #: The longest proper prefix of a token that is a token as well, or -1.
        self.shorter = [next((ranks[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in ranks), -1) for t in self.tokens]
        self._pairs: dict[int, bool] = {}
        self._merged: dict[tuple[int, int], int] = {}
        self._halves: list[tuple[int, int]] = []
        self._find_halves()
        self.pieces = _Pieces(self)

    def _find_halves(self) -> None:
        """The last merge that makes each token, in order of rank."""
        for rank, token in enumerate(self.tokens):
            left, halves = self.shorter[rank], (rank, rank)
            while left >= 0:
                right = self.ranks.get(token[self.sizes[left] :], rank)
                if max(left, right) < rank and self._together(left, right):
                    halves = (left, right)
                    self._merged[halves] = rank
                    break
                left = self.shorter[left]
            self._halves.append(halves)

    def _together(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both ends with exactly these two tokens side by side.

        Undoes merges next to the border, the latest first, and looks for one across the border that would have come earlier.
        At equal rank the left one comes first.
        """
        limit = len(self.tokens) + 1
        halves, merged = self._halves, self._merged
        while True:
            if merged.get((left, right), limit) < limit:
                return False
            if left > right:
                limit, opened = left, halves[left][1]
                if opened != left:
                    left = opened
                    continue
                limit, opened = right + 1, halves[right][0]
                if opened == right:
                    return True
                right = opened
            else:
                limit, opened = right + 1, halves[right][0]
                if opened != right:
                    right = opened
                    continue
                limit, opened = left, halves[left][1]
                if opened == left:
                    return True
                left = opened

    def compatible(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= PAIRS_KEPT:
                self._pairs.clear()
            known = self._pairs[key] = self._together(left, right)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, sizes, shorter = len(piece), self.sizes, self.shorter
        longest = [0] * (n + 1)
        for end, rank in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - sizes[rank]] = rank  # later ends are longer
        out: list[int] = []
        left_once = bytearray(n + 1)
        at, token = 0, longest[0]
        while at < n:
            while token >= 0:
                end = at + sizes[token]
                if not left_once[end] and (not out or self.compatible(out[-1], token)):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at]
            else:
                left_once[at] = 1
                last = out.pop()
                at -= sizes[last]
                token = shorter[last]
        return out

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; null counts as empty."""
        return b"".join(map(self.pieces.__getitem__, self.split_text(text or "")))

    def decode(self, ids: bytes | None) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))


class _Pieces(dict):
    """Pieces and their ids; emptied when full, so its memory is bounded."""

    def __init__(self, codec: BytePairCodec):
        self.codec = codec

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.codec.encode_piece(piece.encode()), "<u4").tobytes()
        if len(piece) <= PIECE_CHARS:
            if len(self) >= PIECES_KEPT:
                self.clear()
            self[piece] = ids
        return ids


@lru_cache(maxsize=2)
def load_codec(path: str, pattern: str) -> BytePairCodec:
    with open(path, "rb") as f:
        return BytePairCodec({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` with ids as binary, little-endian unsigned 32 bits.

    Null and empty texts give no ids; repeated rows and null ids stay as they are; other columns are ignored. The
    vocabulary file must be readable at ``path`` on each executor.
    """
    bounded_batches(docs.sparkSession)
    given = default_vocabulary()
    path, pattern = path or given[0], pattern or given[1]

    def rows(it: Iterable[tuple]) -> Iterator[tuple]:
        encode = load_codec(path, pattern).encode
        for key, text in it:
            yield key, encode(text)

    kind = dict(docs.dtypes)[id_col]
    return map_rows(columns(docs, id_col, text_col), rows, f"`{id_col}` {kind}, ids binary")


def decode_documents(encoded: DataFrame, path: str | None = None, pattern: str | None = None, *, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of ``encoded`` and ``decoded``: the bytes that the column ``ids`` stands for."""
    bounded_batches(encoded.sparkSession)
    given = default_vocabulary()
    path, pattern = path or given[0], pattern or given[1]
    kinds = dict(encoded.dtypes)

    def rows(it: Iterable[tuple]) -> Iterator[tuple]:
        decode = load_codec(path, pattern).decode
        for *kept, ids in it:
            yield (*kept, decode(ids))

    return map_rows(columns(encoded, *keep, "ids"), rows, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", decoded binary")


def digest(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encode, decode the ids again and describe both: one row for each row of ``docs``.

    One pass, so that ids and decoded bytes need not leave the worker. Null counts as empty, which has no ids; each row is
    described by itself, so repeated rows give equal rows; an empty table gives none; other columns, of any name, are ignored.
    """
    bounded_batches(docs.sparkSession)
    given = default_vocabulary()
    path, pattern = path or given[0], pattern or given[1]

    def rows(it: Iterable[tuple]) -> Iterator[tuple]:
        codec = load_codec(path, pattern)
        for key, text in it:
            ids = codec.encode(text)
            yield key, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()

    return map_rows(columns(docs, "doc_id", "text"), rows, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and hash of the ids of each row of ``documents`` and hash of what they decode to; edge cases as in :func:`digest`."""
    return digest(read_table(spark, sf_dir, "documents"))

"""Cross-tokenizer alignment (operator 11): which tokens of two vocabularies stand for the same bytes, and how often.

Both tokenizers cut one byte string. NumPy sums token lengths to ends, ``intersect1d`` finds the ends that both have,
``searchsorted`` labels each token with its group, and ``repeat`` expands groups to links. This happens for a block of
documents at a time, since each document ends in a cut. A block keeps its distinct pairs once, with the number of its
documents that hold each; two shuffles, the first by pair and salt, add these up over the corpus. Counts go back to the
blocks, not to links or documents, so what is shuffled is the pairs of each block and never the links.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from luxtrace.llm.common import bounded_batches, columns, cut, map_rows, read_table, tokenizer_path

#: A block ends after so many code points or documents; links are expanded at most about so many at a time.
BLOCK_CHARS = 1 << 20
BLOCK_DOCS = 4096
LINKS_AT_ONCE = 1 << 21
#: Segments kept with their ids in each Python worker; longer ones are encoded each time.
SEGMENTS_KEPT = 500_000
SEGMENT_CHARS = 64
#: The first shuffle spreads each pair over so many keys.
SALTS = 16
#: A pair is one long: the id in A above the id in B; above both there is room for a block's documents.
ID_BITS = 24

SPACE = "▁"
#: A text is cut between other signs and a following space or line feed; neither vocabulary has tokens across that.
_SEGMENTS = re.compile(r"\s+(?:\S+(?:[^\S \n]\s*\S+)*(?:[^\S \n]\s*)?)?")


class _Side:
    """The tokens of one vocabulary: bytes, lengths, and the ids of each segment seen so far, one after another."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.sizes = np.array([len(t) for t in tokens], "i8")
        self.spelled = {end: np.array([f"{k}{end}" for k in range(len(tokens))], object) for end in ",|;"}
        self.clear()

    def clear(self) -> None:
        self.flat, self.used, self.starts, self.counts = np.empty(1 << 16, "i4"), 0, array("q"), array("q")

    def add(self, encoded: list[list[int]]) -> None:
        counts = np.fromiter(map(len, encoded), "i8", len(encoded))
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        if self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(max(len(self.flat), total), "i4")])
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(encoded), "i4", total)
        self.starts.frombytes((self.used + ends - counts).tobytes())
        self.counts.frombytes(counts.tobytes())
        self.used += total

    def spell(self, encoded: list[list[int]]) -> list[bytes]:
        tokens = self.tokens
        return [b"".join([tokens[k] for k in ids]) for ids in encoded]

    def gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of segments ``which`` in order, and how many each has."""
        counts, starts = np.frombuffer(self.counts, "i8")[which], np.frombuffer(self.starts, "i8")[which]
        return self.flat[np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())], counts


class TwoTokenizers:
    """A: a byte-level file of the tokenizers library; B: a sentencepiece model that puts a space in front."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        import tokenizers

        self.a_library = tokenizers.Tokenizer.from_file(path_a)
        self.a_library.encode_special_tokens = True  # their strings in a text are plain text
        self.b_library = sentencepiece.SentencePieceProcessor(model_file=path_b)
        with open(path_a, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        spelled = _byte_of_sign()
        a_tokens = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            a_tokens[k] = bytes(spelled[c] for c in token)
        pieces = [self.b_library.id_to_piece(k) for k in range(self.b_library.get_piece_size())]
        self.a, self.b = _Side(a_tokens), _Side([bytes([int(p[3:5], 16)]) if self.b_library.is_byte(k) else p.replace(SPACE, " ").encode() for k, p in enumerate(pieces)])
        if max(len(a_tokens), len(pieces)) > 1 << ID_BITS:
            raise ValueError("a vocabulary is too large")
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces):
            raise ValueError("tokens of B cross spaces or lines")
        self.space = self.b_library.piece_to_id(SPACE)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.sound = bytearray()
        self.a.clear()
        self.b.clear()

    def _encode_b(self, segments: list[str]) -> list[list[int]]:
        """B puts a space in front, which replaces a segment's own or, before a line feed, is a token of its own."""
        spaced = [s[0] == " " for s in segments]
        ids = self.b_library.encode([s[1:] if own else s for s, own in zip(segments, spaced, strict=True)], num_threads=1)
        return [([self.space] if s == " " else x) if own else x[1:] for s, own, x in zip(segments, spaced, ids, strict=True)]

    def segments(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the segments of space + text, text after text, and how many each text has."""
        if len(self.sound) > SEGMENTS_KEPT:
            self.clear()
        cut_up = [_SEGMENTS.findall(" " + t) if t else [] for t in texts]
        known = self.known
        new = list(set(chain.from_iterable(cut_up)).difference(known))
        if new:
            in_a, in_b = [e.ids for e in self.a_library.encode_batch(new, add_special_tokens=False)], self._encode_b(new)
            known.update(zip(new, range(len(self.sound), len(self.sound) + len(new)), strict=True))
            self.a.add(in_a)
            self.b.add(in_b)
            self.sound.extend(s.encode() == x == y for s, x, y in zip(new, self.a.spell(in_a), self.b.spell(in_b), strict=True))
        which = np.fromiter(map(known.__getitem__, chain.from_iterable(cut_up)), "i8")
        for s in new:
            if len(s) > SEGMENT_CHARS:
                del known[s]
        return which, np.fromiter(map(len, cut_up), "i8", len(cut_up))

    def aligned(self, texts: list[str | None]) -> Aligned:
        return Aligned(self, texts)


class Aligned:
    """Tokens, groups and links of some texts, as flat arrays in the order of the texts.

    A text that is null, empty, or not what its tokens' bytes join to has no tokens.
    """

    def __init__(self, both: TwoTokenizers, texts: list[str | None]):
        which, n = both.segments([t or "" for t in texts])
        of = np.repeat(np.arange(len(texts)), n)
        bad = np.zeros(len(texts), bool)
        bad[of[~np.frombuffer(both.sound, bool)[which]]] = True
        which, of = which[~bad[of]], of[~bad[of]]
        self.sides, self.n_docs = (both.a, both.b), len(texts)
        (self.a, n_a), (self.b, n_b) = both.a.gather(which), both.b.gather(which)
        self.doc_a, self.doc_b = np.repeat(of, n_a), np.repeat(of, n_b)
        ends = [np.cumsum(side.sizes[ids]) for side, ids in zip(self.sides, (self.a, self.b), strict=True)]
        cuts = np.intersect1d(*ends, assume_unique=True)
        self.group_a, self.group_b = (np.searchsorted(cuts, e) for e in ends)
        self.in_a, self.in_b = (np.bincount(g, minlength=len(cuts)) for g in (self.group_a, self.group_b))
        self.doc_of_group = np.zeros(len(cuts), "i8")
        self.doc_of_group[self.group_a] = self.doc_a

    def per_doc(self) -> tuple[np.ndarray, ...]:
        """Tokens in A, tokens in B, groups and links of each text."""
        count = lambda of, w=None: np.bincount(of, w, self.n_docs).astype("i8")
        return count(self.doc_a), count(self.doc_b), count(self.doc_of_group), np.array(_exact_sums(self.doc_of_group, self.in_a * self.in_b, self.n_docs))

    def described(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each text: ids of each group."""
        before = [np.cumsum(n) - n for n in (self.in_a, self.in_b)]
        out = np.empty(len(self.a) + len(self.b), object)
        out[np.arange(len(self.a)) + before[1][self.group_a]] = self._spelled(0, self.a, self.group_a, "|")
        out[np.arange(len(self.b)) + (before[0] + self.in_a)[self.group_b]] = self._spelled(1, self.b, self.group_b, ";")
        ends = np.cumsum(np.bincount(self.doc_a, minlength=self.n_docs) + np.bincount(self.doc_b, minlength=self.n_docs)).tolist()
        return ["".join(out[start:end])[:-1] for start, end in zip([0, *ends], ends, strict=False)]

    def _spelled(self, side: int, ids: np.ndarray, group: np.ndarray, end: str) -> np.ndarray:
        spelled = self.sides[side].spelled
        return np.where(np.diff(group, append=-1) != 0, spelled[end][ids], spelled[","][ids])

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``doc, a, b`` of all links, in slices of bounded size: each token of A meets every token of B in its group."""
        times = self.in_b[self.group_a]
        first = (np.cumsum(self.in_b) - self.in_b)[self.group_a]
        done = np.cumsum(times)
        at = 0
        while at < len(self.a):
            to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + LINKS_AT_ONCE, "right")))
            n = times[at:to]
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield np.repeat(self.doc_a[at:to], n), np.repeat(self.a[at:to], n), self.b[np.repeat(first[at:to], n) + within]
            at = to

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The distinct pairs in order; then, of each text and each of its pairs in that order, text, pair's place and times."""
        found = [_counted(doc, a.astype("i8") << ID_BITS | b) for doc, a, b in self.links()]
        doc, pair, times = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, "i8"),) * 3
        distinct, place = np.unique(pair, return_inverse=True)
        key, of = np.unique(doc * max(1, len(distinct)) + place, return_inverse=True)
        total = np.zeros(len(key), "i8")
        np.add.at(total, of, times)
        return distinct, key // max(1, len(distinct)), key % max(1, len(distinct)), total


def _byte_of_sign() -> dict[str, int]:
    """The signs that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def _counted(doc: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows of both arrays, in order, and how often each is there."""
    key, times = np.unique(doc << 2 * ID_BITS | pair, return_counts=True)
    return key >> 2 * ID_BITS, key & (1 << 2 * ID_BITS) - 1, times


def _exact_sums(of: np.ndarray, values: np.ndarray, n: int) -> list[int]:
    """Integer sums by label; ``bincount`` would add doubles."""
    out = np.zeros(n, "i8")
    np.add.at(out, of, values)
    return out.tolist()


def default_vocabularies() -> tuple[str, str]:
    return tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


@lru_cache(maxsize=1)
def load_tokenizers(path_a: str, path_b: str) -> TwoTokenizers:
    return TwoTokenizers(path_a, path_b)


def _blocks(rows: Iterable[tuple]) -> Iterator[list[tuple]]:
    held: list[tuple] = []
    size = 0
    for r in rows:
        held.append(r)
        size += len(r[1] or "")
        if size >= BLOCK_CHARS or len(held) >= BLOCK_DOCS:
            yield held
            held, size = [], 0
    if held:
        yield held


def token_groups(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, groups`` of each row: the groups as text; '' for a row without tokens (see :class:`Aligned`)."""
    bounded_batches(docs.sparkSession)
    given = default_vocabularies()
    paths = path_a or given[0], path_b or given[1]

    def rows(it: Iterable[tuple]) -> Iterator[tuple]:
        for block in _blocks(it):
            yield from zip((r[0] for r in block), load_tokenizers(*paths).aligned([r[1] for r in block]).described(), strict=True)

    return map_rows(columns(docs, id_col, text_col), rows, f"`{id_col}` {dict(docs.dtypes)[id_col]}, groups string")


_BLOCK = "block long, pairs array<long>, holders array<long>, ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, of binary, places binary, times binary"


def align_blocks(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each block of documents: distinct pairs, how many of its documents hold each, and each document's own
    figures and pairs (arrays packed with zstandard, pairs by place). Written to the shared folder, so texts are encoded once.

    Each row is a document of its own, rows of equal id too; null, empty and unsound texts have no tokens; other columns, of
    any name, are ignored; an empty table gives no block. A group of m and n tokens has m·n links; they are expanded in
    slices, and a block's memory follows its distinct pairs.
    """
    bounded_batches(docs.sparkSession)
    given = default_vocabularies()
    paths = path_a or given[0], path_b or given[1]

    def rows(it: Iterable[tuple]) -> Iterator[tuple]:
        base = TaskContext.get().partitionId() << 32
        pack = lambda x, kind: zstandard.compress(x.astype(kind).tobytes(), 1)
        for k, block in enumerate(_blocks(it)):
            found = load_tokenizers(*paths).aligned([r[1] for r in block])
            distinct, doc, place, times = found.pairs()
            holders = np.bincount(place, minlength=len(distinct))
            sha = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in found.described()]
            steps = np.diff(place, prepend=0)  # small numbers; they fall where a document starts
            yield base + k, distinct.tolist(), holders.tolist(), [r[0] for r in block], *(np.asarray(c).tolist() for c in found.per_doc()), sha, pack(np.bincount(doc, minlength=len(block)), "<i8"), pack(steps, "<i4"), pack(times, "<i8")

    own = columns(docs, id_col, text_col).select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`"))
    return cut(map_rows(own, rows, _BLOCK), "aligned-blocks")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``a, b, n_docs, best`` of each pair of ids: documents that hold it linked, and whether no pair of the same ``a`` has more.

    Blocks have added up their documents; the first shuffle adds up by pair and salt, the second by pair, so a pair that all
    blocks hold is shared out.
    """
    salted = blocks.select((F.col("block") % SALTS).alias("salt"), F.explode(F.arrays_zip("pairs", "holders")).alias("p")).select("salt", "p.pairs", "p.holders")
    counts = salted.groupBy("pairs", "salt").agg(F.sum("holders").alias("n")).groupBy("pairs").agg(F.sum("n").alias("n_docs"))
    counts = cut(counts.select(F.shiftright("pairs", ID_BITS).alias("a"), (F.col("pairs") % (1 << ID_BITS)).alias("b"), "n_docs"), "pair-counts")
    most = counts.groupBy(F.col("a").alias("of")).agg(F.max("n_docs").alias("most"))
    return counts.join(most, F.col("a") == F.col("of")).select("a", "b", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def link_scores(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of each document, from blocks and the counts of pairs.

    Counts join the pairs of blocks, and each block gets its own pairs' counts back as arrays; both joins can be split.
    """
    wanted = blocks.select("block", F.explode("pairs").alias("pair"))
    known = counts.select((F.shiftleft("a", ID_BITS) + F.col("b")).alias("pair"), F.struct("n_docs", "best").alias("v"))
    back = wanted.join(known, "pair").groupBy("block").agg(F.collect_list(F.struct("pair", "v")).alias("found"))  # a block's own pairs
    got = back.select(F.col("block").alias("of_block"), F.col("found.pair").alias("p"), F.col("found.v.n_docs").alias("n"), F.col("found.v.best").alias("best"))
    given = ["ids", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "of", "places", "times"]
    joined = blocks.join(got, F.col("block") == F.col("of_block"), "left").select(*given, "p", "n", "best")

    def rows(it: Iterable[tuple]) -> Iterator[tuple]:
        unpack = lambda x, kind: np.frombuffer(zstandard.decompress(x), kind)
        for ids, n_a, n_b, n_groups, n_links, sha, of, places, times, pair, n, best in it:
            order = np.argsort(np.array(pair or [], "i8"))
            counted, good = np.array(n or [], "i8")[order], np.array(best or [], bool)[order]
            times, place = unpack(times, "<i8"), np.cumsum(unpack(places, "<i4").astype("i8"))
            doc = np.repeat(np.arange(len(ids)), unpack(of, "<i8"))
            sums = _exact_sums(doc, counted[place] * times, len(ids)), _exact_sums(doc, good[place] * times, len(ids))
            yield from zip(ids, n_a, n_b, n_groups, n_links, sums[1], sums[0], sha, strict=True)

    return map_rows(joined, rows, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of each row of ``documents`` under two tokenizers; edge cases as in :func:`align_blocks`."""
    blocks = align_blocks(read_table(spark, sf_dir, "documents"))
    return link_scores(blocks, pair_counts(blocks))

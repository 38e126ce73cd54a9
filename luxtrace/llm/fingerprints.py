"""Document fingerprints (operator 13): closed syncmers with their places, compared by order.

A k-mer is an anchor if the smallest of its inner s-mers stands at one of its edges. That depends on the k-mer alone, so the
same passage has the same anchors wherever it stands. A fingerprint holds all anchors of its text and where each stands
first; two fingerprints are alike in the anchors that both have in the same order.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from luxtrace.llm.common import bounded_batches, columns, map_rows, read_table

#: Code points of an s-mer; a k-mer is two of them.
S = 11
K = 2 * S
#: Bytes of an anchor's hash and place.
_HASH, _PLACE = 6, 4
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)

#: Documents in order are cut into ranges of about so many; at least and at most so many ranges.
RANGE_ROWS = 20_000
LEAST_RANGES, MOST_RANGES = 512, 16_384
#: Ids of each range that are sampled to place its ends; they bear on the ranges' sizes, not on results.
SAMPLED = 32


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX
    return h ^ (h >> np.uint64(29))


def _least(h: np.ndarray, n: int) -> np.ndarray:
    """The least of each ``n`` neighbours, by doubling."""
    size = 1
    while 2 * size <= n:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (n - size)], h[n - size :]) if size < n else h


def anchors(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of all closed syncmers; a text without one has itself as its anchor, an empty one none."""
    signs = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if len(signs) >= K:
        h = signs[: len(signs) - S + 1].astype("u8")
        for k in range(1, S):
            h = h * _BASE + signs[k : len(signs) - S + 1 + k]
        h = _mixed(h)
        least = _least(h, K - S + 1)
        at = np.flatnonzero((h[: len(least)] == least) | (h[K - S :] == least))
        if len(at):
            return _mixed(h[at] * _BASE + h[at + K - S]) >> np.uint64(64 - 8 * _HASH), at
    whole = int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=_HASH).digest(), "little")
    return np.array([whole] if text else [], "u8"), np.zeros(min(1, len(text)), "i8")


class Fingerprint:
    """Hashes in order and, for each, the place where it stands first in the text."""

    def __init__(self, hashes: np.ndarray, places: np.ndarray):
        self.hashes, self.places = hashes, places

    @classmethod
    def of(cls, text: str) -> Fingerprint:
        hashes, first = np.unique((found := anchors(text))[0], return_index=True)
        return cls(hashes, found[1][first])

    def __str__(self) -> str:
        """Base64 of the anchors, six bytes of hash and four of place each, in order of hash."""
        parts = [x.astype("<u8").view("u1").reshape(-1, 8)[:, :n] for x, n in ((self.hashes, _HASH), (self.places, _PLACE))]
        return base64.b64encode(np.concatenate(parts, axis=1).tobytes()).decode()

    @classmethod
    def read(cls, text: str) -> Fingerprint:
        raw = np.frombuffer(base64.b64decode(text), "u1").reshape(-1, _HASH + _PLACE).astype("u8")
        join = lambda part: sum((part[:, k] << np.uint64(8 * k) for k in range(part.shape[1])), np.zeros(len(part), "u8"))
        return cls(join(raw[:, :_HASH]), join(raw[:, _HASH:]))

    def likeness(self, other: Fingerprint) -> float:
        """Twice the anchors that both texts have in the same order over those of each, 0 to 1; two empty texts are alike."""
        _, own, its = np.intersect1d(self.hashes, other.hashes, assume_unique=True, return_indices=True)
        ends: list[int] = []  # of the rising rows of each length, the least end
        for p in other.places[its][np.argsort(self.places[own])].tolist():
            if not ends or p > ends[-1]:
                ends.append(p)
            else:
                ends[bisect_left(ends, p)] = p
        n = len(self.hashes) + len(other.hashes)
        return 2 * len(ends) / n if n else 1.0


class _Ranges:
    """Ranges of (doc_id, hash of text): nulls, then ids between cuts; ranges of one id alone are cut by hash."""

    def __init__(self, sample: list, n_nulls: int, per_range: int):
        ids = sorted(sample)
        picked = ids[per_range::per_range]
        often = {v for v, w in zip(picked, picked[1:], strict=False) if v == w}
        self.cuts = np.array(sorted(set(picked) | often | {v + 1 for v in often if v < 2**63 - 1}), "i8")
        own = np.bincount(np.searchsorted(self.cuts, np.array(ids, "i8"), "right"), minlength=len(self.cuts) + 1)
        alone = np.isin(self.cuts, list(often))
        self.parts = np.array([1 + n_nulls // per_range, 1, *np.where(alone, 1 + own[1:] // per_range, 1)], "i8")
        self.first = np.cumsum(self.parts) - self.parts

    def of(self, ids: np.ndarray, null: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        base = np.where(null, 0, 1 + np.searchsorted(self.cuts, ids, "right"))
        share = hashes.astype("f8") / 2.0**64 + 0.5
        return self.first[base] + np.minimum((share * self.parts[base]).astype("i8"), self.parts[base] - 1)


def _batched(rows: Iterable[tuple], n: int = 512) -> Iterator[list[tuple]]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) == n:
            yield held
            held = []
    if held:
        yield held


def _ranges_of(ranges: _Ranges, rows: list[tuple]) -> list[int]:
    ids = np.array([r[0] or 0 for r in rows], "i8")
    return ranges.of(ids, np.array([r[0] is None for r in rows]), np.array([r[1] for r in rows], "i8")).tolist()


def in_order(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``at, ahead, d, h, packed``: rows sorted by id (null first), then by hash of text, in ranges that never leave a task.

    At the end of each range, with ``ahead``, stands a copy of the row that comes next in the whole order; after the last row
    that is the first. So each row has its successor next to it after one shuffle. Texts are packed with zstandard.
    """
    spark = docs.sparkSession
    own = columns(docs, id_col, text_col).select(F.col(f"`{id_col}`").cast("long").alias("d"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
    keyed = own.select("d", F.xxhash64("t").alias("h"), "t")
    n, nulls = own.agg(F.count(F.lit(1)), F.count_if(F.col("d").isNull())).first()
    wanted = min(MOST_RANGES, max(LEAST_RANGES, -(-n // RANGE_ROWS)))
    share = min(1.0, SAMPLED * wanted / max(1, n))
    drawn = own.select("d").where("d IS NOT NULL")
    sample = [r[0] for r in (drawn if share == 1 else drawn.sample(share, seed=13)).collect()]  # about SAMPLED a range
    ranges = _Ranges(sample, int(nulls * share), max(1, (len(sample) + int(nulls * share)) // wanted))

    def place(it: Iterable[tuple]) -> Iterator[tuple]:
        for rows in _batched(it):
            yield from ((at, d, h) for at, (d, h) in zip(_ranges_of(ranges, rows), rows, strict=True))

    least = map_rows(keyed.select("d", "h"), place, "at long, d long, h long").groupBy("at").agg(F.min(F.struct(F.col("d").isNotNull(), "d", "h")).alias("m"))
    heads = {r["at"]: (r["m"]["d"], r["m"]["h"]) for r in least.collect()}  # one for each range at most
    order = sorted(heads)
    before = {at: order[k - 1] for k, at in enumerate(order)}

    def deal(it: Iterable[tuple]) -> Iterator[tuple]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for rows in _batched(it, 64):
            for at, (d, h, t) in zip(_ranges_of(ranges, rows), rows, strict=True):
                packed = pack(t.encode("utf-8", "surrogatepass"))
                yield at, False, d, h, packed
                if heads[at] == (d, h):
                    yield before[at], True, d, h, packed

    dealt = map_rows(keyed, deal, "at long, ahead boolean, d long, h long, packed binary")
    return dealt.repartition("at").sortWithinPartitions("at", "ahead", "d", "h")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, fingerprint`` of each row; null counts as empty, whose fingerprint is ''; equal texts have equal ones."""
    bounded_batches(docs.sparkSession)

    def rows(it: Iterable[tuple]) -> Iterator[tuple]:
        for key, text in it:
            yield key, len(text or ""), str(Fingerprint.of(text or ""))

    return map_rows(columns(docs, id_col, text_col), rows, f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_chars long, fingerprint string")


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by the beginning of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of each row.

    The next document is that of the next id, after the last the first; a single row is its own. Null ids come first; rows of
    equal id follow each other by hash of text. Null texts count as empty; an empty table gives none; other columns, of any
    name, are ignored.
    """
    bounded_batches(docs.sparkSession)

    def rows(it: Iterable[tuple]) -> Iterator[tuple]:
        unpack = zstandard.ZstdDecompressor().decompress
        held, used = None, False  # the last row and whether the range's end is behind
        for at, ahead, d, _, packed in it:
            if held and held[0] == at and used:
                continue  # further copies of the row ahead
            text = unpack(packed).decode("utf-8", "surrogatepass")
            own = Fingerprint.of(text)
            if held and held[0] == at:
                _, key, before, print_before = held
                new = edited(before, text)
                changed = Fingerprint.of(new)
                yield key, len(before), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), str(print_before), str(changed), print_before.likeness(changed), print_before.likeness(own)
            held, used = (at, d, text, own), ahead

    return map_rows(in_order(docs, id_col=id_col, text_col=text_col), rows, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each row of ``documents`` and of its edited text, and their likeness; edge cases as in :func:`compare_with_next`."""
    return compare_with_next(read_table(spark, sf_dir, "documents"))

"""Removal of repeated passages (operator 9) by prefix-free parsing.

Triggers of a rolling hash cut each text into phrases. A window (a string of ``LENGTH`` bytes) belongs to the first trigger
in it; windows that start at most 128 bytes apart before one trigger share a *core*, the bytes that all of them cover. Equal
windows have equal cores, so only cores found twice matter (the parse). Their distinct neighbourhoods form the dictionary,
with counts. A neighbourhood found twice repeats with all its windows. Among different neighbourhoods of one core, the
suffixes of the dictionary are sorted, and equal neighbours in that order are repeated windows. A core with more
neighbourhoods than one task should sort is split first: its windows are dealt to narrower ranges before the trigger, whose
cores are longer, until the groups are small or a core is a whole window.

A window without any trigger is a neighbourhood of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from luxtrace.llm.common import bounded_batches, columns, cut, drop, map_columns, map_rows, read_table, release

LENGTH = 400
#: Bytes below the rolling hash; one of ``1 << TRIGGER_BITS`` positions is a trigger; starts that share a core.
ROLL, TRIGGER_BITS, BAND = 16, 6, 128
#: Neighbourhoods that are sorted together at most; cores with more are split by ``SPLIT`` narrower ranges of starts.
GROUP, SPLIT = 512, 4
NULL_ID = -(1 << 63)
_NO_TRIGGER = 511

_xxh = xxhash.xxh3_64_intdigest


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def triggers(raw: bytes) -> np.ndarray:
    """Positions whose following ``ROLL`` bytes hash to a trigger."""
    n = len(raw) - ROLL + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    words = np.ndarray((n + 8,), "<u8", raw, strides=(1,))
    h = words[:n] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += words[8:]
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    return np.flatnonzero(h >> np.uint64(64 - TRIGGER_BITS) == 0)


def neighbourhoods(raw: bytes) -> Iterator[tuple[np.ndarray, ...]]:
    """``(core hash, neighbourhood hash, start, end, trigger - start)`` for all windows of a text, in groups; as arrays."""
    last = len(raw) - LENGTH
    if last < 0:
        return
    at = triggers(raw)
    before = np.concatenate([[-1], at[:-1]]) if len(at) else at
    reach = np.minimum(at - before - 1, LENGTH - ROLL)
    least = np.maximum(at - last, 0)
    for first in range(0, LENGTH - ROLL + 1, BAND):
        low, high = np.maximum(least, first), np.minimum(reach, first + BAND - 1)
        t, lo, hi = (a[low <= high] for a in (at, low, high))
        if len(t):
            start, end, core = t - hi, t - lo + LENGTH, t - first
            size = LENGTH - BAND + 1
            cores = [_xxh(raw[i : i + size], first) for i in core.tolist()]
            around = [_xxh(raw[i:j], k) for i, j, k in zip(start.tolist(), end.tolist(), hi.tolist(), strict=True)]
            yield np.array(cores, np.uint64), np.array(around, np.uint64), start, end, hi
    alone = [
        np.arange(a + 1, (min(b - LENGTH + ROLL - 1, last) if b < len(raw) else last) + 1)
        for a, b in zip([-1, *at.tolist()], [*at.tolist(), len(raw)], strict=True)
        if min(b, len(raw)) - a > LENGTH - ROLL
    ]
    start = np.concatenate(alone) if alone else np.zeros(0, np.int64)
    if len(start):
        hashes = [np.array([_xxh(raw[i : i + LENGTH], seed) for i in start.tolist()], np.uint64) for seed in (1001, 1002)]
        yield *hashes, start, start + LENGTH, np.full(len(start), _NO_TRIGGER)


# A neighbourhood's place in one integer: start (44 bits), length (10), trigger - start (9).
_S, _E = 19, 9
_START = f"shiftright(p, {_S})"
_END = f"{_START} + (shiftright(p, {_E}) & 1023)"


def _place(start, end, trigger):
    return start << _S | end - start << _E | trigger


def _start(p: int) -> int:
    return p >> _S


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``i, v, t``: id, a number for each row's id and text, and text (null: empty).

    The number is the id (null: below all) unless some id has several texts; then it is a hash of both.
    """
    given = columns(docs, id_col, text_col).toDF("i", "x").select(F.col("i").cast("long").alias("i"), F.coalesce("x", F.lit("")).alias("t"))
    key = F.coalesce("i", F.lit(NULL_ID))
    texts = given.select(key.alias("k"), F.xxhash64("t").alias("h")).groupBy("k").agg(F.min("h").alias("low"), F.max("h").alias("high"))
    shared = not texts.where("low < high").isEmpty()
    return given.select("i", (F.xxhash64("i", "t", F.length("t")) if shared else key).alias("v"), "t")


def parse(keyed: DataFrame) -> DataFrame:
    """``k, h, v, p``: each neighbourhood of each text with its core."""

    def arrays(row: tuple) -> Iterator[tuple]:
        v, text = row
        for k, h, start, end, trigger in neighbourhoods(text.encode("utf-8", "surrogatepass")):
            yield k.view(np.int64), h.view(np.int64), np.full(len(k), v), _place(start, end, trigger)

    return map_columns(keyed.select("v", "t"), arrays, "k long, h long, v long, p long")


def _equal_windows(group: list[tuple]) -> Iterator[tuple[int, int, int]]:
    """``(v, start, end)`` of the windows of single neighbourhoods that are found in another one of the group.

    The suffixes of the concatenated neighbourhoods that are long enough are sorted by their first ``LENGTH`` bytes.
    """
    dictionary = b"".join(r[4] for r in group)
    suffixes, owner, base = [], [], 0
    for j, r in enumerate(group):
        n = len(r[4]) - LENGTH + 1
        suffixes += range(base, base + n)
        owner += [(j, base)] * n
        base += len(r[4])
    order = sorted(range(len(suffixes)), key=lambda i: dictionary[suffixes[i] : suffixes[i] + LENGTH])
    last, held = None, []

    def told() -> Iterator[tuple[int, int, int]]:
        if len(held) > 1:
            for i in held:
                j, first = owner[i]
                _, c, v, p, _ = group[j]
                if c == 1:
                    start = _start(p) + suffixes[i] - first
                    yield v, start, start + LENGTH

    for i in order:
        window = dictionary[suffixes[i] : suffixes[i] + LENGTH]
        if window != last:
            yield from told()
            last, held = window, []
        held.append(i)
    yield from told()


def _split(regions: DataFrame, width: int) -> DataFrame:
    """``k, h, c, v, p, bytes``: the neighbourhoods cut into those of ranges of ``width`` starts, with longer cores."""

    def narrower(it: Iterable[tuple]) -> Iterator[tuple]:
        for _, c, v, p, region in it:
            high = p & 511
            low = high - (len(region) - LENGTH)
            for first in range(low // width * width, high + 1, width):
                lo, hi = max(low, first), min(high, first + width - 1)
                # counted from the first byte of the region, which is ``high`` before the trigger
                part = region[high - hi : high - lo + LENGTH]
                core = region[high - first : high - first + LENGTH - width + 1] if width > 1 else part
                yield _signed(_xxh(core, first << 9 | width)), _signed(_xxh(part, hi)), c, v, _place(_start(p) + high - hi, _start(p) + high - lo + LENGTH, hi), part

    return map_rows(regions, narrower, "k long, h long, c long, v long, p long, bytes binary")


def _several(of: DataFrame) -> DataFrame:
    """``k, n``: the cores of several different neighbourhoods and how many."""
    return of.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def repeated_spans(keyed: DataFrame) -> DataFrame:
    """``v, s, e``: spans of bytes (they may overlap) that cover exactly the windows found more than once; of ``v, t``."""
    spark = keyed.sparkSession
    parsed = cut(parse(keyed), "parse")
    # Written first, so that the join below has two plain shuffles and Spark can split a core that very many texts have.
    twice = cut(parsed.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k"), "cores")
    release(spark)
    found = cut(parsed.join(twice, "k", "left_semi"), "repeated-cores")
    release(spark, parsed, twice)
    counted = cut(found.groupBy("k", "h").agg(F.count(F.lit(1)).alias("c"), F.first("v").alias("v"), F.first("p").alias("p")), "dictionary")
    more = cut(counted.where("c > 1").select("k", "h"), "repeated")
    whole = found.join(more, ["k", "h"], "left_semi").selectExpr("v", f"{_START} AS s", f"{_END} AS e")
    spans = [cut(whole, "spans")]
    release(spark, found, more)

    classes = counted.join(_several(counted).select("k"), "k", "left_semi")
    wanted = classes.selectExpr("v", "struct(k, c, p) AS w").groupBy("v").agg(F.collect_list("w").alias("w"))  # of one text
    fetched = keyed.join(wanted.hint("shuffle_hash"), "v").select("v", "t", "w")

    def cut_out(it: Iterable[tuple]) -> Iterator[tuple]:
        for v, text, ws in it:
            raw, got = text.encode("utf-8", "surrogatepass"), set()
            for w in ws:
                p = w["p"]
                if p not in got:
                    got.add(p)
                    yield w["k"], w["c"], v, p, raw[_start(p) : _start(p) + (p >> _E & 1023)]

    regions = cut(map_rows(fetched, cut_out, "k long, c long, v long, p long, bytes binary"), "neighbourhoods")
    release(spark, counted)

    def by_suffixes(it: Iterable[tuple]) -> Iterator[tuple]:
        for _, group in groupby(it, key=lambda r: r[0]):
            yield from (x[1:] for x in _merged((0, *w) for w in _equal_windows(list(group))))

    width = BAND
    while True:
        sizes = cut(_several(regions), "sizes")
        small = regions.join(sizes.where(F.col("n") <= GROUP).select("k"), "k", "left_semi")
        small = small.repartition("k").sortWithinPartitions("k", "v", "p")
        spans.append(cut(map_rows(small, by_suffixes, "v long, s long, e long"), "spans"))
        large = sizes.where(F.col("n") > GROUP).select("k")
        if width == 1 or large.isEmpty():
            break
        width = max(1, width // SPLIT)
        parts = cut(_split(regions.join(large, "k", "left_semi"), width), "parts")
        same = cut(parts.groupBy("k", "h").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n"), F.min(F.struct("v", "p")).alias("first")), "same")
        # a part found twice repeats with all its windows; one of its places stands for it from here on
        repeated = parts.where("c = 1").join(same.where("c > 1").select("k", "h"), ["k", "h"], "left_semi")
        spans.append(cut(repeated.selectExpr("v", f"{_START} AS s", f"{_END} AS e"), "spans"))
        several = _several(same).select("k")
        kept = parts.drop("c").join(same.select("k", "h", "c", F.col("first.v").alias("v"), F.col("first.p").alias("p")), ["k", "h", "v", "p"]).join(several, "k", "left_semi")
        drop(regions, sizes)
        regions = cut(kept.select("k", "c", "v", "p", "bytes"), "neighbourhoods")
        release(spark, parts, same)
    drop(regions, sizes)
    out = spans[0]
    for more in spans[1:]:
        out = out.union(more)
    return out


def _merged(spans: Iterable[tuple[int, int, int, int]]) -> Iterator[tuple[int, int, int, int]]:
    held: tuple | None = None
    for d, v, s, e in sorted(spans):
        if held and held[:2] == (d, v) and s <= held[3]:
            held = (d, v, held[2], max(e, held[3]))
        else:
            if held:
                yield held
            held = (d, v, s, e)
    if held:
        yield held


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, kept``: each text as UTF-8 without the bytes that a repeated window covers.

    Overlaps count, within a document as well; strings are judged on the input. Null counts as empty; texts below
    ``LENGTH`` bytes stay whole; repeated rows are copies of each other, and so are equal texts of any ids; rows of one id
    (or without one) that have different texts are documents of their own; an empty table gives none; other columns, of any
    name, are ignored.
    """
    bounded_batches(docs.sparkSession)
    keyed = _keyed(docs, id_col, text_col)
    spans = repeated_spans(keyed)
    release(docs.sparkSession)
    by_text = spans.groupBy("v").agg(F.collect_set(F.struct("s", "e")).alias("spans"))  # of one text

    def rows(it: Iterable[tuple]) -> Iterator[tuple]:
        for key, text, spans in it:
            raw = text.encode("utf-8", "surrogatepass")
            runs = [(s, e) for _, _, s, e in _merged((0, 0, x["s"], x["e"]) for x in spans or ())]
            ends = [0, *(e for _, e in runs)]
            starts = [*(s for s, _ in runs), len(raw)]
            kept = b"".join(raw[a:b] for a, b in zip(ends, starts, strict=True))
            yield key, len(raw), len(raw) - len(kept), len(runs), kept

    joined = keyed.join(by_text.hint("shuffle_hash"), "v", "left").select("i", "t", "spans")
    return map_rows(joined, rows, f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept binary")


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, removed bytes and spans, and hash of the rest of each row of ``documents``; edge cases as in :func:`remove_repeats`."""
    out = remove_repeats(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[str | None]) -> list[tuple[int, int, int, str]]:
    """``n_bytes, n_removed, n_spans, kept_sha256`` of each text, by counting all windows; for tests."""
    seen: dict[bytes, int] = {}
    raws = [(t or "").encode() for t in texts]
    for raw in raws:
        for i in range(len(raw) - LENGTH + 1):
            seen[raw[i : i + LENGTH]] = seen.get(raw[i : i + LENGTH], 0) + 1
    out = []
    for raw in raws:
        gone = np.zeros(len(raw) + 1, np.int64)
        for i in range(len(raw) - LENGTH + 1):
            if seen[raw[i : i + LENGTH]] > 1:
                gone[i] += 1
                gone[i + LENGTH] -= 1
        mask = np.cumsum(gone)[:-1] > 0
        spans = int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())
        out.append((len(raw), int(mask.sum()), spans, hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~mask])).hexdigest()))
    return out

"""Near-duplicate documents (operator 8): order MinHash candidates, verified by banded alignment.

Every text is a sequence of five-word shingles, each labelled with the number of times it came before. An order MinHash sketch
is the two least shingles in one of many orders, as they stand in the text. Texts that share a sketch are candidates, and a
candidate pair is a link if a banded alignment of the words finds a similarity of 0.8 or more (1 - edits / words of the longer
text). Half of the orders take five adjacent words, half take five with a gap, some of which outlive edits at any regular
distance. Short texts, where few shingles outlive an edit, also share sketches of their three least words. Classes are the
connected parts of the links. Equal texts are one vertex.

In a bucket (the texts that share a sketch) every text is compared with the first, which joins most copies at once. Then each
text that isn't in the first one's part meets all others of the bucket that are in another part than its own, so no pair of a
bucket stays unseen. Pairs whose lengths or words differ too much for the similarity asked for, and pairs that other
links have joined already, are not aligned.

A large bucket in which several parts are left is that of a passage which unlike texts share. Its texts meet by their rarest
words instead: texts of n words that are similar enough share all but a fifth of them, so whatever order the words are put in,
they share one of the first n / 5 + 1. In an order by rarity those are words that few texts have, not those of the passage.
Where the first one that both have stands says how many words they can share at most.

Each text has its keys in one order, and a pair is made at the first key that both texts have: at a later one it is seen that
they share one of the keys before it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from luxtrace.llm.common import bounded_batches, columns, cut, drop, map_rows, read_table, release

#: Least similarity; places of a shingle's words, adjacent and with a gap; orders of each kind and shingles in a sketch.
LEAST = 0.8
ADJACENT, SPACED = (0, 1, 2, 3, 4), (0, 1, 2, 5, 6)
ORDERS, SAMPLED = 72, 2
#: Texts of at most BAG words have sketches of their least words too: orders and words in a sketch.
BAG, WORD_ORDERS, WORD_SAMPLED = 80, 32, 3
#: Buckets of more texts, in several parts, are asked by rare words. Counters of words; cells of a table that tells whether
#: texts of several parts have a word among their rarest; slices in which both are put together.
LARGE, CELLS, PART_CELLS, SLICES = 64, 1 << 18, 1 << 22, 64
_MIXED = np.uint32(1)
#: Members of a large bucket in a part of it, and most such parts; bits in the parity of words.
SALT, MOST_SALT = 32768, 64
#: Keys before a key that a text takes along, so that pairs which share one of them are not made again.
BEFORE = 32
PARITY = 512
#: Columns aligned before the match masks are made anew; shingles ordered at a time.
BLOCK, AT_A_TIME = 1024, 1 << 12
NULL_ID = -(1 << 63)

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_powers = [np.ones(1, _U), np.ones(1, _U)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=_U)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words between ASCII blanks, in lower case."""
    raw = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return np.zeros(0, _U)
    blank = np.concatenate([[True], _SPACE[raw], [True]])
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    start, end = edges[::2], edges[1::2]
    up, down = _powers_to(len(raw) + 1)
    sums = np.concatenate([np.zeros(1, _U), np.cumsum((raw.astype(_U) + _U(1)) * up[: len(raw)], dtype=_U)])
    return _mixed((sums[end] - sums[start]) * down[start])


def shingles(words: np.ndarray, places: tuple[int, ...] = ADJACENT) -> np.ndarray:
    """Hashes of the words at ``places`` from each word on; a text too short for them is one shingle."""
    if not len(words):
        return words
    if len(words) <= places[-1]:
        places = tuple(range(min(len(words), len(places))))
    n = len(words) - places[-1]
    out = np.zeros(n, _U)
    for i in places:
        out = out * _U(0x100000001B3 | 1) + words[i : i + n]
    return _mixed(out)


def labelled(found: np.ndarray) -> np.ndarray:
    """Each shingle's hash with the number of equal ones before it."""
    ordered = np.sort(found)
    if not (ordered[1:] == ordered[:-1]).any():
        return _mixed(found + _mixed(np.ones(1, _U)))
    order = np.argsort(found, kind="stable")
    ordered = found[order]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    place = np.arange(len(found))
    seen = np.empty(len(found), _U)
    seen[order] = (place - np.maximum.accumulate(np.where(first, place, 0))).astype(_U)
    return _mixed(found + _mixed(seen + _U(1)))


#: An order compares the products of marks and its factor, modulo 2**64.
_FACTORS = _mixed(np.arange(1, 2 * ORDERS + WORD_ORDERS + 1, dtype=_U) * _U(_BASE)) | _U(1)
_TOP = _U((1 << 64) - 1)


def sampled(marks: np.ndarray, factors: np.ndarray, few: int) -> np.ndarray:
    """A row for each order: the places of its ``few`` least marks, ascending as in the text."""
    rows, places = np.arange(len(factors)), None
    for first in range(0, len(marks), AT_A_TIME):
        values = np.multiply.outer(factors, marks[first : first + AT_A_TIME])
        found = []
        for _ in range(min(few, values.shape[1])):
            at = values.argmin(axis=1)
            values[rows, at] = _TOP
            found.append(at + first)
        found = np.stack(found, axis=1)
        if places is not None:
            found = np.concatenate([places, found], axis=1)
            least = np.argsort(marks[found] * factors[:, None], axis=1, kind="stable")[:, :few]
            found = np.take_along_axis(found, least, axis=1)
        places = found
    return np.sort(places, axis=1)


def sketches(words: np.ndarray) -> np.ndarray:
    """The hash of each order's sketch; none without words."""
    if not len(words):
        return np.zeros(0, np.int64)
    kinds = [(shingles(words), ORDERS, SAMPLED), (shingles(words, SPACED), ORDERS, SAMPLED)]
    if len(words) <= BAG:
        kinds.append((words, WORD_ORDERS, WORD_SAMPLED))
    out, first = [], 0
    for found, orders, few in kinds:
        factors, marks = _FACTORS[first : first + orders], labelled(found)
        keys = np.zeros(orders, _U)
        for at in sampled(marks, factors, few).T:
            keys = _mixed(keys + marks[at]) * _U(0x9FB21C651E98DF25)
        out.append(keys ^ factors)
        first += orders
    return np.concatenate(out).view(np.int64)


def parity(words: np.ndarray) -> list[int]:
    """Whether an odd number of words, each labelled with those like it before, falls into each of PARITY classes, as bits.

    An edit takes one word from the bag of words and puts one into it at most, so it changes two bits at most; words that come
    often don't cancel out.
    """
    marks = labelled(words) if len(words) else words
    odd = (np.bincount((marks % _U(PARITY)).astype(np.int64), minlength=PARITY) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).tolist()


def edits(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Edit distance of two sequences if it is at most ``most``, by alignment in a band around the diagonal.

    Bit r of the masks at column j stands for row j - band + r: vertical differences of +1 and -1 between its cells. Cells
    outside the band enter as if reached by an insertion or a deletion, so no result is too small, and any path of at most
    ``most`` edits stays inside.
    """
    if len(a) < len(b):
        a, b = b, a
    skew = len(a) - len(b)
    if skew > most:
        return None
    n = len(b)
    differ = a[:n] != b
    head = int(np.argmax(differ)) if differ.any() else n
    a, b = a[head:], b[head:]
    if len(b):
        differ = a[::-1][: len(b)] != b[::-1]
        tail = int(np.argmax(differ)) if differ.any() else len(b)
        a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(b):
        return skew
    band = most
    rows, cols = a.tolist(), b.tolist()
    width = 2 * band + 1
    mask = (1 << width) - 1
    up, down = mask & ~((1 << (band + 1)) - 1), 0
    bottom, watched, cost = 1 << (width - 1), 1 << (skew + band), skew
    for first in range(0, len(cols), BLOCK):
        masks: dict[int, int] = {}
        base = first - band  # row of bit 0
        for i in range(max(base, 0), min(first + BLOCK + band, len(rows))):
            w = rows[i]
            masks[w] = masks.get(w, 0) | 1 << (i - base)
        get = masks.get
        for j, w in enumerate(cols[first : first + BLOCK]):
            equal = get(w, 0) >> j & mask
            up, down = up >> 1 | bottom, down >> 1
            straight = (((equal & up) + up) ^ up | equal | down) & mask
            right_up = down | mask & ~(straight | up)
            right_down = straight & up
            moved = right_up << 1 | 1
            down = moved & straight
            up = (right_down << 1 | ~(moved | straight)) & mask
            if not straight & watched:
                cost += 1
                if cost > most:
                    return None
    return cost


def similarity(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> float | None:
    """``1 - edits / words of the longer text`` if that is at least ``least``; two texts without words are alike."""
    longest = max(len(a), len(b))
    if not longest:
        return 1.0
    most = _most(longest, least)
    if abs(len(a) - len(b)) > most:
        return None
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    known = np.sort(small)
    at = np.minimum(np.searchsorted(known, large), max(len(known) - 1, 0))
    if len(known) and int((known[at] != large).sum()) > most:  # words that cannot be matched
        return None
    found = edits(a, b, most)
    return None if found is None else 1 - found / longest


def fingerprint(words: np.ndarray) -> tuple[int, int]:
    """128 bits of all words, as two signed integers."""
    f = xxhash.xxh3_128_digest(words.tobytes())
    return int.from_bytes(f[:8], "big", signed=True), int.from_bytes(f[8:], "big", signed=True)


def sketch_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``d, n, f1, f2, keys, odd``: number and fingerprint of the words, sketches and parity of each row."""

    def rows(it: Iterable[tuple]) -> Iterator[tuple]:
        for d, text in it:
            words = word_hashes(text)
            yield (NULL_ID if d is None else d, len(words), *fingerprint(words), sketches(words).tolist(), parity(words))

    return map_rows(_given(docs, id_col, text_col), rows, "d long, n long, f1 long, f2 long, keys array<long>, odd array<long>")


def _given(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return columns(docs, id_col, text_col).toDF("i", "t").select(F.coalesce(F.col("i").cast("long"), F.lit(NULL_ID)).alias("d"), "t")


def distinct_texts(sketched: DataFrame) -> DataFrame:
    """``f1, f2, d, v``: the smallest id of each text and its vertex, which is that id but where texts share one."""
    texts = cut(sketched.groupBy("f1", "f2").agg(F.min("d").alias("d")), "firsts")  # the joins can then split a text of many copies
    first = texts.groupBy("d").agg(F.min(F.struct("f1", "f2")).alias("first"), F.count(F.lit(1)).alias("texts")).where("texts > 1")
    shared = cut(first.select(F.col("d").alias("d0"), F.col("first.f1").alias("g1"), F.col("first.f2").alias("g2")), "shared-ids")
    if shared.isEmpty():
        return texts.withColumn("v", F.col("d"))
    own = F.when(F.col("d0").isNull() | (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")), F.col("d")).otherwise(F.xxhash64("d", "f1", "f2"))
    return cut(texts.join(shared, F.col("d") == F.col("d0"), "left").select("f1", "f2", "d", own.alias("v")), "vertices")


def _near(a: str, b: str, least: float) -> F.Column:
    return F.least(a, b) >= F.greatest(a, b) * least - 1e-9


def _members(texts: DataFrame) -> DataFrame:
    """``key, v, n, size, lead, lead_n``: the buckets of two texts or more, with their size, the first text and its number of words."""
    buckets = texts.select("v", F.col("n").cast("int").alias("n"), F.explode(F.array_distinct("keys")).alias("key"))
    sizes = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = cut(buckets.join(sizes, "key"), "buckets")  # few rows of many, so the first text is looked for afterwards
    release(texts.sparkSession)
    out = cut(shared.join(shared.groupBy("key").agg(F.min("v").alias("lead"), F.min_by("n", "v").alias("lead_n")), "key"), "members")
    drop(shared)
    return out


def _stars(members: DataFrame, least: float) -> DataFrame:
    """``x, y`` (x below y, each once): the first member of each bucket with the others of fitting length."""
    return members.where("lead < v").where(_near("lead_n", "n", least)).select(F.col("lead").alias("x"), F.col("v").alias("y")).distinct()


def _words_may_agree(least: float) -> F.Column:
    """Of columns ``nx, ny, x0, y0, x1, ...``: false only where the parities of words rule the similarity out."""
    unlike = F.expr(" + ".join(f"bit_count(x{k} ^ y{k})" for k in range(PARITY // 64)))
    return unlike <= 2 * F.floor(F.greatest("nx", "ny") * (1 - least) + 1e-9)


def _odds(side: str) -> list[F.Column]:
    return [F.col("v").alias(side), F.col("n").alias(f"n{side}"), *(F.col("odd")[k].alias(f"{side}{k}") for k in range(PARITY // 64))]


def _alike(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The ``pairs`` whose lengths and words may agree well enough."""
    both = pairs.join(texts.select(*_odds("x")), "x").join(texts.select(*_odds("y")), "y")
    return both.where(_near("nx", "ny", least)).where(_words_may_agree(least)).select("x", "y")


def _with_parts(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``key, v, size, part, led`` and ``place``, if there is one: the part that each member is in, and whether the bucket's first text is in it as well."""
    part, lead_part = F.col("v"), F.col("lead")
    if labels is not None:
        members = members.join(labels.toDF("v", "label"), "v", "left").join(labels.toDF("lead", "lead_label"), "lead", "left")
        part, lead_part = F.coalesce("label", "v"), F.coalesce("lead_label", "lead")
    return cut(members.select("key", "v", "size", *({"place"} & {*members.columns}), part.alias("part"), (part == lead_part).alias("led")), "parts")


def _most(n: int, least: float) -> int:
    """Edits that a text of ``n`` words may be away from a shorter or equally long one."""
    return int((1 - least) * n + 1e-9)


def _table(words: DataFrame, size: int, kind: type, fill: Callable[[np.ndarray, tuple], None], merge: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """An array of fixed size over all rows: each task ``fill``s one, and the slices of all tasks are ``merge``d by slice."""

    def partial(it: Iterable[tuple]) -> Iterator[tuple]:
        own = np.zeros(size, kind)
        for r in it:
            fill(own, r)
        yield from ((k, zstandard.compress(part.tobytes(), 1)) for k, part in enumerate(np.split(own, SLICES)) if part.any())

    read = lambda x: np.frombuffer(zstandard.decompress(x.as_py()), kind)

    def merged(key: tuple, table: pa.Table) -> pa.Table:
        whole = reduce(merge, map(read, table["part"]))
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int64()), "part": pa.array([zstandard.compress(whole.tobytes(), 1)], pa.binary())})

    rows = map_rows(words, partial, "slice long, part binary").groupBy("slice").applyInArrow(merged, "slice long, part binary").collect()
    out = np.zeros((SLICES, size // SLICES), kind)
    for k, part in rows:
        out[k] = np.frombuffer(zstandard.decompress(part), kind)
    return out.ravel()


def _counters(words: DataFrame) -> np.ndarray:
    """How many of the words of all texts fall into each of CELLS counters."""

    def fill(own: np.ndarray, row: tuple) -> None:
        own += np.bincount((_marks(row[0]) % _U(CELLS)).astype(np.int64), minlength=CELLS)

    return _table(words.select("w"), CELLS, np.int64, fill, np.add)


def _several_parts(words: DataFrame, counts: np.ndarray, least: float) -> np.ndarray:
    """Two tables of cells by word and class of length: 0, _MIXED, or a hash of the one part that has the word among the rarest."""

    def fill(own: np.ndarray, row: tuple) -> None:
        part, w = row
        marks = _marks(w)
        mine = _part_hash(part)
        for at in _cells(_rarest(marks, counts, least), _length_class(len(marks), least)):
            held = own[at]
            own[at] = np.where((held == 0) | (held == mine), mine, _MIXED)

    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(a == 0, b, np.where((b == 0) | (a == b), a, _MIXED)).astype(np.uint32)

    return _table(words.select("part", "w"), 2 * PART_CELLS, np.uint32, fill, merge)


def _part_hash(part: int) -> np.uint32:
    return np.uint32(int(_mixed(np.array([part], np.int64).view(_U))[0]) & 0xFFFFFFFF | 2)


def _length_class(n: int, least: float) -> int:
    """Classes of a quarter of the range in which lengths may differ: similar texts are at most four apart."""
    return math.floor(4 * math.log(max(n, 1)) / _width(least))


def _width(least: float) -> float:
    return max(-math.log(least), 0.01) * 1.0001


def _cells(marks: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of words in both tables."""
    h = _mixed(marks + _U((length + 1) * _BASE % (1 << 64)))
    return (h >> _U(40)).astype(np.int64) % PART_CELLS, PART_CELLS + (h % _U(PART_CELLS)).astype(np.int64)


def _elsewhere(marks: np.ndarray, length: int, part: int, cells: np.ndarray) -> np.ndarray:
    """The marks that a text of another part and fitting length may have among its rarest; none that one has is missed."""
    mine, found = _part_hash(part), np.zeros(len(marks), bool)
    for near in range(length - 4, length + 5):
        if near >= 0:
            a, b = (cells[at] for at in _cells(marks, near))
            found |= (a != 0) & (a != mine) & (b != 0) & (b != mine)
    return marks[found]


def _marks(w: bytes) -> np.ndarray:
    return labelled(np.frombuffer(w, np.uint32).astype(_U))


def _rarest(marks: np.ndarray, counts: np.ndarray, least: float) -> np.ndarray:
    """The first marks, by rarity and then by value, of which texts that are similar enough share one."""
    return marks[np.lexsort((marks, counts[(marks % _U(CELLS)).astype(np.int64)]))[: _most(len(marks), least) + 1]]


def _by_rare_words(docs: DataFrame, texts: DataFrame, ids: DataFrame, least: float, id_col: str, text_col: str) -> DataFrame:
    """``key, v, place, size, lead``: of the texts ``ids`` (``v, part``), those that share one of their rarest words with another part's of fitting length.

    ``place`` counts the text's words that come before the key in the order by rarity.
    """
    words = words_of(docs, texts, ids, id_col=id_col, text_col=text_col)
    counts = _counters(words)
    cells = _several_parts(words, counts, least)

    def rows(it: Iterable[tuple]) -> Iterator[tuple]:
        for v, part, w in it:
            marks = _marks(w)
            rarest = _rarest(marks, counts, least)
            found = _elsewhere(rarest, _length_class(len(marks), least), part, cells)
            yield from ((v, m, k) for m, k in zip(found.view(np.int64).tolist(), np.flatnonzero(np.isin(rarest, found)).tolist(), strict=True))

    shared = cut(map_rows(words.select("v", "part", "w"), rows, "v long, key long, place long"), "rare-words")
    sizes = shared.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("v").alias("lead")).where("size > 1")
    out = cut(shared.join(sizes, "key").select("key", "v", "place", "size", "lead"), "members")
    drop(words, shared)
    return out


def _rest(docs: DataFrame, members: DataFrame, texts: DataFrame, labels: DataFrame | None, least: float, id_col: str, text_col: str) -> DataFrame:
    """``x, y``: the pairs of buckets that are in different parts and whose lengths and words may agree."""
    parts = _with_parts(members, labels)
    large = _mixed_buckets(parts.where(F.col("size") > LARGE)).select("v", "part").distinct()
    found = [_pairs(_mixed_buckets(parts.where(F.col("size") <= LARGE)), texts, least)]
    if not large.isEmpty():
        rare = _by_rare_words(docs, texts, cut(large, "large"), least, id_col, text_col)
        found.append(_pairs(_mixed_buckets(_with_parts(rare, labels)), texts, least))
    out = cut(reduce(DataFrame.union, found).distinct(), "pairs")
    drop(parts)
    return out


def _mixed_buckets(parts: DataFrame) -> DataFrame:
    """The members of buckets in which some text isn't in the first one's part; those texts themselves need no join."""
    apart = parts.where("NOT led")
    return apart.union(parts.where("led").join(apart.select("key").distinct(), "key", "left_semi").select(*parts.columns))


def _pairs(parts: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """``x, y`` of these buckets: texts outside the first one's part meet the bucket's others.

    Both sides are dealt out by bucket, by length (classes of similar texts differ by one at most) and, where a bucket is very
    large, by a hash; only pairs that pass leave the join. A pair passes at the first of its keys (by ``place``, or by value),
    and again only where more than BEFORE other keys of one of the texts stand between two that both have.
    """
    length = F.floor(F.log("n") / _width(least))
    salts = F.least(F.ceil(F.col("size") / SALT), F.lit(MOST_SALT)).cast("int")
    placed = "place" in parts.columns
    before = Window.partitionBy("v").orderBy("place" if placed else "key").rowsBetween(-BEFORE, -1)
    found = parts.withColumn("before", F.collect_list("key").over(before)).join(texts.select("v", "n", "odd"), "v")
    at = ["place", "before"] if placed else ["before"]
    few = found.where("NOT led").select("*", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt")).select("*", F.explode(F.array(length - 1, length, length + 1)).alias("length"))
    few = few.select("key", "length", "salt", F.col("part").alias("part_x"), *_odds("x"), *[F.col(c).alias(f"{c}_x") for c in at])
    all_ = found.select("key", length.alias("length"), F.pmod(F.xxhash64("v"), salts).cast("int").alias("salt"), F.col("part").alias("part_y"), "led", *_odds("y"), *[F.col(c).alias(f"{c}_y") for c in at])
    both = few.join(all_, ["key", "length", "salt"]).where("part_x != part_y AND (led OR x < y)").where(_near("nx", "ny", least)).where(_words_may_agree(least))
    if placed:  # the first key of both: no word before it is shared
        both = both.where(F.least(F.col("nx") - F.col("place_x"), F.col("ny") - F.col("place_y")) >= F.greatest("nx", "ny") - F.floor(F.greatest("nx", "ny") * (1 - least) + 1e-9))
    both = both.where(~F.arrays_overlap("before_x", "before_y"))
    return both.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))


def _apart(pairs: DataFrame, labels: DataFrame | None, x: str, y: str) -> DataFrame:
    """The rows whose two vertices are in different parts; a vertex without a label is a part of its own."""
    if labels is None:
        return pairs
    for c in (x, y):
        pairs = pairs.join(labels.toDF(c, f"__{c}"), c, "left").withColumn(f"__{c}", F.coalesce(f"__{c}", c))
    return pairs.where(F.col(f"__{x}") != F.col(f"__{y}")).drop(f"__{x}", f"__{y}")


def words_of(docs: DataFrame, texts: DataFrame, ids: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``v, w``: the words of the texts ``ids`` (``v``, each once), as hashes of 32 bits, written to the shared folder.

    More columns of ``ids`` (whole numbers) are kept.

    Each text is found once: by its smallest id and, as rows of one id can differ, its fingerprint.
    """
    more = [c for c in ids.columns if c != "v"]
    wanted = texts.select("v", "d", "f1", "f2").join(ids, "v")

    def hashed(it: Iterable[tuple]) -> Iterator[tuple]:
        for v, f1, f2, *kept, text in it:
            words = word_hashes(text)
            if fingerprint(words) == (f1, f2):
                yield v, *kept, words.astype(np.uint32).tobytes()

    joined = _given(docs, id_col, text_col).join(wanted.hint("shuffle_hash"), "d").select("v", "f1", "f2", *more, "t")
    return cut(map_rows(joined, hashed, ", ".join(["v long", *(f"{c} long" for c in more), "w binary"])), "words")


def verify(words: DataFrame, pairs: DataFrame, *, least: float = LEAST) -> DataFrame:
    """The ``pairs`` (``x, y``) whose texts are similar enough, with ``similarity``."""
    left, right = words.toDF("x", "wx"), words.toDF("y", "wy")

    def compared(it: Iterable[tuple]) -> Iterator[tuple]:
        for x, y, wx, wy in it:
            found = similarity(np.frombuffer(wx, np.uint32), np.frombuffer(wy, np.uint32), least)
            if found is not None:
                yield x, y, found

    both = pairs.join(left, "x").join(right, "y").select("x", "y", "wx", "wy")
    return cut(map_rows(both, compared, "x long, y long, similarity double"), "links")


def classes_of(docs: DataFrame, texts: DataFrame, *, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame | None:
    """``v, label`` of texts with links, the connected parts of all verified links.

    ``texts`` has a row ``v, d, n, f1, f2, keys, odd`` for each different text; its row in ``docs`` is found by id and fingerprint.
    """
    spark, labels = docs.sparkSession, None
    members = _members(texts)
    release(spark)
    for step in ("stars", "rest"):
        candidates = cut(_alike(_stars(members, least), texts, least), "pairs") if step == "stars" else _rest(docs, members, texts, labels, least, id_col, text_col)
        words = None
        first = candidates.groupBy("y").agg(F.min("x").alias("x")).select("x", "y")  # joins most copies at once
        for todo in (first, candidates):
            todo = cut(_apart(todo, labels, "x", "y"), "todo")
            if not todo.isEmpty():
                if words is None:
                    ids = candidates.select(F.explode(F.array("x", "y")).alias("v")).distinct()
                    words = words_of(docs, texts, ids, id_col=id_col, text_col=text_col)
                links = verify(words, todo, least=least)
                labels = _joined(labels, links.select("x", "y"))
                drop(links)
            drop(todo)
        release(spark, candidates, *([words] if words else []))
    drop(members)
    return labels


def _joined(labels: DataFrame | None, edges: DataFrame) -> DataFrame | None:
    """Labels after more edges: the parts so far are the vertices, so old edges aren't looked at again."""
    if labels is None:
        return components(edges)
    for c in ("x", "y"):
        edges = edges.join(labels.toDF(c, f"__{c}"), c, "left").withColumn(f"__{c}", F.coalesce(f"__{c}", c))
    parts = components(edges.select(F.col("__x").alias("x"), F.col("__y").alias("y")).where("x != y").distinct())
    if parts is None:
        return labels
    old = labels.join(parts.toDF("label", "__new"), "label", "left").select("v", F.coalesce("__new", "label").alias("label"))
    return cut(old.union(parts.join(labels.select("v"), "v", "left_anti").select("v", "label")), "labels")


def components(edges: DataFrame) -> DataFrame | None:
    """``v, label``: the smallest vertex of the connected part of each vertex that has an edge.

    Every round takes the least label among the neighbours and then the label of that label; each round is written to the
    shared folder.
    """
    spark = edges.sparkSession
    if edges.isEmpty():
        return None
    both = cut(edges.select("x", "y").union(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    labels = cut(both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("label")).withColumnRenamed("x", "v"), "labels")
    while True:
        near = both.join(labels.toDF("y", "near"), "y").groupBy("x").agg(F.min("near").alias("near"))
        taken = labels.join(near.withColumnRenamed("x", "v"), "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("got"))
        jump = labels.toDF("got", "further")
        new = taken.join(jump, "got", "left").select("v", "old", F.least("got", F.coalesce("further", "got")).alias("label"))
        new = cut(new, "labels")
        done = new.where("old != label").isEmpty()
        drop(labels)
        labels = new.select("v", "label")
        if done:
            return labels


def near_duplicates(docs: DataFrame, *, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, class_id``, one row for each row of ``docs``: the smallest id among its near-duplicates, itself included.

    Texts with the same words are alike whatever their length; null, empty and blank texts have the same (no) words. A null id
    is below all others and stays null. Rows of one id and different texts are judged each by its own text. Repeated rows are
    copies; an empty table gives none. Other columns, of any name, are ignored.
    """
    return _classified(docs, least, id_col, text_col).select(F.nullif("d", F.lit(NULL_ID)).alias(id_col), F.nullif("class_id", F.lit(NULL_ID)).alias("class_id"))


def _classified(docs: DataFrame, least: float, id_col: str, text_col: str) -> DataFrame:
    """``d, f1, f2, class_id`` and ``kept``, which is true for the first text of the smallest id of each class."""
    spark = docs.sparkSession
    bounded_batches(spark)
    sketched = cut(sketch_documents(docs, id_col=id_col, text_col=text_col), "sketches")
    vertices = distinct_texts(sketched)
    members = cut(sketched.select("d", "f1", "f2").join(vertices.select("f1", "f2", "v"), ["f1", "f2"]), "members")
    texts = sketched.join(vertices, ["f1", "f2", "d"]).select("v", "d", "n", "f1", "f2", "keys", "odd")
    texts = cut(texts.dropDuplicates(["f1", "f2", "d"]), "texts")
    release(spark, sketched)
    labels = classes_of(docs, texts, least=least, id_col=id_col, text_col=text_col)
    of = vertices.withColumn("label", F.col("v"))
    if labels is not None:
        of = vertices.join(labels, "v", "left").withColumn("label", F.coalesce("label", "v"))
    of = cut(of.select("v", "d", "label"), "labels-of-texts")
    least_of = cut(of.groupBy("label").agg(F.min(F.struct("d", "v")).alias("first")), "classes")
    named = of.join(least_of, "label").select("v", F.col("first.d").alias("class_id"), (F.col("v") == F.col("first.v")).alias("first"))
    named = cut(named, "named")
    drop(texts, of, least_of)
    return members.join(named, "v").select("d", "f1", "f2", "class_id", (F.col("first") & (F.col("d") == F.col("class_id"))).alias("kept"))


def keep_one(docs: DataFrame, *, least: float = LEAST) -> DataFrame:
    """One row of ``docs`` for each class of near-duplicates, that of the smallest id; no column changes.

    Null, empty and blank texts are one class. Of different texts under one id (or under a null id, which is below all others)
    in one class the one of the smallest vertex stays; those of different classes all stay. Of repeated rows with equal id and
    words one stays, the least by its text and then by its other columns. Columns may have any name; an empty table stays empty.
    """
    rows = _classified(docs, least, "doc_id", "text").where("kept").groupBy("d", "f1", "f2").count()
    kept = cut(rows.toDF("d0", "f1", "f2", "rows"), "kept")  # the columns of docs are c0, c1, ... below, whatever their names
    names = docs.columns
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])
    d, t = (f"c{names.index(c)}" for c in ("doc_id", "text"))
    found = plain.join(kept.hint("shuffle_hash"), F.coalesce(F.col(d).cast("long"), F.lit(NULL_ID)) == F.col("d0")).select(*plain.columns, "f1", "f2")
    at = names.index("text")

    def same(it: Iterable[tuple]) -> Iterator[tuple]:
        for row in it:
            if fingerprint(word_hashes(row[at])) == row[-2:]:
                yield row

    out = map_rows(found, same, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema))
    if not kept.where("rows > 1").isEmpty():
        order = F.struct(t, F.to_json(F.struct(*plain.columns)))
        out = out.groupBy(d, "f1", "f2").agg(F.min_by(F.struct(*plain.columns), order).alias("row")).select("row.*")
    return out.select(*plain.columns).toDF(*names)


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, class_id`` of each row of ``documents``; nulls, empty texts and repeated rows as in :func:`near_duplicates`."""
    return near_duplicates(read_table(spark, sf_dir, "documents"))

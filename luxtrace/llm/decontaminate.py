"""Benchmark decontamination (operator 4) by templates.

Words become template tokens: numbers, units after numbers and names turn into typed placeholders, other words lose case and
outer punctuation. A document leaks a benchmark item if at least 0.8 of the item's windows of five template tokens are found
in one stretch of it with slots that agree: one value of the item stands for one value of the document, throughout and both
ways. So questions whose numbers or names were changed are found, and texts that share a frame by chance are not. A capitalised
word at the start of a sentence may be a name or not: windows take both readings. An item without windows (below five words, or
nearly all slots) is leaked by a text that has its whole template.

Windows of both sides meet in joins of their hashes. Bit maps of fixed size tell the documents' tasks which words and windows
no item has, so that few rows leave them. First a text meets an item in the rarest of the item's windows, so many of them that a leak
must have one; then all windows of the pairs so found are compared. Equal texts are one.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from luxtrace.llm.common import bounded_batches, columns, cut, drop, map_rows, read_table

#: Template tokens in a window, how many must be words, and the share of an item's windows that makes a leak.
WINDOW, WORDS, LEAST = 5, 3, 0.8
#: The bit maps of windows and of words have ``1 << FILTER_BITS`` bits (4 MB) each, made in pieces of ``1 << PIECE_BITS``.
FILTER_BITS, PIECE_BITS = 25, 15
#: Words kept with their token in each Python worker.
WORDS_KEPT = 300_000

UNITS = frozenset(
    "mm cm m km inch inches foot feet ft yard yards mile miles mg g gram grams kg kilogram kilograms lb lbs pound pounds ounce ounces ton tons "
    "ml l liter liters litre litres gallon gallons second seconds sec minute minutes min hour hours day days week weeks month months year years "
    "dollar dollars cent cents euro euros percent degree degrees mph kph watt watts volt volts joule joules newton newtons meter meters metre metres".split()
)
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty "
    "thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half".split()
)
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*%?")
_NUMBER_UNIT = re.compile(r"[+-]?[$€£]?\d[\d.,]*([^\W\d_]+)")
_BEFORE_NUMBER = "+-$€£"
_OUTER = "\"'“”‘’«»()[]{}<>.,;:!?*#%&$…-–—_/\\|"
NUM, NAME, UNIT = 1, 2, 3
_FIRST_WORD = 4
# Of a packed word: its own token, then flags.
_OWN = (1 << 56) - 1
_ENDS, _IS_NUM, _MAY_UNIT, _NAMED = (1 << k for k in range(56, 60))
_WHOLE = 0x5BD1E995


def _word(bare: str) -> int:
    return max(xxhash.xxh3_64_intdigest(bare.encode("utf-8", "surrogatepass")) & _OWN, _FIRST_WORD)


def pack(word: str) -> int:
    ends = _ENDS if word.rstrip("\"'”’»)]")[-1:] in (".", "!", "?", ":") else 0
    bare = word.strip(_OUTER)
    low = bare.lower()
    if not bare:
        return _word(word) | ends
    may_count = bare[0].isdigit() or bare[0] in _BEFORE_NUMBER
    if low in NUMBER_WORDS or may_count and (_NUMBER.fullmatch(bare) or (m := _NUMBER_UNIT.fullmatch(bare)) and m[1].lower() in UNITS):
        return NUM | ends | _IS_NUM
    named = bare[0].isupper() and len(bare) > 1 and not bare.isupper()
    return _word(low) | ends | (_NAMED if named else 0) | (_MAY_UNIT if low in UNITS else 0)


class Templates:
    """Template tokens of words, as numbers: placeholders, hashes of other words, and 0 for words that no item has.

    ``known`` is a bit map of the items' words; without it all words are known.
    """

    def __init__(self, known: np.ndarray | None = None):
        self.kept = _Words(known)

    def read(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens, with starts of sentences as words, and which of these starts may be names."""
        packed = np.fromiter(map(self.kept.__getitem__, words), np.int64, len(words))
        if not len(packed):
            return packed, packed > 0
        starts = np.concatenate([[True], packed[:-1] & _ENDS != 0])
        named = packed & _NAMED != 0
        units = np.concatenate([[False], packed[:-1] & _IS_NUM != 0]) & (packed & _MAY_UNIT != 0)
        out = np.where(named & ~starts, NAME, packed & _OWN)
        out[units] = UNIT
        return out, starts & named & ~units


class _Words(dict):
    def __init__(self, known: np.ndarray | None):
        self.known = None if known is None else known.tobytes()

    def __missing__(self, word: str) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        packed = pack(word)
        own = packed & _OWN
        if self.known is not None and own >= _FIRST_WORD:
            at = own >> 56 - FILTER_BITS
            if not self.known[at >> 3] >> 7 - (at & 7) & 1:
                packed -= own
        self[word] = packed
        return packed


def _mix(h: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    h = (h ^ tokens.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ h >> np.uint64(29)


def readings(tokens: np.ndarray, may_name: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(places, hashes, named)`` of the windows, one for each choice of names (bits of ``named``) among words that may be some.

    A window has WORDS words at least; such a word counts as a word in either reading. Windows with unknown words are left out.
    """
    n = len(tokens) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    words = np.concatenate([[0], np.cumsum((tokens >= _FIRST_WORD) | may_name)])
    unknown = np.concatenate([[0], np.cumsum((tokens == 0) & ~may_name)])
    enough = np.flatnonzero((words[WINDOW:] - words[:-WINDOW] >= WORDS) & (unknown[WINDOW:] == unknown[:-WINDOW]))
    bits = np.zeros(len(enough), np.int64)
    for k in range(WINDOW):
        bits |= may_name[enough + k].astype(np.int64) << k
    choices = sorted({m for b in set(bits.tolist()) for m in range(b + 1) if m & b == m})  # that some window has
    if not choices:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    each = [enough[bits & m == m] if m else enough for m in choices]
    at, named = np.concatenate(each), np.repeat(choices, [len(x) for x in each])
    h, known = np.zeros(len(at), np.uint64), np.ones(len(at), bool)
    for k in range(WINDOW):
        t = np.where(named >> k & 1, NAME, tokens[at + k])
        h, known = _mix(h, t), known & (t > 0)
    return at[known], h[known], named[known]


def whole(tokens: np.ndarray) -> np.uint64:
    """The hash of a text's whole template."""
    places = np.arange(len(tokens), dtype=np.uint64)
    return np.bitwise_xor.reduce(_mix(_mix(places + np.uint64(_WHOLE), tokens), places))


def _signed(h: np.ndarray) -> list[int]:
    return h.astype(np.uint64).view(np.int64).tolist()


def item_windows(items: DataFrame) -> DataFrame:
    """``h, item, i, named, n`` of items ``item, text``: their windows with place, reading and number of places.

    An item without windows has its whole template at place -1 instead; an item without words has no row.
    """

    def rows(it: Iterable[tuple]) -> Iterator[tuple]:
        templates = Templates()
        for item, text in it:
            tokens, may_name = templates.read(text.split())
            at, hashes, named = readings(tokens, may_name)
            n = len(np.unique(at))
            if n:
                yield from ((h, item, i, m, n) for h, i, m in zip(_signed(hashes), at.tolist(), named.tolist(), strict=True))
            elif len(tokens):
                yield _signed(whole(tokens)[None])[0], item, -1, 0, 1

    return map_rows(items.select("item", "text"), rows, "h long, item long, i int, named int, n int")


def item_words(items: DataFrame) -> DataFrame:
    """``h``: the tokens of the items' words, as the upper bits of a hash."""

    def rows(it: Iterable[tuple]) -> Iterator[tuple]:
        for (text,) in it:
            own = {pack(w) & _OWN for w in text.split()}
            yield from ((h,) for h in _signed(np.array(sorted(x for x in own if x >= _FIRST_WORD), np.uint64) << np.uint64(8)))

    return map_rows(items.select("text"), rows, "h long")


def bit_map(windows: DataFrame) -> np.ndarray:
    """One bit for each value of the hashes' upper FILTER_BITS bits, made on the executors; its size is fixed."""
    place = F.shiftrightunsigned("h", 64 - FILTER_BITS)
    bits = windows.select(F.shiftright(place, PIECE_BITS).cast("int").alias("piece"), place.bitwiseAND((1 << PIECE_BITS) - 1).cast("int").alias("bit")).distinct()

    def pieces(it: Iterable[tuple]) -> Iterator[tuple]:
        for piece, found in it:
            own = np.zeros(1 << PIECE_BITS, bool)
            own[found] = True
            yield piece, np.packbits(own).tobytes()

    out = np.zeros((1 << (FILTER_BITS - PIECE_BITS), 1 << (PIECE_BITS - 3)), np.uint8)
    grouped = bits.groupBy("piece").agg(F.collect_list("bit").alias("found"))  # 1 << PIECE_BITS at most
    for piece, own in map_rows(grouped, pieces, "piece int, own binary").collect():  # 1 << (FILTER_BITS - PIECE_BITS) rows
        out[piece] = np.frombuffer(own, np.uint8)
    return out.ravel()


def _in_map(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
    return bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 == 1


def _keyed(docs: DataFrame, text_col: str) -> list[F.Column]:
    """128 bits of a text."""
    return [F.xxhash64(F.col(text_col)).alias("a"), F.xxhash64(F.lit("second"), F.col(text_col)).alias("b")]


def document_windows(docs: DataFrame, bits, text_col: str) -> DataFrame:
    """``a, b, h, j, w``: the windows of each text that may be some item's, with their place and words; each once."""

    def rows(it: Iterable[tuple]) -> Iterator[tuple]:
        known, words_known = bits.value
        templates = Templates(words_known)
        for a, b, text in it:
            words = (text or "").split()
            tokens, may_name = templates.read(words)
            at, hashes, _ = readings(tokens, may_name)
            hit = _in_map(known, hashes)
            yield from ((a, b, h, j, " ".join(words[j : j + WINDOW])) for h, j in zip(_signed(hashes[hit]), at[hit].tolist(), strict=True))
            if words and tokens.all() and _in_map(known, h := whole(tokens)[None])[0]:
                yield a, b, _signed(h)[0], -1, " ".join(words)

    given = columns(docs, text_col).toDF("t").select(*_keyed(docs, "t"), "t")
    found = map_rows(given, rows, "a long, b long, h long, j int, w string")
    return found.dropDuplicates(["a", "b", "h", "j"])


def _bare(word: str) -> str:
    return word.strip(_OUTER).lower() or word


def agreeing(pairs: list[tuple[int, int, int, str]], item_words: list[str], tokens: list[int]) -> tuple[int, bool]:
    """Windows of the item whose slots follow the commonest value for value, both ways; and whether a value differs.

    A pair is ``(j, i, named, words)``; what isn't a slot must be the same word.
    """
    slots = []
    for _, i, named, words in pairs:
        mine = item_words[i : i + WINDOW] if i >= 0 else item_words
        read = [NAME if named >> k & 1 else t for k, t in enumerate(tokens[i : i + WINDOW] if i >= 0 else tokens)]
        theirs = words.split(" ")
        if len(theirs) == len(mine) and all(t < _FIRST_WORD or _bare(a) == _bare(b) for t, a, b in zip(read, mine, theirs, strict=True)):
            slots.append((i, [(t, _bare(a), _bare(b)) for t, a, b in zip(read, mine, theirs, strict=True) if t < _FIRST_WORD]))
    there: dict[tuple, Counter] = defaultdict(Counter)
    back: dict[tuple, Counter] = defaultdict(Counter)
    for _, values in slots:
        for kind, a, b in values:
            there[kind, a][b] += 1
            back[kind, b][a] += 1
    one = {k: max(c, key=lambda b: (c[b], b)) for k, c in there.items()}
    other = {k: max(c, key=lambda a: (c[a], a)) for k, c in back.items()}
    good, changed = set(), False
    for i, values in slots:
        if all(one[kind, a] == b and other[kind, b] == a for kind, a, b in values):
            good.add(i)
            changed |= any(a != b for _, a, b in values)
    return len(good), changed


def judged(pairs: list[tuple[int, int, int, str]], text: str, n: int, least: float, templates: Templates) -> tuple[float, int, bool] | None:
    """``(coverage, matched windows, changed)`` of the best stretch, or None if it is no leak."""
    words = text.split()
    tokens = templates.read(words)[0].tolist()
    best = max((agreeing(stretch, words, tokens) for stretch in _stretches(pairs, len(words))), default=(0, False))
    if best[0] < least * n - 1e-9:
        return None
    if pairs[0][1] < 0 and best[1] and max(tokens) < _FIRST_WORD:  # nothing but slots: other values are another text
        return None
    return best[0] / n, best[0], best[1]


def _stretches(pairs: list[tuple[int, int, int, str]], size: int) -> Iterator[list[tuple[int, int, int, str]]]:
    """Matches in order of their place, parted where more than the item's length is between two."""
    held: list[tuple[int, int, int, str]] = []
    for p in sorted(pairs):
        if held and p[0] - held[-1][0] > size:
            yield held
            held = []
        held.append(p)
    if held:
        yield held


def leaking_texts(docs: DataFrame, items: DataFrame, *, least: float = LEAST, text_col: str = "text") -> DataFrame:
    """``a, b, item, coverage, n_windows, changed``: each different text (by 128 bits) of ``docs`` with each item that it leaks.

    ``items`` has columns ``item`` (a number of its own for each) and ``text`` (not null).
    """
    spark = docs.sparkSession
    windows = cut(item_windows(items), "item-windows")
    bits = spark.sparkContext.broadcast((bit_map(windows), bit_map(item_words(items))))
    hits = cut(document_windows(docs, bits, text_col), "windows")
    bits.unpersist()
    # of n places a leak has least * n, so it has one of any n - least * n + 1 places: the rarest are joined
    spread = windows.groupBy("h").agg(F.count_distinct("item").alias("items"))
    places = windows.join(spread, "h").groupBy("item", "i").agg(F.max("items").alias("items"), F.first("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy("items", "i"))
    rare = places.withColumn("rank", rank).where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).select("item", "i")
    asked = cut(windows.join(rare, ["item", "i"]).select("h", "item").distinct(), "rare-windows")
    pairs = cut(hits.select("a", "b", "h").join(asked, "h").select("a", "b", "item").distinct(), "pairs")
    met = pairs.join(windows, "item").join(hits, ["a", "b", "h"])
    grouped = met.groupBy("a", "b", "item", "n").agg(F.collect_list(F.struct("j", "i", "named", "w")).alias("pairs"), F.count_distinct("i").alias("seen"))  # of one text
    enough = grouped.where(F.col("seen") >= F.col("n") * least - 1e-9).join(items.select("item", F.col("text").alias("of")), "item")

    def rows(it: Iterable[tuple]) -> Iterator[tuple]:
        templates = Templates()
        for a, b, item, n, found, of in it:
            got = judged([(p["j"], p["i"], p["named"], p["w"]) for p in found], of, n, least, templates)
            if got:
                yield (a, b, item, *got)

    out = cut(map_rows(enough.select("a", "b", "item", "n", "pairs", "of"), rows, "a long, b long, item long, coverage double, n_windows long, changed boolean"), "leaks")
    drop(windows, hits, asked, pairs)
    return out


def _numbered(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """``item, id, text``: the items with text, each row with a number, written to the shared folder."""
    given = columns(benchmark, item_col, text_col).toDF("id", "text").where("text IS NOT NULL")
    return cut(given.select(F.monotonically_increasing_id().alias("item"), "id", "text"), "items")


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, coverage, n_windows, changed``: one row for each document and item that it leaks.

    ``changed`` tells that some slot has another value than the item. Null and empty texts leak nothing, null and empty items
    are leaked by nothing; an item without windows (below five words, or nearly all slots) is leaked by texts of its whole
    template. Repeated rows of either table give rows of their own, null ids stay null, empty tables give none, and other
    columns, of any name, are ignored.
    """
    bounded_batches(docs.sparkSession)
    items = _numbered(benchmark, item_col, item_text_col)
    leaks = leaking_texts(docs, items, least=least, text_col=text_col).join(items.select("item", "id"), "item")
    given = columns(docs, id_col, text_col).toDF("i", "t").select("i", *_keyed(docs, "t"))
    return given.join(leaks, ["a", "b"]).select(F.col("i").alias(id_col), F.col("id").alias(item_col), "coverage", "n_windows", "changed")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, *, least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` that leak no item; no column changes.

    Null and empty texts stay; equal texts stay or go together; with an empty benchmark all stay; columns may have any name.
    """
    bounded_batches(docs.sparkSession)
    leaks = leaking_texts(docs, _numbered(benchmark, "item_id", "text"), least=least)
    texts = cut(leaks.select("a", "b").distinct(), "leaking-texts")
    names = docs.columns
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])
    a, b = _keyed(plain, f"c{names.index('text')}")
    return plain.join(texts, (a == texts["a"]) & (b == texts["b"]), "left_anti").toDF(*names)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of ``documents`` with each item of ``benchmark`` that it leaks; edge cases as in :func:`find_leaks`."""
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))

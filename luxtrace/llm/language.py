"""Language identification (operator 3) by rank-order profiles.

A language's profile is the list of its most frequent letter n-grams in order of count. A document's own list is compared
to each profile: every n-gram adds the distance between its two ranks, or the most possible where the profile lacks it.
The language with the least sum wins.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from luxtrace.llm.common import bounded_batches, columns, keep_rows, map_rows, read_table

#: Ranks compared, longest n-grams, documents a language that profiles are made of at most, characters counted at a time.
RANKS = 300
GRAM = 3
SAMPLE_PER_LANGUAGE = 600
BLOCK = 1 << 20
UNKNOWN = "und"
#: The filter rejects documents that are this far from all profiles.
LEAST_SCORE = 0.15
_BLANK = 32


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point its lower-case form, or a blank if it is neither a letter nor a mark on one."""
    table = np.full(0x110000, _BLANK, np.int64)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha() or unicodedata.category(s)[0] == "M":
            low = s.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a whole text, each packed in 63 bits, ascending, and their counts; runs of other signs are one blank."""
    table = _letters()
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    tail = np.array([_BLANK], np.int64)
    first = True
    for a in range(0, len(text), BLOCK):
        signs = table[np.frombuffer(text[a : a + BLOCK].encode("utf-32-le", "surrogatepass"), "<u4")]
        if a + BLOCK >= len(text):
            signs = np.append(signs, _BLANK)
        signs = np.concatenate([tail, signs])
        solid = signs != _BLANK
        solid[0] = True
        solid[1:] |= signs[:-1] != _BLANK
        old = len(tail)
        signs = signs[solid]
        grams = [signs[(0 if first else old) :]]
        for n in range(2, GRAM + 1):
            packed = signs[: len(signs) - n + 1].copy()
            for k in range(1, n):
                packed <<= 21
                packed |= signs[k : len(signs) - n + 1 + k]
            grams.append(packed[max(0, old - n + 1) if not first else 0 :])
        packed = np.concatenate(grams)
        parts.append(np.unique(packed[packed != _BLANK], return_counts=True))
        tail, first = signs[-(GRAM - 1) :], False
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(parts) == 1:
        return parts[0]
    grams, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return grams, np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)


def ranked(grams: np.ndarray, counts: np.ndarray, most: int = RANKS) -> np.ndarray:
    """The most frequent n-grams in order of count; equal counts in ascending order of the n-gram."""
    if len(grams) > most:
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        keep = counts >= least
        grams, counts = grams[keep], counts[keep]
    return grams[np.argsort(-counts, kind="stable")[:most]]


class Profiles:
    """Rank-order profiles by language."""

    def __init__(self, by_language: dict[str, list[int]], most: int = RANKS):
        self.languages = sorted(by_language)
        self.most = most
        self.grams = np.array(sorted({g for v in by_language.values() for g in v}), np.int64)
        self.ranks = np.full((len(self.languages), len(self.grams) + 1), -1, np.int64)  # the last column: in no profile
        for k, language in enumerate(self.languages):
            own = np.array(by_language[language][:most], np.int64)
            self.ranks[k, np.searchsorted(self.grams, own)] = np.arange(len(own))

    def distances(self, text: str) -> np.ndarray | None:
        """Out-of-place distance to each language as a share of the most possible; None without a letter."""
        own = ranked(*gram_counts(text), self.most)
        if not len(own):
            return None
        if not self.languages:
            return np.ones(0)
        at = np.searchsorted(self.grams, own)
        at[at == len(self.grams)] = 0
        if len(self.grams):
            at = np.where(self.grams[at] == own, at, len(self.grams))
        ranks = self.ranks[:, at]
        out = np.where(ranks < 0, self.most, np.abs(ranks - np.arange(len(own))))
        return out.sum(axis=1) / (self.most * len(own))

    def predict(self, text: str | None) -> tuple[str, float]:
        found = self.distances(text) if text and any(map(str.isalpha, text)) else None  # a mark alone is no letter
        if found is None or not len(found):
            return UNKNOWN, 0.0
        best = int(np.argmin(found))
        return self.languages[best], float(1 - found[best])


def learn(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> Profiles:
    """Profiles from rows with text and language.

    Of each language at most ``per_language`` rows are used, those with the smallest hash of their id (a bounded sample;
    counts of rows and the choice itself look at all rows, without their texts). Rows without text or language are left
    out; an empty table gives no profiles.
    """
    bounded_batches(labelled.sparkSession)
    rows = columns(labelled, id_col, text_col, lang_col).toDF("k", "t", "lang").where(F.col("t").isNotNull() & F.col("lang").isNotNull())
    by_hash = F.xxhash64(F.col("k").cast("string"), F.lit("sample"))
    sizes = rows.groupBy("lang").count()
    share = F.greatest(F.lit(1.0), F.col("count") / (2.0 * per_language))  # one of so many; about twice as many as are used
    picked = (
        rows.select("k", "lang", "t", by_hash.alias("h")).join(F.broadcast(sizes), "lang")
        .where(F.pmod("h", F.lit(1 << 30)) < (1 << 30) / share)
        .withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "k")))
        .where(F.col("r") <= per_language)
    )

    def counted(it: Iterable[tuple]) -> Iterator[tuple]:
        for lang, text in it:
            for gram, n in zip(*gram_counts(text), strict=True):
                yield lang, int(gram), int(n)

    counts = map_rows(picked.select("lang", "t"), counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= RANKS)
    found: dict[str, list[int]] = {}
    for r in sorted(top.select("lang", "r", "gram").collect(), key=lambda r: (r["lang"], r["r"])):  # RANKS rows a language
        found.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(found)


def identify(docs: DataFrame, profiles: Profiles, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, lang_pred, score``: one row for each row of ``docs``; null texts and texts without a letter are ``und`` with score 0.

    Equal distances go to the language that comes first in the alphabet.
    """
    bounded_batches(docs.sparkSession)

    def rows(it: Iterable[tuple]) -> Iterator[tuple]:
        for key, text in it:
            yield (key, *profiles.predict(text))

    return map_rows(columns(docs, id_col, text_col), rows, f"`{id_col}` {dict(docs.dtypes)[id_col]}, lang_pred string, score double")


def held_out(key) -> F.Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def learned_on_documents(docs: DataFrame) -> Profiles:
    return learn(docs.where(~held_out("doc_id")))


def keep_identified(docs: DataFrame, profiles: Profiles, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` whose text is in some learned language; the others are rejected. No column changes.

    Null and empty texts, and those without a letter, go. Each row is judged alone, so repeated rows stay or go together;
    columns may have any name; an empty table stays empty.
    """
    bounded_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def known(row: tuple) -> bool:
        lang, score = profiles.predict(row[at])
        return lang != UNKNOWN and score >= least

    return keep_rows(docs, lambda: known)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of each row of ``documents``, by profiles of the rows that are not held out.

    Null texts and texts without a letter are ``und`` with score 0; repeated rows give equal rows; a null id is not held out.
    """
    docs = columns(read_table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    found = identify(docs, learned_on_documents(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")

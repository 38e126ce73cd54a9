"""Line deduplication (operator 10): documents probe shards of a minimal perfect hash instead of joining lines.

Hashes of lines that occur in several documents are dealt to shards; each shard holds a minimal perfect hash and, in the
order of its slots, arrays of fingerprints, counts and smallest documents. Each document's distinct line hashes go to their
shards, are looked up there in blocks, and what must be dropped goes back to the document. Lines themselves are never
shuffled. A shard with more probes than usual (a line of a third of all documents) is copied and its probes are dealt to
the copies by document.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from luxtrace.llm import mph
from luxtrace.llm.common import bounded_batches, columns, cut, map_rows, read_table

#: Shorter keys stay. A shard holds about so many hashes; small inputs have so many shards at least.
LEAST_CHARS = 10
SHARD_KEYS = 50_000
LEAST_SHARDS = 256

_BLANKS = " \t\n\x0b\x0c\r"
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
NULL_ID = -(1 << 63)


def line_key(line: str) -> str:
    """The line without ASCII white space at both ends, A-Z in lower case."""
    line = line.strip(_BLANKS)
    return line.lower() if line.isascii() else line.translate(_LOWER)


def _hash(key: str) -> tuple[int, int]:
    """128 bits as two signed integers."""
    d = xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass"))
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def line_hashes(docs: DataFrame, least_chars: int, id_col: str, text_col: str) -> DataFrame:
    """``h1, h2, d``: the distinct hashes of each document's keys that are long enough."""

    def rows(it: Iterable[tuple]) -> Iterator[tuple]:
        for d, text in it:
            d = NULL_ID if d is None else d
            keys = {k for line in (text or "").split("\n") if len(k := line_key(line)) >= least_chars}
            for key in keys:
                yield (*_hash(key), d)

    given = columns(docs, id_col, text_col).select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`"))
    return map_rows(given, rows, "h1 long, h2 long, d long")


_SHARD = pa.schema([("shard", pa.int64()), ("n", pa.int64()), ("displacements", pa.binary()), ("fingerprints", pa.binary()), ("counts", pa.binary()), ("first_docs", pa.binary())])


def _build_shard(key: tuple, table: pa.Table) -> pa.Table:
    h1, h2, n, first = (table[c].to_numpy() for c in ("h1", "h2", "n", "first"))
    displacements, slot = mph.build(h1, h2)
    arrays = [np.empty(len(h1), t) for t in ("<i8", "<i8", "<i8")]
    for out, values in zip(arrays, (h2, n, first), strict=True):
        out[slot] = values
    row = [key[0].as_py(), len(h1), displacements.astype("<i8").tobytes(), *(a.tobytes() for a in arrays)]
    return pa.table([pa.array([v], t.type) for v, t in zip(row, _SHARD, strict=True)], schema=_SHARD)


def build_index(hashes: DataFrame, n_shards: int) -> DataFrame:
    """One row of arrays for each shard that has hashes found in at least two documents."""
    index = hashes.groupBy("h1", "h2").agg(F.min("d").alias("first"), F.max("d").alias("last"), F.count(F.lit(1)).alias("n")).where("first < last").drop("last")
    sharded = index.withColumn("shard", F.pmod("h1", F.lit(n_shards)))
    return sharded.groupBy("shard").applyInArrow(_build_shard, "shard long, n long, displacements binary, fingerprints binary, counts binary, first_docs binary")


def _probe(key: tuple, probes: pa.Table, shard: pa.Table) -> pa.Table:
    """The probes whose line must go: it is in the shard, and first in a smaller document."""
    if not probes.num_rows or not shard.num_rows:
        return probes.select(["h1", "d"]).slice(0, 0)
    n, displacements, fingerprints, firsts = (shard[c][0].as_py() for c in ("n", "displacements", "fingerprints", "first_docs"))
    h1, h2, d = (probes[c].to_numpy() for c in ("h1", "h2", "d"))
    slot = mph.look_up(np.frombuffer(displacements, "<i8"), n, h1, h2)
    gone = (np.frombuffer(fingerprints, "<i8")[slot] == h2) & (np.frombuffer(firsts, "<i8")[slot] < d)
    return pa.table({"h1": h1[gone], "d": d[gone]})


def repeated_lines(docs: DataFrame, *, least_chars: int = LEAST_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``d, gone``: for each document that loses lines, the first halves of their hashes."""
    hashes = cut(line_hashes(docs, least_chars, id_col, text_col), "line-hashes")
    total = hashes.count()
    n_shards = max(LEAST_SHARDS, math.ceil(total / SHARD_KEYS))
    index = cut(build_index(hashes, n_shards), "line-index")
    probes = hashes.withColumn("shard", F.pmod("h1", F.lit(n_shards)))
    usual = max(1, 2 * total // n_shards)
    copies = cut(probes.groupBy("shard").count().select("shard", F.ceil(F.col("count") / usual).alias("copies")), "line-shards")
    dealt = probes.join(copies, "shard").select("shard", F.pmod(F.xxhash64("d"), "copies").alias("part"), "h1", "h2", "d")
    again = copies.toDF("of", "times")
    arrays = index.join(again, F.col("shard") == F.col("of")).select(
        F.col("shard").alias("of"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)).alias("part"), *index.columns[1:]
    )
    gone = dealt.groupBy("shard", "part").cogroup(arrays.groupBy("of", "part")).applyInArrow(_probe, "h1 long, d long")
    return gone.groupBy("d").agg(F.collect_list("h1").alias("gone"))  # a document's own lines


def drop_repeated_lines(docs: DataFrame, *, least_chars: int = LEAST_CHARS, id_col: str = "doc_id", text_col: str = "text", counted: bool = True) -> DataFrame:
    """``docs`` without repeated lines in ``text_col``; if ``counted`` with two more columns at the end, ``n_lines`` and ``n_dropped``.

    A line goes if its key has at least ``least_chars`` code points and a document of smaller id holds it too; null counts
    as an id below all others. Null and empty texts are one empty line and become empty; rows of equal id count as one
    document; other columns, of any name, are kept as they are; an empty table stays empty.
    """
    bounded_batches(docs.sparkSession)
    lost = repeated_lines(docs, least_chars=least_chars, id_col=id_col, text_col=text_col)
    names = docs.columns
    at = names.index(text_col)
    given = docs.toDF(*[f"c{k}" for k in range(len(names))])
    own = F.coalesce(F.col(f"c{names.index(id_col)}").cast("long"), F.lit(NULL_ID))
    joined = given.withColumn("d", own).join(lost.hint("shuffle_hash"), "d", "left").drop("d")

    def rows(it: Iterable[tuple]) -> Iterator[tuple]:
        for *row, gone in it:
            lines = (row[at] or "").split("\n")
            kept = lines
            if gone:
                out = set(gone)
                kept = [x for x in lines if len(k := line_key(x)) < least_chars or _hash(k)[0] not in out]
            row[at] = "\n".join(kept)
            yield (*row, len(lines), len(lines) - len(kept)) if counted else tuple(row)

    more = ["n_lines", "n_dropped"] if counted else []
    schema = ", ".join([f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(docs.schema)] + [f"{m} long" for m in more])
    return map_rows(joined, rows, schema).toDF(*names, *more)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, dropped lines and hash of the rest of each row of ``documents``; edge cases as in :func:`drop_repeated_lines`."""
    docs = columns(read_table(spark, sf_dir, "documents"), "doc_id", "text")
    out = drop_repeated_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP10_SQL = """
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key
  FROM lines
), repeated AS (
  SELECT line_key, min(doc_id) AS first_doc FROM keyed WHERE length(line_key) >= 10
  GROUP BY line_key HAVING count(DISTINCT doc_id) > 1
), marked AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(r.first_doc < k.doc_id, false) AS gone
  FROM keyed k LEFT JOIN repeated r ON k.line_key = r.line_key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

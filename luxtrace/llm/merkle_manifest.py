"""Merkle dataset manifest (operator 12): a tree for each source, a tree over their roots, and a proof for each document.

Leaves are hashed, ordered and numbered by DataFrame operations. The trees are built in Pregel-style supersteps over RDDs:
children message their parent, a parent that has all its children hashes them and messages on, and a tree's last node
messages the tree of sources. Then supersteps run downwards: each node hands its children the siblings on their way to the
root, and leaves fold theirs to verify. A message goes to the key (tree, parent), which at most FAN_OUT children share, so a
source with a third of all documents is spread like the others; the siblings of a whole family's ancestors travel once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from luxtrace.llm.common import columns, cut, read_table

FAN_OUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes of a level that one task takes at least.
NODES_A_TASK = 4000
#: ``monotonically_increasing_id`` has the partition above so many bits.
_ROW_BITS = 33
#: The tree of sources among the trees.
_TOP = -1
#: Kinds of messages.
_FAMILY, _WAY = 0, 1


def _hash(digests: bytes) -> bytes:
    """Hash of some digests, as hex text one after another."""
    return hashlib.sha256(digests.hex().encode()).digest()


def leaf_digest(*fields: Column) -> Column:
    """Hash of fields in order: ``-`` for null, else length in UTF-8 bytes, ``:`` and value."""
    spelled = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*spelled), 256)


def tampered(doc_id: Column) -> Column:
    """Whether 5 divides the CRC-32 of the id in decimal; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def placed(leaves: DataFrame) -> tuple[DataFrame, int, int, int]:
    """``leaves`` (``source, doc_id, leaf`` and more) with ``tree`` and ``place``, both from 0, and ``size``; then the numbers of trees and leaves and the largest size.

    Trees follow the sources (null first, bytewise), places follow doc_id (null first), then leaf. Rows are ranged and sorted
    once; a row's place is its number in its range and the sums of the ranges before, of which there is one row for each
    range and source.
    """
    order = ["source", "doc_id", "leaf"]
    at = cut(leaves.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "leaves")
    part = F.shiftright("at", _ROW_BITS)
    runs = cut(at.groupBy(part.alias("part"), "source").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")), "leaf-runs")
    sources = runs.groupBy("source").agg(F.min("part").alias("begins"), F.sum("n").alias("size"))
    begun = sources.groupBy("begins").agg(F.count(F.lit(1)).alias("m"))  # a row for each range at most
    before = Window.orderBy("begins").rowsBetween(Window.unboundedPreceding, -1)
    offsets = begun.select(F.col("begins").alias("b"), F.coalesce(F.sum("m").over(before), F.lit(0)).alias("trees_before"))
    within = F.row_number().over(Window.partitionBy("begins").orderBy("source")) - 1
    trees = cut(sources.join(offsets, F.col("begins") == F.col("b")).select(F.col("source").alias("of"), "size", (F.col("trees_before") + within).alias("tree")), "leaf-trees")
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = runs.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(trees, F.col("source").eqNullSafe(F.col("of")))
    own = based.select(F.col("part").alias("p"), F.col("source").alias("s"), "first", "base", "tree", "size")
    out = at.join(own, (part == F.col("p")) & F.col("source").eqNullSafe(F.col("s"))).withColumn("place", F.col("base") + F.col("at") - F.col("first"))
    n, total, most = trees.agg(F.count(F.lit(1)), F.sum("size"), F.max("size")).first()
    return out.drop("at", "p", "s", "first", "base"), n, total or 0, most or 0


def _parts(spark: SparkSession, nodes: int) -> int:
    return max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-nodes // NODES_A_TASK)))


def _families(nodes: RDD, parts: int) -> RDD:
    """One superstep upwards: ``((tree, place), (size of its level, digest, ...))`` to ``((tree, parent), (size, children in order))``."""

    def message(node: tuple) -> tuple:
        (tree, place), value = node
        return (tree, place // FAN_OUT), (place % FAN_OUT, *value)

    def complete(item: tuple) -> tuple:
        (tree, place), got = item
        children = sorted(got, key=lambda c: c[0])
        size = children[0][1]
        if [c[0] for c in children] != list(range(min(FAN_OUT, size - FAN_OUT * place))):
            raise ValueError("a parent lacks children")
        return size, [c[2:] for c in children]

    grouped = nodes.map(message).groupByKey(parts)  # FAN_OUT messages at most
    return grouped.mapPartitions(lambda it: ((k, complete((k, v))) for k, v in it), preservesPartitioning=True)


def _hashed(families: RDD) -> RDD:
    """What parents hash and forward; a tree of one node has no parent."""
    parents = families.filter(lambda x: x[1][0] > 1)
    return parents.mapValues(lambda f: (-(-f[0] // FAN_OUT), _hash(b"".join(c[0] for c in f[1]))))


def _levels(n: int) -> int:
    """Supersteps from ``n`` nodes to one."""
    k = 0
    while n > 1:
        n, k = -(-n // FAN_OUT), k + 1
    return k


def _grown(spark: SparkSession, nodes: RDD, total: int, most: int, trees: int) -> tuple[list[RDD], RDD]:
    """All supersteps upwards: the families of each level, and ``tree, (level, digest)`` of the trees' last nodes."""
    families, last = [], []
    for level in range(max(1, _levels(most))):
        total = -(-total // FAN_OUT) + trees
        families.append(_families(nodes, _parts(spark, total)))
        if not level:  # a tree of one leaf has that leaf as its end
            last.append(families[0].filter(lambda x: x[1][0] == 1).map(lambda x: (x[0][0], (0, x[1][1][0][0]))))
        nodes = _hashed(families[-1])
        last.append(nodes.filter(lambda x: x[1][0] == 1).map(lambda x, k=level + 1: (x[0][0], (k, x[1][1]))))
        nodes = nodes.filter(lambda x: x[1][0] > 1)
    return families, spark.sparkContext.union(last)


def _told(level: int) -> Callable[[tuple], Iterator[tuple]]:
    """One superstep downwards: a node that has been told its way tells each child the child's; a message to a lower level waits."""

    def run(item: tuple) -> Iterator[tuple]:
        (tree, place), got = item
        got = list(got)
        family = next((v for kind, v in got if kind == _FAMILY), None)
        for kind, v in got:
            if kind == _FAMILY:
                continue
            at, way, ends = v
            if family and at == level + (family[0] > 1):
                alone = family[0] == 1
                digests = [c[0] for c in family[1]]
                for k, value in enumerate(family[1]):
                    own = way if alone else ((b"".join(digests[:k]), b"".join(digests[k + 1 :])), *way)
                    yield (tree, place * FAN_OUT + k), (_WAY, (level, own, ends)) if level else (value, own, ends)
            elif at <= level:
                yield (tree, place), (_WAY, v)

    return run


def _ways(families: list[RDD], begins: RDD) -> RDD:
    """All supersteps downwards: ``key, (leaf's value, way, ends)``. ``begins``: ``(tree, 0), (_WAY, (level, way, ends))`` of the trees' last nodes."""
    inbox = begins
    for level in range(len(families) - 1, -1, -1):
        parts = families[level].getNumPartitions()
        met = families[level].mapValues(lambda f: (_FAMILY, f)).union(inbox.partitionBy(parts)).groupByKey(parts)  # a family and its message
        inbox = met.flatMap(_told(level))
    return inbox


def proofs(docs: DataFrame, *, changed: Column | None = None) -> RDD:
    """``doc_id, leaf, leaf now, way, subroot, root`` of each row, digests as bytes.

    ``way`` has, from the leaf up, the siblings before and after the node in its run. ``changed`` is the text found at
    verification where it isn't the one of the manifest (null: not changed). Rows of equal id and equal fields are leaves of
    their own, as are rows with nulls; null is a source; an empty table gives no row; other columns, of any name, are ignored.
    """
    spark = docs.sparkSession
    now = F.when(changed.isNotNull(), leaf_digest(*[changed if c == "text" else F.col(c) for c in FIELDS])) if changed is not None else F.lit(None).cast("string")
    leaves = docs.select("source", F.col("doc_id").cast("long").alias("doc_id"), leaf_digest(*[F.col(c) for c in FIELDS]).alias("leaf"), now.alias("now"))
    ordered, n_trees, total, most = placed(leaves)
    packed = ordered.select("tree", "place", "size", F.unhex("leaf"), "doc_id", F.unhex("now"))
    nodes = packed.rdd.map(lambda r: ((r[0], r[1]), (r[2], bytes(r[3]), r[4], r[5] and bytes(r[5]))))
    families, last = _grown(spark, nodes, total, most, n_trees)
    above, root = _grown(spark, last.map(lambda x: ((_TOP, x[0]), (n_trees, x[1][1], x[1][0]))), n_trees, n_trees, 1)
    ways = _ways(above, root.map(lambda x: ((_TOP, 0), (_WAY, (x[1][0], (), (x[1][1],))))))
    begins = ways.map(lambda x: ((x[0][1], 0), (_WAY, (x[1][0][1], x[1][1], (x[1][0][0], *x[1][2])))))  # with the subroot and the root
    return _ways(families, begins).map(lambda x: (x[1][0][1], x[1][0][0], x[1][0][2], x[1][1], *x[1][2]))


def _fold(leaf: bytes, way: tuple) -> bytes:
    for before, after in way:
        leaf = _hash(before + leaf + after)
    return leaf


def manifest(docs: DataFrame) -> DataFrame:
    """``source, n_docs, subroot, root``: the manifest itself, a row for each source; edge cases as in :func:`proofs`."""
    sources = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.min(F.struct(F.col("doc_id").cast("long").alias("doc_id"), leaf_digest(*[F.col(c) for c in FIELDS]).alias("leaf"))).alias("first"))
    ends = docs.sparkSession.createDataFrame(proofs(docs).map(lambda p: (p[0], p[1].hex(), p[4].hex(), p[5].hex())), "doc_id long, leaf string, subroot string, root string", verifySchema=False).distinct()
    on = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.leaf") == F.col("leaf"))
    return sources.join(ends, on).select("source", "n_docs", "subroot", "root")


def inclusion_proofs(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, way, subroot, root``, hex text: what someone with the document needs to verify it; as :func:`proofs`."""
    spell = lambda p: (p[0], p[1].hex(), [(b.hex(), a.hex()) for b, a in p[3]], p[4].hex(), p[5].hex())
    return docs.sparkSession.createDataFrame(proofs(docs).map(spell), "doc_id long, leaf string, way array<struct<before:string,after:string>>, subroot string, root string", verifySchema=False)


def verified(docs: DataFrame, changed: Column) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``: each row's proof folded from what its text is now."""

    def row(p: tuple) -> tuple:
        key, leaf, now, way, subroot, root = p
        folded = _fold(now or leaf, way)
        proof = hashlib.sha256("".join(b.hex() + a.hex() for b, a in way).encode()).hexdigest()
        return key, leaf.hex(), subroot.hex(), root.hex(), proof, folded.hex(), folded == root

    return docs.sparkSession.createDataFrame(proofs(docs, changed=changed).map(row), "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean", verifySchema=False)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots, proof and its folding of each row of ``documents``, some texts lower-cased; edge cases as in :func:`proofs`."""
    docs = columns(read_table(spark, sf_dir, "documents"), *FIELDS)
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return verified(docs, F.when(tampered(F.col("doc_id")), lower))


def _manifest_sql(levels: int = 8) -> str:
    """DuckDB SQL of the same rows, with the levels of each tree written out; whole below FAN_OUT ** levels leaves a source."""
    spell = lambda text: " || ".join(f"coalesce(strlen({c})::varchar || ':' || {c}, '-')" for c in ("doc_id::varchar", "source", "lang", "n_chars::varchar", text))
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    step = "list_reduce(list_prepend(xor({0}, {1}), range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    crc = f"xor(list_reduce(list_prepend(4294967295::bigint, [ord(d)::bigint FOR d IN string_split(doc_id::varchar, '')]), lambda a, b: {step.format('a', 'b')}), 4294967295)"
    parts = [
        f"leaves AS (SELECT row_number() OVER () AS r, doc_id, source, sha256({spell('text')}) AS leaf, CASE WHEN coalesce(({crc}) % 5 = 0, false) THEN sha256({spell(lower)}) END AS now FROM documents)",
        "places AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM leaves)",
    ]

    def grown(name: str, first: str) -> None:
        parts.append(f"{name}0 AS ({first})")
        for k in range(levels):
            parts.append(f"{name}f{k} AS (SELECT t, i // {FAN_OUT} AS i, list(h ORDER BY i) AS run FROM {name}{k} GROUP BY ALL)")
            parts.append(f"{name}{k + 1} AS (SELECT t, i, CASE WHEN count(*) OVER (PARTITION BY t) = 1 AND len(run) = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS h FROM {name}f{k})")

    def folded(name: str, before: str, tree: str, place: str) -> str:
        """Each row of ``before`` (``r, h, proof``) folded through all levels of its tree."""
        for k in range(levels):
            at, one = f"(q.{place} // {FAN_OUT**k} % {FAN_OUT} + 1)", f"(len(f.run) = 1 AND NOT EXISTS (SELECT 1 FROM {name}f{k} o WHERE o.t = f.t AND o.i > 0))"
            others = f"[x FOR x, k IN f.run IF k <> {at}]"
            new = f"[CASE WHEN k = {at} THEN b.h ELSE x END FOR x, k IN f.run]"
            parts.append(f"{name}w{k} AS (SELECT b.r, CASE WHEN {one} THEN b.h ELSE sha256(array_to_string({new}, '')) END AS h, b.proof || array_to_string({others}, '') AS proof FROM {before} b JOIN places q ON q.r = b.r JOIN {name}f{k} f ON f.t = {tree} AND f.i = q.{place} // {FAN_OUT ** (k + 1)})")
            before = f"{name}w{k}"
        return before

    grown("s", "SELECT tree AS t, place AS i, leaf AS h FROM places")
    grown("u", f"SELECT 0 AS t, t AS i, h FROM s{levels}")
    parts.append("now0 AS (SELECT r, coalesce(now, leaf) AS h, '' AS proof FROM places)")
    end = folded("u", folded("s", "now0", "q.tree", "place"), "0", "tree")
    return f"WITH {', '.join(parts)} SELECT p.doc_id, p.leaf, s.h AS subroot, u.h AS root, sha256(e.proof) AS proof_sha256, e.h AS folded_root, e.h = u.h AS verified FROM places p JOIN s{levels} s ON s.t = p.tree CROSS JOIN u{levels} u JOIN {end} e ON e.r = p.r"


OP12_SQL = _manifest_sql()

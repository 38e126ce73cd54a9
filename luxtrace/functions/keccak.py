"""Keccak-256 over many messages at once, and sets of leaves committed to by it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from luxtrace.schema import RECORD_TAG
from luxtrace.shared import cut

_RATE = 136  # bytes taken in between permutations


def _round_constants() -> list[int]:
    """From the shift register that the standard defines."""
    out, state = [], 1
    for _ in range(24):
        value = 0
        for j in range(7):
            if state & 1:
                value |= 1 << ((1 << j) - 1)
            state = (state << 1) ^ (0x171 if state & 0x80 else 0)
        out.append(value)
    return out


def _rotations() -> list[list[int]]:
    """Offsets by column and row: triangular numbers along the path (x, y) -> (y, 2x + 3y)."""
    out = [[0] * 5 for _ in range(5)]
    x, y = 1, 0
    for t in range(24):
        out[x][y] = (t + 1) * (t + 2) // 2 % 64
        x, y = y, (2 * x + 3 * y) % 5
    return out


_CONSTANTS, _OFFSETS = _round_constants(), _rotations()


def _turned(a: np.ndarray, n: int) -> np.ndarray:
    return a if not n else a << np.uint64(n) | a >> np.uint64(64 - n)


def _permute(s: list[list[np.ndarray]]) -> list[list[np.ndarray]]:
    for constant in _CONSTANTS:
        column = [s[x][0] ^ s[x][1] ^ s[x][2] ^ s[x][3] ^ s[x][4] for x in range(5)]
        mixed = [column[(x - 1) % 5] ^ _turned(column[(x + 1) % 5], 1) for x in range(5)]
        moved: list[list[np.ndarray]] = [[None] * 5 for _ in range(5)]  # type: ignore[list-item]
        for x in range(5):
            for y in range(5):
                moved[y][(2 * x + 3 * y) % 5] = _turned(s[x][y] ^ mixed[x], _OFFSETS[x][y])
        s = [[moved[x][y] ^ (~moved[(x + 1) % 5][y] & moved[(x + 2) % 5][y]) for y in range(5)] for x in range(5)]
        s[0][0] = s[0][0] ^ np.uint64(constant)
    return s


def keccak_many(messages: list[bytes]) -> list[bytes]:
    """The digest of each message; messages with equally many blocks are permuted together."""
    out: list[bytes] = [b""] * len(messages)
    by_blocks: dict[int, list[int]] = {}
    for i, m in enumerate(messages):
        by_blocks.setdefault(len(m) // _RATE + 1, []).append(i)
    for blocks, where in by_blocks.items():
        data = np.zeros((len(where), blocks * _RATE), np.uint8)
        for row, i in enumerate(where):
            m = messages[i]
            data[row, : len(m)] = np.frombuffer(m, np.uint8)
            data[row, len(m)] ^= 0x01
            data[row, -1] ^= 0x80
        words = data.view("<u8").reshape(len(where), blocks, _RATE // 8)
        s = [[np.zeros(len(where), np.uint64) for _ in range(5)] for _ in range(5)]
        for b in range(blocks):
            for k in range(_RATE // 8):
                s[k % 5][k // 5] = s[k % 5][k // 5] ^ words[:, b, k]
            s = _permute(s)
        digest = np.stack([s[k][0] for k in range(4)], axis=1).astype("<u8").tobytes()
        for row, i in enumerate(where):
            out[i] = digest[32 * row : 32 * row + 32]
    return out


def keccak(message: bytes) -> bytes:
    return keccak_many([message])[0]


@F.pandas_udf(BinaryType())
def keccak256(values: pd.Series) -> pd.Series:
    known = values.notna()
    out = pd.Series([None] * len(values), dtype=object)
    out[known.to_numpy()] = keccak_many([bytes(v) for v in values[known]])
    return out


def body_id(commitment: F.Column) -> F.Column:
    """Id of a camera body from its fingerprint's commitment (bytes)."""
    return keccak256(F.concat(F.unhex(F.lit((RECORD_TAG + b"body").hex())), commitment))


# --- Merkle trees: leaves in byte order, each pair in byte order, an odd node goes up unchanged


def _parents(nodes: list[bytes]) -> list[bytes]:
    pairs = [min(a, b) + max(a, b) for a, b in zip(nodes[::2], nodes[1::2], strict=False)]
    return keccak_many(pairs) + ([nodes[-1]] if len(nodes) % 2 else [])


def merkle_levels(leaves: list[bytes]) -> list[list[bytes]]:
    """All levels, the sorted leaves first."""
    if not leaves:
        raise ValueError("a session needs at least one frame")
    return _climb(sorted(leaves))


def inclusion_proof(levels: list[list[bytes]], leaf: bytes) -> list[bytes]:
    """The neighbours on the way up from the first place of ``leaf``."""
    return _path(levels, levels[0].index(leaf))


def verify_proof(leaf: bytes, proof: list[bytes], root: bytes) -> bool:
    for other in proof:
        leaf = keccak(min(leaf, other) + max(leaf, other))
    return leaf == root


#: Leaves that one task hashes to a subtree.
CHUNK = 1 << 14


def _ranked(frames: DataFrame, session: str, leaf: str) -> DataFrame:
    """``s, l, c, first``: each leaf with the number of its run of CHUNK ranks, and whether it is the first of its value.

    Leaves get their rank within the session by their first two bytes, then within those, so that a large session is shared out.
    """
    from pyspark.sql import Window

    ordered = frames.where(F.col(leaf).isNotNull()).select(F.col(session).alias("s"), F.col(leaf).alias("l"))
    ordered = ordered.withColumn("b", F.conv(F.rpad(F.hex(F.substring("l", 1, 2)), 4, "0"), 16, 10).cast("int"))
    before = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # at most 65,536 rows a session
    sizes = ordered.groupBy("s", "b").agg(F.count(F.lit(1)).alias("n")).select(F.col("s").alias("__s"), F.col("b").alias("__b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("s", "b").orderBy("l")
    placed = ordered.withColumn("w", F.row_number().over(within) - 1).withColumn("first", ~F.lag("l").over(within).eqNullSafe(F.col("l")))
    ranked = placed.join(sizes, F.col("s").eqNullSafe(F.col("__s")) & (F.col("b") == F.col("__b")))
    return ranked.select("s", "l", F.floor((F.col("base") + F.col("w")) / CHUNK).alias("c"), "first")


def _climb(nodes: list[bytes]) -> list[list[bytes]]:
    """All levels from these nodes to one, in the order given."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append(_parents(levels[-1]))
    return levels


def _path(levels: list[list[bytes]], at: int) -> list[bytes]:
    """The neighbours on the way up from a place; an odd node has none."""
    return [level[at >> k ^ 1] for k, level in enumerate(levels) if at >> k ^ 1 < len(level)]


def merkle_roots(frames: DataFrame, session: str = "session_id", leaf: str = "leaf") -> DataFrame:
    """``session, merkle_root, frame_count``, of whatever many frames a session has.

    Runs of ``CHUNK`` ranks, a power of two, become subtrees in parallel, and the level above them is small. Equal to one tree
    over all leaves, since a run below it is a whole subtree, and the last, shorter run goes up as an odd node does.
    """

    def subtree(pdf: pd.DataFrame) -> pd.DataFrame:
        root = _climb(sorted(map(bytes, pdf["l"])))[-1][0]
        return pd.DataFrame({"s": [pdf["s"].iloc[0]], "c": [pdf["c"].iloc[0]], "node": [root], "n": [len(pdf)]})

    kind = dict(frames.dtypes)[session]
    subtrees = _ranked(frames, session, leaf).groupBy("s", "c").applyInPandas(subtree, f"s {kind}, c long, node binary, n long")

    def top(pdf: pd.DataFrame) -> pd.DataFrame:
        root = _climb([bytes(x) for x in pdf.sort_values("c")["node"]])[-1][0]
        return pd.DataFrame({session: [pdf["s"].iloc[0]], "merkle_root": [root], "frame_count": [int(pdf["n"].sum())]})

    return subtrees.groupBy("s").applyInPandas(top, f"`{session}` {kind}, merkle_root binary, frame_count long")


def inclusion_proofs(frames: DataFrame, session: str = "session_id", leaf: str = "leaf") -> DataFrame:
    """``session, leaf, proof, root`` of each different leaf of a session, from its first place in the tree.

    Each run of ``CHUNK`` ranks gives its leaves the neighbours within its subtree; the small tree over the runs gives each
    run the rest of the way; both are joined by run. So no task has more of a session than one run, or a node for each run.
    """
    kind = dict(frames.dtypes)[session]

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(l=[bytes(x) for x in pdf["l"]]).sort_values(["l", "first"], ascending=[True, False])
        levels = _climb(pdf["l"].tolist())
        places = [i for i, first in enumerate(pdf["first"]) if first]
        out = pd.DataFrame({"l": [levels[0][i] for i in places] + [None], "path": [*(_path(levels, i) for i in places), None], "node": [None] * len(places) + [levels[-1][0]]})
        return out.assign(s=pdf["s"].iloc[0], c=pdf["c"].iloc[0])[["s", "c", "l", "path", "node"]]

    def above(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("c")
        levels = _climb([bytes(x) for x in pdf["node"]])
        return pd.DataFrame({"s2": pdf["s"], "c2": pdf["c"], "rest": [_path(levels, i) for i in range(len(pdf))], "root": [levels[-1][0]] * len(pdf)})

    parts = cut(_ranked(frames, session, leaf).groupBy("s", "c").applyInPandas(within, f"s {kind}, c long, l binary, path array<binary>, node binary"))
    tops = parts.where("l IS NULL").groupBy("s").applyInPandas(above, f"s2 {kind}, c2 long, rest array<binary>, root binary")
    joined = parts.where("l IS NOT NULL").join(tops, F.col("s").eqNullSafe(F.col("s2")) & (F.col("c") == F.col("c2")))
    return joined.select(F.col("s").alias(session), F.col("l").alias(leaf), F.concat("path", "rest").alias("proof"), "root")


def _folded(leaves: list[bytes], proofs: list[list[bytes]]) -> list[bytes]:
    """Each leaf with its proof folded in, all of them step by step, so that a step is one permutation of many."""
    now = list(leaves)
    for k in range(max(map(len, proofs), default=0)):
        still = [i for i, p in enumerate(proofs) if len(p) > k]
        for i, digest in zip(still, keccak_many([min(now[i], proofs[i][k]) + max(now[i], proofs[i][k]) for i in still]), strict=True):
            now[i] = digest
    return now


def verify_inclusion(proofs: DataFrame) -> DataFrame:
    """``proofs`` (``leaf binary, proof array<binary>, root binary``) with ``included``; a zero or null root includes nothing."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            included = [False] * len(b)
            asked = [(i, bytes(x), [bytes(q) for q in p], bytes(r)) for i, (x, p, r) in enumerate(zip(b["leaf"], b["proof"], b["root"], strict=True)) if r is not None and any(bytes(r)) and x is not None and p is not None]
            for (i, *_, root), end in zip(asked, _folded([a[1] for a in asked], [a[2] for a in asked]), strict=True):
                included[i] = end == root
            yield b.assign(included=included)

    return proofs.mapInPandas(check, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in proofs.schema) + ", included boolean")

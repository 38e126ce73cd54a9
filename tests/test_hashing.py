import hashlib
import hmac

import numpy as np
import pytest
from pyspark.sql import functions as F

from luxtrace.functions import hashing, labels, words
from luxtrace.functions.keccak import inclusion_proof, keccak, keccak_many, merkle_levels, merkle_roots, verify_inclusion, verify_proof
from luxtrace.schema import BODY_TAG, PIXEL_TAG


def test_keccak_known_values():
    assert keccak(b"").hex() == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    assert keccak(b"abc").hex() == "4e03657aea45a94fc7d47ba826c8d667c0d1e6e33a64a036ec44f58fa12d6c45"
    sizes = [0, 1, 135, 136, 137, 271, 272, 1000]
    assert keccak_many([b"x" * n for n in sizes]) == [keccak(b"x" * n) for n in sizes]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 17])
def test_merkle_proofs(n):
    leaves = [bytes([i]) * 32 for i in range(n)]
    levels = merkle_levels(leaves[::-1])
    root = levels[-1][0]
    assert merkle_levels(leaves)[-1][0] == root
    assert all(verify_proof(x, inclusion_proof(levels, x), root) for x in leaves)
    assert not verify_proof(b"\xff" * 32, inclusion_proof(levels, leaves[0]), root)
    with pytest.raises(ValueError):
        merkle_levels([])


def test_proofs_in_chunks(spark, monkeypatch):
    """Put together from runs of four leaves, equal to those of one tree; leaves repeat within runs and across them."""
    from luxtrace.functions import keccak as module

    monkeypatch.setattr(module, "CHUNK", 4)
    own = lambda s, n: [hashlib.sha256(f"{s}{i}".encode()).digest() for i in range(n)]
    leaves = {s: own(s, n) for s, n in ((None, 3), ("a", 1), ("b", 4), ("c", 11), ("d", 8), ("e", 33))}
    leaves["f"] = own("f", 5) + own("f", 2) * 9
    rows = [(s, x) for s, of in leaves.items() for x in of]
    got = module.inclusion_proofs(spark.createDataFrame(rows, "session_id string, leaf binary").repartition(3)).collect()
    assert len(got) == len(set(rows))
    for r in got:
        levels = merkle_levels(leaves[r["session_id"]])
        assert (r["root"], r["proof"]) == (levels[-1][0], inclusion_proof(levels, bytes(r["leaf"])))


def test_merkle_roots_in_chunks(spark, monkeypatch):
    from luxtrace.functions import keccak as module

    monkeypatch.setattr(module, "CHUNK", 4)
    rows = [(s, hashlib.sha256(f"{s}{i}".encode()).digest()) for s, n in (("a", 1), ("b", 4), ("c", 11), ("d", 8), ("e", 9)) for i in range(n)]
    got = {r["session_id"]: bytes(r["merkle_root"]) for r in merkle_roots(spark.createDataFrame(rows, "session_id string, leaf binary")).collect()}
    assert got == {s: merkle_levels([x for t, x in rows if t == s])[-1][0] for s in "abcde"}


def test_inclusion_rows(spark):
    leaves = [bytes([i]) * 32 for i in range(5)]
    levels = merkle_levels(leaves)
    rows = [(leaves[2], inclusion_proof(levels, leaves[2]), levels[-1][0]), (leaves[2], [], levels[-1][0]), (leaves[0], [], bytes(32)), (leaves[0], [], None)]
    got = verify_inclusion(spark.createDataFrame(rows, "leaf binary, proof array<binary>, root binary")).collect()
    assert sorted(r["included"] for r in got) == [False, False, False, True]


def test_native_digests(spark):
    key = b"k" * 70
    row = spark.range(1).select(
        F.lower(F.hex(hashing.body_commitment(key, F.lit("m"), F.lit(None).cast("string"), F.lit("é"), F.lit("o"), F.lit("0x0102")))).alias("b"), hashing.pixel_hash(F.lit(2), F.lit(1), F.lit(bytes(range(6)))).alias("p"),
        words.low_64(F.lit("0x" + "0" * 48 + "ffffffffffffffff")).alias("w"), words.low_64(F.lit("0x")).alias("n"), words.null_if_zero(F.lit("0x" + "0" * 64)).alias("z"), words.hmac_key(F.lit("0x0a0B")).alias("k1"), words.hmac_key(F.lit("plain")).alias("k2"),
        hashing.clamp_score(F.lit(99.5)).alias("s1"), hashing.clamp_score(F.lit(-3.0)).alias("s2"), labels.progress_share(F.lit("x — 3 of 4 (y)")).alias("g"), words.event_id(F.lit("0xab"), F.lit(258)).alias("id"),
    ).first()
    part = lambda b: len(b).to_bytes(4, "big") + b
    message = BODY_TAG + b"".join(map(part, (b"m", b"", "é".encode(), b"o", b"\x01\x02")))
    assert row["b"] == hmac.new(key, message, hashlib.sha256).hexdigest()
    assert row["p"] == "0x" + hashlib.sha256(PIXEL_TAG + b"".join(d.to_bytes(4, "big") for d in (2, 1, 3)) + bytes(range(6))).hexdigest()
    assert (row["w"], row["n"], row["z"], bytes(row["k1"]), bytes(row["k2"])) == (-1, None, None, b"\x0a\x0b", b"plain")
    assert (row["s1"], row["s2"], row["g"], row["id"]) == (100, 0, 0.75, "0xab02010000")
    assert words.builder_suffix("ab") == "6162" + "02" + "00" + "8021" * 8


def test_phash_bits(spark):
    values = np.random.default_rng(1).normal(size=(5, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(values)], "i int, block array<double>")
    for r in df.select("i", hashing.phash("block").alias("h")).collect():
        v = values[r["i"]]
        want = int("".join("1" if x > np.median(v[1:]) else "0" for x in v), 2)
        assert r["h"] & (1 << 64) - 1 == want


def test_no_output_claims_too_much(spark):
    df = spark.createDataFrame([("0xaa", 1, 120, 1_700_000_000, "0xbb", True, "0xcc", ["0xdd"])], "image_hash string, level int, pce long, at long, owner string, revoked boolean, parent string, children array<string>")
    text = df.select(labels.describe_image("image_hash", "level", "pce", "at", "owner", "revoked"), labels.describe_lineage("image_hash", "parent", "children"), labels.describe_body("image_hash", "owner", "pce", "revoked")).first()
    for t in text:
        assert t and not any(w in t.lower() for w in labels.FORBIDDEN)

"""Signatures over records: ECDSA on secp256k1 with a deterministic nonce, and the signer's address back from one."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from luxtrace.functions.keccak import keccak

# The curve's field, order and base point.
P = 2**256 - 2**32 - 977
N = 0xFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFEBAAEDCE6AF48A03BBFD25E8CD0364141
G = (0x79BE667EF9DCBBAC55A06295CE870B07029BFCDB2DCE28D959F2815B16F81798, 0x483ADA7726A3C4655DA4FBFC0E1108A8FD17B448A68554199C47D08FFB10D4B8)

Point = tuple[int, int] | None


def _add(a: Point, b: Point) -> Point:
    if a is None or b is None:
        return a or b
    if a[0] == b[0]:
        if (a[1] + b[1]) % P == 0:
            return None
        slope = 3 * a[0] * a[0] * pow(2 * a[1], -1, P) % P
    else:
        slope = (b[1] - a[1]) * pow(b[0] - a[0], -1, P) % P
    x = (slope * slope - a[0] - b[0]) % P
    return x, (slope * (a[0] - x) - a[1]) % P


def _times(k: int, point: Point) -> Point:
    out = None
    while k:
        if k & 1:
            out = _add(out, point)
        point, k = _add(point, point), k >> 1
    return out


def _nonces(key: int, digest: bytes) -> Iterator[int]:
    """Candidates in the order of RFC 6979."""
    v, k = b"\1" * 32, b"\0" * 32
    seed = key.to_bytes(32, "big") + (int.from_bytes(digest, "big") % N).to_bytes(32, "big")
    for sep in (b"\0", b"\1"):
        k = hmac.digest(k, v + sep + seed, hashlib.sha256)
        v = hmac.digest(k, v, hashlib.sha256)
    while True:
        v = hmac.digest(k, v, hashlib.sha256)
        yield int.from_bytes(v, "big")
        k = hmac.digest(k, v + b"\0", hashlib.sha256)
        v = hmac.digest(k, v, hashlib.sha256)


def sign(message: bytes, private_key: bytes) -> bytes:
    """65 bytes: r, s (the lower of the two) and the recovery bit."""
    key, digest = int.from_bytes(private_key, "big"), keccak(message)
    if not 0 < key < N:
        raise ValueError("the key is out of range")
    z = int.from_bytes(digest, "big")
    for k in _nonces(key, digest):
        if 0 < k < N:
            x, y = _times(k, G)  # type: ignore[misc]
            r = x % N
            s = pow(k, -1, N) * (z + r * key) % N
            if r and s:
                bit = y & 1
                if s > N // 2:
                    s, bit = N - s, bit ^ 1
                return r.to_bytes(32, "big") + s.to_bytes(32, "big") + bytes([bit])
    raise AssertionError("unreachable")


def address(public: Point) -> str:
    """Address with a check sum in its capitals."""
    raw = keccak(public[0].to_bytes(32, "big") + public[1].to_bytes(32, "big"))[-20:].hex()  # type: ignore[index]
    marks = keccak(raw.encode()).hex()
    return "0x" + "".join(c.upper() if int(m, 16) > 7 else c for c, m in zip(raw, marks, strict=False))


def address_of(private_key: bytes) -> str:
    return address(_times(int.from_bytes(private_key, "big"), G))


def recover(message: bytes, signature: bytes) -> str:
    """The address that signed; ValueError if no key could have."""
    if len(signature) != 65:
        raise ValueError("a signature has 65 bytes")
    r, s, bit = int.from_bytes(signature[:32], "big"), int.from_bytes(signature[32:64], "big"), signature[64] % 27
    if not (0 < r < N and 0 < s < N and bit < 2):
        raise ValueError("the signature is out of range")
    square = (pow(r, 3, P) + 7) % P
    y = pow(square, (P + 1) // 4, P)
    if y * y % P != square:
        raise ValueError("not a point of the curve")
    z = int.from_bytes(keccak(message), "big")
    inverse = pow(r, -1, N)
    public = _add(_times(-z * inverse % N, G), _times(s * inverse % N, (r, y if y & 1 == bit else P - y)))
    if public is None:
        raise ValueError("no key")
    return address(public)


def with_signer(df: DataFrame, message: str = "message", signature: str = "signature") -> DataFrame:
    """``df`` with ``signer``; null where the signature is missing or could not have been made."""

    def one(m, s):
        try:
            return recover(bytes(m), bytes(s)) if m is not None and s is not None else None
        except ValueError:
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(signer=[one(m, s) for m, s in zip(b[message], b[signature], strict=True)])

    return df.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", signer string")

"""Content hashes, keyed commitments and record encoding as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from luxtrace.functions.words import _c, big_endian, tag
from luxtrace.schema import BODY_TAG, PIXEL_TAG, RECORD_TAG, SESSION_TAG

_INNER, _OUTER = 0x36, 0x5C


def sha256(value: Column) -> Column:
    """Digest as bytes."""
    return F.unhex(F.sha2(value, 256))


def pixel_hash(h: Column | str, w: Column | str, pixels: Column | str) -> Column:
    """Hash of an 8-bit RGB raster: tag, the three dimensions as 32-bit numbers, then the rows; hex with 0x."""
    return F.concat(F.lit("0x"), F.sha2(F.concat(tag(PIXEL_TAG), big_endian(h, 4), big_endian(w, 4), big_endian(F.lit(3), 4), _c(pixels)), 256))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC with a key known to the driver: two nested digests with the padded key in front."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (tag(bytes(b ^ pad for b in block)) for pad in (_INNER, _OUTER))
    return sha256(F.concat(outer, sha256(F.concat(inner, message))))


def _field(value: Column, *, binary: bool = False) -> Column:
    raw = F.coalesce(value if binary else F.encode(value.cast("string"), "UTF-8"), F.lit(b""))
    return F.concat(big_endian(F.length(raw), 4), raw)


def body_commitment(key: bytes, make: Column, model: Column, serial: Column, owner: Column, evidence_hex: Column) -> Column:
    """Keyed commitment to a camera: each field with its length; nulls are empty; evidence is hex, with or without 0x."""
    evidence = F.unhex(F.regexp_replace(evidence_hex, "^0x", ""))
    return hmac_sha256(key, F.concat(tag(BODY_TAG), *map(_field, (make, model, serial, owner)), _field(evidence, binary=True)))


def metadata_hmac(key: bytes, timestamp: Column, place: Column, owner: Column) -> Column:
    """Keyed commitment to time, place and owner."""
    return hmac_sha256(key, F.concat(*map(_field, (timestamp, place, owner))))


def session_id(root: Column | str) -> Column:
    """Id of an import session from its Merkle root (bytes)."""
    return sha256(F.concat(tag(SESSION_TAG), _c(root)))


def clamp_score(pce: Column | str) -> Column:
    """A score as the record holds it: rounded half to even, then within 32 bits."""
    return F.greatest(F.lit(0).cast("long"), F.least(F.bround(_c(pce)).cast("long"), F.lit(4294967295)))


def canonical_record(image_hash, perceptual_hash, body_id, level, parent, hmac, pce, registered_at) -> Column:
    """The bytes that a signature covers, each part of fixed width; hashes are bytes, numbers are numbers."""
    return F.concat(tag(RECORD_TAG), _c(image_hash), _c(perceptual_hash), _c(body_id), big_endian(level, 1), _c(parent), _c(hmac), big_endian(pce, 4), big_endian(registered_at, 8))


def commit_data(image_hash, perceptual_hash, body_id, level, parent, hmac, pce, registered_at) -> Column:
    """The record as compact JSON with keys in order; bytes as hex without 0x."""
    h = lambda c: F.lower(F.hex(_c(c)))
    fields = {
        "body_id": h(body_id), "image_hash": h(image_hash), "metadata_hmac": h(hmac), "modification_level": _c(level), "parent_image_hash": h(parent),
        "pce_score": _c(pce), "perceptual_hash": h(perceptual_hash), "registered_at": _c(registered_at), "version": F.lit(RECORD_TAG.decode()),
    }
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def phash_bits(block: Column | str) -> tuple[Column, Column]:
    """The 64 bits of a perceptual hash as two 32-bit numbers (high, low), from 64 coefficients.

    A bit is set where the coefficient is above the median of all but the first; the first coefficient has a bit too.
    """
    c = _c(block)
    rest = F.sort_array(F.slice(c, 2, 63))
    median = F.element_at(rest, 32)
    bits = F.transform(c, lambda x: F.when(x > median, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")))
    fold = lambda start: F.aggregate(F.slice(bits, start, 32), F.lit(0).cast("long"), lambda a, b: a * 2 + b)
    return fold(1), fold(33)


def phash(block: Column | str) -> Column:
    """The same as one signed 64-bit pattern."""
    high, low = phash_bits(block)
    return F.shiftleft(high, 32).bitwiseOR(low)


def hamming(a: Column | str, b: Column | str) -> Column:
    return F.bit_count(_c(a).bitwiseXOR(_c(b)))

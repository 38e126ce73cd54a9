"""Native expressions for 32-byte words, addresses, content ids and file names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from luxtrace.schema import CID_PREFIX, DESKTOP_SOFTWARE, MAIN_CHAINS, RAW_SUFFIXES, TEST_CHAINS, ZERO_WORD


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def big_endian(value: Column | str, width: int) -> Column:
    """A non-negative number as ``width`` bytes, the highest first."""
    return F.unhex(F.lpad(F.hex(_c(value).cast("long")), 2 * width, "0"))


def tag(value: bytes) -> Column:
    return F.unhex(F.lit(value.hex()))


def null_if_zero(word: Column | str) -> Column:
    """An all-zero word means that there is none."""
    return F.nullif(F.lower(_c(word)), F.lit(ZERO_WORD))


def pad_word(value: Column | str) -> Column:
    """Bytes as a 32-byte word in hex, zeros in front."""
    return F.concat(F.lit("0x"), F.lower(F.lpad(F.hex(_c(value)), 64, "0")))


def low_64(word: Column | str) -> Column:
    """The last 16 hex digits of a word as a 64-bit pattern; null where it is too short to hold one."""
    digits = F.lpad(F.right(F.regexp_replace(_c(word), "^0x", ""), F.lit(16)), 16, "0")
    high, low = F.conv(F.substring(digits, 1, 8), 16, 10).cast("long"), F.conv(F.substring(digits, 9, 8), 16, 10).cast("long")
    return F.when(F.length(F.regexp_replace(_c(word), "^0x", "")) > 0, F.shiftleft(high, 32).bitwiseOR(low))


def is_hash(value: Column | str) -> Column:
    return _c(value).rlike("^0x[0-9a-f]{64}$")


def is_address(value: Column | str) -> Column:
    return _c(value).rlike("^0x[0-9a-fA-F]{40}$")


def is_commitment(value: Column | str) -> Column:
    return _c(value).rlike("^(0x)?[0-9a-fA-F]{64}$")


def same_id(a: Column | str, b: Column | str) -> Column:
    """Equal but for case and a leading 0x."""
    return bare(a) == bare(b)


def bare(value: Column | str) -> Column:
    return F.lower(F.regexp_replace(_c(value), "^0[xX]", ""))


def content_id(image_hash: Column | str) -> Column:
    """The content id of an image given as hex or as bytes in hex with 0x."""
    return F.concat(F.lit(CID_PREFIX), bare(image_hash))


def image_of_content_id(cid: Column | str) -> Column:
    """The image that a content id names, if it has the prefix and 64 more signs; what they are is not looked at."""
    c = _c(cid)
    n = len(CID_PREFIX)
    return F.when(c.startswith(CID_PREFIX) & (F.length(c) == n + 64), F.concat(F.lit("0x"), F.substring(c, n + 1, 64)))


def event_id(tx_hash: Column | str, log_index: Column | str) -> Column:
    """Transaction hash and log index (four bytes, the lowest first), in hex."""
    le = F.lower(F.lpad(F.hex(_c(log_index).cast("long")), 8, "0"))
    return F.concat(_c(tx_hash), *[F.substring(le, 1 + 2 * k, 2) for k in (3, 2, 1, 0)])


def transaction_of(entity_id: Column | str) -> Column:
    return F.substring(_c(entity_id), 1, 66)


def abi_word(data: Column | str, index: int) -> Column:
    """Word ``index`` of ABI-encoded bytes; null where the bytes end before it."""
    return F.when(F.length(_c(data)) >= 32 * (index + 1), F.substring(_c(data), 1 + 32 * index, 32))


def abi_uint(data: Column | str, index: int) -> Column:
    """An unsigned word that fits in 63 bits."""
    return F.conv(F.hex(F.substring(abi_word(data, index), 25, 8)), 16, 10).cast("long")


def abi_address(data: Column | str, index: int) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(F.substring(abi_word(data, index), 13, 20))))


def builder_suffix(code: str) -> str:
    """Call-data suffix for one builder code: the code, its length, a zero byte and the marker eight times, as hex."""
    if not code.isascii() or "," in code or len(code) > 255:
        raise ValueError("a builder code is ASCII without commas, below 256 bytes")
    return code.encode().hex() + f"{len(code):02x}" + "00" + "8021" * 8


def hmac_key(value: Column | str) -> Column:
    """A key given as hex, with or without 0x, else as text; null where it is blank."""
    v = F.trim(_c(value))
    hexed = F.regexp_replace(v, "^0x", "")
    return F.when(v == "", None).otherwise(F.coalesce(F.try_to_binary(hexed, F.lit("hex")), F.encode(v, "UTF-8")))


def is_raw(file_name: Column | str) -> Column:
    endings = "|".join(s[1:] for s in RAW_SUFFIXES)
    return F.lower(_c(file_name)).rlike(rf"\.({endings})$")


def is_jpeg(content: Column | str) -> Column:
    return F.hex(F.substring(_c(content), 1, 3)) == "FFD8FF"


def decoder_for(file_name: Column | str, content: Column | str) -> Column:
    """Which decoder a file goes to, by content first; raw files are refused."""
    return F.when(is_raw(file_name), "refused").when(is_jpeg(content), "jpeg").otherwise("lossless")


def is_camera_jpeg(make: Column | str, software: Column | str) -> Column:
    """A maker's name and no sign of a desktop program: the camera wrote the file itself."""
    edited = reduce(lambda a, b: a | b, [F.lower(F.coalesce(_c(software), F.lit(""))).contains(s) for s in DESKTOP_SOFTWARE])
    return (F.coalesce(_c(make), F.lit("")) != "") & ~edited


def may_test(chain_id: Column | str) -> Column:
    """Whether a registry on this chain may be one that can be reset; unknown chains may not."""
    return F.coalesce(_c(chain_id).isin(*TEST_CHAINS) & ~_c(chain_id).isin(*MAIN_CHAINS), F.lit(False))


def may_reset(test_mode: Column | str, registry: Column | str, typed: Column | str) -> Column:
    """A reset takes a test registry and its address typed out."""
    return F.coalesce(_c(test_mode) & (F.lower(F.trim(_c(typed))) == F.lower(_c(registry))), F.lit(False))

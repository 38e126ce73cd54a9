"""Media columns (operator 5): Netpbm and BMP bytes to numpy arrays, area resizing, NPY tiles and difference hashes.

Resizing averages the source area below each target pixel: running sums along each axis (an integral image, taken one axis
at a time so that memory stays near the size of the image) are read at fractional places and subtracted.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from luxtrace.llm.common import bounded_batches, columns, map_rows, read_table

#: Bytes in a row of a stored text, edge of the tiles, and rows summed at a time.
PAYLOAD_WIDTH = 64
TILE = 32
ROWS_AT_A_TIME = 16_384

_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")


def encode_pgm(payload: bytes, width: int = PAYLOAD_WIDTH) -> bytes:
    """Bytes as a binary grey map; their number must be a multiple of ``width``."""
    if len(payload) % width:
        raise ValueError("the payload does not fill its last row")
    return b"P5\n%d %d\n255\n" % (width, len(payload) // width) + payload


def encode_bmp(pixels: np.ndarray) -> bytes:
    """Grey (h, w) or RGB (h, w, 3) as an uncompressed BMP, bottom row first."""
    h, w = pixels.shape[:2]
    grey = pixels.ndim == 2
    row = pixels if grey else pixels[:, :, ::-1].reshape(h, 3 * w)
    body = np.pad(row, ((0, 0), (0, -row.shape[1] % 4)))[::-1].tobytes()
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, 1) * np.array([1, 1, 1, 0], np.uint8) if grey else np.zeros((0, 4), np.uint8)
    at = 54 + palette.nbytes
    return struct.pack("<2sIHHI", b"BM", at + len(body), 0, 0, at) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8 if grey else 24, 0, len(body), 2835, 2835, len(palette), 0) + palette.tobytes() + body


def decode_media(data: bytes) -> np.ndarray:
    """Netpbm P1 to P6 or uncompressed BMP (8, 24 or 32 bits) as (h, w) or (h, w, 3); anything else is a ValueError."""
    if data[:2] == b"BM":
        return _decode_bmp(data)
    if len(data) > 2 and data[:1] == b"P" and data[1:2] in b"123456":
        return _decode_netpbm(data)
    raise ValueError("neither Netpbm nor BMP")


def _decode_netpbm(data: bytes) -> np.ndarray:
    kind, at, head = int(data[1:2]), 2, []
    for _ in range(2 if kind in (1, 4) else 3):
        m = _TOKEN.match(data, at)
        if not m or not m[1].isdigit():
            raise ValueError("damaged Netpbm header")
        head.append(int(m[1]))
        at = m.end()
    w, h = head[:2]
    most = head[2] if len(head) > 2 else 1
    if not 0 < most < 65536:
        raise ValueError("bad Netpbm maximum")
    bands = 3 if kind in (3, 6) else 1
    shape = (h, w, 3) if bands == 3 else (h, w)
    n = h * w * bands
    if kind == 1:
        body = np.frombuffer(re.sub(rb"#[^\n]*|\s", b"", data[at:]), np.uint8)[:n] - 48
    elif kind in (2, 3):
        body = np.array(re.sub(rb"#[^\n]*", b"", data[at:]).split()[:n], np.int64)
    elif kind == 4:
        stride = (w + 7) // 8
        packed = np.frombuffer(data, np.uint8, offset=at + 1)[: h * stride]
        if packed.size < h * stride:
            raise ValueError("cut Netpbm body")
        body = np.unpackbits(packed.reshape(h, stride), axis=1)[:, :w].ravel()
    else:
        body = np.frombuffer(data, np.uint8 if most < 256 else ">u2", offset=at + 1)[:n]
    if body.size < n:
        raise ValueError("cut Netpbm body")
    if kind in (1, 4):
        return np.where(body.reshape(shape) > 0, 0, 255).astype(np.uint8)  # 1 is black
    if most != 255:
        body = (body.astype(np.int64) * 255 + most // 2) // most
    return body.astype(np.uint8, copy=False).reshape(shape)


def _decode_bmp(data: bytes) -> np.ndarray:
    if len(data) < 54:
        raise ValueError("cut BMP header")
    at, head, w, h, _, bits, packing = struct.unpack_from("<IIiiHHI", data, 10)
    if packing not in (0, 3) or bits not in (8, 24, 32) or w <= 0 or h == 0:
        raise ValueError("BMP of a kind that is not read")
    step = bits // 8
    stride = (w * step + 3) // 4 * 4
    body = np.frombuffer(data, np.uint8, offset=at)
    if body.size < stride * abs(h):
        raise ValueError("cut BMP body")
    rows = body[: stride * abs(h)].reshape(abs(h), stride)[:, : w * step]
    rows = rows[::-1] if h > 0 else rows
    if bits == 8:
        colours = np.frombuffer(data, np.uint8, offset=14 + head)[: at - 14 - head].reshape(-1, 4)[:, 2::-1]
        if colours.size and (colours == colours[:, :1]).all():
            return colours[rows, 0]
        return colours[rows]
    return rows.reshape(abs(h), w, step)[:, :, 2::-1]


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the area below each target pixel, as float64; bands are averaged first."""
    h, w = pixels.shape[:2]
    if not h or not w:
        return np.zeros((height, width))
    columns_ = _edges(w, width)
    narrow = np.empty((h, width))
    for a in range(0, h, ROWS_AT_A_TIME):
        block = pixels[a : a + ROWS_AT_A_TIME]
        block = block.mean(axis=2) if block.ndim == 3 else block
        sums = np.zeros((block.shape[0], w + 1))
        np.cumsum(block, axis=1, out=sums[:, 1:])
        narrow[a : a + len(block)] = np.diff(_read(sums, columns_, 1), axis=1)
    sums = np.zeros((h + 1, width))
    np.cumsum(narrow, axis=0, out=sums[1:])
    return np.diff(_read(sums, _edges(h, height), 0), axis=0) / ((h / height) * (w / width))


def _edges(n: int, parts: int) -> np.ndarray:
    return np.arange(parts + 1) * n / parts


def _read(sums: np.ndarray, places: np.ndarray, axis: int) -> np.ndarray:
    low = np.minimum(places.astype(np.int64), sums.shape[axis] - 2)
    part = places - low
    part = part[None, :] if axis else part[:, None]
    a, b = np.take(sums, low, axis), np.take(sums, low + 1, axis)
    return a + (b - a) * part


def difference_hash(pixels: np.ndarray) -> str:
    """64 bits as hex: whether each of 8 x 8 areas is darker than its right neighbour."""
    small = np.round(area_resize(pixels, 8, 9), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy_tile(pixels: np.ndarray, edge: int = TILE) -> bytes:
    """The image resized to a square of 8-bit samples, as the bytes of an NPY file."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(np.round(area_resize(pixels, edge, edge), 6)), 0, 255).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def payload_of(text: str | None) -> bytes:
    """UTF-8 and zeros up to a positive multiple of the row width; null counts as empty."""
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % PAYLOAD_WIDTH if raw else PAYLOAD_WIDTH)


def store_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, media``: each text as a grey map, losslessly.

    Null counts as empty, which is stored as one row of zeros; equal texts give equal media; an empty table gives none; other
    columns, of any name, are ignored.
    """
    bounded_batches(docs.sparkSession)

    def rows(it: Iterable[tuple]) -> Iterator[tuple]:
        for key, text in it:
            payload = payload_of(text)
            yield key, len((text or "").encode()), encode_pgm(payload)

    return map_rows(columns(docs, id_col, text_col), rows, f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_bytes long, media binary")


def media_tiles(media: DataFrame, *, keep: tuple[str, ...] = ("doc_id",), media_col: str = "media") -> DataFrame:
    """``keep, height, width, bands, dhash, tile, error``: each image decoded, its difference hash and its NPY tile.

    Null or damaged media give nulls and a message; nothing stops the job.
    """
    bounded_batches(media.sparkSession)
    kinds = dict(media.dtypes)

    def rows(it: Iterable[tuple]) -> Iterator[tuple]:
        for *kept, data in it:
            try:
                pixels = decode_media(data or b"")
                yield (*kept, pixels.shape[0], pixels.shape[1], 3 if pixels.ndim == 3 else 1, difference_hash(pixels), npy_tile(pixels), None)
            except (ValueError, IndexError, struct.error) as e:
                yield (*kept, None, None, None, None, None, str(e))

    return map_rows(columns(media, *keep, media_col), rows, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", height int, width int, bands int, dhash string, tile binary, error string")


def describe_stored(stored: DataFrame) -> DataFrame:
    """The digest of stored texts: what the decoder gives back of each, and its features. Each row is described by itself."""

    def rows(it: Iterable[tuple]) -> Iterator[tuple]:
        for key, n_bytes, data in it:
            pixels = decode_media(data)
            payload = pixels.tobytes()
            yield (
                key, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAYLOAD_WIDTH:]),
                len(data), hashlib.sha256(data).hexdigest(), difference_hash(pixels), hashlib.sha256(npy_tile(pixels)).hexdigest(),
            )

    return map_rows(stored, rows, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_sha256 string")


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, hashes and features of each row of ``documents`` stored as an image and read back; edge cases as in :func:`store_texts`."""
    return describe_stored(store_texts(read_table(spark, sf_dir, "documents")).withColumn("doc_id", F.col("doc_id").cast("long")))

"""Readers and writers of images, fingerprints and folders."""

from __future__ import annotations

import io
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from luxtrace.functions.words import is_jpeg, is_raw
from luxtrace.operators.raster import kernels as K

RGB = "image_id string, h int, w int, data binary, error string"


def read_images(spark: SparkSession, path: str, *, glob: str = "*", lossless_only: bool = True) -> DataFrame:
    """``image_id, h, w, data (RGB rows), error`` of image files.

    Decoding is Spark's own reader. Its JPEG decoder differs from others in the last bit, so with ``lossless_only`` JPEG files
    are refused by content, as raw files always are by name; what cannot be decoded is refused too.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", F.substring("content", 1, 3).alias("content"))
    images = spark.read.format("image").option("dropInvalid", "false").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("image.*")
    refused = F.when(is_raw("path"), "raw file").when(is_jpeg("content") & F.lit(lossless_only), "jpeg is not lossless")
    plain = lambda c: F.regexp_replace(c, "^([a-z0-9]+):/+", "$1:/")  # noqa: E731  the two readers differ in slashes
    both = files.select("path", refused.alias("refused")).join(images, plain("path") == plain("origin"), "left")

    def rgb(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                error = r.refused or (None if r.height and r.height > 0 else "cannot be decoded")
                if error:
                    out.append((r.path, None, None, None, error))
                    continue
                a = np.frombuffer(r.data, np.uint8).reshape(int(r.height), int(r.width), int(r.nChannels))
                a = np.repeat(a, 3, axis=2) if a.shape[2] == 1 else a[:, :, 2::-1]  # blue first, alpha last
                out.append((r.path, a.shape[0], a.shape[1], a.tobytes(), None))
            yield pd.DataFrame(out, columns=["image_id", "h", "w", "data", "error"])

    return both.select("path", "refused", "height", "width", "nChannels", "data").mapInPandas(rgb, RGB)


_NETPBM = re.compile(rb"P([56])\s+(?:#[^\n]*\n\s*)*(\d{1,9})\s+(?:#[^\n]*\n\s*)*(\d{1,9})\s+(?:#[^\n]*\n\s*)*255\s")


def decode_netpbm(content: bytes | None) -> np.ndarray | None:
    """RGB of a binary PGM or PPM with 8 bits a sample; None for anything else, and for a file that ends early."""
    head = _NETPBM.match(content or b"")
    if not head:
        return None
    channels, w, h = 1 if head[1] == b"5" else 3, int(head[2]), int(head[3])
    if not w or not h or len(content) - head.end() < w * h * channels:
        return None
    a = np.frombuffer(content, np.uint8, w * h * channels, head.end()).reshape(h, w, channels)
    return np.repeat(a, 3, axis=2) if channels == 1 else a


def decode_files(files: DataFrame) -> DataFrame:
    """``file_id, h, w, data (RGB rows), error`` of ``file_id, content``: Netpbm files, decoded where their bytes were read.

    Raw files are refused by name and JPEG files by content, as in ``read_images``, which reads other lossless formats.
    """
    refused = F.when(is_raw("file_id"), "raw file").when(is_jpeg("content"), "jpeg is not lossless")

    def rgb(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for name, content, error in b.itertuples(index=False):
                a = None if error else decode_netpbm(content)
                out.append((name, None, None, None, error or "cannot be decoded") if a is None else (name, *a.shape[:2], a.tobytes(), None))
            yield pd.DataFrame(out, columns=["file_id", "h", "w", "data", "error"])

    return files.select("file_id", "content", refused.alias("refused")).mapInPandas(rgb, RGB.replace("image_id", "file_id"))


def read_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """``body_id, plane, h, w, data, meta`` from ``.npz`` files; the body is the file's name; a file without planes gives no row."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path", "content")

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                with np.load(io.BytesIO(r.content), allow_pickle=False) as z:
                    meta = str(z["meta"]) if "meta" in z.files else "{}"
                    planes = {int(n[6:]): z[n] for n in z.files if n.startswith("plane_")}
                name = r.path.rsplit("/", 1)[-1].removesuffix(".npz")
                if planes:
                    yield pd.DataFrame([(name, c, *p.shape, p.astype(np.float32).ravel(), meta) for c, p in sorted(planes.items())], columns=["body_id", "plane", "h", "w", "data", "meta"])

    return files.mapInPandas(load, "body_id string, plane int, h int, w int, data array<float>, meta string")


def fingerprint_bytes(planes: dict[int, np.ndarray], meta: dict | None = None) -> bytes:
    """A fingerprint as the bytes of an ``.npz`` file, with its commitment."""
    out = io.BytesIO()
    arrays = {f"plane_{c}": np.asarray(p, np.float32) for c, p in planes.items()}
    np.savez_compressed(out, **arrays, meta=np.array(json.dumps(meta or {})), commitment=np.frombuffer(K.commitment(planes), np.uint8))
    return out.getvalue()


def folder_listing(spark: SparkSession, path: str) -> DataFrame:
    """``folder, n_files, n_raw, n_bytes`` of each folder below ``path``, from file names alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return files.groupBy(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder")).agg(F.count(F.lit(1)).alias("n_files"), F.count_if(is_raw("path")).alias("n_raw"), F.sum("length").alias("n_bytes"))


def change_signature(spark: SparkSession, path: str) -> DataFrame:
    """One row whose ``signature`` changes when a file below ``path`` does: names, sizes and times in order."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
    each = F.xxhash64("path", "length", "modificationTime")
    return files.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(each, F.lit(1 << 40))).alias("signature"))


# --- maker and program from image headers


def read_exif(content: bytes | None) -> tuple[str | None, str | None] | None:
    """``(make, software)`` from a JPEG, TIFF or PNG; None without a readable header."""
    try:
        tiff = _tiff_part(content or b"")
        return None if tiff is None else _directory(tiff)
    except (struct.error, IndexError, ValueError):
        return None


def _tiff_part(b: bytes) -> bytes | None:
    if b[:4] in (b"II*\0", b"MM\0*"):
        return b
    if b[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(b) and b[at] == 0xFF:
            size = struct.unpack_from(">H", b, at + 2)[0]
            if b[at + 1] == 0xE1 and b[at + 4 : at + 10] == b"Exif\0\0":
                return b[at + 10 : at + 2 + size]
            if b[at + 1] == 0xDA:
                return None
            at += 2 + size
    if b[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 8 <= len(b):
            size = struct.unpack_from(">I", b, at)[0]
            if b[at + 4 : at + 8] == b"eXIf":
                return b[at + 8 : at + 8 + size]
            at += 12 + size
    return None


def _directory(t: bytes) -> tuple[str | None, str | None]:
    order = {b"II": "<", b"MM": ">"}[t[:2]] if t[:2] in (b"II", b"MM") else None
    if order is None:
        raise ValueError("no byte order")
    at = struct.unpack_from(order + "I", t, 4)[0]
    found: dict[int, str] = {}
    for k in range(struct.unpack_from(order + "H", t, at)[0]):
        tag, kind, n, value = struct.unpack_from(order + "HHII", t, at + 2 + 12 * k)
        if tag in (271, 305) and kind == 2:
            start = value if n > 4 else at + 2 + 12 * k + 8
            found[tag] = t[start : start + n].split(b"\0")[0].decode("latin-1").strip()
    return found.get(271), found.get(305)


def with_exif(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` with ``make`` and ``software``; nulls where a header is missing or malformed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [read_exif(c) or (None, None) for c in b[content]]
            yield b.assign(make=[g[0] for g in got], software=[g[1] for g in got])

    return files.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema) + ", make string, software string")

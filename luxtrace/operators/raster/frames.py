"""Raster analytics as DataFrame operators: one plane of one frame in a row, kernels behind Arrow.

Planes have ``h int, w int, data array<float>`` (row by row). A fingerprint is a set of planes of one body.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from types import SimpleNamespace
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyarrow import parquet
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from luxtrace.operators.raster import kernels as K
from luxtrace.schema import SATURATION_LEVEL, SATURATION_WARN
from luxtrace.shared import shared_dir

#: Samples of one plane that are added up in one row.
CHUNK = 1 << 18


def plane_of(row) -> np.ndarray:
    return np.asarray(row.data, np.float32).reshape(row.h, row.w)


def pixels_of(row) -> np.ndarray:
    return np.frombuffer(row.data, np.uint8).reshape(row.h, row.w, 3)


#: Samples (or bytes) of result rows that are held before they leave a task, about. Input comes in batches of Spark's byte limit.
HELD = 4 << 20


def _values(column: pa.Array) -> list:
    """An Arrow column as Python values, lists of numbers as numpy arrays without a copy."""
    kind = column.type
    if not pa.types.is_list(kind) or not (pa.types.is_list(kind.value_type) or pa.types.is_primitive(kind.value_type)):
        return column.to_pylist()
    inner = _values(column.values) if pa.types.is_list(kind.value_type) else column.values.to_numpy(zero_copy_only=False)
    ends = column.offsets.to_numpy()
    return [inner[i:j] if ok else None for i, j, ok in zip(ends[:-1], ends[1:], column.is_valid().to_pylist(), strict=True)]


def _column(values: list, kind: pa.DataType) -> pa.Array:
    if pa.types.is_list(kind) and pa.types.is_primitive(kind.value_type):
        dtype = kind.value_type.to_pandas_dtype()
        values = [None if v is None else np.ascontiguousarray(v, dtype) for v in values]
    return pa.array(values, type=kind)


def _map(df: DataFrame, fn: Callable[[SimpleNamespace], dict | list[dict] | None], schema: str) -> DataFrame:
    """``fn`` of each row, in Arrow batches: it gets arrays as numpy and gives a dictionary, several or none."""
    out = df.sparkSession.createDataFrame([], schema).schema
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([_column([g.get(f.name) for g in held], f.type) for f in arrow], schema=arrow)

        for b in batches:
            for row in zip(*map(_values, b.columns), strict=True):
                got = fn(SimpleNamespace(**dict(zip(b.schema.names, row, strict=True))))
                for g in got if isinstance(got, list) else [got] if got else []:
                    held.append(g)
                    size += 64 + sum(len(v) for v in g.values() if hasattr(v, "__len__"))
                    if size >= HELD:
                        yield batch()
                        held, size = [], 0
        if held:
            yield batch()

    return df.mapInArrow(run, out)


def samples(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with the bytes of ``column`` as an ``array<float>`` named ``name`` in its place; null stays null."""
    schema = ", ".join(f"`{c}` {t}" if c != column else f"`{name}` array<float>" for c, t in df.dtypes)
    wide = lambda v: None if v is None else np.frombuffer(v, np.uint8).astype(np.float32)
    return _map(df, lambda r: {name if c == column else c: wide(v) if c == column else v for c, v in vars(r).items()}, schema)


def split_mosaics(mosaics: DataFrame, crop: int | None = None) -> DataFrame:
    """``frame_id, plane, h, w, data, error`` from ``frame_id, h, w, data array<float>, colours array<int>, black array<double>, white``.

    ``colours`` numbers each sample of the mosaic; other tilings than 2 × 2 give an error row.
    """

    def split(r):
        shape = (r.h, r.w)
        try:
            planes = K.split_mosaic(np.asarray(r.data, np.float32).reshape(shape), np.asarray(r.colours, int).reshape(shape), list(r.black), float(r.white), crop)
        except (ValueError, ZeroDivisionError) as e:
            return {"frame_id": r.frame_id, "error": str(e)}
        return [{"frame_id": r.frame_id, "plane": c, "h": p.shape[0], "w": p.shape[1], "data": p.ravel(), "error": None} for c, p in sorted(planes.items())]

    return _map(mosaics.select("frame_id", "h", "w", "data", "colours", "black", "white"), split, "frame_id string, plane int, h int, w int, data array<float>, error string")


def delivered_planes(images: DataFrame, pattern: list[list[int]]) -> DataFrame:
    """``image_id, plane, h, w, data`` of RGB images at sensor size (``image_id, h, w, data binary``)."""
    split = lambda r: [{"image_id": r.image_id, "plane": c, "h": p.shape[0], "w": p.shape[1], "data": p.ravel()} for c, p in sorted(K.delivered_planes(pixels_of(r), pattern).items())]
    return _map(images.select("image_id", "h", "w", "data"), split, "image_id string, plane int, h int, w int, data array<float>")


def image_hash_block(images: DataFrame) -> DataFrame:
    """``image_id, block``: the 64 coefficients that perceptual hashes come from; the bits are a native expression."""
    return _map(images.select("image_id", "h", "w", "data"), lambda r: {"image_id": r.image_id, "block": K.dct_block(pixels_of(r))}, "image_id string, block array<double>")


def residuals(planes: DataFrame, key: str = "frame_id") -> DataFrame:
    """The planes with their noise residuals in place of samples."""
    kind = dict(planes.dtypes)[key]
    return _map(planes.select(F.col(key).alias("k"), "plane", "h", "w", "data"), lambda r: {key: r.k, "plane": r.plane, "h": r.h, "w": r.w, "data": K.noise_residual(plane_of(r)).ravel()}, f"`{key}` {kind}, plane int, h int, w int, data array<float>")


# --- residuals of planes in tiles


#: Edge of a tile; a multiple of the wavelet's largest step.
TILE = 2048
_STEP = 1 << K.LEVELS
TILES = "plane int, h int, w int, y int, x int, th int, tw int, data array<float>"


def to_tiles(planes: DataFrame, key: str = "frame_id", edge: int = TILE) -> DataFrame:
    """Planes cut into tiles of ``edge``: ``key, plane, h, w`` (of the plane), ``y, x`` (the tile's corner), ``th, tw, data``."""
    if edge % _STEP:
        raise ValueError(f"the edge of a tile is a multiple of {_STEP}")

    def cut_up(r):
        p = plane_of(r)
        for y in range(0, r.h, edge):
            for x in range(0, r.w, edge):
                t = p[y : y + edge, x : x + edge]
                yield {key: r.k, "plane": r.plane, "h": r.h, "w": r.w, "y": y, "x": x, "th": t.shape[0], "tw": t.shape[1], "data": t.ravel()}

    return _map(planes.select(F.col(key).alias("k"), "plane", "h", "w", "data"), lambda r: list(cut_up(r)), f"`{key}` {dict(planes.dtypes)[key]}, {TILES}")


def residual_tiles(tiles: DataFrame, key: str = "frame_id", edge: int = TILE) -> DataFrame:
    """The tiles with their noise residuals in place of samples, as of the whole plane.

    Each tile hands its neighbours the strips that they need: what is further away than the filters and windows reach can't
    bear on a residual. Strips begin at whole steps of the wavelet, so its samples fall as in the plane, and where a tile's
    surroundings end at the plane's border they end as the plane does. A task has one tile and its surroundings.
    """
    kind = dict(tiles.dtypes)[key]

    def halo_of(h: int, w: int) -> int:
        return -(-K.reach(K.levels_for((h, w))) // _STEP) * _STEP

    def hand_out(r):
        halo, t = halo_of(r.h, r.w), np.asarray(r.data, np.float32).reshape(r.th, r.tw)
        near = -(-halo // edge)
        for ty in range(max(0, r.y - near * edge), min(r.h, r.y + (near + 1) * edge), edge):
            for tx in range(max(0, r.x - near * edge), min(r.w, r.x + (near + 1) * edge), edge):
                (top, bottom), (left, right) = ((max(a, c - halo), min(a + n, c + edge + halo)) for a, n, c in ((r.y, r.th, ty), (r.x, r.tw, tx)))
                if top < bottom and left < right:
                    part = t[top - r.y : bottom - r.y, left - r.x : right - r.x]
                    yield {key: r.k, "plane": r.plane, "h": r.h, "w": r.w, "y": ty, "x": tx, "top": top, "left": left, "ph": part.shape[0], "pw": part.shape[1], "data": part.ravel()}

    strips = _map(tiles.select(F.col(key).alias("k"), "plane", "h", "w", "y", "x", "th", "tw", "data"), lambda r: list(hand_out(r)), f"`{key}` {kind}, plane int, h int, w int, y int, x int, top int, left int, ph int, pw int, data array<float>")

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        h, w, y, x = (int(first[c]) for c in ("h", "w", "y", "x"))
        halo = halo_of(h, w)
        top, left, bottom, right = max(0, y - halo), max(0, x - halo), min(h, y + edge + halo), min(w, x + edge + halo)
        a = np.zeros((bottom - top, right - left), np.float32)
        for r in pdf.itertuples(index=False):
            a[r.top - top : r.top - top + r.ph, r.left - left : r.left - left + r.pw] = np.asarray(r.data, np.float32).reshape(r.ph, r.pw)
        got = K.noise_residual(a, levels=K.levels_for((h, w)))[y - top : y - top + edge, x - left : x - left + edge]
        return pd.DataFrame({key: [first[key]], "plane": [first["plane"]], "h": [h], "w": [w], "y": [y], "x": [x], "th": [got.shape[0]], "tw": [got.shape[1]], "data": [got.ravel()]})

    return strips.groupBy(key, "plane", "h", "w", "y", "x").applyInPandas(tile, f"`{key}` {kind}, {TILES}")


def saturation(planes: DataFrame, key: str = "frame_id") -> DataFrame:
    """The largest share of saturated samples over each frame's planes, natively."""
    share = F.size(F.filter("data", lambda x: x >= SATURATION_LEVEL)) / F.size("data")
    return planes.groupBy(key).agg(F.max(share).alias("saturated"))


def uneven_planes(frames: DataFrame) -> DataFrame:
    """``body_id, plane, sizes``: planes whose frames differ in size, of which no fingerprint can be made."""
    return frames.groupBy("body_id", "plane").agg(F.countDistinct("h", "w").alias("sizes")).where("sizes > 1")


def estimate_fingerprints(frames: DataFrame) -> DataFrame:
    """``body_id, plane, h, w, data``: maximum-likelihood fingerprints from ``body_id, frame_id, plane, h, w, data``, cleaned up.

    Each task adds up residual × sample and sample² of the frames it has, so what is shuffled is one pair of sums for each
    task, body and plane, in chunks, whatever the number of frames. Planes whose frames differ in size are
    left out; ``uneven_planes`` tells which.
    """
    kind = dict(frames.dtypes)["body_id"]
    parts = to_arrow_schema(frames.sparkSession.createDataFrame([], f"body_id {kind}, plane int, h int, w int, chunk int, top array<double>, bottom array<double>").schema)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list[np.ndarray]] = {}

        def rows(key: tuple) -> Iterator[pa.RecordBatch]:
            top, bottom = (x.ravel() for x in sums.pop(key))
            for i in range(0, top.size, CHUNK):
                values = (*key, i // CHUNK, top[i : i + CHUNK], bottom[i : i + CHUNK])
                yield pa.RecordBatch.from_arrays([_column([v], f.type) for v, f in zip(values, parts, strict=True)], schema=parts)

        for b in batches:
            for body, plane, h, w, data in zip(*map(_values, b.columns), strict=True):
                key, p = (body, plane, h, w), np.asarray(data, np.float32).reshape(h, w)
                if key not in sums and len(sums) >= 8:  # memory holds a few planes
                    yield from rows(next(iter(sums)))
                top, bottom = sums.setdefault(key, [np.zeros(p.shape), np.zeros(p.shape)])
                top += K.noise_residual(p) * p
                bottom += p.astype(np.float64) ** 2
        for key in list(sums):
            yield from rows(key)

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        top, bottom = (np.sum(np.stack(pdf[c].to_list()), axis=0) for c in ("top", "bottom"))
        k = (top / np.maximum(bottom, np.finfo(np.float64).eps)).astype(np.float32)
        return pd.DataFrame({"body_id": [first.body_id], "plane": [first["plane"]], "h": [first["h"]], "w": [first["w"]], "chunk": [first["chunk"]], "data": [k]})

    own = frames.join(uneven_planes(frames), ["body_id", "plane"], "left_anti")
    summed = own.select("body_id", "plane", "h", "w", "data").mapInArrow(partial, f"body_id {kind}, plane int, h int, w int, chunk int, top array<double>, bottom array<double>")
    chunks = summed.groupBy("body_id", "plane", "h", "w", "chunk").applyInPandas(total, f"body_id {kind}, plane int, h int, w int, chunk int, data array<float>")
    whole = chunks.groupBy("body_id", "plane", "h", "w").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "data"))), lambda x: x["data"])).alias("data"))  # one plane
    clean = lambda r: {"body_id": r.body_id, "plane": r.plane, "h": r.h, "w": r.w, "data": K.postprocess(plane_of(r)).ravel()}
    return _map(whole, clean, f"body_id {kind}, plane int, h int, w int, data array<float>")


def enrol(frames: DataFrame) -> DataFrame:
    """``estimate_fingerprints`` that fails aloud: frames of several sizes are an error that names their planes, and bodies whose
    frames are saturated beyond a share that spoils fingerprints are warned of."""
    uneven = uneven_planes(frames).orderBy("body_id", "plane").limit(20).collect()
    if uneven:
        raise ValueError("frames differ in size: " + ", ".join(f"plane {r['plane']} of {r['body_id']}" for r in uneven))
    share = F.size(F.filter("data", lambda x: x >= SATURATION_LEVEL)) / F.size("data")
    for r in frames.groupBy("body_id").agg(F.max(share).alias("most")).where(F.col("most") > SATURATION_WARN).orderBy(F.desc("most")).limit(20).collect():
        warnings.warn(f"{r['most']:.1%} of a frame of {r['body_id']} is saturated", stacklevel=2)
    return estimate_fingerprints(frames)


def commitments(fingerprints: DataFrame) -> DataFrame:
    """``body_id, commitment`` of each fingerprint."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"body_id": [pdf["body_id"].iloc[0]], "commitment": [K.commitment({int(r.plane): plane_of(r) for r in pdf.itertuples()})]})

    return fingerprints.groupBy("body_id").applyInPandas(one, f"body_id {dict(fingerprints.dtypes)['body_id']}, commitment binary")


def sensor_fields(fingerprints: DataFrame) -> DataFrame:
    """``body_id, h, w, data``: the mean of the green planes, or of all."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        f = K.sensor_field({int(r.plane): plane_of(r) for r in pdf.itertuples()})
        return pd.DataFrame({"body_id": [pdf["body_id"].iloc[0]], "h": [f.shape[0]], "w": [f.shape[1]], "data": [f.ravel()]})

    return fingerprints.groupBy("body_id").applyInPandas(one, f"body_id {dict(fingerprints.dtypes)['body_id']}, h int, w int, data array<float>")


def packed(planes: DataFrame, key: str, prefix: str) -> DataFrame:
    """One row for each ``key`` with all its planes (a handful), in order, as arrays side by side."""
    whole = planes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("plane", "h", "w", "data"))).alias("p"))
    return whole.select(key, *[F.col(f"p.{c}").alias(f"{prefix}_{c}") for c in ("plane", "h", "w", "data")])


def _unpacked(row, prefix: str) -> dict[int, np.ndarray]:
    columns = [getattr(row, f"{prefix}_{c}") for c in ("plane", "h", "w", "data")]
    return {int(c): np.asarray(data, np.float32).reshape(h, w) for c, h, w, data in zip(*columns, strict=True)}


_RESULT = "image_id string, body_id string, pce double, path string, orientation string, scale double, stripped boolean, error string"


#: Fingerprints in a file, which a task holds at once, and samples of prepared images that it holds meanwhile, about (some 12 bytes each).
BODIES, PREPARED = 8, 8 << 20


def _against_bodies(images: DataFrame, fingerprints: DataFrame, prepare: Callable[[SimpleNamespace], Any], size: Callable[[SimpleNamespace], int], score: Callable[[Any, dict[int, np.ndarray]], dict]) -> DataFrame:
    """``score`` of each image, prepared once by ``prepare``, with each body's planes.

    Every image meets every enrolled body, which is what the question asks. Images stay where they are: each is prepared (its
    residuals, the dear part) once, by the task that has it. Fingerprints are written to the shared folder, BODIES in a file,
    and a task reads file after file for each of its loads of images, so no raster is copied or shuffled for a comparison.
    """
    spark = images.sparkSession
    path = shared_dir(spark, "bodies")
    packed(fingerprints, "body_id", "k").withColumn("body_id", F.col("body_id").cast("string")).write.option("maxRecordsPerFile", BODIES).parquet(path)
    files = sorted(spark.read.parquet(path).inputFiles())
    out = spark.createDataFrame([], _RESULT).schema
    arrow = to_arrow_schema(out)

    def bodies(file: str) -> Iterator[tuple[str, dict[int, np.ndarray]]]:
        system, at = arrow_fs.FileSystem.from_uri(file)
        with system.open_input_file(at) as f:
            for b in parquet.ParquetFile(f).iter_batches(batch_size=1):
                one = SimpleNamespace(**{c: _values(b.column(c))[0] for c in b.schema.names})
                yield one.body_id, _unpacked(one, "k")

    def met(load: list[tuple[str, Any]]) -> Iterator[pa.RecordBatch]:
        for file in files:
            found = [{"image_id": image_id, "body_id": body_id} | score(probe, planes) for body_id, planes in bodies(file) for image_id, probe in load]
            if found:
                yield pa.RecordBatch.from_arrays([_column([g.get(f.name) for g in found], f.type) for f in arrow], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load, held = [], 0
        for b in batches:
            for values in zip(*map(_values, b.columns), strict=True):
                row = SimpleNamespace(**dict(zip(b.schema.names, values, strict=True)))
                load.append((row.image_id, prepare(row)))
                held += size(row)
                if held >= PREPARED:
                    yield from met(load)
                    load, held = [], 0
        if load:
            yield from met(load)

    return images.withColumn("image_id", F.col("image_id").cast("string")).mapInArrow(run, out)


def score_planes(planes: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Score of each frame's planes (``image_id, plane, h, w, data``) against each body, on the mosaic."""

    def one(probe: K.Probe, k: dict[int, np.ndarray]) -> dict:
        try:
            return {"pce": probe.score(k), "path": "aligned", "orientation": "0 deg"}
        except ValueError as e:
            return {"error": str(e)}

    return _against_bodies(packed(planes, "image_id", "i"), fingerprints, lambda r: K.Probe({c: np.array(p) for c, p in _unpacked(r, "i").items()}), lambda r: sum(map(len, r.i_data)), one)


def score_images(images: DataFrame, fingerprints: DataFrame, pattern: list[list[int]]) -> DataFrame:
    """Score of each delivered image (``image_id, h, w, data binary``) against each body, by the first way that fits."""

    def one(probe: K.ImageProbe, k: dict[int, np.ndarray]) -> dict:
        got = probe.score(k)
        return {"pce": got["pce"], "path": got["path"], "orientation": got["orientation"], "scale": got.get("scale"), "stripped": got.get("stripped", False)}

    return _against_bodies(images.select("image_id", "h", "w", "data"), fingerprints, lambda r: K.ImageProbe(np.array(pixels_of(r)), pattern), lambda r: len(r.data), one)


def search_attempts(probes: DataFrame, *, exhaustive: bool = False) -> DataFrame:
    """Scale and orientation search as rows: ``image_id, body_id, pce, scale, turns, mirrored`` of the best attempt.

    ``probes`` has ``image_id, h, w, data`` (residual) and ``body_id, kh, kw, k`` (field). Each attempt is a row, so a hard
    image is shared out over tasks; the second stage runs the scales at the orientation that won the first.
    """
    spark = probes.sparkSession

    def run(df: DataFrame) -> DataFrame:
        def one(r):
            a, k = np.asarray(r.data, np.float32).reshape(r.h, r.w), np.asarray(r.k, np.float32).reshape(r.kh, r.kw)
            return {"image_id": str(r.image_id), "body_id": str(r.body_id), "pce": K.attempt(a, k, r.turns, r.mirrored, r.scale), "scale": r.scale, "turns": r.turns, "mirrored": r.mirrored, "place": r.place}

        got = _map(df, one, "image_id string, body_id string, pce double, scale double, turns int, mirrored boolean, place int")
        best = F.max_by(F.struct("pce", "scale", "turns", "mirrored"), F.struct(F.abs("pce"), -F.col("place"))).alias("b")
        return got.groupBy("image_id", "body_id").agg(best).select("image_id", "body_id", "b.*")

    first = spark.createDataFrame([(i, t, m, f) for i, (t, m, f) in enumerate(K.attempts(exhaustive))], "place int, turns int, mirrored boolean, scale double")
    best = run(probes.crossJoin(F.broadcast(first)))  # 8 or 104 attempts
    if exhaustive:
        return best
    scales = spark.createDataFrame([(i, float(f)) for i, f in enumerate(K.SCALES)], "place int, scale double")
    settled = probes.join(best.select("image_id", "body_id", "turns", "mirrored"), ["image_id", "body_id"])
    return run(settled.crossJoin(F.broadcast(scales)))  # 13 scales


def signals(images: DataFrame, *, raw: bool = False) -> DataFrame:
    """``image_id, resamplingPeak, detail``; null for raw images, detail to one decimal."""

    def one(r):
        if raw:
            return {"image_id": str(r.image_id), "resamplingPeak": None, "detail": None}
        grey = K.luma(pixels_of(r))
        return {"image_id": str(r.image_id), "resamplingPeak": K.resampling_peak(grey), "detail": round(K.detail(grey), 1)}

    return _map(images.select("image_id", "h", "w", "data"), one, "image_id string, resamplingPeak double, detail double")


def area_resized(planes: DataFrame, width: int, height: int, key: str = "frame_id") -> DataFrame:
    """The planes at another size, each sample the mean of the area that it covers."""
    resize = lambda r: {key: r.k, "plane": r.plane, "h": height, "w": width, "data": K.area_resize(plane_of(r), width, height).ravel()}
    return _map(planes.select(F.col(key).alias("k"), "plane", "h", "w", "data"), resize, f"`{key}` {dict(planes.dtypes)[key]}, plane int, h int, w int, data array<float>")


def structural_similarity(pairs: DataFrame) -> DataFrame:
    """``pair_id, ssim`` of two grey images of one size (``pair_id, h, w, a, b``)."""
    one = lambda r: {"pair_id": r.pair_id, "ssim": K.ssim(*(np.asarray(x, np.float64).reshape(r.h, r.w) for x in (r.a, r.b)))}
    return _map(pairs.select("pair_id", "h", "w", "a", "b"), one, f"pair_id {dict(pairs.dtypes)['pair_id']}, ssim double")


def pair_scores(frames: DataFrame) -> DataFrame:
    """Score between the residuals of each two frames of a body that were chosen for comparison (``pair_id, plane, h, w, data`` and ``other``)."""
    def one(r):
        shape = (r.h, r.w)
        a, b = (np.asarray(x, np.float32).reshape(shape) for x in (r.data, r.other))
        return {"pair_id": str(r.pair_id), "plane": r.plane, "pce": K.pce(K.noise_residual(a), K.noise_residual(b))}

    return _map(frames.select("pair_id", "plane", "h", "w", "data", "other"), one, "pair_id string, plane int, pce double")

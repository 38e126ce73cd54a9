"""From files to verdicts: a file goes on to the next, dearer stage only while it is unresolved.

1. decode: raw files and files without a decoder are refused;
2. hash: pixels to content hash and perceptual hash, once for each file;
3. registry: these very pixels are registered;
4. index and registry: a near copy is registered (the index proposes, the registry confirms);
5. score: what is left is scored against enrolled fingerprints, which can never grant a claim.

Files of equal pixels are one row from stage 3 on, so a picture that a third of all files show is looked up once. Each
stage's rows are written before the next, so no picture is decoded or looked up twice; the rasters themselves are read again
only for the files that reach stage 5. What was written is joined by sorting: Spark goes by the size of the files, a fraction
of what their hashes take in memory, and would send them to every task by way of the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from luxtrace.functions import labels
from luxtrace.functions.hashing import phash, pixel_hash
from luxtrace.functions.words import bare, is_raw, low_64
from luxtrace.operators import event_fold
from luxtrace.operators.raster.frames import image_hash_block, score_images, signals
from luxtrace.operators.verdict import confirmed, earliest
from luxtrace.schema import PCE_THRESHOLD
from luxtrace.shared import cut

COLUMNS = (
    "file_id", "verdict", "stage", "image_hash", "perceptual_hash", "reported", "distance", "body_id", "body_name", "owner", "revoked", "registered_at", "level", "pce_at_registration", "competing", "best_body", "pce", "method", "reason", "resettable",
)
_COMPETING = "array<struct<image_id:string,body_id:string,distance:int,registered_at:bigint,earlier:boolean>>"
_EMPTY = {"distance": "int", "registered_at": "long", "level": "int", "pce_at_registration": "long", "competing": _COMPETING, "pce": "double", "revoked": "boolean", "resettable": "boolean"}


def hashed(rasters: DataFrame) -> DataFrame:
    """``file_id, image_hash, perceptual_hash (64 bits), error`` of ``file_id, h, w, data binary, error``; a raster without data is an error."""
    bad = F.coalesce("error", F.when(is_raw("file_id"), "raw files need a decoder on this machine"), F.when(F.col("data").isNull(), "cannot be decoded"))
    rows = rasters.withColumn("error", bad)
    good = rows.where("error IS NULL").select("file_id", pixel_hash("h", "w", "data").alias("image_hash"), "h", "w", "data")
    blocks = image_hash_block(good.select(F.concat_ws("|", "image_hash", "file_id").alias("image_id"), "h", "w", "data"))
    own = blocks.select(F.substring("image_id", 68, 1 << 30).alias("file_id"), F.substring("image_id", 1, 66).alias("image_hash"), phash("block").alias("perceptual_hash"), F.lit(None).cast("string").alias("error"))
    return own.union(rows.where("error IS NOT NULL").select("file_id", F.lit(None).cast("string"), F.lit(None).cast("long"), "error"))


def _as_result(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast(_EMPTY.get(c, "string" if c != "perceptual_hash" else "long")).alias(c) if c in df.columns else F.lit(None).cast(_EMPTY.get(c, "string" if c != "perceptual_hash" else "long")).alias(c) for c in COLUMNS])


def verify_files(rasters: DataFrame, folded: DataFrame, *, fingerprints: DataFrame | None = None, pattern: list[list[int]] | None = None, local: DataFrame | None = None, index: DataFrame | None = None, registry_read: bool = True, threshold: float = PCE_THRESHOLD) -> DataFrame:
    """One row for each file (``rasters``: ``file_id, h, w, data binary, error``) with the columns ``COLUMNS``.

    ``verdict``: refused, registered, derived, fingerprint-only, no-record; withheld for all that were decoded if the registry
    couldn't be read (``registry_read`` false). ``stage`` names the one that resolved it. ``index`` (``image_id, image_hash64``)
    proposes near copies; by default it is that of the registry. An exact hit is looked up there as well, for registrations
    that came ``earlier``. ``local`` (``body_id, name``) names enrolled bodies.
    """
    seen = cut(hashed(rasters))
    refused = _as_result(seen.where("error IS NOT NULL").select("file_id", F.lit("refused").alias("verdict"), F.lit("decode").alias("stage"), F.col("error").alias("reason")))
    good = seen.where("error IS NULL").drop("error")
    if not registry_read:
        return refused.unionByName(_as_result(good.withColumn("verdict", F.lit("withheld")).withColumn("stage", F.lit("registry"))))
    images = event_fold.images_current(folded)
    records = cut(images.select(F.col("image_hash").alias("image_id"), low_64("perceptual_hash").alias("image_hash64"), "body_id", "registered_at", "level", "pce"))
    pictures = good.groupBy("image_hash").agg(F.min("perceptual_hash").alias("probe_hash"))
    probes = cut(pictures.select(F.col("image_hash").alias("probe_id"), F.col("image_hash").alias("image_id"), "probe_hash"))
    near = cut(confirmed(probes, records.select("image_id", "image_hash64") if index is None else index, records))
    exact = records.hint("merge").join(probes.select("image_id"), "image_id", "left_semi").select("image_id", F.lit("registered").alias("verdict"), F.lit("registry").alias("stage"), F.col("image_id").alias("reported"), F.lit(None).cast("int").alias("distance"))
    first = earliest(near).hint("merge").join(exact.select(F.col("image_id").alias("probe_id")), "probe_id", "left_anti")
    derived = first.select(F.col("probe_id").alias("image_id"), F.lit("derived").alias("verdict"), F.lit("index").alias("stage"), F.col("image_id").alias("reported"), F.col("distance").cast("int"))
    claims = exact.union(derived)
    of = records.select(F.col("image_id").alias("reported"), "body_id", "registered_at", "level", F.col("pce").alias("pce_at_registration"))
    bodies = event_fold.bodies_current(folded).select("body_id", "owner", "revoked")
    others = near.select(F.col("probe_id").alias("image_id"), F.struct("rank", F.col("image_id").alias("other"), "body_id", F.col("distance").cast("int").alias("distance"), "registered_at").alias("m")).groupBy("image_id").agg(F.array_sort(F.collect_list("m")).alias("found"))  # MOST_CONFIRMED at most
    competing = F.transform(F.filter(F.coalesce("found", F.array()), lambda m: m["other"] != F.col("reported")), lambda m: F.struct(m["other"].alias("image_id"), m["body_id"].alias("body_id"), m["distance"].alias("distance"), m["registered_at"].alias("registered_at"), (m["registered_at"] < F.col("registered_at")).alias("earlier")))
    state = F.broadcast(event_fold.current_epoch(folded).select("resettable"))  # one row
    resolved = claims.hint("merge").join(of, "reported").join(bodies, "body_id", "left").join(others, "image_id", "left").withColumn("competing", competing).crossJoin(state)
    if local is not None:
        resolved = resolved.join(local.select(bare("body_id").alias("__k"), F.col("name").alias("body_name")), bare("body_id") == F.col("__k"), "left")
    resolved = cut(resolved.withColumnRenamed("image_id", "image_hash").drop("found"))
    out = [refused, _as_result(good.hint("merge").join(resolved, "image_hash"))]
    left = cut(good.hint("merge").join(resolved.select("image_hash"), "image_hash", "left_anti"))
    if fingerprints is None:
        out.append(_as_result(left.withColumn("verdict", F.lit("no-record")).withColumn("stage", F.lit("index"))))
    else:
        out.append(_as_result(_scored(rasters, left, fingerprints, pattern, local, threshold)))
    return reduce(DataFrame.unionByName, out)


def _scored(rasters: DataFrame, left: DataFrame, fingerprints: DataFrame, pattern: list[list[int]] | None, local: DataFrame | None, threshold: float) -> DataFrame:
    """The files ``left`` with the best body's score; pictures are scored once, whatever many files show them."""
    one = left.groupBy("image_hash").agg(F.min("file_id").alias("file_id"))
    shown = rasters.join(one, "file_id").select(F.col("image_hash").alias("image_id"), "h", "w", "data")
    scores = score_images(shown, fingerprints, pattern or [[0, 1], [3, 2]])
    best = scores.groupBy(F.col("image_id").alias("image_hash")).agg(F.max_by(F.struct("body_id", "pce", "path"), F.struct("pce", "body_id")).alias("b"))
    out = left.join(best, "image_hash", "left").join(signals(shown).select(F.col("image_id").alias("image_hash"), "detail"), "image_hash", "left")
    out = out.select(*left.columns, F.col("b.body_id").alias("best_body"), F.col("b.pce").alias("pce"), F.col("b.path").alias("method"), "detail").withColumn("matched", F.coalesce(F.col("pce") >= threshold, F.lit(False)))
    out = out.withColumn("verdict", F.when(F.col("matched"), "fingerprint-only").otherwise("no-record")).withColumn("stage", F.lit("score")).withColumn("body_id", F.when(F.col("matched"), F.col("best_body")))
    out = out.withColumn("reason", F.when(~F.col("matched"), labels.diagnosis("detail", F.lit(False), F.lit(False))))
    if local is None:
        return out
    return out.join(local.select(bare("body_id").alias("__k"), F.col("name").alias("body_name")), bare("best_body") == F.col("__k"), "left").withColumn("body_name", F.when(F.col("matched"), F.col("body_name")))

"""Registering an import: frames that may be registered, one root for all of them, and a proof for each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from luxtrace.functions.hashing import clamp_score, session_id
from luxtrace.functions.keccak import inclusion_proofs, merkle_roots
from luxtrace.schema import PCE_THRESHOLD


def judged(frames: DataFrame, registered: DataFrame, threshold: float = PCE_THRESHOLD) -> DataFrame:
    """``frames`` (``session, frame_id, image_hash binary, pce, body_registered``) with the reason why one is refused.

    The registered score is the rounded one, so 99.6 passes here.
    """
    known = registered.select(F.col("image_hash").alias("__h")).distinct()
    out = frames.join(known, F.col("image_hash") == F.col("__h"), "left")
    reason = (
        F.when(~F.coalesce("body_registered", F.lit(False)), "camera is not registered").when(F.col("__h").isNotNull(), "already registered").when(F.col("pce").isNull(), "no score")
        .when(clamp_score("pce") < threshold, "score below the threshold")
    )
    return out.withColumn("refused", reason).drop("__h")


def roots(judged_frames: DataFrame) -> DataFrame:
    """``session, merkle_root, frame_count, session_id`` of the accepted frames."""
    return merkle_roots(judged_frames.where("refused IS NULL"), "session", "image_hash").withColumn("session_id", session_id("merkle_root"))


def proofs(judged_frames: DataFrame) -> DataFrame:
    """``session, image_hash, proof, root`` of each accepted image, however many a session has."""
    return inclusion_proofs(judged_frames.where("refused IS NULL"), "session", "image_hash")


def registered(judged_frames: DataFrame) -> DataFrame:
    """What an import hands back: each accepted image with its session's id and size, the root and its proof."""
    own = roots(judged_frames).select(F.col("session").alias("__s"), "session_id", "frame_count")
    return proofs(judged_frames).join(own, F.col("session").eqNullSafe(F.col("__s"))).select("session", "session_id", "frame_count", "image_hash", "proof", F.col("root").alias("merkle_root"))

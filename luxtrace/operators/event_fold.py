"""Folding the registry's ordered events into entity tables, by epoch.

A position is ``(block, log index)``. A reset starts a new epoch: bodies, images and sessions of earlier epochs are gone from
the current views; commits, attestations and challenges stay and carry their epoch. Everything is grouped by entity, so the
fold has no global order but for the epoch and the commit index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from luxtrace.functions.words import event_id, image_of_content_id, null_if_zero
from luxtrace.operators.ordered import as_of, running_sum

#: Log indices are below this, so block and index fit in one long.
_BLOCK = 1 << 20


def positioned(events: DataFrame) -> DataFrame:
    return events.withColumn("pos", F.col("block_number") * _BLOCK + F.col("log_index"))


def with_epoch(events: DataFrame) -> DataFrame:
    """Positioned events with the number of resets before each (``epoch``) and at all (``last_epoch``); a reset itself still has
    the old epoch."""
    return running_sum(events, "pos", F.col("kind") == "RegistryReset", "epoch", inclusive=False, total="last_epoch")


def current_epoch(events: DataFrame) -> DataFrame:
    """One row: ``epoch, resettable``; once resettable, always so."""
    n = F.count_if(F.col("kind") == "RegistryReset")
    return events.agg(n.alias("epoch"), (n > 0).alias("resettable"))


def of_last_epoch(folded: DataFrame) -> DataFrame:
    """The events of the current epoch; a fold over them alone gives the current tables."""
    return folded.where(F.col("epoch") == F.col("last_epoch"))


def bodies(folded: DataFrame) -> DataFrame:
    """``epoch, body_id, owner, first_owner, body_commitment, revoked, registered_at, registered_pos``, for every epoch.

    The first registration counts; a transfer or revocation before it has no effect; transfers keep the registration.
    """
    e = folded.where(F.col("kind").isin("BodyRegistered", "BodyTransferred", "BodyRevoked"))
    is_reg, is_transfer, is_revoke = (F.col("kind") == k for k in ("BodyRegistered", "BodyTransferred", "BodyRevoked"))
    first = lambda c: F.min_by(F.when(is_reg, F.col(c)), F.when(is_reg, F.col("pos")))
    owner = F.when(is_reg, F.col("owner")).when(is_transfer, F.col("to_address"))
    out = e.groupBy("epoch", "body_id").agg(
        F.max_by(owner, F.when(~is_revoke, F.col("pos"))).alias("owner"), first("owner").alias("first_owner"), first("body_commitment").alias("body_commitment"),
        F.min(F.when(is_reg, F.col("pos"))).alias("registered_pos"), F.max(F.when(is_revoke, F.col("pos"))).alias("__revoked"), first("block_timestamp").alias("registered_at"),
    )
    out = out.where("registered_pos IS NOT NULL").withColumn("body_commitment", null_if_zero("body_commitment"))
    return out.withColumn("revoked", F.coalesce(F.col("__revoked") > F.col("registered_pos"), F.lit(False))).drop("__revoked")


def bodies_current(folded: DataFrame) -> DataFrame:
    return bodies(of_last_epoch(folded))


def images(folded: DataFrame) -> DataFrame:
    """First registration of each image in each epoch; a parent counts only if it was registered earlier in that epoch."""
    e = folded.where(F.col("kind") == "ImageRegistered")
    columns = ["body_id", "perceptual_hash", "parent_hash", "level", "metadata_hmac", "pce", "block_timestamp", "tx_hash"]
    first = e.groupBy("epoch", "image_hash").agg(F.min("pos").alias("pos"), *[F.min_by(c, "pos").alias(c) for c in columns])
    first = first.withColumnRenamed("block_timestamp", "registered_at").withColumn("metadata_hmac", null_if_zero("metadata_hmac"))
    parents = first.select(F.col("epoch").alias("__e"), F.col("image_hash").alias("__h"), F.col("pos").alias("__p"))
    linked = first.join(parents, (F.col("epoch") == F.col("__e")) & (null_if_zero("parent_hash") == F.col("__h")) & (F.col("__p") < F.col("pos")), "left")
    return linked.withColumn("parent", F.col("__h")).drop("__e", "__h", "__p", "parent_hash")


def images_current(folded: DataFrame) -> DataFrame:
    return images(of_last_epoch(folded))


def sessions(folded: DataFrame) -> DataFrame:
    e = folded.where(F.col("kind") == "SessionCommitted")
    return e.groupBy("epoch", "session_id").agg(*[F.min_by(c, "pos").alias(c) for c in ("merkle_root", "frame_count")], F.min_by("block_timestamp", "pos").alias("committed_at"))


def commits(folded: DataFrame) -> DataFrame:
    """Every commit with its global index, which resets don't rewind, and the image its content id names."""
    e = running_sum(folded.where(F.col("kind") == "Commit"), "pos", F.lit(1), "commit_index", inclusive=False)
    return e.select(
        event_id("tx_hash", "log_index").alias("id"), "epoch", "commit_index", "recorder", "asset_cid", "commit_data", "block_number", "pos", F.col("block_timestamp").alias("timestamp"), "tx_hash",
        image_of_content_id("asset_cid").alias("image"),
    )


def commits_by_cid(committed: DataFrame) -> DataFrame:
    """Of each epoch and content id, the number of commits and their indices in order."""
    return committed.groupBy("epoch", "asset_cid").agg(F.count(F.lit(1)).alias("n_commits"), F.sort_array(F.collect_list("commit_index")).alias("indices"))


def attestations(folded: DataFrame) -> DataFrame:
    return folded.where(F.col("kind") == "Attested").select(event_id("tx_hash", "log_index").alias("id"), "epoch", "subject", F.col("by_address").alias("attester"), "attest_kind", "data_hash", F.col("block_timestamp").alias("timestamp"))


def challenges(folded: DataFrame) -> DataFrame:
    return folded.where(F.col("kind") == "Challenged").select(event_id("tx_hash", "log_index").alias("id"), "epoch", "subject", F.col("by_address").alias("challenger"), "evidence_hash", F.col("block_timestamp").alias("timestamp"))


def owner_as_of(folded: DataFrame, at: DataFrame) -> DataFrame:
    """``at`` (``epoch, body_id, pos``) with the body's owner just before each position, and whether it was revoked by then.

    As in ``bodies``, what happens before a body's first registration has no effect.
    """
    first = folded.where(F.col("kind") == "BodyRegistered").groupBy("epoch", "body_id").agg(F.min("pos").alias("__first"))
    since = folded.where(F.col("kind").isin("BodyRegistered", "BodyTransferred", "BodyRevoked")).join(first, ["epoch", "body_id"]).where("pos >= __first")
    e = since.where("kind != 'BodyRevoked'").select("epoch", "body_id", "pos", F.coalesce("to_address", "owner").alias("__owner"))
    keyed = lambda df: df.withColumn("__key", F.concat_ws("|", F.col("epoch").cast("string"), "body_id"))
    out = as_of(keyed(at), keyed(e).select("__key", F.col("pos").alias("__pos"), "__owner"), "__key", "pos", change_pos="__pos", values={"__owner": "owner_then"})
    revoked = since.where("kind = 'BodyRevoked'").groupBy("epoch", "body_id").agg(F.min("pos").alias("__revoked"))
    out = out.join(revoked, ["epoch", "body_id"], "left")
    return out.withColumn("revoked_then", F.coalesce(F.col("__revoked") < F.col("pos"), F.lit(False))).drop("__key", "__revoked")


def earliest_commits(folded: DataFrame) -> DataFrame:
    """``image, tx_hash, block_number`` of the first commit that names each image."""
    e = folded.where(F.col("kind") == "Commit").select("pos", "tx_hash", "block_number", image_of_content_id("asset_cid").alias("image")).where("image IS NOT NULL")
    return e.groupBy("image").agg(F.min_by("tx_hash", "pos").alias("tx_hash"), F.min("block_number").alias("block_number"))


def registration_checks(folded: DataFrame) -> DataFrame:
    """``block_number, error`` of each registration of an image in a trusted log: the checks in their order."""
    calls = folded.where("kind = 'ImageRegistered'").select("epoch", "body_id", "image_hash", "level", "pos", "block_number")
    b = bodies(folded).select("epoch", "body_id", "registered_pos")
    revoked = folded.where("kind = 'BodyRevoked'").select("epoch", "body_id", F.col("pos").alias("__r")).join(b, ["epoch", "body_id"]).where("__r > registered_pos").groupBy("epoch", "body_id").agg(F.min("__r").alias("revoked_pos"))
    first = calls.groupBy("epoch", "image_hash").agg(F.min("pos").alias("first_pos"))
    out = calls.join(b, ["epoch", "body_id"], "left").join(revoked, ["epoch", "body_id"], "left").join(first, ["epoch", "image_hash"])
    error = (
        F.when(F.col("registered_pos").isNull() | (F.col("registered_pos") > F.col("pos")), "unknown body").when(F.col("revoked_pos") < F.col("pos"), "body revoked")
        .when(F.col("first_pos") < F.col("pos"), "image already registered").when(F.col("level") > 2, "modification level out of range")
    )
    return out.select("block_number", error.alias("error"))

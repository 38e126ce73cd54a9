"""Point lookups and nested views over the current entity tables.

Ids are lower-cased before they are compared; every ``limit`` comes with an order, so results don't depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from luxtrace.functions import labels, words
from luxtrace.operators import event_fold

#: Rows of index scans, as in the read API.
SCANNED = 1000


def _equal(column: str, value: str) -> Column:
    return F.col(column) == F.lit(value.lower())


def image(images: DataFrame, image_hash: str) -> DataFrame:
    return images.where(_equal("image_hash", image_hash))


def images_like(images: DataFrame, perceptual_hash: str, limit: int = 10) -> DataFrame:
    """Images with just this perceptual hash."""
    return images.where(_equal("perceptual_hash", perceptual_hash)).orderBy("image_hash").limit(limit)


def body(bodies: DataFrame, key: str) -> DataFrame:
    """A body by id, else by commitment (the smallest id, if several)."""
    found = bodies_by_key(bodies, bodies.sparkSession.createDataFrame([(key,)], "key string"))
    return bodies.join(found.select("body_id"), "body_id", "left_semi")


def bodies_by_key(bodies: DataFrame, keys: DataFrame) -> DataFrame:
    """``key, body_id, found_by`` of each ``key``: by id, else by commitment (the smallest id, if several), else none."""
    by_id = bodies.select(F.lower("body_id").alias("__k"), F.col("body_id").alias("__id"))
    by_commitment = bodies.where("body_commitment IS NOT NULL").groupBy(F.lower("body_commitment").alias("__c")).agg(F.min("body_id").alias("__of"))
    out = keys.select("key").join(by_id, F.lower("key") == F.col("__k"), "left").join(by_commitment, F.lower("key") == F.col("__c"), "left")
    return out.select("key", F.coalesce("__id", "__of").alias("body_id"), F.when(F.col("__id").isNotNull(), "id").when(F.col("__of").isNotNull(), "commitment").otherwise("none").alias("found_by"))


def with_images(bodies: DataFrame, images: DataFrame, limit: int | None = None) -> DataFrame:
    """Each body with its number of images and its images by time of registration: all, or the first ``limit``.

    They are counted natively; with a limit, they are ranked and cut before any list is made.
    """
    kept = ["registered_at", "image_hash", "level", "pce"]
    of = images.join(bodies.select("body_id"), "body_id", "left_semi").select("body_id", *kept)
    count = of.groupBy("body_id").agg(F.count(F.lit(1)).alias("n_images"))
    first = of if limit is None else of.withColumn("__r", F.row_number().over(Window.partitionBy("body_id").orderBy(*kept))).where(F.col("__r") <= limit)
    nested = first.groupBy("body_id").agg(F.array_sort(F.collect_list(F.struct(*kept))).alias("images"))
    out = bodies.join(count, "body_id", "left").join(nested, "body_id", "left")
    return out.withColumn("n_images", F.coalesce("n_images", F.lit(0)))


def bodies_of(bodies: DataFrame, images: DataFrame, owner: str, limit: int | None = None) -> DataFrame:
    """An owner's bodies by time of registration, each with its images (the first ``limit``, if given) in that order."""
    if not _is_address(owner):
        raise ValueError("not an address")
    return with_images(bodies.where(F.lower("owner") == owner.lower()), images, limit).orderBy("registered_at", "body_id")


def nested_images(images: DataFrame, bodies: DataFrame) -> DataFrame:
    """Each image with its body's owner, its parent and what was made from it (hash and level, in order of hash)."""
    made = images.where("parent IS NOT NULL").groupBy(F.col("parent").alias("__p")).agg(F.array_sort(F.collect_list(F.struct("image_hash", "level"))).alias("derivatives"))
    out = images.join(bodies.select("body_id", "owner"), "body_id", "left").join(made, F.col("image_hash") == F.col("__p"), "left")
    return out.select("image_hash", "level", "owner", "parent", F.coalesce("derivatives", F.array().cast("array<struct<image_hash:string,level:int>>")).alias("derivatives"))


def body_health(bodies: DataFrame, images: DataFrame) -> DataFrame:
    """``body_id, revoked, n_images, first_at, max_pce`` of each body."""
    n = images.groupBy("body_id").agg(F.count(F.lit(1)).alias("n_images"), F.min("registered_at").alias("first_at"), F.max("pce").alias("max_pce"))
    return bodies.join(n, "body_id", "left").select("body_id", "revoked", F.coalesce("n_images", F.lit(0)).alias("n_images"), "first_at", "max_pce")


def _is_address(value: str) -> bool:
    import re

    return re.fullmatch("0x[0-9a-fA-F]{40}", value) is not None


def index_scan(images: DataFrame, limit: int | None = SCANNED) -> DataFrame:
    """What a near search reads: hash and perceptual hash, the first rows by id; None for all."""
    two = images.select("image_hash", "perceptual_hash")
    return two if limit is None else two.orderBy("image_hash").limit(limit)


def images_of(images: DataFrame, bodies: DataFrame, limit: int | None = SCANNED, *, by: tuple[str, ...] = ("body_id",)) -> DataFrame:
    """The images of some bodies, matched ``by`` these columns: as in the read API the first ``limit`` by hash, or all for None."""
    keys = bodies.select(*[F.lower(c).alias(c) if c == "body_id" else c for c in by]).distinct()
    of = images.join(keys, list(by), "left_semi")
    return of if limit is None else of.orderBy("image_hash").limit(limit)


def indexed_block(folded: DataFrame) -> DataFrame:
    """One row: the last block in the log."""
    return folded.agg(F.max("block_number").alias("indexed_block"))


def status(folded: DataFrame, most: int | None = SCANNED) -> DataFrame:
    """One row of counts that tell whether the index is alive; as in the read API counts end at ``most``, None counts all."""
    n = lambda df, name: (df if most is None else df.limit(most)).agg(F.count(F.lit(1)).alias(name))
    parts = [event_fold.current_epoch(folded), indexed_block(folded), n(event_fold.bodies_current(folded), "n_bodies"), n(event_fold.images_current(folded), "n_images")]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out


def lineage(images: DataFrame, image_hash: str) -> DataFrame:
    """An image with its parent and what was made from it, and the same in words."""
    one = image(images, image_hash).select("image_hash", "parent", "level")
    children = images.where(_equal("parent", image_hash)).groupBy("parent").agg(F.sort_array(F.collect_list("image_hash")).alias("children")).withColumnRenamed("parent", "__p")
    out = one.join(children, F.col("image_hash") == F.col("__p"), "left").drop("__p").withColumn("children", F.coalesce("children", F.array().cast("array<string>")))
    return out.withColumn("report", labels.describe_lineage("image_hash", "parent", "children"))


def registration_transactions(folded: DataFrame, claims: DataFrame) -> DataFrame:
    """Which claims (``image_hash, tx_hash``) name a transaction that registered that image."""
    e = folded.where("kind = 'ImageRegistered'").select("image_hash", "tx_hash").distinct().withColumn("confirmed", F.lit(True))
    return claims.join(e, ["image_hash", "tx_hash"], "left").withColumn("confirmed", F.coalesce("confirmed", F.lit(False)))


def record_view(folded: DataFrame, requests: DataFrame, *, chain_id: int, registry: str, page: str = "", page_chain: int = 8453, page_registry: str = "") -> DataFrame:
    """The read API: one row for each requested ``image_hash`` with a status and, if registered, the record.

    400: not 0x and 64 lower-case hex digits. 404: no such image. 200: the record, cacheable for ever only if the registry
    can't be reset and the transaction is known.
    """
    images, bodies = event_fold.images_current(folded), event_fold.bodies_current(folded)
    then = event_fold.owner_as_of(folded, images).select("image_hash", "body_id", "owner_then", "pce", "level", "registered_at", "parent", F.col("tx_hash").alias("__own_tx"))
    now = bodies.select("body_id", F.col("owner").alias("__now"), "revoked")
    first = event_fold.earliest_commits(folded).select("image", "tx_hash")
    out = requests.select("image_hash").join(then, "image_hash", "left").join(now, "body_id", "left").join(first, F.col("image_hash") == F.col("image"), "left")
    out = out.crossJoin(F.broadcast(event_fold.current_epoch(folded).select(F.col("resettable").alias("test_mode"))))  # one row
    found = F.col("registered_at").isNotNull()
    tx = F.when(F.col("tx_hash") == F.col("__own_tx"), F.col("tx_hash"))  # the earliest commit must be the registration's own
    valid = words.is_hash("image_hash")
    link = labels.verify_link(F.lit(chain_id), F.lit(registry), "image_hash", page=page, chain=page_chain, address=page_registry)
    return out.select(
        "image_hash", F.when(~F.coalesce(valid, F.lit(False)), 400).when(found, 200).otherwise(404).alias("status"), found.alias("registered"), "body_id", F.coalesce("owner_then", "__now").alias("owner"), "revoked", "pce",
        F.when(found, labels.level_name("level")).alias("level"), "registered_at", labels.iso_date("registered_at").alias("registered_on"), "parent", tx.alias("tx_hash"), F.when(found, link).alias("verify_url"), (found & ~F.col("test_mode") & tx.isNotNull()).alias("cacheable"), "test_mode",
    )

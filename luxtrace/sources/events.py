"""The registry's event log: as files, and made from the generated tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from luxtrace.functions.words import content_id
from luxtrace.schema import EVENTS


def read_events(spark: SparkSession, path: str, *, start_block: int = 0) -> DataFrame:
    """An event log in Parquet files; the start block is pushed to the scan."""
    return spark.read.schema(EVENTS).parquet(path).where(F.col("block_number") >= start_block)


def word(n: Column, digits: int = 64) -> Column:
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(n)), digits, "0"))


def image_word(n: Column) -> Column:
    return F.concat(F.lit("0x"), F.sha2(F.concat(F.lit("image"), n.cast("string")).cast("binary"), 256))


def generated_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generated ``events`` read as a registry log, one event for each row that stands for one."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"))
    t, k, u = F.col("event_type"), F.col("k"), F.col("user_id")
    kind = (
        F.when((t == "error") & (k == 99), "RegistryReset").when((t == "error") & (k < 10), "BodyRevoked").when((t == "error") & (k < 20), "Challenged").when((t == "error") & (k < 30), "SessionCommitted")
        .when(t == "signup", "BodyRegistered").when((t == "click") & (k < 20), "BodyTransferred").when(t == "purchase", "ImageRegistered").when((t == "click") | ((t == "view") & (k < 50)), "Commit").when(t == "view", "Attested")
    )
    of = lambda *kinds: F.col("kind").isin(*kinds)
    made = e.withColumn("kind", kind).where("kind IS NOT NULL")
    subject = image_word(k % 20)
    columns = {
        "block_number": F.col("event_id"), "log_index": F.lit(0), "tx_hash": F.concat(F.lit("0x"), F.sha2(F.col("event_id").cast("string").cast("binary"), 256)), "block_timestamp": F.unix_timestamp("ts"), "kind": F.col("kind"),
        "body_id": F.when(of("BodyRegistered", "BodyRevoked", "BodyTransferred", "ImageRegistered"), word(u)), "owner": F.when(of("BodyRegistered"), word(u, 40)), "to_address": F.when(of("BodyTransferred"), word((u * 7 + k) % 150, 40)),
        "body_commitment": F.when(of("BodyRegistered"), F.when(k % 2 == 0, word(F.lit(0))).otherwise(word(k))), "image_hash": F.when(of("ImageRegistered"), image_word(u * 100 + k)), "parent_hash": F.when(of("ImageRegistered") & (k % 5 == 0), image_word(u * 100 + (k + 37) % 100)),
        "level": F.when(of("ImageRegistered"), k % 4), "pce": F.when(of("ImageRegistered"), F.floor("value")), "session_id": F.when(of("SessionCommitted"), word(k)), "merkle_root": F.when(of("SessionCommitted"), word(u + 1)), "frame_count": F.when(of("SessionCommitted"), k.cast("long")),
        "recorder": F.when(of("Commit"), word(u, 40)), "asset_cid": F.when(of("Commit"), F.when(t == "view", content_id(image_word(u * 100 + k))).otherwise(F.concat(F.lit("ipfs:"), k.cast("string")))),
        "subject": F.when(of("Attested", "Challenged"), subject), "by_address": F.when(of("Attested", "Challenged"), word(u, 40)), "attest_kind": F.when(of("Attested"), word(k % 3)),
    }
    types = {f.name: f.dataType for f in EVENTS}
    log = made.select(*[columns.get(n, F.lit(None)).cast(d).alias(n) for n, d in types.items()])
    # A registration emits a commit of the image in the same transaction.
    own = log.where("kind = 'ImageRegistered'")
    commit = {"kind": F.lit("Commit"), "log_index": F.lit(1), "recorder": F.concat(F.lit("0x"), F.right("body_id", F.lit(40))), "asset_cid": content_id("image_hash")}
    shared = ("block_number", "tx_hash", "block_timestamp")
    return log.union(own.select(*[commit.get(n, F.col(n) if n in shared else F.lit(None)).cast(d).alias(n) for n, d in types.items()]))

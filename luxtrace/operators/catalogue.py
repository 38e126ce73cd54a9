"""The local catalogue of photographs: statistics, listing, search, and merges with new rows and with the chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LISTED = 500


def statistics(catalogue: DataFrame) -> DataFrame:
    """One row of counts and ranges; descriptions are counted where they are neither null nor empty, null over no rows."""
    return catalogue.agg(
        F.count(F.lit(1)).alias("n_images"), F.countDistinct("session_id").alias("n_sessions"), F.countDistinct("body_id").alias("n_bodies"), F.min("pce").alias("min_pce"), F.max("pce").alias("max_pce"), F.avg("pce").alias("avg_pce"),
        F.sum(F.when(F.col("description") != "", 1).when(F.col("description") == "", 0)).alias("n_described"), F.min("registered_at").alias("first_at"), F.max("registered_at").alias("last_at"),
    )


def per_body(catalogue: DataFrame) -> DataFrame:
    return catalogue.groupBy("body_name").agg(F.count(F.lit(1)).alias("n_images")).orderBy(F.desc("n_images"), F.asc_nulls_first("body_name"))


def listing(catalogue: DataFrame, limit: int = LISTED) -> DataFrame:
    """The newest rows; rows without a time come last, ties in order of hash."""
    return catalogue.orderBy(F.desc_nulls_last("registered_at"), F.asc("image_hash")).limit(limit)


def search(catalogue: DataFrame, text: str, body_id: str | None = None) -> DataFrame:
    """Rows whose file or body name holds ``text`` in any case, of one body if given."""
    hit = F.lit(False)
    for c in ("file_name", "body_name"):
        hit = hit | F.coalesce(F.lower(c).contains(text.lower()), F.lit(False))
    out = catalogue.where(hit)
    return out if body_id is None else out.where(F.col("body_id") == body_id)


def upsert(catalogue: DataFrame, new: DataFrame, order: Column | str) -> DataFrame:
    """``catalogue`` with ``new`` rows (the last of each hash in ``order`` counts).

    For a known hash only names and paths are replaced, and transaction and session filled in where given; the score, caption
    and times of the first row stay.
    """
    last = new.withColumn("__r", F.row_number().over(Window.partitionBy("image_hash").orderBy(F.desc(order) if isinstance(order, str) else order.desc()))).where("__r = 1")
    n = last.select(F.col("image_hash").alias("__n"), *[F.col(c).alias(f"__{c}") for c in catalogue.columns if c != "image_hash"])
    both = catalogue.join(n, F.col("image_hash") == F.col("__n"), "full_outer")
    old, got = F.col("image_hash").isNotNull(), F.col("__n").isNotNull()

    def merged(c: str) -> Column:
        if c == "image_hash":
            return F.coalesce("image_hash", "__n")
        if c in ("file_name", "file_path"):
            return F.when(got, F.col(f"__{c}")).otherwise(F.col(c))
        if c in ("tx_hash", "session_id"):
            return F.coalesce(f"__{c}", c)
        return F.when(old, F.col(c)).otherwise(F.col(f"__{c}"))

    return both.select(*[merged(c).alias(c) for c in catalogue.columns])


def describe(catalogue: DataFrame, captions: DataFrame) -> DataFrame:
    """``catalogue`` with the captions (``image_hash, description``) of rows that exist; others are ignored."""
    c = captions.select(F.col("image_hash").alias("__h"), F.col("description").alias("__d"))
    return catalogue.join(c, F.col("image_hash") == F.col("__h"), "left").withColumn("description", F.when(F.col("__h").isNotNull(), F.col("__d")).otherwise(F.col("description"))).drop("__h", "__d")


def known(catalogue: DataFrame, captions: DataFrame) -> DataFrame:
    """Whether each caption's image exists."""
    rows = catalogue.select("image_hash").distinct().withColumn("found", F.lit(True))
    return captions.join(rows, "image_hash", "left").select("image_hash", F.coalesce("found", F.lit(False)).alias("found"))


def clear(catalogue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An empty catalogue, and one row with the number of rows removed."""
    return catalogue.limit(0), catalogue.agg(F.count(F.lit(1)).alias("removed"))


def sync(catalogue: DataFrame, bodies: DataFrame, images: DataFrame, indexed_block: int) -> DataFrame:
    """The catalogue after reading the index: ``bodies`` (``body_id, body_name``) and their ``images``.

    Chain fields come from the index, names and captions stay. A row of one of the bodies that the index lacks goes, unless
    its block is above ``indexed_block`` (not indexed yet). Rows of other bodies are left alone.
    """
    low = lambda c: F.lower(F.col(c))
    names = bodies.select(low("body_id").alias("__b"), F.col("body_name").alias("__name"))
    chain = images.select(low("image_hash").alias("__h"), low("perceptual_hash").alias("__p"), low("body_id").alias("__body"), F.col("pce").cast("double").alias("__pce"), F.col("registered_at").cast("long").alias("__at"))
    chain = chain.join(names, F.col("__body") == F.col("__b"), "left").drop("__b")
    of_these = names.select(F.col("__b").alias("__own"))
    both = catalogue.join(of_these, low("body_id") == F.col("__own"), "left").join(chain, low("image_hash") == F.col("__h"), "full_outer")
    stale = F.col("block_number").isNull() | (F.col("block_number") <= indexed_block)
    kept = both.where(F.col("__h").isNotNull() | F.col("__own").isNull() | ~stale)
    fields = {"perceptual_hash": "__p", "body_id": "__body", "body_name": "__name", "pce": "__pce", "registered_at": "__at"}
    out = []
    for c in catalogue.columns:
        if c == "image_hash":
            out.append(F.coalesce("image_hash", "__h").alias(c))
        elif c in fields:
            out.append(F.when(F.col("__h").isNotNull(), F.col(fields[c])).otherwise(F.col(c)).alias(c))
        elif c == "description":
            out.append(F.when(F.col("image_hash").isNull(), F.lit("")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return kept.select(*out)


def needs_attention(enrolled: DataFrame, bodies: DataFrame) -> DataFrame:
    """Enrolled cameras that the registry lacks or has revoked; ids are compared without case and 0x."""
    key = lambda c: F.lower(F.regexp_replace(c, "^0[xX]", ""))
    alive = bodies.where("NOT revoked").select(key("body_id").alias("__k"))
    return enrolled.join(alive, key("body_id") == F.col("__k"), "left_anti")


def import_names(existing: DataFrame, stems: DataFrame) -> DataFrame:
    """``stem, name`` of each ``stem``: the stem itself, or the first of ``stem-2``, ``stem-3`` … that no file in ``existing`` (``name``) has.

    A name is taken apart at its last number, so names meet stems by equality. The first free number is 1 or follows one that
    is taken, so it is the least of those that aren't taken themselves.
    """
    ending = r"^(.*)-([1-9][0-9]{0,17})$"
    numbered = existing.where(F.col("name").rlike(ending)).select(F.regexp_extract("name", ending, 1).alias("stem"), F.regexp_extract("name", ending, 2).cast("long").alias("k"))
    own = stems.select("stem").distinct()
    taken = existing.select(F.col("name").alias("stem"), F.lit(1).cast("long").alias("k")).union(numbered).join(own, "stem", "left_semi").distinct()
    next_to = taken.select("stem", F.col("k") + 1).union(own.select("stem", F.lit(1).cast("long"))).toDF("stem", "k")
    free = next_to.join(taken, ["stem", "k"], "left_anti").groupBy("stem").agg(F.min("k").alias("k"))
    return free.select("stem", F.when(F.col("k") == 1, F.col("stem")).otherwise(F.concat_ws("-", "stem", F.col("k").cast("string"))).alias("name"))


def import_name(existing: DataFrame, stem: str) -> str:
    """The same for one import."""
    return import_names(existing, existing.sparkSession.createDataFrame([(stem,)], "stem string")).first()["name"]


def serials_disagree(frames: DataFrame) -> DataFrame:
    """Folders (``folder, serial``) whose frames name more than one serial number, with the numbers."""
    named = frames.where("serial IS NOT NULL AND trim(serial) != ''")
    return named.groupBy("folder").agg(F.sort_array(F.collect_set("serial")).alias("serials")).where(F.size("serials") > 1)


def ready(checks: DataFrame) -> DataFrame:
    """One row: whether all checks (``name, go``) pass, and which don't; a null counts as no."""
    go = F.coalesce("go", F.lit(False))
    return checks.agg(F.coalesce(F.bool_and(go), F.lit(True)).alias("ready"), F.sort_array(F.collect_list(F.when(~go, F.col("name")))).alias("missing"))

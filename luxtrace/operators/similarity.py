"""Pairs of 64-bit perceptual hashes within a Hamming distance.

Three ways with equal results. ``near_by_scan`` compares each probe with each row and is for an index that is small enough to
send to every task. ``near_by_bands`` cuts the 64 bits into six bands: two hashes within ten bits agree in some band up to one
bit, so each probe asks for its band values with at most one bit flipped, an equality join that Spark deals out by value; some
4.5 % of the index are compared. ``near_by_wide_bands`` has three bands of 23, 22 and 19 bits and up to three flips. Two
hashes of different parity are an odd number of bits apart, so nine at most, and the second band needs a flip less there; the
parity is part of the key. One of the flips is the index's, so a probe asks for 871 values, an index row has 67, and a probe is
compared with less than 0.1 % of a large index. Four bands of 16 bits (``MIDDLE``) ask for 88 and compare some 0.6 %.

Values meet in a sort-merge join, always: Spark takes the rows for as small as they are before they become hundreds, and would
send them to every task by way of the driver.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from luxtrace.functions.hashing import hamming
from luxtrace.schema import HAMMING_RADIUS

#: First bit and width of each band.
BANDS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
#: First bit and width of each wide band, and most flips between hashes of equal and of different parity.
WIDE = ((0, 23, 3, 3), (23, 22, 3, 2), (45, 19, 2, 2))
#: The same for an index of middle size.
MIDDLE = ((0, 16, 2, 2), (16, 16, 2, 2), (32, 16, 2, 1), (48, 16, 1, 1))
#: Most rows of an index that may go to every task; rows up to which ``near_matches`` scans and asks by middle bands.
SCAN_ROWS, FEW_ROWS, BAND_ROWS = 50_000, 2_000, 2_000_000


def near_by_scan(probes: DataFrame, index: DataFrame, radius: int = HAMMING_RADIUS) -> DataFrame:
    """``probes`` (``probe_id, probe_hash``) × ``index`` (``image_id, image_hash64``) within ``radius``; null hashes match nothing.

    The index has at most ``SCAN_ROWS`` rows; a larger one is an error.
    """
    if index.limit(SCAN_ROWS + 1).count() > SCAN_ROWS:
        raise ValueError("the index is too large to go to every task")
    return _scan(probes, index, radius)


def _scan(probes: DataFrame, index: DataFrame, radius: int) -> DataFrame:
    return probes.join(F.broadcast(index), hamming("probe_hash", "image_hash64") <= radius).select("probe_id", "image_id", hamming("probe_hash", "image_hash64").alias("distance"))


def _bands(df: DataFrame, column: str) -> DataFrame:
    parts = [F.struct(F.lit(i).alias("band"), F.shiftrightunsigned(F.col(column), at).bitwiseAND((1 << n) - 1).cast("int").alias("value"), F.lit(n).alias("bits")) for i, (at, n) in enumerate(BANDS)]
    return df.withColumn("__b", F.explode(F.array(*parts)))


def near_by_bands(probes: DataFrame, index: DataFrame, radius: int = HAMMING_RADIUS) -> DataFrame:
    """As ``near_by_scan``; for a radius of at most eleven."""
    if radius >= 2 * len(BANDS):
        raise ValueError("the bands find pairs within eleven bits")
    flips = F.concat(F.array(F.col("__b.value")), F.transform(F.sequence(F.lit(0), F.col("__b.bits") - 1), lambda i: F.col("__b.value").bitwiseXOR(F.call_function("shiftleft", F.lit(1), i))))
    asked = _bands(probes.where("probe_hash IS NOT NULL"), "probe_hash").select("probe_id", "probe_hash", F.col("__b.band").alias("band"), F.explode(flips).alias("value"))
    held = _bands(index.where("image_hash64 IS NOT NULL"), "image_hash64").select("image_id", "image_hash64", F.col("__b.band").alias("band"), F.col("__b.value").alias("value"))
    close = asked.hint("merge").join(held, ["band", "value"]).where(hamming("probe_hash", "image_hash64") <= radius)
    # A pair is kept in the first band in which it agrees up to one bit, so no pair comes twice.
    differ = F.col("probe_hash").bitwiseXOR(F.col("image_hash64"))
    first = F.coalesce(*[F.when(F.bit_count(F.shiftrightunsigned(differ, at).bitwiseAND((1 << n) - 1)) <= 1, F.lit(i)) for i, (at, n) in enumerate(BANDS)])
    return close.where(first == F.col("band")).select("probe_id", "image_id", hamming("probe_hash", "image_hash64").alias("distance"))


def _key(band: int, value: Column, parity: Column) -> Column:
    return (value.cast("int") + parity * F.lit(1 << 23) + F.lit(band << 24)).cast("int")


def _band(hash64: str, at: int, width: int) -> Column:
    return F.shiftrightunsigned(F.col(hash64), at).bitwiseAND((1 << width) - 1).cast("int")


def _masks(width: int, most: int) -> Column:
    return F.expr("array(" + ", ".join(str(sum(1 << k for k in c)) for n in range(most + 1) for c in combinations(range(width), n)) + ")")


def _wide_pairs(probes: DataFrame, index: DataFrame, plan: tuple[tuple[int, int, int, int], ...] = WIDE) -> DataFrame:
    """``probe_id, probe_hash, image_id, image_hash64, band`` of all pairs that are compared, once for each band.

    Flips are shared out: the index holds each value with at most one flip, and a probe asks with one flip less than the plan
    allows. Of the ways in which a pair then meets in a band one counts: the index's flip is the lowest bit of the difference
    if that has as many bits as the plan allows, else none. So a probe asks for some hundred values, not thousands.
    """
    asked, held = [], []
    own, its = ((F.bit_count(F.col(c)) % 2).cast("int") for c in ("probe_hash", "image_hash64"))
    for band, (at, width, same, other) in enumerate(plan):
        value, held_value = _band("probe_hash", at, width), _band("image_hash64", at, width)
        for flips, parity in ((same, own), (other, 1 - own)):
            base = _key(band, F.lit(0), parity)
            asked.append(F.transform(_masks(width, flips - 1), lambda m: value.bitwiseXOR(m) + base))  # noqa: B023  evaluated at once
        key = _key(band, F.lit(0), its)
        held.append(F.transform(_masks(width, 1), lambda m: F.struct((held_value.bitwiseXOR(m) + key).alias("held"), m.alias("flip"))))  # noqa: B023
    spark = probes.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # A few small files are dealt out before they become hundreds of rows each.
    dealt = lambda df, i, h: df.where(F.col(h).isNotNull()).select(i, h).repartition(tasks, i)
    left = dealt(probes, "probe_id", "probe_hash").select("probe_id", "probe_hash", F.explode(F.concat(*asked)).alias("key"))
    right = dealt(index, "image_id", "image_hash64").select("image_id", "image_hash64", F.explode(F.concat(*held)).alias("h")).select("image_id", "image_hash64", "h.held", "h.flip")
    differ = F.col("probe_hash").bitwiseXOR(F.col("image_hash64"))
    flip = F.lit(None).cast("int")
    for band, (at, width, same, other) in enumerate(plan):
        own_bits = F.shiftrightunsigned(differ, at).bitwiseAND((1 << width) - 1).cast("int")
        most = F.when(F.bit_count(differ) % 2 == 0, F.lit(same)).otherwise(F.lit(other))
        flip = F.when(F.shiftright("key", 24) == band, F.when(F.bit_count(own_bits) < most, 0).otherwise(own_bits.bitwiseAND(-own_bits))).otherwise(flip)
    return left.hint("merge").join(right, (F.col("key") == F.col("held")) & (F.col("flip") == flip)).withColumn("band", F.shiftright("key", 24)).drop("key", "held", "flip")


def near_by_wide_bands(probes: DataFrame, index: DataFrame, radius: int = HAMMING_RADIUS, plan: tuple[tuple[int, int, int, int], ...] = WIDE) -> DataFrame:
    """As ``near_by_scan``; for a radius of at most ten. ``plan`` is WIDE or MIDDLE."""
    if radius > 10:
        raise ValueError("the wide bands find pairs within ten bits")
    differ = F.col("probe_hash").bitwiseXOR(F.col("image_hash64"))
    close = _wide_pairs(probes, index, plan).where(F.bit_count(differ) <= radius)
    # A pair is kept in the first band that asks for it, so no pair comes twice.
    most = lambda same, other: F.when(F.bit_count(differ) % 2 == 0, F.lit(same)).otherwise(F.lit(other))
    first = F.coalesce(*[F.when(F.bit_count(F.shiftrightunsigned(differ, at).bitwiseAND((1 << n) - 1)) <= most(same, other), F.lit(i)) for i, (at, n, same, other) in enumerate(plan)])
    return close.where(first == F.col("band")).select("probe_id", "image_id", hamming("probe_hash", "image_hash64").alias("distance"))


def compared(probes: DataFrame, index: DataFrame) -> DataFrame:
    """One row: ``compared`` pairs of the wide bands, and ``possible`` pairs."""
    pairs = _wide_pairs(probes, index).agg(F.count(F.lit(1)).alias("compared"))
    n = lambda df, c, name: df.agg(F.count(c).alias(name))
    sizes = n(probes, "probe_hash", "__p").crossJoin(n(index, "image_hash64", "__i"))  # one row each
    return pairs.crossJoin(sizes).select("compared", (F.col("__p") * F.col("__i")).alias("possible"))


def near_matches(probes: DataFrame, index: DataFrame, radius: int = HAMMING_RADIUS) -> DataFrame:
    """By scan if the index has at most ``FEW_ROWS`` rows, by middle bands up to ``BAND_ROWS``, else by wide bands."""
    n = index.limit(BAND_ROWS + 1).count()
    if n <= FEW_ROWS:
        return _scan(probes, index, radius)
    if radius > 10:
        return near_by_bands(probes, index, radius)
    return near_by_wide_bands(probes, index, radius, MIDDLE if n <= BAND_ROWS else WIDE)


def ranked(matches: DataFrame, most: int | None = None) -> DataFrame:
    """``rank`` by distance, then id, for each probe; only the first ``most`` if given."""
    out = matches.withColumn("rank", F.row_number().over(Window.partitionBy("probe_id").orderBy("distance", "image_id")))
    return out if most is None else out.where(F.col("rank") <= most)


def nearest(matches: DataFrame) -> DataFrame:
    """The nearest image of each probe, the smallest id at a tie."""
    best = F.min(F.struct("distance", "image_id")).alias("m")
    return matches.groupBy("probe_id").agg(best).select("probe_id", "m.image_id", "m.distance")

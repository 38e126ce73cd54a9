"""Running sums over one global order without putting all rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a range that the order is cut into, about, and most ranges.
ROWS, MOST = 1 << 20, 4096


def running_sum(df: DataFrame, pos: str, value: Column, name: str, *, inclusive: bool = True, total: str | None = None, ranges: int | None = None) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows up to (or before) each row in order of ``pos``.

    ``pos`` is a unique number. The order is cut at approximate quantiles into as many ranges as the rows need (they are
    counted); each range is summed on its own and the few sums are added up in order, so no task holds more than a range. With
    ``total``, each row gets the sum over all rows as well.
    """
    if ranges is None:
        ranges = min(MOST, -(-df.select(pos).count() // ROWS))
    cuts = sorted(set(df.approxQuantile(pos, [k / ranges for k in range(1, ranges)], 1 / (4 * ranges)))) if ranges > 1 else []
    spread = df.withColumn("__v", value.cast("long")).withColumn("__r", _range_of(F.col(pos), cuts))
    before = Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range at most
    whole = [F.sum("__s").over(Window.partitionBy(F.lit(0))).alias(total)] if total else []
    sums = spread.groupBy("__r").agg(F.sum("__v").alias("__s")).select("__r", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__base"), *whole)
    within = Window.partitionBy("__r").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    own = F.coalesce(F.sum("__v").over(within), F.lit(0))
    return spread.withColumn("__own", own).join(F.broadcast(sums), "__r").withColumn(name, F.col("__base") + F.col("__own")).drop("__v", "__r", "__own", "__base")


def _range_of(pos: Column, cuts: list[float]) -> Column:
    """How many cuts are at or below ``pos``, by halving: as many steps for each row as the number of cuts has digits."""
    if not cuts:
        return F.lit(0)
    held = F.expr(f"array({', '.join(f'{float(c)!r}D' for c in cuts)})")
    steps = F.expr(f"array({', '.join(str(1 << k) for k in reversed(range(len(cuts).bit_length())))})")
    return F.aggregate(steps, F.lit(0), lambda below, k: F.when(F.get(held, below + k - 1) <= pos.cast("double"), below + k).otherwise(below))


def as_of(events: DataFrame, changes: DataFrame, key: str, pos: str, *, change_pos: str, values: dict[str, str]) -> DataFrame:
    """``events`` with the ``values`` (column of ``changes`` to new name) of the last change of the same key before each.

    Changes become intervals, and events join the interval that holds them: an equality join on the key with a range
    condition, which Spark can split where one key has very many events.
    """
    w = Window.partitionBy(key).orderBy(change_pos)
    intervals = changes.select(F.col(key).alias("__k"), F.col(change_pos).alias("__from"), F.lead(change_pos).over(w).alias("__to"), *[F.col(c).alias(n) for c, n in values.items()])
    on = (F.col(key) == F.col("__k")) & (F.col(pos) > F.col("__from")) & (F.col("__to").isNull() | (F.col(pos) <= F.col("__to")))
    return events.join(intervals, on, "left").drop("__k", "__from", "__to")

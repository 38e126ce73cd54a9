"""The triangle test: do two images share more than a camera?

Frames come as rows of arrays and are cut into blocks once. A block of one frame meets the block of the other at the same
place, once a pair; what leaves the task are a few sums for each block and pair. Predictions, the calibration on pairs that are
known to be unrelated, and each pair's distance from it are native aggregates of those sums in the same plan.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from luxtrace.operators.raster.evaluation import BLOCK
from luxtrace.operators.raster.frames import _map
from luxtrace.operators.statistics import calibration, triangle_d

_TINY = 1e-30


def frame_blocks(frames: DataFrame, edge: int = BLOCK) -> DataFrame:
    """Blocks of ``frames`` (``frame_id, h, w, light, noise, k``: samples, residual and fingerprint, row by row).

    ``frame_id, by, bx, whole``, the arrays ``light`` and ``noise``, and of the block ``mean`` and ``attenuation``; then sums for
    the frame's correlation with the fingerprint. Blocks at the right and lower border that aren't ``whole`` count in
    correlations only.
    """
    kind = dict(frames.dtypes)["frame_id"]

    def cut_up(r) -> list[dict]:
        light, noise, k = (np.asarray(a, np.float64).reshape(r.h, r.w) for a in (r.light, r.noise, r.k))
        out = []
        for y in range(0, r.h, edge):
            for x in range(0, r.w, edge):
                i, n, f = (a[y : y + edge, x : x + edge] for a in (light, noise, k))
                e = i * f
                dn, de = n - n.mean(), e - e.mean()
                fit = float((dn * de).sum()) / np.sqrt(max(float((dn * dn).sum() * (de * de).sum()), _TINY))
                size = np.sqrt((n * n).sum()) / max(np.sqrt((i * i).mean()) * np.sqrt((f * f).sum()), _TINY)
                sums = {"n": n.size, "sn": float(n.sum()), "sk": float(f.sum()), "snn": float((n * n).sum()), "skk": float((f * f).sum()), "snk": float((n * f).sum())}
                out.append({"frame_id": r.frame_id, "by": y // edge, "bx": x // edge, "whole": i.shape == (edge, edge), "light": i.ravel(), "noise": n.ravel(), "mean": float(i.mean()), "attenuation": float(size * fit)} | sums)
        return out

    schema = f"frame_id {kind}, by int, bx int, whole boolean, light array<double>, noise array<double>, mean double, attenuation double, n long, sn double, sk double, snn double, skk double, snk double"
    return _map(frames.select("frame_id", "h", "w", "light", "noise", "k"), cut_up, schema)


def _corr(n: str, sx: str, sy: str, sxx: str, syy: str, sxy: str) -> Column:
    """Correlation from sums; 0 without spread."""
    total = lambda c: F.sum(c)
    top = total(n) * total(sxy) - total(sx) * total(sy)
    spread = (total(n) * total(sxx) - total(sx) ** 2) * (total(n) * total(syy) - total(sy) ** 2)
    return F.when(spread > 0, top / F.sqrt(spread)).otherwise(F.lit(0.0))


def pair_correlations(blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    """``a, b, predicted, observed`` of each pair of frames (``a, b``) of equal size.

    The prediction is what two images share if they share the camera alone: both correlations with the fingerprint times a
    factor for common content. Pairs are joined to frames by block, so each block travels once for each pair it is in.
    """
    side = lambda s: blocks.select(F.col("frame_id").alias(s), "by", "bx", *[F.col(c).alias(f"{c}_{s}") for c in ("whole", "light", "noise", "mean", "attenuation")])
    met = pairs.select("a", "b").join(side("a"), "a").join(side("b"), ["b", "by", "bx"])
    kinds = dict(pairs.dtypes)

    def sums(r) -> dict:
        x, y = np.asarray(r.noise_a), np.asarray(r.noise_b)
        both = r.whole_a and r.whole_b
        mutual = float((np.asarray(r.light_a) * np.asarray(r.light_b)).mean()) if both else 0.0
        own = {"top": r.attenuation_a * r.attenuation_b * mutual, "ma": r.attenuation_a * r.mean_a, "mb": r.attenuation_b * r.mean_b} if both else {"top": 0.0, "ma": 0.0, "mb": 0.0}
        return {"a": r.a, "b": r.b, "blocks": int(both), "n": len(x), "sx": float(x.sum()), "sy": float(y.sum()), "sxx": float(x @ x), "syy": float(y @ y), "sxy": float(x @ y)} | own

    each = _map(met, sums, f"a {kinds['a']}, b {kinds['b']}, blocks int, n long, sx double, sy double, sxx double, syy double, sxy double, top double, ma double, mb double")
    out = each.groupBy("a", "b").agg(_corr("n", "sx", "sy", "sxx", "syy", "sxy").alias("observed"), F.sum("top").alias("top"), (F.sum("ma") * F.sum("mb")).alias("bottom"), F.sum("blocks").alias("blocks"))
    to = blocks.groupBy("frame_id").agg(_corr("n", "sn", "sk", "snn", "skk", "snk").alias("c"))
    out = out.join(to.toDF("a", "ca"), "a").join(to.toDF("b", "cb"), "b")
    predicted = F.when(F.col("bottom") == 0, F.lit(0.0)).otherwise(F.col("ca") * F.col("cb") * F.col("top") * F.col("blocks") / F.col("bottom"))
    return out.select("a", "b", predicted.alias("predicted"), "observed")


def triangle_test(frames: DataFrame, pairs: DataFrame, edge: int = BLOCK) -> DataFrame:
    """``a, b, predicted, observed, d, pearson``: how far each pair (``a, b, innocent``) is above the calibrated line, in spreads.

    The line goes through the pairs that are known to be unrelated (``innocent``), of which there must be two at least; else, or
    without spread, ``d`` is 0. A low ``pearson`` means that no ``d`` says anything.
    """
    found = pair_correlations(frame_blocks(frames, edge), pairs).join(pairs.select("a", "b", "innocent"), ["a", "b"])
    line = calibration(found.where("innocent").withColumn("__all", F.lit(1)), "__all", "predicted", "observed")
    line = F.broadcast(line.select("slope", "intercept", "residual_std", "pearson"))  # one row at most
    out = found.join(line, F.lit(True), "left")
    return out.select("a", "b", "predicted", "observed", F.coalesce(triangle_d("observed", "predicted", "slope", "intercept", "residual_std"), F.lit(0.0)).alias("d"), "pearson")

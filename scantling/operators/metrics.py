"""Ranking metrics, as plans over score rows and as functions over arrays."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ranking_metrics(scores: DataFrame, by: list[str], max_fpr: float = 0.01, times: Column | int = 1) -> DataFrame:
    """``by, n, n_pos, auroc, recall`` of rows ``by, y, score``; metrics are null where a group has one class only.

    Scores are first counted by value, so that windows run over distinct scores. Recall is the highest true positive rate at a
    false positive rate of at most ``max_fpr`` among the corners of the curve: points on a straight
    line between their neighbours don't count, the origin does. ``times`` is how often each row counts.
    """
    many = times if isinstance(times, Column) else F.lit(times)
    side = lambda y: F.sum(F.when(F.col("y") == y, many).otherwise(0))
    tied = scores.groupBy(*by, "score").agg(side(1).alias("p"), side(0).alias("q"))
    down = Window.partitionBy(*by).orderBy(F.col("score").desc())
    upto = down.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*by)
    curve = tied.select(*by, "p", "q", F.sum("p").over(upto).alias("tp"), F.sum("q").over(upto).alias("fp"), F.sum("p").over(whole).alias("pos"), F.sum("q").over(whole).alias("neg"), F.lead("p").over(down).alias("next_p"), F.lead("q").over(down).alias("next_q"), F.row_number().over(down).alias("i"), F.count("*").over(whole).alias("points"))
    bends = (F.col("points") <= 2) | (F.col("i") == 1) | F.col("next_p").isNull() | (F.col("p") != F.col("next_p")) | (F.col("q") != F.col("next_q"))
    area = F.col("q") * (F.col("tp") - F.col("p") + F.col("p") / F.lit(2.0))
    within = bends & (F.col("fp") <= F.lit(float(max_fpr)) * F.col("neg"))
    sums = curve.groupBy(*by).agg(F.first("pos").alias("pos"), F.first("neg").alias("neg"), F.sum(area).alias("_area"), F.max(F.when(within, F.col("tp")).otherwise(F.lit(0))).alias("_tp"))
    both = (F.col("pos") > 0) & (F.col("neg") > 0)
    return sums.select(*by, (F.col("pos") + F.col("neg")).alias("n"), F.col("pos").alias("n_pos"), F.when(both, F.col("_area") / (F.col("pos") * F.col("neg"))).alias("auroc"), F.when(both, F.col("_tp") / F.col("pos")).alias("recall"))


def areas(scores: DataFrame, by: list[str], times: Column | int = 1) -> DataFrame:
    """``by, auroc`` alone, as in :func:`ranking_metrics`, with one window and no more."""
    many = times if isinstance(times, Column) else F.lit(times)
    side = lambda y: F.sum(F.when(F.col("y") == y, many).otherwise(0))
    tied = scores.groupBy(*by, "score").agg(side(1).alias("p"), side(0).alias("q"))
    down = Window.partitionBy(*by).orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = tied.withColumn("_tp", F.sum("p").over(down)).groupBy(*by).agg(F.sum(F.col("q") * (F.col("_tp") - F.col("p") / F.lit(2.0))).alias("_area"), F.sum("p").alias("_p"), F.sum("q").alias("_q"))
    return summed.select(*by, F.when((F.col("_p") > 0) & (F.col("_q") > 0), F.col("_area") / (F.col("_p") * F.col("_q"))).alias("auroc"))


def auroc(y: np.ndarray, score: np.ndarray, weight: np.ndarray | None = None) -> float:
    """Area under the curve by average ranks; NaN with one class. ``weight``: how often each row counts."""
    return _curve(y, score, weight)[0]


def recall_at(y: np.ndarray, score: np.ndarray, weight: np.ndarray | None = None, max_fpr: float = 0.01) -> float:
    """Recall at a bounded false positive rate, with the corners as in :func:`ranking_metrics`."""
    return _curve(y, score, weight, max_fpr)[1]


def _curve(y: np.ndarray, score: np.ndarray, weight: np.ndarray | None = None, max_fpr: float = 0.01) -> tuple[float, float]:
    w = np.ones(len(y)) if weight is None else np.asarray(weight, float)
    y, score = np.asarray(y)[w > 0], np.asarray(score, float)[w > 0]
    w = w[w > 0]
    order = np.argsort(-score, kind="stable")
    y, score, w = y[order], score[order], w[order]
    if not len(y):
        return float("nan"), float("nan")
    first = np.flatnonzero(np.concatenate([[True], score[1:] != score[:-1]]))
    p, q = np.add.reduceat(w * (y == 1), first), np.add.reduceat(w * (y == 0), first)
    tp, fp = np.cumsum(p), np.cumsum(q)
    if not tp[-1] or not fp[-1]:
        return float("nan"), float("nan")
    area = float((q * (tp - p / 2)).sum() / (tp[-1] * fp[-1]))
    bends = np.ones(len(p), bool)
    if len(p) > 2:
        bends[1:-1] = (p[1:-1] != p[2:]) | (q[1:-1] != q[2:])
    within = bends & (fp <= max_fpr * fp[-1])
    return area, float(tp[within].max(initial=0.0) / tp[-1])


def curves(y: np.ndarray, score: np.ndarray, weights: np.ndarray, max_fpr: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """Area and recall as in :func:`auroc` and :func:`recall_at`, for each row of ``weights`` (draws x rows); NaN where a draw has one class."""
    order = np.argsort(-np.asarray(score, float), kind="stable")
    y, score, weights = np.asarray(y)[order], np.asarray(score, float)[order], weights[:, order]
    if not len(y):
        return np.full(len(weights), np.nan), np.full(len(weights), np.nan)
    first = np.flatnonzero(np.concatenate([[True], score[1:] != score[:-1]]))
    p, q = (np.add.reduceat(weights * (y == label), first, axis=1).astype(float) for label in (1, 0))
    tp, fp = np.cumsum(p, axis=1), np.cumsum(q, axis=1)
    up, down = tp[:, -1:], fp[:, -1:]
    some = p + q > 0  # points of the curve; scores that a draw lacks are none
    n = p.shape[1]
    at = np.where(some, np.arange(n), n)
    after = np.concatenate([np.minimum.accumulate(at[:, ::-1], axis=1)[:, ::-1][:, 1:], np.full((len(p), 1), n)], axis=1)
    ahead = np.minimum(after, n - 1)
    bends = (after == n) | (at == at.min(axis=1, keepdims=True)) | (some.sum(axis=1, keepdims=True) <= 2)
    bends |= (p != np.take_along_axis(p, ahead, 1)) | (q != np.take_along_axis(q, ahead, 1))
    within = some & bends & (fp <= max_fpr * down)
    with np.errstate(invalid="ignore", divide="ignore"):
        area = (q * (tp - p / 2)).sum(axis=1) / (up * down)[:, 0]
        recall = np.where(within, tp, 0.0).max(axis=1) / up[:, 0]
    lacking = (up[:, 0] == 0) | (down[:, 0] == 0)
    area[lacking] = recall[lacking] = np.nan
    return area, recall


METRICS: dict[str, Callable[..., float]] = {"auroc": auroc, "recall_at_1pct_fpr": recall_at}


def efficiency_index(recall_by_k: dict[int, float], ks: list[int]) -> float:
    """Area under recall over k, divided by the width; NaN below two values of k, 0 over no width."""
    points = sorted((k, recall_by_k[k]) for k in ks if k in recall_by_k)
    if len(points) < 2:
        return float("nan")
    width = points[-1][0] - points[0][0]
    return sum((b - a) * (u + v) / 2 for (a, u), (b, v) in zip(points, points[1:])) / width if width else 0.0


#: Weights that the bootstrap holds at a time.
BLOCK = 1_000_000


def bootstrap_difference(y: np.ndarray, a: np.ndarray, b: np.ndarray, metric: str, draws: int, seed: int, strict: bool = False) -> dict[str, float]:
    """Paired bootstrap of metric(a) - metric(b).

    The default keeps draws of one class as NaN, which count in the denominator of the p-value only, and gives the bootstrap
    mean; ``strict`` skips them, bounds p by 1 and gives the observed difference.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    if not len(y) == len(a) == len(b):
        raise ValueError("labels and scores differ in length")
    f = METRICS[metric]
    rng = np.random.default_rng(seed)
    n = len(y)
    which, d = list(METRICS).index(metric), []
    step = max(1, BLOCK // max(n, 1))  # draws at a time: bounds the memory
    for begin in range(0, draws, step):
        weights = np.stack([np.bincount(rng.integers(0, n, size=n), minlength=n) for _ in range(min(step, draws - begin))])
        d.append(curves(y, a, weights)[which] - curves(y, b, weights)[which])
    d = np.concatenate(d) if d else np.zeros(0)
    if strict:
        d = d[~np.isnan(d)]
    some = d[~np.isnan(d)]
    low, high = np.percentile(some, [2.5, 97.5]) if len(some) else (np.nan, np.nan)
    p = 2 * min((d <= 0).mean(), (d >= 0).mean()) if len(d) else np.nan
    whole_a, whole_b = f(y, a), f(y, b)
    mean = whole_a - whole_b if strict else (some.mean() if len(some) else np.nan)
    return {"score_a": whole_a, "score_b": whole_b, "mean_diff": float(mean), "ci_low": float(low), "ci_high": float(high), "p_value": float(min(p, 1.0) if strict else p)}

"""Summary tables over result rows. Groups keep null keys; NaN counts as missing (see ``clean_metrics``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scantling.sources.schemas import METRICS

# The columns of the report tables, in their order.
KEYS = ("scorer", "k", "balance_mode", "model", "layer", "dataset")
AVERAGED = (*METRICS, "wall_clock_s")
SELECTABLE = tuple(f"{m}_mean" for m in METRICS if not m.startswith("ood"))
DECISION = (
    "dataset", "model", "balance_mode", "k", "scorer", "layer", "test_recall_at_1pct_fpr_mean", "test_recall_at_1pct_fpr_std", "test_auroc_mean",
    "test_auroc_std", "ood_recall_at_1pct_fpr_mean", "ood_recall_at_1pct_fpr_std", "ood_auroc_mean", "ood_auroc_std",
)
OOD = ("scorer", "k", "balance_mode", "model", "dataset", "layer", "ood_auroc_mean", "ood_auroc_std", "ood_recall_at_1pct_fpr_mean", "ood_recall_at_1pct_fpr_std")
LAYERS = ("scorer", "k", "balance_mode", "model", "dataset", "layer", "eval_recall_at_1pct_fpr_mean", "test_recall_at_1pct_fpr_mean")


def summary(runs: DataFrame, digits: int | None = None) -> DataFrame:
    """Mean and sample deviation of each metric over seeds; one value has no deviation."""
    shown = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    return runs.groupBy(*KEYS).agg(*(shown(f(m)).alias(f"{m}_{n}") for m in AVERAGED for n, f in (("mean", F.avg), ("std", F.stddev_samp))))


def selection(metric: str) -> str:
    """The column by which layers are chosen; metrics that can't be chosen fall back to recall on eval."""
    return f"{metric}_mean" if f"{metric}_mean" in SELECTABLE else "eval_recall_at_1pct_fpr_mean"


def first_rows(df: DataFrame, by: list[str], metric: str, tie: str) -> DataFrame:
    """The row of the highest metric in each group, of equal ones that of the lowest ``tie``; groups without a metric are dropped."""
    w = Window.partitionBy(*by).orderBy(F.col(metric).desc(), F.col(tie).asc())
    return df.where(F.col(metric).isNotNull()).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def best_layers(table: DataFrame, metric: str = "eval_recall_at_1pct_fpr") -> DataFrame:
    return first_rows(table, ["scorer", "k", "balance_mode", "model", "dataset"], selection(metric), "layer")


def without_metric(table: DataFrame, metric: str = "eval_recall_at_1pct_fpr") -> DataFrame:
    """Groups that :func:`best_layers` drops."""
    return table.groupBy("scorer", "k", "balance_mode", "model", "dataset").agg(F.count(selection(metric)).alias("n"), F.count("*").alias("layers")).where("n = 0").drop("n")


def efficiency(best: DataFrame, ks: list[int]) -> DataFrame:
    """``scorer, balance_mode, model, dataset, fsei, k_min, k_max``: normalised area of test recall over the listed k; null below two k."""
    keys = ["scorer", "balance_mode", "model", "dataset"]
    w = Window.partitionBy(*keys).orderBy("k")
    known = (F.col("test_recall_at_1pct_fpr_mean").isNotNull()) & F.col("k").isin(*ks)
    points = best.select(*keys, F.when(known, F.col("k")).alias("k"), F.when(known, F.col("test_recall_at_1pct_fpr_mean")).alias("r"))
    steps = points.withColumn("area", (F.col("k") - F.lag("k").over(w)) * (F.col("r") + F.lag("r").over(w)) / F.lit(2.0))
    width = F.max("k") - F.min("k")
    fsei = F.when(F.count("k") >= 2, F.when(width > 0, F.sum("area") / width).otherwise(F.lit(0.0)))
    return steps.groupBy(*keys).agg(fsei.alias("fsei"), F.min("k").alias("k_min"), F.max("k").alias("k_max"))


def decisions(best: DataFrame) -> DataFrame:
    """The scorer of highest mean test recall for each dataset, model, balance mode and k."""
    keys = ["dataset", "model", "balance_mode", "k"]
    return first_rows(best, keys, "test_recall_at_1pct_fpr_mean", "scorer").select(*(c for c in DECISION if c in best.columns)).orderBy(*keys)


def ood_table(best: DataFrame) -> DataFrame:
    return best.select(*(c for c in OOD if c in best.columns))


def layer_choices(best: DataFrame) -> DataFrame:
    return best.select(*(c for c in LAYERS if c in best.columns)).orderBy("dataset", "model", "scorer", "balance_mode", "k")


def wins(decision: DataFrame) -> DataFrame:
    """How often each scorer is the decision; null keys aren't counted."""
    return decision.dropna(subset=["dataset", "model", "scorer"]).groupBy("dataset", "model", "scorer").agg(F.count("*").alias("wins"))


def win_matrix(counts: DataFrame, columns: list[str]) -> DataFrame:
    """Scorers by the given ``dataset|model`` columns, 0 where there is no win."""
    named = counts.withColumn("cell", F.concat_ws("|", "dataset", "model"))
    return named.groupBy("scorer").pivot("cell", columns).agg(F.first("wins")).fillna(0)


def against_k(best: DataFrame, metric: str) -> DataFrame:
    """What a line plot of a metric over k shows: its mean for each k, scorer and dataset, with number and deviation."""
    return best.groupBy("k", "scorer", "dataset").agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"), F.count(metric).alias("n"))


def top(df: DataFrame, column: str, n: int = 20) -> DataFrame:
    return df.orderBy(F.col(column).desc_nulls_last()).limit(n)

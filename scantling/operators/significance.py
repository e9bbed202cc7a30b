"""Comparison of runs by paired bootstrap."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scantling.operators.metrics import METRICS, bootstrap_difference

SETTING = ("dataset", "model", "balance_mode", "k")
COMPARED = "run_id_a string, run_id_b string, split string, metric string, score_a double, score_b double, mean_diff double, ci_low double, ci_high double, p_value double, error string"


def top_pairs(runs: DataFrame, metric: str = "test_recall_at_1pct_fpr") -> DataFrame:
    """The two runs of highest metric in every setting, missing values last and ties by run id; settings of one run are dropped."""
    w = Window.partitionBy(*SETTING).orderBy(F.col(metric).desc_nulls_last(), F.col("run_id").asc())
    two = runs.select(*SETTING, "scorer", "run_id", metric).withColumn("_r", F.row_number().over(w)).where("_r <= 2")
    one = lambda r, c, name: F.max(F.when(F.col("_r") == r, F.col(c))).alias(name)
    return two.groupBy(*SETTING).agg(F.count("*").alias("_n"), one(1, "scorer", "scorer_a"), one(2, "scorer", "scorer_b"), one(1, "run_id", "run_id_a"), one(2, "run_id", "run_id_b")).where("_n = 2").drop("_n")


def top_scorer_pairs(best: DataFrame) -> DataFrame:
    """The two scorers of highest mean test recall in every setting, from the best-layer table."""
    w = Window.partitionBy(*SETTING).orderBy(F.col("test_recall_at_1pct_fpr_mean").desc_nulls_last(), F.col("scorer").asc())
    two = best.withColumn("_r", F.row_number().over(w)).where("_r <= 2")
    one = lambda r, name: F.max(F.when(F.col("_r") == r, F.col("scorer"))).alias(name)
    return two.groupBy(*SETTING).agg(F.count("*").alias("_n"), one(1, "scorer_a"), one(2, "scorer_b")).where("_n = 2").drop("_n")


def paired(predictions: DataFrame, pairs: DataFrame, split: str) -> DataFrame:
    """``run_id_a, run_id_b, sample_id, y_a, y_b, a, b``: predictions of both runs side by side, rows of one run only included."""
    ids = pairs.select(F.explode(F.array("run_id_a", "run_id_b")).alias("run_id")).distinct()
    # a sweep that was stopped and taken up again may have written rows twice
    rows = predictions.where(F.col("split") == split).join(ids, "run_id", "left_semi").dropDuplicates(["run_id", "sample_id"])
    a = pairs.select("run_id_a", "run_id_b").join(rows.selectExpr("run_id as run_id_a", "sample_id", "y as y_a", "score as a"), "run_id_a")
    b = pairs.select("run_id_a", "run_id_b").join(rows.selectExpr("run_id as run_id_b", "sample_id", "y as y_b", "score as b"), "run_id_b")
    return a.join(b, ["run_id_a", "run_id_b", "sample_id"], "full")


def aligned(side_by_side: DataFrame) -> DataFrame:
    """Whether the runs of a pair were measured on the same labels."""
    return side_by_side.groupBy("run_id_a", "run_id_b").agg(F.count("*").alias("n"), F.bool_and(F.col("y_a").eqNullSafe(F.col("y_b"))).alias("aligned"))


def compare(side_by_side: DataFrame, split: str, metric: str, draws: int = 2000, seed: int = 0, strict: bool = False) -> DataFrame:
    """Bootstrap comparison of every pair, a task a pair; pairs of differing labels, or that fail, get an error and no figures."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("sample_id")
        out = dict.fromkeys(("score_a", "score_b", "mean_diff", "ci_low", "ci_high", "p_value", "error"))
        try:
            if rows[["y_a", "y_b"]].isna().any().any() or not np.array_equal(rows["y_a"], rows["y_b"]):
                raise ValueError("labels aren't aligned")
            figures = bootstrap_difference(rows["y_a"].to_numpy(), rows["a"].to_numpy(), rows["b"].to_numpy(), metric, draws, seed, strict)
            out |= {k: None if np.isnan(v) else v for k, v in figures.items()}
        except Exception as e:  # noqa: BLE001
            out["error"] = type(e).__name__
        return pd.DataFrame([{"run_id_a": key[0], "run_id_b": key[1], "split": split, "metric": metric} | out], columns=[c.split()[0] for c in COMPARED.split(", ")])

    return side_by_side.groupBy("run_id_a", "run_id_b").applyInPandas(run, COMPARED)


def significance(runs: DataFrame, predictions: DataFrame, split: str = "test", metric: str = "recall_at_1pct_fpr", draws: int = 2000, seed: int = 0) -> DataFrame:
    """The top pair of every setting with its comparison; a pair without predictions has the error ``FileNotFoundError``."""
    pairs = top_pairs(runs)
    done = compare(paired(predictions, pairs, split), split, metric, draws, seed)
    joined = pairs.join(done, ["run_id_a", "run_id_b"], "left")
    missing = F.col("metric").isNull()
    return joined.withColumns({"error": F.when(missing, "FileNotFoundError").otherwise(F.col("error")), "split": F.lit(split), "metric": F.lit(metric)})

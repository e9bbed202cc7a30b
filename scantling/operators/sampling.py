"""Splits, few-shot samples and confidence filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scantling.functions.order import portable_key, ranked


def confident(df: DataFrame, difference: str = "logit_diff", label: str = "label", threshold: float = 0.0) -> DataFrame:
    """Rows whose signed confidence is above the threshold: the difference for label 1, its negative for any other label."""
    return df.where(F.when(F.col(label) == 1, F.col(difference)).otherwise(-F.col(difference)) > threshold)


def class_splits(df: DataFrame, by: list[str], seed: int = 42, test_share: float = 0.15, eval_share: float = 0.15) -> DataFrame:
    """Adds ``split``: test and eval hold equally many of labels 1 and 0, the rest is the train pool; other labels are left out.

    Sizes are truncated products of doubles with the smaller class; what test took counts as gone for eval.
    """
    if test_share < 0 or eval_share < 0 or test_share + eval_share > 1 or test_share == 1:
        raise ValueError("shares must leave room for each other")
    rows = df.where(F.col("label").isin(0, 1)).withColumn("_key", portable_key(seed, F.col("sample_id")))
    order = ranked(rows, [*by, "label"], "_key", "sample_id", "_r")
    counts = rows.groupBy(*by).agg(F.count_if(F.col("label") == 1).alias("_p"), F.count_if(F.col("label") == 0).alias("_q")) if by else rows.agg(F.count_if(F.col("label") == 1).alias("_p"), F.count_if(F.col("label") == 0).alias("_q"))
    small = F.least("_p", "_q")
    sizes = counts.withColumn("_test", F.floor(small * F.lit(float(test_share)))).withColumn("_eval", F.floor((small - F.col("_test")) * F.lit(float(eval_share) / (1 - float(test_share)))))
    joined = order.join(F.broadcast(sizes), by) if by else order.crossJoin(F.broadcast(sizes))  # one row a cell
    split = F.when(F.col("_r") <= F.col("_test"), "test").when(F.col("_r") <= F.col("_test") + F.col("_eval"), "eval").otherwise("train_pool")
    return joined.withColumn("split", split).drop("_key", "_r", "_p", "_q", "_test", "_eval")


def draws(pool: DataFrame, by: list[str], ks: list[int], seeds: int) -> DataFrame:
    """``by, k, seed, sample_id, label``: k positives and as many negatives, or all if there are fewer, for every k and seed.

    A cell with fewer than k positives has no sample of that k. Draws depend on the pool, k and seed only, so that every
    layer, scorer and balance mode shares them.
    """
    plan = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(s).alias("seed")) for k in ks for s in range(seeds))))
    rows = pool.where(F.col("label").isin(0, 1)).select(*by, "sample_id", "label")
    keyed = rows.withColumn("_g", plan).select(*by, "sample_id", "label", "_g.k", "_g.seed").withColumn("_key", portable_key(F.col("seed"), F.col("k"), F.col("sample_id")))
    w = Window.partitionBy(*by, "k", "seed", "label").orderBy("_key", "sample_id")
    # the bound of the largest k lets each input partition drop the rest before the shuffle
    picked = keyed.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max(ks)).where(F.col("_r") <= F.col("k"))
    whole = picked.withColumn("_n", F.count_if(F.col("label") == 1).over(Window.partitionBy(*by, "k", "seed")))  # 2 k rows at most
    return whole.where("_n = k").select(*by, "k", "seed", "sample_id", "label")


def few_shot(pool: DataFrame, by: list[str], ks: list[int], seeds: int, modes: list[str]) -> DataFrame:
    """``by, k, seed, balance_mode, sample_id, label``: the samples of :func:`draws` row by row; imbalanced ones hold all negatives of the pool.

    The pipeline never lists imbalanced samples so: it keeps the drawn positives and takes the negatives from the pool.
    """
    unknown = set(modes) - {"balanced", "imbalanced"}
    if unknown:
        raise ValueError(f"unknown balance modes {sorted(unknown)}")
    drawn = draws(pool, by, ks, seeds)
    parts = []
    if "balanced" in modes:
        parts.append(drawn.withColumn("balance_mode", F.lit("balanced")))
    if "imbalanced" in modes:
        up = drawn.where("label = 1")
        cells = up.groupBy(*by, "k", "seed").agg(F.lit(0).alias("_one")).drop("_one")
        down = pool.where("label = 0").select(*by, "sample_id", "label")
        every = down.join(F.broadcast(cells), by) if by else down.crossJoin(F.broadcast(cells))  # a row for each k and seed
        parts.append(up.unionByName(every).withColumn("balance_mode", F.lit("imbalanced")))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return rows.select(*by, "k", "seed", "balance_mode", "sample_id", "label")


def split_counts(splits: DataFrame, by: list[str]) -> DataFrame:
    """Manifest of splits: rows and labels of each."""
    counts = [F.count("*").alias("n_total"), F.count_if(F.col("label") == 1).alias("n_pos_total"), F.count_if(F.col("label") == 0).alias("n_neg_total")]
    for s in ("train_pool", "eval", "test"):
        counts.append(F.count_if(F.col("split") == s).alias(f"{s}_size"))
    for s in ("eval", "test"):
        for name, label in (("pos", 1), ("neg", 0)):
            counts.append(F.count_if((F.col("split") == s) & (F.col("label") == label)).alias(f"{s}_{name}"))
    return splits.groupBy(*by).agg(*counts)


def bootstrap_weights(n: int, draws: int, spark: SparkSession) -> DataFrame:
    """``b, row, times``: how often draw b, of n row numbers from 0 with replacement by hash, takes each row; rows not taken are left out."""
    cells = spark.range(draws).select(F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    number = F.conv(F.substring(F.md5(F.concat_ws("|", "b", "i")), 1, 8), 16, 10).cast("long")
    return cells.withColumn("row", number % n).groupBy("b", "row").agg(F.count("*").alias("times"))

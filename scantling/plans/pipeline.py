"""The phases of a benchmark: extract, sweep, analyze, significance, plot data. Each reads and writes tables below the results and cache folders."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scantling.functions.vectors import without_nan
from scantling.operators import reports, significance
from scantling.operators.sampling import class_splits, draws, split_counts
from scantling.operators.scorers import fitted, result_rows, scored
from scantling.plans.config import Config, grid, pending
from scantling.plans.encode import Encoder, hashed, surrogate_difference, vectors
from scantling.session import cut
from scantling.sources import store
from scantling.sources.schemas import PREDICTIONS, RUNS

MODES = ("base", "prompted", "followup")


def extract(
    spark: SparkSession,
    config: Config,
    model: str,
    dataset: str,
    texts: DataFrame,
    modes: tuple[str, ...] = MODES,
    skip_filter: bool = False,
    make: Callable[[], Encoder] | None = None,
    difference: Callable[[DataFrame], DataFrame] = surrogate_difference,
    overwrite: bool = False,
) -> None:
    """Filter, split and encode one dataset for one model: ``texts`` has sample_id, text, label. Writes confidences, splits, manifests and vectors.

    What is on disk already is used again, confidences, splits and complete vectors alike, unless ``overwrite`` is set.
    """
    if model not in config.models:
        raise ValueError(f"unknown model {model!r}")
    home = f"{config.cache_dir}/{model.replace('/', '_')}/{dataset}"
    names = [F.lit(model).alias("model"), F.lit(dataset).alias("dataset")]
    kept = texts
    if not skip_filter:
        if overwrite or not store.exists(spark, f"{home}/confidence"):
            measured = difference(texts)
            sure = F.when(F.col("label") == 1, F.col("logit_diff")).otherwise(-F.col("logit_diff")) > config.threshold
            measured.select("sample_id", "logit_diff", F.coalesce(sure, F.lit(False)).alias("kept")).write.mode("overwrite").parquet(f"{home}/confidence")
            seen = spark.read.parquet(f"{home}/confidence")
            store.write_manifest(seen.agg(*names, F.lit(config.threshold).alias("threshold"), F.count("*").alias("n_original"), F.count_if("kept").alias("n_filtered"), F.avg(F.when(F.col("kept"), F.col("logit_diff"))).alias("mean_kept_logit_diff")), f"{home}/filter_manifest")
        kept = texts.join(spark.read.parquet(f"{home}/confidence").where("kept").select("sample_id"), "sample_id", "left_semi")
    named = kept.select("sample_id", "text", F.col("label").cast("int").alias("label"))
    if overwrite or not store.exists(spark, f"{home}/splits"):
        splits = class_splits(named.select("sample_id", "label"), []).select(*names, "split", "sample_id", "label")
        splits.write.mode("overwrite").parquet(f"{home}/splits")
        store.write_manifest(split_counts(spark.read.parquet(f"{home}/splits"), ["model", "dataset"]), f"{home}/split_manifest")
    layers, path = config.models[model], f"{config.cache_dir}/vectors"
    rows = named.count()
    todo = list(modes)
    if not overwrite and store.exists(spark, path):
        cells = spark.createDataFrame([(model, dataset, m, layer) for m in modes for layer in layers], "model string, dataset string, mode string, layer int")
        have = store.read_vectors(spark, path, model=model, dataset=dataset)
        todo = [r["mode"] for r in store.incomplete_cells(cells, have, spark.createDataFrame([(model, dataset, rows)], "model string, dataset string, n long")).select("mode").distinct().collect()]
    for mode in todo:
        encoded = vectors(named, dataset, mode, layers, make or hashed(most=config.max_length))
        store.write_vectors(encoded.select(*names, F.lit(mode).alias("mode"), "layer", "sample_id", "label", "x"), path, max(1, rows // VECTORS_PER_FILE))


#: Vectors in a file of the store, about.
VECTORS_PER_FILE = 50_000


def sweep_scores(vectors: DataFrame, splits: DataFrame, runs: DataFrame, drawn: DataFrame, ood: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Fitted models (with their runs) and all scores of ``runs`` over the given vectors (model, dataset, mode, layer, sample_id, label, x).

    ``runs``: model, dataset, mode, layer, scorer, k, seed, balance_mode. ``splits``: model, dataset, split, sample_id. ``drawn``: of
    :func:`draws` by model and dataset, shared by modes and layers. ``ood``: vectors of the other dataset under the name of the dataset they
    test. Cells without vectors and sizes of which the pool has too few positives have no rows.
    """
    cell = ["model", "dataset", "mode", "layer"]
    clean = lambda df: df.where("x is not null").withColumn("x", without_nan(F.col("x")))
    placed = clean(vectors).join(splits.select("model", "dataset", "split", "sample_id"), ["model", "dataset", "sample_id"]).select(*cell, "split", "sample_id", "label", "x")
    held = placed.where("split <> 'train_pool'")
    if ood is not None:
        held = held.unionByName(clean(ood).select(*cell, F.lit("ood").alias("split"), "sample_id", "label", "x"))
    side = lambda label: F.collect_list(F.when(F.col("label") == label, F.col("sample_id")))
    samples = drawn.groupBy("model", "dataset", "k", "seed").agg(side(1).alias("up"), side(0).alias("down"))  # 2 k ids at most
    ids = F.when(F.col("balance_mode") == "balanced", F.concat("up", "down")).otherwise(F.col("up"))
    name = store.run_id(*(F.col(c) for c in ("model", "dataset", "scorer", "layer", "k", "seed", "balance_mode")))
    specs = runs.join(samples, ["model", "dataset", "k", "seed"]).select(*cell, "scorer", "k", "seed", "balance_mode", name.alias("run_id"), ids.alias("ids"))
    models = cut(fitted(specs, placed.where("split = 'train_pool'"), cell))
    return models, scored(models, held, cell)


def sweep_runs(vectors: DataFrame, splits: DataFrame, runs: DataFrame, drawn: DataFrame, ood: DataFrame | None = None) -> DataFrame:
    """Result rows of :func:`sweep_scores`."""
    models, scores = sweep_scores(vectors, splits, runs, drawn, ood)
    return result_rows(models, cut(scores)).select(*RUNS.names)


def sweep(spark: SparkSession, config: Config, scorers: list[str] | None = None) -> DataFrame:
    """Fits and scores what has no result yet, writes the predictions if the configuration asks for them, and appends the result rows.

    Models and datasets without splits, and cells without vectors, are skipped. The predictions of a sweep that was stopped may be
    written again by the next; readers take each row once.
    """
    path = f"{config.results_dir}/runs"
    if config.overwrite:
        spark.createDataFrame([], RUNS).write.mode("overwrite").json(path)
    home = f"{config.cache_dir}/vectors"
    folders = [f for m in config.models for d in config.ood if store.exists(spark, f := f"{config.cache_dir}/{m.replace('/', '_')}/{d}/splits")]
    if folders and store.exists(spark, home):
        every = spark.read.parquet(*folders)
        vecs = store.read_vectors(spark, home)
        todo = pending(grid(spark, config, scorers), store.done_ids(spark, path)).select("model", "dataset", "mode", "layer", "scorer", "k", "seed", "balance_mode")
        drawn = draws(every.where("split = 'train_pool'"), ["model", "dataset"], config.ks, config.seeds)
        pairs = spark.createDataFrame([(d, o) for d, o in config.ood.items() if o], "dataset string, other string")
        ood = vecs.withColumnRenamed("dataset", "other").join(F.broadcast(pairs), "other").select("model", "dataset", "mode", "layer", "sample_id", "label", "x")
        models, scores = sweep_scores(vecs, every, todo, drawn, ood)
        if config.save_predictions:
            batch = f"{config.results_dir}/predictions/batch={uuid.uuid4().hex}"
            store.write_predictions(scores, batch)
            scores = spark.read.schema(PREDICTIONS).parquet(batch)
        else:
            scores = cut(scores)
        store.append_runs(result_rows(models, scores).select(*RUNS.names), path)
    elif not store.exists(spark, path):
        spark.createDataFrame([], RUNS).write.mode("append").json(path)
    return store.read_runs(spark, path)


def analyze(runs: DataFrame, config: Config) -> dict[str, DataFrame]:
    """The report tables by name."""
    table = reports.summary(store.clean_metrics(runs)).cache()  # a few rows a configuration
    best = reports.best_layers(table, config.selection_metric)
    return {
        "all_results_summary": table,
        "best_layer_summary": best,
        "fsei": reports.efficiency(best, config.ks),
        "decision_table": reports.decisions(best),
        "ood_table": reports.ood_table(best),
        "layer_choices": reports.layer_choices(best),
        "dropped_groups": reports.without_metric(table, config.selection_metric),
    }


def write_reports(tables: dict[str, DataFrame], results_dir: str) -> None:
    for name, df in tables.items():
        store.write_csv(df, f"{results_dir}/{name}")


def plot_data(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What the figures show, as tables."""
    best = tables["best_layer_summary"]
    return {
        "recall_vs_k": reports.against_k(best, "test_recall_at_1pct_fpr_mean"),
        "auroc_vs_k": reports.against_k(best, "test_auroc_mean"),
        "ood_recall_vs_k": reports.against_k(best, "ood_recall_at_1pct_fpr_mean"),
        "fsei_bar": tables["fsei"].groupBy("scorer", "dataset").agg(F.avg("fsei").alias("fsei")),
        "win_counts": reports.wins(tables["decision_table"]),
        "selected_layer_vs_k": reports.against_k(tables["layer_choices"], "layer"),
    }


def significance_report(spark: SparkSession, config: Config, split: str = "test", metric: str = "recall_at_1pct_fpr") -> DataFrame:
    """Comparison of the top pair of every setting on the stored predictions; pairs without predictions get an error each."""
    runs = store.clean_metrics(store.read_runs(spark, f"{config.results_dir}/runs"))
    predictions = store.read_predictions(spark, f"{config.results_dir}/predictions")
    return significance.significance(runs, predictions, split, metric, config.draws, config.seed)

"""Configuration of a benchmark, and the grid of runs it stands for."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scantling.operators.scorers import REGISTRY
from scantling.sources.store import run_id


@dataclass
class Config:
    """``models``: layers by model; ``ood``: the out-of-distribution dataset of each dataset, or None."""

    models: dict[str, list[int]]
    ood: dict[str, str | None]
    ks: list[int] = field(default_factory=lambda: [1, 2, 3, 5, 10, 25, 50, 100])
    seeds: int = 10
    balance_modes: list[str] = field(default_factory=lambda: ["balanced", "imbalanced"])
    threshold: float = 0.0
    max_length: int = 512
    selection_metric: str = "eval_recall_at_1pct_fpr"
    overwrite: bool = False
    save_predictions: bool = True
    draws: int = 2000
    seed: int = 0
    results_dir: str = "./results"
    cache_dir: str = "./cache/activations"


def parse(raw: dict[str, Any]) -> Config:
    """A configuration from its YAML mapping; datasets may be given in the older form, a mapping in which sms is no dataset of its own."""
    datasets = raw["datasets"]
    if "in_distribution" in datasets:
        ood = {d: (datasets.get("ood") or {}).get(d) for d in datasets["in_distribution"]}
    else:
        ood = {d: None for d in datasets if d != "sms"}
    sweep, results, tests = raw.get("sweep", {}), raw.get("results", {}), raw.get("significance", {})
    extraction, plain = raw.get("extraction", {}), Config({}, {})
    return Config(
        models={m["name"]: list(m["layers"]) for m in raw["models"]},
        ood=ood,
        ks=list(sweep.get("k_values", plain.ks)),
        seeds=int(sweep.get("seeds", plain.seeds)),
        balance_modes=list(sweep.get("balance_modes", plain.balance_modes)),
        threshold=float(raw.get("filtering", {}).get("logit_diff_threshold", 0.0)),
        max_length=int(extraction.get("max_length", 512)),
        selection_metric=raw.get("selection_metric", plain.selection_metric),
        overwrite=bool(results.get("overwrite", False)),
        save_predictions=bool(results.get("save_predictions", True)),
        draws=int(tests.get("n_boot", 2000)),
        seed=int(tests.get("seed", 0)),
        results_dir=raw.get("results_dir", plain.results_dir),
        cache_dir=extraction.get("cache_dir", plain.cache_dir),
    )


def load(path: str) -> Config:
    import yaml

    with open(path, encoding="utf-8") as f:
        return parse(yaml.safe_load(f))


def narrowed(config: Config, model: str | None = None, dataset: str | None = None) -> Config:
    """The configuration for one model or dataset; unknown ones are an error."""
    if model is not None and model not in config.models:
        raise ValueError(f"unknown model {model!r}")
    if dataset is not None and dataset not in config.ood:
        raise ValueError(f"unknown dataset {dataset!r}")
    models = {m: x for m, x in config.models.items() if model in (None, m)}
    return Config(**{**config.__dict__, "models": models, "ood": {d: o for d, o in config.ood.items() if dataset in (None, d)}})


def grid(spark: SparkSession, config: Config, scorers: list[str] | None = None) -> DataFrame:
    """Every run: ``model, dataset, ood_dataset, mode, layer, scorer, k, balance_mode, seed, run_id``. Unknown scorers are an error."""
    names = list(REGISTRY) if scorers is None else scorers
    if unknown := set(names) - set(REGISTRY):
        raise ValueError(f"unknown scorers {sorted(unknown)}")
    models = spark.createDataFrame([(m, layer) for m, layers in config.models.items() for layer in layers], "model string, layer int").coalesce(1)
    datasets = spark.createDataFrame(list(config.ood.items()), "dataset string, ood_dataset string").coalesce(1)
    methods = spark.createDataFrame([(n, REGISTRY[n].mode) for n in names], "scorer string, mode string").coalesce(1)
    draws = spark.createDataFrame([(k, b, s) for k in config.ks for b in config.balance_modes for s in range(config.seeds)], "k int, balance_mode string, seed int").coalesce(1)
    # one partition each, else their product would be one of partitions as well
    every = models.crossJoin(datasets).crossJoin(methods).crossJoin(draws)  # dimensions of the configuration, a few rows each
    return every.withColumn("run_id", run_id(*(F.col(c) for c in ("model", "dataset", "scorer", "layer", "k", "seed", "balance_mode"))))


def pending(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """Runs that have no result yet."""
    return wanted.join(done.select("run_id").distinct(), "run_id", "left_anti")

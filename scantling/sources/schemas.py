"""Declared schemas and dataset descriptions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType

METRICS = ("eval_auroc", "eval_recall_at_1pct_fpr", "test_auroc", "test_recall_at_1pct_fpr", "ood_auroc", "ood_recall_at_1pct_fpr")

RUNS = StructType(
    [
        StructField("run_id", StringType()),
        StructField("scorer", StringType()),
        StructField("k", IntegerType()),
        StructField("seed", IntegerType()),
        StructField("balance_mode", StringType()),
        StructField("model", StringType()),
        StructField("layer", IntegerType()),
        StructField("dataset", StringType()),
        *(StructField(m, DoubleType()) for m in METRICS),
        StructField("n_train_pos", IntegerType()),
        StructField("n_train_neg", IntegerType()),
        StructField("wall_clock_s", DoubleType()),
        StructField("error", BooleanType()),
        StructField("error_type", StringType()),
    ]
)

VECTORS = StructType(
    [
        StructField("model", StringType()),
        StructField("dataset", StringType()),
        StructField("mode", StringType()),
        StructField("layer", IntegerType()),
        StructField("sample_id", LongType()),
        StructField("label", IntegerType()),
        StructField("x", ArrayType(FloatType())),
    ]
)

PREDICTIONS = StructType(
    [
        StructField("run_id", StringType()),
        StructField("split", StringType()),
        StructField("sample_id", LongType()),
        StructField("y", IntegerType()),
        StructField("score", DoubleType()),
    ]
)

SPLITS = StructType([StructField("model", StringType()), StructField("dataset", StringType()), StructField("split", StringType()), StructField("sample_id", LongType())])


@dataclass(frozen=True)
class DatasetSpec:
    """What the pipeline must know about a text dataset."""

    name: str
    task_type: str
    positive_label: int = 1
    ood_only: bool = False


SPECS = {s.name: s for s in (DatasetSpec("enron", "spam"), DatasetSpec("sms", "spam", ood_only=True), DatasetSpec("mask", "honesty"))}


def spec(name: str) -> DatasetSpec:
    """The description of a dataset; unknown names are an error."""
    if name not in SPECS:
        raise ValueError(f"unknown dataset {name!r}; known are {sorted(SPECS)}")
    return SPECS[name]

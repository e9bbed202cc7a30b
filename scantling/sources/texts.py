"""Text datasets in one schema."""

from __future__ import annotations

import os
import warnings
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scantling.sources.schemas import spec

# Names under which sources carry the fields of the honesty schema, first hit wins.
CANDIDATES = {
    "proposition": ("proposition", "question", "prompt", "input", "text"),
    "belief_target": ("ground_truth", "answer", "target_answer", "gold_answer", "belief_target"),
    "pressure_prompt": ("pressure_prompt", "lie_elicitation_prompt", "prompted_text"),
    "belief_elicitation_prompt": ("belief_elicitation_prompt", "belief_prompt", "neutral_prompt"),
    "category": ("category", "archetype", "task_type", "subset"),
    "question_id": ("question_id", "id", "example_id", "uid"),
    "label": ("label", "dishonest", "is_dishonest", "target", "y"),
}
# Words that stand for 1 and for 0.
TRUTHY = ("1", "true", "yes", "spam", "positive", "dishonest", "deceptive")
FALSY = ("0", "false", "no", "ham", "negative", "honest", "truthful")

# The columns of the honesty schema in their order.
HONESTY = ("text", "label", "belief_target", "pressure_prompt", "belief_elicitation_prompt", "proposition", "question_id", "category")


def first_of(df: DataFrame, names: tuple[str, ...], default: str | int | None = None, required: bool = False) -> Column:
    """The first of the named columns that exists and isn't null; else the default, or an error where one is required."""
    there = [F.col(n).cast("string") for n in names if n in df.columns]
    if required:
        return F.coalesce(*there, F.raise_error(F.lit(f"none of {', '.join(names)} has a value")).cast("string"))
    return F.coalesce(*there, F.lit(default).cast("string"))


def binary_label(value: Column, positive: str = "1") -> Column:
    """0 or 1 of a label given as a boolean, number or word; other words count by equality with ``positive``."""
    text = F.lower(F.trim(value.cast("string")))
    number = value.cast("string").try_cast("double")
    return (
        F.when(text.isin(*TRUTHY), 1)
        .when(text.isin(*FALSY), 0)
        .when(number.isNotNull(), F.when(number == F.lit(positive).try_cast("double"), 1).otherwise(0))
        .otherwise(F.when(value.cast("string") == positive, 1).otherwise(0))
    )


def spam(df: DataFrame, name: str, text: str = "text") -> DataFrame:
    """``text, label, task_type`` of a spam corpus whose text column may have another name; an id is kept."""
    ids = [c for c in ("sample_id",) if c in df.columns]
    named = df.withColumnRenamed(text, "text") if text != "text" else df
    return named.select(*ids, "text", "label").withColumn("task_type", F.lit(spec(name).task_type))


def honesty(df: DataFrame) -> DataFrame:
    """Rows in the honesty schema: named candidates are searched, an empty pressure prompt gives way to the proposition, a label that is no integer counts as 1."""
    ids = [c for c in ("sample_id",) if c in df.columns]
    values = {k: first_of(df, names, {"category": "unknown", "question_id": None, "label": "1"}.get(k, "")) for k, names in CANDIDATES.items()}
    values["text"] = F.coalesce(F.nullif(values["pressure_prompt"], F.lit("")), values["proposition"])
    values["label"] = F.coalesce(values["label"].try_cast("int"), F.lit(1))
    return df.select(*ids, *(values[c].alias(c) for c in HONESTY))


def union_of(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Honesty rows of several sources; one that can't be read is warned of and passed over, none at all is an error."""
    parts = []
    for path in paths:
        try:
            parts.append(honesty(read_any(spark, path)))
        except Exception as e:  # noqa: BLE001
            warnings.warn(f"could not read {path}: {type(e).__name__}", stacklevel=2)
    if not parts:
        raise RuntimeError("no honesty source could be read")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_any(spark: SparkSession, source: str) -> DataFrame:
    """A folder or file of parquet, CSV, JSON lines, or one JSON array, told by its suffix."""
    suffix = os.path.splitext(source.rstrip("/"))[1].lower()
    if suffix == ".csv":
        return spark.read.option("header", True).option("multiLine", True).csv(source)
    if suffix in (".jsonl", ".ndjson"):
        return spark.read.json(source)
    if suffix == ".json":
        return spark.read.option("multiLine", True).json(source)
    if suffix in (".parquet", ""):
        return spark.read.parquet(source)
    raise ValueError(f"unknown kind of source: {source}")


#: How the rows of a dataset get its schema, by name.
LOADERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "enron": lambda df: spam(df, "enron"),
    "sms": lambda df: spam(df, "sms", "sms" if "sms" in df.columns else "text"),
    "mask": honesty,
}


def load(spark: SparkSession, name: str, source: str) -> DataFrame:
    """The dataset of that name from a folder or file; unknown names are an error."""
    if name not in LOADERS:
        raise ValueError(f"unknown dataset {name!r}; known are {sorted(LOADERS)}")
    return LOADERS[name](read_any(spark, source))

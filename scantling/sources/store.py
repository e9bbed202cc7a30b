"""Tables of the pipeline on disk: vectors, runs, predictions, splits, manifests and reports."""

from __future__ import annotations

import contextlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scantling.sources.schemas import METRICS, PREDICTIONS, RUNS, VECTORS

CELL = ("model", "dataset", "mode", "layer")


def safe_name(model: Column) -> Column:
    """Model names as parts of paths and ids."""
    return F.replace(model, F.lit("/"), F.lit("_"))


def run_id(model: Column, dataset: Column, scorer: Column, layer: Column, k: Column, seed: Column, balance: Column) -> Column:
    """The id of a run, of all that sets it apart."""
    layer, k, seed = (F.concat(F.lit(p), c.cast("string")) for p, c in (("layer", layer), ("k", k), ("seed", seed)))
    return F.concat_ws("__", safe_name(model), dataset, scorer, layer, k, seed, balance)


def exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, on whatever file system it is; does nothing once the session has ended."""
    with contextlib.suppress(Exception):
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def write_vectors(df: DataFrame, path: str, parts: int = 4) -> None:
    """One folder a cell, so that a scan of a cell opens its files only; only cells that ``df`` has are replaced.

    A cell is written by ``parts`` tasks, by hash of the ids: as many as its rows ask for.
    """
    df.repartition(*CELL, F.pmod(F.xxhash64("sample_id"), F.lit(parts))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*CELL).parquet(path)


def read_vectors(spark: SparkSession, path: str, **cell: str | int) -> DataFrame:
    """Vectors of the cells with the given values; the filter prunes folders."""
    df = spark.read.schema(VECTORS).parquet(path)
    for name, value in cell.items():
        df = df.where(F.col(name) == value)
    return df


def incomplete_cells(wanted: DataFrame, vectors: DataFrame, rows: DataFrame) -> DataFrame:
    """Of the wanted cells (CELL), those that lack a layer or whose number of vectors isn't that of ``rows`` (model, dataset, n)."""
    have = vectors.groupBy(*CELL).agg(F.count("*").alias("have"))
    full = have.join(rows, ["model", "dataset"]).where("have = n").select(*CELL)
    return wanted.join(full, list(CELL), "left_anti")


def clean_metrics(runs: DataFrame) -> DataFrame:
    """NaN as null, once, so that means skip it."""
    return runs.withColumns({m: F.when(~F.isnan(m), F.col(m)) for m in (*METRICS, "wall_clock_s") if m in runs.columns})


def append_runs(df: DataFrame, path: str) -> None:
    """Result rows as JSON lines, added to what is there."""
    df.write.mode("append").option("ignoreNullFields", False).json(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """All result rows of a folder of JSON lines; blank lines are skipped, missing keys are null, the token NaN is a number."""
    return spark.read.schema(RUNS).option("allowNonNumericNumbers", True).json(path)


def done_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids of the runs on disk; none where nothing has been written."""
    if not exists(spark, path):
        return spark.createDataFrame([], "run_id string")
    return known_ids(read_runs(spark, path))


def known_ids(runs: DataFrame) -> DataFrame:
    return runs.select("run_id").where("run_id <> ''").distinct()


def write_predictions(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("compression", "zstd").partitionBy("split").parquet(path)


def read_predictions(spark: SparkSession, path: str, run: str | None = None) -> DataFrame:
    """Stored predictions; none where nothing has been written."""
    df = spark.read.schema(PREDICTIONS).parquet(path) if exists(spark, path) else spark.createDataFrame([], PREDICTIONS)
    rows = df.select(*PREDICTIONS.names).where("split <> '_seconds'")
    return rows if run is None else rows.where(F.col("run_id") == run)


def write_csv(df: DataFrame, path: str) -> None:
    """A report as one CSV file with a header; for aggregates only."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_manifest(df: DataFrame, path: str) -> None:
    """A manifest of few rows as JSON."""
    df.coalesce(1).write.mode("overwrite").json(path)

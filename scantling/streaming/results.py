"""Result rows as a stream: new files of JSON lines are taken up as they come, each run once. An addition, not a part of the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from scantling.sources.schemas import RUNS


def arriving(spark: SparkSession, path: str) -> DataFrame:
    """Rows of files that arrive below ``path``, without repeats of a run."""
    return spark.readStream.schema(RUNS).json(path).where("run_id <> ''").dropDuplicates(["run_id"])


def ingest(df: DataFrame, out: str, checkpoints: str) -> StreamingQuery:
    """Takes up all that is there and ends; a later call goes on from there."""
    return df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoints).trigger(availableNow=True).start()

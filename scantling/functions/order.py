"""Orders that every engine and machine agrees on, and ranks that no single task must sort alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def portable_key(*parts: Column | str | int) -> Column:
    """A pseudo-random order key: md5 of the parts."""
    return F.md5(F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts)))


def ranked(df: DataFrame, by: list[str], key: str, tie: str, name: str = "r", digits: int = 4) -> DataFrame:
    """Adds the rank from 1 within ``by`` in order of a hexadecimal ``key``, then ``tie``.

    Rows are ranked within buckets of the key's first digits and shifted by the sizes of the buckets before, so that a
    group of any size is spread over up to 16 ** digits tasks.
    """
    cell = df.withColumn("_b", F.substring(key, 1, digits))
    sizes = cell.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy(*by).orderBy("_b")) - F.col("_n")).drop("_n")
    inner = cell.withColumn("_i", F.row_number().over(Window.partitionBy(*by, "_b").orderBy(key, tie)))
    match = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*by, "_b")]
    joined = inner.alias("l").join(before.alias("r"), match)
    return joined.select("l.*", (F.col("l._i") + F.col("r._before")).alias(name)).drop("_b", "_i")

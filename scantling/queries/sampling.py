"""Splits and few-shot samples over the embeddings, the even labels being positive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scantling.functions.order import portable_key, ranked
from scantling.operators.sampling import bootstrap_weights, class_splits, draws, few_shot, split_counts
from scantling.queries import query
from scantling.session import table

KS, SEEDS, MODES = [1, 5, 25], 2, ["balanced", "imbalanced"]

BASE = "base as (select vec_id as id, case when label % 2 = 0 then 1 else 0 end as y from embeddings)"
PLACED = f"""{BASE}, sizes as (select t, floor((m - t) * (0.15::double / (1 - 0.15::double))) as e from (select m, floor(m * 0.15::double) as t from (select least(sum(y), sum(1 - y)) as m from base))),
placed as (select id, y, case when r <= t then 'test' when r <= t + e then 'eval' else 'train_pool' end as split
  from (select *, row_number() over (partition by y order by md5('42|' || id), id) as r from base), sizes)"""
DRAWN = f"""{PLACED}, ranked as (select id, y, k, seed, row_number() over (partition by k, seed, y order by md5(seed || '|' || k || '|' || id), id) as r
  from placed, (values (1), (5), (25)) k(k), (values (0), (1)) s(seed) where split = 'train_pool'),
drawn as (select id, y, k, seed, 'balanced' as balance_mode from ranked where r <= k union all select id, y, k, seed, 'imbalanced' from ranked where y = 0 or r <= k)"""


def base(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id"), F.when(F.col("label") % 2 == 0, 1).otherwise(0).alias("label"))


def placed(spark: SparkSession, d: str) -> DataFrame:
    return class_splits(base(spark, d), [])


def pool(spark: SparkSession, d: str) -> DataFrame:
    return placed(spark, d).where("split = 'train_pool'")


def drawn(spark: SparkSession, d: str) -> DataFrame:
    return few_shot(pool(spark, d), [], KS, SEEDS, MODES)


@query("smp_1", f"with {PLACED} select id as sample_id, y as label, split from placed")
def smp_1(spark: SparkSession, d: str) -> DataFrame:
    return placed(spark, d)


@query("smp_2", f"with {DRAWN} select id as sample_id, y as label, k, seed, balance_mode from drawn")
def smp_2(spark: SparkSession, d: str) -> DataFrame:
    return drawn(spark, d)


DRAWS = 2000
HELD = f"""held_rows as (select id, row_number() over (order by id) - 1 as spot from placed where split = 'test'), size as (select count(*) as n from held_rows),
weights as (select b, spot, count(*) as times from (select b, cast('0x' || substr(md5(b || '|' || i), 1, 8) as bigint) % n as spot from size, range({DRAWS}) x(b), range((select n from size)) y(i)) group by all)"""


def resampled(spark: SparkSession, d: str) -> DataFrame:
    """``b, sample_id, times``: the configured number of bootstrap draws over the test split."""
    ids = placed(spark, d).where("split = 'test'").select("sample_id", F.lit("0").alias("key"))
    spots = ranked(ids.withColumn("key", F.lpad(F.hex("sample_id"), 16, "0")), [], "key", "sample_id", "r", 13).select("sample_id", (F.col("r") - 1).alias("row"))
    return bootstrap_weights(spots.count(), DRAWS, spark).join(spots, "row").select("b", "sample_id", "times")


@query("smp_3", f"with {PLACED}, {HELD} select b, id as sample_id, times from weights join held_rows using (spot)")
def smp_3(spark: SparkSession, d: str) -> DataFrame:
    return resampled(spark, d)


@query("win_1", "select sample_id, label, row_number() over (partition by label order by md5('42|' || sample_id), sample_id) as r from enron where label in (0, 1)")
def win_1(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "enron").select("sample_id", "label").where("label in (0, 1)").withColumn("_key", portable_key(42, F.col("sample_id")))
    return ranked(rows, ["label"], "_key", "sample_id").select("sample_id", "label", "r")


@query("win_2", f"with {DRAWN} select k, seed, balance_mode, count(*) filter (y = 1) as pos, count(*) filter (y = 0) as neg from drawn group by all")
def win_2(spark: SparkSession, d: str) -> DataFrame:
    return drawn(spark, d).groupBy("k", "seed", "balance_mode").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))


@query("split_manifest", f"with {PLACED} select count(*) as n_total, count(*) filter (y = 1) as n_pos_total, count(*) filter (y = 0) as n_neg_total, count(*) filter (split = 'train_pool') as train_pool_size, count(*) filter (split = 'eval') as eval_size, count(*) filter (split = 'test') as test_size, count(*) filter (split = 'eval' and y = 1) as eval_pos, count(*) filter (split = 'eval' and y = 0) as eval_neg, count(*) filter (split = 'test' and y = 1) as test_pos, count(*) filter (split = 'test' and y = 0) as test_neg from placed")
def split_manifest(spark: SparkSession, d: str) -> DataFrame:
    return split_counts(placed(spark, d), [])

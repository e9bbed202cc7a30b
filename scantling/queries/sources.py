"""Scans, sinks read back, and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scantling.plans.config import Config, grid
from scantling.queries import query, scratch
from scantling.session import table
from scantling.sources import store, texts
from scantling.sources.schemas import METRICS, RUNS

# isnan() may be folded away from the statistics of a file, so the value is read as text
CLEAN = ", ".join(f"case when {m}::varchar <> 'nan' then {m} end as {m}" for m in (*METRICS, "wall_clock_s"))
KEPT = ", ".join(c for c in RUNS.names if c not in (*METRICS, "wall_clock_s"))
CLEAN_RUNS = f"select {KEPT}, {CLEAN} from runs"
CELL = "model = 'orrin/lumen-4b' and dataset = 'enron' and mode = 'base' and layer = 8"


def runs(spark: SparkSession, d: str) -> DataFrame:
    return store.clean_metrics(table(spark, d, "runs").select(*RUNS.names))


@query("src_1", "select sample_id, text, label, 'spam' as task_type from enron")
def src_1(spark: SparkSession, d: str) -> DataFrame:
    return texts.spam(table(spark, d, "enron"), "enron")


@query("src_2", "select sample_id, text, label, 'spam' as task_type from sms")
def src_2(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "sms").withColumnRenamed("text", "sms")  # as the source has it
    return texts.spam(raw, "sms", "sms")


HONESTY_SQL = """
select sample_id, coalesce(nullif(coalesce(pressure_prompt, ''), ''), coalesce(proposition, text, '')) as text, coalesce(label, 1) as label,
  coalesce(belief_target, '') as belief_target, coalesce(pressure_prompt, '') as pressure_prompt,
  coalesce(belief_elicitation_prompt, '') as belief_elicitation_prompt, coalesce(proposition, text, '') as proposition, question_id, coalesce(category, 'unknown') as category
from mask"""


@query("src_3", HONESTY_SQL)
def src_3(spark: SparkSession, d: str) -> DataFrame:
    """The honesty corpus from its parts, one of which can't be read."""
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return texts.union_of(spark, [f"{d}/mask.parquet", f"{d}/absent.parquet"])


@query("src_4", "select * from nation")
def src_4(spark: SparkSession, d: str) -> DataFrame:
    return texts.read_any(spark, f"{d}/nation.parquet")


@query("src_6", f"select sample_id, label, x from activations where {CELL}")
def src_6(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "activations").where(CELL).select("sample_id", "label", "x")


@query("src_7", f"select model, dataset, mode, layer, sample_id, label, x from activations where {CELL}")
def src_7(spark: SparkSession, d: str) -> DataFrame:
    """The vector store written and one cell of it read."""
    path = scratch(spark, "vectors")
    store.write_vectors(table(spark, d, "activations").select("model", "dataset", "mode", "layer", "sample_id", "label", "x"), path)
    return store.read_vectors(spark, path, model="orrin/lumen-4b", dataset="enron", mode="base", layer=8)


@query("src_8", "select distinct model, replace(model, '/', '_') as safe from runs")
def src_8(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "runs").select("model", store.safe_name(F.col("model")).alias("safe")).distinct()


@query(
    "src_9",
    """with wanted as (select distinct model, dataset, mode, unnest([8, 16, 24, 32, 48]) as layer from activations),
have as (select model, dataset, mode, layer, count(*) as have from activations group by all),
n as (select model, dataset, max(have) as n from have group by all)
select w.* from wanted w where not exists (select 1 from have h join n using (model, dataset) where h.have = n.n and h.model = w.model and h.dataset = w.dataset and h.mode = w.mode and h.layer = w.layer)""",
)
def src_9(spark: SparkSession, d: str) -> DataFrame:
    """Cells that aren't whole, taking the fullest of each model for whole."""
    act = table(spark, d, "activations")
    wanted = act.select("model", "dataset", "mode").distinct().withColumn("layer", F.explode(F.array(*map(F.lit, (8, 16, 24, 32, 48)))))
    whole = act.groupBy(*store.CELL).count().groupBy("model", "dataset").agg(F.max("count").alias("n"))
    return store.incomplete_cells(wanted, act, whole)


@query("src_10", CLEAN_RUNS)
def src_10(spark: SparkSession, d: str) -> DataFrame:
    """Result rows appended twice, by dataset, as JSON lines and read back."""
    path = scratch(spark, "runs")
    some = table(spark, d, "runs").select(*RUNS.names)
    for part in ("enron", "mask"):
        store.append_runs(some.where(F.col("dataset") == part), path)
    return store.clean_metrics(store.read_runs(spark, path))


@query("src_11", CLEAN_RUNS)
def src_11(spark: SparkSession, d: str) -> DataFrame:
    return runs(spark, d)


@query("src_12", f"select run_id, dataset, k, test_auroc from ({CLEAN_RUNS})")
def src_12(spark: SparkSession, d: str) -> DataFrame:
    every = runs(spark, d).select("run_id", "dataset", "k", "test_auroc")
    return every.where("dataset = 'enron'").unionByName(every.where("dataset <> 'enron'"))


@query("src_13", "select distinct run_id from runs where run_id <> ''")
def src_13(spark: SparkSession, d: str) -> DataFrame:
    return store.known_ids(table(spark, d, "runs"))


SPLIT_ROWS = """
select distinct model, dataset, 'train_pool' as split, unnest(train_pool) as sample_id from splits
union select model, dataset, 'eval', unnest(eval) from splits
union select model, dataset, 'test', unnest(test) from splits"""


def split_rows(spark: SparkSession, d: str) -> DataFrame:
    """The union of the shards of each split map, as rows."""
    maps = table(spark, d, "splits")
    parts = F.array(*(F.struct(F.lit(s).alias("split"), F.col(s).alias("ids")) for s in ("train_pool", "eval", "test")))
    return maps.select("model", "dataset", F.explode(parts).alias("p")).select("model", "dataset", "p.split", F.explode("p.ids").alias("sample_id")).distinct()


@query("src_16", SPLIT_ROWS)
def src_16(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "splits")
    split_rows(spark, d).write.partitionBy("model", "dataset").parquet(path)
    return spark.read.parquet(path).select("model", "dataset", "split", "sample_id")


DIFF = "(cast('0x' || substr(md5(text), 1, 8) as bigint) % 2001 - 1000) / 1000.0::double"


@query("src_17", f"select sample_id from enron where text is not null and case when label = 1 then {DIFF} else -({DIFF}) end > 0")
def src_17(spark: SparkSession, d: str) -> DataFrame:
    """Keys kept by the confidence filter, written and read back."""
    from scantling.operators.sampling import confident
    from scantling.plans.encode import surrogate_difference

    path = scratch(spark, "kept")
    confident(surrogate_difference(table(spark, d, "enron"))).select("sample_id").write.parquet(path)
    return spark.read.parquet(path)


@query(
    "src_18",
    """select 'enron' as dataset, count(*) as n_total, count(*) filter (label = 1) as n_pos_total, count(*) filter (label = 0) as n_neg_total, round(avg(length(text)), 6) as mean_length from enron""",
)
def src_18(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "manifest")
    counts = table(spark, d, "enron").agg(F.lit("enron").alias("dataset"), F.count("*").alias("n_total"), F.count_if(F.col("label") == 1).alias("n_pos_total"), F.count_if(F.col("label") == 0).alias("n_neg_total"), F.round(F.avg(F.length("text")), 6).alias("mean_length"))
    store.write_manifest(counts, path)
    return spark.read.schema(counts.schema).json(path)


@query("src_19", "select dataset, model, count(*) as n from runs group by all")
def src_19(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "report")
    counts = table(spark, d, "runs").groupBy("dataset", "model").agg(F.count("*").alias("n"))
    store.write_csv(counts, path)
    return spark.read.schema(counts.schema).option("header", True).csv(path)


@query("src_20", "select n_nationkey, n_name, n_regionkey from nation")
def src_20(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "nation")
    rows = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    store.write_csv(rows, path)
    return spark.read.schema(rows.schema).option("header", True).csv(path)


@query("prj_1", "select text, label from enron")
def prj_1(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "enron").select("text", "label")


@query("prj_2", "select sample_id, text as message from sms")
def prj_2(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sms").select("sample_id", "text").withColumnRenamed("text", "message")


@query("prj_3", "select sample_id, 'honesty' as task_type from mask")
def prj_3(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "mask").select("sample_id").withColumn("task_type", F.lit("honesty"))


@query("prj_4", HONESTY_SQL)
def prj_4(spark: SparkSession, d: str) -> DataFrame:
    return texts.honesty(table(spark, d, "mask"))


@query("prj_5", "select run_id, scorer, k from runs")
def prj_5(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "runs")
    return df.select(*(c for c in ("run_id", "scorer", "k", "no_such_column") if c in df.columns))


@query("prj_9", "select sample_id, proposition, category, question_id from mask")
def prj_9(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "mask").select("sample_id", "text", "label", "proposition", "category", "question_id")
    return df.select("sample_id", F.struct(*(c for c in df.columns if c not in ("sample_id", "text", "label"))).alias("metadata")).select("sample_id", "metadata.*")


CONFIG = Config(models={"a/b": [8, 16], "c-2": [10]}, ood={"enron": "sms", "mask": None}, ks=[1, 5], seeds=2)


GRID_SQL = """
with m(model, layer) as (values ('a/b', 8), ('a/b', 16), ('c-2', 10)), o(dataset, ood_dataset) as (values ('enron', 'sms'), ('mask', null)),
s(scorer, mode) as (values ('P1_logistic', 'base'), ('P2_mass_mean', 'base'), ('P3_lda', 'base'), ('P4_cosine', 'base'), ('P6_prompted', 'prompted'), ('P7_mahalanobis', 'base'), ('P8_followup', 'followup')),
k(k) as (values (1), (5)), b(balance_mode) as (values ('balanced'), ('imbalanced')), e(seed) as (values (0), (1))
select model, layer, dataset, ood_dataset, scorer, mode, k, balance_mode, seed,
  concat_ws('__', replace(model, '/', '_'), dataset, scorer, 'layer' || layer, 'k' || k, 'seed' || seed, balance_mode) as run_id
from m, o, s, k, b, e"""


@query("join_5", GRID_SQL)
def join_5(spark: SparkSession, d: str) -> DataFrame:
    return grid(spark, CONFIG)

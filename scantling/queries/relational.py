"""Filters, joins, aggregates, windows, sorts and set operations over result rows and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scantling.functions.vectors import has_nan, without_nan
from scantling.operators import reports, significance
from scantling.operators.sampling import confident, split_counts
from scantling.plans.config import grid, pending
from scantling.plans.encode import surrogate_difference
from scantling.queries import query
from scantling.queries.sources import CLEAN_RUNS, CONFIG, DIFF, GRID_SQL, SPLIT_ROWS, runs, split_rows
from scantling.session import table

KS = [1, 2, 3, 5, 10, 25, 50, 100]
MEANS = ", ".join(f"round(avg({m}), 6) as {m}_mean, round(stddev_samp({m}), 6) as {m}_std" for m in reports.AVERAGED)
SUMMARY = f"summary as (select scorer, k, balance_mode, model, layer, dataset, {MEANS} from ({CLEAN_RUNS}) group by scorer, k, balance_mode, model, layer, dataset)"
BEST = f"{SUMMARY}, best as (select * exclude (r) from (select *, row_number() over (partition by scorer, k, balance_mode, model, dataset order by eval_recall_at_1pct_fpr_mean desc, layer) as r from summary where eval_recall_at_1pct_fpr_mean is not null) where r = 1)"
DECIDED = f"{BEST}, decided as (select * exclude (r) from (select *, row_number() over (partition by dataset, model, balance_mode, k order by test_recall_at_1pct_fpr_mean desc, scorer) as r from best where test_recall_at_1pct_fpr_mean is not null) where r = 1)"


def summary(spark: SparkSession, d: str) -> DataFrame:
    return reports.summary(runs(spark, d), 6)


def best(spark: SparkSession, d: str) -> DataFrame:
    return reports.best_layers(summary(spark, d))


@query("flt_1", f"select sample_id, label from enron where text is not null and case when label = 1 then {DIFF} else -({DIFF}) end > 0.25")
def flt_1(spark: SparkSession, d: str) -> DataFrame:
    return confident(surrogate_difference(table(spark, d, "enron")), threshold=0.25).select("sample_id", "label")


@query("flt_2", f"with kept as ({SPLIT_ROWS}) select distinct model, e.sample_id, label from enron e join kept k on k.sample_id = e.sample_id where dataset = 'enron'")
def flt_2(spark: SparkSession, d: str) -> DataFrame:
    """The mails that each model kept."""
    keys = split_rows(spark, d).where("dataset = 'enron'").select("model", "sample_id").distinct()
    return keys.join(table(spark, d, "enron").select("sample_id", "label"), "sample_id").select("model", "sample_id", "label")


@query("flt_3", "select sample_id, label from enron")
def flt_3(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "enron").select("sample_id", "label")


@query("flt_4", "select category, count(*) filter (label = 1) as pos, count(*) filter (label = 0) as neg, count(*) as n from mask group by category")
def flt_4(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "mask").groupBy("category").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"), F.count("*").alias("n"))


@query("flt_5", "select run_id from runs where model = 'orrin/lumen-4b' and dataset = 'enron' and scorer in ('P1_logistic', 'P4_cosine')")
def flt_5(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "runs").where((F.col("model") == "orrin/lumen-4b") & (F.col("dataset") == "enron") & F.col("scorer").isin("P1_logistic", "P4_cosine")).select("run_id")


@query("flt_6", "select distinct model from runs where contains(lower(model), 'quartz')")
def flt_6(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "runs").select("model").where(F.lower("model").contains("quartz")).distinct()


@query("flt_7", "select distinct r.model, r.dataset, r.layer from runs r join activations a on a.model = r.model and a.dataset = r.dataset and a.layer = r.layer")
def flt_7(spark: SparkSession, d: str) -> DataFrame:
    cells = table(spark, d, "activations").select("model", "dataset", "layer").distinct()
    return table(spark, d, "runs").select("model", "dataset", "layer").distinct().join(cells, ["model", "dataset", "layer"], "left_semi")


@query("flt_8", "select vec_id, len(list_filter(x, lambda v: isnan(v))) > 0 as dirty, case when len(list_filter(x, lambda v: isnan(v))) > 0 then list_transform(x, lambda v: 0::float) else x end as x from activations where x is not null")
def flt_8(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "activations").where("x is not null").select("vec_id", has_nan(F.col("x")).alias("dirty"), without_nan(F.col("x")).alias("x"))


@query("flt_9", f"select run_id from ({GRID_SQL}) where layer < 12")
def flt_9(spark: SparkSession, d: str) -> DataFrame:
    return grid(spark, CONFIG).where("layer < 12").select("run_id")


@query("flt_10", f"with {BEST} select scorer, k, test_recall_at_1pct_fpr_mean from best where test_recall_at_1pct_fpr_mean is not null")
def flt_10(spark: SparkSession, d: str) -> DataFrame:
    return best(spark, d).where("test_recall_at_1pct_fpr_mean is not null").select("scorer", "k", "test_recall_at_1pct_fpr_mean")


@query("join_1", f"select s.model, s.split, a.mode, a.layer, a.sample_id, a.vec_id, a.label from activations a join ({SPLIT_ROWS}) s on s.model = a.model and s.dataset = a.dataset and s.sample_id = a.sample_id")
def join_1(spark: SparkSession, d: str) -> DataFrame:
    return split_rows(spark, d).join(table(spark, d, "activations").select("model", "dataset", "mode", "layer", "sample_id", "vec_id", "label"), ["model", "dataset", "sample_id"]).select("model", "split", "mode", "layer", "sample_id", "vec_id", "label")


@query("join_2", "select a.vec_id, a.label as vector_label, e.label as mail_label from activations a join enron e using (sample_id)")
def join_2(spark: SparkSession, d: str) -> DataFrame:
    mails = table(spark, d, "enron").select("sample_id", F.col("label").alias("mail_label"))
    return table(spark, d, "activations").select("vec_id", "sample_id", F.col("label").alias("vector_label")).join(mails, "sample_id").drop("sample_id")


@query("join_3", "select distinct r.dataset, o.ood_dataset from runs r left join (values ('enron', 'sms')) o(dataset, ood_dataset) using (dataset)")
def join_3(spark: SparkSession, d: str) -> DataFrame:
    pairs = spark.createDataFrame([("enron", "sms")], "dataset string, ood_dataset string")
    return table(spark, d, "runs").select("dataset").distinct().join(F.broadcast(pairs), "dataset", "left")


@query("join_4", "select r.run_id, r.scorer, coalesce(m.mode, 'base') as mode from runs r left join (values ('P6_prompted', 'prompted'), ('P8_followup', 'followup')) m(scorer, mode) using (scorer)")
def join_4(spark: SparkSession, d: str) -> DataFrame:
    modes = spark.createDataFrame([("P6_prompted", "prompted"), ("P8_followup", "followup")], "scorer string, mode string")
    return table(spark, d, "runs").select("run_id", "scorer").join(F.broadcast(modes), "scorer", "left").withColumn("mode", F.coalesce("mode", F.lit("base")))


@query("join_6", "select distinct run_id from runs where k = 5 except select run_id from runs where k = 5 and not error and seed < 5")
def join_6(spark: SparkSession, d: str) -> DataFrame:
    every = table(spark, d, "runs").where("k = 5").select("run_id", "error", "seed")
    return pending(every.select("run_id").distinct(), every.where("not error and seed < 5"))


@query("join_7", "select sample_id from sms where sample_id in (select sample_id from enron where label = 1)")
def join_7(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sms").select("sample_id").join(table(spark, d, "enron").where("label = 1").select("sample_id"), "sample_id", "left_semi")


@query("join_9", f"with {BEST} select scorer, k, balance_mode, model, dataset, layer, test_auroc_mean from best")
def join_9(spark: SparkSession, d: str) -> DataFrame:
    return best(spark, d).select("scorer", "k", "balance_mode", "model", "dataset", "layer", "test_auroc_mean")


@query("agg_1", f"with {SUMMARY} select * from summary")
def agg_1(spark: SparkSession, d: str) -> DataFrame:
    return summary(spark, d)


@query("agg_2", f"with {BEST} select * from best")
def agg_2(spark: SparkSession, d: str) -> DataFrame:
    return best(spark, d)


@query("agg_3", f"with {DECIDED} select {', '.join(reports.DECISION)} from decided")
def agg_3(spark: SparkSession, d: str) -> DataFrame:
    return reports.decisions(best(spark, d))


FSEI = f"""{BEST}, points as (select scorer, balance_mode, model, dataset, case when test_recall_at_1pct_fpr_mean is not null then k end as k, test_recall_at_1pct_fpr_mean as r from best),
steps as (select *, (k - lag(k) over w) * (r + lag(r) over w) / 2.0::double as area from points window w as (partition by scorer, balance_mode, model, dataset order by k nulls first)),
raw_fsei as (select scorer, balance_mode, model, dataset, case when count(k) >= 2 then case when max(k) > min(k) then sum(area) / (max(k) - min(k)) else 0 end end as fsei, min(k) as k_min, max(k) as k_max from steps group by all),
fsei as (select scorer, balance_mode, model, dataset, round(fsei, 6) as fsei, k_min, k_max from raw_fsei)"""


def fsei(spark: SparkSession, d: str) -> DataFrame:
    return reports.efficiency(best(spark, d), KS).withColumn("fsei", F.round("fsei", 6))


@query("agg_4", f"with {FSEI} select * from fsei")
def agg_4(spark: SparkSession, d: str) -> DataFrame:
    return fsei(spark, d)


@query("agg_5", f"with {BEST} select scorer, balance_mode, model, dataset, list(k order by k) as ks, list(test_recall_at_1pct_fpr_mean order by k) as recalls, list(layer order by k) as layers from best group by all")
def agg_5(spark: SparkSession, d: str) -> DataFrame:
    entry = F.struct("k", F.col("test_recall_at_1pct_fpr_mean").alias("recall"), "layer")
    return best(spark, d).groupBy("scorer", "balance_mode", "model", "dataset").agg(F.array_sort(F.collect_list(entry)).alias("m")).select("scorer", "balance_mode", "model", "dataset", F.col("m.k").alias("ks"), F.col("m.recall").alias("recalls"), F.col("m.layer").alias("layers"))


@query(
    "agg_6",
    f"""with s as ({SPLIT_ROWS}), labels as (select 'enron' as dataset, sample_id, label from enron union all select 'mask', sample_id, label from mask), l as (select s.*, x.label from s join labels x using (dataset, sample_id))
select model, dataset, count(*) as n_total, count(*) filter (label = 1) as n_pos_total, count(*) filter (label = 0) as n_neg_total,
count(*) filter (split = 'train_pool') as train_pool_size, count(*) filter (split = 'eval') as eval_size, count(*) filter (split = 'test') as test_size,
count(*) filter (split = 'eval' and label = 1) as eval_pos, count(*) filter (split = 'eval' and label = 0) as eval_neg,
count(*) filter (split = 'test' and label = 1) as test_pos, count(*) filter (split = 'test' and label = 0) as test_neg from l group by model, dataset""",
)
def agg_6(spark: SparkSession, d: str) -> DataFrame:
    labels = [table(spark, d, t).select(F.lit(t).alias("dataset"), "sample_id", "label") for t in ("enron", "mask")]
    return split_counts(split_rows(spark, d).join(labels[0].unionByName(labels[1]), ["dataset", "sample_id"]), ["model", "dataset"])


@query("agg_7", f"select round(avg({DIFF}), 6) as mean_kept from enron where text is not null and case when label = 1 then {DIFF} else -({DIFF}) end > 0")
def agg_7(spark: SparkSession, d: str) -> DataFrame:
    return confident(surrogate_difference(table(spark, d, "enron"))).agg(F.round(F.avg("logit_diff"), 6).alias("mean_kept"))


@query("agg_10", f"with {DECIDED} select dataset, model, scorer, count(*) as wins from decided group by all")
def agg_10(spark: SparkSession, d: str) -> DataFrame:
    return reports.wins(reports.decisions(best(spark, d)))


@query("agg_11", f"with {DECIDED}, cells as (select distinct dataset, model from decided), scorers as (select distinct scorer from decided) select scorer, dataset, model, (select count(*) from decided d where d.scorer = s.scorer and d.dataset = c.dataset and d.model = c.model) as wins from scorers s, cells c")
def agg_11(spark: SparkSession, d: str) -> DataFrame:
    """The win matrix of all models, unpivoted: 0 where a scorer has no win."""
    won = reports.wins(reports.decisions(best(spark, d)))
    cells = [r["cell"] for r in won.select(F.concat_ws("|", "dataset", "model").alias("cell")).distinct().orderBy("cell").collect()]  # columns of a report
    pairs = F.explode(F.map_from_arrays(F.array(*map(F.lit, cells)), F.array(*(F.col(f"`{c}`") for c in cells)))).alias("cell", "wins")
    parts = F.split("cell", r"\|", 2)
    return reports.win_matrix(won, cells).select("scorer", pairs).select("scorer", parts[0].alias("dataset"), parts[1].alias("model"), "wins")


@query("agg_12", f"with {BEST} select k, scorer, dataset, round(avg(test_recall_at_1pct_fpr_mean), 6) as mean, round(stddev_samp(test_recall_at_1pct_fpr_mean), 6) as std, count(test_recall_at_1pct_fpr_mean) as n from best group by all")
def agg_12(spark: SparkSession, d: str) -> DataFrame:
    return reports.against_k(best(spark, d), "test_recall_at_1pct_fpr_mean").withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query("agg_13", f"with {FSEI} select scorer, dataset, round(avg(fsei), 5) as fsei from raw_fsei group by all")
def agg_13(spark: SparkSession, d: str) -> DataFrame:
    return reports.efficiency(best(spark, d), KS).groupBy("scorer", "dataset").agg(F.round(F.avg("fsei"), 5).alias("fsei"))


@query("agg_14", "select model, mode, layer, count(distinct label) < 2 as single from activations group by all")
def agg_14(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "activations").groupBy("model", "mode", "layer").agg((F.countDistinct("label") < 2).alias("single"))


@query("agg_15", f"select dataset, round(avg(d), 6) as mean, round(quantile_cont(d, 0.025), 6) as low, round(quantile_cont(d, 0.975), 6) as high, round(2 * least(avg((d <= 0)::int), avg((d >= 0)::int)), 6) as p from (select dataset, test_auroc - eval_auroc as d from ({CLEAN_RUNS}) where test_auroc is not null and eval_auroc is not null) group by dataset")
def agg_15(spark: SparkSession, d: str) -> DataFrame:
    diff = runs(spark, d).select("dataset", (F.col("test_auroc") - F.col("eval_auroc")).alias("d")).where("d is not null")
    p = 2 * F.least(F.avg((F.col("d") <= 0).cast("int")), F.avg((F.col("d") >= 0).cast("int")))
    return diff.groupBy("dataset").agg(*(F.round(e, 6).alias(n) for n, e in (("mean", F.avg("d")), ("low", F.percentile("d", F.lit(0.025))), ("high", F.percentile("d", F.lit(0.975))), ("p", p))))


@query("agg_16", "select count(*) as rows, count(distinct run_id) as runs, count(*) filter (error) as failed from runs")
def agg_16(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "runs").agg(F.count("*").alias("rows"), F.countDistinct("run_id").alias("runs"), F.count_if("error").alias("failed"))


@query("prj_6", f"with {BEST} select {', '.join(reports.OOD)} from best")
def prj_6(spark: SparkSession, d: str) -> DataFrame:
    return reports.ood_table(best(spark, d))


@query("prj_7", f"with {BEST} select {', '.join(reports.LAYERS)} from best")
def prj_7(spark: SparkSession, d: str) -> DataFrame:
    return reports.layer_choices(best(spark, d))


@query("prj_8", f"with {SUMMARY} select scorer, layer, test_auroc_mean, test_auroc_std from summary")
def prj_8(spark: SparkSession, d: str) -> DataFrame:
    return summary(spark, d).select("scorer", "layer", "test_auroc_mean", "test_auroc_std")


@query("dropped_groups", f"with {SUMMARY} select scorer, k, balance_mode, model, dataset, count(*) as layers from summary group by all having count(eval_recall_at_1pct_fpr_mean) = 0")
def dropped_groups(spark: SparkSession, d: str) -> DataFrame:
    return reports.without_metric(summary(spark, d))


PAIRS = f"""two as (select *, row_number() over (partition by dataset, model, balance_mode, k order by test_recall_at_1pct_fpr desc nulls last, run_id) as r from ({CLEAN_RUNS})),
pairs as (select dataset, model, balance_mode, k, max(case when r = 1 then scorer end) as scorer_a, max(case when r = 2 then scorer end) as scorer_b,
max(case when r = 1 then run_id end) as run_id_a, max(case when r = 2 then run_id end) as run_id_b from two where r <= 2 group by dataset, model, balance_mode, k having count(*) = 2)"""


@query("win_6", f"with {PAIRS} select * from pairs")
def win_6(spark: SparkSession, d: str) -> DataFrame:
    return significance.top_pairs(runs(spark, d))


@query("met_6", f"with {BEST}, two as (select *, row_number() over (partition by dataset, model, balance_mode, k order by test_recall_at_1pct_fpr_mean desc nulls last, scorer) as r from best) select dataset, model, balance_mode, k, max(case when r = 1 then scorer end) as scorer_a, max(case when r = 2 then scorer end) as scorer_b from two where r <= 2 group by dataset, model, balance_mode, k having count(*) = 2")
def met_6(spark: SparkSession, d: str) -> DataFrame:
    return significance.top_scorer_pairs(best(spark, d))


@query("win_7", f"with {BEST} select scorer, k, balance_mode, model, dataset, layer from best")
def win_7(spark: SparkSession, d: str) -> DataFrame:
    return best(spark, d).select("scorer", "k", "balance_mode", "model", "dataset", "layer")


@query("win_8", f"with {FSEI} select scorer, balance_mode, model, dataset, k, round(area, 8) as area from steps where area is not null")
def win_8(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("scorer", "balance_mode", "model", "dataset").orderBy("k")
    known = best(spark, d).where("test_recall_at_1pct_fpr_mean is not null").withColumnRenamed("test_recall_at_1pct_fpr_mean", "r")
    area = (F.col("k") - F.lag("k").over(w)) * (F.col("r") + F.lag("r").over(w)) / F.lit(2.0)
    return known.select("scorer", "balance_mode", "model", "dataset", "k", F.round(area, 8).alias("area")).where("area is not null")


@query("sort_1", f"with {DECIDED} select dataset, model, balance_mode, k, scorer from decided order by all")
def sort_1(spark: SparkSession, d: str) -> DataFrame:
    return reports.decisions(best(spark, d)).select("dataset", "model", "balance_mode", "k", "scorer").orderBy("dataset", "model", "balance_mode", "k", "scorer")


@query("sort_2", f"with {FSEI} select fsei from fsei order by fsei desc nulls last limit 20")
def sort_2(spark: SparkSession, d: str) -> DataFrame:
    return reports.top(fsei(spark, d), "fsei").select("fsei")


@query("sort_3", f"with {FSEI} select scorer, balance_mode, model, dataset, fsei from fsei order by fsei desc nulls last, scorer, balance_mode, model, dataset")
def sort_3(spark: SparkSession, d: str) -> DataFrame:
    return fsei(spark, d).select("scorer", "balance_mode", "model", "dataset", "fsei").orderBy(F.col("fsei").desc_nulls_last(), "scorer", "balance_mode", "model", "dataset")


@query("set_1", "select 'enron' as dataset, text, label from enron union all select 'sms', text, label from sms")
def set_1(spark: SparkSession, d: str) -> DataFrame:
    parts = [table(spark, d, n).select(F.lit(n).alias("dataset"), "text", "label") for n in ("enron", "sms")]
    return parts[0].unionByName(parts[1])


@query("set_2", "select run_id, loaded_at from runs where k < 10 union all select run_id, loaded_at from runs where k >= 10")
def set_2(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "runs").select("run_id", "loaded_at", "k")
    return df.where("k < 10").unionByName(df.where("k >= 10")).drop("k")


@query("set_3", "select sample_id, label, md5('42|' || sample_id) as ord from enron where label in (0, 1)")
def set_3(spark: SparkSession, d: str) -> DataFrame:
    from scantling.functions.order import portable_key

    df = table(spark, d, "enron").select("sample_id", "label")
    return df.where("label = 1").unionByName(df.where("label = 0")).withColumn("ord", portable_key(42, F.col("sample_id")))


@query("set_4", "select run_id, count(*) > 1 as repeated from runs group by run_id")
def set_4(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "runs").groupBy("run_id").agg((F.count("*") > 1).alias("repeated"))


@query("latest_runs", "select run_id, max(loaded_at) as loaded_at from runs group by run_id")
def latest_runs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "runs").groupBy("run_id").agg(F.max("loaded_at").alias("loaded_at"))



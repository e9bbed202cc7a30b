"""Scorers, metrics and the sweep, over the embeddings in four pseudo-layers of 16 values and over the stored vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scantling.operators import metrics, scorers, significance
from scantling.operators.sampling import draws
from scantling.plans import pipeline
from scantling.plans.config import Config
from scantling.queries import query, scratch
from scantling.queries.sampling import DRAWN, HELD, KS, MODES, PLACED, SEEDS, base, placed, resampled
from scantling.queries.sources import split_rows
from scantling.session import cut, table
from scantling.sources import store

CLOSED = ["P2_mass_mean", "P4_cosine"]
CELLS = ["layer", "k", "seed", "balance_mode"]


def layered(spark: SparkSession, d: str) -> DataFrame:
    """``sample_id, layer, x``"""
    layers = F.explode(F.array(*map(F.lit, range(4)))).alias("layer")
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id"), layers, "embedding").select("sample_id", "layer", F.slice("embedding", F.col("layer") * 16 + 1, 16).alias("x"))


LAYERED = "layered as (select vec_id as id, l::int as layer, embedding[16 * l + 1:16 * l + 16] as x from embeddings, range(4) t(l))"
PLACES = "places as (select id, layer, unnest(range(1, 17)) as i, unnest(x)::double as v from layered)"
MEANS = """means as (select layer, k, seed, balance_mode, i, avg(v) filter (y = 1) as up, avg(v) filter (y = 0) as down from drawn join places using (id) group by all)"""
_CELL = "layer, k, seed, balance_mode"
SCORED = f"""{DRAWN}, {LAYERED}, {PLACES}, {MEANS},
sums as (select m.layer, m.k, m.seed, m.balance_mode, p.id, sum(v * (up - down)) as d, sum(v * up) as vu, sum(v * down) as vd, sqrt(sum(v * v)) as nv, sqrt(sum(up * up)) as nu, sqrt(sum(down * down)) as nd, sqrt(sum((up - down) * (up - down))) as n
  from means m join places p on p.layer = m.layer and p.i = m.i join placed q on q.id = p.id where q.split <> 'train_pool' group by m.layer, m.k, m.seed, m.balance_mode, p.id),
scored as (select {_CELL}, id, 'P2_mass_mean' as scorer, round(case when n > 0 then d / n else d end, 6) as score from sums
  union all select {_CELL}, id, 'P4_cosine', round(case when nv * nu > 0 then vu / (nv * nu) else 0 end - case when nv * nd > 0 then vd / (nv * nd) else 0 end, 6) from sums),
held as (select s.*, q.y, q.split from scored s join placed q using (id))"""
CURVE = """tied as (select layer, k, seed, balance_mode, scorer, split, score, sum(y)::bigint as p, sum(1 - y)::bigint as q from held group by all),
curve as (select *, sum(p) over (c order by score desc) as tp, sum(q) over (c order by score desc) as fp, sum(p) over c as tot_p, sum(q) over c as tot_n,
  lead(p) over (c order by score desc) as np, lead(q) over (c order by score desc) as nq, row_number() over (c order by score desc) as i, count(*) over c as points
  from tied window c as (partition by layer, k, seed, balance_mode, scorer, split))"""
MEASURED = f"""{CURVE}, measured as (select layer, k, seed, balance_mode, scorer, split, (any_value(tot_p) + any_value(tot_n))::bigint as n, any_value(tot_p)::bigint as n_pos,
  sum(q * (tp - p + p / 2.0::double)) / (any_value(tot_p) * any_value(tot_n)) as auroc,
  max(case when (points <= 2 or i = 1 or np is null or p <> np or q <> nq) and fp <= 0.01::double * tot_n then tp else 0 end) / any_value(tot_p)::double as recall from curve group by layer, k, seed, balance_mode, scorer, split)"""


def means(spark: SparkSession, d: str, rows: DataFrame | None = None) -> DataFrame:
    """Class means of every sample over every layer; ``rows`` are of :func:`placed`."""
    train = (placed(spark, d) if rows is None else rows).where("split = 'train_pool'")
    return scorers.sample_means(draws(train, [], KS, SEEDS), train.join(layered(spark, d), "sample_id"), [], ["layer"], MODES)


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Scores of both closed forms on the held-out rows of every cell."""
    rows = cut(placed(spark, d))  # read three times: by the draws, the means and the scores
    held = rows.where("split <> 'train_pool'").join(layered(spark, d), "sample_id")
    return scorers.closed_scores(means(spark, d, rows), held, ["layer"], CLOSED).select(*CELLS, "scorer", "split", "sample_id", F.col("label").alias("y"), "score")


def measured(spark: SparkSession, d: str) -> DataFrame:
    m = metrics.ranking_metrics(scored(spark, d), [*CELLS, "scorer", "split"])
    return m.withColumns({c: F.round(c, 6) for c in ("auroc", "recall")})


@query("agg_8", f"with {DRAWN}, {LAYERED}, {PLACES}, {MEANS} select {_CELL}, i::int - 1 as i, round(up, 6) as up, round(down, 6) as down from means")
def agg_8(spark: SparkSession, d: str) -> DataFrame:
    return means(spark, d).select(*CELLS, F.posexplode(F.arrays_zip("up", "down")).alias("i", "m")).select(*CELLS, "i", F.round("m.up", 6).alias("up"), F.round("m.down", 6).alias("down"))


@query("scr_2", f"with {SCORED} select {_CELL}, id as sample_id, score from scored where scorer = 'P2_mass_mean'")
def scr_2(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).where("scorer = 'P2_mass_mean'").select(*CELLS, "sample_id", "score")


@query("scr_4", f"with {SCORED} select {_CELL}, id as sample_id, score from scored where scorer = 'P4_cosine'")
def scr_4(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).where("scorer = 'P4_cosine'").select(*CELLS, "sample_id", "score")


@query("met_1", f"with {SCORED}, {MEASURED} select {_CELL}, scorer, split, n, n_pos, round(auroc, 6) as auroc from measured")
def met_1(spark: SparkSession, d: str) -> DataFrame:
    return measured(spark, d).drop("recall")


@query("met_2", f"with {SCORED}, {MEASURED} select {_CELL}, scorer, split, n, n_pos, round(recall, 6) as recall from measured")
def met_2(spark: SparkSession, d: str) -> DataFrame:
    return measured(spark, d).drop("auroc")


@query("flagship", f"with {SCORED}, {MEASURED} select {_CELL}, scorer, split, n, n_pos, round(auroc, 6) as auroc, round(recall, 6) as recall from measured")
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Split, few-shot samples, two closed-form scorers and both metrics for all layers, k, seeds and balance modes in one plan."""
    return measured(spark, d)


@query("win_3", f"with {SCORED}, {CURVE} select {_CELL}, scorer, split, score, tp::bigint as tp, fp::bigint as fp from curve")
def win_3(spark: SparkSession, d: str) -> DataFrame:
    by = [*CELLS, "scorer", "split"]
    tied = scored(spark, d).groupBy(*by, "score").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q"))
    w = Window.partitionBy(*by).orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return tied.select(*by, "score", F.sum("p").over(w).alias("tp"), F.sum("q").over(w).alias("fp"))


@query("win_4", f"with {SCORED}, {CURVE} select {_CELL}, scorer, split, count(*) filter (points <= 2 or i = 1 or np is null or p <> np or q <> nq) as corners from curve group by all")
def win_4(spark: SparkSession, d: str) -> DataFrame:
    by = [*CELLS, "scorer", "split"]
    tied = scored(spark, d).groupBy(*by, "score").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q"))
    w = Window.partitionBy(*by).orderBy(F.col("score").desc())
    marked = tied.select(*by, ((F.count("*").over(Window.partitionBy(*by)) <= 2) | (F.row_number().over(w) == 1) | F.lead("p").over(w).isNull() | (F.col("p") != F.lead("p").over(w)) | (F.col("q") != F.lead("q").over(w))).alias("corner"))
    return marked.groupBy(*by).agg(F.count_if("corner").alias("corners"))


@query("win_5", f"with {SCORED} select {_CELL}, scorer, id as sample_id, rank() over (c order by score) + (count(*) over (partition by {_CELL}, scorer, split, score) - 1) / 2.0::double as rank from held where split = 'test' window c as (partition by {_CELL}, scorer, split)")
def win_5(spark: SparkSession, d: str) -> DataFrame:
    by = [*CELLS, "scorer", "split"]
    ties = F.count("*").over(Window.partitionBy(*by, "score")) - 1
    rank = F.rank().over(Window.partitionBy(*by).orderBy("score")) + ties / F.lit(2.0)
    return scored(spark, d).where("split = 'test'").select(*CELLS, "scorer", "sample_id", rank.alias("rank"))


@query(
    "join_8",
    f"with {SCORED} select {_CELL}, count(*) as n, bool_and(a.y = b.y) as aligned from held a join held b using ({_CELL}, id, split) where a.scorer = 'P2_mass_mean' and b.scorer = 'P4_cosine' and split = 'test' group by {_CELL}",
)
def join_8(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(spark, d).where("split = 'test'")
    a, b = (rows.where(F.col("scorer") == s).select(*CELLS, "sample_id", F.col("y").alias(f"y_{s[:2]}")) for s in CLOSED)
    return a.join(b, [*CELLS, "sample_id"]).groupBy(*CELLS).agg(F.count("*").alias("n"), F.bool_and(F.col("y_P2") == F.col("y_P4")).alias("aligned"))


def _runs_of(rows: DataFrame) -> DataFrame:
    """Predictions under ids of their runs."""
    name = F.concat_ws("__", "scorer", *(F.concat(F.lit(c), F.col(c).cast("string")) for c in ("layer", "k", "seed")), "balance_mode")
    return rows.select(name.alias("run_id"), "split", "sample_id", "y", "score")


_RUN = "concat_ws('__', scorer, 'layer' || layer, 'k' || k, 'seed' || seed, balance_mode)"


@query("src_14", f"with {SCORED} select {_RUN} as run_id, split, id as sample_id, y, score from held")
def src_14(spark: SparkSession, d: str) -> DataFrame:
    """Predictions written and read back."""
    path = scratch(spark, "predictions")
    store.write_predictions(_runs_of(scored(spark, d)), path)
    return store.read_predictions(spark, path)


@query("src_15", f"with {SCORED} select {_RUN} as run_id, split, id as sample_id, y, score from held where scorer = 'P4_cosine' and layer = 2 and k = 5 and seed = 1 and balance_mode = 'balanced'")
def src_15(spark: SparkSession, d: str) -> DataFrame:
    return _runs_of(scored(spark, d)).where("run_id = 'P4_cosine__layer2__k5__seed1__balanced'")


@query("sort_5", f"with {DRAWN}, {LAYERED}, {PLACES}, {MEANS} select {_CELL}, i::int - 1 as i, r::int as r from (select *, row_number() over (partition by {_CELL} order by round(abs(up - down), 9) desc, i) as r from means) where r <= 4")
def sort_5(spark: SparkSession, d: str) -> DataFrame:
    """The four places whose class means differ most."""
    places = means(spark, d).select(*CELLS, F.posexplode(F.zip_with("up", "down", lambda a, b: F.round(F.abs(a - b), 9))).alias("i", "gap"))
    w = Window.partitionBy(*CELLS).orderBy(F.col("gap").desc(), "i")
    return places.withColumn("r", F.row_number().over(w)).where("r <= 4").select(*CELLS, "i", "r")


BOOT = f"""{HELD}, btied as (select b, layer, k, seed, balance_mode, scorer, score, sum(y * times)::bigint as p, sum((1 - y) * times)::bigint as q
  from weights join held_rows using (spot) join held using (id) where split = 'test' group by all),
barea as (select b, layer, k, seed, balance_mode, scorer, case when any_value(tp) > 0 and any_value(tn) > 0 then sum(q * (cp - p + p / 2.0::double)) / (any_value(tp) * any_value(tn)) end as auroc
  from (select *, sum(p) over (c order by score desc) as cp, sum(p) over c as tp, sum(q) over c as tn from btied window c as (partition by b, layer, k, seed, balance_mode, scorer)) group by b, layer, k, seed, balance_mode, scorer),
diffs as (select b, layer, k, seed, balance_mode, max(case when scorer = 'P2_mass_mean' then auroc end) - max(case when scorer = 'P4_cosine' then auroc end) as d from barea group by all)"""


@query(
    "met_4",
    f"with {SCORED}, {BOOT} select {_CELL}, round(avg(d), 6) as mean_diff, round(quantile_cont(d, 0.025), 6) as ci_low, round(quantile_cont(d, 0.975), 6) as ci_high, round(2 * least(avg(coalesce((d <= 0)::int, 0)), avg(coalesce((d >= 0)::int, 0))), 6) as p_value from diffs group by all",
)
def met_4(spark: SparkSession, d: str) -> DataFrame:
    """Paired bootstrap of AUROC between the closed forms in every cell, drawn by hash, wholly as a plan: draws weigh rows, which are counted by score."""
    series = F.xxhash64(*CELLS, "scorer").alias("series")
    rows = cut(scored(spark, d).where("split = 'test'").select(*CELLS, "scorer", "sample_id", "y", "score", series))
    names = rows.select("series", *CELLS, "scorer").distinct()  # a row for each cell and scorer
    slim = rows.select("series", "sample_id", "y", "score").join(resampled(spark, d), "sample_id")
    each = metrics.areas(slim, ["series", "b"], F.col("times")).join(F.broadcast(names), "series")
    a, b = (F.max(F.when(F.col("scorer") == s, F.col("auroc"))) for s in CLOSED)
    diff = each.groupBy(*CELLS, "b").agg((a - b).alias("d"))
    side = lambda c: F.avg(F.coalesce(c.cast("int"), F.lit(0)))
    p = 2 * F.least(side(F.col("d") <= 0), side(F.col("d") >= 0))
    low, high = (F.percentile("d", F.lit(q)) for q in (0.025, 0.975))
    return diff.groupBy(*CELLS).agg(*(F.round(e, 6).alias(name) for name, e in (("mean_diff", F.avg("d")), ("ci_low", low), ("ci_high", high), ("p_value", p))))


def _compared(spark: SparkSession, d: str, metric: str, strict: bool = False) -> DataFrame:
    rows = _runs_of(scored(spark, d))
    ids = rows.select(F.regexp_replace("run_id", "^P[24]_[a-z_]+?__", "").alias("rest")).distinct()
    pairs = ids.select(F.concat(F.lit("P2_mass_mean__"), "rest").alias("run_id_a"), F.concat(F.lit("P4_cosine__"), "rest").alias("run_id_b"))
    return significance.compare(significance.paired(rows, pairs, "test"), "test", metric, Config({}, {}).draws, 0, strict)


@query("met_3")
def met_3(spark: SparkSession, d: str) -> DataFrame:
    return _compared(spark, d, "auroc", True)


@query("met_5")
def met_5(spark: SparkSession, d: str) -> DataFrame:
    return _compared(spark, d, "recall_at_1pct_fpr")


@query("met_7")
def met_7(spark: SparkSession, d: str) -> DataFrame:
    """The significance phase over the sweep of the embeddings: the top pair of every setting, compared on the predictions of both with the configured draws."""
    models, scores = _swept(spark, d, list(scorers.REGISTRY))
    path = scratch(spark, "swept")
    store.write_predictions(scores, path)
    predictions = store.read_predictions(spark, path)
    rows = scorers.result_rows(models, predictions)
    return significance.significance(store.clean_metrics(cut(rows)), predictions, draws=Config({}, {}).draws)


_FSEI = """means as (select scorer, balance_mode, model, dataset, layer, k, avg(case when isnan(test_recall_at_1pct_fpr) then null else test_recall_at_1pct_fpr end) as r from runs group by all),
points as (select *, lag(k) over w as k0, lag(r) over w as r0, count(*) over (partition by scorer, balance_mode, model, dataset, layer) as n from means where r is not null window w as (partition by scorer, balance_mode, model, dataset, layer order by k))"""


@query(
    "met_8",
    f"with {_FSEI} select scorer, balance_mode, model, dataset || '/' || layer as dataset, case when any_value(n) > 1 then round(sum((k - k0) * (r + r0) / 2) / (max(k) - min(k)), 6) end as fsei from points group by scorer, balance_mode, model, dataset, layer",
)
def met_8(spark: SparkSession, d: str) -> DataFrame:
    """Area under recall over k of every scorer at every layer of the result table."""
    from scantling.operators.reports import efficiency
    from scantling.queries.sources import runs

    by = ["scorer", "balance_mode", "model", "dataset", "k"]
    recall = store.clean_metrics(runs(spark, d)).withColumn("dataset", F.concat_ws("/", "dataset", "layer"))
    rows = recall.groupBy(*by).agg(F.avg("test_recall_at_1pct_fpr").alias("test_recall_at_1pct_fpr_mean")).where("test_recall_at_1pct_fpr_mean is not null")
    ks = [r["k"] for r in rows.select("k").distinct().collect()]  # values of k in use
    return efficiency(rows, ks).select("scorer", "balance_mode", "model", "dataset", F.round("fsei", 6).alias("fsei"))


FULL = Config({}, {})


def _swept(spark: SparkSession, d: str, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """Models and scores of the sweep over the embeddings with all k and seeds: one model, four layers, all rows labelled 0 to 2 as the other dataset."""
    cell = [F.lit("m/e").alias("model"), F.lit("even").alias("dataset")]
    vecs = layered(spark, d).join(base(spark, d), "sample_id")
    modes = F.explode(F.array(*map(F.lit, sorted({scorers.REGISTRY[n].mode for n in names})))).alias("mode")
    stored = vecs.select(*cell, modes, "layer", "sample_id", "label", "x")
    splits = placed(spark, d).select(*cell, "split", "sample_id", "label")
    drawn = draws(splits.where("split = 'train_pool'"), ["model", "dataset"], FULL.ks, FULL.seeds)
    ood = table(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id"), F.when(F.col("label") < 3, 1).otherwise(0).alias("label"))
    other = layered(spark, d).join(ood, "sample_id").select(*cell, modes, "layer", "sample_id", "label", "x")
    runs = scorers.wanted(stored.select("model", "dataset", "mode", "layer").distinct(), names, FULL.ks, FULL.seeds, FULL.balance_modes)
    return pipeline.sweep_scores(stored, splits, runs, drawn, other)


def _results(swept: tuple[DataFrame, DataFrame]) -> DataFrame:
    return scorers.result_rows(swept[0], cut(swept[1])).drop("wall_clock_s")


def _scorer_query(number: int, name: str) -> None:
    @query(f"scr_{number}")
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _results(_swept(spark, d, [name]))


for _number, _name in ((1, "P1_logistic"), (3, "P3_lda"), (6, "P6_prompted"), (7, "P7_mahalanobis"), (8, "P8_followup")):
    _scorer_query(_number, _name)


@query("scr_5")
def scr_5(spark: SparkSession, d: str) -> DataFrame:
    """The scorer on sparse features, with a fixed random encoder plugged in."""
    import numpy as np

    weights = np.random.default_rng(0).standard_normal((16, 96))
    scorers.register(scorers.Scorer("P5_sae", scorers.sparse_features(lambda v: np.maximum(v @ weights, 0), 16)))
    try:
        return _results(_swept(spark, d, ["P5_sae"]))
    finally:
        del scorers.REGISTRY["P5_sae"]


@query("met_9")
def met_9(spark: SparkSession, d: str) -> DataFrame:
    """The whole sweep over the embeddings: seven scorers, three modes, four layers, all k and seeds."""
    return _results(_swept(spark, d, list(scorers.REGISTRY)))


@query("sweep_vectors")
def sweep_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The sweep over the stored vectors and split maps of the mails: all scorers, k and seeds."""
    vecs = table(spark, d, "activations").where("x is not null").select("model", "dataset", "mode", "layer", "sample_id", "label", "x")
    vecs = vecs.dropDuplicates(["model", "dataset", "mode", "layer", "sample_id"])
    splits = split_rows(spark, d).where("dataset = 'enron'")
    once = splits.groupBy("model", "dataset", "sample_id").agg(F.max("split").alias("split"))  # an id in several splits counts for training
    # samples are drawn among rows that have vectors; cells differ in these, so each is a dataset of its own here
    one = cut(vecs.withColumn("dataset", F.concat_ws("/", "dataset", "mode", "layer")))
    placed_rows = cut(one.join(once.drop("dataset"), ["model", "sample_id"]).select("model", "dataset", "split", "sample_id", "label"))
    drawn = draws(placed_rows.where("split = 'train_pool'"), ["model", "dataset"], FULL.ks, FULL.seeds)
    runs = scorers.wanted(one.select("model", "dataset", "mode", "layer").distinct(), list(scorers.REGISTRY), FULL.ks, FULL.seeds, FULL.balance_modes)
    return pipeline.sweep_runs(one, placed_rows, runs, drawn).drop("wall_clock_s")


@query("fn_23")
def fn_23(spark: SparkSession, d: str) -> DataFrame:
    """Distances of the Mahalanobis scorer as predictions."""
    rows = _swept(spark, d, ["P7_mahalanobis"])[1]
    return rows.where("split <> '_seconds'").withColumn("score", F.round("score", 6))


# The fitted scorers on vectors of one value, where SQL can express them.


def _lined(spark: SparkSession, d: str, name: str) -> DataFrame:
    """Scores of a fitted scorer on the first value of the embeddings, for every sample."""
    cell = [F.lit("m").alias("model"), F.lit("line").alias("dataset")]
    vecs = table(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id"), F.slice("embedding", 1, 1).alias("x")).join(base(spark, d), "sample_id").select(*cell, F.lit("base").alias("mode"), F.lit(0).alias("layer"), "sample_id", "label", "x")
    splits = placed(spark, d).select(*cell, "split", "sample_id", "label")
    runs = scorers.wanted(vecs.select("model", "dataset", "mode", "layer").distinct(), [name], KS, SEEDS, MODES)
    models, scores = pipeline.sweep_scores(vecs, splits, runs, draws(splits.where("split = 'train_pool'"), ["model", "dataset"], KS, SEEDS))
    return scores.where("split <> '_seconds'").join(models.select("run_id", "k", "seed", "balance_mode"), "run_id").select("k", "seed", "balance_mode", "split", "sample_id", F.round("score", 5).alias("score"))


LINE = f"""{DRAWN}, line as (select vec_id as id, embedding[1]::double as v from embeddings), train as (select k, seed, balance_mode, y, v from drawn join line using (id)),
held_line as (select id, split, v from placed join line using (id) where split <> 'train_pool'),
side as (select k, seed, balance_mode, count(*) as n, count(*) filter (y = 1) as n1, count(*) filter (y = 0) as n0, avg(v) filter (y = 1) as m1, avg(v) filter (y = 0) as m0,
  coalesce(var_pop(v) filter (y = 1), 0) as s1, coalesce(var_pop(v) filter (y = 0), 0) as s0 from train group by all)"""
_OUT = "k, seed, balance_mode, split, id as sample_id"


@query("scr_7_line", f"with {LINE} select {_OUT}, round(case when s0 > 0 then abs(v - m0) / sqrt(s0) else 0 end, 5) as score from side, held_line where n0 >= 2")
def scr_7_line(spark: SparkSession, d: str) -> DataFrame:
    return _lined(spark, d, "P7_mahalanobis")


@query("scr_3_line", f"with {LINE}, pooled as (select *, (n1 * s1 + n0 * s0) / n as s from side where n > 2 and n1 > 0 and n0 > 0) select {_OUT}, round(v * (m1 - m0) / s - 0.5 * (m1 * m1 - m0 * m0) / s + ln(n1::double / n0), 5) as score from pooled, held_line")
def scr_3_line(spark: SparkSession, d: str) -> DataFrame:
    return _lined(spark, d, "P3_lda")


def _newton(rounds: int = 14) -> str:
    """Newton's steps for the logistic scorer of one value, one after the other."""
    out = ["fit0 as (select k, seed, balance_mode, 0.0::double as w, 0.0::double as b from side where n1 > 0 and n0 > 0)"]
    for i in range(rounds):
        out.append(
            f"""grad{i} as (select k, seed, balance_mode, any_value(w) as w, any_value(b) as b, sum((p - y) * v) + any_value(w) as gw, sum(p - y) as gb, sum(p * (1 - p) * v * v) + 1 as hww, sum(p * (1 - p) * v) as hwb, sum(p * (1 - p)) + 1e-10 as hbb
  from (select *, 1 / (1 + exp(-(w * v + b))) as p from train join fit{i} using (k, seed, balance_mode)) group by k, seed, balance_mode),
fit{i + 1} as (select k, seed, balance_mode, w - (hbb * gw - hwb * gb) / (hww * hbb - hwb * hwb) as w, b - (hww * gb - hwb * gw) / (hww * hbb - hwb * hwb) as b from grad{i})"""
        )
    return ",\n".join(out) + f",\nfitted as (select * from fit{rounds})"


@query("scr_1_line", f"with {LINE}, {_newton()} select {_OUT}, round(1 / (1 + exp(-(w * v + b))), 5) as score from fitted, held_line")
def scr_1_line(spark: SparkSession, d: str) -> DataFrame:
    return _lined(spark, d, "P1_logistic")


_GRID = f"""{PLACED}, ranked as (select y, k, seed, row_number() over (partition by k, seed, y order by md5(seed || '|' || k || '|' || id), id) as r from placed, (values {", ".join(f"({k})" for k in FULL.ks)}) k(k), range({FULL.seeds}) s(seed) where split = 'train_pool'),
counts as (select k, seed, count(*) filter (y = 1) as pool_pos, count(*) filter (y = 0) as pool_neg from ranked group by all having count(*) filter (y = 1) >= k),
sizes_of as (select k, seed, b as balance_mode, k as n_train_pos, case when b = 'balanced' then least(k, pool_neg) else pool_neg end as n_train_neg from counts, (values ('balanced'), ('imbalanced')) m(b)),
methods as (select * from (values ('P1_logistic'), ('P2_mass_mean'), ('P3_lda'), ('P4_cosine'), ('P6_prompted'), ('P7_mahalanobis'), ('P8_followup')) t(scorer)),
grid as (select *, scorer = 'P3_lda' and n_train_pos + n_train_neg <= 2 or scorer = 'P7_mahalanobis' and n_train_neg < 2 as error from sizes_of, methods, range(4) l(layer))"""


@query(
    "sweep_grid",
    f"with {_GRID} select 'm_e__even__' || scorer || '__layer' || layer || '__k' || k || '__seed' || seed || '__' || balance_mode as run_id, scorer, layer::int as layer, k::int as k, seed::int as seed, balance_mode, n_train_pos::int as n_train_pos, n_train_neg::int as n_train_neg, error, case when error then 'ValueError' end as error_type from grid",
)
def sweep_grid(spark: SparkSession, d: str) -> DataFrame:
    """All runs of the sweep over the embeddings: sizes of their samples, and which can't be fitted."""
    return _swept(spark, d, list(scorers.REGISTRY))[0].select("run_id", "scorer", "layer", "k", "seed", "balance_mode", "n_train_pos", "n_train_neg", "error", "error_type")

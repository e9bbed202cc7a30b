"""Sampling, scorers, metrics, reports and stores on small fixtures."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scantling.functions import prompts
from scantling.functions import vectors as vec
from scantling.functions.order import portable_key, ranked
from scantling.operators import metrics, reports, sampling, scorers, significance
from scantling.plans import config as conf
from scantling.plans import pipeline
from scantling.plans.encode import hashed
from scantling.sources import store, texts
from scantling.sources.schemas import RUNS, spec


def brute_auroc(y, s):
    pos, neg = [a for a, b in zip(s, y) if b == 1], [a for a, b in zip(s, y) if b == 0]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg)) if pos and neg else math.nan


def brute_recall(y, s, cap=0.01):
    values = sorted(set(s), reverse=True)
    points = [(sum(b == 0 and a >= v for a, b in zip(s, y)), sum(b == 1 and a >= v for a, b in zip(s, y))) for v in values]
    n, p = points[-1]
    if not n or not p:
        return math.nan
    if len(points) > 2:
        before = [(0, 0), *points]
        keep = [True] * len(points)
        for i in range(1, len(points) - 1):
            (a, b), (c, d), (e, f) = before[i], points[i], points[i + 1]
            keep[i] = (e - c, f - d) != (c - a, d - b)
        points = [x for x, k in zip(points, keep) if k]
    return max([t for f, t in points if f <= cap * n], default=0) / p


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 6)), min_size=1, max_size=40))
def test_metrics_against_brute_force(rows):
    y, s = [a for a, _ in rows], [float(b) for _, b in rows]
    assert metrics.auroc(np.array(y), np.array(s)) == pytest.approx(brute_auroc(y, s), nan_ok=True)
    assert metrics.recall_at(np.array(y), np.array(s), max_fpr=0.3) == pytest.approx(brute_recall(y, s, 0.3), nan_ok=True)


def test_metric_plan_equals_functions(spark):
    rng = np.random.default_rng(1)
    rows = [(g, int(rng.integers(0, 2)) if g else 1, float(rng.integers(0, 30)) / 3) for g in range(5) for _ in range(200)]
    got = {r["g"]: r for r in metrics.ranking_metrics(spark.createDataFrame(rows, "g int, y int, score double"), ["g"], 0.05).collect()}
    for g in range(5):
        y, s = np.array([r[1] for r in rows if r[0] == g]), np.array([r[2] for r in rows if r[0] == g])
        if g == 0:
            assert got[g]["auroc"] is None and got[g]["recall"] is None
        else:
            assert got[g]["auroc"] == pytest.approx(metrics.auroc(y, s))
            assert got[g]["recall"] == pytest.approx(metrics.recall_at(y, s, max_fpr=0.05))


def test_collinear_ties(spark):
    rows = [(i % 2 ^ 1, float(-(i // 4))) for i in range(800)]
    r = metrics.ranking_metrics(spark.createDataFrame(rows, "y int, score double"), []).first()
    assert (r["recall"], r["auroc"]) == (0.005, 0.5)


def test_weights_are_repeats():
    rng = np.random.default_rng(3)
    y, s, w = rng.integers(0, 2, 50), rng.integers(0, 9, 50).astype(float), rng.integers(0, 4, 50)
    assert metrics.auroc(y, s, w) == pytest.approx(metrics.auroc(np.repeat(y, w), np.repeat(s, w)))
    assert metrics.recall_at(y, s, w, 0.2) == pytest.approx(metrics.recall_at(np.repeat(y, w), np.repeat(s, w), None, 0.2))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 5)), min_size=1, max_size=25), st.integers(0, 1000))
def test_curves_of_draws_are_curves(rows, seed):
    y, s = np.array([a for a, _ in rows]), np.array([float(b) for _, b in rows])
    weights = np.random.default_rng(seed).integers(0, 3, (6, len(y)))
    area, recall = metrics.curves(y, s, weights, 0.3)
    for k, w in enumerate(weights):
        assert area[k] == pytest.approx(metrics.auroc(y, s, w), nan_ok=True) and recall[k] == pytest.approx(metrics.recall_at(y, s, w, 0.3), nan_ok=True)


def test_bootstrap_variants():
    y = np.array([1, 0, 0, 0, 0, 0])
    a, b = np.array([0.9, 0.1, 0.2, 0.3, 0.4, 0.5]), np.array([0.1, 0.9, 0.2, 0.3, 0.4, 0.5])
    loose = metrics.bootstrap_difference(y, a, b, "auroc", 200, 0)
    strict = metrics.bootstrap_difference(y, a, b, "auroc", 200, 0, strict=True)
    assert loose["score_a"] == 1.0 and strict["mean_diff"] == pytest.approx(1.0)
    assert loose["p_value"] <= 2 * 1.0 and strict["p_value"] <= 1.0
    with pytest.raises(ValueError):
        metrics.bootstrap_difference(y, a[:-1], b, "auroc", 2, 0)
    with pytest.raises(ValueError):
        metrics.bootstrap_difference(y, a, b, "nope", 2, 0)


def test_efficiency(spark):
    assert metrics.efficiency_index({1: 0.1, 2: 0.3, 5: 0.6}, [1, 2, 5, 10]) == pytest.approx(0.3875)
    assert math.isnan(metrics.efficiency_index({1: 0.1}, [1, 2]))
    rows = [("a", "b", "m", "d", 1, 0.1), ("a", "b", "m", "d", 2, 0.3), ("a", "b", "m", "d", 5, 0.6), ("x", "b", "m", "d", 1, 0.4), ("x", "b", "m", "d", 2, None)]
    got = {r["scorer"]: r for r in reports.efficiency(spark.createDataFrame(rows, "scorer string, balance_mode string, model string, dataset string, k int, test_recall_at_1pct_fpr_mean double"), [1, 2, 5]).collect()}
    assert got["a"]["fsei"] == pytest.approx(0.3875) and got["x"]["fsei"] is None and got["x"]["k_max"] == 1


def test_split_sizes_and_invariants(spark):
    df = spark.range(500).select(F.col("id").alias("sample_id"), F.when(F.col("id") < 50, 1).otherwise(0).alias("label"))
    counts = {(r["split"], r["label"]): r["n"] for r in sampling.class_splits(df, []).groupBy("split", "label").agg(F.count("*").alias("n")).collect()}
    assert counts == {("test", 1): 7, ("test", 0): 7, ("eval", 1): 7, ("eval", 0): 7, ("train_pool", 1): 36, ("train_pool", 0): 436}


def test_few_shot(spark):
    df = spark.range(40).select(F.lit("c").alias("cell"), F.col("id").alias("sample_id"), F.when(F.col("id") < 6, 1).otherwise(0).alias("label"))
    got = sampling.few_shot(df, ["cell"], [2, 6, 7], 2, ["balanced", "imbalanced"]).toPandas()
    sizes = got.groupby(["k", "seed", "balance_mode", "label"]).size()
    assert sizes[2, 0, "balanced", 1] == 2 and sizes[2, 0, "balanced", 0] == 2 and sizes[6, 1, "imbalanced", 0] == 34
    assert 7 not in set(got.k)
    with pytest.raises(ValueError):
        sampling.few_shot(df, ["cell"], [1], 1, ["odd"])
    assert sampling.few_shot(df.where("false"), ["cell"], [1], 1, ["balanced"]).count() == 0


def test_weights_of_draws(spark):
    got = sampling.bootstrap_weights(7, 5, spark).groupBy("b").agg(F.sum("times").alias("n"), F.max("row").alias("high")).collect()
    assert len(got) == 5 and all(r["n"] == 7 and r["high"] < 7 for r in got)
    with pytest.raises(ValueError):
        sampling.class_splits(spark.range(1).selectExpr("id as sample_id", "1 as label"), [], test_share=0.8, eval_share=0.3)


def test_ranked_is_a_row_number(spark):
    df = spark.range(300).select((F.col("id") % 3).alias("g"), F.col("id"), portable_key(1, F.col("id") % 50).alias("key"))
    df = df.unionByName(spark.createDataFrame([(None, 1000, "ff")], "g long, id long, key string"))
    got = ranked(df, ["g"], "key", "id").toPandas()
    for _, part in got.groupby("g", dropna=False):
        assert part.sort_values(["key", "id"]).r.tolist() == list(range(1, len(part) + 1))


def test_logistic_gradient_vanishes():
    rng = np.random.default_rng(0)
    for n, d in ((60, 5), (8, 30)):
        x, y = rng.standard_normal((n, d)), np.r_[np.ones(n // 2), np.zeros(n - n // 2)].astype(int)
        score = scorers.logistic(x, y)
        zero, unit = score(np.zeros((1, d)))[0], np.array([score(np.eye(d)[[i]])[0] for i in range(d)])
        b = np.log(zero / (1 - zero))
        w = np.log(unit / (1 - unit)) - b
        p = 1 / (1 + np.exp(-(x @ w + b)))
        assert np.abs(x.T @ (p - y) + w).max() < 1e-5 and abs((p - y).sum()) < 1e-5


def test_shrinkage_and_distance_agree_with_dense():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((9, 25))
    y = np.array([0] * 7 + [1] * 2)
    z = x[y == 0] - x[y == 0].mean(0)
    s, mu = scorers.shrinkage(z)
    n, d = z.shape
    cov = z.T @ z / n
    beta = sum(np.linalg.norm(np.outer(r, r) - cov) ** 2 for r in z) / n**2
    delta = np.linalg.norm(cov - np.trace(cov) / d * np.eye(d)) ** 2
    assert s == pytest.approx(min(beta, delta) / delta)
    dense = np.linalg.inv((1 - s) * cov + s * mu * np.eye(d))
    c = x - x[y == 0].mean(0)
    assert scorers.mahalanobis(x, y)(x) == pytest.approx(np.sqrt(np.einsum("ij,jk,ik->i", c, dense, c)))
    with pytest.raises(ValueError):
        scorers.mahalanobis(x[6:8], y[6:8])
    with pytest.raises(ValueError):
        scorers.discriminant(x[6:8], y[6:8])


def test_scorers_separate():
    rng = np.random.default_rng(4)
    x = np.r_[rng.standard_normal((40, 6)) + 1.5, rng.standard_normal((40, 6))]
    y = np.r_[np.ones(40), np.zeros(40)].astype(int)
    for s in scorers.REGISTRY.values():
        assert metrics.auroc(y, s.fit(x, y)(x)) > 0.85, s.name
    assert scorers.cosine_difference(np.zeros((2, 3)), np.array([1, 0]))(np.ones((1, 3)))[0] == 0.0


CELL = ["model", "dataset", "mode", "layer"]


def test_error_rows(spark):
    rows = [("m", "d", "base", 0, s, i, i % 2, [float(i), 1.0]) for i, s in enumerate(["train_pool"] * 4 + ["eval"] * 4 + ["test"] * 4)]
    v = spark.createDataFrame(rows, "model string, dataset string, mode string, layer int, split string, sample_id long, label int, x array<float>")
    base = [s.name for s in scorers.REGISTRY.values() if s.mode == "base"]
    specs = spark.createDataFrame([("m", "d", "base", 0, s, 1, 0, "balanced", s, [1, 2]) for s in base], "model string, dataset string, mode string, layer int, scorer string, k int, seed int, balance_mode string, run_id string, ids array<long>")
    models = scorers.fitted(specs, v.where("split = 'train_pool'"), CELL).cache()
    scores = scorers.scored(models, v.where("split <> 'train_pool'"), CELL, rows_per_task=3)
    got = {r["scorer"]: r for r in scorers.result_rows(models, scores).collect()}
    assert set(got) == set(base)
    assert got["P7_mahalanobis"]["error"] and got["P7_mahalanobis"]["error_type"] == "ValueError" and got["P3_lda"]["error"]
    assert not got["P2_mass_mean"]["error"] and got["P2_mass_mean"]["test_auroc"] is not None and got["P2_mass_mean"]["ood_auroc"] is None
    assert got["P2_mass_mean"]["n_train_pos"] == 1 and got["P2_mass_mean"]["wall_clock_s"] > 0


def test_sweep_against_plain_loop(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((120, 5)).astype(np.float32) + (np.arange(120) % 3 == 0)[:, None]
    y = (np.arange(120) % 3 == 0).astype(int)
    x[7] = np.nan  # counts as zeros
    split = np.array(["train_pool"] * 60 + ["eval"] * 30 + ["test"] * 30)
    v = spark.createDataFrame([("m", "d", mode, 1, i, int(y[i]), x[i].tolist()) for i in range(120) for mode in pipeline.MODES], "model string, dataset string, mode string, layer int, sample_id long, label int, x array<float>")
    parts = spark.createDataFrame([("m", "d", split[i], i, int(y[i])) for i in range(120)], "model string, dataset string, split string, sample_id long, label int")
    drawn = sampling.draws(parts.where("split = 'train_pool'"), ["model", "dataset"], [3, 30], 2).cache()
    runs = scorers.wanted(v.select(*CELL).distinct(), list(scorers.REGISTRY), [3, 30], 2, ["balanced", "imbalanced"])
    got = {(r["scorer"], r["seed"], r["balance_mode"]): r for r in pipeline.sweep_runs(v, parts, runs, drawn).collect()}
    assert len(got) == 7 * 2 * 2  # no run of 30 positives
    clean = np.where(np.isnan(x).any(1)[:, None], 0, x).astype(float)
    for (name, seed, mode), r in got.items():
        ids = [q["sample_id"] for q in drawn.where(f"seed = {seed}").collect()]
        at = np.array([i for i in ids if mode == "balanced" or y[i] == 1] + ([] if mode == "balanced" else [i for i in range(60) if y[i] == 0]))
        score = scorers.REGISTRY[name].fit(clean[at], y[at])
        for side in ("eval", "test"):
            s = score(clean[split == side])
            assert r[f"{side}_auroc"] == pytest.approx(metrics.auroc(y[split == side], s), abs=1e-9), (name, seed, mode)
            assert r[f"{side}_recall_at_1pct_fpr"] == pytest.approx(metrics.recall_at(y[split == side], s))


def test_sparse_logistic_is_optimal():
    rng = np.random.default_rng(6)
    x, y = rng.standard_normal((80, 6)) * [3, 1, 1, 1, 0.1, 1], rng.integers(0, 2, 80)
    score = scorers.sparse_logistic(x, y)
    b = np.log(score(np.zeros((1, 6)))[0] / (1 - score(np.zeros((1, 6)))[0]))
    w = np.array([np.log(score(e)[0] / (1 - score(e)[0])) - b for e in np.eye(6)[:, None]])
    g = x.T @ (1 / (1 + np.exp(-(x @ w + b))) - y)
    on = np.abs(w) > 1e-6
    assert 0 < on.sum() < 6 and np.allclose(g[on], -np.sign(w[on]), atol=1e-3) and (np.abs(g[~on]) <= 1 + 1e-3).all()


def test_reports_ties_and_gaps(spark):
    base = {m: None for m in RUNS.names} | {"scorer": "s", "k": 1, "balance_mode": "b", "model": "m", "dataset": "d"}
    rows = [base | {"run_id": str(i), "layer": layer, "scorer": s, "eval_recall_at_1pct_fpr": e, "test_recall_at_1pct_fpr": t} for i, (s, layer, e, t) in enumerate([("s", 16, 0.5, 0.2), ("s", 8, 0.5, 0.7), ("a", 8, 0.1, 0.7), ("z", 8, float("nan"), 0.9)])]
    table = reports.summary(store.clean_metrics(spark.createDataFrame([tuple(r[c] for c in RUNS.names) for r in rows], RUNS)))
    best = reports.best_layers(table)
    assert {r["scorer"]: r["layer"] for r in best.collect()} == {"s": 8, "a": 8}
    assert [r["scorer"] for r in reports.without_metric(table).collect()] == ["z"]
    assert [r["scorer"] for r in reports.decisions(best).collect()] == ["a"]
    assert all(r["eval_recall_at_1pct_fpr_std"] is None for r in table.collect())
    assert reports.selection("ood_auroc") == "eval_recall_at_1pct_fpr_mean"


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"run_id": "r", "k": 3, "eval_auroc": NaN}\n\n{"run_id": "q"}\n')
    got = {r["run_id"]: r for r in store.clean_metrics(store.read_runs(spark, str(tmp_path))).collect()}
    assert len(got) == 2 and got["r"]["eval_auroc"] is None and got["q"]["k"] is None
    assert store.done_ids(spark, str(tmp_path / "none")).count() == 0


def test_texts(spark):
    df = spark.createDataFrame([(1, "p", "", "x"), (2, "p", "q", None), (3, None, None, "0")], "sample_id long, question string, pressure_prompt string, label string")
    got = {r["sample_id"]: r for r in texts.honesty(df).collect()}
    assert got[1]["text"] == "p" and got[1]["label"] == 1 and got[2]["text"] == "q" and got[2]["label"] == 1 and got[3]["label"] == 0 and got[3]["text"] == ""
    assert got[1]["category"] == "unknown" and got[1]["question_id"] is None
    words = spark.createDataFrame([("Yes ",), ("HAM",), ("1",), ("2",), ("odd",)], "v string")
    assert [r[0] for r in words.select(texts.binary_label(F.col("v"))).collect()] == [1, 0, 1, 0, 0]
    with pytest.raises(ValueError):
        spec("nope")
    with pytest.raises(ValueError):
        prompts.in_mode("enron", "odd", F.lit(""))
    with pytest.raises(RuntimeError), pytest.warns(UserWarning):
        texts.union_of(spark, ["/no/such"])
    assert prompts.answer_token({"Yes": [1, 2], "yes": [3], " Yes": [4], " yes": [5]}, prompts.YES_FORMS) == 3
    assert prompts.answer_token({f: [7, 8] for f in prompts.NO_FORMS}, prompts.NO_FORMS) == 7


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.json").write_text('[{"x": 1}, {"x": 2}]')
    (tmp_path / "c.jsonl").write_text('{"x": 1}\n')
    assert [texts.read_any(spark, str(tmp_path / f)).count() for f in ("a.csv", "b.json", "c.jsonl")] == [1, 2, 1]
    with pytest.raises(ValueError):
        texts.read_any(spark, "x.docx")


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, float("nan")],), ([3.0, 4.0],), ([0.0, 0.0],)], "x array<float>")
    rows = df.select(vec.without_nan(F.col("x")).alias("c"), vec.norm(vec.without_nan(F.col("x"))).alias("n"), vec.cosine(vec.without_nan(F.col("x")), F.array(F.lit(1.0), F.lit(0.0))).alias("k")).collect()
    assert rows[0]["c"] == [0.0, 0.0] and rows[1]["n"] == 5.0 and rows[2]["k"] == 0.0 and rows[1]["k"] == pytest.approx(0.6)
    mask = spark.range(1).select(vec.pooling_mask(F.lit(5), F.lit(3), F.lit(9)).alias("m")).first()["m"]
    assert mask == [0, 0, 1, 0, 0]


def test_significance_pairs(spark):
    rows = [("d", "m", "b", 1, s, r, t) for s, r, t in (("x", "r2", 0.5), ("y", "r1", 0.5), ("z", "r0", None))] + [("d", "m", "b", 2, "x", "only", 0.1)]
    pairs = significance.top_pairs(spark.createDataFrame(rows, "dataset string, model string, balance_mode string, k int, scorer string, run_id string, test_recall_at_1pct_fpr double"))
    assert [(r["run_id_a"], r["run_id_b"]) for r in pairs.collect()] == [("r1", "r2")]
    preds = spark.createDataFrame([("r1", "test", i, i % 2, float(i)) for i in range(20)] + [("r2", "test", i, (i + (i == 3)) % 2, float(-i)) for i in range(20)], "run_id string, split string, sample_id long, y int, score double")
    side = significance.paired(preds, pairs, "test")
    assert significance.aligned(side).first()["aligned"] is False
    assert significance.compare(side, "test", "auroc", 5).first()["error"] == "ValueError"


def test_config_and_grid(spark):
    raw = {"models": [{"name": "a/b", "layers": [1, 2]}], "datasets": {"in_distribution": ["enron", "mask"], "ood": {"enron": "sms"}}, "sweep": {"k_values": [1], "seeds": 2}}
    c = conf.parse(raw)
    assert c.ood == {"enron": "sms", "mask": None} and conf.parse(raw | {"datasets": {"enron": {}, "sms": {}}}).ood == {"enron": None}
    g = conf.grid(spark, c)
    assert g.count() == 2 * 2 * 7 * 1 * 2 * 2 == g.select("run_id").distinct().count()
    assert conf.pending(g, g.limit(5)).count() == 2 * 2 * 7 * 1 * 2 * 2 - 5
    with pytest.raises(ValueError):
        conf.grid(spark, c, ["nope"])
    with pytest.raises(ValueError):
        conf.narrowed(c, model="nope")


def test_pipeline_end_to_end(spark, tmp_path, monkeypatch):
    rows = [(i, f"{'win money now' if i % 2 else 'see you at lunch'} {i} {i * 7 % 13}", i % 2) for i in range(160)]
    given = spark.createDataFrame(rows, "sample_id long, text string, label int")
    c = conf.Config(models={"a/b": [0, 1], "no/vectors": [3]}, ood={"enron": None, "mask": None}, ks=[1, 4], seeds=2, draws=20, results_dir=str(tmp_path / "r"), cache_dir=str(tmp_path / "c"))
    assert pipeline.sweep(spark, c).count() == 0 and pipeline.significance_report(spark, c).count() == 0
    pipeline.extract(spark, c, "a/b", "enron", given, skip_filter=True, make=lambda: hashed(6, 16)())
    pipeline.extract(spark, c, "a/b", "enron", given, skip_filter=True, make=None)  # complete cells aren't encoded again, else widths would differ
    assert {len(r["x"]) for r in store.read_vectors(spark, f"{c.cache_dir}/vectors").collect()} == {6}
    first = pipeline.sweep(spark, c)
    assert first.count() == 2 * 7 * 2 * 2 * 2  # models and datasets without vectors are passed over
    fits = []
    monkeypatch.setattr(pipeline, "fitted", lambda specs, train, cell: fits.append(specs.count()) or scorers.fitted(specs, train, cell))
    assert pipeline.sweep(spark, c).count() == first.count() and fits == [0]  # nothing is fitted twice
    predictions = store.read_predictions(spark, f"{c.results_dir}/predictions")
    assert predictions.select("run_id").distinct().count() == first.where("not error").count()
    tables = pipeline.analyze(store.read_runs(spark, f"{c.results_dir}/runs"), c)
    pipeline.write_reports(tables, c.results_dir)
    assert tables["decision_table"].count() == 4
    assert {len(df.columns) for df in pipeline.plot_data(tables).values()} <= {3, 4, 6}
    report = pipeline.significance_report(spark, c, metric="auroc").collect()
    assert len(report) == 4 and all(r["error"] is None and r["ci_low"] <= r["mean_diff"] <= r["ci_high"] for r in report)


def test_filter_is_reused(spark, tmp_path):
    given = spark.createDataFrame([(i, f"text {i}", i % 2) for i in range(60)], "sample_id long, text string, label int")
    c = conf.Config(models={"m": [0]}, ood={"enron": None}, results_dir=str(tmp_path / "r"), cache_dir=str(tmp_path / "c"), max_length=1)
    sure = lambda level: lambda df: df.withColumn("logit_diff", F.lit(level) * (F.col("label") * 2 - 1))
    pipeline.extract(spark, c, "m", "enron", given, ("base",), difference=sure(1.0))
    vecs = store.read_vectors(spark, f"{c.cache_dir}/vectors").collect()
    assert len(vecs) == 60 and len({tuple(r["x"]) for r in vecs}) == 1  # max_length: all texts begin with one token
    pipeline.extract(spark, c, "m", "enron", given, ("base",), difference=sure(-1.0))
    assert spark.read.json(f"{c.cache_dir}/m/enron/filter_manifest").first()["n_filtered"] == 60
    pipeline.extract(spark, c, "m", "enron", given, ("base",), difference=sure(-1.0), overwrite=True)
    assert spark.read.json(f"{c.cache_dir}/m/enron/filter_manifest").first()["n_filtered"] == 0


def test_command_line_end_to_end(spark, tmp_path):
    from scantling import cli

    for name in ("enron", "sms"):
        spark.createDataFrame([(i, f"{'win money now' if i % 2 else 'see you at lunch'} {i} {i * 7 % 13}", i % 2) for i in range(160)], "sample_id long, text string, label int").write.parquet(str(tmp_path / f"{name}.parquet"))
    config = {"models": [{"name": "a/b", "layers": [0]}], "datasets": {"in_distribution": ["enron"], "ood": {"enron": "sms"}}, "sweep": {"k_values": [1, 3], "seeds": 2}, "significance": {"n_boot": 10}, "results_dir": str(tmp_path / "r"), "extraction": {"cache_dir": str(tmp_path / "c")}}
    (tmp_path / "config.yaml").write_text(__import__("json").dumps(config))
    sources = [x for n in ("enron", "sms") for x in ("--source", f"{n}={tmp_path}/{n}.parquet")]
    cli.main(["all", "--config", str(tmp_path / "config.yaml"), *sources])
    report = spark.read.option("header", True).csv(str(tmp_path / "r" / "significance_test")).collect()
    assert len(report) == 4 and all(r["error"] is None for r in report)
    assert spark.read.option("header", True).csv(str(tmp_path / "r" / "ood_table")).where("ood_auroc_mean is not null").count() > 0
    cli.main(["significance", "--config", str(tmp_path / "config.yaml"), "--split", "eval"])
    assert (tmp_path / "r" / "significance_eval").exists()


def test_encoder(spark):
    from types import SimpleNamespace

    from scantling.plans import encode

    rows = encode.hashed(10, 3)()(["a b c d", "", "b"], [0, 2])
    assert rows[0][0] == pytest.approx(np.mean([encode.token_values(t, 0, 10) for t in "abc"], axis=0), abs=1e-6) and not rows[2][1].any()
    assert encode.hashed(10)()(["a b c"], [1], [7])[1][0] == pytest.approx(encode.token_values("c", 1, 10))
    df = spark.createDataFrame([(1, "a b", 1), (2, None, 0)], "sample_id long, text string, label int")
    got = encode.vectors(df, "enron", "base", [0], encode.hashed(4), F.lit(1)).collect()
    assert {r["sample_id"]: list(r["x"]) for r in got} == {1: list(encode.token_values("b", 0, 4)), 2: [0.0] * 4}
    assert encode.layers_of(SimpleNamespace(transformer=SimpleNamespace(h=[1, 2]))) == [1, 2]
    with pytest.raises(ValueError):
        encode.layers_of(SimpleNamespace())
    vocabulary = {"Yes": [1, 2], "yes": [3], " Yes": [4], " yes": [5]} | {f: [0, 9] for f in prompts.NO_FORMS}
    add = encode.answer_difference("enron", lambda: lambda texts: np.array([[len(t), 0, 0, 2 * len(t)] for t in texts], float), vocabulary)
    got = {r["sample_id"]: r["logit_diff"] for r in add(df).collect()}
    assert got[1] == len(prompts.SPAM_QUESTION) + len("\n\na b\n\nAnswer:") and got[2] == 0.0


def test_stream(spark, tmp_path):
    from scantling.streaming.results import arriving, ingest

    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    (src / "a.json").write_text('{"run_id": "r1", "k": 1}\n{"run_id": "r1", "k": 1}\n')
    ingest(arriving(spark, str(src)), str(out), str(tmp_path / "cp")).awaitTermination()
    (src / "b.json").write_text('{"run_id": "r1", "k": 1}\n{"run_id": "r2", "k": 1}\n')
    ingest(arriving(spark, str(src)), str(out), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["run_id"] for r in spark.read.parquet(str(out)).collect()) == ["r1", "r2"]


def test_cli_parses():
    from scantling.cli import parser

    args = parser().parse_args(["sweep", "--model", "m", "--scorers", "P1_logistic", "P4_cosine"])
    assert args.scorers == ["P1_logistic", "P4_cosine"]
    assert isinstance(pd.DataFrame(), pd.DataFrame)

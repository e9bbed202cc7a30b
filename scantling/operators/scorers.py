"""Scorers: closed forms as plans, iterative ones as functions on arrays, all in one registry."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from scantling.functions.vectors import dot, norm, unit
from scantling.operators.metrics import ranking_metrics

Score = Callable[[np.ndarray], np.ndarray]


def mean_difference(x: np.ndarray, y: np.ndarray) -> Score:
    """Projection on the unit vector between the class means."""
    d = x[y == 1].mean(axis=0) - x[y == 0].mean(axis=0)
    n = np.linalg.norm(d)
    d = d / n if n > 0 else d
    return lambda v: v @ d


def cosine_difference(x: np.ndarray, y: np.ndarray) -> Score:
    """Cosine to the positive mean less cosine to the negative mean; 0 where either is zero."""

    def side(v: np.ndarray, c: np.ndarray) -> np.ndarray:
        n = np.linalg.norm(v, axis=1) * np.linalg.norm(c)
        return np.divide(v @ c, n, out=np.zeros(len(v)), where=n > 0)

    up, down = x[y == 1].mean(axis=0), x[y == 0].mean(axis=0)
    return lambda v: side(v, up) - side(v, down)


def logistic(x: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 100, tol: float = 1e-9) -> Score:
    """L2 logistic regression with a free intercept, by Newton steps in the span of the training rows when these are few."""
    if len(np.unique(y)) < 2:
        raise ValueError("both classes are needed")
    n, d = x.shape
    basis = None
    z = x
    if n < d:  # the optimum lies in the span of the rows
        u, s, basis = np.linalg.svd(x, full_matrices=False)
        z = u * s
    one = np.hstack([z, np.ones((n, 1))])
    ridge = np.full(one.shape[1], 1.0 / c)
    ridge[-1] = 0.0
    w = np.zeros(one.shape[1])

    def loss(w: np.ndarray) -> float:
        m = one @ w
        return float(np.logaddexp(0, m).sum() - m @ (y == 1) + 0.5 * (ridge * w * w).sum())

    now = loss(w)
    for _ in range(rounds):
        p = 0.5 * (1 + np.tanh(0.5 * (one @ w)))
        g = one.T @ (p - (y == 1)) + ridge * w
        h = (one * (p * (1 - p))[:, None]).T @ one + np.diag(ridge)
        h[-1, -1] += 1e-10
        step = np.linalg.solve(h, g)
        size = 1.0
        while (after := loss(w - size * step)) > now and size > 1e-8:
            size /= 2
        w, now = w - size * step, after
        if np.abs(g).max() < tol:
            break
    coef = w[:-1] if basis is None else basis.T @ w[:-1]
    return lambda v: 0.5 * (1 + np.tanh(0.5 * (v @ coef + w[-1])))


def sparse_logistic(x: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 20_000, tol: float = 1e-7) -> Score:
    """L1 logistic regression with a free intercept: the log-loss times ``c`` plus the sum of absolute coefficients, by accelerated proximal steps."""
    if len(np.unique(y)) < 2:
        raise ValueError("both classes are needed")
    one, t = np.hstack([x, np.ones((len(x), 1))]), (y == 1).astype(float)
    step = 4.0 / (c * np.linalg.norm(one, 2) ** 2 + 1e-12)
    w = v = np.zeros(one.shape[1])
    pace = 1.0
    for _ in range(rounds):
        p = 0.5 * (1 + np.tanh(0.5 * (one @ v)))
        u = v - step * c * (one.T @ (p - t))
        u[:-1] = np.sign(u[:-1]) * np.maximum(np.abs(u[:-1]) - step, 0)
        after = 0.5 * (1 + np.sqrt(1 + 4 * pace * pace))
        if (v - u) @ (u - w) > 0:  # it overshot: start anew from here
            after = 1.0
        v, moved = u + (pace - 1) / after * (u - w) * (after > 1), np.abs(u - w).max()
        w, pace = u, after
        if moved < tol * max(1.0, np.abs(w).max()) * min(1.0, step):
            break
    return lambda z: 0.5 * (1 + np.tanh(0.5 * (z @ w[:-1] + w[-1])))


def shrinkage(x: np.ndarray) -> tuple[float, float]:
    """Ledoit-Wolf shrinkage of centred rows, and the mean variance it shrinks to; from n x n products when rows are few."""
    n, d = x.shape
    sq = x * x
    mu = sq.sum() / (n * d)
    if n < d:
        gram = x @ x.T
        beta = (np.diag(gram) ** 2).sum()
        delta = (gram * gram).sum() / n**2
    else:
        beta = float((sq.sum(axis=1) ** 2).sum())
        cov = x.T @ x
        delta = float((cov * cov).sum()) / n**2
    beta = (beta / n - delta) / (d * n)
    delta = (delta - 2 * mu * (mu * d) + d * mu * mu) / d
    beta = min(beta, delta)
    return (0.0 if beta <= 0 or delta <= 0 else beta / delta), mu


def discriminant(x: np.ndarray, y: np.ndarray) -> Score:
    """Linear discriminant with Ledoit-Wolf shrinkage of each class, standardised; score is the decision function."""
    labels, counts = np.unique(y, return_counts=True)
    if len(labels) < 2 or len(x) <= len(labels):
        raise ValueError("more rows than classes are needed")
    cov = np.zeros((x.shape[1], x.shape[1]))
    for label, n in zip(labels, counts):
        rows = x[y == label]
        scale = rows.std(axis=0)
        scale[scale == 0] = 1.0
        z = (rows - rows.mean(axis=0)) / scale
        s, mu = shrinkage(z)
        c = (1 - s) * (z.T @ z) / n
        c.flat[:: len(c) + 1] += s * mu
        cov += (n / len(x)) * scale[:, None] * c * scale[None, :]
    means = np.stack([x[y == k].mean(axis=0) for k in labels])
    coef = np.linalg.lstsq(cov, means.T, rcond=None)[0].T
    intercept = -0.5 * np.einsum("ij,ij->i", means, coef) + np.log(counts / len(x))
    w, b = coef[1] - coef[0], intercept[1] - intercept[0]
    return lambda v: v @ w + b


def mahalanobis(x: np.ndarray, y: np.ndarray) -> Score:
    """Distance to the negatives under their Ledoit-Wolf covariance, inverted in the span of the rows (Woodbury)."""
    rows = x[y == 0]
    if len(rows) < 2:
        raise ValueError("two negatives are needed")
    centre = rows.mean(axis=0)
    z = rows - centre
    n = len(z)
    s, mu = shrinkage(z)
    base = s * mu
    if base > 0:
        factor = z * np.sqrt((1 - s) / n)
        inner = np.linalg.inv(np.eye(n) + factor @ factor.T / base) if n < z.shape[1] else None
        if inner is not None:

            def score(v: np.ndarray) -> np.ndarray:
                d = v - centre
                t = d @ factor.T
                return np.sqrt(np.maximum((d * d).sum(1) / base - np.einsum("ij,jk,ik->i", t, inner, t) / base**2, 0))

            return score
    precision = np.linalg.pinv((1 - s) * (z.T @ z) / n + base * np.eye(z.shape[1]), hermitian=True)

    def dense(v: np.ndarray) -> np.ndarray:
        d = v - centre
        return np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", d, precision, d), 0))

    return dense


def sparse_features(encode: Callable[[np.ndarray], np.ndarray], width: int, k: int = 64, batch: int = 256) -> Callable[[np.ndarray, np.ndarray], Score]:
    """An L1 logistic scorer on the ``k`` features of an external sparse encoder whose class means differ most; ties go to the lower index."""

    def fit(x: np.ndarray, y: np.ndarray) -> Score:
        if encode is None:
            raise RuntimeError("no encoder has been set")
        if x.shape[1] != width:
            raise ValueError(f"the encoder takes {width} values, not {x.shape[1]}")
        run = lambda v: np.concatenate([encode(v[i : i + batch]) for i in range(0, len(v), batch)])
        z = run(x)
        keep = np.argsort(-np.abs(z[y == 1].mean(0) - z[y == 0].mean(0)), kind="stable")[:k]
        inner = sparse_logistic(z[:, keep], y)
        return lambda v: inner(run(v)[:, keep])

    return fit


@dataclass(frozen=True)
class Scorer:
    """A way of scoring: which mode of vectors it reads, and how it is fitted."""

    name: str
    fit: Callable[[np.ndarray, np.ndarray], Score]
    mode: str = "base"


REGISTRY: dict[str, Scorer] = {
    s.name: s
    for s in (
        Scorer("P1_logistic", logistic),
        Scorer("P2_mass_mean", mean_difference),
        Scorer("P3_lda", discriminant),
        Scorer("P4_cosine", cosine_difference),
        Scorer("P6_prompted", logistic, "prompted"),
        Scorer("P7_mahalanobis", mahalanobis),
        Scorer("P8_followup", logistic, "followup"),
    )
}


def register(scorer: Scorer) -> None:
    """Adds a scorer, or replaces one of the same name."""
    REGISTRY[scorer.name] = scorer


def class_means(train: DataFrame, by: list[str], vector: str = "x") -> DataFrame:
    """``by, up, down``: mean vectors of labels 1 and 0; each task sums its vectors first."""
    rows = train.where(F.col(vector).isNotNull()).select(*by, "label", array_to_vector(vector).alias("_v"))
    means = rows.where(F.col("label").isin(0, 1)).groupBy(*by, "label").agg(Summarizer.mean(F.col("_v")).alias("_m"))
    side = lambda label: F.max(F.when(F.col("label") == label, vector_to_array("_m")))
    return means.groupBy(*by).agg(side(1).alias("up"), side(0).alias("down"))


def sample_means(drawn: DataFrame, pool: DataFrame, by: list[str], cell: list[str], modes: list[str]) -> DataFrame:
    """``by, cell, k, seed, balance_mode, up, down``: class means of every few-shot sample over the vectors of ``pool`` (by, cell, sample_id, label, x).

    ``drawn`` is of :func:`scantling.operators.sampling.draws`. All negatives of a cell are averaged once, whatever the number of samples.
    """
    own = class_means(drawn.join(pool.drop("label"), [*by, "sample_id"]), [*by, *cell, "k", "seed"])
    parts = []
    if "balanced" in modes:
        parts.append(own.withColumn("balance_mode", F.lit("balanced")))
    if "imbalanced" in modes:
        every = class_means(pool.where("label = 0"), [*by, *cell]).select(*by, *cell, F.col("down").alias("_all"))
        parts.append(own.join(F.broadcast(every), [*by, *cell]).withColumn("down", F.col("_all")).drop("_all").withColumn("balance_mode", F.lit("imbalanced")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def closed_scores(means: DataFrame, vectors: DataFrame, on: list[str], names: list[str]) -> DataFrame:
    """``scorer, score`` of closed-form scorers for the vectors of each cell of ``means``, all in one pass, rounded so that engines agree on ties.

    What depends on the means only is computed once a cell, before the join.
    """
    if unknown := set(names) - {"P2_mass_mean", "P4_cosine"}:
        raise ValueError(f"no closed form of {sorted(unknown)}")
    ready = means.withColumn("_way", F.zip_with("up", "down", lambda a, b: a - b))
    ready = ready.select(*(c for c in means.columns if c not in ("up", "down")), unit(F.col("_way")).alias("_way"), unit(F.col("up")).alias("_up"), unit(F.col("down")).alias("_down"))
    x = F.col("x")
    length = norm(x)
    sides = F.when(length > 0, (dot(x, F.col("_up")) - dot(x, F.col("_down"))) / length).otherwise(F.lit(0.0))
    scores = {"P2_mass_mean": dot(x, F.col("_way")), "P4_cosine": sides}
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("scorer"), F.round(scores[n], 6).alias("score")) for n in names))).alias("_s")
    joined = vectors.join(ready, on).select("*", each)
    return joined.select("*", "_s.*").drop("_up", "_down", "_way", "_s", "x")


FITTED = "run_id string, scorer string, k int, seed int, balance_mode string, n_train_pos int, n_train_neg int, fit_s double, error boolean, error_type string, packed binary"
SCORED = "run_id string, split string, sample_id long, y int, score double"
#: Rows that one task scores at a time; a cell of more is scored by several tasks.
ROWS_PER_TASK = 20_000


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as a matrix."""
    flat = column.combine_chunks()
    values = flat.values.to_numpy(zero_copy_only=False)[flat.offsets[0].as_py() : flat.offsets[-1].as_py()]
    return values.reshape(len(flat), -1).astype(float)


def wanted(cells: DataFrame, scorers: list[str], ks: list[int], seeds: int, modes: list[str]) -> DataFrame:
    """All runs over the cells ``model, dataset, mode, layer`` that there are: cell, scorer, k, seed, balance_mode."""
    plan = [(s, REGISTRY[s].mode, k, seed, b) for s in scorers for k in ks for seed in range(seeds) for b in modes]
    names = ("scorer", "_mode", "k", "seed", "balance_mode")
    runs = F.explode(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, p))) for p in plan))).alias("_p")
    return cells.select("*", runs).select(*cells.columns, "_p.*").where("mode = _mode").drop("_mode")


def fitted(specs: DataFrame, train: DataFrame, cell: list[str]) -> DataFrame:
    """The fitted scorer of every row of ``specs`` (cell, run_id, scorer, k, seed, balance_mode, ids): cell and FITTED.

    ``ids`` are the drawn rows, at most 2 k; imbalanced runs take the negatives of ``train`` (cell, sample_id, label, x) besides. A task
    holds the rows that the balanced runs of a cell and seed drew, or the drawn positives and all negatives of a cell's train pool.
    A fit that fails gives an error row without a model.
    """
    group = [*cell, "balance_mode", "_part"]
    specs = specs.withColumn("_part", F.when(F.col("balance_mode") == "balanced", F.col("seed")).otherwise(-1))
    drawn = specs.select(*group, F.explode("ids").alias("sample_id")).distinct()
    picked = train.join(drawn, [*cell, "sample_id"])
    uneven = specs.where("balance_mode = 'imbalanced'").select(*group).distinct()
    picked = picked.unionByName(train.where("label = 0").join(uneven, cell))
    picked = picked.select(*group, "sample_id", "label", "x").toDF(*group, "sample_id", "label", "x")  # columns of its own
    registry = dict(REGISTRY)

    def run(key: tuple, runs: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if runs.num_rows and rows.num_rows:
            x, y = matrix(rows["x"]), rows["label"].to_numpy()
            place = {v: i for i, v in enumerate(rows["sample_id"].to_pylist())}
            down = np.flatnonzero(y == 0)
            for r in runs.to_pylist():
                own = [place[i] for i in sorted(r["ids"]) if i in place]
                at = np.array(own if r["balance_mode"] == "balanced" else [*(i for i in own if y[i] == 1), *down], int)
                made = {c: r[c] for c in ("run_id", "scorer", "k", "seed", "balance_mode")}
                made |= {"n_train_pos": int((y[at] == 1).sum()), "n_train_neg": int((y[at] == 0).sum()), "error": False, "error_type": None, "packed": None}
                began = time.perf_counter()
                try:
                    made["packed"] = cloudpickle.dumps(registry[r["scorer"]].fit(x[at], y[at]))
                except Exception as e:  # noqa: BLE001
                    made |= {"error": True, "error_type": type(e).__name__}
                made["fit_s"] = time.perf_counter() - began
                out.append(dict(zip(cell, (k.as_py() for k in key))) | made)
        return pa.Table.from_pylist(out, schema=shape)

    types = dict(specs.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in cell) + ", " + FITTED
    shape = arrow_schema(schema)
    columns = [*group, "run_id", "scorer", "k", "seed", "ids"]
    return specs.select(*columns).groupBy(*cell, "balance_mode", "_part").cogroup(picked.groupBy(*group)).applyInArrow(run, schema)


def arrow_schema(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def scored(models: DataFrame, held: DataFrame, cell: list[str], rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Scores of all fitted models of a cell for its rows ``held`` (cell, split, sample_id, label, x): SCORED.

    Each task scores a bounded number of rows, by hash of their ids, with all models of the cell. For each run and task there is a row
    of split ``_seconds`` besides, with the time that eval and test took.
    """
    sizes = held.groupBy(*cell).agg(F.ceil(F.count("*") / rows_per_task).cast("int").alias("_n"))
    given = models.where("not error").select(*cell, "run_id", "packed").join(sizes, cell).select(*cell, "run_id", "packed", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_at"))
    parted = held.join(sizes, cell).select(*cell, F.pmod(F.xxhash64("sample_id"), F.col("_n")).cast("int").alias("_at"), "split", "sample_id", "label", "x")
    shape = arrow_schema(SCORED)

    def run(key: tuple, runs: pa.Table, rows: pa.Table) -> pa.Table:
        if not runs.num_rows or not rows.num_rows:
            return shape.empty_table()
        x, split = matrix(rows["x"]), rows["split"].to_numpy(zero_copy_only=False)
        timed, rest = np.flatnonzero(split != "ood"), np.flatnonzero(split == "ood")
        order = np.concatenate([timed, rest])
        fixed = [c.combine_chunks().take(pa.array(order)) for c in (rows["split"], rows["sample_id"], rows["label"])]
        out = []
        for name, packed in zip(runs["run_id"].to_pylist(), runs["packed"].to_pylist()):
            score = cloudpickle.loads(packed)
            began = time.perf_counter()
            s = score(x[timed]) if len(timed) else np.zeros(0)
            spent = time.perf_counter() - began
            s = np.concatenate([s, score(x[rest]) if len(rest) else np.zeros(0)])
            out.append(pa.Table.from_arrays([pa.array([name] * len(s), pa.string()), *fixed, pa.array(s, pa.float64())], schema=shape))
            out.append(pa.Table.from_pylist([{"run_id": name, "split": "_seconds", "sample_id": None, "y": None, "score": spent}], schema=shape))
        return pa.concat_tables(out)

    group = [*cell, "_at"]
    parted = parted.toDF(*parted.columns)  # columns of its own
    return given.groupBy(*group).cogroup(parted.groupBy(*group)).applyInArrow(run, SCORED)


def result_rows(models: DataFrame, scores: DataFrame) -> DataFrame:
    """Result rows of fitted models and the scores of all their runs; metrics are null where a run failed, has no rows or one class only."""
    curves = ranking_metrics(scores.where("split <> '_seconds'"), ["run_id", "split"])
    one = lambda split, name: F.max(F.when(F.col("split") == split, F.col(name)))
    named = {f"{s}_{m}": one(s, c) for s in ("eval", "test", "ood") for m, c in (("auroc", "auroc"), ("recall_at_1pct_fpr", "recall"))}
    wide = curves.groupBy("run_id").agg(*(c.alias(n) for n, c in named.items()))
    spent = scores.where("split = '_seconds'").groupBy("run_id").agg(F.sum("score").alias("_score_s"))
    rows = models.drop("packed").join(wide, "run_id", "left").join(spent, "run_id", "left")
    return rows.withColumn("wall_clock_s", F.col("fit_s") + F.coalesce("_score_s", F.lit(0.0))).drop("fit_s", "_score_s")

"""Problem 6: splits that keep related records together.

Rows are linked by equal keys; components come from alternating large-star and small-star rounds, each cut by a
checkpoint. Components are then balanced over many equal bins by largest differencing, and whole bins
are given to the splits by target proportion.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scantling.llm.dedup import equal_runs
from scantling.session import cut


#: Parts in which the links of one node are joined with what its neighbours agreed on.
SALTS = 8


def _with_least(links: DataFrame, least: DataFrame) -> DataFrame:
    """``u, v, m``: links with the least neighbour of u. A node of millions of links, a root say, is joined in SALTS parts."""
    spread = F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt")
    return links.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(least.select("u", "m", spread), ["u", "salt"]).drop("salt")


def components(links: DataFrame) -> DataFrame:
    """Connected components of links ``a, b`` (bigint): ``node, root`` with root the smallest node of each component.

    A node stands in the result if it stands in a link, a link to itself included; null ends are left out. The
    number of rounds grows with the logarithm of the longest chain; each round shuffles links only, and reduces those of a node in the
    tasks that hold them first.
    """
    links = cut(links.where("a is not null and b is not null").selectExpr("greatest(a, b) as u", "least(a, b) as v").distinct())
    nodes = links.selectExpr("explode(array(u, v)) as node").distinct()
    edges, seen = links.where("u <> v"), None
    while True:
        both = edges.select("u", "v").unionByName(edges.selectExpr("v as u", "u as v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = _with_least(both, least).where("v > u").selectExpr("v as u", "m as v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _with_least(large, least).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges = cut(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return nodes.join(edges.selectExpr("u as node", "v as root"), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def related(rows: DataFrame, keys: list[str], number: str = "id") -> DataFrame:
    """``member, root`` for every row: rows with an equal non-null value in any of the string columns ``keys`` belong together, also over others."""
    links = rows.select(F.col(number).alias("a"), F.col(number).alias("b"))
    for key in keys:
        _, members = equal_runs(rows, number, key)
        links = links.unionByName(members.selectExpr("rep as a", "member as b"))
    return components(links).selectExpr("node as member", "root")


def difference(weights: list[tuple[int, int]], bins: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Largest differencing over ``bins`` bins of ``(weight, how many)``: sums of the bins, and (weight, number from 0, bin)."""
    heap: list = []
    step = 0
    for weight, many in sorted(weights, reverse=True):
        for k in range(many):
            sums, held = np.zeros(bins, np.int64), [[] for _ in range(bins)]
            sums[-1], held[-1] = weight, [(weight, k)]
            heap.append((-weight, step, sums, held))
            step += 1
    heapq.heapify(heap)
    if not heap:
        return np.zeros(bins, np.int64), []
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        sums = a + b[::-1]  # the heaviest of one with the lightest of the other
        held = [p + q if len(p) >= len(q) else q + p for p, q in zip(x, reversed(y))]
        order = np.argsort(sums, kind="stable")
        sums = sums[order]
        heapq.heappush(heap, (int(sums[0] - sums[-1]), step, sums, [held[i] for i in order]))
        step += 1
    _, _, sums, held = heap[0]
    return sums, [(weight, k, b) for b, items in enumerate(held) for weight, k in items]


def bins_to_splits(sums: np.ndarray, targets: dict[str, float]) -> list[str]:
    """A split for each bin, the heaviest first, always to the split that lacks most."""
    lack = {name: share * float(sums.sum()) for name, share in targets.items()}
    out = [""] * len(sums)
    for b in sorted(range(len(sums)), key=lambda b: (-sums[b], b)):
        out[b] = max(lack, key=lambda s: (lack[s], targets[s]))
        lack[out[b]] -= float(sums[b])
    return out


#: Components that one task ranks among those of equal weight.
RANKED = 100_000
#: Weights, the heaviest first, that are differenced; what is lighter is less than a thousandth of the whole and fills the lightest bins.
DIFFERENCED = 2_000


def fill(sums: np.ndarray, weights: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Puts ``(weight, how many)``, the heaviest first, into the lightest bin each; (weight, number from 0, bin). Changes ``sums``."""
    heap = [(int(s), b) for b, s in enumerate(sums)]
    heapq.heapify(heap)
    out = []
    for weight, many in sorted(weights, reverse=True):
        for k in range(many):
            s, b = heapq.heappop(heap)
            out.append((weight, k, b))
            sums[b] = s + weight
            heapq.heappush(heap, (s + weight, b))
    return out


def balanced_splits(membership: DataFrame, targets: dict[str, float], bins: int = 100, salts: int | None = None) -> DataFrame:
    """``member, root, bin, split``: whole components in bins of nearly equal weight, whole bins in splits.

    Components of equal weight go round the bins evenly as far as they fill whole rounds, which leaves no
    difference; only what is left over, fewer than ``bins`` of a weight, is differenced, and of more than DIFFERENCED weights the lightest
    are put into the lightest bins. The driver sees the histogram of weights, at most sqrt(2 * rows) numbers, never the components. A
    component heavier than a bin has one to itself; proportions are then as near as whole components allow. No rows give no rows.
    """
    spark = membership.sparkSession
    sizes = cut(membership.groupBy("root").agg(F.count("*").alias("weight")))
    histogram = {int(w): int(n) for w, n in sizes.groupBy("weight").count().collect()}
    salts = salts or max(1, -(-sum(histogram.values()) // RANKED))
    salted = sizes.withColumn("salt", F.pmod(F.xxhash64("root"), F.lit(salts)))
    cells = salted.groupBy("weight", "salt").agg(F.count("*").alias("n"))
    offsets = cells.withColumn("before", F.sum("n").over(Window.partitionBy("weight").orderBy("salt")) - F.col("n")).drop("n")
    ranked = salted.withColumn("r", F.row_number().over(Window.partitionBy("weight", "salt").orderBy("root")) - 1).join(offsets, ["weight", "salt"]).withColumn("r", F.col("r") + F.col("before"))
    over = sorted(((w, n % bins) for w, n in histogram.items() if n % bins), reverse=True)
    rest, placed = difference(over[:DIFFERENCED], bins)
    placed = placed + fill(rest, over[DIFFERENCED:])
    sums = rest + sum(w * (n // bins) for w, n in histogram.items())
    splits = bins_to_splits(sums, targets)
    left = spark.createDataFrame([(w, histogram[w] // bins * bins + k, b) for w, k, b in placed], "weight long, r long, rest_bin int")
    named = F.element_at(F.array(*map(F.lit, splits)), F.col("bin") + 1)
    placed_roots = ranked.join(left, ["weight", "r"], "left").select("root", F.coalesce("rest_bin", F.pmod("r", F.lit(bins)).cast("int")).alias("bin")).withColumn("split", named)
    spread = F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt")
    rows = membership.withColumn("salt", F.pmod(F.xxhash64("member"), F.lit(SALTS)).cast("int"))
    return rows.join(placed_roots.select("root", "bin", "split", spread), ["root", "salt"]).select("member", "root", "bin", "split")

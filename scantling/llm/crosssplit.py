"""Problem 5: same or nearly same records across splits.

Texts with the same words form one class. Each class has a MinHash signature of its word shingles, cut in
bands; classes that meet in a band and stand on different sides of some split are candidates, and exact Jaccard
similarity decides. Pairs stay pairs of classes until the result asks for rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scantling.llm.common import list_arrays, word_hashes, words
from scantling.session import cut

#: 50 bands of 4 find a pair of similarity 0.6 with probability 0.999, of 0.8 with 1 - 1e-11.
BANDS, ROWS = 50, 4


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, n, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that high and low bits depend on all bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def shingles(flat: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and their offsets, from word hashes."""
    factors = _odd(size, size)
    n = len(flat) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    value = np.zeros(n, np.uint64)
    for k in range(size):
        value = (value + flat[k : k + n].view(np.uint64)) * factors[k]
    value = mix(value)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    whole = np.arange(n) + size <= offsets[1:][owner]
    value, owner = value[whole], owner[whole]
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    first = np.ones(len(value), dtype=bool)
    first[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[first], np.concatenate([[0], np.cumsum(np.bincount(owner[first], minlength=len(offsets) - 1))])


def band_keys(value: np.ndarray, offsets: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band keys (texts x bands) of non-empty shingle sets."""
    a, b = _odd(11, bands * rows), _odd(12, bands * rows)
    out = np.zeros((len(offsets) - 1, bands), np.uint64)
    for k in range(bands):
        key = np.full(len(offsets) - 1, k + 1, np.uint64)
        for r in range(k * rows, (k + 1) * rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(value * a[r] + b[r], offsets[:-1]))
        out[:, k] = key
    return out


def _sets(size: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, flat = list_arrays(batch.column("words"))
            value, ends = shingles(flat, offsets, size)
            yield pa.RecordBatch.from_arrays([batch.column("class"), pa.LargeListArray.from_arrays(ends, value.view(np.int64)).cast(pa.list_(pa.int64()))], names=["class", "shingles"])

    return run


def _bands(bands: int, rows: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ends, value = list_arrays(batch.column("shingles"))
            keys = band_keys(value.view(np.uint64), ends, bands, rows)
            again = pa.array(np.repeat(np.arange(batch.num_rows), bands))
            columns = [batch.column(c).take(again) for c in ("class", "train", "held")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.repeat(np.diff(ends), bands).astype(np.int32)), pa.array(keys.reshape(-1).view(np.int64))], names=["class", "train", "held", "n", "bucket"])

    return run


#: Parts in which rows with the same words are joined with their class.
SALTS = 8


def classes(texts: DataFrame) -> DataFrame:
    """``id, class`` of ``id, text``: class is the smallest id with the same words; null texts have none. A text of millions of copies is joined in SALTS parts."""
    keyed = texts.where("id is not null and text is not null").select("id", F.unhex(F.sha2(F.array_join(words(F.col("text")), " "), 256)).alias("digest"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    spread = F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt")
    least = keyed.groupBy("digest").agg(F.min("id").alias("class"), F.count("*").alias("n")).where("n > 1").select("digest", "class", spread)
    return keyed.join(least, ["digest", "salt"], "left").select("id", F.coalesce("class", "id").alias("class"))


def shingle_sets(texts: DataFrame, membership: DataFrame, size: int) -> DataFrame:
    """``class, shingles``: the distinct shingle hashes of each class, sorted; classes shorter than a shingle have none."""
    heads = texts.join(membership.where("id = class").select("id", "class"), "id").select("class", word_hashes(F.col("text")).alias("words"))
    return cut(heads.where(F.size("words") >= size).mapInArrow(_sets(size), "class long, shingles array<long>"))


def similar_classes(sets: DataFrame, sides: DataFrame, similarity: float, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Pairs of different classes ``x < y`` with Jaccard similarity of their shingle sets of at least ``similarity``.

    ``sides`` has ``class, train, held``: arrays of the numbers of the split maps that hold the class on either side. Bands carry them
    as bits, so that train rows meet held rows only, of some map that parts them; rows of one side never meet. Each pair above the
    threshold is found with the probability that the bands give (0.999 at 0.6). Both sides of the join of
    buckets are shuffled for it and nothing else, so that adaptive execution can split a hot bucket on either side.
    """
    bits = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, k: s.bitwiseOR(F.pow(F.lit(2.0), F.pmod(k, F.lit(62))).cast("long")))
    marked = sets.join(sides.select("class", bits(F.col("train")).alias("train"), bits(F.col("held")).alias("held")), "class")
    banded = marked.mapInArrow(_bands(bands, rows), "class long, train long, held long, n int, bucket long")
    x = banded.where("train <> 0").select("bucket", F.col("class").alias("x"), F.col("n").alias("n_x"), "train")
    y = banded.where("held <> 0").select("bucket", F.col("class").alias("y"), F.col("n").alias("n_y"), "held")
    least = F.lit(similarity)
    met = x.join(y, "bucket").where((F.col("x") != F.col("y")) & (F.col("train").bitwiseAND(F.col("held")) != 0) & (F.least("n_x", "n_y") >= least * F.greatest("n_x", "n_y")))
    met = met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    sx, sy = (sides.select(F.col("class").alias(c), F.col("train").alias(f"train_{c}"), F.col("held").alias(f"held_{c}")) for c in "xy")
    parted = met.join(sx, "x").join(sy, "y").where("arrays_overlap(train_x, held_y) or arrays_overlap(held_x, train_y)").select("x", "y")  # exact beyond 62 maps as well
    zx, zy = (sets.select(F.col("class").alias(c), F.col("shingles").alias(f"s_{c}")) for c in "xy")
    common = F.size(F.array_intersect("s_x", "s_y"))
    compared = parted.join(zx, "x").join(zy, "y").withColumn("common", common)
    return compared.select("x", "y", (F.col("common") / (F.size("s_x") + F.size("s_y") - F.col("common"))).alias("similarity")).where(F.col("similarity") >= least)


def sides_of(splits: DataFrame) -> DataFrame:
    """``model, id, train, eval, test``: the sides on which a map holds an id; null arrays and repeated ids do no harm."""
    parts = F.array(*(F.struct(F.lit(s).alias("side"), F.col(c).alias("ids")) for s, c in (("train", "train_pool"), ("eval", "eval"), ("test", "test"))))
    rows = splits.select("model", F.explode(parts).alias("p")).select("model", "p.side", F.explode("p.ids").alias("id"))
    return rows.groupBy("model", "id").agg(*(F.max(F.col("side") == s).alias(s) for s in ("train", "eval", "test")))


def _overlaps(texts: DataFrame, splits: DataFrame, size: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Members (model, class, id and sides) and pairs of classes in both directions, a class with itself included."""
    membership = cut(classes(texts))
    member = sides_of(splits).join(membership, "id")
    map_of = F.xxhash64("model")
    sides = cut(member.groupBy("class").agg(F.collect_set(F.when(F.col("train"), map_of)).alias("train"), F.collect_set(F.when(F.col("eval") | F.col("test"), map_of)).alias("held")))
    sets = shingle_sets(texts, membership, size)
    pairs = cut(similar_classes(sets, sides, similarity))
    both = pairs.select("x", "y").unionByName(pairs.selectExpr("y as x", "x as y"))
    return member, both.unionByName(sets.selectExpr("class as x", "class as y"))


def overlapping_rows(texts: DataFrame, splits: DataFrame, size: int = 3, similarity: float = 0.6) -> DataFrame:
    """``model, a, b`` with a <= b: every pair of rows of which one is in the model's train pool, the other in eval or test.

    A row that stands on both sides is a pair with itself, whatever its text. Ids that ``texts`` lacks are left out.
    """
    member, pairs = _overlaps(texts, splits, size, similarity)
    train = member.where("train").select("model", F.col("class").alias("x"), F.col("id").alias("t"))
    held = member.where("eval or test").select("model", F.col("class").alias("y"), F.col("id").alias("h"))
    rows = train.join(pairs, "x").join(held, ["model", "y"]).select("model", F.least("t", "h").alias("a"), F.greatest("t", "h").alias("b"))
    itself = sides_of(splits).where("train and (eval or test)").join(texts.select("id"), "id", "left_semi").select("model", F.col("id").alias("a"), F.col("id").alias("b"))
    return rows.unionByName(itself).distinct()


def overlap_report(texts: DataFrame, splits: DataFrame, size: int = 3, similarity: float = 0.6) -> DataFrame:
    """``model, split, source, mails, exact, links``: held-out rows with a match in the train pool, those with the same words, and pairs.

    Counted from classes, so that copies are never expanded. ``texts`` has ``id, text, source``; a null source counts as one.
    """
    member, pairs = _overlaps(texts.select("id", "text"), splits, size, similarity)
    train = member.where("train").groupBy("model", F.col("class").alias("x")).agg(F.count("*").alias("n"))
    near = pairs.join(train, "x").groupBy("model", F.col("y").alias("class")).agg(F.sum("n").alias("links"), F.max(F.col("x") == F.col("y")).alias("exact"))
    held = member.withColumn("split", F.explode(F.expr("array(if(eval, 'eval', null), if(test, 'test', null))"))).where("split is not null")
    found = held.join(near, ["model", "class"]).join(texts.select("id", "source"), "id")
    return found.groupBy("model", "split", "source").agg(F.count("*").alias("mails"), F.count_if("exact").alias("exact"), F.sum("links").alias("links"))

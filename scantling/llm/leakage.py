"""Problem 9: evaluation passages in a training corpus.

Two kinds of windows are fingerprinted by SimHash on both sides: every run of twelve words, and windows as long as the items
themselves, so that an item found with words changed counts as well. Fingerprints are cut in one block more than the radius has bits, so
that any two within the radius agree in a block; windows of items are indexed by block value, windows of documents look them up as they
stream by. Candidates are verified: twelve words by comparing them, item-sized windows by the similarity of their shingles with
their numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scantling.llm.common import list_arrays, word_hashes
from scantling.llm.crosssplit import mix

#: Words of items in one index; more items are searched in several passes. An index of this size takes under 200 MB.
BLOCK_WORDS = 1_000_000
#: Words of an exact passage, and bits by which equal words may differ (none do; the guarantee is tested at this radius).
PASSAGE, PASSAGE_RADIUS = 12, 3
#: Bits by which fingerprints of item-sized windows may differ: at similarity 0.8 about one word in 45 is changed, which moves 4.3 bits of 64 on average.
RADIUS = 7
GROWTH = 1.25
STEP = 40_000  # words of documents at a time
FOUND = "doc_id long, item_id long, windows int, exact boolean, similarity double"


def sizes_up_to(longest: int, least: int = PASSAGE) -> list[int]:
    """Sizes of windows: each number of words below ``least``, then steps of a quarter."""
    out, size = list(range(1, least)), float(least)
    while int(size) <= longest:
        out.append(int(size))
        size = max(size * GROWTH, size + 1)
    return out


def bit_sums(words: np.ndarray, longest: int) -> np.ndarray:
    """Running sums of the bits of the word hashes, in the least type in which differences over ``longest`` words are exact."""
    bits = np.unpackbits(np.ascontiguousarray(mix(words.view(np.uint64))).view(np.uint8).reshape(-1, 8), axis=1)
    kind = np.uint8 if longest <= 255 else np.uint16 if longest <= 65_535 else np.uint32
    sums = np.zeros((len(words) + 1, 64), kind)  # wraps round, as do the differences
    np.cumsum(bits, axis=0, dtype=kind, out=sums[1:])
    return sums


def simhashes(sums: np.ndarray, window: int) -> np.ndarray:
    """SimHash of every run of ``window`` words, by majority of the bits of the word hashes, from their running sums."""
    if len(sums) <= window:
        return np.zeros(0, np.uint64)
    return np.packbits((sums[window:] - sums[:-window]) > window // 2, axis=1).view(np.uint64).reshape(-1)


def windows_of(flat: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the windows that lie within one text, and the texts."""
    n = max(len(flat) - window + 1, 0)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    at = np.flatnonzero(np.arange(n) + window <= offsets[1:][owner])
    return at, owner[at]


def rolled(words: np.ndarray, shingle: int) -> np.ndarray:
    """A hash of every run of ``shingle`` words."""
    out = np.zeros(max(len(words) - shingle + 1, 0), np.uint64)
    for k in range(shingle):
        out = mix((out + words[k : k + len(out)].view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15))
    return out


def shingle_counts(words: np.ndarray, shingle: int) -> Counter:
    plain = words.tolist()
    return Counter(tuple(plain[i : i + shingle]) for i in range(len(plain) - shingle + 1))


def weighted(x: Counter, y: Counter) -> float:
    """Jaccard similarity of shingles, each weighing as often as it stands in a text."""
    common = sum((x & y).values())
    whole = x.total() + y.total() - common
    return common / whole if whole else 0.0


class Table:
    """Windows of one size by block value."""

    def __init__(self, prints: np.ndarray, words: np.ndarray, item: np.ndarray, radius: int):
        self.prints, self.words, self.item, self.radius = prints, words, item, radius
        edges = np.linspace(0, 64, radius + 2).astype(int)
        self.blocks = []
        for low, high in zip(edges[:-1], edges[1:]):
            value = self.block(prints, low, high)
            order = np.argsort(value, kind="stable")
            self.blocks.append((low, high, order, np.searchsorted(value[order], np.arange((1 << int(high - low)) + 1))))

    @staticmethod
    def block(prints: np.ndarray, low: int, high: int) -> np.ndarray:
        return (prints >> np.uint64(low)).astype(np.uint64) & np.uint64((1 << int(high - low)) - 1)

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (position, item window) within the radius."""
        found = []
        for low, high, order, starts in self.blocks:
            value = self.block(prints, low, high).astype(np.int64)
            many = starts[value + 1] - starts[value]
            hit = np.flatnonzero(many)
            left = np.repeat(hit, many[hit])
            inner = np.arange(len(left)) - np.repeat(np.cumsum(many[hit]) - many[hit], many[hit])
            right = order[starts[value[left]] + inner]
            close = np.bitwise_count(prints[left] ^ self.prints[right]) <= self.radius
            found.append(left[close].astype(np.int64) * len(self.prints) + right[close])
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return pairs // max(len(self.prints), 1), pairs % max(len(self.prints), 1)


class Index:
    """The windows of a block of items: all of PASSAGE words, and for each item the first and last of the greatest size that it holds."""

    def __init__(self, ids: np.ndarray, flat: np.ndarray, offsets: np.ndarray, shingle: int, passage: int = PASSAGE, radius: int = RADIUS):
        lengths = np.diff(offsets)
        self.passage, self.shingle, self.longest = passage, shingle, int(lengths.max(initial=passage))
        sums = bit_sums(flat, self.longest)
        cut = lambda at, size: flat[at[:, None] + np.arange(size)] if len(at) else np.zeros((0, size), flat.dtype)
        at, owner = windows_of(flat, offsets, passage)
        self.passages = Table(simhashes(sums, passage)[at], cut(at, passage), ids[owner], PASSAGE_RADIUS)
        sizes = np.array(sizes_up_to(self.longest))
        size_of = sizes[np.searchsorted(sizes, lengths, side="right") - 1] if len(lengths) else np.zeros(0, int)
        self.tables: dict[int, Table] = {}
        for size in sorted(set(size_of[lengths >= shingle].tolist())):
            mine = np.flatnonzero((size_of == size) & (lengths >= shingle))
            at = np.unique(np.concatenate([offsets[mine], offsets[mine + 1] - size]))
            owner = np.searchsorted(offsets, at, side="right") - 1
            self.tables[size] = Table(simhashes(sums, size)[at], cut(at, size), ids[owner], radius)
        self.counts: dict[tuple[int, int], Counter] = {}
        self.known = np.unique(rolled(flat, shingle))

    def strange(self, words: np.ndarray) -> np.ndarray:
        """Running number of the shingles that stand in no item."""
        value = rolled(words, self.shingle)
        at = np.minimum(np.searchsorted(self.known, value), len(self.known) - 1)
        return np.concatenate([[0], np.cumsum(self.known[at] != value)])

    def similarity(self, words: np.ndarray, size: int, right: int) -> float:
        known = self.counts.get((size, right))
        if known is None:
            known = self.counts[size, right] = shingle_counts(self.tables[size].words[right], self.shingle)
        return weighted(shingle_counts(words, self.shingle), known)


def _search(index: Index, least: float) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, flat = list_arrays(batch.column("words"))
            docs = batch.column("doc_id").to_numpy()
            places = {size: windows_of(flat, offsets, size) for size in {index.passage, *index.tables}}
            found: dict[tuple[int, int], list] = {}
            hit = lambda doc, item: found.setdefault((int(docs[doc]), int(item)), [set(), 0.0])  # noqa: B023, E731
            for begin in range(0, len(flat), STEP):
                chunk = flat[begin : begin + STEP + index.longest - 1]
                sums, strange = bit_sums(chunk, index.longest), index.strange(chunk)
                for size, (at, owner) in places.items():
                    mine = slice(*np.searchsorted(at, [begin, begin + STEP]))
                    if mine.start == mine.stop:
                        continue
                    prints = simhashes(sums, size)[at[mine] - begin]
                    if size == index.passage:
                        left, right = index.passages.near(prints)
                        same = (flat[at[mine][left][:, None] + np.arange(size)] == index.passages.words[right]).all(axis=1)
                        for i, j in zip(left[same].tolist(), right[same].tolist()):
                            hit(owner[mine][i], index.passages.item[j])[0].add(j)
                    if size in index.tables:
                        left, right = index.tables[size].near(prints)
                        n, first = size - index.shingle + 1, at[mine][left] - begin
                        # windows of n shingles each have 2 n s / (1 + s) in common at least, so that no more than the rest may be strange to all items
                        some = strange[first + n] - strange[first] <= n - 2 * n * least / (1 + least) + 1e-6
                        left, right = left[some], right[some]
                        for i, j in zip(left.tolist(), right.tolist()):
                            first = at[mine][i]
                            s = index.similarity(flat[first : first + size], size, j)
                            if s >= least:
                                known = hit(owner[mine][i], index.tables[size].item[j])
                                known[1] = max(known[1], s)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in found], pa.int64()),
                    pa.array([k[1] for k in found], pa.int64()),
                    pa.array([len(v[0]) for v in found.values()], pa.int32()),
                    pa.array([bool(v[0]) for v in found.values()], pa.bool_()),
                    pa.array([v[1] for v in found.values()], pa.float64()),
                ],
                names=["doc_id", "item_id", "windows", "exact", "similarity"],
            )

    return run


def leaks(docs: DataFrame, items: DataFrame, passage: int = PASSAGE, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """Documents in which items stand, in part or whole: ``doc_id, item_id, windows, exact, similarity``.

    ``docs`` has ``doc_id, text``, ``items`` has ``item_id, text``; ids are unique. ``exact`` tells that some ``passage`` words of the item
    stand there word for word, ``windows`` how many runs of so many words of the item do. ``similarity`` is that of the best
    window as long as the item (to a quarter, from its first or to its last word), 0 if none reaches the bound. A row needs either.
    Windows are compared if their fingerprints are within the radius, see RADIUS. Null and empty texts have no windows; an item under
    ``shingle`` words is never found, one under ``passage`` words is by its similarity. Documents aren't shuffled; items are
    broadcast in blocks of BLOCK_WORDS words, one pass over the documents for each block.
    """
    spark = docs.sparkSession
    hashed = items.where("item_id is not null").select("item_id", word_hashes(F.col("text")).alias("words")).where(F.size("words") >= shingle)
    total = hashed.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_WORDS))
    read = docs.where("doc_id is not null").select("doc_id", word_hashes(F.col("text")).alias("words")).where(F.size("words") >= shingle)
    out = None
    for b in range(blocks):
        rows = hashed.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id").collect()  # BLOCK_WORDS words, about
        if not rows:
            continue
        offsets = np.concatenate([[0], np.cumsum([len(r["words"]) for r in rows])]).astype(np.int64)
        flat = np.concatenate([np.array(r["words"], np.int64) for r in rows])
        index = Index(np.array([r["item_id"] for r in rows], np.int64), flat, offsets, shingle, passage)
        part = read.mapInArrow(_search(index, similarity), FOUND)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], FOUND) if out is None else out

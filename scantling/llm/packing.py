"""Problem 8: items of varying length in containers of fixed capacity.

Texts are measured in tokens of a public tokenizer and packed by best fit in decreasing order, over several
permitted capacities at once: a container is opened at the capacity of least cost for what is still
to come, and shrunk to its contents in the end. Items are dealt at random to shards of bounded size that
are packed side by side; a shard wastes less than one container more than packing all in one would.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scantling.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the public byte-level tokenizer parts a text before it merges bytes.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CAPACITY = 2048
CAPACITIES = (256, 512, 1024, 2048)
ITEMS_PER_SHARD = 20_000
PLACED = "doc_id long, piece int, tokens int, container long, capacity int"


def _counter(vocabulary: bytes, pattern: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        encoding = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            n = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], names=["doc_id", "tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """``doc_id, tokens`` of ``doc_id, text``; the vocabulary file is read on the driver (under 1 MB) and sent along."""
    with open(tokenizer, "rb") as f:
        vocabulary = f.read()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_counter(vocabulary, pattern), "doc_id long, tokens long")


def least_cost(n: int, left: int, smallest: int, costs: dict[int, float]) -> int:
    """The capacity to open for an item of size ``n`` with ``left`` still to come, itself included: least cost a token that it will hold.

    A container is filled until not even the smallest item to come fits, so that half of that size stays free on average; near the end it holds
    what is left. Of equal costs the largest capacity counts, which leaves the most choice.
    """
    held = lambda c: max(n, min(left, c - smallest / 2))
    return min((c for c in costs if c >= n), key=lambda c: (costs[c] / max(held(c), 1e-9), -c))


def pack(sizes: np.ndarray, capacities: tuple[int, ...], costs: dict[int, float] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(container of each item, capacity of each container); sizes must not exceed the largest capacity.

    Best fit in decreasing order: the fullest container with room for the item. Where none has room, the capacity of least cost is opened, see
    :func:`least_cost`; ``costs`` by capacity, its length if not given. In the end every container is shrunk to the cheapest capacity that
    holds its contents.
    """
    costs = {c: float(c) for c in capacities} if costs is None else costs
    if set(costs) != set(capacities) or min(costs.values()) <= 0:
        raise ValueError("every capacity needs a cost above 0")
    top = max(capacities)
    order = np.argsort(-sizes, kind="stable")
    left = int(sizes.sum())
    smallest = int(sizes.min(initial=0))
    where = np.zeros(len(sizes), np.int64)
    room: list[list[int]] = [[] for _ in range(top + 1)]
    levels = 0  # bit r is set if a container has room r
    used: list[int] = []
    for i in order.tolist():
        n = int(sizes[i])
        fits = levels >> n
        if fits:
            r = n + ((fits & -fits).bit_length() - 1)
            b = room[r].pop()
            if not room[r]:
                levels ^= 1 << r
        else:
            b, r = len(used), least_cost(n, left, smallest, costs)
            used.append(0)
        used[b] += n
        left -= n
        where[i] = b
        r -= n
        if not room[r]:
            levels |= 1 << r
        room[r].append(b)
    return where, np.array([min((c for c in capacities if c >= u), key=lambda c: (costs[c], c)) for u in used], np.int64)


def _packed(capacities: tuple[int, ...], costs: dict[int, float] | None) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        if held is None:
            return
        shards = held.column("shard").to_numpy()
        for shard in np.unique(shards):
            rows = held.take(pa.array(np.flatnonzero(shards == shard)))
            rows = rows.sort_by([("doc_id", "ascending"), ("piece", "ascending")])
            where, capacity = pack(rows.column("tokens").to_numpy(), capacities, costs)
            out = pa.table([rows.column("doc_id"), rows.column("piece"), rows.column("tokens").cast(pa.int32()), pa.array((int(shard) << 32) + where), pa.array(capacity[where].astype(np.int32))], names=["doc_id", "piece", "tokens", "container", "capacity"])
            yield from out.combine_chunks().to_batches()

    return run


def containers(sizes: DataFrame, capacities: tuple[int, ...] = CAPACITIES, per_shard: int = ITEMS_PER_SHARD, costs: dict[int, float] | None = None) -> DataFrame:
    """``doc_id, piece, tokens, container, capacity``: the container of each piece of ``doc_id, tokens``.

    A document is split only if it exceeds the largest capacity, into full pieces and a rest. Documents without
    tokens (null or empty text) are pieces of 0 tokens and take a place in some container. Rows with a null id are
    left out. Pieces are dealt to shards of about ``per_shard``, whatever their number, and each shard is packed for itself: it ends with one
    container that isn't full at most, so that at 20,000 pieces a shard the fill falls short of one packing of all by less than 0.1 %.
    ``costs`` is of :func:`pack`.
    """
    top = max(capacities)
    last = F.greatest(F.ceil(F.col("tokens") / top), F.lit(1)).cast("int")
    pieces = cut(
        sizes.where("doc_id is not null")
        .select("doc_id", "tokens", F.explode(F.sequence(F.lit(1), last)).alias("piece"))
        .select("doc_id", "piece", F.least(F.lit(top), F.col("tokens") - (F.col("piece") - 1) * top).cast("long").alias("tokens"))
    )
    full, rest = pieces.where(F.col("tokens") == top), pieces.where(F.col("tokens") < top)
    shards = max(1, -(-rest.count() // per_shard))
    dealt = rest.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards))).repartition(shards, "shard")
    alone = full.select("doc_id", "piece", F.col("tokens").cast("int").alias("tokens"), (-(F.col("doc_id") * (1 << 20) + F.col("piece"))).alias("container"), F.lit(top).alias("capacity"))
    return dealt.mapInArrow(_packed(tuple(capacities), costs), PLACED).unionByName(alone)

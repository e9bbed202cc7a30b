"""Problem 3: top N items of every group by secondary sort.

Each partition is sorted by group, score and identifier as it stands and streamed once, so that a group of
any size leaves at most N rows a partition; these are hash-partitioned by group, sorted and streamed again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scantling.llm.common import changes


def _first(n: int, groups: int, item: int, ranked: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Streams sorted batches and passes on each group's first ``n`` distinct items; holds only those of the current group."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: list[pa.Scalar] | None = None
        got: set = set()
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            new = np.zeros(size, dtype=bool)
            for c in range(groups):
                new |= changes(batch.column(c), before and before[c])
            if before is None:
                new[0] = True
            starts = np.flatnonzero(new)
            items = batch.column(item)
            keep, pos = [], []
            begins = starts if len(starts) and starts[0] == 0 else np.concatenate([[0], starts])
            for begin, end in zip(begins.tolist(), np.concatenate([begins[1:], [size]]).tolist()):
                if new[begin]:
                    got = set()
                row = begin
                while row < end and len(got) < n:
                    value = items[row].as_py()
                    if value not in got:
                        got.add(value)
                        keep.append(row)
                        pos.append(len(got))
                    row += 1
            before = [batch.column(c)[size - 1] for c in range(groups)]
            out = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(pos, pa.int32())], names=[*out.schema.names, "pos"]) if ranked else out

    return run


def top_n(df: DataFrame, groups: list[str], score: str, item: str, n: int) -> DataFrame:
    """The first ``n`` distinct items of every group by score descending, then item ascending, with ``pos`` from 1.

    Rows whose score is null or NaN, or whose item is null, are left out; null is a group of its own. An item
    that stands several times in a group counts once, at its best score. Groups of fewer than ``n`` items
    are given whole, an empty input gives no rows. Result: group columns, score, item, pos.
    """
    columns = [*(F.col(g) for g in groups), (F.col(score).cast("double") + F.lit(0.0)).alias(score), F.col(item)]
    rows = df.select(*columns).where(F.col(score).isNotNull() & ~F.isnan(score) & F.col(item).isNotNull())
    order = [*(F.col(g).asc() for g in groups), F.col(score).desc(), F.col(item).asc()]
    local = rows.sortWithinPartitions(*order).mapInArrow(_first(n, len(groups), len(groups) + 1, False), rows.schema)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", pos int"
    return local.repartition(*(F.col(g) for g in groups)).sortWithinPartitions(*order).mapInArrow(_first(n, len(groups), len(groups) + 1, True), schema)

"""Problem 1: records that differ by formatting only.

Canonical records are range-partitioned, sorted externally by Spark and read once: a run of equal full keys
is one record, its smallest id the representative, its length the number of copies. A hot record (a third
of all rows, say) is split over several partitions, because the range key ends with the id; the runs at
the ends of partitions, at most two a partition, are then joined up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scantling.llm.common import changes, letters_digits
from scantling.session import cut

# The header fields that may open a mail.
MAIL_FIELDS = ("Subject", "From", "To", "Date")

FIELD_END, PART_END = "\u0001", "\u0002"
HEADER_LINE = r"(?i)^[ \t]*(?:" + "|".join(MAIL_FIELDS) + r")[ \t]*:"
ITEM = r"^[^\p{L}\p{N}]*\p{L}[\p{L}\p{N} _-]{0,40}:"

RUNS = "rep long, member long, copies long, edge binary"


def header_lines(lines: Column) -> Column:
    """How many header lines open a mail, given its lines."""
    first_other = F.array_position(F.transform(lines, lambda x: x.rlike(HEADER_LINE)), False)
    return F.when(first_other == 0, F.size(lines)).otherwise(first_other - 1).cast("int")


def mail_key(text: Column) -> Column:
    """Key of a mail: its opening header lines in sorted order, then the letters and digits of the rest."""
    lines = F.split(text, "\n")
    n = header_lines(lines)
    head = F.array_sort(F.transform(F.slice(lines, F.lit(1), n), letters_digits))
    rest = F.array_join(F.slice(lines, n + 1, F.size(lines)), "\n")
    return F.when(text.isNotNull(), F.concat(F.array_join(head, FIELD_END), F.lit(PART_END), letters_digits(rest)))


def items_key(text: Column) -> Column:
    """Key of a message: its ``Name: value`` items in sorted order if it holds nothing else, or its letters and digits."""
    parts = F.filter(F.split(text, "[;|]"), lambda p: p.rlike(r"[\p{L}\p{N}]"))
    fields = (F.size(parts) > 1) & F.forall(parts, lambda p: p.rlike(ITEM))
    return F.when(fields, F.array_join(F.array_sort(F.transform(parts, letters_digits)), FIELD_END)).otherwise(letters_digits(text))


def digest(key: str) -> bytes:
    """What stands for a full key where runs at the ends of partitions are joined up: its length and 128 bits."""
    data = key.encode("utf-8", "surrogatepass")
    return len(data).to_bytes(8, "big") + hashlib.blake2b(data, digest_size=16).digest()


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal keys among sorted (key, id): a row for each member but the first, and one for each run."""
    key = last = None
    rep, copies, first = 0, 0, True
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, ids = batch.column("key"), batch.column("id").to_numpy()
        new = changes(keys, key)
        again = ~new & (ids == np.concatenate([[ids[0] if last is None else last], ids[:-1]]))
        if last is None:
            again[0] = False
        starts = np.flatnonzero(new)
        at = np.maximum.accumulate(np.where(new, np.arange(len(ids)), -1))
        reps = np.where(at >= 0, ids[np.maximum(at, 0)], rep)
        member = ~new & ~again
        seen = np.concatenate([[0], np.cumsum(~again)])
        ends = np.concatenate([starts, [len(ids)]])
        out_rep, out_copies, out_edge = [], [], []
        if len(starts):
            if key is not None:  # the run carried over ends here
                out_rep.append([rep])
                out_copies.append([copies + seen[starts[0]]])
                out_edge.append(digest(key.as_py()) if first else None)
                first = False
            whole = starts[:-1]
            out_rep.append(ids[whole])
            out_copies.append(seen[ends[1:-1]] - seen[whole])
            edges = [None] * len(whole)
            if first and len(whole):
                edges[0], first = digest(keys[int(whole[0])].as_py()), False
            out_edge.extend(edges)
            rep, copies, key = int(ids[starts[-1]]), int(seen[-1] - seen[starts[-1]]), keys[int(starts[-1])]
        else:
            copies += int(seen[-1])
        last = ids[-1]
        runs = np.concatenate(out_rep).astype(np.int64) if out_rep else np.zeros(0, np.int64)
        n, m = int(member.sum()), len(runs)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([reps[member].astype(np.int64), runs])),
                pa.concat_arrays([pa.array(ids[member]), pa.nulls(m, pa.int64())]),
                pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(np.concatenate(out_copies).astype(np.int64) if out_copies else np.zeros(0, np.int64))]),
                pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array(out_edge, pa.binary())]),
            ],
            names=["rep", "member", "copies", "edge"],
        )
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([rep]), pa.nulls(1, pa.int64()), pa.array([copies]), pa.array([digest(key.as_py())])], names=["rep", "member", "copies", "edge"])


def equal_runs(keyed: DataFrame, number: str = "id", key: str = "key") -> tuple[DataFrame, DataFrame]:
    """Groups of rows with equal keys.

    ``keyed`` has a bigint id and a string key; rows with a null id or key are left out, and a row that stands
    twice with the same id counts once. Returns (records, members): ``rep, copies`` with one row a key, rep
    the smallest id, and ``rep, member`` with one row for each id but the smallest. The input is read twice
    (bounds of the ranges, then the sort); only ids and numbers are written.
    """
    rows = keyed.select(F.col(number).cast("long").alias("id"), F.col(key).alias("key")).where("id is not null and key is not null").withColumn("h", F.xxhash64("key"))
    ordered = rows.repartitionByRange("h", "id").sortWithinPartitions("h", "key", "id").select("key", "id")
    runs = cut(ordered.mapInArrow(_runs, RUNS))
    edges = runs.where("edge is not null")
    whole = edges.groupBy("edge").agg(F.min("rep").alias("first"), F.sum("copies").alias("all"), F.count("*").alias("pieces")).where("pieces > 1")
    # two rows of 48 bytes a partition at most: 10 MB for 100,000 partitions
    moved = F.broadcast(edges.join(F.broadcast(whole), "edge").select(F.col("rep").alias("old"), "first", "all"))
    heads = moved.where("old <> first").select(F.col("first").alias("rep"), F.col("old").alias("member"))
    moved_ids = moved.select(F.col("old").alias("rep"), "first", "all")
    members = runs.where("member is not null").join(moved_ids, "rep", "left").select(F.coalesce("first", "rep").alias("rep"), "member").unionByName(heads)
    records = runs.where("copies is not null").join(moved_ids, "rep", "left").where("first is null or first = rep").select("rep", F.coalesce("all", "copies").alias("copies"))
    return records, members


def collapse(df: DataFrame, number: str, key: Column) -> DataFrame:
    """One row for each distinct record: ``rep`` (smallest id) and ``copies``; rows whose key is null are left out."""
    return equal_runs(df.select(F.col(number).alias("id"), key.alias("key")))[0]


def tagged(tables: dict[str, DataFrame]) -> DataFrame:
    """Keys of several tables in one set of rows: id and source name are packed into one number, 8 bits for the source."""
    out = None
    for k, df in enumerate(tables.values()):
        df = df.select((F.shiftleft(F.col("id"), 8) + F.lit(k)).alias("id"), F.concat(F.lit(f"{k}{PART_END}"), "key").alias("key"))
        out = df if out is None else out.unionByName(df)
    return out


def untagged(names: list[str], df: DataFrame, *ids: str) -> DataFrame:
    """Inverse of :func:`tagged`: a column ``dataset`` and plain ids."""
    name = F.element_at(F.array(*map(F.lit, names)), (F.col(ids[0]).bitwiseAND(255) + 1).cast("int"))
    return df.withColumns({"dataset": name} | {c: F.shiftright(F.col(c), 8) for c in ids})

"""Text expressions and Arrow helpers shared by the corpus operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_ALNUM = r"[^\p{L}\p{N}]+"


def letters_digits(text: Column) -> Column:
    """Letters and digits only, without case: sharp s agrees with ss, a final sigma with any other."""
    return F.replace(F.replace(F.lower(F.regexp_replace(text, NOT_ALNUM, "")), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def words(text: Column) -> Column:
    """The words of a text: longest runs of letters and digits, lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the words in order; an empty array for null and empty texts."""
    return F.coalesce(F.transform(words(text), lambda w: F.xxhash64(w)), F.expr("cast(array() as array<bigint>)"))


def changes(column: pa.Array | pa.ChunkedArray, before: pa.Scalar | None) -> np.ndarray:
    """True where a value differs from the one before it, nulls being equal; ``before`` precedes the first."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = np.ones(len(column), dtype=bool)
    if not len(column):
        return out
    a, b = column[1:], column[:-1]
    differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    nulls = pc.xor(pc.is_null(a), pc.is_null(b)).to_numpy(zero_copy_only=False)
    out[1:] = differ | nulls
    if before is not None:
        out[0] = column[0].as_py() != before.as_py()
    return out


def list_arrays(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and flat values of a list column without nulls."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]

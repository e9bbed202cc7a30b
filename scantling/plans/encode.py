"""Vectors of texts. The built-in encoder needs no model; others plug in."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from scantling.functions.prompts import NO_FORMS, YES_FORMS, answer_token, filter_prompt, in_mode, tokens

#: (texts, layers, first tokens to pool or None) -> one matrix (texts x width) a layer; made once a task.
Encoder = Callable[[list[str], list[int], list[int] | None], dict[int, np.ndarray]]
#: texts -> logits of the token that would follow each (texts x vocabulary); made once a task.
Logits = Callable[[list[str]], np.ndarray]

#: Tokens of the built-in encoder, as :func:`scantling.functions.prompts.tokens` cuts them.
TOKEN = re.compile(r"[^ \t\n\r\f\v]+")

# Where models of different makes keep their layers.
LAYER_PLACES = ("model.layers", "model.decoder.layers", "transformer.h", "transformer.layers")


def layers_of(model: object, places: tuple[str, ...] = LAYER_PLACES) -> object:
    """The list of layers of a model, for encoders with one behind them; a model without any is an error."""
    for place in places:
        found = model
        for name in place.split("."):
            found = getattr(found, name, None)
        if found is not None:
            return found
    raise ValueError(f"no layers at any of {', '.join(places)}")


def token_values(token: str, layer: int, width: int) -> np.ndarray:
    """Pseudo-random values in [-1, 1) of a token in a layer, in steps of 1/1024: 16 bits each of md5(token|layer|k), eight values to a digest."""
    data = b"".join(hashlib.md5(f"{token}|{layer}|{k}".encode()).digest() for k in range(-(-width // 8)))  # noqa: S324
    return (np.frombuffer(data, ">u2")[:width].astype(np.int64) % 2048 - 1024) / 1024.0


def hashed(width: int = 32, most: int = 512) -> Callable[[], Encoder]:
    """Mean over the first ``most`` tokens, or those from a start on, of :func:`token_values`, which every engine can compute as well."""

    def make() -> Encoder:
        known: dict[tuple[str, int], np.ndarray] = {}

        def encode(texts: list[str], layers: list[int], starts: list[int] | None = None) -> dict[int, np.ndarray]:
            parts = [TOKEN.findall(t)[:most] for t in texts]
            if starts is not None:
                parts = [p[min(max(s, 0), max(len(p) - 1, 0)) :] for p, s in zip(parts, starts, strict=True)]
            if len(known) > 200_000:
                known.clear()
            out = {}
            for layer in layers:
                names = {t: k for k, t in enumerate(dict.fromkeys(t for p in parts for t in p))}
                for t in names:
                    if (t, layer) not in known:
                        known[t, layer] = token_values(t, layer, width)
                table = np.stack([known[t, layer] for t in names]) if names else np.zeros((0, width))
                sizes = np.array([len(p) for p in parts])
                sums = np.zeros((len(texts), width))
                np.add.at(sums, np.repeat(np.arange(len(texts)), sizes), table[[names[t] for p in parts for t in p]] if names else table)
                out[layer] = (sums / np.maximum(sizes, 1)[:, None]).astype(np.float32)
            return out

        return encode

    return make


def vectors(texts: DataFrame, dataset: str, mode: str, layers: list[int], make: Callable[[], Encoder] | None = None, start: Column | None = None) -> DataFrame:
    """``sample_id, label, layer, x`` of ``sample_id, text, label`` in a mode; a task makes its encoder once and streams batches.

    ``start`` is the token, from 0, from which a text is pooled; beyond the last one the last one counts. Null is 0.
    """
    make = make or hashed()
    spans = start is not None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make()
        for batch in batches:
            plain = [t or "" for t in batch.column("text").to_pylist()]
            by_layer = encode(plain, layers, batch.column("start").to_pylist()) if spans else encode(plain, layers)
            for layer, rows in by_layer.items():
                flat = rows.astype(np.float32)
                x = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column("sample_id"), batch.column("label"), pa.array([layer] * len(rows), pa.int32()), x], names=["sample_id", "label", "layer", "x"])

    first = F.coalesce(start.cast("int"), F.lit(0)) if spans else F.lit(0)
    given = texts.select(F.col("sample_id").cast("long").alias("sample_id"), F.col("label").cast("int").alias("label"), in_mode(dataset, mode, F.col("text")).alias("text"), first.alias("start"))
    return given.mapInArrow(run, "sample_id long, label int, layer int, x array<float>")


def answer_difference(dataset: str, make: Callable[[], Logits], vocabulary: dict[str, list[int]]) -> Callable[[DataFrame], DataFrame]:
    """What adds ``logit_diff`` by a model: how much likelier it answers yes than no to the dataset's question. ``vocabulary`` has the tokens of each form of the answers."""
    yes, no = answer_token(vocabulary, YES_FORMS), answer_token(vocabulary, NO_FORMS)

    def add(texts: DataFrame) -> DataFrame:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            logits = make()
            for batch in batches:
                scores = logits(batch.column("_question").to_pylist()) if batch.num_rows else np.zeros((0, max(yes, no) + 1))
                difference = pa.array((scores[:, yes] - scores[:, no]).astype(float))
                yield batch.drop_columns(["_question"]).append_column("logit_diff", difference)

        asked = texts.withColumn("_question", F.coalesce(filter_prompt(dataset, F.col("text")), F.lit("")))
        return asked.mapInArrow(run, StructType([*texts.schema.fields, StructField("logit_diff", DoubleType())]))

    return add


def surrogate_difference(text: DataFrame, column: str = "text") -> DataFrame:
    """Adds ``logit_diff`` in [-1, 1] by hash: stands in for a model's confidence where none is plugged in."""
    number = F.conv(F.substring(F.md5(column), 1, 8), 16, 10).cast("long")
    return text.withColumn("logit_diff", (number % 2001 - 1000) / F.lit(1000.0))


def token_rows(df: DataFrame, column: str = "text", most: int = 512) -> DataFrame:
    return df.withColumn("tokens", tokens(F.col(column), most))

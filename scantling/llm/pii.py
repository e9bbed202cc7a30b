"""Problem 2: personal details inside free text.

A bidirectional LSTM over characters scores tags for overlapping windows, a CRF over tag transitions decodes each
window, and the spans of all windows of a text are reconciled, those farthest from a window's edge first. The spans are
the network's own; those that can't be what they are tagged as, a phone number of two digits say, are dropped. The network is
numpy; its weights come from :mod:`scantling.llm.pii_train`.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Callable, Container, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "phone", "identity", "address", "person")

TAGS = 1 + 2 * len(KINDS)  # outside, then first and later characters of each kind
WINDOW, MARGIN = 256, 24
BATCH = 512
WEIGHTS = os.path.join(os.path.dirname(__file__), "pii_weights.npz")
OTHER_LETTER, OTHER_SIGN = 1, 2


def _table() -> np.ndarray:
    table = np.full(0x2500, OTHER_SIGN, np.uint8)
    table[:128] = np.arange(128)
    table[[9, 0xA0]] = 32
    for c in range(128, 0x2500):
        base = unicodedata.normalize("NFKD", chr(c))[0]
        if ord(base) < 128 and base.isalnum():
            table[c] = ord(base)
        elif chr(c).isalpha():
            table[c] = OTHER_LETTER
    for plain, signs in (("'", "‘’"), ('"', "“”„"), ("-", "–—")):
        for c in signs:
            table[ord(c)] = ord(plain)
    return table


CODES = _table()


def encode(text: str) -> np.ndarray:
    """One code below 128 for each character; accents are dropped."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return CODES[np.minimum(points, len(CODES) - 1)]


def gates(z: np.ndarray, h: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Input, forget, output gates and candidate of pre-activations laid out i, f, o, g (the first three halved)."""
    z = np.tanh(z, out=z)
    s = z[:, : 3 * h]
    s *= 0.5
    s += 0.5
    return z[:, :h], z[:, h : 2 * h], z[:, 2 * h : 3 * h], z[:, 3 * h :]


class Tagger:
    """The trained network. Arrays: ``in_f, in_b`` (128 x 4H), ``re_f, re_b`` (H x 4H), ``out`` (2H x tags), ``bias``, ``trans, start``."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = {k: np.ascontiguousarray(v, np.float32) for k, v in weights.items()}
        self.h = self.w["re_f"].shape[0]
        scale = np.ones(4 * self.h, np.float32)
        scale[: 3 * self.h] = 0.5  # sigmoid by tanh
        for k in ("in_f", "in_b", "re_f", "re_b"):
            self.w[k] = self.w[k] * scale

    def emissions(self, codes: np.ndarray) -> np.ndarray:
        """Tag scores (time, rows, tags) of codes (time, rows)."""
        steps, rows = codes.shape
        h, w = self.h, self.w
        hidden = np.empty((steps, rows, 2 * h), np.float32)
        for side, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
            state, cell = np.zeros((rows, h), np.float32), np.zeros((rows, h), np.float32)
            at = slice(0, h) if side == "f" else slice(h, 2 * h)
            given, again = w[f"in_{side}"], w[f"re_{side}"]
            for t in order:
                z = state @ again
                z += given[codes[t]]
                i, f, o, g = gates(z, h)
                cell *= f
                i *= g
                cell += i
                np.tanh(cell, out=state)
                state *= o
                hidden[t, :, at] = state
        return hidden.reshape(-1, 2 * h) @ w["out"] + w["bias"]

    def tags(self, codes: np.ndarray) -> np.ndarray:
        """Best tag sequences (time, rows) under the CRF."""
        steps, rows = codes.shape
        score = self.emissions(codes).reshape(steps, rows, TAGS)
        # a later character of a kind follows a first or later one of that kind only; whatever is outside or first follows anything
        opens, later, first = np.array([0, *range(1, TAGS, 2)]), np.arange(2, TAGS, 2), np.arange(1, TAGS, 2)
        to_open = np.ascontiguousarray(self.w["trans"].T[opens])[None]  # to, from
        stay, enter = self.w["trans"][later, later], self.w["trans"][first, later]
        best = score[0] + self.w["start"]
        best[:, later] = -1e9
        back = np.empty((steps, rows, TAGS), np.int8)
        for t in range(1, steps):
            through = best[:, None, :] + to_open
            begun, held = best[:, first] + enter, best[:, later] + stay
            newer = begun > held
            back[t][:, opens] = through.argmax(axis=2)
            back[t][:, later] = np.where(newer, first, later)
            now = np.empty_like(best)
            now[:, opens] = through.max(axis=2)
            now[:, later] = np.where(newer, begun, held)
            now += score[t]
            best = now
        out = np.empty((steps, rows), np.int8)
        out[-1] = best.argmax(axis=1)
        at = np.arange(rows)
        for t in range(steps - 1, 0, -1):
            out[t - 1] = back[t, at, out[t]]
        return out


@lru_cache(maxsize=1)
def tagger(path: str = WEIGHTS) -> Tagger:
    with np.load(path) as f:
        return Tagger({k: f[k] for k in f.files})


def spans_of(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of one tag sequence."""
    out = []
    inside = tags > 0
    change = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
    for a, b in zip(change[::2].tolist(), change[1::2].tolist()):
        begin = a
        for t in range(a + 1, b + 1):
            if t == b or tags[t] % 2 == 1 or (tags[t] + 1) // 2 != (tags[begin] + 1) // 2:
                out.append((begin, t, (int(tags[begin]) + 1) // 2 - 1))
                begin = t
    return out


def cut_windows(length: int) -> list[int]:
    """Starts of the windows over a text."""
    if length <= WINDOW:
        return [0]
    step = WINDOW - 2 * MARGIN
    starts = list(range(0, length - WINDOW, step))
    return [*starts, length - WINDOW]


def detect(texts: list[str], model: Tagger) -> list[list[tuple[int, int, str]]]:
    """Spans of each text, windows decoded together and reconciled over the whole text."""
    codes = [encode(t) for t in texts]
    places = [(k, s) for k, c in enumerate(codes) if len(c) for s in cut_windows(len(c))]
    raw: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
    places.sort(key=lambda p: min(len(codes[p[0]]), WINDOW))  # windows of one length side by side
    for begin in range(0, len(places), BATCH):
        group = places[begin : begin + BATCH]
        width = max(min(len(codes[k]), WINDOW) for k, _ in group)
        grid = np.full((width, len(group)), 10, np.uint8)
        for j, (k, s) in enumerate(group):
            piece = codes[k][s : s + width]
            grid[: len(piece), j] = piece
        best = model.tags(grid)
        for j in np.flatnonzero((best > 0).any(axis=0)).tolist():
            k, s = group[j]
            length = len(codes[k])
            for a, b, kind in spans_of(np.ascontiguousarray(best[:, j])):
                low, high = s + a, min(s + b, length)
                if low < high:
                    inner = min(low - s if s else WINDOW, s + width - high if s + width < length else WINDOW)
                    raw[k].append((-inner, low, high, kind))
    out = []
    for spans in raw:
        kept: list[tuple[int, int, str]] = []
        for _, low, high, kind in sorted(spans):
            if not any(low < b and a < high for a, b, _ in kept):
                kept.append((low, high, KINDS[kind]))
        out.append(sorted(kept))
    return out


# Words that open or close a letter.
GREETINGS = ("hello", "hi", "hey", "dear", "thanks", "regards", "cheers", "yours", "wishes")


def digits(text: str) -> int:
    return sum(c.isdigit() for c in text)


def checked(text: str, spans: list[tuple[int, int, str]], lexicon: Container[str]) -> list[tuple[int, int, str]]:
    """The network's spans without white space at their ends, and without those that can't be what they are tagged as."""
    bare = ((a + len(text[a:b]) - len(text[a:b].lstrip()), a + len(text[a:b].rstrip()), kind) for a, b, kind in spans)
    return [(a, b, kind) for a, b, kind in bare if looks(text[a:b], kind, lexicon)]


def looks(piece: str, kind: str, lexicon: Container[str]) -> bool:
    """Least demands on a span: words for a name, one of them an initial or a listed name or, where neither is, two of four letters with capitals; digits in number for the others."""
    n = digits(piece)
    if kind == "person":
        parts = [p for p in re.split(r"[\W\d_]+", piece) if p]
        if n or len(parts) < 2 or parts[0].lower() in GREETINGS:
            return False
        return any(len(p) == 1 or p.lower() in lexicon for p in parts) or sum(len(p) >= 4 and p[0].isupper() for p in parts) >= 2
    if kind == "identity":
        return 6 <= n <= 14 and n >= 0.5 * sum(c.isalnum() for c in piece)
    if kind == "address":
        return n > 0 and sum(c.isalpha() for c in piece) >= 4 and len(piece.split()) >= 2
    if kind == "email":
        return "@" in piece or re.search(r"(?i)\bat\b", piece) is not None
    return 7 <= n <= 20


FOUND = "dataset string, sample_id long, spans array<struct<a:int,b:int,kind:string>>"


def _find(model: dict[str, np.ndarray], lexicon: frozenset[str], redact: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Tagger(model)
        for batch in batches:
            for begin in range(0, batch.num_rows, 400):  # bounds the windows held at once
                part = batch.slice(begin, 400)
                texts = part.column("text").to_pylist()
                every = [checked(t, s, lexicon) for t, s in zip(texts, detect(texts, network))]
                head = [part.column("dataset"), part.column("sample_id")]
                if redact:
                    yield pa.RecordBatch.from_arrays([*head, pa.array([replaced(t, s) for t, s in zip(texts, every)], pa.string()), pa.array([len(s) for s in every], pa.int32())], names=["dataset", "sample_id", "text", "details"])
                else:
                    rows = np.repeat(np.arange(len(texts)), [len(s) for s in every])
                    flat = [x for s in every for x in s]
                    yield pa.RecordBatch.from_arrays(
                        [*(c.take(pa.array(rows)) for c in head), pa.array([x[2] for x in flat], pa.string()), pa.array([x[0] + 1 for x in flat], pa.int32())], names=["dataset", "sample_id", "kind", "start_pos"]
                    )

    return run


def replaced(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with a typed placeholder for each span."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
            at = b
    return "".join([*out, text[at:]])


def _prepared(names: DataFrame, weights: str) -> tuple[dict[str, np.ndarray], frozenset[str]]:
    with np.load(weights) as f:
        model = {k: f[k] for k in f.files}
    # a lexicon of names, a few hundred rows at every scale; refuse what isn't one
    rows = names.select(F.lower("name").alias("name")).where("name is not null").distinct().limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("the table of names isn't a lexicon: more than 100,000 rows")
    return model, frozenset(p for r in rows for p in r["name"].split())


def details(texts: DataFrame, names: DataFrame, weights: str = WEIGHTS) -> DataFrame:
    """``dataset, sample_id, kind, start_pos`` (from 1, in characters) of the personal details of ``dataset, sample_id, text``.

    Whole texts are read whatever their length; null and empty ones have no details. No shuffle.
    """
    model, lexicon = _prepared(names, weights)
    rows = texts.where(F.length("text") > 0).select("dataset", F.col("sample_id").cast("long").alias("sample_id"), "text")
    return rows.mapInArrow(_find(model, lexicon, False), "dataset string, sample_id long, kind string, start_pos int")


def redacted(texts: DataFrame, names: DataFrame, weights: str = WEIGHTS) -> DataFrame:
    """``dataset, sample_id, text, details``: the texts with ``[EMAIL]`` and the like for each detail, and their number; null texts are left out."""
    model, lexicon = _prepared(names, weights)
    rows = texts.where("text is not null").select("dataset", F.col("sample_id").cast("long").alias("sample_id"), "text")
    return rows.mapInArrow(_find(model, lexicon, True), "dataset string, sample_id long, text string, details int")

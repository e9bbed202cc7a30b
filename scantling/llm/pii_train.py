"""Training of the tagger: ``python -m scantling.llm.pii_train DATA_DIR SECONDS`` writes ``pii_weights.npz``.

Labelled spans come from two sources. Half are made: details of random names, numbers and shapes are put into stretches of mails and messages that
hold none, with look-alikes that are no details. Half come from the exact forms, on a bounded sample of texts (MAILS and MESSAGES rows,
the documented bound), so that the network knows how the corpus itself writes. Both partly in altered case. Backpropagation through time and
the CRF's forward-backward pass are numpy. With weights at hand training goes on from them.
"""

from __future__ import annotations

import sys
import time

import numpy as np

from scantling.llm.pii import KINDS, TAGS, WEIGHTS, WINDOW, Tagger, detect, encode
from scantling.llm.pii_rules import Names, found

MAILS, MESSAGES = 2500, 4000
HIDDEN = 32


MADE = 12_000  # texts with made details

# Words from which details are made.
GIVEN = "Anna James Maria Peter Li Omar Ingrid Sofia Tomas Aisha Bruno Chloe Dmitri Elena Felix Greta Hugo Irene Jonas Karin Luis Mei Nadia Oscar Paula Quentin Rosa Stefan Tara Ursula Victor Wendy Yusuf Zoe".split()
FAMILY = "Smith Garcia Mueller Rossi Novak Kim Haddad Larsen Dubois Silva Ivanov Tanaka Okafor Petrov Jensen Moreau Costa Weber Murphy Kowalski Fischer Nakamura Andersen Bianchi Romero Schmidt Walker Young Hughes Bennett O'Neil McKay Saint-Just".split()
SYLLABLES = "ba bel bro car cor dan del dor el fan fen gar gol hal hav il jar jus kel kor lan lor mar mel mor nal nor ol pel quin ran rel sar sel tal tor ul van vor wes yar zan".split()
HOSTS = "mail post office home web net cloud north river blue green first".split()
ENDS = "com org net edu example test invalid de fr co.uk io corp.example".split()
STREET = "Street St Road Rd Lane Avenue Ave Court Close Terrace Drive Way Place Square Hill Row Walk Boulevard Crescent Gardens".split()
COMPANY = "Systems Holdings Partners Supply Press Media Energy Freight Analytics Logistics Bank Group Ltd".split()


def made(hosts: list[str], names: list[tuple[str, str]], rng: np.random.Generator, many: int = MADE) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """``many`` texts with the (start, end, kind) of the details put into them."""
    pick = lambda x: x[int(rng.integers(len(x)))]
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda: "".join(pick(SYLLABLES) for _ in range(int(rng.integers(2, 4)))).capitalize()
    listed = {r: [n for n, role in names if role == r] or [word()] for r in ("given", "family")}
    given = lambda: pick((pick(GIVEN), pick(listed["given"]), word()))
    family = lambda: pick((pick(FAMILY), pick(listed["family"]), word(), f"{word()}-{word()}"))
    gap = lambda: pick((" ", "-", ".", " ", "/", ""))

    def person() -> tuple[str, str, str]:
        g, f = given(), family()
        return "", pick((f"{g} {f}", f"{g} {f}", f"{g} {g[0]}. {f}", f"{g[0]}. {f}", f"{f}, {g}", f"{f}, {g} {pick('ABCDEF')}.", f"{f} {g}", f"{g}\n{f}")), ""

    def email() -> tuple[str, str, str]:
        user = pick((f"{given()}.{family()}", f"{given()}{d(2)}", f"{family()}_{given()}", f"{given()[0]}{family()}", f"{family()}-{pick('abc')}", f"{given()}.{family()}+{pick(HOSTS)}")).lower().replace(" ", "")
        at = pick(("@", "@", "@", "@", "(at)", " at ", "[at]"))
        host = f"{pick((pick(HOSTS), word().lower()))}{pick(('', '', '-' + pick(HOSTS)))}"
        return "", f"{user}{at}{host}{' dot ' if at == ' at ' else '.'}{pick(ENDS)}", ""

    def phone() -> tuple[str, str, str]:
        s = gap()
        number = pick((f"+1{s or ' '}{d(3)}{s}{d(3)}{s}{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"+44 {d(2)} {d(4)} {d(4)}", f"+49 {d(3)} {d(6)}", f"0{d(3)} {d(3)} {d(4)}", f"0{d(4)} {d(6)}", f"555{s or '-'}{d(4)}", f"+{d(2)} ({d(1)}) {d(2)} {d(3)} {d(2)} {d(2)}"))
        return pick(("", "", "call ", "tel ", "T ", "Phone: ", "ring me on ", "mobile ")), number, pick(("", "", " x" + d(3)))

    def identity() -> tuple[str, str, str]:
        cue = pick(("SSN ", "SSN: ", "social security number ", "social security no. ", "soc. sec. "))
        ni = "".join(pick("ABCEGHJKLMNPRSTWXYZ") for _ in range(2))
        return pick(((cue, f"{d(3)}-{d(2)}-{d(4)}"), (cue, f"{d(3)} {d(2)} {d(4)}"), ("passport ", f"{pick('ABCXQ')}{d(8)}"), ("passport no. ", d(9)), ("passport number ", f"{ni}{d(6)}"), ("NI number ", f"{ni} {d(2)} {d(2)} {d(2)} {pick('ABCD')}"), ("national insurance number ", f"{ni}{d(6)}{pick('ABCD')}"), ("ID card ", d(9)), ("identity card no. ", f"{d(4)}{pick(' -')}{d(5)}"))) + ("",)

    def address() -> tuple[str, str, str]:
        n, town = str(rng.integers(1, 2000)), word()
        place = pick((f"{n} {word()} {pick(STREET)}", f"{n} {word()} {word()} {pick(STREET)}", f"Flat {rng.integers(1, 40)}, {n} {word()} {pick(STREET)}", f"{n} {word()} {pick(STREET)}, Apt {rng.integers(1, 40)}", f"P.O. Box {d(3)}", f"PO Box {d(4)}", f"{word()}straße {n}", f"{word()}str. {n}", f"{n} rue de {word()}", f"Calle {word()} {n}", f"Rua {word()}, {n}"))
        return "", place + pick(("", "", f", {town}")), ""

    def none() -> tuple[str, str, str]:
        text = pick((f"order {d(7)}", f"invoice {d(3)}-{d(2)}-{d(5)}", f"meter {d(4)} {d(4)}", f"version {d(1)}.{d(2)}.{d(4)}", f"code {d(5)}", f"{given()} said", f"{family()} {pick(COMPANY)}", f"the {word()} Street office", f"{d(2)}:{d(2)}", f"{d(2)}/{d(2)}/{d(4)}", f"ref {pick('ABC')}{d(3)}-{d(2)}", f"{word()} and {word()}", f"{d(2)},{d(3)} items", f"Hi {given()},", f"account {d(8)}", f"build {d(6)}"))
        return text, "", ""

    makers = {"person": person, "email": email, "phone": phone, "identity": identity, "address": address, "": none}
    kinds = list(makers)
    out = []
    for _ in range(many):
        text, spans = "", []
        for part in range(int(rng.integers(1, 4))):
            host = pick(hosts)
            begin = int(rng.integers(0, max(1, len(host) - 60)))
            text += host[begin : begin + int(rng.integers(0, 90))].rsplit(" ", 1)[0] + pick((" ", " ", "\n", "\n\n", ", ", ": ", " (", "- "))
            kind = pick(kinds)
            before, value, after = makers[kind]()
            text += before
            if kind:
                spans.append((len(text), len(text) + len(value + after), kind))
            text += value + after + pick((" ", ". ", "\n", ", ", "\n\n", ") ", "? "))
        host = pick(hosts)
        out.append((text + host[: int(rng.integers(0, 80))], spans))
    return out


def tagged(text: str, spans: list[tuple[int, int, str]]) -> tuple[np.ndarray, np.ndarray]:
    codes, tags = encode(text), np.zeros(len(text), np.int64)
    for a, b, kind in spans:
        k = KINDS.index(kind)
        tags[a] = 2 * k + 1
        tags[a + 1 : b] = 2 * k + 2
    return codes, tags


def labelled(text: str, names: Names) -> tuple[np.ndarray, np.ndarray]:
    return tagged(text, found(text, names))


def altered(codes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The codes in lower or upper case, one time in six each."""
    r = rng.random()
    low, high = (codes >= 97) & (codes <= 122), (codes >= 65) & (codes <= 90)
    if r < 0.17:
        return np.where(high, codes + 32, codes).astype(np.uint8)
    if r < 0.34:
        return np.where(low, codes - 32, codes).astype(np.uint8)
    return codes


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def lstm(codes: np.ndarray, given: np.ndarray, again: np.ndarray, order: range) -> dict:
    steps, rows = codes.shape
    h = again.shape[0]
    state, cell = np.zeros((rows, h), np.float32), np.zeros((rows, h), np.float32)
    kept = {"order": order, "states": np.zeros((steps, rows, h), np.float32), "before": np.zeros((steps, rows, h), np.float32), "cells": np.zeros((steps, rows, h), np.float32), "past": np.zeros((steps, rows, h), np.float32), "gates": np.zeros((steps, rows, 4 * h), np.float32)}
    for t in order:
        z = given[codes[t]] + state @ again
        z[:, : 3 * h] = sigmoid(z[:, : 3 * h])
        z[:, 3 * h :] = np.tanh(z[:, 3 * h :])
        kept["before"][t], kept["past"][t], kept["gates"][t] = state, cell, z
        cell = z[:, h : 2 * h] * cell + z[:, :h] * z[:, 3 * h :]
        state = z[:, 2 * h : 3 * h] * np.tanh(cell)
        kept["cells"][t], kept["states"][t] = cell, state
    return kept


def lstm_back(kept: dict, codes: np.ndarray, again: np.ndarray, d_states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    steps, rows, h = kept["states"].shape
    d_again, d_z = np.zeros_like(again), np.zeros((steps, rows, 4 * h), np.float32)
    d_state, d_cell = np.zeros((rows, h), np.float32), np.zeros((rows, h), np.float32)
    for t in reversed(kept["order"]):
        z, cell = kept["gates"][t], np.tanh(kept["cells"][t])
        i, f, o, g = z[:, :h], z[:, h : 2 * h], z[:, 2 * h : 3 * h], z[:, 3 * h :]
        ds = d_states[t] + d_state
        dc = d_cell + ds * o * (1 - cell * cell)
        d = d_z[t]
        d[:, :h] = dc * g * i * (1 - i)
        d[:, h : 2 * h] = dc * kept["past"][t] * f * (1 - f)
        d[:, 2 * h : 3 * h] = ds * cell * o * (1 - o)
        d[:, 3 * h :] = dc * i * (1 - g * g)
        d_cell = dc * f
        d_state = d @ again.T
        d_again += kept["before"][t].T @ d
    d_given = np.zeros((128, 4 * h), np.float32)
    flat, d_flat = codes.reshape(-1), d_z.reshape(-1, 4 * h)
    order = np.argsort(flat, kind="stable")
    values, starts = np.unique(flat[order], return_index=True)
    d_given[values] = np.add.reduceat(d_flat[order], starts, axis=0)
    return d_given, d_again


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def crf(score: np.ndarray, tags: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood a character, and gradients for scores, transitions, starts."""
    steps, rows, k = score.shape
    ahead, behind = np.zeros_like(score), np.zeros_like(score)
    ahead[0] = score[0] + start
    for t in range(1, steps):
        ahead[t] = log_sum(ahead[t - 1][:, :, None] + trans[None], 1) + score[t]
    for t in range(steps - 2, -1, -1):
        behind[t] = log_sum(trans[None] + (score[t + 1] + behind[t + 1])[:, None, :], 2)
    whole = log_sum(ahead[-1], 1)
    at = np.arange(rows)
    gold = start[tags[0]] + sum(score[t, at, tags[t]] for t in range(steps)) + sum(trans[tags[t - 1], tags[t]] for t in range(1, steps))
    d_score = np.exp(ahead + behind - whole[None, :, None])
    d_start = d_score[0].sum(0)
    d_trans = np.zeros_like(trans)
    for t in range(1, steps):
        pair = ahead[t - 1][:, :, None] + trans[None] + (score[t] + behind[t])[:, None, :] - whole[:, None, None]
        d_trans += np.exp(pair).sum(0)
        np.add.at(d_trans, (tags[t - 1], tags[t]), -1.0)
        d_score[t, at, tags[t]] -= 1
    d_score[0, at, tags[0]] -= 1
    np.add.at(d_start, tags[0], -1.0)
    n = steps * rows
    return float((whole - gold).sum() / n), d_score / n, d_trans / n, d_start / n


def train(texts: list[str], listed: list[tuple[str, str]], seconds: float, first: dict[str, np.ndarray] | None = None, width: int = 80, rows: int = 128, seed: int = 7, rate: float = 0.006) -> dict[str, np.ndarray]:
    rng, names = np.random.default_rng(seed), Names(listed)
    every = [(t, found(t, names)) for t in texts]
    bare = [piece for t, spans in every for a, b in zip([0, *(s[1] for s in spans)], [*(s[0] for s in spans), len(t)]) if len(piece := t[a:b].strip()) > 60]
    data = [tagged(t, s) for t, s in every + made(bare, [(n, r) for n, r in listed if n and r], rng)]
    data = [d for d in data if len(d[0]) > width // 4]
    data = [(np.concatenate([c, np.full(width, 10, np.uint8)]), np.concatenate([t, np.zeros(width, np.int64)])) for c, t in data]
    ends = np.cumsum([len(c) for c, _ in data])
    codes_all, tags_all = np.concatenate([c for c, _ in data]), np.concatenate([t for _, t in data])
    hits = np.flatnonzero(tags_all % 2 == 1)
    kinds = (tags_all[hits] + 1) // 2
    share = 1.0 / np.bincount(kinds, minlength=len(KINDS) + 1)[kinds]
    share /= share.sum()
    h = HIDDEN
    w = {k: rng.normal(0, 0.3 if k.startswith("in") else h**-0.5, s).astype(np.float32) for k, s in (("in_f", (128, 4 * h)), ("in_b", (128, 4 * h)), ("re_f", (h, 4 * h)), ("re_b", (h, 4 * h)))}
    for k in ("in_f", "in_b"):
        w[k][:, h : 2 * h] += 1.0
    w |= {"out": rng.normal(0, 0.2, (2 * h, TAGS)).astype(np.float32), "bias": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32), "start": np.zeros(TAGS, np.float32)}
    if first is not None:
        w = {k: x.astype(np.float32) for k, x in first.items()}
    m, v = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}
    began, step, shown, mean = time.time(), 0, 0.0, None
    while (spent := time.time() - began) < seconds:
        half = rows // 2
        near = rng.choice(hits, half, p=share) - rng.integers(0, width, half)
        any_ = rng.integers(0, len(codes_all) - width, rows - half)
        starts = np.clip(np.concatenate([near, any_]), 0, len(codes_all) - width - 1)
        codes = np.stack([altered(codes_all[s : s + width], rng) for s in starts], 1)
        tags = np.stack([tags_all[s : s + width] for s in starts], 1)
        f, b = lstm(codes, w["in_f"], w["re_f"], range(width)), lstm(codes, w["in_b"], w["re_b"], range(width - 1, -1, -1))
        hidden = np.concatenate([f["states"], b["states"]], 2)
        keep = (rng.random(hidden.shape) < 0.9).astype(np.float32) / 0.9
        dropped = hidden * keep
        loss, d_score, d_trans, d_start = crf(dropped @ w["out"] + w["bias"], tags, w["trans"], w["start"])
        d_score = d_score.astype(np.float32)
        d_hidden = (d_score @ w["out"].T) * keep
        g = {"out": dropped.reshape(-1, 2 * h).T @ d_score.reshape(-1, TAGS), "bias": d_score.sum((0, 1)), "trans": d_trans, "start": d_start}
        g["in_f"], g["re_f"] = lstm_back(f, codes, w["re_f"], d_hidden[:, :, :h])
        g["in_b"], g["re_b"] = lstm_back(b, codes, w["re_b"], d_hidden[:, :, h:])
        norm = float(np.sqrt(sum((x.astype(np.float64) ** 2).sum() for x in g.values())))
        step += 1
        lr = rate * min(1.0, step / 50) * max(0.03, 1 - spent / seconds)
        for k in w:
            x = g[k] * min(1.0, 0.5 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * x
            v[k] = 0.995 * v[k] + 0.005 * x * x
            w[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.995**step)) + 1e-8)).astype(np.float32)
        mean = loss if mean is None else 0.98 * mean + 0.02 * loss
        if spent - shown > 15:
            shown = spent
            print(f"{spent:.0f} s, step {step}, loss {mean:.4f}", flush=True)
    return w


def recall(texts: list[str], names: Names, model: Tagger) -> dict[str, tuple[float, int]]:
    """Share of labelled spans that the network's spans of the kind meet."""
    total, met = dict.fromkeys(KINDS, 0), dict.fromkeys(KINDS, 0)
    for text, spans in zip(texts, detect(texts, model)):
        for a, b, kind in found(text, names):
            total[kind] += 1
            met[kind] += any(x < b and a < y for x, y, _ in spans)
    return {k: (met[k] / max(total[k], 1), total[k]) for k in KINDS}


def main(folder: str, seconds: float, out: str = WEIGHTS) -> None:
    import os

    import pyarrow.parquet as pq

    table = pq.read_table(f"{folder}/person_names.parquet")
    listed = list(zip(table["name"].to_pylist(), table["role"].to_pylist()))
    mails = [t for t in pq.read_table(f"{folder}/enron.parquet")["text"].to_pylist() if t]
    messages = [t for t in pq.read_table(f"{folder}/sms.parquet")["text"].to_pylist() if t]
    first = dict(np.load(out)) if os.path.exists(out) else None
    weights = train(mails[:MAILS] + messages[:MESSAGES], listed, seconds, first)
    weights = {k: x.astype(np.float16) for k, x in weights.items()}
    np.savez_compressed(out, **weights)
    held = mails[MAILS : MAILS + 600] + messages[MESSAGES : MESSAGES + 600]
    print(f"window {WINDOW}; held-out recall:", recall(held, Names(listed), Tagger(weights)))


if __name__ == "__main__":
    main(sys.argv[1], float(sys.argv[2]) if len(sys.argv) > 2 else 600.0)

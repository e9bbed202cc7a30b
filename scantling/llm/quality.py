"""Problem 10: text statistics of each document, and what sort of text it is.

Every line is a row of values, an entry, remains of a machine, or running text. Rows show by delimiters that
stand in the same number, or in the same column, on neighbouring lines; entries by markers or leaders that
return with a period; running text by common words and by lines of nearly equal length that only a
paragraph's end cuts short. The sort of a document is that of most of its characters.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Frequent function words of the five languages.
COMMON = frozenset(
    """a about after all also an and are as at be been before both but by can could did for from had has have he her his i if in is
    it its let lets me more most my neither no nobody not of on one only or our out rather she so such than that the their them then there
    they this those to too u ur up us was we were what when where which while who will with would yet you your n pls r w
    al antes casi como con cuando de del desde el ella en es está esta este hay la las lo los más me mi muy nada no nos o para pero podemos por porque que qué se
    sin sobre su todavía un una uno y ya
    au aux avant avec ce ces cet cette dans de des du elle en encore est et eux il ils je la le les leur mais même n'est ne nous on ou par pas peu plus pour pourquoi
    qu que qui sa se ses son sont sur très un une vous y à été a
    aber als an auch auf aus bei bis das dass dem den der des die doch ein eine einem einen einer er erst es fertig für gibt hat ich im in ist kein keine können man mit nach
    nicht noch nur oder sich sie sind so um und uns von vor war warum was wenn wie wir wird zu zum zur über
    ainda ao aos as com como da das de do dos ela ele em entre eu há isso já mais mas muito na nas nem no nos não o os ou para pela pelo podemos por porque quase que se sem seu sua são também um
    uma você é está""".split()
)

WORD = re.compile(r"[^\W_]+")
RULE = re.compile(r"[\s\-+=|_:.*~#]+$")
ENTRY = re.compile(r"(?:\s+o|\s*(?:[-*+•·–‣◦]|\(?[0-9]{1,3}[.)]|\(?[a-zA-Z][.)]|\[[ xX]?\]|[0-9]{1,3}\s*[-–:]))\s+\S")
LINK = re.compile(r"\s*(?:https?|ftp)://\S+\s*$")
PAIRS = re.compile(r"\s*(?:[\w.-]+[=:][^\s,;]+[\s,;]+)+[\w.-]+[=:][^\s,;]+\s*$")
GAP = re.compile(r"(?<=\S)(?: {2,})(?=\S)")
BARE = re.compile(r"\s*[^\W\d_]{2,}(?: [^\W\d_]+){0,3}\s*[,;.]?\s*$")
TAG = re.compile(r"<[a-zA-Z/!][^<>]*>|&[a-z]+;")
NUMBER = re.compile(r"\d+")
HEX = re.compile(r"\s*(?:[0-9a-fA-F]{2}\s+){5,}[0-9a-fA-F]{2}\s*$")
CODED = re.compile(r"[A-Za-z0-9+/=]{40,}")
CODE = re.compile(r"function\s*\(|\bvar \w+\s*=|[{};]\s*$|^%PDF|^\W*$")
FURNITURE = re.compile(r"\W*(?:click here|loading|page \d+|next|previous|home|login|help|menu|share|print|\[\w+\])(?:\W+(?:home|login|help|menu|next|previous))*\W*$", re.I)  # what pages carry around their text
END = tuple(".!?…:;\"'”’)]")

ROW, LISTED, REMAINS, TEXT, BLANK = range(5)

STATS = "doc_id long, words long, mean_word_length double, symbol_share double, line_end_share double, common_share double, sort string, aligned_share double, indent_period double, length_autocorrelation double"
#: Spans at which lines are compared with the ones before, for lists that return to an indentation every few lines.
LAGS = range(1, 7)


def leader(line: str) -> bool:
    """A line that ends in dots leading to a number, as in a table of contents; linear in the line."""
    bare = line.rstrip()
    head = bare.rstrip("0123456789")
    dots = head.rstrip()
    return len(head) < len(bare) and dots.endswith("....") and bool(dots.rstrip(".").strip())


def shape(line: str) -> str:
    """The line with every number as 0."""
    return NUMBER.sub("0", line)


def _delimited(lines: list[str]) -> list[bool]:
    """Lines whose delimiters agree in number, or whose gaps agree in place, with most others that have any."""
    out = [False] * len(lines)
    for mark, least in (("\t", 1), ("|", 2), (";", 2), (",", 1)):
        counts = [x.count(mark) for x in lines]
        usual = Counter(c for c in counts if c >= least).most_common(1)
        if usual and usual[0][1] >= 3:
            for k, c in enumerate(counts):
                if c == usual[0][0]:
                    cells = lines[k].strip().strip(mark).split(mark)
                    if mark in "\t|" or all(len(cell.split()) <= 3 for cell in cells) and not lines[k].rstrip().endswith((".", "!", "?")):
                        out[k] = True
    gaps = [[m.end() for m in GAP.finditer(x.rstrip())] if "  " in x else [] for x in lines]
    rivers = Counter(p for g in gaps for p in g)
    for k, g in enumerate(gaps):
        if g and not leader(lines[k]) and (len(g) >= 2 or max(rivers[p] for p in g) >= 3) and len(lines[k].split()) <= 4 * (len(g) + 1):
            out[k] = True
    return out


def _entries(lines: list[str]) -> list[bool]:
    """Marked lines, where a marker returns on at least three lines, and runs of at least five bare items of a few words."""
    marked = [bool(ENTRY.match(x) or leader(x) or LINK.match(x)) for x in lines]
    out = marked if sum(marked) >= 3 or sum(marked) == len(marked) else [False] * len(lines)
    bare = [bool(BARE.match(x)) and not FURNITURE.match(x) and not any(w.lower() in COMMON for w in WORD.findall(x)) for x in lines]
    begin = 0
    while begin < len(lines):
        end = begin
        while end < len(lines) and bare[end]:
            end += 1
        if end - begin >= 5 and len(set(lines[begin:end])) > 0.5 * (end - begin):
            out[begin:end] = [True] * (end - begin)
        begin = end + 1
    return out


def autocorrelation(lengths: np.ndarray, lag: int = 1) -> float:
    """Of the lengths of lines; 0 where they don't vary."""
    x = lengths - lengths.mean() if len(lengths) > lag else np.zeros(1)
    power = float((x * x).sum())
    return float((x[lag:] * x[:-lag]).sum()) / power if power else 0.0


def indentation(lines: list[str]) -> np.ndarray:
    """White space before each line that isn't blank, a tab being four."""
    out = []
    for x in lines:
        bare = x.lstrip()
        if bare:
            before = x[: len(x) - len(bare)]
            out.append(len(before) + 3 * before.count("\t"))
    return np.array(out, float)


def period(indents: np.ndarray) -> float:
    """How regularly the indentation returns: the greatest autocorrelation over LAGS, 0 where it doesn't vary or there are fewer than six lines."""
    if len(indents) < 6 or not indents.any():
        return 0.0
    return max((autocorrelation(indents, lag) * len(indents) / (len(indents) - lag) for lag in LAGS if lag <= len(indents) // 3), default=0.0)


def signals(lines: list[str]) -> tuple[float, float, float]:
    """Share of lines whose delimiters or gaps stand in line with others', period of the indentation, autocorrelation of the lengths, of the lines that aren't blank."""
    full = [x for x in lines if x.strip()]
    if len(full) < 2:
        return 0.0, 0.0, 0.0
    lengths = np.array([len(x) for x in full], float)
    return sum(_delimited(full)) / len(full), period(indentation(full)), autocorrelation(lengths)


def _indented(lines: list[str], sorts: list[int]) -> bool:
    """Whether running text is in truth a list shown by indentation alone: short lines, without the punctuation of prose, at indentations that return."""
    text = [x for x, s in zip(lines, sorts) if s == TEXT]
    if len(text) < 6 or sum(x.rstrip().endswith(END) for x in text) > 0.2 * len(text) or sum(len(x.split()) for x in text) > 9 * len(text):
        return False
    indents = indentation(text)
    return len(set(indents.tolist())) > 1 and period(indents) > 0.5


def line_sorts(lines: list[str]) -> list[int]:
    """What each line is."""
    rows, entries = _delimited(lines), _entries(lines)
    shapes = Counter(shape(x.strip()) for x in lines)
    out = []
    for k, x in enumerate(lines):
        s = x.strip()
        if not s:
            out.append(BLANK)
            continue
        found = WORD.findall(s)
        letters = sum(map(len, found))
        common = sum(map(COMMON.__contains__, map(str.lower, found)))
        dense = len(s) - s.count(" ")
        if common > 0.3 * len(found) and len(found) >= 5 and letters > 0.6 * dense and not entries[k] and "<" not in s:
            out.append(TEXT)  # the usual case, whatever its delimiters
            continue
        if HEX.match(s) or TAG.search(s) and len(TAG.sub("", s)) < 0.4 * len(s) or CODED.search(s) and len(found) < 12 and not LINK.match(s):
            out.append(REMAINS)
        elif RULE.match(s):
            out.append(ROW if k and rows[k - 1] or k + 1 < len(rows) and rows[k + 1] else BLANK)
        elif entries[k] and (common < 0.34 * len(found) or not s.endswith((".", "!", "?")) and common < 0.45 * len(found)):
            out.append(LISTED)
        elif (rows[k] or PAIRS.match(s)) and common <= 0.25 * len(found) and letters >= 0.35 * dense:
            out.append(ROW if shapes[shape(s)] < 3 or any(c.isdigit() for c in s) else REMAINS)
        elif letters < 0.6 * dense or CODE.search(s) or FURNITURE.match(s) or shapes[shape(s)] >= 3 and len(found) <= 4 and len(lines) >= 4:
            out.append(REMAINS)
        else:
            out.append(TEXT)
    return out


def sort_of(text: str, lower: list[str], common: float, shown: tuple[float, float, float]) -> str:
    """``prose, list, table`` or ``junk``, by the sorts of the lines and the signals of the whole (see :func:`signals`)."""
    if len(text) < 5:
        return "prose"
    lines = text.split("\n")
    sorts = line_sorts(lines)
    weight, number = [0, 0, 0, 0, 0], [0, 0, 0, 0, 0]
    for x, s in zip(lines, sorts):
        weight[s] += len(x.strip())
        number[s] += 1
    whole = sum(weight[:4])
    if not whole:
        return "prose" if lower else "junk"
    for s, kind in ((LISTED, "list"), (ROW, "table")):  # many short lines below a sentence or two
        if number[s] > 0.5 * sum(number[:4]) and weight[s] > 0.3 * whole:
            return kind
    if weight[TEXT] > 0.5 * whole and shown[1] > 0.5 and _indented(lines, sorts):
        return "list"
    if weight[TEXT] > 0.5 * whole:
        senseless = len(lower) >= 8 and common < 0.13 and sum(c > "\u02ff" for w in lower for c in w) <= 0.5 * sum(map(len, lower))  # other scripts have other words
        return "junk" if senseless or _stuck(lower) else "prose"
    kinds = {"table": weight[ROW], "list": weight[LISTED], "junk": weight[REMAINS]}
    best = max(kinds, key=lambda k: kinds[k])
    if best == "junk" and kinds["junk"] < 0.5 * whole and kinds["table"] + kinds["list"] >= kinds["junk"]:
        best = max(("table", "list"), key=lambda k: kinds[k])
    lengths = np.array([len(x) for x, s in zip(lines, sorts) if s != BLANK], float)
    if best == "list" and len(lengths) > 6 and common > 0.3 and shown[2] < 0 and np.median(lengths) > 0.85 * lengths.max():
        return "prose"  # wrapped lines that happen to begin like entries
    return best


def _stuck(lower: list[str]) -> bool:
    """Words or short phrases repeated over and over."""
    if len(lower) < 12 or len(set(lower)) > 0.5 * len(lower) + 6:
        return False
    same = sum(a == b for a, b in zip(lower, lower[1:]))
    for period in (2, 3, 4, 5, 6):
        same = max(same, sum(a == b for a, b in zip(lower, lower[period:])))
    return same > 0.5 * len(lower)


def statistics(text: str | None) -> tuple[int, float | None, float | None, float | None, float | None, str, float, float, float]:
    """Words, mean word length, shares of symbols, of lines ending in punctuation and of common words, sort, the signals of the layout."""
    text = text or ""
    found = WORD.findall(text)
    lines = [x for x in (line.rstrip() for line in text.split("\n")) if x]
    dense = sum(map(len, text.split()))
    letters = sum(map(len, found))
    lower = [w.lower() for w in found]
    common = sum(map(COMMON.__contains__, lower)) / max(len(lower), 1)
    shown = signals(lines)
    return (
        len(found),
        letters / len(found) if found else None,
        (dense - letters) / dense if dense else None,
        sum(x.endswith(END) for x in lines) / len(lines) if lines else None,
        common if found else None,
        sort_of(text, lower, common, shown),
        *shown,
    )


def _each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = list(zip(*map(statistics, batch.column("text").to_pylist()))) or [()] * 9
        types = [pa.int64(), *[pa.float64()] * 4, pa.string(), *[pa.float64()] * 3]
        names = ["words", "mean_word_length", "symbol_share", "line_end_share", "common_share", "sort", "aligned_share", "indent_period", "length_autocorrelation"]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types))], names=["doc_id", *names])


def text_statistics(docs: DataFrame) -> DataFrame:
    """Statistics of each row of ``doc_id, text``, without a shuffle.

    Null and empty texts have no words, null shares, and count as prose, as do texts under five characters; a text of
    any length is read whole. Other columns are ignored.
    """
    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(_each, STATS)

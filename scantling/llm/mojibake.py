"""Problem 7: text that was decoded with the wrong character encoding.

Which swaps of code pages a source suffered is unknown, so each is treated as a substitution cipher: what
stands in the text is a cipher symbol (a character, or the characters that one multi-byte letter became), and
the plain letter depends on the swap. All symbols with their neighbours are counted over the corpus, and so are the letter
bigrams of the language, from the symbols that are single letters; expectation-maximization against the bigrams learns, source by source
and each in a task of its own, which letter each symbol stands for; the learned tables are applied with translate().
"""

from __future__ import annotations

import itertools
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scantling.session import cut

# Code pages by which the bytes of UTF-8 are commonly misread, and single-byte pages, any of which may be misread as any other.
MISREAD_UTF8 = ("cp1252", "latin-1", "cp1250", "cp1251", "cp1253", "cp1254", "cp437", "cp850", "mac_roman", "koi8-r", "iso8859-2", "iso8859-15")
SINGLE = ("cp1252", "cp1250", "cp1251", "cp1253", "cp437", "cp850", "cp866", "koi8-r", "mac_roman")
SWAPS = tuple(itertools.permutations(SINGLE, 2))

# Sentences that hold all letters of a language, and usual signs: from them is learned which classes of characters follow each other. The letters
# themselves are learned from the corpus.
CLASSES = """
Voix ambiguë d’un cœur qui au zéphyr préfère les jattes de kiwis. Dès Noël, où un zéphyr haï me vêt de glaçons würmiens, je dîne d’exquis rôtis de bœuf à l’aÿ d’âge mûr. Là, Île, Été, Ô, Ça, À Évian.
Zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich. Falsches Üben von Xylophonmusik quält jeden größeren Zwerg. Öde Äcker, Ängste, Über. „Gut“, sagte sie.
El pingüino Wenceslao hizo kilómetros bajo exhaustiva lluvia y frío, añoraba a su querido cachorro. ¿Quién? ¡Así! Ávila, Éibar, Ñandú, Úbeda.
Luís argüia à Júlia que «brações, fé, chá, óxido, pôr, zângão» eram palavras do português. À noite, vovô Kowalsky vê o ímã cair no pé do pinguim queixoso. Órfão, Água.
Quizdeltagerne spiste jordbær med fløde, mens cirkusklovnen Walther spillede på xylofon. Flygande bäckasiner söka hwila på mjuka tuvor. Høj bly gom vandt fræk sexquiz på wc. Ørn, Åben, Ær, Öland.
Kæmi ný öxi hér, ykist þjófum nú bæði víl og ádrepa. Pijamalı hasta yağız şoföre çabucak güvendi. İzmir, Şile, Ağrı.
Съешь же ещё этих мягких французских булок, да выпей чаю. В чащах юга жил бы цитрус? Да, но фальшивый экземпляр! Эх, Юра, Яна, Жора, Шура, Цирк, Щит, Ёлка, Он.
Ξεσκεπάζω την ψυχοφθόρα βδελυγμία. Γαζέες και μυρτιές δεν θα βρω πια στο χρυσαφί ξέφωτο. Ήταν, Ώρα, Όχι, Άρα, Έλα, Ύστερα.
Pchnąć w tę łódź jeża lub ośm skrzyń fig. Příliš žluťoučký kůň úpěl ďábelské ódy. Árvíztűrő tükörfúrógép. Łan, Źle, Šok, Čas, Őr.
We didn’t know they’d left, so she’ll ask whether he’s been there; I’m sure you’ve seen it, and weren’t we told it couldn’t, wouldn’t, shouldn’t, doesn’t, hasn’t, aren’t? The dog’s bowl, the cats’ toys. “That’s mine”, he said, “and yours isn’t”. Well… who’d have thought – “nobody”, of course – that it’d end here… “Right”. Let’s go, what’s next.
“Yes”, ‘no’ and “perhaps” – they’re all answers, aren’t they… It’s 5 € or £7; 20 °C and 3 µm, ±2, © 2001, the Thing™, the Other® — see §3, ½ cup, 2½ miles, 90°, 4 × 5, ☺ well, a naïve résumé, façade, café.
""".strip()

SHOW = re.compile(r"[^\x00-\x7f]+")
LOST = "�"


@lru_cache(maxsize=65536)
def kind(c: str) -> str:
    """Class of a character."""
    n = ord(c)
    if n < 128:
        return "s" if c.isspace() else "a" if c.islower() else "A" if c.isupper() else "d" if c.isdigit() else "p"
    if c == "\xa0" or c.isspace():
        return "s"
    if n < 0xA0 or 0xE000 <= n < 0xF900:
        return "t"
    if c.isalpha() and c not in "ªºµƒˆ":
        for low, high, small, great in ((0xC0, 0x250, "l", "L"), (0x370, 0x400, "g", "G"), (0x400, 0x530, "c", "C")):
            if low <= n < high:
                return small if c.islower() else great
        return "o"
    if c in "‘’“”–—…«»¿¡€£§°„":
        return {"–": "-", "—": "-", "€": "$", "£": "$", "¿": "¿", "¡": "¿", "°": "°", "§": "$", "’": "’", "‘": "“", "“": "“", "„": "“", "«": "“", "”": "”", "»": "”", "…": "…"}[c]
    return "y" if c in "©®™±½¼¾×µ·•☺²³¹" else "x"


class Bigrams:
    """Letter bigrams: how the classes of characters follow each other, and within a class the letters as the corpus has them.

    ``counted`` has (letter, next letter, n) of the corpus. A letter that the corpus doesn't show shares what little weight its class has left.
    """

    def __init__(self, counted: Iterable[tuple[str, str, int]] = (), classes: str = CLASSES, loose: float = 2.0):
        text = " ".join(classes.split())
        plain = "".join(c.upper() if c.isascii() else c for c in text)  # as tools do that know ASCII only
        text = f" {text} {text.upper()} {plain} "
        self.kinds = Counter((kind(a), kind(b)) for a, b in zip(text, text[1:]))
        self.first_kinds = Counter(map(kind, text[:-1]))
        self.pairs: Counter = Counter()
        self.within: Counter = Counter()
        letters = set(text)
        self.singles: Counter = Counter(c for c in text if ord(c) > 127)
        for a, b, n in counted:
            self.pairs[a, b] += n
            self.within[a, kind(b)] += n
            self.singles[b] += n
            letters.update((a, b))
        self.of_kind: Counter = Counter()
        for c, n in self.singles.items():
            self.of_kind[kind(c)] += n
        self.size = Counter(map(kind, letters))
        self.loose = loose
        self.known: dict[tuple[str, str], float] = {}

    def __call__(self, a: str, b: str) -> float:
        """log P(b | a)"""
        value = self.known.get((a, b))
        if value is None:
            ka, kb = kind(a), kind(b)
            classes = (self.kinds[ka, kb] + 0.02) / (self.first_kinds[ka] + 1.0)
            single = (self.singles[b] + 0.5) / (self.of_kind[kb] + 0.5 * self.size[kb] + 1.0) if ord(b) > 127 else 1.0 / (self.size[kb] + 1.0)
            letter = (self.pairs[a, b] + self.loose * single) / (self.within[a, kb] + self.loose)
            strange = kb == "o" and not self.singles[b]  # a letter of a script that the corpus doesn't have
            value = self.known[a, b] = float(np.log(max(classes * letter * (1e-6 if strange else 1.0), 1e-15)))
        return value


@lru_cache(maxsize=65536)
def to_byte(c: str, page: str) -> int:
    """The byte that the page shows as this character, -1 for none; bytes that the page leaves open show as controls."""
    try:
        return c.encode(page)[0]
    except UnicodeEncodeError:
        return ord(c) if ord(c) < 256 and page.startswith("cp125") else -1


def _utf8(chars: str, page: str) -> str | None:
    data = [to_byte(c, page) for c in chars]
    if min(data) < 0:
        return None
    try:
        return bytes(data).decode("utf-8")
    except UnicodeDecodeError:
        return None


@lru_cache(maxsize=262144)
def letters_of(symbol: str) -> dict[int, str]:
    """The plain text of a symbol by swap: 0 as it stands, then misread UTF-8 once or twice by each page, then single-byte swaps."""
    out = {0: symbol}
    if len(symbol) > 1:
        for k, page in enumerate(MISREAD_UTF8):
            once = _utf8(symbol, page)
            if once is not None and len(once) == 1:
                out[1 + k] = once
            if once is not None and len(once) > 1 and ord(min(once)) > 127:
                twice = _utf8(once, page)
                if twice is not None and len(twice) == 1:
                    out[1 + len(MISREAD_UTF8) + k] = twice
    else:
        for k, (true, wrong) in enumerate(SWAPS):
            byte = to_byte(symbol, wrong)
            if byte >= 128:
                try:
                    plain = bytes([byte]).decode(true)
                except UnicodeDecodeError:
                    continue
                if plain != symbol:
                    out[1 + 2 * len(MISREAD_UTF8) + k] = plain
    return out


#: By how much a swap must beat the symbol as it stands, in all of a record: single characters are weak evidence.
LEAST_GAIN, LEAST_GAIN_SINGLE = 0.0, 3.0

HYPOTHESES = 1 + 2 * len(MISREAD_UTF8) + len(SWAPS)


@lru_cache(maxsize=262144)
def symbols(run: str) -> tuple[str, ...]:
    """A run of characters beyond ASCII as symbols: longest sequences that are one misread letter, else single characters."""
    out, i = [], 0
    while i < len(run):
        for n in (9, 8, 7, 6, 5, 4, 3, 2):
            if i + n <= len(run) and len(letters_of(run[i : i + n])) > 1:
                break
        else:
            n = 1
        out.append(run[i : i + n])
        i += n
    return tuple(out)


def contexts(text: str) -> list[tuple[int, int, str, str, str]]:
    """(start, end, symbol before, symbol, symbol after) of every symbol; plain characters are their own symbols."""
    out = []
    for m in SHOW.finditer(text):
        parts = symbols(m.group())
        at = m.start()
        for k, s in enumerate(parts):
            before = parts[k - 1] if k else text[at - 1 : at] or " "
            after = parts[k + 1] if k + 1 < len(parts) else text[at + len(s) : at + len(s) + 1] or " "
            if s not in "\xa0":
                out.append((at, at + len(s), before, s, after))
            at += len(s)
    return out


def score(bigrams: Bigrams, before: str, symbol: str, after: str) -> np.ndarray:
    """Log-likelihood of the symbol between its neighbours under each swap, -inf where the swap has no such symbol."""
    out = np.full(HYPOTHESES, -np.inf)
    whole = letters_of(symbol)
    left, right = letters_of(before), letters_of(after)
    for h, plain in whole.items():
        a, b = left.get(h, before), right.get(h, after)
        chain = a[-1] + plain + b[0]
        out[h] = sum(bigrams(x, y) for x, y in zip(chain, chain[1:])) if LOST not in plain else -30.0
        if len(plain) > 1:
            out[h] -= 2.0 * (len(plain) - 1)
    return out


def swaps_of(symbol: str) -> list[int]:
    """The swaps under which a symbol stands for something."""
    return sorted(letters_of(symbol))


def learn(bigrams: Bigrams, counted: list[tuple[str, str, str, int]], rounds: int = 12) -> dict[str, dict[int, float]]:
    """Expectation-maximization over the counted contexts (before, symbol, after, n) of a source: for each symbol the log of its chances of the swaps.

    The chances of a symbol are drawn to those of the source as a whole.
    """
    if not counted:
        return {}
    like = np.array([score(bigrams, b, s, a) for b, s, a, _ in counted])
    n = np.array([x[3] for x in counted], float)
    symbols_here = sorted({x[1] for x in counted})
    number = {s: k for k, s in enumerate(symbols_here)}
    symbol = np.array([number[x[1]] for x in counted])
    prior = np.full(HYPOTHESES, 0.1 / (HYPOTHESES - 1))
    prior[0] = 0.9
    chances = np.tile(prior, (len(number), 1))
    for _ in range(rounds):
        odds = like + np.log(chances[symbol])
        post = np.exp(odds - odds.max(axis=1, keepdims=True))
        post *= (n / post.sum(axis=1))[:, None]
        prior = (post.sum(axis=0) + 1.0) / (post.sum() + HYPOTHESES)
        sums = np.zeros_like(chances)
        np.add.at(sums, symbol, post)
        chances = sums + 4.0 * prior
        chances /= chances.sum(axis=1, keepdims=True)
    logs = np.log(chances)
    return {s: {h: float(logs[k, h]) for h in swaps_of(s)} for s, k in number.items()}


class Decoder:
    """Decides symbols in their contexts by the bigrams and the learned chances of (source, symbol)."""

    def __init__(self, bigrams: Bigrams, chances: dict[tuple[str, str], dict[int, float]]):
        self.bigrams, self.chances = bigrams, chances
        self.known: dict[tuple[str, str, str, str], tuple[str, float]] = {}

    def __call__(self, source: str, before: str, symbol: str, after: str) -> tuple[str, float]:
        """The best plain text of a symbol other than itself, and by how much it beats it."""
        key = (source, before, symbol, after)
        found = self.known.get(key)
        if found is None:
            letters = letters_of(symbol)
            if len(letters) == 1:
                found = ("", 5.0) if kind(symbol) == "t" or symbol == LOST else ("", -5.0)
            else:
                odds = score(self.bigrams, before, symbol, after)
                for h, chance in self.chances[source, symbol].items():
                    odds[h] += chance
                best = int(np.argmax(odds[1:])) + 1
                found = (letters[best], float(odds[best] - odds[0]))
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[key] = found
        return found


def restore(text: str, source: str, decide: Decoder) -> tuple[bool, str]:
    """Whether the text holds a wrongly decoded passage, and the text with all restored that can be."""
    found = contexts(text)
    if not found:
        return False, text
    gain, plain = defaultdict(float), {}
    wrong = False
    for _, _, before, s, after in found:
        letter, by = decide(source, before, s, after)
        gain[s] += by
        plain.setdefault(s, Counter())[letter] += 1
        wrong |= by > 0 and not letter
    swapped = {s: plain[s].most_common(1)[0][0] for s, by in gain.items() if by > (LEAST_GAIN_SINGLE if len(s) == 1 else LEAST_GAIN)}
    wrong |= bool(swapped)
    table = {s: p for s, p in swapped.items() if p}
    if table:
        codes = {s: chr(0xF0000 + k) for k, s in enumerate(table)}  # one code a symbol, so that translate() does the rest
        out, at = [], 0
        for begin, end, _, s, _ in found:
            if s in codes:
                out += [text[at:begin], codes[s]]
                at = end
        text = "".join([*out, text[at:]]).translate({ord(codes[s]): p for s, p in table.items()})
    return wrong, text


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: Counter = Counter()
        for source, text in zip(batch.column("source").to_pylist(), batch.column("text").to_pylist()):
            seen.update((source, b, s, a) for _, _, b, s, a in contexts(text))
        columns = list(zip(*seen)) or [()] * 4
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns), pa.array(list(seen.values()), pa.int64())], names=["source", "before", "symbol", "after", "n"])


def _learn(bigrams: list[tuple[str, str, int]]) -> Callable[[pa.Table], pa.Table]:
    shape = pa.schema([("source", pa.string()), ("symbol", pa.string()), ("swap", pa.int32()), ("chance", pa.float64())])

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("before", "ascending"), ("symbol", "ascending"), ("after", "ascending")])
        counted = [(b, s, a, n) for b, s, a, n in zip(*(rows[c].to_pylist() for c in ("before", "symbol", "after", "n"))) if len(letters_of(s)) > 1]
        learned = learn(Bigrams(bigrams), counted)
        source = rows["source"][0].as_py()
        return pa.Table.from_pylist([{"source": source, "symbol": s, "swap": h, "chance": c} for s, every in learned.items() for h, c in every.items()], schema=shape)

    return run


def _apply(bigrams: list[tuple[str, str, int]], chances: dict) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decide = Decoder(Bigrams(bigrams), chances)
        for batch in batches:
            done = [restore(t, s, decide) for s, t in zip(batch.column("source").to_pylist(), batch.column("text").to_pylist())]
            keep = pa.array([d[0] for d in done], pa.bool_())
            out = batch.select(["dataset", "sample_id"]).append_column("restored", pa.array([d[1] for d in done], pa.string()))
            yield out.filter(keep)

    return run


def language(counted: DataFrame) -> list[tuple[str, str, int]]:
    """Bigrams of the corpus that hold a letter or sign beyond ASCII: (letter, next letter, n). What came of a letter of several bytes is no letter and left out.

    At most the square of the alphabets of the scripts with case, some hundred thousand pairs at the utmost, whatever the number of texts.
    """
    one = counted.where((F.length("symbol") == 1) & F.col("symbol").rlike(r"[\p{IsLatin}\p{IsGreek}\p{IsCyrillic}\p{IsCommon}]"))
    ahead = one.where(F.length("before") == 1).select(F.col("before").alias("a"), F.col("symbol").alias("b"), "n")
    behind = one.where(F.col("after").rlike(r"^[\x00-\x7f]$")).select(F.col("symbol").alias("a"), F.col("after").alias("b"), "n")
    rows = ahead.unionByName(behind).groupBy("a", "b").agg(F.sum("n").alias("n")).orderBy("a", "b")
    return [(r["a"], r["b"], r["n"]) for r in rows.collect()]


def garbled(texts: DataFrame) -> DataFrame:
    """``dataset, sample_id, restored`` of the records of ``dataset, sample_id, source, text`` that hold a wrongly decoded passage.

    ``restored`` has every symbol put right whose letter is known; replacement characters stay. Null and empty
    texts are sound, a null source is a source of its own. Contexts are counted over all texts and stay distributed; a task learns a
    source from its distinct contexts. The driver gets the bigrams, see :func:`language`, and what was learned: the chances of the few swaps of
    each symbol of a source, some kilobytes a source.
    """
    shown = texts.where(F.col("text").rlike(r"[^\x00-\x7f]")).select("dataset", F.col("sample_id").cast("long").alias("sample_id"), F.concat_ws("|", "dataset", F.coalesce("source", F.lit(""))).alias("source"), "text")
    counted = cut(shown.mapInArrow(_count, "source string, before string, symbol string, after string, n long").groupBy("source", "before", "symbol", "after").agg(F.sum("n").alias("n")))
    bigrams = language(counted)
    learned = counted.groupBy("source").applyInArrow(_learn(bigrams), "source string, symbol string, swap int, chance double")
    chances: dict[tuple[str, str], dict[int, float]] = {}
    for r in learned.collect():
        chances.setdefault((r["source"], r["symbol"]), {})[r["swap"]] = r["chance"]
    return shown.mapInArrow(_apply(bigrams, chances), "dataset string, sample_id long, restored string")

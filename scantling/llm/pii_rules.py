"""Exact forms of personal details: they label the training sample, and nothing else."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable


# Words by which forms are told apart.
STREETS = "street|st|road|rd|lane|ln|avenue|ave|court|ct|close|terrace|crescent|boulevard|blvd|drive|dr|way|place|square|grove|hill|gardens|row|walk|parade|mews|quay"
COMPANIES = "holdings|partners|systems|analytics|supply|freight|press|media|energy|logistics|industries|group|ltd|inc|gmbh|bank"
NO_PHONE = r"(?:meter|read|invoice|order|no|nr|number|ref|reference|build|version|claim|slot|item|parcel|tracking|account)"

W = r"(?:[ \t\xa0]{1,3}|[ \t\xa0]*\r?\n[>|\t \xa0]*)"  # white space inside a detail, also where a line was broken
G = r"(?:[ \t\xa0]{1,2}|[ \t\xa0]*\r?\n[>|\t \xa0]*)?"
S = r"(?:[ \t\xa0./-]|[ \t\xa0]*\r?\n[>|\t \xa0]*)"

EMAIL = re.compile(
    rf"(?<![\w@.+-])[\w+-][\w.+'-]*(?:@|{W}?[\[(]at[\])]{W}?|{W}at{W}(?=[\w-]+(?:\.[\w-]+)*{W}dot{W}))(?:[\w-]+(?:\.|{W}?[\[(]dot[\])]{W}?|{W}dot{W})){{1,4}}[a-z]{{2,12}}(?![\w@])", re.I
)
PHONE = re.compile(
    rf"(?<![\w.,/+-])(?:\+{G}\d{{1,3}}(?:{S}?\(?\d{{1,5}}\)?){{2,6}}|\(\d{{3}}\){G}\d{{3}}{S}\d{{4}}|1{S}\d{{3}}{S}\d{{3}}{S}\d{{4}}|\d{{3}}{S}\d{{3}}{S}\d{{4}}|0\d{{4}}{S}?\d{{3}}{S}?\d{{3}}|0\d{{2,3}}{S}\d{{3,4}}{S}?\d{{4}}|555{S}\d{{4}}|[2-9]\d{{9}})(?:{W}?(?:x|ext\.?){W}?\d{{1,5}})?(?![\w]|-\d|\.\d)",
    re.I,
)
IDENTITY = re.compile(
    rf"(?:(?:passport(?:{W}(?:no|number|nr)\.?)?|ni{W}(?:no\.?|number)|national{W}insurance(?:{W}(?:no\.?|number))?|national{W}id(?:{W}(?:no\.?|number))?|id{W}card(?:{W}(?:no\.?|number))?|ssn|social{W}security(?:{W}(?:no\.?|number))?|soc\.?{W}sec\.?)(?:{W}is)?[:#]?{W}\(?(?P<a>[a-z]{{2}}{G}\d\d{G}\d\d{G}\d\d{G}[a-d]|[a-z]{{0,2}}\d(?:{S}?\d)*[a-z]?))(?![\w])"
    rf"|(?<![\w.,/-])(?P<b>\d{{3}}{S}?\d{{2}}{S}?\d{{4}})(?={W}\(?soc\.?{W}sec)"
    rf"|(?<![\w.,/-])(?P<c>qq{G}\d\d{G}\d\d{G}\d\d{G}[a-d])(?!\w)"
    rf"|(?<![\w.,/-])(?P<d>\d{{3}}[ -]\d{{2}}[ -]\d{{4}})(?![\w-])",
    re.I,
)
NAME = r"[^\W\d_][\w'’-]*"
ADDRESS = re.compile(
    rf"(?<![\w.,/-])(?:"
    rf"(?:(?:flat|apt\.?|apartment|suite|unit){W}\d+[a-z]?,?{W})?\d{{1,5}}[a-z]?,?{W}(?:(?:n|s|e|w|north|south|east|west)\.?{W})?(?:{NAME}{W}){{1,2}}(?:{STREETS})\b"
    rf"|p\.?{G}o\.?{W}box{W}\d+"
    rf"|\d{{1,5}}(?:{G}(?:bis|ter))?,?{W}(?:rue|avenue|place|boulevard|chemin|impasse|quai){W}(?:(?:de|du|des|la|le){W}|l['’]|d['’]){{0,2}}{NAME}"
    rf"|{NAME}(?:stra(?:ß|ss)e|str\.|weg|gasse|platz|allee){W}\d+[a-z]?"
    rf"|(?:calle|avenida|plaza|paseo|rua|travessa){W}(?:(?:de|del|la|las|los|da|do|das|dos){W}){{0,2}}{NAME},?{W}\d+"
    rf")\.?(?:,?{W}(?:apt|flat|suite|unit|apartment)\.?{W}\d+[a-z]?)?(?:,{W}(?:\d{{4,5}}{W})?(?-i:[A-Z])[\w-]+)?",
    re.I,
)


def branches(names: Iterable[str]) -> str:
    """A pattern of all the names that shares their beginnings, so that few branches are tried at a place; longer names first."""
    by_first: dict[str, set[str]] = {}
    for n in names:
        by_first.setdefault(n[:1], set()).add(n[1:])
    parts = []
    for first, rest in sorted(by_first.items(), reverse=True):
        if not first:
            parts.append("")
            continue
        inner = branches(rest) if rest != {""} else ""
        parts.append((W if first == " " else re.escape(first)) + (f"(?:{inner})" if "|" in inner else inner))
    return "|".join(parts)


class Names:
    """Given and family names: those listed, and those built of the same stems and endings."""

    def __init__(self, listed: Iterable[tuple[str, str]]):
        listed = [(n, r) for n, r in listed if n and r]
        self.given = self._grown({n.lower() for n, r in listed if r == "given"})
        self.family = self._grown({n.lower() for n, r in listed if r == "family"})
        g, f = (branches(x or {"\0"}) for x in (self.given, self.family))
        first = rf"(?:(?:{g})|[^\W\d_]\.)"
        middle = rf"(?:{W}[^\W\d_]\.)?"
        self.person = re.compile(rf"(?<![\w.@+/-])(?:{first}{middle}{W}(?:{f})|(?:{f}),{W}{first}(?:{W}[^\W\d_]\.)?|(?:{f}){W}(?:{g}))(?![\w@]|[.+-]\w|{W}(?:{COMPANIES}|{STREETS})\b)", re.I)

    def __contains__(self, name: str) -> bool:
        return name in self.given or name in self.family

    @staticmethod
    def _grown(names: set[str], least: int = 4) -> set[str]:
        """Names and all stem + ending combinations of stems and endings that many of them share."""
        stems, ends = Counter(), Counter()
        for n in names:
            for k in range(2, len(n) - 1):
                stems[n[:k]] += 1
                ends[n[k:]] += 1
        pairs = {(n[:k], n[k:]) for n in names for k in range(2, len(n) - 1) if stems[n[:k]] >= least and ends[n[k:]] >= least}
        by_stem = Counter(s for s, _ in pairs)
        by_end = Counter(e for _, e in pairs)
        best_stems = {s for s, n in by_stem.items() if n >= least}
        best_ends = {e for e, n in by_end.items() if n >= least}
        # a stem may take an ending if most stems of that ending's length class do
        return names | {s + e for s in best_stems for e in best_ends if by_end[e] >= 0.5 * max(1, len({t for t in best_stems if len(t) == len(s)})) and by_stem[s] >= 0.4 * len(best_ends)}


def digits(text: str) -> int:
    return sum(c.isdigit() for c in text)


def found(text: str, names: Names) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the details of exact form, none within another."""
    out: list[tuple[int, int, str]] = []
    taken: list[tuple[int, int]] = []

    def take(a: int, b: int, kind: str) -> None:
        if not any(a < y and x < b for x, y in taken):
            taken.append((a, b))
            out.append((a, b, kind))

    for m in EMAIL.finditer(text):
        take(m.start(), m.end(), "email")
    for m in IDENTITY.finditer(text):
        group = next(g for g in "abcd" if m.group(g))
        number = m.group(group)
        if digits(number) >= 6 and not re.search(r"(?i)invoice\W*$", text[max(0, m.start(group) - 10) : m.start(group)]):
            take(m.start(group), m.end(group), "identity")
    for m in ADDRESS.finditer(text):
        take(m.start(), m.end(), "address")
    for m in PHONE.finditer(text):
        beyond = min((x for x, _ in taken if m.start() < x < m.end()), default=0)
        m = PHONE.match(text, m.start(), beyond) if beyond else m
        if not m:
            continue
        before = text[max(0, m.start() - 14) : m.start()]
        if 7 <= digits(m.group()) <= 16 and not re.search(rf"(?i)\b{NO_PHONE}\W*(?:\d[\d ]*)?$", before) or re.search(r"(?i)\b(?:new no|phone|tel|ph|call|ring)\W*(?:is|me on|on|no)?\W*$", before) and digits(m.group()) >= 7:
            take(m.start(), m.end(), "phone")
    for m in names.person.finditer(text):
        take(m.start(), m.end(), "person")
    return sorted(out)

"""Personal data by a semi-Markov conditional random field.

A text's segmentations are paths over its tokens: a step is one token outside any entity, or a whole
candidate span of bounded length with a kind. A candidate's score is the sum of the weights of features
of the whole span: its shape, digits, checksums, separators, neighbours and the words before it. Dynamic
programming over the candidates' ends picks boundaries and kinds together; forward and backward sums
give every candidate's probability. Steps outside cost nothing, so only the stretches of a text in which
candidates can lie are tokenised.

The field is fitted by stochastic gradient descent on the likelihood of whole segmentations: on windows
around spans that the base patterns find in a bounded sample of documents, on the same windows with the
spans written in other ways, and on look-alikes that are nobody's data.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorspark.llm.common import small_batches

KINDS = ("email", "ip", "card", "phone")
#: Tokens of an entity, at most.
LONGEST = 32
#: Feature weights: a span's features are hashed to so many.
WEIGHTS = 1 << 15
#: A span that the base patterns do not hold is added if its probability is so high.
SURE = 0.9

# Base patterns


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


# The patterns are the contract's; possessive runs and the look-behind only spare retries that must fail.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` by kind, then start: the leftmost matches of each kind that do not overlap
    in it, without those that fail their check."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL_CHARS:
            begin -= 1
        found = _DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            free = found.end()
            out.append((0, begin, free))
        at = text.find("@", max(at + 1, free))
    for m in _IP.finditer(text):
        if all(_octet(p) for p in m.group().split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        # A run may be very long: its digits are looked at only where their number can fit.
        if 16 <= m.end() - m.start() <= 37 and 16 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m.group())) <= 15:
            out.append((3, m.start(), m.end()))
    return out


# Candidates

_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s+|.", re.DOTALL)
_NUMERIC = re.compile(r"[+(]*[0-9][^A-Za-z\n]{5,}[0-9]")
_AT_WORD = re.compile(r"\bat\b", re.IGNORECASE)
_DOT_WORD = re.compile(r"\bdot\b|[\[({]\s?\.\s?[\])}]", re.IGNORECASE)
#: What may stand inside a number that is written in groups.
_JOINS = frozenset("    .,()-/[]{}‐‑‒–—:_·•")
#: Code points on both sides of a stretch, at least.
_BEFORE, _AFTER = 64, 64


def stretches(text: str) -> list[tuple[int, int]]:
    """The parts of a text that may hold candidates, with their surroundings, ending at white space
    where there is some nearby."""
    hits = [m.span() for m in _NUMERIC.finditer(text)]
    at = text.find("@")
    while at >= 0:
        hits.append((at, at + 1))
        at = text.find("@", at + 1)
    if _DOT_WORD.search(text):
        dots = [m.start() for m in _DOT_WORD.finditer(text)]
        near = iter(dots)
        dot = next(near, None)
        for m in _AT_WORD.finditer(text):
            while dot is not None and dot < m.end():
                dot = next(near, None)
            if dot is not None and dot - m.end() <= 64:
                hits.append((m.start(), dot + 3))
    out: list[list[int]] = []
    for a, b in sorted(hits):
        a, b = _edge(text, a, -1), _edge(text, b, 1)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _edge(text: str, at: int, step: int) -> int:
    """Away from ``at`` by the margin, and on to white space if it comes within as much again."""
    far = max(0, at - _BEFORE) if step < 0 else min(len(text), at + _AFTER)
    for i in range(far, max(0, far - _BEFORE) if step < 0 else min(len(text), far + _AFTER), step):
        if text[i - 1 if step < 0 else i : i if step < 0 else i + 1].isspace():
            return i
    return far


@dataclass
class Lattice:
    """The candidates of a stretch: begin, end (code points of the stretch), kind, feature numbers."""

    begin: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    kind: list[int] = field(default_factory=list)
    features: list[np.ndarray] = field(default_factory=list)

    def add(self, begin: int, end: int, kind: int, names: Iterable[str]) -> None:
        self.begin.append(begin)
        self.end.append(end)
        self.kind.append(kind)
        self.features.append(np.array([zlib.crc32(f"{KINDS[kind]}|{n}".encode()) % WEIGHTS for n in names]))

    def scores(self, weights: np.ndarray) -> np.ndarray:
        return np.array([weights[f].sum() for f in self.features])


def _shape(text: str) -> str:
    return re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]", "9", re.sub(r"\s", " ", text)))[:48]


def _neighbour(text: str, at: int) -> str:
    if not 0 <= at < len(text):
        return "edge"
    c = text[at]
    return "space" if c.isspace() else "digit" if c.isdigit() else "letter" if c.isalpha() else c


def _surroundings(text: str, words: list[tuple[int, str]], begin: int, end: int) -> list[str]:
    """Neighbouring characters, and the two words before the span."""
    before = [w for e, w in words if begin - 24 <= e <= begin][-2:]
    return ["left " + _neighbour(text, begin - 1), "right " + _neighbour(text, end), *("word " + w for w in before)]


def lattice(text: str) -> Lattice:
    """All candidates of a stretch: spans of up to ``LONGEST`` tokens that begin and end like an entity
    and stand apart from other letters and digits."""
    tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
    words = [(e, text[s:e].lower()) for s, e in tokens if text[s].isalpha()]
    out = Lattice()
    digit = [text[s] in "0123456789" for s, _ in tokens]
    word = [text[s].isalnum() for s, _ in tokens]
    apart_left = [i == 0 or not word[i - 1] for i in range(len(tokens))]
    apart_right = [i + 1 == len(tokens) or not word[i + 1] for i in range(len(tokens))]
    nearby: dict[int, list[tuple[int, str]]] = {}

    def around(begin: int) -> list[tuple[int, str]]:
        if begin not in nearby:
            low = begin - 24
            k = _last_before(words, begin)
            nearby[begin] = [w for w in words[max(0, k - 2) : k] if w[0] >= low]
        return nearby[begin]

    for i, (s, _) in enumerate(tokens):
        if not (digit[i] and apart_left[i] or text[s] in "+("):
            continue
        groups: list[str] = []
        count = 0
        for j in range(i, min(i + LONGEST, len(tokens))):
            a, b = tokens[j]
            if digit[j]:
                groups.append(text[a:b])
                count += b - a
                if count > 19:
                    break
                if apart_right[j] and count >= 4:
                    _numbers(out, text, around(s), s, b, groups, count)
            elif not (set(text[a:b]) <= _JOINS and b - a <= 3) and not (j == i and text[a] == "+"):
                break
    _addresses(out, text, tokens, words, around, apart_left, apart_right)
    return out


def _last_before(words: list[tuple[int, str]], at: int) -> int:
    low, high = 0, len(words)
    while low < high:
        middle = (low + high) // 2
        low, high = (middle + 1, high) if words[middle][0] <= at else (low, middle)
    return low


def _numbers(out: Lattice, text: str, words: list[tuple[int, str]], begin: int, end: int, groups: list[str], count: int) -> None:
    span = text[begin:end]
    joins = re.split(r"[0-9]+", span)
    inner = joins[1:-1]
    shape = _shape(span)
    common = ["bias", "shape " + shape, "form " + re.sub("9+", "9", shape), f"joins {len(set(inner))}", *("join " + j for j in sorted(set(inner)))]
    common += _surroundings(text, words, begin, end)
    lone = text[max(0, begin - 2) : begin].strip()[-1:] in {".", "-", "/", ",", ":"} or re.match(r"[.,:/-][0-9]|\s?[-/]\s?[0-9]", text[end : end + 3])
    if lone:
        common.append("goes on")
    if text[max(0, begin - 3) : begin].rstrip(" (")[-1:].isdigit():
        common.append("digits before")
    if re.match(r"[\s_]{1,2}[(]?[0-9]", text[end : end + 4]):
        common.append("digits after")
    balanced = span.count("(") == span.count(")")
    if span[0] in "+(0123456789" and 7 <= count <= 15 and balanced:
        lead = "+" if span[0] == "+" else "(" if span[0] == "(" else "00" if span.startswith("00") else "0" if span[0] == "0" else "n"
        dates = len(groups) >= 3 and any(len(g) == 4 and g[:2] in ("19", "20") for g in groups[:3]) and "+" not in span
        names = [f"digits {count}", f"lead {lead}", f"groups {len(groups)}", f"lead {lead} groups {','.join(str(len(g)) for g in groups)}", "lead " + lead + " joins " + "|".join(sorted(set(inner)))]
        out.add(begin, end, 3, [*common, *names, *(["date"] if dates else [])])
    if span[0] not in "+(" and 16 <= count <= 19 and len(groups) <= 19:
        ok = "luhn" if luhn("".join(groups)) else "no luhn"
        names = [f"{ok} digits {count}", ok, "sizes " + ",".join(str(len(g)) for g in groups[:8]), f"{ok} first {groups[0][0]}", f"{ok} joins {len(set(inner))}"]
        out.add(begin, end, 2, [*common, *names])
    if span[0] not in "+(" and len(groups) == 4 and all(len(g) <= 3 for g in groups):
        ok = "octets" if all(_octet(g) for g in groups) else "no octets"
        dots = "dots" if all("." in j for j in inner) else "no dots"
        names = [ok, dots, f"{ok} {dots} same {len(set(inner)) == 1}", f"{ok} {dots} {len(set(inner))} {sorted(set(inner))[0]}"]
        out.add(begin, end, 1, [*common, *names])


_AT = re.compile(r"\s?@\s?|\s?[\[({<]\s?(?:at|@)\s?[\])}>]\s?|\s+at\s+", re.IGNORECASE)
_DOT = re.compile(r"\s?\.\s?|\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?|\s+dot\s+", re.IGNORECASE)


#: A dot that is spelt out, right before a place.
_SPELT = re.compile(r"(?:\s+dot\s+|\s?[\[({<]\s?dot\s?[\])}>]\s?)\Z", re.IGNORECASE)


def _addresses(out: Lattice, text: str, tokens: list[tuple[int, int]], words: list, around, apart_left: list[bool], apart_right: list[bool]) -> None:
    start = {s: i for i, (s, _) in enumerate(tokens)}
    stop = {e: i for i, (_, e) in enumerate(tokens)}
    for at in _AT.finditer(text):
        last, first = stop.get(at.start()), start.get(at.end())
        if last is None or first is None or not text[at.start() - 1].isalnum() or not text[at.end()].isalnum():
            continue
        # Domains: labels joined by dots, from two labels on.
        ends, i, joins = [], first, []
        label = re.compile(r"[^\W_]+(?:-+[^\W_]+)*")
        here = label.match(text, at.end())
        while here and len(ends) < 6:
            if joins and stop.get(here.end()) is not None:
                ends.append((here.end(), tuple(joins), here.group()))
            dot = _DOT.match(text, here.end())
            if not dot:
                break
            joins.append(re.sub(r"\s+", " ", dot.group().lower()))
            here = label.match(text, dot.end())
        if not ends:
            continue
        i, k = last, 0
        while i >= 0 and k < 12:
            s, e = tokens[i]
            c = text[s]
            if not (c.isalnum() or c in "._%+-"):
                # A dot may be written out in the local part as well.
                if not (c.isspace() or c in "[](){}<>") or not any(_SPELT.search(text, max(0, x - 12), x) for x in (e, e + 1, tokens[min(i + 2, last)][1])):
                    break
            if (c.isalnum() or c in "._%+-") and apart_left[i] and c.isalnum():
                for end, dots, top in ends:
                    how = re.sub(r"\s+", " ", at.group().lower())
                    tidy = "plain" if how == "@" and set(dots) == {"."} else "spelt" if "at" in how else "spaced"
                    names = [
                        "bias", f"at {how}", f"at {how} dots {'|'.join(sorted(set(dots)))}", tidy, f"{tidy} labels {len(dots) + 1}", f"{tidy} top {min(len(top), 8)} {top.isalpha()}",
                        f"top {top.lower()[:12]}", f"{tidy} local {min(k, 6)}", f"{tidy} local space {any(x.isspace() for x in text[s : at.start()])}",
                        f"{tidy} whole {_neighbour(text, s - 1)} {_neighbour(text, end)}", f"{tidy} goes on {bool(_DOT.match(text, end) and label.match(text, _DOT.match(text, end).end()))}",
                        f"{tidy} spelt dot before {bool(_SPELT.search(text, max(0, s - 12), s))}", f"{tidy} local goes on {text[s - 1 : s] in ('.', '_', '%', '+', '-') if s else False}", *_surroundings(text, around(s), s, end)[2:],
                    ]
                    if end - s <= 160:
                        out.add(s, end, 0, names)
            i, k = i - 1, k + 1


# The field


def _order(lat: Lattice) -> tuple[list[int], list[int], list[int]]:
    """Candidates by end; and the numbers of their begins and ends among all ends of candidates (other
    boundaries change nothing, as steps outside are free)."""
    places = sorted({*lat.begin, *lat.end})
    number = {p: i for i, p in enumerate(places)}
    order = sorted(range(len(lat.begin)), key=lambda c: (lat.end[c], lat.begin[c], lat.kind[c]))
    return order, [number[b] for b in lat.begin], [number[e] for e in lat.end]


def marginals(lat: Lattice, scores: np.ndarray) -> tuple[float, np.ndarray]:
    """Log of the sum over all segmentations, and each candidate's probability."""
    if not lat.begin:
        return 0.0, np.zeros(0)
    order, begin, end = _order(lat)
    n = max(end) + 1
    into: list[list[int]] = [[] for _ in range(n)]
    outof: list[list[int]] = [[] for _ in range(n)]
    for c in order:
        into[end[c]].append(c)
        outof[begin[c]].append(c)
    s = scores.tolist()

    def total(xs: list[float]) -> float:
        top = max(xs)
        return top if len(xs) == 1 else top + math.log(sum(math.exp(x - top) for x in xs))

    up, down = [0.0] * n, [0.0] * n
    for p in range(1, n):
        up[p] = total([up[p - 1], *(up[begin[c]] + s[c] for c in into[p])])
    for p in range(n - 2, -1, -1):
        down[p] = total([down[p + 1], *(s[c] + down[end[c]] for c in outof[p])])
    return up[-1], np.exp(np.array([up[begin[c]] + s[c] + down[end[c]] for c in range(len(s))]) - up[-1])


def best(lat: Lattice, scores: np.ndarray) -> list[int]:
    """The candidates of the segmentation of the highest score."""
    if not lat.begin:
        return []
    order, begin, end = _order(lat)
    n = max(end) + 1
    value, back = [0.0] * n, [-1] * n
    at = 0
    for p in range(1, n):
        value[p] = value[p - 1]
        while at < len(order) and end[order[at]] == p:
            c = order[at]
            if value[begin[c]] + scores[c] > value[p]:
                value[p], back[p] = value[begin[c]] + float(scores[c]), c
            at += 1
    out, p = [], n - 1
    while p > 0:
        if back[p] >= 0:
            out.append(back[p])
            p = begin[back[p]]
        else:
            p -= 1
    return out[::-1]


def gradient(lat: Lattice, gold: Sequence[int], weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of a segmentation, and its gradient as feature numbers and values."""
    scores = lat.scores(weights)
    z, p = marginals(lat, scores)
    slope = -p
    slope[list(gold)] += 1
    return float(scores[list(gold)].sum()) - z, np.concatenate(lat.features), np.repeat(slope, [len(f) for f in lat.features])


def fit(windows: Sequence[tuple[str, Sequence[tuple[int, int, int]]]], epochs: int = 8, rate: float = 0.5, decay: float = 1e-6, seed: int = 5) -> np.ndarray:
    """Weights from windows and their ``(kind, start, end)`` spans, by AdaGrad steps of one window."""
    made = []
    for text, spans in windows:
        lat = lattice(text)
        at = {(k, b, e): c for c, (k, b, e) in enumerate(zip(lat.kind, lat.begin, lat.end, strict=True))}
        if lat.begin and all(tuple(s) in at for s in spans):
            made.append((lat, [at[tuple(s)] for s in spans]))
    weights, seen = np.zeros(WEIGHTS), np.full(WEIGHTS, 1e-6)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(made)):
            lat, gold = made[i]
            _, numbers, values = gradient(lat, gold, weights)
            own, inverse = np.unique(numbers, return_inverse=True)
            g = np.bincount(inverse, weights=values, minlength=len(own)) - decay * weights[own]
            seen[own] += g * g
            weights[own] += rate * g / np.sqrt(seen[own])
    return weights


# Windows to learn from

_VOWELS, _CONSONANTS = "aeiou", "bdfglmnprstvz"


class Writer:
    """Writes personal data in many forms, and look-alikes, between words of given contexts."""

    def __init__(self, contexts: Sequence[str], seed: int):
        self.rng, self.contexts = random.Random(seed), [c for c in contexts if c.strip()]

    def word(self) -> str:
        return "".join(self.rng.choice(_CONSONANTS) + self.rng.choice(_VOWELS) for _ in range(self.rng.randint(1, 4)))

    def number(self, n: int, first: str = "0123456789") -> str:
        return self.rng.choice(first) + "".join(self.rng.choice("0123456789") for _ in range(n - 1))

    def filler(self) -> str:
        if self.contexts and self.rng.random() < 0.5:
            words = self.rng.choice(self.contexts).split()
            at = self.rng.randrange(len(words))
            return " ".join(words[at : at + self.rng.randint(1, 8)])
        return " ".join(self.rng.choice(["at", "dot", "the", "on", "in"]) if self.rng.random() < 0.1 else self.word() for _ in range(self.rng.randint(1, 8)))

    def email(self) -> str:
        rng = self.rng
        local = rng.choice([self.word(), self.word() + rng.choice(["."] * 3 + ["_", "-", "+"]) + self.word(), self.word() + rng.choice([".", ""]) + self.number(2)])
        labels = [self.word() + rng.choice(["", "", self.number(1)]) for _ in range(rng.choice([1, 1, 2]))] + [rng.choice(["com", "org", "net", "de", "es", "fr", "io", "edu", "co.uk"])]
        at, dot = rng.choice([("@", "."), (" at ", " dot "), ("(at)", "(dot)"), ("[at]", "[dot]"), (" [at] ", " [dot] "), (" (at) ", " (dot) "), (" (at) ", "."), ("[at]", "."), (" @ ", "."), (" @ ", " . "), (" AT ", " DOT "), ("{at}", "{dot}"), ("@", "[.]")])
        domain = dot.join(".".join(labels).split("."))
        if at.strip() not in ("@",) and dot.strip() != "." and rng.random() < 0.5:
            local = local.replace(".", dot)
        elif "." in local and dot != ".":
            local = local.replace(".", "")
        return local + at + domain

    def ip(self) -> str:
        join = self.rng.choice([".", ".", "[.]", "(.)", " . ", "[dot]"[:0] or "[.]"])
        return join.join(str(self.rng.randint(0, 255)) for _ in range(4))

    def card(self, fails: bool = False) -> str:
        n = self.rng.choice([16] * 6 + [17, 18, 19])
        body = self.number(n - 1, "3456")
        check = next(d for d in "0123456789" if luhn(body + d))
        if fails:
            check = str((int(check) + self.rng.randint(1, 9)) % 10)
        digits, join = body + check, self.rng.choice(["", " ", "-", ".", "  ", " ", "/", "–", " - ", "_"])
        return join.join(digits[i : i + 4] for i in range(0, n, 4))

    def phone(self) -> str:
        rng, n = self.rng, self.number
        a, b, c = n(3, "23456789"), n(3), n(4)
        return rng.choice([
            f"+1 ({a}) {b}-{c}", f"+{n(2, '123456789')} {n(2)} {n(7)}", f"+{n(2, '123456789')}{n(9)}", f"({a}) {b}-{c}", f"({a}){b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}",
            f"00{n(2, '123456789')} {n(3, '123456789')} {n(6)}", f"00{n(2, '123456789')}{n(9)}", f"0{n(3, '123456789')}/{n(7)}", f"+{n(2, '123456789')}/{n(3)}/{n(6)}", f"0{n(1, '123456789')} {n(2)} {n(2)} {n(2)} {n(2)}",
            f"+{n(2, '123456789')} (0) {n(2)} {n(4)} {n(3)}",
        ])

    def decoy(self) -> str:
        rng, n = self.rng, self.number
        y, m, d = rng.randint(1900, 2050), rng.randint(1, 12), rng.randint(1, 28)
        h, s = rng.randint(0, 23), rng.randint(0, 59)
        return rng.choice([
            f"{y}-{m:02}-{d:02}", f"{d:02}.{m:02}.{y}", f"{m}/{d}/{y}", f"{y}-{m:02}-{d:02} {h:02}:{s:02}:{s:02}", f"{y}-{m:02}-{d:02}T{h:02}:{s:02}:{s:02}.{n(3)}", f"{h:02}:{s:02}:{s:02}", f"{y}{m:02}{d:02}{h:02}{s:02}",
            f"{rng.randint(0, 30)}.{rng.randint(0, 30)}.{rng.randint(0, 300)}", f"{n(3)},{n(3)}.{n(2)}", f"{n(1)},{n(3)},{n(3)},{n(3)}", f"978-{n(1)}-{n(2)}-{n(6)}-{n(1)}", f"{n(20, '123456789')}", f"{n(24, '123456789')}",
            f"#{n(8)}", f"{n(10, '123456789')}", f"{n(9)}", f"{n(12, '123456789')}", f"{y}-{y + 5}", f"{rng.randint(256, 999)}.{n(3)}.{n(2)}.{n(3)}", f"{n(3)} {n(3)} {n(3)} {n(3)}", f"{n(2)}.{n(4)}, {n(1)}.{n(4)}", f"{n(2)}.{n(6)} {n(2)}.{n(6)}",
            f"{n(3)}+{n(4)}={n(5)}", f"({n(2)}) ({n(3)}) {n(3)}", f"{n(5)}-{n(5)}-{n(5)}", f"{n(4)}-{n(4)}", f"{n(5)} {n(5)} {n(5)}", f"1.{n(1)}.{n(1)}.{n(1)}.{n(1)}.{n(1)}", f"{n(2)} {n(2)} {n(2)} {n(2)}", " ".join(n(1) for _ in range(rng.randint(8, 14))),
            self.card(fails=True), self.card(fails=True), f"{self.word()} at {self.word()}", f"{self.word()} at {self.word()} dot, {self.word()}", f"at the {self.word()} dot {self.word()}", f"@{self.word()}", f"{self.word()}@{self.word()}",
            f"{self.word()} @ {self.word()}", f"look at {self.word()}. Dot {self.word()}", f"{self.word()} at noon. {self.word().title()}", "".join(rng.choice("0123456789abcdef") for _ in range(40)), f"{n(3)}-{n(2)}-{n(4)}", f"{n(1)}({n(2)}):{n(3)}-{n(3)}",
        ])

    def entity(self, kind: int) -> str:
        return (self.email, self.ip, self.card, self.phone)[kind]()

    def window(self) -> tuple[str, list[tuple[int, int, int]]]:
        """Words with one to three entities or look-alikes."""
        text, spans = self.filler(), []
        for _ in range(self.rng.randint(1, 3)):
            text += self.rng.choice([" ", " ", " ", ", ", ": ", "\n", " (", ' "'])
            if self.rng.random() < 0.55:
                kind = self.rng.randrange(len(KINDS))
                piece = self.entity(kind)
                spans.append((kind, len(text), len(text) + len(piece)))
            else:
                piece = self.decoy()
            text += piece + self.rng.choice([" ", " ", " ", ". ", ", ", "\n", ") ", '" ', "; "]) + self.filler()
        return text, spans


_WINDOW = "plain boolean, window string, spans array<struct<kind:int,start:int,end:int>>, place long"


@dataclass(frozen=True)
class Settings:
    """Bounds of what the field is fitted on: documents looked at, windows around spans of them,
    contexts without any, and windows that are written. The decoded probability that adds a span."""

    documents: int = 8192
    windows: int = 512
    contexts: int = 256
    written: int = 3500
    sure: float = SURE
    seed: int = 5


def sample_windows(docs: DataFrame, settings: Settings) -> tuple[list[tuple[str, list[tuple[int, int, int]]]], list[str]]:
    """From about ``settings.documents`` documents, chosen by a hash: windows around base spans that
    overlap no other kind's, and contexts without spans. Both bounded, in an order that rows decide."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("text").cast("string").alias("text"), F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit(settings.seed)).alias("place")).where("text is not null")
    every = max(1, docs.count() // settings.documents)
    rows = rows.where(F.pmod("place", F.lit(every)) == 0)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, place in zip(batch.column("text").to_pylist(), batch.column("place").to_pylist(), strict=True):
                found = sorted(base_spans(text), key=lambda s: s[1])
                for kind, begin, end in found[:8]:
                    a, b = _edge(text, begin, -1), _edge(text, end, 1)
                    inside = [s for s in found if s[1] < b and s[2] > a]
                    if b - a <= 800 and all(x[2] <= y[1] for x, y in zip(inside, inside[1:], strict=False)) and all(a <= s[1] and s[2] <= b for s in inside):
                        out.append((False, text[a:b], [{"kind": k, "start": s - a, "end": e - a} for k, s, e in inside], place))
                if not found and text:
                    middle = len(text) // 2
                    out.append((True, text[middle : middle + 160], [], place))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ((),) * 4, types, strict=True)], ["plain", "window", "spans", "place"]
            )

    types = [pa.bool_(), pa.string(), pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])), pa.int64()]
    made = rows.mapInArrow(emit, _WINDOW).distinct()
    spans = made.where("not plain").orderBy("place", "window").limit(settings.windows).collect()
    plain = made.where("plain").orderBy("place", "window").limit(settings.contexts).collect()
    return [(r["window"], [(s["kind"], s["start"], s["end"]) for s in r["spans"]]) for r in spans], [r["window"] for r in plain]


def train(docs: DataFrame, settings: Settings = Settings()) -> np.ndarray:
    """The field's weights. Sampled windows count as they are and, where they hold one span, rewritten
    with another way of writing its kind; the rest are written between sampled contexts. Without
    documents the written windows alone teach it."""
    found, contexts = sample_windows(docs, settings)
    writer = Writer(contexts, settings.seed)
    windows = list(found)
    for text, spans in found:
        if len(spans) == 1:
            kind, begin, end = spans[0]
            piece = writer.entity(kind)
            windows.append((text[:begin] + piece + text[end:], [(kind, begin, begin + len(piece))]))
    windows += [writer.window() for _ in range(settings.written)]
    return fit(windows, seed=settings.seed)


# Texts


def decoded(text: str, weights: np.ndarray) -> list[tuple[int, int, int, float]]:
    """``(kind, start, end, probability)`` of the best segmentation, without the base patterns."""
    out = []
    for a, b in stretches(text):
        lat = lattice(text[a:b])
        scores = lat.scores(weights) if lat.begin else np.zeros(0)
        chosen = best(lat, scores)
        if chosen:
            p = marginals(lat, scores)[1]
            out += [(lat.kind[c], a + lat.begin[c], a + lat.end[c], float(p[c])) for c in chosen]
    return out


def all_spans(text: str, weights: np.ndarray, sure: float = SURE) -> list[tuple[int, int, int, bool]]:
    """``(kind, start, end, base)`` by kind, then start: the base spans, and the field's spans of high
    probability that overlap none of them."""
    base = base_spans(text)
    taken = sorted((s, e) for _, s, e in base)
    out = [(*s, True) for s in base]
    at = 0
    for kind, begin, end, p in sorted(decoded(text, weights), key=lambda s: s[1]):
        while at < len(taken) and taken[at][1] <= begin and (at + 1 == len(taken) or taken[at + 1][0] <= begin):
            at += 1
        clash = any(s < end and e > begin for s, e in taken[max(0, at - 4) : at + 8]) if len(taken) > 64 else any(s < end and e > begin for s, e in taken)
        if p >= sure and not clash:
            out.append((kind, begin, end, False))
    return sorted(out)


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def find_personal(docs: DataFrame, weights: np.ndarray, keep: Sequence[str] = ("doc_id",), out: str = "spans", sure: float = SURE) -> DataFrame:
    """The columns ``keep`` and ``out``: all spans of every whole text, in code points, end exclusive,
    by kind as in ``KINDS``, then start. One row for every row of ``docs``; null and empty texts have
    none. Equal texts have equal spans. Each text is read by itself; nothing is shuffled."""
    small_batches(docs.sparkSession)
    names = [c for c in keep if c != out]
    rows = docs.select(*[F.col(f"`{c}`") for c in names], F.col("text").cast("string").alias("__text"))
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                [{"kind": KINDS[k], "start": s, "end": e, "base": b} for k, s, e, b in all_spans(text.as_py() or "", weights, sure)] for text in batch.column("__text")
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, kinds)], [*names, out])

    schema = rows.select(*[F.col(f"`{c}`") for c in names], F.lit(None).cast(SPANS).alias(out)).schema
    return rows.mapInArrow(search, schema)


def masked(text: str, spans: Iterable[tuple[int, int, int, bool]]) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans as the one
    that begins first."""
    out, at = [], 0
    for kind, begin, end, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if begin >= at:
            out += [text[at:begin], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])

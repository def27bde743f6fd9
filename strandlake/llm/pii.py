"""Personal data: strict rules, and boosted trees over the candidates that rules miss.

Strict spans (email, ip, card, phone by fixed patterns and checks) always stay. Generators of
high recall propose more, overlapping spans: runs of digit groups and parts of them as phone or
card, four numbers as an address, signs written as words or apart. Gradient-boosted trees judge
each by its format and context; per kind a threshold, calibrated on examples that the trees have
not seen, selects what is redacted too. The trees learn from examples written here from a fixed
seed, so a run needs no labels. Real and decoy items stand in the same invented context; a word
such as "phone" is somewhat more likely before a phone number and occurs before decoys as well.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_back, id_key, map_arrow

KINDS = ("email", "ip", "card", "phone")
#: The patterns of the strict rules.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
#: A leftmost match never starts inside a run of digits nor gives digits back, so long runs cost
#: linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Runs of digit groups; signs between the numbers of an address; signs of a spelled address.
_RUN = re.compile(r"[+(]?[0-9]+(?:[ ().,/_-]{1,3}[0-9]+)*")
_GROUP = re.compile(r"[0-9]+")
_POINT = r"[ ]?(?:\.|\[\.\]|\(\.\)|\[dot\]|\(dot\)|,| dot )[ ]?"
_FOUR = re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?:{_POINT}[0-9]{{1,3}}){{3}}(?![0-9]|\.[0-9])", re.IGNORECASE)
_AT = re.compile(r"[ ]?(?:@|\(at\)|\[at\]|(?<=[ ])at(?=[ ]))[ ]?", re.IGNORECASE)
_LEFT = re.compile(r"[A-Za-z0-9._%+-]{1,64}\Z")
_DOT = r"(?:\.|[ ]?\(dot\)[ ]?|[ ]?\[dot\][ ]?|[ ]dot[ ])"
_RIGHT = re.compile(rf"[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{0,4}}{_DOT}[A-Za-z]{{2,24}}\b", re.IGNORECASE)
_WORDS = (("mail", "contact", "write"), ("ip", "host", "server", "address"), ("card", "visa", "credit", "pay"), ("call", "tel", "phone", "fax", "mobile"))
_DIGITS = re.compile(r"[0-9]+")

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> list[Span]:
    """As the pattern local@domain finds them: local parts have no @, so each sign has one."""
    out, at, floor = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            floor = found.end()
            out.append((start, floor))
        at = text.find("@", max(at + 1, floor))
    return out


def _phones(text: str) -> list[Span]:
    out, at = [], text.find("+")
    while at >= 0:
        found = _PHONE.match(text, at)
        if found and 9 <= len(_digits(found[0])) <= 15:
            out.append(found.span())
        at = text.find("+", found.end() if found else at + 1)
    return out


def strict(text: str) -> dict[str, list[Span]]:
    """The spans of the strict rules, each kind leftmost and without overlap."""
    out: dict[str, list[Span]] = {"email": _emails(text), "ip": [], "card": [], "phone": _phones(text)}
    for found in _CARD.finditer(text):
        if found.end() - found.start() >= 13:
            digits = _digits(found[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(found.span())
    for found in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in found[0].split(".")):
            out["ip"].append(found.span())
    return out


#: Groups of a run that are looked at together; longer runs are tables and not numbers.
MOST_GROUPS = 7


def _numbers(text: str) -> Iterator[tuple[int, int, int]]:
    """Phones and cards among the digit groups of a run, whole or in part."""
    for run in _RUN.finditer(text):
        if run.end() - run.start() < 7:
            continue
        groups = [m.span() for m in _GROUP.finditer(text, run.start(), run.end())]
        for i in range(len(groups)):
            digits, start = 0, groups[i][0]
            lead = start - 1 if start and text[start - 1] in "+(" and start > run.start() - 1 else start
            lead = max(lead, run.start())
            for _, stop in groups[i : i + MOST_GROUPS]:
                digits = len(_digits(text[start:stop]))
                if digits > 19:
                    break
                if 13 <= digits and luhn(_digits(text[start:stop])):
                    yield 2, start, stop
                if 9 <= digits <= 15:
                    yield 3, lead, stop


def _spelled(text: str) -> Iterator[tuple[int, int, int]]:
    """Addresses whose signs are words, in brackets or apart."""
    if "@" not in text and "at" not in text.lower():
        return
    for sign in _AT.finditer(text):
        left = _LEFT.search(text, max(0, sign.start() - 64), sign.start())
        right = _RIGHT.match(text, sign.end()) if left else None
        # a plain word "at" needs a spelled dot too, or all prose would be candidates
        if right and (sign[0].strip().lower() != "at" or " dot " in right[0].lower() or "(" in right[0] or "[" in right[0]):
            yield 0, left.start(), right.end()


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) proposed beyond the rules; spans overlap, within and across kinds."""
    return [*_spelled(text), *((1, *m.span()) for m in _FOUR.finditer(text)), *_numbers(text)]


def _class_of(char: str) -> int:
    if not char:
        return 0
    return 1 if char.isspace() else 2 if char.isdigit() else 3 if char.isalpha() else 4 if char in ".,;:!?)" else 5


#: Context words stand within so many code points before a candidate.
CONTEXT = 24


def describe(text: str, kind: int, start: int, end: int) -> list[float]:
    """Format and context of a candidate."""
    body = text[start:end]
    groups = [len(g) for g in _DIGITS.findall(body)] or [0]
    values = [int(g) for g in _DIGITS.findall(body)] or [0]
    digits = _digits(body)
    signs = re.findall(r"[^0-9]+", body.lstrip("+("))
    before, after = text[max(0, start - CONTEXT) : start].lower(), text[end : end + 6]
    return [
        *(float(kind == k) for k in range(4)),
        end - start,
        len(digits),
        sum(c.isalpha() for c in body),
        *(body.count(c) for c in " -.(/,_[@"),
        body.startswith("+") + 2 * body.startswith("(") + 3 * body.startswith("00") + 4 * (body[0] == "0"),
        len(groups),
        max(groups),
        min(groups),
        groups[0],
        groups[-1],
        groups[1] if len(groups) > 1 else 0,
        float(luhn(digits)) if len(digits) >= 12 else -1,
        float(max(values) <= 255),
        float(max(values) <= 31),
        float(len(groups) == 4 and max(groups) <= 3),
        float(1900 <= values[0] <= 2100 or 1900 <= values[-1] <= 2100),
        len(set(signs)),
        float(digits[:1] in "3456"),
        _class_of(text[start - 1 : start]),
        _class_of(text[end : end + 1]),
        sum("0" <= c <= "9" for c in text[max(0, start - 6) : start]),
        sum("0" <= c <= "9" for c in after),
        float(any(w in before for w in _WORDS[kind])),
        float(any(w in before for i, words in enumerate(_WORDS) if i != kind for w in words)),
        float("at)" in body.lower() or "at]" in body.lower()),
        float("dot" in body.lower()),
    ]


@dataclass
class Tree:
    """A full binary tree of ``depth`` levels: at node i, x[feature] > cut goes right."""

    depth: int
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[np.arange(len(x)), self.feature[at]] > self.cut[at])
        return self.value[at - (2**self.depth - 1)]


def _grow(x: np.ndarray, slope: np.ndarray, curve: np.ndarray, depth: int, penalty: float = 1.0) -> Tree:
    """A tree of Newton steps; each split has the largest gain over its node's thresholds."""
    inner = 2**depth - 1
    feature, cut = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
    at = np.zeros(len(x), dtype=np.int64)
    for node in range(inner):
        rows = np.flatnonzero(at == node)
        best = 1e-6
        total, mass = slope[rows].sum(), curve[rows].sum()
        for j in range(x.shape[1]) if len(rows) > 1 else ():
            order = rows[np.argsort(x[rows, j], kind="stable")]
            v = x[order, j]
            edge = np.flatnonzero(v[1:] > v[:-1])
            if not len(edge):
                continue
            g, h = np.cumsum(slope[order])[edge], np.cumsum(curve[order])[edge]
            gain = g**2 / (h + penalty) + (total - g) ** 2 / (mass - h + penalty) - total**2 / (mass + penalty)
            i = int(np.argmax(gain))
            if gain[i] > best:
                best = gain[i]
                feature[node], cut[node] = j, (v[edge[i]] + v[edge[i] + 1]) / 2
        at[rows] = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
    leaf = at - inner
    sums, masses = (np.bincount(leaf, weights=w, minlength=inner + 1) for w in (slope, curve))
    return Tree(depth, feature, cut, -sums / (masses + penalty))


@dataclass
class Boosted:
    trees: list[Tree]
    rate: float
    thresholds: list[float]

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.zeros(len(x))
        for tree in self.trees:
            raw += self.rate * tree(x)
        return 1 / (1 + np.exp(-raw))


def _with_check_digit(body: str) -> str:
    return next(body + str(d) for d in range(10) if luhn(body + str(d)))


def _item(rng: random.Random, kind: int, unseen: bool) -> str:
    """An item of a kind (-1: a decoy). Formats that are ``unseen`` never occur in training."""
    number = lambda n: "".join(str(rng.randrange(10)) for _ in range(n))
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9)))
    no_card = lambda: next(n for n in iter(lambda: number(16), None) if not luhn(n))
    if kind == 0:
        user, host, last = f"{word()}{rng.choice(['', '.', '_', '-'])}{rng.choice([word(), number(2)])}", word(), rng.choice(["com", "org", "net", "de", "edu", "info"])
        host = host + (rng.choice([".", "-"]) + word()) * (rng.random() < 0.3)
        known = ["{}(at){}(dot){}", "{}[at]{}[dot]{}", "{} (at) {} (dot) {}", "{} [at] {} [dot] {}", "{} @ {}.{}", "{} at {} dot {}", "{}(at){}.{}", "{} [at] {}.{}"]
        new = ["{} (at) {}.{}", "{}[at]{}.{}", "{} at {}(dot){}", "{} @{}.{}"]
        item = rng.choice(new if unseen else known).format(user, host, last)
        return item.upper() if rng.random() < 0.15 else item
    if kind == 1:
        sign = rng.choice([" . ", "(dot)", "[dot]"] if unseen else [" .", ". ", "[.]", "(.)", " dot "])
        return sign.join(str(rng.randrange(256)) for _ in range(4))
    if kind == 2:
        digits = _with_check_digit(rng.choice("3456") + number(14))
        if unseen:
            return rng.choice([" . ", "_"]).join([digits[:4], digits[4:8], digits[8:12], digits[12:]]) if rng.random() < 0.5 else f"{digits}, {number(4)}"
        sign = rng.choice(["/", "  ", " - ", ", ", "."])
        return rng.choice([sign.join(digits[i : i + 4] for i in range(0, 16, 4)), f"{number(rng.randrange(3, 17))} {digits}", f"{digits} {no_card()}"])
    if kind == 3:
        a, b, c = rng.choice("23456789") + number(2), number(3), number(4)
        if unseen:
            return rng.choice([f"({a}){b}-{c}", f"({a}) {b}.{c}", f"00{rng.randrange(10, 99)} {a} {b}{c}", f"{a}.{b}-{c}"])
        known = [f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00 {rng.randrange(1, 99)} {a} {b} {c}", f"00{rng.randrange(1, 99)}-{a}-{b}{c}", f"0{a}/{b}{c}"]
        return rng.choice(known)
    decoys = [
        lambda: number(rng.randrange(7, 20)),
        lambda: f"20{number(2)}-{rng.randrange(1, 13):02}-{rng.randrange(1, 29):02}",
        lambda: f"{rng.randrange(1, 29)}/{rng.randrange(1, 13)}/20{number(2)} {rng.randrange(24):02}.{number(2)}",
        lambda: ".".join(str(rng.randrange(256, 9999)) for _ in range(4)),
        lambda: ", ".join(number(rng.randrange(1, 5)) for _ in range(rng.randrange(3, 6))),
        lambda: ", ".join(str(rng.randrange(256)) for _ in range(4)),
        lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40)),
        lambda: f"978-{rng.randrange(10)}-{number(2)}-{number(6)}-{rng.randrange(10)}",
        lambda: f"{rng.randrange(1, 999)},{number(3)},{number(3)}.{number(2)}",
        lambda: f"{word()} at {word()}. {word().title()}",
        lambda: " ".join(number(4) for _ in range(rng.randrange(3, 7))),
        lambda: f"{no_card()} {no_card()}",
        lambda: f"19{number(2)}-20{number(2)}",
        lambda: f"{number(3)}-{number(5)}-{number(4)}",
        lambda: f"{word()} @ {word()} {word()}",
    ]
    fresh = [
        lambda: f"{rng.randrange(24):02}.{number(2)}.{number(2)}, {rng.randrange(1, 29)}.{rng.randrange(1, 13)}.20{number(2)}",
        lambda: f"{number(1)} {number(3)} {number(3)} {number(3)}",
        lambda: "-".join("".join(rng.choice("0123456789abcdef") for _ in range(n)) for n in (8, 4, 4, 4, 12)),
        lambda: f"{number(2)}/{number(4)}/{number(6)}",
    ]
    return rng.choice(fresh if unseen else decoys)()


def example(rng: random.Random, unseen: bool = False) -> tuple[str, int, int, int]:
    """(text, kind, start, end) of an item in invented context; kind -1 is a decoy."""
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9)))
    kind = rng.choice([0, 1, 2, 3, -1, -1, -1, -1])
    item = _item(rng, kind, unseen)
    hint = _WORDS[kind if kind >= 0 and rng.random() < 0.5 else rng.randrange(4)]
    lead = f"{word()}{rng.choice(['. ', ' ', ', ', chr(10)])}{word()} {rng.choice(hint) if rng.random() < 0.35 else word()}{rng.choice([' ', ' ', ': ', ' = ', chr(10)])}"
    tail = f"{rng.choice([' ', '. ', ', ', chr(10)])}{word()} {word()}"
    return lead + item + tail, kind, len(lead), len(lead) + len(item)


def _rows(rng: random.Random, examples: int, unseen: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Descriptions of the candidates of so many examples, and which are right: of an item's kind,
    and covering its number or address but for digits that the item has beside it."""
    rows, right = [], []
    for _ in range(examples):
        text, kind, start, end = example(rng, unseen)
        taken = [s for spans in strict(text).values() for s in spans]
        for k, a, b in candidates(text):
            if not any(a < y and x < b for x, y in taken):
                rows.append(describe(text, k, a, b))
                right.append(k == kind and _is_item(text, k, a, b, start, end))
    return np.array(rows, dtype=float), np.array(right, dtype=float)


def _is_item(text: str, kind: int, a: int, b: int, start: int, end: int) -> bool:
    if kind != 2:
        return (a, b) == (start, end)
    digits = _digits(text[a:b])
    return start <= a and b <= end and len(digits) == 16 and luhn(digits) and digits[0] in "3456"


@lru_cache(maxsize=1)
def trained(examples: int = 6000, rounds: int = 60, depth: int = 4, rate: float = 0.25, precision: float = 0.995) -> Boosted:
    """Trees from two thirds of the examples, thresholds from the rest: the lowest score per
    kind above which at least ``precision`` of its candidates are right."""
    rng = random.Random(4)
    x, y = _rows(rng, examples * 2 // 3)
    held, truth = _rows(rng, examples // 3)
    model, raw = Boosted([], rate, []), np.zeros(len(x))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        tree = _grow(x, p - y, p * (1 - p), depth)
        model.trees.append(tree)
        raw += rate * tree(x)
    score = model.score(held)
    for k in range(4):
        mine = held[:, k] == 1
        order = np.argsort(-score[mine], kind="stable")
        s, hits = score[mine][order], truth[mine][order]
        good = np.flatnonzero((np.cumsum(hits) >= precision * np.arange(1, len(s) + 1)) & (hits == 1))
        # half way to the best wrong one, as formats of the corpus are not those of the examples
        below = s[good[-1] + 1 :] if len(good) else s
        model.thresholds.append(float(max(0.5, (s[good[-1]] + below.max(initial=0.0)) / 2)) if len(good) else 2.0)
    return model


def find(text: str, model: Boosted) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """(strict spans, added spans) by kind. Added spans overlap no strict one and, best score
    first, no other added one."""
    base = strict(text)
    more: dict[str, list[Span]] = {k: [] for k in KINDS}
    proposed = candidates(text)
    if not proposed:
        return base, more
    # one mark a code point, so a text with many spans costs no comparison of all with all
    taken = bytearray(len(text))
    for a, b in (s for spans in base.values() for s in spans):
        taken[a:b] = b"\x01" * (b - a)
    open_ = [c for c in proposed if taken.find(1, c[1], c[2]) < 0]
    if open_:
        score = model.score(np.array([describe(text, *c) for c in open_], dtype=float))
        for i in np.argsort(-score, kind="stable").tolist():
            kind, a, b = open_[i]
            if score[i] >= model.thresholds[kind] and taken.find(1, a, b) < 0:
                taken[a:b] = b"\x01" * (b - a)
                more[KINDS[kind]].append((a, b))
    return base, more


def _joined(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(spans[k]))


def redact(text: str, spans: dict[str, list[Span]]) -> str:
    """The text with each span as [KIND]; of overlapping spans the first one is shown."""
    out, at = [], 0
    for a, b, kind in sorted((a, b, k) for k, list_ in spans.items() for a, b in list_):
        if a >= at:
            out.append(text[at:a] + f"[{kind.upper()}]")
        at = max(at, b)
    return "".join(out) + text[at:]


def find_pii(docs: DataFrame, texts: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone (strict
    spans), base_sha256, spans, n_added, n_spans (both together); with ``texts`` also the redacted
    text.

    Spans are kind:start:end in code points, end exclusive, by kind and start. Null or empty
    text: no spans. Very long texts are searched whole. Ties between overlapping candidates: the
    first proposed. Null doc_id: null. Repeated rows: equal rows. Empty table: empty result. Other
    columns are ignored."""
    model = trained()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for item in batch.column("text"):
            text = item.as_py() or ""
            base, more = find(text, model)
            every = {k: base[k] + more[k] for k in KINDS}
            row = [len(base[k]) for k in KINDS]
            row += [hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every), sum(map(len, more.values())), sum(map(len, every.values()))]
            out.append(row + [redact(text, every)] * texts)
        types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64(), pa.int64()] + [pa.string()] * texts
        columns = [pa.array(c, t) for c, t in zip(zip(*out), types)]
        yield pa.RecordBatch.from_arrays([batch.column("k"), *columns], ["k", *names])

    names = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "n_spans"] + ["redacted"] * texts
    schema = "k long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long" + ", redacted string" * texts
    base = docs.select(id_key().alias("k"), F.col("text").cast("string").alias("text"))
    return map_arrow(base, run, schema).select(id_back(F.col("k")).alias("doc_id"), *names)

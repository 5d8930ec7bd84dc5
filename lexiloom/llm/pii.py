"""Personal data: base patterns, and spans that boosted trees select from generous candidates.

The base patterns of emails, IP addresses, cards and phone numbers always stay. Besides, generators of high recall propose
overlapping spans: masked or spaced addresses, numbers in any grouping and parts of them, other forms of IP addresses. Boosted trees score
each by its format and its context, and a threshold for each kind, calibrated on labelled candidates that the trees have
not seen so that PRECISION of what passes is right, selects. Of selected spans that overlap, the likelier stays, or the
whole if one is part of another of its kind, and none overlaps a base span.

The labelled candidates are made by a seeded generator (TRAIN of them), not taken from the data; the model is fitted once
on the driver, has a fixed size and goes to the tasks with the function.

Defined results: null and empty texts have no spans; offsets count code points; repeated rows are searched one by one;
equal scores go to the earlier span; an empty table gives an empty result; extra columns are left aside.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import boosting
from .common import slices, table

KINDS = ("email", "ip", "card", "phone")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    values = [int(c) for c in digits[::-1]]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses. Each must hold an @, so the search goes from one to the next and stays linear."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL.match(text[start - 1]):
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[Span]:
    """The spans of the base patterns, by start and then kind."""
    found: list[Span] = [(a, b, "email") for a, b in emails(text)]
    found += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 40 and 14 <= len(digits := digits_of(m[0])) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), "card"))
    if "+" in text:
        found += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


#: Generous patterns of each kind.
GENEROUS = (
    ("email", re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}(?: ?[\[(] ?dot ?[\])] ?[A-Za-z0-9_%+-]{1,63}){0,3}(?: ?@ ?| ?[\[(] ?at ?[\])] ?| at )[A-Za-z0-9-]{1,63}(?:(?:\.| ?[\[(] ?dot ?[\])] ?| dot | \. )[A-Za-z0-9-]{1,63}){1,4}", re.I)),
    ("ip", re.compile(r"(?<![0-9.])[0-9]{1,3}(?: ?(?:\.|\[\.\]|\(\.\)) ?[0-9]{1,3}){3}(?![0-9.])|(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")),
    ("card", re.compile(r"(?<![0-9A-Za-z.])[0-9]{3,6}(?:[ ./_-]?[0-9]{2,7}){2,5}(?![0-9A-Za-z])")),
    ("phone", re.compile(r"(?<![0-9A-Za-z.,])(?=[0-9+(])(?:\+|00)?[0-9]{0,3}[ .-]?\(?[0-9]{2,5}\)?(?:[ ./-]{0,2}[0-9]{2,5}){1,4}(?![0-9A-Za-z])")),
)
#: Least and most digits.
DIGITS = {"card": (13, 19), "phone": (7, 15)}
#: What any match of a kind's generous pattern holds; texts without it have no candidates of the kind.
NEEDED = {
    "email": re.compile(r"@|[\[(] ?at ?[\])]| at ", re.I),
    "ip": re.compile(r"[0-9] ?(?:\.|\[\.\]|\(\.\)) ?[0-9]|[0-9A-Fa-f]:[0-9A-Fa-f]"),
    "card": re.compile(r"[0-9]{3}"),
    "phone": re.compile(r"[0-9]{2}"),
}
#: Groups of digits in a row, what a row may begin with, and how many of its groups a span can have.
ROW = re.compile(r"[0-9]+(?:[ ()./_-]{1,3}[0-9]+)*")
OPENING = re.compile(r"[+(]{0,2}\Z")
GROUPS = 6
#: The generous patterns of numbers without what must stand around them.
PART = {kind: re.compile(re.sub(r"^\(\?<![^)]*\)|\(\?![^)]*\)$", "", pattern.pattern)) for kind, pattern in GENEROUS if kind in DIGITS}
CONTEXT = {
    "email": re.compile(r"\b(?:e-?mail|mail|contact|write|address|reach|correo|courriel|kontakt)\b", re.I),
    "ip": re.compile(r"\b(?:ip|ipv[46]|host|server|addr(?:ess)?|ping|login|subnet|dns)\b", re.I),
    "card": re.compile(r"\b(?:card|visa|master ?card|amex|credit|debit|pan|karte|carte|tarjeta|payment|paid)\b", re.I),
    "phone": re.compile(r"\b(?:phone|tel|call|cell|mobile|fax|dial|telefon|t[eé]l[eé]phone|tel[eé]fono|ring|sms|whatsapp)\b", re.I),
}
OTHER = re.compile(r"\b(?:order|invoice|isbn|version|page|serial|model|no|ref|sku|id|pp|vol|date|since|build|section|rfc|part|item|total|sum|eur|usd|km|kg)\b\.?", re.I)
AROUND = 32


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    """Format and context of a candidate."""
    span, before, after = text[start:end], text[max(0, start - AROUND) : start], text[end : end + AROUND]
    digits = digits_of(span)
    groups = re.findall(r"[0-9]+", span)
    return [
        KINDS.index(kind),
        len(span),
        len(digits),
        len(groups),
        max(map(len, groups), default=0),
        min(map(len, groups), default=0),
        span.startswith(("+", "00")),
        span.count("(") == span.count(")") == 1 and "(" in span,
        span.count(" "),
        span.count("-"),
        span.count("."),
        span.count("/"),
        "@" in span,
        bool(re.search(r"[\[(] ?(?:at|dot|\.) ?[\])]", span, re.I)),
        bool(re.search(r" at ", span, re.I)),
        bool(re.search(r" dot |\.[a-z]{2,6}$", span, re.I)),
        14 <= len(digits) <= 19 and luhn(digits),
        len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups),
        span.count(":"),
        digits[:1] in ("3", "4", "5", "6"),
        len(set(digits)) / max(1, len(digits)),
        bool(CONTEXT[kind].search(before)),
        bool(CONTEXT[kind].search(after)),
        bool(OTHER.search(before)),
        before[-1:].isalnum(),
        after[:1].isalnum(),
        bool(re.match(r"(?:19|20)[0-9]{2}\b", span)),
        before.rstrip().endswith(("#", "$", "€", "=", "v", "§")),
    ]


def parts(text: str, kind: str) -> Iterator[tuple[int, int]]:
    """Spans of up to GROUPS neighbouring groups of digits of which a number of the kind can be made, overlapping ones included."""
    least, most = DIGITS[kind]
    fits = PART[kind].fullmatch
    for row in ROW.finditer(text):
        if row.end() - row.start() < least:
            continue
        groups = [m.span() for m in re.finditer("[0-9]+", text[row.start() : row.end()])]
        groups = [(row.start() + a, row.start() + b) for a, b in groups]
        for i, (start, _) in enumerate(groups):
            opening = len(OPENING.search(text[max(0, start - 2) : start])[0]) if kind == "phone" else 0
            digits = 0
            for a, end in groups[i : i + GROUPS]:
                digits += end - a
                if digits > most:
                    break
                if digits < least or text[end : end + 1].isalnum():
                    continue
                for at in range(start - opening, start + 1):
                    if not text[max(0, at - 1) : at].isalnum() and fits(text, at, end):
                        yield at, end
                        break


def candidates(text: str) -> list[Span]:
    """Overlapping spans of all generous patterns, and of parts of numbers, where the digits are as many as the kind can have."""
    found: dict[Span, None] = {}
    for kind, pattern in GENEROUS:
        if not NEEDED[kind].search(text):
            continue
        for m in pattern.finditer(text):
            if kind not in DIGITS or DIGITS[kind][0] <= len(digits_of(m[0])) <= DIGITS[kind][1]:
                found[m.start(), m.end(), kind] = None
        if kind in DIGITS:
            found.update(((a, b, kind), None) for a, b in parts(text, kind))
    return list(found)


TRAIN, SEED, PRECISION = 6000, 10, 0.98


def labelled(draw: random.Random) -> tuple[str, Span, int]:
    """A text, a candidate in it and whether it is personal data, made up."""
    word = lambda n=8: "".join(draw.choice("abcdefghijklmnoprstuvwxyz") for _ in range(draw.randint(2, n)))
    number = lambda n: "".join(draw.choice("0123456789") for _ in range(n))
    kind, good = draw.choice(KINDS), draw.random() < 0.5
    hint = {"email": "email contact", "ip": "host server ip", "card": "card visa", "phone": "phone tel call"}[kind].split()
    lead = draw.choice(hint) + draw.choice([" ", ": "]) if good and draw.random() < 0.6 else " ".join(word() for _ in range(draw.randint(0, 3))) + " "
    if not good:
        lead = draw.choice(["order ", "isbn ", "version v", "no. ", "page ", "$", "total ", "ref #", lead, lead, lead])
    if kind == "email":
        if good:
            at, dot = draw.choice([(" @ ", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), ("@", ".")])
            span = f"{word()}{draw.choice(['', '.', '_'])}{draw.choice([word(), number(2)])}{at}{word()}{dot}{draw.choice(['com', 'org', 'net', 'de', 'fr'])}"
        else:
            span = f"{word()} at {word()}{draw.choice([' . ', '.'])}{word()}"
    elif kind == "ip":
        if good:
            octets = [str(draw.randint(0, 255)) for _ in range(4)]
            span = draw.choice(["[.]", "(.)", " . ", "."]).join(octets) if draw.random() < 0.8 else ":".join(f"{draw.randint(0, 65535):x}" for _ in range(8))
        else:
            numbers = [draw.choice([number(3), str(draw.randint(256, 999)), number(1)]) for _ in range(4)]
            few = [str(draw.randint(0, 99)) for _ in range(8)]  # ratios and sections
            span = draw.choice([draw.choice([".", " . "]).join(numbers), ":".join(few), " . ".join(few[:4])])
    elif kind == "card":
        body = draw.choice("3456") + number(draw.choice([13, 14, 14, 14, 15]))
        check = next(c for c in "0123456789" if luhn(body + c))
        whole = body + (check if good else draw.choice([c for c in "0123456789" if c != check]))
        sign = draw.choice(["", " ", "-", ".", "/", "_"]) if good else draw.choice(["", " ", "-"])
        span = sign.join(whole[i : i + 4] for i in range(0, len(whole), 4))
    elif good:
        sign = draw.choice([" ", "-", ".", " "])
        area = draw.choice([number(3), f"({number(3)})"])
        span = f"{draw.choice(['', '+1 ', '0049 ', '1-', '+33 '])}{area}{draw.choice([' ', sign])}{number(3)}{sign}{number(4)}"
        if span[0].isdigit() and "(" not in span and draw.random() < 0.8:
            lead = draw.choice(["phone ", "tel. ", "call ", "mobile: "])
    else:
        span = draw.choice([f"{draw.randint(1900, 2099)}-{number(2)}-{number(2)}", f"{number(2)}/{number(2)}/{number(4)}", f"{number(3)}.{number(2)}", f"{number(2)} {number(2)} {number(2)}", f"{number(5)} {number(5)}", " ".join(number(2) for _ in range(draw.randint(4, 6))), f"{number(4)}-{number(4)}", number(9), f"{number(3)}-{number(10)}"])
    text = f"{lead}{span}{draw.choice([' ', '. ', ', '])}{word()} {word()}"
    return text, (len(lead), len(lead) + len(span), kind), int(good)


def trained() -> tuple[dict[str, np.ndarray], dict[str, float]]:
    """Trees fitted on half of the made-up candidates, and each kind's threshold, calibrated on the other half."""
    draw = random.Random(SEED)
    rows = [labelled(draw) for _ in range(TRAIN)]
    x = np.array([features(text, *span) for text, span, _ in rows], float)
    y = np.array([label for *_, label in rows], float)
    half = TRAIN // 2
    trees = boosting.fit(x[:half], y[:half])
    score, label = boosting.predict(trees, x[half:]), y[half:]
    kinds = x[half:, 0].astype(int)
    thresholds = {}
    for k, kind in enumerate(KINDS):
        s, own = score[kinds == k], label[kinds == k]
        order = np.argsort(-s)
        right = np.cumsum(own[order]) / np.arange(1, len(order) + 1)
        passing = np.flatnonzero(right >= PRECISION)
        thresholds[kind] = float(s[order][passing[-1]]) if len(passing) else float("inf")
    return trees, thresholds


class Taken:
    """Spans in order of their starts; tells whether one meets any of them."""

    def __init__(self, spans: list[Span]):
        self.starts = [s[0] for s in spans]
        self.ends = list(accumulate((s[1] for s in spans), max))  # the furthest end of all up to each

    def meets(self, start: int, end: int) -> bool:
        k = bisect_left(self.starts, end)
        return k > 0 and self.ends[k - 1] > start


def select(text: str, base: list[Span], trees: dict[str, np.ndarray], thresholds: dict[str, float]) -> list[Span]:
    """The spans to redact: the base's, and the likeliest candidates that overlap none."""
    taken = Taken(base)
    proposed = [c for c in candidates(text) if not taken.meets(c[0], c[1])]
    if not proposed:
        return base
    scores = boosting.predict(trees, np.array([features(text, *c) for c in proposed], float))
    passed = [(c, s) for c, s in zip(proposed, scores, strict=True) if s >= max(0.0, thresholds[c[2]])]
    wide: list[tuple[Span, float]] = []  # those that are no part of another of their kind
    ends = dict.fromkeys(KINDS, -1)
    for (start, end, kind), score in sorted(passed, key=lambda p: (p[0][0], -p[0][1])):
        if end > ends[kind]:
            wide.append(((start, end, kind), score))
            ends[kind] = end
    starts: list[int] = []  # of those kept, which overlap nowhere, so only neighbours need a look
    ends_: list[int] = []
    kept: list[Span] = []
    for (start, end, kind), _ in sorted(wide, key=lambda p: (-p[1], p[0][0])):
        k = bisect_left(starts, end)
        if not k or ends_[k - 1] <= start:
            starts.insert(k, start)
            ends_.insert(k, end)
            kept.append((start, end, kind))
    return sorted(base + kept, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def redacted(text: str, spans: list[Span]) -> str:
    """text with each span's kind in its place."""
    parts, done = [], 0
    for start, end, kind in spans:
        if start >= done:
            parts += [text[done:start], f"[{kind}]"]
        done = max(done, end)
    return "".join([*parts, text[done:]])


def listed(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, redacted string"


def personal_data(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """Counts and digest of the base spans, all spans, and (with_text) the redacted text of docs (doc_id, text)."""
    model = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                base = base_spans(text := text or "")
                spans = select(text, base, *model)
                rows.append((doc_id, *(sum(s[2] == k for s in base) for k in KINDS), hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans), redacted(text, spans) if with_text else None))
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 5 + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in FOUND.split(", ")])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, FOUND)


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"), with_text=False).drop("redacted")

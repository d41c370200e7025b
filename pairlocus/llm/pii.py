"""Personal data by candidate gradient boosting.

High-recall generators propose overlapping spans of four kinds (email, ip, card, phone);
boosted trees score each candidate by its format and context; a threshold for each kind,
calibrated on examples the trees haven't seen, selects redactions, the likelier of two that
overlap first. Spans that the base patterns find and validate always stay; the trees add what
the patterns miss, such as a card that a stray number precedes, a phone without its plus, an
address written with (at) and (dot).

The trees are fitted on the driver on two bounded sets. One has ``examples`` synthetic snippets,
written from the formats below with look-alikes (keys, versions, order numbers, dates, failed
checksums) as negatives. The other has up to ``fit_rows`` places of the documents themselves,
drawn by a hash: spans that the base rules validate, written in a form they miss (no plus, (at)
and (dot), a stray number before), are positives where they stand, and numbers that fail the
rules' checks or lie in keys are negatives. A third of either set is kept from the trees; a
kind's threshold has the asked precision on both thirds, and ``calibration`` reports precision
and recall there. Detection reads every whole text.

Patterns are matched in time linear in a text: starts inside a run that has already failed
are skipped by possessive repeats and look-behinds, which changes no match. Candidates of cards and
phones, up to nineteen digits from each group on, are made and scored in vectors over the groups of
a batch, a bounded number at a time; which spans overlap is looked up by character.

Nulls: a null text counts as empty and has no spans; null or repeated document ids are rows
like others. Empty tables give no rows.
"""

import functools
import hashlib
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import small_batches, whole_text

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"@([A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+(?<=[0-9])")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Addresses from left to right: the whole run before an @ that a domain follows."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        m = DOMAIN.match(text, at)
        start = at
        while m and start > free and text[start - 1] in LOCAL:
            start -= 1
        if m and start < at:
            found.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return found


def phones(text: str) -> list[tuple[int, int]]:
    found, at = [], text.find("+")
    while at >= 0:
        m = PHONE.match(text, at)
        if m:
            found.append(m.span())
        at = text.find("+", m.end() if m else at + 1)
    return found


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns that pass their checks, by kind as listed, then start."""
    spans: list[Span] = [("email", *s) for s in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            spans.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        number = digits_of(m[0]) if m.end() - m.start() < 64 else ""
        if 13 <= len(number) <= 19 and luhn(number):
            spans.append(("card", *m.span()))
    for start, end in phones(text):
        if 9 <= len(digits_of(text[start:end])) <= 15:
            spans.append(("phone", start, end))
    return spans


# Generators of candidates

AT = re.compile(r" ?(?:\(at\)|\[at\]|\{at\}|@) ?", re.IGNORECASE)
HOST = re.compile(r"[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]|\{dot\}|\.) ?[A-Za-z0-9-]++)++", re.IGNORECASE)
DOTTED = re.compile(r"(?<![0-9])[0-9]{1,3}(?: ?\[\.\] ?|\.)[0-9]{1,3}(?: ?\[\.\] ?|\.)[0-9]{1,3}(?: ?\[\.\] ?|\.)[0-9]{1,3}(?![0-9])")
NUMBERS = re.compile(r"[0-9]++(?:[ .\-()/]{1,2}[0-9]++)*+")
GROUP = re.compile(r"[0-9]+")


def addresses(text: str) -> list[tuple[int, int]]:
    """Written addresses from left to right: the whole run before a sign that a host follows."""
    found, free = [], 0
    for m in AT.finditer(text):
        host = HOST.match(text, m.end())
        start = m.start()
        while host and start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            found.append((start, host.end()))
            free = host.end()
    return found


def candidates(text: str) -> list[Span]:
    """Spans that might be personal data; they overlap, and most are none."""
    numbers = [(kind, s, e) for kind, _, starts, ends, _ in number_candidates([text]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
    return [*plain_candidates(text), *numbers]


def plain_candidates(text: str) -> list[Span]:
    """Those of emails and ips, which don't overlap within a kind."""
    lower = text.lower()
    spans: list[Span] = []
    if "@" in text or "(at)" in lower or "[at]" in lower or "{at}" in lower:
        spans += [("email", *s) for s in addresses(text)]
    return spans + [("ip", *m.span()) for m in DOTTED.finditer(text)]


KEYWORDS = {
    "email": ("mail", "contact", "write", "address"),
    "ip": ("ip", "host", "server", "addr", "login"),
    "card": ("card", "visa", "pay", "credit"),
    "phone": ("tel", "phone", "call", "mobile", "fax"),
}
AGAINST = ("version", "order", "isbn", "ref", "id", "token", "key", "date", "v")


#: Signs before or after a span that speak of keys and names.
JOINING = ("_", "/", "=", '"')


def said_before(text: str, kind: str, start: int) -> tuple[float, float]:
    """Whether one of the three words before speaks for the kind, or against all."""
    words = re.findall(r"[a-z]+", text[max(0, start - 24) : start].lower())[-3:]
    return float(any(w in k for k in words for w in KEYWORDS[kind])), float(any(k in AGAINST for k in words))


def at_start(text: str, kind: str, start: int) -> tuple[float, ...]:
    """What the place where a span begins tells: signs, joined letters, words, digits before it."""
    before = text[start - 1 : start]
    return (
        float(text.startswith("+", start)),
        float(text.startswith("(", start)),
        float(before.isalnum() or before in JOINING or before == "#"),
        *said_before(text, kind, start),
        float(before.isdigit()),
        float(any(c.isdigit() or c == "+" for c in text[max(0, start - 3) : start])),
    )


def at_end(text: str, end: int) -> tuple[float, ...]:
    after = text[end : end + 1]
    return float(after.isalnum() or after in JOINING), float(after.isdigit()), float(any(c.isdigit() for c in text[end : end + 3]))


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of a candidate."""
    span = text[start:end]
    number = digits_of(span)
    groups = [len(g) for g in GROUP.findall(span)]
    parts = [int(p) for p in GROUP.findall(span)[:4]] if kind == "ip" and len(span) < 64 else [0]
    tail = re.split(r"[.)\]}]", span)[-1].strip() if kind == "email" else ""
    plus, paren, joined_before, speaks, against, digit_before, near_before = at_start(text, kind, start)
    joined_after, digit_after, near_after = at_end(text, end)
    return [
        len(number),
        len(groups),
        max(groups, default=0),
        min(groups, default=0),
        groups[-1] if groups else 0,
        float(13 <= len(number) <= 19 and luhn(number)),
        float(number[:1] in ("3", "4", "5", "6")),
        plus,
        paren,
        span.count("-"),
        span.count(" "),
        span.count("."),
        span.count("/"),
        max(parts),
        joined_before,
        joined_after,
        speaks,
        against,
        len(tail),
        float(tail.isalpha()),
        float("@" in span or "at" in span.lower()),
        float(digit_before or digit_after),
        near_before,
        near_after,
    ]


#: Digit groups whose candidates are made at a time, and the most digits of a candidate.
GROUPS, DIGITS = 1 << 12, 19


def number_candidates(texts: list[str]) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``kind, number of the text, start, end, features`` of cards and phones, some groups of digits at a time.

    The features are those of ``features``, from running sums over the groups.
    """
    rows = [
        (n, chain, g.start(), g.end())
        for n, text in enumerate(texts)
        for chain, m in enumerate(NUMBERS.finditer(text))
        for g in GROUP.finditer(text, m.start(), m.end())
    ]
    if not rows:
        return
    own, chain, start, end = (np.array(c, np.int64) for c in zip(*rows, strict=True))
    size = end - start
    # Only the first digits of a long group can matter: none is in a candidate.
    digits = np.frombuffer("".join(texts[n][s : min(e, s + DIGITS + 1)] for n, _, s, e in rows).encode(), np.uint8).astype(np.int64) - 48
    kept = np.minimum(size, DIGITS + 1)
    first = np.cumsum(kept) - kept
    doubled = 2 * digits - 9 * (digits > 4)
    odd = np.arange(len(digits)) % 2 == 1
    #: Running sums by whether the last digit of a number stands at an odd place.
    sums = [np.concatenate(([0], np.cumsum(np.where(odd == last, digits, doubled)))) for last in (False, True)]
    between = [texts[n][e : min(s, e + 2)] if n == m else "" for (n, _, _, e), (m, _, s, _) in zip(rows, rows[1:], strict=False)]
    signs = [np.concatenate(([0], np.cumsum([g.count(c) for g in between]))).astype(np.int64) for c in "- ./"]
    for low in range(0, len(rows), GROUPS):
        i = np.arange(low, min(low + GROUPS, len(rows)))
        total, most, least = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64), np.full(len(i), 1 << 62)
        found: dict[str, list] = {"card": [], "phone": []}
        for k in range(DIGITS):
            alive = i + k < len(rows)
            i, total, most, least = i[alive], total[alive], most[alive], least[alive]
            j = i + k
            total = total + size[j]
            alive = (total <= DIGITS) & (own[j] == own[i]) & (chain[j] == chain[i])
            if not alive.any():
                break
            i, j, total, most, least = i[alive], j[alive], total[alive], np.maximum(most[alive], size[j][alive]), np.minimum(least[alive], size[j][alive])
            a, b = first[i], first[j] + size[j]
            check = np.where((b - 1) % 2 == 1, sums[1][b] - sums[1][a], sums[0][b] - sums[0][a])
            good = (total >= 13) & (check % 10 == 0)
            for kind, which in (("card", good), ("phone", (total >= 7) & (total <= 15))):
                at, to = i[which], j[which]
                columns = [total[which], np.full(len(at), k + 1), most[which], least[which], size[to], good[which], (digits[a[which]] >= 3) & (digits[a[which]] <= 6)]
                found[kind].append((at, to, np.array([*columns, *[c[to] - c[at] for c in signs]], float)))
        for kind, parts in found.items():
            if not parts:
                continue
            at, to, inner = (np.concatenate([p[c] for p in parts], axis=-1) for c in range(3))
            if not len(at):
                continue
            begins, back = np.unique(at, return_inverse=True)
            starts = start[begins]
            if kind == "phone":
                starts = np.array([opened(texts[n], s) for n, s in zip(own[begins].tolist(), starts.tolist(), strict=True)])
            before = np.array([at_start(texts[n], kind, s) for n, s in zip(own[begins].tolist(), starts.tolist(), strict=True)]).T[:, back]
            stops, forth = np.unique(to, return_inverse=True)
            after = np.array([at_end(texts[n], e) for n, e in zip(own[stops].tolist(), end[stops].tolist(), strict=True)]).T[:, forth]
            zero = np.zeros(len(at))
            x = np.array([
                *inner[:7], before[0], before[1], *inner[7:], zero, before[2], after[0], before[3], before[4], zero, zero, zero,
                np.maximum(before[5], after[1]), before[6], after[2],
            ]).T
            yield kind, own[at], starts[back], end[to], x


def opened(text: str, start: int) -> int:
    """Where a phone begins whose first digit is at ``start``: a bracket and a plus before it belong to it."""
    if start and text[start - 1] == "(":
        start -= 1
    if start and text[start - 1] == "+":
        start -= 1
    return start


class Trees:
    """Gradient-boosted regression trees of depth 3 for the logistic loss."""

    def __init__(self, rounds: int = 40, rate: float = 0.3, depth: int = 3, least: int = 8):
        self.rounds, self.rate, self.depth, self.least = rounds, rate, depth, least
        self.trees: list[list[tuple[int, float, float]]] = []
        self.start = 0.0

    def grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, node: int, tree: list) -> None:
        """Fill ``tree`` (children of node n at 2n+1 and 2n+2) with (feature, cut, value)."""
        value = g[rows].sum() / (h[rows].sum() + 1.0)
        tree[node] = (-1, 0.0, value)
        if node >= 2**self.depth - 1:
            return
        best = (1e-6, -1, 0.0)
        whole = g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
        for f in range(x.shape[1]):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v = x[order, f]
            gs, hs = np.cumsum(g[order]), np.cumsum(h[order])
            cut = np.flatnonzero(v[1:] > v[:-1])
            cut = cut[(cut + 1 >= self.least) & (len(order) - cut - 1 >= self.least)]
            if len(cut):
                gain = gs[cut] ** 2 / (hs[cut] + 1) + (gs[-1] - gs[cut]) ** 2 / (hs[-1] - hs[cut] + 1) - whole
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, float(v[cut[k]] + v[cut[k] + 1]) / 2)
        if best[1] >= 0:
            tree[node] = (best[1], best[2], value)
            left = x[rows, best[1]] <= best[2]
            self.grow(x, g, h, rows[left], 2 * node + 1, tree)
            self.grow(x, g, h, rows[~left], 2 * node + 2, tree)

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Trees":
        p = y.mean() * 0.998 + 0.001
        self.start = float(np.log(p / (1 - p)))
        score = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree = [(-1, 0.0, 0.0)] * (2 ** (self.depth + 1) - 1)
            self.grow(x, y - p, p * (1 - p), np.arange(len(y)), 0, tree)
            self.trees.append(tree)
            score += self.rate * self.leaf(tree, x)
        return self

    def leaf(self, tree: list, x: np.ndarray) -> np.ndarray:
        feature, cut, value = (np.array(c) for c in zip(*tree, strict=True))
        for n in range(2**self.depth - 1):  # below a leaf its value stays
            if feature[n] < 0:
                feature[2 * n + 1 : 2 * n + 3], value[2 * n + 1 : 2 * n + 3] = -1, value[n]
        node = np.zeros(len(x), np.int64)
        for level in range(self.depth):
            inner = range(2**level - 1, 2 ** (level + 1) - 1)
            right = np.array([x[:, feature[n]] > cut[n] if feature[n] >= 0 else np.zeros(len(x), bool) for n in inner])
            node = 2 * node + 1 + right[node - inner.start, np.arange(len(x))]
        return value[node]

    def probability(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.start)
        for tree in self.trees:
            score += self.rate * self.leaf(tree, x)
        return 1 / (1 + np.exp(-score))


def example(rng: random.Random) -> tuple[str, list[Span]]:
    """A snippet of invented prose with one thing in it, and its personal spans."""

    def word() -> str:
        return "".join(rng.choice("bcdfghjklmnprstvz") + rng.choice("aeiouéäñ") for _ in range(rng.randint(1, 4)))

    def number(n: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(n))

    def checked(n: int, good: bool) -> str:
        while luhn(x := rng.choice("3456") + number(n - 1)) != good:
            pass
        return x

    def spaced(x: str, sep: str) -> str:
        return sep.join(x[i : i + 4] for i in range(0, len(x), 4))

    hexed = "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice((18, 32, 40))))
    phone = rng.choice(("({a}) {b}-{c}", "{a}-{b}-{c}", "{a}.{b}.{c}", "{a} {b} {c}")).format(a=number(3), b=number(3), c=number(4))
    at, dot = rng.choice(((" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", " [dot] "), ("@", ".")))
    things = [
        ("email", f"{word()}{rng.choice(('', '.' + word(), number(2)))}{at}{word()}{dot}{rng.choice(('com', 'org', 'net', 'example'))}"),
        ("ip", rng.choice((".", "[.]")).join(str(rng.randint(0, 255)) for _ in range(4))),
        ("card", rng.choice((str, lambda x: spaced(x, " "), lambda x: spaced(x, "-")))(checked(rng.choice((13, 15, 16, 16, 16, 19)), True))),
        ("phone", rng.choice(("", "", "+1 ", "+49 ", "+")) + phone),
        ("phone", f"+{rng.randint(1, 99)} {number(rng.randint(2, 4))} {number(rng.randint(5, 7))}"),
        (None, checked(16, False)),
        (None, spaced(checked(16, False), " ")),
        (None, f"{rng.choice(('token', 'key', 'id'))} = \"{hexed}\""),
        (None, f"password={hexed}"),
        (None, f"AKIA{''.join(rng.choice('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') for _ in range(16))}"),
        (None, f"version {rng.randint(0, 20)}.{rng.randint(0, 30)}.{rng.randint(0, 99)}"),
        (None, f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}"),
        (None, f"{rng.randint(1, 28):02}/{rng.randint(1, 12):02}/{rng.randint(1900, 2030)}"),
        (None, f"{rng.choice(('order', 'ref', 'isbn', 'id'))} {number(rng.randint(7, 15))}"),
        (None, number(rng.randint(7, 15))),
        (None, f"{number(3)},{number(3)},{number(3)}"),
        (None, f"{rng.randint(256, 999)}.{rng.randint(0, 999)}.{rng.randint(256, 999)}.{rng.randint(0, 999)}"),
        (None, f"{number(2)} {number(3)} {number(2)} {number(3)}"),
        (None, f"@{word()} {word()} at {word()}"),
    ]
    kind, thing = rng.choice(things)
    lead = " ".join(word() for _ in range(rng.randint(0, 4)))
    if kind and rng.random() < 0.3:
        lead += " " + rng.choice(KEYWORDS[kind]) + rng.choice((":", "", " is"))
    if kind == "card" and rng.random() < 0.15:
        lead += f" {rng.randint(1, 99)}"
    lead += " " if lead else ""
    text = lead + thing + rng.choice(("", ".", ",", " ")) + (" " + word() if rng.random() < 0.8 else "")
    return text, [(kind, len(lead), len(lead) + len(thing))] if kind else []


def rewritten(kind: str, span: str, rng: random.Random) -> tuple[str, int]:
    """A validated span in a form that the base rules miss, and where it begins in what is returned."""
    if kind == "email":
        at, dot = rng.choice(((" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", " [dot] ")))
        name, domain = span.split("@", 1)
        return name + at + domain.replace(".", dot), 0
    if kind == "ip":
        return span.replace(".", "[.]"), 0
    if kind == "card":
        number = digits_of(span)
        stray = f"{rng.randint(1, 99)} "
        return stray + " ".join(number[i : i + 4] for i in range(0, len(number), 4)), len(stray)
    number = span.lstrip("+")
    return rng.choice((number, number.split(" ", 1)[-1])), 0


def fails_checks(text: str, start: int, end: int) -> bool:
    """Whether a run of digits is surely none of the kinds: in a key or word, or of a card's length but failing its sum."""
    inside = text[start - 1 : start].isalnum() or text[end : end + 1].isalnum()
    number = digits_of(text[start:end])
    return inside or (13 <= len(number) <= 19 and not luhn(number))


#: Characters kept on either side of a place.
AROUND = 80


def places(text: str) -> list[tuple[str, str, int, int]]:
    """``window, kind, start, end`` of validated spans and, with kind none, of numbers that fail the checks."""
    found = base_spans(text)
    taken = covered(text, found)
    for m in NUMBERS.finditer(text):
        if m.end() - m.start() <= AROUND and 1 not in taken[m.start() : m.end()] and fails_checks(text, *m.span()):
            found.append(("none", *m.span()))
    out = []
    for kind, start, end in found:
        if end - start <= AROUND:
            low = max(0, start - AROUND)
            out.append((text[low : end + AROUND], kind, start - low, end - low))
    return out


def covered(text: str, spans: list[Span]) -> bytearray:
    """For each character, 1 if a span holds it."""
    out = bytearray(len(text))
    for _, start, end in spans:
        out[start:end] = b"\1" * (end - start)
    return out


def place_hash(place: tuple[str, str, int, int]) -> int:
    return zlib.crc32("\0".join(map(str, place)).encode())


def drawn_places(docs: DataFrame, fit_rows: int) -> list[tuple[str, str, int, int]]:
    """At most ``fit_rows`` places of the documents, those of the least hashes.

    Places are counted first; then tasks pass on those whose hashes are below a share, so that about
    half as many again come to the driver, whatever the number of documents. Equal places count as
    one: of a table with many copies fewer are drawn.
    """
    texts = docs.select(whole_text(docs).alias("text")).where(F.col("text").rlike("[0-9@]"))

    def count(batches):
        for batch in small_batches(batches, rows=4000, mb=16):
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(places(t)) for t in batch["text"].to_pylist())])], ["n"])

    total = texts.mapInArrow(count, "n long").agg(F.sum("n").alias("n")).first()["n"] or 0
    below = int(min(1.0, 1.5 * fit_rows / max(total, 1)) * (1 << 32))

    def run(batches):
        for batch in small_batches(batches, rows=4000, mb=16):
            found = [p for t in batch["text"].to_pylist() for p in places(t) if place_hash(p) < below]
            columns = zip(*found, strict=True) if found else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int32()), strict=True)], ["window", "kind", "start", "end"])

    drawn = [tuple(r) for r in texts.mapInArrow(run, "window string, kind string, start int, end int").distinct().collect()]
    return sorted(drawn, key=lambda p: (place_hash(p), p))[:fit_rows]


def examined(texts: list[str]) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``kind, number of the text, start, end, features`` of all candidates of some texts."""
    plain: dict[str, list[tuple[int, int, int]]] = {"email": [], "ip": []}
    for n, text in enumerate(texts):
        for kind, start, end in plain_candidates(text) if text else ():
            plain[kind].append((n, start, end))
    for kind, spans in plain.items():
        for low in range(0, len(spans), GROUPS):
            own = spans[low : low + GROUPS]
            yield kind, *np.array(own).T, np.array([features(texts[n], kind, s, e) for n, s, e in own], float)
    yield from number_candidates(texts)


class Calibrated(dict):
    """Trees and threshold of each kind; ``report`` has what the kept third of the documents' places gave."""

    report: list[tuple[str, float, float, float, int]] = []


def threshold_of(p: np.ndarray, truth: np.ndarray, precision: float) -> float:
    """The least probability from which on the asked share of candidates are right."""
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(truth[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(right >= precision)
    return float(p[order][good[-1]]) if len(good) else 1.0


def trained(examples: int = 6000, seed: int = 5, precision: float = 0.97, drawn: tuple = ()) -> Calibrated:
    """Trees and thresholds from synthetic snippets and from ``drawn_places``; two in three are for the trees."""
    rng = random.Random(seed)
    texts, asked = [], []  # of each text its true spans, the kinds and the stretch that are looked at, and its use
    for n in range(examples):
        text, spans = example(rng)
        texts.append(text)
        asked.append((spans, KINDS, (0, len(text)), n % 3 > 0, False))
    for n, (window, kind, start, end) in enumerate(drawn):
        text, truth = window, []
        if kind != "none":
            new, at = rewritten(kind, window[start:end], rng)
            text, truth = window[:start] + new + window[end:], [(kind, start + at, start + len(new))]
            end = start + len(new)
        texts.append(text)
        asked.append((truth, KINDS if kind == "none" else (kind,), (start, end), n % 3 > 0, True))
    rows: dict[str, list] = {k: [] for k in KINDS}
    for kind, number, starts, ends, x in examined(texts):
        for n, start, end, values in zip(number.tolist(), starts.tolist(), ends.tolist(), x, strict=True):
            truth, kinds, (low, high), use, own = asked[n]
            if kind in kinds and start < high and low < end:
                rows[kind].append((use, own, float((kind, start, end) in truth), values))
    models = Calibrated()
    models.report = []
    for kind, found in rows.items():
        use, own, y, x = (np.array(c) for c in zip(*found, strict=True))
        trees = Trees().fit(x[use], y[use])
        p = trees.probability(x)
        sets = [~use & ~own, ~use & own]
        threshold = max([0.5, *[threshold_of(p[s], y[s], precision) for s in sets if y[s].any()]])
        models[kind] = (trees, threshold)
        taken, truth = p[sets[1]] >= threshold, y[sets[1]] == 1
        right = int((taken & truth).sum())
        models.report.append((kind, threshold, right / max(int(taken.sum()), 1), right / max(int(truth.sum()), 1), int(truth.sum())))
    return models


@functools.cache
def from_snippets() -> Calibrated:
    return trained()


FIT_ROWS = 3000


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS) -> Calibrated:
    """Trees and thresholds for these documents; from the snippets alone where no place is drawn."""
    drawn = drawn_places(docs, fit_rows)
    return trained(drawn=tuple(drawn)) if drawn else from_snippets()


def calibration(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``kind, threshold, precision, recall, spans``: on the places of ``docs`` that the trees haven't seen."""
    report = fit(docs, fit_rows).report
    return docs.sparkSession.createDataFrame(report, "kind string, threshold double, precision double, recall double, spans long")


def find_spans(texts: list[str], models: dict[str, tuple[Trees, float]]) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and all spans of each text; candidates of all texts are scored together."""
    base = [base_spans(t) if t else [] for t in texts]
    found = [list(spans) for spans in base]
    likely: list[tuple[float, int, int, int, str]] = []
    for kind, number, starts, ends, x in examined(texts):
        trees, threshold = models[kind]
        p = trees.probability(np.asfortranarray(x))
        good = np.flatnonzero(p >= threshold)
        likely += [(-p[i], int(number[i]), int(starts[i]), int(ends[i]), kind) for i in good]
    # A kind after the other, the likelier first; a span that overlaps one that is there goes.
    likely.sort(key=lambda c: (KINDS.index(c[4]), *c))
    taken: dict[int, bytearray] = {}
    for _, n, start, end, kind in likely:
        if n not in taken:
            taken[n] = covered(texts[n], base[n])
        if 1 not in taken[n][start:end]:
            taken[n][start:end] = b"\1" * (end - start)
            found[n].append((kind, start, end))
    place = {k: i for i, k in enumerate(KINDS)}
    return [(b, sorted(f, key=lambda s: (place[s[0]], s[1], s[2]))) for b, f in zip(base, found, strict=True)]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


#: What a text must hold to have a candidate.
SIGNS = r"(?i)[0-9@]|\(at\)|\[at\]|\{at\}"


def detect(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``: one row for each row."""
    spark = docs.sparkSession
    models = spark.sparkContext.broadcast(fit(docs, fit_rows))
    none = hashlib.sha256(b"").hexdigest()

    def run(batches):
        for batch in small_batches(batches, rows=4000, mb=16):
            may = pc.match_substring_regex(batch["text"], SIGNS)
            some = np.flatnonzero(may.to_numpy(zero_copy_only=False))
            counts = np.zeros((len(KINDS), len(batch)), np.int64)
            sha, spans = [none] * len(batch), [""] * len(batch)
            found = find_spans(batch["text"].take(pa.array(some)).to_pylist(), models.value)
            for n, (base, every) in zip(some.tolist(), found, strict=True):
                for kind, _, _ in base:
                    counts[KINDS.index(kind), n] += 1
                sha[n] = hashlib.sha256(joined(base).encode()).hexdigest()
                spans[n] = joined(every)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *map(pa.array, counts), pa.array(sha), pa.array(spans)],
                ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(docs).alias("text"))
    return rows.mapInArrow(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    )


def redacted(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``docs`` with its text's spans replaced by ``<kind>``; all columns stay."""
    models = docs.sparkSession.sparkContext.broadcast(fit(docs, fit_rows))

    @F.arrow_udf("string")
    def redact(texts: pa.Array) -> pa.Array:
        out = []
        for text, (_, spans) in zip(texts.to_pylist(), find_spans(texts.to_pylist(), models.value), strict=True):
            free, pieces = 0, []
            for kind, start, end in sorted(spans, key=lambda s: s[1:]):
                if start >= free:
                    pieces += [text[free:start], f"<{kind}>"]
                free = max(free, end)
            out.append("".join([*pieces, text[free:]]))
        return pa.array(out, pa.string())

    return docs.withColumn("text", redact(whole_text(docs)))

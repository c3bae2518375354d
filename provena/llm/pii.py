"""Personal data: exact base patterns, and a semi-Markov conditional random field for the forms they do not cover.

Base: e-mail addresses, IPv4 addresses, card numbers with a valid check digit, international phone numbers. The field looks at
islands of text that could hold such data and are not base spans: number-like runs and spelled-out addresses. An island is a
row of tokens; candidate segments of up to ``MAX_TOKENS`` tokens are scored as wholes (digits, groups, separators, check
digit, octets, context), and a dynamic program chooses boundaries and types of all entities of the island jointly.

It is trained here: base spans of a bounded sample of documents are rewritten into the forms people use to write such data
otherwise (silver labels), and broken ones (wrong check digits, octets out of range, plain numbers) are what is no entity.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.session import written_table

KINDS = ["email", "ip", "card", "phone"]
MAX_TOKENS = 32
#: Tokens of an island decoded at once; the next stretch begins after the last entity that begins in this one.
STRETCH = 512

# The base patterns. A digit or plus that a longer run of digits holds starts no match of its own, so the
# patterns look for the start of a run first, which leaves the matches as they are and the search linear.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Islands: number-like runs of seven digits or more, and addresses whose signs are spelled out.
NUMBERS = re.compile(r"(?<![\w.@])[+(]?\d(?:[ ().\-/\[\]]{0,3}\d){6,}(?![\w@])")
SPELLED = re.compile(
    r"(?<![\w.%+-])[A-Za-z0-9][\w.%+-]{0,63} ?(?:\(at\)|\[at\]|\{at\}| at |@) ?[A-Za-z0-9-]{1,63}"
    r"(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}| dot ) ?[A-Za-z0-9-]{1,24}){1,4}"
)
MARKS = ("(at)", "[at]", "{at}", "(dot)", "[dot]", "{dot}", " dot ")
TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s+|.", re.S)
LABELS = ["O", *KINDS]
#: Number-like runs with more digits are looked at beside the base spans in them too; a shorter one goes with its base span.
LONG = 41


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base spans by start, then kind as listed; code points, end exclusive."""
    out = []
    end, at = 0, text.find("@")
    while at >= 0:
        s = at
        while s > end and text[s - 1] in LOCAL:
            s -= 1
        m = DOMAIN.match(text, at) if s < at else None
        if m:
            out.append((s, m.end(), "email"))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    if any(c in text for c in "0123456789"):
        for m in IP.finditer(text):
            if all(len(p := q.lstrip("0")) <= 3 and int(p or 0) <= 255 for q in m[0].split(".")):
                out.append((m.start(), m.end(), "ip"))
        for m in CARD.finditer(text):
            if m.end() - m.start() <= 37 and 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(digits_of(m[0])) <= 15:
                    out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def islands(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """(start, end) of the places the field looks at: outside the base spans, in order, without overlaps."""
    found = []
    if any(c in text for c in "0123456789"):
        found += [m.span() for m in NUMBERS.finditer(text)]
    low = text.lower()
    if any(m in low for m in MARKS):
        found += [m.span() for m in SPELLED.finditer(text)]
    out: list[tuple[int, int]] = []
    starts, reach = [a for a, _, _ in taken], [*accumulate((b for _, b, _ in taken), max)]
    for s, e in sorted(found):
        i = bisect_left(starts, e)
        if i and reach[i - 1] > s:
            if len(digits_of(text[s:e])) > LONG:
                out += outside(text, s, e, taken[:i])
            continue
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def outside(text: str, s: int, e: int, taken: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """What base spans leave of a long number-like run, where it has seven digits or more."""
    out, last = [], s
    for a, b, _ in [*((a, b, k) for a, b, k in taken if b > s), (e, e, "")]:
        digits = [m.start() for m in re.finditer("[0-9]", text[last:a])] if a > last else []
        if len(digits) >= 7:
            out.append((last + digits[0], last + digits[-1] + 1))
        last = max(last, b)
    return out


def tokens_of(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in TOKEN.finditer(text)]


FEATURES = [
    "bias", "digits<7", "digits7-8", "digits9-11", "digits12-15", "digits16", "digits17-19", "digits>19", "one group", "two groups",
    "three groups", "four groups", "more groups", "spaces", "hyphens", "dots", "brackets", "slashes", "starts plus", "starts 00",
    "check digit", "four octets", "groups 3-3-4", "groups of 4", "at sign", "at word", "dot word", "letters", "ends in letters",
    "letters without at", "touches letters or digits", "open bracket", "context digit",
]
INDEX = {f: i for i, f in enumerate(FEATURES)}


def span_features(text: str, s: int, e: int, before: str, after: str) -> list[int]:
    """Features of the whole segment ``text[s:e]`` with the characters around it."""
    span = text[s:e]
    low = span.lower()
    groups = re.findall(r"[0-9]+", span)
    d = "".join(groups)
    n = len(d)
    out = ["bias"]
    out.append(
        "digits<7" if n < 7 else "digits7-8" if n < 9 else "digits9-11" if n < 12 else "digits12-15" if n < 16 else "digits16" if n == 16
        else "digits17-19" if n < 20 else "digits>19"
    )
    out.append(["one group", "one group", "two groups", "three groups", "four groups"][len(groups)] if len(groups) < 5 else "more groups")
    flags = {
        "spaces": " " in span, "hyphens": "-" in span, "dots": "." in span, "brackets": "(" in span or "[" in span, "slashes": "/" in span,
        "starts plus": span[0] == "+", "starts 00": d[:2] == "00" and span[:1] == "0", "check digit": 12 <= n <= 19 and luhn(d),
        "four octets": len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups),
        "groups 3-3-4": [len(g) for g in groups[-3:]] == [3, 3, 4], "groups of 4": len(groups) > 2 and all(len(g) == 4 for g in groups[:-1]),
        "at sign": "@" in span, "at word": bool(re.search(r"[(\[{]at[)\]}]| at ", low)), "dot word": bool(re.search(r"[(\[{]dot[)\]}]| dot ", low)),
        "letters": bool(re.search(r"[a-z]", low)), "ends in letters": bool(re.search(r"[a-z]{2,}$", low)),
        "touches letters or digits": bool(before[-1:].isalnum() or after[:1].isalnum()), "open bracket": span.count("(") != span.count(")"),
        "context digit": bool(re.search(r"[0-9]", before[-3:] + after[:3])),
    }
    flags["letters without at"] = flags["letters"] and not (flags["at sign"] or flags["at word"])
    out += [k for k, v in flags.items() if v]
    return [INDEX[f] for f in out]


@dataclass
class Lattice:
    """Tokens of an island and the features of its candidate segments: (first token, end token) -> features."""

    tokens: list[tuple[int, int]]
    segments: dict[tuple[int, int], list[int]]


def lattice(text: str, s: int, e: int) -> Lattice:
    island = text[s:e]
    toks = tokens_of(island)
    segments = {}
    for i, (a, _) in enumerate(toks):
        if island[a].isspace():
            continue
        for j in range(i + 1, min(i + MAX_TOKENS, len(toks)) + 1):
            b = toks[j - 1][1]
            if not island[b - 1].isspace() and b - a >= 7:
                segments[i, j] = span_features(island, a, b, text[max(0, s + a - 20) : s + a], text[s + b : s + b + 20])
    return Lattice(toks, segments)


def scores(lat: Lattice, w: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """Score of each segment for each kind: an address needs its sign, spelled out or not, and numbers hold no letters."""
    out = {}
    for k, f in lat.segments.items():
        s = w[:, f].sum(1)
        if INDEX["at sign"] not in f and INDEX["at word"] not in f:
            s[0] = -np.inf
        if INDEX["letters"] in f:
            s[1:] = -np.inf
        out[k] = s
    return out


def decode(lat: Lattice, w: np.ndarray, follow: np.ndarray) -> list[tuple[int, int, int]]:
    """The best row of segments (first token, end token, label); label 0, no entity, takes one token."""
    n, k = len(lat.tokens), len(LABELS)
    s = scores(lat, w)
    best = np.full((n + 1, k), -np.inf)
    best[0, 0] = 0
    back: dict[tuple[int, int], tuple[int, int]] = {}
    by_end: dict[int, list[int]] = {}
    for i, j in s:
        by_end.setdefault(j, []).append(i)
    for j in range(1, n + 1):
        best[j, 0], prev = max((best[j - 1, p] + follow[p, 0], p) for p in range(k))
        back[j, 0] = (j - 1, prev)
        for i in by_end.get(j, ()):
            for y in range(1, k):
                v, prev = max((best[i, p] + follow[p, y] + s[i, j][y - 1], p) for p in range(k))
                if v > best[j, y]:
                    best[j, y], back[j, y] = v, (i, prev)
    out, at = [], (n, int(best[n].argmax()))
    while at[0] > 0:
        i, prev = back[at]
        if at[1]:
            out.append((i, at[0], at[1]))
        at = (i, prev)
    return out[::-1]


def gradient(lat: Lattice, gold: list[tuple[int, int, int]], w: np.ndarray, follow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the log-likelihood of ``gold``: counts of its features and transitions less the expected ones."""
    n, k = len(lat.tokens), len(LABELS)
    s = scores(lat, w)
    steps = [(j - 1, j, 0, 0.0) for j in range(1, n + 1)]
    steps += [(i, j, y, float(v[y - 1])) for (i, j), v in s.items() for y in range(1, k)]
    steps.sort(key=lambda x: x[1])
    forward = np.full((n + 1, k), -np.inf)
    forward[0, 0] = 0
    for i, j, y, v in steps:
        forward[j, y] = np.logaddexp(forward[j, y], np.logaddexp.reduce(forward[i] + follow[:, y]) + v)
    backward = np.full((n + 1, k), -np.inf)
    backward[n] = 0
    for i, j, y, v in sorted(steps, key=lambda x: -x[0]):
        backward[i] = np.logaddexp(backward[i], follow[:, y] + v + backward[j, y])
    total = np.logaddexp.reduce(forward[n])
    gw, gf = np.zeros_like(w), np.zeros_like(follow)
    for i, j, y, v in steps:
        p = np.exp(forward[i] + follow[:, y] + v + backward[j, y] - total)
        gf[:, y] -= p
        if y:
            gw[y - 1, lat.segments[i, j]] -= p.sum()
    at, prev = 0, 0
    chosen = {i: (j, y) for i, j, y in gold}
    while at < n:
        j, y = chosen.get(at, (at + 1, 0))
        gf[prev, y] += 1
        if y:
            gw[y - 1, lat.segments[at, j]] += 1
        at, prev = j, y
    return gw, gf


def variants(kind: str, span: str, rng: np.random.Generator) -> list[tuple[str, bool]]:
    """Other ways to write a base span, and near misses that are none: (text, whether it is still an entity)."""
    pick = lambda *xs: xs[int(rng.integers(len(xs)))]
    d = digits_of(span)
    if kind == "email":
        at, dot = pick(" [at] ", "[at]", "(at)", " (at) ", " at "), pick(" [dot] ", "[dot]", "(dot)", " dot ")
        name, host = span.split("@", 1)
        return [(name + at + host.replace(".", dot), True), (name + pick("[at]", "(at)", " (at) ") + host, True)]
    if kind == "ip":
        p = d and span.split(".")
        return [(pick("[.]", " . ", "(.)").join(p), True), (pick("[.]", " . ").join([str(int(p[0]) + 300), *p[1:]]), False)]
    if kind == "card":
        four = [d[i : i + 4] for i in range(0, len(d), 4)]
        wrong = d[:-1] + str((int(d[-1]) + int(rng.integers(1, 9))) % 10)
        return [
            (pick(".", "/", " - ").join(four), True), (wrong, False),
            (pick(" ", "-", ".").join(wrong[i : i + 4] for i in range(0, len(wrong), 4)), False),
        ]
    local = d[-10:]
    return [
        (f"({local[:3]}) {local[3:6]}-{local[6:]}", True), (f"{local[:3]}{pick('-', '.')}{local[3:6]}{pick('-', '.')}{local[6:]}", True),
        (f"00{pick('1', '44', '49')} {local[:3]} {local[3:6]} {local[6:]}", True), (local, False), (d[-7:], False), (f"{d[:4]}-{d[4:6]}-{d[6:8]}", False),
        (f"{d[:2]}/{d[2:4]}/{d[4:8]}", False), (f"{d[:3]}.{d[3:6]}", False), (d + local, False),
    ]


@dataclass(frozen=True)
class PiiModel:
    weights: list[list[float]]
    follow: list[list[float]]

    def spans(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """(key, base, spans) of every row: ``base`` and all spans as arrays of (kind, start, end), by start, then kind as listed.

        A null text is an empty one. Added spans never overlap base ones. Texts are read whole.
        """
        weights, follow = self.weights, self.follow
        kind = docs.schema[key].dataType.simpleString()
        item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, f = np.array(weights), np.array(follow)
            known: dict[str, list[tuple[int, int, str]]] = {}
            for batch in batches:
                base, every = [], []
                for t in batch.column(1):
                    t = t.as_py() or ""
                    b = base_spans(t)
                    a = b + [x for s, e in islands(t, b) for x in added(t, s, e, w, f, known)]
                    base.append([{"kind": k, "start": s, "end": e} for s, e, k in b])
                    every.append([{"kind": k, "start": s, "end": e} for s, e, k in sorted(a, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(base, item), pa.array(every, item)], names=["key", "base", "spans"]
                )

        schema = "array<struct<kind:string,start:int,end:int>>"
        return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(found, f"key {kind}, base {schema}, spans {schema}")


def added(text: str, s: int, e: int, w: np.ndarray, follow: np.ndarray, known: dict) -> list[tuple[int, int, str]]:
    """Entities of an island; islands that recur with the same surroundings are decoded once in a task."""
    seen = text[max(0, s - 20) : e + 20]
    if seen not in known:
        toks, got, p = tokens_of(text[s:e]), [], 0
        while p < len(toks):
            # two of the longest segments beyond the stretch, so that what begins in it is seen whole, as is what rivals it
            q = min(p + STRETCH + 2 * MAX_TOKENS, len(toks))
            cut = p + STRETCH if q < len(toks) else q
            at, from_ = toks[p][0], p
            for i, j, y in decode(lattice(text, s + at, s + toks[q - 1][1]), w, follow):
                if from_ + i < cut:
                    got.append((toks[from_ + i][0], toks[from_ + j - 1][1], LABELS[y]))
                    p = from_ + j
            p = max(p, cut)
        if len(known) > 50_000:
            known.clear()
        known[seen] = got
    return [(s + a, s + b, k) for a, b, k in known[seen]]


def train(docs: DataFrame, text: str = "text", rows: int = 100, epochs: int = 5, rate: float = 0.3, penalty: float = 1e-4, seed: int = 9) -> PiiModel:
    """Fit on ``rows`` base spans of each kind at most, taken by the hash of their surroundings. Without any, nothing is added."""

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # each task hands on the spans with the smallest hashes; the smallest of all are among them
        held: list[tuple[str, str, str, str, str]] = []
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    for s, e, k in base_spans(t):
                        around = (k, t[max(0, s - 30) : s], t[s:e], t[e : e + 30])
                        held.append((hashlib.md5("\0".join(around).encode("utf-8", "replace")).hexdigest(), *around))
                    if len(held) > 20_000:
                        held = smallest(held, rows)
        held = smallest(held, rows)
        yield pa.RecordBatch.from_arrays([pa.array([h[i] for h in held], pa.string()) for i in range(5)], names=["h", "k", "a", "s", "b"])

    found = docs.select(F.col(text).alias("t")).mapInArrow(examples, "h string, k string, a string, s string, b string").distinct()
    found = written_table(found)
    top = [found.where(F.col("k") == k).orderBy("h").limit(rows) for k in KINDS]
    picked = [tuple(r) for t in top for r in t.collect()]
    rng = np.random.default_rng(seed)
    cases: list[tuple[Lattice, list[tuple[int, int, int]]]] = []
    for _, kind, a, span, b in picked:
        for form, good in variants(kind, span, rng):
            whole = a + form + b
            s, e = len(a), len(a) + len(form)
            place = next(((x, y) for x, y in islands(whole, base_spans(whole)) if x <= s and e <= y), None)
            if place is None:
                continue
            lat = lattice(whole, *place)
            gold = []
            if good:
                first = next((i for i, t in enumerate(lat.tokens) if place[0] + t[0] == s), None)
                last = next((i + 1 for i, t in enumerate(lat.tokens) if place[0] + t[1] == e), None)
                if (first, last) not in lat.segments:
                    continue
                gold = [(first, last, LABELS.index(kind))]
            cases.append((lat, gold))
    w, follow = np.zeros((len(KINDS), len(FEATURES))), np.zeros((len(LABELS), len(LABELS)))
    w[:, 0] = -4.0  # an entity has to be earned
    gw, gf = np.full_like(w, 1e-6), np.full_like(follow, 1e-6)
    for _ in range(epochs):
        for c in rng.permutation(len(cases)):
            dw, df = gradient(*cases[c], w, follow)
            dw, df = dw - penalty * w, df - penalty * follow
            gw, gf = gw + dw * dw, gf + df * df
            w, follow = w + rate * dw / np.sqrt(gw), follow + rate * df / np.sqrt(gf)
    return PiiModel(w.tolist(), follow.tolist())


def smallest(held: list[tuple], rows: int) -> list[tuple]:
    held = sorted(set(held))
    return [h for k in KINDS for h in [x for x in held if x[1] == k][:rows]]

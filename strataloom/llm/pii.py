"""Personal data: fixed patterns, and a skip-chain conditional random field.

Patterns find base spans, which always stay. The field labels the tokens of a
document that hold a digit or an at sign (any other token is outside every
entity): a token's own features, the labels beside it, and skip edges between
consecutive occurrences of repeated or similar tokens share potentials, and
loopy message passing finds the marginals over the whole document. Tokens are
similar that have the same letters and digits without case and punctuation, more
than ``SIMILAR`` of them, or the same name before an at sign; and tokens in a
row whose last ``SIMILAR`` + 1 digits are those of tokens in a row elsewhere,
however either is spaced ('+1 (555) 123-4567' and '555 123 4567'), are joined
digit by digit. Tokens of base spans are observed. A token whose marginal for a
kind is at least ``SURE`` becomes a span.

All weights, those of features and the potentials of both kinds of edges, are
learned by maximum pseudo-likelihood: each label given its neighbours' observed
labels. Potentials of skip edges are tied: one for equal kinds, one for none at
both ends, one for a kind and none. Every row with a neighbour is learned a second time with its features
hidden, as if the patterns did not know it, so that edges must explain it. The
rows come from a bounded sample: ``SAMPLE`` tokens at most, of ``SAMPLE`` / 10
documents, both drawn by hash of document and place.

Edge cases: a null text counts as empty and has no spans; very long texts are
searched in time linear in their length, and messages pass until they settle,
``ROUNDS`` times at most; labels whose marginals are equal fall to the kind that
comes first, none before all; repeated rows get the same spans and count once in
the sample; further columns of any name stay as they are in ``redact`` and
unread in ``find``; an empty table gives an empty result; with no sample the
weights are zero and only base spans are found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.common import mapped, slices

KINDS = ("email", "ip", "card", "phone")
#: Token rows that weights are learned from.
SAMPLE = 20_000
SURE = 0.7
#: Messages pass so many times at most; they stop when none changes by more than ``SETTLED``.
ROUNDS, SETTLED = 100, 1e-3
#: Tokens of more letters and digits than this are joined by skip edges, and names before an at sign of more than half.
SIMILAR = 6
#: Digits of a number at most.
LONGEST = 19
#: Tokens whose features are made at a time.
TOKENS = 4096
STEPS, RATE, DECAY = 300, 0.5, 1e-3

# The patterns of the base spans. Starts of the e-mail pattern are
# found from its at sign, so that long words take linear time.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MAYBE_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){12}")
# A candidate starts a token, so that no place inside a long token is tried again.
_CANDIDATE = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+")
_SEPARATORS = re.compile(r"[^0-9A-Za-z@]+")

#: Features of a token; the last says that all others are hidden.
FEATURES = 25
LABELS = 1 + len(KINDS)


class Weights(NamedTuple):
    """Weights of features, and log potentials of labels (left, right) that
    follow each other, and of labels that a skip edge joins."""

    unary: np.ndarray
    follow: np.ndarray
    skip: np.ndarray


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans in the order of ``KINDS``, then of their start."""
    out = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    if "." in text:
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(_small(p) for p in m[0].split("."))]
    if _MAYBE_CARD.search(text):
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def shown(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def features(token: str, before: str) -> list[float]:
    """Shape of a token, and of the word before it."""
    digits = sum("0" <= c <= "9" for c in token)
    letters = sum(c.isalpha() for c in token)
    dots = token.count(".")
    plain = token.strip(".,;:!?()[]<>\"'#*$%&|")
    parts = plain.split(".")
    quads = len(parts) == 4 and all(p.isascii() and p.isdigit() and _small(p) for p in parts)
    only = plain.isascii() and plain.isdigit()
    x = [
        1.0, "@" in token, bool(re.search(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.[A-Za-z0-9]", token)), quads,
        only and 13 <= digits <= 19, only and 13 <= digits <= 19 and luhn(plain), only and 9 <= digits <= 12,
        only and digits <= 2, only and digits == 3, only and digits == 4, only and 5 <= digits <= 8, digits > 19,
        bool(re.fullmatch(r"\+[0-9]{1,3}", plain)), bool(re.fullmatch(r"\([0-9]{2,4}\)", token.strip(".,;:!?"))),
        bool(re.fullmatch(r"[0-9]{3}-[0-9]{4}", plain)), token.startswith("+"), letters > 0, letters > digits,
        dots == 3, "=" in token or '"' in token, "/" in token, "-" in plain,
        bool(re.fullmatch(r"\+[0-9]{1,3}|\([0-9]{2,4}\)", before.strip(".,;:!?"))), before == "", False,
    ]
    return [float(v) for v in x]


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _CANDIDATE.finditer(text)]


def _before(text: str, start: int) -> str:
    stop = start
    while stop > 0 and text[stop - 1] in "\x20\x09\x0a\x0b\x0c\x0d":
        stop -= 1
    least = max(0, stop - 64)
    begin = max(text.rfind(" ", least, stop), text.rfind("\n", least, stop), least - 1) + 1
    return text[begin:stop]


def token_labels(tokens: list[tuple[int, int]], spans: list[tuple[str, int, int]]) -> np.ndarray:
    """0, or 1 + the kind of the first base span that a token meets."""
    labels = np.zeros(len(tokens), np.int64)
    starts = np.array([a for a, _ in tokens], np.int64)
    ends = np.array([b for _, b in tokens], np.int64)
    for kind, a, b in reversed(spans):
        labels[np.searchsorted(ends, a, "right") : np.searchsorted(starts, b, "left")] = 1 + KINDS.index(kind)
    return labels


def skip_edges(keys: list[str]) -> list[tuple[int, int]]:
    """Consecutive occurrences of the same key."""
    last: dict[str, int] = {}
    edges = []
    for i, k in enumerate(keys):
        if k and k in last:
            edges.append((last[k], i))
        last[k] = i
    return edges


def number_edges(digits: list[str], follow: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Edges between tokens in a row and the last ones before that end in the
    same ``SIMILAR`` + 1 digits or more: between the tokens that hold each digit.
    ``digits`` are those of tokens that have no letters, else empty."""
    linked, last, edges = {b for _, b in follow}, {}, set()
    text, owner = "", []
    for i, d in enumerate(digits):
        if i not in linked or not d:
            text, owner = "", []
        # No entity has more digits than a card, so older ones of the row are no longer needed.
        text, owner = (text + d)[-LONGEST:], (owner + [i] * len(d))[-LONGEST:]
        if len(text) > SIMILAR:
            key = text[-SIMILAR - 1 :]
            before, holds = last.get(key, ("", []))
            for c, x, e, y in zip(reversed(before), reversed(holds), reversed(text), reversed(owner), strict=False):
                if c != e:
                    break
                if x < y:
                    edges.add((x, y))
            last[key] = (text, owner)
    return sorted(edges)


def tied(slope: np.ndarray) -> np.ndarray:
    """Skip potentials with the mean of all that are tied."""
    kinds = np.arange(1, LABELS)
    out = np.zeros_like(slope)
    out[0, 0] = slope[0, 0]
    out[kinds, kinds] = slope[kinds, kinds].mean()
    out[0, 1:] = out[1:, 0] = (slope[0, 1:].mean() + slope[1:, 0].mean()) / 2
    return out


def marginals(unary: np.ndarray, follow: list[tuple[int, int]], skip: list[tuple[int, int]], weights: Weights) -> np.ndarray:
    """Loopy belief propagation; log potentials, messages in both directions."""

    def shares(x: np.ndarray) -> np.ndarray:
        p = np.exp(x - x.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    if not follow and not skip:
        return shares(unary)
    left, right = np.array(follow + skip).T
    a, b, n = np.concatenate([left, right]), np.concatenate([right, left]), len(left)
    # A message to the right is weighed by the potentials, one to the left by their transpose.
    ways = np.exp(np.stack([weights.follow, weights.skip, weights.follow.T, weights.skip.T]))
    way = ways[np.repeat([0, 1, 2, 3], [len(follow), len(skip)] * 2)]
    back = np.r_[n : 2 * n, 0:n]
    messages = np.zeros((2 * n, unary.shape[1]))
    for _ in range(ROUNDS):
        belief = unary.copy()
        np.add.at(belief, b, messages)
        out = np.einsum("ej,ejk->ek", shares(belief[a] - messages[back]), way)
        new = np.log(out / out.sum(1, keepdims=True))
        moved = np.abs(new - messages).max()
        messages = new
        if moved < SETTLED:
            break
    belief = unary.copy()
    np.add.at(belief, b, messages)
    return shares(belief)


def learn(rows: list[tuple]) -> Weights:
    """Weights from rows ``(features, labels of neighbours, label)`` by
    pseudo-likelihood. Neighbours: token before and after, occurrence before
    and after; -1 for none."""
    out = Weights(np.zeros((FEATURES, LABELS)), np.zeros((LABELS, LABELS)), np.zeros((LABELS, LABELS)))
    if not rows:
        return out
    x, near, y = (np.array([r[i] for r in rows]) for i in range(3))
    some = (near >= 0).any(1)
    hidden = np.zeros((int(some.sum()), FEATURES))
    hidden[:, -1] = 1
    x, near, y = np.concatenate([x, hidden]), np.concatenate([near, near[some]]), np.concatenate([y, y[some]])
    truth = np.eye(LABELS)[y]
    before, after, *skips = (np.eye(LABELS)[near[:, i]] * (near[:, i] >= 0)[:, None] for i in range(4))
    joined = sum(skips)
    speeds = [np.zeros_like(w) for w in out]
    for _ in range(STEPS):
        z = x @ out.unary + before @ out.follow + after @ out.follow.T + joined @ out.skip
        p = np.exp(z - z.max(1, keepdims=True))
        miss = truth - p / p.sum(1, keepdims=True)
        skip = joined.T @ miss
        for w, speed, slope in zip(out, speeds, (x.T @ miss, before.T @ miss + miss.T @ after, tied((skip + skip.T) / 2)), strict=True):
            speed *= 0.9
            speed += slope / len(y) - DECAY * w
            w += RATE * speed
    return out


class Field:
    """Candidate tokens of a text with their edges, and the labels of base spans."""

    def __init__(self, text: str, base: list[tuple[str, int, int]]):
        self.tokens = candidates(text)
        self.observed = token_labels(self.tokens, base)
        self.words = [text[a:b] for a, b in self.tokens]
        ends = zip(self.tokens, self.tokens[1:], strict=False)
        self.follow = [(i, i + 1) for i, (x, y) in enumerate(ends) if not text[x[1] : y[0]].strip(" ")]
        keys = [_SEPARATORS.sub("", w).lower() for w in self.words]
        names = [w.partition("@")[0].lower() if "@" in w else "" for w in self.words]
        found = set(skip_edges([k if len(k) > SIMILAR else "" for k in keys]))
        found.update(skip_edges([n if len(n) > SIMILAR // 2 else "" for n in names]))
        found.update(number_edges([k if k.isdigit() and k.isascii() else "" for k in keys], self.follow))
        self.skip = sorted(found)

    def features(self, text: str) -> np.ndarray:
        """A row of features a token, made a few at a time, as lists take much more memory."""
        each = list(zip(self.words, self.tokens, strict=True))
        parts = [np.array([features(w, _before(text, a)) for w, (a, _) in each[i : i + TOKENS]], np.float32) for i in range(0, len(each), TOKENS)]
        return np.concatenate(parts) if parts else np.zeros((0, FEATURES), np.float32)

    def neighbours(self) -> np.ndarray:
        """Labels of the token before and after, and of the occurrence before and after."""
        out = np.full((len(self.tokens), 4), -1)
        for at, edges in ((0, self.follow), (2, self.skip)):
            for a, b in edges:
                out[b, at], out[a, at + 1] = self.observed[a], self.observed[b]
        return out

    def labels(self, text: str, weights: Weights, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The likeliest label of each token and its marginal, given observed labels where ``known``."""
        unary = self.features(text) @ weights.unary
        unary[known] = -50.0
        unary[known, self.observed[known]] = 50.0
        p = marginals(unary, self.follow, self.skip, weights)
        return p.argmax(1), p.max(1)


def all_spans(text: str, weights: Weights) -> tuple[list, list]:
    """Base spans, and all spans in the same order."""
    base = base_spans(text)
    field = Field(text, base)
    tokens, hit = field.tokens, field.observed > 0
    if hit.all() or not weights.unary.any():
        return base, base
    kinds, sure = field.labels(text, weights, hit)
    more, joined = [], set(field.follow)
    for i in np.flatnonzero(~hit & (sure >= SURE) & (kinds > 0)):
        a, b = tokens[i]
        while a < b and not (text[a].isalnum() or text[a] in "+("):
            a += 1
        while b > a and not (text[b - 1].isalnum() or text[b - 1] == ")"):
            b -= 1
        if a < b:
            kind = KINDS[kinds[i] - 1]
            if more and more[-1][0] == kind == "phone" and text[more[-1][2] : a].strip(" ") == "" and (i - 1, i) in joined:
                more[-1] = (kind, more[-1][1], b)
            else:
                more.append((kind, a, b))
    if not more:
        return base, base
    return base, sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def fit(docs: DataFrame, text: str = "text", sample: int = SAMPLE, key: str = "doc_id") -> Weights:
    """Weights from a bounded sample of candidate tokens of all documents,
    drawn by hash of document and place, so that equal tokens are thinned
    alike. Only hashes are gathered to choose documents, never their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows: list[tuple] = []
            for t, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                field = Field(t, base_spans(t))
                if field.tokens:
                    rows += zip(field.features(t).tolist(), field.neighbours().tolist(), field.observed.tolist(), [own] * len(field.tokens), range(len(field.tokens)), strict=True)
            kinds = (pa.list_(pa.float32()), pa.list_(pa.int32()), pa.int32(), pa.int64(), pa.int32())
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["x", "near", "y", "own", "at"])

    own = F.xxhash64(*([key] if key in docs.columns else []), text).alias("own")
    texts = docs.filter(F.col(text).isNotNull() & F.col(text).rlike("[0-9@]")).select(F.col(text).alias("t"), own)
    last = texts.select("own").orderBy("own").limit(max(1, sample // 10)).agg(F.max("own")).first()[0]
    chosen = texts.filter(F.col("own") <= F.lit(last)).groupBy("own").agg(F.first("t").alias("t")).select("t", "own")
    tokens = mapped(chosen, run, "x array<float>, near array<int>, y int, own long, at int")
    rows = tokens.orderBy(F.xxhash64("own", "at"), "own", "at").limit(sample).collect()
    return learn([(list(r["x"]), list(r["near"]), r["y"]) for r in rows])


def find(docs: DataFrame, weights: Weights, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: counts of base spans, their digest, and all spans."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts: list[list] = [[] for _ in KINDS]
            digests, spans = [], []
            for t in batch.column(1).to_pylist():
                base, full = all_spans(t or "", weights)
                for c, k in zip(counts, KINDS, strict=True):
                    c.append(sum(s[0] == k for s in base))
                digests.append(sha256(shown(base).encode()).hexdigest())
                spans.append(shown(full))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                names=[key, *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    schema = f"`{key}` {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return mapped(docs.select(key, text), run, schema)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind; of spans that overlap, the
    union is replaced once, by the kind that comes first."""
    out, at = [], 0
    merged: list[list] = []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(b, merged[-1][2])
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, weights: Weights, text: str = "text") -> DataFrame:
    """``docs`` with the spans of each whole text replaced; null stays null."""
    names, at = docs.columns, docs.columns.index(text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = []
            for t in batch.column(at).to_pylist():
                full = all_spans(t, weights)[1] if t else []
                texts.append(redacted(t, full) if full else t)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return mapped(docs, run, schema)

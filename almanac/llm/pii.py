"""Personal data: fixed patterns, and a skip-chain conditional random field that adds to them.

The patterns find e-mail addresses, IP addresses, card and telephone numbers; what they find stays.
The field labels the tokens that hold a digit or an ``@`` (all others are certainly no such data,
so that the chain of a document falls apart at them). Neighbouring tokens share a potential, and so
do distant ones that repeat or resemble each other: a number that was recognised in one place
speaks for the same digits elsewhere, written in a way the patterns don't know. Sum-product
messages pass along both kinds of edges until those of a document settle; all documents of a batch
are worked on at once, but none waits for or depends on another.
Tokens within a pattern's span are held at its kind. Others become spans where their marginal is
high enough.

The potentials are learnt here by pseudo-likelihood from what the patterns find in a bounded
sample of documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm.common import text_bytes

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + len(KINDS)  # 0: none
#: Documents to learn from, about, a sample by hash; and tokens of them, at most.
SAMPLE_DOCS, SAMPLE_TOKENS, SAMPLE_PARTS = 10_000, 1_000_000, 16
#: Marginal from which a token becomes a span.
SURE = 0.9
#: A document's messages have settled when none moves further. They are damped; after every so
#: many rounds half of what they still move is left, so that those that swing come to rest, too.
SETTLED, DAMPING, PATIENCE = 1e-3, 0.3, 30
SHAPES = 64
_HELD = 30.0

# The patterns whose matches are always reported.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_SIGN = re.compile(r"[0-9@]")
_TOKEN_END = re.compile(r"\S*")
_EDGE = ".,;:!?'\"#$%&*|<>[]{}"


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Every ``@`` in turn, the longest local part before it, and a domain after it."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            floor = found.end()
            yield start, floor
        at = text.find("@", max(at + 1, floor))


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` by kind, then start; code points, end exclusive."""
    out = [(0, a, b) for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        parts = (p.lstrip("0") for p in m[0].split("."))
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, *m.span()))
    return out


def _tokens(text: str) -> list[tuple[int, int]]:
    """Tokens between white space that hold a digit or an ``@``."""
    out, end = [], 0
    while m := _SIGN.search(text, end):
        start = m.start()
        while start > end and not text[start - 1].isspace():
            start -= 1
        end = _TOKEN_END.match(text, m.start()).end()
        out.append((start, end))
    return out


def _bucket(n: int, edges: tuple[int, ...]) -> int:
    return sum(n >= e for e in edges)


#: How many values each feature of a token has.
_SIZES = (2, 6, 5, 2, 2, 3, 3, 2, 2, SHAPES, 1)
_OFFSETS = np.concatenate(([0], np.cumsum(_SIZES)))


def _features(token: str, near: tuple[bool, bool]) -> list[int]:
    digits = sum("0" <= c <= "9" for c in token)
    letters = sum(c.isalpha() for c in token)
    shape = re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", "9", token.strip(_EDGE)))[:12]
    code = 0
    for c in shape:
        code = (code * 31 + ord(c)) % 1_000_003
    values = (
        "@" in token, _bucket(digits, (1, 4, 8, 16, 20)), _bucket(token.count("."), (1, 2, 3, 4)),
        token.lstrip(_EDGE).startswith("+"), "(" in token, _bucket(letters, (1, 3)),
        _bucket(token.count("-"), (1, 2)), near[0], near[1], code % SHAPES, 0,
    )
    return [int(v) + int(o) for v, o in zip(values, _OFFSETS, strict=False)]


@dataclass
class _Graph:
    """Tokens of some documents, their features and edges."""

    spans: list[tuple[int, int, int]]  # document, start, end
    features: np.ndarray
    label: np.ndarray  # of the pattern that covers the token, else 0
    chain: np.ndarray
    skip: np.ndarray


def _graph(texts: list[str], found: list[list[tuple]]) -> _Graph:
    spans, features, label, chain, skip = [], [], [], [], []
    for doc, text in enumerate(texts):
        own, hubs = _tokens(text), {}
        bases = sorted((a, b, k) for k, a, b in found[doc])
        at = 0
        for i, (a, b) in enumerate(own):
            before = i > 0 and text[own[i - 1][1] : a].strip() == "" and a - own[i - 1][1] < 4
            after = (
                i + 1 < len(own) and text[b : own[i + 1][0]].strip() == "" and own[i + 1][0] - b < 4
            )
            token = text[a:b]
            features.append(_features(token, (before, after)))
            while at < len(bases) and bases[at][1] <= a:
                at += 1
            covers = [k for s, e, k in bases[at : at + 4] if s < b and e > a]
            label.append(1 + covers[0] if covers else 0)
            if before:
                chain.append((len(spans) - 1, len(spans)))
            digits = re.sub(r"[^0-9]", "", token)
            for key in {
                ("same", token.strip(_EDGE + "()").lower()),
                ("digits", digits if len(digits) >= 6 else ""),
            }:
                # Repeats are linked to the first of them: any two are two links apart, and there
                # are fewer links than tokens.
                if key[1] and hubs.setdefault(key, len(spans)) != len(spans):
                    skip.append((hubs[key], len(spans)))
            spans.append((doc, a, b))
    pairs = lambda x: np.array(x, np.int64).reshape(-1, 2)
    return _Graph(
        spans, np.array(features, np.int64).reshape(-1, len(_SIZES)), np.array(label, np.int64),
        pairs(chain), np.unique(pairs(skip), axis=0),
    )


@dataclass
class Model:
    node: np.ndarray  # features x labels
    chain: np.ndarray  # labels x labels, the earlier token first
    skip: np.ndarray  # labels x labels, symmetric


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def marginals(
    node: np.ndarray, edges: np.ndarray, tables: np.ndarray, document: np.ndarray | None = None
) -> np.ndarray:
    """Loopy sum-product: marginals of ``node`` (tokens x labels, logs) under pairwise ``tables``
    (edges x labels x labels, logs). Exact where the edges make no loop. Each ``document`` settles
    by itself, whatever others are looked at with it."""
    n, width = node.shape
    source = np.concatenate([edges[:, 0], edges[:, 1]])
    target = np.concatenate([edges[:, 1], edges[:, 0]])
    table = np.concatenate([tables, tables.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    message = np.zeros((len(source), width))
    of = np.zeros(len(source), np.int64) if document is None else document[source]

    def belief(on: np.ndarray) -> np.ndarray:
        sums = [np.bincount(target[on], message[on, k], minlength=n) for k in range(width)]
        return node + np.stack(sums, axis=1)

    active, damping, rounds = np.arange(len(source)), DAMPING, 0
    while len(active):
        out = belief(active)[source[active]] - message[back[active]]
        new = _log_sum(out[:, :, None] + table[active], axis=1)
        new -= _log_sum(new, axis=1)[:, None]
        step = (1 - damping) * (new - message[active])
        message[active] += step
        moved = np.zeros(int(of.max()) + 1)
        np.maximum.at(moved, of[active], np.abs(step).max(axis=1))
        active = active[moved[of[active]] >= SETTLED]
        rounds += 1
        if rounds % PATIENCE == 0:
            damping = (1 + damping) / 2
    total = belief(np.arange(len(source)))
    return np.exp(total - _log_sum(total, axis=1)[:, None])


def _edges(g: _Graph, model: Model) -> tuple[np.ndarray, np.ndarray]:
    tables = [np.repeat(t[None], len(e), axis=0) for t, e in
              ((model.chain, g.chain), (model.skip, g.skip))]
    return np.concatenate([g.chain, g.skip]), np.concatenate(tables)


def _added(g: _Graph, model: Model, texts: list[str]) -> list[list[tuple]]:
    """Spans of tokens that no pattern covers, neighbours of one kind joined."""
    out: list[list[tuple]] = [[] for _ in texts]
    if not len(g.spans) or g.label.all():
        return out
    node = model.node[g.features].sum(axis=1)
    held = np.flatnonzero(g.label)
    node[held] = -_HELD
    node[held, g.label[held]] = _HELD
    edges, tables = _edges(g, model)
    p = marginals(node, edges, tables, np.array([d for d, _, _ in g.spans], np.int64))
    best = p.argmax(axis=1)
    sure = (g.label == 0) & (best > 0) & (p.max(axis=1) >= SURE)
    joined = set(map(tuple, g.chain.tolist()))
    last = None
    for k in np.flatnonzero(sure).tolist():
        doc, a, b = g.spans[k]
        text = texts[doc]
        while a < b and text[a] in _EDGE:
            a += 1
        while b > a and text[b - 1] in _EDGE:
            b -= 1
        if a == b:
            continue
        kind = int(best[k]) - 1
        if last == k - 1 and (k - 1, k) in joined and out[doc][-1][0] == kind:
            out[doc][-1] = (kind, out[doc][-1][1], b)
        else:
            out[doc].append((kind, a, b))
        last = k
    return out


def all_spans(texts: list[str], model: Model) -> list[list[tuple[int, int, int, bool]]]:
    """``(kind, start, end, base)`` of each text, by kind, then start."""
    found = [base_spans(t) for t in texts]
    extra = _added(_graph(texts, found), model, texts)
    return [
        sorted([(*s, True) for s in base] + [(*s, False) for s in more])
        for base, more in zip(found, extra, strict=True)
    ]


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"
#: Texts and characters looked at together.
_TEXTS, _CHARS = 2_000, 8_000_000


def _by_batch(model: Model, make):
    """An Arrow function over texts: in pieces of bounded size, ``make(texts, spans)``."""

    def of_batch(data: pa.Array) -> list:
        out, texts, size = [], [], 0
        for x in data:
            text = x.as_py().decode("utf-8", "replace")
            texts.append(text)
            size += len(text)
            if len(texts) == _TEXTS or size > _CHARS:
                out += make(texts, all_spans(texts, model))
                texts, size = [], 0
        return out + (make(texts, all_spans(texts, model)) if texts else [])

    return of_batch


def spans(text: Column, model: Model) -> Column:
    """All spans of a text; none in missing and empty ones. Offsets count code points."""
    sent = SparkSession.active().sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([
        ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()),
    ]))

    def make(texts: list[str], found: list[list[tuple]]) -> list:
        return [
            [{"kind": KINDS[k], "start": a, "end": b, "base": base} for k, a, b, base in own]
            for own in found
        ]

    @F.arrow_udf(SPANS)
    def of_batch(data: pa.Array) -> pa.Array:
        return pa.array(_by_batch(sent.value, make)(data), kind)

    return of_batch(text_bytes(text))


def _replaced(text: str, found: list[tuple]) -> str:
    out, end = [], 0
    for kind, a, b, _ in sorted(found, key=lambda s: (s[1], -s[2], s[0])):
        if a >= end:
            out += [text[end:a], f"<{KINDS[kind]}>"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def redact(text: Column, model: Model) -> Column:
    """The text with ``<kind>`` for each span (overlapping ones: for the first). A missing text
    becomes an empty one."""
    sent = SparkSession.active().sparkContext.broadcast(model)

    def make(texts: list[str], found: list[list[tuple]]) -> list:
        return [_replaced(t, own) for t, own in zip(texts, found, strict=True)]

    @F.arrow_udf("string")
    def of_batch(data: pa.Array) -> pa.Array:
        return pa.array(_by_batch(sent.value, make)(data), pa.string())

    return of_batch(text_bytes(text))


def _learn(g: _Graph, steps: int = 300, ridge: float = 0.3) -> Model:
    """Pseudo-likelihood: each label given the features and the labels of its neighbours."""
    n = len(g.label)
    node = np.zeros((int(_OFFSETS[-1]), LABELS))
    chain, skip = np.zeros((LABELS, LABELS)), np.zeros((LABELS, LABELS))
    if n == 0:
        return Model(node, chain, skip)
    y = np.eye(LABELS)[g.label]

    def around(edges: np.ndarray, forward: bool) -> np.ndarray:
        """For each token, how many of its neighbours have each label."""
        a, b = (edges[:, 0], edges[:, 1]) if forward else (edges[:, 1], edges[:, 0])
        return np.stack(
            [np.bincount(b, y[a, k], minlength=n) for k in range(LABELS)], axis=1
        ) if len(edges) else np.zeros((n, LABELS))

    left, right = around(g.chain, True), around(g.chain, False)
    other = around(g.skip, True) + around(g.skip, False)
    scale = [np.full(x.shape, 1e-8) for x in (node, chain, skip)]
    for _ in range(steps):
        score = node[g.features].sum(axis=1) + left @ chain + right @ chain.T + other @ skip
        p = np.exp(score - _log_sum(score, axis=1)[:, None])
        miss = (p - y) / n
        grad_node = np.stack(
            [np.bincount(g.features.ravel(), np.repeat(miss[:, k], g.features.shape[1]),
                         minlength=len(node)) for k in range(LABELS)], axis=1)
        grad_skip = other.T @ miss
        grads = (grad_node + ridge * node / n, left.T @ miss + (right.T @ miss).T
                 + ridge * chain / n, (grad_skip + grad_skip.T) / 2 + ridge * skip / n)
        for value, grad, total in zip((node, chain, skip), grads, scale, strict=True):
            total += grad**2
            value -= 0.3 * grad / np.sqrt(total)
    return Model(node, chain, skip)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn the potentials from what the patterns find in about ``SAMPLE_DOCS`` documents, among
    those with a digit or an ``@``. What comes to the driver are the features of ``SAMPLE_TOKENS``
    tokens at most: the last document that would go beyond ends the sample. Repeated rows may be in
    it as often; without such documents nothing is learned and no span is added."""
    text = F.col(text_col)
    named = docs.where(text.rlike("[0-9@]"))
    rate = SAMPLE_DOCS / max(1, named.count())
    place = F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = named.where(place < rate).select(text_bytes(text).alias("text"), place.alias("place"))
    kind = "struct<f:array<array<int>>,y:array<int>,chain:array<array<int>>,skip:array<array<int>>>"

    @F.arrow_udf(kind)
    def of_batch(data: pa.Array) -> pa.Array:
        out = []
        for x in data:
            t = x.as_py().decode("utf-8", "replace")
            g = _graph([t], [base_spans(t)])
            out.append({"f": g.features.tolist(), "y": g.label.tolist(),
                        "chain": g.chain.tolist(), "skip": g.skip.tolist()})
        ints = pa.list_(pa.int32())
        return pa.array(out, pa.struct([("f", pa.list_(ints)), ("y", ints),
                                        ("chain", pa.list_(ints)), ("skip", pa.list_(ints))]))

    # Gathered in a few partitions first: the driver asks for one after the other.
    graphs = sample.select(of_batch("text").alias("g"), "place").repartition(SAMPLE_PARTS, "place")
    rows, parts, n = [], [], 0
    for row in graphs.toLocalIterator():
        if n and n + len(row["g"]["y"]) > SAMPLE_TOKENS:
            break
        rows.append(row)
        n += len(row["g"]["y"])
    n = 0
    for row in sorted(rows, key=lambda r: r["place"]):
        g = row["g"]
        pairs = [np.array(g[k], np.int64).reshape(-1, 2) + n for k in ("chain", "skip")]
        parts.append((np.array(g["f"], np.int32).reshape(-1, len(_SIZES)), np.array(g["y"], np.int64), *pairs))
        n += len(g["y"])
    none = (np.zeros((0, len(_SIZES)), np.int32), np.zeros(0, np.int64), *[np.zeros((0, 2), np.int64)] * 2)
    return _learn(_Graph([], *map(np.concatenate, zip(none, *parts, strict=True))))

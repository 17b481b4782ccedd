"""Quality by a factorisation machine.

Each text is a sparse vector: hashed words, statistics of its structure and its metadata, the
latter two in ranges. The machine adds to a linear model the interaction of every pair of features,
by inner products of low rank. By the identity that a sum over pairs is half of the square of the
sum less the sum of the squares, a score takes time linear in the features of a text.

The machine is fitted on a bounded sample of labelled rows. The table of features has a fixed
size, so the fitted machine has one too.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm.common import text_bytes

#: Labelled rows to fit on at most, taken by hash.
SAMPLE_ROWS = 8_000
WORD_SLOTS = 1 << 15
RANK = 8
EPOCHS, BATCH, RATE, RIDGE = 8, 128, 0.1, 1e-4
_KNOWN_WORDS = 400_000

_SHARES = (0.0005, 0.005, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9)
#: Statistics of a text and where their ranges part.
STATISTICS = {
    "upper": _SHARES, "digits": _SHARES, "symbols": _SHARES, "marks": _SHARES, "spaces": _SHARES,
    "wide": _SHARES, "distinct": _SHARES, "repeated_lines": _SHARES,
    "word_length": (2, 3, 4, 5, 6, 7, 8, 10, 14), "words": (1, 4, 16, 64, 256, 1024, 4096, 16384),
    "line_words": (1, 4, 8, 16, 32, 64, 256),
}
METADATA = {"n_chars": (1, 16, 64, 256, 1024, 4096, 16384, 65536)}
_EDGES = {**STATISTICS, **METADATA}
# Each has one range more for a missing value.
_START = dict(zip(_EDGES, np.cumsum([0] + [len(e) + 2 for e in _EDGES.values()])[:-1].tolist(),
                  strict=True))
OWN_SLOTS = sum(len(e) + 2 for e in _EDGES.values()) + 1
SLOTS = WORD_SLOTS + OWN_SLOTS

_CLASS = np.zeros((256, 5), np.int64)  # upper, digits, symbols, marks, spaces
for _b in range(256):
    _c = chr(_b)
    if _b < 128:
        _CLASS[_b] = (_c.isupper(), _c.isdigit(), _c in "#$%&*|<>{}[]@=~^_\\/", _c in "!?.,;:",
                      _c.isspace())


def _range(name: str, value: float | None) -> int:
    edges = _EDGES[name]
    place = len(edges) + 1 if value is None else sum(value >= e for e in edges)
    return WORD_SLOTS + _START[name] + place


def _slot(word: str) -> int:
    return zlib.crc32(word.encode()) % WORD_SLOTS


def _vector(data: bytes, n_chars: float | None, known: dict[str, int]) -> tuple[list, list]:
    """Slots and values of a text. The words together have length one."""
    text = data.decode("utf-8", "replace")
    words = text.lower().split()
    distinct = set(words)
    for word in distinct.difference(known):
        known[word] = _slot(word)
    slots = list({known[w] for w in distinct})
    values = [1.0 / math.sqrt(max(1, len(slots)))] * len(slots)
    size = max(1, len(data))
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    upper, digits, symbols, marks, spaces = (count @ _CLASS / size).tolist()
    lines = [x for x in text.split("\n") if x.strip()]
    n = max(1, len(words))
    stats = {
        "upper": upper, "digits": digits, "symbols": symbols, "marks": marks, "spaces": spaces,
        "wide": float(count[128:].sum() / size), "distinct": len(distinct) / n,
        "repeated_lines": 1 - len(set(lines)) / max(1, len(lines)),
        "word_length": len(text) / n, "words": len(words),
        "line_words": len(words) / max(1, len(lines)), "n_chars": n_chars,
    }
    slots += [_range(name, value) for name, value in stats.items()]
    slots.append(SLOTS - 1)
    return slots, values + [1.0 / math.sqrt(len(stats))] * len(stats) + [1.0]


@dataclass
class Machine:
    bias: float
    linear: np.ndarray  # slots
    factors: np.ndarray  # slots x rank


def _margins(m: Machine, slots: np.ndarray, values: np.ndarray, begin: np.ndarray) -> tuple:
    own = m.factors[slots] * values[:, None]
    sums = np.add.reduceat(own, begin)
    squares = np.add.reduceat((own**2).sum(axis=1), begin)
    line = np.add.reduceat(m.linear[slots] * values, begin)
    return m.bias + line + 0.5 * ((sums**2).sum(axis=1) - squares), own, sums


def _fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> Machine:
    """Logistic loss, AdaGrad over small batches."""
    draw = np.random.default_rng(7)
    m = Machine(0.0, np.zeros(SLOTS), draw.normal(0, 0.05, (SLOTS, RANK)))
    if len(y) == 0:
        return m
    rate = np.clip(y.mean(), 0.01, 0.99)
    m.bias = math.log(rate / (1 - rate))
    seen = [np.full(SLOTS, 1e-6), np.full((SLOTS, RANK), 1e-6)]
    for _ in range(EPOCHS):
        order = draw.permutation(len(y))
        for a in range(0, len(order), BATCH):
            own = order[a : a + BATCH]
            size = np.array([len(rows[i][0]) for i in own])
            slots = np.concatenate([rows[i][0] for i in own])
            values = np.concatenate([rows[i][1] for i in own])
            begin = np.cumsum(size) - size
            margin, part, sums = _margins(m, slots, values, begin)
            miss = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[own]
            scale = np.repeat(miss, size) * values
            by_slot = np.argsort(slots, kind="stable")
            used, first = np.unique(slots[by_slot], return_index=True)
            pull = scale[:, None] * (np.repeat(sums, size, axis=0) - part)
            grads = (np.add.reduceat(scale[by_slot], first), np.add.reduceat(pull[by_slot], first))
            for value, grad, total in zip((m.linear, m.factors), grads, seen, strict=True):
                grad = grad / len(own) + RIDGE * value[used]
                total[used] += grad**2
                value[used] -= RATE * grad / np.sqrt(total[used])
    return m


_VECTOR = "struct<slots:array<int>,values:array<float>>"


def _vectors(text: Column, n_chars: Column) -> Column:
    @F.arrow_udf(_VECTOR)
    def of_batch(data: pa.Array, chars: pa.Array) -> pa.Array:
        known: dict[str, int] = {}
        out = [
            _vector(x.as_py(), c.as_py(), known) for x, c in zip(data, chars, strict=True)
        ]
        kind = pa.struct([("slots", pa.list_(pa.int32())), ("values", pa.list_(pa.float32()))])
        return pa.array([{"slots": s, "values": v} for s, v in out], kind)

    return of_batch(text_bytes(text), n_chars)


def _metadata(docs: DataFrame) -> Column:
    """The length as the source states it, if it does."""
    return (F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)).cast("double")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> Machine:
    """Learn from ``labels`` (id, quality 0/1) on ``SAMPLE_ROWS`` of its rows at most, and their
    documents. Missing and other labels, and those of no document, teach nothing; repeated rows
    count as often as they are in the sample; from empty tables comes a machine without a preference.
    A text of any length is one sparse vector of bounded size."""
    sample = (
        labels.where(F.col("quality").isin(0, 1) & F.col(id_col).isNotNull())
        .select(id_col, "quality")
        .orderBy(F.xxhash64(id_col), "quality")
        .limit(SAMPLE_ROWS)
    )
    chosen = docs.join(F.broadcast(sample), id_col)  # bounded by SAMPLE_ROWS
    found = chosen.select(
        _vectors(F.col("text"), _metadata(docs)).alias("x"), "quality"
    ).limit(SAMPLE_ROWS)
    rows, y = [], []
    for row in found.toLocalIterator():
        rows.append((np.array(row["x"]["slots"], np.int64), np.array(row["x"]["values"])))
        y.append(row["quality"])
    return _fit(rows, np.array(y, float))


def score(docs: DataFrame, machine: Machine) -> Column:
    """From 0 to 1, higher for better texts; a missing text is scored as an empty one, a long one by
    all its words, repeated rows alike, and an empty table has no scores."""
    sent = SparkSession.active().sparkContext.broadcast(machine)

    @F.arrow_udf("double")
    def of_batches(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        m, known = sent.value, {}
        for data, chars in batches:
            out = []
            for a in range(0, len(data), 500):
                pairs = zip(data.slice(a, 500), chars.slice(a, 500), strict=True)
                rows = [_vector(x.as_py(), c.as_py(), known) for x, c in pairs]
                size = np.array([len(s) for s, _ in rows])
                slots = np.concatenate([np.array(s, np.int64) for s, _ in rows])
                values = np.concatenate([np.array(v) for _, v in rows])
                margin, _, _ = _margins(m, slots, values, np.cumsum(size) - size)
                out.append(1 / (1 + np.exp(-np.clip(margin, -30, 30))))
                if len(known) > _KNOWN_WORDS:
                    known.clear()
            yield pa.array(np.concatenate(out) if out else np.zeros(0))

    return of_batches(text_bytes("text"), _metadata(docs))

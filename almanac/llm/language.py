"""Language by averaged embeddings of hashed subwords.

A text is lower-cased and read as words of letters with a mark before and after each; its subwords
are all runs of two to four of these characters within a word. Each is hashed to a slot, each slot
has an embedding, and a linear softmax over the average of a text's embeddings gives the languages.
Slots, softmax and embeddings are trained together by stochastic gradient descent with a falling
rate.

Part of the sample is kept from training and calibrates the result: a temperature that makes the
probabilities honest there, and the probability from which a prediction is accepted, the smallest
one above which enough of those predictions are right. What is below is rejected.

The sample is bounded twice: rows, about as many of each language (those with the smallest hashes of
id and text), and slots of all rows together, so that long texts cost no more. Scoring reads whole
texts, in pieces, and keeps nothing from one text to the next.

Defined results: a missing text and one without a letter are ``und`` with score 0, not accepted;
so is every text if nothing could be learned. Rows whose language is missing teach nothing. Of
equal probabilities the first language in text order is taken. Repeated rows give equal results,
empty tables none. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm.common import text_bytes

#: Rows to learn from at most, and slots that occur in them, all together.
SAMPLE_ROWS = 2_400
SAMPLE_SLOTS = 8_000_000
#: Partitions that the sample is gathered in: the driver asks for one after the other.
SAMPLE_PARTS = 16
SLOTS, WIDTH = 1 << 16, 8
ORDERS = (2, 3, 4)
EPOCHS, BATCH, RATE = 6, 16, 4.0
#: A part of the sample that calibrates, and the share of accepted predictions to be right there.
KEPT_BACK, RIGHT, LEAST_KEPT = 0.2, 0.99, 20
UNDETERMINED = "und"
#: Characters looked at in one go: bounds the memory of a task.
_PIECE = 400_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _lower() -> np.ndarray:
    """For each code point its lower case, or 0 if it is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for k in range(0x110000):
        c = chr(k)
        if c.isalpha():
            low = c.lower()
            out[k] = ord(low) if len(low) == 1 else k
    return out


def _slots(text: np.ndarray) -> list[np.ndarray]:
    """For each order, the slot of each subword by its first character, ``SLOTS`` where the
    characters there are not within one word. ``text`` has lower-case letters and marks (0)."""
    out = []
    key = text.astype(np.uint64) * _MIX
    inner = None  # whether all between first and last are letters
    letter = text != 0
    for n in range(2, max(ORDERS) + 1):
        count = len(text) - n + 1
        if count <= 0:
            break
        key = (key[:count] ^ (text[n - 1 :] + np.uint64(n))) * _MIX
        key ^= key >> np.uint64(29)
        if n == 2:
            fine = letter[:-1] | letter[1:]
        else:
            between = letter[1 : 1 + count]
            inner = between if inner is None else inner[:count] & letter[n - 2 : n - 2 + count]
            fine = inner
        if n in ORDERS:
            slot = (key >> np.uint64(40)).astype(np.int64) % SLOTS
            out.append(np.where(fine, slot, SLOTS))
    return out


@dataclass
class _Run:
    """Characters of pieces of texts in a row; where each piece begins, of which text it is, and
    whether it is that text's last one."""

    text: np.ndarray
    begin: np.ndarray
    number: np.ndarray
    last: np.ndarray

    def slots(self) -> Iterator[np.ndarray]:
        """Slots of each order. What reaches out of a piece is none, and what begins where pieces
        overlap belongs to the next one."""
        end = np.append(self.begin[1:], len(self.text))
        for n, slots in zip(ORDERS, _slots(self.text), strict=False):
            for back in range(1, max(ORDERS)):
                at = (end if back < n else end[~self.last]) - back
                slots[at[(at >= 0) & (at < len(slots))]] = SLOTS
            yield slots


def _runs(texts: list[bytes]) -> Iterator[_Run]:
    """Texts with a mark before and after each. A long text comes in pieces that overlap, so that no
    subword is lost."""
    lower, over = _lower(), max(ORDERS) - 1
    parts, begin, number, last, size = [], [], [], [], 0
    for k, data in enumerate(texts):
        points = np.frombuffer(data.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        own = np.zeros(len(points) + 2, np.uint64)
        own[1:-1] = lower[points]
        for a in range(0, max(1, len(own) - over), _PIECE):
            piece = own[a : a + _PIECE + over]
            parts.append(piece)
            begin.append(size)
            number.append(k)
            last.append(a + _PIECE + over >= len(own))
            size += len(piece)
            if size >= _PIECE:
                yield _Run(np.concatenate(parts), np.array(begin), np.array(number), np.array(last))
                parts, begin, number, last, size = [], [], [], [], 0
    if parts:
        yield _Run(np.concatenate(parts), np.array(begin), np.array(number), np.array(last))


@dataclass
class Model:
    languages: list[str]
    embeddings: np.ndarray  # slots and a last one of zeros, x width
    weights: np.ndarray  # width x languages
    bias: np.ndarray
    temperature: float = 1.0
    accept_from: float = 0.0


def _averages(texts: list[bytes], table: np.ndarray) -> np.ndarray:
    """The average of the rows of ``table`` over the subwords of each text."""
    total = np.zeros((len(texts), table.shape[1]))
    count = np.zeros(len(texts))
    for run in _runs(texts):
        for slots in run.slots():
            own = run.begin < len(slots)
            at, of = run.begin[own], run.number[own]
            np.add.at(total, of, np.add.reduceat(table[slots], at, axis=0, dtype=float))
            np.add.at(count, of, np.add.reduceat((slots < SLOTS).astype(np.int64), at))
    return total / np.maximum(count, 1)[:, None]


def _softmax(margins: np.ndarray) -> np.ndarray:
    p = np.exp(margins - margins.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def probabilities(texts: list[bytes], m: Model) -> np.ndarray:
    return _softmax((_averages(texts, m.embeddings) @ m.weights + m.bias) / m.temperature)


def _counts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Slots of a text and the share each has of its subwords."""
    total = np.zeros(SLOTS + 1, np.int64)
    for run in _runs([data]):
        for slots in run.slots():
            total += np.bincount(slots, minlength=SLOTS + 1)
    used = np.flatnonzero(total[:SLOTS])
    return used, total[used] / max(1, total[:SLOTS].sum())


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, languages: list[str]) -> Model:
    """Stochastic gradient descent over small batches, at a rate that falls to zero."""
    draw = np.random.default_rng(5)
    embeddings = draw.uniform(-1, 1, (SLOTS + 1, WIDTH)) / WIDTH
    embeddings[SLOTS] = 0
    weights, bias = np.zeros((WIDTH, len(languages))), np.zeros(len(languages))
    steps = max(1, EPOCHS * -(-len(y) // BATCH))
    done = 0
    for _ in range(EPOCHS):
        order = draw.permutation(len(y))
        for a in range(0, len(order), BATCH):
            own = order[a : a + BATCH]
            size = np.array([len(rows[i][0]) for i in own])
            slots = np.concatenate([rows[i][0] for i in own])
            share = np.concatenate([rows[i][1] for i in own])
            of = np.repeat(np.arange(len(own)), size)
            hidden = np.zeros((len(own), WIDTH))
            np.add.at(hidden, of, embeddings[slots] * share[:, None])
            miss = _softmax(hidden @ weights + bias)
            miss[np.arange(len(own)), y[own]] -= 1
            rate = RATE * (1 - done / steps)
            back = miss @ weights.T
            weights -= rate * hidden.T @ miss / len(own)
            bias -= rate * miss.mean(axis=0)
            # Each slot has a small share of a text, so its step is that of the text, not the mean.
            np.add.at(embeddings, slots, -rate * back[of] * share[:, None])
            done += 1
    return Model(languages, embeddings.astype(np.float32), weights, bias)


def calibrate(m: Model, margins: np.ndarray, y: np.ndarray, right: float = RIGHT) -> None:
    """Set the temperature of the least loss, and the probability to accept from."""
    if not len(y):
        return
    row = np.arange(len(y))
    loss = lambda t: -np.log(np.maximum(_softmax(margins / t)[row, y], 1e-12)).mean()
    m.temperature = float(min(2.0 ** np.arange(-6, 6.01, 0.25), key=loss))
    p = _softmax(margins / m.temperature)
    top, hit = p.max(axis=1), p.argmax(axis=1) == y
    order = np.argsort(-top, kind="stable")
    enough = np.flatnonzero(np.cumsum(hit[order]) >= right * np.arange(1, len(y) + 1))
    m.accept_from = float(top[order][enough[-1]]) if len(enough) else 1.0


def _sample(docs: DataFrame, id_col: str) -> DataFrame:
    """About ``SAMPLE_ROWS`` rows ``(lang, place, data)``, as many of each language as there are."""
    named = docs.where(F.col("lang").isNotNull() & F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}"))
    place = F.pmod(F.xxhash64(F.col(id_col).cast("string"), "text"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    named = named.select(F.col("lang").cast("string").alias("lang"), "text", place.alias("place"))
    sizes = named.groupBy("lang").count().collect()  # a row for each language
    if not sizes:
        return named.select("lang", "place", text_bytes("text").alias("data")).limit(0)
    quota = -(-SAMPLE_ROWS // len(sizes))
    rates = [(r["lang"], min(1.0, quota / r["count"])) for r in sizes]
    chosen = docs.sparkSession.createDataFrame(rates, "lang string, rate double")
    return named.join(F.broadcast(chosen), "lang").where("place <= rate").select(
        "lang", "place", text_bytes("text").alias("data")
    )


def fit(docs: DataFrame, id_col: str = "doc_id") -> Model | None:
    """Learn from documents ``(id, text, lang)``; None if no row teaches anything."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [_counts(x.as_py()) for x in batch.column("data")]
            yield pa.record_batch(
                [
                    batch.column("lang"), batch.column("place"),
                    pa.array([s.astype(np.int32) for s, _ in own], pa.list_(pa.int32())),
                    pa.array([v.astype(np.float32) for _, v in own], pa.list_(pa.float32())),
                ],
                ["lang", "place", "slots", "shares"],
            )

    found = _sample(docs, id_col).mapInArrow(
        counted, "lang string, place double, slots array<int>, shares array<float>"
    ).repartition(SAMPLE_PARTS, "place")
    taken, size = [], 0
    for r in found.toLocalIterator():  # ends at the bound, however many rows there are
        size += len(r["slots"])
        if taken and (len(taken) >= 2 * SAMPLE_ROWS or size > SAMPLE_SLOTS):
            break
        taken.append((r["place"], r["lang"], np.array(r["slots"], np.int64), np.array(r["shares"])))
    if not taken:
        return None
    taken.sort(key=lambda r: (r[0], r[1]))
    languages = sorted({r[1] for r in taken})
    number = {name: k for k, name in enumerate(languages)}
    rows, y = [r[2:] for r in taken], np.array([number[r[1]] for r in taken])
    kept = np.random.default_rng(3).random(len(y)) < KEPT_BACK
    if kept.sum() < LEAST_KEPT or len(set(y[~kept])) < len(languages):
        kept[:] = False  # too few to keep any back: probabilities stay as they are
    learn = np.flatnonzero(~kept)
    m = train([rows[i] for i in learn], y[learn], languages)
    own = [m.embeddings[rows[i][0]].T @ rows[i][1] for i in np.flatnonzero(kept)]
    margins = np.array(own).reshape(-1, WIDTH) @ m.weights + m.bias
    calibrate(m, margins, y[kept])
    return m


_RESULT = "struct<lang:string,score:double,accepted:boolean>"


def predict(text: Column, model: Model | None) -> Column:
    """``(lang, score, accepted)`` of a text: the likeliest language, its calibrated probability, and
    whether that is enough."""
    none = F.struct(
        F.lit(UNDETERMINED).alias("lang"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted")
    )
    if model is None:
        return none
    sent = SparkSession.active().sparkContext.broadcast(model)

    @F.arrow_udf(_RESULT)
    def of_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = sent.value
        names = pa.array(m.languages)
        for data in batches:
            tops, scores = [], []
            for a in range(0, len(data), 256):
                p = probabilities([x.as_py() for x in data.slice(a, 256)], m)
                tops.append(p.argmax(axis=1))
                scores.append(p.max(axis=1))
            top = np.concatenate(tops) if tops else np.zeros(0, np.int64)
            score = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.StructArray.from_arrays(
                [names.take(pa.array(top)), pa.array(score), pa.array(score >= m.accept_from)],
                ["lang", "score", "accepted"],
            )

    # A text without a letter has no subword; that is seen before Python.
    return F.when(F.coalesce(text, F.lit("")).rlike(r"\p{L}"), of_batches(text_bytes(text))).otherwise(none)

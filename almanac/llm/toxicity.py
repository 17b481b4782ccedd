"""Toxicity by class-conditional Kneser-Ney models of the letters in words.

Two interpolated Kneser-Ney models, one of toxic and one of ordinary texts, give each word a
log-likelihood ratio. The highest order counts by class. All lower orders are continuation counts
that both classes share, so a rare expression is smoothed by how its letters continue anywhere.
A text is judged by ratios per word, so that its length neither hides nor makes toxicity: the mean
over all words, over the worst fiftieth of them, the worst one, and what exceeds chance in the
worst passage. A logistic curve turns these into a score.

Where neither class has seen a sequence the shared part cancels, and the ratio is that of the
weights with which both back off. So a model is one table, of seen sequences and of contexts.
Counts cover all rows to learn from. They are aggregated in each task and then by sequence.

The table grows with the texts and stays stored. Texts become blocks of distinct words and packed
word numbers; the distinct sequences of each block meet the table in a shuffle, their ratios return
to the block, and each word of it gets its sum. So nothing of the model is broadcast or collected.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.llm.bpe import _joined, _packed, _planes, _unpacked
from almanac.llm.common import clear_shuffles, release, stored, stored_by, text_bytes

ORDER = 5
DISCOUNT = 0.75
#: Words of a block of texts; a longer text is a block by itself.
BLOCK_WORDS = 2_000_000
#: Rows to fit the weights and the offset of the curve on, about: a bounded sample by hash.
CURVE_ROWS = 20_000
#: The worst words that are looked at by themselves, and the ratio that chance rarely exceeds.
WORST_SHARE = 0.02
CHANCE_RATIO = 3.0
PASSAGE_WORDS = 100
FEATURES = 4
WORD = re.compile(r"\w+")
_KNOWN_WORDS = 200_000  # counts remembered by a task


def words_of(data: bytes) -> list[str]:
    return WORD.findall(data.decode("utf-8", "replace").lower())


def sequences(word: str, order: int) -> list[str]:
    """The letters of a word, each with those before it; both ends are marked."""
    marked = "\x02" * (order - 1) + word + "\x03"
    return [marked[i : i + order] for i in range(len(word) + 1)]


def count_sequences(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """Of rows ``(text binary, toxic boolean, part int)``: ``(gram, part, toxic, ordinary)``."""

    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[tuple, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (toxic, part), own in words.items():
                grams: dict[str, int] = {}
                get = grams.get
                for word, n in own.items():
                    for gram in sequences(word, order):
                        grams[gram] = get(gram, 0) + n
                keys = list(grams)
                count = np.fromiter(grams.values(), np.int64, len(grams))
                for a in range(0, len(keys), 50_000):
                    at = slice(a, a + 50_000)
                    none = np.zeros(len(count[at]), np.int64)
                    yield pa.record_batch(
                        [
                            pa.array(keys[at], pa.string()),
                            pa.array(np.full(len(none), part, np.int32)),
                            pa.array(count[at] if toxic else none),
                            pa.array(none if toxic else count[at]),
                        ],
                        ["gram", "part", "toxic", "ordinary"],
                    )
            words.clear()

        for batch in batches:
            for data, toxic, part in zip(*(batch.column(i) for i in range(3)), strict=True):
                own = words.setdefault((toxic.as_py(), part.as_py()), Counter())
                own.update(words_of(data.as_py()))
            if sum(map(len, words.values())) > _KNOWN_WORDS:
                yield from flush()
        yield from flush()
        release()

    schema = "gram string, part int, toxic long, ordinary long"
    made = rows.select("text", "toxic", "part").mapInArrow(of_partition, schema)
    return made.groupBy("gram", "part").agg(
        F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")
    )


def ratios(counts: DataFrame, order: int, discount: float = DISCOUNT) -> DataFrame:
    """``(key, ratio)``: log-likelihood ratios of the sequences seen, and for contexts (one letter
    shorter) the ratio for whatever was not seen after them."""
    tail = lambda n: F.substring("gram", 2, n)
    head = lambda n: F.substring("gram", 1, n)
    levels, grams = {}, counts.select("gram")
    for m in range(order - 1, 0, -1):  # continuation counts, shared by both classes
        levels[m] = grams.groupBy(tail(m).alias("gram")).agg(F.count("*").alias("k"))
        grams = levels[m].select("gram")
    letters, total = levels[1].agg(F.count("*"), F.sum("k")).first()
    spread = discount * letters / (letters + 1)
    shared = levels[1].select(
        "gram",
        ((F.greatest(F.col("k") - discount, F.lit(0.0)) + spread) / F.lit(total or 1)).alias("p"),
    )
    for m in range(2, order):
        level = levels[m].withColumns({"context": head(m - 1), "low": tail(m - 1)})
        sums = level.groupBy("context").agg(F.sum("k").alias("s"), F.count("*").alias("u"))
        shared = (
            level.join(sums, "context")
            .join(shared.select(F.col("gram").alias("low"), F.col("p").alias("q")), "low")
            .select(
                "gram",
                ((F.greatest(F.col("k") - discount, F.lit(0.0)) + discount * F.col("u")
                  * F.col("q")) / F.col("s")).alias("p"),
            )
        )
    top = counts.withColumns({"context": head(order - 1), "low": tail(order - 1)})
    sums = top.groupBy("context").agg(
        F.sum("toxic").alias("nt"),
        F.count_if(F.col("toxic") > 0).alias("ut"),
        F.sum("ordinary").alias("no"),
        F.count_if(F.col("ordinary") > 0).alias("uo"),
    )

    def weight(n: str, u: str) -> Column:
        return F.when(F.col(n) > 0, discount * F.col(u) / F.col(n)).otherwise(F.lit(1.0))

    def likelihood(count: str, n: str, u: str) -> Column:
        own = F.when(
            F.col(n) > 0, F.greatest(F.col(count) - discount, F.lit(0.0)) / F.col(n)
        ).otherwise(F.lit(0.0))
        return own + weight(n, u) * F.col("q")

    seen = (
        top.join(sums, "context")
        .join(shared.select(F.col("gram").alias("low"), F.col("p").alias("q")), "low")
        .select(
            F.col("gram").alias("key"),
            F.log(likelihood("toxic", "nt", "ut") / likelihood("ordinary", "no", "uo"))
            .alias("ratio"),
        )
    )
    unseen = sums.select(
        F.col("context").alias("key"), F.log(weight("nt", "ut") / weight("no", "uo")).alias("ratio")
    )
    return seen.unionByName(unseen)


@dataclass
class Model:
    """Ratios as a stored table; the curve's offset and its weight of each feature."""

    order: int
    ratios: DataFrame
    curve: tuple[float, ...] = (-3.0, 0.0, 0.0, 0.0, 0.0)


def _features(values: np.ndarray) -> tuple[float, ...]:
    n = len(values)
    if n == 0:
        return (0.0,) * FEATURES
    worst = np.partition(values, n - (k := max(1, math.ceil(WORST_SHARE * n))))[-k:]
    excess = np.concatenate(([0.0], np.cumsum(np.maximum(values - CHANCE_RATIO, 0.0))))
    size = min(n, PASSAGE_WORDS)
    passage = float((excess[size:] - excess[:-size]).max()) / size
    return float(values.mean()), float(worst.mean()), float(values.max()), passage


BLOCKS = "block long, gram string, payload binary"


def _pack(order: int):
    """Rows of texts and further columns to blocks. A block has a row without a sequence, with the
    further columns, the distinct words and the texts as numbers of these, and a row for each
    distinct sequence of its words."""

    def rows(block: int, grams: list, payload: bytes | None = None) -> pa.RecordBatch:
        n = len(grams)
        return pa.record_batch(
            [
                pa.array(np.full(n, block, np.int64)),
                pa.array(grams, pa.string()),
                pa.array([payload] * n, pa.binary()),
            ],
            ["block", "gram", "payload"],
        )

    def close(keys: list, texts: list, index: dict) -> Iterator[pa.RecordBatch]:
        block = uuid.uuid4().int >> 65
        codes = np.concatenate(texts)
        often = np.argsort(-np.bincount(codes, minlength=len(index)), kind="stable")
        rank = np.empty(len(index), np.int64)
        rank[often] = np.arange(len(index))
        names = list(index)
        parts = (
            pa.Table.from_batches(keys).combine_chunks().to_batches()[0].columns,
            [pa.array([len(x) for x in texts], pa.int32())],
            [pa.array([names[i] for i in often], pa.string())],
            _planes(rank[codes]),
        )
        yield rows(block, [None], b"".join(
            len(x).to_bytes(8, "little") + x for x in (_packed(*own) for own in parts)
        ))
        distinct: set[str] = set()
        for word in names:
            distinct.update(sequences(word, order))
        grams = sorted(distinct)
        for a in range(0, len(grams), 50_000):
            yield rows(block, grams[a : a + 50_000])

    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, texts, index, n = [], [], {}, 0
        for batch in batches:
            first, further = 0, batch.select(range(1, batch.num_columns))
            for k, data in enumerate(batch.column(0)):
                found = words_of(data.as_py())
                if texts and n + len(found) > BLOCK_WORDS:
                    if k > first:
                        keys.append(further.slice(first, k - first))
                    yield from close(keys, texts, index)
                    keys, texts, index, n, first = [], [], {}, 0, k
                for word in dict.fromkeys(found):
                    if word not in index:
                        index[word] = len(index)
                texts.append(np.fromiter(map(index.__getitem__, found), np.uint32, len(found)))
                n += len(found)
            if batch.num_rows > first:
                keys.append(further.slice(first))
        if texts:
            yield from close(keys, texts, index)
        keys, texts, index = [], [], {}
        release()

    return of_partition


def _of_block(names: list[str], order: int):
    """The further columns of a block and the features of its texts, by the ratios of its sequences."""

    def of_block(block: pa.Table, ratios: pa.Table) -> pa.Table:
        if block.num_rows != 1:
            raise RuntimeError("ratios came back for a block that is not there, or twice")
        payload, parts = block.column("payload")[0].as_py(), []
        while payload:
            size = int.from_bytes(payload[:8], "little")
            parts.append(payload[8 : 8 + size])
            payload = payload[8 + size :]
        keys, lengths, words = (_unpacked(x) for x in parts[:3])
        lengths, codes = lengths.column(0).to_numpy(), _joined(_unpacked(parts[3]), 0)
        # A sequence that did not come back is an error here.
        of = dict(zip(ratios.column("gram").to_pylist(), ratios.column("ratio").to_pylist(), strict=True))
        words = words.column(0).to_pylist()
        of_gram = of.__getitem__
        ratio = np.fromiter((sum(map(of_gram, sequences(w, order))) for w in words), float, len(words))
        ends = np.cumsum(lengths, dtype=np.int64)
        x = [_features(ratio[codes[a:b]]) for a, b in zip(ends - lengths, ends, strict=True)]
        return pa.table(
            [*keys.columns, pa.array(x, pa.list_(pa.float64()))], names=[*names, "x"]
        )

    return of_block


def with_features(rows: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The columns but the text, renamed ``k0``, ``k1`` and so on, and ``x``, the features of the
    text: mean ratio of the words, of the worst fiftieth, of the worst one, and the mean excess of
    the worst passage. Every row comes back, also repeated ones."""
    kept = [c for c in rows.columns if c != text_col]
    names = [f"k{i}" for i in range(len(kept))]
    picked = rows.select(
        text_bytes(text_col), *(F.col(_quoted(c)).alias(k) for c, k in zip(kept, names, strict=True))
    )
    partitions = picked.rdd.getNumPartitions()
    blocks = stored_by(
        picked.mapInArrow(_pack(model.order), BLOCKS), "blocks", "block", max(8, partitions), compression="zstd"
    )
    grams = blocks.where("gram is not null").select("gram", F.col("block").alias("of"))
    seen = model.ratios.select(F.col("key").alias("gram"), "ratio")
    unseen = model.ratios.select(F.col("key").alias("context"), F.col("ratio").alias("back"))
    # Each sequence is looked up once, so that the contexts of many blocks do not meet in a task.
    found = (
        grams.select("gram").distinct()
        .join(seen.hint("merge"), "gram", "left")
        .withColumn("context", F.substring("gram", 1, model.order - 1))
        .join(unseen.hint("merge"), "context", "left")
        .select("gram", F.coalesce("ratio", "back", F.lit(0.0)).alias("ratio"))
    )
    back = grams.join(found.hint("merge"), "gram").select("of", "gram", "ratio")
    types = [f.dataType.simpleString() for f in picked.schema.fields[1:]]
    schema = ", ".join(f"{k} {t}" for k, t in zip([*names, "x"], [*types, "array<double>"], strict=True))
    return (
        blocks.where("gram is null").select("block", "payload").groupBy("block")
        .cogroup(back.groupBy("of"))
        .applyInArrow(_of_block(names, model.order), schema)
    )


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _model(counts: DataFrame) -> Model:
    own = counts.groupBy("gram").agg(
        F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")
    )
    return Model(ORDER, stored(ratios(stored(own, "sequences"), ORDER), "ratios"))


def _fit_curve(x: np.ndarray, y: np.ndarray, count: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton's method, with a small ridge. Rows count so many times."""
    mean = np.average(x, axis=0, weights=count)
    std = np.sqrt(np.average((x - mean) ** 2, axis=0, weights=count)) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / std]
    w = np.zeros(FEATURES + 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        ridge = 0.05 * np.r_[0.0, np.ones(FEATURES)]
        hess = (z * (count * p * (1 - p))[:, None]).T @ z + np.diag(ridge + 1e-6)
        step = np.linalg.solve(hess, z.T @ (count * (y - p)) - ridge * w)
        w += np.clip(step, -4, 4)
    slope = w[1:] / std
    return (float(w[0] - slope @ mean), *map(float, slope))


def fit(rows: DataFrame, id_col: str = "doc_id") -> Model:
    """Learn from ``(doc_id, text, toxic 0/1)``. Rows without a label, or with another, teach
    nothing. The curve is fitted on every fourth row by hash, or on about ``CURVE_ROWS`` of them if
    there are more, with a model of the other rows; the final model counts all rows. Rows that
    repeat come to the driver as one with a number. Without rows of both labels, as with an empty
    table, the curve is that of no evidence."""
    part = (F.pmod(F.xxhash64(F.col(id_col)), F.lit(4)) == 0).cast("int")
    place = F.pmod(F.xxhash64(F.col(id_col), F.lit(7)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    labelled = rows.where(F.col("toxic").isin(0, 1)).select(
        place.alias("_at"),
        text_bytes("text").alias("text"),
        (F.col("toxic") == 1).alias("toxic"),
        part.alias("part"),
    )
    counts = stored(count_sequences(labelled), "counts")
    clear_shuffles(rows.sparkSession)
    rest = _model(counts.where("part = 0"))
    apart = labelled.where("part = 1")
    rate = CURVE_ROWS / max(1, apart.count())
    sample = apart.where(F.col("_at") < rate)
    found = with_features(sample.select("text", "toxic"), rest).groupBy("x", "k0").count().toArrow()
    x = np.array(found.column("x").to_pylist(), float).reshape(-1, FEATURES)
    y = np.array(found.column("k0").to_pylist(), float)
    clear_shuffles(rows.sparkSession)
    model = _model(counts)
    if 0 < y.sum() < len(y):
        model.curve = _fit_curve(x, y, found.column("count").to_numpy())
    clear_shuffles(rows.sparkSession)
    return model


def _on_curve(x: Column, model: Model) -> Column:
    terms = F.zip_with(
        x, F.array(*(F.lit(w) for w in model.curve[1:])), lambda a, w: a * w
    )
    total = F.aggregate(terms, F.lit(model.curve[0]), lambda a, t: a + t)
    return 1 / (1 + F.exp(-total))


def with_score(rows: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The columns but the text, and ``score``: from 0 to 1, higher for toxic texts; a column of
    that name gives way to it, any other stays whatever its name. Missing and empty texts get the
    score of no words, repeated rows come back as often, an empty table empty. Takes a model of any
    size."""
    found = with_features(rows, model, text_col)
    kept = [(k, c) for k, c in zip(found.columns, (c for c in rows.columns if c != text_col), strict=False)
            if c != "score"]
    return found.select(
        *(F.col(k).alias(c) for k, c in kept), _on_curve(F.col("x"), model).alias("score")
    )

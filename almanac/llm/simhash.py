"""Near duplicates by SimHash fingerprints.

A fingerprint of 64 bits is embedded as its bit counts in 32 segments of two bits. The Manhattan
distance of two such vectors never exceeds the Hamming distance of the fingerprints, so vectors
further apart than the threshold cannot link. The vectors lie on a grid, its axes are dealt into
blocks of neighbouring segments, and a range join finds all pairs within the threshold: points at
a Manhattan distance of at most ``d`` agree in all but ``d`` of the blocks, so they share a grid
cell over some choice of ``blocks - d`` blocks. Pairs that share a cell are compared by Manhattan
distance first and by exact Hamming distance then.

Unary coding (0, 1, 2 as 00, 01, 11) turns the Manhattan distance into a bit count as well.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.llm.common import components, stored, text_bytes

SHINGLE = 4
MAX_BITS = 4
SEGMENTS = 32
#: Blocks of axes: at least so many, and as many more as keep the expected partners by chance low.
LEAST_BLOCKS, MOST_BLOCKS = 8, 12
CHANCE_PARTNERS = 8.0
#: Two random segments of two bits hold equally many ones with this probability.
SAME_COUNT = 0.375


def _fingerprint(data: bytes, size: int) -> int:
    words = data.lower().split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(size, len(words))
    n = len(words) - size + 1
    digest = xxhash.xxh64_intdigest
    counts, hashes = np.zeros(64, np.int64), []
    pairs = zip(starts[:n].tolist(), ends[size - 1 :].tolist(), strict=True)
    for at, (start, end) in enumerate(pairs, 1):
        hashes.append(digest(joined[start:end], 42))
        if len(hashes) == 100_000 or at == n:
            packed = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
            counts += np.unpackbits(packed, axis=1, bitorder="little").sum(0, dtype=np.int64)
            hashes.clear()
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprint(text: Column, size: int = SHINGLE) -> Column:
    """The fingerprint of a text as a signed long: ASCII letters lower-cased, words between ASCII
    white space, shingles of ``size`` words with repeats, hashed by XXH64 with seed 42; a bit is
    set if it is in over half of the hashes. Fewer words make one shingle, no words give zero."""

    @F.arrow_udf("long")
    def of_batch(data: pa.Array) -> pa.Array:
        return pa.array((_fingerprint(x.as_py(), size) for x in data), pa.int64())

    return of_batch(text_bytes(text))


def _unary(x: Column) -> Column:
    """Bit counts of the 32 segments, each as a unary code in the place of the segment."""
    low = F.lit(0x5555555555555555)
    half = F.shiftrightunsigned(x, 1)
    return x.bitwiseOR(half).bitwiseAND(low).bitwiseOR(
        F.shiftleft(x.bitwiseAND(half).bitwiseAND(low), 1)
    )


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def block_masks(blocks: int) -> list[int]:
    edges = [SEGMENTS * i // blocks for i in range(blocks + 1)]
    return [
        sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(edges, edges[1:], strict=False)
    ]


def blocks_for(n: int, max_bits: int = MAX_BITS) -> int:
    """How finely to divide the axes for ``n`` fingerprints: a finer division makes more cells of
    each point, but cells over more segments that fewer points share by chance."""
    for blocks in range(LEAST_BLOCKS, MOST_BLOCKS):
        kept = blocks - max_bits
        chance = SAME_COUNT ** (SEGMENTS * kept / blocks)
        if math.comb(blocks, kept) * n * chance <= CHANCE_PARTNERS:
            return blocks
    return MOST_BLOCKS


def close_pairs(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """All pairs ``(a, b)``, a < b, of different values of ``fp`` within ``max_bits`` bits.
    Exact. A pair is emitted in the first of the cells it shares only; cells hold distinct
    fingerprints, and Spark splits a cell that many share between tasks (skew join).

    Both sides are shuffled by name: Spark sees the size of the fingerprints, not that of their
    70 to 495 times as many cells, and would send these through the driver."""
    if not 0 <= max_bits < LEAST_BLOCKS:
        raise ValueError(f"max_bits must be from 0 to {LEAST_BLOCKS - 1}")
    points = prints.select("fp").where(F.col("fp").isNotNull()).distinct()
    blocks = blocks_for(points.count(), max_bits)
    masks = block_masks(blocks)
    chosen = list(combinations(range(blocks), blocks - max_bits))
    first = []  # for each set of agreeing blocks the first choice within it
    for agree in range(1 << blocks):
        own = [i for i in range(blocks) if agree >> i & 1][: blocks - max_bits]
        first.append(chosen.index(tuple(own)) if len(own) == blocks - max_bits else -1)
    grid = points.withColumn("u", _unary(F.col("fp")))
    cell = [
        F.struct(
            F.lit(k).cast("smallint").alias("choice"),
            F.col("u").bitwiseAND(F.lit(_signed(sum(masks[i] for i in own)))).alias("cell"),
        )
        for k, own in enumerate(chosen)
    ]
    cells = grid.select("fp", F.inline(F.array(*cell)))
    cells = cells.select("fp", "choice", F.xxhash64("choice", "cell").alias("cell"))
    a, b = cells.alias("a"), cells.alias("b")
    ua, ub = _unary(F.col("a.fp")), _unary(F.col("b.fp"))
    apart = ua.bitwiseXOR(ub)
    agree = F.lit(0)
    for i, mask in enumerate(masks):
        same = apart.bitwiseAND(F.lit(_signed(mask))) == 0
        agree = agree + F.when(same, F.lit(1 << i)).otherwise(F.lit(0))
    found = (
        (F.col("a.cell") == F.col("b.cell"))
        & (F.col("a.choice") == F.col("b.choice"))
        & (F.col("a.fp") < F.col("b.fp"))
        & (F.bit_count(apart) <= max_bits)
        & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= max_bits)
        & (F.element_at(F.lit(first), agree + 1) == F.col("a.choice"))
    )
    pairs = a.hint("merge").join(b.hint("merge"), found)
    return pairs.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """``(doc_id, fp, component_id)``: the fingerprint and the smallest id reachable by links.

    Equal fingerprints are one point, whatever their number. Missing and empty texts have the
    fingerprint zero and link like any other. A row without an id keeps its fingerprint; its
    component is that of the rows with ids, or missing where there are none. Repeated rows stay
    repeated. Other columns are not looked at.
    """
    return _classes(docs, id_col, text_col, size, max_bits).drop("digest")


def _digest(text_col: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(text_col, F.lit("")), 256))


def _classes(docs: DataFrame, id_col: str, text_col: str, size: int, max_bits: int) -> DataFrame:
    """As ``near_duplicates``, with the digest of the text."""
    prints = stored(
        docs.select(
            F.col(id_col).alias("doc_id"), _digest(text_col).alias("digest"),
            fingerprint(F.col(text_col), size).alias("fp"),
        ),
        "prints",
    )
    points = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    ids = points.where(F.col("first").isNotNull())
    links = (
        stored(close_pairs(prints, max_bits), "pairs")
        .join(ids.select(F.col("fp").alias("a"), F.col("first").alias("u")), "a")
        .join(ids.select(F.col("fp").alias("b"), F.col("first").alias("v")), "b")
        .select("u", "v")
    )
    reached = components(links)
    classes = points.join(reached, F.col("first") == F.col("id"), "left").select(
        "fp", F.coalesce("component", "first").alias("component_id")
    )
    return prints.join(classes, "fp").select("doc_id", "digest", "fp", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each group of near duplicates the row with the smallest id, with all its columns. An id
    that repeats with different texts is judged text by text; of its rows that would stay, the one
    with the least text does. Rows without an id all stay."""
    rows = stored(_classes(docs, id_col, text_col, SHINGLE, MAX_BITS), "classes")
    texts = rows.where(F.col("doc_id").isNotNull()).groupBy("doc_id", "digest").agg(
        F.count("*").alias("n"),
        F.first(F.col("doc_id") == F.col("component_id")).alias("stays"),  # one for each text
    )
    repeated = texts.where("stays").groupBy("doc_id").agg(F.sum("n").alias("rows")).where("rows > 1")
    several = texts.where("stays").join(repeated, "doc_id", "left_semi")
    keys = lambda t: t.select(F.col("doc_id").alias(row_id), F.col("digest").alias(digest))
    taken = {c.lower() for c in docs.columns}
    row_id, digest = (next(f"_{x}{i}" for i in range(len(taken) + 1) if f"_{x}{i}" not in taken)
                      for x in ("id", "digest"))
    quoted = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    own = docs.select(*quoted, F.col(id_col).alias(row_id), _digest(text_col).alias(digest))
    go = keys(texts.where("not stays").select("doc_id", "digest").unionByName(several.select("doc_id", "digest")))
    once = own.join(go, [row_id, digest], "left_anti").select(*quoted)
    best = own.join(keys(several), [row_id, digest], "left_semi").groupBy(row_id).agg(
        F.min_by(F.struct(*quoted), F.coalesce(text_col, F.lit(""))).alias("_row")
    )
    return once.unionByName(best.select("_row.*"))

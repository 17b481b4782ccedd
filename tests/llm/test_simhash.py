import numpy as np
import pytest
import xxhash
from conftest import SF_DIR, plan_of
from pyspark.sql import functions as F

from almanac.llm import simhash
from almanac.llm.common import components
from almanac.llm.queries import queries


def plain_print(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    size = min(4, len(words))
    hashes = [
        xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), 42)
        for i in range(len(words) - size + 1)
    ]
    return sum(
        1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)
    )


def plain_components(prints):
    """By id: the smallest id reachable."""
    ids, root = [i for i, _ in prints], {}
    value = np.array([p for _, p in prints], np.uint64)
    low = {i: i for i in ids}
    for _ in ids:
        for k, i in enumerate(ids):
            near = np.bitwise_count(value ^ value[k]) <= 4
            low[i] = min(low[ids[j]] for j in np.flatnonzero(near))
    return low or root


def test_prints_equal_the_plain_definition(spark):
    hard = ["", None, " \t\n", "one", "One TWO", "a b c d", "a b c d a b c d a b", "é ß Ü\x0bx", "x " * 9000]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(hard)], "i int, text string")
    found = dict(
        (r[0], r[1] % (1 << 64)) for r in rows.select("i", simhash.fingerprint(F.col("text"))).collect()
    )
    assert found == {i: plain_print(t or "") for i, t in enumerate(hard)}


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    found = {r[0]: (r[1], r[2]) for r in queries()["op7_simhash"](spark, SF_DIR).collect()}
    prints = [(r["doc_id"], plain_print(r["text"])) for r in docs.collect()]
    low = plain_components(prints)
    assert found == {i: (f"{p:016x}", low[i]) for i, p in prints}


def test_all_close_pairs_are_found(spark):
    draw = np.random.default_rng(3)
    base = draw.integers(0, 1 << 63, 60, dtype=np.int64).tolist()
    prints = set(base)
    for x in base:
        for flips in range(1, 8):
            y = x
            for b in draw.choice(64, flips, replace=False).tolist():
                y ^= 1 << b
            prints.add(y - (1 << 64) if y >> 63 else y)
    prints = sorted(prints)
    rows = spark.createDataFrame([(p,) for p in prints for _ in range(2)] + [(None,)], "fp long")
    for bits in (0, 2, 4):
        expected = {
            (a, b) for i, a in enumerate(prints) for b in prints[i + 1 :]
            if (a ^ b if (a ^ b) >= 0 else (a ^ b) + (1 << 64)).bit_count() <= bits
        }
        found = [tuple(r) for r in simhash.close_pairs(rows, bits).collect()]
        assert len(found) == len(set(found))
        assert {tuple(sorted(p)) for p in found} == expected


def test_cells_never_pass_through_the_driver(spark):
    prints = spark.range(60).select(F.xxhash64("id").alias("fp"))  # of known and small size
    plan = plan_of(simhash.close_pairs(prints))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_more_prints_get_a_finer_grid():
    sizes = [simhash.blocks_for(n) for n in (10, 10**6, 10**7, 10**9)]
    assert sizes == sorted(sizes) and sizes[0] == simhash.LEAST_BLOCKS and sizes[-1] > sizes[0]
    for blocks in range(8, 13):
        masks = simhash.block_masks(blocks)
        assert sum(masks) == (1 << 64) - 1 and len(masks) == blocks


ROWS = [
    (5, "The quick brown fox jumps over the lazy dog again"),
    (3, "the QUICK brown fox jumps over the lazy dog again"),
    (9, "something else entirely was written on this page today"),
    (9, "something else entirely was written on this page today"),
    (2, None), (7, ""), (None, "the quick brown fox jumps over the lazy dog again"), (None, "lonely words"),
]


def test_edge_cases(texts):
    found = simhash.near_duplicates(texts(ROWS))
    rows = sorted(((r["doc_id"], r["component_id"]) for r in found.collect()), key=str)
    assert rows == sorted(
        [(5, 3), (3, 3), (9, 9), (9, 9), (2, 2), (7, 2), (None, 3), (None, None)], key=str
    )
    assert simhash.near_duplicates(texts([])).count() == 0


def test_keep_first(texts):
    docs = texts(ROWS)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted(
        [3, 9, 2, None, None], key=str
    )
    assert simhash.keep_first(texts([])).count() == 0


def test_keep_first_judges_texts_of_an_id_apart(spark):
    """Every group keeps one row, also if an id is in two groups; columns may have any name."""
    a, b = "one text of some words that repeats", "another one, about quite different things"
    rows = [(2, a, "p"), (5, a, "q"), (5, b, "r"), (9, b, "s"), (9, b, "t"), (7, "x", "u"), (7, "", "v"), (7, "", "w")]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "_id0"]).withColumn("a.b", F.col("_id0")).withColumn("digest", F.lit(1))
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    found = sorted((r["doc_id"], r["text"]) for r in kept.collect())
    assert found == [(2, a), (5, b), (7, "")]


def test_bits_out_of_range(spark):
    with pytest.raises(ValueError):
        simhash.close_pairs(spark.createDataFrame([(1,)], "fp long"), 9)


def test_components_of_chains_hubs_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)]
    edges += [(200, 201), (201, 202), (202, 200), (202, 200), (300, 300)]
    found = dict(tuple(r) for r in components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert found == (
        dict.fromkeys(range(41), 0) | dict.fromkeys(range(100, 160), 100)
        | dict.fromkeys((200, 201, 202), 200)
    )
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0

import math

import duckdb
import numpy as np
import pytest
from conftest import SF_DIR

from almanac.llm import cover_tree
from almanac.llm.oracle import oracle_sql
from almanac.llm.queries import queries


def brute_force(rows, cosine=0.95):
    """``[(id, links, component)]`` of rows ``(id, vector)``."""
    fine = [
        (i, v) for i, v in rows
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    ]
    out = [(i, 0, i) for i, v in rows if (i, v) not in fine]
    width = max((len(v) for _, v in fine), default=1)
    m = np.array([list(v) + [0.0] * (width - len(v)) for _, v in fine], float).reshape(-1, width)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = m @ m.T >= cosine
    low = np.array([i for i, _ in fine], dtype=np.int64)
    for _ in fine:
        new = np.array([low[n].min() for n in near], dtype=np.int64)
        if (new == low).all():
            break
        low = new
    return out + [(i, int(n.sum()) - 1, int(c)) for (i, _), n, c in zip(fine, near, low, strict=True)]


def found(df, **options):
    rows = cover_tree.near_duplicates(df, **options).collect()
    for r in rows:
        assert r["kept"] == (r["vec_id"] == r["component_id"] or r["vec_id"] is None)
    return sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in rows), key=str)


def frame(spark, rows):
    kind = "vec_id long, embedding array<float>, label int, id string, n string, cell string, links string"
    return spark.createDataFrame([(i, v, 1, "x", "x", "x", "x") for i, v in rows], kind)


@pytest.mark.parametrize("block", [40, 4096])
def test_clusters_of_all_kinds(spark, block, monkeypatch):
    monkeypatch.setattr(cover_tree, "BLOCK", block)
    draw = np.random.default_rng(block)
    rows, base = [], draw.normal(size=(12, 16))
    for k, centre in enumerate(base):
        for spread in (0.0, 0.001, 0.03, 0.1):
            for _ in range(1 + k % 6):
                rows.append(centre + spread * draw.normal(size=16))
    rows += list(draw.normal(size=(60, 16)))
    order = draw.permutation(len(rows)).tolist()
    rows = [(i, [float(np.float32(x)) for x in rows[k]]) for i, k in enumerate(order)]
    assert found(frame(spark, rows)) == sorted(brute_force(rows), key=str)


def test_one_very_large_group(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "BLOCK", 64)
    draw = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in [1.0, *draw.normal(0, 0.02, 7)]]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(100)]
    assert found(frame(spark, rows)) == sorted(brute_force(rows), key=str)


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [1.0, 1.0]), (5, [2.0, 2.0]),
        (6, [1.0, None]), (None, [1.0, 1.0]), (7, []), (8, [inf, 1.0]), (5, [2.0, 2.0]),
        (9, [-1.0, -1.0]), (10, [1.0]), (11, [3.0, 0.0]), (12, [1e-38, 1e-38]), (13, [3e38, 3e38]),
    ]
    assert found(frame(spark, rows)) == sorted(brute_force_of(rows), key=str)
    assert found(frame(spark, [])) == []
    assert found(frame(spark, [(1, None), (None, None)])) == [(1, 0, 1), (None, 0, None)]
    with pytest.raises(ValueError):
        cover_tree.near_duplicates(frame(spark, rows), cosine=1.5)


def brute_force_of(rows):
    single = [(i, None if v is None else [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    odd = [(i, v) for i, v in single if v is not None and any(isinstance(x, float) and x != x for x in v)]
    rest = [r for r in single if r not in odd and r[0] != 3]
    return brute_force(rest) + [(3, 0, 3)]


def test_doubles_and_other_thresholds(spark):
    draw = np.random.default_rng(5)
    rows = [(i, (np.ones(6) + 0.4 * draw.normal(size=6)).tolist()) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for cosine in (0.8, 0.9, 0.99):
        assert found(df, cosine=cosine) == sorted(brute_force(rows, cosine), key=str)


def test_levels_cover_their_members():
    draw = np.random.default_rng(2)
    points = cover_tree._unit(np.repeat(draw.normal(size=(20, 8)), 30, axis=0) + 0.05 * draw.normal(size=(600, 8)))
    levels = cover_tree._tree(points, 0.02)
    assert len(levels) > 1
    for fine, coarse in zip(levels, levels[1:], strict=False):
        assert 2 * len(set(coarse)) <= len(set(fine))
        assert len({(f, c) for f, c in zip(fine, coarse, strict=True)}) == len(set(fine))  # nested
        assert set(coarse) <= set(fine)


def test_query_equals_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()]
    out = queries()["op6_embeddings"](spark, SF_DIR).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in out) == sorted(brute_force(rows))


@pytest.mark.parametrize("block", [4, 4096])
def test_ids_that_repeat_with_other_vectors(spark, block, monkeypatch):
    """Each row has the links of its own vector, and the smallest id that this one reaches."""
    monkeypatch.setattr(cover_tree, "BLOCK", block)
    rows = [(5, [1.0, 0.0, 0.0]), (5, [0.0, 1.0, 0.0]), (6, [1.0, 0.01, 0.0]), (2, [0.0, 1.0, 0.01]),
            (5, [0.0, 1.0, 0.0]), (9, [0.0, 0.0, 1.0]), (9, [0.0, 0.0, -1.0]), (1, [0.0, 0.0, -1.0])]
    assert found(frame(spark, rows)) == sorted(brute_force(rows), key=str)
    draw = np.random.default_rng(8)
    base = draw.normal(size=(6, 8))
    rows = [(int(draw.integers(12)), [float(np.float32(x)) for x in base[k % 6] + 0.03 * draw.normal(size=8)]) for k in range(60)]
    assert found(frame(spark, rows)) == sorted(brute_force(rows), key=str)


def test_query_equals_sql(spark):
    sf = SF_DIR.replace("0.001", "0.01")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    sql = con.execute(oracle_sql()["op6_embeddings"])
    columns = [c[0] for c in sql.description]
    out = queries()["op6_embeddings"](spark, sf)
    assert sorted(columns) == sorted(out.columns)
    assert sorted(map(tuple, out.select(*columns).collect())) == sorted(sql.fetchall())

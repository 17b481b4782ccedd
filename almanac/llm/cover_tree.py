"""Embedding near duplicates by a cover tree, traversed in pairs of nodes.

On unit vectors a cosine of at least ``t`` is a distance of at most ``e = sqrt(2 - 2t)``. The upper
level of the tree are cells around centres drawn from a bounded sample; each cell knows its
covering radius, the largest distance of a member from its centre. Two cells whose centres are
further apart than both radii and ``e`` hold no link, and a vector meets another cell only if its
distance from that centre is within that cell's radius and ``e``. Within a cell, blocks of bounded
size have nested levels of nodes with halving radii. Pairs of blocks are traversed from coarse
levels to fine ones: a pair of nodes further apart than both radii and ``e`` is dropped, one whose
farthest members are within ``e`` links as a whole, and what remains is verified by exact cosines
in double precision. So all links are found, and none below the threshold.

Equal vectors are one point, with a number of its own (ids may repeat with other vectors) and how
many they are. Of a link's vectors only counts leave a task, and one row for each point with the
first one, by smallest id, that it reaches there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.llm.common import components, stored

COSINE = 0.95
#: Vectors that centres are chosen from, taken by hash; centres at most.
SAMPLE = 4_096
MOST_CELLS = 512
#: Vectors of a block, and of a cell to aim at.
BLOCK = 4_096
_SLACK = 1e-6  # bounds are taken with room for rounding; links are exact
_PAIRS = 50_000
#: A list of pairs is worth it if it leaves out all but one of so many; else all are compared.
_DROPS = 16


def _unit(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled**2).sum(axis=1, keepdims=True))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(size), width))
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(np.arange(len(size)), size), place] = flat
    return out


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def _centres(points: np.ndarray, count: int) -> np.ndarray:
    """Each the point farthest from those before it."""
    chosen, far = [0], _distances(points, points[:1])[:, 0]
    while len(chosen) < min(count, len(points)) and far.max() > _SLACK:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _distances(points, points[chosen[-1:]])[:, 0])
    return points[chosen]


def _leaders(points: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """A net: leaders further than ``radius`` apart, and the leader of each point within it."""
    leaders: list[int] = []
    own = np.full(len(points), -1)
    for a in range(0, len(points), 256):
        part = points[a : a + 256]
        if leaders:
            far = _distances(part.astype(np.float32), points[leaders].astype(np.float32))
            best = far.argmin(axis=1)
            near = far[np.arange(len(part)), best] <= radius
            own[a : a + 256][near] = best[near]
        left = np.flatnonzero(own[a : a + 256] < 0)
        if not len(left):
            continue
        among = _distances(part[left], part[left])
        for i, k in enumerate(left):
            if own[a + k] < 0:
                reach = (own[a + left] < 0) & (among[i] <= radius)
                own[a + left[reach]] = len(leaders)
                own[a + k] = len(leaders)
                leaders.append(a + int(k))
    return np.array(leaders, np.int64), own


def _tree(points: np.ndarray, least: float) -> list[np.ndarray]:
    """Nested levels, fine to coarse, as the leader of each point. The radii double; a level that
    does not halve the nodes is left out."""
    leaders, own = _leaders(points, least)
    levels, radius = [leaders[own]], least
    while len(leaders) > 1 and radius < 1:
        radius *= 2
        upper, of = _leaders(points[leaders], radius)
        if 2 * len(upper) <= len(leaders):
            place = np.full(len(points), -1)
            place[leaders] = np.arange(len(leaders))
            levels.append(leaders[upper][of][place[levels[-1]]])
            leaders = leaders[upper]
    return levels


class _Side:
    """A block with its levels, coarse to fine: centres, radii, and the parent of each node."""

    def __init__(self, points: np.ndarray, levels: list[list[int]]):
        self.points, self.levels = points, []
        above = None
        for path in reversed(levels):
            nodes, of = np.unique(path, return_inverse=True)
            away = np.sqrt(((points - points[nodes[of]]) ** 2).sum(axis=1))
            radius = np.zeros(len(nodes))
            np.maximum.at(radius, of, away)
            parent = None
            if above is not None:
                parent = np.zeros(len(nodes), np.int64)
                parent[of] = above
            self.levels.append((points[nodes], radius, parent))
            above = of
        self.leaf = above
        order = np.argsort(above, kind="stable")
        self.members, count = order, np.bincount(above)
        self.begin, self.count = np.cumsum(count) - count, count


def _bounded(ca: np.ndarray, ra: np.ndarray, cb: np.ndarray, rb: np.ndarray, reach: float,
             pairs: np.ndarray) -> np.ndarray:
    """Those pairs of nodes that are not further apart than both radii and ``reach``."""
    stay = [pairs[:0]]
    for c in range(0, len(pairs), _PAIRS):
        x, y = pairs[c : c + _PAIRS].T
        far = np.sqrt(((ca[x] - cb[y]) ** 2).sum(axis=1))
        stay.append(pairs[c : c + _PAIRS][far <= ra[x] + rb[y] + reach + _SLACK])
    return np.concatenate(stay)


def _all_bounded(ca: np.ndarray, ra: np.ndarray, cb: np.ndarray, rb: np.ndarray, reach: float,
                 last: bool) -> np.ndarray | None:
    """The same of all pairs of a level, by products of matrices in single precision first. None if
    the level drops too few to be worth it, and is not the last."""
    found, n = [np.zeros((0, 2), np.int64)], 0
    ca32, cb32 = ca.astype(np.float32), cb.T.astype(np.float32)
    far = np.minimum(ra + rb.max() + reach + 1e-3, 2.0)  # 1e-3: single precision
    least = (1 - far**2 / 2).astype(np.float32)[:, None]
    for c in range(0, len(ca), 1024):
        near = np.argwhere(ca32[c : c + 1024] @ cb32 >= least[c : c + 1024])
        n += len(near)
        if not last and _DROPS * n > len(ca) * len(cb):
            return None
        near[:, 0] += c
        found.append(near)
    return _bounded(ca, ra, cb, rb, reach, np.concatenate(found))


def _leaf_pairs(a: _Side, b: _Side, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of leaves that may link, and whether all their members do."""
    pairs, depth = None, max(len(a.levels), len(b.levels))
    for step in range(depth):
        ka = max(0, step - depth + len(a.levels))
        kb = max(0, step - depth + len(b.levels))
        (ca, ra, above_a), (cb, rb, above_b) = a.levels[ka], b.levels[kb]
        if pairs is not None:
            # The side with fewer levels waits until both are as fine.
            sons_a = _sons(above_a) if step - depth + len(a.levels) > 0 else None
            sons_b = _sons(above_b) if step - depth + len(b.levels) > 0 else None
            size = np.ones(len(pairs), np.int64)
            for sons, own in ((sons_a, pairs[:, 0]), (sons_b, pairs[:, 1])):
                size *= 1 if sons is None else sons[2][own]
            if _DROPS * int(size.sum()) <= len(ca) * len(cb):
                pairs = _bounded(ca, ra, cb, rb, reach, _expand(pairs, sons_a, sons_b))
                continue
        pairs = _all_bounded(ca, ra, cb, rb, reach, last=step == depth - 1)
    (ca, ra, _), (cb, rb, _) = a.levels[-1], b.levels[-1]
    whole = np.zeros(len(pairs), bool)
    for c in range(0, len(pairs), _PAIRS):
        x, y = pairs[c : c + _PAIRS].T
        far = np.sqrt(((ca[x] - cb[y]) ** 2).sum(axis=1))
        whole[c : c + _PAIRS] = far + ra[x] + rb[y] <= reach - _SLACK
    return pairs, whole


def _sons(parent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(parent, kind="stable")
    count = np.bincount(parent)
    return order, np.cumsum(count) - count, count


def _product(first: tuple, second: tuple, pairs: np.ndarray) -> np.ndarray:
    """For pairs of groups, given as (members, begin, count), all pairs of their members."""
    (ma, ba, na), (mb, bb, nb) = first, second
    x, y = pairs.T
    size = na[x] * nb[y]
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    width = np.repeat(nb[y], size)
    left = ma[np.repeat(ba[x], size) + at // width]
    return np.stack([left, mb[np.repeat(bb[y], size) + at % width]], axis=1)


def _expand(pairs: np.ndarray, a: tuple | None, b: tuple | None) -> np.ndarray:
    same = lambda k: (np.arange(k + 1), np.arange(k + 1), np.ones(k + 1, np.int64))
    if not len(pairs):
        return pairs
    top = pairs.max(axis=0).tolist()
    return _product(a or same(top[0]), b or same(top[1]), pairs)


def _links(a: _Side, b: _Side, na: np.ndarray, nb: np.ndarray, ids_a: np.ndarray,
           ids_b: np.ndarray, cosine: float, same: bool) -> tuple:
    """How many vectors each point links to on the other side, and the pairs that connect."""
    reach = math.sqrt(2 - 2 * cosine)
    count_a, count_b = np.zeros(len(na), np.int64), np.zeros(len(nb), np.int64)
    joined: list[np.ndarray] = []
    pairs, whole = _leaf_pairs(a, b, reach)
    if same:
        pairs, whole = pairs[keep := pairs[:, 0] <= pairs[:, 1]], whole[keep]
    sum_a = np.bincount(a.leaf, na, minlength=len(a.count)).astype(np.int64)
    sum_b = np.bincount(b.leaf, nb, minlength=len(b.count)).astype(np.int64)
    for x, y in pairs[whole].tolist():
        own = a.members[a.begin[x] : a.begin[x] + a.count[x]]
        other = b.members[b.begin[y] : b.begin[y] + b.count[y]]
        count_a[own] += sum_b[y]
        if same and x == y:
            count_a[own] -= na[own]
        else:
            count_b[other] += sum_a[x]
        joined += [np.stack([own, np.full(len(own), other[0])], axis=1),
                   np.stack([np.full(len(other), own[0]), other], axis=1)]
    rest = pairs[~whole]
    size = a.count[rest[:, 0]] * b.count[rest[:, 1]]
    part = np.cumsum(size) // (4 * _PAIRS)
    for k in np.unique(part):
        own = _product((a.members, a.begin, a.count), (b.members, b.begin, b.count),
                       rest[part == k])
        for c in range(0, len(own), _PAIRS):
            x, y = own[c : c + _PAIRS].T
            if same:  # a pair of leaves is there once; within a leaf both orders are
                once = (a.leaf[x] != a.leaf[y]) | (x < y)
                x, y = x[once], y[once]
            hit = np.einsum("ij,ij->i", a.points[x], b.points[y]) >= cosine
            x, y = x[hit], y[hit]
            count_a += np.bincount(x, nb[y], minlength=len(na)).astype(np.int64)
            count_b += np.bincount(y, na[x], minlength=len(nb)).astype(np.int64)
            joined.append(np.stack([x, y], axis=1))
    pairs = np.concatenate(joined) if joined else np.zeros((0, 2), np.int64)
    return count_a, count_b, ids_a[pairs[:, 0]], ids_b[pairs[:, 1]]


def _lows(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each number among the links the smallest one reached."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = at[: len(u)], at[len(u) :]
    low = np.arange(len(ids))
    while True:
        new = low.copy()
        np.minimum.at(new, x, low[y])
        np.minimum.at(new, y, low[x])
        new = new[new]
        if (new == low).all():
            return ids, ids[low]
        low = new


def _usable(vector: Column) -> Column:
    """Neither missing nor zero, all components finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _by_block(width: int, cosine: float):
    least = math.sqrt(2 - 2 * cosine) / 4

    def of_block(key: tuple, rows: pa.Table) -> pa.Table:
        levels = _tree(_unit(_matrix(rows.column("vector"), width)), least)
        paths = pa.array(np.stack(levels, axis=1).tolist(), pa.list_(pa.int32()))
        place = pa.array(np.arange(rows.num_rows), pa.int32())
        return rows.append_column("levels", paths).append_column("place", place)

    return of_block


def _by_pair(width: int, cosine: float):
    def side(rows: pa.Table) -> tuple:
        points = _unit(_matrix(rows.column("vector"), width))
        levels = np.array(rows.column("levels").to_pylist(), np.int64).T
        place = {k: i for i, k in enumerate(rows.column("place").to_pylist())}
        # Leaders are named by their place in the block. Members that came here without their
        # leader take the first of them in its stead; radii are measured anew.
        own = []
        for path in levels:
            first: dict[int, int] = {}
            for i, k in enumerate(path.tolist()):
                first.setdefault(k, i)
            lead = np.array([place.get(k, first[k]) for k in path.tolist()])
            own.append(lead)
        return (_Side(points, own), *(rows.column(c).to_numpy() for c in ("n", "id", "point")))

    def of_pair(key: tuple, rows: pa.Table) -> pa.Table:
        is_left = rows.column("right").to_numpy() == 0
        left = rows.filter(pa.array(is_left))
        right = rows.filter(pa.array(~is_left))
        same = key[0].as_py() == key[2].as_py() and key[1].as_py() == key[3].as_py()
        out = pa.schema([(c, pa.int64()) for c in ("id", "point", "links", "low_id", "low_point")])
        if left.num_rows == 0 or (right.num_rows == 0 and not same):
            return out.empty_table()
        a, na, ids_a, points_a = side(left)
        b, nb, ids_b, points_b = (a, na, ids_a, points_a) if same else side(right)
        # Points by rank: by id, then number.
        ids, points = np.concatenate([ids_a, ids_b]), np.concatenate([points_a, points_b])
        points, first, at = np.unique(points, return_index=True, return_inverse=True)
        order = np.lexsort((points, ids[first]))
        ids, points = ids[first][order], points[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        every = rank[at]
        count_a, count_b, u, v = _links(
            a, b, na, nb, every[: len(ids_a)], every[len(ids_a) :], cosine, same
        )
        linked, low = _lows(u, v)
        total = np.bincount(every, np.concatenate([count_a, count_b]), minlength=len(ids))
        some = np.flatnonzero(total)
        low = low[np.searchsorted(linked, some)]
        return pa.table(
            [ids[some], points[some], total[some].astype(np.int64), ids[low], points[low]], schema=out
        )

    return of_pair


def near_duplicates(
    vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``: for each vector how many others link with it, and
    the smallest id reachable by links; the vector of that id is kept.

    Vectors that are missing, empty, zero, or hold a missing or non-finite component link with
    nothing, nor do vectors without an id (their component is missing). Shorter vectors count as
    ending in zeros. A repeated row is another vector with the same id, and so is a row with the
    same id and another vector: each has the links of its own vector. An empty table gives no rows.
    Other columns are not looked at.
    """
    if not 0 < cosine < 1:
        raise ValueError("the cosine has to be between 0 and 1")
    all_rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector")
    )
    fine = all_rows.where(_usable(F.col("vector")) & F.col("vec_id").isNotNull())
    points = stored(
        fine.groupBy("vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"))
        .withColumn("point", F.monotonically_increasing_id()),
        "points",
    )
    total, width = points.agg(F.count("*"), F.max(F.size("vector"))).first()
    spark = vectors.sparkSession
    if not total:
        return _alone(all_rows)
    sample = points.orderBy(F.xxhash64("id")).limit(SAMPLE).select("vector").toArrow()
    drawn = _unit(_matrix(sample.column(0), width))
    cells = min(MOST_CELLS, max(1, math.ceil(total / BLOCK)))
    centres = spark.sparkContext.broadcast(_centres(drawn, cells))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far = _distances(_unit(_matrix(batch.column(0), width)), centres.value)
                own = far.argmin(axis=1)
                yield pa.record_batch(
                    [*batch.columns, pa.array(own, pa.int32()),
                     pa.array(far[np.arange(len(own)), own])],
                    ["vector", "id", "n", "point", "cell", "far"],
                )

    kind = points.schema["vector"].dataType.simpleString()
    base = f"vector {kind}, id long, n long, point long"
    assigned = points.mapInArrow(assign, f"{base}, cell int, far double")
    assigned = stored(assigned, "cells")
    about = {r["cell"]: (r["size"], r["radius"]) for r in assigned.groupBy("cell").agg(
        F.count("*").alias("size"), F.max("far").alias("radius")).collect()}
    blocks = np.array([math.ceil(about.get(c, (0, 0))[0] / BLOCK) for c in range(cells)])
    radius = np.array([about.get(c, (0, -9.0))[1] for c in range(cells)])
    reach = math.sqrt(2 - 2 * cosine)
    split = F.element_at(F.lit([max(1, int(b)) for b in blocks]), F.col("cell") + 1)
    with_block = assigned.withColumn("block", F.pmod(F.xxhash64("id"), split).cast("int"))
    shape = f"{base}, cell int, far double, block int, levels array<int>, place int"
    trees = stored(
        with_block.groupBy("cell", "block").applyInArrow(_by_block(width, cosine), shape), "trees"
    )
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            far = _distances(_unit(_matrix(batch.column("vector"), width)), centres.value)
            near = far[:, : len(blocks)] <= radius[None, : far.shape[1]] + reach + _SLACK
            cell = batch.column("cell").to_numpy()
            block = batch.column("block").to_numpy()
            row, other = np.nonzero(near)
            own = cell[row]
            size = blocks[other]
            row, other, own = (np.repeat(x, size) for x in (row, other, own))
            theirs = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            mine = block[row]
            right = (own > other) | ((own == other) & (mine > theirs))
            a, i = np.where(right, other, own), np.where(right, theirs, mine)
            b, j = np.where(right, own, other), np.where(right, mine, theirs)
            for c in range(0, len(row), 20_000):
                part = slice(c, c + 20_000)
                keys = [pa.array(x[part], pa.int32()) for x in (a, i, b, j)]
                sent = batch.select(["vector", "id", "n", "point", "levels", "place"]).take(
                    pa.array(row[part])
                )
                yield pa.record_batch(
                    [*sent.columns, *keys, pa.array(right[part].astype(np.int32))],
                    ["vector", "id", "n", "point", "levels", "place", "a", "i", "b", "j", "right"],
                )

    keyed = f"{base}, levels array<int>, place int, a int, i int, b int, j int, right int"
    found = stored(
        trees.mapInArrow(send, keyed).groupBy("a", "i", "b", "j")
        .applyInArrow(_by_pair(width, cosine), "id long, point long, links long, low_id long, low_point long"),
        "links",
    )
    # Points in the order of ids: the first of a component has its smallest id.
    reached = components(found.select(
        F.struct(F.col("id"), F.col("point")).alias("u"),
        F.struct(F.col("low_id").alias("id"), F.col("low_point").alias("point")).alias("v"),
    )).select(F.col("id.point").alias("point"), F.col("component.id").alias("component"))
    links = found.groupBy("point").agg(F.sum("links").alias("links"))
    points = points.join(links, "point", "left").join(reached, "point", "left")
    owners = fine.join(
        points.select(
            "vector", F.col("id").alias("first"), "n", F.coalesce("links", F.lit(0)).alias("links"),
            F.coalesce("component", "id").alias("component"),
        ),
        "vector",
    )
    linked = owners.select(
        "vec_id", (F.col("links") + F.col("n") - 1).alias("n_links"),
        F.col("component").alias("component_id"),
    )
    kept = F.col("vec_id") == F.col("component_id")
    return linked.withColumn("kept", kept).unionByName(_alone(all_rows))


def _alone(rows: DataFrame) -> DataFrame:
    """Rows that link with nothing, whatever their vector."""
    return rows.where(~_usable(F.col("vector")) | F.col("vec_id").isNull()).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
        F.lit(True).alias("kept"),
    )

"""Joins of uneven objects, images cut into blocks, and batches of geometry, against brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesselle.functions import boxes, polygons, shapes
from tesselle.operators import masks, partition, reconstruction, tiles
from tesselle.operators import spatial_join as sj
from tesselle.operators.graph import label_components

SCHEMA = "id long, x0 double, y0 double, x1 double, y1 double"


def uneven(seed: int, n: int) -> list[tuple]:
    """Points, a dense cluster, usual boxes, and a few that are as wide as the space."""
    r, out = random.Random(seed), []
    for k in range(n):
        kind = r.randrange(6)
        x, y = (50 + r.random() * 0.05, 50 + r.random() * 0.05) if kind < 2 else (r.random() * 1000, r.random() * 1000)
        w, h = [(0.0, 0.0), (0.001, 0.002), (3.0, 1.0), (8.0, 20.0), (1.0, 1.0), (0.0, 5.0)][kind]
        out.append((k, x, y, x + w, y + h))
    return [*out, (n, -10.0, -10.0, 1100.0, 1100.0), (n + 1, 0.0, 400.0, 1000.0, 401.0), (n + 2, 0.0, 0.0, 0.0, 0.0), (n + 3, 4.0, 4.0, 4.0, 4.0)]


@pytest.mark.parametrize("d", [0.0, 2.5, 600.0])
def test_join_of_uneven_boxes(spark, d):
    a, b = uneven(1, 120), uneven(2, 90)
    got = sj.spatial_join(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), lambda p, q: boxes.within_distance(p, q, d), d)
    gap = lambda p, q: math.hypot(max(p[1] - q[3], q[1] - p[3], 0), max(p[2] - q[4], q[2] - p[4], 0))
    assert sorted((r.a_id, r.b_id) for r in got.collect()) == sorted((p[0], q[0]) for p in a for q in b if gap(p, q) <= d)


def test_join_plan_has_no_nested_loop(spark):
    a = spark.createDataFrame(uneven(1, 50), SCHEMA)
    tiles = a.limit(9).withColumnRenamed("id", "tile_id")
    for df in (sj.spatial_join(a, a, boxes.intersects), partition.to_tiles(a, tiles)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_candidates_of_clusters_and_wide_boxes_stay_few(spark):
    """2,000 boxes in a spot, 2,000 spread ones, and one as wide as the space: candidates grow with the pairs that meet."""
    r = random.Random(3)
    spot = [(k, x := 500 + r.random(), y := 500 + r.random(), x + 0.004, y + 0.004) for k in range(2000)]
    spread = [(2000 + k, x := r.random() * 1000, y := r.random() * 1000, x + 3, y + 3) for k in range(2000)]
    rows = spark.createDataFrame([*spot, *spread, (9999, 0.0, 0.0, 1003.0, 1003.0)], SCHEMA)
    _, has_a, _ = sj.levels(rows, rows, 0.0)
    assert len(has_a) == 3
    pairs = sj.spatial_join(rows, rows, boxes.intersects).count()
    plan_rows = sum(1 for p in spot for q in spot if abs(p[1] - q[1]) < 0.016 and abs(p[2] - q[2]) < 0.016)
    assert 12_000 < pairs < 20_000 + plan_rows


def test_extra_keys_are_part_of_the_join(spark):
    rows = [(k, 0.0, 0.0, 1.0, 1.0, k % 3) for k in range(9)]
    df = spark.createDataFrame(rows, SCHEMA + ", image int")
    assert sj.spatial_join(df, df, boxes.intersects, on=["image"]).count() == 27


def test_disjoint_pairs_and_counts(spark):
    a, b = uneven(4, 40), uneven(5, 30)
    one, two = spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)
    meet = lambda p, q: p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]
    assert {(r.a_id, r.b_id) for r in sj.disjoint(one, two).collect()} == {(p[0], q[0]) for p in a for q in b if not meet(p, q)}
    assert {tuple(r) for r in sj.disjoint_counts(one, two).collect()} == {(p[0], sum(not meet(p, q) for q in b)) for p in a}


def test_earth_within_at_the_poles_and_the_date_line(spark):
    r = random.Random(6)
    points = [(k, r.choice([r.uniform(-90, 90), 90 - r.random() * 3, -90 + r.random() * 3]), r.choice([r.uniform(-180, 180), 180 - r.random(), -180 + r.random()])) for k in range(150)]

    def metres(p, q):
        u, v = math.radians(p[1]), math.radians(q[1])
        h = math.sin((v - u) / 2) ** 2 + math.cos(u) * math.cos(v) * math.sin(math.radians(q[2] - p[2]) / 2) ** 2
        return 2 * boxes.EARTH_MILES * boxes.METRES * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    df = spark.createDataFrame(points, "id long, lat double, lon double")
    for d in (150_000.0, 2_000_000.0, 15_000_000.0):
        got = {(x.a_id, x.b_id) for x in sj.earth_within(df, df, d).collect()}
        assert got == {(p[0], q[0]) for p in points for q in points if metres(p, q) <= d}


@pytest.mark.parametrize("block", [3, 8, 512])
def test_connected_is_independent_of_blocks(spark, block):
    r = random.Random(7)
    on = {(t, y + (70_000 if t else 0), x) for t in (0, 1) for y in range(20) for x in range(20) if r.random() < 0.45}
    on |= {(2, 5, x) for x in range(30)} | {(2, y, 29) for y in range(5, 30)}
    got = {(x.tile, x.y, x.x): x.label for x in masks.connected(spark.createDataFrame([(*p, 1) for p in on] + [(0, 0, 0, 0), (0, None, 1, 1)], "tile int, y int, x int, label int"), block).collect()}
    want, left = {}, set(on)
    for start in sorted(on):
        if start in left:
            left.discard(start)
            stack = [start]
            while stack:
                t, y, x = stack.pop()
                want[t, y, x] = start[1] * masks.STRIDE + start[2] + 1
                near = {(t, y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)} & left
                left -= near
                stack += near
    assert got == want


def test_components(spark):
    links = [(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (20, 9), (20, 30), (None, 1)]
    got = {r.node: r.component for r in label_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8, 20: 8, 30: 8}
    assert label_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_distance_transform_raises_when_rounds_run_out(spark):
    df = spark.createDataFrame([(y, x, 1) for y in range(12) for x in range(12)], "y int, x int, label int")
    with pytest.raises(ValueError, match="rounds"):
        masks.distance_transform(df, 4, rounds=1)
    assert masks.distance_transform(df.limit(0), 4).count() == 0


def test_reconstruction_is_the_brute_force_one(spark):
    r = random.Random(8)
    rows = [(y, x, r.randrange(6) if r.random() < 0.05 else 0, r.randrange(6)) for y in range(-5, 18) for x in range(21) if r.random() < 0.9]
    mask = {(y, x): m for y, x, _, m in rows}
    level = {(y, x): min(v, m) for y, x, v, m in rows}
    while True:
        new = {p: max([level[p], *(min(mask[p], level.get((p[0] + dy, p[1] + dx), 0)) for dy in (-1, 0, 1) for dx in (-1, 0, 1))]) for p in level}
        if new == level:
            break
        level = new
    df = spark.createDataFrame([*rows, (None, 3, 1, 1)], "y int, x int, marker int, mask int")
    for tile in (4, 9, 64):
        assert {(x.y, x.x): x.value for x in reconstruction.reconstruct(df, tile).collect()} == level
    with pytest.raises(ValueError, match="rounds"):
        reconstruction.reconstruct(df, 4, rounds=1)


def test_batches_of_triangles_are_measured_as_one_by_one():
    rng = np.random.default_rng(9)
    p, q = rng.integers(0, 9, (2, 4000, 3, 2)).astype(float)
    cross = lambda t: (t[:, 1, 0] - t[:, 0, 0]) * (t[:, 2, 1] - t[:, 0, 1]) - (t[:, 1, 1] - t[:, 0, 1]) * (t[:, 2, 0] - t[:, 0, 0])
    whole = (cross(p) != 0) & (cross(q) != 0)
    p, q = p[whole], q[whole]
    p[cross(p) < 0] = p[cross(p) < 0][:, ::-1]
    q[cross(q) < 0] = q[cross(q) < 0][:, ::-1]
    areas, meet = polygons.common_areas(p, q), polygons.triangles_meet(p, q)
    for k in range(len(p)):
        one, two = [tuple(x) for x in p[k]], [tuple(x) for x in q[k]]
        assert meet[k] == shapes.convex_intersects(one, two)
        assert areas[k] == pytest.approx(shapes.polygon_area(shapes.clip(one, two)), abs=1e-9)


def test_pairs_of_a_small_dense_table_are_shared_out(spark):
    """4,000 boxes make 8 million candidates or so: few bytes to shuffle, but too many pairs for one task."""
    r = random.Random(5)
    rows = [(k, x := r.random() * 100, y := r.random() * 100, x + 1 + r.random() * 14, y + 1 + r.random() * 14) for k in range(4000)]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    pairs = sj.spatial_join(df, df, boxes.intersects)
    shares = [x["count"] for x in pairs.groupBy(F.spark_partition_id()).count().collect()]
    low, high = (np.array([x[k : k + 2] for x in rows]) for k in (1, 3))
    want = sum(int(((low <= high[k]) & (low[k] <= high)).all(axis=1).sum()) for k in range(4000))
    assert sum(shares) == want and max(shares) < 0.8 * want


def test_tiles_hold_bounded_parts_and_each_near_pair_once(spark):
    a, b = uneven(11, 150) + [(1000 + k, 7.0, 7.0, 9.0, 9.0) for k in range(100)], uneven(12, 120) + [(2000 + k, 8.0, 8.0, 8.0, 8.0) for k in range(80)]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        one, two = tiles.numbers(left), tiles.numbers(right)
        pairs = [(p, q) for at, among in tiles.near(one, two, 2.5, 8) for p, q in zip(*np.nonzero(tiles.distances(one[at], two[among]) <= 2.5), strict=True) for p, q in [(at[p], among[q])]]
        ids = lambda table, k: pa.array([table["id"][int(x[k])].as_py() for x in pairs], pa.int64())
        return pa.table({"u": ids(left, 0), "v": ids(right, 1), "n": pa.array([len(left)] * len(pairs), pa.int64()), "m": pa.array([len(right)] * len(pairs), pa.int64())})

    got = tiles.in_tiles(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), 2.5, run, "u long, v long, n long, m long", (20, 30)).collect()
    gap = lambda p, q: math.hypot(max(p[1] - q[3], q[1] - p[3], 0), max(p[2] - q[4], q[2] - p[4], 0))
    assert sorted((x.u, x.v) for x in got) == sorted((p[0], q[0]) for p in a for q in b if gap(p, q) <= 2.5)
    assert max(x.n for x in got) < 60 and max(x.m for x in got) < 90


@pytest.mark.parametrize(("k", "bound"), [(3, 40.0), (20, 5.0)])
def test_nearest_of_uneven_boxes(spark, k, bound):
    """Ties by id, far boxes, and rows that share an id or have none, which are ranked together."""
    a, b = [*uneven(21, 90), (None, 3.0, 3.0, 4.0, 4.0), (5, 900.0, 900.0, 901.0, 901.0)], [*uneven(22, 110), *[(300 - n, 900.0, 900.0, 901.0, 901.0) for n in range(40)]]
    got = sj.nearest(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), k, bound).collect()
    gap = lambda p, q: math.sqrt(max(p[1] - q[3], q[1] - p[3], 0) ** 2 + max(p[2] - q[4], q[2] - p[4], 0) ** 2)
    want = []
    for name in {x[0] for x in a}:
        found = sorted((gap(p, q), q[0]) for p in a if p[0] == name for q in b if gap(p, q) < bound)[:k]
        want += [(name, other, round(d, 9), n) for n, (d, other) in enumerate(found, 1)]
    assert sorted(((x.a_id, x.b_id, round(x.distance, 9), x["rank"]) for x in got), key=str) == sorted(want, key=str)


def test_tasks_grow_in_number_and_not_in_length_with_copies_of_a_table(spark):
    """Copies of a table in the same space make pairs with the square of their number; a task's candidates stay as many."""
    r = random.Random(31)
    rows = [(k, x := r.random() * 1000, y := r.random() * 1000, x + 1 + r.random() * 6, y + 1 + r.random() * 4) for k in range(2000)]
    df = spark.createDataFrame(rows, SCHEMA)
    e = sj.extents(df, df, 0.0)
    tasks = []
    for copies in (60, 600, 3600):
        side = {k: sj.Extent(x.n * copies, x.most, tuple(t * copies for t in x.total)) for k, x in e.a.items()}
        grids = [*sj._grids(side, side, e, False, None), *sj._grids(side, side, e, True, None)]
        candidates = sum(g.candidates for g in grids)
        tasks.append(sj.partitions(df, sum(g.copies for g in grids), candidates))
        assert candidates / tasks[-1] <= 8_000_000
    assert tasks[0] < tasks[1] < tasks[2]

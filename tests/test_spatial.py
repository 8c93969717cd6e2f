"""Tiled joins, neighbours and partitioners against brute force; convex geometry by hand."""

from __future__ import annotations

import math
import random
import time

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tesselle.functions import boxes, shapes
from tesselle.operators import masks, params, partition, regions, tuning
from tesselle.operators import spatial_join as sj
from tesselle.sources import files
from tesselle.streaming import continuous

SCHEMA = "id long, x0 long, y0 long, x1 long, y1 long"


def some(seed, n):
    r = random.Random(seed)
    out = []
    for k in range(n):
        x, y = r.randrange(100), r.randrange(100)
        out.append((k, x, y, x + r.randrange(1, 9), y + r.randrange(1, 9)))
    return out


@pytest.mark.parametrize("cell", [3.0, 17.0, 1000.0])
def test_join_is_the_brute_force_join(spark, cell):
    a, b = some(1, 60), some(2, 50)
    got = sj.spatial_join(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), boxes.intersects, cell=cell)
    want = [(p[0], q[0]) for p in a for q in b if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]]
    assert sorted((r.a_id, r.b_id) for r in got.collect()) == sorted(want)


def test_empty_and_null_boxes_meet_nothing(spark):
    a = spark.createDataFrame([(1, None, 0, 5, 5)], SCHEMA)
    assert sj.spatial_join(a, a, boxes.intersects).count() == 0
    assert sj.nearest_unbounded(a.limit(0), a.limit(0), 2).count() == 0


def test_nearest_unbounded(spark):
    a, b = some(3, 30), some(4, 40)
    gap = lambda p, q: math.hypot(max(p[1] - q[3], q[1] - p[3], 0), max(p[2] - q[4], q[2] - p[4], 0))
    got = {}
    for r in sj.nearest_unbounded(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), 3).collect():
        got.setdefault(r.a_id, []).append((r["rank"], r.b_id))
    for p in a:
        assert [x for _, x in sorted(got[p[0]])] == [q[0] for q in sorted(b, key=lambda q: (gap(p, q), q[0]))[:3]]


@pytest.mark.parametrize("make", [partition.hilbert_tiles, partition.binary_tiles, partition.strip_tiles])
def test_every_object_has_a_tile(spark, make):
    a = spark.createDataFrame(some(5, 200), SCHEMA)
    tiles = make(a, 20)
    assert tiles.count() > 4
    assert partition.to_tiles(a, tiles).select("id").distinct().count() == 200


@pytest.mark.parametrize("make", [partition.binary_tiles, partition.strip_tiles])
def test_every_object_has_a_tile_beyond_the_sample(spark, make, monkeypatch):
    monkeypatch.setattr(partition, "SAMPLE", 100)
    far = [(1000 + k, x, y, x + 1, y + 1) for k, (x, y) in enumerate((sx * (5000 + 100 * k), sy * (5000 + 100 * k)) for k in range(5) for sx in (-1, 1) for sy in (-1, 1))]
    a = spark.createDataFrame(some(5, 1000) + far, SCHEMA)
    assert partition.to_tiles(a, make(a, 50)).select("id").distinct().count() == 1020


def test_hilbert_visits_neighbours(spark):
    cells = spark.range(64).selectExpr("id div 8 as x", "id % 8 as y")
    order = [(r.x, r.y) for r in cells.withColumn("h", shapes.hilbert(cells.x, cells.y, 3)).orderBy("h").collect()]
    assert all(abs(p[0] - q[0]) + abs(p[1] - q[1]) == 1 for p, q in zip(order, order[1:], strict=False))


def test_convex_shapes():
    square, other = [(0, 0), (2, 0), (2, 2), (0, 2)], [(1, 1), (3, 1), (3, 3), (1, 3)]
    assert shapes.polygon_area(shapes.clip(square, other)) == 1
    assert shapes.convex_intersects(square, [(2, 2), (3, 2), (3, 3)]) and not shapes.convex_intersects(square, [(2.1, 2), (3, 2), (3, 3)])
    assert shapes.convex_distance(square, [(5, 0), (6, 0), (6, 1)]) == 3
    assert shapes.convex_hull([(0, 0), (1, 1), (2, 2), (2, 0), (0, 2), (1, 0)]) == [(0, 0), (2, 0), (2, 2), (0, 2)]


@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20)), min_size=3, max_size=9), st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20)), min_size=3, max_size=9))
def test_clip_is_no_larger_than_either(p, q):
    a, b = shapes.convex_hull(p), shapes.convex_hull(q)
    if len(a) > 2 and len(b) > 2:
        assert shapes.polygon_area(shapes.clip(a, b)) <= min(shapes.polygon_area(a), shapes.polygon_area(b)) + 1e-6


def test_wkt(spark):
    df = spark.createDataFrame([("POLYGON((0 0,4 0,4 3,0 0))",), ("POINT(1 2)",), ("POLYGON((0 0,a 1))",), (None,), ("",)], "t string")
    got = [r.r for r in df.select(shapes.ring_of(df.t).alias("r")).collect()]
    assert [len(x) if x else None for x in got] == [4, 1, None, None, None]


def test_box_functions(spark):
    row = spark.range(1).select(*[c.alias(n) for n, c in zip("abcdef", regions.box_intersection([_lit(v) for v in (1, 2, 0, 2, 4, 0)], [_lit(v) for v in (2, 3, 0, 2, 4, 0)]), strict=True)]).first()
    assert tuple(row) == (2, 3, 0, 2, 4, 0)


def _lit(v):
    from pyspark.sql import functions as F

    return F.lit(v)


def test_grid_sizes(spark):
    assert params.grid(spark, {"a": [1, 2], "b": [1, 2, 3], "c": [1, 2, 3, 4]}).distinct().count() == 24
    g = params.grid(spark, {"a": [1, 2], "b": [1.3, 2.3, 2.4], "c": ["x", "y"]})
    assert g.count() == 12 and [r.c for r in g.orderBy("param_set_id").limit(3).collect()] == ["x", "y", "x"]


def test_strategies_find_the_minimum():
    axes = [tuning.Axis(0, 10, 1), tuning.Axis(0, 10, 1)]
    score = lambda p: ((p - np.array([3, 7])) ** 2).sum(axis=1)
    assert tuning.exhaustive(axes, score).best() == ((3.0, 7.0), 0.0)
    for memo in (tuning.nelder_mead(axes, score), tuning.rank_order(axes, score), tuning.genetic(axes, score, 10, 20, 4)):
        assert memo.best()[1] <= 2
    with pytest.raises(ValueError):
        tuning.genetic(axes, score, 1, 3, 1)
    assert tuning.morris(axes, 12, 4).shape == (12, 2)


def test_distance_transform_is_independent_of_tiles(spark):
    r = random.Random(9)
    on = {(y, x) for y in range(24) for x in range(24) if r.random() < 0.85}
    df = spark.createDataFrame([(y, x, 1) for y, x in on], "y int, x int, label int")
    got = {(v.y, v.x): v.distance for v in masks.distance_transform(df, 8).collect()}
    off = {(y, x) for y in range(-1, 25) for x in range(-1, 25)} - on
    assert got == {p: min(abs(p[0] - y) + abs(p[1] - x) for y, x in off) for p in on}


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "m.txt").write_text("3 2\n0 1 1\n2 0 0\n")
    got = files.read_mask_text(spark, str(tmp_path / "m.txt")).orderBy("y", "x").collect()
    assert [(r.y, r.x, r.label) for r in got] == [(0, 0, 0), (0, 1, 1), (0, 2, 1), (1, 0, 2), (1, 1, 0), (1, 2, 0)]
    (tmp_path / "v.vec").write_bytes(files.vectors_to_bytes([[1.5, 2.0], [], [3.0]]))
    assert files.read_vectors(spark, str(tmp_path / "v.vec")).first().vectors == [[1.5, 2.0], [], [3.0]]
    (tmp_path / "o.tsv").write_text("1\tPOLYGON((0 0,2 0,2 2,0 0))\tx\n2\t\ty\n")
    assert [r.x1 for r in files.read_objects(spark, str(tmp_path / "o.tsv"), 2, 3).collect()] == [2.0]


def test_continuous_query_sees_what_a_batch_sees(spark, tmp_path):
    rows = spark.range(50).selectExpr("id as event_id", "timestamp_ntz'2024-01-01 00:00:00' as ts", "cast(id * 7 as int) as x0", "cast(id as int) as y0", "cast(id * 7 + 5 as int) as x1", "cast(id + 5 as int) as y1", "1.0D as value")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    seen = []
    q = continuous.register(spark, str(tmp_path / "in"), (50, 0, 120, 40), lambda df, _: seen.extend(r.event_id for r in df.collect()), str(tmp_path / "state"))
    q.awaitTermination()
    assert sorted(seen) == sorted(r.event_id for r in continuous.within(rows, 50, 0, 120, 40).collect())


def test_binary_cuts_take_time_in_line_with_the_boxes(spark):
    """60,000 boxes are cut within seconds: the spread of a tile's centres takes one pass, not one for each centre."""
    r = random.Random(8)
    rows = [(k, x := r.random() * 1000, y := r.random() * 1000, x + 0.1, y + 0.1) for k in range(60_000)]
    df = spark.createDataFrame(rows, "id long, x0 double, y0 double, x1 double, y1 double")
    began = time.monotonic()
    tiles = partition.binary_tiles(df, 1000).count()
    assert 60 <= tiles <= 200 and time.monotonic() - began < 25

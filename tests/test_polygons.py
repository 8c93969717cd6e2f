"""Concave polygons, reconstruction, box parts and curve intervals against brute force."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesselle.functions import polygons, shapes
from tesselle.operators import polygon_join, reconstruction, regions, tiles
from tesselle.sources import files

ELL = [(0, 0), (4, 0), (4, 2), (2, 2), (2, 4), (0, 4), (0, 0)]
COMB = [(0, 0), (9, 0), (9, 5), (7, 5), (7, 1), (6, 1), (6, 5), (4, 5), (4, 1), (3, 1), (3, 5), (0, 5)]


def rectilinear(r):
    """A staircase of unit cells as a ring, and its cells."""
    heights = [r.randrange(1, 7) for _ in range(r.randrange(1, 6))]
    x, y = r.randrange(8), r.randrange(8)
    ring = [(x, y)]
    ring += [(x + len(heights), y)]
    for k in reversed(range(len(heights))):
        ring += [(x + k + 1, y + heights[k]), (x + k, y + heights[k])]
    return ring, {(x + k, y + j) for k, h in enumerate(heights) for j in range(h)}


@pytest.mark.parametrize("ring, area", [(ELL, 12), (ELL[::-1], 12), (COMB, 37), ([(0, 0), (2, 0), (4, 0), (4, 4), (0, 4)], 16)])
def test_triangles_cover_the_polygon(ring, area):
    pieces = polygons.triangles(ring)
    assert sum(shapes.polygon_area(p) for p in pieces) == pytest.approx(area)
    assert shapes.polygon_area(ring) == pytest.approx(area)


def test_flat_rings_and_crossing_rings():
    assert polygons.triangles([(0, 0), (1, 1), (0, 0)]) == [[(0, 0), (1, 1)]]
    assert polygons.triangles([(3, 3), (3, 3)]) == [[(3, 3)]]
    with pytest.raises(ValueError):
        polygons.triangles([(0, 0), (4, 4), (4, 0), (0, 3)])


def test_intersection_area_is_the_number_of_common_cells():
    r = random.Random(3)
    for _ in range(200):
        (a, own), (b, other) = rectilinear(r), rectilinear(r)
        got = polygons.intersection_area(polygons.triangles(a), polygons.triangles(b))
        assert got == pytest.approx(len(own & other), abs=1e-9)


def test_polygon_join_is_the_brute_force_join(spark):
    r = random.Random(4)
    a, b = ([(k, *rectilinear(r)) for k in range(25)] for _ in range(2))
    frame = lambda side: spark.createDataFrame([(k, [{"x": float(x), "y": float(y)} for x, y in ring]) for k, ring, _ in side] + [(99, []), (98, None), (97, [{"x": 0.0, "y": 0.0}, {"x": 9.0, "y": 9.0}, {"x": 9.0, "y": 0.0}, {"x": 0.0, "y": 7.0}])], "id long, ring array<struct<x:double,y:double>>")
    pairs = {(p[0], q[0]): (p[2], q[2]) for p in a for q in b}
    want = {
        "st_overlaps": {k for k, (p, q) in pairs.items() if p & q and p - q and q - p},
        "st_contains": {k for k, (p, q) in pairs.items() if q <= p},
        "st_within": {k for k, (p, q) in pairs.items() if p <= q},
        "st_equals": {k for k, (p, q) in pairs.items() if p == q},
        "st_touches": {k for k, (p, q) in pairs.items() if not p & q and any(abs(x - u) <= 1 and abs(y - v) <= 1 for x, y in p for u, v in q)},
        "st_crosses": set(),
        "st_dwithin": {k for k, (p, q) in pairs.items() if min(max(abs(x - u) - 1, 0) ** 2 + max(abs(y - v) - 1, 0) ** 2 for x, y in p for u, v in q) <= 4},
    }
    for name, expected in want.items():
        got = polygon_join.polygon_join(frame(a), frame(b), name, 2.0 if name == "st_dwithin" else 0.0)
        assert {(x.id1, x.id2) for x in got.collect()} == expected, name
    for bad in (("st_near", 0.0), ("st_dwithin", 0.0), ("st_intersects", -1.0)):
        with pytest.raises(ValueError):
            polygon_join.polygon_join(frame(a), frame(b), *bad)


def test_polygons_with_holes(spark):
    """Rectangles with rectangular holes on a grid of cells: every predicate against sets of cells."""
    r = random.Random(12)
    box = lambda x0, y0, x1, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    cells = lambda x0, y0, x1, y1: {(x, y) for x in range(x0, x1) for y in range(y0, y1)}

    def some(k):
        x, y, w, h = r.randrange(8), r.randrange(8), r.randrange(5, 12), r.randrange(5, 12)
        hole = (x + 1, y + 1, x + r.randrange(2, w), y + r.randrange(2, h)) if k % 3 else None
        if k % 5 == 0:  # small ones, which may lie in a hole
            w, h, hole = 1, 1, None
        return k, box(x, y, x + w, y + h), [box(*hole)] if hole else None, cells(x, y, x + w, y + h) - (cells(*hole) if hole else set())

    a, b = ([some(k) for k in range(30)] for _ in range(2))
    b.append((30, *some(1)[1:3], None))
    b[-1] = (30, a[1][1], a[1][2], a[1][3])
    point = lambda ring: [{"x": float(x), "y": float(y)} for x, y in ring]
    frame = lambda side: spark.createDataFrame([(k, point(ring), [point(x) for x in holes] if holes else None) for k, ring, holes, _ in side], "id long, ring array<struct<x:double,y:double>>, holes array<array<struct<x:double,y:double>>>")
    touch = lambda p, q: any(abs(x - u) <= 1 and abs(y - v) <= 1 for x, y in p for u, v in q)
    pairs = {(p[0], q[0]): (p[3], q[3]) for p in a for q in b}
    want = {
        "st_intersects": {k for k, (p, q) in pairs.items() if touch(p, q)},
        "st_touches": {k for k, (p, q) in pairs.items() if touch(p, q) and not p & q},
        "st_contains": {k for k, (p, q) in pairs.items() if q <= p},
        "st_within": {k for k, (p, q) in pairs.items() if p <= q},
        "st_equals": {k for k, (p, q) in pairs.items() if p == q},
        "st_overlaps": {k for k, (p, q) in pairs.items() if p & q and p - q and q - p},
        "st_dwithin": {k for k, (p, q) in pairs.items() if min(max(abs(x - u) - 1, 0) ** 2 + max(abs(y - v) - 1, 0) ** 2 for x, y in p for u, v in q) <= 1},
    }
    assert want["st_touches"] and want["st_equals"] and want["st_contains"]
    for name, expected in want.items():
        got = polygon_join.polygon_join(frame(a), frame(b), name, 1.0 if name == "st_dwithin" else 0.0).collect()
        assert {(x.id1, x.id2) for x in got} == expected, name
        assert all(x.intersect_area == pytest.approx(len(pairs[x.id1, x.id2][0] & pairs[x.id1, x.id2][1])) for x in got)


def test_holes_in_text(spark, tmp_path):
    (tmp_path / "o.tsv").write_text("1\tPOLYGON((0 0,9 0,9 9,0 0),(5 1,6 1,6 2,5 1), (7 1,8 1,8 2,7 1))\n2\tPOLYGON((0 0,2 0,2 2,0 0))\n3\tPOLYGON((0 0,2 0,2 2,0 0),(a 1))\n4\tPOINT(3 4)\n")
    got = {x.f1: x for x in files.read_objects(spark, str(tmp_path / "o.tsv"), 2, 2).collect()}
    assert {k: (len(x.ring), [len(h) for h in x.holes]) for k, x in got.items()} == {"1": (4, [4, 4]), "2": (4, []), "4": (1, [])}


def test_reconstruction_is_independent_of_tiles(spark):
    r = random.Random(5)
    mask = {(y, x): r.choice([0, 3, 5, 9]) for y in range(20) for x in range(20)}
    marker = {p: r.choice([0] * 15 + [4, 12]) for p in mask}
    value = {p: min(marker[p], m) for p, m in mask.items()}
    changed = True
    while changed:
        new = {(y, x): min(m, max(value.get((y + dy, x + dx), 0) for dy in (-1, 0, 1) for dx in (-1, 0, 1))) for (y, x), m in mask.items()}
        changed, value = new != value, new
    rows = [(y, x, marker[y, x] or None, m) for (y, x), m in mask.items()]
    df = spark.createDataFrame(rows, "y int, x int, marker int, mask int")
    for tile in (6, 64):
        assert {(v.y, v.x): v.value for v in reconstruction.reconstruct(df, tile).collect()} == value
    assert reconstruction.reconstruct(df.limit(0), 6).count() == 0


def test_box_parts_and_intervals(spark):
    df = spark.createDataFrame([(1, 0, 0, 0, 3, 4, 1)], "id long, x0 long, y0 long, z0 long, x1 long, y1 long, z1 long")
    parts = regions.box_parts(df, ("x0", "y0", "z0"), ("x1", "y1", "z1"))
    size = F.lit(1)
    for c in "xyz":
        size = size * (F.col(f"p_{c}1") - F.col(f"p_{c}0") + 1)
    assert parts.count() == 8 and parts.agg(F.sum(size)).first()[0] == 4 * 5 * 2
    box = spark.createDataFrame([(7, 3, 2, 11, 6), (8, None, 0, 1, 1)], "id long, x0 long, y0 long, x1 long, y1 long")
    got = regions.box_intervals(box, 4).orderBy("first").collect()
    places = [h for r in got for h in range(r["first"], r["last"] + 1)]
    cells = spark.range(256).selectExpr("id div 16 as x", "id % 16 as y").filter("x between 3 and 11 and y between 2 and 6")
    assert places == sorted(r.h for r in cells.select(shapes.hilbert(F.col("x"), F.col("y"), 4).alias("h")).collect())
    assert all(p["last"] + 1 < q["first"] for p, q in zip(got, got[1:], strict=False))


def test_pair_lines(spark):
    df = spark.createDataFrame([([1, 2], [3, None])], "side1 array<long>, side2 array<long>")
    assert [r.line for r in files.pair_lines(df).collect()] == ["1\t2\t3\t"]
    assert [r.line for r in files.pair_lines(df, "2:1,1:2,1:5").collect()] == ["3\t2\t"]
    with pytest.raises(ValueError):
        files.pair_lines(df, "3:1")


def test_distances_of_many_segments_are_those_of_each():
    r = np.random.default_rng(4)
    p, a, b = (np.round(r.random((300, 2)) * 6) for _ in range(3))
    got = polygons.segment_distances(p, a, b)
    assert np.allclose(got, [shapes.segment_distance(*x) for x in zip(p.tolist(), a.tolist(), b.tolist(), strict=True)], atol=1e-12)


def test_rectangles_make_up_rings_and_their_holes():
    r = random.Random(8)
    for _ in range(100):
        ring, cells = rectilinear(r)
        inner = min(cells)
        holes = [[(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1)] for x, y in [inner]] if r.random() < 0.5 else []
        rects = polygons.rectangles([polygons.opened(x) for x in (ring, *holes)])
        found = [(x, y) for x0, y0, x1, y1 in rects for x in range(x0, x1) for y in range(y0, y1)]
        assert len(found) == len(set(found)) and set(found) == cells - ({inner} if holes else set())
    assert polygons.touches_itself(polygons.opened([(0, 0), (4, 0), (4, 4), (2, 4), (2, 0), (1, 0), (1, 4), (0, 4)]))
    assert not polygons.touches_itself(polygons.opened(COMB))


def test_rectangles_and_slanted_polygons_are_cut_once_and_meet(spark):
    """Staircases are cut into rectangles without ear clipping, and meet each other, triangles and flat rings; null ids stay."""
    r = random.Random(9)
    some = lambda k: [(float(x), float(y)) for x, y in rectilinear(r)[0]] if k % 3 else [(float(x := r.randrange(9)), float(y := r.randrange(9))), (x + 1.0 + r.randrange(4), y + 0.0), (x + 0.5, y + 1.0 + r.randrange(5))]
    a, b = ([(k, some(k)) for k in range(40)] for _ in range(2))
    b += [(40, [(3.0, 3.0), (5.0, 4.0)]), (None, a[1][1])]
    frame = lambda side: spark.createDataFrame([(k, [{"x": x, "y": y} for x, y in ring]) for k, ring in side], "id long, ring array<struct<x:double,y:double>>")
    cut = polygon_join.pieces(frame(a)).collect()
    assert {x.id: (len(x.rects) > 0, len(x.parts) > 0) for x in cut} == {k: (k % 3 > 0, k % 3 == 0) for k in range(40)}
    want = {}
    for k, one in a:
        for j, two in b:
            p, q = polygons.triangles(one), polygons.triangles(two)
            gap = 0.0 if polygons.intersects(p, q) else polygons.ring_distance(polygons.opened(one), polygons.opened(two))
            if gap <= 1.5:
                want[k, j] = (round(polygons.intersection_area(p, q), 9), round(gap, 9))
    got = polygon_join.polygon_join(frame(a), frame(b), "st_dwithin", 1.5).collect()
    assert len(got) == len(want) and {(x.id1, x.id2): (round(x.intersect_area, 9), round(x.distance, 9)) for x in got} == want
    assert {(x.id1, x.id2) for x in polygon_join.polygon_pairs(frame(a), frame(b), "st_dwithin", 1.5).collect()} == set(want)
    same = polygon_join.measures(frame(a), frame(b), 1.5, wanted=lambda meets, inter, *_: inter < 0)
    assert same.count() == 0


def test_a_task_gives_its_pairs_in_batches(spark):
    """200 points on 200 in one spot: what a call gives one after the other is all there, whatever the parts."""
    rows = [(k, 1.0, 1.0, 1.0, 1.0) for k in range(200)]
    df = spark.createDataFrame(rows, "id long, x0 double, y0 double, x1 double, y1 double")

    def run(left: pa.Table, right: pa.Table):
        for k in left["id"].to_pylist():
            yield pa.RecordBatch.from_pydict({"u": pa.array([k] * len(right), pa.int64()), "v": right["id"].combine_chunks(), "n": pa.array([len(left)] * len(right), pa.int64())})

    got = tiles.streamed_in_tiles(df, df, 0.0, run, "u long, v long, n long", (30, 50)).collect()
    assert len(got) == 40_000 == len({(x.u, x.v) for x in got}) and max(x.n for x in got) < 60
    assert tiles.streamed_in_tiles(df, df.limit(0), 0.0, run, "u long, v long, n long").count() == 0

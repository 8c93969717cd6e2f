"""Image files, stages, caches, contours, features, tuning sessions and regions, against brute force and round trips."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselle.functions import shapes
from tesselle.operators import caching, contours, masks, params, partition, polygon_join, regions, spatial_join, stages, tuning
from tesselle.sources import files, images
from tesselle.streaming import continuous


@pytest.mark.parametrize("kind", ["tiff", "pnm"])
def test_regions_in_image_files(spark, tmp_path, kind):
    rng = np.random.default_rng(1)
    grids = {f"r{k}": rng.integers(0, top, shape).astype(dtype) for k, (shape, dtype, top) in enumerate([((5, 7, 1), np.uint8, 256), ((130, 9, 3), np.uint8, 256), ((4, 4, 1), np.uint16, 60000), ((1, 1, 3), np.uint16, 60000)])}
    rows = [(k, *g.shape, 8 * g.dtype.itemsize, g.astype(g.dtype.newbyteorder("<")).tobytes()) for k, g in grids.items()] + [("empty", 0, 0, 1, 8, b""), ("none", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "name string, height int, width int, channels int, bits int, pixels binary")
    written = images.write_regions(df, str(tmp_path / "out"), kind).collect()
    assert sorted(x.name for x in written) == sorted(grids)
    (tmp_path / "out" / "broken.tiff").write_bytes(b"II*\0zz")
    read = images.read_regions(spark, str(tmp_path / "out"))
    got = {x.path.split("/")[-1].split(".")[0]: x for x in read.collect()}
    assert got["broken"].error and got["broken"].pixels is None and not list((tmp_path / "out").glob("*.part"))
    for name, grid in grids.items():
        x = got[name]
        assert (x.height, x.width, x.channels) == grid.shape and bytes(x.pixels) == grid.astype(grid.dtype.newbyteorder("<")).tobytes()
    cells = {(x.y, x.x, x.channel): x.value for x in images.pixels(read.filter(F.contains("path", F.lit("/r1.")))).collect()}
    assert cells == {(y, x, c): int(grids["r1"][y, x, c]) for y in range(130) for x in range(9) for c in range(3)}


def test_plain_any_maps():
    assert images.read_pnm(b"P1\n# note\n3 2\n1 0 1\n0 1 0\n")[..., 0].tolist() == [[1, 0, 1], [0, 1, 0]]
    assert images.read_pnm(b"P2 2 2 9 1 2\n3 4")[..., 0].tolist() == [[1, 2], [3, 4]]
    assert images.read_pnm(b"P4\n9 2\n" + bytes([0x80, 0x80, 0x01, 0x00]))[..., 0].sum(axis=1).tolist() == [2, 1]
    for bad in (b"P9 1 1", b"P5 2 2 255\n\0", b"P5 2"):
        with pytest.raises(ValueError):
            images.read_pnm(bad)


def test_xml_matrices_and_paths(spark, tmp_path):
    rows = [("a", 0, 0, 1.5), ("a", 1, 2, -2.25), ("b", 0, 0, 3.0)]
    files.write_xml_matrices(spark.createDataFrame(rows, "name string, y int, x int, value double"), str(tmp_path / "m"))
    got = {(x.path.split("name=")[1][0], x.y, x.x): x.value for x in files.read_xml_matrix(spark, str(tmp_path / "m" / "*")).collect() if x.value}
    assert got == {r[:3]: r[3] for r in rows} and files.is_complete(spark, str(tmp_path / "m")) and not files.is_complete(spark, str(tmp_path))
    for name, value in (("n", 3), ("x", 0.5), ("s", "a:b"), ("v", [1.0, 2.5]), ("e", [])):
        assert files.argument_of(files.argument_text(name, value)) == (name, value)


def test_contours_have_holes(spark):
    art = ["111110", "100010", "101010", "100010", "111110", "000001"]
    rows = [(0, y, x, 1) for y, line in enumerate(art) for x, c in enumerate(line) if c == "1"] + [(0, 0, 0, 1), (1, 0, 0, 0), (1, 5, 5, 7)]
    got = contours.contours(spark.createDataFrame(rows, "tile int, y int, x int, label int")).collect()
    assert sorted((x.tile, x.label, x.hole, x.area, len(x.ring)) for x in got) == [(0, 1, False, 1.0, 4), (0, 1, False, 1.0, 4), (0, 1, False, 25.0, 4), (0, 1, True, -9.0, 4), (1, 7, False, 1.0, 4)]


def test_contours_of_random_masks(spark):
    r = random.Random(2)
    rows = [(t, y, x, r.randrange(3)) for t in range(2) for y in range(15) for x in range(15)]
    found = contours.contours(spark.createDataFrame(rows, "tile int, y int, x int, label int")).collect()
    sums: dict = {}
    for x in found:
        ring = [(p.x, p.y) for p in x.ring]
        assert shapes.polygon_area(ring) == abs(x.area) and (x.area < 0) == x.hole
        sums[x.tile, x.label] = sums.get((x.tile, x.label), 0) + x.area
    assert sums == {(t, v): sum(q[0] == t and q[3] == v for q in rows) for t in range(2) for v in (1, 2)}


def test_hulls_take_the_ends_of_rows(spark):
    r = random.Random(3)
    rows = [(0, r.randrange(20), r.randrange(20), 1 + k % 3) for k in range(150)] + [(0, 1, 1, 9)]
    got = {x.label: x.area for x in masks.hulls(spark.createDataFrame(rows, "tile int, y int, x int, label int")).collect()}
    want = {v: shapes.polygon_area(shapes.convex_hull([(float(x), float(y)) for _, y, x, w in rows if w == v])) for v in (1, 2, 3)}
    assert got == want


def test_hull_overlaps_are_the_brute_force_ones(spark):
    r = random.Random(5)
    sides = [[(t, r.randrange(30), r.randrange(30), 1 + r.randrange(6)) for t in range(3) for _ in range(40)] for _ in range(2)]
    a, b = (masks.hulls(spark.createDataFrame(x, "tile int, y int, x int, label int")) for x in sides)

    def hull(rows, tile, label):
        return shapes.convex_hull([(float(x), float(y)) for t, y, x, v in rows if (t, v) == (tile, label)])

    want = {}
    for t in range(3):
        for p in range(1, 7):
            for q in range(1, 7):
                one, two = hull(sides[0], t, p), hull(sides[1], t, q)
                area = shapes.polygon_area(shapes.clip(one, two)) if len(one) > 2 and len(two) > 2 else 0
                if area > 0:
                    want[t, p, q] = area
    got = {(x.tile, x.label_a, x.label_b): x.inter for x in masks.hull_overlaps(a, b).collect()}
    assert got == pytest.approx(want) and len(want) > 20
    sums = masks.dice_of(masks.hull_overlaps(a, b).select("inter"), a, b).first()
    whole = [sum(shapes.polygon_area(hull(rows, t, v)) for t in range(3) for v in range(1, 7)) for rows in sides]
    assert sums.dice == pytest.approx(2 * sum(want.values()) / sum(whole), abs=1e-8)


def test_caches_are_replayed(spark):
    log = [("w", k, key, 1) for k, key in enumerate("abcabdaeb")] + [("v", 0, "big", 9), ("v", 1, "big", 9), (None, 1, "x", 1)]
    df = spark.createDataFrame(log, "worker string, at long, key string, size long")
    lru = {x.worker: x for x in caching.replay(df, 3, "LRU").collect()}
    fifo = {x.worker: x for x in caching.replay(df, 3, "FIFO").collect()}
    assert (lru["w"].hits, lru["w"].misses, lru["w"].evicted) == (3, 6, ["c", "b", "d"])
    assert (fifo["w"].hits, fifo["w"].evicted) == (2, ["a", "b", "c", "d"]) and lru["v"].hits == 0 and lru["v"].evictions == 0
    with pytest.raises(ValueError):
        caching.replay(df, 3, "random")
    found = caching.layers("<c><layer><type>RAM</type><capacity>1000</capacity><level>1</level></layer><layer><device>HDD</device><capacity>5</capacity><level>0</level><policy>lru</policy><path>/x</path></layer></c>")
    assert [(x["device"], x["capacity"], x["policy"]) for x in found] == [("HDD", 5.0, "LRU"), ("RAM", 1000.0, "FIFO")]


def test_workflows(spark):
    df = spark.range(4).select(F.col("id").alias("a"), (F.col("id") * 2).alias("b"))

    @stages.stage("breaks")
    def breaks(rows):
        return rows.select(F.raise_error(F.lit("no")).alias("a"), "b")

    flow = stages.Workflow().add("ok", "add", ["in"], a="a", b="b", out="c").add("bad", "breaks", ["in"]).add("late", "add", ["bad"], a="a", b="b", out="c").add("other", "add", ["ok"], a="a", b="c", out="d")
    done, state = flow.attempt({"in": df})
    assert state == {"ok": "done", "bad": state["bad"], "late": "cancelled", "other": "done"} and state["bad"].startswith("failed")
    assert sorted(x.d for x in done["other"].collect()) == [0, 4, 8, 12]
    seen = []
    stages.Workflow().add("ok", "add", ["in"], a="a", b="b", out="c").transaction({"in": df}, ["ok"], lambda x: seen.append(x.count()))
    assert seen == [4] and len(stages.to_driver(df)) == 4
    with pytest.raises(ValueError, match="more than"):
        stages.to_driver(df, 3)

    @stages.stage("two", needs=(("a",), ("z",)))
    def two(one, other):
        return one

    with pytest.raises(ValueError, match="of input 2"):
        two(df, df)
    tiles = stages.per_tile(lambda frame: frame.assign(a=frame["a"] + 1), ["b"], "a long, b long")(df)
    assert sorted(x.a for x in tiles.collect()) == [1, 2, 3, 4]


def test_shared_stages_run_once_for_each_prefix(spark):
    runs = spark.sparkContext.accumulator(0)

    def counted(name):
        def run(frames):
            for frame in frames:
                runs.add(len(frame))
                yield frame.assign(v=frame["v"] + frame[name])

        return lambda df: df.mapInPandas(run, df.schema)

    sets = params.grid(spark, {"p": [1, 2], "q": [10, 20, 30]})
    data = spark.range(5).select("id", F.lit(0).cast("long").alias("v"))
    got = stages.run_shared(data, sets, [(["p"], counted("p")), (["q"], counted("q"))]).collect()
    assert sorted((x.id, x.v) for x in got) == sorted((k, p + q) for k in range(5) for p in (1, 2) for q in (10, 20, 30))
    assert runs.value == 5 * 2 + 5 * 6


def test_segmentation_is_the_brute_force_one(spark):
    r = random.Random(4)
    value = {(t, y, x): r.randrange(10) for t in range(3) for y in range(12) for x in range(12)}
    df = spark.createDataFrame([(*k, v) for k, v in value.items()], "tile int, y int, x int, value int")
    got: dict = {}
    for x in stages.segment(df, 5, 3).collect():
        got.setdefault((x.tile, x.label), set()).add((x.y, x.x))
    left, want = {k for k, v in value.items() if v > 5}, []
    while left:
        stack, part = [left.pop()], set()
        while stack:
            t, y, x = stack.pop()
            part.add((t, y, x))
            near = {(t, y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)} & left
            left -= near
            stack += near
        if len(part) >= 3:
            want.append(part)
    assert sorted(sorted((t, *p) for p in part) for (t, _), part in got.items()) == sorted(sorted(part) for part in want)
    fused = stages.segment_and_features(df, 5, 3, least_objects=2)
    tiles = [t for t in range(3) if sum(next(iter(p))[0] == t for p in want) >= 2]
    assert sorted(x.pixels for x in fused.collect()) == sorted(len(p) for p in want if next(iter(p))[0] in tiles)


def test_regions_are_published_in_versions(spark, tmp_path):
    make = lambda version, value: spark.createDataFrame([("a", "id", version, 7, value), ("b", "id", version, 7, -value)], "dr_name string, dr_id string, version int, ts int, value int")
    regions.put(make(1, 10), str(tmp_path / "r"))
    regions.put(make(3, 30), str(tmp_path / "r"))
    assert [x.value for x in regions.get(spark, str(tmp_path / "r"), "a").collect()] == [30]
    assert [x.value for x in regions.get(spark, str(tmp_path / "r"), "b", 1).collect()] == [-10]
    assert regions.get(spark, str(tmp_path / "r"), "c").count() == 0


def test_tuning_sessions(spark, tmp_path):
    axes = {"x": tuning.Axis(0, 5, 1), "y": tuning.Axis(0, 5, 1)}
    session = tuning.Session("exhaustive", axes, {"mode": ["slow", "fast"]})
    while points := session.fetch():
        session.report([(p["x"] - 2) ** 2 + (p["y"] - 4) ** 2 + (p["mode"] == "slow") for p in points])
    assert session.converged and session.best() == ({"x": 2.0, "y": 4.0, "mode": "fast"}, 0.0) and len(session.trace()) == 72
    tuning.write_trace(spark, session, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 72
    rule = tuning.within(lambda p: p["x"] <= p["y"], ["x", "y"], lambda points: [p.sum() for p in points])
    assert rule(np.array([[1.0, 2.0], [3.0, 1.0], [2.0, 2.0]])) == [3.0, float("inf"), 4.0]
    assert len(tuning.spaces("watershed")) == 15 and len(tuning.spaces("levelset")) == 7 and tuning.spaces("levelset")["mpp"].count == 1


def test_morris_finds_the_axes_that_matter():
    axes = [tuning.Axis(0, 10, 1)] * 3
    points = tuning.morris(axes, 40, 4, seed=5)
    effects = tuning.elementary_effects(points, 5 * points[:, 0] + 0.1 * points[:, 1], axes)
    assert effects == pytest.approx([50, 1, 0]) and (np.abs(np.diff(points, axis=0)[np.arange(len(points) - 1) % 4 != 3]) > 0).sum(axis=1).max() == 1
    lhs = tuning.latin_hypercube(axes, 20, seed=6)
    assert all(sorted((lhs[:, k] // 0.5).astype(int).tolist()) == list(range(20)) for k in range(3))
    shares = tuning.sobol_first(axes, lambda p: 5 * p[:, 0] + p[:, 1], 4000, seed=7)
    assert shares == pytest.approx([25 / 26, 1 / 26, 0], abs=0.06)


def test_hourly_stream_is_the_batch(spark, tmp_path):
    rows = spark.range(300).selectExpr("id as event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, id * 7, 0) as ts", "id as user_id", "cast(id as double) as value")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = continuous.hourly(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("by_hour").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    want = sorted(map(tuple, continuous.hourly(rows).collect()))
    assert sorted(map(tuple, spark.table("by_hour").collect())) == want and sum(x[1] for x in want) == 300


def test_buffers():
    d, (w, h) = 2.0, (3, 5)
    ring = shapes.buffered([(0, 0), (w, 0), (w, h), (0, h)], d, 16)
    assert shapes.polygon_area(ring) == pytest.approx(w * h + 2 * d * (w + h) + np.pi * d * d, rel=2e-3)
    with pytest.raises(ValueError):
        shapes.buffered([(0, 0)], 0)


def test_folders_and_ports(spark, tmp_path):
    root = str(tmp_path / "a")
    assert files.make_folder(spark, f"{root}/b/c")
    (tmp_path / "a" / "x.txt").write_text("four")
    assert files.folder_entries(spark, root) == [("b", True, 0), ("x.txt", False, 4)]
    assert files.port_values('{"p": [1, 2], "q": "x"}') == {"p": [1, 2], "q": ["x"]}
    assert files.port_values('[{"name": "p", "values": [1]}, {"name": "q", "value": 2}]') == {"p": [1], "q": [2]}


def test_options_are_checked(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0)], "id long, x0 double, y0 double, x1 double, y1 double")
    for k, bound in ((0, 1.0), (1, 0.0), (1, -2.0)):
        with pytest.raises(ValueError):
            spatial_join.nearest(df, df, k, bound)
    polygons = df.select("id", F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y"))).alias("ring"))
    for predicate, d in (("st_nothing", 0.0), ("st_dwithin", 0.0), ("st_intersects", -1.0)):
        with pytest.raises(ValueError):
            polygon_join.polygon_join(polygons, polygons, predicate, d)
    for rate in (-0.1, 1.1):
        with pytest.raises(ValueError):
            partition.sampled(df, rate, 1)
    with pytest.raises(ValueError):
        files.pair_lines(df, "3:1")


def test_searches_by_name_and_budgets():
    axes = [tuning.Axis(0, 4, 1), tuning.Axis(0, 4, 1)]
    score = lambda points: np.abs(points - 2).sum(axis=1).tolist()
    assert len(tuning.tune("exhaustive", axes, score).seen) == 25 and tuning.tune("exhaustive", axes, score).best() == ((2.0, 2.0), 0.0)
    found = tuning.tune("random", axes, score, trials=400)
    assert len(found.seen) == 25 and found.best()[1] == 0
    assert tuning.tune("unknown", axes, score).best()[1] <= 1
    for evaluations in (1, 10, 100, 250):
        generations, population, elite = tuning.budget(evaluations)
        assert population % 2 == 0 and generations * population >= evaluations * 0.7 and elite >= 1
    for wrong in ({"population": 3, "elite": 1}, {"population": 4, "elite": 2}, {"population": 4, "elite": 1, "crossover": 101}):
        with pytest.raises(ValueError):
            tuning.genetic(axes, score, 2, **wrong)


def test_samples_and_orders(spark):
    r = random.Random(11)
    rows = [(k, float(r.randrange(40)), 0.0, float(40 + r.randrange(3)), 1.0) for k in range(3000)]
    df = spark.createDataFrame(rows, "id long, x0 double, y0 double, x1 double, y1 double")
    got = partition.sampled(df, 0.25, 3)
    assert 650 < got.count() < 850 and got.exceptAll(partition.sampled(df, 0.25, 3)).isEmpty()
    assert partition.sampled(df, 1.0, 3).count() == 3000 and partition.sampled(df, 0.0, 3).count() == 0
    place = {x.id: x.place for x in partition.centre_order(df).collect()}
    assert [k for k, _ in sorted(place.items(), key=lambda x: x[1])] == [x[0] for x in sorted(rows, key=lambda x: (x[1] + x[3], x[0]))]
    assert partition.centre_order(df.limit(0)).count() == 0

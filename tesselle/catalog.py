"""The registered queries over the reference's own operators, and their SQL equivalents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import boxes, shapes, sql
from .functions.boxes import Box
from .operators import caching, contours, features, masks, params, partition, polygon_join, reconstruction, regions, stages
from .operators import spatial_join as sj
from .operators.durable import shared_folder
from .plans.fixtures import fixture, with_fixtures
from .sources import files
from .streaming import continuous

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def wrap(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_fixtures(sql)
        return f

    return wrap


def rects(spark, sf, a="rect_a", b="rect_b"):
    return fixture(spark, sf, a), fixture(spark, sf, b)


MEET = "a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1"
INNER = "a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1"
A_IN_B = "a.x0 >= b.x0 AND a.y0 >= b.y0 AND a.x1 <= b.x1 AND a.y1 <= b.y1"
B_IN_A = "b.x0 >= a.x0 AND b.y0 >= a.y0 AND b.x1 <= a.x1 AND b.y1 <= a.y1"
I = "(greatest(least(a.x1,b.x1)-greatest(a.x0,b.x0),0)*greatest(least(a.y1,b.y1)-greatest(a.y0,b.y0),0))"  # noqa: E741
A1, A2 = "((a.x1-a.x0)*(a.y1-a.y0))", "((b.x1-b.x0)*(b.y1-b.y0))"
D2 = "(pow(greatest(a.x0-b.x1,b.x0-a.x1,0),2)+pow(greatest(a.y0-b.y1,b.y0-a.y1,0),2))"
PAIR = "SELECT a.id AS id1, b.id AS id2 FROM rect_a a JOIN rect_b b ON "


def _ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a_id").alias("id1"), F.col("b_id").alias("id2"))


def _join(name: str, predicate, sql: str, d: float = 0.0, a: str = "rect_a", b: str = "rect_b") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _ids(sj.spatial_join(*rects(spark, sf_dir, a, b), predicate, d))

    run.__name__ = name
    query(PAIR.replace("rect_a", a).replace("rect_b", b) + sql)(run)


_join("st_intersects", boxes.intersects, MEET)
_join("st_adjacent", boxes.intersects, MEET)
_join("st_touches", boxes.touches, f"{MEET} AND NOT ({INNER})")
_join("st_contains", boxes.contains, B_IN_A)
_join("st_within", lambda a, b: boxes.contains(b, a), A_IN_B)
_join("st_overlaps", boxes.overlaps, f"{INNER} AND NOT ({A_IN_B}) AND NOT ({B_IN_A})")
_join("st_equals", boxes.equals, "a.x0=b.x0 AND a.y0=b.y0 AND a.x1=b.x1 AND a.y1=b.y1", a="rect_s", b="rect_t")
ENTERS = "(a.y0=a.y1 AND b.y0 < a.y0 AND a.y0 < b.y1 AND a.x0 < b.x1 AND b.x0 < a.x1 OR a.x0=a.x1 AND b.x0 < a.x0 AND a.x0 < b.x1 AND a.y0 < b.y1 AND b.y0 < a.y1)"
_join("st_crosses", boxes.crosses, f"{ENTERS} AND NOT ({A_IN_B})", a="seg_a")
_join("st_dwithin", lambda a, b: boxes.within_distance(a, b, 7.0), f"{D2} <= 49", 7.0)
_join("st_disjoint", lambda a, b: ~boxes.intersects(a, b), f"a.x0-5 <= b.x1 AND b.x0 <= a.x1+5 AND a.y0-5 <= b.y1 AND b.y0 <= a.y1+5 AND NOT ({MEET})", 5.0)


@query("SELECT a.id AS id1, b.id AS id2 FROM point_a a JOIN point_b b ON pow(a.x0-b.x0,2)+pow(a.y0-b.y0,2) <= 36")
def st_dwithin_points(spark, sf):
    return _ids(sj.spatial_join(*rects(spark, sf, "point_a", "point_b"), lambda a, b: boxes.within_distance(a, b, 6.0), 6.0))


@query(f"SELECT a.id AS id1, b.id AS id2, {A1} AS area1, {A2} AS area2, {I} AS inter_area, {A1}+{A2}-{I} AS union_area, round({I}/({A1}+{A2}-{I})::DOUBLE,9) AS jaccard, round(2*{I}/({A1}+{A2})::DOUBLE,9) AS dice, round(sqrt({D2}),9) AS min_distance FROM rect_a a JOIN rect_b b ON {MEET}")
def pair_stats(spark, sf):
    s = sj.pair_stats(sj.spatial_join(*rects(spark, sf), boxes.intersects))
    return s.select(F.col("a_id").alias("id1"), F.col("b_id").alias("id2"), "area1", "area2", "inter_area", "union_area", *[F.round(c, 9).alias(c) for c in ("jaccard", "dice", "min_distance")])


@query(f"SELECT a.id AS id1, b.id AS id2 FROM rect_u a JOIN rect_u b ON {MEET} AND a.id < b.id")
def self_join_unique(spark, sf):
    return _ids(sj.self_join(fixture(spark, sf, "rect_u"), boxes.intersects))


@query(f"SELECT a.id AS id1, b.id AS id2 FROM rect_u a JOIN rect_u b ON {MEET} AND a.id <> b.id")
def self_join_replicate(spark, sf):
    return _ids(sj.self_join(fixture(spark, sf, "rect_u"), boxes.intersects, unique=False))


def _inter(spark, sf):
    return sj.spatial_join(*rects(spark, sf), boxes.intersects).select("a_id", "b_id", boxes.intersection_area(Box("a_"), Box("b_")).alias("inter"), boxes.union_area(Box("a_"), Box("b_")).alias("uni"))


SUMS = f"SELECT {{}} FROM (SELECT coalesce(sum({I}),0)::DOUBLE AS i FROM rect_a a JOIN rect_b b ON {MEET}), (SELECT sum((x1-x0)*(y1-y0))::DOUBLE AS a1 FROM rect_a), (SELECT sum((x1-x0)*(y1-y0))::DOUBLE AS a2 FROM rect_b)"


def _dice(spark, sf):
    a, b = rects(spark, sf)
    area = ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area")
    return masks.dice_of(_inter(spark, sf).select(F.col("inter").cast("double")), a.select(area), b.select(area))


@query(SUMS.format("round(2*i/(a1+a2),9) AS dice"))
def mask_dice(spark, sf):
    return _dice(spark, sf).select("dice")


@query(SUMS.format("round(i/(a1+a2-i),9) AS jaccard"))
def mask_jaccard(spark, sf):
    return _dice(spark, sf).select("jaccard")


@query(SUMS.format("round(i/a2,9) AS mask_intersection"))
def mask_intersection(spark, sf):
    return _dice(spark, sf).select("mask_intersection")


@query(f"SELECT coalesce(round(avg(2*{I}/({A1}+{A2})::DOUBLE),9),0) AS mean_dice FROM rect_a a JOIN rect_b b ON {MEET}")
def mask_dice_pairs(spark, sf):
    return sj.pair_stats(sj.spatial_join(*rects(spark, sf), boxes.intersects)).agg(F.coalesce(F.round(F.avg("dice"), 9), F.lit(0.0)).alias("mean_dice"))


@query(f"SELECT DISTINCT {I} AS inter, {A1}+{A2}-{I} AS uni FROM rect_a a JOIN rect_b b ON {MEET}")
def dedup_uniq(spark, sf):
    return _inter(spark, sf).select("inter", "uni").distinct()


@query(f"SELECT DISTINCT {A1}+{A2}-{I} AS uni FROM rect_a a JOIN rect_b b ON {MEET}")
def dedup_uniqpart(spark, sf):
    return _inter(spark, sf).dropDuplicates(["uni"]).select("uni")


KNN = "SELECT id1, id2, distance, rank FROM (SELECT a.id AS id1, b.id AS id2, round(sqrt({d}),9) AS distance, row_number() OVER (PARTITION BY a.id ORDER BY {d}, b.id) AS rank FROM {l} a JOIN {r} b ON {on}) WHERE rank <= 3"


def _knn(df):
    return df.select(F.col("a_id").alias("id1"), F.col("b_id").alias("id2"), F.round("distance", 9).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query(KNN.format(d=D2, l="rect_a", r="rect_b", on=f"{D2} < 625"))
def knn_bounded(spark, sf):
    return _knn(sj.nearest(*rects(spark, sf), 3, 25.0))


@query(KNN.format(d=D2, l="rect_a", r="rect_b", on="true"))
def knn_unbounded(spark, sf):
    return _knn(sj.nearest_unbounded(*rects(spark, sf), 3))


@query(KNN.format(d=D2, l="rect_b", r="rect_b", on="a.id <> b.id"))
def knn_self(spark, sf):
    b = fixture(spark, sf, "rect_b")
    return _knn(sj.nearest_unbounded(b, b, 3, exclude_self=True))


@query(f"SELECT round(sum(distance),6) AS total, count(*) AS pairs FROM ({KNN.format(d=D2, l='rect_a', r='rect_b', on=f'{D2} < 625')})")
def knn_summary(spark, sf):
    return _knn(sj.nearest(*rects(spark, sf), 3, 25.0)).agg(F.round(F.sum("distance"), 6).alias("total"), F.count("*").alias("pairs"))


HAVERSINE = "3958.75*1609.0*2*atan2(sqrt(pow(sin(radians(b.lat-a.lat)/2),2)+cos(radians(a.lat))*cos(radians(b.lat))*pow(sin(radians(b.lon-a.lon)/2),2)), sqrt(1-(pow(sin(radians(b.lat-a.lat)/2),2)+cos(radians(a.lat))*cos(radians(b.lat))*pow(sin(radians(b.lon-a.lon)/2),2))))"


@query(f"SELECT a.id AS id1, b.id AS id2, round({HAVERSINE},2) AS metres FROM geo a JOIN geo b ON a.id < b.id AND {HAVERSINE} <= 500000")
def earth_dwithin(spark, sf):
    g = fixture(spark, sf, "geo")
    return sj.earth_within(g, g, 500_000.0).filter("a_id < b_id").select(F.col("a_id").alias("id1"), F.col("b_id").alias("id2"), F.round("metres", 2).alias("metres"))


@query("SELECT min(x0) AS min_x, min(y0) AS min_y, max(x1) AS max_x, max(y1) AS max_y, count(*) AS objects FROM rect_a")
def space_dimension(spark, sf):
    return partition.space(fixture(spark, sf, "rect_a"))


@query("SELECT min(x0) AS min_x, min(y0) AS min_y, max(x1) AS max_x, max(y1) AS max_y, count(*) AS objects FROM (SELECT * FROM rect_a UNION ALL SELECT * FROM rect_b)")
def space_merge(spark, sf):
    a, b = rects(spark, sf)
    return partition.merge_spaces(partition.space(a).union(partition.space(b)))


@query("SELECT floor(4000*1.0/(count(*)*40)*count(*))::BIGINT AS objects FROM rect_a")
def partition_size(spark, sf):
    n = fixture(spark, sf, "rect_a").count()
    return spark.range(1).select(F.lit(partition.partition_size(4000, 1.0, n * 40, n)).cast("long").alias("objects"))


W = "(SELECT min(x0) AS ax, min(y0) AS ay, max(x1)-min(x0) AS w, max(y1)-min(y0) AS h FROM rect_a)"


@query(f"SELECT id, round((x0-ax)/w::DOUBLE,9) AS x0, round((y0-ay)/h::DOUBLE,9) AS y0, round((x1-ax)/w::DOUBLE,9) AS x1, round((y1-ay)/h::DOUBLE,9) AS y1 FROM rect_a, {W}")
def mbb_normalize(spark, sf):
    a = fixture(spark, sf, "rect_a")
    return partition.normalize(a, partition.space(a)).select("id", *[F.round(c, 9).alias(c) for c in sj.BOX])


@query("SELECT id, x0, y0, x1, y1 FROM rect_a")
def mbb_denormalize(spark, sf):
    a = fixture(spark, sf, "rect_a")
    w = partition.space(a)
    return partition.denormalize(partition.normalize(a, w), w).select("id", *[F.round(c).cast("long").alias(c) for c in sj.BOX])


GRID = "(SELECT greatest(ceil(sqrt(n/100.0*r)),1)::BIGINT AS nx, greatest(ceil(sqrt(n/100.0/r)),1)::BIGINT AS ny FROM (SELECT count(*) AS n, (max(x1)-min(x0))/(max(y1)-min(y0))::DOUBLE AS r FROM rect_a))"


@query(f"SELECT 'FG|' || (i*ny+j+1) AS tile_id, round(i/nx::DOUBLE,9) AS x0, round(j/ny::DOUBLE,9) AS y0, round((i+1)/nx::DOUBLE,9) AS x1, round((j+1)/ny::DOUBLE,9) AS y1 FROM {GRID}, range(1000) p(i), range(1000) q(j) WHERE i < nx AND j < ny")
def grid_tiles(spark, sf):
    return partition.fixed_grid(fixture(spark, sf, "rect_a"), 100).select("tile_id", *[F.round(c, 9).alias(c) for c in sj.BOX])


@query("SELECT id, 'T|' || (i*8+j) AS tile_id FROM rect_a, range(8) p(i), range(8) q(j) WHERE x0 <= i*128+128 AND x1 >= i*128 AND y0 <= j*128+128 AND y1 >= j*128")
def object_to_tile(spark, sf):
    t = spark.range(64).select(F.concat(F.lit("T|"), "id").alias("tile_id"), (F.floor(F.col("id") / 8) * 128).alias("x0"), (F.col("id") % 8 * 128).alias("y0")).withColumns({"x1": F.col("x0") + 128, "y1": F.col("y0") + 128})
    return partition.to_tiles(fixture(spark, sf, "rect_a"), t).select("id", "tile_id")


@query()
def hilbert_tiles(spark, sf):
    return partition.hilbert_tiles(fixture(spark, sf, "rect_a"), 100)


@query()
def bsp_tiles(spark, sf):
    return partition.binary_tiles(fixture(spark, sf, "rect_a"), 100)


@query()
def bos_tiles(spark, sf):
    return partition.strip_tiles(fixture(spark, sf, "rect_a"), 100)


@query("SELECT avg((x0+x1)/2.0) AS mean_x, round(var_pop((x0+x1)/2.0)*count(*),3) AS spread_x, median((x0+x1)/2.0) AS median_x FROM rect_a")
def split_statistics(spark, sf):
    c = (F.col("x0") + F.col("x1")) / 2.0
    return fixture(spark, sf, "rect_a").agg(F.avg(c).alias("mean_x"), F.round(F.var_pop(c) * F.count("*"), 3).alias("spread_x"), F.median(c).alias("median_x"))


@query(f"SELECT a.id AS id1, b.id AS id2, greatest(a.x0,b.x0) AS x0, greatest(a.y0,b.y0) AS y0, least(a.x1,b.x1) AS x1, least(a.y1,b.y1) AS y1 FROM rect_a a JOIN rect_b b ON {MEET}")
def bbox_intersection(spark, sf):
    p = sj.spatial_join(*rects(spark, sf), boxes.intersects)
    a, b = ([F.col(f"{s}_{c}") for c in sj.BOX] for s in "ab")
    return p.select(F.col("a_id").alias("id1"), F.col("b_id").alias("id2"), *[c.alias(n) for c, n in zip(regions.box_intersection(a, b), sj.BOX, strict=True)])


@query("SELECT id, x1-x0+1 AS width, y1-y0+1 AS height, (x0 <= 500 AND x1 >= 100 AND y0 <= 500 AND y1 >= 100) AS overlap, (x0 >= 100 AND x1 <= 500 AND y0 >= 100 AND y1 <= 500) AS inside FROM rect_a")
def bbox_overlap(spark, sf):
    own = [F.col(c) for c in sj.BOX]
    roi = [F.lit(v) for v in (100, 100, 500, 500)]
    w, h = regions.box_sizes(own)
    return fixture(spark, sf, "rect_a").select("id", w.alias("width"), h.alias("height"), regions.box_overlap(own, roi).alias("overlap"), regions.box_include(roi, own).alias("inside"))


@query("SELECT id, q AS quarter, qx0, qy0, qx1, qy1 FROM (SELECT id, 2*x+y AS q, CASE WHEN x=0 THEN x0 ELSE (x0+x1)//2+1 END AS qx0, CASE WHEN y=0 THEN y0 ELSE (y0+y1)//2+1 END AS qy0, CASE WHEN x=0 THEN (x0+x1)//2 ELSE x1 END AS qx1, CASE WHEN y=0 THEN (y0+y1)//2 ELSE y1 END AS qy1 FROM rect_a, range(2) p(x), range(2) r(y)) WHERE qx0 <= qx1 AND qy0 <= qy1")
def bbox_divide(spark, sf):
    parts = regions.box_parts(fixture(spark, sf, "rect_a"))
    return parts.select("id", F.col("part").alias("quarter"), *[F.col(f"p_{c}").alias(f"q{c}") for c in sj.BOX])


@query("SELECT dr_name, version, ts, dr_id, seq FROM regions WHERE dr_name <> '' QUALIFY row_number() OVER (PARTITION BY dr_name, ts, version ORDER BY seq DESC) = 1")
def region_upsert(spark, sf):
    return regions.upsert(fixture(spark, sf, "regions"))


FOUND = "SELECT dr_name, version, ts, dr_id, seq FROM regions WHERE dr_name = '1-URGENT' AND ts = 3 AND version = 2 ORDER BY seq DESC LIMIT 1"


@query(FOUND)
def region_lookup(spark, sf):
    return regions.lookup(fixture(spark, sf, "regions"), "1-URGENT", 3, 2)


@query(f"SELECT dr_name, version, ts, dr_id, seq FROM regions WHERE seq NOT IN (SELECT seq FROM ({FOUND}))")
def region_delete(spark, sf):
    return regions.delete(fixture(spark, sf, "regions"), "1-URGENT", 3, 2).select("dr_name", "version", "ts", "dr_id", "seq")


@query("SELECT dr_name, version, ts, dr_id, seq, row_number() OVER (ORDER BY dr_name, seq DESC) - 1 AS idx FROM regions")
def region_index(spark, sf):
    return regions.index(fixture(spark, sf, "regions")).select("dr_name", "version", "ts", "dr_id", "seq", "idx")


@query("SELECT tile, (y-40)::INT AS y, (x-30)::INT AS x, label FROM mask WHERE x BETWEEN 30 AND 129 AND y BETWEEN 40 AND 139")
def roi_crop(spark, sf):
    return regions.crop(fixture(spark, sf, "mask"), 30, 40, 129, 139)


@query("SELECT i*4+j AS id, i*64 AS x0, j*64 AS y0, i*64+63 AS x1, j*64+63 AS y1 FROM range(4) p(i), range(4) q(j) WHERE i*64 <= 129 AND i*64+63 >= 30 AND j*64 <= 139 AND j*64+63 >= 40")
def chunk_prune(spark, sf):
    c = spark.range(16).select("id", (F.floor(F.col("id") / 4) * 64).alias("x0"), (F.col("id") % 4 * 64).alias("y0")).withColumns({"x1": F.col("x0") + 63, "y1": F.col("y0") + 63})
    return regions.chunks_of(c, 30, 40, 129, 139)


SLIDES = "(SELECT s_suppkey AS id, 1000+(s_suppkey*37)%900 AS w, 800+(s_suppkey*91)%700 AS h FROM supplier)"


def _slides(spark, sf):
    return spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("id"), (1000 + F.col("s_suppkey") * 37 % 900).alias("w"), (800 + F.col("s_suppkey") * 91 % 700).alias("h"))


@query(f"SELECT id, i*256 AS x, j*256 AS y, least(256, w-i*256) AS tw, least(256, h-j*256) AS th FROM {SLIDES}, range(20) p(i), range(20) q(j) WHERE i <= w//256 AND j <= h//256 AND w-i*256 > 0 AND h-j*256 > 0")
def slide_grid(spark, sf):
    return regions.slide_grid(_slides(spark, sf), 256)


@query(f"SELECT id, level FROM (SELECT id, level, row_number() OVER (PARTITION BY id ORDER BY (w // (1+(level+id)%3))*(h // (1+(level+id)%3)) DESC, level) AS n FROM {SLIDES}, range(5) l(level)) WHERE n = 1")
def largest_level(spark, sf):
    s = _slides(spark, sf).withColumn("level", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))))
    by = 1 + (F.col("level") + F.col("id")) % 3
    return regions.largest_level(s.withColumns({"w": F.floor(F.col("w") / by), "h": F.floor(F.col("h") / by)}))


@query("SELECT id, CASE WHEN a=0 THEN 0 WHEN a=255 THEN c ELSE (c*255 + a//2)//a END AS value FROM (SELECT p_partkey AS id, (p_partkey*7)%256 AS a, (p_partkey*13)%256 AS c FROM part)")
def argb_unpremultiply(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    return p.select(F.col("p_partkey").alias("id"), regions.unpremultiply(F.col("p_partkey") * 13 % 256, F.col("p_partkey") * 7 % 256).alias("value"))


@query("SELECT tile//2*256+y AS y, tile%2*256+x AS x, label FROM mask")
def slide_assemble(spark, sf):
    m = fixture(spark, sf, "mask").select(F.floor(F.col("tile") / 2).cast("int").alias("tile_y"), (F.col("tile") % 2).alias("tile_x"), "y", "x", "label")
    return regions.assemble(m, 256).select("y", "x", "label")


@query("SELECT tile, count(*) FILTER (coalesce(m.label,0) <> coalesce(r.label,0)) AS diff_pixels, count(*) FILTER (coalesce(r.label,0) <> 0) AS foreground FROM mask m FULL JOIN ref_mask r USING (tile, y, x) GROUP BY tile")
def pixel_compare(spark, sf):
    return masks.pixel_compare(*rects(spark, sf, "mask", "ref_mask"))


@query("SELECT sum((coalesce(m.label,0) <> coalesce(r.label,0))::INT)::BIGINT AS diff_pixels, sum((coalesce(r.label,0) <> 0)::INT)::BIGINT AS foreground FROM mask m FULL JOIN ref_mask r USING (tile, y, x)")
def total_diff(spark, sf):
    return masks.pixel_compare(*rects(spark, sf, "mask", "ref_mask")).agg(F.sum("diff_pixels").alias("diff_pixels"), F.sum("foreground").alias("foreground"))


@query("SELECT tile, label, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, count(*) AS pixels FROM mask GROUP BY tile, label")
def label_bbox(spark, sf):
    return masks.label_boxes(fixture(spark, sf, "mask"))


@query('SELECT max(r) AS "rows", max(c) AS cols FROM (SELECT max(y)-min(y)+3 AS r, max(x)-min(x)+3 AS c FROM mask GROUP BY tile, label)')
def label_max_box(spark, sf):
    return masks.largest_box(fixture(spark, sf, "mask"))


@query("WITH im AS (SELECT tile, y, x, (x*7+y*3)%256 AS value FROM mask) SELECT m.tile, m.label, count(*) AS pixels, round(avg(i.value),6) AS mean_value, min(i.value) AS min_value, max(i.value) AS max_value, round(var_pop(i.value),6) AS var_value, round(coalesce(avg(abs(n.value-i.value)),0),6) AS mean_step FROM mask m JOIN im i USING (tile, y, x) LEFT JOIN im n ON n.tile=m.tile AND n.y=m.y AND n.x=m.x+1 GROUP BY m.tile, m.label")
def object_features(spark, sf):
    m = fixture(spark, sf, "mask")
    return masks.object_features(m, m.select("tile", "y", "x", ((F.col("x") * 7 + F.col("y") * 3) % 256).alias("value")))



@query()
def labelled_mask_dice(spark, sf):
    a, b = (masks.hulls(x) for x in rects(spark, sf, "mask", "ref_mask"))
    return masks.dice_of(masks.hull_overlaps(a, b).select("inter"), a, b)


#: The next background pixel lies among those up to 24 steps away, whose offsets are tried from the nearest on.
STEPS = "(SELECT abs(i-24)+abs(j-24) AS d, i-24 AS dy, j-24 AS dx FROM range(49) p(i), range(49) q(j) WHERE abs(i-24)+abs(j-24) BETWEEN 1 AND 24)"


@query(f"WITH px AS (SELECT tile//2*256+y AS y, tile%2*256+x AS x FROM mask) SELECT p.y, p.x, min(s.d)::INT AS distance FROM px p, {STEPS} s LEFT JOIN px n ON n.y = p.y+s.dy AND n.x = p.x+s.dx WHERE n.y IS NULL GROUP BY p.y, p.x")
def distance_transform(spark, sf):
    return masks.distance_transform(slide_assemble(spark, sf), 64)


@query("SELECT ((a-1)*12+(b-1)*4+(c-1))::BIGINT AS param_set_id, a::INT AS a, b::INT AS b, c::INT AS c FROM range(1,3) x(a), range(1,4) y(b), range(1,5) z(c)")
def param_grid(spark, sf):
    return params.grid(spark, {"a": params.span(1, 2), "b": params.span(1, 3), "c": params.span(1, 4)})


@query("SELECT stage::INT AS stage, runs FROM (SELECT 0 AS stage, count(DISTINCT o_orderpriority) AS runs FROM orders UNION ALL SELECT 1, count(*) FROM (SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders) UNION ALL SELECT 2, count(*) FROM (SELECT DISTINCT o_orderpriority, o_orderstatus, o_custkey%5 FROM orders))")
def prefix_share(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").withColumn("k", F.col("o_custkey") % 5)
    return params.shared_prefix(o, [["o_orderpriority"], ["o_orderstatus"], ["k"]])


@query("SELECT DISTINCT c_custkey AS param_set_id FROM customer WHERE c_custkey NOT IN (SELECT param_set_id FROM trace)")
def memo_lookup(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("param_set_id")).distinct()
    return params.unseen(c, fixture(spark, sf, "trace"), ["param_set_id"])


TIMED = "SELECT p_partkey AS param_set_id, (p_partkey%97)/97.0::DOUBLE AS metric, (p_partkey%89)/89.0::DOUBLE AS other, (1+p_partkey%13)::DOUBLE AS time FROM part"
SCORED = f"SELECT param_set_id, CASE WHEN m <= 1.1920928955078125e-07 OR 0.7*m + 0.3*speed <= 0 THEN NULL ELSE round(1/(0.7*m + 0.3*speed), 9) END AS score FROM (SELECT param_set_id, {{}} AS m, (max(time) OVER () - time)/(max(time) OVER () - min(time) OVER ()) AS speed FROM ({TIMED}))"


def _objective(spark, sf, second=None):
    k = F.col("p_partkey")
    t = spark.read.parquet(f"{sf}/part.parquet").select(k.alias("param_set_id"), (k % 97 / 97.0).alias("metric"), (k % 89 / 89.0).alias("other"), (1 + k % 13).cast("double").alias("time"))
    score = F.col("score")
    return params.objective(t, 0.7, 0.3, second).select("param_set_id", F.when(score < float("inf"), F.round(score, 9)).alias("score"))  # null: infinite


@query(SCORED.format("metric"))
def multi_objective_score(spark, sf):
    return _objective(spark, sf)


@query(SCORED.format("(metric+other)/2"))
def multi_objective_two_metrics(spark, sf):
    return _objective(spark, sf, "other")


@query("SELECT param_set_id, trial, score FROM trace ORDER BY score, trial LIMIT 1")
def best_params(spark, sf):
    return params.best(fixture(spark, sf, "trace"))


@query("SELECT param_set_id, min(score) AS min_score, max(score) AS max_score, round(avg(score),6) AS avg_score, round(median(score),6) AS median_score FROM trace GROUP BY param_set_id")
def repeat_agg(spark, sf):
    return params.repeat_stats(fixture(spark, sf, "trace"))


@query("SELECT max(score) AS slowest, min(score) AS fastest FROM trace")
def profile_times(spark, sf):
    return fixture(spark, sf, "trace").agg(F.max("score").alias("slowest"), F.min("score").alias("fastest"))


@query("SELECT param_set_id, round(sum(score),4) AS metric, count(*) AS images FROM trace GROUP BY param_set_id")
def cross_image_sum(spark, sf):
    return fixture(spark, sf, "trace").groupBy("param_set_id").agg(F.round(F.sum("score"), 4).alias("metric"), F.count("*").alias("images"))


POP = "SELECT n_nationkey AS idx, 'g' || n_nationkey AS gene, (n_nationkey*{m})%17 AS fitness FROM nation"


def _population(spark, sf, m):
    n = F.col("n_nationkey")
    return spark.read.parquet(f"{sf}/nation.parquet").select(n.alias("idx"), F.concat(F.lit("g"), n).alias("gene"), (n * m % 17).alias("fitness"))


@query(f"WITH p AS ({POP.format(m=7)}), r AS (SELECT *, row_number() OVER (ORDER BY fitness, idx) AS k, count(*) OVER () AS n FROM p) SELECT r.idx, coalesce(t.gene, r.gene) AS gene, coalesce(t.fitness, r.fitness) AS fitness FROM r LEFT JOIN r t ON t.k <= 5 AND t.k = r.n + 1 - r.k")
def elite_propagation(spark, sf):
    return params.elite(_population(spark, sf, 7), 5)


@query(f"WITH p AS (SELECT *, 1 AS kind FROM ({POP.format(m=7)}) UNION ALL SELECT *, 0 FROM ({POP.format(m=5)})) SELECT rank, gene, fitness FROM (SELECT gene, fitness, row_number() OVER (ORDER BY fitness, kind, idx) AS rank FROM p) WHERE rank <= (SELECT count(*) FROM nation)")
def natural_selection(spark, sf):
    return params.survivors(_population(spark, sf, 7), _population(spark, sf, 5)).withColumn("rank", F.col("rank").cast("long"))


@query(f"SELECT p.idx, CASE WHEN c.fitness < p.fitness THEN c.gene ELSE p.gene END AS gene, least(c.fitness, p.fitness) AS fitness FROM ({POP.format(m=7)}) p JOIN ({POP.format(m=5)}) c USING (idx)")
def parent_offspring(spark, sf):
    return params.better_of(_population(spark, sf, 7), _population(spark, sf, 5))


@query("SELECT fold::INT AS fold, id, row_number() OVER (PARTITION BY fold ORDER BY md5('5:' || fold || ':' || id), id) <= 10 AS train FROM (SELECT n_nationkey AS id FROM nation), range(10) f(fold)")
def cross_validation_folds(spark, sf):
    return params.folds(spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").alias("id")), 10, 10, 5)


@query("SELECT n_nationkey AS id, n_nationkey+n_regionkey AS a, n_nationkey+n_regionkey+n_nationkey+10 AS b, n_nationkey+n_regionkey+n_regionkey+5 AS c, 3*n_nationkey+3*n_regionkey+15 AS d FROM nation")
def stage_graph(spark, sf):
    flow = stages.Workflow().add("A", "add", ["in"], a="p", b="q", out="a").add("B", "add", ["A"], a="a", b="p", out="b", plus=10)
    flow.add("C", "add", ["B"], a="a", b="q", out="c", plus=5).add("D", "add", ["C"], a="b", b="c", out="d")
    n = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").alias("id"), F.col("n_nationkey").alias("p"), F.col("n_regionkey").alias("q"))
    return flow.run({"in": n})["D"].select("id", "a", "b", "c", "d")


@query("WITH RECURSIVE e AS (SELECT n_nationkey AS node, n_nationkey//2 AS needs FROM nation WHERE n_nationkey > 0), p(node, needs) AS (SELECT * FROM e UNION SELECT p.node, e.needs FROM p JOIN e ON p.needs = e.node) SELECT node, needs FROM p")
def stage_dependency_closure(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet").filter("n_nationkey > 0")
    return stages.closure(n.select(F.col("n_nationkey").alias("node"), F.floor(F.col("n_nationkey") / 2).cast("int").alias("needs")))


@query("SELECT event_id, ((user_id*37)%1009)::INT AS x0, ((user_id*91)%997)::INT AS y0, value FROM events WHERE (user_id*37)%1009 <= 400 AND (user_id*37)%1009+9 >= 100 AND (user_id*91)%997 <= 400 AND (user_id*91)%997+9 >= 100")
def continuous_bbox(spark, sf):
    return continuous.within(continuous.frames(spark.read.parquet(f"{sf}/events.parquet")), 100, 100, 400, 400).select("event_id", "x0", "y0", "value")


@query("SELECT user_id, event_id AS version, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def latest_version(spark, sf):
    return continuous.latest(spark.read.parquet(f"{sf}/events.parquet").select("user_id", F.col("event_id").alias("version"), "value"), ["user_id"])


@query("SELECT date_trunc('hour', ts) AS hour, count(*) AS frames FROM events GROUP BY 1")
def frames_by_hour(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").groupBy(F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("frames"))


WKT = "'POLYGON((' || x0 || ' ' || y0 || ',' || x1 || ' ' || y0 || ',' || x1 || ' ' || y1 || ',' || x0 || ' ' || y1 || ',' || x0 || ' ' || y0 || '))'"


@query(f"SELECT id, {WKT} AS wkt, ((x1-x0)*(y1-y0))::DOUBLE AS area, x0::DOUBLE AS x0, y1::DOUBLE AS y1 FROM rect_a")
def wkt_roundtrip(spark, sf):
    c = {k: F.col(k).cast("string") for k in sj.BOX}
    text = F.concat(F.lit("POLYGON(("), F.concat_ws(",", *[F.concat_ws(" ", c[x], c[y]) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0"))]), F.lit("))"))
    r = fixture(spark, sf, "rect_a").select("id", shapes.ring_of(text).alias("ring"))
    box = shapes.envelope(F.col("ring"))
    return r.select("id", shapes.to_wkt(F.col("ring")).alias("wkt"), shapes.ring_area(F.col("ring")).alias("area"), box[0], box[3])


@query("SELECT p_partkey AS id, regexp_replace(p_name, '[^ ]* *', '', '') AS rest, (p_partkey%500)::INT AS x0, (p_partkey%500+127)::INT AS x1 FROM part")
def tile_names(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    name = F.concat(F.lit("slide-"), (F.col("p_partkey") % 500).cast("string"), F.lit("-7.tiff"))
    x0, _, x1, _ = files.tile_of_name(name, 128)
    return p.select(F.col("p_partkey").alias("id"), F.regexp_replace("p_name", r"^[^ ]* *", "").alias("rest"), x0, x1)


@query("SELECT p_partkey AS id FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)")
def pair_by_stem(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey")
    images = p.select(F.concat(F.lit("/img/"), F.col("p_partkey"), F.lit(".tiff")).alias("path"))
    found, _ = files.pair_by_stem(images, spark.read.parquet(f"{sf}/lineitem.parquet").select(F.concat(F.lit("/mask/"), F.col("l_partkey"), F.lit(".txt")).alias("path")).distinct())
    return found.select(F.col("stem").cast("long").alias("id"))


@query("SELECT p_partkey AS id, row_number() OVER (ORDER BY p_partkey) AS place FROM part")
def natural_sort(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("id"), F.concat(F.lit("Img"), F.col("p_partkey"), F.lit(".tif")).alias("name"))
    # a listing of one folder: small
    return p.withColumn("place", F.row_number().over(Window.orderBy(files.natural_key(F.col("name")))).cast("long")).select("id", "place")


@query("SELECT (i+1)::BIGINT AS id, true AS inside FROM range(1000) r(i)")
def random_triangles(spark, sf):
    t = files.random_triangles(spark, 1000, 3.0, 1000.0, 11)
    return t.select("id", F.forall("ring", lambda v: (v["x"].between(0, 1000)) & (v["y"].between(0, 1000))).alias("inside"))


def _ells(spark, sf, name):
    """L-shaped polygons on the boxes: twice as wide and high as a box, without the upper right quarter."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    corners = ((0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2), (0, 0))
    ring = F.array(*[F.struct((F.col("x0") + i * w).cast("double").alias("x"), (F.col("y0") + j * h).cast("double").alias("y")) for i, j in corners])
    return polygon_join.spread(fixture(spark, sf, name)).select("id", ring.alias("ring"))


def _ell_sql(name: str) -> str:
    """The two boxes of an L, and its area."""
    area = "3*(x1-x0)*(y1-y0) AS area"
    return f"(SELECT id, x0, y0, 2*x1-x0 AS x1, y1, {area} FROM {name} UNION ALL SELECT id, x0, y1, x1, 2*y1-y0, {area} FROM {name})"


ELLS = f"(SELECT a.id AS id1, b.id AS id2, any_value(a.area)::DOUBLE AS area1, any_value(b.area)::DOUBLE AS area2, sum({I})::DOUBLE AS inter, min({D2}) AS d2 FROM {_ell_sql('rect_a')} a JOIN {_ell_sql('rect_b')} b ON a.x0-64 <= b.x1 AND b.x0 <= a.x1+64 AND a.y0-64 <= b.y1 AND b.y0 <= a.y1+64 GROUP BY a.id, b.id)"


@query(f"SELECT id1, id2, area1, area2, inter AS intersect_area, area1+area2-inter AS union_area, round(inter/(area1+area2-inter), 6) AS jaccard, round(2*inter/(area1+area2), 6) AS dice FROM {ELLS} WHERE d2 = 0")
def polygon_stats(spark, sf):
    p = polygon_join.polygon_join(_ells(spark, sf, "rect_a"), _ells(spark, sf, "rect_b"), "st_intersects")
    area = F.round("intersect_area", 6)
    union, both = F.col("area1") + F.col("area2") - area, F.col("area1") + F.col("area2")
    return p.select("id1", "id2", "area1", "area2", area.alias("intersect_area"), union.alias("union_area"), F.round(area / union, 6).alias("jaccard"), F.round(2 * area / both, 6).alias("dice"))


def _polygons(name: str, predicate: str, sql: str, d: float = 0.0) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return polygon_join.polygon_pairs(_ells(spark, sf_dir, "rect_a"), _ells(spark, sf_dir, "rect_b"), predicate, d)

    run.__name__ = name
    query(f"SELECT id1, id2 FROM {ELLS} WHERE {sql}")(run)


_polygons("polygon_touches", "st_touches", "d2 = 0 AND inter = 0")
_polygons("polygon_overlaps", "st_overlaps", "inter > 0 AND inter < area1 AND inter < area2")
_polygons("polygon_contains", "st_contains", "inter > 0 AND inter = area2")
_polygons("polygon_within", "st_within", "inter > 0 AND inter = area1")
_polygons("polygon_dwithin", "st_dwithin", "d2 <= 9", 3.0)


def _overlap(x0: str, y0: str, x1: str, y1: str) -> str:
    return f"(greatest(least({x1},b.x1)-greatest({x0},b.x0),0)*greatest(least({y1},b.y1)-greatest({y0},b.y0),0))"


FRAMED = f"{_overlap('a.x0', 'a.y0', 'a.x1', 'a.y1')} - {_overlap('a.x0+4', 'a.y0+4', 'a.x1-4', 'a.y1-4')}"


@query(f"SELECT id1, id2, area1, area2, inter::DOUBLE AS intersect_area FROM (SELECT a.id AS id1, b.id AS id2, ({A1} - (a.x1-a.x0-8)*(a.y1-a.y0-8))::DOUBLE AS area1, {A2}::DOUBLE AS area2, {FRAMED} AS inter FROM rect_u a JOIN rect_b b ON {MEET}) WHERE inter > 0")
def polygon_holes(spark, sf):
    ring = lambda x0, y0, x1, y1: F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))])
    x0, y0, x1, y1 = (F.col(c) for c in sj.BOX)
    frames = polygon_join.spread(fixture(spark, sf, "rect_u")).select("id", ring(x0, y0, x1, y1).alias("ring"), F.array(ring(x0 + 4, y0 + 4, x1 - 4, y1 - 4)).alias("holes"))
    plain = polygon_join.spread(fixture(spark, sf, "rect_b")).select("id", ring(x0, y0, x1, y1).alias("ring"))
    p = polygon_join.polygon_join(frames, plain, "st_intersects").filter("intersect_area > 0")
    return p.select("id1", "id2", *[F.round(c, 6).alias(c) for c in ("area1", "area2", "intersect_area")])


@query()
def morph_reconstruction(spark, sf):
    level = F.col("label") * 30
    px = slide_assemble(spark, sf).select("y", "x", level.alias("mask"), F.when((F.col("x") * 7 + F.col("y") * 13) % 97 == 0, level).otherwise(0).alias("marker"))
    return reconstruction.reconstruct(px, 64)


@query()
def bbox_intervals(spark, sf):
    return regions.box_intervals(fixture(spark, sf, "rect_a"))


@query("SELECT id, p AS part, CASE WHEN p=0 THEN x0 ELSE (x0+x1)//2+1 END AS p_x0, CASE WHEN p=0 THEN (x0+x1)//2 ELSE x1 END AS p_x1 FROM rect_a, range(2) r(p) WHERE p = 0 OR (x0+x1)//2+1 <= x1")
def bbox_halves(spark, sf):
    return regions.box_parts(fixture(spark, sf, "rect_a"), ("x0",), ("x1",))


@query("SELECT a.id, a.x0-b.x0 AS x0, a.y0-b.y0 AS y0, a.x1-b.x0 AS x1, a.y1-b.y0 AS y1, (a.x0=b.x0 AND a.y0=b.y0 AND a.x1=b.x1 AND a.y1=b.y1) AS equal FROM rect_a a JOIN rect_b b USING (id)")
def bbox_to_origin(spark, sf):
    a, b = rects(spark, sf)
    both = a.join(b.select("id", *[F.col(c).alias(f"b_{c}") for c in sj.BOX]), "id")
    own, other = [F.col(c) for c in sj.BOX], [F.col(f"b_{c}") for c in sj.BOX]
    moved = regions.box_to_origin(own, other[:2])
    return both.select("id", *[c.alias(n) for c, n in zip(moved, sj.BOX, strict=True)], regions.box_equals(own, other).alias("equal"))


@query("SELECT DISTINCT version FROM regions WHERE dr_name = '2-HIGH'")
def region_versions(spark, sf):
    return regions.versions(fixture(spark, sf, "regions"), "2-HIGH")


@query("SELECT dr_id AS worker, sum(seq)::BIGINT AS reused FROM regions GROUP BY 1")
def worker_reuse(spark, sf):
    return regions.reuse(fixture(spark, sf, "regions"), "seq", "dr_id")


@query("SELECT a.o AS id, a.v = b.v AS equal FROM (SELECT l_orderkey AS o, list([l_quantity, l_tax] ORDER BY l_linenumber, l_quantity, l_tax) AS v FROM lineitem GROUP BY 1) a JOIN (SELECT l_orderkey AS o, list([l_quantity, CASE WHEN l_orderkey % 2 = 0 THEN l_tax ELSE l_discount END] ORDER BY l_linenumber, l_quantity, l_tax, l_discount) AS v FROM lineitem GROUP BY 1) b USING (o)")
def ragged_equality(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet")
    other = F.when(F.col("l_orderkey") % 2 == 0, F.col("l_tax")).otherwise(F.col("l_discount"))
    ordered = lambda *v: F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_tax", "l_discount", F.array(*v).alias("v")))), lambda s: s["v"])
    both = rows.groupBy(F.col("l_orderkey").alias("id")).agg(ordered("l_quantity", "l_tax").alias("a"), ordered("l_quantity", other).alias("b"))
    return both.select("id", regions.ragged_equal(F.col("a"), F.col("b")).alias("equal"))


@query("SELECT id, 1 AS side, x0, y0, x1, y1 FROM rect_a UNION ALL SELECT id, 2 AS side, x0, y0, x1, y1 FROM rect_b")
def side_tagging(spark, sf):
    return files.tagged(*rects(spark, sf)).select("id", "side", *sj.BOX)


@query(f"SELECT a.id || chr(9) || (a.x1-a.x0) || chr(9) || b.id || chr(9) || (b.y1-b.y0) AS line FROM rect_a a JOIN rect_b b ON {MEET}")
def pair_lines(spark, sf):
    w, h = (F.col("a_x1") - F.col("a_x0")).alias("w"), (F.col("b_y1") - F.col("b_y0")).alias("h")
    pairs = sj.spatial_join(*rects(spark, sf), boxes.intersects)
    return files.pair_lines(pairs.select(F.array(F.col("a_id"), w).alias("side1"), F.array(F.col("b_id"), h).alias("side2")), "1:1,1:2,2:1,2:2")


@query(f"SELECT a.id, count(*) FILTER (NOT ({MEET})) AS disjoint FROM rect_a a, rect_b b GROUP BY a.id")
def st_disjoint_full(spark, sf):
    return sj.disjoint_counts(*rects(spark, sf))


def _covered(name: str, make) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        a = fixture(spark, sf_dir, "rect_a")
        return partition.to_tiles(a, make(a, 100)).select("id").distinct()

    run.__name__ = name
    query("SELECT id FROM rect_a")(run)


_covered("hilbert_cover", partition.hilbert_tiles)
_covered("bsp_cover", partition.binary_tiles)
_covered("bos_cover", partition.strip_tiles)


@query("SELECT id, (least(x1,1023)-x0+1)*(least(y1,1023)-y0+1) AS cells FROM rect_a")
def interval_cells(spark, sf):
    return bbox_intervals(spark, sf).groupBy("id").agg(F.sum(F.col("last") - F.col("first") + 1).alias("cells"))


@query("SELECT id FROM rect_a WHERE substr(md5('5:' || id), 1, 8) < '4ccccccd'")
def bernoulli_sample(spark, sf):
    return partition.sampled(fixture(spark, sf, "rect_a"), 0.3, 5).select("id")


@query("SELECT id, row_number() OVER (ORDER BY x0+x1, id) AS place FROM rect_a")
def centre_order(spark, sf):
    return partition.centre_order(fixture(spark, sf, "rect_a"))


@query("SELECT 'T' || i || '|' || j AS tile_id, (j%4)*0.25*(10+i)+i*100 AS x0, (j//4)*0.25*20 AS y0, (j%4+1)*0.25*(10+i)+i*100 AS x1, (j//4+1)*0.25*20 AS y1 FROM range(8) p(i), range(16) q(j)")
def nested_denormalize(spark, sf):
    i, j = F.floor(F.col("id") / 16), F.col("id") % 16
    first = spark.range(8).select(F.concat(F.lit("T"), "id").alias("tile_id"), (F.col("id") * 100).alias("x0"), F.lit(0).alias("y0"), (F.col("id") * 101 + 10).alias("x1"), F.lit(20).alias("y1"))
    tiles = spark.range(128).select(F.concat(F.lit("T"), i, F.lit("|"), j).alias("tile_id"), (j % 4 * 0.25).alias("x0"), (F.floor(j / 4) * 0.25).alias("y0"), ((j % 4 + 1) * 0.25).alias("x1"), ((F.floor(j / 4) + 1) * 0.25).alias("y1"))
    return partition.denormalize_nested(tiles, first)


@query("SELECT ((a-1)*36+(b-1)*6+(c-1))::BIGINT AS param_set_id, a::INT AS a, b::INT AS b, c::INT AS c FROM range(1,7) x(a), range(1,7) y(b), range(1,7) z(c) WHERE a+b <= c AND (a < b OR c = 6)")
def constrained_grid(spark, sf):
    return params.constrained(params.grid(spark, {k: params.span(1, 6) for k in "abc"}), "a + b <= c", "a < b or c = 6")


@query("WITH parts AS (SELECT fold, id, row_number() OVER (PARTITION BY fold ORDER BY md5('5:' || fold || ':' || id), id) <= 9 AS train FROM (SELECT range AS id FROM range(15)), (SELECT range AS fold FROM range(10))), means AS (SELECT fold, param_set_id%7 AS param_set_id, avg(score) FILTER (train) AS train_score, avg(score) FILTER (NOT train) AS test_score FROM trace JOIN parts ON trial%15 = parts.id GROUP BY 1, 2) SELECT fold::INT AS fold, param_set_id, round(train_score, 6) AS train_score, round(test_score, 6) AS test_score FROM means QUALIFY row_number() OVER (PARTITION BY fold ORDER BY train_score, param_set_id) = 1")
def cross_validation(spark, sf):
    scores = fixture(spark, sf, "trace").select((F.col("param_set_id") % 7).alias("param_set_id"), (F.col("trial") % 15).alias("image"), "score")
    found = params.cross_validate(scores, params.folds(spark.range(15), 10, 9, 5))
    return found.select("fold", "param_set_id", F.round("train_score", 6).alias("train_score"), F.round("test_score", 6).alias("test_score"))


@query("SELECT (p*12+q*4+r)::BIGINT AS param_set_id, n_nationkey AS id, ((n_nationkey+p)*2+q)*3-r AS v FROM nation, range(5) x(p), range(3) y(q), range(4) z(r)")
def shared_stages(spark, sf):
    sets = params.grid(spark, {"p": params.span(0, 4), "q": params.span(0, 2), "r": params.span(0, 3)})
    n = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").alias("id"))
    steps = [(["p"], lambda df: df.withColumn("v", F.col("id") + F.col("p"))), (["q"], lambda df: df.withColumn("v", F.col("v") * 2 + F.col("q"))), (["r"], lambda df: df.withColumn("v", F.col("v") * 3 - F.col("r")))]
    return stages.run_shared(n, sets, steps).select("param_set_id", "id", "v")


@query("SELECT tile, label::BIGINT AS label, count(*)::DOUBLE AS area FROM mask GROUP BY tile, label")
def contour_areas(spark, sf):
    return contours.contours(fixture(spark, sf, "mask")).groupBy("tile", "label").agg(F.sum("area").alias("area"))


CHANNELS = {"b": "(x*7+y*3)%256", "g": "(x*x+y)%251", "r": "(x+y*y)%241"}
_SUMS = ", ".join(f"abs(coalesce(sum(o.dx*(2-abs(o.dy))*(n.{c}-i.{c})),0)) + abs(coalesce(sum(o.dy*(2-abs(o.dx))*(n.{c}-i.{c})),0)) AS g{c}" for c in CHANNELS)
_STATS = ", ".join(f"round(avg({c}),6) AS {c}_mean, min({c}) AS {c}_min, max({c}) AS {c}_max, round(var_pop({c}),6) AS {c}_var, round(avg(g{c}),6) AS {c}_gradient_mean, max(g{c})::BIGINT AS {c}_gradient_max, count(*) FILTER (g{c} >= 200) AS {c}_edges" for c in CHANNELS)


@query(f"WITH im AS (SELECT tile, y, x, label, {', '.join(f'{v} AS {c}' for c, v in CHANNELS.items())} FROM mask) SELECT tile, label, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, count(*) AS pixels, {_STATS} FROM (SELECT i.tile, i.y, i.x, i.label, i.b, i.g, i.r, {_SUMS} FROM im i, (SELECT p.range-1 AS dy, q.range-1 AS dx FROM range(3) p, range(3) q WHERE p.range <> 1 OR q.range <> 1) o LEFT JOIN im n ON n.tile = i.tile AND n.y = i.y+o.dy AND n.x = i.x+o.dx GROUP BY ALL) GROUP BY tile, label")
def channel_features(spark, sf):
    m = fixture(spark, sf, "mask")
    return features.object_features(m, m.select("tile", "y", "x", *[F.expr(v).alias(c) for c, v in CHANNELS.items()]))


@query("SELECT channel, l_orderkey AS id, l_linenumber AS line, round((v-m)/s*30+120, 3) AS value FROM (SELECT *, avg(v) OVER (PARTITION BY channel) AS m, stddev_pop(v) OVER (PARTITION BY channel) AS s FROM (SELECT l_suppkey%3 AS channel, l_orderkey, l_linenumber, (l_partkey%251)::DOUBLE AS v FROM lineitem))")
def normalized_colours(spark, sf):
    px = spark.read.parquet(f"{sf}/lineitem.parquet").select((F.col("l_suppkey") % 3).alias("channel"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), (F.col("l_partkey") % 251).cast("double").alias("value"))
    return stages.normalize_colours(px, 120.0, 30.0).select("channel", "id", "line", F.round("value", 3).alias("value"))


@query()
def segmented_objects(spark, sf):
    px = fixture(spark, sf, "mask").select("tile", "y", "x", ((F.col("x") * 7 + F.col("y") * 3) % 256).alias("value"))
    return stages.segment_and_features(px, 40.0, 3)


@query("SELECT seq, concat_ws('-', dr_name, dr_id, version::VARCHAR, ts::VARCHAR) || '.tiff' AS name FROM regions")
def region_file_names(spark, sf):
    return fixture(spark, sf, "regions").select("seq", regions.file_name(F.col("dr_name"), F.col("dr_id"), F.col("version"), F.col("ts"), ".tiff").alias("name"))


@query("SELECT s_suppkey AS id, CASE s_suppkey%3 WHEN 0 THEN 0.0 WHEN 1 THEN (s_suppkey%41)::DOUBLE ELSE 0.0 END AS magnification FROM supplier")
def slide_magnification(spark, sf):
    k = F.col("s_suppkey")
    properties = F.when(k % 3 == 0, F.create_map(F.lit("other"), F.lit("7"))).when(k % 3 == 1, F.create_map(F.lit("aperio.AppMag"), (k % 41).cast("string"))).otherwise(F.create_map(F.lit("aperio.AppMag"), F.lit("none")))
    return spark.read.parquet(f"{sf}/supplier.parquet").select(k.alias("id"), regions.magnification(properties).alias("magnification"))


@query(f"SELECT (m.y-20)::INT AS y, (m.x-10)::INT AS x, m.label FROM mask m JOIN ({FOUND}) f ON m.tile = f.seq%4 WHERE m.x BETWEEN 10 AND 99 AND m.y BETWEEN 20 AND 119")
def region_of_interest(spark, sf):
    r = fixture(spark, sf, "regions")
    px = fixture(spark, sf, "mask").join(regions.lookup(r, "1-URGENT", 3, 2).select("seq", (F.col("seq") % 4).cast("int").alias("tile")), "tile")
    return regions.region_of_interest(r, px.select("seq", "y", "x", "label"), "1-URGENT", 3, 2, (10, 20, 99, 119)).select("y", "x", "label")


@query(f"SELECT a.id, round(sqrt({D2}), 9) AS distance FROM rect_a a JOIN rect_b b USING (id)")
def bbox_distance(spark, sf):
    a, b = rects(spark, sf)
    both = a.join(b.select("id", *[F.col(c).alias(f"b_{c}") for c in sj.BOX]), "id")
    return both.select("id", F.round(regions.box_distance([F.col(c) for c in sj.BOX], [F.col(f"b_{c}") for c in sj.BOX]), 9).alias("distance"))


@query("SELECT p_partkey AS id, '/out/' || p_partkey || CASE p_partkey%3 WHEN 0 THEN '' ELSE '.a' END || '.pbm' AS path, '/in.dir/' || p_partkey || CASE p_partkey%3 WHEN 1 THEN '.a' WHEN 2 THEN '.a' ELSE '' END || '.pbm' AS renamed FROM part")
def path_rewrite(spark, sf):
    k = F.col("p_partkey").cast("string")
    tail = F.when(F.col("p_partkey") % 3 == 0, "").when(F.col("p_partkey") % 3 == 1, ".a.tiff").otherwise(".a.b")
    path = F.concat(F.lit("/in.dir/"), k, tail)
    renamed = files.with_extension(path, "pbm")
    return spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("id"), files.in_folder(renamed, "/out").alias("path"), renamed.alias("renamed"))


@query()
def cache_replay(spark, sf):
    log = fixture(spark, sf, "regions").select(F.col("dr_id").alias("worker"), F.col("seq").alias("at"), F.concat_ws("-", "dr_name", "ts").alias("key"), (1 + F.col("version")).alias("size"))
    return caching.replay(log, 60).select("worker", "hits", "misses", "evictions")


@query("SELECT id, i AS cx, j AS cy FROM rect_a, range(32) p(i), range(32) q(j) WHERE i BETWEEN x0//64 AND x1//64 AND j BETWEEN y0//64 AND y1//64")
def udtf_cells(spark, sf):
    sql.register(spark)
    return spark.sql("SELECT r.id, c.cx, c.cy FROM {r} r, LATERAL cells(r.x0, r.y0, r.x1, r.y1, 64) c", r=fixture(spark, sf, "rect_a"))


@query("SELECT id, ((x1-x0)*(y1-y0))::DOUBLE AS area FROM rect_b")
def udaf_hull_area(spark, sf):
    sql.register(spark)
    corners = spark.sql("SELECT id, explode(array(struct(x0 AS x, y0 AS y), struct(x1 AS x, y0 AS y), struct(x0 AS x, y1 AS y), struct(x1 AS x, y1 AS y))) AS p FROM {r}", r=fixture(spark, sf, "rect_b"))
    return spark.sql("SELECT id, hull_area(p.x, p.y) AS area FROM {c} GROUP BY id", c=corners)


@query("SELECT id, round((x1-x0)*(y1-y0) + 2*2.5*((x1-x0)+(y1-y0)) + 16*6.25*sin(pi()/16), 6) AS area FROM rect_a")
def buffered_areas(spark, sf):
    return polygon_join.buffered_areas(fixture(spark, sf, "rect_a"), 2.5).select("id", F.round("area", 6).alias("area"))


@query(ORACLES["continuous_bbox"])
def stream_bbox(spark, sf):
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    return continuous.replay(spark, f"{sf}/events.parquet", continuous.EVENTS, (100, 100, 400, 400), f"{folder}/out", f"{folder}/state").select("event_id", "x0", "y0", "value")


STEP = "x & (s-1) AS u, y & (s-1) AS v, (x & s > 0)::BIGINT AS rx, (y & s > 0)::BIGINT AS ry"


@query(f"WITH h(id, x, y, d, s) AS (SELECT id, x0::BIGINT, y0::BIGINT, 0::BIGINT, 512::BIGINT FROM rect_a UNION ALL SELECT id, CASE WHEN ry=1 THEN u WHEN rx=1 THEN s-1-v ELSE v END, CASE WHEN ry=1 THEN v WHEN rx=1 THEN s-1-u ELSE u END, d + s*s*xor(3*rx, ry), s//2 FROM (SELECT id, d, s, {STEP} FROM h WHERE s > 0)) SELECT id, d AS place FROM h WHERE s = 0")
def hilbert_places(spark, sf):
    return fixture(spark, sf, "rect_a").select("id", shapes.hilbert(F.col("x0"), F.col("y0"), 10).alias("place"))


for _name in ("object_features", "distance_transform", "channel_features", "cross_validation"):  # their own WITH follows that of the fixtures
    ORACLES[_name] = ORACLES[_name].replace(" WITH im AS", ", im AS").replace(" WITH px AS", ", px AS").replace(" WITH parts AS", ", parts AS")
ORACLES["hilbert_places"] = ORACLES["hilbert_places"].replace("WITH ", "WITH RECURSIVE ", 1).replace(" WITH h", ", h")

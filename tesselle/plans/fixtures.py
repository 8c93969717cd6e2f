"""Spatial inputs derived from the driver's tables by integer arithmetic, the same in Spark and in SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

FIXTURES = {
    "rect_a": "SELECT p_partkey AS id, (p_partkey*37)%1009 AS x0, (p_partkey*91)%997 AS y0, (p_partkey*37)%1009+1+p_size%7 AS x1, (p_partkey*91)%997+1+p_size%5 AS y1 FROM part",
    "rect_b": "SELECT c_custkey AS id, (c_custkey*53)%1009 AS x0, (c_custkey*29)%997 AS y0, (c_custkey*53)%1009+2+c_nationkey%6 AS x1, (c_custkey*29)%997+2+c_nationkey%4 AS y1 FROM customer",
    "rect_s": "SELECT p_partkey AS id, (p_partkey*37)%199 AS x0, (p_partkey*91)%197 AS y0, (p_partkey*37)%199+1+p_size%2 AS x1, (p_partkey*91)%197+1+p_size%2 AS y1 FROM part",
    "rect_t": "SELECT c_custkey AS id, (c_custkey*53)%199 AS x0, (c_custkey*29)%197 AS y0, (c_custkey*53)%199+1+c_nationkey%2 AS x1, (c_custkey*29)%197+1+c_nationkey%2 AS y1 FROM customer",
    "rect_u": "SELECT p_partkey AS id, (p_partkey*37)%1009 AS x0, (p_partkey*91)%997 AS y0, (p_partkey*37)%1009+15+p_size%7 AS x1, (p_partkey*91)%997+15+p_size%5 AS y1 FROM part",
    "seg_a": "SELECT p_partkey AS id, (p_partkey*37)%1009 AS x0, (p_partkey*91)%997 AS y0, (p_partkey*37)%1009+25*(p_partkey%2) AS x1, (p_partkey*91)%997+25*(1-p_partkey%2) AS y1 FROM part",
    "point_a": "SELECT p_partkey AS id, (p_partkey*37)%1009 AS x0, (p_partkey*91)%997 AS y0, (p_partkey*37)%1009 AS x1, (p_partkey*91)%997 AS y1 FROM part",
    "point_b": "SELECT c_custkey AS id, (c_custkey*53)%1009 AS x0, (c_custkey*29)%997 AS y0, (c_custkey*53)%1009 AS x1, (c_custkey*29)%997 AS y1 FROM customer",
    "geo": "SELECT s_suppkey AS id, (s_suppkey*13)%120-60 AS lat, (s_suppkey*47)%360-180 AS lon FROM supplier",
    "mask": "SELECT CAST(l_suppkey%4 AS INT) AS tile, CAST(l_orderkey%256 AS INT) AS y, CAST(l_partkey%256 AS INT) AS x, max(1+l_linenumber%7) AS label FROM lineitem GROUP BY 1, 2, 3",
    "ref_mask": "SELECT CAST(l_suppkey%4 AS INT) AS tile, CAST(l_orderkey%256 AS INT) AS y, CAST((l_partkey+1)%256 AS INT) AS x, max(1+l_linenumber%7) AS label FROM lineitem GROUP BY 1, 2, 3",
    "regions": "SELECT o_orderpriority AS dr_name, o_orderkey%5 AS version, o_custkey%10 AS ts, o_orderstatus AS dr_id, o_orderkey AS seq FROM orders",
    "trace": "SELECT user_id AS param_set_id, value AS score, event_id AS trial FROM events",
}
SOURCE = {"rect_u": "part", "rect_s": "part", "rect_t": "customer", "seg_a": "part", "rect_a": "part", "rect_b": "customer", "point_a": "part", "point_b": "customer", "geo": "supplier", "mask": "lineitem", "ref_mask": "lineitem", "regions": "orders", "trace": "events"}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source = SOURCE[name]
    return spark.sql(FIXTURES[name].replace(f"FROM {source}", "FROM {t}"), t=spark.read.parquet(f"{sf_dir}/{source}.parquet"))


def with_fixtures(sql: str) -> str:
    """The query with a WITH clause for the fixtures that it names."""
    used = [k for k in FIXTURES if re.search(rf"\b{k}\b", sql)]
    return "WITH " + ", ".join(f"{k} AS ({FIXTURES[k]})" for k in used) + " " + sql if used else sql

"""Functions for Spark SQL: one that makes a table of cells, and an aggregate."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .shapes import convex_hull, polygon_area


class Cells:
    """cells(x0, y0, x1, y1, size): the grid cells that an inclusive box covers. Nulls cover none."""

    def eval(self, x0, y0, x1, y1, size):
        if None in (x0, y0, x1, y1) or not size or size <= 0:
            return
        for cx in range(int(x0 // size), int(x1 // size) + 1):
            for cy in range(int(y0 // size), int(y1 // size) + 1):
                yield cx, cy


def hull_area(x: pd.Series, y: pd.Series) -> float:
    """hull_area(x, y): area of the convex hull of a group's points; 0 of fewer than three."""
    both = pd.DataFrame({"x": x, "y": y}).dropna()
    return polygon_area(convex_hull(list(both.astype(float).itertuples(index=False, name=None))))


def register(spark: SparkSession) -> None:
    spark.udtf.register("cells", F.udtf(Cells, returnType="cx long, cy long"))
    spark.udf.register("hull_area", F.pandas_udf(hull_area, "double"))

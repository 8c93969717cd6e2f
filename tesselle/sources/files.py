"""Readers and writers: tabbed objects with WKT, labelled masks as text, ragged vectors, XML matrices, listings."""

from __future__ import annotations

import json
import re
import struct
import xml.etree.ElementTree as ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shapes import envelope, holes_of, outline_of, to_wkt


def read_objects(spark: SparkSession, path: str, geometry: int, n_fields: int) -> DataFrame:
    """Tabbed lines with a geometry in the given field (from 1): f1.., ring, holes and the box. Lines without one are dropped."""
    schema = ", ".join(f"f{k} string" for k in range(1, n_fields + 1))
    rows = spark.read.csv(path, sep="\t", schema=schema, quote='"')
    rows = rows.filter(F.length(f"f{geometry}") >= 2).withColumn("ring", outline_of(F.col(f"f{geometry}")))
    rows = rows.withColumn("holes", F.coalesce(holes_of(F.col(f"f{geometry}")), F.array().cast("array<array<struct<x:double,y:double>>>")))
    return rows.filter("ring is not null").select("*", *envelope(F.col("ring")))


def write_objects(polygons: DataFrame, path: str) -> None:
    """id, tab, POLYGON text; ids are those of the rows."""
    polygons.select("id", to_wkt(F.col("ring"))).write.csv(path, sep="\t", quote="\u0000")


def tagged(*inputs: DataFrame) -> DataFrame:
    """The inputs as one, each row with the number of its side, from 1."""
    out = inputs[0].withColumn("side", F.lit(1))
    for k, df in enumerate(inputs[1:], 2):
        out = out.unionByName(df.withColumn("side", F.lit(k)))
    return out


def pair_lines(pairs: DataFrame, fields: str = "") -> DataFrame:
    """line: fields of either side (arrays side1 and side2) joined by tabs. `fields` names them as side:place from 1;
    without it all fields of both sides are written. Fields that a row lacks are empty."""
    wanted = [tuple(map(int, f.split(":"))) for f in fields.split(",") if f]
    if any(side not in (1, 2) or place < 1 for side, place in wanted):
        raise ValueError(f"no such fields: {fields}")
    text = lambda c: F.transform(c, lambda v: F.coalesce(v.cast("string"), F.lit("")))
    if not wanted:
        return pairs.select(F.array_join(F.concat(text(F.col("side1")), text(F.col("side2"))), "\t").alias("line"))
    chosen = [F.coalesce(F.try_element_at(f"side{side}", F.lit(place)).cast("string"), F.lit("")) for side, place in wanted]
    return pairs.select(F.array_join(F.array(*chosen), "\t").alias("line"))


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter(F.size(parts) == 5).select(parts[0].alias("tile_id"), *[parts[k].try_cast("double").alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"), 1)])


def read_mask_text(spark: SparkSession, path: str) -> DataFrame:
    """path, y, x, label from files of `columns rows` and then the labels in row order."""
    numbers = F.filter(F.split("value", r"\s+"), lambda v: v != "")
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), numbers.alias("n"))
    cells = whole.select("path", F.try_element_at("n", F.lit(1)).cast("int").alias("cols"), F.posexplode(F.slice("n", 3, 1 << 30)).alias("k", "v"))
    return cells.select("path", F.floor(F.col("k") / F.col("cols")).cast("int").alias("y"), (F.col("k") % F.col("cols")).alias("x"), F.col("v").cast("int").alias("label"))


def write_mask_text(mask: DataFrame, path: str, cols: int, rows: int) -> None:
    """One file per tile: a row of text per image row, missing pixels as 0."""
    line = F.transform(F.sequence(F.lit(0), F.lit(cols - 1)), lambda x: F.coalesce(F.col("m")[x], F.lit(0)).cast("string"))
    by_row = mask.groupBy("tile", "y").agg(F.map_from_entries(F.collect_list(F.struct("x", "label"))).alias("m")).select("tile", "y", F.array_join(line, " ").alias("t"))
    blank = " ".join("0" for _ in range(cols))
    image = by_row.groupBy("tile").agg(F.map_from_entries(F.collect_list(F.struct("y", "t"))).alias("r"))
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda y: F.coalesce(F.col("r")[y], F.lit(blank))), "\n")
    image.select("tile", F.concat(F.lit(f"{cols} {rows}\n"), text).alias("value")).write.partitionBy("tile").option("lineSep", "\n").text(path)


def vectors_to_bytes(vectors: list[list[float]]) -> bytes:
    return struct.pack("<i", len(vectors)) + b"".join(struct.pack(f"<i{len(v)}d", len(v), *v) for v in vectors)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """path, vectors (array<array<double>>) from files of a count and then, per vector, a count and doubles."""

    def parse(raw: bytes) -> list[list[float]]:
        out, at = [], 4
        for _ in range(struct.unpack_from("<i", raw)[0]):
            n = struct.unpack_from("<i", raw, at)[0]
            out.append(list(struct.unpack_from(f"<{n}d", raw, at + 4)))
            at += 4 + 8 * n
        return out

    def run(frames):
        for frame in frames:
            yield pd.DataFrame({"path": frame["path"], "vectors": [parse(x) for x in frame["content"]]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, vectors array<array<double>>")


def read_xml_matrix(spark: SparkSession, path: str, node: str = "mat") -> DataFrame:
    """path, y, x, value from the named matrix of XML storage files."""

    def run(frames):
        for frame in frames:
            for name, raw in zip(frame["path"], frame["content"], strict=True):
                found = ElementTree.fromstring(raw).find(node)
                cols = int(found.find("cols").text)
                data = np.array(found.find("data").text.split(), float)
                yield pd.DataFrame({"path": name, "y": np.arange(len(data)) // cols, "x": np.arange(len(data)) % cols, "value": data})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, y int, x int, value double")


def xml_matrix(rows: list[list[float]], node: str = "mat") -> str:
    """A matrix as XML storage has it, and as read_xml_matrix reads it."""
    root = ElementTree.Element("opencv_storage")
    mat = ElementTree.SubElement(root, node, type_id="opencv-matrix")
    for name, text in (("rows", len(rows)), ("cols", len(rows[0]) if rows else 0), ("dt", "d"), ("data", " ".join(repr(float(v)) for row in rows for v in row))):
        ElementTree.SubElement(mat, name).text = str(text)
    return '<?xml version="1.0"?>\n' + ElementTree.tostring(root, encoding="unicode")


def write_xml_matrices(cells: DataFrame, path: str, node: str = "mat") -> None:
    """One file for each matrix (name, y, x, value), in a folder of its own name. Missing cells are 0."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros((int(frame["y"].max()) + 1, int(frame["x"].max()) + 1))
        grid[frame["y"], frame["x"]] = frame["value"]
        return pd.DataFrame({"name": [frame["name"].iat[0]], "value": [xml_matrix(grid.tolist(), node)]})

    texts = cells.groupBy("name").applyInPandas(run, "name string, value string")
    texts.write.partitionBy("name").option("lineSep", "\n").text(path)


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Ragged vectors (name, vectors: array<array<double>>) as a table; `vectors_to_bytes` gives the bytes of a file."""
    vectors.select("name", "vectors").write.parquet(path)


def with_extension(path: Column, extension: str) -> Column:
    """The path with another extension, or with one if it has none. Dots in folders don't count."""
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit(f".{extension}"))


def in_folder(path: Column, folder: str) -> Column:
    """The file's name below another folder."""
    return F.concat(F.lit(folder.rstrip("/") + "/"), F.regexp_replace(path, r"^.*/", ""))


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end: the job's marker is there."""
    files, at = _file_system(spark, f"{path.rstrip('/')}/_SUCCESS")
    return bool(files.exists(at))


#: Python types of arguments by their name in text.
ARGUMENTS = {"int": int, "float": float, "string": str}


def argument_text(name: str, value: int | float | str | list[float]) -> str:
    """name:type:value, a list of numbers with commas."""
    if isinstance(value, list):
        return f"{name}:floats:{','.join(map(repr, map(float, value)))}"
    kind = "string" if isinstance(value, str) else "int" if isinstance(value, int) else "float"
    return f"{name}:{kind}:{value if kind == 'string' else repr(value)}"


def argument_of(text: str) -> tuple[str, int | float | str | list[float]]:
    name, kind, value = text.split(":", 2)
    if kind == "floats":
        return name, [float(v) for v in value.split(",") if v]
    if kind not in ARGUMENTS:
        raise ValueError(f"no such type: {kind}")
    return name, ARGUMENTS[kind](value)


def list_files(spark: SparkSession, path: str, part: str) -> DataFrame:
    """Files below the folder whose name holds `part`, which need not be at its end."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    return files.filter(F.contains(F.element_at(F.split("path", "/"), -1), F.lit(part)))


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def folder_entries(spark: SparkSession, path: str) -> list[tuple[str, bool, int]]:
    """Name, whether it is a folder, and length of what lies in a folder itself, by name. Any store that Spark reads."""
    files, at = _file_system(spark, path)
    return sorted((x.getPath().getName(), bool(x.isDirectory()), 0 if x.isDirectory() else int(x.getLen())) for x in files.listStatus(at))


def make_folder(spark: SparkSession, path: str) -> bool:
    """Makes a folder and those above it; true if it is there then."""
    files, at = _file_system(spark, path)
    return bool(files.mkdirs(at))


def natural_key(name: Column) -> Column:
    """Sorts digits by number and letters without case: each run of digits is padded to 20 places."""
    runs = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(runs, lambda r: F.when(F.regexp_like(r, F.lit(r"^\d")), F.lpad(r, 20, "0")).otherwise(r)), "")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"\.[^.]*$", "")


def pair_by_stem(images: DataFrame, masks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Images with the mask of the same stem, and the images that have none."""
    a, b = images.select(F.col("path").alias("image"), stem(F.col("path")).alias("stem")), masks.select(F.col("path").alias("mask"), stem(F.col("path")).alias("stem"))
    return a.join(b, "stem"), a.join(b, "stem", "left_anti")


def tile_of_name(path: Column, tile: int) -> list[Column]:
    """The inclusive box of a chunk named ...-x-y.ext."""
    x, y = (F.regexp_extract(path, r"-(\d+)-(\d+)\.[^.]*$", k).try_cast("int") for k in (1, 2))
    return [x.alias("x0"), y.alias("y0"), (x + tile - 1).alias("x1"), (y + tile - 1).alias("y1")]


def timestamp_of_name(path: Column) -> Column:
    return F.regexp_extract(path, r"(\d+)\.[^.]*$", 1).try_cast("int")


def workflow_ports(xml: str) -> dict:
    """Ports, processors and links of a dataflow description, whatever its namespace."""
    root = ElementTree.fromstring(re.sub(r'xmlns="[^"]*"', "", xml))
    flow = root if root.tag == "dataflow" else root.find(".//dataflow")
    names = lambda at: [x.text for x in flow.findall(at)]
    end = lambda link, side: "/".join(x.text for x in link.find(side) if x.text)
    return {"inputs": names("inputPorts/port/name"), "outputs": names("outputPorts/port/name"), "processors": names("processors/processor/name"), "links": [(end(x, "source"), end(x, "sink")) for x in flow.findall("datalinks/datalink")]}


def port_values(text: str) -> dict[str, list]:
    """The values of each port from JSON text: an object of ports, or a list of objects with a name and a value or values."""
    found = json.loads(text)
    pairs = found.items() if isinstance(found, dict) else [(x["name"], x.get("values", x.get("value"))) for x in found]
    return {name: list(v) if isinstance(v, list) else [v] for name, v in pairs}


def random_triangles(spark: SparkSession, n: int, size: float, space: float, seed: int) -> DataFrame:
    """Seeded test objects: id and a closed triangle of at most `size` with 4 decimals."""
    r = lambda k: F.rand(seed + k)
    base = spark.range(1, n + 1).withColumns({"cx": r(0) * (space - size), "cy": r(1) * (space - size)})
    v = [F.struct(F.round(F.col("cx") + r(2 + 2 * k) * size, 4).alias("x"), F.round(F.col("cy") + r(3 + 2 * k) * size, 4).alias("y")) for k in range(3)]
    base = base.withColumn("v", F.array(*v))
    return base.select("id", F.concat("v", F.slice("v", 1, 1)).alias("ring"))

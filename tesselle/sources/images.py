"""Dense regions in image files: the portable any-map family and plain TIFF, read and written as whole arrays."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER = re.compile(rb"(?:\s*(?:#[^\n]*\n)?)*(\d+)")
#: TIFF tags and the sizes of its number types.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279
TYPES = {1: "B", 3: "H", 4: "I"}


def read_pnm(data: bytes) -> np.ndarray:
    """P1 to P6, as height x width x channels. Bits count 1 for black, as the format has them."""
    kind, at, head = data[:2], 2, []
    if not re.fullmatch(rb"P[1-6]", kind):
        raise ValueError("not a portable any-map")
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        found = HEADER.match(data, at)
        if not found:
            raise ValueError("the header ends early")
        head.append(int(found[1]))
        at = found.end()
    (width, height), most = head[:2], head[2] if len(head) > 2 else 1
    channels = 3 if kind in (b"P3", b"P6") else 1
    n = width * height * channels
    wide = np.dtype(">u2") if most > 255 else np.dtype(np.uint8)
    if kind == b"P1":
        values = np.array([c - 48 for c in re.sub(rb"#[^\n]*|\s", b"", data[at:])], np.uint8)
    elif kind in (b"P2", b"P3"):
        values = np.array(re.sub(rb"#[^\n]*", b"", data[at:]).split(), np.int64)
    elif kind == b"P4":
        row = -(-width // 8)
        values = np.unpackbits(np.frombuffer(data[at + 1 : at + 1 + row * height], np.uint8).reshape(height, row), axis=1)[:, :width].reshape(-1)
    else:
        values = np.frombuffer(data[at + 1 : at + 1 + n * wide.itemsize], wide)
    if len(values) < n:
        raise ValueError("the pixels end early")
    return values[:n].reshape(height, width, channels).astype(np.uint16 if most > 255 else np.uint8)


def write_pnm(grid: np.ndarray) -> bytes:
    """Height x width x 1 as a grey map, x 3 as a colour map, with 8 or 16 bits."""
    height, width, channels = grid.shape
    wide = grid.dtype.itemsize > 1
    return b"P%d\n%d %d\n%d\n" % (6 if channels == 3 else 5, width, height, 65535 if wide else 255) + grid.astype(">u2" if wide else np.uint8).tobytes()


def read_tiff(data: bytes) -> np.ndarray:
    """The first image of a TIFF file in strips, not compressed, with 8 or 16 bits, as height x width x channels."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack_from(order + "I", data, 4)
    tags = {}
    for k in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        if kind in TYPES:
            code = f"{order}{count}{TYPES[kind]}"
            place = at + 10 + 12 * k
            tags[tag] = struct.unpack_from(code, data, place if struct.calcsize(code) <= 4 else struct.unpack_from(order + "I", data, place)[0])
    if tags.get(COMPRESSION, (1,)) != (1,) or set(tags.get(BITS, (1,))) - {8, 16} or len(set(tags[BITS])) > 1:
        raise ValueError("only plain pixels of 8 or 16 bits are read")
    raw = b"".join(data[lo : lo + n] for lo, n in zip(tags[OFFSETS], tags[COUNTS], strict=True))
    wide = np.dtype(order + "u2") if tags[BITS][0] == 16 else np.dtype(np.uint8)
    shape = tags[HEIGHT][0], tags[WIDTH][0], tags.get(SAMPLES, (1,))[0]
    return np.frombuffer(raw, wide, int(np.prod(shape))).reshape(shape).astype(wide.newbyteorder("="))


def write_tiff(grid: np.ndarray, strip: int = 64) -> bytes:
    height, width, channels = grid.shape
    raw = [grid[lo : lo + strip].astype(grid.dtype.newbyteorder("<")).tobytes() for lo in range(0, height, strip)]
    offsets = np.cumsum([8, *map(len, raw)]).tolist()
    body, at = [b"II*\0", struct.pack("<I", offsets[-1] + offsets[-1] % 2), *raw, bytes(offsets[-1] % 2)], offsets[-1] + offsets[-1] % 2
    entries = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8 * grid.dtype.itemsize] * channels), (COMPRESSION, 3, [1]), (PHOTOMETRIC, 3, [2 if channels == 3 else 1]), (OFFSETS, 4, offsets[:-1]), (SAMPLES, 3, [channels]), (ROWS, 4, [strip]), (COUNTS, 4, [len(x) for x in raw])]
    more, table = b"", struct.pack("<H", len(entries))
    for tag, kind, values in entries:
        packed = struct.pack(f"<{len(values)}{TYPES[kind]}", *values)
        if len(packed) > 4:
            more, packed = more + packed, struct.pack("<I", at + 6 + 12 * len(entries) + len(more))
        table += struct.pack("<HHI", tag, kind, len(values)) + packed.ljust(4, b"\0")
    return b"".join([*body, table, struct.pack("<I", 0), more])


def decode(data: bytes) -> np.ndarray:
    return read_tiff(data) if data[:2] in (b"II", b"MM") else read_pnm(data)


ARRAYS = "path string, height int, width int, channels int, bits int, pixels binary, error string"


def read_regions(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, height, width, channels, bits, pixels (row by row, 16 bits little-endian) and error of the image files in a
    folder. Files that can't be read have an error and nulls."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, data in zip(frame["path"], frame["content"], strict=True):
                try:
                    grid = decode(data)
                    row = (name, *grid.shape, 8 * grid.dtype.itemsize, grid.astype(grid.dtype.newbyteorder("<")).tobytes(), None)
                except (ValueError, LookupError, struct.error) as broken:
                    row = (name, None, None, None, None, None, str(broken) or type(broken).__name__)
                yield pd.DataFrame([row], columns=[x.split()[0] for x in ARRAYS.split(", ")], dtype=object)

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select("path", "content").mapInPandas(run, ARRAYS)


def pixels(regions: DataFrame) -> DataFrame:
    """path, y, x, channel, value: one row for each value of each image."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, h, w, c, bits, raw in zip(*(frame[k] for k in ("path", "height", "width", "channels", "bits", "pixels")), strict=True):
                at = np.arange(int(h) * int(w) * int(c))
                yield pd.DataFrame({"path": name, "y": at // (w * c), "x": at // c % w, "channel": at % c, "value": np.frombuffer(raw, "<u2" if bits == 16 else np.uint8).astype(np.int32)})

    return regions.filter("pixels is not null").select("path", "height", "width", "channels", "bits", "pixels").mapInPandas(run, "path string, y int, x int, channel int, value int")


def write_regions(regions: DataFrame, folder: str, kind: str = "tiff") -> DataFrame:
    """Writes each region (name, height, width, channels, bits, pixels) to folder/name.kind, kind being tiff or pnm, and gives
    name, path and bytes. The folder must be one that all executors share. A file appears whole or not at all, as it is
    renamed when it is written, so a task that runs again does no harm. Regions without pixels are left out."""
    if kind not in ("tiff", "pnm"):
        raise ValueError(f"no such kind of file: {kind}")
    encode = write_tiff if kind == "tiff" else write_pnm

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        Path(folder).mkdir(parents=True, exist_ok=True)
        for frame in frames:
            out = []
            for name, h, w, c, bits, raw in zip(*(frame[k] for k in ("name", "height", "width", "channels", "bits", "pixels")), strict=True):
                data = encode(np.frombuffer(raw, "<u2" if bits == 16 else np.uint8).reshape(int(h), int(w), int(c)))
                path = f"{folder}/{name}.{kind}"
                part = f"{path}.{os.getpid()}.part"
                Path(part).write_bytes(data)
                os.replace(part, path)
                out.append((name, path, len(data)))
            yield pd.DataFrame(out, columns=["name", "path", "bytes"])

    return regions.filter("pixels is not null and length(pixels) > 0").select("name", "height", "width", "channels", "bits", "pixels").mapInPandas(run, "name string, path string, bytes long")

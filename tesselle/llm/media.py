"""Media columns: progressive JPEG.

Bytes are stored as quantised DCT coefficients, the unit in which JPEG is lossless: each block holds 63 bytes as AC
coefficients of 128 to 255 with either sign, and a DC coefficient of 0. The writer makes a 4:2:0 colour image in scans
of spectral selection (DC apart from AC, a component at a time) and successive approximation (the lowest bit in a scan
of its own).
The reader takes any progressive JPEG of 8 bits a sample, with or without restart markers: it adds up the scans in
coefficient arrays, inverts the transform in numpy, upsamples chroma and stores full-resolution RGB tensors. Where a
scan's codes have a fixed width, which holds for raw correction bits in any file, it is read as an array, else code by
code.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
RESTART = re.compile(rb"\xff[\xd0-\xd7]")
#: The longest run of blocks that one end-of-band code can stand for.
LONGEST_RUN = 32767
COMPONENTS = ((1, 2, 2), (2, 1, 1), (3, 1, 1))
#: The reader refuses larger images than this, with an error in the row, as a broken header may claim any size.
MOST_PIXELS = 1 << 28


def _zigzag() -> np.ndarray:
    """Row-major place of each coefficient in zigzag order: along anti-diagonals, turning each time."""
    return np.array(sorted(range(64), key=lambda p: (p // 8 + p % 8, p // 8 if (p // 8 + p % 8) % 2 else p % 8)))


def _inverse() -> np.ndarray:
    """64 zigzag coefficients to 64 row-major samples."""
    x, u = np.arange(8)[:, None], np.arange(8)[None]
    basis = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(0.125), 0.5)
    return np.einsum("yv,xu->vuyx", basis, basis).reshape(64, 64)[_zigzag()].astype(np.float32)


INVERSE = _inverse()


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def huffman(kind: int, symbols: list[int], length: int) -> bytes:
    """A table in which all symbols have codes of one length, from 0 upwards."""
    counts = bytearray(16)
    counts[length - 1] = len(symbols)
    return segment(0xC4, bytes([kind << 4]) + bytes(counts) + bytes(symbols))


def scan(components: list[int], first: int, last: int, high: int, low: int, bits: np.ndarray | bytes) -> bytes:
    """The bits of a scan one by one, or as bytes."""
    head = bytes([len(components)]) + b"".join(bytes([c, 0]) for c in components) + bytes([first, last, high << 4 | low])
    if not isinstance(bits, bytes):
        bits = np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])).tobytes()
    return segment(0xDA, head) + bits.replace(b"\xff", b"\xff\x00")


def write_jpeg(payload: bytes) -> bytes:
    """A progressive JPEG whose coefficients are the payload, a positive multiple of 64 bytes."""
    if not payload or len(payload) % 64:
        raise ValueError("the payload must be a positive multiple of 64 bytes")
    n = -(-len(payload) // 63)
    units = -(-n // 6)
    columns = int(np.ceil(np.sqrt(units)))
    rows = -(-units // columns)
    units = columns * rows
    coefficients = np.zeros(6 * units * 63, np.uint8)
    coefficients[: len(payload)] = np.frombuffer(payload, np.uint8)
    out = [b"\xff\xd8", segment(0xFE, str(len(payload)).encode()), segment(0xDB, b"\0" + b"\1" * 64)]
    out.append(segment(0xC2, struct.pack(">BHHB", 8, 16 * rows, 16 * columns, 3) + b"".join(bytes([c, h << 4 | v, 0]) for c, h, v in COMPONENTS)))
    flat = np.zeros(6 * units, np.uint8)
    out += [huffman(0, [0], 1), scan([1, 2, 3], 0, 0, 0, 1, flat), scan([1, 2, 3], 0, 0, 1, 0, flat)]
    # a code of one bit, 0, and the 7 upper bits of the coefficient: the inverse ones of a negative
    upper = ((coefficients & 127 | 128) >> 1) ^ ((coefficients >> 7) - np.uint8(1) & np.uint8(127))
    out.append(huffman(1, [7], 1))
    parts = [slice(0, 252 * units), slice(252 * units, 315 * units), slice(315 * units, 378 * units)]
    out += [scan([c], 1, 63, 0, 1, upper[part].tobytes()) for (c, _, _), part in zip(COMPONENTS, parts, strict=True)]
    for (c, _, _), part in zip(COMPONENTS, parts, strict=True):
        lowest = coefficients[part] & 1
        blocks = len(lowest) // 63
        runs = [min(LONGEST_RUN, blocks - lo) for lo in range(0, blocks, LONGEST_RUN)]
        symbols = sorted({(run.bit_length() - 1) << 4 for run in runs})
        bits, lo = [], 0
        for run in runs:
            extra = run.bit_length() - 1
            code = symbols.index(extra << 4)
            head = [code >> 1, code & 1, *((run >> k & 1) for k in range(extra - 1, -1, -1))]
            bits += [np.array(head, np.uint8), lowest[63 * lo : 63 * (lo + run)]]
            lo += run
        out += [huffman(1, symbols, 2), scan([c], 1, 63, 1, 0, np.concatenate(bits))]
    return b"".join([*out, b"\xff\xd9"])


class Table:
    def __init__(self, counts: bytes, symbols: bytes):
        self.codes: dict[tuple[int, int], int] = {}
        code = k = 0
        for length, count in enumerate(counts, 1):
            for _ in range(count):
                self.codes[length, code] = symbols[k]
                code, k = code + 1, k + 1
            code <<= 1
        self.only = (*next(iter(self.codes.items())),) if len(self.codes) == 1 else None


class Bits:
    def __init__(self, data: bytes):
        self.octets = np.frombuffer(data, np.uint8)
        self.at = 0

    @cached_property
    def bits(self) -> np.ndarray:
        return np.unpackbits(self.octets)

    def take_octets(self, n: int) -> np.ndarray:
        """The same as octets, at the start of a scan."""
        self.at += 8 * n
        if n > len(self.octets):
            raise ValueError("the scan ends early")
        return self.octets[:n]

    def take(self, n: int) -> np.ndarray:
        self.at += n
        if self.at > len(self.bits):
            raise ValueError("the scan ends early")
        return self.bits[self.at - n : self.at]

    def number(self, n: int) -> int:
        value = 0
        for bit in self.take(n).tolist():
            value = value << 1 | bit
        return value

    def symbol(self, table: Table) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | int(self.take(1)[0])
            found = table.codes.get((length, code))
            if found is not None:
                return found
        raise ValueError("no such code")

    def signed(self, n: int) -> int:
        value = self.number(n)
        return value if not n or value >> (n - 1) else value - (1 << n) + 1


def dc_first(bits: Bits, tables: list[Table], arrays: list[np.ndarray], orders: list[np.ndarray], low: int) -> None:
    if all(t.only and t.only[0][0] == 1 and t.only[1] == 0 for t in tables):
        bits.take(sum(x.size for x in orders))  # every difference is 0
        for array, order in zip(arrays, orders, strict=True):
            array[order.reshape(-1), 0] = 0
        return
    before = [0] * len(arrays)
    for unit in range(len(orders[0])):
        for c, (table, array, order) in enumerate(zip(tables, arrays, orders, strict=True)):
            for block in order[unit].tolist():
                before[c] += bits.signed(bits.symbol(table))
                array[block, 0] = before[c] << low


def dc_refine(bits: Bits, arrays: list[np.ndarray], orders: list[np.ndarray], low: int) -> None:
    got = bits.take(sum(x.size for x in orders)).reshape(len(orders[0]), -1)
    at = 0
    for array, order in zip(arrays, orders, strict=True):
        array[order.reshape(-1), 0] |= got[:, at : at + order.shape[1]].reshape(-1).astype(np.int32) << low
        at += order.shape[1]


def ac_first(bits: Bits, table: Table, array: np.ndarray, first: int, last: int, low: int) -> None:
    if table.only and table.only[0][0] == 1 and 0 < table.only[1] < 16:  # every coefficient has this size
        size = table.only[1]
        n = array.shape[0] * (last - first + 1)
        if size == 7 and table.only[0][1] == 0:
            value = bits.take_octets(n).astype(np.int32)
        else:
            octets = np.packbits(bits.take(n * (1 + size)).reshape(-1, 1 + size)[:, 1:], axis=1)
            value = (octets[:, 0].astype(np.int32) << 8 | (octets[:, 1] if size > 8 else 0)) >> (16 - size)
        value -= np.where(value >> (size - 1), 0, (1 << size) - 1)
        array[:, first : last + 1] = (value << low).reshape(len(array), -1)
        return
    run = 0
    for block in array:
        if run:
            run -= 1
            continue
        k = first
        while k <= last:
            zeros, size = divmod(bits.symbol(table), 16)
            if size:
                k += zeros
                block[k] = bits.signed(size) * (1 << low)
                k += 1
            elif zeros == 15:
                k += 16
            else:
                run = (1 << zeros) - 1 + bits.number(zeros)
                break


def ac_refine(bits: Bits, table: Table, array: np.ndarray, first: int, last: int, low: int) -> None:
    step = 1 << low

    def correct(part: np.ndarray) -> None:
        """One bit for each coefficient that isn't zero."""
        if part.all():
            part += np.sign(part) * bits.take(part.size).reshape(part.shape) * np.int32(step)
            return
        where = part != 0
        got = bits.take(int(where.sum())).astype(np.int32) * step
        part[where] += np.where(part[where] > 0, got, -got)

    b = 0
    while b < len(array):
        block, k, run = array[b], first, 0
        while k <= last:
            zeros, size = divmod(bits.symbol(table), 16)
            new = 0
            if size:
                new = step if bits.number(1) else -step
            elif zeros < 15:
                run = (1 << zeros) + bits.number(zeros)
                break
            while k <= last:
                if block[k]:
                    correct(block[k : k + 1])
                elif zeros:
                    zeros -= 1
                else:
                    if new:
                        block[k] = new
                    break
                k += 1
            k += 1
        if run:
            correct(block[k : last + 1])
            correct(array[b + 1 : b + run, first : last + 1])
        b += max(1, run)


def read_coefficients(data: bytes) -> tuple[int, int, list[dict], bytes]:
    """Height, width, the components with their coefficient arrays (zigzag), and the first comment."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at, comment, tables, quant, parts = 2, b"", {}, {}, []
    height = width = interval = 0
    while True:
        found = MARKER.search(data, at)
        if not found:
            raise ValueError("the file ends early")
        marker, at = data[found.end() - 1], found.end()
        if marker == 0xD9:
            return height, width, parts, comment
        size = struct.unpack_from(">H", data, at)[0]
        body = data[at + 2 : at + size]
        at += size
        if marker == 0xFE and not comment:
            comment = body
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.float32)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = Table(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xC2:
            depth, height, width, n = struct.unpack_from(">BHHB", body)
            if depth != 8 or n not in (1, 3) or len(body) < 6 + 3 * n:
                raise ValueError("only 8 bits and 1 or 3 components are read")
            if height * width > MOST_PIXELS:
                raise ValueError("the image is too large")
            parts = [{"id": body[6 + 3 * k], "h": body[7 + 3 * k] >> 4, "v": body[7 + 3 * k] & 15, "q": body[8 + 3 * k]} for k in range(n)]
            if n == 1:
                parts[0] |= {"h": 1, "v": 1}
            if not all(p["h"] and p["v"] for p in parts):
                raise ValueError("a component of no size")
            most_h, most_v = max(p["h"] for p in parts), max(p["v"] for p in parts)
            columns, rows = -(-width // (8 * most_h)), -(-height // (8 * most_v))
            for p in parts:
                p |= {"columns": columns * p["h"], "rows": rows * p["v"], "own_columns": -(-width * p["h"] // (8 * most_h)), "own_rows": -(-height * p["v"] // (8 * most_v))}
                p["array"] = np.zeros((p["columns"] * p["rows"], 64), np.int32)
                unit = np.arange(columns * rows)
                r, c = unit // columns, unit % columns
                p["units"] = np.stack([(r * p["v"] + y) * p["columns"] + c * p["h"] + x for y in range(p["v"]) for x in range(p["h"])], axis=1)
                own = np.arange(p["own_columns"] * p["own_rows"])
                p["blocks"] = own // p["own_columns"] * p["columns"] + own % p["own_columns"]
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif 0xC0 <= marker <= 0xCF:
            raise ValueError("only progressive Huffman files are read")
        elif marker == 0xDA:
            chosen = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
            first, last, how = body[1 + 2 * body[0] :][:3]
            own = [p for p in parts if p["id"] in chosen]
            after = MARKER.search(data, at)
            end = after.start() if after else len(data)
            for p in own:
                p["quant"] = quant[p["q"]]
            orders = [p["units"] for p in own] if len(own) > 1 else [p["blocks"][:, None] for p in own]
            if not own or not len(orders[0]):
                raise ValueError("a scan of nothing")
            # each restart interval is a stream of bits of its own
            step = interval or len(orders[0])
            streams = RESTART.split(data[at:end]) if interval else [data[at:end]]
            at = end
            if len(streams) < -(-len(orders[0]) // step):
                raise ValueError("the scan ends early")
            p = own[0]
            whole = len(p["blocks"]) == len(p["array"])
            array = p["array"] if whole or first == 0 else p["array"][p["blocks"]]
            for lo, stream in zip(range(0, len(orders[0]), step), streams, strict=False):
                bits = Bits(stream.replace(b"\xff\x00", b"\xff"))
                units = [order[lo : lo + step] for order in orders]
                if first:
                    (ac_refine if how >> 4 else ac_first)(bits, tables[16 + (chosen[p["id"]] & 15)], array[lo : lo + step], first, last, how & 15)
                elif how >> 4:
                    dc_refine(bits, [x["array"] for x in own], units, how & 15)
                else:
                    dc_first(bits, [tables[chosen[x["id"]] >> 4] for x in own], [x["array"] for x in own], units, how & 15)
            if first and not whole:
                p["array"][p["blocks"]] = array


def to_rgb(height: int, width: int, parts: list[dict]) -> np.ndarray:
    """height x width x 3, 8 bits: inverse transform, chroma repeated to full resolution, colours as in JFIF."""
    most_h, most_v = max(p["h"] for p in parts), max(p["v"] for p in parts)
    planes = []
    for p in parts:
        samples = (p["array"].astype(np.float32) * p["quant"]) @ INVERSE + 128
        plane = samples.reshape(p["rows"], p["columns"], 8, 8).swapaxes(1, 2).reshape(8 * p["rows"], 8 * p["columns"])
        plane = np.clip(np.rint(plane), 0, 255)
        planes.append(plane.repeat(most_v // p["v"], axis=0).repeat(most_h // p["h"], axis=1)[:height, :width])
    if len(planes) == 1:
        planes = planes * 3
    else:
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        planes = [y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb]
    return np.clip(np.rint(np.stack(planes, axis=-1)), 0, 255).astype(np.uint8)


def payload_of(parts: list[dict], comment: bytes) -> bytes:
    """What write_jpeg stored."""
    value = np.concatenate([p["array"][:, 1:] for p in parts])
    out = (np.abs(value) & 127 | (value > 0) * 128).astype(np.uint8)
    return out.reshape(-1)[: int(comment)].tobytes()


def feature(rgb: np.ndarray) -> str:
    """Mean of each channel in hundredths, and for each cell of an 8 by 8 grid whether its green is above the mean."""
    height, width, _ = rgb.shape
    sums = np.add.reduceat(np.add.reduceat(rgb[..., 1].astype(np.int64), np.arange(8) * height // 8, axis=0), np.arange(8) * width // 8, axis=1)
    mean = rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64) * 100 // (height * width)
    cells = np.packbits(sums * 64 > sums.sum()).tobytes().hex()
    return ":".join([*map(str, mean.tolist()), cells])


def pad(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % 64 if raw else 64)


#: Rows that a task hands on at a time: images of long texts are large.
HANDED_ON = 32


def write_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text as a progressive JPEG.

    Null and empty texts become 64 bytes of 0. Repeated rows give repeated results; other columns are ignored.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids = frame["doc_id"].astype("Int64").to_numpy(object)
            for lo in range(0, len(frame), HANDED_ON):
                padded = [pad(x) for x in frame["text"].iloc[lo : lo + HANDED_ON]]
                yield pd.DataFrame({"doc_id": ids[lo : lo + HANDED_ON], "n_bytes": [n for n, _ in padded], "media": [write_jpeg(x) for _, x in padded]})

    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInPandas(run, "doc_id long, n_bytes long, media binary")


def read_image(data: bytes | None) -> tuple:
    """payload, media_bytes, media_sha256, height, width, feature, rgb and error of a file; its values are null where it
    is null or can't be read, and the payload is null where the file has no comment with its length."""
    if data is None:
        return None, None, None, None, None, None, None, "no file"
    size, name = len(data), hashlib.sha256(data).hexdigest()
    try:
        height, width, parts, comment = read_coefficients(data)
        if not height or not width or any("quant" not in p for p in parts):
            raise ValueError("no whole image")
        rgb = to_rgb(height, width, parts)
        payload = payload_of(parts, comment) if comment.isdigit() else None
    except (ValueError, LookupError, TypeError, MemoryError, struct.error) as broken:
        return None, size, name, None, None, None, None, f"{type(broken).__name__}: {broken}"
    return payload, size, name, height, width, feature(rgb), rgb.tobytes(), None


def read_media(media: DataFrame) -> DataFrame:
    """doc_id and n_bytes of `media`, and payload, media_bytes, media_sha256, height, width, feature, rgb (the tensor:
    height x width x 3 bytes, row-major) and error for each row.

    A file that is null or that the reader can't take has null results and an error, the others go on. Repeated rows give
    repeated results; other columns are ignored; no rows give none.
    """
    names = ["payload", "media_bytes", "media_sha256", "height", "width", "feature", "rgb", "error"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lo in range(0, len(frame), HANDED_ON):
                part = frame.iloc[lo : lo + HANDED_ON]
                found = pd.DataFrame([read_image(x) for x in part["media"]], columns=names, dtype=object)
                yield pd.concat([part[["doc_id", "n_bytes"]].astype("Int64").reset_index(drop=True), found], axis=1)

    rows = small_batches(media).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("n_bytes").cast("long").alias("n_bytes"), "media")
    return rows.mapInPandas(run, "doc_id long, n_bytes long, payload binary, media_bytes long, media_sha256 string, height int, width int, feature string, rgb binary, error string")


def digest(read: DataFrame) -> DataFrame:
    """What read_media gives, with digests in place of payload and tensor; of null ones they are null."""
    payload, rgb = F.col("payload"), F.col("rgb")
    tail = F.expr("substring(payload, -64, 64)")
    return read.select("doc_id", "n_bytes", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"), "media_bytes", "media_sha256", "feature", "height", "width", F.octet_length(rgb).cast("long").alias("rgb_bytes"), F.sha2(rgb, 256).alias("rgb_sha256"), "error")

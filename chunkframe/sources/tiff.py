"""TIFF files as volumes: pages of one file, or of many in natural order, are the places of the first axes.

Directories are walked by ranged reads (both byte orders, 32- and 64-bit offsets), so a task reads of a file the directories and
the strips or tiles of the pages it is due. Strips and tiles may be raw, PackBits, LZW or deflate, with horizontal
differences undone. The axes in front of y and x come from the description of the first page (ImageJ's counts, OME-XML's
sizes and order); without one all pages are z. What cannot be is a ``ValueError``.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metadata import natural_key
from . import zarr

# Tags, the sizes and letters of value types, and what a sample's format is called.
TAGS = {256: "width", 257: "height", 258: "bits", 259: "compression", 262: "photometric", 270: "description", 273: "offsets", 277: "samples", 278: "rows", 279: "counts", 284: "planar", 317: "predictor", 322: "tile_width", 323: "tile_height", 324: "offsets", 325: "counts", 339: "format"}
TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, None), 6: (1, "b"), 7: (1, "s"), 8: (2, "h"), 9: (4, "i"), 10: (8, None), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q"), 17: (8, "q"), 18: (8, "Q")}
KINDS = {1: "u", 2: "i", 3: "f"}
RAW, LZW, DEFLATE, PACKBITS = (1,), (5,), (8, 32946), (32773,)
#: Directories of one file at most (a loop of them has no end), and bytes of values of one tag.
MOST_PAGES, MOST_BYTES = 1 << 20, 1 << 28
Read = Callable[[int, int], bytes | None]


@dataclass
class Page:
    width: int = 0
    height: int = 0
    bits: int = 1
    samples: int = 1
    compression: int = 1
    predictor: int = 1
    format: int = 1
    planar: int = 1
    rows: int = 0
    tile: tuple[int, int] | None = None
    description: str = ""
    offsets: list[int] = field(default_factory=list)
    counts: list[int] = field(default_factory=list)
    order: str = "<"

    @property
    def dtype(self) -> str:
        if self.format not in KINDS or self.bits not in (8, 16, 32, 64) or (self.format == 3 and self.bits < 32):
            raise ValueError(f"samples of {self.bits} bits, format {self.format}")
        return f"{self.order}{KINDS[self.format]}{self.bits // 8}"


def _exactly(read: Read, at: int, n: int) -> bytes:
    data = read(at, n) if n and at >= 0 else b""
    if data is None or len(data) != n:
        raise ValueError("a file is shorter than its directory tells")
    return data


def pages(read: Read) -> Iterator[Page]:
    """The directories of a file, one after the other."""
    head = _exactly(read, 0, 8)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack(f"{order}H", head[2:4])[0] if order else 0
    if version not in (42, 43):
        raise ValueError("no TIFF file")
    big = version == 43
    at = struct.unpack(f"{order}Q", _exactly(read, 8, 8))[0] if big else struct.unpack(f"{order}I", head[4:8])[0]
    count_size, entry_size, value_size, link = (8, 20, 8, "Q") if big else (2, 12, 4, "I")
    seen: set[int] = set()
    while at:
        if at in seen or len(seen) >= MOST_PAGES:
            raise ValueError("directories that go round")
        seen.add(at)
        n = struct.unpack(f"{order}{'Q' if big else 'H'}", _exactly(read, at, count_size))[0]
        if n > 4096:
            raise ValueError(f"a directory of {n} tags")
        body = _exactly(read, at + count_size, n * entry_size + value_size)
        page = Page(order=order)
        for i in range(n):
            tag, kind = struct.unpack_from(f"{order}HH", body, i * entry_size)
            count = struct.unpack_from(f"{order}{link}", body, i * entry_size + 4)[0]
            if tag in TAGS and kind in TYPES and TYPES[kind][1]:
                size, letter = TYPES[kind]
                if size * count > MOST_BYTES:
                    raise ValueError(f"a tag of {size * count} bytes")
                place = i * entry_size + 4 + value_size
                inside = size * count <= value_size
                data = body[place : place + size * count] if inside else _exactly(read, struct.unpack_from(f"{order}{link}", body, place)[0], size * count)
                _set(page, TAGS[tag], data.split(b"\0")[0].decode("utf-8", "replace") if letter == "s" else list(struct.unpack(f"{order}{count}{letter}", data)))
        yield page
        at = struct.unpack_from(f"{order}{link}", body, n * entry_size)[0]


def _set(page: Page, name: str, value) -> None:
    if name in ("offsets", "counts"):
        setattr(page, name, value if isinstance(value, list) else [])
    elif name == "description":
        page.description = value if isinstance(value, str) else ""
    elif isinstance(value, list) and value:
        if name in ("bits", "format") and len(set(value)) > 1:
            raise ValueError(f"samples of different {name}")
        if name in ("tile_width", "tile_height"):
            wide, high = page.tile or (0, 0)
            page.tile = (value[0], high) if name == "tile_width" else (wide, value[0])
        elif hasattr(page, name):
            setattr(page, name, value[0])


def unpack_bits(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n, at = data[at], at + 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out[:size])


def unpack_lzw(data: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, high bits first; 256 clears the table, 257 ends."""
    table: list[bytes] = [bytes([i]) for i in range(256)] + [b"", b""]
    out, width, bits, held, last = bytearray(), 9, 0, 0, b""
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == 257 or len(out) >= size:
            break
        if code == 256:
            del table[258:]
            width, last = 9, b""
            continue
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last:
            entry = last + last[:1]
        else:
            raise ValueError("a code that is in no table")
        out += entry
        if last and len(table) < 4096:
            table.append(last + entry[:1])
        last, width = entry, min(max(9, (len(table) + 1).bit_length()), 12)
    return bytes(out[:size])


def _decoded(page: Page, data: bytes, size: int) -> bytes:
    if page.compression in RAW:
        out = data[:size]
    elif page.compression in DEFLATE:
        try:
            out = zlib.decompressobj().decompress(data, size)
        except zlib.error as e:
            raise ValueError(f"a deflate strip: {e}") from None
    elif page.compression in LZW:
        out = unpack_lzw(data, size)
    elif page.compression in PACKBITS:
        out = unpack_bits(data, size)
    else:
        raise ValueError(f"compression {page.compression}")
    if len(out) != size:
        raise ValueError("a strip or tile that is cut short")
    return out


def read_page(read: Read, page: Page) -> np.ndarray:
    """The samples of a page: (height, width), or (sample, height, width) where there are several."""
    kind, apart = np.dtype(page.dtype), page.planar == 2 and page.samples > 1
    if page.predictor not in (1, 2) or (page.predictor == 2 and kind.kind == "f") or not (page.width and page.height and page.samples):
        raise ValueError(f"predictor {page.predictor}, {page.width} by {page.height}")
    wide, high = page.tile or (page.width, min(page.rows or page.height, page.height))
    if not wide or not high:
        raise ValueError("tiles or strips of no size")
    across, down, deep = -(-page.width // wide), -(-page.height // high), page.samples if apart else 1
    inner = 1 if apart else page.samples
    if len(page.offsets) < across * down * deep or len(page.counts) < across * down * deep:
        raise ValueError("a page without all its strips or tiles")
    out = np.zeros((page.height, page.width, page.samples), kind.newbyteorder("="))
    for n in range(across * down * deep):
        sample, row, column = n // (across * down), n // across % down, n % across
        tall = high if page.tile else min(high, page.height - row * high)
        data = _decoded(page, _exactly(read, page.offsets[n], page.counts[n]), tall * wide * inner * kind.itemsize)
        block = np.frombuffer(data, kind).reshape(tall, wide, inner)
        if page.predictor == 2:
            block = np.cumsum(block, axis=1, dtype=kind.newbyteorder("="))
        y, x = row * high, column * wide
        part = block[: page.height - y, : page.width - x]
        out[y : y + part.shape[0], x : x + part.shape[1], sample if apart else slice(None)] = part[:, :, 0] if apart else part
    return out[:, :, 0] if page.samples == 1 else out.transpose(2, 0, 1)


def axes_of(description: str, n: int) -> tuple[str, list[int], dict[str, float]]:
    """The axes that ``n`` pages are the places of, their extents, and voxel sizes in nanometres by axis, where the description tells them."""
    sizes: dict[str, float] = {}
    if "<OME" in description:
        tag = re.search(r"<Pixels\b[^>]*>", description)
        told = dict(re.findall(r'(\w+)\s*=\s*"([^"]*)"', tag[0])) if tag else {}
        order = [a for a in told.get("DimensionOrder", "XYZCT")[::-1].lower() if a in "tcz"]
        extents = [int(told.get(f"Size{a.upper()}", 1)) for a in order]
        unit = {"nm": 1.0, "µm": 1e3, "mm": 1e6}
        for a in "XYZ":
            if f"PhysicalSize{a}" in told:
                sizes[a.lower()] = float(told[f"PhysicalSize{a}"]) * unit.get(told.get(f"PhysicalSize{a}Unit", "µm"), 1e3)
        kept = [(a, e) for a, e in zip(order, extents, strict=True) if e > 1] or [("z", n)]
    else:
        told = dict(re.findall(r"^(\w+)=(\S+)", description, re.M))
        number = lambda k: int(told.get(k, "1")) if re.fullmatch(r"\d+", told.get(k, "1")) else 1
        kept = [(a, number(k)) for a, k in (("t", "frames"), ("z", "slices"), ("c", "channels")) if number(k) > 1] if description.startswith("ImageJ") else []
        if "spacing" in told and description.startswith("ImageJ"):
            try:
                sizes["z"] = float(told["spacing"]) * {"nm": 1.0, "mm": 1e6}.get(told.get("unit", "um"), 1e3)
            except ValueError:
                pass
    if math.prod(e for _, e in kept) != n or not kept:
        kept = [("z", n)]
    return "".join(a for a, _ in kept), [e for _, e in kept], sizes


def files_of(spark: SparkSession, path: str) -> list[tuple[str, int, dict]]:
    """(file, pages, first page) of a file or of all TIFF files of a folder, in natural order; the files are looked at by tasks.

    The driver holds one short row for each file, as Spark's own listing does.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.[tT][iI][fF]*").load(path).select("path")
    names = listed.select("path").orderBy(natural_key(F.element_at(F.split("path", "/"), -1)), "path")
    schema = "path string, pages long, width long, height long, samples long, dtype string, description string"

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name in b.column(0).to_pylist():
                found = list(pages(lambda at, n, name=name: zarr.fetch_range(name, at, n)))
                if not found:
                    raise ValueError(f"{name} has no page")
                first = found[0]
                if any((p.width, p.height, p.samples, p.dtype) != (first.width, first.height, first.samples, first.dtype) for p in found):
                    raise ValueError(f"{name} has pages of different sizes or types")
                rows.append((name, len(found), first.width, first.height, first.samples, first.dtype, first.description))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=schema_names) if rows else None

    schema_names = [c.split()[0] for c in schema.split(", ")]

    def looked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from (b for b in look(batches) if b is not None)

    told = {r["path"]: r.asDict() for r in listed.mapInArrow(looked, schema).collect()}
    return [(r["path"], told[r["path"]]["pages"], told[r["path"]]) for r in names.collect()]


def describe(spark: SparkSession, path: str, axes: str | None = None) -> dict:
    """shape, axes, dtype and voxel sizes of a file's or folder's volume, and where its pages are."""
    files = files_of(spark, path)
    if not files:
        raise FileNotFoundError(f"no TIFF file at {path}")
    first = files[0][2]
    for _, _, f in files:
        if (f["width"], f["height"], f["samples"], f["dtype"]) != (first["width"], first["height"], first["samples"], first["dtype"]):
            raise ValueError("files of different sizes or types")
    per, total = files[0][1], sum(n for _, n, _ in files)
    inner, extents, sizes = axes_of(first["description"], per)
    if len(files) > 1:  # the files are z; what a file's own pages are stays inside
        same = all(n == per for _, n, _ in files)
        inner, extents = ("z", [total]) if per == 1 or not same or "z" in inner else ("z" + inner, [len(files), *extents])
    if first["samples"] > 1:
        inner, extents = inner + ("s" if "c" in inner else "c"), [*extents, first["samples"]]
    names = list(axes) if axes else [*inner, "y", "x"]
    shape = [*extents, first["height"], first["width"]]
    if len(names) != len(shape):
        raise ValueError(f"axes {''.join(names)} for {shape}")
    starts = np.cumsum([0, *(n for _, n, _ in files)])[:-1].tolist()
    return {"shape": shape, "axes": names, "dtype": np.dtype(first["dtype"]).newbyteorder("=").name, "voxel": sizes, "samples": first["samples"], "files": [(p, n, s) for (p, n, _), s in zip(files, starts, strict=True)], "description": first["description"]}


def read_chunks(spark: SparkSession, path: str, axes: str | None = None, run: int = 64) -> DataFrame:
    """(origin, extent, payload, dtype): a chunk for each page; ``run`` pages of a file make one input partition."""
    info = describe(spark, path, axes)
    places, many = info["shape"][:-2], info["samples"] > 1
    front = places[:-1] if many else places
    kind = np.dtype(info["dtype"]).newbyteorder("<").str
    jobs = [(p, first, min(first + run, n), start + first) for p, n, start in info["files"] for first in range(0, n, run)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for name, first, stop, number in zip(*(c.to_pylist() for c in b.columns), strict=True):
                read = lambda at, n, name=name: zarr.fetch_range(name, at, n)
                for i, page in enumerate(pages(read)):
                    if i >= stop:
                        break
                    if i >= first:
                        block = np.ascontiguousarray(read_page(read, page)).astype(kind)
                        at = [int(v) for v in np.unravel_index(number + i - first, front)]
                        shape = [1] * len(front) + list(block.shape)
                        yield at + [0] * block.ndim, shape, block.tobytes(), kind

    table = spark.createDataFrame(jobs, "path string, first long, stop long, number long").repartition(max(1, len(jobs)))
    return table.mapInArrow(lambda batches: zarr.chunk_batches(rows(batches)), zarr.CHUNK_SCHEMA)


def page_file(block: np.ndarray, description: str = "", rows: int = 64) -> bytes:
    """A file of one page (height, width): deflate strips with differences along the rows."""
    kind = block.dtype.newbyteorder("<")
    height, width = block.shape
    signed = np.ascontiguousarray(block).astype(kind)
    if kind.kind != "f":
        signed = np.diff(signed, axis=1, prepend=np.zeros((height, 1), kind)).astype(kind)
    strips = [zlib.compress(signed[y : y + rows].tobytes(), 6) for y in range(0, height, rows)]
    text = description.encode() + b"\0"
    n = len(strips)
    fields = [(256, 4, [width]), (257, 4, [height]), (258, 3, [8 * kind.itemsize]), (259, 3, [8]), (262, 3, [1]), (270, 2, text), (273, 4, None), (277, 3, [1]), (278, 4, [rows]), (279, 4, [len(s) for s in strips]), (317, 3, [1 if kind.kind == "f" else 2]), (339, 3, [{"u": 1, "i": 2, "f": 3}[kind.kind]])]
    first = 8 + 2 + 12 * len(fields) + 4
    starts = np.cumsum([first, *(len(s) for s in strips)])[:-1].tolist()
    tail, body = bytearray(), b""
    tail_at = first + sum(map(len, strips))
    for tag, code, values in fields:
        values = starts if values is None else values
        data = values if isinstance(values, bytes) else struct.pack(f"<{len(values)}{TYPES[code][1]}", *values)
        count = len(data) // TYPES[code][0]
        if len(data) > 4:
            place = struct.pack("<I", tail_at + len(tail))
            tail += data + b"\0" * (len(data) % 2)
        else:
            place = data.ljust(4, b"\0")
        body += struct.pack("<HHI", tag, code, count) + place
    assert n == len(starts)
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(fields)) + body + struct.pack("<I", 0) + b"".join(strips) + bytes(tail)


def write_pages(chunks: DataFrame, folder: str, name: str = "page_{}.tif") -> int:
    """Every chunk (one place of the first axis, whole planes) as a file of its own, named by that place; how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for b in batches:
            for i in range(b.num_rows):
                origin, extent, payload, kind = (c[i].as_py() for c in b.columns)
                zarr.put(f"{folder}/{name.format(origin[0])}", page_file(np.frombuffer(payload, kind).reshape(extent[1:])))
                n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return chunks.select("origin", "extent", "payload", "dtype").mapInArrow(run, "n long").agg(F.sum("n")).first()[0]

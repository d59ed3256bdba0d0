"""Zarr v2 and v3 arrays (raw, gzip, zlib, zstd or blosc chunks, sharded or not), N5 blocks and precomputed volumes, by Spark tasks.

Metadata is small JSON read on the driver through Hadoop's file systems; chunks are files, listed and
read by Spark, decoded in tasks. Of a shard a task reads the index and then only the chunks it is due, by their place in
the file, so a shard can be read by many tasks; and a shard is written as its chunks come in, one held at a time.
Chunk tables carry their element type, so floats and 64-bit integers stay what they
are; chunks that were never stored are made of the fill value. Writing goes through Arrow's file systems, so a path can
be a local folder all tasks share or an address (s3, gs, hdfs).
"""

from __future__ import annotations

import gzip
import json
import math
import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blosc
from .checksums import crc32c

# Element types by their names in the formats; what marks a chunk that a shard does not hold.
DTYPES = {"uint8": "u1", "uint16": "u2", "uint32": "u4", "uint64": "u8", "int8": "i1", "int16": "i2", "int32": "i4", "int64": "i8", "float32": "f4", "float64": "f8"}
ABSENT = 2**64 - 1
CHUNK_SCHEMA = "origin array<long>, extent array<long>, payload binary, dtype string"
#: Decoded bytes that one task is given, and that one batch of rows holds at least before it is passed on.
TASK_BYTES, BATCH_BYTES = 128 << 20, 8 << 20


def read_json(spark: SparkSession, path: str) -> dict | None:
    """A small file of any store; Spark's own readers skip names that start with a dot."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def describe(spark: SparkSession, path: str) -> dict:
    """format, shape, chunk, dtype, codec, fill and attributes of an array."""
    return described(path, lambda at: read_json(spark, at))


def described(path: str, read: Callable[[str], dict | None]) -> dict:
    """``describe`` with any way to ``read`` a JSON file (None: there is none)."""
    if m := read(f"{path}/zarr.json"):
        outer, inner = _codecs(m["codecs"]), None
        if "shard" in outer:
            inner = _codecs(outer["shard"]["codecs"])
        kind = DTYPES[m["data_type"]]
        key = m.get("chunk_key_encoding", {"name": "default"})
        separator = key.get("configuration", {}).get("separator", "/" if key["name"] == "default" else ".")
        return {"format": "zarr3", "shape": m["shape"], "chunk": outer["shard"]["chunk_shape"] if inner else m["chunk_grid"]["configuration"]["chunk_shape"], "shard": m["chunk_grid"]["configuration"]["chunk_shape"] if inner else None, "dtype": (inner or outer)["endian"] + kind, "fill": _fill(m.get("fill_value"), kind), "codecs": inner or outer, "index": outer.get("shard"), "prefix": "c" if key["name"] == "default" else "", "separator": separator, "names": m.get("dimension_names"), "attributes": m.get("attributes", {})}
    if m := read(f"{path}/.zarray"):
        codec = (m.get("compressor") or {}).get("id")
        if codec not in (None, "gzip", "zlib", "zstd", "blosc") or m.get("filters"):
            raise ValueError(f"compressor {codec}")
        return {"format": "zarr2", "shape": m["shape"], "chunk": m["chunks"], "dtype": m["dtype"], "fill": _fill(m.get("fill_value"), m["dtype"][1:]), "codecs": {"transpose": None, "order": m.get("order", "C"), "steps": [codec] if codec else []}, "prefix": "", "separator": m.get("dimension_separator", "."), "names": None, "attributes": read(f"{path}/.zattrs") or {}}
    if m := read(f"{path}/attributes.json"):
        codec = m.get("compression", {}).get("type", "raw")
        if codec not in ("raw", "gzip", "blosc"):
            raise ValueError(f"compression {codec}")
        return {"format": "n5", "shape": m["dimensions"], "chunk": m["blockSize"], "dtype": ">" + DTYPES[m["dataType"]], "fill": 0, "codecs": {"transpose": None, "order": "F", "steps": [] if codec == "raw" else [codec]}, "prefix": "", "separator": "/", "names": m.get("axes"), "attributes": m}
    from . import precomputed  # which reads through this module

    if m := read(f"{path}/info"):
        return precomputed.describe_scale(m, m["scales"][0], m["scales"][0]["key"])
    root, _, key = path.rstrip("/").rpartition("/")
    for scale in ((read(f"{root}/info") or {}).get("scales") or []) if root else []:
        if scale["key"] == key:  # a scale by its own folder
            return precomputed.describe_scale(read(f"{root}/info"), scale, "")
    raise FileNotFoundError(f"no array at {path}")


def _fill(value, kind: str):
    """The fill value of a format's JSON: numbers, NaN and infinities by name, nothing as 0."""
    if isinstance(value, str):
        return float(value.replace("Infinity", "inf")) if kind[0] == "f" else int(value, 0)
    return value or 0


def _codecs(chain: list[dict]) -> dict:
    """transpose, order, endian and the byte steps of a chain; ``shard`` holds the inner chain, if there is one."""
    out: dict = {"transpose": None, "order": "C", "endian": "<", "steps": []}
    for c in chain:
        name, conf = c["name"], c.get("configuration", {})
        if name == "transpose":
            out["transpose"] = conf["order"]
        elif name == "bytes":
            out["endian"] = "<" if conf.get("endian", "little") == "little" else ">"
        elif name == "sharding_indexed":
            if out["transpose"] or conf.get("index_location", "end") not in ("start", "end"):
                raise ValueError(f"sharding {conf}")
            out["shard"] = conf
        elif name in ("gzip", "zstd", "blosc", "crc32c"):
            out["steps"].append(name)
        else:
            raise ValueError(f"codec {name}")
    return out


def decode_block(data: bytes, codecs: dict, dtype: str, size: list[int]) -> np.ndarray:
    """The values of one chunk, steps undone from the last."""
    for step in reversed(codecs["steps"]):
        if step == "crc32c":
            data, told = data[:-4], int.from_bytes(data[-4:], "little")
            if crc32c(data) != told:
                raise ValueError("a chunk's checksum differs")
        else:
            data = decode(data, step)
    if order := codecs["transpose"]:
        stored = np.frombuffer(data, dtype).reshape([size[i] for i in order])
        return stored.transpose(np.argsort(order))
    return np.frombuffer(data, dtype).reshape(tuple(size), order=codecs["order"])


def fetch_range(path: str, first: int, length: int) -> bytes | None:
    """``length`` bytes of a file from ``first`` on, counted from the end where negative; fewer where it is shorter, None where there is no file."""
    system, at = _file_system(path)
    try:
        with system.open_input_file(at) as f:
            return f.read_at(length, first if first >= 0 else max(f.size() + first, 0))
    except (FileNotFoundError, NotADirectoryError):
        return None


def shard_index(info: dict, read: Callable[[int, int], bytes | None]) -> list[list[int]] | None:
    """(place, length) of every chunk of a shard, by its number; None where the shard was never stored."""
    total = math.prod(s // c for s, c in zip(info["shard"], info["chunk"], strict=True))
    checked = any(c["name"] == "crc32c" for c in info["index"].get("index_codecs", []))
    size = 16 * total + 4 * checked
    head = read(0 if info["index"].get("index_location") == "start" else -size, size)
    if head is None:
        return None
    if len(head) != size or (checked and crc32c(head[:-4]) != int.from_bytes(head[-4:], "little")):
        raise ValueError("a shard index is cut short, or its checksum differs")
    return np.frombuffer(head[: 16 * total], "<u8").reshape(total, 2).tolist()


def rows_of_shard(info: dict, place: list[int], read: Callable[[int, int], bytes | None], numbers: range, fill_missing: bool = True, wanted: Callable[[list[int], list[int]], bool] | None = None) -> Iterator[tuple]:
    """(origin, extent, payload, dtype) of the chunks with these numbers in a shard; ``read`` gets ranges of its file, and only those of chunks that are ``wanted``."""
    counts = [s // c for s, c in zip(info["shard"], info["chunk"], strict=True)]
    start, entries, known = [i * s for i, s in zip(place, info["shard"], strict=True)], None, False
    for n in numbers:
        origin = [o + int(i) * c for o, i, c in zip(start, np.unravel_index(n, counts), info["chunk"], strict=True)]
        extent = [min(c, s - o) for c, s, o in zip(info["chunk"], info["shape"], origin, strict=True)]
        if min(extent) <= 0 or (wanted and not wanted(origin, extent)):
            continue
        if not known:
            entries, known = shard_index(info, read), True
        at, length = entries[n] if entries else (ABSENT, 0)
        if at != ABSENT:
            data = read(at, length)
            if data is None or len(data) != length:
                raise ValueError("a shard is shorter than its index tells")
            yield _row(info, origin, decode_block(data, info["codecs"], info["dtype"], info["chunk"]))
        elif fill_missing:
            yield _row(info, origin, None)


def _row(info: dict, origin: list[int], block: np.ndarray | None) -> tuple:
    """A chunk's row, cut at the array's edges; None: the fill value."""
    kind = "<" + info["dtype"].lstrip("<>|=")
    extent = [min(c, s - o) for c, s, o in zip(info["chunk"], info["shape"], origin, strict=True)]
    block = np.full(extent, info["fill"], kind) if block is None else block[tuple(slice(0, e) for e in extent)]
    return origin, list(block.shape), np.ascontiguousarray(block).astype(kind).tobytes(), kind


def chunk_batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of ``CHUNK_SCHEMA`` in batches that are passed on once they hold ``BATCH_BYTES``."""
    kinds = (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.string())
    names = ["origin", "extent", "payload", "dtype"]

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[2]) + 100
        if size >= BATCH_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def decode(data: bytes, codec: str | None) -> bytes:
    if codec == "gzip":
        return gzip.decompress(data)
    if codec == "zlib":
        return zlib.decompress(data)
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    if codec == "blosc":
        return blosc.decode(data)
    return data


def encode(data: bytes, codec: str | None, level: int = 5, item: int = 1) -> bytes:
    """``blosc`` frames hold zstd streams, or what follows a colon (blosc:lz4); ``item``: bytes of an element."""
    if codec == "gzip":
        return gzip.compress(data, level, mtime=0)
    if codec == "zlib":
        return zlib.compress(data, level)
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdCompressor(level=level).compress(data)
    if codec and codec.startswith("blosc"):
        return blosc.encode(data, item, codec.partition(":")[2] or "zstd", level)
    return data


def codec_json(codec: str | None, format: str, item: int, level: int = 5) -> dict | None:
    """What the metadata of a format say about a codec."""
    if codec and codec.startswith("blosc"):
        conf = {"cname": codec.partition(":")[2] or "zstd", "clevel": level, "shuffle": 1, "blocksize": 0}
        return {"zarr3": {"name": "blosc", "configuration": conf | {"typesize": item, "shuffle": "shuffle" if item > 1 else "noshuffle"}}, "zarr2": {"id": "blosc"} | conf, "n5": {"type": "blosc"} | conf}[format]
    if format == "zarr3":
        return {"name": codec, "configuration": {"level": level} | ({"checksum": False} if codec == "zstd" else {})} if codec else None
    if format == "n5":
        return {"type": codec or "raw"} | ({"level": level} if codec else {})
    return {"id": codec, "level": level} if codec else None


def _places(path: str, info: dict) -> list[int] | None:
    """The grid place that a chunk's (or shard's) file name tells; None for other files."""
    n, separator = len(info["shape"]), re.escape(info["separator"])
    if info["format"] == "precomputed":
        m = re.search(r"/(\d+)-\d+_(\d+)-\d+_(\d+)-\d+$", path)
        return [(int(v) - o) // c for v, o, c in zip((*m.groups(), 0), info["offset"], info["chunk"], strict=True)] if m else None
    front = r"(?:^|/)c/" if info["prefix"] else "/"
    m = re.search(front + rf"(\d+(?:{separator}\d+){{{n - 1}}})$", path)
    return [int(i) for i in m.group(1).split(info["separator"])] if m else None


def file_of(info: dict, place: list[int]) -> str:
    """The name of the file at a grid place, under the array's folder."""
    if info["format"] == "precomputed":
        low = [i * c for i, c in zip(place, info["chunk"], strict=True)][:3]
        high = [min(o + c, s) for o, c, s in zip(low, info["chunk"], info["shape"], strict=False)]
        return (info["prefix"] + "/" if info["prefix"] else "") + "_".join(f"{lo + o}-{hi + o}" for lo, hi, o in zip(low, high, info["offset"], strict=False))
    name = info["separator"].join(map(str, place))
    return f"{info['prefix']}{info['separator']}{name}" if info["prefix"] else name


def rows_of_file(info: dict, place: list[int], data: bytes | None) -> Iterator[tuple]:
    """(origin, extent, payload, dtype) of the chunk in the file (None: never stored) at a grid place."""
    shape, chunk = info["shape"], info["chunk"]
    start = [i * c for i, c in zip(place, chunk, strict=True)]
    if min(s - o for s, o in zip(shape, start, strict=True)) <= 0:
        return
    if info["format"] == "precomputed":
        from . import precomputed

        yield from precomputed.decode_chunk(info, place, data)
        return
    if data is None:
        yield _row(info, start, None)
        return
    size = chunk
    if info["format"] == "n5":
        mode, dims = int.from_bytes(data[:2], "big"), int.from_bytes(data[2:4], "big")
        size = [int.from_bytes(data[4 + 4 * i : 8 + 4 * i], "big") for i in range(dims)]
        data = data[4 + 4 * dims + (4 if mode == 1 else 0) :]
    yield _row(info, start, decode_block(data, info["codecs"], info["dtype"], size))


def tasks_for(info: dict, chunks: int) -> int:
    """In how many partitions so many chunks are read."""
    each = max(1, TASK_BYTES // max(1, math.prod(info["chunk"]) * np.dtype(info["dtype"]).itemsize))
    return max(1, -(-chunks // each))


def _read_shards(spark: SparkSession, path: str, info: dict, fill_missing: bool) -> DataFrame:
    """Chunks by their number over all shards; a task reads of a shard the index and the chunks it is due."""
    shards = [-(-n // s) for n, s in zip(info["shape"], info["shard"], strict=True)]
    inside = math.prod(s // c for s, c in zip(info["shard"], info["chunk"], strict=True))
    total = math.prod(shards) * inside

    def rows(numbers: Iterator[int]) -> Iterator[tuple]:
        for shard, group in groupby(numbers, lambda n: n // inside):
            place = [int(i) for i in np.unravel_index(shard, shards)]
            file = f"{path}/{file_of(info, place)}"
            due = list(group)
            yield from rows_of_shard(info, place, lambda at, n, file=file: fetch_range(file, at, n), range(due[0] % inside, due[-1] % inside + 1), fill_missing)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from chunk_batches(rows(n for b in batches for n in b.column(0).to_pylist()))

    return spark.range(0, total, 1, tasks_for(info, total)).mapInArrow(run, CHUNK_SCHEMA)


def read_chunks(spark: SparkSession, path: str, fill_missing: bool = True) -> DataFrame:
    """(origin, extent, payload, dtype): an array's chunks, cut at its edges, in their own type (little-endian).

    Chunks without a file hold the fill value; their places come from an anti-join of the grid with the names of the files.
    """
    info = describe(spark, path)
    if info.get("shard"):
        return _read_shards(spark, path, info, fill_missing)
    if info.get("sharding"):
        from . import precomputed

        return precomputed.read_shards(spark, path, info, fill_missing)
    counts = [-(-s // c) for s, c in zip(info["shape"], info["chunk"], strict=True)]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/{info['prefix']}" if info["prefix"] else path)

    def stored_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                place = _places(name, info)
                if place is not None:
                    yield from rows_of_file(info, place, data)

    stored = files.select("path", "content").mapInArrow(lambda batches: chunk_batches(stored_rows(batches)), CHUNK_SCHEMA)
    if not fill_missing:
        return stored

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_places(p, info) for p in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"n": pa.array([int(np.ravel_multi_index(p, counts)) for p in found if p is not None], pa.int64())})

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from chunk_batches(row for b in batches for n in b.column(0).to_pylist() for row in rows_of_file(info, [int(i) for i in np.unravel_index(n, counts)], None))

    have = files.select("path").mapInArrow(named, "n long")
    missing = spark.range(math.prod(counts)).withColumnRenamed("id", "n").join(have, "n", "left_anti")
    return stored.union(missing.mapInArrow(filled, CHUNK_SCHEMA))


def _file_system(path: str):
    from pyarrow import fs

    if path.startswith("file:"):  # as Spark writes such paths: not encoded, with one to three slashes
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def fetch(path: str) -> bytes | None:
    """A whole file, None where there is none."""
    system, at = _file_system(path)
    try:
        with system.open_input_stream(at, compression=None) as f:
            return f.read()
    except (FileNotFoundError, NotADirectoryError):
        return None


def put(path: str, data: bytes) -> None:
    """A whole file: beside its place and then moved where names can be taken over, else in one put."""
    system, at = _file_system(path)
    if system.type_name == "local":
        os.makedirs(os.path.dirname(at), exist_ok=True)
        with open(f"{at}.{os.getpid()}.tmp", "wb") as f:
            f.write(data)
        os.replace(f"{at}.{os.getpid()}.tmp", at)
    else:
        with system.open_output_stream(at) as f:
            f.write(data)


class ShardFile:
    """A shard that is written as its chunks come; the index and its checksum go last, then it gets its name."""

    def __init__(self, path: str, total: int):
        self.system, self.at = _file_system(path)
        self.local = self.system.type_name == "local"
        if self.local:
            os.makedirs(os.path.dirname(self.at), exist_ok=True)
        self.staged = f"{self.at}.{os.getpid()}.tmp" if self.local else self.at
        self.file, self.index, self.length = self.system.open_output_stream(self.staged), np.full((total, 2), ABSENT, "<u8"), 0

    def add(self, number: int, data: bytes) -> None:
        if self.index[number, 0] != ABSENT:
            raise ValueError(f"chunk {number} of a shard twice")
        self.index[number] = self.length, len(data)
        self.length += len(data)
        self.file.write(data)

    def close(self) -> None:
        index = self.index.tobytes()
        self.file.write(index + crc32c(index).to_bytes(4, "little"))
        self.file.close()
        if self.local:
            os.replace(self.staged, self.at)


class Layout:
    """How an array is stored: what a chunk becomes, where it goes, and the metadata."""

    def __init__(self, shape: list[int], chunk: list[int], dtype: str = "int32", format: str = "zarr3", codec: str | None = "gzip", attributes: dict | None = None, names: list[str] | None = None, shard: list[int] | None = None, fill: float = 0):
        if shard and (format != "zarr3" or any(s % c for s, c in zip(shard, chunk, strict=True))):
            raise ValueError("shards are whole chunks, and zarr3 only")
        if format not in ("zarr3", "zarr2", "n5"):
            raise ValueError(f"arrays are not written as {format}")
        self.shape, self.chunk, self.dtype, self.format, self.codec = shape, chunk, dtype, format, codec
        self.attributes, self.names, self.shard, self.fill = attributes or {}, names, shard, fill
        self.kind = (">" if format == "n5" else "<") + DTYPES[dtype]
        self.inside = [s // c for s, c in zip(shard, chunk, strict=True)] if shard else [1] * len(shape)

    def block(self, extent: list[int], payload: bytes, kind: str) -> np.ndarray:
        return np.frombuffer(payload, kind).reshape(extent).astype(self.kind)

    def packed(self, block: np.ndarray) -> bytes:
        """The bytes that are stored for a chunk, filled up to its whole size (N5: as long as it is)."""
        item = block.dtype.itemsize
        if self.format == "n5":
            head = (0).to_bytes(2, "big") + block.ndim.to_bytes(2, "big") + b"".join(int(e).to_bytes(4, "big") for e in block.shape)
            return head + encode(block.tobytes(order="F"), self.codec, item=item)
        if list(block.shape) != list(self.chunk):
            full = np.full(self.chunk, self.fill, self.kind)
            full[tuple(slice(0, e) for e in block.shape)] = block
            block = full
        return encode(block.tobytes(), self.codec, item=item)

    def file(self, origin: list[int]) -> str:
        """The file of the chunk (or its shard) at an origin, under the array's folder."""
        at = [str(int(o) // s) for o, s in zip(origin, self.shard or self.chunk, strict=True)]
        return "/".join([*(["c"] if self.format == "zarr3" else []), *at])

    def number(self, origin: list[int]) -> int:
        """The place of a chunk in its shard."""
        return int(np.ravel_multi_index([int(o) // c % n for o, c, n in zip(origin, self.chunk, self.inside, strict=True)], self.inside))

    def write(self, rows: Iterator[tuple], path: str) -> Iterator[str]:
        """Stores rows (origin, extent, payload, dtype); the files, each when it is whole. Rows of a shard must follow each other."""
        open_, name = None, None
        for origin, extent, payload, kind in rows:
            if any(o % c for o, c in zip(origin, self.chunk, strict=True)) or any(e > c for e, c in zip(extent, self.chunk, strict=True)):
                raise ValueError(f"a block at {origin} of {extent} is no chunk of {self.chunk}")
            data, file = self.packed(self.block(extent, payload, kind)), self.file(origin)
            if not self.shard:
                put(f"{path}/{file}", data)
                yield file
                continue
            if file != name:
                if open_:
                    open_.close()
                    yield name
                open_, name = ShardFile(f"{path}/{file}", math.prod(self.inside)), file
            open_.add(self.number(origin), data)
        if open_:
            open_.close()
            yield name

    def grid(self) -> list[int]:
        """How many files there are along each axis."""
        return [-(-n // s) for n, s in zip(self.shape, self.shard or self.chunk, strict=True)]

    def same_as(self, info: dict) -> bool:
        """Whether an array that was described takes this one's chunks."""
        told = (self.format, list(self.shape), list(self.chunk), self.shard and list(self.shard), DTYPES[self.dtype])
        return told == (info["format"], info["shape"], info["chunk"], info.get("shard"), info["dtype"].lstrip("<>|="))

    def metadata(self) -> dict[str, dict]:
        """The array's JSON files."""
        item = np.dtype(self.kind).itemsize
        codec = codec_json(self.codec, self.format, item)
        if self.format == "zarr2":
            kind = self.kind if self.kind[1:] not in ("u1", "i1") else "|" + self.kind[1:]
            return {".zarray": {"zarr_format": 2, "shape": self.shape, "chunks": self.chunk, "dtype": kind, "compressor": codec, "fill_value": self.fill, "order": "C", "filters": None, "dimension_separator": "/"}, ".zattrs": self.attributes}
        if self.format == "n5":
            return {"attributes.json": {"dimensions": self.shape, "blockSize": self.chunk, "dataType": self.dtype, "compression": codec} | self.attributes}
        bytes_ = [{"name": "bytes", "configuration": {"endian": "little"}}]
        codecs = bytes_ + ([codec] if codec else [])
        if self.shard:
            codecs = [{"name": "sharding_indexed", "configuration": {"chunk_shape": self.chunk, "codecs": codecs, "index_codecs": [*bytes_, {"name": "crc32c"}], "index_location": "end"}}]
        return {"zarr.json": {"zarr_format": 3, "node_type": "array", "shape": self.shape, "data_type": self.dtype, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": self.shard or self.chunk}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": self.fill, "codecs": codecs, "dimension_names": self.names, "attributes": self.attributes}}


def layout_of(info: dict) -> Layout:
    """The layout of a described array, for more chunks of it; codecs that are only read are an error."""
    steps = [s for s in info["codecs"]["steps"] if s != "crc32c"]
    if info["codecs"]["transpose"] or "crc32c" in info["codecs"]["steps"] or len(steps) > 1 or info["dtype"][0] == (">" if info["format"] != "n5" else "<") or (info["format"] == "zarr2" and info["codecs"]["order"] == "F") or (info["format"] == "zarr2" and info["separator"] != "/"):
        raise ValueError("arrays of this layout are not written")
    dtype = {v: k for k, v in DTYPES.items()}[info["dtype"].lstrip("<>|=")]
    return Layout(info["shape"], info["chunk"], dtype, info["format"], steps[0] if steps else None, info["attributes"], info["names"], info.get("shard"), info["fill"])


def take_over(staged: str, path: str) -> None:
    """A staged folder in the place of whatever is at ``path``; what was there is moved aside first, and deleted last.

    So there is always a whole array, at its place or (for the moment between two renames) beside it; if the second fails, the old one goes back.
    """
    from pyarrow import fs

    system, source = _file_system(staged)
    target = _file_system(path)[1].rstrip("/")
    aside = f"{target}.{uuid.uuid4().hex}.old"
    there = system.get_file_info(target).type != fs.FileType.NotFound
    if there:
        system.move(target, aside)
    elif "/" in target:
        system.create_dir(target.rpartition("/")[0], recursive=True)
    try:
        system.move(source, target)
    except Exception:
        if there:
            system.move(aside, target)
        raise
    if there:
        system.delete_dir(aside)


def delete_folder(path: str) -> bool:
    """Deletes a folder; whether there was one."""
    from pyarrow import fs

    system, at = _file_system(path)
    if system.get_file_info(at).type != fs.FileType.Directory:
        return False
    try:
        system.delete_dir(at)
    except OSError:  # something was put into it meanwhile
        pass
    return True


def move_files(staged: str, path: str, files: Iterable[str]) -> None:
    """Files of a staged folder into an array that exists, each in one step; then the folder goes."""
    system, source = _file_system(staged)
    target = _file_system(path)[1]
    made = set()
    for file in files:
        folder = f"{target}/{file}".rpartition("/")[0]
        if folder not in made:
            system.create_dir(folder, recursive=True)
            made.add(folder)
        system.move(f"{source}/{file}", f"{target}/{file}")
    delete_folder(staged)


def by_shard(chunks: DataFrame, shard: list[int]) -> DataFrame:
    """Rows dealt by shard and sorted within, so that those of a shard follow each other."""
    home = F.transform(F.arrays_zip(F.col("origin").alias("o"), F.array(*map(F.lit, shard)).alias("s")), lambda x: F.floor(x["o"] / x["s"]))
    dealt = chunks.withColumn("_home", F.to_json(home))
    return dealt.repartition("_home").sortWithinPartitions("_home", "origin").drop("_home")


def write_chunks(chunks: DataFrame, path: str, shape: list[int], chunk: list[int], dtype: str = "int32", format: str = "zarr3", codec: str | None = "gzip", **options) -> int:
    """Each row one chunk, in a file of its own or (zarr3 with ``shard``) in that of its shard; metadata last. The number of chunks.

    ``path``: a folder that all tasks share, or an address. ``options``: those of ``Layout``. A task holds one chunk at a time.
    """
    layout = Layout(list(shape), list(chunk), dtype, format, codec, **options)
    kind = F.col("dtype") if "dtype" in chunks.columns else F.lit("<i8").alias("dtype")
    rows = chunks.select("origin", "extent", "payload", kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {"n": 0}

        def counted() -> Iterator[tuple]:
            for b in batches:
                for i in range(b.num_rows):
                    counts["n"] += 1
                    yield tuple(c[i].as_py() for c in b.columns)

        for _ in layout.write(counted(), path):
            pass
        yield pa.RecordBatch.from_pydict({"n": pa.array([counts["n"]], pa.int64())})

    done = (by_shard(rows, layout.shard) if layout.shard else rows).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    for name, value in layout.metadata().items():
        put(f"{path}/{name}", json.dumps(value).encode())
    return done


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; one under the warehouse where none is set."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    return (found or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared").rstrip("/")


def total_chunks(shape: list[int], chunk: list[int]) -> int:
    return math.prod(-(-s // c) for s, c in zip(shape, chunk, strict=True))

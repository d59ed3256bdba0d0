"""Precomputed volumes in full: every scale, raw or compressed-segmentation chunks, in files of their own or in shards of many.

A sharded scale names its chunks by a compressed Morton code; a hash of it tells the shard file and the minishard within, whose
index tells where the chunk lies. Reading fetches the shard's index entry, the minishard's index (kept for the next chunk) and the
chunk, each by its place in the file. Writing deals chunks by shard, in the order of minishards, and streams them out;
the indices come last.
"""

from __future__ import annotations

import gzip
import json
import math
import os
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import zarr

# Bit widths of encoded labels, the edge of a block of labels, and the numbers of the 128-bit hash for 32-bit machines.
WIDTHS, BLOCK = (0, 1, 2, 4, 8, 16, 32), (8, 8, 8)
_C1, _C2, _C3, _F1, _F2 = 0x239B961B, 0xAB0E9789, 0x38B34AE5, 0x85EBCA6B, 0xC2B2AE35
_M = 0xFFFFFFFF
#: Minishard indices that a task keeps.
KEPT = 64


# -- compressed segmentation ----------------------------------------------------------------


def pack_labels(labels: np.ndarray, block: tuple[int, int, int] = BLOCK) -> bytes:
    """Labels (x, y, z, channel) as blocks: a table of the values in each, and their places in it with as few bits as do."""
    words = labels.dtype.itemsize // 4
    if labels.dtype.kind != "u" or words not in (1, 2):
        raise ValueError(f"labels of {labels.dtype} are not compressed")
    channels = []
    for c in range(labels.shape[3]):
        grid = [-(-n // b) for n, b in zip(labels.shape[:3], block, strict=True)]
        heads, body, tables = np.zeros((math.prod(grid), 2), "<u4"), [], {}
        at = 2 * math.prod(grid)
        for number in range(math.prod(grid)):
            i, j, k = number % grid[0], number // grid[0] % grid[1], number // (grid[0] * grid[1])
            part = labels[i * block[0] : (i + 1) * block[0], j * block[1] : (j + 1) * block[1], k * block[2] : (k + 1) * block[2], c]
            values, codes = np.unique(part, return_inverse=True)
            bits = next(w for w in WIDTHS if len(values) <= 1 << w)
            whole = np.zeros(block, np.uint64)
            whole[tuple(slice(0, n) for n in part.shape)] = codes.reshape(part.shape)
            flat, per = whole.ravel(order="F"), 32 // bits if bits else 0
            start = at
            if bits:
                padded = np.zeros(-(-len(flat) // per) * per, np.uint64)
                padded[: len(flat)] = flat
                packed = (padded.reshape(-1, per) << (np.arange(per, dtype=np.uint64) * np.uint64(bits))).sum(axis=1, dtype=np.uint64).astype("<u4")
                body.append(packed)
                at += len(packed)
            table = values.astype(f"<u{4 * words}").tobytes()
            if table not in tables:
                tables[table] = at
                body.append(np.frombuffer(table, "<u4"))
                at += len(table) // 4
            if tables[table] >= 1 << 24:
                raise ValueError("a chunk whose tables do not fit in 24 bits: take smaller chunks")
            heads[number] = tables[table] | bits << 24, start
        channels.append(np.concatenate([heads.ravel(), *body]))
    offsets = np.cumsum([len(channels), *map(len, channels)])[:-1].astype("<u4")
    return offsets.tobytes() + b"".join(c.astype("<u4").tobytes() for c in channels)


def unpack_labels(data: bytes, size: list[int], dtype: str, block: tuple[int, int, int] = BLOCK) -> np.ndarray:
    """The labels (x, y, z, channel) of a chunk; what points outside of it is a ``ValueError``."""
    if len(data) % 4 or np.dtype(dtype).itemsize not in (4, 8):
        raise ValueError("no chunk of compressed labels")
    raw, words = np.frombuffer(data, "<u4"), np.dtype(dtype).itemsize // 4
    out = np.zeros(size, dtype)
    grid, cells = [-(-n // b) for n, b in zip(size[:3], block, strict=True)], math.prod(block)
    for c in range(size[3]):
        if c >= len(raw) or int(raw[c]) + 2 * math.prod(grid) > len(raw):
            raise ValueError("labels without the heads of their blocks")
        mine = raw[int(raw[c]) :]
        heads = mine[: 2 * math.prod(grid)].reshape(-1, 2).tolist()
        for number, (first, start) in enumerate(heads):
            table, bits = first & 0xFFFFFF, first >> 24
            if bits not in WIDTHS:
                raise ValueError(f"labels of {bits} bits")
            codes = np.zeros(cells, np.int64)
            if bits:
                per = 32 // bits
                packed = mine[start : start + -(-cells // per)]
                if len(packed) < -(-cells // per):
                    raise ValueError("a block of labels is cut short")
                shifts = np.arange(per, dtype=np.uint64) * np.uint64(bits)
                codes = (packed.astype(np.uint64)[:, None] >> shifts & np.uint64((1 << bits) - 1)).ravel()[:cells].astype(np.int64)
            i, j, k = number % grid[0], number // grid[0] % grid[1], number // (grid[0] * grid[1])
            place = tuple(slice(p * b, min((p + 1) * b, n)) for p, b, n in zip((i, j, k), block, size, strict=False))
            inside = codes.reshape(block, order="F")[tuple(slice(0, s.stop - s.start) for s in place)]
            top = int(inside.max())
            entries = mine[table : table + words * (top + 1)]
            if len(entries) < words * (top + 1):
                raise ValueError("a table of labels is cut short")
            out[(*place, c)] = entries.view(dtype if words == 1 else "<u8")[inside] if words == 1 else np.ascontiguousarray(entries).view("<u8")[inside]
    return out


# -- shards ---------------------------------------------------------------------------------


def murmur(key: int) -> int:
    """The low 64 bits of the 128-bit hash of eight bytes."""
    turn = lambda v, n: (v << n | v >> 32 - n) & _M

    def mixed(h: int) -> int:
        h = (h ^ h >> 16) * _F1 & _M
        h = (h ^ h >> 13) * _F2 & _M
        return h ^ h >> 16

    h2 = turn((key >> 32) * _C2 & _M, 16) * _C3 & _M
    h1 = turn((key & _M) * _C1 & _M, 15) * _C2 & _M
    h = [h1 ^ 8, h2 ^ 8, 8, 8]
    h[0] = sum(h) & _M
    h[1:] = [(v + h[0]) & _M for v in h[1:]]
    h = [mixed(v) for v in h]
    h[0] = sum(h) & _M
    return (h[1] + h[0] & _M) << 32 | h[0]


def grid_bits(grid: list[int]) -> list[tuple[int, int]]:
    """(axis, bit of its place) for every bit of a compressed Morton code, from the lowest."""
    return [(axis, bit) for bit in range(max(grid).bit_length()) for axis in range(3) if 1 << bit < grid[axis]]


def morton(place: list[int], bits: list[tuple[int, int]]) -> int:
    return sum((place[axis] >> bit & 1) << i for i, (axis, bit) in enumerate(bits))


def place_of(code: int, bits: list[tuple[int, int]]) -> list[int]:
    out = [0, 0, 0]
    for i, (axis, bit) in enumerate(bits):
        out[axis] |= (code >> i & 1) << bit
    return out


def shard_and_mini(code: int, spec: dict) -> tuple[int, int]:
    key = code >> spec.get("preshift_bits", 0)
    hashed = {"identity": lambda k: k, "murmurhash3_x86_128": murmur}[spec["hash"]](key)
    mini = spec["minishard_bits"]
    return hashed >> mini & (1 << spec["shard_bits"]) - 1, hashed & (1 << mini) - 1


def shard_file(shard: int, spec: dict) -> str:
    return f"{shard:0{max(1, -(-spec['shard_bits'] // 4))}x}.shard"


class Minishards:
    """Chunks of a sharded scale by their codes; the last indices that were read are kept."""

    def __init__(self, folder: str, spec: dict, read: Callable[[str, int, int], bytes | None] = zarr.fetch_range):
        self.folder, self.spec, self.read = folder, spec, read
        self.kept: OrderedDict[tuple[int, int], dict[int, tuple[int, int]]] = OrderedDict()

    def _index(self, shard: int, mini: int) -> dict[int, tuple[int, int]]:
        path, head = f"{self.folder}/{shard_file(shard, self.spec)}", 16 << self.spec["minishard_bits"]
        entry = self.read(path, 16 * mini, 16)
        if entry is None:
            return {}
        if len(entry) != 16:
            raise ValueError("a shard without its index")
        first, stop = (int(v) for v in np.frombuffer(entry, "<u8"))
        if first == stop:
            return {}
        data = self.read(path, head + first, stop - first)
        if data is None or len(data) != stop - first:
            raise ValueError("the index of a minishard is cut short")
        data = gzip.decompress(data) if self.spec.get("minishard_index_encoding") == "gzip" else data
        if len(data) % 24:
            raise ValueError("the index of a minishard is no table of three rows")
        codes, starts, sizes = np.frombuffer(data, "<u8").reshape(3, -1)
        codes = np.cumsum(codes)
        starts = np.cumsum(starts + np.concatenate([[np.uint64(0)], sizes[:-1]])) + np.uint64(head)
        return dict(zip(codes.tolist(), zip(starts.tolist(), sizes.tolist(), strict=True), strict=True))

    def get(self, code: int) -> bytes | None:
        at = shard_and_mini(code, self.spec)
        if at not in self.kept:
            self.kept[at] = self._index(*at)
            if len(self.kept) > KEPT:
                self.kept.popitem(last=False)
        self.kept.move_to_end(at)
        if code not in self.kept[at]:
            return None
        first, length = self.kept[at][code]
        data = self.read(f"{self.folder}/{shard_file(at[0], self.spec)}", first, length)
        if data is None or len(data) != length:
            raise ValueError("a shard is shorter than its index tells")
        return gzip.decompress(data) if self.spec.get("data_encoding") == "gzip" else data


class ShardWriter:
    """A shard whose chunks come by minishard and code; where names can be taken over, it is streamed, else held until it is whole."""

    def __init__(self, path: str, spec: dict):
        self.path, self.spec, self.head = path, spec, 16 << spec["minishard_bits"]
        self.system, self.at = zarr._file_system(path)
        self.local = self.system.type_name == "local"
        if self.local:
            os.makedirs(os.path.dirname(self.at), exist_ok=True)
            self.staged = f"{self.at}.{os.getpid()}.tmp"
            self.file = open(self.staged, "w+b")  # noqa: SIM115  closed by close()
            self.file.write(bytes(self.head))
        else:
            self.body = bytearray()
        self.length, self.entries, self.index, self.mini = 0, [], np.zeros((1 << spec["minishard_bits"], 2), "<u8"), None

    def _put(self, data: bytes) -> None:
        self.file.write(data) if self.local else self.body.extend(data)
        self.length += len(data)

    def add(self, mini: int, code: int, data: bytes) -> None:
        if mini != self.mini:
            self._end()
            self.mini = mini
        data = gzip.compress(data, mtime=0) if self.spec.get("data_encoding") == "gzip" else data
        if self.entries and code <= self.entries[-1][0]:
            raise ValueError("chunks of a minishard out of order, or one of them twice")
        self.entries.append((code, self.length, len(data)))
        self._put(data)

    def _end(self) -> None:
        if not self.entries:
            return
        codes, starts, sizes = (np.array(v, np.uint64) for v in zip(*self.entries, strict=True))
        ends = np.concatenate([[np.uint64(0)], (starts + sizes)[:-1]])
        table = np.stack([np.diff(codes, prepend=np.uint64(0)), starts - ends, sizes]).astype("<u8").tobytes()
        table = gzip.compress(table, mtime=0) if self.spec.get("minishard_index_encoding") == "gzip" else table
        self.index[self.mini] = self.length, self.length + len(table)
        self._put(table)
        self.entries = []

    def close(self) -> None:
        self._end()
        if self.local:
            self.file.seek(0)
            self.file.write(self.index.tobytes())
            self.file.close()
            os.replace(self.staged, self.at)
        else:
            zarr.put(self.path, self.index.tobytes() + bytes(self.body))


# -- scales ---------------------------------------------------------------------------------


def describe_scale(meta: dict, scale: dict, prefix: str) -> dict:
    """What ``zarr.describe`` says of a scale."""
    encoding = scale["encoding"]
    if encoding not in ("raw", "compressed_segmentation"):
        raise ValueError(f"encoding {encoding}")
    spec = scale.get("sharding")
    if spec and (spec.get("@type") != "neuroglancer_uint64_sharded_v1" or spec.get("hash") not in ("identity", "murmurhash3_x86_128")):
        raise ValueError(f"sharding {spec}")
    return {
        "format": "precomputed", "shape": [*scale["size"], meta["num_channels"]], "chunk": [*scale["chunk_sizes"][0], meta["num_channels"]], "dtype": "<" + zarr.DTYPES[meta["data_type"]], "fill": 0,
        "codecs": {"transpose": None, "order": "F", "steps": []}, "prefix": prefix, "separator": "_", "offset": [*scale.get("voxel_offset", [0, 0, 0]), 0], "names": ["x", "y", "z", "c"], "attributes": meta,
        "labels": tuple(scale.get("compressed_segmentation_block_size", BLOCK)) if encoding == "compressed_segmentation" else None, "sharding": spec, "scale": scale,
    }


def decode_chunk(info: dict, place: list[int], data: bytes | None) -> Iterator[tuple]:
    """The row of a chunk, as ``zarr.rows_of_file`` has it."""
    start = [i * c for i, c in zip(place, info["chunk"], strict=True)]
    if data is None:
        yield zarr._row(info, start, None)
        return
    size = [min(c, s - o) for c, s, o in zip(info["chunk"], info["shape"], start, strict=True)]
    block = unpack_labels(data, size, info["dtype"], info["labels"]) if info["labels"] else zarr.decode_block(data, info["codecs"], info["dtype"], size)
    yield zarr._row(info, start, block)


def grid_of(info: dict) -> list[int]:
    return [-(-n // c) for n, c in zip(info["shape"], info["chunk"], strict=True)]


def folder_of(path: str, info: dict) -> str:
    return f"{path}/{info['prefix']}" if info["prefix"] else path


def read_shards(spark: SparkSession, path: str, info: dict, fill_missing: bool = True) -> DataFrame:
    """The chunks of a sharded scale, by ranges of their codes: neighbours share minishards."""
    grid, bits, folder = grid_of(info), grid_bits(grid_of(info)[:3]), folder_of(path, info)

    def rows(codes: Iterator[int]) -> Iterator[tuple]:
        shards = Minishards(folder, info["sharding"])
        for code in codes:
            place = place_of(code, bits)
            if all(i < g for i, g in zip(place, grid, strict=False)):
                data = shards.get(code)
                if data is not None or fill_missing:
                    yield from decode_chunk(info, [*place, 0], data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from zarr.chunk_batches(rows(n for b in batches for n in b.column(0).to_pylist()))

    total = 1 << len(bits)
    return spark.range(0, total, 1, zarr.tasks_for(info, total)).mapInArrow(run, zarr.CHUNK_SCHEMA)


def write_scale(chunks: DataFrame, path: str, size: list[int], chunk: list[int], dtype: str, resolution: list[float], encoding: str = "raw", sharding: dict | None = None, offset: list[int] | None = None, channels: int = 1, block: tuple[int, int, int] = BLOCK) -> dict:
    """Chunks (x, y, z, c) of a scale under ``path``; the scale's entry for ``write_info``. All chunks of ``chunk`` that are not given are absent, and read as 0."""
    key = "_".join(str(int(r)) if r == int(r) else str(r) for r in resolution)
    scale = {"key": key, "size": size, "resolution": resolution, "voxel_offset": offset or [0, 0, 0], "chunk_sizes": [chunk], "encoding": encoding}
    if encoding == "compressed_segmentation":
        scale["compressed_segmentation_block_size"] = list(block)
    if sharding:
        scale["sharding"] = {"@type": "neuroglancer_uint64_sharded_v1", "preshift_bits": 0, "hash": "murmurhash3_x86_128", "minishard_index_encoding": "gzip", "data_encoding": "raw"} | sharding
    info = describe_scale({"num_channels": channels, "data_type": dtype}, scale, key)
    spec, grid, kind = info["sharding"], grid_of(info), "<" + zarr.DTYPES[dtype]
    bits = grid_bits(grid[:3])

    def packed(extent: list[int], payload: bytes, told: str) -> bytes:
        values = np.frombuffer(payload, told).reshape(extent).astype(kind)
        return pack_labels(values, block) if encoding == "compressed_segmentation" else values.tobytes(order="F")

    @F.arrow_udf("struct<shard:long,mini:long,code:long>")
    def home(origins: pa.Array) -> pa.Array:
        out = []
        for origin in origins.to_pylist():
            code = morton([o // c for o, c in zip(origin, chunk, strict=False)], bits)
            shard, mini = shard_and_mini(code, spec)
            out.append({"shard": shard, "mini": mini, "code": code})
        return pa.array(out, pa.struct([("shard", pa.int64()), ("mini", pa.int64()), ("code", pa.int64())]))

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for b in batches:
            for i in range(b.num_rows):
                origin, extent, payload, told = (b.column(c)[i].as_py() for c in ("origin", "extent", "payload", "dtype"))
                zarr.put(f"{path}/{zarr.file_of(info, [o // c for o, c in zip(origin, info['chunk'], strict=True)])}", packed(extent, payload, told))
                n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    def sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, at, open_ = 0, None, None
        for b in batches:
            for i in range(b.num_rows):
                to, extent, payload, told = (b.column(c)[i].as_py() for c in ("home", "extent", "payload", "dtype"))
                if to["shard"] != at:
                    if open_:
                        open_.close()
                    at, open_ = to["shard"], ShardWriter(f"{path}/{key}/{shard_file(to['shard'], spec)}", spec)
                open_.add(to["mini"], to["code"], packed(extent, payload, told))
                n += 1
        if open_:
            open_.close()
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    rows = chunks.select("origin", "extent", "payload", "dtype")
    if spec:
        dealt = rows.withColumn("home", home("origin")).repartition("home.shard").sortWithinPartitions("home")
        written = dealt.mapInArrow(sharded, "n long")
    else:
        written = rows.mapInArrow(single, "n long")
    written.agg(F.sum("n")).first()
    return scale


def write_info(path: str, dtype: str, scales: list[dict], kind: str = "image", channels: int = 1) -> None:
    """The volume's metadata, after its scales are written."""
    zarr.put(f"{path}/info", json.dumps({"@type": "neuroglancer_multiscale_volume", "type": kind, "data_type": dtype, "num_channels": channels, "scales": scales}).encode())

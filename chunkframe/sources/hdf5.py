"""HDF5 files by their own walk: groups, datasets and attributes, and the chunks of a dataset by ranged reads.

Read are superblocks 0 to 3, object headers 1 and 2, groups as symbol tables or as links in the header, fixed-point and float
types of either byte order, compact, contiguous and chunked (version 1 B-tree) layouts, and the filters deflate, shuffle and
fletcher32. A task reads a leaf of the chunks' B-tree and the chunks it names, or a run of rows of a contiguous dataset. Other structures
(dense groups, newer chunk indices, other filters) and broken files are a ``ValueError``.

Imaris files are such files with fixed names: their time points and channels come in the order of their numbers.
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

from . import zarr

# Marks of the structures, and numbers of messages and filters.
MAGIC, UNDEFINED = b"\x89HDF\r\n\x1a\n", 2**64 - 1
SPACE, LINK_INFO, DATATYPE, LINK, LAYOUT, FILTERS, ATTRIBUTE, CONTINUES, TABLE, FILL = 0x1, 0x2, 0x3, 0x6, 0x8, 0xB, 0xC, 0x10, 0x11, 0x5
DEFLATE, SHUFFLE, FLETCHER = 1, 2, 3
#: Levels of groups, nodes of a tree, members of a group and bytes of one structure at most: what is beyond is broken.
MOST_DEPTH, MOST_NODES, MOST_BYTES = 32, 1 << 22, 1 << 26
Read = Callable[[int, int], bytes | None]


def _bytes(read: Read, at: int, n: int) -> bytes:
    if n < 0 or n > MOST_BYTES or at < 0 or at >= UNDEFINED:
        raise ValueError(f"{n} bytes at {at} are asked for")
    data = read(at, n) if n else b""
    if data is None or len(data) != n:
        raise ValueError("a file is shorter than its structures tell")
    return data


def _ints(data: bytes, at: int, size: int, n: int = 1) -> list[int]:
    if at < 0 or at + size * n > len(data):
        raise ValueError("a structure is cut short")
    return [int.from_bytes(data[at + i * size : at + (i + 1) * size], "little") for i in range(n)]


def _int(data: bytes, at: int, size: int) -> int:
    return _ints(data, at, size)[0]


@dataclass
class Item:
    """An object: a group with members, or a dataset."""

    address: int
    members: dict[str, int] = field(default_factory=dict)
    attributes: dict[str, object] = field(default_factory=dict)
    shape: list[int] | None = None
    dtype: str | None = None
    layout: tuple | None = None
    filters: list[tuple[int, list[int]]] = field(default_factory=list)
    fill: bytes = b""

    @property
    def is_dataset(self) -> bool:
        return self.layout is not None and self.shape is not None


class File:
    def __init__(self, read: Read):
        self.read = read
        head = _bytes(read, 0, 9)
        if head[:8] != MAGIC:
            raise ValueError("no HDF5 file")
        if head[8] in (0, 1):
            data = _bytes(read, 0, 96 + 4 * head[8])
            sizes, at = data[13:15], 24 + 4 * head[8]
            self.base, self.root = _int(data, at, 8), _int(data, at + 40, 8)
        elif head[8] in (2, 3):
            data = _bytes(read, 0, 48)
            sizes, self.base, self.root = data[9:11], _int(data, 12, 8), _int(data, 36, 8)
        else:
            raise ValueError(f"a superblock of version {head[8]}")
        if sizes != b"\x08\x08":
            raise ValueError("addresses of other than eight bytes")

    def at(self, address: int, n: int) -> bytes:
        return _bytes(self.read, self.base + address, n)

    # -- object headers

    def messages(self, address: int) -> Iterator[tuple[int, bytes]]:
        first = self.at(address, 16)
        if first[:4] == b"OHDR":
            flags = first[5]
            skip = 6 + (16 if flags & 0x20 else 0) + (4 if flags & 0x10 else 0)
            width = 1 << (flags & 3)
            size = _int(self.at(address, skip + width), skip, width)
            blocks, head, order = [(address + skip + width, size)], 4 + (2 if flags & 4 else 0), True
        elif first[0] == 1:
            blocks, head, order = [(address + 16, _int(first, 8, 4))], 8, False
        else:
            raise ValueError("no object header")
        seen = set()
        while blocks:
            place, size = blocks.pop(0)
            if place in seen or len(seen) > 1000:
                raise ValueError("object headers that go round")
            seen.add(place)
            data, at = self.at(place, size), 0
            while at + head <= size:
                kind, n = (data[at], _int(data, at + 1, 2)) if order else (_int(data, at, 2), _int(data, at + 2, 2))
                body = data[at + head : at + head + n]
                if len(body) != n:
                    raise ValueError("a message is cut short")
                at += head + n
                if kind == CONTINUES:
                    to, length = _ints(body, 0, 8, 2)
                    blocks.append((to + 4, length - 8) if order else (to, length))
                elif kind:
                    yield kind, body

    def item(self, address: int) -> Item:
        out = Item(address)
        for kind, body in self.messages(address):
            if kind == SPACE:
                out.shape = _space(body)
            elif kind == DATATYPE:
                out.dtype = _datatype(body)
            elif kind == LAYOUT:
                out.layout = _layout(body)
            elif kind == FILTERS:
                out.filters = _filters(body)
            elif kind == FILL:
                out.fill = _fill(body)
            elif kind == TABLE:
                out.members |= self.symbols(*_ints(body, 0, 8, 2))
            elif kind == LINK:
                name, to = _link(body)
                if to is not None:
                    out.members[name] = to
            elif kind == LINK_INFO:
                at = 2 + (8 if body[1:2] and body[1] & 1 else 0)
                if _int(body, at, 8) != UNDEFINED:
                    raise ValueError("a group whose links are in a heap")
            elif kind == ATTRIBUTE:
                name, value = _attribute(body)
                out.attributes[name] = value
        return out

    # -- groups

    def symbols(self, tree: int, heap: int) -> dict[str, int]:
        head = self.at(heap, 32)
        if head[:4] != b"HEAP":
            raise ValueError("no heap of names")
        names = self.at(_int(head, 24, 8), _int(head, 8, 8))
        out: dict[str, int] = {}
        for leaf in self.leaves(tree, 0, 8):
            for node in leaf:
                data = self.at(node[1], 8)
                if data[:4] != b"SNOD":
                    raise ValueError("no table of symbols")
                count = _int(data, 6, 2)
                rows = self.at(node[1] + 8, 40 * count)
                for i in range(count):
                    name, to = _ints(rows, 40 * i, 8, 2)
                    end = names.find(b"\0", name)
                    if end < 0:
                        raise ValueError("a name without an end")
                    out[names[name:end].decode("utf-8", "replace")] = to
        return out

    def leaves(self, tree: int, kind: int, key: int) -> Iterator[list[tuple[bytes, int]]]:
        """The (key, child) pairs of every leaf of a version 1 B-tree."""
        for address in self.leaf_places(tree, kind, key):
            yield self.node(address, kind, key)[1]

    def node(self, address: int, kind: int, key: int) -> tuple[int, list[tuple[bytes, int]]]:
        head = self.at(address, 24)
        if head[:4] != b"TREE" or head[4] != kind:
            raise ValueError("no node of a tree")
        used = _int(head, 6, 2)
        data = self.at(address + 24, used * (key + 8) + key)
        return head[5], [(data[i * (key + 8) : i * (key + 8) + key], _int(data, i * (key + 8) + key, 8)) for i in range(used)]

    def leaf_places(self, tree: int, kind: int, key: int) -> list[int]:
        if tree == UNDEFINED:
            return []
        out, open_, seen = [], [(tree, None)], 0
        while open_:
            address, due = open_.pop()
            level, children = self.node(address, kind, key)
            seen += 1
            if seen > MOST_NODES or (due is not None and level != due):
                raise ValueError("a tree that goes round")
            if level == 0:
                out.append(address)
            else:
                open_ += [(to, level - 1) for _, to in reversed(children)]
        return out

    # -- names

    def find(self, path: str) -> Item:
        found = self.item(self.root)
        for name in filter(None, path.split("/")):
            if name not in found.members:
                raise FileNotFoundError(f"no {name} in {path}")
            found = self.item(found.members[name])
        return found

    def datasets(self) -> list[tuple[str, Item]]:
        """Every dataset by its path, groups in the order of their names' numbers."""
        out, open_, seen = [], [("", self.root, 0)], {self.root}
        while open_:
            path, address, depth = open_.pop()
            found = self.item(address)
            if found.is_dataset:
                out.append((path, found))
            for name in sorted(found.members, key=_natural, reverse=True):
                to = found.members[name]
                if to not in seen:  # links can lead to what was seen
                    if depth >= MOST_DEPTH or len(seen) > MOST_NODES:
                        raise ValueError("groups too deep")
                    seen.add(to)
                    open_.append((f"{path}/{name}", to, depth + 1))
        return out


def _natural(name: str) -> list:
    return [(int(p), "") if p.isdigit() else (-1, p) for p in re.split(r"(\d+)", name) if p]


def _space(body: bytes) -> list[int]:
    if body[:1] not in (b"\1", b"\2"):
        raise ValueError("a dataspace of another version")
    rank = _int(body, 1, 1)
    return _ints(body, 8 if body[0] == 1 else 4, 8, rank) if rank <= 32 else _ints(b"", 0, 8)


def _datatype(body: bytes) -> str | None:
    """A numpy type; None for what is no number or text."""
    kind, order, size = _int(body, 0, 1) & 15, _int(body, 1, 1), _int(body, 4, 4)
    if kind == 0 and size in (1, 2, 4, 8):
        return ("<>"[order & 1]) + ("i" if order & 8 else "u") + str(size)
    if kind == 1 and size in (2, 4, 8):
        return ("<>"[order & 1]) + f"f{size}"
    return f"S{size}" if kind == 3 and 0 < size <= MOST_BYTES else None


def _layout(body: bytes) -> tuple:
    version, kind = _ints(body, 0, 1, 2)
    if version != 3:
        raise ValueError(f"a layout of version {version}")
    if kind == 0:
        size = _int(body, 2, 2)
        return "compact", body[4 : 4 + size]
    if kind == 1:
        return "contiguous", *_ints(body, 2, 8, 2)
    if kind == 2:
        n = _int(body, 2, 1)
        return "chunked", _int(body, 3, 8), _ints(body, 11, 4, n)
    raise ValueError(f"a layout of kind {kind}")


def _filters(body: bytes) -> list[tuple[int, list[int]]]:
    version, count = _ints(body, 0, 1, 2)
    out, at = [], 8 if version == 1 else 2
    for _ in range(count):
        number = _int(body, at, 2)
        named = version == 1 or number >= 256
        length = _int(body, at + 2, 2) if named else 0
        at += 4 if named else 2
        values = _int(body, at + 2, 2)
        at += 4 + (-(-length // 8) * 8 if version == 1 else length)
        out.append((number, _ints(body, at, 4, values)))
        at += 4 * values + (4 if version == 1 and values % 2 else 0)
    return out


def _fill(body: bytes) -> bytes:
    version = _int(body, 0, 1)
    if version in (1, 2) and (version == 1 or (len(body) > 3 and body[3])):
        return body[8 : 8 + _int(body, 4, 4)]
    if version == 3 and _int(body, 1, 1) & 0x20:
        return body[6 : 6 + _int(body, 2, 4)]
    return b""


def _link(body: bytes) -> tuple[str, int | None]:
    flags, at = _int(body, 1, 1), 2
    kind = 0
    if flags & 8:
        kind, at = _int(body, at, 1), at + 1
    at += (8 if flags & 4 else 0) + (1 if flags & 16 else 0)
    width = 1 << (flags & 3)
    size = _int(body, at, width)
    name = body[at + width : at + width + size].decode("utf-8", "replace")
    return name, _int(body, at + width + size, 8) if kind == 0 else None


def _attribute(body: bytes) -> tuple[str, object]:
    version = _int(body, 0, 1)
    if version not in (1, 2, 3):
        return "", None
    sizes = _ints(body, 2, 2, 3)
    at, step = 8 + (version == 3), 8 if version == 1 else 1
    parts = []
    for size in sizes:
        parts.append(body[at : at + size])
        at += -(-size // step) * step
    name = parts[0].split(b"\0")[0].decode("utf-8", "replace")
    dtype, shape = _datatype(parts[1]), _space(parts[2])
    n = math.prod(shape)
    if dtype is None or n * np.dtype(dtype).itemsize > len(body) - at:
        return name, None
    values = np.frombuffer(body, dtype, n, at)
    if dtype[0] == "S":  # texts are often stored a letter an entry
        return name, b"".join(values.tolist()).decode("utf-8", "replace") if np.dtype(dtype).itemsize == 1 else values[0].decode("utf-8", "replace") if n == 1 else [v.decode("utf-8", "replace") for v in values]
    return name, values.tolist() if n != 1 else values[0].item()


def undone(data: bytes, filters: list[tuple[int, list[int]]], mask: int, size: int) -> bytes:
    """A chunk's bytes with its filters undone, the last one first; those set in the mask were left out."""
    for i in range(len(filters) - 1, -1, -1):
        number, values = filters[i]
        if mask >> i & 1:
            continue
        if number == DEFLATE:
            try:
                data = zlib.decompressobj().decompress(data, size + 64)
            except zlib.error as e:
                raise ValueError(f"a deflate chunk: {e}") from None
        elif number == SHUFFLE:
            item = values[0] if values else 1
            n = len(data) // item if item else 0
            data = np.frombuffer(data, np.uint8, n * item).reshape(item, n).T.tobytes() + data[n * item :]
        elif number == FLETCHER:
            data = data[:-4]
        else:
            raise ValueError(f"filter {number}")
    if len(data) != size:
        raise ValueError("a chunk of another size than its layout tells")
    return data


# -- as tables ------------------------------------------------------------------------------


def opened(path: str) -> File:
    return File(lambda at, n: zarr.fetch_range(path, at, n))


def largest(path: str) -> str:
    """The dataset with most elements; of equals the first by name."""
    found = [(-math.prod(item.shape), i, name) for i, (name, item) in enumerate(opened(path).datasets()) if item.dtype and item.dtype[0] in "<>" and item.shape]
    if not found:
        raise ValueError(f"{path} has no array of numbers")
    return min(found)[2]


def describe(path: str, dataset: str | None = None) -> dict:
    """dataset, shape, chunk, dtype, fill and attributes."""
    name = dataset or largest(path)
    item = opened(path).find(name)
    if not item.is_dataset or not item.dtype or item.dtype[0] not in "<>":
        raise ValueError(f"{name} is no array of numbers")
    chunk = item.layout[2][:-1] if item.layout[0] == "chunked" else [1] * (len(item.shape) - 2) + item.shape[-2:]
    if len(chunk) != len(item.shape) or min(chunk, default=1) < 1:
        raise ValueError(f"chunks {chunk} of a dataset of {item.shape}")
    kind = np.dtype(item.dtype)
    return {"dataset": name, "shape": item.shape, "chunk": chunk, "dtype": kind.newbyteorder("=").name, "fill": np.frombuffer(item.fill, kind)[0].item() if len(item.fill) == kind.itemsize else 0, "attributes": item.attributes}


def _jobs(path: str, dataset: str) -> list[tuple[int, int]]:
    """What tasks read: leaves of the chunks' tree, or runs of planes of a contiguous dataset."""
    file = opened(path)
    item = file.find(dataset)
    if item.layout[0] == "chunked":
        return [(address, 0) for address in file.leaf_places(item.layout[1], 1, 8 + 8 * len(item.layout[2]))]
    planes = math.prod(item.shape[:-2])
    return [(i, min(i + 64, planes)) for i in range(0, planes, 64)]


def _rows(path: str, dataset: str, jobs: Iterator[tuple[int, int]]) -> Iterator[tuple]:
    file = opened(path)
    item = file.find(dataset)
    kind, shape = np.dtype(item.dtype), item.shape
    target = kind.newbyteorder("<")
    for first, stop in jobs:
        if item.layout[0] == "chunked":
            chunk = item.layout[2][:-1]
            for key, address in file.node(first, 1, 8 + 8 * len(item.layout[2]))[1]:
                size, mask = _ints(key, 0, 4, 2)
                origin = _ints(key, 8, 8, len(chunk))
                extent = [min(c, n - o) for c, n, o in zip(chunk, shape, origin, strict=True)]
                if min(extent) <= 0 or any(o % c for o, c in zip(origin, chunk, strict=True)):
                    raise ValueError("a chunk outside of its dataset")
                data = undone(file.at(address, size), item.filters, mask, math.prod(chunk) * kind.itemsize)
                block = np.frombuffer(data, kind).reshape(chunk)[tuple(slice(0, e) for e in extent)]
                yield origin, extent, np.ascontiguousarray(block).astype(target).tobytes(), target.str
            continue
        plane = math.prod(shape[-2:]) * kind.itemsize
        for n in range(first, stop):
            if item.layout[0] == "compact":
                data = item.layout[1][n * plane : (n + 1) * plane]
            else:
                data = bytes(plane) if item.layout[1] == UNDEFINED else file.at(item.layout[1] + n * plane, plane)
            if len(data) != plane:
                raise ValueError("a dataset is cut short")
            at = [int(i) for i in np.unravel_index(n, shape[:-2])] if len(shape) > 2 else []
            yield [*at, *[0] * len(shape[-2:])], [*[1] * len(at), *shape[-2:]], np.frombuffer(data, kind).astype(target).tobytes(), target.str


def read_chunks(spark: SparkSession, path: str, dataset: str | None = None) -> DataFrame:
    """(origin, extent, payload, dtype) of the chunks that are stored; those that are not hold the fill value."""
    name = dataset or largest(path)
    describe(path, name)
    jobs = _jobs(path, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from zarr.chunk_batches(_rows(path, name, (j for b in batches for j in zip(*(c.to_pylist() for c in b.columns), strict=True))))

    table = spark.createDataFrame(jobs, "first long, stop long") if jobs else spark.createDataFrame([], "first long, stop long")
    return table.repartition(max(1, len(jobs))).mapInArrow(run, zarr.CHUNK_SCHEMA)


def file_of(datasets: dict[str, np.ndarray]) -> bytes:
    """A file of a few contiguous datasets in one group."""
    out = bytearray(96)

    def put(data: bytes) -> int:
        at = len(out)
        out.extend(data + bytes(-len(data) % 8))
        return at

    def header(messages: list[tuple[int, bytes]]) -> int:
        body = b"".join(struct.pack("<HHI", kind, len(data) + -len(data) % 8, 0) + data + bytes(-len(data) % 8) for kind, data in messages)
        return put(struct.pack("<BBHIII", 1, 0, len(messages), 1, len(body), 0) + body)

    names, places, objects = bytearray(8), {}, {}
    for name, a in datasets.items():
        kind = a.dtype.newbyteorder("<")
        number = struct.pack("<HH", 0, 8 * kind.itemsize) if kind.kind != "f" else bytes(12)
        said = struct.pack("<BBBBI", 0x11 if kind.kind == "f" else 0x10, 8 if kind.kind == "i" else 0, 0, 0, kind.itemsize) + number
        data = np.ascontiguousarray(a).astype(kind).tobytes()
        shape = struct.pack("<BBBBI", 1, a.ndim, 0, 0, 0) + struct.pack(f"<{a.ndim}Q", *a.shape)
        objects[name] = header([(SPACE, shape), (DATATYPE, said), (LAYOUT, struct.pack("<BBQQ", 3, 1, put(data), len(data)))])
        places[name] = len(names)
        names += name.encode() + bytes(8 - len(name.encode()) % 8)
    heap = put(b"HEAP" + bytes(4) + struct.pack("<QQQ", len(names), UNDEFINED, put(bytes(names))))
    node = put(b"SNOD" + struct.pack("<BBH", 1, 0, len(objects)) + b"".join(struct.pack("<QQ", places[n], objects[n]) + bytes(24) for n in sorted(objects)))
    tree = put(b"TREE" + struct.pack("<BBHQQ", 0, 0, 1, UNDEFINED, UNDEFINED) + struct.pack("<QQQ", 0, node, places[max(objects)]))
    root = header([(TABLE, struct.pack("<QQ", tree, heap))])
    out[:96] = MAGIC + bytes([0, 0, 0, 0, 0, 8, 8, 0]) + struct.pack("<HHI", 16, 16, 0) + struct.pack("<QQQQ", 0, UNDEFINED, len(out), UNDEFINED) + struct.pack("<QQ", 0, root) + bytes(24)
    return bytes(out)


def write_files(chunks: DataFrame, folder: str, name: str = "part_{}.h5") -> int:
    """Every chunk (one place of the first axis) as a file with the dataset ``data``, named by that place; how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for b in batches:
            for i in range(b.num_rows):
                origin, extent, payload, kind = (c[i].as_py() for c in b.columns)
                zarr.put(f"{folder}/{name.format(origin[0])}", file_of({"data": np.frombuffer(payload, kind).reshape(extent[1:])}))
                n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return chunks.select("origin", "extent", "payload", "dtype").mapInArrow(run, "n long").agg({"n": "sum"}).first()[0]


def read_files(spark: SparkSession, folder: str, dataset: str | None = None) -> DataFrame:
    """(path, origin, extent, payload, dtype) of the chunks of every HDF5 file of a folder; of each the dataset that is named, or its largest."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{h5,hdf5}").load(folder).select("path")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                name = dataset or largest(path)
                for found in zarr.chunk_batches(_rows(path, name, iter(_jobs(path, name)))):
                    yield pa.RecordBatch.from_arrays([pa.array([path] * found.num_rows), *found.columns], names=["path", *found.schema.names])

    return files.mapInArrow(rows, "path string, " + zarr.CHUNK_SCHEMA)


# -- Imaris ---------------------------------------------------------------------------------


def describe_imaris(path: str, level: int = 0) -> dict:
    """The array of a level: t, c, z, y, x (axes of one place left out), its datasets in order, and voxel sizes in nanometres."""
    file = opened(path)
    group = file.find(f"/DataSet/ResolutionLevel {level}")
    times = sorted((n for n in group.members if n.startswith("TimePoint ")), key=_natural)
    channels = sorted((n for n in file.item(group.members[times[0]]).members if n.startswith("Channel ")), key=_natural) if times else []
    if not channels:
        raise ValueError(f"{path} has no time point with a channel")
    names = [f"/DataSet/ResolutionLevel {level}/{t}/{c}/Data" for t in times for c in channels]
    first = describe(path, names[0])
    info = file.find("/DataSetInfo/Image").attributes
    unit = str(info.get("Unit") or "").strip().lower()
    voxel = {}
    for i, a in enumerate("xyz"):
        try:
            size = (float(info[f"ExtMax{i}"]) - float(info[f"ExtMin{i}"])) / int(info[a.upper()])
        except (KeyError, TypeError, ValueError):
            continue
        named = unit or ("um" if size < 1 else "nm")
        voxel[a] = size * (1.0 if named.startswith("n") else 1e6 if named.startswith("mm") else 1e3)
    front = [(a, n) for a, n in (("t", len(times)), ("c", len(channels))) if n > 1]
    return {"axes": [a for a, _ in front] + ["z", "y", "x"], "shape": [n for _, n in front] + first["shape"], "chunk": [1] * len(front) + first["chunk"], "dtype": first["dtype"], "datasets": names, "voxel": voxel, "counts": [n for _, n in front]}


def read_imaris(spark: SparkSession, path: str, level: int = 0) -> DataFrame:
    """The chunks of all time points and channels of a level, as one array."""
    info = describe_imaris(path, level)
    jobs = [(i, *job) for i, name in enumerate(info["datasets"]) for job in _jobs(path, name)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for i, first, stop in zip(*(c.to_pylist() for c in b.columns), strict=True):
                front = [int(v) for v in np.unravel_index(i, info["counts"])] if info["counts"] else []
                for origin, extent, payload, kind in _rows(path, info["datasets"][i], iter([(first, stop)])):
                    yield front + origin, [1] * len(front) + extent, payload, kind

    table = spark.createDataFrame(jobs, "n long, first long, stop long").repartition(max(1, len(jobs)))
    return table.mapInArrow(lambda batches: zarr.chunk_batches(rows(batches)), zarr.CHUNK_SCHEMA)

"""HDF5 files made by hand: groups, layouts, filters, attributes; Imaris names; broken files."""

import math
import struct
import tempfile
import zlib

import numpy as np
import pytest
from test_resample import whole

from chunkframe.sources import convert, hdf5, zarr

RNG = np.random.default_rng(9)
NO = 2**64 - 1


def pad(b, n=8):
    return b + bytes(-len(b) % n)


def datatype(kind):
    kind = np.dtype(kind)
    if kind.kind == "S":
        return struct.pack("<BBBBI", 0x13, 0, 0, 0, kind.itemsize)
    order = 1 if kind.str[0] == ">" else 0
    if kind.kind == "f":
        return struct.pack("<BBBBI", 0x11, order, 0, 0, kind.itemsize) + bytes(12)
    return struct.pack("<BBBBI", 0x10, order | (8 if kind.kind == "i" else 0), 0, 0, kind.itemsize) + struct.pack("<HH", 0, 8 * kind.itemsize)


def space(shape):
    return struct.pack("<BBBBI", 1, len(shape), 0, 0, 0) + b"".join(struct.pack("<Q", n) for n in shape)


class Maker:
    """A file that grows; addresses are known as its parts are put."""

    def __init__(self, version=0):
        self.version, self.out = version, bytearray(96 if version == 0 else 48)

    def put(self, data):
        at = len(self.out)
        self.out += pad(data)
        return at

    def header(self, messages, split=False):
        if self.version == 0:
            pack = lambda ms: b"".join(struct.pack("<HHBBBB", k, len(pad(b)), 0, 0, 0, 0) + pad(b) for k, b in ms)
            if split:
                rest = pack(messages[1:])
                messages = [messages[0], (hdf5.CONTINUES, struct.pack("<QQ", self.put(rest), len(rest)))]
            body = pack(messages)
            return self.put(struct.pack("<BBHII", 1, 0, len(messages), 1, len(body)) + bytes(4) + body)
        body = b"".join(struct.pack("<BHB", k, len(b), 0) + b for k, b in messages)
        return self.put(b"OHDR" + struct.pack("<BBI", 2, 2, len(body)) + body + bytes(4))

    def attribute(self, name, value):
        a = np.frombuffer(value.encode(), "S1") if isinstance(value, str) else np.atleast_1d(np.asarray(value))
        n, t, s = name.encode() + b"\0", datatype(a.dtype), space(a.shape)
        return hdf5.ATTRIBUTE, struct.pack("<BBHHH", 1, 0, len(n), len(t), len(s)) + pad(n) + pad(t) + pad(s) + a.tobytes()

    def group(self, members, attributes=()):
        if self.version:
            links = [(hdf5.LINK, struct.pack("<BBB", 1, 0, len(n)) + n.encode() + struct.pack("<Q", to)) for n, to in members.items()]
            return self.header([*links, *attributes])
        names, places = bytearray(8), {}
        for n in members:
            places[n] = len(names)
            names += pad(n.encode() + b"\0")
        heap = self.put(b"HEAP" + bytes(4) + struct.pack("<QQQ", len(names), NO, self.put(bytes(names))))
        nodes = []
        ordered = sorted(members)
        for i in range(0, len(ordered), 3):  # few to a node, so that a tree has several
            part = ordered[i : i + 3]
            nodes.append(self.put(b"SNOD" + struct.pack("<BBH", 1, 0, len(part)) + b"".join(struct.pack("<QQ", places[n], members[n]) + bytes(24) for n in part)))
        tree = self.put(b"TREE" + struct.pack("<BBHQQ", 0, 0, len(nodes), NO, NO) + b"".join(struct.pack("<QQ", 0, n) for n in nodes) + bytes(8))
        return self.header([(hdf5.TABLE, struct.pack("<QQ", tree, heap)), *attributes])

    def tree(self, entries, rank):
        """Leaves of three chunks below one node."""
        key = lambda size, mask, origin: struct.pack("<II", size, mask) + b"".join(struct.pack("<Q", o) for o in (*origin, 0))
        leaves = []
        for i in range(0, len(entries), 3):
            part = entries[i : i + 3]
            leaves.append((part[0], self.put(b"TREE" + struct.pack("<BBHQQ", 1, 0, len(part), NO, NO) + b"".join(key(*e[:3]) + struct.pack("<Q", e[3]) for e in part) + key(0, 0, [0] * rank))))
        if len(leaves) == 1:
            return leaves[0][1]
        return self.put(b"TREE" + struct.pack("<BBHQQ", 1, 1, len(leaves), NO, NO) + b"".join(key(*e[:3]) + struct.pack("<Q", at) for e, at in leaves) + key(0, 0, [0] * rank))

    def dataset(self, a, chunk=None, filters=(), compact=False, skip=(), split=False, attributes=()):
        messages = [(hdf5.SPACE, space(a.shape)), (hdf5.DATATYPE, datatype(a.dtype))]
        if compact:
            messages.append((hdf5.LAYOUT, struct.pack("<BBH", 3, 0, a.nbytes) + a.tobytes()))
        elif chunk is None:
            messages.append((hdf5.LAYOUT, struct.pack("<BBQQ", 3, 1, self.put(a.tobytes()), a.nbytes)))
        else:
            entries = []
            for n, at in enumerate(np.ndindex(*(-(-s // c) for s, c in zip(a.shape, chunk, strict=True)))):
                origin, whole_ = [i * c for i, c in zip(at, chunk, strict=True)], np.zeros(chunk, a.dtype)
                part = a[tuple(slice(o, o + c) for o, c in zip(origin, chunk, strict=True))]
                whole_[tuple(slice(0, e) for e in part.shape)] = part
                if n in skip:
                    continue
                data, mask = whole_.tobytes(), 0
                for i, f in enumerate(filters):
                    if f == hdf5.DEFLATE and n == 0:
                        mask |= 1 << i  # left out for the first chunk
                    elif f == hdf5.DEFLATE:
                        data = zlib.compress(data)
                    elif f == hdf5.SHUFFLE:
                        data = np.frombuffer(data, np.uint8).reshape(-1, a.itemsize).T.tobytes()
                    elif f == hdf5.FLETCHER:
                        data += b"sums"
                entries.append((len(data), mask, origin, self.put(data)))
            messages.append((hdf5.LAYOUT, struct.pack("<BBBQ", 3, 2, a.ndim + 1, self.tree(entries, a.ndim)) + b"".join(struct.pack("<I", n) for n in (*chunk, a.itemsize))))
            if filters:
                messages.append((hdf5.FILTERS, struct.pack("<BB", 1, len(filters)) + bytes(6) + b"".join(struct.pack("<HHHH", f, 0, 0, 1) + struct.pack("<II", a.itemsize, 0) for f in filters)))
        return self.header([*messages, *attributes], split)

    def done(self, root):
        if self.version == 0:
            self.out[:96] = hdf5.MAGIC + struct.pack("<BBBBBBBB", 0, 0, 0, 0, 0, 8, 8, 0) + struct.pack("<HHI", 4, 16, 0) + struct.pack("<QQQQ", 0, NO, len(self.out), NO) + struct.pack("<QQ", 0, root) + bytes(24)
        else:
            self.out[:48] = hdf5.MAGIC + struct.pack("<BBBB", self.version, 8, 8, 0) + struct.pack("<QQQQ", 0, NO, len(self.out), root) + bytes(4)
        return bytes(self.out)


def saved(data):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/a.h5"
    zarr.put(path, data)
    return path


@pytest.mark.parametrize("version", [0, 2])
def test_groups_and_layouts(spark, version):
    m = Maker(version)
    big = RNG.integers(-900, 900, (7, 30, 21)).astype(">i2")
    cases = {"chunked": (big, {"chunk": (3, 8, 8), "filters": (hdf5.SHUFFLE, hdf5.DEFLATE)}), "plain": (big[:3].astype("<f4"), {}), "small": (big[0, :4, :5].astype("u1"), {"compact": True}), "summed": (big[:2].astype("<u8"), {"chunk": (1, 16, 16), "filters": (hdf5.DEFLATE, hdf5.FLETCHER), "split": version == 0})}
    inner = {n: m.dataset(a, **o) for n, (a, o) in cases.items()}
    empty = {f"g{i}": m.group({}) for i in range(7)}
    path = saved(m.done(m.group({"data": m.group(inner, [m.attribute("scale", [1.5, 2.5]), m.attribute("name", "cells")])} | empty)))
    file = hdf5.opened(path)
    assert [n for n, _ in file.datasets()] == [f"/data/{n}" for n in sorted(cases)] and sorted(file.item(file.root).members) == sorted(["data", *empty])
    assert file.find("data").attributes == {"scale": [1.5, 2.5], "name": "cells"} and hdf5.largest(path) == "/data/chunked"
    for name, (a, _) in cases.items():
        info = hdf5.describe(path, f"/data/{name}")
        assert info["shape"] == list(a.shape) and info["dtype"] == a.dtype.newbyteorder("=").name
        assert (whole(hdf5.read_chunks(spark, path, f"/data/{name}"), a.shape, info["dtype"]) == a).all()
    assert hdf5.read_chunks(spark, path, "/data/chunked").rdd.getNumPartitions() == math.ceil(3 * 4 * 3 / 3)
    with pytest.raises(FileNotFoundError):
        hdf5.describe(path, "/data/none")
    with pytest.raises(ValueError, match="no array"):
        hdf5.describe(path, "/data")


def test_imaris(spark):
    m = Maker()
    a = RNG.integers(0, 900, (11, 2, 5, 9, 8)).astype("<u2")
    times = {f"TimePoint {t}": m.group({f"Channel {c}": m.group({"Data": m.dataset(a[t, c], (2, 4, 4), (hdf5.DEFLATE,))}) for c in range(2)}) for t in range(11)}
    image = m.group({}, [m.attribute(k, v) for k, v in {"X": "8", "Y": "9", "Z": "5", "ExtMin0": "0", "ExtMax0": "4.0", "ExtMin1": "0", "ExtMax1": "4.5", "ExtMin2": "-5", "ExtMax2": "5", "Unit": "um"}.items()])
    path = saved(m.done(m.group({"DataSet": m.group({"ResolutionLevel 0": m.group(times)}), "DataSetInfo": m.group({"Image": image})})))
    info = hdf5.describe_imaris(path)
    assert (info["axes"], info["shape"], info["voxel"]) == (["t", "c", "z", "y", "x"], [11, 2, 5, 9, 8], {"x": 500.0, "y": 500.0, "z": 2000.0})
    assert (whole(hdf5.read_imaris(spark, path), a.shape, "uint16") == a).all()  # TimePoint 10 comes after 9


def test_broken_files_are_errors():
    m = Maker()
    a = RNG.integers(0, 99, (9, 8)).astype("u1")
    data = m.done(m.group({"a": m.dataset(a, (4, 4), (hdf5.DEFLATE,)), "b": m.dataset(a)}))

    def walk(data):
        read = lambda at, n: data[at : at + n]
        file = hdf5.File(read)
        for _, item in file.datasets():
            if item.layout[0] == "chunked":
                for leaf in file.leaves(item.layout[1], 1, 8 + 8 * len(item.layout[2])):
                    for key, address in leaf:
                        hdf5.undone(file.at(address, int.from_bytes(key[:4], "little")), item.filters, 0, 16)

    for cut in (0, 5, 20, 95, 200, len(data) - 100):
        with pytest.raises(ValueError):
            walk(data[:cut])
    for _ in range(1500):
        bad = bytearray(data)
        bad[RNG.integers(0, len(bad))] ^= 1 << int(RNG.integers(0, 8))
        try:
            walk(bytes(bad))
        except (ValueError, FileNotFoundError):
            pass


def test_what_is_not_read():
    m = Maker(2)
    dense = m.header([(hdf5.LINK_INFO, struct.pack("<BBQQ", 0, 0, 4096, 4096))])
    with pytest.raises(ValueError, match="heap"):
        hdf5.File(lambda at, n, d=m.done(dense): d[at : at + n]).datasets()
    with pytest.raises(ValueError, match="filter 32000"):
        hdf5.undone(b"x", [(32000, [])], 0, 1)
    with pytest.raises(ValueError, match="version 4"):
        hdf5._layout(b"\x04\x02")


def test_files_are_converted(spark):
    a = RNG.integers(0, 900, (7, 12, 10)).astype("<u2")
    m = Maker()
    path = saved(m.done(m.group({"small": m.dataset(a[:2]), "big": m.dataset(a, (3, 8, 8), (hdf5.DEFLATE,), skip=(0,), attributes=[m.attribute("element_size_um", [2.0, 0.5, 0.5])])})))
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    job = convert.plan(spark, path)
    assert (job.shape, job.axes, job.voxel) == ([7, 12, 10], ["z", "y", "x"], [2000.0, 500.0, 500.0])
    done = convert.convert(spark, path, f"{folder}/a.zarr", convert.Options(order="xyz", chunk=4))
    want = a.copy()
    want[:3, :8, :8] = 0  # the chunk that is not stored
    assert (whole(zarr.read_chunks(spark, done["array"]), (10, 12, 7), "uint16") == want.transpose(2, 1, 0)).all()
    small = convert.convert(spark, path, f"{folder}/b.zarr", convert.Options(dataset="/small"))
    assert (whole(zarr.read_chunks(spark, small["array"]), (2, 12, 10), "uint16") == a[:2]).all()


def test_sizes_in_attributes():
    sizes = convert.attribute_voxel
    assert sizes({"element_size_um": [2.0, 0.5, 0.25]}) == {"z": 2000.0, "y": 500.0, "x": 250.0} and sizes({}) == {}
    assert sizes({"voxel_size_x": 4.0, "dx": 9.0, "dy": 5, "scale_z": 2.0, "unit": "um"}) == {"x": 4000.0, "y": 5000.0, "z": 2000.0}
    assert sizes({"pixel_size_x": 8.0}) == {"x": 8.0} and sizes({"dx": "8", "units": "mm"}) == {}

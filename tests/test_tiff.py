"""TIFF files as volumes: hand-made files of every layout, stacks, descriptions, and broken files."""

import struct
import tempfile
import zlib

import numpy as np
import pytest
from test_resample import chunked, whole

from chunkframe.sources import convert, tiff, zarr

RNG = np.random.default_rng(6)


def lzw(data):
    """A plain encoder: a table that grows from single bytes, cleared when it is full."""
    table, out, bits, n, width = {bytes([i]): i for i in range(256)}, bytearray(), 0, 0, 9

    def put(code):
        nonlocal bits, n
        bits, n = bits << width | code, n + width
        while n >= 8:
            out.append(bits >> n - 8 & 255)
            n -= 8
            bits &= (1 << n) - 1

    put(256)
    size, held = 258, b""
    for b in data:
        one = held + bytes([b])
        if one in table:
            held = one
            continue
        put(table[held])
        table[one], size = size, size + 1
        width = max(9, size.bit_length()) if size < 4096 else 12
        if size == 4094:
            put(256)
            table, size, width = {bytes([i]): i for i in range(256)}, 258, 9
        held = bytes([b])
    if held:
        put(table[held])
        size += 1
        width = min(max(9, size.bit_length()), 12)
    put(257)
    if n:
        out.append(bits << 8 - n & 255)
    return bytes(out)


def packbits(data):
    out = bytearray()
    for i in range(0, len(data), 100):
        part = data[i : i + 100]
        out += bytes([257 - len(part)]) + part[:1] if len(set(part)) == 1 and len(part) > 1 else bytes([len(part) - 1]) + part
    return bytes(out)


def file_of(pages, order="<", big=False, compression=1, tile=None, rows=5, predictor=1, planar=1, description=""):
    """A file of pages (height, width) or (height, width, sample)."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(f"{order}H", 43 if big else 42) + (struct.pack(f"{order}HHQ", 8, 0, 0) if big else struct.pack(f"{order}I", 0)))
    link_at, link = (8, "Q") if big else (4, "I")
    squeeze = {1: bytes, 5: lzw, 8: zlib.compress, 32773: packbits}[compression]
    for page in pages:
        a = np.asarray(page)
        a = a[:, :, None] if a.ndim == 2 else a
        high, wide = tile or (rows, a.shape[1])
        blocks = []
        for layer in range(a.shape[2]) if planar == 2 else [slice(None)]:
            for y in range(0, a.shape[0], high):
                for x in range(0, a.shape[1], wide):
                    part = a[y : y + high, x : x + wide, layer]
                    part = part[:, :, None] if part.ndim == 2 else part
                    if tile:
                        part = np.pad(part, ((0, high - part.shape[0]), (0, wide - part.shape[1]), (0, 0)))
                    if predictor == 2:
                        part = np.diff(part, axis=1, prepend=np.zeros_like(part[:, :1]))
                    blocks.append(squeeze(part.astype(a.dtype.newbyteorder(order)).tobytes()))
        starts = []
        for b in blocks:
            starts.append(len(out))
            out += b
        n = a.shape[2]
        fields = [(256, 3, [a.shape[1]]), (257, 3, [a.shape[0]]), (258, 3, [8 * a.itemsize] * n), (259, 3, [compression]), (277, 3, [n]), (284, 3, [planar]), (317, 3, [predictor]), (339, 3, [{"u": 1, "i": 2, "f": 3}[a.dtype.kind]] * n)]
        fields += [(322, 3, [wide]), (323, 3, [high]), (324, 4, starts), (325, 4, [len(b) for b in blocks])] if tile else [(278, 3, [rows]), (273, 4, starts), (279, 4, [len(b) for b in blocks])]
        if description:
            fields.append((270, 2, description.encode() + b"\0"))
        body = b""
        for tag, code, values in sorted(fields):
            data = values if isinstance(values, bytes) else struct.pack(f"{order}{len(values)}{ {3: 'H', 4: 'I'}[code] }", *values)
            count = len(data) // {2: 1, 3: 2, 4: 4}[code]
            room = 8 if big else 4
            if len(data) > room:
                place = struct.pack(f"{order}{link}", len(out))
                out += data
            else:
                place = data.ljust(room, b"\0")
            body += struct.pack(f"{order}HH{link}", tag, code, count) + place
        out[link_at : link_at + struct.calcsize(link)] = struct.pack(f"{order}{link}", len(out))
        out += struct.pack(f"{order}{'Q' if big else 'H'}", len(fields)) + body
        link_at = len(out)
        out += struct.pack(f"{order}{link}", 0)
    return bytes(out)


def reader(data):
    return lambda at, n: data[at : at + n]


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize("compression", [1, 5, 8, 32773])
def test_layouts(order, big, compression):
    for dtype in ("uint8", "uint16", "int32", "float32"):
        for shape in ((13, 17), (16, 16, 3)):
            a = (RNG.integers(0, 90, shape) // 30 * 7).astype(dtype)
            for tile in (None, (8, 16)):
                for predictor in (1, 2) if dtype != "float32" else (1,):
                    for planar in (1, 2) if a.ndim == 3 else (1,):
                        data = file_of([a, a + 1], order, big, compression, tile, predictor=predictor, planar=planar)
                        found = list(tiff.pages(reader(data)))
                        want = a if a.ndim == 2 else a.transpose(2, 0, 1)
                        assert len(found) == 2 and (tiff.read_page(reader(data), found[0]) == want).all() and (tiff.read_page(reader(data), found[1]) == want + 1).all()


def test_long_lzw():
    for data in (RNG.bytes(60000), b"ab" * 40000, bytes(70000)):
        assert tiff.unpack_lzw(lzw(data), len(data)) == data


def test_descriptions():
    assert tiff.axes_of("ImageJ=1.53\nimages=24\nchannels=2\nslices=4\nframes=3\nspacing=0.5\nunit=um\n", 24) == ("tzc", [3, 4, 2], {"z": 500.0})
    assert tiff.axes_of("ImageJ=1.53\nslices=4\n", 9) == ("z", [9], {}) and tiff.axes_of("", 5) == ("z", [5], {}) and tiff.axes_of("anything slices=5", 5)[0] == "z"
    ome = '<OME><Image><Pixels DimensionOrder="XYCZT" SizeX="4" SizeY="4" SizeC="2" SizeZ="3" SizeT="1" PhysicalSizeX="0.25" PhysicalSizeZ="2" PhysicalSizeZUnit="µm"/></Image></OME>'
    assert tiff.axes_of(ome, 6) == ("zc", [3, 2], {"x": 250.0, "z": 2000.0})


def test_broken_files_are_errors():
    a = RNG.integers(0, 99, (13, 17)).astype("uint8")
    data = file_of([a, a], compression=8)
    for bad in (b"", b"II*", b"XX*\0" + data[4:], data[:-6], data[:40]):
        with pytest.raises(ValueError):
            for p in tiff.pages(reader(bad)):
                tiff.read_page(reader(bad), p)
    loop = bytearray(data)
    loop[-4:] = data[4:8]  # the last directory leads to the first
    with pytest.raises(ValueError, match="go round"):
        list(tiff.pages(reader(bytes(loop))))
    for _ in range(400):
        bad = bytearray(data)
        bad[RNG.integers(0, len(bad))] ^= 1 << int(RNG.integers(0, 8))
        try:
            for p in tiff.pages(reader(bytes(bad))):
                if p.width * p.height < 1 << 20:
                    tiff.read_page(reader(bytes(bad)), p)
        except ValueError:
            pass


def test_files_in_natural_order_and_pages_of_one(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    a = RNG.integers(0, 900, (12, 9, 11)).astype("uint16")
    for i in range(12):
        zarr.put(f"{folder}/s/img_{i + 1}.tif", file_of([a[i]], compression=8, predictor=2))
    zarr.put(f"{folder}/s/notes.txt", b"none")
    info = tiff.describe(spark, f"{folder}/s")
    assert (info["shape"], info["axes"], info["dtype"]) == ([12, 9, 11], ["z", "y", "x"], "uint16")
    assert (whole(tiff.read_chunks(spark, f"{folder}/s"), a.shape, "uint16") == a).all()
    zarr.put(f"{folder}/m/one.tif", file_of(list(a), compression=5, description="ImageJ=1\nimages=12\nchannels=3\nslices=4\n"))
    info = tiff.describe(spark, f"{folder}/m/one.tif")
    assert (info["shape"], info["axes"]) == ([4, 3, 9, 11], ["z", "c", "y", "x"])
    chunks = tiff.read_chunks(spark, f"{folder}/m/one.tif", run=5)
    assert chunks.rdd.getNumPartitions() == 3 and (whole(chunks, (4, 3, 9, 11), "uint16") == a.reshape(4, 3, 9, 11)).all()
    color = RNG.integers(0, 255, (2, 9, 11, 3)).astype("uint8")
    for i in range(2):
        zarr.put(f"{folder}/c/p{i}.TIFF", file_of([color[i]]))
    assert (whole(tiff.read_chunks(spark, f"{folder}/c"), (2, 3, 9, 11), "uint8") == color.transpose(0, 3, 1, 2)).all() and tiff.describe(spark, f"{folder}/c")["axes"] == ["z", "c", "y", "x"]
    zarr.put(f"{folder}/s/img_13.tif", file_of([a[0][:5]]))
    with pytest.raises(ValueError, match="different sizes"):
        tiff.describe(spark, f"{folder}/s")
    with pytest.raises(FileNotFoundError):
        tiff.describe(spark, f"{folder}")


def test_pages_are_written(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for dtype in ("int16", "uint8", "float32"):
        a = RNG.integers(0, 99, (11, 70, 30)).astype(dtype)
        assert tiff.write_pages(chunked(spark, a, (1, 70, 30)), f"{folder}/{dtype}") == 11
        assert (whole(tiff.read_chunks(spark, f"{folder}/{dtype}"), a.shape, dtype) == a).all()


def test_a_stack_is_converted(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    a = RNG.integers(0, 900, (6, 9, 11)).astype("uint16")
    zarr.put(f"{folder}/in.tif", file_of(list(a), compression=8, description="ImageJ=1\nimages=6\nslices=6\nspacing=0.5\nunit=um\n"))
    job = convert.plan(spark, f"{folder}/in.tif", convert.Options(order="xyz", box={"z": (2, 4)}))
    assert (job.shape, job.voxel, job.source_chunk) == ([11, 9, 4], [1.0, 1.0, 500.0], [1, 9, 11])
    done = convert.convert(spark, f"{folder}/in.tif", f"{folder}/out.zarr", convert.Options(order="xyz", box={"z": (2, 4)}))
    assert (whole(zarr.read_chunks(spark, done["array"]), (11, 9, 4), "uint16") == a[2:].transpose(2, 1, 0)).all()

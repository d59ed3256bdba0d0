"""Blosc frames, checksums, shards by range, the writer of the data source, redistribution, written pyramids, conversion."""

import json
import os
import tempfile

import numpy as np
import pytest
from test_resample import chunked, whole

from chunkframe.operators import blocks, redistribute
from chunkframe.sources import blosc, checksums, containers, convert, elements, multiscale, zarr

RNG = np.random.default_rng(8)


def new():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def load(spark, path, dtype=None):
    info = zarr.describe(spark, path)
    return whole(zarr.read_chunks(spark, path), info["shape"], dtype or np.dtype(info["dtype"]).newbyteorder("="))


# -- blosc and checksums --------------------------------------------------------------------


@pytest.mark.parametrize("codec", ["zstd", "lz4", "zlib"])
@pytest.mark.parametrize("shuffle", [0, 1, 2, -1])
def test_blosc_round_trip(codec, shuffle):
    for n in (0, 1, 7, 999, 40000, 300001):
        data = np.cumsum(RNG.integers(0, 3, n // 4 + 1)).astype("<u4").tobytes()[:n]
        for size in (1, 2, 4, 8, 20):
            for block in (0, 4096):
                frame = blosc.encode(data, size, codec, 5, shuffle, block)
                assert blosc.decode(frame) == data
                assert len(frame) <= n + 16


def test_blosc_frames_made_by_hand():
    data = np.arange(64, dtype="<u2").tobytes()
    head = lambda flags, total, block, size: bytes([2, 1, flags, 2]) + np.array([total, block, size], "<u4").tobytes()
    assert blosc.decode(head(2, 128, 128, 144) + data) == data  # stored
    literal = bytes([31]) + data[:32] + b"".join(bytes([31]) + data[i : i + 32] for i in (32, 64, 96))
    block = len(literal).to_bytes(4, "little") + literal
    assert blosc.decode(head(0 | 16, 128, 128, 20 + len(block)) + (20).to_bytes(4, "little") + block) == data  # blosclz literals
    assert blosc.blosclz(bytes([2]) + b"abc" + bytes([(5 << 5) | 0, 2]) + bytes([0]) + b"!", 12) == b"abc" + b"abcabca" + b"!"
    assert blosc.blosclz(bytes([0]) + b"x" + bytes([(7 << 5), 255, 10, 0]), 500) == b"x" * (1 + 6 + 255 + 10 + 3)
    far = bytes(range(256)) * 40
    stream = b"".join(bytes([31]) + far[i : i + 32] for i in range(0, len(far), 32))
    assert blosc.blosclz(stream + bytes([(1 << 5) | 31, 255, 4, 0]), len(far) + 3) == far + far[-(8191 + 1024 + 1) :][:3]


def test_broken_blosc_frames_are_errors():
    data = np.cumsum(RNG.integers(0, 3, 30000)).astype("<u4").tobytes()
    for codec in ("zstd", "lz4", "zlib"):
        frame = bytearray(blosc.encode(data, 4, codec, block=16384))
        for cut in (0, 5, 15, 16, 30, len(frame) - 1):
            with pytest.raises(ValueError):
                blosc.decode(bytes(frame[:cut]))
        for _ in range(200):
            bad = bytearray(frame)
            bad[RNG.integers(0, len(bad))] ^= 1 << int(RNG.integers(0, 8))
            try:
                blosc.decode(bytes(bad))
            except ValueError:
                pass
    for bad in (bytes([40]), bytes([3]) + b"ab", bytes([0]) + b"a" + bytes([(7 << 5), 255]), bytes([0]) + b"a" + bytes([(1 << 5), 9])):
        with pytest.raises(ValueError):
            blosc.blosclz(bad, 99) and blosc._stream(bad, "blosclz", 99)


def test_checksums():
    def plain(data):
        crc = 0xFFFFFFFF
        for b in data:
            crc ^= b
            for _ in range(8):
                crc = crc >> 1 ^ (checksums.POLYNOMIAL if crc & 1 else 0)
        return crc ^ 0xFFFFFFFF

    assert checksums.crc32c(b"123456789") == 0xE3069283
    for n in (0, 1, 2, 31, 1023, 1024, 1025, 2047, 4097, 10001):
        data = RNG.bytes(n)
        assert checksums.crc32c(data) == plain(data)
    assert checksums.crc32c(bytes(5000)) == plain(bytes(5000))


@pytest.mark.parametrize("format", ["zarr3", "zarr2", "n5"])
@pytest.mark.parametrize("codec", ["blosc", "blosc:lz4"])
def test_blosc_arrays(spark, format, codec):
    a = RNG.integers(0, 900, (30, 17)).astype("uint16")
    path = new() + "/a"
    zarr.write_chunks(chunked(spark, a, (8, 5)), path, [30, 17], [8, 5], "uint16", format=format, codec=codec)
    assert (load(spark, path) == a).all()
    file = f"{path}/{ {'zarr3': 'c/0/0', 'zarr2': '0/0', 'n5': '0/0'}[format] }"
    with open(file, "r+b") as f:
        f.truncate(os.path.getsize(file) - 3)
    with pytest.raises(Exception, match="frame|stream"):
        load(spark, path)


# -- shards by range ------------------------------------------------------------------------


def test_a_box_reads_the_index_and_the_chunks_it_touches(spark, monkeypatch):
    a = RNG.integers(0, 2**31, (256, 256)).astype("int32")
    path = new() + "/a"
    zarr.write_chunks(chunked(spark, a, (16, 16)), path, [256, 256], [16, 16], "int32", codec=None, shard=[128, 128])
    info, read = zarr.describe(spark, path), []
    real = zarr.fetch_range
    monkeypatch.setattr(zarr, "fetch_range", lambda p, first, n: read.append(n) or real(p, first, n))
    monkeypatch.setattr(zarr, "fetch", lambda p: pytest.fail("a whole shard was read"))
    reader = elements.ElementReader(path, info, ["y", "x"], "int32", [(20, 40), (130, 140)])
    got = [tuple(r.values()) for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist()]
    assert sorted(got) == [(y, x, int(a[y, x])) for y in range(20, 40) for x in range(130, 140)]
    assert sorted(read) == [16 * 16 * 4] * 2 + [64 * 16 + 4]  # one shard's index, two chunks of 1024 bytes; 256 KB are stored


def test_a_shard_is_read_by_several_tasks(spark, monkeypatch):
    a = RNG.integers(0, 99, (64, 64)).astype("uint8")
    path = new() + "/a"
    zarr.write_chunks(chunked(spark, a, (8, 8)), path, [64, 64], [8, 8], "uint8", shard=[64, 64])
    monkeypatch.setattr(zarr, "TASK_BYTES", 640)
    chunks = zarr.read_chunks(spark, path)
    assert chunks.rdd.getNumPartitions() == 7 and (whole(chunks, a.shape, "uint8") == a).all()
    reader = elements.ElementReader(path, zarr.describe(spark, path), ["y", "x"], "uint8", [(0, 64), (0, 64)])
    assert len(reader.partitions()) == 7
    monkeypatch.setattr(elements, "PARTITIONS", 3)
    assert len(reader.partitions()) == 3


def test_a_shard_is_written_as_its_chunks_come(spark, monkeypatch):
    layout = zarr.Layout([64, 64], [8, 8], "uint8", codec=None, shard=[64, 64])
    path, alive = new() + "/a", []

    def rows():
        for y in range(0, 64, 8):
            for x in range(0, 64, 8):
                stage = [f for _, _, names in os.walk(path) for f in names]
                alive.append(len(stage))
                yield [y, x], [8, 8], bytes([y + x]) * 64, "|u1"

    assert list(layout.write(rows(), path)) == ["c/0/0"] and max(alive) == 1 and os.listdir(f"{path}/c/0") == ["0"]
    twice = [([0, 0], [8, 8], bytes(64), "|u1")] * 2
    with pytest.raises(ValueError, match="twice"):
        list(layout.write(iter(twice), path))
    with pytest.raises(ValueError, match="no chunk"):
        list(layout.write(iter([([4, 0], [8, 8], bytes(64), "|u1")]), path))


def test_broken_shards_are_errors(spark):
    a = RNG.integers(0, 99, (16, 16)).astype("uint8")
    path = new() + "/a"
    zarr.write_chunks(chunked(spark, a, (8, 8)), path, [16, 16], [8, 8], "uint8", shard=[16, 16])
    with open(f"{path}/c/0/0", "rb") as f:
        data = f.read()
    for bad, match in ((data[:-1], "checksum|cut short"), (data[:20], "cut short"), (data[:-9] + bytes([data[-9] ^ 1]) + data[-8:], "checksum")):
        zarr.put(f"{path}/c/0/0", bad)
        with pytest.raises(Exception, match=match):
            load(spark, path)


# -- the writer of the data source ----------------------------------------------------------


def save(df, path, mode="overwrite", **options):
    df.select("origin", "extent", "payload", "dtype").write.format("chunked_array").mode(mode).options(**options).save(path)


@pytest.mark.parametrize("options", [{}, {"store": "zarr2", "codec": "blosc"}, {"store": "n5"}, {"shard": "16,16", "codec": "zstd", "names": "y,x"}, {"codec": "none", "attributes": '{"k": 1}', "fill": "7"}])
def test_chunks_are_written_with_a_commit(spark, options):
    elements.register(spark)
    a = RNG.integers(0, 900, (30, 20)).astype("int32")
    folder = new()
    path, given = f"{folder}/a", {"shape": "30,20", "chunk": "8,8"} | options
    arranged = lambda df: zarr.by_shard(df, [16, 16]) if "shard" in options else df
    save(arranged(chunked(spark, a, (8, 8))), path, **given)
    assert (load(spark, path) == a).all() and os.listdir(folder) == ["a"]
    b = a + 1
    save(arranged(chunked(spark, b, (8, 8)).where("origin[0] < 16")), path, "append")  # the layout is that of the array
    mixed = np.vstack([b[:16], a[16:]])
    assert (load(spark, path) == mixed).all()
    bad = chunked(spark, b, (8, 8)).repartition(4).selectExpr("origin", "extent", "CASE WHEN origin[0] = 24 THEN raise_error('lost') ELSE payload END AS payload", "dtype")
    for mode in ("overwrite", "append"):
        with pytest.raises(Exception, match="lost"):
            save(bad, path, mode, **given)
        assert (load(spark, path) == mixed).all() and os.listdir(folder) == ["a"]  # nothing is left of a job that failed
    with pytest.raises(Exception, match="twice"):
        save(chunked(spark, a, (8, 8)).union(chunked(spark, a, (8, 8))).repartition(8), path, **given)
    assert (load(spark, path) == mixed).all() and os.listdir(folder) == ["a"]
    with pytest.raises(Exception, match="another layout"):
        save(chunked(spark, a, (10, 10)), path, "append", **(given | {"chunk": "10,10", "shard": ""}))
    with pytest.raises(Exception, match="FileExistsError"):
        save(chunked(spark, a, (8, 8)), path, "append", exists="error", **given)
    with pytest.raises(Exception, match="lack"):
        chunked(spark, a, (8, 8)).select("origin").write.format("chunked_array").mode("append").options(**given).save(path)


def test_chunks_are_read_as_chunks(spark):
    elements.register(spark)
    a = RNG.integers(0, 900, (30, 20)).astype("int32")
    path = new() + "/a"
    zarr.write_chunks(chunked(spark, a, (8, 8)), path, [30, 20], [8, 8], "int32", names=["y", "x"])
    got = spark.read.format("chunked_array").options(form="chunks", box="y=9:17").load(path).collect()
    assert sorted(r["origin"] for r in got) == [[y, x] for y in (8, 16) for x in (0, 8, 16)]


def test_the_old_array_stays_if_the_new_one_cannot_be_moved(spark, monkeypatch):
    folder = new()
    zarr.put(f"{folder}/a/old", b"1")
    with pytest.raises(Exception):
        zarr.take_over(f"{folder}/none", f"{folder}/a")
    assert os.listdir(folder) == ["a"] and os.listdir(f"{folder}/a") == ["old"]
    zarr.put(f"{folder}/b/new", b"2")
    zarr.take_over(f"{folder}/b", f"{folder}/a")
    assert os.listdir(folder) == ["a"] and os.listdir(f"{folder}/a") == ["new"]


def test_labels_added_at_once_are_all_listed(spark):
    from concurrent.futures import ThreadPoolExecutor

    root = new() + "/c.zarr"
    zarr.put(f"{root}/zarr.json", b"{}")
    a, axes = np.ones((8, 8), "int32"), [{"name": n, "type": "space"} for n in "yx"]
    add = lambda i: containers.add_label(spark, root, f"l{i}", chunked(spark, a, (8, 8)), [8, 8], [8, 8], axes, [1.0, 1.0], "int32")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(add, range(4)))
    assert zarr.read_json(spark, f"{root}/zarr.json")["attributes"]["ome"]["labels"] == ["l0", "l1", "l2", "l3"]
    with containers.locked(spark, root), pytest.raises(TimeoutError):
        with containers.locked(spark, root, seconds=0.2):
            pass


# -- redistribution -------------------------------------------------------------------------


def test_redistribution_in_one_pass(spark):
    a = RNG.integers(-500, 500, (3, 20, 17)).astype("int16")
    chunks = chunked(spark, a, (2, 6, 7))
    cases = [
        ({"shape": [3, 20, 17], "chunk": [1, 8, 8]}, a),
        ({"shape": [2, 9, 10], "chunk": [2, 4, 3], "start": [1, 5, 7]}, a[1:3, 5:14, 7:17]),
        ({"shape": [17, 20, 3], "chunk": [5, 20, 3], "order": [2, 1, 0]}, a.transpose(2, 1, 0)),
        ({"shape": [1, 3, 1, 20, 17], "chunk": [1, 1, 1, 7, 17], "order": [None, 0, None, 1, 2]}, a[None, :, None]),
        ({"shape": [17, 10], "chunk": [6, 6], "order": [2, 1], "start": [0, 3], "pick": {0: 2}}, a[2].T[:, 3:13]),
        ({"shape": [3, 20, 17], "chunk": [3, 20, 17], "dtype": "uint8"}, np.clip(a, 0, 255).astype("uint8")),
        ({"shape": [3, 22, 20], "chunk": [3, 8, 8], "start": [0, -2, 0], "fill": 9}, np.pad(a, ((0, 0), (2, 0), (0, 3)), constant_values=9)),
    ]
    for options, want in cases:
        for source in (None, [2, 6, 7]):
            got = redistribute.redistribute(chunks, source=source, **options)
            assert (whole(got, want.shape, want.dtype) == want).all(), options
    with pytest.raises(Exception, match="pick a place"):
        redistribute.redistribute(chunks, [20, 17], [8, 8], order=[1, 2]).collect()
    with pytest.raises(ValueError, match="twice"):
        redistribute.redistribute(chunks, [20, 20], [8, 8], order=[1, 1])


def test_nested_grids_need_no_exchange(spark):
    a = RNG.integers(0, 500, (20, 24)).astype("int32")
    chunks = chunked(spark, a, (8, 12))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    inside = redistribute.redistribute(chunks, [12, 24], [4, 6], start=[8, 0], source=[8, 12])
    assert "Exchange" not in plan(inside) and (whole(inside, (12, 24), "int32") == a[8:]).all()
    across = redistribute.redistribute(chunks, [20, 24], [5, 6], source=[8, 12])
    assert plan(across).count("Exchange hashpartitioning") == 1 and (whole(across, a.shape, "int32") == a).all()


def test_missing_chunks_are_filled(spark):
    a = RNG.integers(0, 9, (20, 20)).astype("float32")
    some = redistribute.redistribute(chunked(spark, a, (10, 10)).where("chunk_id <> 2"), [20, 20], [5, 5])
    want = a.copy()
    want[10:, :10] = -1
    assert (whole(redistribute.with_missing(some, [20, 20], [5, 5], "float32", -1), a.shape, "float32") == want).all()


@pytest.mark.parametrize("method", ["mean", "mode", "median", "min", "max", "stride"])
def test_blocks_across_chunks(spark, method):
    a = RNG.integers(0, 9, (21, 18)).astype("uint8")
    got = redistribute.downsample_chunks(chunked(spark, a, (5, 7)), [21, 18], [2, 3], [4, 4], method)
    assert (whole(got, (11, 6), "uint8") == blocks.reduce_block(a, [2, 3], method)).all()


@pytest.mark.parametrize("dtype", ["uint64", "int64"])
def test_means_at_the_ends_of_64_bits(spark, dtype):
    low, high = np.iinfo(dtype).min, np.iinfo(dtype).max
    values = [high, high, high, high - 1, low, low, low + 1, low, high, low, high // 2, 3, high, high, high - 2, high - 1] + [int(v) for v in RNG.integers(low, high, 20, dtype=dtype)]
    a = np.array(values, dtype).reshape(6, 6)
    for factor in ([2, 2], [4, 3], [6, 5]):
        got = blocks.reduce_block(a, factor, "mean")
        for at in np.ndindex(got.shape):
            block = [int(v) for v in a[tuple(slice(i * f, (i + 1) * f) for i, f in zip(at, factor, strict=True))].ravel()]
            q, r = divmod(sum(block), len(block))
            assert int(got[at]) == q + (2 * r > len(block) or (2 * r == len(block) and q % 2 == 1))
    rows = blocks.from_chunks(chunked(spark, a, (6, 6)), ["y", "x"], dtype)
    by_element = {(r["y"], r["x"]): int(r["v"]) for r in blocks.downsample(rows, "mean", y=2, x=2).collect()}
    assert by_element == {at: int(v) for at, v in np.ndenumerate(blocks.reduce_block(a, [2, 2], "mean"))}


def test_casts_of_blocks():
    cast = redistribute.cast_block
    assert cast(np.array([-2.9, 300.0, np.nan, np.inf, -np.inf, 1e300]), "uint8").tolist() == [0, 255, 255, 255, 0, 255]
    assert cast(np.array([-2.9, 2.9, 9.3e18, -9.3e18]), "int64").tolist() == [-2, 2, 2**63 - 1, -(2**63)]
    assert cast(np.array([2**64 - 1, 5], "u8"), "int32").tolist() == [2**31 - 1, 5] and cast(np.array([-5, 2**62]), "uint64").tolist() == [0, 2**62]
    assert cast(np.array([1, 2], "u1"), "float32").dtype == np.float32


# -- written pyramids -----------------------------------------------------------------------


def container(spark, a, format="zarr3", method_shape=(8, 8), group="raw", shard=None):
    root = new() + "/c.zarr"
    options = {"format": format, "codec": "zstd"} | ({"shard": shard, "names": ["y", "x"]} if format == "zarr3" else {})
    zarr.write_chunks(chunked(spark, a, method_shape), f"{root}/{group}/s0", list(a.shape), list(method_shape), a.dtype.name, **options)
    axes = [{"name": n, "type": "space", "unit": "nanometer"} for n in "yx"]
    scale = {"name": "cells", "axes": axes, "datasets": [{"path": "s0", "coordinateTransformations": [{"type": "scale", "scale": [4.0, 8.0]}]}]}
    multiscale.write_group(f"{root}/{group}", {"attributes": {"ome": {"version": "0.5", "multiscales": [scale], "omero": {"kept": 1}}}} if format == "zarr3" else {"multiscales": [scale], "omero": {"kept": 1}}, format)
    return root


@pytest.mark.parametrize("format", ["zarr3", "zarr2"])
def test_a_pyramid_is_written_level_by_level(spark, format):
    a = RNG.integers(0, 999, (61, 40)).astype("uint16")
    root = container(spark, a, format, shard=[16, 16] if format == "zarr3" else None)
    steps = [[2, 1], [2, 2], [3, 2]]
    listed = multiscale.generate_pyramid(spark, f"{root}/raw", "mean", root=root, steps=steps)
    want, cumulative = a, np.array([1, 1])
    for i, f in enumerate(steps, 1):
        want, cumulative = blocks.reduce_block(want, f, "mean").astype("uint16"), cumulative * f
        info = zarr.describe(spark, f"{root}/raw/s{i}")
        assert (load(spark, f"{root}/raw/s{i}") == want).all() and info["attributes"]["chunkframe"]["cumulative_factor"] == cumulative.tolist()
        steps_told = listed[i]["coordinateTransformations"]
        assert steps_told[0]["scale"] == (cumulative * [4.0, 8.0]).tolist() and steps_told[1]["translation"] == ((cumulative - 1) * [4.0, 8.0] / 2).tolist()
    assert [x["path"] for x in listed] == ["s0", "s1", "s2", "s3"] and len(listed[0]["coordinateTransformations"]) == 1
    holder = lambda p: multiscale._holder(multiscale.read_group(spark, p, format), format)
    assert holder(f"{root}/raw")["omero"] == {"kept": 1} and holder(f"{root}/raw")["multiscales"][0]["datasets"] == listed
    assert [x["path"] for x in holder(root)["multiscales"][0]["datasets"]] == [f"raw/s{i}" for i in range(4)]
    assert not [f for _, dirs, files in os.walk(root) for f in (*dirs, *files) if ".tmp" in f or ".lock" in f]


def test_a_pyramid_goes_on_after_the_last_level(spark, monkeypatch):
    a = RNG.integers(0, 999, (64, 64)).astype("int32")
    one, two = container(spark, a), container(spark, a)
    steps = [[2, 2], [2, 2], [2, 2]]
    whole_run = multiscale.generate_pyramid(spark, f"{one}/raw", "median", root=one, steps=steps)
    real, made = multiscale._write_level, []

    def fails(spark, before, path, *rest):
        made.append(path[-2:])
        if len(made) == 3:
            raise RuntimeError("stopped")
        real(spark, before, path, *rest)

    monkeypatch.setattr(multiscale, "_write_level", fails)
    with pytest.raises(RuntimeError):
        multiscale.generate_pyramid(spark, f"{two}/raw", "median", root=two, steps=steps)
    made.append("again")
    assert multiscale.generate_pyramid(spark, f"{two}/raw", "median", root=two, steps=steps) == whole_run
    assert made == ["s1", "s2", "s3", "again", "s3"]
    for p in ("raw/zarr.json", "zarr.json", "raw/s3/zarr.json"):
        assert zarr.read_json(spark, f"{one}/{p}") == zarr.read_json(spark, f"{two}/{p}")
    assert (load(spark, f"{one}/raw/s3") == load(spark, f"{two}/raw/s3")).all()
    os.rename(f"{one}/raw/s2", f"{one}/raw/away")
    assert [x["path"] for x in multiscale.update_multiscale(spark, f"{one}/raw")] == ["s0", "s1"]  # up to the first gap
    with pytest.raises(ValueError, match="another shape"):
        multiscale.generate_pyramid(spark, f"{two}/raw", steps=[[4, 4]])


def test_labels_are_listed_by_name_above(spark):
    a = RNG.integers(0, 5, (32, 32)).astype("uint32")
    root = container(spark, a, group="labels/cells")
    multiscale.write_group(root, {"attributes": {"ome": {"multiscales": [{"datasets": [{"path": "raw/s0"}]}]}}}, "zarr3")
    multiscale.generate_pyramid(spark, f"{root}/labels/cells", "mode", root=root, steps=[[2, 2]])
    ome = lambda p: zarr.read_json(spark, f"{p}/zarr.json")["attributes"]["ome"]
    assert ome(f"{root}/labels")["labels"] == ["cells"] and ome(root)["labels"] == ["cells"] and ome(root)["multiscales"] == [{"datasets": [{"path": "raw/s0"}]}]


# -- conversion -----------------------------------------------------------------------------


def test_convert(spark):
    a = RNG.integers(0, 70000, (2, 11, 40, 30)).astype("uint32")
    folder = new()
    axes = [{"name": n, "type": "space", "unit": "micrometer"} | ({"type": "channel"} if n == "c" else {}) for n in "cxyz"]
    zarr.write_chunks(chunked(spark, a, (1, 4, 16, 16)), f"{folder}/in.zarr/s0", list(a.shape), [1, 4, 16, 16], "uint32", format="zarr2", codec="blosc")
    multiscale.write_group(f"{folder}/in.zarr", {"multiscales": [{"axes": axes, "datasets": [{"path": "s0", "coordinateTransformations": [{"type": "scale", "scale": [1.0, 0.25, 0.5, 2.0]}]}]}]}, "zarr2")
    options = convert.Options(box={"x": (2, 8), "z": (5, 20)}, pick={"c": 1}, order="zyx", dtype="uint16", chunk=(8, 16, 8), shard=(16, 32, 8), kind="image", group="raw", pyramid=True)
    job = convert.plan(spark, f"{folder}/in.zarr", options)
    assert (job.shape, job.order, job.start, job.pick, job.voxel, job.exchange, job.shard) == ([20, 40, 8], [3, 2, 1], [5, 0, 2], {0: 1}, [2000.0, 500.0, 250.0], True, [16, 32, 8])
    assert json.loads(convert.preview(spark, f"{folder}/in.zarr", options))["axes"] == ["z", "y", "x"]
    report = convert.convert(spark, f"{folder}/in.zarr", f"{folder}/out.zarr", options, today="2020-01-02")
    want = np.clip(a[1, 2:10, :, 5:25].transpose(2, 1, 0), 0, 65535).astype("uint16")
    assert (load(spark, f"{folder}/out.zarr/raw/s0") == want).all() and report["chunks"] == 9 and report["levels"] == 1
    root = zarr.read_json(spark, f"{folder}/out.zarr/zarr.json")["attributes"]
    assert root["ome"]["multiscales"][0]["datasets"][0]["path"] == "raw/s0"
    assert root["source"] == {"source_urls": {"in.zarr": f"{folder}/in.zarr"}, "bbox_origin_voxel": [5, 0, 2], "bbox_size_voxel": [20, 40, 8], "format": "zarr", "bbox_coordinate_order": "ZYX", "voxel_size_nm": [2000.0, 500.0, 250.0], "physical_extent_um": [40.0, 20.0, 2.0], "conversion_tool": "chunkframe", "conversion_date": "2020-01-02"}
    with pytest.raises(FileExistsError):
        convert.convert(spark, f"{folder}/in.zarr", f"{folder}/out.zarr", options)
    back = convert.convert(spark, f"{folder}/out.zarr", f"{folder}/back.n5", convert.Options(format="n5", codec="gzip", chunk=16))  # by the container's list of levels
    assert (load(spark, back["array"]) == want).all() and zarr.describe(spark, back["array"])["names"] == ["z", "y", "x"]
    five = convert.convert(spark, f"{folder}/back.n5", f"{folder}/five.zarr", convert.Options(format="zarr2", order="tczyx", codec="blosc:lz4"))
    assert (load(spark, five["array"]) == want[None, None]).all() and convert.plan(spark, f"{folder}/five.zarr").voxel == [1.0, 1.0, 2000.0, 500.0, 250.0]


def test_conversions_that_cannot_be(spark):
    a = np.zeros((2, 6, 6), "uint8")
    path = new() + "/a"
    zarr.write_chunks(chunked(spark, a, (1, 6, 6)), path, [2, 6, 6], [1, 6, 6], "uint8", names=["c", "y", "x"])
    bad = [{"box": {"y": (3, 4)}}, {"box": {"q": (0, 1)}}, {"box": {"y": (0, 0)}}, {"pick": {"c": 2}}, {"squeeze": ("c",)}, {"order": "yx"}, {"dtype": "bool"}, {"chunk": (1, 2)}, {"axes": "yy"}]
    for options in bad:
        with pytest.raises(ValueError):
            convert.plan(spark, path, convert.Options(**options))
    with pytest.raises(FileNotFoundError):
        convert.plan(spark, path + "/none")
    with pytest.raises(ValueError, match="preset"):
        convert.preset("none")
    assert convert.preset("viewer", chunk=32).shard == 1024 and convert.plan(spark, path, convert.Options(shard=1024)).shard == [1, 6, 6]


def test_many_conversions_stand_alone(spark):
    folder = new()
    for i in range(3):
        zarr.write_chunks(chunked(spark, np.full((4, 4), i, "uint8"), (4, 4)), f"{folder}/in{i}", [4, 4], [4, 4], "uint8")
    zarr.put(f"{folder}/in1/c/0/0", b"broken")
    targets = [f"{folder}/out{i}" for i in range(3)]
    run = lambda: [r["status"] for r in convert.convert_many(spark, [f"{folder}/in{i}" for i in range(3)], targets)]
    assert run() == ["done", "failed", "done"] and run() == ["skipped", "failed", "skipped"]
    report = convert.report_table(spark, convert.convert_many(spark, [f"{folder}/in1"], targets[1:2]))
    assert report.where("status = 'failed' AND error IS NOT NULL").count() == 1 and not os.path.exists(f"{targets[1]}/s0/zarr.json")


def test_chunks_of_frames_are_capped():
    assert convert.capped(["z", "y", "x"], [500, 2048, 2048], [1, 2048, 2048], 64) == ([128, 128, 128], [1024, 1024, 1024])
    assert convert.capped(["c", "z", "y", "x"], [2, 500, 900, 900], [1, 1, 900, 900], 64, [1, 64, 128, 128]) == ([1, 8, 64, 64], [1, 64, 128, 128])
    assert convert.clamped_shard([100, 10], [32, 16], [1024, 1024]) == [128, 16]


def test_upsampled_containers(spark):
    folder = new()
    a = np.repeat(15 * np.arange(16, dtype="uint8")[:, None], 6, axis=1)
    zarr.write_chunks(chunked(spark, a, (8, 4)), f"{folder}/in/s0", [16, 6], [8, 4], "uint8", names=["z", "x"])
    axes = [{"name": n, "type": "space", "unit": "nanometer"} for n in "zx"]
    multiscale.write_group(f"{folder}/in", {"attributes": {"ome": {"multiscales": [{"axes": axes, "datasets": [{"path": "s0", "coordinateTransformations": [{"type": "scale", "scale": [20.0, 9.0]}]}]}]}}}, "zarr3")
    for format in ("zarr3", "zarr2"):
        done = convert.upsample(spark, f"{folder}/in", f"{folder}/{format}.zarr", "img", options=convert.Options(format=format))
        got = load(spark, done["array"])
        assert done["shape"] == [36, 6] and done["voxel"] == [9.0, 9.0] and got.shape == (36, 6) and (np.diff(got.astype(int), axis=0) >= 0).all() and got.max() == 225
        for place, path in ((f"{folder}/{format}.zarr/img", "s0"), (f"{folder}/{format}.zarr", "img/s0")):
            scale = multiscale._holder(multiscale.read_group(spark, place, format), format)["multiscales"][0]
            assert scale["datasets"][0]["path"] == path and scale["datasets"][0]["coordinateTransformations"][0]["scale"] == [9.0, 9.0] and [x["name"] for x in scale["axes"]] == ["z", "x"]
        with pytest.raises(ValueError, match="already isotropic"):
            convert.upsample(spark, f"{folder}/{format}.zarr", f"{folder}/again.zarr")


def test_box_arguments():
    assert convert.box_argument("1, 2,3,4,5,6", ["c", "z", "y", "x"]) == {"z": (1, 4), "y": (2, 5), "x": (3, 6)}
    for bad in ("1,2,3,4,5", "1,2,3,4,5,0", "1,2,3,4,5,x", ""):
        with pytest.raises(ValueError):
            convert.box_argument(bad, ["z", "y", "x"])

"""Precomputed volumes: compressed labels, shards, scales, and what is broken."""

import gzip
import os
import tempfile

import numpy as np
import pytest
from test_resample import chunked, whole

from chunkframe.sources import convert, elements, precomputed, zarr

RNG = np.random.default_rng(4)


def new():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/v"


@pytest.mark.parametrize("dtype", ["uint32", "uint64"])
@pytest.mark.parametrize("size", [(8, 8, 8, 1), (13, 9, 17, 2), (1, 1, 1, 1)])
def test_labels_round_trip(dtype, size):
    for most in (1, 2, 3, 17, 300, 2**31):
        a = RNG.integers(0, most, size).astype(dtype) * (np.array(2**33, dtype) if dtype == "uint64" else np.array(1, dtype))
        data = precomputed.pack_labels(a)
        assert (precomputed.unpack_labels(data, list(size), "<" + zarr.DTYPES[dtype]) == a).all()
    assert (precomputed.unpack_labels(precomputed.pack_labels(a, (4, 8, 2)), list(size), "<" + zarr.DTYPES[dtype], (4, 8, 2)) == a).all()


def test_labels_by_hand():
    """One block of two values, with one bit each: the head, 16 words of bits, the table."""
    words = [1, (2 + 16) | 1 << 24, 2, *([0b10] + [0] * 15), 5, 9]
    got = precomputed.unpack_labels(np.array(words, "<u4").tobytes(), [8, 8, 8, 1], "<u4")
    want = np.full((8, 8, 8, 1), 5)
    want[1, 0, 0, 0] = 9
    assert (got == want).all()


def test_broken_labels_are_errors():
    a = RNG.integers(0, 40, (16, 16, 16, 1)).astype("uint64")
    data = bytearray(precomputed.pack_labels(a))
    for cut in (0, 3, 4, 40, len(data) - 8):
        with pytest.raises(ValueError):
            precomputed.unpack_labels(bytes(data[:cut]), [16, 16, 16, 1], "<u8")
    for _ in range(300):
        bad = bytearray(data)
        bad[RNG.integers(0, 80)] ^= 1 << int(RNG.integers(0, 8))
        try:
            precomputed.unpack_labels(bytes(bad), [16, 16, 16, 1], "<u8")
        except ValueError:
            pass


def test_codes_and_hashes():
    bits = precomputed.grid_bits([5, 2, 9])
    assert bits == [(0, 0), (1, 0), (2, 0), (0, 1), (2, 1), (0, 2), (2, 2), (2, 3)]
    for place in ([0, 0, 0], [4, 1, 8], [3, 0, 5]):
        assert precomputed.place_of(precomputed.morton(place, bits), bits) == place
    assert precomputed.grid_bits([1, 1, 1]) == [] and precomputed.morton([0, 0, 0], []) == 0
    assert len({precomputed.murmur(i) for i in range(5000)}) == 5000 and max(precomputed.murmur(i) for i in range(100)) < 2**64
    spec = {"hash": "identity", "preshift_bits": 2, "minishard_bits": 3, "shard_bits": 5}
    assert precomputed.shard_and_mini(0b11010_101_11, spec) == (0b11010, 0b101) and precomputed.shard_file(10, spec) == "0a.shard"


SHARDS = [None, {"hash": "identity", "preshift_bits": 1, "minishard_bits": 1, "shard_bits": 2}, {"minishard_bits": 2, "shard_bits": 1, "data_encoding": "gzip"}, {"minishard_bits": 0, "shard_bits": 0, "minishard_index_encoding": "raw"}]


@pytest.mark.parametrize("sharding", SHARDS)
@pytest.mark.parametrize("encoding", ["raw", "compressed_segmentation"])
def test_volumes(spark, sharding, encoding):
    a = RNG.integers(0, 2**40, (30, 21, 13, 1)).astype("uint64") // 2**36
    path, elements_of = new(), lambda **o: spark.read.format("chunked_array").options(**o)
    chunks = chunked(spark, a, (8, 8, 8, 1))
    small = a[::2, ::2, ::2]
    scales = [precomputed.write_scale(chunks, path, [30, 21, 13], [8, 8, 8], "uint64", [4.0, 4.0, 40.0], encoding, sharding, [100, 0, 7])]
    scales.append(precomputed.write_scale(chunked(spark, small, (8, 8, 8, 1)), path, [15, 11, 7], [8, 8, 8], "uint64", [8.0, 8.0, 80.0], encoding, sharding))
    precomputed.write_info(path, "uint64", scales, "segmentation")
    elements.register(spark)
    assert (whole(zarr.read_chunks(spark, path), a.shape, "uint64") == a).all()
    assert (whole(zarr.read_chunks(spark, f"{path}/8_8_80"), small.shape, "uint64") == small).all()
    got = sorted((r["x"], r["y"], r["z"], int(r["v"])) for r in elements_of(box="x=5:12,y=15:,z=7:9").load(path).collect())
    assert got == [(x, y, z, int(a[x, y, z, 0])) for x in range(5, 12) for y in range(15, 21) for z in range(7, 9)]
    job = convert.plan(spark, "precomputed://" + path, convert.Options(squeeze=("c",), order="zyx"))
    assert (job.shape, job.voxel, job.is_label) == ([13, 21, 30], [40.0, 4.0, 4.0], True)


def test_absent_chunks_of_shards_are_zero(spark):
    a = RNG.integers(1, 99, (16, 16, 16, 1)).astype("uint32")
    path = new()
    some = chunked(spark, a, (8, 8, 8, 1)).where("origin[0] = 0")
    precomputed.write_info(path, "uint32", [precomputed.write_scale(some, path, [16, 16, 16], [8, 8, 8], "uint32", [1.0, 1.0, 1.0], sharding=SHARDS[1])])
    got = whole(zarr.read_chunks(spark, path), a.shape, "uint32")
    assert (got[:8] == a[:8]).all() and (got[8:] == 0).all() and zarr.read_chunks(spark, path, fill_missing=False).count() == 4


def test_reading_touches_few_bytes_and_broken_shards_are_errors(spark):
    a = RNG.integers(0, 2**31, (64, 64, 64, 1)).astype("uint32")
    path, read = new(), []
    spec = {"hash": "identity", "minishard_bits": 1, "shard_bits": 0}
    scale = precomputed.write_scale(chunked(spark, a, (16, 16, 16, 1)), path, [64, 64, 64], [16, 16, 16], "uint32", [1.0, 1.0, 1.0], sharding=spec)
    precomputed.write_info(path, "uint32", [scale])
    info = zarr.describe(spark, path)
    shards = precomputed.Minishards(f"{path}/1_1_1", info["sharding"], lambda p, at, n: read.append(n) or zarr.fetch_range(p, at, n))
    bits = precomputed.grid_bits([4, 4, 4])
    for place in ([0, 0, 0], [2, 0, 0]):
        (row,) = precomputed.decode_chunk(info, [*place, 0], shards.get(precomputed.morton(place, bits)))
        assert (np.frombuffer(row[2], "<u4").reshape(row[1]) == a[tuple(slice(16 * i, 16 * i + 16) for i in place)]).all()
    assert len(read) == 4 and sum(read) < 2 * 16384 + 2000  # an entry, an index, two chunks; the file holds 1 MB
    file = f"{path}/1_1_1/0.shard"
    with open(file, "rb") as f:
        data = f.read()
    for bad in (data[:8], data[:-5], data[: len(data) // 2]):
        zarr.put(file, bad)
        with pytest.raises(Exception, match="shard|index|gzip|end-of-stream"):
            zarr.read_chunks(spark, path).count()
    assert gzip.decompress(gzip.compress(b"x")) == b"x" and os.path.exists(file)
    with pytest.raises(ValueError, match="twice"):
        writer = precomputed.ShardWriter(file, info["sharding"])
        writer.add(0, 2, b"x")
        writer.add(0, 2, b"x")


def test_what_is_not_read(spark):
    path = new()
    for scale in ({"encoding": "jpeg"}, {"encoding": "raw", "sharding": {"@type": "other"}}):
        precomputed.write_info(path, "uint8", [{"key": "1", "size": [1, 1, 1], "chunk_sizes": [[1, 1, 1]], "resolution": [1, 1, 1]} | scale])
        with pytest.raises(ValueError, match="encoding|sharding"):
            zarr.describe(spark, path)

"""Every array query against DuckDB, and the parts SQL can't say."""

import glob
import json
import math
import os
import tempfile
from decimal import Decimal

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkframe.operators import blocks, discovery, domain, pyramid
from chunkframe.plans import catalog
from chunkframe.sources import fixtures, zarr
from chunkframe.streaming import bins

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, (float, Decimal)):
        return round(float(v), 9)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else str(v) if v is not None and not isinstance(v, (int, str, bool)) else v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = duck.sql(catalog.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert got == want and got


@pytest.mark.parametrize("format", ["zarr3", "zarr2", "n5"])
@pytest.mark.parametrize("codec", [None, "gzip", "zstd"])
def test_array_round_trip(spark, format, codec):
    if format == "n5" and codec == "zstd":
        pytest.skip("not in this format")
    image = fixtures.image(spark, SF)
    chunks = blocks.to_chunks(image, {"y": 500, "x": 64}, {"y": 150, "x": 48})
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/a"
    assert zarr.write_chunks(chunks, path, [500, 64], [150, 48], format=format, codec=codec) == zarr.total_chunks([500, 64], [150, 48])
    info = zarr.describe(spark, path)
    assert info["shape"] == [500, 64] and info["format"] == format
    back = blocks.from_chunks(zarr.read_chunks(spark, path), ["y", "x"])
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, image.collect()))
    with pytest.raises(FileNotFoundError):
        zarr.describe(spark, path + "/none")


@pytest.mark.parametrize("dtype", ["float32", "float64", "uint64", "int16"])
def test_typed_and_sharded_round_trip(spark, dtype):
    top = {"float32": 1.5e30, "float64": 1 / 3, "uint64": 2**64 - 1, "int16": -32768}[dtype]
    cells = [(y, x, top if (y + x) % 3 else (y * 10 + x)) for y in range(20) for x in range(7) if not 8 <= y < 12]
    kind = {"float32": "float", "float64": "double", "uint64": "decimal(20,0)", "int16": "int"}[dtype]
    rows = spark.createDataFrame([(y, x, Decimal(v) if dtype == "uint64" else float(v) if dtype[0] == "f" else v) for y, x, v in cells], f"y long, x long, v {kind}")
    for shard in (None, [8, 8]):
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/a"
        chunks = blocks.to_chunks(rows, {"y": 20, "x": 7}, {"y": 4, "x": 4}, fill=3, dtype=dtype)
        zarr.write_chunks(chunks, path, [20, 7], [4, 4], dtype, codec="zstd", shard=shard, fill=3)
        back = {(r["y"], r["x"]): r["v"] for r in blocks.from_chunks(zarr.read_chunks(spark, path), ["y", "x"], dtype).collect()}
        want = {(y, x): 3 for y in range(20) for x in range(7)} | {(y, x): v for y, x, v in cells}
        assert back.keys() == want.keys() and all(float(back[k]) == float(np.dtype(dtype).type(want[k])) for k in want)
        if dtype != "int16":
            with pytest.raises(Exception, match="do not fit"):
                blocks.from_chunks(zarr.read_chunks(spark, path), ["y", "x"]).collect()


def test_foreign_layouts(spark):
    """A transposed chunk with a checksum, an index in front, and a precomputed volume, built by hand."""
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    a = np.arange(24, dtype="<u2").reshape(4, 6)

    def v3(name, grid, codecs, files):
        zarr.put(f"{folder}/{name}/zarr.json", json.dumps({"zarr_format": 3, "node_type": "array", "shape": [4, 6], "data_type": "uint16", "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": grid}}, "fill_value": 9, "codecs": codecs}).encode())
        for at, data in files.items():
            zarr.put(f"{folder}/{name}/c/{at}", data)

    raw = [{"name": "bytes", "configuration": {"endian": "little"}}]
    body = np.ascontiguousarray(a[:, :3].T).tobytes()
    v3("t", [4, 3], [{"name": "transpose", "configuration": {"order": [1, 0]}}, *raw, {"name": "crc32c"}], {"0/0": body + zarr.crc32c(body).to_bytes(4, "little")})
    index = np.full((2, 2), zarr.ABSENT, "<u8")
    index[1] = 32, 24
    v3("s", [4, 6], [{"name": "sharding_indexed", "configuration": {"chunk_shape": [4, 3], "codecs": raw, "index_codecs": raw, "index_location": "start"}}], {"0/0": index.tobytes() + a[:, 3:].tobytes()})
    got = {n: {(r["y"], r["x"]): r["v"] for r in blocks.from_chunks(zarr.read_chunks(spark, f"{folder}/{n}"), ["y", "x"]).collect()} for n in "ts"}
    assert got["t"] == {(y, x): int(a[y, x]) if x < 3 else 9 for y in range(4) for x in range(6)}
    assert got["s"] == {(y, x): int(a[y, x]) if x >= 3 else 9 for y in range(4) for x in range(6)}
    assert zarr.crc32c(b"123456789") == 0xE3069283
    zarr.put(f"{folder}/p/info", json.dumps({"@type": "neuroglancer_multiscale_volume", "type": "image", "data_type": "uint16", "num_channels": 1, "scales": [{"key": "8_8_8", "size": [4, 6, 1], "resolution": [8, 8, 8], "chunk_sizes": [[4, 4, 1]], "encoding": "raw", "voxel_offset": [10, 0, 0]}]}).encode())
    zarr.put(f"{folder}/p/8_8_8/10-14_0-4_0-1", a[:, :4].tobytes(order="F"))
    zarr.put(f"{folder}/p/8_8_8/10-14_4-6_0-1", a[:, 4:].tobytes(order="F"))
    back = {(r["x"], r["y"]): r["v"] for r in blocks.from_chunks(zarr.read_chunks(spark, f"{folder}/p"), ["x", "y", "z", "c"]).collect()}
    assert back == {(x, y): int(a[x, y]) for x in range(4) for y in range(6)}


def test_folders_are_told_apart(spark):
    rows = [("a", f"/d/a/{f}") for f in (".zgroup", "raw/s0/zarr.json")] + [("b", "/d/b/zarr.json"), ("c", "/d/c/attributes.json"), ("e", "/d/e/info")] + [("f", f"/d/f/{i}.tif") for i in range(3)] + [("g", "/d/g/x.txt"), ("h", "/d/h/.zgroup"), ("h", "/d/h/raw/note.txt")]
    found = discovery.folders(spark.createDataFrame(rows, "root string, path string"), "root", F.concat(F.lit("/d/"), F.col("root")))
    got = {r["root"]: (r["format"], r["one"], r["many"]) for r in found.select("root", "format", discovery.input_mode(F.lit("/o/x.zarr")).alias("one"), discovery.input_mode(F.lit("/o")).alias("many")).collect()}
    assert got == {"a": ("container", *["discovered_folder"] * 2), "b": ("zarr", *["single_file"] * 2), "c": ("n5", *["single_file"] * 2), "e": ("precomputed", *["single_file"] * 2), "f": ("files", "single_file", "batch_directory"), "g": ("files", *["batch_directory"] * 2), "h": ("zarr", *["single_file"] * 2)}


def test_wide_casts(spark):
    one = spark.range(1)
    cast = lambda v, dtype, **kw: one.select(domain.cast_value(F.lit(v), dtype, **kw).alias("v")).first()["v"]
    assert cast(-5, "uint64") == 0 and cast(2**63 - 1, "uint64") == 2**63 - 1
    assert cast(1e19, "uint64", from_float=True) == 10**19 and cast(1e30, "uint64", from_float=True) == 2**64 - 1 and cast(-1e30, "int64", from_float=True) == -(2**63)
    assert cast(-2.9, "int64", from_float=True) == -2 and cast(0.25, "float32") == 0.25 and cast(7, "float64") == 7.0


def test_levels_stop_before_magnifications_drift():
    shapes = [lv["shape"] for lv in pyramid.plan([1000, 1000, 1030], [8.0] * 3, ["z", "y", "x"], least_bytes=1, least_shape=2)]
    assert all(pyramid.power_of_two_error(n / m) <= 0.04 for s in shapes for n, m in zip(shapes[0], s, strict=True)) and len(shapes) < 10
    assert pyramid.power_of_two_error(4.2) > 0.04


def test_means_beyond_the_range_of_doubles(spark):
    big = 2**60 + 1
    rows = spark.createDataFrame([(0, big), (1, big + 1), (2, -3), (3, -4)], "x long, v long")
    assert sorted(r["v"] for r in blocks.downsample(rows, "mean", x=2).collect()) == [-4, big + 1]


def test_stream_equals_batch(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    fixtures.table(spark, SF, "events").repartition(3).write.mode("overwrite").parquet(f"{folder}/in")
    q = bins.time_bins(bins.stream_of(spark, f"{folder}/in")).writeStream.format("memory").queryName("bins").outputMode("complete").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("bins").collect())) == sorted(map(tuple, bins.time_bins(fixtures.table(spark, SF, "events")).collect()))


def test_errors_and_plans(spark):
    image = fixtures.image(spark, SF)
    with pytest.raises(ValueError):
        domain.crop(image, y=(0, 0))
    with pytest.raises(ValueError):
        domain.reorder(image, "xz")
    chunks = blocks.to_chunks(image, {"y": 500, "x": 64}, {"y": 125, "x": 64})
    with pytest.raises(Exception, match="rechunk first"):
        blocks.reduce_chunks(chunks, [2, 2]).collect()
    levels = pyramid.plan([64, 1024, 1024], [8.0, 8.0, 8.0], ["z", "y", "x"])
    assert [lv["shape"] for lv in levels] == [[64, 1024, 1024], [32, 512, 512], [16, 256, 256]]
    assert pyramid.factors([40.0, 8.0, 8.0], ["z", "y", "x"]) == [1, 2, 2]
    assert math.prod(levels[-1]["cumulative"]) == 64


def test_two_axis_upsampling_grows_with_the_image(spark):
    for sf, height in ((SF, 500), ("/root/testdata/sf0.1", 2000)):
        out = catalog.queries()["upsample_linear_2d_whole"](spark, sf)
        assert out.count() == height * 8 // 5 * 100

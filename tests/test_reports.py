"""Reports of batches and the index of their files."""

import tempfile

import pytest
from pyspark.sql import functions as F

from chunkframe.functions import metadata as M
from chunkframe.operators import reports


def test_batch_report(spark):
    rows = [("a", "done", i) for i in range(3)] + [("a", "failed", i) for i in range(40, 0, -1)] + [("b", "done", 1), ("b", "skipped", 2), ("c", "running", 5)]
    got = {r["b"]: r for r in reports.batch_report(spark.createDataFrame(rows, "b string, s string, k long"), "b", "s", "k").collect()}
    assert (got["a"]["total"], got["a"]["failed"], got["a"]["complete"], got["a"]["failures"]) == (43, 40, False, list(range(1, 11)))
    assert got["b"]["complete"] and got["b"]["failures"] == [] and not got["c"]["complete"]


def test_index_of_files(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/index"
    rows = [(1, 0, "/in/a b.tif", "/out/a b.zarr"), (1, 1, "/in/ü.tif", "/out/ü.zarr"), (2, 0, "/x", "/y")]
    schema = "job long, row long, source string, target string"
    reports.write_index(spark.createDataFrame(rows, schema), path)
    assert sorted(map(tuple, reports.read_index(spark, path).collect())) == rows
    with pytest.raises(Exception, match="with a tab"):
        reports.write_index(spark.createDataFrame([(1, 0, "a\tb", "c")], schema), path + "2")


def test_arguments(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first()["v"]
    axes = F.array(*map(F.lit, "zyx"))
    assert value(M.order_argument(F.lit("xyz"), axes)) == "xyz" and value(M.order_argument(F.lit("xxz"), axes)) is None and value(M.order_argument(F.lit("xy"), axes)) is None
    assert value(M.voxel_argument(F.lit("x=4, y=5.5 ,z=-1"))) == {"x": 4.0, "y": 5.5, "z": None}
    assert value(M.told_color(F.lit("#abcdef"))) == "ABCDEF" and value(M.told_color(F.lit("blue"))) is None and value(M.told_color(F.lit("-16776961"))) == "FF0000"
    assert [value(M.wavelength_label(F.lit(w))) for w in (488.0, 488.5)] == ["488", "488.5"]
    assert [value(M.axis_unit(F.lit(a))) for a in ("X", "t", "v", "c", "other")] == ["nanometer", "millisecond", None, None, None]
    assert [value(M.is_native(F.lit(p))) for p in ("/a/b.zarr/s0", "/a/B.N5", "/a/b.precomputed", "gs://x")] == [True, True, False, True]

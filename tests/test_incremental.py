"""Arrays filled by a stream: batches once, replayed, interrupted, and growing."""

import json
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkframe.operators import discovery
from chunkframe.sources import zarr
from chunkframe.streaming import incremental

AXES, SCHEMA = ["t", "x"], "t long, x long, v int"


def filled(spark, root):
    info = zarr.describe(spark, f"{root}/a")
    out = np.zeros(info["shape"], "int32")
    for r in zarr.read_chunks(spark, f"{root}/a").collect():
        out[tuple(slice(o, o + e) for o, e in zip(r["origin"], r["extent"], strict=True))] = np.frombuffer(r["payload"], r["dtype"]).reshape(r["extent"])
    return out


def start(spark, root, checkpoint="check"):
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    q = incremental.append_stream(rows, f"{root}/a", AXES, f"{root}/state", f"{root}/{checkpoint}", "x")
    q.awaitTermination()


def put(spark, root, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/in")


def test_batches_are_applied_once(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    incremental.create(f"{root}/a", AXES, [1, 6], [4, 4], "int32", fill=-1)
    put(spark, root, [(t, x, 10 * t + x) for t in range(5) for x in range(6)])
    start(spark, root)
    put(spark, root, [(t, x, 1000 + t) for t in range(3, 9) for x in range(0, 6, 5)])  # over the first and beyond it
    start(spark, root)
    want = np.full((9, 6), -1)
    want[:5] = [[10 * t + x for x in range(6)] for t in range(5)]
    want[3:, [0, 5]] = np.arange(1003, 1009)[:, None]
    assert (filled(spark, root) == want).all()
    ranges = lambda: {r["channel"]: (r["n"], r["least"], r["most"]) for r in incremental.running_ranges(spark, f"{root}/state").collect()}
    assert ranges()[0] == (11, 0.0, 1008.0) and ranges()[1] == (5, 1.0, 41.0)
    before = ranges()
    start(spark, root, "another")  # the same batches again: their records are there
    assert (filled(spark, root) == want).all() and ranges() == before
    whole = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    incremental.create(f"{whole}/a", AXES, [1, 6], [4, 4], "int32", fill=-1)
    put(spark, whole, [(int(t), int(x), int(v)) for (t, x), v in np.ndenumerate(want) if v >= 0])
    start(spark, whole)
    assert (filled(spark, whole) == want).all()


def test_a_batch_that_failed_half_way_comes_again(spark, monkeypatch):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    incremental.create(f"{root}/a", AXES, [1, 6], [2, 3], "int32")
    put(spark, root, [(t, x, t + x) for t in range(4) for x in range(6)])
    real = zarr.put
    monkeypatch.setattr(zarr, "put", lambda path, data: (_ for _ in ()).throw(OSError("gone")) if "/state/" in path else real(path, data))
    with pytest.raises(Exception, match="gone"):
        start(spark, root)
    monkeypatch.setattr(zarr, "put", real)
    assert incremental.record_of(f"{root}/state", 0) is None
    start(spark, root)
    assert (filled(spark, root) == np.add.outer(np.arange(4), np.arange(6))).all() and os.listdir(f"{root}/state") == ["batch-0.json"]
    assert json.loads(zarr.fetch(f"{root}/state/batch-0.json"))["chunks"] == 4


def test_pending_files(spark):
    files = spark.createDataFrame([("a",), ("b",), ("c",)], "path string")
    done = spark.createDataFrame([("b",), ("b",)], "path string")
    assert sorted(r["path"] for r in incremental.pending(files, done).collect()) == ["a", "c"]


def test_first_arrays_by_level_and_order(spark):
    many = [("many", f"d{i:02d}/.zarray") for i in range(12)] + [("many", "a/b/.zarray")]
    rows = [*many, ("deep", "a/b/c/d/e/.zarray"), ("four", "a/b/c/d/.zarray"), ("order", "z/raw/.zarray"), ("order", "z/em/.zarray"), ("order", "z/aa/.zarray"), ("late", "raw/n.txt"), *[("late", f"x{i}/n.txt") for i in range(12)], ("late", "x9/.zarray"), ("root", ".zarray")]
    table = spark.createDataFrame(rows, "root string, inner string")
    got = {r["root"]: (r["path"], r["depth"]) for r in discovery.first_arrays(table, "root", F.col("inner").endswith(".zarray")).collect()}
    assert got == {"many": ("d00", 1), "four": ("a/b/c/d", 4), "order": ("z/em", 2)}  # x9 is the thirteenth folder

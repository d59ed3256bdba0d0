"""Modes of writing, and labels in a container that exists."""

import json
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_resample import chunked, whole

from chunkframe.sources import containers, zarr

A = np.arange(12 * 10, dtype="int32").reshape(12, 10)


def read(spark, path, dtype="int32"):
    return whole(zarr.read_chunks(spark, path), A.shape, dtype)


@pytest.mark.parametrize("options", [{}, {"format": "zarr2"}, {"format": "n5"}])
def test_modes(spark, options):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    path = f"{folder}/c/a"
    chunks = chunked(spark, A, (4, 5))
    write = lambda df, mode, **more: containers.write_array(spark, df, path, [12, 10], [4, 5], mode=mode, **(options | more))
    assert write(chunks, "append") == 6  # nothing there: made
    with pytest.raises(FileExistsError):
        write(chunks, "error")
    assert write(chunked(spark, A * 2, (4, 5)).where("chunk_id = 1"), "append") == 1
    want = A.copy()
    want[0:4, 5:] *= 2
    assert (read(spark, path) == want).all()
    with pytest.raises(ValueError, match="another layout"):
        containers.write_array(spark, chunks, path, [12, 10], [4, 10], mode="append", **options)
    bad = chunks.withColumn("payload", F.expr("CASE WHEN chunk_id = 5 THEN raise_error('lost') ELSE payload END"))
    with pytest.raises(Exception, match="lost"):
        write(bad, "overwrite")
    assert (read(spark, path) == want).all()  # a failed job leaves the old array
    write(chunks.where("chunk_id < 2"), "overwrite")
    assert (read(spark, path)[4:] == 0).all() and (read(spark, path)[:4] == A[:4]).all()
    with pytest.raises(ValueError, match="mode"):
        write(chunks, "ignore")


def test_appended_shards_are_whole(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/a"
    write = lambda df: containers.write_array(spark, df, path, [12, 10], [4, 5], mode="append", shard=[8, 10], attributes={"k": 1})
    write(chunked(spark, A, (4, 5)))
    with pytest.raises(ValueError, match="fill their shards"):
        write(chunked(spark, A, (4, 5)).where("chunk_id = 0"))
    write(chunked(spark, A * 3, (4, 5)).where("chunk_id >= 4"))  # the last shard is cut at the edge
    assert (read(spark, path) == np.vstack([A[:8], A[8:] * 3])).all()


@pytest.mark.parametrize("format, file", [("zarr3", "zarr.json"), ("zarr2", ".zattrs")])
def test_labels_are_added(spark, format, file):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/c.zarr"
    labels = {"labels": ["nuclei"]}
    zarr.put(f"{root}/{file}", json.dumps({"attributes": {"ome": labels, "k": 1}} if format == "zarr3" else labels | {"k": 1}).encode())
    axes = [{"name": n, "type": "space", "unit": "nanometer"} for n in "yx"]
    add = lambda name, a: containers.add_label(spark, root, name, chunked(spark, a, (4, 5)), [12, 10], [4, 5], axes, [8.0, 8.0], "int32", format=format)
    assert add("cells", A) == ["cells", "nuclei"]
    assert add("axons", A) == ["axons", "cells", "nuclei"]
    assert add("cells", A + 1) == ["axons", "cells", "nuclei"]
    assert (read(spark, f"{root}/labels/cells/s0") == A + 1).all() and (read(spark, f"{root}/labels/axons/s0") == A).all()
    assert sorted(os.listdir(f"{root}/labels")) == ["axons", "cells"] and not [f for f in os.listdir(root) if f.endswith(".tmp")]
    with open(f"{root}/{file}") as f:
        meta = json.load(f)
    assert meta["attributes"]["k"] == 1 if format == "zarr3" else meta["k"] == 1
    with pytest.raises(FileNotFoundError):
        containers.add_label(spark, root + "/none", "x", chunked(spark, A, (4, 5)), [12, 10], [4, 5], axes, [8.0, 8.0], "int32", format=format)

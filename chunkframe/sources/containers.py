"""Arrays put into place whole: modes of writing, and labels added to a container that exists.

Tasks write to a folder beside the place; when all of it is written, the driver moves the old array aside, the new one
to its place, and deletes the old one, so what is read under a final name is complete. A job that fails leaves the old array as it was.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import zarr

MODES = ("error", "overwrite", "append")


def exists(spark: SparkSession, path: str) -> bool:
    return any(zarr.read_json(spark, f"{path}/{name}") is not None for name in ("zarr.json", ".zarray", "attributes.json"))


@contextmanager
def locked(spark: SparkSession, folder: str, seconds: float = 60.0, name: str = ".chunkframe.lock"):
    """Alone among those who take this lock of a folder: a file that only one can create. An error after ``seconds`` of waiting."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    until = time.monotonic() + seconds
    while True:
        try:
            if fs.createNewFile(at):
                break
        except Py4JJavaError:  # some stores answer so when the file is there
            if not fs.exists(at):
                raise
        if time.monotonic() > until:
            raise TimeoutError(f"{folder} is locked by {name}; delete it if its writer is gone")
        time.sleep(0.05)
    try:
        yield
    finally:
        fs.delete(at, False)


def _whole_shards(chunks: DataFrame, shape: list[int], chunk: list[int], shard: list[int]) -> bool:
    """Whether the chunks fill every shard they are in."""
    home = [F.floor(F.get("origin", F.lit(i)) / s) for i, s in enumerate(shard)]
    inside = [F.ceil((F.least(F.lit(n), (h + 1) * s) - h * s) / c) for h, n, s, c in zip(home, shape, shard, chunk, strict=True)]
    due = math.prod(inside[1:], start=inside[0])
    counts = chunks.groupBy(*[h.alias(f"h{i}") for i, h in enumerate(home)]).agg(F.countDistinct("origin").alias("n"), F.max(due).alias("due"))
    return counts.where("n < due").isEmpty()


def write_array(spark: SparkSession, chunks: DataFrame, path: str, shape: list[int], chunk: list[int], dtype: str = "int32", mode: str = "error", **options) -> int:
    """``zarr.write_chunks`` by mode: ``error`` if there is an array, ``overwrite`` all of it, ``append`` chunks to one of the same layout.

    Appended chunks take the place of stored ones; those of a sharded array must fill their shards, whose files are written whole.
    """
    if mode not in MODES:
        raise ValueError(f"mode {mode}: {', '.join(MODES)}")
    there = exists(spark, path)
    if there and mode == "error":
        raise FileExistsError(path)
    if there and mode == "append":
        have = zarr.describe(spark, path)
        shard = options.get("shard")
        told = (options.get("format", "zarr3"), shape, chunk, shard, zarr.DTYPES[dtype])
        if told != (have["format"], have["shape"], have["chunk"], have.get("shard"), have["dtype"].lstrip("<>|=")):
            raise ValueError(f"the array at {path} has another layout")
        if shard and not _whole_shards(chunks, shape, chunk, shard):
            raise ValueError("chunks appended to a sharded array must fill their shards")
        if have["format"] != "n5":
            options = {"attributes": have["attributes"], "fill": have["fill"], "names": have["names"]} | options
        return zarr.write_chunks(chunks, path, shape, chunk, dtype, **options)
    staged = f"{path.rstrip('/')}.{uuid.uuid4().hex}.tmp"
    done = zarr.write_chunks(chunks, staged, shape, chunk, dtype, **options)
    zarr.take_over(staged, path)
    return done


def add_label(spark: SparkSession, container: str, name: str, chunks: DataFrame, shape: list[int], chunk: list[int], axes: list[dict], voxel: list[float], dtype: str = "uint32", parent: str = "labels", **options) -> list[str]:
    """A label image (its first level) in a container that exists; the container's list of labels afterwards.

    Only the label of that name is replaced. The list of the root is extended, in order and without repeats; other metadata stay.
    """
    format = options.get("format", "zarr3")
    if format not in ("zarr3", "zarr2"):
        raise ValueError(f"labels in {format}")
    file = "zarr.json" if format == "zarr3" else ".zattrs"
    if zarr.read_json(spark, f"{container}/{file}") is None:
        raise FileNotFoundError(f"no container at {container}")
    staged = f"{container}/{parent}.{uuid.uuid4().hex}.tmp"
    zarr.write_chunks(chunks, f"{staged}/s0", shape, chunk, dtype, **options)
    image = {"name": name, "type": "image", "axes": axes, "datasets": [{"path": "s0", "coordinateTransformations": [{"type": "scale", "scale": voxel}]}]}
    if format == "zarr3":
        group = {"zarr.json": {"zarr_format": 3, "node_type": "group", "attributes": {"ome": {"version": "0.5", "multiscales": [image], "image-label": {"version": "0.5"}}}}}
    else:
        group = {".zgroup": {"zarr_format": 2}, ".zattrs": {"multiscales": [{"version": "0.4"} | image], "image-label": {"version": "0.4"}}}
    for at, value in group.items():
        zarr.put(f"{staged}/{at}", json.dumps(value).encode())
    zarr.take_over(staged, f"{container}/{parent}/{name}")
    with locked(spark, container):  # labels that are added at once each read the list that the one before wrote
        root = zarr.read_json(spark, f"{container}/{file}")
        holder = root.setdefault("attributes", {}).setdefault("ome", {}) if format == "zarr3" else root
        holder["labels"] = sorted({*holder.get("labels", []), name})
        zarr.put(f"{container}/{file}", json.dumps(root).encode())
    return holder["labels"]

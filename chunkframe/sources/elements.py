"""A Spark data source over stored arrays: one row per element (or chunk), chunk files chosen by a box; chunks written with a commit.

``register(spark)``, then ``spark.read.format("chunked_array").option("box", "z=10:20").load(path)`` opens only the chunks
that the box touches; of a shard it reads the index and those chunks. The box is an option and no pushed filter, since Spark 4.1 keeps the
filters pushed into a Python source for the next query on the same DataFrame, which would then lack rows.

``chunks.write.format("chunked_array").mode("overwrite").option("shape", "200,64").option("chunk", "64,16").save(path)`` stores rows
(origin, extent, payload, dtype). Tasks write beside the place and report which files they made; the driver's commit checks
that none was made twice and puts the array in its place, or (``append``) the files into the array there. A job that fails is aborted: what it
wrote is deleted, and nothing at the place has changed.
"""

from __future__ import annotations

import json
import math
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..operators.blocks import SPARK_TYPES
from . import precomputed, zarr

#: Partitions of one scan at most; each has as many more chunks as that takes.
PARTITIONS = 10_000


def _load(path: str) -> dict | None:
    data = zarr.fetch(path)
    return None if data is None else json.loads(data)


class Chunks(InputPartition):
    """Numbers, first to last, of chunks: by the files that the box touches, and within a shard by their place there."""

    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


def box_of(text: str, axes: list[str], shape: list[int]) -> list[tuple[int, int]]:
    """(first, stop) on every axis from ``axis=first:stop`` with commas; either end may be left out."""
    box = [(0, n) for n in shape]
    for part in filter(None, text.replace(" ", "").split(",")):
        name, _, ends = part.partition("=")
        if name not in axes or ends.count(":") != 1:
            raise ValueError(f"box {part}: axis=first:stop, axes {axes}")
        i, (first, stop) = axes.index(name), ends.split(":")
        box[i] = max(int(first or 0), 0), min(int(stop or shape[i]), shape[i])
    return box


class ElementReader(DataSourceReader):
    def __init__(self, path: str, info: dict, axes: list[str], dtype: str, box: list[tuple[int, int]]):
        self.path, self.info, self.axes, self.dtype, self.box = path, info, axes, dtype, box
        self.grid = [range(lo // c, -(-hi // c)) if lo < hi else range(0) for (lo, hi), c in zip(box, info.get("shard") or info["chunk"], strict=True)]
        self.inside = math.prod(s // c for s, c in zip(info["shard"], info["chunk"], strict=True)) if info.get("shard") else 1

    def partitions(self) -> list[Chunks]:
        total = math.prod(map(len, self.grid)) * self.inside
        each = max(-(-total // PARTITIONS), -(-total // zarr.tasks_for(self.info, total)) if total else 1)
        return [Chunks(i, min(i + each, total)) for i in range(0, total, each)] or [Chunks(0, 0)]

    def _touched(self, origin: list[int], extent: list[int]) -> bool:
        return all(max(lo, o) < min(hi, o + e) for (lo, hi), o, e in zip(self.box, origin, extent, strict=True))

    def _chunks(self, partition: Chunks) -> Iterator[tuple]:
        sizes = [len(g) for g in self.grid]
        if self.info.get("sharding"):
            bits = precomputed.grid_bits(precomputed.grid_of(self.info)[:3])
            shards = precomputed.Minishards(precomputed.folder_of(self.path, self.info), self.info["sharding"])
            places = ([g[int(i)] for g, i in zip(self.grid, np.unravel_index(n, sizes), strict=True)] for n in range(partition.first, partition.last))
            for code, place in sorted((precomputed.morton(place, bits), place) for place in places):
                yield from precomputed.decode_chunk(self.info, place, shards.get(code))
            return
        for file in range(partition.first // self.inside, -(-partition.last // self.inside)):
            place = [g[int(i)] for g, i in zip(self.grid, np.unravel_index(file, sizes), strict=True)]
            path = f"{self.path}/{zarr.file_of(self.info, place)}"
            if self.info.get("shard"):
                numbers = range(max(partition.first - file * self.inside, 0), min(partition.last - file * self.inside, self.inside))
                yield from zarr.rows_of_shard(self.info, place, lambda at, n, path=path: zarr.fetch_range(path, at, n), numbers, wanted=self._touched)
            else:
                yield from zarr.rows_of_file(self.info, place, zarr.fetch(path))

    def read(self, partition: Chunks) -> Iterator[pa.RecordBatch]:
        for origin, extent, payload, kind in self._chunks(partition):
            cut = [(max(lo - o, 0), min(hi - o, e)) for (lo, hi), o, e in zip(self.box, origin, extent, strict=True)]
            if all(lo < hi for lo, hi in cut):
                block = np.frombuffer(payload, kind).reshape(extent)[tuple(slice(*c) for c in cut)]
                at = np.indices(block.shape).reshape(len(extent), -1) + np.array([o + lo for o, (lo, _) in zip(origin, cut, strict=True)])[:, None]
                yield pa.RecordBatch.from_arrays([*map(pa.array, at.astype("i8")), self._column(block.ravel())], names=[*self.axes, "v"])

    def _column(self, values: np.ndarray) -> pa.Array:
        if self.dtype == "uint64":
            return pa.array(values).cast(pa.decimal128(20, 0))
        return pa.array(values.astype({"uint8": "i2", "uint16": "i4", "uint32": "i8"}.get(self.dtype, self.dtype)))


class ChunkReader(ElementReader):
    """Whole chunks, those that the box touches."""

    def read(self, partition: Chunks) -> Iterator[pa.RecordBatch]:
        yield from zarr.chunk_batches(row for row in self._chunks(partition) if self._touched(row[0], row[1]))


@dataclass
class Written(WriterCommitMessage):
    """The numbers of the files that a task made, packed."""

    files: bytes


class ChunkWriter(DataSourceArrowWriter):
    def __init__(self, path: str, layout: zarr.Layout, add: bool):
        self.path, self.layout, self.add = path, layout, add
        self.staged = f"{path}.{uuid.uuid4().hex}.tmp"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        grid = self.layout.grid()
        rows = (tuple(batch.column(c)[i].as_py() for c in ("origin", "extent", "payload", "dtype")) for batch in iterator for i in range(batch.num_rows))
        skip = 1 if self.layout.format == "zarr3" else 0
        made = [int(np.ravel_multi_index([int(i) for i in file.split("/")[skip:]], grid)) for file in self.layout.write(rows, self.staged)]
        return Written(zlib.compress(np.diff(np.sort(np.array(made, np.int64)), prepend=0).tobytes()))

    def commit(self, messages: list[Written | None]) -> None:
        made = [np.cumsum(np.frombuffer(zlib.decompress(m.files), np.int64)) for m in messages if m]
        numbers = np.sort(np.concatenate(made)) if made else np.zeros(0, np.int64)
        if (twice := numbers[1:][numbers[1:] == numbers[:-1]]).size:
            raise ValueError(f"{twice.size} files were written twice: give each chunk once, and the chunks of a shard to one task (zarr.by_shard)")
        if self.add:
            origins = np.stack(np.unravel_index(numbers, self.layout.grid())).T * np.array(self.layout.shard or self.layout.chunk) if numbers.size else []
            zarr.move_files(self.staged, self.path, (self.layout.file(o.tolist()) for o in origins))
            return
        for name, value in self.layout.metadata().items():
            zarr.put(f"{self.staged}/{name}", json.dumps(value).encode())
        zarr.take_over(self.staged, self.path)

    def abort(self, messages: list[Written | None]) -> None:
        quiet, until = 0, time.monotonic() + 30
        while quiet < 4 and time.monotonic() < until:  # tasks that are being stopped may still finish a file
            quiet = 0 if zarr.delete_folder(self.staged) else quiet + 1
            time.sleep(0.25)


class ChunkedArray(DataSource):
    """Reading: ``path``, ``axes`` (names with commas; else those of the metadata, else d0, d1, ...), ``box``, ``form`` (elements or chunks).

    Writing chunks: ``path``, ``shape``, ``chunk``, ``shard`` (numbers with commas), ``dtype``, ``store`` (zarr3, zarr2, n5), ``codec`` (none for raw),
    ``names``, ``fill``, ``attributes`` (JSON), and ``exists`` = error, which refuses a place that has an array. Of an array that chunks are appended to,
    ``shape`` and the others may be left out; a chunk takes the place of the one stored there, and chunks of a shard that of the whole shard.
    """

    @classmethod
    def name(cls) -> str:
        return "chunked_array"

    def _array(self) -> tuple[dict, list[str], str]:
        info = zarr.described(self.options["path"].rstrip("/"), _load)
        names = self.options["axes"].split(",") if "axes" in self.options else info.get("names") or [f"d{i}" for i in range(len(info["shape"]))]
        if len(names) != len(info["shape"]):
            raise ValueError(f"{len(names)} names for {len(info['shape'])} axes")
        return info, names, np.dtype(info["dtype"]).newbyteorder("=").name

    def schema(self) -> str:
        if self.options.get("form") == "chunks":
            return zarr.CHUNK_SCHEMA
        _, names, dtype = self._array()
        return ", ".join(f"`{n}` long" for n in names) + f", v {SPARK_TYPES[dtype]}"

    def reader(self, schema) -> ElementReader:
        info, axes, dtype = self._array()
        kind = ChunkReader if self.options.get("form") == "chunks" else ElementReader
        return kind(self.options["path"].rstrip("/"), info, axes, dtype, box_of(self.options.get("box", ""), axes, info["shape"]))

    def writer(self, schema, overwrite: bool) -> ChunkWriter:
        if missing := {"origin", "extent", "payload", "dtype"} - set(schema.fieldNames()):
            raise ValueError(f"chunks lack {sorted(missing)}")
        path, o = self.options["path"].rstrip("/"), self.options
        try:
            have = zarr.described(path, _load)
        except FileNotFoundError:
            have = None
        if have and o.get("exists") == "error":
            raise FileExistsError(path)
        ints = lambda name: [int(v) for v in o[name].split(",")] if o.get(name) else None
        if have and not overwrite and not o.get("shape"):
            layout = zarr.layout_of(have)
        else:
            codec = o.get("codec", "gzip")
            layout = zarr.Layout(ints("shape"), ints("chunk"), o.get("dtype", "int32"), o.get("store", "zarr3"), None if codec == "none" else codec, json.loads(o.get("attributes", "{}")), o["names"].split(",") if o.get("names") else None, ints("shard"), float(o["fill"]) if "." in o.get("fill", "") else int(o.get("fill", "0")))
        if have and not overwrite and not layout.same_as(have):
            raise ValueError(f"the array at {path} has another layout")
        return ChunkWriter(path, layout, bool(have) and not overwrite)


def register(spark: SparkSession) -> None:
    """Make the format ``chunked_array`` known."""
    spark.dataSource.register(ChunkedArray)

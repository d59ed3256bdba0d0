"""Arrays that grow with a stream: each batch is laid over the chunks it touches, once, and counted once.

A stream of elements (index columns and ``v``) is written with ``foreachBatch``. A batch leaves a record, by its number, when all of it is
stored; a batch that comes again is skipped by its record, and one that failed half way is laid over the same chunks again, with
the same outcome. Ranges of values by channel are kept in the records, so they never count a batch twice. The first
axis grows as elements come; where elements of two batches share a place, the later batch has it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.blocks import SPARK_TYPES
from ..sources import zarr


def create(path: str, axes: list[str], shape: list[int], chunk: list[int], dtype: str, codec: str | None = "zstd", fill: float = 0) -> None:
    """An array without chunks, if there is none at the place."""
    if zarr.fetch(f"{path}/zarr.json") is None:
        for name, value in zarr.Layout(shape, chunk, dtype, "zarr3", codec, names=axes, fill=fill).metadata().items():
            zarr.put(f"{path}/{name}", json.dumps(value).encode())


def grow(path: str, extent: int) -> None:
    """The first axis made at least this long; what is not stored there is the fill value."""
    meta = json.loads(zarr.fetch(f"{path}/zarr.json"))
    if extent > meta["shape"][0]:
        meta["shape"][0] = extent
        zarr.put(f"{path}/zarr.json", json.dumps(meta).encode())


def lay_over(rows: DataFrame, path: str, axes: list[str]) -> int:
    """Elements put into the stored chunks they fall in, each chunk read, changed and written by one task; how many chunks.

    Rows are dealt by chunk and sorted by place; a task holds one chunk and the batch it reads. Of elements at one place the last by value wins.
    """
    info = zarr.describe(rows.sparkSession, path)
    layout = zarr.layout_of(info)
    if layout.shard:
        raise ValueError("elements are not laid over shards")
    counts = layout.grid()
    number = F.lit(0).cast("long")
    for a, c, g in zip(axes, layout.chunk, counts, strict=True):
        number = number * g + F.floor(F.col(a) / c)
    dealt = rows.select(number.alias("chunk"), *[F.col(a).cast("long").alias(a) for a in axes], F.col("v").cast(SPARK_TYPES[layout.dtype]).alias("v"))
    dealt = dealt.repartition("chunk").sortWithinPartitions("chunk", *axes, "v")

    def stored(place: list[int]) -> tuple[list[int], np.ndarray]:
        data = zarr.fetch(f"{path}/{zarr.file_of(info, place)}")
        origin, extent, payload, kind = next(zarr.rows_of_file(info, place, data))
        return origin, np.frombuffer(payload, kind).reshape(extent).copy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, origin, block, done = None, None, None, 0

        def put() -> None:
            for _ in layout.write(iter([(origin, list(block.shape), block.tobytes(), block.dtype.str)]), path):
                pass

        for batch in batches:
            chunks = batch.column(0).to_numpy()
            cuts = [0, *(np.nonzero(np.diff(chunks))[0] + 1).tolist(), len(chunks)] if len(chunks) else []
            for first, stop in zip(cuts, cuts[1:], strict=False):
                if chunks[first] != at:
                    if at is not None:
                        put()
                    at, done = int(chunks[first]), done + 1
                    origin, block = stored([int(i) for i in np.unravel_index(at, counts)])
                places = tuple(batch.column(1 + i).slice(first, stop - first).to_numpy() - o for i, o in enumerate(origin))
                values = batch.column(len(axes) + 1).slice(first, stop - first)
                block[places] = [int(v) for v in values.to_pylist()] if layout.dtype == "uint64" else values.to_numpy(zero_copy_only=False)
        if at is not None:
            put()
        yield pa.RecordBatch.from_pydict({"n": pa.array([done], pa.int64())})

    return dealt.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]


def record_of(state: str, batch: int) -> dict | None:
    data = zarr.fetch(f"{state}/batch-{batch}.json")
    return None if data is None else json.loads(data)


def apply_batch(rows: DataFrame, batch: int, path: str, axes: list[str], state: str, channel: str | None = None) -> bool:
    """One batch, unless its record is there; whether it was applied."""
    if record_of(state, batch) is not None:
        return False
    rows = rows.persist()
    try:
        by = [channel] if channel else []
        told = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.max(axes[0]).alias("top")).collect()  # a row for each channel
        told = [r for r in told if r["n"]]
        chunks = 0
        if told:
            grow(path, int(max(r["top"] for r in told)) + 1)
            chunks = lay_over(rows, path, axes)
        whole = lambda v: float(v) if isinstance(v, float) else int(v)
        ranges = [{"channel": None if channel is None else int(r[channel]), "n": r["n"], "least": whole(r["least"]), "most": whole(r["most"])} for r in told]
        zarr.put(f"{state}/batch-{batch}.json", json.dumps({"batch": batch, "chunks": chunks, "ranges": ranges}).encode())
    finally:
        rows.unpersist()
    return True


def append_stream(rows: DataFrame, path: str, axes: list[str], state: str, checkpoint: str, channel: str | None = None) -> StreamingQuery:
    """A stream of elements into an array that was created; all there is, in batches as the source cuts them, then it ends."""
    return rows.writeStream.foreachBatch(lambda df, batch: apply_batch(df, batch, path, axes, state, channel)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_ranges(spark: SparkSession, state: str) -> DataFrame:
    """(channel, n, least, most) over all batches that were applied."""
    schema = "batch long, chunks long, ranges array<struct<channel:long,n:long,least:double,most:double>>"
    rows = spark.read.schema(schema).json(state).select(F.inline("ranges"))
    return rows.groupBy("channel").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))


def pending(listing: DataFrame, done: DataFrame, key: str = "path") -> DataFrame:
    """Files of a listing that no finished one names."""
    return listing.join(done.select(key).distinct(), key, "left_anti")


"""Block reductions, chunk and shard addresses, and chunks as rows with a binary payload.

In voxel form a reduction is one partial and one final aggregation on the block's index. In chunk
form, where every block lies inside one chunk, it needs no exchange: ``reduce_chunks``.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METHODS = ("mean", "mode", "median", "min", "max", "stride")


def half_even(total: str, count: str) -> Column:
    """total / count for integers (as SQL), ties to the even number; no value passes through a double."""
    r = F.expr(f"pmod({total}, {count})")
    q, n = F.expr(f"({total} - pmod({total}, {count})) div {count}"), F.expr(count)
    return F.when(2 * r > n, q + 1).when(2 * r < n, q).otherwise(q + F.pmod(q, F.lit(2)))


def half_even_wide(total: str, count: str) -> Column:
    """The same of decimals without places, for totals beyond 64 bits."""
    n = f"CAST({count} AS DECIMAL(20, 0))"
    rest = f"pmod({total}, {n})"
    r, q = F.expr(rest), F.expr(f"CAST(({total} - {rest}) / {n} AS DECIMAL(20, 0))")
    odd = F.pmod(q, F.lit(2).cast("decimal(20,0)"))
    return F.when(2 * r > F.expr(n), q + 1).when(2 * r < F.expr(n), q).otherwise(q + odd)


def downsample(df: DataFrame, method: str = "mean", **factor: int) -> DataFrame:
    """Blocks of ``axis=factor`` reduced to one value of the same type; edges hold what there is."""
    kind, other = dict(df.dtypes)["v"], [c for c in df.columns if c not in (*factor, "v")]
    at = {a: F.expr(f"{a} div {f}") for a, f in factor.items()}
    if method == "stride":
        for a, f in factor.items():
            df = df.where(F.col(a) % f == 0)
        return df.withColumns(at)
    whole = kind in ("tinyint", "smallint", "int")
    wide = kind == "bigint" or kind.startswith("decimal")  # sums beyond 64 bits
    mean = half_even("sum(CAST(v AS BIGINT))", "count(v)") if whole else half_even_wide("sum(CAST(v AS DECIMAL(20, 0)))", "count(v)") if wide else F.avg("v")
    agg = {"mean": mean, "mode": F.mode("v", True), "median": F.expr("percentile_disc(0.5) within group (order by v)"), "min": F.min("v"), "max": F.max("v")}[method]
    return df.groupBy(*other, *[c.alias(a) for a, c in at.items()]).agg(agg.cast(kind).alias("v"))


def chunk_id(shape: dict[str, int], chunk: dict[str, int]) -> Column:
    """The row-major number of an element's chunk."""
    out = F.lit(0).cast("long")
    for a, n in shape.items():
        out = out * -(-n // chunk[a]) + F.expr(f"{a} div {chunk[a]}")
    return out


def chunk_grid(spark, shape: dict[str, int], chunk: dict[str, int]) -> DataFrame:
    """(chunk_id, <axis>_start, <axis>_stop) of every chunk, cut at the edges."""
    grid = {a: -(-n // chunk[a]) for a, n in shape.items()}
    left, df = math.prod(grid.values()), spark.range(math.prod(grid.values())).withColumnRenamed("id", "chunk_id")
    for a, g in grid.items():
        left //= g
        start = F.expr(f"(chunk_id div {left}) % {g} * {chunk[a]}")
        df = df.withColumn(f"{a}_start", start).withColumn(f"{a}_stop", F.least(start + chunk[a], F.lit(shape[a]).cast("long")))
    return df


def shard_id(chunks: DataFrame, shape: dict[str, int], shard: dict[str, int]) -> Column:
    out = F.lit(0).cast("long")
    for a, n in shape.items():
        out = out * -(-n // shard[a]) + F.expr(f"{a}_start div {shard[a]}")
    return out


def chunk_ranges(spark, total: int, jobs: int) -> DataFrame:
    """(job, start, stop): ranges whose sizes differ by one at most, larger ones first."""
    q, r = divmod(total, jobs)
    job = F.col("id")
    start = job * q + F.least(job, F.lit(r).cast("long"))
    return spark.range(jobs).select(job.alias("job"), start.alias("start"), (start + q + F.when(job < r, 1).otherwise(0)).alias("stop"))


def rechunk(df: DataFrame, shape: dict[str, int], chunk: dict[str, int]) -> DataFrame:
    """(chunk_id, n, values): each chunk's values in row-major order; a chunk is bounded by its size."""
    axes = list(shape)
    return df.groupBy(chunk_id(shape, chunk).alias("chunk_id")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct(*axes, "v"))).alias("s")).select("chunk_id", "n", F.col("s.v").alias("values"))


#: What an element type is in a table.
SPARK_TYPES = {"int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)", "float32": "float", "float64": "double"}


def to_chunks(df: DataFrame, shape: dict[str, int], chunk: dict[str, int], fill: float = 0, dtype: str = "int64") -> DataFrame:
    """(chunk_id, origin, extent, payload): dense little-endian values of each chunk; other types than int64 have a column dtype."""
    axes, sizes, kind = list(shape), list(chunk.values()), np.dtype(dtype).newbyteorder("<").str
    counts = [-(-shape[a] // chunk[a]) for a in axes]

    def pack(pdf):
        import pandas as pd

        number = int(pdf["chunk_id"].iloc[0])
        start = [int(i) * c for i, c in zip(np.unravel_index(number, counts), sizes, strict=True)]
        extent = [min(c, shape[a] - s) for a, c, s in zip(axes, sizes, start, strict=True)]
        block = np.full(extent, fill, kind)
        values = pdf["v"].to_numpy()
        block[tuple(pdf[a].to_numpy() - s for a, s in zip(axes, start, strict=True))] = [int(v) for v in values] if values.dtype == object else values
        return pd.DataFrame({"chunk_id": [number], "origin": [start], "extent": [extent], "payload": [block.tobytes()]} | ({"dtype": [kind]} if typed else {}))

    typed = dtype != "int64"
    keyed = df.select(chunk_id(shape, chunk).alias("chunk_id"), *[F.col(a).cast("long") for a in axes], F.col("v").cast(SPARK_TYPES[dtype]))
    return keyed.groupBy("chunk_id").applyInPandas(pack, "chunk_id long, origin array<long>, extent array<long>, payload binary" + ", dtype string" * typed)


def from_chunks(chunks: DataFrame, axes: list[str], dtype: str = "int64") -> DataFrame:
    """Chunks back to one row per element, as ``dtype``; an error where a value would change."""
    schema = ", ".join(f"{a} long" for a in axes) + f", v {SPARK_TYPES[dtype]}"
    typed, target = "dtype" in chunks.columns, np.dtype(dtype)

    def values(payload: bytes, kind: str):
        import decimal

        stored = np.frombuffer(payload, kind)
        out = stored.astype(target)
        if target.kind != "f" and (stored.dtype.kind == "f" or (stored.dtype.kind != target.kind and stored.size and (int(stored.max()) > np.iinfo(target).max or int(stored.min()) < np.iinfo(target).min))):
            raise ValueError(f"values of {kind} do not fit {dtype}")
        return [decimal.Decimal(int(v)) for v in out] if dtype == "uint64" else out

    def unpack(batches):
        import pandas as pd

        for pdf in batches:
            kinds = pdf["dtype"] if typed else ["<i8"] * len(pdf)
            for origin, extent, payload, kind in zip(pdf["origin"], pdf["extent"], pdf["payload"], kinds, strict=True):
                at = np.indices(tuple(extent)).reshape(len(axes), -1) + np.asarray(origin)[:, None]
                yield pd.DataFrame(dict(zip(axes, at, strict=True)) | {"v": values(payload, kind)})

    return chunks.select("origin", "extent", "payload", *(["dtype"] if typed else [])).mapInPandas(unpack, schema)


def sorted_blocks(a: np.ndarray, factor: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The elements of ``a`` sorted by block and value, and where each block begins and how many it has."""
    counts = [-(-n // f) for n, f in zip(a.shape, factor, strict=True)]
    of = np.ravel_multi_index([i // f for i, f in zip(np.indices(a.shape), factor, strict=True)], counts).ravel()
    by = np.lexsort((a.ravel(), of))
    n = np.bincount(of)
    return a.ravel()[by], np.cumsum(n) - n, n


def _block_sums(a: np.ndarray, cut: list[np.ndarray]) -> np.ndarray:
    for axis, c in enumerate(cut):
        a = np.add.reduceat(a, c, axis=axis)
    return a


def mean_block(a: np.ndarray, cut: list[np.ndarray]) -> np.ndarray:
    """Means of the blocks that begin at ``cut``; integers half to even, exact for all of 64 bits: their halves of 32 bits are summed apart."""
    sizes = [np.diff(np.append(c, n)) for c, n in zip(cut, a.shape, strict=True)]
    n = np.ones([1] * a.ndim, np.int64)
    for axis, size in enumerate(sizes):
        n = n * size.reshape([-1 if i == axis else 1 for i in range(a.ndim)])
    if a.dtype.kind == "f":
        return _block_sums(a.astype(float), cut) / n
    if a.dtype.itemsize < 8:
        q, r = np.divmod(_block_sums(a.astype(np.int64), cut), n)
    else:
        half = np.array(32, a.dtype)
        high, low = _block_sums((a >> half).astype(np.int64), cut), _block_sums((a & np.array(0xFFFFFFFF, a.dtype)).astype(np.int64), cut)
        q_high, rest = np.divmod(high, n)
        q_low, r = np.divmod((rest << 32) + low, n)
        q = (q_high.astype(a.dtype) << half) + q_low.astype(a.dtype)
    return q + ((2 * r > n) | ((2 * r == n) & (q % 2 == 1))).astype(q.dtype)


def reduce_block(a: np.ndarray, factor: list[int], method: str) -> np.ndarray:
    """One chunk reduced; ties of the mode go to the smallest value, the median is the lower one."""
    cut = [np.arange(0, n, f) for n, f in zip(a.shape, factor, strict=True)]
    if method == "stride":
        return a[tuple(slice(None, None, f) for f in factor)]
    if method in ("min", "max"):
        for axis, c in enumerate(cut):
            a = (np.minimum if method == "min" else np.maximum).reduceat(a, c, axis=axis)
        return a
    if method == "mean":
        return mean_block(a, cut)
    if method not in METHODS:
        raise ValueError(method)
    values, start, n = sorted_blocks(a, factor)
    if method == "median":
        return values[start + (n - 1) // 2].reshape([len(c) for c in cut])
    block = np.repeat(np.arange(len(n)), n)
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (block[1:] != block[:-1])
    first = np.flatnonzero(new)  # of each run of equal values in a block
    run = np.diff(np.append(first, len(values)))
    best = np.lexsort((first, -run, block[first]))
    return values[first[best[np.unique(block[first][best], return_index=True)[1]]]].reshape([len(c) for c in cut])


def reduce_chunks(chunks: DataFrame, factor: list[int], method: str = "mean") -> DataFrame:
    """Blocks inside chunks reduced where they are, in their own type; chunk origins must be multiples of the factors."""
    typed = "dtype" in chunks.columns

    def block(pdfs):
        import pandas as pd

        for pdf in pdfs:
            rows, kinds = [], pdf["dtype"] if typed else ["<i8"] * len(pdf)
            for number, origin, extent, payload, kind in zip(pdf["chunk_id"], pdf["origin"], pdf["extent"], pdf["payload"], kinds, strict=True):
                if any(o % f for o, f in zip(origin, factor, strict=True)):
                    raise ValueError("a block crosses chunks: rechunk first")
                out = reduce_block(np.frombuffer(payload, kind).reshape(tuple(extent)), factor, method)
                rows.append((number, [o // f for o, f in zip(origin, factor, strict=True)], list(out.shape), np.ascontiguousarray(out, kind).tobytes(), kind))
            yield pd.DataFrame(rows, columns=["chunk_id", "origin", "extent", "payload", "dtype"]).iloc[:, : 4 + typed]

    kept = chunks.select("chunk_id", "origin", "extent", "payload", *(["dtype"] if typed else []))
    return kept.mapInPandas(block, "chunk_id long, origin array<long>, extent array<long>, payload binary" + ", dtype string" * typed)

"""Upsampling: each output place looks up its source places on one axis after the other.

``upsample`` works on one row per element and suits what is small or sparse. ``upsample_chunks`` works on
chunks: every output chunk gets the pieces of the source chunks that it needs, with a halo, so that
a source value moves about once and nothing is shuffled by element.
"""

from __future__ import annotations

import itertools
import warnings

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def out_extent(n: int, zoom: float) -> int:
    return round(n * zoom)


def lookup(spark, n: int, out: int, order: int) -> DataFrame:
    """(k, i, w): source places and weights of output place k; both ends are clamped. ``out`` rows, twice for order 1."""
    at = f"least(greatest((k + 0.5D) * {n} / {out} - 0.5D, 0D), {n - 1}D)"
    rows = spark.range(out).select(F.col("id").alias("k")).withColumn("s", F.expr(at))
    if order == 0:
        return rows.select("k", F.floor(F.col("s") + 0.5).cast("long").alias("i"), F.lit(1.0).alias("w"))
    low, w = F.floor("s").cast("long"), F.col("s") - F.floor("s")
    return rows.select("k", F.explode(F.array(F.struct(low.alias("i"), (1 - w).alias("w")), F.struct(F.least(low + 1, F.lit(n - 1).cast("long")).alias("i"), w.alias("w")))).alias("p")).select("k", "p.i", "p.w").where("w > 0")


def upsample(df: DataFrame, extents: dict[str, tuple[int, int]], method: str = "trilinear") -> DataFrame:
    """``axis=(n, out)``; nearest keeps values, trilinear rounds halves away from zero, like the chunk form. Lookups grow with an axis, not the volume."""
    if method not in ("nearest", "trilinear"):
        raise ValueError(f"{method} needs chunks: upsample_chunks")
    kind, axes = dict(df.dtypes)["v"], [c for c in df.columns if c != "v"]
    out = df.withColumn("w", F.lit(1.0))
    for a, (n, m) in extents.items():
        table = lookup(df.sparkSession, n, m, 0 if method == "nearest" else 1).select(F.col("k").alias(f"{a}_k"), F.col("i").alias(a), F.col("w").alias(f"{a}_w"))
        out = out.join(table, a).withColumn("w", F.col("w") * F.col(f"{a}_w")).drop(a, f"{a}_w").withColumnRenamed(f"{a}_k", a)
    if method == "nearest":
        return out.select(*axes, "v")
    total = F.round(F.sum(F.col("v") * F.col("w")), 6)
    return out.groupBy(*axes).agg((total if kind in ("float", "double") else F.signum(total) * F.floor(F.abs(total) + 0.5)).cast(kind).alias("v"))


ORDERS = {"nearest": 0, "trilinear": 1, "cubic": 3}

#: Places on either side that a cubic spline's coefficient is summed over; the next weight is below 1e-13 of the first.
REACH = 24

#: Pieces of chunks sent in one batch.
PIECES = 64


def resolve(method: str, is_label: bool = False) -> str:
    """``auto`` is nearest for labels and trilinear for images."""
    if method == "auto":
        return "nearest" if is_label else "trilinear"
    if method not in ORDERS:
        raise ValueError(f"unknown method {method}: auto, {', '.join(ORDERS)}")
    return method


def window(k0: int, k1: int, n: int, out: int, order: int) -> tuple[int, int]:
    """The source places that output places k0 to k1 - 1 of one axis are made of."""
    if n == out:
        return k0, k1
    first, last = ((k + 0.5) * n / out - 0.5 for k in (k0, k1 - 1))
    if order == 0:
        low, high = int(np.floor(first + 0.5)), int(np.floor(last + 0.5))
    else:
        more = 1 + REACH if order == 3 else 0
        low, high = int(np.floor(first)) - more, int(np.floor(last)) + 1 + more
    return min(max(low, 0), n - 1), min(max(high, 0), n - 1) + 1


def weights(k0: int, k1: int, n: int, out: int, order: int) -> np.ndarray:
    """What each place of the ``window`` adds to each output place (linear or cubic); beyond its ends an axis repeats its last value."""
    low, high = window(k0, k1, n, out, order)
    s, row, w = (np.arange(k0, k1) + 0.5) * n / out - 0.5, np.arange(k1 - k0), np.zeros((k1 - k0, high - low))
    if order == 1:
        s = np.clip(s, 0, n - 1)
        at = np.floor(s).astype(int)
        np.add.at(w, (row, at - low), 1 - (s - at))
        np.add.at(w, (row, np.minimum(at + 1, n - 1) - low), s - at)
        return w
    at = np.floor(s).astype(int)
    t = s - at
    basis = ((1 - t) ** 3 / 6, (3 * t**3 - 6 * t**2 + 4) / 6, (-3 * t**3 + 3 * t**2 + 3 * t + 1) / 6, t**3 / 6)
    for m in range(-REACH, REACH + 1):  # a coefficient is the sum of values by powers of the filter's pole
        for place, b in zip((at - 1, at, at + 1, at + 2), basis, strict=True):
            np.add.at(w, (row, np.clip(place + m, 0, n - 1) - low), b * np.sqrt(3) * (np.sqrt(3) - 2) ** abs(m))
    return w


def rounded(x: np.ndarray, kind: np.dtype) -> np.ndarray:
    """Floats as ``kind``: halves away from zero, cut to the type's range."""
    if kind.kind == "f":
        return x.astype(kind)
    info, x = np.iinfo(kind), np.round(x, 6)
    top = float(info.max) if kind.itemsize < 8 else np.nextafter(float(info.max), 0)
    return np.clip(np.sign(x) * np.floor(np.abs(x) + 0.5), float(info.min), top).astype(kind)


def upsample_chunks(chunks: DataFrame, extents: dict[str, tuple[int, int]], chunk: dict[str, int], method: str = "trilinear", fill: float = 0) -> DataFrame:
    """Chunks of the resampled array: ``extents`` has (n, out) and ``chunk`` the new chunk size of every axis, in order.

    Places that no source chunk holds are ``fill``. Nearest keeps every value as it is; the other methods compute in
    doubles, so integers beyond 2 ** 53 lose their last digits. A task holds one output chunk and its window at a time.
    """
    order, axes, typed = ORDERS[method], list(extents), "dtype" in chunks.columns
    size, grid = [chunk[a] for a in axes], [-(-extents[a][1] // chunk[a]) for a in axes]
    span = lambda i, t: (t * size[i], min((t + 1) * size[i], extents[axes[i]][1]))  # noqa: E731  output places of chunk t on axis i

    def reached(i: int, start: int, stop: int) -> list[tuple[int, int, int]]:
        """(t, low, high): output chunks on axis i that need source places low to high of start to stop."""
        n, out = extents[axes[i]]
        first, last = (int((p + 0.5) * out / n) // size[i] for p in (start - REACH - 3, stop + REACH + 3))
        found = []
        for t in range(max(first - 1, 0), min(last + 1, grid[i] - 1) + 1):
            low, high = window(*span(i, t), n, out, order)
            if max(low, start) < min(high, stop):
                found.append((t, max(low, start), min(high, stop)))
        return found

    def cut(batches):
        import pandas as pd

        names = ["chunk_id", "origin", "extent", "payload", "dtype"]
        for pdf in batches:
            kinds = pdf["dtype"] if typed else ["<i8"] * len(pdf)
            for origin, extent, payload, kind in zip(pdf["origin"], pdf["extent"], pdf["payload"], kinds, strict=True):
                block = np.frombuffer(payload, kind).reshape(tuple(extent))
                places = itertools.product(*[reached(i, int(o), int(o + e)) for i, (o, e) in enumerate(zip(origin, extent, strict=True))])
                while some := list(itertools.islice(places, PIECES)):
                    parts = [block[tuple(slice(lo - o, hi - o) for (_, lo, hi), o in zip(p, origin, strict=True))] for p in some]
                    yield pd.DataFrame([(int(np.ravel_multi_index([t for t, _, _ in p], grid)), [lo for _, lo, _ in p], list(part.shape), part.tobytes(), kind) for p, part in zip(some, parts, strict=True)], columns=names)

    def grow(pdf):
        import pandas as pd

        number, kind = int(pdf["chunk_id"].iloc[0]), np.dtype(pdf["dtype"].iloc[0])
        spans = [span(i, int(t)) for i, t in enumerate(np.unravel_index(number, grid))]
        windows = [window(*s, *extents[a], order) for s, a in zip(spans, axes, strict=True)]
        x = np.full([hi - lo for lo, hi in windows], fill, kind)
        for origin, extent, payload in zip(pdf["origin"], pdf["extent"], pdf["payload"], strict=True):
            x[tuple(slice(o - lo, o - lo + e) for o, e, (lo, _) in zip(origin, extent, windows, strict=True))] = np.frombuffer(payload, kind).reshape(tuple(extent))
        changed = [i for i, a in enumerate(axes) if extents[a][0] != extents[a][1]]
        for i in changed:
            n, out = extents[axes[i]]
            if order == 0:
                at = np.floor(np.clip((np.arange(*spans[i]) + 0.5) * n / out - 0.5, 0, n - 1) + 0.5).astype(int)
                x = np.take(x, at - windows[i][0], axis=i)
            else:
                x = np.moveaxis(np.tensordot(weights(*spans[i], n, out, order), x.astype(float), axes=(1, i)), 0, i)
        x = rounded(x, kind) if changed and order else x
        row = {"chunk_id": [number], "origin": [[k0 for k0, _ in spans]], "extent": [list(x.shape)], "payload": [np.ascontiguousarray(x, kind).tobytes()]}
        return pd.DataFrame(row | ({"dtype": [kind.str]} if typed else {}))

    schema = "chunk_id long, origin array<long>, extent array<long>, payload binary"
    pieces = chunks.select("origin", "extent", "payload", *(["dtype"] if typed else [])).mapInPandas(cut, schema + ", dtype string")
    return pieces.groupBy("chunk_id").applyInPandas(grow, schema + ", dtype string" * typed)


def upsample_to_isotropic(chunks: DataFrame, shape: dict[str, int], voxel: dict[str, float], chunk: dict[str, int], target: float | None = None, method: str = "auto", is_label: bool = False, space: str = "zyx") -> tuple[DataFrame, dict[str, int], dict[str, float]]:
    """Chunks, shape and voxel sizes with all spatial axes at ``target``, which is the smallest size if not given.

    An error where every size is within a hundredth of the target. A spatial axis of size 1 beside larger ones is warned of:
    it may be a channel or time axis.
    """
    sizes = {a: voxel[a] for a in shape if a in space}
    if not sizes:
        raise ValueError("no spatial axis")
    to = min(sizes.values()) if target is None else target
    if all(abs(v - to) / to < 0.01 for v in sizes.values()):
        raise ValueError(f"already isotropic at {to}: {sizes}")
    suspect = [a for a, v in sizes.items() if v == 1.0]
    if suspect and any(v > 1.0 for v in sizes.values()):
        warnings.warn(f"axes {suspect} have voxel size 1 beside larger ones: they may be no spatial axes", stacklevel=2)
    extents = {a: (n, out_extent(n, sizes[a] / to if a in sizes else 1.0)) for a, n in shape.items()}
    out = upsample_chunks(chunks, extents, chunk, resolve(method, is_label))
    return out, {a: m for a, (_, m) in extents.items()}, voxel | dict.fromkeys(sizes, to)

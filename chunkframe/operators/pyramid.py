"""Pyramid planning (arithmetic on shapes and voxel sizes) and its chained or direct execution."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import downsample

SPATIAL = ("x", "y", "z")


def factors(voxel: list[float], axes: list[str], low: float = 0.5, high: float = 2.0) -> list[int]:
    """2 for every spatial axis, but one that is coarse (fine) against all others is left out (taken alone)."""
    at = [i for i, a in enumerate(axes) if a in SPATIAL]
    out = [2 if i in at else 1 for i in range(len(axes))]
    if len(at) > 1:
        for i in at:
            ratios = [voxel[i] / voxel[j] for j in at if j != i]
            if min(ratios) >= high:
                return [1 if j == i or j not in at else 2 for j in range(len(axes))]
            if max(ratios) <= low:
                return [2 if j == i else 1 for j in range(len(axes))]
    return out


def power_of_two_error(magnification: float) -> float:
    nearest = 2 ** round(math.log2(magnification))
    return abs(magnification - nearest) / nearest


def plan(shape: list[int], voxel: list[float], axes: list[str], item_bytes: int = 2, least_bytes: int | None = None, least_shape: int | list[int] | None = None, most: int = 20, chunk: list[int] | None = None) -> list[dict]:
    """One dict per level from 0: shape, factor, cumulative factor, voxel size and translation.

    Stops when a level would be smaller than ``least_bytes``, or along every axis (channels and times too) than ``least_shape``, one number
    or one for each axis; when the whole magnification of a spatial axis would be 4 % off a power of 2; or after ``most``.
    The limits are those of a ``chunk`` where one is given, else 512 KiB and 32.
    """
    if chunk is not None:
        least_bytes = math.prod(chunk) * item_bytes if least_bytes is None else least_bytes
        least_shape = list(chunk) if least_shape is None else least_shape
    least_bytes = 512 << 10 if least_bytes is None else least_bytes
    least = [32 if least_shape is None else least_shape] * len(shape) if not isinstance(least_shape, list) else least_shape
    levels = [{"level": 0, "shape": list(shape), "factor": [1] * len(shape), "cumulative": [1] * len(shape), "voxel": list(voxel), "translation": [0.0] * len(shape)}]
    floor_shape = list(shape)
    while len(levels) <= most:
        last = levels[-1]
        f = factors(last["voxel"], axes)
        floor_shape = [max(1, n // k) for n, k in zip(floor_shape, f, strict=True)]
        if math.prod(floor_shape) * item_bytes < least_bytes or all(n < m for n, m in zip(floor_shape, least, strict=True)):
            break
        if any(power_of_two_error(n / m) > 0.04 for n, m, a in zip(shape, floor_shape, axes, strict=True) if a in SPATIAL):
            break
        cumulative = [c * k for c, k in zip(last["cumulative"], f, strict=True)]
        levels.append({
            "level": len(levels), "factor": f, "cumulative": cumulative,
            "shape": [-(-n // k) for n, k in zip(last["shape"], f, strict=True)],
            "voxel": [v * k for v, k in zip(last["voxel"], f, strict=True)],
            "translation": [(c - 1) * v / 2 for c, v in zip(cumulative, voxel, strict=True)],
        })
    return levels


def _factors(voxel: np.ndarray, at: list[int], low: float = 0.5, high: float = 2.0) -> np.ndarray:
    """``factors`` of many volumes with the same axes; ``at``: the places of the spatial ones."""
    out = np.ones(voxel.shape, np.int64)
    out[:, at] = 2
    open_ = np.full(len(voxel), len(at) > 1)
    for i in at if len(at) > 1 else []:
        ratios = voxel[:, [i]] / voxel[:, [j for j in at if j != i]]
        coarse = open_ & (ratios.min(axis=1) >= high)
        fine = open_ & ~coarse & (ratios.max(axis=1) <= low)
        out[coarse, i] = 1
        out[np.ix_(fine, [j for j in at if j != i])] = 1
        open_ &= ~(coarse | fine)
    return out


def plan_many(shape: np.ndarray, voxel: np.ndarray, axes: list[str], item_bytes: int = 2, least_bytes: int | None = None, least_shape: int | list[int] | None = None, most: int = 20, chunk: list[int] | None = None) -> list[tuple[np.ndarray, dict[str, np.ndarray]]]:
    """``plan`` of many volumes (rows) with the same axes: for each level the rows that have it, and its values."""
    if chunk is not None:
        least_bytes = math.prod(chunk) * item_bytes if least_bytes is None else least_bytes
        least_shape = list(chunk) if least_shape is None else least_shape
    least_bytes = 512 << 10 if least_bytes is None else least_bytes
    least, at = np.asarray(32 if least_shape is None else least_shape), [i for i, a in enumerate(axes) if a in SPATIAL]
    rows, ones, first = np.arange(len(shape)), np.ones(shape.shape, np.int64), shape
    now = {"shape": shape, "factor": ones, "cumulative": ones, "voxel": voxel, "translation": np.zeros(voxel.shape)}
    out, floor_shape = [(rows, now)], shape
    while len(out) <= most and len(rows):
        f = _factors(now["voxel"], at)
        floor_shape = np.maximum(1, floor_shape // f)
        small = (floor_shape.astype(float).prod(axis=1) * item_bytes < least_bytes) | (floor_shape < least).all(axis=1)
        grown = first[rows][:, at] / floor_shape[:, at]
        nearest = 2.0 ** np.rint(np.log2(grown))
        on = ~small & ~(np.abs(grown - nearest) / nearest > 0.04).any(axis=1)
        rows, floor_shape, f = rows[on], floor_shape[on], f[on]
        last = {name: values[on] for name, values in now.items()}
        cumulative = last["cumulative"] * f
        now = {"shape": -(-last["shape"] // f), "factor": f, "cumulative": cumulative, "voxel": last["voxel"] * f, "translation": (cumulative - 1) * voxel[rows] / 2}
        out.append((rows, now))
    return out


def plans(volumes: DataFrame, key: str, **limits) -> DataFrame:
    """(key, level, shape, factor, cumulative, voxel, translation): the levels of every row of ``volumes`` (key, shape, voxel, axes)."""
    names = ("level", "shape", "factor", "cumulative", "voxel", "translation")
    kind = dict(volumes.dtypes)[key]

    def run(batches):
        for batch in batches:
            alike: dict[tuple, list[int]] = {}
            for i, axes in enumerate(batch.column(3).to_pylist()):
                alike.setdefault(tuple(axes), []).append(i)
            for axes, at in alike.items():
                part = batch.take(pa.array(at))
                shape, voxel = (part.column(c).flatten().to_numpy(zero_copy_only=False).reshape(len(at), len(axes)).astype(kind) for c, kind in ((1, np.int64), (2, float)))
                levels = plan_many(shape, voxel, list(axes), **limits)
                rows = np.concatenate([r for r, _ in levels])
                columns = {key: part.column(0).take(pa.array(rows)), "level": pa.array(np.repeat(np.arange(len(levels)), [len(r) for r, _ in levels]), pa.int32())}
                offsets = pa.array(np.arange(len(rows) + 1) * len(axes), pa.int32())
                for n in names[1:]:
                    values = np.concatenate([x[n] for _, x in levels]).astype(np.int64 if n in ("shape", "factor", "cumulative") else float)
                    columns[n] = pa.ListArray.from_arrays(offsets, pa.array(values.ravel()))
                yield pa.RecordBatch.from_pydict(columns)

    return volumes.select(key, "shape", "voxel", "axes").mapInArrow(run, f"{key} {kind}, level int, shape array<long>, factor array<long>, cumulative array<long>, voxel array<double>, translation array<double>")


def chained(base: DataFrame, steps: list[dict[str, int]], method: str = "mean", store=None) -> list[DataFrame]:
    """Each level from the one before; ``store(df, level)`` writes a level and reads it back."""
    out = [base]
    for i, f in enumerate(steps):
        level = downsample(out[-1], method, **f)
        out.append(store(level, i + 1) if store else level)
    return out


def direct(base: DataFrame, steps: list[dict[str, int]], method: str = "mean") -> DataFrame:
    """The last level straight from the base, by the product of the factors."""
    return downsample(base, method, **reduce(lambda a, b: {k: a.get(k, 1) * b.get(k, 1) for k in {*a, *b}}, steps))

"""A pyramid that is written: levels stored one by one, then the lists of levels of its group and of the groups above.

Each level is read back from where the one before was stored, so no level is computed twice and no lineage grows. A level
is put in its place when all of it is written, so a run that was interrupted goes on after the last level there is.
Metadata are made from the levels that are found, so they are the same after one run or several.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from ..operators import pyramid
from ..operators.redistribute import downsample_chunks
from . import containers, zarr

#: Where a level keeps what it was made with, and the group how.
STAMP = "chunkframe"
BLOCK_METHODS = ("mean", "mode", "median", "min", "max")


def _file(format: str) -> str:
    return {"zarr3": "zarr.json", "zarr2": ".zattrs"}[format]


def format_at(spark: SparkSession, array: str) -> str:
    return zarr.describe(spark, array)["format"]


def _holder(meta: dict, format: str) -> dict:
    """Where a group's metadata have the multiscales and labels."""
    return meta.setdefault("attributes", {}).setdefault("ome", {"version": "0.5"}) if format == "zarr3" else meta


def read_group(spark: SparkSession, path: str, format: str) -> dict | None:
    return zarr.read_json(spark, f"{path}/{_file(format)}")


def write_group(path: str, meta: dict, format: str) -> None:
    if format == "zarr2":
        zarr.put(f"{path}/.zgroup", json.dumps({"zarr_format": 2}).encode())
    else:
        meta = {"zarr_format": 3, "node_type": "group"} | meta
    zarr.put(f"{path}/{_file(format)}", json.dumps(meta).encode())


def level_name(prefix: str, level: int) -> str:
    return f"{prefix}{level}"


def level_prefix(spark: SparkSession, group: str) -> str:
    """``s`` or nothing, by which first level is there; ``s`` where none is."""
    return "" if not containers.exists(spark, f"{group}/s0") and containers.exists(spark, f"{group}/0") else "s"


def found_levels(spark: SparkSession, group: str, prefix: str | None = None) -> list[dict]:
    """The descriptions of the levels from 0 to the last before the first gap."""
    prefix = level_prefix(spark, group) if prefix is None else prefix
    levels: list[dict] = []
    while containers.exists(spark, path := f"{group}/{level_name(prefix, len(levels))}"):
        levels.append(zarr.describe(spark, path) | {"name": level_name(prefix, len(levels))})
    return levels


def datasets(levels: list[dict], scale0: list[float], method: str | None = "mean") -> list[dict]:
    """The list of levels: a scale by the factor a level is stamped with, or by the rounded ratio of the shapes; a shift for block methods."""
    out = []
    for i, level in enumerate(levels):
        factor = level["attributes"].get(STAMP, {}).get("cumulative_factor") or [round(a / b) for a, b in zip(levels[0]["shape"], level["shape"], strict=True)]
        scale = list(scale0) if i == 0 else [s * f for s, f in zip(scale0, factor, strict=True)]
        shift = [(a - b) * 0.5 if method is None or method in BLOCK_METHODS else 0.0 for a, b in zip(scale, scale0, strict=True)]
        steps = [{"type": "scale", "scale": scale}] + ([{"type": "translation", "translation": shift}] if i and any(shift) else [])
        out.append({"path": level["name"], "coordinateTransformations": steps})
    return out


def update_multiscale(spark: SparkSession, group: str, method: str | None = "mean", prefix: str | None = None) -> list[dict]:
    """The group's list of levels made anew from those that are there, up to the first gap; other metadata stay. The list."""
    levels = found_levels(spark, group, prefix)
    if not levels:
        raise FileNotFoundError(f"no levels at {group}")
    format = levels[0]["format"]
    with containers.locked(spark, group):
        meta = read_group(spark, group, format) or {}
        holder = _holder(meta, format)
        scales = holder.setdefault("multiscales", [{}])
        first = scales[0] if scales else {}
        holder["multiscales"] = [first, *scales[1:]]
        told = [t["scale"] for d in first.get("datasets", [])[:1] for t in d.get("coordinateTransformations", []) if t["type"] == "scale"]
        first["datasets"] = datasets(levels, told[0] if told else [1.0] * len(levels[0]["shape"]), method)
        attributes = meta["attributes"] if format == "zarr3" else meta
        attributes["_software"] = {"name": "chunkframe", "version": "1"}
        write_group(group, meta, format)
    return first["datasets"]


def propagate(spark: SparkSession, group: str, root: str) -> list[str]:
    """A group's list of levels carried to the groups above it, up to ``root``; those that were changed.

    A group that lists labels and has no image only gets the name of the label; one with an image, or with neither, gets the levels
    behind the path of the group, unless they are those of a label, which it lists by name.
    """
    group, root = group.rstrip("/"), root.rstrip("/")
    if not group.startswith(root + "/"):
        raise ValueError(f"{group} is not inside {root}")
    format = zarr.describe(spark, f"{group}/{found_levels(spark, group)[0]['name']}")["format"]
    inner = _holder(read_group(spark, group, format) or {}, format).get("multiscales", [])
    if not inner:
        return []
    parts, changed = group[len(root) + 1 :].split("/"), []
    for depth in range(len(parts) - 1, -1, -1):
        parent, key = "/".join([root, *parts[:depth]]), "/".join(parts[depth:])
        is_label = "labels" in parts[:-1]
        with containers.locked(spark, parent):
            meta = read_group(spark, parent, format)
            if meta is None and depth and parts[depth - 1] != "labels":
                continue  # a folder that is no group
            meta = meta or {}
            holder = _holder(meta, format)
            if is_label:
                name = key.removeprefix("labels/")
                labels = holder.setdefault("labels", [])
                if name not in labels:
                    labels.append(name)
            else:
                moved = [d | {"path": f"{key}/{d['path']}"} for d in inner[0].get("datasets", [])]
                scales = holder.get("multiscales") or [{"name": inner[0].get("name", "image"), "type": inner[0].get("type", "image")}]
                scales[0] = scales[0] | {"axes": inner[0].get("axes", scales[0].get("axes", [])), "datasets": moved}
                holder["multiscales"] = scales
            write_group(parent, meta, format)
            changed.append(parent)
    return changed


def _axes_and_voxel(spark: SparkSession, group: str, info: dict) -> tuple[list[str], list[float]]:
    """The axes and sizes of the first level, from the group's metadata; unnamed axes are by rank, and sizes 1."""
    scales = _holder(read_group(spark, group, info["format"]) or {}, info["format"]).get("multiscales") or [{}]
    n = len(info["shape"])
    axes = [a["name"] for a in scales[0].get("axes", [])] or info["names"] or list("tczyx"[5 - n :]) if n <= 5 else [f"dim_{i}" for i in range(n)]
    told = [t["scale"] for d in scales[0].get("datasets", [])[:1] for t in d.get("coordinateTransformations", []) if t["type"] == "scale"]
    return list(axes), list(told[0]) if told else [1.0] * n


def generate_pyramid(spark: SparkSession, group: str, method: str = "mean", root: str | None = None, codec: str | None = "zstd", steps: list[list[int]] | None = None, **limits) -> list[dict]:
    """Levels 1 and up of the group whose level 0 is stored, and the metadata; the list of levels.

    ``steps``: the factors of each level; else those of ``pyramid.plan`` with ``limits``. Levels have the chunks and shards of the first, no longer than they are
    themselves. A level that is there with the shape it should have is kept; one of another shape is an error. ``root``: the container whose metadata follow.
    """
    group = group.rstrip("/")
    prefix = level_prefix(spark, group)
    base = f"{group}/{level_name(prefix, 0)}"
    info = zarr.describe(spark, base)
    if info["format"] not in ("zarr3", "zarr2"):
        raise ValueError(f"pyramids of {info['format']} are not written")
    axes, voxel = _axes_and_voxel(spark, group, info)
    if steps is None:
        steps = [x["factor"] for x in pyramid.plan(info["shape"], voxel, axes, zarr.np.dtype(info["dtype"]).itemsize, **limits)[1:]]
    last, cumulative = info, [1] * len(info["shape"])
    for i, factor in enumerate(steps, 1):
        path, before = f"{group}/{level_name(prefix, i)}", f"{group}/{level_name(prefix, i - 1)}"
        shape = [-(-n // f) for n, f in zip(last["shape"], factor, strict=True)]
        cumulative = [c * f for c, f in zip(cumulative, factor, strict=True)]
        if containers.exists(spark, path):
            if zarr.describe(spark, path)["shape"] != shape:
                raise ValueError(f"the level at {path} has another shape")
        else:
            _write_level(spark, before, path, last, info, shape, factor, cumulative, method, codec)
        last = zarr.describe(spark, path)
    listed = update_multiscale(spark, group, method, prefix)
    if root and root.rstrip("/") != group:
        propagate(spark, group, root)
    return listed


def _write_level(spark: SparkSession, before: str, path: str, last: dict, info: dict, shape: list[int], factor: list[int], cumulative: list[int], method: str, codec: str | None) -> None:
    chunk = [min(c, n) for c, n in zip(info["chunk"], shape, strict=True)]
    shard = [min(s, -(-n // c) * c) // c * c for s, n, c in zip(info["shard"], shape, chunk, strict=True)] if info.get("shard") else None
    level: DataFrame = downsample_chunks(zarr.read_chunks(spark, before), last["shape"], factor, chunk, method, last["chunk"])
    options = {"format": info["format"], "codec": codec, "fill": info["fill"], "attributes": {STAMP: {"factor": factor, "cumulative_factor": cumulative, "method": method}}}
    if info["format"] == "zarr3":
        options |= {"names": info["names"], "shard": shard}
    dtype = {v: k for k, v in zarr.DTYPES.items()}[info["dtype"].lstrip("<>|=")]
    containers.write_array(spark, level, path, shape, chunk, dtype, "error", **options)

"""Scalar functions on axes, units, types, colours, channels, names and metadata, as Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once a row, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def axis_name(a: Column) -> Column:
    a = F.lower(a)
    return F.when(a == "channel", "c").when(a == "v", "t").otherwise(a)


def axis_type(a: Column) -> Column:
    a = F.lower(a)
    return F.when(a.isin("c", "channel"), "channel").when(a.isin("t", "v"), "time").otherwise("space")


def axis_unit(a: Column, space: str = "nanometer", time: str = "millisecond") -> Column:
    """The unit of x, y, z and t; other axes have none."""
    return F.when(F.lower(a).isin("x", "y", "z"), space).when(F.lower(a) == "t", time)


def to_nanometers(value: Column, unit: Column) -> Column:
    u = F.lower(F.trim(F.coalesce(unit, F.lit(""))))
    factor = F.when(u == "", 1.0).when(u.isin("nm") | u.contains("nanom"), 1.0).when(u.isin("um", "µm", "μm") | u.contains("microm") | u.contains("micron"), 1e3).when((u == "mm") | u.contains("millim"), 1e6).when(u.isin("m", "meter", "meters", "metre", "metres"), 1e9).otherwise(1e3)
    return F.when(value.isNull(), 1.0).otherwise(value * factor)


def is_segmentation(dtype: Column) -> Column:
    return dtype.isin("uint32", "uint64", "int32", "int64")


# Words in a name that tell labels.
LABEL_WORDS = "label|mask|seg|annotation|roi|binary|instance"


def classify(name: Column, dtype: Column, encoding: Column) -> Column:
    """segmentation or image: compressed segmentation is one, then words in the name tell, then the element type."""
    compressed = F.coalesce(F.lower(encoding) == "compressed_segmentation", F.lit(False))
    return F.when(compressed | F.lower(name).rlike(LABEL_WORDS) | is_segmentation(F.lower(dtype)), "segmentation").otherwise("image")


def auto_method(path: Column) -> Column:
    """mode where one of the last four parts of a path names labels, else mean; backslashes separate parts too."""
    path = F.replace(path, F.lit("\\"), F.lit("/"))
    tail = F.array_join(F.slice(F.split(F.lower(path), "/"), -4, 4), " ")
    return F.when(F.when(F.size(F.split(path, "/")) < 4, F.lower(path)).otherwise(tail).rlike("label|mask|seg|annotation|binary|instance"), "mode").otherwise("mean")


def rgba_hex(rgba: Column) -> Column:
    """RRGGBB of a signed 32-bit RGBA number."""
    low = rgba.cast("long").bitwiseAND(4294967295)
    return F.lpad(F.hex(F.shiftright(low, 8).bitwiseAND(16777215)), 6, "0")


def wavelength_color(nm: Column) -> Column:
    return F.when(nm < 500, "0000FF").when(nm < 560, "00FF00").otherwise("FF0000")


# The six colours channels take in turn.
CYCLE = ("FF0000", "00FF00", "0000FF", "FF00FF", "FFFF00", "00FFFF")


def told_color(color: Column) -> Column:
    """RRGGBB of a colour as it is told: six letters with or without marks in front, or a signed 32-bit RGBA number; null for anything else."""
    bare = F.regexp_replace(color, "^#+", "")
    return F.when(F.length(bare) == 6, F.upper(bare)).otherwise(rgba_hex(F.trim(bare).try_cast("long")))


def channel_color(color: Column, em: Column, ex: Column, index: Column, n: Column) -> Column:
    turn = F.element_at(F.array(*map(F.lit, CYCLE)), (index % len(CYCLE) + 1).cast("int"))
    return F.coalesce(told_color(color), F.when(n == 1, "808080"), F.when(em.isNotNull(), wavelength_color(em)), F.when(ex.isNotNull(), wavelength_color(ex)), turn)


def wavelength_label(nm: Column) -> Column:
    """A wavelength as a name: whole numbers without a point."""
    return F.when(nm == F.floor(nm), nm.cast("long").cast("string")).otherwise(nm.cast("string"))


def channel_label(name: Column, em: Column, ex: Column, dye: Column, index: Column) -> Column:
    """The name, else a wavelength, else the dye, else a number."""
    said = lambda c: F.when(c != "", c)
    return F.coalesce(said(name), wavelength_label(em), wavelength_label(ex), said(dye), F.concat(F.lit("Channel "), index.cast("string")))


def dtype_window(dtype: Column) -> tuple[Column, Column]:
    low = F.when(dtype == "int8", -128.0).when(dtype == "int16", -32768.0).otherwise(0.0)
    high = F.when(dtype == "uint8", 255.0).when(dtype == "int8", 127.0).when(dtype == "int16", 32767.0).when(dtype.isin("float32", "float64"), 1.0).otherwise(65535.0)
    return low, high


def adaptive_chunk(total_bytes: Column) -> Column:
    gib = 1024**3
    return F.when(total_bytes < 20 * gib, 64).when(total_bytes < 100 * gib, 128).otherwise(256)


def clamp_shard(extent: Column, chunk: Column, shard: Column) -> Column:
    """A shard no longer than the chunks that cover the axis."""
    return F.when(extent < shard, F.least(F.ceil(extent / chunk).cast("long") * chunk, shard)).otherwise(shard)


def label_hue(i: Column) -> Column:
    return (i * 0.618033988749895) % 1.0


def parse_ints(text: Column) -> Column:
    """Positive integers of a list with commas; an error for anything else."""
    parts = F.transform(F.split(text, ","), lambda x: F.trim(x))
    ok = F.forall(parts, lambda x: x.rlike("^[0-9]+$") & (x != "0"))
    return F.when(ok, F.transform(parts, lambda x: x.try_cast("long"))).otherwise(F.raise_error(F.concat(F.lit("bad shape "), text)).cast("array<bigint>"))


def natural_key(name: Column) -> Column:
    """A text that sorts as the name does when its runs of digits compare as numbers."""
    parts = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(p)), "")


def numpy_type(code: Column) -> Column:
    """uint16 for <u2 and the like; other texts stay."""
    kind = F.when(code.substr(2, 1) == "u", "uint").when(code.substr(2, 1) == "i", "int").otherwise("float")
    name = F.concat(kind, (code.substr(3, 1).try_cast("int") * 8).cast("string"))
    return F.when(code.rlike("^(\\|[ui]1|[<>][ui][248]|[<>]f[48])$"), name).otherwise(code)


def human_size(size: Column) -> Column:
    """Bytes with one decimal in the largest unit, up to PB, that keeps them under 1024."""
    text = lambda k, unit: F.format_string(f"%.1f {unit}", F.bround(size / 1024.0**k, 1))
    found = F.when(size < 1024, text(0, "B"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        found = found.when(size < 1024 ** (k + 1), text(k, unit))
    return found.otherwise(text(5, "PB"))


def is_native(path: Column) -> Column:
    """Whether a path is an address or has a part that ends in .zarr or .n5."""
    return path.contains("://") | F.exists(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: F.lower(p).rlike("[^.].*\\.(zarr|n5)$"))


def output_path(file: Column, source: str, target: str, suffix: str = ".zarr") -> Column:
    """The file's place under ``source``, under ``target`` instead, with another suffix."""
    inner = F.substring(file, len(source.rstrip("/")) + 2, 1 << 20)
    return F.concat(F.lit(target.rstrip("/") + "/"), F.regexp_replace(inner, r"(?<=[^/])\.[^./]*$", ""), F.lit(suffix))


def job_name(file: Column, target: str, prefix: str = "job") -> Column:
    """prefix_suffix_to_target_stem of a path's last part, without blanks, 128 characters at most."""
    last = F.element_at(F.split(file, "/"), -1)
    stem, suffix = F.regexp_replace(last, r"(?<=.)\.[^.]*$", ""), F.regexp_extract(last, r".\.([^.]*)$", 1)
    return F.substring(F.replace(F.concat(F.lit(f"{prefix}_"), suffix, F.lit(f"_to_{target}_"), stem), F.lit(" "), F.lit("_")), 1, 128)


def axes_look_swapped(x: Column, y: Column, z: Column) -> Column:
    """Of three sizes exactly two differ, and z is not the odd one."""
    return (F.size(F.array_distinct(F.array(x, y, z))) == 2) & (x != y)


def axes_by_rank(rank: Column, times: Column, channels: Column) -> Column:
    """Axis letters by rank; a fourth axis is time only where there are several times and one channel."""
    fourth = F.when((times > 1) & (channels == 1), "tzyx").otherwise("czyx")
    by_number = F.array_join(F.transform(F.sequence(F.lit(0), rank - 1), lambda i: F.concat(F.lit("dim_"), i.cast("string"))), ",")
    return F.when(rank == 2, "yx").when(rank == 3, "zyx").when(rank == 4, fourth).when(rank == 5, "tczyx").otherwise(by_number)


def extent_voxel_nm(low: Column, high: Column, n: Column, unit: Column) -> Column:
    """Size of a voxel in nanometres from an extent; without a unit, below 1 means micrometres."""
    size = (high - low) / n
    named = F.when(F.trim(F.coalesce(unit, F.lit(""))) != "", unit).when(size < 1, "um").otherwise("nm")
    return to_nanometers(size, named)


def data_type(asked: Column, is_label: Column, dtype: Column) -> Column:
    """labels or image: as asked for, by the flag, or (auto) by the element type."""
    return F.when((asked == "labels") | is_label, "labels").when((asked == "auto") & is_segmentation(dtype), "labels").otherwise("image")


def subgroup(asked: Column, is_label: Column, nested: Column, label_key: Column, image_key: Column) -> Column:
    """Where the output goes in a nested container; null where that is known only later, or nothing is nested."""
    return F.when(~nested, None).when(is_label | (asked == "labels"), F.concat(F.lit("labels/"), label_key)).when(asked == "image", image_key)


def upsample_method(asked: Column, is_label: Column) -> Column:
    return F.when(is_label, "nearest").when(asked == "auto", "trilinear").otherwise(asked)


def provenance_key(url: Column) -> Column:
    """The last part of an address, with the one before where it starts with v or is a number."""
    parts = F.split(F.regexp_replace(F.regexp_replace(url, "/+$", ""), "^precomputed://", ""), "/")
    last = F.element_at(parts, -1)
    return F.when((F.size(parts) > 1) & last.rlike("^(v.*|[0-9]+)$"), F.concat_ws("_", F.element_at(parts, -2), last)).otherwise(last)


def store_of(path: Column) -> Column:
    """s3, gs, http or file."""
    scheme = F.regexp_extract(path, "(?:^|://)([a-z0-9]+)://", 1)
    return F.when(scheme.isin("https", "http"), "http").when(scheme == "", "file").otherwise(scheme)


def bucket_of(path: Column) -> Column:
    return F.when(store_of(path).isin("s3", "gs"), F.regexp_extract(path, "(?:s3|gs)://([^/]+)", 1))


# Endings of files, by format.
SUFFIXES = {"tiff": ("tif", "tiff"), "nd2": ("nd2",), "ims": ("ims",), "hdf5": ("h5", "hdf5"), "czi": ("czi",)}


def format_of(path: Column) -> Column:
    """The format an address is read as, by its ending or a part of it."""
    low = F.lower(path)
    found = F.when(low.rlike(r"\.n5(/|$)"), "n5").when(low.rlike(r"\.zarr(/|$)"), "zarr").when(low.contains("precomputed://") | low.endswith(".precomputed"), "precomputed")
    for name, ends in SUFFIXES.items():
        found = found.when(F.element_at(F.split(low, r"\."), -1).isin(*ends), name)
    return found.otherwise("other")


def level_path(root: Column, level: Column, prefix: Column, group: Column | None = None) -> Column:
    """Where a level lies: in a group of the container (``raw``, ``labels/<name>``) or in the container itself."""
    name = F.concat(prefix, level.cast("string"))
    return F.concat_ws("/", root, *([group] if group is not None else []), name)


def label_group(name: Column) -> Column:
    return F.concat(F.lit("labels/"), name)


def order_argument(said: Column, axes: Column) -> Column:
    """The letters of an order, where they are those of the axes, each once; else null."""
    return F.when(F.array_sort(F.split(said, "")) == F.array_sort(axes), said)


def voxel_argument(said: Column) -> Column:
    """Sizes by axis from x=..,y=..,z=..; blanks don't count, and what is no positive number is null."""
    sizes = F.str_to_map(F.replace(said, F.lit(" "), F.lit("")), F.lit(","), F.lit("="))
    return F.transform_values(sizes, lambda _, v: F.when(v.try_cast("double") > 0, v.try_cast("double")))


INFO = "data_type string, scales array<struct<encoding:string>>"


def classify_info(info: Column) -> Column:
    """segmentation or image of a precomputed volume's parsed metadata (``INFO``): by the first scale's encoding and the type; without scales an image."""
    first = F.get(info["scales"], F.lit(0))["encoding"]
    return F.when(F.size(info["scales"]) == 0, "image").otherwise(classify(F.lit(""), info["data_type"], first))


def box_argument(said: Column) -> Column:
    """(origin, size) of six numbers with commas, three each; null for anything else, and for sizes that aren't positive."""
    parts = F.transform(F.split(said, ","), lambda x: F.when(F.trim(x).rlike("^[+-]?[0-9]+$"), F.trim(x).try_cast("long")))
    whole = (F.size(parts) == 6) & F.forall(parts, lambda x: x.isNotNull())
    found = F.struct(F.slice(parts, 1, 3).alias("origin"), F.slice(parts, 4, 3).alias("size"))
    return F.when(whole & F.forall(F.slice(parts, 4, 3), lambda x: x > 0), found)

"""Multiscale metadata as structs and JSON: axes, datasets, containers, channels, labels, precomputed info."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import metadata as M

DATASETS = "array<struct<path:string,coordinateTransformations:array<struct<type:string,scale:array<double>>>>>"
GROUP = f"struct<multiscales:array<struct<axes:array<struct<name:string,type:string,unit:string>>,datasets:{DATASETS}>>>"


def axes(names: Column, space: str = "nanometer", time: str = "millisecond") -> Column:
    """Name, type and unit (absent for channels) of each axis."""
    unit = lambda a: F.when(M.axis_type(a) == "space", space).when(M.axis_type(a) == "time", time)
    return F.transform(names, lambda a: F.struct(M.axis_name(a).alias("name"), M.axis_type(a).alias("type"), unit(a).alias("unit")))


def dataset(path: Column, scale: Column, shift: Column | None = None) -> Column:
    """A level's entry; a translation only where it isn't 0 throughout."""
    of = lambda kind, v: F.struct(F.lit(kind).alias("type"), *((v if k == kind else F.lit(None).cast("array<double>")).alias(k) for k in ("scale", "translation")))
    only = F.array(of("scale", scale))
    if shift is None:
        steps = F.array(F.struct(F.lit("scale").alias("type"), scale.alias("scale")))
    else:
        steps = F.when(F.exists(shift, lambda x: x != 0), F.concat(only, F.array(of("translation", shift)))).otherwise(only)
    return F.struct(path.alias("path"), steps.alias("coordinateTransformations"))


def multiscales(names: Column, name: Column, datasets: Column, is_label: Column, version: str | None = None, time: str = "millisecond") -> Column:
    """One multiscale; labels carry no type."""
    fields = [axes(names, time=time).alias("axes"), datasets.alias("datasets"), name.alias("name"), F.when(~is_label, F.lit("image")).alias("type")]
    return F.array(F.struct(*([F.lit(version).alias("version")] if version else []), *fields))


def software(name: str = "chunkframe", version: str = "1") -> Column:
    return F.struct(F.lit(name).alias("name"), F.lit(version).alias("version"))


def group_v3(scales: Column, extra: Column | None = None) -> Column:
    """The JSON of a v3 group (0.5): version, multiscales, what wrote it."""
    ome = F.struct(F.lit("0.5").alias("version"), scales.alias("multiscales"), *([extra.alias("image-label")] if extra is not None else []))
    return F.to_json(F.struct(F.lit(3).alias("zarr_format"), F.lit("group").alias("node_type"), F.struct(ome.alias("ome"), software().alias("_software")).alias("attributes")))


def group_v2(scales: Column) -> Column:
    """The JSON of a v2 group's attributes (0.4)."""
    return F.to_json(F.struct(scales.alias("multiscales")))


def nested(datasets: Column, group: Column) -> Column:
    """The same levels as seen from the root: paths behind the group's name."""
    return F.transform(datasets, lambda x: x.withField("path", F.concat_ws("/", group, x["path"])))


def merged_labels(old: Column, new: Column) -> Column:
    """Both lists in order, each name once."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(old, empty), F.coalesce(new, empty)))


def image_label(colors: Column, source: Column) -> Column:
    where = F.when(source.isNotNull(), F.struct(source.alias("image")))
    return F.struct(F.lit("0.5").alias("version"), colors.alias("colors"), where.alias("source"))


def label_rgba(i: Column, alpha: int = 255) -> Column:
    """The palette's colour of a label: golden-ratio hue, saturation 0.7, brightness 0.9, cut to integers."""
    h = M.label_hue(i.cast("double")) * 6
    sector, part = F.floor(h), h - F.floor(h)
    v, low = F.lit(0.9), F.lit(0.9) * (1.0 - F.lit(0.7))
    down, up = v * (1.0 - F.lit(0.7) * part), v * (1.0 - F.lit(0.7) * (1.0 - part))
    turns = ((v, up, low), (down, v, low), (low, v, up), (low, down, v), (up, low, v), (v, low, down))
    pick = lambda k: F.element_at(F.array(*(t[k] for t in turns)), (sector % 6 + 1).cast("int"))
    return F.array(*(F.floor(pick(k) * 255).cast("int") for k in range(3)), F.lit(alpha))


def channels(xml: Column) -> Column:
    """Name, colour, wavelengths and dye of every channel element; null where an attribute is absent."""
    tags = F.regexp_extract_all(xml, F.lit(r"<(?:OME:)?Channel\s+([^>]+?)/?>"), 1)
    text = lambda t, name: F.get(F.regexp_extract_all(t, F.lit(rf'(?:^|\s){name}\s*=\s*"([^"]*)"'), 1), F.lit(0))
    return F.transform(tags, lambda t: F.struct(
        text(t, "Name").alias("name"), M.rgba_hex(text(t, "Color").try_cast("int")).alias("color"), text(t, "EmissionWavelength").try_cast("double").alias("em"),
        text(t, "ExcitationWavelength").try_cast("double").alias("ex"), text(t, "Fluor").alias("dye")))


def _attribute(tag: Column, name: str) -> Column:
    """An attribute of an element's opening tag; null where it is absent."""
    return unescaped(F.get(F.regexp_extract_all(tag, F.lit(rf'^<[^>]*?\s{name}\s*=\s*"([^"]*)"'), 1), F.lit(0)))


def _element(tag: Column, name: str) -> Column:
    """The text of an element inside; null where it is absent or empty."""
    return unescaped(F.nullif(F.trim(F.regexp_extract(tag, rf"<{name}\b[^>]*>([^<]*)</{name}>", 1)), F.lit("")))


def unescaped(text: Column) -> Column:
    for code, letter in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(code), F.lit(letter))
    return text


_CHANNEL = r"(?s)<Channel\b(?:[^>]*/>|[^>]*[^/>]>.*?</Channel>|>.*?</Channel>)"


def czi_channels(xml: Column) -> Column:
    """Name, colour, wavelengths and dye of the channels in a CZI file's metadata.

    Channels are those of the image's dimensions (else of the first list of channels); a colour is their own, as a number or #AARRGGBB, or that
    of the display setting of the same name, as #RRGGBB. Null where there are none.
    """
    inner = F.regexp_extract(xml, r"(?s)<Dimensions\b.*?<Channels\b[^>]*>(.*?)</Channels>", 1)
    inner = F.coalesce(F.nullif(inner, F.lit("")), F.regexp_extract(xml, r"(?s)<Channels\b[^>]*>(.*?)</Channels>", 1))
    tags = F.regexp_extract_all(inner, F.lit(_CHANNEL), 0)
    shown = F.regexp_extract_all(F.regexp_extract(xml, r"(?s)<DisplaySetting\b.*</DisplaySetting>", 0), F.lit(_CHANNEL), 0)
    display = F.transform(shown, lambda t: F.struct(F.coalesce(F.nullif(_attribute(t, "Name"), F.lit("")), _attribute(t, "Id")).alias("name"), _element(t, "Color").alias("color")))
    display = F.filter(display, lambda d: d["color"].rlike("^#.{6}$"))

    def described(t: Column, name: Column, own: Column, display: Column) -> Column:
        from_display = F.try_element_at(F.filter(display, lambda d: (d["name"] == name) & (name != "")), F.lit(-1))["color"]
        told = F.coalesce(M.rgba_hex(F.trim(own).try_cast("long")), F.when(own.rlike("^#.{8}$"), F.upper(F.substring(own, 4, 6))), F.upper(F.substring(from_display, 2, 6)))
        return F.struct(name.alias("name"), told.alias("color"), _element(t, "EmissionWavelength").try_cast("double").alias("em"), _element(t, "ExcitationWavelength").try_cast("double").alias("ex"), F.coalesce(_element(t, "DyeName"), _element(t, "Fluor")).alias("dye"))

    def all_(s: Column) -> Column:
        one = lambda t: M.once(F.struct(_attribute(t, "Name").alias("name"), _attribute(t, "Color").alias("own")), lambda x: described(t, x["name"], x["own"], s["display"]))
        return F.when(F.size(s["tags"]) > 0, F.transform(s["tags"], one))

    return M.once(F.struct(tags.alias("tags"), display.alias("display")), all_)


def channel_info(format: Column, czi_xml: Column, ome_xml: Column) -> Column:
    """The channels that a file describes: of a CZI file by its own metadata, else (and for all others) by OME-XML; null where none are told."""
    own = F.when(F.lower(format) == "czi", czi_channels(czi_xml))
    general = channels(F.coalesce(F.nullif(ome_xml, F.lit("")), czi_xml))
    return F.coalesce(own, M.once(general, lambda found: F.when(F.size(found) > 0, found)))


def _extent(shape: Column, names: Column, axis: str) -> Column:
    """How long an axis is; 1 where there is none."""
    at = F.array_position(names, axis).cast("int")
    return F.when(at > 0, F.get(shape, at - 1)).otherwise(1).cast("long")


def _shown(c: Column, i: Column, n: Column, first: Column, last: Column) -> Column:
    """The entry of the channel ``c``, the i-th of n."""
    window = F.struct(first.alias("start"), last.alias("end"), first.alias("min"), last.alias("max"))
    return F.struct(
        (i < 3).alias("active"), F.lit(1).alias("coefficient"), M.channel_color(c["color"], c["em"], c["ex"], i, n).alias("color"), F.lit("linear").alias("family"),
        F.lit(False).alias("inverted"), M.channel_label(c["name"], c["em"], c["ex"], c["dye"], i).alias("label"), window.alias("window"),
    )


def _drawn(n: Column, z: Column) -> Column:
    model = F.when((n > 1) & (n < 8), "color").otherwise("greyscale")
    return F.struct(F.lit(0).alias("defaultT"), F.floor(z / 2).alias("defaultZ"), model.alias("model"))


def omero(found: Column, dtype: Column, shape: Column, names: Column, windows: Column | None = None) -> Column:
    """The display block: a channel for each place of the axis c (described, made up, or left out), and how they are drawn.

    ``found``: an array of channels or null. ``windows``: an array of (low, high) by channel where values were looked at; else by the type.
    """
    low, high = M.dtype_window(dtype)

    def one(v: Column, i: Column) -> Column:
        seen = F.get(v["windows"], i.cast("int")) if windows is not None else None
        first, last = (v["low"], v["high"]) if seen is None else (F.coalesce(seen["low"].cast("double"), v["low"]), F.coalesce(seen["high"].cast("double"), v["high"]))
        return _shown(F.get(v["found"], i.cast("int")), i, v["n"], first, last)

    def block(v: Column) -> Column:
        return F.struct(F.transform(F.sequence(F.lit(0).cast("long"), v["n"] - 1), lambda i: one(v, i)).alias("channels"), _drawn(v["n"], v["z"]).alias("rdefs"))

    # what every channel looks at is worked out once a volume
    lower = F.transform(names, F.lower)
    known = {"found": found, "n": _extent(shape, lower, "c"), "z": _extent(shape, lower, "z"), "low": low, "high": high} | ({"windows": windows} if windows is not None else {})
    return M.once(F.struct(*(c.alias(name) for name, c in known.items())), block)


def omero_rows(volumes: DataFrame, keep: list[str], found: Column, dtype: Column, shape: Column, names: Column) -> DataFrame:
    """(keep, rdefs, i, c): the same block of every volume as a row for each channel, for tables of many volumes."""
    low, high = M.dtype_window(dtype)
    told = volumes.select(*keep, found.alias("found"), low.alias("low"), high.alias("high"), shape.alias("shape"), F.transform(names, F.lower).alias("names"))
    sized = told.select(*keep, "found", "low", "high", *(_extent(F.col("shape"), F.col("names"), a).alias(name) for name, a in (("n", "c"), ("z", "z"))))
    rows = sized.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    c = _shown(F.get("found", F.col("i").cast("int")), F.col("i"), F.col("n"), F.col("low"), F.col("high"))
    return rows.select(*keep, _drawn(F.col("n"), F.col("z")).alias("rdefs"), "i", c.alias("c"))


def voxel_nm(group: Column, path: Column, defaults: tuple[str, ...] = ("s0", "0")) -> Column:
    """x, y, z in nanometres of the level ``path`` (none given: the first with a default name); axes without a scale count 1."""
    base = lambda p: F.element_at(F.split(p, "/"), -1)

    def known(first: Column) -> Column:
        level = F.filter(first["datasets"], lambda x: (x["path"] == path) | ((path == "") & (x["path"].isin(*defaults) | base(x["path"]).isin(*defaults))))[0]
        scale = F.filter(level["coordinateTransformations"], lambda t: t["type"] == "scale")[0]["scale"]
        return F.struct(scale.alias("scale"), F.transform(first["axes"], lambda a: F.lower(a["name"])).alias("names"), first["axes"]["unit"].alias("units"))

    def of(v: Column, axis: str) -> Column:
        at = F.array_position(v["names"], axis).cast("int") - 1  # -1, that is no place, where there is none
        unit = F.coalesce(F.get(v["units"], at), F.lit("micrometer"))
        return F.when(v["scale"].isNotNull(), F.when(F.get(v["scale"], at).isNull(), 1.0).otherwise(M.to_nanometers(F.get(v["scale"], at), unit)))

    return M.once(M.once(group["multiscales"][0], known), lambda v: F.struct(*(of(v, a).alias(a) for a in "xyz")))


def precomputed_info(kind: Column, dtype: Column, channels_: Column, size: Column, resolution: Column, chunk: Column) -> Column:
    """The JSON of a precomputed volume with one scale; its key joins the resolutions."""
    key = F.concat_ws("_", F.transform(resolution, lambda r: r.cast("long").cast("string")))
    encoding = F.when((kind == "segmentation") & dtype.isin("uint32", "uint64"), "compressed_segmentation").otherwise("raw")
    scale = F.struct(key.alias("key"), size.alias("size"), resolution.alias("resolution"), F.array(chunk).alias("chunk_sizes"), encoding.alias("encoding"))
    return F.to_json(F.struct(F.lit("neuroglancer_multiscale_volume").alias("@type"), kind.alias("type"), dtype.alias("data_type"), channels_.alias("num_channels"), F.array(scale).alias("scales")))

"""Queries on container metadata (JSON) and on listings of files, with the SQL that checks them."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import layout as L
from ..functions import metadata as M
from ..functions import ome
from ..operators import blocks, discovery, redistribute, reports
from ..sources import convert, elements, fixtures, hdf5, multiscale, precomputed, tiff, zarr
from ..sources.fixtures import SQL
from ..streaming import incremental
from .catalog import query
from .layouts import VOL

_volumes = fixtures.volumes

# -- JSON -----------------------------------------------------------------------------------

_TYPE = "CASE WHEN a = 'c' THEN 'channel' WHEN a IN ('t', 'v') THEN 'time' ELSE 'space' END"


def _axes_sql(time: str) -> str:
    return "'[' || array_to_string(list_transform(axes, lambda a: '{\"name\":\"' || CASE WHEN a = 'v' THEN 't' ELSE a END || '\",\"type\":\"' || " + _TYPE + " || '\"' || CASE WHEN a = 'c' THEN '' WHEN a IN ('t', 'v') THEN ',\"unit\":\"" + time + "\"' ELSE ',\"unit\":\"nanometer\"' END || '}'), ',') || ']'"


_SCALE = "'[' || array_to_string(list_transform(voxel, lambda s: printf('%.1f', s)), ',') || ']'"
_DATASETS = "'[{\"path\":\"s0\",\"coordinateTransformations\":[{\"type\":\"scale\",\"scale\":' || " + _SCALE + " || '}]}]'"
_LABELS = "regexp_matches(lower(word), 'label|mask|seg|annotation|roi|binary|instance')"


def _scales_sql(time: str, datasets: str = _DATASETS) -> str:
    return f"'[{{\"axes\":' || {_axes_sql(time)} || ',\"datasets\":' || {datasets} || ',\"name\":\"' || word || '\"' || CASE WHEN {_LABELS} THEN '' ELSE ',\"type\":\"image\"' END || '}}]'"


def _is_label():
    return F.lower("word").rlike(M.LABEL_WORDS)


def _levels(path: str = "s0"):
    return F.array(ome.dataset(F.lit(path), F.col("voxel")))


@query("SELECT k, '{\"zarr_format\":3,\"node_type\":\"group\",\"attributes\":{\"ome\":{\"version\":\"0.5\",\"multiscales\":' || " + _scales_sql("millisecond") + " || '},\"_software\":{\"name\":\"chunkframe\",\"version\":\"1\"}}}' AS json FROM " + VOL)
def groups_v3(spark, d):
    """Mx2, Mx15: the 0.5 metadata of every volume; labels carry no type."""
    return _volumes(spark, d).select("k", ome.group_v3(ome.multiscales(F.col("axes"), F.col("word"), _levels(), _is_label())).alias("json"))


@query("SELECT k, '{\"multiscales\":[{\"version\":\"0.4\",' || substr(" + _scales_sql("second") + ", 3) || '}' AS json FROM " + VOL)
def groups_v2(spark, d):
    """Mx1, Mx3: the 0.4 metadata, whose times are in seconds."""
    return _volumes(spark, d).select("k", ome.group_v2(ome.multiscales(F.col("axes"), F.col("word"), _levels(), _is_label(), version="0.4", time="second")).alias("json"))


_GROUP = "CASE WHEN " + _LABELS + " THEN 'labels/' || word ELSE 'raw' END"
_NESTED = "'[{\"path\":\"' || " + _GROUP + " || '/s0\",\"coordinateTransformations\":[{\"type\":\"scale\",\"scale\":' || " + _SCALE + " || '}]}]'"


@query("SELECT k, '{\"multiscales\":' || " + _scales_sql("millisecond", _NESTED) + " || '}' AS json FROM " + VOL)
def nested_roots(spark, d):
    """Mx4, Mx5, Mx9: a group's levels as the root lists them, behind the group's name."""
    group = F.when(_is_label(), F.concat(F.lit("labels/"), F.col("word"))).otherwise("raw")
    return _volumes(spark, d).select("k", ome.group_v2(ome.multiscales(F.col("axes"), F.col("word"), ome.nested(_levels(), group), _is_label())).alias("json"))


@query(f"SELECT k, CASE WHEN k % 3 = 0 THEN 'old' ELSE word END AS shown, CASE k % 4 WHEN 0 THEN ['cells'] WHEN 1 THEN ['cells', word] WHEN 2 THEN [word] ELSE [] END AS labels FROM {VOL}")
def merged_roots(spark, d):
    """Mx6, Mx7, J8: old multiscales stay where there are no new ones, labels are united in order."""
    old = F.when(F.col("k") % 4 < 2, F.array(F.lit("cells")))
    new = F.when(F.col("k") % 4 == 1, F.array("word", F.lit("cells"))).when(F.col("k") % 4 == 2, F.array("word", "word"))
    return _volumes(spark, d).select("k", F.coalesce(F.when(F.col("k") % 3 != 0, F.col("word")), F.lit("old")).alias("shown"), ome.merged_labels(old, new).alias("labels"))


@query("SELECT k, '{\"version\":\"0.5\",\"colors\":[' || array_to_string(list_transform(range(1, k % 4 + 2), lambda i: '{\"label-value\":' || i || ',\"alpha\":255}'), ',') || ']' || CASE WHEN k % 2 = 0 THEN ',\"source\":{\"image\":\"../../raw\"}' ELSE '' END || '}' AS json FROM " + VOL)
def image_labels(spark, d):
    """Mx10: the label block, with its source where one is known; whole colours are checked by label_palette_rgb."""
    colors = F.transform(F.sequence(F.lit(1).cast("long"), F.col("k") % 4 + 1), lambda i: F.struct(i.alias("label-value"), F.get(ome.label_rgba(i), F.lit(3)).alias("alpha")))
    return _volumes(spark, d).select("k", F.to_json(ome.image_label(colors, F.when(F.col("k") % 2 == 0, F.lit("../../raw")))).alias("json"))


@query("SELECT k, '[{\"path\":\"s0\",\"coordinateTransformations\":[{\"type\":\"scale\",\"scale\":' || " + _SCALE + " || '}]},{\"path\":\"s1\",\"coordinateTransformations\":[{\"type\":\"scale\",\"scale\":[' || array_to_string(list_transform(voxel, lambda s: printf('%.1f', s * 2)), ',') || ']}' || CASE WHEN k % 3 = 0 THEN '' ELSE ',{\"type\":\"translation\",\"translation\":[' || array_to_string(list_transform(voxel, lambda s: printf('%.1f', s / 2)), ',') || ']}' END || ']}]' AS json FROM " + VOL)
def added_levels(spark, d):
    """Mx11, Mx12: a level behind the first one, with a translation unless it is 0 throughout."""
    scale = F.transform("voxel", lambda s: s * 2)
    shift = L.translation(scale, F.col("voxel"), F.when(F.col("k") % 3 == 0, "stride").otherwise("mean"))
    levels = F.concat(F.array(ome.dataset(F.lit("s0"), F.col("voxel"), F.transform("voxel", lambda s: F.lit(0.0)))), F.array(ome.dataset(F.lit("s1"), scale, shift)))
    return _volumes(spark, d).select("k", F.to_json(levels).alias("json"))


@query("SELECT k, '{\"@type\":\"neuroglancer_multiscale_volume\",\"type\":\"' || CASE WHEN " + _LABELS + " THEN 'segmentation' ELSE 'image' END || '\",\"data_type\":\"' || dtype || '\",\"num_channels\":1,\"scales\":[{\"key\":\"' || array_to_string(list_transform(list_reverse(list_slice(voxel, r - 2, r)), lambda s: CAST(s AS BIGINT)), '_') || '\",\"size\":[' || array_to_string(list_reverse(list_slice(shape, r - 2, r)), ',') || '],\"resolution\":[' || array_to_string(list_transform(list_reverse(list_slice(voxel, r - 2, r)), lambda s: printf('%.1f', s)), ',') || '],\"chunk_sizes\":[[64,64,64]],\"encoding\":\"' || CASE WHEN " + _LABELS + " AND dtype IN ('uint32', 'uint64') THEN 'compressed_segmentation' ELSE 'raw' END || '\"}]}' AS json FROM " + VOL)
def precomputed_infos(spark, d):
    """Mx14."""
    last = lambda c: F.reverse(F.slice(c, F.col("r") - 2, 3))
    return _volumes(spark, d).select("k", ome.precomputed_info(F.when(_is_label(), "segmentation").otherwise("image"), F.col("dtype"), F.lit(1), last("shape"), last("voxel"), F.array(*[F.lit(64)] * 3)).alias("json"))


@query(f"SELECT k, CASE WHEN k % 5 = 0 THEN 1.0 ELSE voxel[r] END * CASE WHEN k % 2 = 0 OR k % 5 = 0 THEN 1 ELSE 1000 END AS x, voxel[r - 1] * CASE WHEN k % 2 = 0 THEN 1 ELSE 1000 END AS y, voxel[r - 2] * CASE WHEN k % 2 = 0 THEN 1 ELSE 1000 END AS z, CASE WHEN k % 2 = 0 THEN 'nanometer' ELSE 'micrometer' END AS unit FROM {VOL}")
def voxels_of_metadata(spark, d):
    """J-10, G9, H12: sizes and unit of the level s0 out of a group's JSON; axes without a scale count 1, units without a name micrometres."""
    unit = F.when(F.col("k") % 2 == 0, F.lit("nanometer"))
    names = F.array(*(F.struct(F.lit(a).alias("name"), F.lit("space").alias("type"), unit.alias("unit")) for a in "zyx"))
    scale = F.slice("voxel", F.col("r") - 2, F.when(F.col("k") % 5 == 0, 2).otherwise(3))
    json = F.to_json(F.struct(F.array(F.struct(names.alias("axes"), F.array(ome.dataset(F.lit("raw/s0"), scale), ome.dataset(F.lit("raw/s1"), scale)).alias("datasets"))).alias("multiscales")))
    found = F.filter(F.col("group")["multiscales"][0]["axes"], lambda a: (a["type"] == "space"))[0]["unit"]
    parsed = _volumes(spark, d).select("k", F.from_json(json, ome.GROUP).alias("group"))
    return parsed.select("k", ome.voxel_nm(F.col("group"), F.lit("")).alias("v"), F.coalesce(found, F.lit("micrometer")).alias("unit")).select("k", "v.x", "v.y", "v.z", "unit")


@query(f"SELECT k, CASE WHEN k % 7 = 0 THEN 'image' WHEN encoding = 'compressed_segmentation' THEN 'segmentation' WHEN dtype IN ('uint32', 'uint64', 'int32', 'int64') THEN 'segmentation' ELSE 'image' END AS kind, CASE WHEN k % 7 = 0 THEN 0 ELSE 1 END AS scales FROM {VOL}")
def classify_by_info(spark, d):
    """Precomputed info files by their first scale; without scales an image."""
    scales = F.when(F.col("k") % 7 == 0, F.array().cast("array<struct<encoding:string>>")).otherwise(F.array(F.struct(F.col("encoding"))))
    info = F.from_json(F.to_json(F.struct(F.col("dtype").alias("data_type"), scales.alias("scales"))), M.INFO)
    table = _volumes(spark, d).select("k", info.alias("info"))
    return table.select("k", M.classify_info(F.col("info")).alias("kind"), F.size(F.col("info")["scales"]).alias("scales"))


@query(f"SELECT k, array_to_string(axes, '') AS order_, array_to_string(shape, 'x') AS extent, CASE WHEN {_LABELS} THEN 'segmentation' ELSE 'image' END AS hint, list_max(voxel) > list_min(voxel) AS anisotropic FROM {VOL}")
def source_summaries(spark, d):
    """J-11, B14: one row that tells what a source is."""
    return _volumes(spark, d).select("k", F.array_join("axes", "").alias("order_"), F.array_join(F.transform("shape", lambda n: n.cast("string")), "x").alias("extent"), F.when(_is_label(), "segmentation").otherwise("image").alias("hint"), (F.array_max("voxel") > F.array_min("voxel")).alias("anisotropic"))


_DENSE = f"(SELECT g.t, g.c, g.x, coalesce(s.v, 0) AS v FROM (SELECT a.t, b.c, e.x FROM range(30) a(t), range(5) b(c), range(24) e(x)) g LEFT JOIN ({SQL['channels']}) s USING (t, c, x))"

# -- stored arrays --------------------------------------------------------------------------


@query("SELECT vec_id AS y, generate_subscripts(embedding, 1) - 1 AS x, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings")
def sharded_float_array(spark, d):
    """A float32 image written as a sharded Zarr v3 array (zstd) and read back."""
    rows = fixtures.table(spark, d, "embeddings").select(F.col("vec_id").alias("y"), F.posexplode("embedding").alias("x", "v"))
    n = rows.agg(F.max("y").alias("n")).first()["n"] + 1
    path = f"{zarr.shared_folder(spark)}/array-{uuid.uuid4().hex}"
    chunks = blocks.to_chunks(rows, {"y": n, "x": 64}, {"y": 64, "x": 16}, dtype="float32")
    zarr.write_chunks(chunks, path, [n, 64], [64, 16], "float32", codec="zstd", shard=[256, 32])
    return blocks.from_chunks(zarr.read_chunks(spark, path), ["y", "x"], "float64")


_GRID = f"WITH s AS (SELECT * FROM ({SQL['volume']})), e AS (SELECT max(z) + 1 AS nz, max(y) + 1 AS ny, max(x) + 1 AS nx FROM s), g AS (SELECT z, y, unnest(range(nx)) AS x FROM (SELECT z, unnest(range(ny)) AS y, nx FROM (SELECT unnest(range(nz)) AS z, ny, nx FROM e)))"


def _volume_extent(src):
    top = src.agg(*[(F.max(a) + 1).alias(a) for a in "zyx"]).first()
    return {a: top[a] for a in "zyx"}


@query(_GRID + " SELECT g.z, g.y, g.x, coalesce(CAST(18446744073709551615 - s.v AS DECIMAL(20, 0)), CAST(7 AS DECIMAL(20, 0))) AS v FROM g LEFT JOIN s USING (z, y, x)")
def stored_unsigned_array(spark, d):
    """A sparse volume of 64-bit unsigned values as blosc frames; what was never stored holds the fill value."""
    src = fixtures.volume(spark, d)
    shape = _volume_extent(src)
    rows = src.withColumn("v", F.lit("18446744073709551615").cast("decimal(20,0)") - F.col("v"))
    chunk = {"z": 16, "y": 64, "x": 4}
    path = f"{zarr.shared_folder(spark)}/array-{uuid.uuid4().hex}"
    zarr.write_chunks(blocks.to_chunks(rows, shape, chunk, fill=7, dtype="uint64"), path, list(shape.values()), list(chunk.values()), "uint64", "zarr2", "blosc", fill=7)
    return blocks.from_chunks(zarr.read_chunks(spark, path), ["z", "y", "x"], "uint64")


def _stored_image(spark, d, **options):
    """The image as an int32 array of chunks of 64 by 16; its place and shape."""
    n = fixtures.table(spark, d, "embeddings").agg(F.max("vec_id").alias("n")).first()["n"] + 1
    path = f"{zarr.shared_folder(spark)}/array-{uuid.uuid4().hex}/s0"
    zarr.write_chunks(blocks.to_chunks(fixtures.image(spark, d), {"y": n, "x": 64}, {"y": 64, "x": 16}, dtype="int32"), path, [n, 64], [64, 16], names=["y", "x"], **options)
    return path, [n, 64]


@query(f"SELECT y, x, v FROM ({SQL['image']}) AS src")
def blosc_lz4_array(spark, d):
    """An array of blosc frames (lz4 streams, bytes shuffled), written and read back."""
    path, _ = _stored_image(spark, d, codec="blosc:lz4")
    return blocks.from_chunks(zarr.read_chunks(spark, path), ["y", "x"], "int32")


@query(f"SELECT y, x, v FROM ({SQL['image']}) AS src WHERE y >= 70 AND y < 310 AND x >= 20 AND x < 36")
def sharded_box(spark, d):
    """A3, A1: a box of a sharded array; of each shard the index and the chunks it touches are read."""
    path, _ = _stored_image(spark, d, codec="zstd", shard=[256, 64])
    elements.register(spark)
    return spark.read.format(elements.ChunkedArray.name()).option("box", "y=70:310,x=20:36").load(path)


@query(f"SELECT y, x, CAST(CASE WHEN y < 64 THEN v * 2 ELSE v END AS INTEGER) AS v FROM ({SQL['image']}) AS src")
def committed_array(spark, d):
    """Chunks written by the data source in one commit, then the first ones again, appended."""
    n = fixtures.table(spark, d, "embeddings").agg(F.max("vec_id").alias("n")).first()["n"] + 1
    image = fixtures.image(spark, d)
    chunks = lambda df: blocks.to_chunks(df, {"y": n, "x": 64}, {"y": 64, "x": 16}, dtype="int32").select("origin", "extent", "payload", "dtype")
    path = f"{zarr.shared_folder(spark)}/array-{uuid.uuid4().hex}"
    elements.register(spark)
    save = lambda df, mode, **more: df.write.format(elements.ChunkedArray.name()).mode(mode).options(**more).save(path)
    save(chunks(image), "overwrite", shape=f"{n},64", chunk="64,16", codec="zstd", names="y,x")
    save(chunks(image.where("y < 64").withColumn("v", F.col("v") * 2)), "append")
    return spark.read.format(elements.ChunkedArray.name()).load(path)


def _mean(df: str, y: int, x: int) -> str:
    t, n = "sum(CAST(v AS BIGINT))", "count(*)"
    q = f"CAST(floor({t} / {n}) AS BIGINT)"
    r = f"({t} - {q} * {n})"
    return f"SELECT y // {y} AS y, x // {x} AS x, CAST(CASE WHEN 2 * {r} > {n} THEN {q} + 1 WHEN 2 * {r} < {n} THEN {q} ELSE {q} + {q} % 2 END AS INTEGER) AS v FROM {df} GROUP BY 1, 2"


_L1 = "(" + _mean(f"({SQL['image']})", 2, 2) + ")"
_L2 = "(" + _mean(_L1, 3, 2) + ")"


@query(f"SELECT 1 AS level, y, x, v FROM {_L1} UNION ALL SELECT 2, y, x, v FROM {_L2} UNION ALL SELECT 3, y, x, v FROM ({_mean(_L2, 2, 1)})")
def written_pyramid(spark, d):
    """H10, H14, F0, Mx8: three levels of a stored array, each from the stored one before it, read back."""
    path, _ = _stored_image(spark, d, codec="zstd", shard=[128, 32])
    group = path.rpartition("/")[0]
    multiscale.generate_pyramid(spark, group, "mean", steps=[[2, 2], [3, 2], [2, 1]])
    level = lambda i: blocks.from_chunks(zarr.read_chunks(spark, f"{group}/s{i}"), ["y", "x"], "int32").select(F.lit(i).alias("level"), "y", "x", "v")
    return level(1).union(level(2)).union(level(3))


@query(f"SELECT i AS level, CASE WHEN i = 0 THEN 'raw/s0' ELSE 'raw/s' || i END AS path, 4.0::DOUBLE * [1, 2, 6, 12][i + 1] AS scale_y, 8.0::DOUBLE * [1, 2, 4, 4][i + 1] AS scale_x, CASE WHEN i > 0 THEN 4.0::DOUBLE * ([1, 2, 6, 12][i + 1] - 1) / 2 END AS shift_y, CAST(ceil((SELECT max(vec_id) + 1 FROM embeddings) / [1, 2, 6, 12][i + 1]::DOUBLE) AS BIGINT) AS height FROM (SELECT unnest(range(4)) AS i)")
def pyramid_metadata(spark, d):
    """Mx8, Mx9, Mx12, H8, H9: the list of levels of the container above the group, after one run that ended early and one that went on."""
    root = f"{zarr.shared_folder(spark)}/array-{uuid.uuid4().hex}.zarr"
    n = fixtures.table(spark, d, "embeddings").agg(F.max("vec_id").alias("n")).first()["n"] + 1
    chunks = blocks.to_chunks(fixtures.image(spark, d), {"y": n, "x": 64}, {"y": 64, "x": 16}, dtype="int32")
    zarr.write_chunks(chunks, f"{root}/raw/s0", [n, 64], [64, 16], codec="zstd", names=["y", "x"])
    axes = [{"name": a, "type": "space", "unit": "nanometer"} for a in "yx"]
    multiscale.write_group(f"{root}/raw", {"attributes": {"ome": {"version": "0.5", "multiscales": [{"axes": axes, "datasets": [{"path": "s0", "coordinateTransformations": [{"type": "scale", "scale": [4.0, 8.0]}]}]}]}}}, "zarr3")
    multiscale.generate_pyramid(spark, f"{root}/raw", "mean", root=root, steps=[[2, 2]])
    multiscale.generate_pyramid(spark, f"{root}/raw", "mean", root=root, steps=[[2, 2], [3, 2], [2, 1]])
    step = "array<struct<type:string,scale:array<double>,translation:array<double>>>"
    text = spark.read.option("wholetext", True).text([f"{root}/zarr.json"])
    parsed = text.select(F.from_json("value", f"attributes struct<ome:struct<multiscales:array<struct<datasets:array<struct<path:string,coordinateTransformations:{step}>>>>>>").alias("j"))
    levels = parsed.select(F.posexplode(F.col("j.attributes.ome.multiscales")[0]["datasets"]).alias("level", "x"))
    height = F.udf(lambda p: zarr.json.loads(zarr.fetch(f"{root}/{p}/zarr.json"))["shape"][0], "long")
    steps = F.col("x.coordinateTransformations")
    return levels.select(F.col("level").cast("long").alias("level"), F.col("x.path").alias("path"), steps[0]["scale"][0].alias("scale_y"), steps[0]["scale"][1].alias("scale_x"), F.get(steps, F.lit(1))["translation"][0].alias("shift_y"), height("x.path").alias("height"))


@query(f"SELECT CAST(0 AS BIGINT) AS c, x - 5 AS x, y - 30 AS y, CAST(least(greatest(v, 0), 255) AS SMALLINT) AS v FROM ({SQL['image']}) AS src WHERE x >= 5 AND x < 59 AND y >= 30")
def redistributed_chunks(spark, d):
    """Crop, transpose, new axis, cast and rechunk in one exchange of pieces."""
    n = fixtures.table(spark, d, "embeddings").agg(F.max("vec_id").alias("n")).first()["n"] + 1
    chunks = blocks.to_chunks(fixtures.image(spark, d), {"y": n, "x": 64}, {"y": 64, "x": 16}, dtype="int32")
    moved = redistribute.redistribute(chunks, [1, 54, n - 30], [1, 10, 100], [None, 1, 0], [0, 5, 30], dtype="uint8")
    return blocks.from_chunks(moved, ["c", "x", "y"], "uint8")


@query(_mean(f"({SQL['image']})", 5, 3))
def blocks_across_chunks(spark, d):
    """blocks of 5 by 3, which chunks of 64 by 16 cut."""
    n = fixtures.table(spark, d, "embeddings").agg(F.max("vec_id").alias("n")).first()["n"] + 1
    chunks = blocks.to_chunks(fixtures.image(spark, d), {"y": n, "x": 64}, {"y": 64, "x": 16}, dtype="int32")
    return blocks.from_chunks(redistribute.downsample_chunks(chunks, [n, 64], [5, 3], [32, 8]), ["y", "x"], "int32")


@query(_GRID + " SELECT CAST(0 AS BIGINT) AS c, g.x, g.y, g.z - 2 AS z, CAST(least(coalesce(s.v, 0), 255) AS SMALLINT) AS v FROM g LEFT JOIN s USING (z, y, x) WHERE g.z >= 2")
def converted_volume(spark, d):
    """A Zarr v2 container of blosc frames, cropped, turned to c, x, y, z, cast and stored as a sharded Zarr v3 container, read back."""
    src = fixtures.volume(spark, d)
    shape = _volume_extent(src)
    chunk = {"z": 16, "y": 64, "x": 4}
    root = f"{zarr.shared_folder(spark)}/array-{uuid.uuid4().hex}"
    zarr.write_chunks(blocks.to_chunks(src, shape, chunk), f"{root}/in.zarr/s0", list(shape.values()), list(chunk.values()), "int64", "zarr2", "blosc")
    axes = [{"name": a, "type": "space", "unit": "nanometer"} for a in "zyx"]
    multiscale.write_group(f"{root}/in.zarr", {"multiscales": [{"axes": axes, "datasets": [{"path": "s0", "coordinateTransformations": [{"type": "scale", "scale": [40.0, 8.0, 8.0]}]}]}]}, "zarr2")
    options = convert.Options(box={"z": (2, shape["z"] - 2)}, order="cxyz", dtype="uint8", chunk=(1, 4, 32, 32), shard=(1, 8, 64, 64), kind="image")
    done = convert.convert(spark, f"{root}/in.zarr", f"{root}/out.zarr", options)
    elements.register(spark)
    return spark.read.format(elements.ChunkedArray.name()).load(done["array"])


@query(f"SELECT y, x, v FROM ({SQL['image']}) AS src WHERE y >= 70 AND y < 210 AND x >= 10 AND x < 40")
def stored_box(spark, d):
    """A1, D16, S: a box of a stored image by the data source, which opens only the chunks it touches."""
    n = fixtures.table(spark, d, "embeddings").agg(F.max("vec_id").alias("n")).first()["n"] + 1
    path = f"{zarr.shared_folder(spark)}/array-{uuid.uuid4().hex}"
    zarr.write_chunks(blocks.to_chunks(fixtures.image(spark, d), {"y": n, "x": 64}, {"y": 64, "x": 16}, dtype="int32"), path, [n, 64], [64, 16], codec="zstd", names=["y", "x"])
    elements.register(spark)
    return spark.read.format(elements.ChunkedArray.name()).option("box", "y=70:210,x=10:40").load(path)


@query(_GRID + " SELECT g.z, g.y, g.x, CAST(coalesce(s.v, 0) AS INTEGER) AS v FROM g LEFT JOIN s USING (z, y, x)")
def tiff_stack(spark, d):
    """A folder of pages in natural order (deflate strips with differences), converted to a Zarr array and read back."""
    src = fixtures.volume(spark, d)
    shape = _volume_extent(src)
    root = f"{zarr.shared_folder(spark)}/array-{uuid.uuid4().hex}"
    pages = blocks.to_chunks(src, shape, {"z": 1, "y": shape["y"], "x": shape["x"]}, dtype="uint16")
    tiff.write_pages(redistribute.with_missing(pages, list(shape.values()), [1, shape["y"], shape["x"]], "uint16"), f"{root}/pages", "plane {}.tif")
    done = convert.convert(spark, f"{root}/pages", f"{root}/out.zarr")
    elements.register(spark)
    return spark.read.format(elements.ChunkedArray.name()).load(done["array"])


@query(f"SELECT CAST(t AS BIGINT) AS t, CAST(c AS BIGINT) AS c, CAST(x AS BIGINT) AS x, CAST(v AS INTEGER) AS v FROM {_DENSE}")
def hdf5_files(spark, d):
    """An HDF5 file for each day, read by its own walk; the file's name tells the day."""
    shape = {"t": 30, "c": 5, "x": 24}
    chunks = blocks.to_chunks(fixtures.channels(spark, d), shape, {"t": 1, "c": 5, "x": 24}, dtype="int32")
    root = f"{zarr.shared_folder(spark)}/array-{uuid.uuid4().hex}"
    hdf5.write_files(redistribute.with_missing(chunks, list(shape.values()), [1, 5, 24], "int32"), root, "day {}.h5")
    day = F.regexp_extract("path", r"day (\d+)\.h5$", 1).cast("long")
    rows = hdf5.read_files(spark, root).select(F.concat(F.array(day), "origin").alias("origin"), F.concat(F.array(F.lit(1).cast("long")), "extent").alias("extent"), "payload", "dtype")
    return blocks.from_chunks(rows, ["t", "c", "x"], "int32")


# -- listings -------------------------------------------------------------------------------

#: What the ten files of a folder are called, by the kind of folder; {k} is a number.
FOLDERS = {
    "container": ("zarr.json", "raw/zarr.json", "raw/s0/zarr.json", "raw/s1/zarr.json", "labels/zarr.json", "labels/cells/s0/zarr.json", "raw/s0/c/0/0", "raw/s2/zarr.json", "labels/cells/s1/zarr.json", "raw/s4/zarr.json"),
    "zarr2": (".zgroup", ".zattrs", "0/.zarray", "1/.zarray", "0/0.0", "2/.zarray", "0/0.1", "1/0.0", "2/0.0", "0/1.0"),
    "n5": ("attributes.json", "s0/attributes.json", "s0/0/0", "s1/attributes.json", "s0/0/1", "s0/1/0", "s0/1/1", "s1/0/0", "s2/attributes.json", "s2/0/0"),
    "precomputed": ("info", "8_8_8/0-64_0-64_0-64", "8_8_8/64-128_0-64_0-64", "16_16_16/0-64_0-64_0-64", "a", "b", "c", "d", "e", "f"),
    "tiffs": tuple(f"img_{i * 7 % 10}.tif" for i in range(10)),
    "files": ("b.nd2", "a.czi", "c.txt", "d.h5", "e.ims", "f.md", "g.tif", "h.log", "i.hdf5", "j.jpg"),
}
_KINDS = fixtures._list(FOLDERS)
_FILES = "[" + ", ".join(fixtures._list(v) for v in FOLDERS.values()) + "]"
LISTING = f"(SELECT k // 10 AS root, '/d/' || k // 10 || '/' || {_FILES}[k // 10 % 6 + 1][k % 10 + 1] AS path, k FROM (SELECT o_orderkey AS k FROM orders)) AS listing"


def listing(spark, d):
    k = F.col("o_orderkey")
    files = F.array(*(F.array(*map(F.lit, v)) for v in FOLDERS.values()))
    root = F.expr("o_orderkey div 10")
    name = F.get(F.get(files, (root % len(FOLDERS)).cast("int")), (k % 10).cast("int"))
    return fixtures.table(spark, d, "orders").select(root.alias("root"), F.concat(F.lit("/d/"), root.cast("string"), F.lit("/"), name).alias("path"), k.alias("k"))


_INNER = f"(SELECT root, k, substr(path, length('/d/' || root) + 2) AS name FROM {LISTING})"
_MARKS = f"(SELECT root, count(*) AS files, bool_or(name IN ('zarr.json', '.zgroup')) AS grp, bool_or(regexp_matches(name, '^(raw|data|image|images|img|em)/((s0|0)/)?(zarr\\.json|\\.zarray)$')) AS image, bool_or(regexp_matches(name, '^(labels|label|seg)/([^/]+/)?((s0|0)/)?(zarr\\.json|\\.zarray)$')) AS labels, bool_or(name IN ('zarr.json', '.zarray', '.zgroup', 's0/zarr.json', 's0/.zarray', '0/zarr.json', '0/.zarray')) AS zarr, bool_or(name = 'attributes.json') AS n5, bool_or(name = 'info') AS info, bool_and(regexp_matches(name, '\\.tiff?$')) AND count(*) > 1 AS stack, bool_or(regexp_matches(lower(name), '\\.(tif|tiff|nd2|ims|h5|hdf5|czi)$')) AS known FROM {_INNER} GROUP BY root)"
_FORMAT = "CASE WHEN grp AND (image OR labels) THEN 'container' WHEN zarr THEN 'zarr' WHEN n5 THEN 'n5' WHEN info THEN 'precomputed' ELSE 'files' END"


@query(f"SELECT root, {_FORMAT} AS format, grp AND image AS has_image, grp AND labels AS has_labels FROM {_MARKS}")
def folder_formats(spark, d):
    """What each folder is, by its marker files; folders of any size."""
    found = discovery.folders(listing(spark, d), "root", F.concat(F.lit("/d/"), F.col("root").cast("string")))
    return found.select("root", "format", "has_image", "has_labels")


@query(f"SELECT root, CASE WHEN format = 'container' THEN 'discovered_folder' WHEN format <> 'files' THEN 'single_file' WHEN stack THEN 'batch_directory' WHEN known THEN 'discovered_folder' ELSE 'batch_directory' END AS mode, stack FROM (SELECT root, stack, known, {_FORMAT} AS format FROM {_MARKS})")
def input_modes(spark, d):
    """One dataset, a folder of datasets, or files to convert one by one (a stack of images whose output is a folder)."""
    found = discovery.folders(listing(spark, d), "root", F.concat(F.lit("/d/"), F.col("root").cast("string")))
    return found.select("root", discovery.input_mode(F.lit("/out")).alias("mode"), "stack")


@query(f"SELECT root, CASE WHEN root % 6 IN (0, 2) THEN 's' WHEN root % 6 = 1 THEN '' ELSE 's' END AS prefix, max(CASE WHEN root % 6 = 0 THEN TRY_CAST(regexp_extract(path, '/raw/s([0-9]+)/zarr.json', 1) AS INTEGER) WHEN root % 6 = 1 THEN TRY_CAST(regexp_extract(path, '/([0-9]+)/.zarray', 1) AS INTEGER) WHEN root % 6 = 2 THEN TRY_CAST(regexp_extract(path, '/s([0-9]+)/attributes', 1) AS INTEGER) END) AS top FROM {LISTING} GROUP BY root")
def level_names(spark, d):
    """How levels are named, and the last of them; the folders' first group that has levels."""
    return discovery.levels(listing(spark, d), "root")


@query(f"SELECT root, path, row_number() OVER (PARTITION BY root ORDER BY path) AS place FROM {LISTING} WHERE regexp_matches(path, '\\.(tif|tiff|nd2|czi|ims|h5|hdf5)$') QUALIFY place <= 4")
def first_files(spark, d):
    """Files of a known ending, sorted, the first four of each folder."""
    files = listing(spark, d).where(discovery.convertible(F.col("path")))
    return files.select("root", "path", F.row_number().over(Window.partitionBy("root").orderBy("path")).cast("long").alias("place")).where("place <= 4")


_TREE = "SELECT l_suppkey AS root, CASE WHEN l_partkey % 17 = 0 THEN 'raw' WHEN l_partkey % 17 = 1 THEN 's0' ELSE 'g' || l_partkey % 17 END || '/n' || l_orderkey % 13 || '/' || CASE WHEN l_linenumber = 1 THEN 'em' ELSE 'p' || l_linenumber END || CASE WHEN l_linenumber = 7 THEN '/q/deep' WHEN l_linenumber = 6 THEN '/q' ELSE '' END || CASE WHEN l_quantity > 46 THEN '/.zarray' ELSE '/note.txt' END AS file FROM lineitem"
_ORDER = "CASE name WHEN 's0' THEN 1 WHEN 'em' THEN 2 WHEN 'raw' THEN 3 ELSE 100 END"


@query(f"""WITH RECURSIVE files AS (SELECT DISTINCT root, string_split(file, '/') AS parts FROM ({_TREE})),
dirs AS (SELECT DISTINCT root, array_to_string(parts[1:i - 1], '/') AS parent, parts[i] AS name FROM (SELECT root, parts, unnest(range(1, len(parts))) AS i FROM files)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY root, parent ORDER BY {_ORDER}, name) AS place FROM dirs QUALIFY place <= 10),
walk(root, path, places, depth) AS (SELECT root, name, [place], 1 FROM ranked WHERE parent = '' UNION ALL SELECT w.root, w.path || '/' || r.name, list_append(w.places, r.place), w.depth + 1 FROM walk w JOIN ranked r ON r.root = w.root AND r.parent = w.path WHERE w.depth < 4),
arrays AS (SELECT DISTINCT root, array_to_string(parts[1:len(parts) - 1], '/') AS path FROM files WHERE parts[len(parts)] = '.zarray')
SELECT root, path, depth FROM walk JOIN arrays USING (root, path) QUALIFY row_number() OVER (PARTITION BY root ORDER BY depth, places) = 1""")
def first_arrays(spark, d):
    """The first array below each root, level by level, in the first ten folders of each and four levels down."""
    name = lambda c, m: F.concat(F.lit(c), m.cast("string"))
    part, line = F.col("l_partkey") % 17, F.col("l_linenumber")
    top = F.when(part == 0, "raw").when(part == 1, "s0").otherwise(name("g", part))
    deep = F.when(line == 7, "/q/deep").when(line == 6, "/q").otherwise("")
    inner = F.concat(top, F.lit("/"), name("n", F.col("l_orderkey") % 13), F.lit("/"), F.when(line == 1, "em").otherwise(name("p", line)), deep, F.when(F.col("l_quantity") > 46, "/.zarray").otherwise("/note.txt"))
    files = fixtures.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("root"), inner.alias("inner"))
    return discovery.first_arrays(files, "root", F.col("inner").endswith("/.zarray"))


@query(f"SELECT CAST(t AS BIGINT) AS t, CAST(c AS BIGINT) AS c, CAST(x AS BIGINT) AS x, CAST(v AS INTEGER) AS v FROM {_DENSE}")
def incremental_array(spark, d):
    """R: an array that three batches of a stream fill; a second stream with the same batches changes nothing, as their records are there."""
    root = f"{zarr.shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    cells = fixtures.channels(spark, d).withColumn("part", F.col("t") % 3)
    for i in range(3):
        cells.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(f"{root}/in")
    incremental.create(f"{root}/a", ["t", "c", "x"], [1, 5, 24], [7, 2, 24], "int32")
    rows = spark.readStream.schema("t long, c long, x long, v long").option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    for run in ("first", "again"):
        stream = incremental.append_stream(rows, f"{root}/a", ["t", "c", "x"], f"{root}/state", f"{root}/{run}", "c")
        stream.awaitTermination()
    return blocks.from_chunks(zarr.read_chunks(spark, f"{root}/a"), ["t", "c", "x"], "int32")


@query(f"SELECT x, y, z, c, CAST(v AS DECIMAL(20, 0)) AS v FROM (SELECT y // 5 AS x, y % 5 AS y, x AS z, CAST(0 AS BIGINT) AS c, v FROM ({SQL['labels']}))")
def precomputed_labels(spark, d):
    """A6, Mx14: labels as compressed blocks in shards, by hashed codes, written and read back.

    A volume is dense and the table need not be: what is stored is 0 where there is no row, 1 for a row without a label, else the label from 2 on.
    """
    least = F.lit(2 + (1 << 31)).cast("decimal(20,0)")  # labels are signed 32-bit numbers
    stored = F.coalesce(F.col("v").cast("decimal(20,0)") + least, F.lit(1)).cast("decimal(20,0)")
    src = fixtures.labels(spark, d).select(F.expr("y div 5").alias("x"), F.expr("y % 5").alias("y"), F.col("x").alias("z"), F.lit(0).cast("long").alias("c"), stored.alias("v"))
    top = src.agg(*[(F.max(a) + 1).alias(a) for a in "xyz"]).first()
    shape = {"x": top["x"], "y": top["y"], "z": top["z"], "c": 1}
    path = f"{zarr.shared_folder(spark)}/array-{uuid.uuid4().hex}"
    chunks = blocks.to_chunks(src, shape, {"x": 4, "y": 4, "z": 8, "c": 1}, dtype="uint64")
    scale = precomputed.write_scale(chunks, path, [shape[a] for a in "xyz"], [4, 4, 8], "uint64", [8.0, 8.0, 8.0], "compressed_segmentation", {"minishard_bits": 1, "shard_bits": 1})
    precomputed.write_info(path, "uint64", [scale], "segmentation")
    found = blocks.from_chunks(zarr.read_chunks(spark, path), ["x", "y", "z", "c"], "uint64").where("v > 0")
    return found.select("x", "y", "z", "c", F.when(F.col("v") > 1, F.col("v") - least).cast("decimal(20,0)").alias("v"))


@query("SELECT o_custkey AS batch, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'O') AS failed, count(*) FILTER (o_orderstatus = 'P') AS skipped, count(*) FILTER (o_orderstatus IN ('F', 'P')) = count(*) AS complete, min(o_orderkey) FILTER (o_orderstatus = 'O') AS first_failure, coalesce(array_to_string(list_sort(list(o_orderkey) FILTER (o_orderstatus = 'O'))[1:10], ','), '') AS failures FROM orders GROUP BY o_custkey")
def batch_reports(spark, d):
    """Counts by status of every batch, whether it is complete, its first ten failures."""
    found = reports.batch_report(fixtures.table(spark, d, "orders"), "o_custkey", "o_orderstatus", "o_orderkey", "F", "O", "P")
    return found.select(F.col("o_custkey").alias("batch"), "total", "done", "failed", "skipped", "complete", F.get("failures", F.lit(0)).alias("first_failure"), F.array_join(F.transform("failures", lambda x: x.cast("string")), ",").alias("failures"))


@query(f"SELECT i.root, i.path AS image, l.path AS label FROM {LISTING.replace('AS listing', 'AS i')} JOIN {LISTING.replace('AS listing', 'AS l')} ON i.root = l.root WHERE contains(i.path, '/raw/s') AND regexp_matches(i.path, '/raw/s[0-9]+/zarr.json$') AND regexp_matches(l.path, '/labels/[^/]+/s[0-9]+/zarr.json$') AND regexp_extract(i.path, '/s([0-9]+)/', 1) = regexp_extract(l.path, '/s([0-9]+)/', 1)")
def images_with_labels(spark, d):
    """Levels of images with the same level of their labels."""
    level = F.regexp_extract("path", "/s([0-9]+)/", 1)
    files = listing(spark, d)
    images = files.where(F.col("path").rlike("/raw/s[0-9]+/zarr.json$")).select("root", level.alias("level"), F.col("path").alias("image"))
    labels = files.where(F.col("path").rlike("/labels/[^/]+/s[0-9]+/zarr.json$")).select("root", level.alias("level"), F.col("path").alias("label"))
    return images.join(labels, ["root", "level"]).select("root", "image", "label")


@query("SELECT c_custkey AS k, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AS both_, c_custkey NOT IN (SELECT o_custkey FROM orders) AS only_left FROM customer")
def sets_of_names(spark, d):
    """O: intersection and difference of two sets of names, as semi and anti joins."""
    customers = fixtures.table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    orders = fixtures.table(spark, d, "orders")
    done = orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))
    some = orders.select(F.col("o_custkey").alias("k"))
    tell = lambda keys, name: keys.distinct().withColumn(name, F.lit(True))
    table = customers.join(tell(done, "b"), "k", "left").join(tell(some, "a"), "k", "left")
    return table.select("k", F.col("b").isNotNull().alias("both_"), F.col("a").isNull().alias("only_left"))

"""Queries of scalar functions on axes, chunks, units, types, colours and names, one row or more for each volume; with SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import layout as L
from ..functions import metadata as M
from ..functions import ome
from ..operators import pyramid
from ..sources import fixtures
from .catalog import img, query
from .containers import LISTING, listing
from .layouts import KIND, VOL, whole

_volumes = fixtures.volumes
_list = fixtures._list


def _turn(values, i):
    """One of some values by a number."""
    return F.element_at(F.array(*(F.lit(v) for v in values)), (F.pmod(i, F.lit(len(values))) + 1).cast("int"))


# -- chunks and shards ----------------------------------------------------------------------

_CUBE = f"(SELECT k, shape[r - 2] AS z, shape[r - 1] AS y, shape[r] AS x, (shape[r - 2] + 2) // 3 AS cz, (shape[r - 1] + 2) // 3 AS cy, (shape[r] + 2) // 3 AS cx FROM {VOL})"
_CHUNKS = f"(SELECT *, gz * gy * gx AS total, unnest(range(gz * gy * gx)) AS id FROM (SELECT *, (z + cz - 1) // cz AS gz, (y + cy - 1) // cy AS gy, (x + cx - 1) // cx AS gx FROM {_CUBE}))"


def _cubes(spark, d):
    """The last three axes of every volume (n_z, n_y, n_x), about three chunks along each (c_z, c_y, c_x)."""
    n = {a: F.get("shape", F.col("r") - 3 + i) for i, a in enumerate("zyx")}
    return _volumes(spark, d).select("k", *(c.alias(f"n_{a}") for a, c in n.items())).withColumns({f"c_{a}": F.floor((F.col(f"n_{a}") + 2) / 3) for a in "zyx"})


def _by_axis(name: str):
    return [F.col(f"{name}_{a}") for a in "zyx"]


@query(f"SELECT k, id AS chunk_id, id // (gy * gx) * cz AS z_start, least((id // (gy * gx) + 1) * cz, z) AS z_stop, id // gx % gy * cy AS y_start, least((id // gx % gy + 1) * cy, y) AS y_stop, id % gx * cx AS x_start, least((id % gx + 1) * cx, x) AS x_stop FROM {_CHUNKS}")
def chunk_enumerate(spark, d):
    """Every chunk of every volume, cut at the edges."""
    table = _cubes(spark, d).select("*", F.explode(L.chunk_numbers(_by_axis("n"), _by_axis("c"))).alias("chunk_id"))
    ends = [c.alias(f"{a}_{name}") for a, at in zip("zyx", L.chunk_at(F.col("chunk_id"), _by_axis("n"), _by_axis("c")), strict=True) for name, c in zip(("start", "stop"), at, strict=True)]
    return table.select("k", "chunk_id", *ends)


@query(f"SELECT k, CAST(list_product(list_transform(range(r), lambda i: (shape[i + 1] + [1, 64][CASE WHEN axes[i + 1] IN ('z', 'y', 'x') THEN 2 ELSE 1 END] - 1) // [1, 64][CASE WHEN axes[i + 1] IN ('z', 'y', 'x') THEN 2 ELSE 1 END])) AS BIGINT) AS n FROM {VOL}")
def chunk_count(spark, d):
    """How many chunks of 64 a side."""
    return _volumes(spark, d).select("k", L.product(L.chunk_counts(F.col("shape"), L.shape_by_axis(F.col("axes"), 64))).alias("n"))


@query(f"SELECT k, shard_id, count(*) AS chunks FROM (SELECT k, (id // (gy * gx) // 2 * ((gy + 1) // 2) + id // gx % gy // 2) * ((gx + 1) // 2) + id % gx // 2 AS shard_id FROM {_CHUNKS}) GROUP BY ALL")
def shard_chunks(spark, d):
    """How many chunks each shard of two a side holds; those at the edges hold fewer."""
    # dealt by volume before the chunks are listed: the groups of shards lie where their volume does, and chunks don't move
    table = _cubes(spark, d).repartition("k").select("*", F.explode(L.chunk_numbers(_by_axis("n"), _by_axis("c"))).alias("id"))
    start = [a for a, _ in L.chunk_at(F.col("id"), _by_axis("n"), _by_axis("c"))]
    return table.groupBy("k", L.shard_number(start, _by_axis("n"), [c * 2 for c in _by_axis("c")]).alias("shard_id")).agg(F.count(F.lit(1)).alias("chunks"))


@query(f"SELECT k, job, min(i) AS start, max(i) + 1 AS stop FROM (SELECT k, i, CASE WHEN i < (total // jobs + 1) * (total % jobs) THEN i // (total // jobs + 1) ELSE total % jobs + (i - (total // jobs + 1) * (total % jobs)) // (total // jobs) END AS job FROM (SELECT k, 10 + k % 90 AS total, 1 + k % 7 AS jobs, unnest(range(10 + k % 90)) AS i FROM {VOL})) GROUP BY ALL")
def chunk_ranges(spark, d):
    """The chunks of a volume among one to seven jobs."""
    k = F.col("k")
    return _volumes(spark, d).select("k", F.inline(L.work_ranges(10 + k % 90, 1 + k % 7)))


@query(f"SELECT k, n, c, s, CASE WHEN n < s THEN least((n + c - 1) // c * c, s) ELSE s END AS shard FROM (SELECT k, shape[r] AS n, CAST(8 << CAST(k % 4 AS INTEGER) AS BIGINT) AS c, CAST(128 << CAST(k % 5 AS INTEGER) AS BIGINT) AS s FROM {VOL})")
def shard_clamp(spark, d):
    """E10."""
    k = F.col("k")
    table = _volumes(spark, d).select("k", F.get("shape", F.col("r") - 1).alias("n"), F.expr("shiftleft(8L, CAST(k % 4 AS INT))").alias("c"), F.expr("shiftleft(128L, CAST(k % 5 AS INT))").alias("s"))
    return table.select("k", "n", "c", "s", M.clamp_shard(F.col("n"), F.col("c"), F.col("s")).alias("shard"))


@query(f"SELECT k, bytes, CASE WHEN bytes < 21474836480 THEN 64 WHEN bytes < 107374182400 THEN 128 ELSE 256 END AS chunk FROM (SELECT k, CAST(list_product(shape) AS BIGINT) * (1 + k % 50) * 8 AS bytes FROM {VOL})")
def adaptive_chunk(spark, d):
    """E8."""
    size = L.product(F.col("shape")) * (1 + F.col("k") % 50) * 8
    return _volumes(spark, d).select("k", size.alias("bytes")).select("k", "bytes", M.adaptive_chunk(F.col("bytes")).alias("chunk"))


# -- pyramids -------------------------------------------------------------------------------

_FACTORS = "CASE WHEN vz / vy >= 2 AND vz / vx >= 2 THEN [1, 2, 2] WHEN vz / vy <= 0.5 AND vz / vx <= 0.5 THEN [2, 1, 1] WHEN vy / vz >= 2 AND vy / vx >= 2 THEN [2, 1, 2] WHEN vy / vz <= 0.5 AND vy / vx <= 0.5 THEN [1, 2, 1] WHEN vx / vz >= 2 AND vx / vy >= 2 THEN [2, 2, 1] WHEN vx / vz <= 0.5 AND vx / vy <= 0.5 THEN [1, 1, 2] ELSE [2, 2, 2] END"
_OFF = " OR ".join(f"abs({a}0 / {a}::DOUBLE - pow(2, round_even(log2({a}0 / {a}::DOUBLE), 0))) / pow(2, round_even(log2({a}0 / {a}::DOUBLE), 0)) > 0.04" for a in "zyx")
_PLAN = f"""WITH RECURSIVE p(k, level, lead, z0, y0, x0, z, y, x, vz, vy, vx, cz, cy, cx) AS (
SELECT k, 0, CAST(list_product(list_concat([1], shape[1:r - 3])) AS BIGINT), shape[r - 2], shape[r - 1], shape[r], shape[r - 2], shape[r - 1], shape[r], voxel[r - 2], voxel[r - 1], voxel[r], 1::BIGINT, 1::BIGINT, 1::BIGINT FROM {VOL}
UNION ALL SELECT k, level + 1, lead, z0, y0, x0, z, y, x, vz, vy, vx, cz, cy, cx FROM (
    SELECT k, level, lead, z0, y0, x0, greatest(1, z // f[1]) AS z, greatest(1, y // f[2]) AS y, greatest(1, x // f[3]) AS x, vz * f[1] AS vz, vy * f[2] AS vy, vx * f[3] AS vx, cz * f[1] AS cz, cy * f[2] AS cy, cx * f[3] AS cx
    FROM (SELECT *, {_FACTORS} AS f FROM p WHERE level < 20))
WHERE NOT (lead * z * y * x * 2 < 524288 OR (z < 32 AND y < 32 AND x < 32) OR {_OFF}))
SELECT k, level, cz, cy, cx, vz, vx FROM p"""


@query(_PLAN)
def pyramid_plan(spark, d):
    """H3, H4, H6: the levels of every volume."""
    table = pyramid.plans(_volumes(spark, d), "k")
    at = lambda c, i, name: F.element_at(c, i).alias(name)
    return table.select("k", "level", at("cumulative", -3, "cz"), at("cumulative", -2, "cy"), at("cumulative", -1, "cx"), at("voxel", -3, "vz"), at("voxel", -1, "vx"))


@query(f"SELECT k, i AS level, f[i + 1] AS factor, CAST(list_product(f[1:i + 1]) AS BIGINT) AS cumulative FROM (SELECT k, f, unnest(range(len(f))) AS i FROM (SELECT k, list_transform(range(1 + k % 6), lambda j: 1 + (k + j) % 3) AS f FROM {VOL}))")
def cumulative_factors(spark, d):
    """H5."""
    k = F.col("k")
    f = F.transform(F.sequence(F.lit(0).cast("long"), k % 6), lambda j: 1 + (k + j) % 3)
    table = _volumes(spark, d).select("k", f.alias("f"))
    return table.select("k", F.posexplode(F.arrays_zip(F.col("f").alias("factor"), L.running_products(F.col("f")).alias("cumulative"))).alias("level", "x")).select("k", F.col("level").cast("long").alias("level"), "x.factor", "x.cumulative")


@query(f"SELECT k, CAST(i AS INTEGER) AS level, v * pow(2, i) AS scale, CASE WHEN k % 3 = 0 THEN 0.0::DOUBLE ELSE v * (pow(2, i) - 1) / 2 END AS translation FROM (SELECT k, voxel[r] AS v, unnest(range(6)) AS i FROM {VOL})")
def level_scale_translation(spark, d):
    """H8, H9: of six levels; strided levels aren't shifted."""
    first = F.slice("voxel", F.col("r"), 1)
    levels = _volumes(spark, d).select("k", first.alias("v"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("level"))
    scale = F.transform("v", lambda v: v * F.pow(F.lit(2.0), F.col("level")))
    shift = L.translation(scale, F.col("v"), F.when(F.col("k") % 3 == 0, "stride").otherwise("mean"))
    return levels.select("k", "level", scale[0].alias("scale"), shift[0].alias("translation"))


@query(f"SELECT k, zoom, CAST(round_even(n * zoom, 0) AS BIGINT) AS extent FROM (SELECT k, shape[r - 2] AS n, voxel[r - 2] / voxel[r] AS zoom FROM {VOL})")
def zoom_factors(spark, d):
    """Z to the size of x."""
    zoom = F.get("voxel", F.col("r") - 3) / F.get("voxel", F.col("r") - 1)
    return _volumes(spark, d).select("k", zoom.alias("zoom"), F.bround(F.get("shape", F.col("r") - 3) * zoom).cast("long").alias("extent"))


# -- statuses and listings ------------------------------------------------------------------


@query("SELECT batch, status, n, round(100.0::DOUBLE * n / sum(n) OVER (PARTITION BY batch), 1) AS percent FROM (SELECT o_custkey AS batch, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY ALL)")
def batch_status(spark, d):
    """statuses of every batch and their shares."""
    counts = fixtures.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("batch"), F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("batch"))
    return counts.select("batch", "status", "n", F.round(100.0 * F.col("n") / total, 1).alias("percent"))


@query("SELECT batch, count(*) FILTER (island = 0) AS levels FROM (SELECT batch, n - row_number() OVER (PARTITION BY batch ORDER BY n) AS island FROM (SELECT DISTINCT o_custkey AS batch, 1 + o_orderkey % 7 AS n FROM orders)) GROUP BY batch")
def consecutive_levels(spark, d):
    """of the levels a container has, how many follow each other from the first."""
    found = fixtures.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("batch")).agg(F.collect_set(1 + F.col("o_orderkey") % 7).alias("n"))
    return found.select("batch", L.consecutive(F.col("n")).cast("long").alias("levels"))


@query(f"SELECT root, path, row_number() OVER (PARTITION BY root ORDER BY CAST(regexp_extract(path, 'img_([0-9]+)', 1) AS BIGINT)) AS place FROM {LISTING} WHERE path LIKE '%.tif' AND path LIKE '%img_%'")
def natural_sort(spark, d):
    """The images of a stack by their numbers."""
    files = listing(spark, d).where("path LIKE '%.tif' AND path LIKE '%img_%'")
    return files.select("root", "path", F.row_number().over(Window.partitionBy("root").orderBy(M.natural_key(F.col("path")))).cast("long").alias("place"))


@query(f"SELECT folder, kind, count(*) AS n, count(*) > 1 AS ambiguous FROM (SELECT k // 4 AS folder, {KIND} AS kind FROM {VOL}) GROUP BY ALL")
def discovery_validation(spark, d):
    """In folders of four."""
    found = _volumes(spark, d).select(F.expr("k div 4").alias("folder"), M.classify(F.col("word"), F.col("dtype"), F.col("encoding")).alias("kind"))
    return found.groupBy("folder", "kind").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) > 1).alias("ambiguous"))


@query(f"SELECT k, {KIND} AS kind FROM {VOL}")
def classify_datasets(spark, d):
    """B1: names, types and encodings in capitals."""
    return _volumes(spark, d).select("k", M.classify(F.upper("word"), F.upper("dtype"), F.upper("encoding")).alias("kind"))


@query(f"SELECT folder, list_sort(list(DISTINCT word)) AS labels FROM (SELECT k // 10 AS folder, word FROM {VOL}) GROUP BY folder")
def label_list_union(spark, d):
    """J8, O: the labels of a folder's volumes, each once, in order."""
    table = _volumes(spark, d).groupBy(F.expr("k div 10").alias("folder")).agg(F.collect_list("word").alias("words"))
    return table.select("folder", F.array_sort(ome.merged_labels(F.slice("words", 1, 3), F.slice("words", 4, 100))).alias("labels"))


# -- axes, units, types ---------------------------------------------------------------------

_SAID = "CASE WHEN k % 5 = 0 THEN upper(a) WHEN k % 5 = 1 AND a = 'c' THEN 'Channel' WHEN k % 5 = 2 AND a = 'z' THEN 'other' ELSE a END"


@query(f"SELECT k, i, said, CASE lower(said) WHEN 'channel' THEN 'c' WHEN 'v' THEN 't' ELSE lower(said) END AS name, CASE WHEN lower(said) IN ('c', 'channel') THEN 'channel' WHEN lower(said) IN ('t', 'v') THEN 'time' ELSE 'space' END AS kind, CASE WHEN lower(said) IN ('x', 'y', 'z') THEN 'nanometer' WHEN lower(said) = 't' THEN 'millisecond' END AS unit FROM (SELECT k, i, {_SAID} AS said FROM (SELECT k, i, axes[i + 1] AS a FROM (SELECT k, axes, unnest(range(r)) AS i FROM {VOL})))")
def axis_types_units(spark, d):
    """Views and unknown axes have no unit."""
    k, a = F.col("k"), F.col("a")
    said = F.when(k % 5 == 0, F.upper(a)).when((k % 5 == 1) & (a == "c"), "Channel").when((k % 5 == 2) & (a == "z"), "other").otherwise(a)
    table = _volumes(spark, d).select("k", F.posexplode("axes").alias("i", "a")).select("k", F.col("i").cast("long").alias("i"), said.alias("said"))
    said = F.col("said")
    return table.select("k", "i", "said", M.axis_name(said).alias("name"), M.axis_type(said).alias("kind"), M.axis_unit(said).alias("unit"))


_LONG = "list_filter(range(r), lambda i: shape[i + 1] > 10)"
_SHORT = "list_filter(range(r), lambda i: shape[i + 1] <= 10)"


@query(f"SELECT k, CASE WHEN len(sp) BETWEEN 2 AND 3 AND len(ns) <= 2 THEN array_to_string(list_transform(range(r), lambda i: CASE WHEN list_contains(sp, i) THEN ['x', 'y', 'z'][len(sp) - list_position(sp, i) + 1] WHEN len(ns) = 2 AND i = ns[1] THEN 't' ELSE 'c' END), ',') ELSE CASE r WHEN 3 THEN 'z,y,x' WHEN 4 THEN 'c,z,y,x' WHEN 5 THEN 't,c,z,y,x' ELSE array_to_string(list_transform(range(r), lambda i: 'dim_' || i), ',') END END AS names FROM (SELECT *, {_LONG} AS sp, {_SHORT} AS ns FROM {VOL})")
def infer_dimension_names(spark, d):
    """I4, by extents alone."""
    return _volumes(spark, d).select("k", F.array_join(L.infer_names(F.col("shape")), ",").alias("names"))


_UNITS = ("nm", "micrometer", "µm", "mm", "m", "parsec", "", "Nanometers")


@query(f"SELECT k, CASE WHEN value IS NULL THEN 1.0::DOUBLE ELSE value * {_list((1, 1000, 1000, 1000000, 1000000000, 1000, 1, 1))}[k % 8 + 1] END AS nm FROM (SELECT k, CASE WHEN k % 11 > 0 THEN voxel[r] END AS value FROM {VOL})")
def unit_to_nm(spark, d):
    """J-1: an unknown unit counts as micrometres, none as nanometres, no value as 1."""
    k = F.col("k")
    return _volumes(spark, d).select("k", M.to_nanometers(F.when(k % 11 > 0, F.get("voxel", F.col("r") - 1)), _turn(_UNITS, k)).alias("nm"))


_DTYPE_CODES = {"uint8": "|u1", "uint16": "<u2", "uint32": ">u4", "uint64": "<u8", "int8": "|i1", "int16": ">i2", "int32": "<i4", "int64": "<i8", "float32": "<f4", "float64": ">f8"}


@query(f"SELECT k, CASE WHEN k % 7 = 0 THEN dtype ELSE {_list(_DTYPE_CODES.values())}[list_position({_list(_DTYPE_CODES)}, dtype)] END AS code, dtype AS name FROM {VOL}")
def numpy_types(spark, d):
    """A type's name from its code; names stay."""
    codes = F.create_map(*[F.lit(v) for pair in _DTYPE_CODES.items() for v in pair])
    code = F.when(F.col("k") % 7 == 0, F.col("dtype")).otherwise(codes[F.col("dtype")])
    return _volumes(spark, d).select("k", code.alias("code"), M.numpy_type(code).alias("name"))


@query(f"SELECT k, CAST(CASE dtype WHEN 'int8' THEN -128 WHEN 'int16' THEN -32768 ELSE 0 END AS DOUBLE) AS low, CAST(CASE dtype WHEN 'uint8' THEN 255 WHEN 'int8' THEN 127 WHEN 'int16' THEN 32767 WHEN 'float32' THEN 1 WHEN 'float64' THEN 1 ELSE 65535 END AS DOUBLE) AS high, dtype IN ('uint32', 'uint64', 'int32', 'int64') AS segmentation FROM {VOL}")
def dtype_window(spark, d):
    """L5, I9."""
    low, high = M.dtype_window(F.col("dtype"))
    return _volumes(spark, d).select("k", low.alias("low"), high.alias("high"), M.is_segmentation(F.col("dtype")).alias("segmentation"))


@query("SELECT o_orderkey AS k, n, CASE WHEN n < 1024 THEN printf('%.1f B', n::DOUBLE) WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0::DOUBLE) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0::DOUBLE) WHEN n < 1099511627776 THEN printf('%.1f GB', n / 1073741824.0::DOUBLE) WHEN n < 1125899906842624 THEN printf('%.1f TB', n / 1099511627776.0::DOUBLE) ELSE printf('%.1f PB', n / 1125899906842624.0::DOUBLE) END AS size FROM (SELECT o_orderkey, (o_orderkey % 977 + 1) * (1::BIGINT << CAST(o_orderkey % 52 AS INTEGER)) AS n FROM orders)")
def human_sizes(spark, d):
    """J-8."""
    n = F.expr("(o_orderkey % 977 + 1) * shiftleft(1L, CAST(o_orderkey % 52 AS INT))")
    return fixtures.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), n.alias("n")).select("k", "n", M.human_size(F.col("n").cast("double")).alias("size"))


@query(f"SELECT k, voxel[r] AS x, voxel[r - 1] AS y, voxel[r - 2] AS z, voxel[r] <> voxel[r - 1] AND (voxel[r] = voxel[r - 2] OR voxel[r - 1] = voxel[r - 2]) AS swapped FROM {VOL}")
def axis_voxel_check(spark, d):
    """I7, G10."""
    x, y, z = (F.get("voxel", F.col("r") - i) for i in (1, 2, 3))
    return _volumes(spark, d).select("k", x.alias("x"), y.alias("y"), z.alias("z"), M.axes_look_swapped(x, y, z).alias("swapped"))


@query(f"SELECT k, rank, CASE rank WHEN 2 THEN 'yx' WHEN 3 THEN 'zyx' WHEN 4 THEN CASE WHEN 1 + k % 3 > 1 AND k % 2 = 0 THEN 't' ELSE 'c' END || 'zyx' WHEN 5 THEN 'tczyx' ELSE array_to_string(list_transform(range(rank), lambda i: 'dim_' || i), ',') END AS axes FROM (SELECT k, 2 + k % 6 AS rank FROM {VOL})")
def axes_by_rank(spark, d):
    """Several times and one channel make a fourth axis a time."""
    k, rank = F.col("k"), (2 + F.col("k") % 6).cast("int")
    return _volumes(spark, d).select("k", rank.cast("long").alias("rank"), M.axes_by_rank(rank, 1 + k % 3, 1 + k % 2).alias("axes"))


@query(f"SELECT k, low, low + span AS high, n, span / CAST(n AS DOUBLE) * CASE WHEN k % 4 = 1 OR k % 4 IN (0, 3) AND span < n THEN 1000 ELSE 1 END AS nm FROM (SELECT k, -(k % 9) AS low, 1 + k * 37 % 4000 AS span, shape[r] AS n FROM {VOL})")
def extent_voxel_size(spark, d):
    """J-4: without a unit, voxels below 1 are micrometres."""
    k = F.col("k")
    low, high, n = -(k % 9), -(k % 9) + 1 + k * 37 % 4000, F.get("shape", F.col("r") - 1)
    unit = F.when(k % 4 == 0, "").when(k % 4 == 1, "um").when(k % 4 == 2, "nm")
    return _volumes(spark, d).select("k", low.alias("low"), high.alias("high"), n.alias("n"), M.extent_voxel_nm(low, high, n, unit).alias("nm"))


# -- colours and channels -------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, printf('%06X', (l_partkey * 7919 + l_suppkey) % 16777216) AS hex FROM lineitem")
def rgba_hex(spark, d):
    """L1: signed numbers of four bytes."""
    color = F.expr("(l_partkey * 7919 + l_suppkey) % 16777216 * 256 + l_linenumber")
    signed = F.when(color >= 1 << 31, color - (1 << 32)).otherwise(color).cast("int")
    return fixtures.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", M.rgba_hex(signed).alias("hex"))


_WAVE = "CASE WHEN {0} < 500 THEN '0000FF' WHEN {0} < 560 THEN '00FF00' WHEN {0} IS NOT NULL THEN 'FF0000' END"
_NAMED = "CASE WHEN {0} = floor({0}) THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) ELSE CAST({0} AS VARCHAR) END"


@query(f"SELECT k, i, n, coalesce(CASE WHEN k % 7 = 3 AND length(CAST(k * 256 AS VARCHAR)) = 6 THEN CAST(k * 256 AS VARCHAR) WHEN k % 7 IN (1, 2, 3, 4) THEN hex END, CASE WHEN n = 1 THEN '808080' END, {_WAVE.format('em')}, {_WAVE.format('ex')}, ['FF0000', '00FF00', '0000FF', 'FF00FF', 'FFFF00', '00FFFF'][i % 6 + 1]) AS color, coalesce(nullif(name, ''), {_NAMED.format('em')}, {_NAMED.format('ex')}, dye, 'Channel ' || i) AS label FROM (SELECT k, k % 8 AS i, 1 + k % 3 AS n, printf('%06X', k % 16777216) AS hex, CASE k % 3 WHEN 0 THEN word WHEN 1 THEN '' END AS name, CASE WHEN k % 4 = 0 THEN 400.0::DOUBLE + k % 300 / 2.0::DOUBLE END AS em, CASE WHEN k % 5 = 0 THEN 450.0::DOUBLE + k % 200 END AS ex, CASE WHEN k % 6 = 0 THEN 'dye' || k END AS dye FROM {VOL})")
def channel_color_label(spark, d):
    """L2, L3, L4: colours told in any way, then grey for one channel, wavelengths, and a cycle of six; labels by name, wavelength, dye and number."""
    k = F.col("k")
    hexes = F.lpad(F.hex(k % 16777216), 6, "0")
    told = F.when(k % 7 == 1, F.concat(F.lit("#"), F.lower(hexes))).when(k % 7 == 2, hexes).when(k % 7 == 3, (k * 256).cast("string")).when(k % 7 == 4, F.concat(F.lit("##"), hexes)).when(k % 7 == 5, "blue")
    em, ex = F.when(k % 4 == 0, 400.0 + k % 300 / 2.0), F.when(k % 5 == 0, 450.0 + k % 200)
    name, dye = F.when(k % 3 == 0, F.col("word")).when(k % 3 == 1, ""), F.when(k % 6 == 0, F.concat(F.lit("dye"), k.cast("string")))
    return _volumes(spark, d).select("k", (k % 8).alias("i"), (1 + k % 3).alias("n"), M.channel_color(told, em, ex, k % 8, 1 + k % 3).alias("color"), M.channel_label(name, em, ex, dye, k % 8).alias("label"))


@query(f"SELECT k, idx, CASE WHEN idx < 2 THEN word || idx END AS name FROM (SELECT k, word, unnest([0, 1, 2]) AS idx FROM {VOL})")
def ome_xml_channels(spark, d):
    """Names; null where there is none."""
    xml = F.concat(F.lit('<Pixels><Channel ID="0" Name="'), "word", F.lit('0"/><Channel ID="1" Name="'), "word", F.lit('1"/><Channel ID="2"/></Pixels>'))
    return _volumes(spark, d).select("k", F.posexplode(ome.channels(xml)).alias("idx", "c")).select("k", "idx", "c.name")


@query(f"SELECT k, path, voxel[r - 2] AS z, voxel[r] * f AS x FROM {VOL}, (VALUES ('s0', 1), ('s1', 2)) AS t(path, f)")
def json_scale_extract(spark, d):
    """Scales of each level out of a group's JSON."""
    levels = F.array(ome.dataset(F.lit("s0"), F.col("voxel")), ome.dataset(F.lit("s1"), F.transform("voxel", lambda v, i: F.when(i == F.size("voxel") - 1, v * 2).otherwise(v))))
    json = F.to_json(F.struct(F.array(F.struct(levels.alias("datasets"))).alias("multiscales")))
    parsed = _volumes(spark, d).select("k", json.alias("json")).select("k", F.inline(F.from_json("json", ome.GROUP)["multiscales"][0]["datasets"]))
    scale = F.filter("coordinateTransformations", lambda t: t["type"] == "scale")[0]["scale"]
    return parsed.select("k", "path", F.element_at(scale, -3).alias("z"), F.element_at(scale, -1).alias("x"))


@query(f"SELECT i, i < 3 AS active, 'linear' AS family, CASE WHEN i = 0 THEN 'AABBCC' WHEN count(*) OVER () = 1 THEN '808080' WHEN i = 1 THEN '00FF00' ELSE ['FF0000', '00FF00', '0000FF', 'FF00FF', 'FFFF00', '00FFFF'][i % 6 + 1] END AS color, CASE WHEN i = 0 THEN 'DAPI' WHEN i = 1 THEN '525' ELSE 'Channel ' || i END AS label, CAST(least AS DOUBLE) AS low, CAST(most AS DOUBLE) AS high, CASE WHEN count(*) OVER () > 1 AND count(*) OVER () < 8 THEN 'color' ELSE 'greyscale' END AS model FROM (SELECT c AS i, min(v) AS least, max(v) AS most FROM {img('channels')} GROUP BY c)")
def omero_block(spark, d):
    """Windows by the values of each channel, beside what is told of the first two."""
    windows = fixtures.channels(spark, d).groupBy("c").agg(F.struct(F.min("v").alias("low"), F.max("v").alias("high")).alias("w"))
    one = windows.agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "w"))), lambda x: x["w"]).alias("windows"))  # one row a channel
    told = F.array(*(F.struct(*(F.lit(v).cast(t).alias(n) for v, (n, t) in zip(c, (("name", "string"), ("color", "string"), ("em", "double"), ("ex", "double"), ("dye", "string")), strict=True))) for c in (("DAPI", "AABBCC", 450.0, None, None), (None, None, 525.0, None, None))))
    block = ome.omero(told, F.lit("uint16"), F.array(F.size("windows").cast("long"), F.lit(1).cast("long")), F.array(F.lit("c"), F.lit("x")), F.col("windows"))
    table = one.select(block.alias("b")).select(F.col("b.rdefs.model").alias("model"), F.posexplode("b.channels").alias("i", "c"))
    return table.select(F.col("i").cast("long").alias("i"), "c.active", "c.family", "c.color", "c.label", F.col("c.window.start").alias("low"), F.col("c.window.end").alias("high"), "model")


# -- names and paths ------------------------------------------------------------------------


@query(f"SELECT k, path, CASE WHEN regexp_matches(lower(array_to_string(string_split(path, '/')[-4:], ' ')), 'label|mask|seg|annotation|binary|instance') THEN 'mode' ELSE 'mean' END AS method FROM (SELECT k, '/seg/' || k % 7 || '/a' || CASE WHEN k % 2 = 0 THEN '/b' ELSE '' END || '/' || CASE WHEN k % 3 = 0 THEN upper(word) ELSE word END || '/s0' AS path FROM {VOL})")
def downsample_method_auto(spark, d):
    """the last four parts tell; backslashes part them too."""
    k = F.col("k")
    path = F.concat(F.lit("/seg/"), (k % 7).cast("string"), F.lit("/a"), F.when(k % 2 == 0, "/b").otherwise(""), F.lit("/"), F.when(k % 3 == 0, F.upper("word")).otherwise(F.col("word")), F.lit("/s0"))
    told = F.when(k % 5 == 0, F.replace(path, F.lit("/"), F.lit("\\"))).otherwise(path)
    return _volumes(spark, d).select("k", path.alias("path"), M.auto_method(told).alias("method"))


_ENDS = (".tif", ".zarr/raw/s0", ".N5/x", ".czi", "", ".precomputed", ".zarrx/s0")


@query(f"SELECT k, path, contains(path, '://') OR list_bool_or(list_transform(string_split(path, '/'), lambda p: regexp_matches(lower(p), '[^.].*\\.(zarr|n5)$'))) AS native FROM (SELECT k, CASE WHEN k % 4 = 0 THEN 's3://b/' ELSE '/in/' END || word || {_list(_ENDS)}[k % 7 + 1] AS path FROM {VOL})")
def native_sources(spark, d):
    """Addresses, and parts that end in .zarr or .n5."""
    k = F.col("k")
    path = F.concat(F.when(k % 4 == 0, "s3://b/").otherwise("/in/"), "word", _turn(_ENDS, k))
    return _volumes(spark, d).select("k", path.alias("path")).select("k", "path", M.is_native(F.col("path")).alias("native"))


@query(f"SELECT k, '/out/a.b/' || word || ' ' || k || '.zarr' AS target, substr('job_' || [ 'tif', '', 'nd2', 'czi' ][k % 4 + 1] || '_to_zarr3_' || word || '_' || k, 1, 128) AS job FROM {VOL}")
def output_names(spark, d):
    """K2, K5."""
    k = F.col("k")
    path = F.concat(F.lit("/in/a.b/"), "word", F.lit(" "), k.cast("string"), _turn((".tif", "", ".nd2", ".czi"), k))
    return _volumes(spark, d).select("k", M.output_path(path, "/in/", "/out").alias("target"), M.job_name(path, "zarr3").alias("job"))


@query(f"SELECT k, array_to_string(list_transform(shape, lambda n: CAST(n AS VARCHAR)), ',') AS said, list_sum(shape)::BIGINT AS total FROM {VOL}")
def parsed_shapes(spark, d):
    """K1: shapes written as text."""
    said = whole(F.col("shape"), ", ")
    total = F.aggregate(M.parse_ints(said), F.lit(0).cast("long"), lambda a, n: a + n)
    return _volumes(spark, d).select("k", F.replace(said, F.lit(" "), F.lit("")).alias("said"), total.alias("total"))


@query(f"SELECT k, k % 5 > 1 AS valid, CASE WHEN k % 5 > 1 THEN -(k % 9) END AS origin, CASE WHEN k % 5 > 1 THEN shape[r] END AS size FROM {VOL}")
def box_arguments(spark, d):
    """D3: boxes written as six numbers; some lack one, some have a size of 0."""
    k = F.col("k")
    size = F.when(k % 5 == 1, "0").otherwise(F.get("shape", F.col("r") - 1).cast("string"))
    said = F.concat_ws(", ", F.lit("12"), F.lit("7"), (-(k % 9)).cast("string"), F.lit("3"), F.when(k % 5 > 0, "5"), size)
    box = M.box_argument(said)
    return _volumes(spark, d).select("k", box.isNotNull().alias("valid"), F.get(box["origin"], F.lit(2)).alias("origin"), F.get(box["size"], F.lit(2)).alias("size"))

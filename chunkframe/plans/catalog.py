"""The array queries with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import metadata as M
from ..operators import blocks, domain, pyramid, resample
from ..sources import fixtures
from ..sources.fixtures import SQL

_QUERIES, _SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries():
    from . import containers, layouts, scalars, upsampling  # noqa: F401  their queries register themselves

    return dict(_QUERIES)


def oracle_sql():
    from . import containers, layouts, scalars, upsampling  # noqa: F401

    return dict(_SQL)


def img(name: str = "image") -> str:
    return f"({SQL[name]}) AS src"


# -- index domain ---------------------------------------------------------------------------


@query(SQL["image"])
def voxels_image(spark, d):
    return fixtures.image(spark, d)


@query(SQL["volume"])
def voxels_volume(spark, d):
    return fixtures.volume(spark, d)


@query(SQL["channels"])
def voxels_channels(spark, d):
    return fixtures.channels(spark, d)


@query(SQL["labels"])
def voxels_labels(spark, d):
    return fixtures.labels(spark, d)


@query(f"SELECT y - 100 AS y, x - 8 AS x, v FROM {img()} WHERE y >= 100 AND y < 300 AND x >= 8 AND x < 40")
def crop_rebase(spark, d):
    return domain.rebase(domain.crop(fixtures.image(spark, d), y=(100, 200), x=(8, 32)), y=100, x=8)


@query(f"SELECT z - 10 AS z, y - 5 AS y, x, v FROM {img('volume')} WHERE z >= 10 AND z < 50 AND y >= 5 AND y < 8")
def crop_3d(spark, d):
    return domain.rebase(domain.crop(fixtures.volume(spark, d), z=(10, 40), y=(5, 3)), z=10, y=5)


@query(f"SELECT x, y, z, v FROM {img('volume')}")
def transpose_zyx_xyz(spark, d):
    return domain.reorder(fixtures.volume(spark, d), "xyz")


@query(f"SELECT t, c, x, v FROM {img('channels')}")
def ome_axis_reorder(spark, d):
    return fixtures.channels(spark, d).select(*domain.ome_order(["t", "x", "c"]), "v")


@query(f"SELECT t, x, v FROM {img('channels')} WHERE c = 2")
def select_channel(spark, d):
    return domain.select_index(fixtures.channels(spark, d), "c", 2)


@query(f"SELECT t, x, v FROM {img('channels')} WHERE c = 0")
def squeeze_channel(spark, d):
    one = domain.crop(fixtures.channels(spark, d), c=(0, 1))
    return domain.select_index(one, "c", 0)


@query(f"SELECT CAST(0 AS BIGINT) AS t, CAST(0 AS BIGINT) AS c, CAST(0 AS BIGINT) AS z, y, x, v FROM {img()}")
def expand_5d(spark, d):
    return domain.expand(fixtures.image(spark, d))


@query(f"SELECT y, x, CAST(least(greatest(v * 5 - 60, 0), 255) AS SMALLINT) AS v FROM {img()}")
def cast_clip_u8(spark, d):
    return fixtures.image(spark, d).withColumn("v", domain.cast_value(F.col("v") * 5 - 60, "uint8"))


@query("SELECT l_orderkey, l_linenumber, CAST(trunc(least(greatest(l_extendedprice / 3 - 1000, 0), 65535)) AS INTEGER) AS v FROM lineitem")
def cast_float_u16(spark, d):
    price = F.col("l_extendedprice") / 3 - 1000
    return fixtures.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", domain.cast_value(price, "uint16", from_float=True).alias("v"))


@query(f"SELECT CAST(min(v) AS BIGINT) AS least, CAST(max(v) AS BIGINT) AS most, min(v) >= 0 AND max(v) <= 255 AS fits FROM {img('volume')}")
def cast_range_probe(spark, d):
    return domain.value_range(fixtures.volume(spark, d), "uint8")


@query(f"SELECT y, 63 - x AS x, v FROM {img()}")
def axis_flip(spark, d):
    return domain.flip(fixtures.image(spark, d), "x", 64)


DENSE = f"(SELECT g.t, g.c, g.x, coalesce(s.v, 0) AS v FROM (SELECT a.t, b.c, e.x FROM range(30) a(t), range(5) b(c), range(24) e(x)) g LEFT JOIN ({SQL['channels']}) s ON s.t = g.t AND s.c = g.c AND s.x = g.x)"


@query(f"SELECT CAST(t AS BIGINT) AS t, CAST(c AS BIGINT) AS c, CAST(x AS BIGINT) AS x, CAST(v AS BIGINT) AS v FROM {DENSE}")
def densify_fill(spark, d):
    return domain.densify(fixtures.channels(spark, d), t=30, c=5, x=24)


@query(f"SELECT t, x, v, CAST(c AS BIGINT) AS c FROM (SELECT t, x, v, 0 AS c FROM {img('channels')} WHERE c = 1 UNION ALL SELECT t, x, v, 1 AS c FROM {img('channels')} WHERE c = 3)")
def stack_channels(spark, d):
    src = fixtures.channels(spark, d)
    return domain.stack([domain.select_index(src, "c", k) for k in (1, 3)], "c").select("t", "x", "v", "c")


# -- chunks and shards ----------------------------------------------------------------------


@query(f"SELECT CAST(y // 64 * 4 + x // 16 AS BIGINT) AS chunk_id, count(*) AS n, CAST(min(v) AS INTEGER) AS least, CAST(max(v) AS INTEGER) AS most, CAST(sum(v) AS BIGINT) AS total FROM {img()} GROUP BY 1")
def chunk_stats(spark, d):
    return fixtures.image(spark, d).groupBy(blocks.chunk_id({"y": 2000, "x": 64}, {"y": 64, "x": 16}).alias("chunk_id")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.sum(F.col("v").cast("long")).alias("total"))


@query(f"SELECT CAST(y // 64 * 4 + x // 16 AS BIGINT) AS chunk_id, y, x, v FROM {img()} WHERE y // 64 * 4 + x // 16 BETWEEN 5 AND 11")
def chunk_partial_range(spark, d):
    tagged = fixtures.image(spark, d).withColumn("chunk_id", blocks.chunk_id({"y": 2000, "x": 64}, {"y": 64, "x": 16}))
    return tagged.where("chunk_id >= 5 AND chunk_id < 12").select("chunk_id", "y", "x", "v")


@query(f"SELECT CAST(y // 50 * 4 + x // 16 AS BIGINT) AS chunk_id, count(*) AS n, list(v ORDER BY y, x) AS values FROM {img()} GROUP BY 1")
def rechunk_payload(spark, d):
    return blocks.rechunk(fixtures.image(spark, d), {"y": 2000, "x": 64}, {"y": 50, "x": 16})


@query(f"SELECT y, x, CAST(v AS BIGINT) AS v FROM {img()}")
def chunk_round_trip(spark, d):
    chunks = blocks.to_chunks(fixtures.image(spark, d), {"y": _height(spark, d), "x": 64}, {"y": 100, "x": 32})
    return blocks.from_chunks(chunks, ["y", "x"])


def _height(spark, d) -> int:
    return fixtures.table(spark, d, "embeddings").agg(F.max("vec_id")).first()[0] + 1


def halves(y: str, x: str, total: str = "sum(CAST(v AS BIGINT))", n: str = "count(*)") -> str:
    q = f"CAST(floor({total} / {n}) AS BIGINT)"
    r = f"({total} - {q} * {n})"
    return f"CAST(CASE WHEN 2 * {r} > {n} THEN {q} + 1 WHEN 2 * {r} < {n} THEN {q} ELSE {q} + {q} % 2 END AS BIGINT)"


MEAN2 = f"SELECT y // 2 AS y, x // 2 AS x, CAST({halves('y', 'x')} AS INTEGER) AS v FROM {img()} GROUP BY 1, 2"


@query(f"SELECT y // 2 AS y, x // 2 AS x, CAST({halves('y', 'x')} AS BIGINT) AS v FROM {img()} GROUP BY 1, 2")
def chunk_downsample_mean(spark, d):
    chunks = blocks.to_chunks(fixtures.image(spark, d), {"y": _height(spark, d), "x": 64}, {"y": 100, "x": 32})
    return blocks.from_chunks(blocks.reduce_chunks(chunks, [2, 2]), ["y", "x"])


# -- block reductions and pyramids ----------------------------------------------------------


@query(MEAN2)
def downsample_mean(spark, d):
    return blocks.downsample(fixtures.image(spark, d), "mean", y=2, x=2)


@query(f"SELECT y, x, v FROM (SELECT y // 3 AS y, x // 3 AS x, v, row_number() OVER (PARTITION BY y // 3, x // 3 ORDER BY count(*) DESC, v) AS r FROM {img()} GROUP BY y // 3, x // 3, v) WHERE r = 1")
def downsample_mode(spark, d):
    return blocks.downsample(fixtures.image(spark, d), "mode", y=3, x=3)


@query(f"SELECT y // 2 AS y, x // 3 AS x, CAST(quantile_disc(v, 0.5) AS INTEGER) AS v FROM {img()} GROUP BY 1, 2")
def downsample_median(spark, d):
    return blocks.downsample(fixtures.image(spark, d), "median", y=2, x=3)


@query(f"SELECT y // 2 AS y, x // 2 AS x, min(v) AS v FROM {img()} GROUP BY 1, 2")
def downsample_min(spark, d):
    return blocks.downsample(fixtures.image(spark, d), "min", y=2, x=2)


@query(f"SELECT y // 4 AS y, x // 2 AS x, max(v) AS v FROM {img()} GROUP BY 1, 2")
def downsample_max(spark, d):
    return blocks.downsample(fixtures.image(spark, d), "max", y=4, x=2)


@query(f"SELECT y // 3 AS y, x // 2 AS x, v FROM {img()} WHERE y % 3 = 0 AND x % 2 = 0")
def downsample_stride(spark, d):
    return blocks.downsample(fixtures.image(spark, d), "stride", y=3, x=2)


@query(f"SELECT t // 2 AS t, CAST(c AS BIGINT) AS c, x // 2 AS x, CAST({halves('', '')} AS BIGINT) AS v FROM {DENSE} GROUP BY 1, 2, 3")
def downsample_mean_3d(spark, d):
    return blocks.downsample(domain.densify(fixtures.channels(spark, d), t=30, c=5, x=24), "mean", t=2, x=2).select("t", "c", "x", "v")


@query(f"SELECT z // 2 AS z, y // 2 AS y, x // 2 AS x, max(v) AS v FROM {img('volume')} GROUP BY 1, 2, 3")
def downsample_max_3d(spark, d):
    return blocks.downsample(fixtures.volume(spark, d), "max", z=2, y=2, x=2)


@query(f"SELECT y, x, v FROM (SELECT y // 2 AS y, x // 2 AS x, v, row_number() OVER (PARTITION BY y // 2, x // 2 ORDER BY count(*) DESC, v) AS r FROM {img('labels')} GROUP BY y // 2, x // 2, v) WHERE r = 1")
def downsample_labels_mode(spark, d):
    return blocks.downsample(fixtures.labels(spark, d), "mode", y=2, x=2)


@query(f"SELECT y // 2 AS y, x // 2 AS x, CAST({halves('y', 'x')} AS INTEGER) AS v FROM ({MEAN2}) GROUP BY 1, 2")
def pyramid_chained_mean(spark, d):
    return pyramid.chained(fixtures.image(spark, d), [{"y": 2, "x": 2}] * 2)[-1]


@query(f"SELECT y // 4 AS y, x // 4 AS x, CAST({halves('y', 'x')} AS INTEGER) AS v FROM {img()} GROUP BY 1, 2")
def pyramid_direct_mean(spark, d):
    return pyramid.direct(fixtures.image(spark, d), [{"y": 2, "x": 2}] * 2)


# -- aggregates -----------------------------------------------------------------------------


@query(f"SELECT c, min(v) AS least, max(v) AS most FROM {img('channels')} GROUP BY c")
def channel_minmax(spark, d):
    return fixtures.channels(spark, d).groupBy("c").agg(F.min("v").alias("least"), F.max("v").alias("most"))


@query(f"SELECT max(v) AS largest FROM {img('labels')}")
def largest_label(spark, d):
    return fixtures.labels(spark, d).agg(F.max("v").alias("largest"))


@query(f"SELECT l.v AS label, count(*) AS n, CAST(sum(i.v) AS BIGINT) AS total, max(i.v) AS most FROM (SELECT y // 20 AS y, y % 20 AS x, CAST(max(v) AS INTEGER) AS v FROM {img()} GROUP BY src.y) i JOIN ({SQL['labels']}) l ON i.y = l.y AND i.x = l.x GROUP BY l.v")
def label_join_stats(spark, d):
    peaks = fixtures.image(spark, d).groupBy(F.expr("y div 20").alias("ly"), F.expr("y % 20").alias("lx")).agg(F.max("v").alias("peak"))
    own = fixtures.labels(spark, d)
    joined = own.join(peaks, (own.y == peaks.ly) & (own.x == peaks.lx))
    return joined.groupBy(F.col("v").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("peak").cast("long")).alias("total"), F.max("peak").alias("most"))


@query("SELECT user_id, CAST(sum(gap) AS BIGINT) // count(*) AS mean_us, count(*) AS n FROM (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events) WHERE gap IS NOT NULL GROUP BY user_id")
def mean_time_interval(spark, d):
    events = fixtures.table(spark, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    gaps = events.withColumn("gap", F.col("us") - F.lag("us").over(Window.partitionBy("user_id").orderBy("us"))).where("gap is not null")
    return gaps.groupBy("user_id").agg(F.expr("sum(gap) div count(*)").alias("mean_us"), F.count(F.lit(1)).alias("n"))


@query("SELECT date_trunc('day', ts) AS start, event_type AS c, count(*) AS n, min(value) AS least, max(value) AS most FROM events GROUP BY ALL")
def events_time_axis(spark, d):
    from ..streaming.bins import time_bins

    return time_bins(fixtures.table(spark, d, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


# -- upsampling -----------------------------------------------------------------------------


def lin(n: int, m: int) -> str:
    s = f"least(greatest((k + 0.5::DOUBLE) * {n} / {m} - 0.5::DOUBLE, 0), {n - 1})"
    return f"(SELECT k, CAST(floor(s) AS BIGINT) AS i, 1 - (s - floor(s)) AS w FROM (SELECT k, {s} AS s FROM range({m}) t(k)) UNION ALL SELECT k, least(CAST(floor(s) AS BIGINT) + 1, {n - 1}), s - floor(s) FROM (SELECT k, {s} AS s FROM range({m}) t(k)) WHERE s > floor(s))"


@query(f"SELECT y, k AS x, v FROM {img('labels')} JOIN (SELECT k, CAST(floor(least(greatest((k + 0.5::DOUBLE) * 20 / 45 - 0.5::DOUBLE, 0), 19) + 0.5::DOUBLE) AS BIGINT) AS i FROM range(45) t(k)) ON i = x")
def upsample_nearest(spark, d):
    return resample.upsample(fixtures.labels(spark, d), {"x": (20, 45)}, "nearest").select("y", "x", "v")


@query(f"SELECT y, k AS x, CAST(sign(round(sum(v * w), 6)) * floor(abs(round(sum(v * w), 6)) + 0.5::DOUBLE) AS INTEGER) AS v FROM {img()} JOIN {lin(64, 142)} l ON l.i = x GROUP BY 1, 2")
def upsample_linear(spark, d):
    return resample.upsample(fixtures.image(spark, d), {"x": (64, 142)})


LIN_HEIGHT = "WITH h AS (SELECT max(vec_id) + 1 AS n FROM embeddings), p AS (SELECT n, unnest(range(n * 8 // 5)) AS k FROM h), q AS (SELECT n, k, least(greatest((k + 0.5::DOUBLE) * n / (n * 8 // 5) - 0.5::DOUBLE, 0), n - 1) AS s FROM p) SELECT k, CAST(floor(s) AS BIGINT) AS i, 1 - (s - floor(s)) AS w FROM q UNION ALL SELECT k, least(CAST(floor(s) AS BIGINT) + 1, n - 1), s - floor(s) FROM q WHERE s > floor(s)"


@query(f"SELECT a.k AS y, b.k AS x, CAST(sign(round(sum(v * a.w * b.w), 6)) * floor(abs(round(sum(v * a.w * b.w), 6)) + 0.5::DOUBLE) AS INTEGER) AS v FROM {img()} JOIN ({LIN_HEIGHT}) a ON a.i = y JOIN {lin(64, 100)} b ON b.i = x GROUP BY 1, 2")
def upsample_linear_2d_whole(spark, d):
    """The whole image, however high."""
    n = _height(spark, d)
    return resample.upsample(fixtures.image(spark, d), {"y": (n, n * 8 // 5), "x": (64, 100)})


# -- axes, units, types, colours ------------------------------------------------------------

@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber >= 4)")
def skip_existing(spark, d):
    done = fixtures.table(spark, d, "lineitem").where("l_linenumber >= 4").select(F.col("l_orderkey").alias("o_orderkey"))
    return fixtures.table(spark, d, "orders").select("o_orderkey").join(done, "o_orderkey", "left_anti")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Crop, rebase, and two chained mean levels."""
    base = domain.rebase(domain.crop(fixtures.image(spark, d), y=(100, 200), x=(8, 32)), y=100, x=8)
    return pyramid.chained(base, [{"y": 2, "x": 2}] * 2)[-1]

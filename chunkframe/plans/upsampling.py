"""Resampling and reduction in chunk form, with the SQL that checks them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import blocks, resample
from ..sources import convert, elements, fixtures, multiscale, zarr
from .catalog import LIN_HEIGHT, _height, img, lin, query

CHUNK = {"y": 100, "x": 32}


def _chunks(spark, d, dtype: str = "int32"):
    n = _height(spark, d)
    return n, blocks.to_chunks(fixtures.image(spark, d), {"y": n, "x": 64}, CHUNK, dtype=dtype)


def _upsampled(spark, d, method: str, dtype: str = "int32"):
    n, chunks = _chunks(spark, d, dtype)
    return blocks.from_chunks(resample.upsample_chunks(chunks, {"y": (n, n * 8 // 5), "x": (64, 100)}, CHUNK, method), ["y", "x"], dtype)


@query(f"SELECT a.k AS y, b.k AS x, CAST(sign(round(sum(v * a.w * b.w), 6)) * floor(abs(round(sum(v * a.w * b.w), 6)) + 0.5::DOUBLE) AS INTEGER) AS v FROM {img()} JOIN ({LIN_HEIGHT}) a ON a.i = y JOIN {lin(64, 100)} b ON b.i = x GROUP BY 1, 2")
def upsample_linear_chunks(spark, d):
    """Both axes of the whole image, chunk by chunk with a halo."""
    return _upsampled(spark, d, "trilinear")


def _near(n: str, m: str) -> str:
    return f"CAST(floor(least(greatest((k + 0.5::DOUBLE) * {n} / {m} - 0.5::DOUBLE, 0), {n} - 1) + 0.5::DOUBLE) AS BIGINT)"


HEIGHT = "(SELECT n, unnest(range(n * 8 // 5)) AS k FROM (SELECT max(vec_id) + 1 AS n FROM embeddings))"


@query(f"SELECT a.k AS y, b.k AS x, v FROM {img()} JOIN (SELECT k, {_near('n', '(n * 8 // 5)')} AS i FROM {HEIGHT}) a ON a.i = y JOIN (SELECT k, {_near('64', '100')} AS i FROM range(100) t(k)) b ON b.i = x")
def upsample_nearest_chunks(spark, d):
    """G4, G7."""
    return _upsampled(spark, d, "nearest")


def cubic_sql(places: str) -> str:
    """(k, i, w) of a cubic spline through the values, which go on beyond the ends as they end; ``places`` has n, m and k."""
    basis = "CASE o WHEN -1 THEN pow(1 - t, 3) WHEN 0 THEN 3 * t * t * t - 6 * t * t + 4 WHEN 1 THEN -3 * t * t * t + 3 * t * t + 3 * t + 1 ELSE t * t * t END / 6"
    at = f"SELECT n, k, CAST(floor(s) AS BIGINT) AS f, s - floor(s) AS t FROM (SELECT n, k, (k + 0.5::DOUBLE) * n / m - 0.5::DOUBLE AS s FROM {places})"
    return f"(SELECT k, least(greatest(f + o + j, 0), n - 1) AS i, sum({basis} * sqrt(3::DOUBLE) * pow(sqrt(3::DOUBLE) - 2, abs(j))) AS w FROM ({at}), range(-1, 3) a(o), range(-24, 25) b(j) GROUP BY 1, 2)"


@query(f"SELECT b.k AS y, x, CAST(sign(round(sum(v * w), 6)) * floor(abs(round(sum(v * w), 6)) + 0.5::DOUBLE) AS INTEGER) AS v FROM (SELECT y, a.k AS x, sum(v * w) AS v FROM {img()} JOIN {cubic_sql('(SELECT 64 AS n, 100 AS m, k FROM range(100) t(k))')} a ON a.i = x GROUP BY 1, 2) s JOIN {cubic_sql('(SELECT n, n * 8 // 5 AS m, k FROM ' + HEIGHT + ')')} b ON b.i = y GROUP BY 1, 2")
def upsample_cubic_chunks(spark, d):
    """G6, G7."""
    return _upsampled(spark, d, "cubic")


_LEVELS = "SELECT CAST(max(z) + 1 AS BIGINT) AS n, max(y) + 1 AS ny, max(x) + 1 AS nx FROM s"


_ISOTROPIC = f"WITH s AS (SELECT * FROM {img('volume')}), e AS ({_LEVELS}), g AS (SELECT n, unnest(range(2 * n)) AS k FROM e), p AS (SELECT n, k, least(greatest((k + 0.5::DOUBLE) / 2 - 0.5::DOUBLE, 0), n - 1) AS u FROM g), w AS (SELECT k, CAST(floor(u) AS BIGINT) AS i, 1 - (u - floor(u)) AS w FROM p UNION ALL SELECT k, CAST(floor(u) AS BIGINT) + 1, u - floor(u) FROM p WHERE u > floor(u)), o AS (SELECT k, unnest(range(ny)) AS y FROM g, e), a AS (SELECT k, y, unnest(range(nx)) AS x FROM o, e), t AS (SELECT k, y, x, sum(v * w) AS v FROM s JOIN w ON i = z GROUP BY ALL) SELECT k AS z, y, x, CAST(sign(round(coalesce(t.v, 0), 6)) * floor(abs(round(coalesce(t.v, 0), 6)) + 0.5::DOUBLE) AS BIGINT) AS v FROM a LEFT JOIN t USING (k, y, x)"


@query(_ISOTROPIC)
def isotropic_volume(spark, d):
    """A volume of 20 by 10 by 10 nm to 10 nm; what was never stored is 0."""
    src = fixtures.volume(spark, d)
    top = src.agg(*[(F.max(a) + 1).alias(a) for a in "zyx"]).first()
    shape = {a: top[a] for a in "zyx"}
    chunks = blocks.to_chunks(src, shape, {"z": 16, "y": 64, "x": 64})  # bounded along every axis, however many suppliers there are
    return blocks.from_chunks(resample.upsample_to_isotropic(chunks, shape, {"z": 20.0, "y": 10.0, "x": 10.0}, {"z": 16, "y": 64, "x": 64})[0], ["z", "y", "x"])


@query(_ISOTROPIC)
def isotropic_container(spark, d):
    """The same from a stored container to a stored container, whose metadata tell the new sizes."""
    src = fixtures.volume(spark, d)
    top = src.agg(*[(F.max(a) + 1).alias(a) for a in "zyx"]).first()
    shape, chunk = {a: top[a] for a in "zyx"}, {"z": 16, "y": 64, "x": 4}
    root = f"{zarr.shared_folder(spark)}/array-{uuid.uuid4().hex}"
    zarr.write_chunks(blocks.to_chunks(src, shape, chunk), f"{root}/in/s0", list(shape.values()), list(chunk.values()), "int64", codec="zstd", names=list("zyx"))
    axes = [{"name": a, "type": "space", "unit": "nanometer"} for a in "zyx"]
    multiscale.write_group(f"{root}/in", {"attributes": {"ome": {"version": "0.5", "multiscales": [{"axes": axes, "datasets": [{"path": "s0", "coordinateTransformations": [{"type": "scale", "scale": [20.0, 10.0, 10.0]}]}]}]}}}, "zarr3")
    done = convert.upsample(spark, f"{root}/in", f"{root}/out.zarr", options=convert.Options(kind="image", chunk=32))
    elements.register(spark)
    return spark.read.format(elements.ChunkedArray.name()).load(done["array"])


@query(f"SELECT y, x, v FROM (SELECT y // 4 AS y, x // 2 AS x, v, row_number() OVER (PARTITION BY y // 4, x // 2 ORDER BY count(*) DESC, v) AS place FROM {img()} GROUP BY 1, 2, 3) WHERE place = 1")
def chunk_downsample_mode(spark, d):
    """F2 without an exchange by element."""
    return blocks.from_chunks(blocks.reduce_chunks(_chunks(spark, d)[1], [4, 2], "mode"), ["y", "x"], "int32")


@query(f"SELECT y // 4 AS y, x // 2 AS x, CAST(quantile_disc(v, 0.5) AS INTEGER) AS v FROM {img()} GROUP BY 1, 2")
def chunk_downsample_median(spark, d):
    """F3 without an exchange by element."""
    return blocks.from_chunks(blocks.reduce_chunks(_chunks(spark, d)[1], [4, 2], "median"), ["y", "x"], "int32")

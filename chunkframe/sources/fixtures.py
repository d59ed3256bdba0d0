"""Volumes made of the driver's tables: one row per element, integer index columns, integer values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(y, x, v): embeddings as a dense two-dimensional image."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("y"), F.posexplode("embedding").alias("x", "e"))
    return rows.select("y", F.col("x").cast("long").alias("x"), F.floor((F.col("e").cast("double") + 1) * 32).cast("int").alias("v"))


def volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(z, y, x, v): all line items by month (from the first there is), supplier and line number, a sparse volume whose fill is 0."""
    month = F.year("l_shipdate") * 12 + F.month("l_shipdate")
    rows = table(spark, sf_dir, "lineitem")
    first = rows.agg(F.min(month).alias("first")).first()["first"] or 0
    return rows.groupBy((month - first).cast("long").alias("z"), F.col("l_suppkey").alias("y"), (F.col("l_linenumber") - 1).cast("long").alias("x")).agg(F.sum(F.col("l_quantity").cast("long")).alias("v"))


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, c, x, v): events by day, type and hour."""
    kinds = F.create_map(*[F.lit(x) for i, k in enumerate(("click", "error", "purchase", "signup", "view")) for x in (k, i)])
    return table(spark, sf_dir, "events").groupBy(F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long").alias("t"), kinds[F.col("event_type")].cast("long").alias("c"), F.hour("ts").cast("long").alias("x")).agg(F.count(F.lit(1)).alias("v"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(y, x, v): a label image, twenty columns wide."""
    return table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 20").alias("y"), F.expr("vec_id % 20").alias("x"), F.col("label").cast("int").alias("v"))


#: The same volumes for DuckDB.
SQL = {
    "image": "SELECT vec_id AS y, CAST(i - 1 AS BIGINT) AS x, CAST(floor((CAST(embedding[i] AS DOUBLE) + 1) * 32) AS INTEGER) AS v FROM embeddings, unnest(range(1, len(embedding) + 1)) AS u(i)",
    "volume": "SELECT CAST(year(l_shipdate) * 12 + month(l_shipdate) - (SELECT min(year(l_shipdate) * 12 + month(l_shipdate)) FROM lineitem) AS BIGINT) AS z, l_suppkey AS y, CAST(l_linenumber - 1 AS BIGINT) AS x, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS v FROM lineitem GROUP BY ALL",
    "channels": "SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS t, CAST(list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 AS BIGINT) AS c, CAST(hour(ts) AS BIGINT) AS x, count(*) AS v FROM events GROUP BY ALL",
    "labels": "SELECT vec_id // 20 AS y, vec_id % 20 AS x, CAST(label AS INTEGER) AS v FROM embeddings",
}


#: Words and element types that volumes take in turn.
WORDS = ("raw", "em_image", "cell_labels", "seg_v2", "nuclei_mask", "Roi_3", "binary_map", "instance", "annotation", "data")
TYPES = ("uint8", "uint16", "uint32", "uint64", "int8", "int16", "int32", "int64", "float32", "float64")
ENCODINGS = (None, "raw", "jpeg", "compressed_segmentation", "png")


def volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One made-up volume for each order: k, r, shape, voxel, axes, dtype, word, encoding; ranks 3 to 6."""
    k = F.col("o_orderkey")
    turn = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (F.pmod(i, F.lit(len(values))) + 1).cast("int"))
    cut = lambda *values: F.slice(F.array(*values), 7 - F.col("r"), F.col("r"))
    rows = table(spark, sf_dir, "orders").select(k.alias("k"), (3 + F.pmod(k, F.lit(4))).cast("int").alias("r"))
    k = F.col("k")
    shape = cut(F.lit(2).cast("long"), 1 + k * 3 % 15, 1 + k % 12, 11 + k % 700, 20 + k * 7 % 3000, 20 + k * 13 % 3000)
    sizes = [turn(v, i) for v, i in (((8.0, 16.0, 40.0, 100.0, 8.0), k), ((8.0, 8.0, 4.0, 100.0), k * 3), ((8.0, 4.0, 4.0, 100.0, 8.0, 12.0), k * 5))]
    return rows.select("k", "r", shape.alias("shape"), cut(F.lit(1.0), F.lit(1.0), F.lit(1.0), *sizes).alias("voxel"), cut(*map(F.lit, "vtczyx")).alias("axes"), turn(TYPES, k).alias("dtype"), turn(WORDS, k * 7).alias("word"), turn(ENCODINGS, k).cast("string").alias("encoding"))


def _list(values, kind: str = "") -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}{kind}" for v in values) + "]"


#: The same for DuckDB.
SQL["volumes"] = f"""SELECT k, r, list_slice([2::BIGINT, 1 + k * 3 % 15, 1 + k % 12, 11 + k % 700, 20 + k * 7 % 3000, 20 + k * 13 % 3000], 7 - r, 6) AS shape,
list_slice([1.0::DOUBLE, 1.0, 1.0, [8.0::DOUBLE, 16, 40, 100, 8][k % 5 + 1], [8.0::DOUBLE, 8, 4, 100][k * 3 % 4 + 1], [8.0::DOUBLE, 4, 4, 100, 8, 12][k * 5 % 6 + 1]], 7 - r, 6) AS voxel,
list_slice({_list('vtczyx')}, 7 - r, 6) AS axes, {_list(TYPES)}[k % 10 + 1] AS dtype, {_list(WORDS)}[k * 7 % 10 + 1] AS word, {_list(ENCODINGS)}[k % 5 + 1] AS encoding FROM (SELECT o_orderkey AS k, CAST(3 + o_orderkey % 4 AS INTEGER) AS r FROM orders)"""

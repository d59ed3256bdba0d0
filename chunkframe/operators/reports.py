"""What became of batches: counts by status, whether a batch is complete, its first failures; and the index of a batch's files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def batch_report(jobs: DataFrame, batch: str, status: str, key: str, done: str = "done", failed: str = "failed", skipped: str = "skipped", first: int = 10) -> DataFrame:
    """(batch, total, done, failed, skipped, complete, failures): a row for each batch; ``failures`` are the least ``first`` keys that failed.

    Failures are kept few while they are aggregated, so a batch with very many is one small row.
    """
    of = lambda *s: F.count_if(F.col(status).isin(*s))
    total = F.count(F.lit(1))
    counts = jobs.groupBy(batch).agg(total.alias("total"), of(done).alias("done"), of(failed).alias("failed"), of(skipped).alias("skipped"), (of(done, skipped) == total).alias("complete"))
    part = F.pmod(F.xxhash64(key), F.lit(64))
    few = lambda df, *by: df.groupBy(*by).agg(F.slice(F.array_sort(F.flatten(F.collect_list("keys"))), 1, first).alias("keys"))
    lost = jobs.where(F.col(status) == failed).groupBy(batch, part.alias("part"), F.pmod(F.xxhash64(key, F.lit(1)), F.lit(64)).alias("piece")).agg(F.array_sort(F.collect_set(key)).alias("keys"))
    lost = few(few(lost.withColumn("keys", F.slice("keys", 1, first)), batch, "part"), batch)
    empty = F.array().cast(dict(lost.dtypes)["keys"])
    return counts.join(lost, batch, "left").select(*counts.columns, F.coalesce("keys", empty).alias("failures"))


def write_index(files: DataFrame, path: str) -> None:
    """Lines of job, row, source and target, with tabs between; ``files``: job, row, source, target. Tabs in names are an error."""
    bad = F.col("source").contains("\t") | F.col("target").contains("\t")
    line = F.concat_ws("\t", F.col("job").cast("string"), F.col("row").cast("string"), "source", "target")
    files.select(F.when(bad, F.raise_error(F.lit("a name with a tab"))).otherwise(line).alias("value")).write.mode("overwrite").text(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(job, row, source, target) of an index that was written."""
    part = lambda i: F.get(F.split("value", "\t"), F.lit(i))
    return spark.read.text(path).select(part(0).cast("long").alias("job"), part(1).cast("long").alias("row"), part(2).alias("source"), part(3).alias("target"))

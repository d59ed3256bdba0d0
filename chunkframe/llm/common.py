"""Helpers shared by the text operators: shared storage, Arrow mapping, components."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch; texts can be long, so batches stay small.
BATCH_ROWS = 200

#: Bytes of the batches that are read together where a larger one has more words in common.
TOGETHER = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a new one under the warehouse only where none is set."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return found.rstrip("/")


_scratch: list[list[tuple[str, str]]] = []


@contextmanager
def scratch(spark: SparkSession, keep: tuple[str, ...]):
    """Deletes the tables ``written`` within, but for those named in ``keep``, which the result still reads."""
    _scratch.append([])
    try:
        yield
    finally:
        done = _scratch.pop()
        if _scratch:
            _scratch[-1] += [(name, path) for name, path in done if name in keep]
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for name, path in done:
            if name not in keep:
                place = hadoop(path)
                place.getFileSystem(conf).delete(place, True)


def discard(spark: SparkSession, *names: str, keep: int = 0) -> None:
    """Deletes the tables of these names ``written`` in the innermost ``scratch``, but for the last ``keep`` of each; for those that nothing reads again."""
    if not _scratch:
        return
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    for name in names:
        mine = [t for t in _scratch[-1] if t[0] == name]
        for table in mine[: len(mine) - keep]:
            place = hadoop(table[1])
            place.getFileSystem(conf).delete(place, True)
            _scratch[-1].remove(table)


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _scratch:
        _scratch[-1].append((name, path))
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def prepare(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for very long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


@contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """Other Arrow batches for what is run within."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def give_back() -> None:
    """Return what a worker has freed to the system; idle workers stay for later tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold ``size`` bytes."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.nbytes
        if n >= size:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def arrow_map(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str, size: int = 0) -> DataFrame:
    """mapInArrow with columns as lists: ``fn`` gets and returns a dict of lists per batch, or for batches of ``size`` bytes together."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    prepare(df.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(schema) if hasattr(StructType, "fromDDL") else _parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, size):
            if batch.num_rows:
                out = fn({n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
        give_back()

    return df.mapInArrow(run, schema)


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(remainder: int) -> "F.Column":
    """Whether crc32 of the decimal doc_id leaves ``remainder`` modulo 5 (null ids: false)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == remainder, F.lit(False))


def count_bin(c: "F.Column") -> "F.Column":
    """Counts within a 32nd of a doubling; those up to 45 are apart."""
    return F.floor(F.log2(c.cast("double")) * 32 + 1e-9).cast("int")


def most_frequent(counts: DataFrame, most: int) -> list[tuple]:
    """(word, n) of the words in the highest bins of counts that hold at most ``most`` words together, most frequent first.

    ``counts``: a stored table (word, n). The driver gets a number for each bin and at most ``most`` words.
    """
    least, total = None, 0
    bins = counts.groupBy(count_bin(F.col("n")).alias("bin")).agg(F.count(F.lit(1)).alias("words")).collect()
    for r in sorted(bins, key=lambda r: -r["bin"]):
        total += r["words"]
        if total > most:
            break
        least = r["bin"]
    if least is None:
        return []
    rows = counts.where(count_bin(F.col("n")) >= least).select("word", "n").collect()  # at most ``most`` words
    return sorted(((r["word"], r["n"]) for r in rows), key=lambda r: (-r[1], r[0]))


def components(links: DataFrame, rounds: int = 200) -> DataFrame:
    """Connected components of ``links(a, b)``: rows (node, component), smallest node first.

    Each round points every node at the first of its neighbours by a hash order, renames the links and drops
    those that became loops. The order is random for chains of any kind, so that a share of the nodes goes
    each round; what is left lives in the shared folder. At the end a component takes the name of its smallest node.
    """
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    rank = lambda c: F.struct(F.xxhash64(c, F.lit("order")).alias("h"), F.col(c).alias("x"))
    edges = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links")
    label = None
    for _ in range(rounds):
        if edges.isEmpty():
            break
        parent = written(both(edges).groupBy("u").agg(F.min(rank("v")).alias("p")).select("u", F.least("p", rank("u"))["x"].alias("p")), "parent")
        at = lambda c, to: parent.select(F.col("u").alias(c), F.col("p").alias(to))
        moved = edges.join(at("a", "pa"), "a").join(at("b", "pb"), "b")
        edges = written(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).where("a <> b").distinct(), "links")
        if label is None:
            label = parent.select(F.col("u").alias("node"), F.col("p").alias("component"))
        else:
            label = written(label.join(at("component", "p"), "component", "left").select("node", F.coalesce("p", "component").alias("component")), "label")
    else:
        raise RuntimeError("components did not converge")
    if label is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    least = label.groupBy("component").agg(F.min("node").alias("least"))
    return written(label.join(least, "component").select("node", F.col("least").alias("component")), "label")

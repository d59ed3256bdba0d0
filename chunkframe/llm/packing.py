"""Best-fit packing of token sequences by pattern packing.

The lengths of all pieces make a histogram of at most ``size`` numbers. Patterns of one to
three lengths that fill a sequence exactly are enumerated, their repeat counts are fitted to
the histogram by non-negative least squares and rounded, and what is left is packed best-fit
decreasing, all on counts. The plan has a bounded number of rows: each gives the pieces of one
length with ranks in an interval a place. Ranks are made by Spark in (length, bucket) groups, so
no length, however common, meets in one task.

Defined cases: null and empty texts are the end id alone (one piece of length 1); very long texts are cut
into pieces; repeated rows are packed as often as they occur; pieces of one length are ranked by their place in the
stored table, which settles ties; null ids are kept; other columns, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import by_library
from .common import TOGETHER, arrow_map, written

SIZE, BEST = 2048, 4


def pieces(docs: DataFrame, path: str, size: int = SIZE, end: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): texts over ``size`` ids are cut, the first piece may be shorter."""

    def run(x):
        out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
        tail = np.array([end], "<u4").tobytes()
        for doc_id, packed in zip(x["doc_id"], by_library(path).packed([t or "" for t in x["text"]]), strict=True):
            data = packed + tail
            n = len(data) // 4
            first = (n - 1) % size + 1
            bounds = [0, *range(first, n + 1, size)]
            for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                for name, v in zip(out, (doc_id, k, a, b - a, zlib.crc32(data[4 * a : 4 * b])), strict=True):
                    out[name].append(v)
        return out

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, piece int, start long, length long, ids_crc32 long", TOGETHER)


def patterns(count: np.ndarray, best: int = BEST) -> list[tuple[int, ...]]:
    """Multisets of one to three lengths that fill a sequence; for each longest length the ``best`` the histogram offers."""
    size, found = len(count) - 1, []
    if count[size]:
        found.append((size,))
    for a in np.nonzero(count[:size])[0][::-1].tolist():
        rest = size - a
        if rest <= a and count[rest]:
            found.append((a, rest))
        b = np.arange((rest + 1) // 2, min(a, rest - 1) + 1)
        if len(b):
            score = np.minimum(count[b], count[rest - b])
            for i in np.argsort(-score, kind="stable")[:best]:
                if score[i] > 0:
                    found.append((a, int(b[i]), rest - int(b[i])))
    return found


def fit(count: np.ndarray, found: list[tuple[int, ...]], sweeps: int = 25) -> list[float]:
    """Repeat counts x >= 0 with least ||A x - count||, one coordinate after the other."""
    left, x = count.astype(float).tolist(), [0.0] * len(found)
    parts = [[(n, p.count(n)) for n in dict.fromkeys(p)] for p in found]
    norm = [sum(m * m for _, m in q) for q in parts]
    for _ in range(sweeps):
        for k, q in enumerate(parts):
            new = max(0.0, x[k] + sum(m * left[n] for n, m in q) / norm[k])
            if step := new - x[k]:
                x[k] = new
                for n, m in q:
                    left[n] -= m * step
    return x


def plan(count: np.ndarray, roundings: tuple[float, ...] = (0.5, 0.0, -1.0, -3.0)) -> dict[str, np.ndarray]:
    """Columns length, lo, n, copies, sequence, offset: rank r in [lo, lo + n) goes to sequence + (r - lo) // copies, at offset + (r - lo) % copies * length.

    Repeat counts are rounded to the nearest number, down, and down after one or three are left to the residual; the fewest sequences win.
    """
    found = patterns(count)
    x = fit(count, found)
    return min((_rounded(count, found, x, r) for r in roundings), key=lambda t: t[0])[1]


def _rounded(count: np.ndarray, found: list[tuple[int, ...]], fitted: list[float], rounding: float) -> tuple[int, dict[str, np.ndarray]]:
    size, left, given = len(count) - 1, count.astype(int).tolist(), [0] * len(count)
    rows, sequences = [], 0

    def place(length: int, n: int, copies: int, sequence: int, offset: int) -> None:
        rows.append((length, given[length], n, copies, sequence, offset))
        given[length] += n
        left[length] -= n

    for x, p in sorted(zip(fitted, found, strict=True), key=lambda t: (-t[0], t[1])):
        if n := min(int(max(0.0, x + rounding)), *(left[length] // p.count(length) for length in p)):
            offset = 0
            for length in p:
                place(length, n, 1, sequences, offset)
                offset += length
            sequences += n
    room: dict[int, list[tuple[int, int]]] = {}  # free ids: runs of sequences
    free = np.zeros(size + 1, bool)
    for length in range(size, 0, -1):
        while left[length]:
            fits = np.nonzero(free[length:])[0]
            if len(fits):
                space = length + int(fits[0])
                first, n = room[space].pop()
                free[space] = bool(room[space])
            else:
                space, first, n = size, sequences, -(-left[length] // (size // length))
                sequences += n
            copies = space // length
            bins = min(n, left[length] // copies)
            if not bins:
                bins, copies = 1, left[length]
            place(length, bins * copies, copies, first, size - space)
            for to, at, m in ((space - copies * length, first, bins), (space, first + bins, n - bins)):
                if to and m:
                    room.setdefault(to, []).append((at, m))
                    free[to] = True
    columns = np.array(sorted(rows), np.int64).reshape(-1, 6).T
    return sequences, dict(zip(("length", "lo", "n", "copies", "sequence", "offset"), columns, strict=True))


def pack(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """``cut`` with sequence_id and offset; ``cut`` is a stored table with doc_id, piece, length and a number ``row``."""
    spark = cut.sparkSession
    buckets = max(2048, 16 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    counts = cut.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts, "lengths")
    histogram = np.zeros(size + 1, int)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``size`` rows
        histogram[r["length"]] = r["n"]
    steps = plan(histogram)
    key = (steps["length"] << 42) + steps["lo"]
    lo, copies, sequence, offset = (steps[c] for c in ("lo", "copies", "sequence", "offset"))

    @F.arrow_udf("sequence_id long, offset long")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        size_, rank_ = (np.asarray(x.to_numpy(zero_copy_only=False), np.int64) for x in (length, rank))
        at = np.searchsorted(key, (size_ << 42) + rank_, side="right") - 1
        nth = rank_ - lo[at]
        return pa.StructArray.from_arrays([pa.array(sequence[at] + nth // copies[at]), pa.array(offset[at] + nth % copies[at] * size_)], names=["sequence_id", "offset"])

    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "bucket").orderBy("row")
    ranked = cut.withColumn("nth", F.row_number().over(within)).join(base, ["length", "bucket"])
    placed = ranked.withColumn("at", place("length", F.col("base") + F.col("nth") - 1))
    return placed.select(*[c for c in cut.columns if c != "bucket"], "at.sequence_id", "at.offset")


def pack_documents(docs: DataFrame, path: str, size: int = SIZE, end: int = 0) -> DataFrame:
    cut = pieces(docs, path, size, end).withColumn("row", F.monotonically_increasing_id())  # a stored number: no id, null or repeated, fills a bucket
    return pack(written(cut, "pieces"), size).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")

"""Array-valued columns about a volume's axes: names, order, chunks, shards, factors, scales."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .metadata import once

SPACE = ("z", "y", "x")


def places(a: Column) -> Column:
    """0 to n - 1 of an array."""
    return F.sequence(F.lit(0), F.size(a) - 1)


def spatial(axis: Column) -> Column:
    return F.lower(axis).isin(*SPACE)


def infer_names(shape: Column, voxel: Column | None = None, few: int = 10) -> Column:
    """Axis names by extent: up to ``few`` is a channel or time, longer ones are z, y, x from the right.

    Of three long axes with different voxel sizes, the one with the largest (the first of equals) is z.
    """
    long, short = (F.filter(places(shape), keep) for keep in (lambda i: F.get(shape, i) > few, lambda i: F.get(shape, i) <= few))
    z = F.get(long, F.lit(0))
    if voxel is not None:
        sizes = F.transform(long, lambda i: F.get(voxel, i))
        hint = F.get(long, F.array_position(sizes, F.array_max(sizes)).cast("int") - 1)
        z = F.when(F.size(F.array_distinct(sizes)) > 1, hint).otherwise(z)
    flat = F.when(F.size(long) == 3, F.filter(long, lambda i: i != z)).otherwise(long)
    name = lambda i: (
        F.when((F.size(long) == 3) & (i == z), "z").when(i == F.get(flat, F.lit(0)), "y").when(i == F.get(flat, F.lit(1)), "x")
        .when((F.size(short) == 2) & (i == F.get(short, F.lit(0))), "t").otherwise("c")
    )
    usual = [F.array(*map(F.lit, "tczyx"[5 - r :])) for r in range(1, 6)]
    by_rank = F.transform(places(shape), lambda i: F.concat(F.lit("dim_"), i.cast("string")))
    for r, names in enumerate(usual, 1):
        by_rank = F.when(F.size(shape) == r, names).otherwise(by_rank)
    clear = (F.size(shape) > 2) & F.size(long).between(2, 3) & (F.size(short) <= 2)
    return F.when(F.size(shape) == 0, F.array().cast("array<string>")).when(clear, F.transform(places(shape), name)).otherwise(by_rank)


def shape_by_axis(axes: Column, k: int) -> Column:
    """``k`` along spatial axes, 1 along others."""
    return F.transform(axes, lambda a: F.when(spatial(a), k).otherwise(1).cast("long"))


def padded_left(shape: Column, rank: Column) -> Column:
    """``shape`` with ones in front, up to ``rank``."""
    return F.concat(F.array_repeat(F.lit(1).cast("long"), F.greatest(rank - F.size(shape), F.lit(0))), shape)


def product(a: Column) -> Column:
    return F.aggregate(a, F.lit(1).cast("long"), lambda p, x: p * x)


def default_chunk(shape: Column, item_bytes: Column, budget: int = 32 << 20) -> Column:
    """Whole planes and as many z as a budget of bytes holds; for ranks other than 3 the same root of the budget along each axis, cut to an integer as floats give it."""
    items = F.floor(F.lit(budget) / item_bytes)
    plane = F.get(shape, F.lit(1)) * F.get(shape, F.lit(2))
    deep = F.greatest(F.lit(1).cast("long"), F.least(F.get(shape, F.lit(0)), F.floor(items / plane)))
    side = F.floor(F.pow(items.cast("double"), 1.0 / F.size(shape)))
    return F.when(F.size(shape) == 3, F.array(deep, F.get(shape, F.lit(1)), F.get(shape, F.lit(2)))).otherwise(F.transform(shape, lambda n: F.least(n, side)))


def default_shard(chunk: Column, shape: Column, chunks: int = 512) -> Column:
    """About ``chunks`` chunks, the same number along each axis (a root of floats, cut: 7 for 512 along three), no longer than the volume."""
    along = F.floor(F.pow(F.lit(float(chunks)), 1.0 / F.size(chunk)))
    return F.zip_with(chunk, shape, lambda c, n: F.least(c * along, n))


def clamped(shape: Column, chunk: Column, shard: Column) -> Column:
    """Shards no longer than the chunks that cover an axis."""
    covered = F.zip_with(shape, chunk, lambda n, c: F.ceil(n / c) * c)
    least = F.zip_with(covered, shard, lambda a, s: F.least(a, s))
    return F.transform(F.arrays_zip(shape.alias("n"), shard.alias("s"), least.alias("l")), lambda x: F.when(x["n"] < x["s"], x["l"]).otherwise(x["s"]))


def ome_order(axes: Column) -> Column:
    """Places of the axes in the order non-spatial first, both groups in their own order."""
    at = lambda keep: F.filter(places(axes), lambda i: keep(F.get(axes, i)))
    return F.concat(at(lambda a: ~spatial(a)), at(spatial))


def inverse(order: Column) -> Column:
    return F.transform(places(order), lambda i: (F.array_position(order, i) - 1).cast("int"))


def permuted(values: Column, order: Column) -> Column:
    return F.transform(order, lambda i: F.get(values, i))


def memory_order(inner: Column) -> Column:
    """C, F (the inner order reversed) or custom."""
    up = places(inner)
    return F.when(inner == up, "C").when(inner == F.reverse(up), "F").otherwise("custom")


def anisotropic_factors(axes: Column, voxel: Column, low: float = 0.5, high: float = 2.0) -> Column:
    """2 along spatial axes; the first one that is coarse (fine) against all others is left out (taken alone)."""
    at = F.filter(places(axes), lambda i: spatial(F.get(axes, i)))

    def odd_ones(v: Column) -> Column:
        """The axes that are coarse or fine against all others: place and how."""
        others = lambda i, test: F.forall(v["at"], lambda j: (j == i) | test(F.get(v["voxel"], i) / F.get(v["voxel"], j)))
        kind = F.transform(v["at"], lambda i: F.struct(i.alias("at"), F.when(others(i, lambda r: r >= high), 1).when(others(i, lambda r: r <= low), 2).otherwise(0).alias("how")))
        return F.struct(F.size(v["at"]).alias("n"), F.get(F.filter(kind, lambda x: x["how"] > 0), F.lit(0)).alias("odd"))

    def all_(v: Column) -> Column:
        odd, how = v["odd"]["at"], v["odd"]["how"]
        return F.transform(axes, lambda a, i: F.when(~spatial(a), 1).when((v["n"] == 1) | odd.isNull(), 2).when(how == 1, F.when(i == odd, 1).otherwise(2)).otherwise(F.when(i == odd, 2).otherwise(1)))

    return once(once(F.struct(at.alias("at"), voxel.alias("voxel")), odd_ones), all_)


def ambiguous_ratio(voxel: Column) -> Column:
    """Whether the largest ratio of two sizes is far from powers of 2."""
    ratio = F.array_max(voxel) / F.array_min(voxel)
    part = F.log2(ratio) - F.floor(F.log2(ratio))
    return (ratio > 1) & (part > 0.25) & (part < 0.75)


def parse_factors(text: Column) -> Column:
    """``1,2,2;1,2,2`` as an array for each level; null for anything but positive integers."""
    levels = F.transform(F.split(text, ";"), lambda x: F.transform(F.split(x, ","), lambda y: F.when(F.trim(y).rlike("^0*[1-9][0-9]*$"), F.trim(y).try_cast("int"))))
    return F.when(F.forall(levels, lambda x: F.forall(x, lambda y: y.isNotNull())), levels)


def rounded_scale(scale0: Column, shape0: Column, shape: Column) -> Column:
    """A level's scale: the first one times the rounded ratio of the shapes (ties to even)."""
    factor = F.zip_with(shape0, shape, lambda a, b: F.bround(a / b))
    return F.zip_with(scale0, factor, lambda s, f: s * f)


def translation(scale: Column, scale0: Column, method: Column) -> Column:
    """Half the difference of the scales for block methods (and none given), else 0."""
    block = method.isNull() | method.isin("mean", "mode", "median", "min", "max")
    return F.when(block, F.zip_with(scale, scale0, lambda a, b: (a - b) * 0.5)).otherwise(F.transform(scale, lambda a: F.lit(0.0)))


def chunk_counts(shape: Column, chunk: Column) -> Column:
    """How many chunks there are along each axis."""
    return F.zip_with(shape, chunk, lambda n, c: F.ceil(n / c).cast("long"))


def enumerated(shape: Column, chunk: Column) -> Column:
    """(id, start, stop) of every chunk in row-major order, cut at the edges."""
    counts = chunk_counts(shape, chunk)
    # how many chunks one step along an axis passes: the product of the counts behind it
    behind = F.transform(places(shape), lambda i: product(F.slice(counts, i + 2, F.size(counts) - i - 1)))
    axes = F.arrays_zip(shape.alias("n"), chunk.alias("c"), counts.alias("g"), behind.alias("b"))

    def one(number: Column) -> Column:
        start = F.transform(axes, lambda x: (F.floor(number / x["b"]) % x["g"]) * x["c"])
        stop = F.zip_with(axes, start, lambda x, s: F.least(s + x["c"], x["n"]))
        return F.struct(number.alias("id"), start.alias("start"), stop.alias("stop"))

    return F.transform(F.sequence(F.lit(0).cast("long"), product(counts) - 1), one)


def chunk_at(number: Column, shape: list[Column], chunk: list[Column]) -> list[tuple[Column, Column]]:
    """(start, stop) along each axis of the chunk with a row-major number, as plain columns; ``shape``, ``chunk``: a column for each axis."""
    out, left = [], number
    for n, c in zip(reversed(shape), reversed(chunk), strict=True):
        counts = F.ceil(n / c)
        start = left % counts * c
        out.append((start, F.least(start + c, n)))
        left = F.call_function("div", left, counts)
    return out[::-1]


def chunk_numbers(shape: list[Column], chunk: list[Column]) -> Column:
    """0 to the number of chunks - 1."""
    return F.sequence(F.lit(0).cast("long"), reduce(lambda a, b: a * b, (F.ceil(n / c) for n, c in zip(shape, chunk, strict=True))) - 1)


def shard_number(start: list[Column], shape: list[Column], shard: list[Column]) -> Column:
    """``shard_of`` with a column for each axis."""
    out = F.lit(0).cast("long")
    for a, n, s in zip(start, shape, shard, strict=True):
        out = out * F.ceil(n / s) + F.call_function("div", a, s)
    return out


def shard_of(start: Column, shape: Column, shard: Column) -> Column:
    """The row-major number of the shard that a chunk begins in."""
    steps = F.arrays_zip(F.zip_with(start, shard, lambda a, s: F.floor(a / s)).alias("at"), chunk_counts(shape, shard).alias("g"))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda out, x: out * x["g"] + x["at"])


def work_ranges(total: Column, jobs: Column) -> Column:
    """(job, start, stop): ranges whose sizes differ by one at most, larger ones first."""
    q, r = F.floor(total / jobs), total % jobs
    start = lambda j: j * q + F.least(j, r)
    return F.transform(F.sequence(F.lit(0).cast("long"), jobs - 1), lambda j: F.struct(j.alias("job"), start(j).alias("start"), start(j + 1).alias("stop")))


def running_products(values: Column) -> Column:
    """The product of each value and all before it."""
    return F.transform(places(values), lambda i: product(F.slice(values, 1, i + 1)))


def consecutive(numbers: Column) -> Column:
    """How many of 1, 2, 3, ... are there before the first that lacks."""
    return F.size(F.filter(F.array_distinct(numbers), lambda n: (n > 0) & F.forall(F.sequence(F.lit(1).cast("long"), F.greatest(n, F.lit(1))), lambda i: F.array_contains(numbers, i))))


def output_spec(shape: Column, axes: Column, edge: int = 64, shard: int = 1024) -> Column:
    """shard and v2_chunk of an output: shards of ``shard`` clamped to the chunks that cover an axis, v2 chunks no longer than the axis."""
    chunk = shape_by_axis(axes, edge)
    return F.struct(clamped(shape, chunk, shape_by_axis(axes, shard)).alias("shard"), F.zip_with(chunk, shape, lambda c, n: F.least(c, n)).alias("v2_chunk"))

"""Operators on the index domain: crop, rebase, reorder, squeeze, expand, cast, flip, densify."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NON_SPATIAL = ("c", "t", "v", "channel")
# The ranges of the integer element types.
RANGES = {"uint8": (0, 255), "uint16": (0, 65535), "uint32": (0, 2**32 - 1), "int8": (-128, 127), "int16": (-32768, 32767), "int32": (-(2**31), 2**31 - 1), "int64": (-(2**63), 2**63 - 1), "uint64": (0, 2**64 - 1)}
SPARK = {"uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "float32": "float", "float64": "double"}


def crop(df: DataFrame, **box: tuple[int, int]) -> DataFrame:
    """Half-open boxes ``axis=(origin, size)``; range predicates on bare columns reach the scan."""
    if any(size <= 0 for _, size in box.values()):
        raise ValueError("sizes must be positive")
    return reduce(lambda d, a: d.where((F.col(a) >= box[a][0]) & (F.col(a) < sum(box[a]))), box, df)


def rebase(df: DataFrame, **origin: int) -> DataFrame:
    return df.withColumns({a: F.col(a) - o for a, o in origin.items()})


def reorder(df: DataFrame, order: str, values: tuple[str, ...] = ("v",)) -> DataFrame:
    """Axes in the order of the letters; a permutation of those there are."""
    have = [c for c in df.columns if c not in values]
    if sorted(order) != sorted(have):
        raise ValueError(f"{order} is no permutation of {''.join(have)}")
    return df.select(*order, *values)


def ome_order(axes: list[str]) -> list[str]:
    """Non-spatial axes first, both groups in their own order."""
    return [a for a in axes if a not in "xyz"] + [a for a in axes if a in "xyz"]


def select_index(df: DataFrame, axis: str, index: int) -> DataFrame:
    """One place of an axis, which goes."""
    return df.where(F.col(axis) == index).drop(axis)


def expand(df: DataFrame, axes: str = "tczyx", values: tuple[str, ...] = ("v",)) -> DataFrame:
    """Missing axes with the one place 0."""
    return df.select(*[F.col(a) if a in df.columns else F.lit(0).cast("long").alias(a) for a in axes], *values)


def cast_value(v: Column, dtype: str, from_float: bool = False) -> Column:
    """A value clipped into ``dtype``; floats are cut towards zero. Float targets take any value."""
    if dtype in ("float32", "float64"):
        return v.cast(SPARK[dtype])
    low, high = RANGES[dtype]
    if dtype in ("uint64", "int64") and from_float:  # doubles next to these bounds aren't exact: clip as decimals
        wide = F.least(F.greatest(v, F.lit(-1e20)), F.lit(1e20)).cast("decimal(38,10)")
        whole = F.when(wide < 0, F.ceil(wide)).otherwise(F.floor(wide)).cast("decimal(38,0)")
        return F.least(F.greatest(whole, F.lit(str(low)).cast("decimal(38,0)")), F.lit(str(high)).cast("decimal(38,0)")).cast(SPARK[dtype])
    kind = "double" if from_float else "decimal(20,0)" if dtype == "uint64" else "bigint"
    bound = lambda n: F.lit(str(n)).cast(kind)
    return F.least(F.greatest(v.cast(kind), bound(low)), bound(high)).cast(SPARK[dtype])


def value_range(df: DataFrame, dtype: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Least and largest value, and whether they fit ``dtype``; over all data, not a sample."""
    low, high = RANGES[dtype]
    least, most = F.min("v"), F.max("v")
    return df.groupBy(*by).agg(least.cast("long").alias("least"), most.cast("long").alias("most"), ((least >= low) & (most <= high)).alias("fits"))


def flip(df: DataFrame, axis: str, extent: int) -> DataFrame:
    return df.withColumn(axis, F.lit(extent - 1) - F.col(axis))


def densify(df: DataFrame, fill: int = 0, **extent: int) -> DataFrame:
    """Every cell of the extents; missing ones hold ``fill``. The grid is generated, not stored."""
    total = 1
    for n in extent.values():
        total *= n
    grid, left = df.sparkSession.range(total), total
    columns = {}
    for a, n in extent.items():
        left //= n
        columns[a] = F.expr(f"(id div {left}) % {n}")
    cells = grid.select(*[c.alias(a) for a, c in columns.items()])
    return cells.join(df, list(extent), "left").withColumn("v", F.coalesce("v", F.lit(fill)))


def stack(parts: list[DataFrame], axis: str) -> DataFrame:
    """Arrays along a new axis."""
    return reduce(DataFrame.unionByName, [p.withColumn(axis, F.lit(i).cast("long")) for i, p in enumerate(parts)])

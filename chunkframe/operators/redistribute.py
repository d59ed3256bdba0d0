"""Chunks onto another grid, in one pass: cropped, axes dropped, reordered or added, cast, and cut into other chunks.

Every source chunk is cut into the pieces that target chunks get of it, and one exchange brings a target chunk's pieces
together; elements never become rows. Where the target's chunks each lie inside one source chunk there is no
exchange at all. A task holds one target chunk and the batch it reads.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "chunk_id long, origin array<long>, extent array<long>, payload binary, dtype string"
_LONGS = pa.list_(pa.int64())
_KINDS = {"chunk_id": pa.int64(), "place": _LONGS, "origin": _LONGS, "extent": _LONGS, "payload": pa.binary(), "dtype": pa.string()}
#: Bytes of rows that are passed on together.
BATCH_BYTES = 8 << 20


def cast_block(block: np.ndarray, dtype: str) -> np.ndarray:
    """Values clipped into ``dtype``; floats are cut towards zero, NaN counts as larger than any number. Float targets take any value."""
    target = np.dtype(dtype)
    if target.kind == "f" or block.dtype == target:
        return block.astype(target)
    low, high = np.iinfo(target).min, np.iinfo(target).max
    if block.dtype.kind == "f":
        wide = np.where(np.isnan(block), np.inf, block.astype(np.float64))
        inside = (wide >= float(low)) & (wide < float(high))  # the float next to a 64-bit bound is the bound itself or beyond
        return np.where(inside, np.where(inside, wide, 0).astype(target), np.where(wide < 0, target.type(low), target.type(high)))
    have = np.iinfo(block.dtype)
    return np.clip(block, max(low, have.min), min(high, have.max)).astype(target)


def _batches(rows: Iterator[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    held, size, at = [], 0, names.index("payload")

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[n]) for n, c in zip(names, zip(*held, strict=True), strict=True)], names=names)

    for row in rows:
        held.append(row)
        size += len(row[at]) + 100
        if size >= BATCH_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):  # one at a time: payloads are large
            yield tuple(c[i].as_py() for c in batch.columns)


def inside_source(order: list[int | None], start: list[int], chunk: list[int], source: list[int]) -> bool:
    """Whether every chunk of the target lies inside one chunk of the source."""
    return all(a is None or (source[a] % c == 0 and s % c == 0) for a, s, c in zip(order, start, chunk, strict=True))


def redistribute(chunks: DataFrame, shape: list[int], chunk: list[int], order: list[int | None] | None = None, start: list[int] | None = None, pick: dict[int, int] | None = None, dtype: str | None = None, fill: float = 0, source: list[int] | None = None) -> DataFrame:
    """(chunk_id, origin, extent, payload, dtype) of the target's chunks that get at least one element.

    ``chunks``: origin, extent, payload and (int64 without it) dtype, of any sizes. ``shape``, ``chunk``: the target's. ``order``: for each target axis the source axis
    it is, None for a new one of extent 1. ``start``: where the target begins on its axes. ``pick``: the place taken of each
    source axis that isn't in ``order``. ``source``: the source's chunk size, where all chunks are of one grid: it may save the exchange.
    Elements that no source chunk has are ``fill``.
    """
    n = len(shape)
    order = list(range(n)) if order is None else list(order)
    start = [0] * n if start is None else list(start)
    pick = pick or {}
    if min(shape) <= 0 or min(chunk) <= 0 or not len(order) == len(start) == len(chunk) == n:
        raise ValueError("shape, chunk, order and start need a positive number for each axis")
    kept = [a for a in order if a is not None]
    if len(set(kept)) != len(kept) or set(kept) & set(pick):
        raise ValueError(f"order {order} takes an axis twice")
    counts = [-(-s // c) for s, c in zip(shape, chunk, strict=True)]
    direct = source is not None and inside_source(order, start, chunk, source)

    def turned(origin: list[int], extent: list[int], payload: bytes, kind: str) -> tuple[list[int], np.ndarray] | None:
        """A source chunk on the target's axes; None where it has nothing of the places that are picked."""
        block = np.frombuffer(payload, kind).reshape(extent)
        gone = sorted(set(range(block.ndim)) - set(kept))
        if set(gone) != set(pick):
            raise ValueError(f"axes {gone} are in no order: pick a place of each")
        if any(not o <= pick[a] < o + extent[a] for a, o in ((a, origin[a]) for a in gone)):
            return None
        block = block[tuple(pick[a] - origin[a] if a in pick else slice(None) for a in range(block.ndim))]
        rest = [a for a in range(len(origin)) if a not in pick]
        block = block.transpose([rest.index(a) for a in kept])
        at = iter(range(block.ndim))
        block = block[tuple(np.newaxis if a is None else (next(at), slice(None))[1] for a in order)]
        if dtype:
            block = cast_block(block, dtype)
        return [(0 if a is None else origin[a]) - s for a, s in zip(order, start, strict=True)], block

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for row in _rows(batches):
            found = turned(*row)
            if found is None:
                continue
            at, block = found
            low = [max(o, 0) for o in at]
            high = [min(o + e, s) for o, e, s in zip(at, block.shape, shape, strict=True)]
            if any(lo >= hi for lo, hi in zip(low, high, strict=True)):
                continue
            for cell in product(*(range(lo // c, -(-hi // c)) for lo, hi, c in zip(low, high, chunk, strict=True))):
                first = [max(lo, i * c) for lo, i, c in zip(low, cell, chunk, strict=True)]
                stop = [min(hi, (i + 1) * c) for hi, i, c in zip(high, cell, chunk, strict=True)]
                piece = np.ascontiguousarray(block[tuple(slice(f - o, s - o) for f, s, o in zip(first, stop, at, strict=True))])
                kind = piece.dtype.newbyteorder("<").str
                yield int(np.ravel_multi_index(cell, counts)), first, list(piece.shape), piece.astype(kind).tobytes(), kind

    def size_of(number: int) -> tuple[list[int], list[int]]:
        origin = [int(i) * c for i, c in zip(np.unravel_index(number, counts), chunk, strict=True)]
        return origin, [min(c, s - o) for c, s, o in zip(chunk, shape, origin, strict=True)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(pieces(batches), ["chunk_id", "place", "extent", "payload", "dtype"])

    def cells(rows: Iterator[tuple]) -> Iterator[tuple]:
        number = whole = kind = None
        for at, place, extent, payload, piece_kind in rows:
            if at != number:
                if number is not None:
                    yield number, size_of(number)[0], list(whole.shape), whole.tobytes(), kind
                number, kind = at, piece_kind
                origin, size = size_of(number)
                whole = np.full(size, fill, kind)
            elif piece_kind != kind:
                raise ValueError(f"chunks of {kind} and {piece_kind} in one array")
            whole[tuple(slice(p - o, p - o + e) for p, o, e in zip(place, origin, extent, strict=True))] = np.frombuffer(payload, kind).reshape(extent)
        if number is not None:
            yield number, size_of(number)[0], list(whole.shape), whole.tobytes(), kind

    names = ["chunk_id", "origin", "extent", "payload", "dtype"]
    given = chunks.select("origin", "extent", "payload", F.col("dtype") if "dtype" in chunks.columns else F.lit("<i8").alias("dtype"))
    if direct:  # a piece is all that its target chunk gets, but for places that lie outside the source
        return given.mapInArrow(lambda batches: _batches(cells(pieces(batches)), names), SCHEMA)
    cut_rows = given.mapInArrow(cut, "chunk_id long, place array<long>, extent array<long>, payload binary, dtype string")
    met = cut_rows.repartition("chunk_id").sortWithinPartitions("chunk_id", "place")
    return met.mapInArrow(lambda batches: _batches(cells(_rows(batches)), names), SCHEMA)


def with_missing(chunks: DataFrame, shape: list[int], chunk: list[int], dtype: str, fill: float = 0) -> DataFrame:
    """``chunks`` of a grid, and those of it that are not there, made of ``fill``."""
    counts = [-(-s // c) for s, c in zip(shape, chunk, strict=True)]
    kind = np.dtype(dtype).newbyteorder("<").str

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (number,) in _rows(batches):
            origin = [int(i) * c for i, c in zip(np.unravel_index(number, counts), chunk, strict=True)]
            extent = [min(c, s - o) for c, s, o in zip(chunk, shape, origin, strict=True)]
            yield number, origin, extent, np.full(extent, fill, kind).tobytes(), kind

    lacking = chunks.sparkSession.range(int(np.prod(counts))).select(F.col("id").alias("chunk_id")).join(chunks.select("chunk_id"), "chunk_id", "left_anti")
    names = ["chunk_id", "origin", "extent", "payload", "dtype"]
    return chunks.select(*names).union(lacking.mapInArrow(lambda batches: _batches(made(batches), names), SCHEMA))


def downsample_chunks(chunks: DataFrame, shape: list[int], factor: list[int], chunk: list[int], method: str = "mean", source: list[int] | None = None) -> DataFrame:
    """Blocks of ``factor`` reduced, wherever the source's chunks are cut: chunks of ``chunk`` of the smaller array.

    The source is dealt to chunks of ``factor`` times the size, which blocks don't cross, and reduced there.
    """
    from .blocks import reduce_chunks

    wide = [c * f for c, f in zip(chunk, factor, strict=True)]
    if source is not None and all(s % w == 0 for s, w in zip(source, wide, strict=True)):
        return reduce_chunks(redistribute(chunks, shape, wide, source=source), factor, method)
    return reduce_chunks(redistribute(chunks, shape, wide), factor, method)

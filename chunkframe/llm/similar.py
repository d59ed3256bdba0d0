"""Exact Jaccard self-join of word-shingle sets, as connected components.

Equal sets are one class from the start. A set's prefix holds the few shingles that a similar
set must share one of; shingles are ordered by how common a count-min sketch of all sets says they
are, then by hash, so that common passages stay out of the prefixes. Prefixes make index lists.

Set relations save most of the work on a list:

* answers are derived: every set is compared with one hub that shares a list with it (the one whose
  shared shingle comes first in its prefix), and takes the hub's component when they link. Lists
  whose sets are all in one component are done, and for two sets with the same hub the two known
  distances often decide the pair: at most their sum, at least their difference, apart;
* lists are skipped in blocks: what is left of a long list is cut by set size into runs that overlap
  by the size ratio of a link, dealt into cells of two blocks, and each set skips those
  whose sizes and places of the shared shingle forbid a link. A bitmap of the parities of each set's
  hashes bounds the distance from below before texts are read.

A cell reports a forest: one candidate for any two of its trees, however many pairs could
join them, and which of its rows are open: those with a partner that may link, is not refused, and is in another component by
sure links alone. Candidates are verified on whole texts, links rename the components, refused
pairs are remembered, and the open rows of lists that are still mixed are read again, until no row is open. From turn to turn
each row tells twice as many candidates beside the forest, so the turns are few (at most as many as a cell's rows have binary digits,
and one more) and verified pairs at most about twice those that had to be. So every pair that could link is
verified, decided by those bounds, or already in one component, and components are exact. No list, however
long, meets in one task, and distances travel as pairs of numbers.

Defined cases: a null text or one without words has the empty set, links with nothing, and is its
own component; repeated rows share a component, ties included; a null id counts as larger than any other when a
component is named (null where no other is there), and its text links like any other; several texts of one id
are several rows; a very long text is one set like any other; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch_rows, components, discard, give_back, prepare, scratch, written

WIDTH, AT_LEAST = 3, 90  # words of a shingle, per cent
CELLS, CHUNKS, BLOCK, FEW, ROUNDS, TURNS, SHARED, BLOOM_BITS = 1 << 20, 64, 2048, 24, 1, 40, 64, 1 << 23
Features = Callable[[str | None], np.ndarray]
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct 64-bit shingle hashes of a text; fewer words than ``width`` are one shingle."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and ASCII white space
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    span = min(width, len(words))
    out = np.full(len(h) - span + 1, span, np.uint64)
    for i in range(span):
        out = (out ^ h[i : len(out) + i]) * _MIX[i % len(_MIX)]
        out ^= out >> np.uint64(32)
    return np.unique(out)


def name_of(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def prefix_length(n: int, at_least: int = AT_LEAST) -> int:
    return n + (-at_least * n) // 100 + 1


def parities(found: np.ndarray, at_least: int = AT_LEAST) -> bytes:
    """Whether an odd number of hashes fall on each bit of a bitmap.

    Bitmaps of two sets, the longer one folded to the length of the shorter, differ in at most as many bits as the sets in shingles.
    They have 6 to 12 bits for each shingle that two linked sets of this size may differ in.
    """
    bits = 1 << max(6, (12 * len(found) * (100 - at_least) // (100 + at_least)).bit_length())
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(bitmap: np.ndarray, words: int) -> np.ndarray:
    while len(bitmap) > words:
        bitmap = bitmap[: len(bitmap) // 2] ^ bitmap[len(bitmap) // 2 :]
    return bitmap


def bits_apart(a: bytes, b: bytes) -> int:
    one, two = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    words = min(len(one), len(two))
    return int(np.bitwise_count(folded(one, words) ^ folded(two, words)).sum())


def commonness(docs: DataFrame, features: Features = shingles) -> np.ndarray:
    """Two rows of ``CELLS`` counters over the sets of all texts, as levels from 0 (nothing special).

    Partitions send their counters in compressed chunks; the sum has a fixed size.
    """
    size = 2 * CELLS // CHUNKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(2 * CELLS, np.int64)
        for b in batches:
            sets = [features(t) for t in b.column(0).to_pylist()]
            if sets:
                h = np.concatenate(sets)
                sums[:CELLS] += np.bincount((h >> np.uint64(44)).astype(np.int64), minlength=CELLS)
                sums[CELLS:] += np.bincount((h >> np.uint64(20) & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
        if sums.any():  # chunk by chunk: the counters are the largest thing a worker holds
            data = [zlib.compress(sums[i * size : (i + 1) * size].astype("<i8").tobytes(), 1) for i in range(CHUNKS)]
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(range(CHUNKS), pa.int32()), "data": pa.array(data, pa.binary())})
        del sums
        give_back()

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(size, np.int64)
        for data in table.column("data"):
            total += np.frombuffer(zlib.decompress(data.as_py()), "<i8")
        return pa.table({"chunk": pa.array([table.column("chunk")[0].as_py()], pa.int32()), "data": pa.array([zlib.compress(total.astype("<i8").tobytes(), 1)], pa.binary())})

    prepare(docs.sparkSession)
    parts = docs.select("text").mapInArrow(count, "chunk int, data binary").groupBy("chunk").applyInArrow(add, "chunk int, data binary")
    sums = np.zeros((CHUNKS, size), np.int64)
    for r in parts.collect():  # CHUNKS rows
        sums[r["chunk"]] = np.frombuffer(zlib.decompress(r["data"]), "<i8")
    sums = sums.reshape(2, CELLS)
    mean = sums[0].mean()
    step = 8 * np.sqrt(mean) + 1
    return np.clip(np.log2(np.maximum(sums - mean, 0) / step + 0.5) + 1, 0, 30).astype(np.uint8)


def ordered(found: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """A set's shingles, rare ones first."""
    level = np.minimum(levels[0][(found >> np.uint64(44)).astype(np.int64)], levels[1][(found >> np.uint64(20) & np.uint64(CELLS - 1)).astype(np.int64)])
    return found[np.lexsort((found, level))]


def signatures(docs: DataFrame, at_least: int = AT_LEAST, features: Features = shingles) -> DataFrame:
    """(doc_id, named, rid, n, sid, prefix, sketch): a row's key, a set's size, its name, its first shingles, its parities.

    Rows are fetched again by ``rid``: their id, or where that is null (not ``named``) a hash of the text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(commonness(docs, features))  # 2 * CELLS bytes

    def run(x):
        out = {k: x[k] for k in ("doc_id", "named", "rid")} | {"n": [], "sid": [], "prefix": [], "sketch": []}
        for t in x["text"]:
            found = features(t)
            n = len(found)
            out["n"].append(n)
            out["sid"].append(name_of(found) if n else None)
            out["prefix"].append(ordered(found, shared.value)[: prefix_length(n, at_least)].view(np.int64) if n else [])
            out["sketch"].append(parities(found, at_least) if n else None)
        return out

    rows = docs.select("doc_id", F.col("doc_id").isNotNull().alias("named"), F.coalesce("doc_id", F.xxhash64("text")).alias("rid"), "text")
    return arrow_map(rows, run, "doc_id long, named boolean, rid long, n int, sid binary, prefix array<long>, sketch binary")


def too_far(n_a, n_b, distance, at_least: int = AT_LEAST):
    """Whether sets of these sizes that differ in ``distance`` shingles miss the threshold."""
    return 100 * (n_a + n_b - distance) < at_least * (n_a + n_b + distance)


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, at_least: int, features: Features) -> DataFrame:
    """(a, b, n_a, n_b, distance) of candidate pairs of sets, computed on the whole texts of their first rows.

    At most ``SHARED`` partners of ``b`` meet in a group, and its text is sent once to each group.
    A bitmap of fixed size keeps most other texts out of the shuffle; the join decides.
    """
    spark = docs.sparkSession
    often = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / SHARED).cast("int").alias("groups"))
    dealt = pairs.select("a", "b").join(often, "b").withColumn("part", F.pmod(F.xxhash64("a"), F.col("groups")).cast("int"))
    sides = dealt.select(F.col("a").alias("set"), "b", "part").union(dealt.select(F.col("b").alias("set"), "b", "part").distinct())
    need = written(sides.join(classes.select("set", "sid", "named", "rid"), "set"), "need")
    bit = F.pmod(F.xxhash64("rid"), F.lit(BLOOM_BITS))
    marks = need.select(bit.cast("int").alias("bit")).distinct().groupBy(F.floor(F.col("bit") / 4096).alias("w")).agg(F.collect_list(F.col("bit") % 4096).alias("bits")).collect()
    seen = np.zeros(BLOOM_BITS, bool)
    for r in marks:  # at most BLOOM_BITS small numbers
        seen[np.array(r["bits"], int) + 4096 * r["w"]] = True
    shared = spark.sparkContext.broadcast(np.packbits(seen))

    @F.arrow_udf("boolean")
    def wanted(b: pa.Array) -> pa.Array:
        b = b.to_numpy(zero_copy_only=False)
        return pa.array((shared.value[b >> 3] >> (7 - (b & 7)) & 1).astype(bool))

    with_id = docs.where("doc_id is not null").select(F.lit(True).alias("named"), F.col("doc_id").alias("rid"), "text")
    nameless = docs.where("doc_id is null").groupBy(F.xxhash64("text").alias("rid")).agg(F.first("text").alias("text")).select(F.lit(False).alias("named"), "rid", "text")
    texts = with_id.where(wanted(bit)).union(nameless)
    met = texts.join(need, ["named", "rid"]).select("b", "part", (F.col("set") != F.col("b")).alias("later"), "set", "sid", "text")
    met = met.repartition("b", "part").sortWithinPartitions("b", "part", "later", "set")
    names = ("a", "b", "n_a", "n_b", "distance")
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = at = None
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for b, part, later, one, sid, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = features(text)
                if name_of(found) != sid:
                    continue  # an id can have several texts: only those whose set has the name
                if not later:
                    held, at = found, (b, part)
                elif at == (b, part):
                    apart = len(found) + len(held) - 2 * len(np.intersect1d(found, held, assume_unique=True))
                    for to, v in zip(out, (one, b, len(found), len(held), apart), strict=True):
                        to.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names=list(names))
        give_back()

    prepare(spark)
    return met.mapInArrow(measure, "a long, b long, n_a int, n_b int, distance int").distinct()


def near_by_sketch(pairs: DataFrame, sets: DataFrame, at_least: int) -> DataFrame:
    """The pairs (a, b) whose bitmaps allow a link."""
    one = sets.select(F.col("set").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    two = sets.select(F.col("set").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))

    def run(x):
        keep = [i for i, (p, q, u, v) in enumerate(zip(x["n_a"], x["n_b"], x["s_a"], x["s_b"], strict=True)) if not too_far(p, q, bits_apart(u, v), at_least)]
        return {c: [x[c][i] for i in keep] for c in ("a", "b")}

    return arrow_map(pairs.join(one, "a").join(two, "b"), run, "a long, b long")


_CELL = ("key", "run", "low", "high", "block", "guest", "set", "n", "pos", "component", "hub", "distance", "sketch", "refused")


def near_pairs(cell: dict[str, list], at_least: int, more: int) -> tuple[list[tuple[int, int, bool]], set[int]]:
    """(a, b, sure) of one cell, and the sets that have an open partner: near by the bitmaps, not refused, not surely in one component.

    Each set outside the largest component meets the sets of all others. Sure links join components at once. Of candidates,
    the nearest by its bitmap stands for all between two trees of a second forest, in which candidates join too,
    and each set tells ``more`` others; a candidate joins no components, so what it stands for stays open until it is verified.
    """
    if len(cell["set"]) <= FEW:
        return near_few(cell, at_least, more)
    codes = np.unique(np.array(cell["component"], np.int64), return_inverse=True)[1]
    if not codes.any():
        return [], set()
    n, pos, block = (np.array(cell[c], np.int64) for c in ("n", "pos", "block"))
    guest = np.array(cell["guest"], bool)
    hub, far = (np.array([-1 if v is None else v for v in cell[c]], np.int64) for c in ("hub", "distance"))
    cross = cell["low"][0] != cell["high"][0]  # two blocks: pairs inside one of them have a cell of their own
    bitmaps = [np.frombuffer(s, "<u8") for s in cell["sketch"]]
    words = np.array([len(s) for s in bitmaps])
    stacked: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def at_length(size: int) -> tuple[np.ndarray, np.ndarray]:
        if size not in stacked:  # every bitmap of that length or more, and where it stands
            has = words >= size
            stacked[size] = np.stack([folded(bitmaps[i], size) for i in np.nonzero(has)[0]]), np.cumsum(has) - 1
        return stacked[size]

    sets, refused = np.array(cell["set"], np.int64), [np.array(r or (), np.int64) for r in cell["refused"]]
    sure_tree, tree, is_open, found = codes.copy(), codes.copy(), np.zeros(len(n), bool), []

    def tell(x: int, y: int, sure: bool) -> None:
        found.append((int(min(sets[x], sets[y])), int(max(sets[x], sets[y])), sure))
        for trees in (sure_tree, tree) if sure else (tree,):
            trees[trees == trees[x]] = trees[y]

    ahead = np.ones(len(n), bool)
    for x in np.nonzero(codes != np.bincount(codes).argmax())[0].tolist():
        ahead[x] = False
        shared = 1 + np.minimum(n[x] - pos[x] - 1, n - pos - 1)
        ok = ahead & (sure_tree != sure_tree[x]) & ((block != block[x]) == cross) & ~(guest & guest[x])
        y = np.nonzero(ok & ~too_far(n[x], n, n[x] + n - 2 * np.minimum(shared, np.minimum(n, n[x])), at_least))[0]
        if not len(y):
            continue
        same = (hub[y] == hub[x]) & (hub[x] >= 0)
        open_ = ~(same & too_far(n[x], n[y], np.abs(far[y] - far[x]), at_least))
        y, same = y[open_], same[open_]
        sure = same & ~too_far(n[x], n[y], far[y] + far[x], at_least)
        for k in y[sure].tolist():
            if sure_tree[k] != sure_tree[x]:
                tell(x, k, True)
        y = y[~sure & (sure_tree[y] != sure_tree[x])]
        if len(refused[x]):
            y = y[~np.isin(sets[y], refused[x])]
        apart, least = np.zeros(len(y), np.int64), np.minimum(words[y], words[x])
        for size in np.unique(least).tolist():
            table, where = at_length(size)
            part = least == size
            apart[part] = np.bitwise_count(table[where[y[part]]] ^ table[where[x]]).sum(axis=1, dtype=np.int64)
        near = ~too_far(n[x], n[y], apart, at_least)
        y = y[near][np.lexsort((sets[y[near]], apart[near]))]  # the nearest first
        if not len(y):
            continue
        is_open[x] = is_open[y] = True
        firsts = np.unique(tree[y], return_index=True)[1]
        firsts = firsts[tree[y[firsts]] != tree[x]]
        for k in y[firsts].tolist():
            tell(x, k, False)
        for k in np.delete(y, firsts)[:more].tolist():
            found.append((int(min(sets[x], sets[k])), int(max(sets[x], sets[k])), False))
    return found, set(sets[is_open].tolist())


def near_few(cell: dict[str, list], at_least: int, more: int) -> tuple[list[tuple[int, int, bool]], set[int]]:
    """``near_pairs`` for the many cells of a few sets, pair by pair with whole numbers for bitmaps."""
    n, pos, block, guest, hub, far, sets = (cell[c] for c in ("n", "pos", "block", "guest", "hub", "distance", "set"))
    sure_tree, tree = list(cell["component"]), list(cell["component"])
    counts = Counter(sure_tree)
    if len(counts) == 1:
        return [], set()
    largest, cross = max(counts.items(), key=lambda c: (c[1], -c[0]))[0], cell["low"][0] != cell["high"][0]
    bitmaps: list[int | None] = [None] * len(n)
    words, found, is_open = [len(s) for s in cell["sketch"]], [], set()

    def apart(x: int, y: int) -> int:
        for i in (x, y):
            if bitmaps[i] is None:
                bitmaps[i] = int.from_bytes(cell["sketch"][i], "little")
        a, b = bitmaps[x], bitmaps[y]
        long, short = max(words[x], words[y]), min(words[x], words[y])
        if long > short:
            fold = a if words[x] == long else b
            while long > short:
                long //= 2
                fold = fold & (1 << 8 * long) - 1 ^ fold >> 8 * long
            a, b = fold, b if words[x] > words[y] else a
        return (a ^ b).bit_count()

    def tell(x: int, y: int, sure: bool) -> None:
        found.append((min(sets[x], sets[y]), max(sets[x], sets[y]), sure))
        for trees in (sure_tree, tree) if sure else (tree,):
            old, new = trees[x], trees[y]
            trees[:] = [new if t == old else t for t in trees]

    done = set()
    for x, own in enumerate(cell["component"]):
        if own == largest:
            continue
        done.add(x)
        waiting, left, size = [], n[x] - pos[x], n[x]
        for y in range(len(n)):
            if y in done or sure_tree[y] == sure_tree[x] or (block[y] != block[x]) != cross or (guest[x] and guest[y]):
                continue
            both = size + n[y]
            if too_far(size, n[y], both - 2 * min(left, n[y] - pos[y], size, n[y]), at_least):
                continue
            if hub[x] is not None and hub[x] == hub[y]:
                if too_far(size, n[y], abs(far[x] - far[y]), at_least):
                    continue
                if not too_far(size, n[y], far[x] + far[y], at_least):
                    tell(x, y, True)
                    continue
            waiting.append(y)
        no = set(cell["refused"][x] or ())
        near = []
        for y in waiting:
            if sure_tree[y] != sure_tree[x] and sets[y] not in no:
                bits = apart(x, y)
                if not too_far(size, n[y], bits, at_least):
                    near.append((bits, sets[y], y))
        spare = more
        for _, _, y in sorted(near):
            is_open |= {sets[x], sets[y]}
            if tree[y] != tree[x]:
                tell(x, y, False)
            elif spare:
                spare -= 1
                found.append((min(sets[x], sets[y]), max(sets[x], sets[y]), False))
    return found, is_open


def cell_pairs(rows: DataFrame, at_least: int, more: int = 0) -> DataFrame:
    """(a, b, sure, key): what ``near_pairs`` finds in each list; pairs without a key, and rows (key, a) that are open.

    ``rows``: key, m (the list's length), set, n, pos, component, hub, distance, sketch, refused. A list of more than
    ``BLOCK`` sets is cut by size: a set goes to the run of its size, and as a guest to that of the next larger
    sizes; runs are dealt into cells of two blocks.
    """
    own = F.floor(F.log("n") / (math.log(100 / at_least) + 1e-6)).cast("int")  # sizes of a link are in one run or the next
    short = rows.where(F.col("m") <= BLOCK).select("*", *(F.lit(0).alias(c) for c in ("run", "low", "high", "block")), F.lit(False).alias("guest"))
    long = rows.where(F.col("m") > BLOCK).withColumn("stay", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("run", own + F.col("stay")).withColumn("guest", F.col("stay") == 1)
    sizes = long.groupBy("key", "run").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("g"), F.min("guest").alias("only")).where("not only").drop("only")
    dealt = long.join(sizes, ["key", "run"]).withColumn("block", F.pmod(F.xxhash64("set"), F.col("g")).cast("int"))
    dealt = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("g") - 1))).withColumn("low", F.least("block", "j")).withColumn("high", F.greatest("block", "j"))
    cells = short.select(*_CELL).union(dealt.select(*_CELL)).repartition("key", "run", "low", "high").sortWithinPartitions("key", "run", "low", "high", "set")

    def emit(table: pa.Table) -> pa.RecordBatch:
        """The findings of the whole cells of a table."""
        found: list[tuple] = []
        if table.num_rows:
            marks = np.stack([table.column(c).to_numpy() for c in _CELL[:4]])
            cuts = [0, *(np.nonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0))[0] + 1).tolist(), table.num_rows]
            data = {c: table.column(c).to_pylist() for c in _CELL}
            for p, q in zip(cuts, cuts[1:], strict=False):
                if q - p > 1:
                    pairs, rows = near_pairs({c: v[p:q] for c, v in data.items()}, at_least, more)
                    found += [(*pair, None) for pair in pairs]
                    found += [(one, None, None, data["key"][p]) for one in sorted(rows)]
        columns = zip(*found, strict=True) if found else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, (pa.int64(), pa.int64(), pa.bool_(), pa.int64()), strict=True)], names=["a", "b", "sure", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            mark = [batch.column(i)[-1].as_py() for i in range(4)]
            if held and [held[-1].column(i)[-1].as_py() for i in range(4)] == mark == [batch.column(i)[0].as_py() for i in range(4)]:
                held.append(batch)  # all of the cell that is being gathered
                continue
            same = np.logical_and.reduce([batch.column(i).to_numpy() == mark[i] for i in range(4)])
            tail = int(same.sum())
            yield emit(pa.Table.from_batches([*held, batch.slice(0, batch.num_rows - tail)]))
            held = [batch.slice(batch.num_rows - tail)]
        if held:
            yield emit(pa.Table.from_batches(held))
        give_back()

    return cells.mapInArrow(run, "a long, b long, sure boolean, key long")


def similar_components(docs: DataFrame, at_least: int = AT_LEAST, width: int = WIDTH, rounds: int = ROUNDS, features: Features | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text).

    ``features``: another function from a text to its set, sorted distinct well-mixed 64-bit hashes.
    """
    with scratch(docs.sparkSession, keep=("signatures", "of_set")):
        return _joined(docs, at_least, rounds, features or partial(shingles, width=width))


def _joined(docs: DataFrame, at_least: int, rounds: int, features: Features) -> DataFrame:
    spark = docs.sparkSession
    sig = written(signatures(docs, at_least, features), "signatures")
    first = F.min(F.struct((~F.col("named")).alias("nameless"), "rid")).alias("first")
    some = sig.where("n > 0").groupBy("sid", "n").agg(first, F.min("doc_id").alias("least_id"), F.first("sketch").alias("sketch"), F.first("prefix").alias("prefix"))
    some = some.select("sid", "n", (~F.col("first.nameless")).alias("named"), "first.rid", "least_id", "sketch", "prefix")
    classes = written(some.withColumn("set", F.monotonically_increasing_id()), "classes")  # the sets, numbered
    rows = classes.select("set", "n", F.posexplode("prefix").alias("pos", "key"))
    nothing = classes.where("false").select(F.col("set").alias("a"), F.col("set").alias("b"))
    links, refused, hubs_of = [nothing], [nothing], nothing.select(F.col("a").alias("set"), F.col("b").alias("hub"), F.lit(0).alias("distance"))
    linked = ~too_far(F.col("n_a"), F.col("n_b"), F.col("distance"), at_least)
    # the lists of at least two sets, each with its hub: first the set whose shared shingle comes first, then one of any component

    def hubs(rows: DataFrame, turn: int) -> DataFrame:
        """Every mixed list's length, and its hub while there is a round of hubs to come."""
        order = [F.xxhash64("component", F.lit(turn)).alias("o")] if turn else []
        best = F.min(F.struct(*order, "pos", "set", "n", *(["component"] if turn else []))).alias("best")
        mixed = [F.min("component").alias("p"), F.max("component").alias("q")]
        found = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m"), *(mixed if turn else []), *([best] if turn < rounds else [])).where("p < q" if turn else "m > 1")
        hub = [F.col(f"best.{c}").alias(f"hub_{name}") for name, c in (("set", "set"), ("n", "n"), ("pos", "pos"), ("component", "component" if turn else "set"))] if turn < rounds else []
        return written(found.select("key", "m", *hub), "lists")

    state = written(rows.join(hubs(rows, 0), "key"), "state").withColumn("component", F.col("set"))  # each set its own at first
    discard(spark, "lists")
    relabel = lambda: components(reduce(DataFrame.union, links)).withColumnRenamed("node", "set")
    base = ["key", "set", "n", "pos"]

    def renamed(state: DataFrame, turn: int) -> DataFrame:
        """``state`` with new components, the lists that are still mixed, and their hubs."""
        now = state.select(*base).join(relabel(), "set", "left").withColumn("component", F.coalesce("component", "set"))
        now = written(now, "renamed")
        state = written(now.join(hubs(now, turn), "key"), "state")
        discard(spark, "renamed", "lists", "links", "parent", "label", "need", "near", "told")
        discard(spark, "state", keep=1)
        return state

    for turn in range(rounds):
        least = F.least(F.col("n") - F.col("pos"), F.col("hub_n") - F.col("hub_pos"), "n", "hub_n")
        met = state.where("hub_component <> component").where(~too_far(F.col("n"), F.col("hub_n"), F.col("n") + F.col("hub_n") - 2 * least, at_least))
        chosen = met.groupBy(F.col("set").alias("a")).agg(F.min(F.struct("hub_pos", F.xxhash64("hub_set"), "hub_set")).alias("hub")).select("a", F.col("hub.hub_set").alias("b"))
        near = written(near_by_sketch(chosen, classes, at_least), "near")
        measured = written(verified(near, docs, classes, at_least, features), "measured")
        if turn == 0:
            to_hub = measured.select(F.col("a").alias("set"), F.col("b").alias("hub"), "distance").union(measured.select("b", "b", F.lit(0)))
            hubs_of = written(to_hub.groupBy("set").agg(F.min_by(F.struct("hub", "distance"), "distance").alias("s")).select("set", "s.hub", "s.distance"), "hubs_of")
        links.append(measured.where(linked).select("a", "b"))
        refused.append(measured.where(~linked).select("a", "b"))
        state = renamed(state, turn + 1)
    for turn in range(TURNS):
        if state.isEmpty():
            break
        pairs = reduce(DataFrame.union, refused)
        no = pairs.select("a", "b").union(pairs.select("b", "a")).groupBy(F.col("a").alias("set")).agg(F.collect_set("b").alias("refused"))
        full = state.select("m", *base, "component").join(hubs_of, "set", "left").join(classes.select("set", "sketch"), "set").join(no, "set", "left")
        with batch_rows(spark, 2000):
            told = written(cell_pairs(full, at_least, more=(1 << turn) - 1), "told")
        left = written(told.where("key is null").groupBy("a", "b").agg(F.max("sure").alias("sure")), "pairs")
        if left.isEmpty():
            break
        measured = written(verified(left.where("not sure"), docs, classes, at_least, features), "measured")
        links += [left.where("sure").select("a", "b"), measured.where(linked).select("a", "b")]
        refused.append(measured.where(~linked).select("a", "b"))
        alive = told.where("key is not null").select("key", F.col("a").alias("set")).distinct()
        state = renamed(state.join(alive, ["key", "set"], "left_semi"), rounds + turn + 1)
    else:
        raise RuntimeError("candidates are left that were neither linked nor refused")
    named = written(classes.select("set", "sid", "least_id").join(relabel(), "set", "left").withColumn("component", F.coalesce("component", "set")), "named")
    ids = written(named.groupBy("component").agg(F.min("least_id").alias("component_id")), "ids")
    of_set = written(named.join(ids, "component").select("sid", "component_id"), "of_set")
    got = sig.select("doc_id", "n", "sid").where("n > 0").join(of_set, "sid").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    return got.union(sig.where("n = 0").select("doc_id", F.lit(0).cast("long"), "doc_id"))

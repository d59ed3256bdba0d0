"""Language-model scores with a restaurant for every word, below the classes of ``pitman_yor``.

Every pair of words counts on its own. A class's context restaurant has the pairs with other classes; below its dish
"outside the classes" the word has a restaurant for all other words, whose parent is the one they share. A word
outside the classes has a restaurant for all words, whose parent is the context restaurant of its last two bytes.
The parents' chances come from ``pitman_yor``, which counts tokens, and stay fixed; seating below them is
sampled by Gibbs, and chances are averaged over the sweeps after the burn-in.

Pairs are dealt into buckets that hold about ``BUCKET`` tokens, once: those of a word without a number (a rare one) by
that word, so that its restaurant is whole, those of the numbered words by both words. The tables of the latter's restaurants
are summed over all buckets between sweeps. Pairs whose second word is rare then meet its count in a join.

Defined cases: those of ``pitman_yor``; words and pairs are told apart by 64-bit hashes; where a pair's second word is rare, seating takes
the pair's count for the word's, since the word's is known only later (the chance of such a word hardly opens a table).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gathered, give_back, held_out, prepare
from .pitman_yor import BURN_IN, END, OTHER, SAMPLES, THETA, Trained, number_of, tables, tail_of, trained, words_of

START = 1  # before a text's first word; no word has this number
BUCKET, TOGETHER = 1_500_000, 4 << 20

TEXTS = pa.schema([("row", pa.int64()), ("s", pa.float64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64())])
FAR = pa.schema([("h", pa.int64()), ("row", pa.int64()), ("own", pa.float32()), ("rest", pa.float32())])


class Keys(dict):
    """Numbers of words; those without one go by their hash."""

    def __missing__(self, word: bytes) -> int:
        return number_of(word)


class Model:
    """What tasks read: tables of bounded size."""

    def __init__(self, of: Trained):
        self.keys, self.top, self.numbers, self.tails = Keys(of.numbered.number), of.numbered.top, of.numbered.unknown, of.numbered.tails
        self.table, self.others, self.tail, self.logs, self.ends = of.by_context, of.others, of.tail, np.log10(of.singles + 0.5), of.ends
        self.customers = of.singles.copy()  # of each numbered word's restaurant
        self.customers[: self.top] = of.contexts[: self.top, OTHER]
        self.customers[START] = of.contexts[self.top, OTHER]

    def numbered(self, key: np.ndarray) -> np.ndarray:
        return (key >= 0) & (key < self.numbers)

    def parent(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        """log10 of the chance of each pair in its restaurant's parent, but for the count of a rare second word."""
        known, near = self.numbered(w), self.numbered(u)
        tails = np.where(near, self.tails[np.where(near, u, 0)], u & 255)
        dish = np.where(known & (w < self.top), w, OTHER)
        out = np.where(near & (u < self.top), 0.0, self.table[self.top + 1 + tails, dish])  # a class's restaurant is below its dish
        return out + np.where(dish == OTHER, self.others[np.where(known & (w >= self.top), w - self.top, -1)], 0.0)


def mixed(a: np.ndarray, b: np.ndarray | None = None) -> np.ndarray:
    """Hashes of keys or of pairs."""
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    if b is not None:
        x ^= x >> np.uint64(29)
        x = x * np.uint64(0xD6E8FEB86659FD93) + b.astype(np.uint64)
    for k in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x ^= x >> np.uint64(31)
        x *= np.uint64(k)
    return x ^ (x >> np.uint64(32))


def packed(*columns: np.ndarray) -> bytes:
    """Columns byte plane by byte plane, which compress well where numbers are small."""
    planes = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes() for c in columns)
    return pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(n: int, data: bytes, kinds: tuple[type, ...]) -> tuple[np.ndarray, ...]:
    """The columns of these ``kinds``, of ``n`` values each."""
    sizes, out, at = [np.dtype(kind).itemsize for kind in kinds], [], 0
    planes = np.frombuffer(pa.decompress(data, decompressed_size=n * sum(sizes), codec="zstd"), np.uint8)
    for kind, size in zip(kinds, sizes, strict=True):
        out.append(np.ascontiguousarray(planes[at : at + size * n].reshape(size, n).T).view(kind).ravel())
        at += size * n
    return tuple(out)


def stored(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unstored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for data in b.column(0):
            yield from pa.ipc.open_stream(data.as_buffer())
    give_back()


def added(group: pa.Table) -> pa.Table:
    """The texts of one record, with the sums that the buckets have for them."""
    found = sorted(zip(*(group.column(c).to_pylist() for c in ("n", "data")), strict=True))
    texts = pa.ipc.open_stream(found[0][1]).read_all()  # its number is below 0
    s = texts.column("s").to_numpy().copy()
    for n, data in found[1:]:
        place, more = unpacked(n, data, (np.int32, np.float32))
        s[place] += more
    return texts.set_column(1, "s", pa.array(s))


def records(model: Model, batch: pa.RecordBatch, first: int, buckets: int) -> Iterator[tuple]:
    """Texts as (a number below 0, first row, rows, stored) and their pairs as (bucket, first row, pairs, packed).

    Of a pair both words are told, and the text's place, inverted where the text is held out.
    """
    held = batch.column("held_out").to_numpy(zero_copy_only=False)
    us, ws, sizes, get = [], [], [], model.keys.__getitem__
    for text in batch.column("text").to_pylist():
        words = words_of(text)
        key = np.fromiter(map(get, words), np.int64, len(words))
        u = np.concatenate(([START], key))
        far = np.nonzero(~model.numbered(key))[0]
        u[far + 1] = (key[far] & ~255) | np.fromiter((tail_of(words[i]) for i in far.tolist()), np.int64, len(far))
        us.append(u)
        ws.append(np.append(key, END))
        sizes.append(len(u))
    u, w, doc, n = np.concatenate(us), np.concatenate(ws), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), len(sizes)
    known, near = model.numbered(w), model.numbered(u)
    close, inner = near & (u < model.top), known & (w < model.top)
    context, dish = np.where(u == START, model.top, u)[close], np.where(inner, w, OTHER)[close]
    s = np.bincount(doc[close], model.table[context, dish], n)
    base = np.bincount(doc[known], model.logs[w[known]], n)
    n_known = np.bincount(doc[known], minlength=n) - (not model.ends)
    texts = [np.arange(first, first + n), s, batch.column("doc_id"), batch.column("held_out"), np.array(sizes), n_known, base]
    yield -1 - int(mixed(np.array([first]))[0] % np.uint64(buckets)), first, n, stored(pa.RecordBatch.from_arrays([pa.array(x, f.type) if isinstance(x, np.ndarray) else x for x, f in zip(texts, TEXTS, strict=True)], schema=TEXTS))
    far = ~(close & inner)
    u, w, doc = u[far], w[far], np.where(held[doc], ~doc, doc)[far]
    to = (np.where(near[far], mixed(u, w), mixed(u)) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
    order = np.argsort(to, kind="stable")
    u, w, doc, to = u[order], w[order], doc[order], to[order]
    cuts = [0, *(np.nonzero(to[1:] != to[:-1])[0] + 1).tolist(), len(to)] if len(to) else [0]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield int(to[a]), first, b - a, packed(u[a:b], w[a:b], doc[a:b])


class Pairs:
    """The different pairs of a bucket, their training counts, and where they stand."""

    def __init__(self, model: Model, found: list[tuple]):
        read = [(first, *unpacked(n, data, (np.int64, np.int64, np.int32))) for first, n, data in sorted(found, key=lambda r: r[0])]
        doc = np.concatenate([x[3] for x in read])
        self.place = np.where(doc < 0, ~doc, doc)  # of each token's text, after its record's first row
        self.first, self.sizes = [x[0] for x in read], [len(x[3]) for x in read]
        u, w = np.concatenate([x[1] for x in read]), np.concatenate([x[2] for x in read])
        key = mixed(u, w)
        order = np.argsort(key)
        key = key[order]
        new = np.append(True, key[1:] != key[:-1])
        at = np.nonzero(new)[0]
        self.pair = np.empty(len(u), np.int64)  # of each token
        self.pair[order] = np.cumsum(new) - 1
        self.u, self.w = u[order[at]], w[order[at]]
        self.n = np.add.reduceat((doc[order] >= 0).astype(np.int64), at)
        near = model.numbered(self.u)
        far, place = np.unique(self.u[~near], return_inverse=True)
        self.at = np.where(near, self.u, 0)  # the restaurant: numbered words, then the bucket's rare ones
        self.at[~near] = model.numbers + place
        self.customers = np.concatenate((model.customers, np.bincount(place, self.n[~near], len(far)).astype(np.int64)))
        self.model = model

    @cached_property
    def parent(self) -> np.ndarray:
        return self.model.parent(self.u, self.w)

    def sums(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, x, len(self.customers))

    def shared(self, tables_: np.ndarray, mine: np.ndarray) -> np.ndarray:
        """Tables of each restaurant in other buckets, of ``tables_`` in all."""
        return np.append(tables_, np.zeros(len(mine) - len(tables_))) - np.append(mine[: len(tables_)], np.zeros(len(mine) - len(tables_)))


def seatings(model: Model, pairs: Pairs, bucket: int, d: float, distinct: np.ndarray, opened: np.ndarray | None, seat) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tables of each pair and of each restaurant, sweep by sweep; after the burn-in other buckets have ``opened`` less this one's."""
    rng, rare = np.random.default_rng((14, bucket)), ~model.numbered(pairs.w)
    t = (pairs.n > 0).astype(np.int64)
    more = np.nonzero(pairs.n > 1)[0]
    chance = pairs.parent[more] + np.where(rare[more], model.tail.log10(pairs.n[more]), 0.0)
    elsewhere = pairs.shared(distinct, pairs.sums(t))
    for sweep in range(BURN_IN + (SAMPLES if opened is not None else 0)):
        if sweep == BURN_IN:
            elsewhere = pairs.shared(opened, pairs.sums(t))
        all_ = elsewhere + pairs.sums(t)
        t[more] = seat(pairs.n[more], THETA + d * (all_[pairs.at[more]] - t[more]), 10 ** chance, d, rng)
        yield t, elsewhere + pairs.sums(t)


def by_bucket(model, fn, texts: bool = False):
    """For mapPartitions: ``fn`` of each bucket's number and pairs, and the records of texts as they are."""

    def run(found):
        buckets: dict[int, list] = {}
        for bucket, record in found:
            if bucket >= 0:
                buckets.setdefault(bucket, []).append(record)
            elif texts:
                yield record[0], -1, record[2]
        while buckets:
            bucket, mine = buckets.popitem()
            yield from fn(bucket, Pairs(model.value, mine))
        give_back()

    return run


def summed(parts, size: int) -> np.ndarray:
    """The sum of arrays of ``size``, in a tree."""
    return parts.mapPartitions(lambda arrays: [sum(arrays, np.zeros(size))]).treeReduce(lambda a, b: a + b)


def score_documents(docs: DataFrame, seat=tables) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity; every pair of words counts."""
    spark = docs.sparkSession
    of = trained(docs)
    model, tail, size = spark.sparkContext.broadcast(Model(of)), of.tail, len(of.singles)
    buckets = 16 + of.train // BUCKET

    def deal(batches):
        first = TaskContext.get().partitionId() << 33
        for batch in gathered(batches, TOGETHER):
            if batch.num_rows:
                bucket, row, n, data = zip(*records(model.value, batch, first, buckets), strict=True)
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(bucket, pa.int32()), "first": pa.array(row, pa.int64()), "n": pa.array(n, pa.int32()), "data": pa.array(data, pa.binary())})
                first += batch.num_rows
        give_back()

    prepare(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(1).alias("held_out"))
    found = texts.mapInArrow(deal, "bucket int, first long, n int, data binary").rdd
    dealt = found.map(lambda r: (r[0], (r[1], r[2], bytes(r[3])))).partitionBy(buckets, lambda b: b)  # shuffled once, read by all that follows

    def distinct_of(bucket, pairs):
        yield np.append(pairs.sums(pairs.n > 0)[:size], ((pairs.n == 1).sum(), (pairs.n == 2).sum()))

    first_pass = summed(dealt.mapPartitions(by_bucket(model, distinct_of)), size + 2)
    distinct, d = first_pass[:size], float(np.clip(first_pass[size] / max(1, first_pass[size] + 2 * first_pass[size + 1]), 0.05, 0.95))
    known = spark.sparkContext.broadcast(distinct)

    def opened_of(bucket, pairs):
        *_, (t, _) = seatings(model.value, pairs, bucket, d, known.value, None, seat)
        yield pairs.sums(t)[:size]

    after = spark.sparkContext.broadcast(summed(dealt.mapPartitions(by_bucket(model, opened_of)), size))

    def chances(bucket, pairs):
        own, rest = np.zeros(len(pairs.n)), np.zeros(len(pairs.customers))
        for sweep, (t, all_) in enumerate(seatings(model.value, pairs, bucket, d, known.value, after.value, seat)):
            if sweep >= BURN_IN:
                own += np.maximum(pairs.n - d * t, 0) / SAMPLES
                rest += (THETA + d * all_) / SAMPLES
        below = THETA + pairs.customers
        return own / below[pairs.at], (rest / below)[pairs.at] * 10**pairs.parent, model.value.numbered(pairs.w)

    def near_sums(bucket, pairs):
        own, rest, known_ = chances(bucket, pairs)
        logs, at = np.log10(own + rest), 0
        for first, n in zip(pairs.first, pairs.sizes, strict=True):
            pair, place = pairs.pair[at : at + n], pairs.place[at : at + n]
            place, s = place[known_[pair]], logs[pair[known_[pair]]]
            met = np.nonzero(np.bincount(place))[0]
            if len(met):
                yield first, len(met), packed(met.astype(np.int32), np.bincount(place, s)[met].astype(np.float32))
            at += n

    def far_pairs(bucket, pairs):
        own, rest, known_ = chances(bucket, pairs)
        far_ = ~known_[pairs.pair]
        p, row = pairs.pair[far_], (np.repeat(pairs.first, pairs.sizes) + pairs.place)[far_]
        columns = (pairs.w[p], row, own[p].astype(np.float32), rest[p].astype(np.float32))
        yield (stored(pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=FAR)),)

    parts = spark.createDataFrame(dealt.mapPartitions(by_bucket(model, near_sums, texts=True)), "first long, n int, data binary")
    read = parts.groupBy("first").applyInArrow(added, "row long, s double, doc_id long, held_out boolean, n_tokens long, n_known long, base double")
    far = spark.createDataFrame(dealt.mapPartitions(by_bucket(model, far_pairs)), "data binary").mapInArrow(unstored, "h long, row long, own float, rest float")

    @F.arrow_udf("double")
    def chance(c: pa.Array) -> pa.Array:
        return pa.array(10 ** tail.log10(c.to_numpy(zero_copy_only=False).astype(float)))

    rare = of.rare.select("h", "n", chance("n").alias("p"))  # once a word
    far = far.join(rare, "h", "left").withColumn("c", F.coalesce("n", F.lit(0))).withColumn("p", F.coalesce("p", F.lit(float(10 ** tail.log10(np.array([0]))[0]))))
    far = far.select("row", F.log10(F.col("own").cast("double") + F.col("rest").cast("double") * F.col("p")).alias("s"), F.log10(F.col("c") + 0.5).alias("base"), (F.col("c") > 0).cast("long").alias("n_known"))
    total = read.unionByName(far, allowMissingColumns=True).groupBy("row").agg(*[F.sum(c).alias(c) for c in ("s", "base", "n_known", "n_tokens")], F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"))
    return total.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(of.train).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(of.below)).alias("base_score"), F.col("s").alias("score"), F.pow(F.lit(10.0), -F.col("s") / F.col("n_tokens")).alias("perplexity"),
    )

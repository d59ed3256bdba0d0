"""Language-model scores from a hierarchical Pitman-Yor model.

A text's words are read with the word before each. Every word has a context restaurant: the
``CLASSES`` most frequent words (and the start of a text) one of their own, all others one for their last two
bytes, ``TAILS`` in all. They share the unigram restaurant as parent; in it, words outside the
classes are one dish, whose own restaurant serves the next ``FREQUENT`` words and, as one dish, the
rest; those have a restaurant too, where a word's chance depends on its count alone.

Seating is sampled by Gibbs, a dish at a time: all customers of a dish leave their restaurant and are
seated again, given all other tables there and the parent's chances; the parent's customers are the tables
below it, and predictive probabilities are averaged over the sweeps after the burn-in.

These are the restaurants of the classes; ``word_pairs`` puts one for every word below them.

All training words are counted by Spark; tables of bounded size (contexts by classes, frequent words) are
broadcast, and all other words meet their counts in a join.

Defined cases: a null text is the empty text (the end alone); repeated rows are scored and
counted each; a null id counts as training; words of equal counts are ordered by their bytes; a very long text
is one sequence; other columns are ignored; without training rows the model is uniform; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, count_bin, held_out, most_frequent, prepare, written

CLASSES, FREQUENT, TAILS, BURN_IN, SAMPLES, THETA = 1024, 65_536, 256, 3, 4, 1.0
END, OTHER = 0, 1  # the first two classes


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # bytes: A-Z only, and ASCII white space


def tail_of(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % TAILS


def number_of(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, word, n): every word of the training rows, with a hash of it."""

    def count(batches):
        c: Counter = Counter()

        def told():
            return pa.RecordBatch.from_pydict({"h": pa.array(map(number_of, c), pa.int64()), "word": pa.array(list(c), pa.binary()), "n": pa.array(list(c.values()), pa.int64())})

        for b in batches:
            for text in b.column(0).to_pylist():
                c.update(words_of(text))
            if len(c) > 300_000:
                yield told()
                c.clear()
        yield told()

    prepare(docs.sparkSession)
    return docs.where(~held_out(1)).select("text").mapInArrow(count, "h long, word binary, n long").groupBy("h", "word").agg(F.sum("n").alias("n"))


def tables(customers: np.ndarray, others: np.ndarray | float, parent: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish after all its customers were seated again.

    ``others``: theta and ``d`` for each table of other dishes there; ``parent``: the dish's chance in the parent. The next of n
    customers at t tables opens one with chance m / (m + n - d t), where m = (others + d t) parent. Customers come
    in groups of an eighth of those seated (one at least), whose new tables are binomial.
    """
    others, parent = np.broadcast_to(others, customers.shape), np.broadcast_to(parent, customers.shape)
    t = (customers > 0).astype(np.int64)
    seated = t.copy()
    active = np.nonzero(customers > 1)[0]
    while len(active):
        n, k = seated[active], t[active]
        group = np.minimum(np.maximum(1, n // 8), customers[active] - n)
        mass = (others[active] + d * k) * parent[active]
        t[active] = np.minimum(k + rng.binomial(group, np.clip(mass / (mass + n - d * k), 0, 1)), customers[active])
        seated[active] = n + group
        active = active[seated[active] < customers[active]]
    return t


def discount(customers: np.ndarray) -> float:
    one, two = int((customers == 1).sum()), int((customers == 2).sum())
    return float(np.clip(one / max(1, one + 2 * two), 0.05, 0.95))


def context_model(counts: np.ndarray, seed: int = 11) -> np.ndarray:
    """log10 of the averaged chance of each class (columns) in each context (rows); ``counts`` likewise."""
    rng, n_dish = np.random.default_rng(seed), counts.shape[1]
    d = discount(counts[counts > 0])
    all_ = counts.sum(axis=1)
    root_c = (counts > 0).sum(axis=0).astype(np.int64)
    root_t = (root_c > 0).astype(np.int64)
    low = (counts > 0).astype(np.int64)
    total = np.zeros(counts.shape)
    for sweep in range(BURN_IN + SAMPLES):
        d0 = discount(root_c[root_c > 0])
        root_t = tables(root_c, THETA + d0 * (root_t.sum() - root_t), np.full(n_dish, 1 / n_dish), d0, rng)
        p0 = (np.maximum(root_c - d0 * root_t, 0) + (THETA + d0 * root_t.sum()) / n_dish) / (THETA + root_c.sum())
        others = THETA + d * (low.sum(axis=1)[:, None] - low)
        low = tables(counts.ravel(), others.ravel(), np.broadcast_to(p0, counts.shape).ravel(), d, rng).reshape(counts.shape)
        root_c = low.sum(axis=0)
        if sweep >= BURN_IN:
            total += (np.maximum(counts - d * low, 0) + (THETA + d * low.sum(axis=1))[:, None] * p0) / (THETA + all_)[:, None]
    return np.log10(total / SAMPLES)


def dish_model(customers: np.ndarray, seed: int = 12) -> np.ndarray:
    """log10 of the averaged chance of each dish of one restaurant over a uniform base."""
    rng, n = np.random.default_rng(seed), len(customers)
    d, t, total = discount(customers[customers > 0]), (customers > 0).astype(np.int64), np.zeros(n)
    for sweep in range(BURN_IN + SAMPLES):
        t = tables(customers, THETA + d * (t.sum() - t), np.full(n, 1 / n), d, rng)
        if sweep >= BURN_IN:
            total += (np.maximum(customers - d * t, 0) + (THETA + d * t.sum()) / n) / (THETA + customers.sum())
    return np.log10(total / SAMPLES)


class CountModel:
    """A restaurant known by how many dishes have how many customers: a word's chance by its count."""

    def __init__(self, counts: np.ndarray, words: np.ndarray, seed: int = 13, copies: int = 32):
        rng = np.random.default_rng(seed)
        self.counts, n_words, all_ = counts.astype(float), float(words.sum()), float((counts * words).sum())
        one, two = float(words[counts == 1].sum()), float(words[counts == 2].sum())
        d = float(np.clip(one / max(1.0, one + 2 * two), 0.05, 0.95))
        base, mean_t, total, fresh = 1 / (n_words + 1), np.ones(len(counts)), np.zeros(len(counts)), 0.0
        for sweep in range(BURN_IN + SAMPLES):
            others = np.repeat(THETA + d * (float((mean_t * words).sum()) - mean_t), copies)
            many = tables(np.repeat(counts.astype(np.int64), copies), others, np.full(len(counts) * copies, base), d, rng)
            mean_t = many.reshape(-1, copies).mean(axis=1) if len(counts) else mean_t
            new = (THETA + d * float((mean_t * words).sum())) * base / (THETA + all_)
            if sweep >= BURN_IN:
                total += np.maximum(counts - d * mean_t, 0) / (THETA + all_) + new
                fresh += new
        self.counts = np.concatenate(([0.0], self.counts))
        self.chance = np.concatenate(([fresh], total)) / SAMPLES

    def log10(self, count: np.ndarray) -> np.ndarray:
        return np.log10(np.interp(count, self.counts, self.chance))


def contexts_of(ids: np.ndarray, top: int, unknown: int, tails: list[int], known_tails: np.ndarray) -> np.ndarray:
    """The context of each word number (-1: the start): classes, then the start, then tails; ``tails``: of the unknown ones."""
    out = np.where(ids < 0, top, ids)
    far = ids >= top
    tail = known_tails[np.minimum(ids, len(known_tails) - 1)] if len(known_tails) else np.zeros(len(ids), np.int64)
    tail[ids == unknown] = tails
    return np.where(far, top + 1 + tail, out)


class Numbered:
    """The frequent words' numbers: the end 0, other words 1 where they are a class, then the words of the classes, then the rest."""

    def __init__(self, words: list[bytes]):
        self.number = {w: i + 2 for i, w in enumerate(words)}
        self.top, self.unknown = min(CLASSES, len(words) + 2), len(words) + 2
        self.tails = np.array([0, 0, *map(tail_of, words)], np.int64)

    def read(self, text: str | None) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """A text's words, their numbers and the end, and the context of each."""
        ws, get, unknown = words_of(text), self.number.get, self.unknown
        now = np.append(np.fromiter(map(get, ws, repeat(unknown)), np.int64, len(ws)), END)
        before = np.concatenate(([-1], now[:-1]))
        tails = [tail_of(ws[i]) for i in np.nonzero(now[:-1] == unknown)[0].tolist()]
        return ws, now, contexts_of(before, self.top, unknown, tails, self.tails)


def training_counts(docs: DataFrame, words: list[bytes]) -> np.ndarray:
    """Counts of classes (columns) by context (rows: classes, the start, tails)."""
    shared = docs.sparkSession.sparkContext.broadcast(Numbered(words))  # at most CLASSES + FREQUENT words
    top = shared.value.top
    size = (top + 1 + TAILS, top)

    def count(batches):
        contexts = np.zeros(size[0] * top, np.int64)
        for b in batches:
            keys = []
            for text in b.column(0).to_pylist():
                _, now, before = shared.value.read(text)
                keys.append(before * top + np.where(now >= top, OTHER, now))
            if keys:
                contexts += np.bincount(np.concatenate(keys), minlength=len(contexts))
        at = np.nonzero(contexts)[0]
        yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int32()), "n": pa.array(contexts[at], pa.int64())})

    got = docs.where(~held_out(1)).select("text").mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # a bounded table
    contexts = np.zeros(size[0] * top, np.int64)
    contexts[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return contexts.reshape(size)


@dataclass
class Trained:
    """The model of the classes, and the counts it was made of."""

    rare: DataFrame  # words without a number, with their counts
    numbered: Numbered
    singles: np.ndarray  # counts by word number
    contexts: np.ndarray
    train: int
    distinct: int
    by_context: np.ndarray
    others: np.ndarray
    tail: CountModel

    @property
    def ends(self) -> int:
        return int(self.singles[END])

    @property
    def below(self) -> float:
        return float(np.log10(self.train + 0.5 * (self.distinct + 1)))


def trained(docs: DataFrame) -> Trained:
    counts = written(word_counts(docs), "words")
    all_ = counts.agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n")).first()
    frequent = [(bytes(w), n) for w, n in most_frequent(counts, CLASSES - 2 + FREQUENT)]
    words, least = [w for w, _ in frequent], min((n for _, n in frequent), default=1 << 62)
    rare = counts.where(F.col("n") < least)
    contexts = training_counts(docs, words)
    ends, top = int(contexts[:, END].sum()), contexts.shape[1]
    singles = np.array([ends, 0, *(n for _, n in frequent)], np.int64)
    train, distinct = (all_["n"] or 0) + ends, all_["words"] + (ends > 0)
    by_context = context_model(contexts)
    outside_c = np.append(singles[top:], train - singles.sum())  # frequent words outside the classes; last: the rest
    others = dish_model(outside_c)
    hist = rare.groupBy(count_bin(F.col("n")).alias("bin")).agg(F.count(F.lit(1)).alias("k"), F.avg("n").alias("c")).orderBy("bin").collect()
    tail = CountModel(np.array([round(r["c"]) for r in hist], np.int64), np.array([r["k"] for r in hist], float))
    return Trained(rare, Numbered(words), singles, contexts, train, distinct, by_context, others, tail)


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity; by the model of the classes alone."""
    spark = docs.sparkSession
    of = trained(docs)
    rare, tail, ends, n_words, top = of.rare, of.tail, of.ends, len(of.singles), of.numbered.top
    model = spark.sparkContext.broadcast((of.by_context, of.others, np.log10(of.singles + 0.5), of.numbered))  # bounded tables

    def run(x):
        table, other, logs, numbered = model.value
        out = {k: [] for k in ("doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare", "times")}
        out["doc_id"], out["held_out"] = x["doc_id"], x["held_out"]
        for text in x["text"]:
            ws, now, before = numbered.read(text)
            known = now < n_words
            outside = now[now >= top] - top
            far = Counter(number_of(ws[i]) for i in np.nonzero(~known)[0].tolist())
            out["n_tokens"].append(len(now))
            out["n_known"].append(int(known.sum()) - (not ends))
            out["base"].append(float(logs[now[known]].sum()))
            out["score"].append(float(table[before, np.where(now >= top, OTHER, now)].sum() + other[outside].sum()))
            out["rare"].append(list(far))
            out["times"].append(list(far.values()))
        return out

    scored = arrow_map(docs.select("doc_id", "text", held_out(1).alias("held_out")), run, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<long>, times array<int>")
    rows = written(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    met = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("h"), F.col("w.times").alias("times"))
    met = met.join(rare.select("h", "n"), "h", "left").select("row", "times", F.coalesce("n", F.lit(0)).alias("c"))

    @F.arrow_udf("double")
    def chance(c: pa.Array) -> pa.Array:
        return pa.array(tail.log10(c.to_numpy(zero_copy_only=False).astype(float)))

    extra = met.withColumn("p", chance("c")).groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("c") + 0.5)).alias("base_rare"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known_rare"), F.sum(F.col("times") * F.col("p")).alias("score_rare"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    joined = rows.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score").join(extra, "row", "left")
    total = F.col("score") + zero(F.col("score_rare"))
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + zero(F.col("known_rare"))).alias("n_known"), F.lit(of.train).cast("long").alias("train_tokens"),
        (F.col("base") + zero(F.col("base_rare")) - F.col("n_tokens") * F.lit(of.below)).alias("base_score"), total.alias("score"), F.pow(F.lit(10.0), -total / F.col("n_tokens")).alias("perplexity"),
    )

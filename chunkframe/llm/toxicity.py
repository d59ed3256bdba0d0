"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its hashed character n-grams (and of itself), so
an unseen misspelling shares most of it. A run of more than ``LONGEST`` letters is read as pieces of
``PIECE``, one from every ``STEP``-th letter and one at its end, so all of it is seen. A
window of ``WINDOW`` words or pieces, one from every start, is the average of their vectors (a text
of fewer is one window), a linear softmax gives its two classes, and a text is as toxic as its
worst window, which is also the one that learns. The model is fitted on at most ``SAMPLE``
labelled rows of each class, chosen by a hash of the id; scoring reads whole texts.

Defined cases: null texts and texts without a word get the score of an empty window; without
training rows of both classes every score is 0; ties and repeated rows score alike; an empty table gives no rows; columns
named like the results are kept under ``keep`` only if ``into`` names others.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TOGETHER, arrow_map, held_out

BUCKETS, DIMENSIONS, WINDOW, SAMPLE, EPOCHS, GRAMS, LEAST_ROWS, REMEMBERED, RATE, SMOOTH = 1 << 19, 8, 4, 1000, 25, (3, 6), 5, 800_000, 0.02, 3.0
LONGEST, PIECE, STEP = 40, 12, 4  # letters
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """The words of a text between marks; a run of more than ``LONGEST`` letters as overlapping pieces that cover it."""
    out = []
    for w in _WORD.findall((text or "").lower()):
        s, last = f"<{w}>", len(w) + 2 - PIECE
        out += [s] if len(w) <= LONGEST else [s[i : i + PIECE] for i in (*range(0, last, STEP), last)]
    return out


def subwords(word: str) -> list[int]:
    """Buckets of a marked word or piece: its n-grams, and itself."""
    s = word.encode("utf-32-le")
    n = len(s) // 4
    return [zlib.crc32(s[4 * i : 4 * (i + k)]) % BUCKETS for k in range(GRAMS[0], GRAMS[1] + 1) for i in range(n - k + 1)] + [zlib.crc32(s) % BUCKETS]


def fit(texts: list[str], toxic: list[int], epochs: int = EPOCHS, rate: float = RATE, telling_start: bool = True, seed: int = 7) -> np.ndarray:
    """Logit of each subword (toxic less clean, bias last): embeddings times softmax weights; NaN where none was learned.

    A subword of fewer than ``LEAST_ROWS`` texts has no vector. The worst window of each text is found
    with the scalar logits of all words; only its words get vectors and gradients. The first dimension
    starts at the smoothed log odds of a subword's texts, so that the first windows are telling ones
    (``telling_start``; else all start at random).
    """
    number: dict[str, int] = defaultdict(lambda: len(number))
    words = [np.array([number[w] for w in words_of(t)] or [number["<>"]], np.int32) for t in texts]
    grams = [np.array(subwords(w), np.int32) for w in number]
    flat, owner = np.concatenate(grams), np.repeat(np.arange(len(grams)), [len(g) for g in grams])
    texts_with = np.zeros((2, BUCKETS))
    for own, t in zip(words, toxic, strict=True):
        texts_with[t][np.unique(np.concatenate([grams[i] for i in np.unique(own)]))] += 1
    kept = texts_with.sum(axis=0) >= LEAST_ROWS
    flat, owner = flat[kept[flat]], owner[kept[flat]]
    length = np.bincount(owner, minlength=len(grams))
    begin, share = np.cumsum(length) - length, 1 / np.maximum(length, 1)
    seq, size = np.concatenate(words), np.array([len(w) for w in words])
    n_win = np.maximum(1, size - WINDOW + 1)  # a window from every start
    starts = np.concatenate([np.arange(n) + b for n, b in zip(n_win, np.cumsum(size) - size, strict=True)])
    win_of, span = np.cumsum(n_win) - n_win, np.repeat(np.minimum(size, WINDOW), n_win)
    places = [(np.minimum(starts + i, len(seq) - 1), i < span) for i in range(WINDOW)]
    y = np.array(toxic, float)
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    rng = np.random.default_rng(seed)
    e, w, b = rng.normal(0, 0.01, (BUCKETS, DIMENSIONS)), rng.normal(0, 0.1, (DIMENSIONS, 2)), np.zeros(2)
    if telling_start:
        e[:, 0] = np.log((texts_with[1] + SMOOTH) / (y.sum() + 2 * SMOOTH)) - np.log((texts_with[0] + SMOOTH) / ((1 - y).sum() + 2 * SMOOTH))
        w[0] = (-3.0, 3.0)
        b[1] = -2.0
    g_e, g_w, g_b = np.full(BUCKETS, 1e-10), np.full(w.shape, 1e-10), np.full(2, 1e-10)
    for _ in range(epochs):
        logit = np.bincount(owner, (e @ (w[:, 1] - w[:, 0]))[flat], len(grams)) * share
        of_word = logit[seq]
        score = sum(of_word[at] * has for at, has in places) / span
        best = np.maximum.reduceat(score, win_of)
        hit = np.nonzero(score == np.repeat(best, n_win))[0]
        top = hit[np.unique(np.repeat(np.arange(len(texts)), n_win)[hit], return_index=True)[1]]
        rows = np.concatenate([np.arange(s, s + n) for s, n in zip(starts[top], span[top], strict=True)])
        doc = np.repeat(np.arange(len(texts)), span[top])
        used, word = np.unique(seq[rows], return_inverse=True)
        part = np.concatenate([flat[i : i + n] for i, n in zip(begin[used], length[used], strict=True)])
        of = np.repeat(np.arange(len(used)), length[used])
        pull = share[used][of]
        vec = np.stack([np.bincount(of, e[part, k] * pull, len(used)) for k in range(DIMENSIONS)], axis=1)
        each = 1 / span[top][doc]
        h = np.stack([np.bincount(doc, vec[word, k] * each, len(texts)) for k in range(DIMENSIONS)], axis=1)
        z = h @ w + b
        p1 = 1 / (1 + np.exp(np.clip(z[:, 0] - z[:, 1], -50, 50)))
        err = np.stack([y - p1, p1 - y], axis=1) * weight[:, None]
        d_h = err @ w.T
        touched, at = np.unique(part, return_inverse=True)
        d_word = np.stack([np.bincount(word, d_h[doc, k] * each, len(used)) for k in range(DIMENSIONS)], axis=1)
        d_e = np.stack([np.bincount(at, d_word[of, k] * pull, len(touched)) for k in range(DIMENSIONS)], axis=1)
        d_w, d_b = h.T @ err, err.sum(axis=0)
        g_e[touched] += (d_e**2).mean(axis=1)
        g_w += d_w**2
        g_b += d_b**2
        e[touched] -= rate * d_e / np.sqrt(g_e[touched])[:, None]
        w -= rate * d_w / np.sqrt(g_w)
        b -= rate * d_b / np.sqrt(g_b)
    return np.append(np.where(kept, e @ (w[:, 1] - w[:, 0]), np.nan), b[1] - b[0])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray | None:
    """The model, from at most ``sample`` rows of each class; None if a class has no rows."""
    rows = labels.where(~held_out(0) & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    chosen: dict[int, int] = {}
    for t in (0, 1):
        chosen |= {r["doc_id"]: t for r in rows.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()}
    if set(chosen.values()) != {0, 1}:
        return None
    ids = docs.sparkSession.createDataFrame([(k,) for k in chosen], "doc_id long")
    found = docs.join(F.broadcast(ids), "doc_id", "left_semi").select("doc_id", "text").orderBy("doc_id", "text").collect()  # at most 2 * sample ids
    if {chosen[r["doc_id"]] for r in found} != {0, 1}:
        return None
    return fit([r["text"] or "" for r in found], [chosen[r["doc_id"]] for r in found])


def _steps() -> tuple[np.ndarray, np.ndarray]:
    """CRC-32 goes on by a 32-bit code point as the tables of its lower and upper half, put together."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = (byte >> 1) ^ np.where(byte & 1, np.uint32(0xEDB88320), np.uint32(0))
    out = []
    for shift in (0, 16):
        v = np.arange(1 << 16, dtype=np.uint32) << np.uint32(shift)
        for _ in range(4):
            v = (v >> np.uint32(8)) ^ byte[v & 255]
        out.append(v)
    return out[0], out[1]


def subwords_of_all(words: list[str], steps: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word number) of what ``subwords`` gives for each word: its n-grams by length, then itself."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(len(words)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(code))  # letters from here to the word's end
    low, high = steps
    bucket, of = [], []
    crc, at = np.full(len(code), 0xFFFFFFFF, np.uint32), np.arange(len(code))
    for k in range(1, GRAMS[1] + 1):
        ok = left[at] >= k
        crc, at = crc[ok], at[ok]
        crc ^= code[at + k - 1]
        crc = low[crc & 0xFFFF] ^ high[crc >> 16]
        if k >= GRAMS[0]:
            bucket.append((crc ^ np.uint32(0xFFFFFFFF)).astype(np.int64) % BUCKETS)
            of.append(owner[at])
    bucket.append(np.array([zlib.crc32(w.encode("utf-32-le")) % BUCKETS for w in words], np.int64))
    of.append(np.arange(len(words)))
    return np.concatenate(bucket), np.concatenate(of)


class Scorer:
    """Texts to scores. What stands between white space is looked up once a batch, in a bounded memory of two halves:
    when the newer one is full it becomes the older one, and what is met again moves on."""

    def __init__(self, model: np.ndarray):
        self.model, self.steps, self.seen, self.older = model, _steps(), {}, {}

    def logits(self, words: list[str]) -> np.ndarray:
        """The mean of the logits of each word's learned subwords, 0 without any."""
        bucket, of = subwords_of_all(words, self.steps)
        value = self.model[bucket]
        known = ~np.isnan(value)
        of, value = of[known], value[known]
        return np.bincount(of, value, len(words)) / np.maximum(np.bincount(of, minlength=len(words)), 1)

    def chunks(self, names: list[str]) -> list[bytes]:
        """The logits of each chunk's words, as packed doubles."""
        if len(self.seen) > REMEMBERED // 2:
            self.seen, self.older = {}, self.seen
        seen, older = self.seen, self.older
        out: list = list(map(seen.get, names))
        new = []
        for k in [k for k, v in enumerate(out) if v is None]:
            out[k] = v = older.get(names[k])
            if v is None:
                new.append(k)
            else:
                seen[names[k]] = v
        words = [words_of(names[k]) for k in new]
        different = sorted(set().union(*words))
        if different:
            packed = self.logits(different).tobytes()
            found = {w: packed[8 * i : 8 * i + 8] for i, w in enumerate(different)}
        for k, ws in zip(new, words, strict=True):
            out[k] = b"".join([found[w] for w in ws])
            if len(names[k]) <= LONGEST:
                seen[names[k]] = out[k]
        return out

    def __call__(self, texts: list[str | None]) -> list[float]:
        split = pa.array([(t or "").lower().split() for t in texts], pa.large_list(pa.large_string()))
        coded = split.flatten().dictionary_encode()
        packed = pa.array(self.chunks(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(packed.buffers()[1], np.int64)[split.offsets.to_numpy()] // 8
        d = np.frombuffer(packed.buffers()[2] or b"", np.float64)
        out = []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            worst = 0.0
            if b > a:
                k = min(WINDOW, b - a)
                worst = float(sum(d[a + i : b - k + 1 + i] for i in range(k)).max() / k)
            out.append(float(1 / (1 + np.exp(-np.clip(worst + self.model[-1], -50, 50)))))
        return out


def score(docs: DataFrame, model: np.ndarray | None, keep: list[str] | None = None, into: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``keep`` columns (doc_id by default) with score and predicted."""
    keep = keep or ["doc_id"]
    kinds = dict(docs.dtypes)
    columns = dict.fromkeys([*keep, "text"])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS + 1 numbers
    state: list[Scorer] = []

    def run(x):
        if not state:
            state.append(Scorer(shared.value) if shared.value is not None else lambda texts: [0.0] * len(texts))
        s = state[0](x["text"])
        return {k: x[k] for k in keep} | {into[0]: s, into[1]: [int(v >= 0.5) for v in s]}

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keep)
    return arrow_map(docs.select(*columns), run, f"{schema}, `{into[0]}` double, `{into[1]}` int", TOGETHER)


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    return score(docs, train(docs, labels, sample)).select("doc_id", held_out(0).alias("held_out"), "score", "predicted")

"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 made from its code point. An n-gram is the product
of its letters' vectors, each rolled by its place; a text is the sum of its n-grams, a language
the sum of its training texts' directions, and a text goes to the prototype with the largest
cosine. Prototypes are learned from at most ``per_lang`` labelled rows of each language, chosen
by a hash of the id, and summed where the rows are; only the sums reach the driver.

Defined cases: null texts and texts without a letter (``\\p{L}``: numerals such as "½" or "Ⅻ" are none) are ``und`` with score 0; ties go to the
language that sorts first; a very long text is one sum of n-grams; repeated rows count and are predicted each; columns named like the
results are kept under ``keep`` only if ``into`` names others; with no training rows all are ``und``; an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, held_out

DIMENSIONS, GRAM, PER_LANG, CELLS = 1024, 3, 3000, 4096
_GAPS, _LETTER = regex.compile(r"[^\p{L}\p{M}]+"), regex.compile(r"\p{L}")
_letters: dict[int, np.ndarray] = {}
_grams: dict[int, np.ndarray] = {}


def letter(code: int) -> np.ndarray:
    if code not in _letters:
        _letters[code] = np.random.default_rng(code + 1).choice(np.array([-1, 1], np.int8), DIMENSIONS)
    return _letters[code]


def gram(key: int) -> np.ndarray:
    """``key``: code points, 21 bits each."""
    if key not in _grams:
        if len(_grams) > 20_000:
            _grams.clear()
        codes = [key >> 21 * i & 0x1FFFFF for i in range(GRAM)]
        v = np.ones(DIMENSIONS, np.int8)
        for i, c in enumerate(codes):
            v = v * np.roll(letter(c), i)
        _grams[key] = v
    return _grams[key]


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of the n-grams of letters and their marks; words are apart by one blank."""
    words = _GAPS.sub(" ", (text or "").lower()).strip()
    if not _LETTER.search(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a = np.frombuffer(f" {words} ".encode("utf-32-le"), "<u4").astype(np.int64)
    return np.unique(a[:-2] | a[1:-1] << 21 | a[2:] << 42, return_counts=True)


def bundle(texts: list[str | None]) -> np.ndarray:
    """A unit vector for every text, zero where there is no letter."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for begin in range(0, len(texts), 64):
        counted = [gram_counts(t) for t in texts[begin : begin + 64]]
        keys = np.unique(np.concatenate([k for k, _ in counted]))
        for low in range(0, len(keys), 2048):
            part = keys[low : low + 2048]
            weight = np.zeros((len(counted), len(part)), np.float32)
            for i, (k, n) in enumerate(counted):
                at = np.searchsorted(part, k)
                ok = (at < len(part)) & (part[np.minimum(at, len(part) - 1)] == k)
                weight[i, at[ok]] = n[ok]
            out[begin : begin + len(counted)] += weight @ np.stack([gram(k) for k in part.tolist()]).astype(np.float32)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def train(docs: DataFrame, per_lang: int = PER_LANG) -> tuple[list[str], np.ndarray]:
    """Language names in order, and their unit prototypes."""
    cell = F.pmod(F.xxhash64("doc_id"), F.lit(CELLS))
    rows = docs.where(~held_out(0) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = rows.groupBy("lang", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).orderBy("lang", "cell").collect()
    upto: dict[str, int] = {}
    total: dict[str, int] = defaultdict(int)
    for r in counts:  # whole cells, until a language has enough
        if total[r["lang"]] < per_lang:
            total[r["lang"]] += r["n"]
            upto[r["lang"]] = r["cell"]
    if not upto:
        return [], np.zeros((0, DIMENSIONS), np.float32)
    limit = F.create_map(*[F.lit(x) for kv in sorted(upto.items()) for x in kv])
    chosen = rows.where(cell <= limit[F.col("lang")]).select("lang", "text")

    def run(x):
        v, names = bundle(x["text"]), sorted(set(x["lang"]))
        lang = np.array(x["lang"], object)
        return {"lang": names, "v": [v[lang == n].sum(axis=0, dtype=np.float64) for n in names]}

    sums: dict[str, np.ndarray] = {}
    parts = arrow_map(chosen, run, "lang string, v array<double>").select("lang", F.posexplode("v").alias("i", "v"))
    for r in parts.groupBy("lang", "i").agg(F.sum("v").alias("v")).collect():  # languages x dimensions
        sums.setdefault(r["lang"], np.zeros(DIMENSIONS))[r["i"]] = r["v"]
    names = sorted(sums)
    return names, np.stack([sums[n] / max(np.linalg.norm(sums[n]), 1e-9) for n in names]).astype(np.float32)


def predict(docs: DataFrame, names: list[str], prototypes: np.ndarray, keep: list[str] | None = None, into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` columns (doc_id by default) with lang_pred and score, the cosine cut to 0 to 1."""
    keep = keep or ["doc_id"]
    kinds = dict(docs.dtypes)
    columns = dict.fromkeys([*keep, "text"])

    def run(x):
        v = bundle(x["text"])
        out = {k: x[k] for k in keep}
        cosine = v @ prototypes.T if len(names) else np.zeros((len(v), 1))
        best = cosine.argmax(axis=1)
        some = np.any(v != 0, axis=1) if len(names) else np.zeros(len(v), bool)
        out[into[0]] = [names[b] if s else "und" for b, s in zip(best, some, strict=True)]
        out[into[1]] = [float(min(1.0, max(0.0, c))) if s else 0.0 for c, s in zip(cosine[np.arange(len(v)), best], some, strict=True)]
        return out

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keep)
    return arrow_map(docs.select(*columns), run, f"{schema}, `{into[0]}` string, `{into[1]}` double")


def identify(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    names, prototypes = train(docs, per_lang)
    return predict(docs, names, prototypes).select("doc_id", held_out(0).alias("held_out"), "lang_pred", "score")

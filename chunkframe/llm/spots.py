"""Document fingerprints by SpotSigs.

A spot is a common word (the anchor) with the chain of the next ``CHAIN`` content words. A
text's fingerprint is the set of its spots' 32-bit hashes, with the set's length in front. Texts
without a spot use chains behind every word, texts with fewer words than that their words, and
texts without words their raw characters, so equal texts always agree and others rarely do.
Fingerprints are compared by Jaccard similarity, pruned by the two lengths first. ``near_classes``
joins all texts by their spots: inverted lists of a set's rarest spots, in partitions of the set's length.

Defined cases: a null text is the empty text; two empty texts are alike (1.0); repeated ids, ties included, are
ordered by text; rows with a null id come last, ordered by a hash of the text; a very long text is one set of spots, and
its edited text is as long as its half and the next one's start; other columns, whatever their names, are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import similar
from .common import prepare

CHAIN, REMEMBERED = 2, 150_000
# Common words of English, German, French and Spanish.
ANCHORS = frozenset(
    "a an and are as at be but by for from had has have he her his i in is it its not of on or that the their they this to was were which with you "
    "aber als am auch auf aus bei das dem den der des die dies ein eine einen er es für ich im ist mit nach nicht oder sich sie sind so und von war wie zu zum "
    "au aux avec ce ces dans de du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous "
    "al como con cuando del el ella ellos entre era esta este fue hay la las lo los más muy no o para pero por qué que se ser si sin sobre su sus también una uno y ya".split()
)
_WORD = re.compile(r"[^\W_]+")
_hashes: dict[str, int] = {}
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _numbers(words: list[str]) -> np.ndarray:
    if len(_hashes) > REMEMBERED:
        _hashes.clear()
    for w in set(words).difference(_hashes):
        raw = w.encode()
        _hashes[w] = ((zlib.crc32(raw) << 32 | zlib.adler32(raw)) & ~1) | (w in ANCHORS)
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words)) if words else np.zeros(0, np.uint64)


def _chains(*parts: np.ndarray) -> np.ndarray:
    h = np.zeros(len(parts[0]), np.uint64)
    for m, p in zip(_MIX, parts, strict=False):
        h = (h ^ (p + np.uint64(1))) * m
        h ^= h >> np.uint64(29)
    return np.unique((h >> np.uint64(32)).astype(np.uint32))


def spots(text: str | None) -> np.ndarray:
    """The sorted distinct spot hashes of a text."""
    h = _numbers(_WORD.findall((text or "").lower()))
    anchor = (h & np.uint64(1)).astype(bool)
    content = h[~anchor]
    after = np.cumsum(~anchor)[anchor]  # place of the first content word behind each anchor
    whole = after + CHAIN <= len(content)
    if whole.any():
        after = after[whole]
        return _chains(h[anchor][whole], content[after], content[after + 1])
    if len(h) > CHAIN:
        return _chains(h[:-2], h[1:-1], h[2:])
    if len(h):
        return _chains(h)
    return np.array([zlib.crc32((text or "").encode())], np.uint32)


def fingerprint(found: np.ndarray) -> str:
    return f"{len(found)}:{base64.b64encode(found.astype('<u4').tobytes()).decode()}"


def jaccard(a: np.ndarray, b: np.ndarray, at_least: float = 0.0) -> float:
    """Similarity of two sorted sets; 0 without a look at them if their lengths rule ``at_least`` out."""
    if min(len(a), len(b)) < at_least * max(len(a), len(b)):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    all_ = len(a) + len(b) - both
    s = both / all_ if all_ else 1.0
    return s if s >= at_least else 0.0


def length_partitions(longest: int, threshold: float) -> list[int]:
    """Lower bounds of set-length partitions so wide that similar sets are in the same one or the next."""
    bounds, low = [1], 1
    while low <= longest:
        low = max(low + 1, int(low / threshold) + 1)
        bounds.append(low)
    return bounds


def with_next(docs: DataFrame, per_task: int = 16) -> DataFrame:
    """(bucket, extra, at, text, doc_id): rows in ranges of ``at``, each range with the row that follows it.

    ``at`` is the id, or for rows without one a hash of the text; these have as many ranges below the others. Going down, the
    row after the last of a range is the first of the range below; it is sent there a second time
    (``extra``). The lowest range gets the very first row. The driver holds one number per range; texts are shuffled once.
    """
    spark = docs.sparkSession
    ranges = per_task * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select("doc_id").where("doc_id is not null")
    bounds = sorted(set(ids.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges)))) if not ids.isEmpty() else []
    cuts = np.array(bounds, np.float64)
    wide = -(-(1 << 64) // ranges)

    @F.arrow_udf("long")
    def range_of(at: pa.Array, named: pa.Array) -> pa.Array:
        a, has = at.to_numpy(zero_copy_only=False), named.to_numpy(zero_copy_only=False)
        by_id = np.searchsorted(cuts, a.astype(np.float64), side="right") + 1
        by_hash = ((a.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)) // np.uint64(wide)).astype(np.int64) - ranges
        return pa.array(np.where(has.astype(bool), by_id, by_hash).astype(np.int64))

    at = F.coalesce("doc_id", F.xxhash64("text"))
    rows = docs.select("doc_id", "text", at.alias("at"), range_of(at, F.col("doc_id").isNotNull()).alias("bucket"))
    top = {r["bucket"]: r["top"] for r in rows.select("bucket", "at").groupBy("bucket").agg(F.max("at").alias("top")).collect()}
    used = sorted(top)
    send = {b: used[(i + 1) % len(used)] for i, b in enumerate(used)}  # the range above; the highest sends to the lowest

    @F.arrow_udf("array<struct<bucket:long,extra:boolean>>")
    def targets(at: pa.Array, bucket: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("bucket", pa.int64()), ("extra", pa.bool_())]))
        to = [[(b, False), (send[b], True)] if a == top[b] else [(b, False)] for a, b in zip(at.to_pylist(), bucket.to_pylist(), strict=True)]
        return pa.array([[{"bucket": b, "extra": e} for b, e in t] for t in to], kind)

    return rows.withColumn("to", F.explode(targets("at", "bucket"))).select("to.bucket", "to.extra", "at", "text", "doc_id")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose end is replaced by the next text's start."""
    prepare(docs.sparkSession)
    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_spots", "length_partition")
    kinds = dict(zip(names, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()), strict=True))
    bounds = length_partitions(1 << 40, 0.8)

    def emit(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds[n]) for i, n in enumerate(names)], names=list(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = None, []  # the row that waits for the next one of its range, with its spots

        def done(row, text: str, found: np.ndarray) -> tuple:
            _, doc_id, own, mine = row
            n = len(own)
            edited = own[: n - n // 2] + text[: n // 2]
            other = spots(edited)
            return (doc_id, n, hashlib.sha256(edited.encode()).hexdigest(), fingerprint(mine), fingerprint(other), jaccard(mine, other), jaccard(mine, found), len(mine), int(np.searchsorted(bounds, len(mine), side="right")))

        for batch in batches:
            for bucket, extra, _, text, doc_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = text or ""
                if held is not None and held[0] == bucket:
                    found = spots(text)
                    out.append(done(held, text, found))
                    held = None if extra else (bucket, doc_id, text, found)
                elif not extra:
                    held = (bucket, doc_id, text, spots(text))
            if out:
                yield emit(out)
                out = []

    moved = with_next(docs).repartition("bucket").sortWithinPartitions("bucket", "extra", F.desc("at"), F.desc_nulls_last("text"))
    return moved.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_spots long, length_partition long")


def mixed_spots(text: str | None) -> np.ndarray:
    """The spots of a text as sorted 64-bit hashes."""
    h = spots(text).astype(np.uint64) * _MIX[0]
    h ^= h >> np.uint64(29)
    h *= _MIX[1]
    return np.unique(h ^ h >> np.uint64(32))


def near_classes(docs: DataFrame, at_least: int = 80) -> DataFrame:
    """(doc_id, n_spots, class_id): texts whose spot sets have a Jaccard similarity of ``at_least`` per cent share a class, and chains of them.

    The join is that of ``similar``: each set is listed under its rarest spots only, lists are cut by set length
    into partitions as wide as the threshold allows, and lengths and places rule out pairs before sets are compared.
    """
    return similar.similar_components(docs, at_least, features=mixed_spots).withColumnsRenamed({"n_shingles": "n_spots", "component_id": "class_id"})

"""Fill-in-middle over an index of distinct texts, whose line boundaries are computed once and kept as Elias-Fano lists.

Texts meet under the SHA-256 of their bytes. What is found under a digest is compared by content: a digest with two different
texts stops the job, so documents that share an entry have the same text. The text of an entry travels once, combined
before the shuffle; of each document only its id and digest do, gathered by digest and joined to the entry where it lies. An entry's
boundaries (where each line ends, in code points) are packed once as an Elias-Fano list of about 2 + log2(length of a line) bits for
each line; each of its documents then selects its two cuts from that list by its seed. The ids are the side that is built into a table
of hashes; texts are not sorted for the join.

Texts with very many copies are dealt over several tasks: a digest with more than ``HOT`` rows and at least one of
``HOT_SHARE`` of all has one entry for every ``HOT`` rows. There are at most ``HOT_SHARE`` such digests, whatever the size of the
table; only they go through the driver, as digests and counts.

Defined cases: a null text counts as empty and is left plain, like one with a marker in it; a null id has the seed of no digits
(``7:``); repeated rows are cut alike; a text without a line break is one line; a very long one is one entry; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from .common import BATCH_ROWS, give_back, prepare, scratch, written

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Documents in a hundred that are cut, and those of them with the suffix first.
RATE, SUFFIX_FIRST, SEED = 100, 50, "7"
HOT, HOT_SHARE = 64, 10_000
#: Documents of one text that go to a worker together at most.
PIECE = 1024
#: One place of the upper bits is noted for so many boundaries.
_STRIDE = 64


class EliasFano:
    """A rising list of whole numbers: low bits packed, high bits as a unary row of bits; ``get`` reads one of them.

    As bytes: length, number of low bits, then the bit position of every 64th one, the low bits, the high bits.
    """

    def __init__(self, data: bytes):
        self.n, self.low = (int(v) for v in np.frombuffer(data, "<u4", 2))
        self._data, self._notes_at = data, 8
        self._low_at = 8 + 4 * -(-self.n // _STRIDE)
        self._high_at = self._low_at + -(-self.n * self.low // 8)

    @staticmethod
    def pack(values: np.ndarray) -> bytes:
        """``values``: rising whole numbers from 0."""
        n = len(values)
        values = np.asarray(values, np.int64)
        top = int(values[-1]) if n else 0
        low = max((top // n).bit_length() - 1, 0) if n else 0
        ones = (values >> low) + np.arange(n)
        if n and int(ones[-1]) >= 1 << 32:
            raise OverflowError("a text beyond 32 bits")
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        bits = (values[:, None] >> np.arange(low) & 1).astype(np.uint8).ravel()
        parts = [np.array([n, low], "<u4"), ones[::_STRIDE].astype("<u4"), np.packbits(bits, bitorder="little"), np.packbits(high, bitorder="little")]
        return b"".join(p.tobytes() for p in parts)

    def get(self, i: int) -> int:
        """The value at place ``i``: a jump to the noted one before it, then a count of ones."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        start = int(np.frombuffer(self._data, "<u4", 1, self._notes_at + 4 * (i // _STRIDE))[0])
        skip, at = i % _STRIDE, self._high_at + start // 8
        byte = self._data[at] >> start % 8 << start % 8
        while (ones := byte.bit_count()) <= skip:
            skip, at = skip - ones, at + 1
            byte = self._data[at]
        for _ in range(skip):
            byte &= byte - 1
        place = (at - self._high_at) * 8 + (byte & -byte).bit_length() - 1
        first = i * self.low
        word = int.from_bytes(self._data[self._low_at + first // 8 : self._low_at + (first + self.low + 7) // 8], "little")
        return place - i << self.low | word >> first % 8 & (1 << self.low) - 1


def line_ends(text: str) -> np.ndarray:
    """Where each line ends, in code points; the last one may lack its line break."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.flatnonzero(points == 10) + 1
    return ends if not len(points) or (len(ends) and ends[-1] == len(points)) else np.append(ends, len(points))


def seeds(doc_id: int | None) -> list[int]:
    """h1 to h4 of a document."""
    told = hashlib.sha256(f"{SEED}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(told[i : i + 8], 16) for i in range(0, 32, 8)]


def form_of(text: str, h: list[int], rate: int = RATE) -> str:
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= rate:
        return "plain"
    return "spm" if h[3] % 100 < SUFFIX_FIRST else "psm"


def cuts(ends: EliasFano, h: list[int]) -> tuple[int, int]:
    """Where the prefix and the middle end, in code points."""
    units = sorted(v % (ends.n + 1) for v in h[:2])
    first, second = (ends.get(u - 1) if u else 0 for u in units)
    return first, second


def arrange(text: str, form: str, first: int, second: int) -> str:
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if form == "psm":
        return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}" if form == "spm" else text


def restore(output: str, form: str) -> str:
    """The text, from an output and its form alone: texts that have a marker in them stay plain."""
    if form == "plain":
        return output
    marks = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    head, _, middle = output.partition(MIDDLE)
    one, _, two = head.removeprefix(marks[0]).partition(marks[1])
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return prefix + middle + suffix


@F.arrow_udf(BinaryType())
def boundaries(texts: pa.Array) -> pa.Array:
    return pa.array([EliasFano.pack(line_ends(t)) for t in texts.to_pylist()], pa.binary())


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def distinct(texts: DataFrame) -> DataFrame:
    """(digest, text) of the distinct texts of ``texts`` (digest, text), verified by content."""
    found = texts.groupBy("digest").agg(F.collect_set("text").alias("texts"))
    one = F.when(F.size("texts") == 1, F.get("texts", F.lit(0))).otherwise(F.raise_error(F.lit("two texts with one SHA-256")))
    return found.select("digest", one.alias("text"))


def index(docs: DataFrame) -> DataFrame:
    """(digest, text, ends): the distinct texts of ``docs`` with their packed boundaries, as a table."""
    text = F.coalesce("text", F.lit(""))
    return distinct(docs.select(text.alias("text")).select(digest(F.col("text")).alias("digest"), "text")).withColumn("ends", boundaries("text"))


def entries(docs: DataFrame, hot: int = HOT, hot_share: int = HOT_SHARE) -> DataFrame:
    """(text, ids) of ``docs`` (doc_id, text): each distinct text with the documents that have it, ``hot`` or so in a row where they are very many.

    The join is by digest, which is what the texts were grouped by, so it moves ids only.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    texts = docs.select(text.alias("text")).select(digest(F.col("text")).alias("digest"), "text")
    rows = written(docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id")).alias("id"), digest(text).alias("digest")), "rows")
    least = max(hot, rows.count() // hot_share)
    many = rows.groupBy("digest").count().where(F.col("count") > least).collect()  # at most ``hot_share``, a row each
    few_rows, few_texts = rows, texts
    if many:
        groups = [(bytes(r["digest"]), -(-r["count"] // hot)) for r in many]
        dealt = F.broadcast(spark.createDataFrame(groups, StructType([StructField("digest", BinaryType()), StructField("dealt", IntegerType())])))
        few_rows, few_texts = (df.join(dealt, "digest", "left_anti") for df in (rows, texts))
    listed = few_rows.groupBy("digest").agg(F.collect_list("id").alias("ids"))  # at most ``least`` of a digest
    out = listed.hint("shuffle_hash").join(distinct(few_texts), "digest").select("text", "ids")
    if many:
        salted = rows.join(dealt, "digest").withColumn("salt", F.floor(F.rand(7) * F.col("dealt")).cast("int")).groupBy("digest", "salt").agg(F.collect_list("id").alias("ids"))
        copies = distinct(texts.join(dealt.select("digest"), "digest", "left_semi")).join(dealt, "digest")
        copies = copies.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("dealt") - 1))).drop("dealt")
        out = out.union(salted.hint("shuffle_hash").join(copies, ["digest", "salt"]).select("text", "ids"))
    pieces = F.transform(F.sequence(F.lit(1), F.size("ids"), F.lit(PIECE)), lambda i: F.slice("ids", i, PIECE))
    return out.select("text", F.explode(pieces).alias("ids"))


def rendered(docs: DataFrame, rate: int = RATE) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row: the operator's own output."""
    return _cut(docs, rate, {"output": (pa.string(), lambda out, form: out)})


def fill_in_middle(docs: DataFrame, rate: int = RATE) -> DataFrame:
    """The same with digests of the output and of the text that is rebuilt from it."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return _cut(docs, rate, {"output_sha256": (pa.string(), lambda out, form: sha(out)), "restored_sha256": (pa.string(), lambda out, form: sha(restore(out, form)))})


def _cut(docs: DataFrame, rate: int, more: dict) -> DataFrame:
    kinds = {"doc_id": pa.int64(), "n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64()} | {k: v[0] for k, v in more.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def emit() -> pa.RecordBatch:
            columns = [pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds.values(), strict=True)]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=list(kinds))

        for batch in batches:
            for text, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ends = EliasFano(EliasFano.pack(line_ends(text)))  # once for the text
                for doc_id in (i["doc_id"] for i in ids):
                    h = seeds(doc_id)
                    form = form_of(text, h, rate)
                    first, second = cuts(ends, h) if form != "plain" else (None, None)
                    output = arrange(text, form, first, second)
                    held.append((doc_id, ends.n, form, first, None if first is None else second - first, *(f(output, form) for _, f in more.values())))
                if len(held) >= BATCH_ROWS:
                    yield emit()
        if held:
            yield emit()
        give_back()

    prepare(docs.sparkSession)
    with scratch(docs.sparkSession, keep=("rows",)):
        return entries(docs).mapInArrow(run, ", ".join(f"{n} {'string' if k == pa.string() else 'long'}" for n, k in kinds.items()))


MIDDLE_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
h AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') AS lines,
    CAST('0x' || substr(s, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(s, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(s, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(s, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, len(lines) AS n, least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS a, greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, coalesce(array_to_string(lines[1:a], ''), '') AS prefix, coalesce(array_to_string(lines[a + 1:b], ''), '') AS middle, coalesce(array_to_string(lines[b + 1:n], ''), '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM p
"""

"""Chat logs: collapse cumulative snapshots, then render what is left.

A log that repeats an earlier one and adds turns makes the earlier one redundant. Every turn has
a hash of its place, role and text; the sum of the hashes up to a turn (two 64-bit hashes, each
kept as two exact sums of 32-bit halves) names that prefix. Turns are sorted once over the whole
table; a block is what one sorted partition holds of a conversation, and places and sums come from those of
the blocks before, so one huge conversation is shared out. Conversations whose full sum is a proper
prefix of a longer one go by anti-join; equal ones keep the smallest id and the number of copies.
Only DataFrame functions run here.

Defined cases: the place of a turn is its rank by turn, role and text (nulls first) and a null
role or text differs from an empty one; a very long turn is hashed whole; rows with a null conv_id form one
conversation, spread like any long one; of conversations that tie, the smallest id stays, null before any; an empty table gives an
empty result; repeated rows are turns of their own, and copies of one turn are spread too (those that share conv_id, turn, role and
``SORTED`` or more first letters are sorted in one task); other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Letters of a text that choose its partition in the sort, and turns of a rendered row.
SORTED, SEGMENT = 256, 64


def placed(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns with ``conv_id, block, at`` in their order, and ``conv_id, block, base, first, last`` of every block.

    The place of a turn is ``base + at - first``; ``last`` is the last place of its conversation. Ranges of the sort are
    chosen by the start of a text, so that what is sampled for them stays small; a text that is shorter is known
    whole there, and its copies may go to several partitions.
    """
    keys = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role")]
    start, copy = F.substring("text", 1, SORTED), F.when(F.length("text") >= SORTED, F.lit(0)).otherwise(F.monotonically_increasing_id())
    rows = turns.select("conv_id", "turn", "role", "text", start.alias("start"), copy.alias("copy"))
    spread = rows.repartitionByRange(*keys, F.asc_nulls_first("start"), "copy").sortWithinPartitions(*keys, F.asc_nulls_first("text"))
    at = F.monotonically_increasing_id()  # the partition's number, then that of the row in it
    rows = written(spread.select("conv_id", "role", "text", at.alias("at")).withColumn("block", F.shiftright("at", 33)), "turns")
    of_conv = Window.partitionBy("conv_id")
    before = of_conv.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    base = F.coalesce(F.sum("n").over(before), F.lit(0))
    return rows, blocks.select("conv_id", "block", base.alias("base"), "first", (F.sum("n").over(of_conv) - 1).alias("last"))


def with_block(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows joined with the columns of their blocks; a long conversation has many blocks, so no key is hot."""
    b = blocks.select(*[F.col(c).alias(f"{c}_b" if c in ("conv_id", "block") else c) for c in blocks.columns])
    return rows.join(b, F.col("conv_id").eqNullSafe(F.col("conv_id_b")) & (F.col("block") == F.col("block_b"))).drop("conv_id_b", "block_b")


def prefixes(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv_id, block, place, last, role, text`` of the turns, and ``conv_id, place, last, key``, the names of the conversations up to them."""
    rows, blocks = placed(turns)
    rows = with_block(rows, blocks).withColumn("place", F.col("base") + F.col("at") - F.col("first"))
    said = F.to_json(F.struct("place", "role", "text"))
    one, two = F.xxhash64(said), F.xxhash64(F.lit("second"), said, F.length("text"))
    halves = {"h0": one.bitwiseAND(0xFFFFFFFF), "h1": F.shiftrightunsigned(one, 32), "h2": two.bitwiseAND(0xFFFFFFFF), "h3": F.shiftrightunsigned(two, 32)}
    upto = Window.partitionBy("conv_id", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    summed = written(rows.withColumns(halves).select("conv_id", "block", "place", "last", "role", "text", *[F.sum(h).over(upto).alias(h) for h in halves]), "sums")
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = summed.groupBy("conv_id", "block").agg(*[F.max(h).alias(h) for h in halves])  # sums only grow
    totals = totals.select("conv_id", "block", *[F.coalesce(F.sum(h).over(before), F.lit(0)).alias(f"{h}_base") for h in halves])
    key = F.concat_ws("-", F.col("place") + 1, *[F.col(h) + F.col(f"{h}_base") for h in halves])
    return summed.drop(*halves), with_block(summed.drop("role", "text"), totals).select("conv_id", "place", "last", key.alias("key"))


def maximal(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All turns, and (conv_id, n_turns, copies) of conversations that no longer one starts with."""
    rows, keys = prefixes(turns)
    whole = keys.where("place = last").groupBy("key").agg(F.min_by("conv_id", F.struct(F.col("conv_id").isNotNull(), "conv_id")).alias("conv_id"), F.max("last").alias("last"), F.count(F.lit(1)).alias("copies"))
    proper = keys.where("place < last").select("key").distinct()
    kept = whole.join(proper, "key", "left_anti").select("conv_id", (F.col("last") + 1).alias("n_turns"), "copies")
    return rows, kept


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, segment, n_turns, copies, text): kept conversations in the chat format, at most ``SEGMENT`` turns a row."""
    rows, kept = maximal(turns)
    kept = kept.withColumnRenamed("conv_id", "kept_id")
    blocks = rows.select("conv_id", "block").distinct().join(kept, F.col("conv_id").eqNullSafe(F.col("kept_id"))).drop("kept_id")
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n<|end|>\n"))
    return (
        with_block(rows, blocks)
        .groupBy("conv_id", F.floor(F.col("place") / SEGMENT).alias("segment"))
        .agg(F.max("n_turns").alias("n_turns"), F.max("copies").alias("copies"), F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("said"))
        .select("conv_id", "segment", "n_turns", "copies", F.concat_ws("", F.col("said.line")).alias("text"))
    )


#: The same rows for DuckDB: prefixes as digests of everything said up to a turn.
RENDER_SQL = """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS place, role, text FROM conversations),
said AS (SELECT *, string_agg(md5(coalesce('r' || role, 'n') || chr(1) || coalesce('t' || text, 'n')), ',') OVER (PARTITION BY conv_id ORDER BY place) AS upto FROM t),
p AS (SELECT *, md5(upto) AS key, max(place) OVER (PARTITION BY conv_id) AS last FROM said),
whole AS (SELECT key, min(conv_id) AS conv_id, max(last) AS last, count(*) AS copies FROM p WHERE place = last GROUP BY key),
kept AS (SELECT * FROM whole WHERE key NOT IN (SELECT key FROM p WHERE place < last))
SELECT p.conv_id, CAST(p.place // 64 AS BIGINT) AS segment, CAST(max(kept.last) + 1 AS BIGINT) AS n_turns, CAST(max(kept.copies) AS BIGINT) AS copies,
  string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10), '' ORDER BY p.place) AS text
FROM p JOIN kept ON p.conv_id IS NOT DISTINCT FROM kept.conv_id GROUP BY p.conv_id, p.place // 64
"""

"""Quality rules as a short-circuit cascade: the order comes from a sample, the verdict from every rule that is reached.

A rule looks at a text and rejects it or not. On a sample every rule runs on every text, timed: its cost is the mean
time, and each text leaves the set of rules that reject it. The order is greedy: next comes the rule that
rejects most of what the rules before it let through, for its cost; so a rule that repeats a cheaper one goes to the end.
Then every document runs through the rules in that order and stops at the first that rejects it. A verdict is whether
any rule rejects, so it is the same in any order, and times decide only what it costs.

Every rule is a statement about whole numbers counted in the whole text, so SQL can say it too.

Defined cases: a null text has no words, like an empty one or one of white space; nothing divides by its counts, so
rules let it through (the base conditions reject it, having fewer than 50 words); a very long text is counted whole; repeated rows are
judged alike; null ids are kept; other columns are ignored, or kept where asked for; an empty table gives an empty
result, with the rules in the order they were given; rules that cost or reject the same stay in that order.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, give_back, prepare

# ASCII white space, characters of markup and tables, least words of a document.
BLANKS = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
#: Texts that costs and selectivities are estimated on, at most about so many (whole cells of a hash of the text).
SAMPLE = 4000
_CELLS = 1 << 20


class Text:
    """What rules count in a text, each thing at most once."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode("utf-8", "surrogatepass").split()  # bytes: ASCII white space only

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, BLANKS))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        """The lines with a word."""
        return [line for line in self.text.split("\n") if line.strip(BLANKS)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in a window of three that the text has twice or more."""
        words = self.words
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) == len(windows):
            return 0
        counts, covered, end = Counter(windows), 0, 0
        for i, w in enumerate(windows):
            if counts[w] > 1:
                covered += i + 3 - max(i, end)
                end = i + 3
        return covered

    @cached_property
    def n_shouted(self) -> int:
        return sum(w.endswith(b"!!") for w in self.words)

    @cached_property
    def n_lettered(self) -> int:
        """Words with a letter."""
        return sum(w.isalpha() or any(map(str.isalpha, w.decode("utf-8", "replace"))) for w in self.words)

    @cached_property
    def n_dots(self) -> int:
        """Lines that trail off."""
        return sum(line.rstrip(BLANKS).endswith(("...", "…")) for line in self.lines)

    @cached_property
    def n_bullets(self) -> int:
        return sum(line.lstrip(BLANKS).startswith(("-", "*", "•")) for line in self.lines)

    @cached_property
    def base_failed(self) -> bool:
        return self.n_words < LEAST_WORDS or 100 * self.n_repeat_words > 50 * self.n_words


@dataclass(frozen=True)
class Rule:
    """A name, whether it rejects a text, and the same in SQL over the counts of ``JUDGE_SQL``."""

    name: str
    rejects: Callable[[Text], bool]
    sql: str


RULES = (
    Rule("symbols", lambda t: 100 * t.n_symbols > 10 * t.n_words, "100 * n_symbols > 10 * n_words"),
    Rule("short_words", lambda t: t.word_chars < 2 * t.n_words, "word_chars < 2 * n_words"),
    Rule("long_words", lambda t: t.word_chars > 15 * t.n_words, "word_chars > 15 * n_words"),
    Rule("repeated_lines", lambda t: 100 * t.n_dup_lines > 30 * len(t.lines), "100 * n_dup_lines > 30 * n_lines"),
    Rule("shouting", lambda t: 100 * t.n_shouted > 30 * t.n_words, "100 * n_shouted > 30 * n_words"),
    Rule("few_letters", lambda t: 100 * t.n_lettered < 70 * t.n_words, "100 * n_lettered < 70 * n_words"),
    Rule("trailing_dots", lambda t: 100 * t.n_dots > 30 * len(t.lines), "100 * n_dots > 30 * n_lines"),
    Rule("bullets", lambda t: 100 * t.n_bullets > 90 * len(t.lines), "100 * n_bullets > 90 * n_lines"),
)


@dataclass(frozen=True)
class Step:
    """A rule in its place: the seconds it takes for a text, and the share it rejects of what comes to it, in the sample."""

    rule: Rule
    cost: float
    rejection: float


def sampled(docs: DataFrame, most: int = SAMPLE) -> DataFrame:
    """About ``most`` rows, or all of a smaller table: the lowest cells of a hash of the text and id.

    Rows of one id and text share a cell, so many copies of one row come or stay out together; ``limit`` bounds what they bring.
    """
    n = docs.count()
    if n <= most:
        return docs
    cell = F.pmod(F.xxhash64("doc_id", "text"), F.lit(_CELLS))
    return docs.where(cell < F.lit(most * _CELLS // n)).limit(2 * most)


def planned(docs: DataFrame, rules: Sequence[Rule] = RULES, most: int = SAMPLE, clock: Callable[[], float] = time.perf_counter) -> list[Step]:
    """The rules in the order of rejections for their cost, from a sample of ``docs`` (doc_id, text).

    The driver gets one row for each set of rules that reject a text, with its texts and times: at most one a sampled text.
    """
    prepare(docs.sparkSession)
    count = len(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks: dict[int, list] = {}
        for batch in batches:
            for value in batch.column(0).to_pylist():
                mask, times = 0, []
                for i, rule in enumerate(rules):
                    text = Text(value)  # anew, so that no rule pays for another's counts
                    start = clock()
                    mask |= bool(rule.rejects(text)) << i
                    times.append(clock() - start)
                held = masks.setdefault(mask, [0, [0.0] * count])
                held[0] += 1
                held[1] = [a + b for a, b in zip(held[1], times, strict=True)]
        if masks:
            columns = [pa.array(list(masks)), pa.array([n for n, _ in masks.values()]), pa.array([t for _, t in masks.values()])]
            yield pa.RecordBatch.from_arrays(columns, names=["mask", "n", "times"])

    if not 0 < count < 63:
        raise ValueError("one to 62 rules")
    seen = sampled(docs.select("doc_id", "text"), most).select("text").mapInArrow(run, "mask long, n long, times array<double>")
    sums = [F.sum(F.get("times", F.lit(i))).alias(f"t{i}") for i in range(count)]
    rows = seen.groupBy("mask").agg(F.sum("n").alias("n"), *sums).collect()
    total = sum(r["n"] for r in rows)
    costs = [max(sum(r[f"t{i}"] for r in rows) / total, 1e-9) if total else 1e-9 for i in range(count)]
    return ordered(rules, costs, {r["mask"]: r["n"] for r in rows})


def ordered(rules: Sequence[Rule], costs: Sequence[float], masks: dict[int, int]) -> list[Step]:
    """Greedily the rule with most rejections for its cost, of the texts (``masks``: sets of rejecting rules, counted) left by those before."""
    left, open_, steps = dict(masks), list(range(len(rules))), []
    while open_:
        gains = {i: sum(n for m, n in left.items() if m >> i & 1) for i in open_}
        best = max(open_, key=lambda i: (gains[i] / costs[i], -costs[i] if not gains[i] else 0.0, -i))
        total = sum(left.values())
        steps.append(Step(rules[best], costs[best], gains[best] / total if total else 0.0))
        left = {m: n for m, n in left.items() if not m >> best & 1}
        open_.remove(best)
    return steps


def cascade(docs: DataFrame, steps: Sequence[Step], keep: Sequence[str] = ("doc_id",), into: tuple[str, str] = ("rejected_by", "rules_run")) -> DataFrame:
    """``keep`` of every row with the first rule that rejects it (null: none does) and how many rules were run."""
    prepare(docs.sparkSession)
    rules = [s.rule for s in steps]
    text = fresh(docs, "_text")

    @F.arrow_udf("struct<rejected_by:string,rules_run:int>")
    def verdict(texts: pa.Array) -> pa.Array:
        out = []
        for value in texts.to_pylist():
            t = Text(value)
            at = next((i for i, rule in enumerate(rules) if rule.rejects(t)), None)
            out.append({"rejected_by": None if at is None else rules[at].name, "rules_run": len(rules) if at is None else at + 1})
        return pa.array(out, pa.struct([("rejected_by", pa.string()), ("rules_run", pa.int32())]))

    seen = docs.select(*keep, F.col("text").alias(text)).withColumn(text, verdict(text))
    return seen.select(*keep, F.col(f"{text}.rejected_by").alias(into[0]), F.col(f"{text}.rules_run").alias(into[1]))


_BASE = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, most: int = SAMPLE) -> DataFrame:
    """The base counts of every document, whether it fails the base conditions, and whether it is kept.

    The counts that are due for every document are made first; texts that pass the base conditions then go through the cascade,
    whose rules find those counts there.
    """
    steps = planned(docs, rules, most)
    in_order = [s.rule for s in steps]
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in (*counts, "kept")}
            for value in batch.column(1).to_pylist():
                t = Text(value)
                for c in counts:
                    out[c].append(getattr(t, c))
                out["kept"].append(not t.base_failed and not any(rule.rejects(t) for rule in in_order))
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True))], names=["doc_id", *out])
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _BASE)


JUDGE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
windows AS (SELECT r, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
    FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
often AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, a, b, c) > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM often) GROUP BY r),
counted AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines,
    len(list_filter(words, lambda x: ends_with(x, '!!'))) AS n_shouted, len(list_filter(words, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_lettered,
    len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_dots, len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullets
    FROM w LEFT JOIN covered USING (r)),
base AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT (base_failed OR {" OR ".join(f"({rule.sql})" for rule in RULES)}) AS kept
FROM base
"""

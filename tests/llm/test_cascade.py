import itertools
import random

import duckdb
import pytest

from chunkframe.llm import cascade, registry

BASE = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def by_sql(df):
    con = duckdb.connect()
    con.register("d0", df.select("doc_id", "text").toPandas())
    con.sql("CREATE VIEW documents AS SELECT CAST(doc_id AS BIGINT) doc_id, CAST(text AS VARCHAR) AS text FROM d0")
    return con.sql(f"SELECT {', '.join(BASE)} FROM ({cascade.JUDGE_SQL})").fetchall()


def rows(df):
    return [tuple(r) for r in df.select(*BASE).collect()]


key = lambda r: tuple((v is None, v or 0) for v in r)


def test_judge_equals_sql(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = ["a b c " * 40, "a b c d a b c", "x\n\nx\n \nx", "one two three one two three one", "#" * 9, "- a\n- b\n* c\n" * 30, "so it goes...\n" * 60, "    \x85 \x1c", "w\x00w " * 60, "ab!! " * 80, "1 2 3 " * 50, "… • a\n" * 2]
    texts += [" ".join(random.Random(i).choices("abcdefgh", k=90)) + f"\n{i}" for i in range(40)]
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for df in (docs, odd, made):
        assert sorted(rows(cascade.judge(df)), key=key) == sorted(by_sql(df), key=key)
    assert cascade.judge(empty).count() == 0 and cascade.judge(empty).columns == BASE


def test_repeat_words_by_hand():
    count = lambda t: cascade.Text(t).n_repeat_words
    assert [count(t) for t in ("", "a b c", "a b c a b c", "a a a a", "a b c x a b c", "a b c d a b c d e")] == [0, 0, 6, 4, 6, 8]


def test_order_is_rejections_for_cost():
    rules = [cascade.Rule(n, lambda t: False, "") for n in "abcd"]
    masks = {0b0011: 50, 0b0001: 10, 0b0100: 20, 0b0000: 20}  # b rejects part of what a rejects; d nothing
    steps = cascade.ordered(rules, [1.0, 0.5, 1.0, 0.1], masks)
    assert [s.rule.name for s in steps] == ["b", "c", "a", "d"]
    assert [round(s.rejection, 3) for s in steps] == [0.5, 0.4, 0.333, 0.0]

    def cost(order):
        left, spent = dict(masks), 0.0
        for i in order:
            spent += sum(left.values()) * [1.0, 0.5, 1.0, 0.1][i]
            left = {m: n for m, n in left.items() if not m >> i & 1}
        return spent

    mine = cost(["abcd".index(s.rule.name) for s in steps])
    assert mine <= min(map(cost, itertools.permutations(range(4)))) + 10  # d, which costs a tenth, rejects nothing


@pytest.mark.parametrize("seed", range(20))
def test_greedy_order_stays_near_the_best(seed):
    rng = random.Random(seed)
    costs = [rng.uniform(0.1, 2) for _ in range(5)]
    masks = {rng.randrange(32): rng.randrange(1, 100) for _ in range(12)}
    rules = [cascade.Rule(str(i), lambda t: False, "") for i in range(5)]

    def cost(order):
        left, spent = dict(masks), 0.0
        for i in order:
            spent += sum(left.values()) * costs[i]
            left = {m: n for m, n in left.items() if not m >> i & 1}
        return spent

    mine = cost([int(s.rule.name) for s in cascade.ordered(rules, costs, masks)])
    assert mine <= 4 * min(map(cost, itertools.permutations(range(5))))  # the bound of the greedy order


def test_cascade_stops_at_the_first_rejection(spark, odd):
    def must_not_run(text):
        raise AssertionError("a rule behind a rejection was run")

    every = cascade.Rule("every", lambda t: True, "true")
    later = cascade.Rule("later", must_not_run, "false")
    got = cascade.cascade(odd, [cascade.Step(every, 1, 1), cascade.Step(later, 1, 0)], keep=odd.columns).collect()
    assert len(got) == odd.count() and {(r["rejected_by"], r["rules_run"]) for r in got} == {("every", 1)}


def test_verdict_does_not_depend_on_the_order(spark, docs):
    want = sorted(rows(cascade.judge(docs)))
    assert sorted(rows(cascade.judge(docs, cascade.RULES[::-1], most=10))) == want
    steps = cascade.planned(docs, most=50)
    assert {s.rule.name for s in steps} == {r.name for r in cascade.RULES} and all(s.cost > 0 for s in steps)
    kept = {r["doc_id"] for r in cascade.cascade(docs, steps).where("rejected_by is null").collect()}
    assert {r[0] for r in want if r[7]} == {d for d in kept if d not in {r[0] for r in want if r[6]}}


def test_clean_documents_stay(spark):
    docs = registry.op12_rule_cascade(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    seen = docs.where("not base_failed").join(labels, "doc_id").groupBy("quality").agg({"doc_id": "count", "kept": "max"}).collect()
    kept = {(r["quality"], r["kept"]): r["count"] for r in docs.where("not base_failed").join(labels, "doc_id").groupBy("quality", "kept").count().collect()}
    assert len(seen) == 2 and kept.get((1, False), 0) <= 0.01 * kept[(1, True)] and kept.get((0, True), 0) < kept[(0, False)]

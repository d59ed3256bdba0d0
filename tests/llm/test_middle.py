import hashlib
import re

import duckdb
import numpy as np
import pytest

from chunkframe.llm import middle

COLUMNS = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]


def brute(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    hexes = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexes[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(v % (len(units) + 1) for v in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "plain" if text == "" or any(x in text for x in ("<P>", "<S>", "<M>")) else ("spm" if h[3] % 100 < 50 else "psm")
    out = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(units), form, None if form == "plain" else len(p), None if form == "plain" else len(m), sha(out), sha(text))


key = lambda r: tuple((v is None, v or 0) if not isinstance(v, str) else (False, v) for v in r)


def test_fill_in_middle_equals_brute_force_and_sql(spark, odd, empty):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = ["\n", "\n\n", "a\n", "a", "a\nb", "é\n\U0001f600\nz\r\n\x85 q", "x <P> y\nz", "x <S> y\nz", "x <M> y\nz", "<\nP>\n<", "<P\n><S\nM>", "same\ntext\n" * 40] + ["same\ntext\n" * 40] * 300 + ["", None, None]
    made = spark.createDataFrame([(None if i % 97 == 5 else i * 7919 % 4099 - 9, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, ends string, digest int").repartition(6)
    for df in (big, odd, made):
        rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        want = sorted((brute(*r) for r in rows), key=key)
        assert sorted((tuple(r) for r in middle.fill_in_middle(df).select(*COLUMNS).collect()), key=key) == want
        con = duckdb.connect()
        con.register("d0", df.select("doc_id", "text").toPandas())
        con.sql("CREATE VIEW documents AS SELECT CAST(doc_id AS BIGINT) doc_id, CAST(text AS VARCHAR) AS text FROM d0")
        assert sorted(con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({middle.MIDDLE_SQL})").fetchall(), key=key) == want
    assert middle.fill_in_middle(empty).count() == 0
    outputs = {r["doc_id"]: r for r in middle.rendered(made.where("doc_id is not null")).collect()}
    texts_of = {r["doc_id"]: r["text"] or "" for r in made.collect()}
    assert all(middle.restore(r["output"], r["form"]) == texts_of[d] for d, r in outputs.items())


def test_hot_texts_have_several_entries(spark, monkeypatch):
    df = spark.createDataFrame([(i, "one\ntwo\n" if i % 3 else f"text {i}\nof its own") for i in range(900)], "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so little would all go to one
    try:
        plan = middle.entries(df, hot=50, hot_share=100)
        spread = plan.where("text = 'one\ntwo\n'").groupBy(middle.F.spark_partition_id()).agg(middle.F.sum(middle.F.size("ids")).alias("n")).collect()
        assert sum(r["n"] for r in spread) == 600 and len(spread) > 1 and plan.count() > 303
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    monkeypatch.setattr(middle, "PIECE", 7)
    got = middle.entries(df, hot=1000).collect()
    assert max(len(r["ids"]) for r in got) == 7 and sorted(i["doc_id"] for r in got for i in r["ids"]) == list(range(900))
    assert {r["form"] for r in middle.rendered(df, rate=0).collect()} == {"plain"}


def test_texts_move_once(spark):
    df = spark.createDataFrame([(i, f"text {i % 40}\n") for i in range(80)], "doc_id long, text string")
    plan = middle.entries(df)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert len(moved) == 2  # ids, and texts; the join needs no other


def test_the_index_holds_each_text_once(spark, odd):
    got = middle.index(odd).collect()
    texts = {r["text"] or "" for r in odd.collect()}
    assert len(got) == len(texts) and {r["text"] for r in got} == texts
    for r in got:
        ends = middle.EliasFano(bytes(r["ends"]))
        assert [ends.get(i) for i in range(ends.n)] == middle.line_ends(r["text"]).tolist() and bytes(r["digest"]) == hashlib.sha256(r["text"].encode()).digest()


def test_different_texts_under_one_digest_stop_the_job(spark):
    table = spark.createDataFrame([(b"d", "a"), (b"d", "b"), (b"e", "c")], "digest binary, text string")
    with pytest.raises(Exception, match="two texts with one SHA-256"):
        middle.distinct(table).collect()


@pytest.mark.parametrize("seed", range(12))
def test_elias_fano(seed):
    rng = np.random.default_rng(seed)
    steps = rng.integers(0 if seed % 2 else 1, [2, 9, 300, 100000][seed % 4], rng.integers(1, 900))
    values = np.cumsum(steps)
    data = middle.EliasFano.pack(values)
    packed = middle.EliasFano(data)
    assert packed.n == len(values) and [packed.get(i) for i in range(len(values))] == values.tolist()
    bound = 2 + max(np.log2((values[-1] + 1) / len(values)), 0) + 1 + 32 / 64
    assert len(data) * 8 <= bound * len(values) + 8 * 8 + 32 + 16
    with pytest.raises(IndexError):
        packed.get(len(values))


def test_line_ends():
    assert [middle.line_ends(t).tolist() for t in ("", "\n", "a", "a\n", "\U0001f600\nb")] == [[], [1], [1], [2], [2, 3]]
    assert middle.EliasFano(middle.EliasFano.pack(middle.line_ends(""))).n == 0

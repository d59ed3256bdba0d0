import random

from pyspark.sql import functions as F

import corpus_pipeline


def test_pipeline_stages(spark, sf_dir, odd):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "similar", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and {r["doc_id"] for r in rows} < {r["doc_id"] for r in docs.collect()}
    language = corpus_pipeline.by_language(spark, docs, sf_dir)
    assert language.count() == docs.where(F.col("text").rlike(r"\p{L}")).count()
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, odd, sf_dir).collect()
    kept = {r["doc_id"] for r in corpus_pipeline.by_similarity(spark, odd, sf_dir).collect()}
    assert {7, None} <= kept and not {8, 9, 10} & kept


def test_stages_take_empty_tables_and_clashing_columns(spark, sf_dir, odd, empty):
    more = odd.selectExpr("*", "1 AS _lang", "2 AS _cosine", "3 AS _score", "4 AS _toxic", "5 AS _row", "6 AS row", "7 AS lang_pred")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
        out = stage(spark, more, sf_dir)
        assert out.count() and (name == "packing" or out.columns == more.columns)


def test_near_copies_are_found_at_five_words_and_080(spark, sf_dir):
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(10**6)}"
    texts = []
    for _ in range(12):
        base = [word() for _ in range(400)]
        texts.append(base)
        for edits in (8, 10, 40):
            copy = list(base)
            for at in rng.sample(range(400), edits):
                copy[at] = word()
            texts.append(copy)
        texts.append(base + [word() for _ in range(rng.choice([60, 80, 120]))])
    ids = [i % 47 for i in range(len(texts))]  # some ids have two different texts
    rows = [(i, " ".join(t)) for i, t in zip(ids, texts, strict=True)] + [(None, " ".join(texts[0])), (3, None), (3, ""), (None, "alone")]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} or set(map(tuple, [w] if w else [])) for w in ((t or "").split() for _, t in rows)]
    near = lambda a, b: bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)
    between = sum(near(a, b) and len(a & b) < 0.9 * len(a | b) for k, a in enumerate(sets) for b in sets[:k])
    group = list(range(len(rows)))
    for k, a in enumerate(sets):
        for m in range(k):
            if near(a, sets[m]):
                group = [group[m] if g == group[k] else g for g in group]
    want = [min(((i is None, i or 0), t or "") for (i, t), g in zip(rows, group, strict=True) if g == one) for one in set(group)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = [((r["doc_id"] is None, r["doc_id"] or 0), r["text"] or "") for r in corpus_pipeline.by_similarity(spark, table, sf_dir).collect()]
    assert between > 5 and sorted(got) == sorted(want)

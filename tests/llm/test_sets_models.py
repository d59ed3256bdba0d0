import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from chunkframe.llm import chats, pitman_yor, registry, similar, word_pairs


def brute_components(rows):
    def words(t):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()

    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def test_similar_components_equal_brute_force(spark, docs, empty, odd):
    rng = random.Random(4)
    base = [" ".join(f"{rng.choice('abcdef')}{rng.randrange(400)}" for _ in range(n)) for n in (40, 60, 200, 400)]
    rows = []
    for _ in range(160):
        w = rng.choice(base).split()
        for _ in range(rng.randrange(0, max(2, len(w) // 30))):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9)}"
        rows.append(" ".join(w[: rng.choice([len(w), len(w) - 1, len(w) - 3])]))
    rows += [None, "", "one", "one", "one two", "One TWO", base[0], base[0].upper()]
    table = spark.createDataFrame([(3 * i % 1009, t) for i, t in enumerate(rows)], "doc_id long, text string")
    for t in (table, docs):
        want = brute_components([(r["doc_id"], r["text"]) for r in t.select("doc_id", "text").collect()])
        assert sorted(tuple(r) for r in similar.similar_components(t).collect()) == want
    assert similar.similar_components(empty).count() == 0
    got = similar.similar_components(odd).collect()
    assert len(got) == odd.count() and {r["component_id"] for r in got if r["doc_id"] in (7, 8, 9, 10)} == {7}


def near_threshold_group(rng, g, at_least=90):
    """Texts of some clusters, each pair near the threshold from either side."""
    n = rng.randrange(40, 120)
    word = lambda: f"g{g}w{rng.randrange(10**6)}"
    base, texts = [word() for _ in range(n)], []
    for _ in range(rng.randrange(2, 4)):  # clusters at 0.85 to 0.95 of each other
        centre = list(base)
        for _ in range(rng.randrange(0, 4)):
            centre[rng.randrange(n)] = word()
        for _ in range(rng.randrange(2, 5)):
            one = list(centre)
            for _ in range(rng.randrange(0, 3)):
                one[rng.randrange(n)] = word()
            texts.append(" ".join(one[: n - rng.randrange(0, 3)]))
    return texts


@pytest.mark.parametrize("few", [0, 24])
@pytest.mark.parametrize("seed", range(5))
def test_rounds_of_a_cell_lose_no_link(seed, few, monkeypatch):
    monkeypatch.setattr(similar, "FEW", few)
    rng = random.Random(seed)
    for g in range(500):
        found = [np.unique(similar.shingles(t)) for t in near_threshold_group(rng, g)]
        found = list({s.tobytes(): s for s in found}.values())
        m = len(found)
        share = lambda a, b: len(np.intersect1d(found[a], found[b]))  # noqa: B023, E731
        linked = lambda a, b: 100 * share(a, b) >= 90 * (len(found[a]) + len(found[b]) - share(a, b))  # noqa: B023, E731

        def named(links, m=m):
            of = list(range(m))
            for _ in range(m):
                for a, b in links:
                    of[a] = of[b] = min(of[a], of[b])
            return of

        want = named([(a, b) for a in range(m) for b in range(a) if linked(a, b)])
        at, links, refused = list(range(m)), [], [set() for _ in range(m)]
        for more in (0, 1, 3, 7, 15, 31, 63):
            of = named(links)
            cell = {"component": [of[i] for i in at], "n": [len(found[i]) for i in at], "pos": [0] * len(at), "block": [0] * len(at), "guest": [False] * len(at), "hub": [None] * len(at), "distance": [None] * len(at), "low": [0], "high": [0]}
            cell |= {"sketch": [similar.parities(found[i]) for i in at], "set": at, "refused": [sorted(refused[i]) for i in at]}
            pairs, still = similar.near_pairs(cell, 90, more)
            assert len({p[:2] for p in pairs}) == len(pairs) <= (1 + more) * len(at)
            if not pairs:
                break
            for a, b, _ in pairs:
                if linked(a, b):
                    links.append((a, b))
                else:
                    refused[a].add(b)
                    refused[b].add(a)
            at = [i for i in at if i in still]
        else:
            raise AssertionError("candidates are left")
        assert named(links) == want


def test_small_cells_tell_what_large_ones_do(monkeypatch):
    rng = random.Random(3)
    for g in range(400):
        found = [np.unique(similar.shingles(t)) for t in near_threshold_group(rng, g)] * rng.randrange(1, 3)
        m, hubs = len(found), [rng.choice([None, 1, 2]) for _ in found]
        cell = {"component": [rng.randrange(m) for _ in found], "n": [len(f) for f in found], "pos": [rng.randrange(3) for _ in found], "block": [rng.randrange(2) for _ in found], "guest": [rng.random() < 0.2 for _ in found]}
        cell |= {"hub": hubs, "distance": [None if h is None else rng.randrange(0, 40) for h in hubs], "low": [0], "high": [rng.randrange(2)], "sketch": [similar.parities(f) for f in found], "set": list(range(m))}
        refused = [{j for j in range(m) if (i * 7 + j * 7) % 11 == 0} for i in range(m)]
        cell["refused"] = [sorted(r) or None for r in refused]
        for more in (0, 1, 5):
            told = []
            for few in (0, 1000):
                monkeypatch.setattr(similar, "FEW", few)
                pairs, still = similar.near_pairs(cell, 90, more)
                told.append((still, {p for p in pairs if p[2]}, len(pairs)))
            assert told[0][0] == told[1][0] and len(told[0][1]) == len(told[1][1])


def test_similar_components_of_many_groups_near_the_threshold(spark):
    rng, rows, want = random.Random(11), [], []
    for g in range(400):
        group = [(len(rows) + i, t) for i, t in enumerate(near_threshold_group(rng, g))]
        rows += group
        want += brute_components(group)
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(tuple(r) for r in similar.similar_components(table).collect()) == sorted(want)


@pytest.mark.parametrize("n", [1, 2, 9, 10, 11, 100])
def test_prefix_length(n):
    assert similar.prefix_length(n) == n - math.ceil(0.9 * n - 1e-9) + 1


def test_cell_pairs_split_long_lists(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", 4)
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(base[:k] + [f"y{i}"] + base[k + 1 :])) for i, k in enumerate(range(0, 60, 2))] + [(99, " ".join(base))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in similar.similar_components(table, rounds=0).collect()) == brute_components(rows)


def test_chats_equal_sql(spark, empty):
    turns = [(c, t, r, x) for c, said in {1: "ab", 2: "abc", 3: "abc", 4: "abd", 5: "a", 6: "xyz", None: "q"}.items() for t, (r, x) in enumerate(zip("uau", said, strict=False))]
    turns += [(7, 0, None, None), (7, 1, "u", ""), (8, 0, "u", None), (9, 0, "u", ""), (9, 0, "u", "")] + [(10, t, "u", str(t)) for t in range(150)] + [(11, t, "u", str(t)) for t in range(130)]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    big = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    for df in (table, big):
        conversations = df.toPandas()
        con = duckdb.connect()
        con.register("c0", conversations)
        con.sql("CREATE VIEW conversations AS SELECT CAST(conv_id AS BIGINT) conv_id, turn, role, text FROM c0")
        want = con.sql(chats.RENDER_SQL).fetchall()
        key = lambda r: (r[0] is None, r[0] or 0, r[1])
        assert sorted((tuple(r) for r in chats.render(df).collect()), key=key) == sorted(want, key=key)
    kept = {r["conv_id"]: r["copies"] for r in chats.render(table).collect()}
    assert {1, 3, 5, 11}.isdisjoint(kept) and kept[2] == 2 and 4 in kept
    assert chats.render(table.where("false")).count() == 0


def test_long_conversations_are_spread(spark):
    copies = [(None, 0, "u", "same")] * 40 + [(None, 1, "u", "x" * 300 + str(i % 7)) for i in range(40)] + [(1, t, "u", "same") for t in range(40)]
    table = spark.createDataFrame(copies, "conv_id long, turn long, role string, text string").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so little would all go to one
    try:
        rows, blocks = chats.placed(table)
        assert blocks.where("conv_id is null").count() > 1
        said = "".join(r["text"] for r in chats.render(table).where("conv_id is null").orderBy("segment").collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [tuple(r) for r in blocks.groupBy("conv_id").agg({"last": "max"}).orderBy("conv_id").collect()] == [(None, 79), (1, 39)]
    want = sorted([t for c, _, _, t in copies if c is None and t != "same"])
    assert said == "".join(f"<|u|>\n{t}\n<|end|>\n" for t in ["same"] * 40 + want)


def test_language_model(spark, docs, odd, empty):
    for table in (docs, odd):
        rows = [(r["doc_id"], (r["text"] or "").encode().lower().split()) for r in table.collect()]
        held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
        c = Counter(w for d, ws in rows if not held(d) for w in [*ws, None])
        n, v = sum(c.values()), len(c)
        want = sorted((d is None, d or 0, len(ws) + 1, sum(c[w] > 0 for w in [*ws, None]), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*ws, None])) for d, ws in rows)
        out = pitman_yor.score_documents(table).collect()
        got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in out)
        assert [g[:5] for g in got] == [w[:5] for w in want]
        assert np.allclose([g[5] for g in got], [w[5] for w in want])
    out = [r for r in pitman_yor.score_documents(docs).collect() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    assert pitman_yor.score_documents(empty).count() == 0


def test_context_model_is_a_distribution():
    counts = np.random.default_rng(1).poisson(0.5, (21, 20)) * np.random.default_rng(2).integers(1, 500, (21, 20))
    assert np.allclose((10 ** pitman_yor.context_model(counts)).sum(axis=1), 1)
    assert np.allclose((10 ** pitman_yor.dish_model(counts[0])).sum(), 1)
    counts_, words = np.array([1, 2, 5]), np.array([50.0, 20.0, 3.0])
    m = pitman_yor.CountModel(counts_, words)
    assert np.isclose((10 ** m.log10(counts_) * words).sum() + 10 ** m.log10(np.array([0])).sum(), 1)


def test_score_equals_a_model_counted_by_hand(spark, odd, monkeypatch):
    """Chances come from the same sampler; every count, class, context and sum is made here by dictionaries."""
    monkeypatch.setattr(pitman_yor, "CLASSES", 6)
    monkeypatch.setattr(pitman_yor, "FREQUENT", 9)
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.9))}" for _ in range(rng.randrange(0, 60)))) for i in range(120)]
    table = spark.createDataFrame([*rows, (None, "w1 w2"), (500, None)], "doc_id long, text string")
    rows = [(r["doc_id"], (r["text"] or "").encode().lower().split()) for r in table.collect()]
    train = [ws for d, ws in rows if d is None or zlib.crc32(str(d).encode()) % 5 != 1]
    c = Counter(w for ws in train for w in ws)
    bin_of = lambda n: math.floor(math.log2(n) * 32 + 1e-9)
    frequent = []
    for b in sorted({bin_of(n) for n in c.values()}, reverse=True):
        new = [w for w in c if bin_of(c[w]) == b]
        if len(frequent) + len(new) > 13:
            break
        frequent += new
    frequent.sort(key=lambda w: (-c[w], w))
    classes, seconds = frequent[:4], frequent[4:]
    dish = lambda w: 0 if w is None else 2 + classes.index(w) if w in classes else 1
    context = lambda w: 6 if w is None else 2 + classes.index(w) if w in classes else 7 + zlib.crc32(w[-2:]) % pitman_yor.TAILS
    counts = np.zeros((7 + pitman_yor.TAILS, 6), np.int64)
    for ws in train:
        for u, w in zip([None, *ws], [*ws, None], strict=True):
            counts[context(u), dish(w)] += 1
    far = {w: n for w, n in c.items() if w not in frequent}
    table_, other = pitman_yor.context_model(counts), pitman_yor.dish_model(np.array([*(c[w] for w in seconds), sum(far.values())]))
    bins = sorted({bin_of(n) for n in far.values()})
    groups = [[n for n in far.values() if bin_of(n) == b] for b in bins]
    last = pitman_yor.CountModel(np.array([round(sum(g) / len(g)) for g in groups]), np.array([len(g) for g in groups], float))
    want = {}
    for d, ws in rows:
        total = sum(table_[context(u), dish(w)] for u, w in zip([None, *ws], [*ws, None], strict=True))
        total += sum(other[seconds.index(w)] if w in seconds else other[-1] + last.log10(np.array([far.get(w, 0)]))[0] for w in ws if w not in classes)
        want[d] = total
    got = {r["doc_id"]: r["score"] for r in pitman_yor.score_documents(table).collect()}
    assert got.keys() == want.keys() and all(np.isclose(got[d], want[d]) for d in want)


def test_tables_need_customers():
    rng = np.random.default_rng(3)
    t = pitman_yor.tables(np.array([0, 1, 5, 100_000]), 1.0, np.full(4, 0.25), 0.5, rng)
    assert t[0] == 0 and t[1] == 1 and 1 <= t[2] <= 5 and 1 < t[3] < 5000


def is_held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def test_pairs_of_rare_words_have_a_chance_of_their_own(spark, tmp_path):
    """Same counts, same last bytes: only the pair tells the two held-out texts apart."""
    train = (i for i in range(10_000) if not is_held(i))
    rows = [(next(train), " ".join(f"c{k}" for k in range(1100))) for _ in range(6)]
    rows += [(next(train), f"x{k}ab y{k}cd") for k in range(300) for _ in range(2)]
    first, second = [i for i in range(10_000, 10_100) if is_held(i)][:2]
    spark.createDataFrame([*rows, (first, "x5ab y5cd"), (second, "x5ab y6cd")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["score"] for r in registry.op9_pitman_yor(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) + 2 and got[first] > got[second] + 1


def test_score_of_pairs_equals_a_model_counted_by_hand(spark, monkeypatch):
    """One table a pair; every count, restaurant and sum is made here by dictionaries."""
    monkeypatch.setattr(pitman_yor, "CLASSES", 6)
    monkeypatch.setattr(pitman_yor, "FREQUENT", 9)
    monkeypatch.setattr(word_pairs, "BUCKET", 300)
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.9))}" for _ in range(rng.randrange(0, 60)))) for i in range(120)]
    table = spark.createDataFrame([*rows, (None, "w1 w2"), (500, None)], "doc_id long, text string").repartition(3)
    rows = [(r["doc_id"], (r["text"] or "").encode().lower().split()) for r in table.collect()]
    of, c = pitman_yor.trained(table), Counter()
    for d, ws in rows:
        if not is_held(d):
            c.update(zip([None, *ws], [*ws, ""], strict=True))
    count, number = Counter(), of.numbered.number
    for (_, w), n in c.items():
        count[w] += n
    top, rank = of.numbered.top, lambda w: 0 if w == "" else number.get(w, 1 << 30)
    of_class = lambda u: u is None or rank(u) < top
    apart = {(u, w): n for (u, w), n in c.items() if not (of_class(u) and rank(w) < top)}
    customers, opened = Counter(), Counter()
    for (u, _), n in apart.items():
        customers[u] += n
        opened[u] += 1
    one, two = sum(n == 1 for n in apart.values()), sum(n == 2 for n in apart.values())
    disc = min(max(one / (one + 2 * two), 0.05), 0.95)

    def outside(w):
        return of.others[rank(w) - top] if w in number else of.others[-1] + of.tail.log10(np.array([count[w]]))[0]

    def chance(u, w):
        context = top if u is None else rank(u) if of_class(u) else top + 1 + pitman_yor.tail_of(u)
        inner = rank(w) < top
        above = of.by_context[context, rank(w) if inner else 1]
        if of_class(u) and inner:
            return above
        up = outside(w) if of_class(u) else above + (0 if inner else outside(w))
        p = (max(c[u, w] - disc, 0) + (1 + disc * opened[u]) * 10**up) / (1 + customers[u])
        return math.log10(p) + (above if of_class(u) else 0)

    want = {d: sum(chance(u, w) for u, w in zip([None, *ws], [*ws, ""], strict=True)) for d, ws in rows}
    found = word_pairs.score_documents(table, seat=lambda n, others, parent, d, rng: np.minimum(n, 1)).collect()
    got = {r["doc_id"]: r["score"] for r in found}
    assert got.keys() == want.keys() and all(np.isclose(got[d], want[d]) for d in want)
    seated = {r["doc_id"]: r["score"] for r in word_pairs.score_documents(table).collect()}
    assert seated.keys() == want.keys() and all(s < 0 for s in seated.values()) and seated == {r["doc_id"]: r["score"] for r in word_pairs.score_documents(table.repartition(2)).collect()}


def test_pair_scores_of_odd_tables(spark, docs, odd, empty):
    for table in (docs, odd):
        key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"])
        got, want = (sorted(f(table).collect(), key=key) for f in (word_pairs.score_documents, pitman_yor.score_documents))
        assert [r[:5] for r in got] == [r[:5] for r in want] and np.allclose([r["base_score"] for r in got], [r["base_score"] for r in want])
    assert word_pairs.score_documents(empty).count() == 0

import math

import numpy as np
import pytest

from chunkframe.llm import registry, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, component string, n string"


def brute(rows, most=32):
    kept = [(i, v) for i, v in rows if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(c)) + 1000000 for c in v] for _, v in kept]
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    centred = np.array([[n * r[j] - sums[j] for j in range(d)] for r in x]) / n
    v = centred.T @ centred / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    k = min(most, int((e > 1e-10 * e[0]).sum()))
    deviations = [sum((n * r[j] - sums[j]) ** 2 for j in range(d)) for r in x]
    return [i for i, _ in kept], n, deviations, centred @ q[:, :k] / np.sqrt(e[:k]), e[:k] / np.trace(v)


def agree(got, want):
    ids, n, deviations, whitened, explained = want
    k = whitened.shape[1]
    assert len(got) == len(ids) * k and {r["n"] for r in got} == {n} and {r["component"] for r in got} == set(range(1, k + 1))
    assert sorted({(r["vec_id"], r["deviation"]) for r in got}) == sorted(set(zip(ids, deviations, strict=True)))
    assert np.allclose(sorted({(r["component"], r["explained"]) for r in got}), list(zip(range(1, k + 1), explained, strict=True)), rtol=1e-9)
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    mine = np.zeros((len(ids), k))
    at = {v: i for i, v in enumerate(ids)}
    for r in got:
        mine[at[r["vec_id"]], r["component"] - 1] = r["whitened"]
    signs = np.sign((mine * whitened).sum(axis=0))
    assert np.allclose(mine, whitened * signs, atol=1e-7)


def test_query_equals_brute_force(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    agree(registry.op13_welford_whitening(spark, sf_dir).collect(), brute(rows))


def test_odd_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(90)]
    rows[3] = (3, rows[4][1])  # a repeated vector
    odd = [(100, None), (101, []), (102, [None, 1.0, 1.0, 1.0, 1.0]), (103, [float("nan")] * 5), (104, [float("inf"), 0.0, 0.0, 0.0, 0.0])]
    table = spark.createDataFrame([(i, v, 0, "c", None) for i, v in rows + odd], SCHEMA).repartition(37)
    agree(whitening.whiten(table).collect(), brute(rows))
    assert whitening.whiten(table, most=2).count() == 180
    assert whitening.whiten(table.where("false")).count() == 0 == whitening.whiten(table.where("vec_id >= 100")).count()
    nameless = spark.createDataFrame([(None, v, 0, "c", None) for _, v in rows] * 2, SCHEMA)
    assert whitening.whiten(nameless).where("vec_id is null").count() == 2 * 90 * 5
    mixed = spark.createDataFrame([(1, [1.0, 2.0], 0, "c", None), (2, [1.0], 0, "c", None)], SCHEMA)
    with pytest.raises(Exception, match="entries in one table"):
        whitening.whiten(mixed).collect()


def test_components_without_variance_are_left_out(spark):
    rows = [(i, [float(i), 2.0 * i, 7.0], 0, "c", None) for i in range(20)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 20 and {r["component"] for r in got} == {1} and abs(got[0]["explained"] - 1) < 1e-12
    assert whitening.whiten(spark.createDataFrame(rows[:1], SCHEMA)).count() == 0  # one vector has no variance


@pytest.mark.parametrize("d", [1, 2, 3, 8, 33, 64])
def test_symmetric_qr(d):
    rng = np.random.default_rng(d)
    for a in (rng.normal(size=(d, d)), np.diag(rng.integers(0, 3, d)).astype(float), np.ones((d, d)), np.zeros((d, d)), rng.normal(size=(d, d)) * 10.0 ** -np.arange(d)):
        a = a + a.T
        values, vectors = whitening.symmetric_qr(a)
        scale = max(np.abs(a).max(), 1e-300)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-12 * d * scale)
        assert np.allclose(a @ vectors, vectors * values, atol=1e-12 * d * scale)
        assert np.allclose(vectors.T @ vectors, np.eye(d), atol=1e-12)


def test_merged_moments_equal_those_of_all_rows():
    x = np.random.default_rng(1).integers(-200, 200, (300, 4))
    parts = []
    for rows in np.split(x, [1, 1, 50, 51, 200]):
        m = whitening.Moments(4)
        m.add(rows)
        parts.append(m)
    whole = whitening.Moments(0)
    for m in parts:
        whole.merge(m)
    assert whole.n == 300 and whole.sums == x.sum(axis=0).tolist()
    assert np.allclose(whole.spread / 300, np.cov(x.T, bias=True), atol=1e-9)


def test_deviations_beyond_64_bits_are_errors():
    m = whitening.Moments(1)
    m.add(np.array([[0], [1 << 40]]))
    with pytest.raises(OverflowError):
        whitening.Whitener(m, 1).deviations(np.array([[0]]))

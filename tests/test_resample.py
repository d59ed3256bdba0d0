"""Chunk-form resampling and reduction against plain numpy."""

import itertools

import numpy as np
import pytest

from chunkframe.operators import blocks, resample

RNG = np.random.default_rng(5)


def chunked(spark, a, size):
    """The table of ``blocks.to_chunks`` of an array, with a dtype."""
    counts = [-(-n // c) for n, c in zip(a.shape, size, strict=True)]
    rows = []
    for at in itertools.product(*map(range, counts)):
        part = a[tuple(slice(i * c, (i + 1) * c) for i, c in zip(at, size, strict=True))]
        rows.append((int(np.ravel_multi_index(at, counts)), [i * c for i, c in zip(at, size, strict=True)], list(part.shape), bytearray(np.ascontiguousarray(part).tobytes()), a.dtype.newbyteorder("<").str))
    return spark.createDataFrame(rows, "chunk_id long, origin array<long>, extent array<long>, payload binary, dtype string")


def whole(chunks, shape, dtype):
    out, seen = np.zeros(shape, dtype), np.zeros(shape, int)
    for r in chunks.collect():
        at = tuple(slice(o, o + e) for o, e in zip(r["origin"], r["extent"], strict=True))
        out[at] = np.frombuffer(r["payload"], r["dtype"]).reshape(r["extent"])
        seen[at] += 1
    assert (seen == 1).all()
    return out


def spline(v, out):
    """A cubic spline by solving for its coefficients, on values carried on beyond both ends."""
    pad, n = 40, len(v)
    w = np.pad(v.astype(float), pad, mode="edge")
    m = len(w)
    a = (np.diag(np.full(m, 4.0)) + np.diag(np.ones(m - 1), 1) + np.diag(np.ones(m - 1), -1)) / 6
    a[0, 0] = a[-1, -1] = 5 / 6  # constant beyond
    c = np.linalg.solve(a, w)
    x = (np.arange(out) + 0.5) * n / out - 0.5 + pad
    d = np.abs(x[:, None] - np.arange(m))
    return np.where(d < 1, 2 / 3 - d**2 + d**3 / 2, np.where(d < 2, (2 - d) ** 3 / 6, 0)) @ c


def linear(v, out):
    return np.interp((np.arange(out) + 0.5) * len(v) / out - 0.5, np.arange(len(v)), v.astype(float))


def nearest(v, out):
    return v[np.floor(np.clip((np.arange(out) + 0.5) * len(v) / out - 0.5, 0, len(v) - 1) + 0.5).astype(int)]


BY_HAND = {"cubic": spline, "trilinear": linear, "nearest": nearest}


@pytest.mark.parametrize("method", list(BY_HAND))
@pytest.mark.parametrize("dtype", ["uint8", "int16", "float64"])
def test_chunks_equal_the_whole_array(spark, method, dtype):
    a = (RNG.normal(size=(19, 3, 70)) * 90).clip(0 if dtype == "uint8" else -300, 255).astype(dtype)
    to = (43, 3, 101)
    want = a
    for axis, m in enumerate(to):
        if m != a.shape[axis]:
            want = np.apply_along_axis(BY_HAND[method], axis, want, m)
    got = whole(resample.upsample_chunks(chunked(spark, a, (8, 2, 30)), dict(zip("zyx", zip(a.shape, to, strict=True), strict=True)), {"z": 16, "y": 3, "x": 25}, method), to, dtype)
    if dtype == "float64":
        np.testing.assert_allclose(got, want, atol=1e-9)
    else:
        want = np.round(want, 6)
        assert (got == np.clip(np.sign(want) * np.floor(np.abs(want) + 0.5), *((0, 255) if dtype == "uint8" else (-32768, 32767)))).all()


def test_values_are_exact_and_missing_chunks_are_fill(spark):
    a = np.array([[2**64 - 1, 5, 7, 2**63 + 1]], "uint64")
    chunks = chunked(spark, a, (1, 2))
    got = whole(resample.upsample_chunks(chunks, {"y": (1, 2), "x": (4, 8)}, {"y": 2, "x": 3}, "nearest"), (2, 8), "uint64")
    assert (got == np.repeat(np.repeat(a, 2, 0), 2, 1)).all()
    half = resample.upsample_chunks(chunks.where("chunk_id = 0"), {"y": (1, 1), "x": (4, 8)}, {"y": 1, "x": 8}, "nearest", fill=9)
    assert whole(half, (1, 8), "uint64").tolist() == [[2**64 - 1, 2**64 - 1, 5, 5, 9, 9, 9, 9]]
    same = resample.upsample_chunks(chunks, {"y": (1, 1), "x": (4, 4)}, {"y": 1, "x": 4}, "cubic")
    assert (whole(same, (1, 4), "uint64") == a).all()
    assert resample.upsample_chunks(chunks.where("false"), {"y": (1, 1), "x": (4, 8)}, {"y": 1, "x": 8}).count() == 0


def test_isotropic(spark):
    a = RNG.integers(0, 9, (4, 6, 6)).astype("uint8")
    chunks, shape = chunked(spark, a, (2, 6, 6)), {"z": 4, "y": 6, "x": 6}
    out, to, voxel = resample.upsample_to_isotropic(chunks, shape, {"z": 20.0, "y": 10.0, "x": 10.0}, {"z": 4, "y": 6, "x": 6}, is_label=True)
    assert to == {"z": 8, "y": 6, "x": 6} and voxel == {"z": 10.0, "y": 10.0, "x": 10.0}
    assert (whole(out, (8, 6, 6), "uint8") == np.repeat(a, 2, 0)).all()
    with pytest.raises(ValueError, match="already isotropic"):
        resample.upsample_to_isotropic(chunks, shape, {"z": 10.0, "y": 10.05, "x": 10.0}, shape)
    with pytest.raises(ValueError, match="unknown method"):
        resample.resolve("linear5")
    with pytest.warns(UserWarning, match="voxel size 1"):
        resample.upsample_to_isotropic(chunks, shape, {"z": 1.0, "y": 4.0, "x": 4.0}, shape, target=2.0)


def test_one_exchange_of_chunks(spark):
    chunks = chunked(spark, np.zeros((8, 8), "uint8"), (4, 4))
    plan = resample.upsample_chunks(chunks, {"y": (8, 16), "x": (8, 16)}, {"y": 8, "x": 8})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


@pytest.mark.parametrize("dtype", ["int64", "uint8", "float32", "uint64"])
def test_reductions(dtype):
    a = RNG.integers(0, 6, (7, 5, 9)).astype(dtype)
    by_hand = {"min": np.min, "max": np.max, "median": lambda b: np.sort(b.ravel())[(b.size - 1) // 2], "mode": lambda b: min(set(b.ravel()), key=lambda v: (-(b == v).sum(), v)), "mean": np.mean, "stride": lambda b: b.ravel()[0]}
    for method, f in by_hand.items():
        got = blocks.reduce_block(a, [2, 3, 4], method)
        want = np.array([[[f(a[z : z + 2, y : y + 3, x : x + 4]) for x in range(0, 9, 4)] for y in range(0, 5, 3)] for z in range(0, 7, 2)])
        if method == "mean" and dtype != "float32":
            want = np.round(want)  # halves to even
        np.testing.assert_allclose(got, want, rtol=1e-6)

"""What grows with the tables: work is done once a row, keys of large tables fit, gaps stay gaps, and no chunk or group holds all."""

import random

import numpy as np
import pytest

import __spark_entry__ as entry
from chunkframe.operators import blocks, discovery, pyramid
from chunkframe.plans import upsampling

QUERIES = entry.queries()


def planned(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def orders(spark, folder, *keys):
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{folder}/orders.parquet")
    return str(folder)


def test_channels_are_looked_up_once_a_volume(spark, sf_dir):  # F1
    plan = planned(QUERIES["omero_blocks"](spark, sf_dir))
    assert plan.count("regexp_extract_all") == 6  # the channels' tags and five attributes of each


def test_metadata_are_parsed_once_a_volume(spark, sf_dir):  # F2
    assert planned(QUERIES["voxels_of_metadata"](spark, sf_dir)).count("from_json") == 1


def test_czi_colours_of_large_keys(spark, tmp_path):  # F3
    keys = (8_388_608, 16_777_220, 53_999_996)  # colours as signed numbers, some below 0
    got = QUERIES["czi_channels"](spark, orders(spark, tmp_path, *keys)).where("idx = 0 and k % 5 < 4").collect()
    assert {r["k"]: r["color"] for r in got} == {k: f"{k % 16_777_216:06X}" for k in keys if k % 5 < 4}


def test_xml_colours_of_large_keys(spark, tmp_path):  # F4
    keys = (7, 8_388_608, 16_777_220, 53_999_996)
    got = QUERIES["xml_channels"](spark, orders(spark, tmp_path, *keys)).where("idx = 0").collect()
    assert {r["k"]: r["color"] for r in got} == {k: f"{k % 16_777_216:06X}" for k in keys}


def test_labels_keep_their_gaps(spark, tmp_path):  # F5
    rows = [(i, None if i % 9 == 2 else i % 10 - 1) for i in range(157) if i % 7 != 3]
    spark.createDataFrame(rows, "vec_id long, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["precomputed_labels"](spark, str(tmp_path)).collect()
    place = lambda i: (i // 20 // 5, i // 20 % 5, i % 20, 0)
    assert sorted((tuple(r)[:4], None if r["v"] is None else int(r["v"])) for r in got) == sorted((place(i), v) for i, v in rows)


def test_omero_block_shows_what_is_told(spark, sf_dir):  # F6
    got = {r["i"]: (r["label"], r["color"], r["family"]) for r in QUERIES["omero_block"](spark, sf_dir).collect()}
    assert got[0] == ("DAPI", "AABBCC", "linear") and got[1] == ("525", "00FF00", "linear") and got[2] == ("Channel 2", "0000FF", "linear")


def test_chunks_of_shards_stay_with_their_volume(spark, sf_dir):  # F8
    df = QUERIES["shard_chunks"](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "lambda" not in plan
    assert plan.index("Generate") < plan.index("Exchange")  # volumes are dealt, not their chunks


def test_chunks_are_numbered_by_plain_columns(spark, sf_dir):  # F9
    assert "lambda" not in planned(QUERIES["chunk_enumerate"](spark, sf_dir))


def test_arrays_meet_their_folders_in_one_join(spark):  # F10
    rows = [("r", f"{a}/{b}/{c}") for a in ("raw", *"abcdefghijklm") for b in "pq" for c in ("x/y/.zarray", "x/y/z/w/.zarray", "n.txt")] + [("s", ".zarray"), ("s", "k/.zarray"), ("t", "a/b/c/d/.zarray"), ("u", "a/b/c/d/e/.zarray")]
    table = spark.createDataFrame(rows, "root string, inner string")
    df = discovery.first_arrays(table, "root", table["inner"].endswith(".zarray"))
    assert planned(df).count("Join ") == 1
    assert {r["root"]: (r["path"], r["depth"]) for r in df.collect()} == {"r": ("raw/p/x/y", 4), "s": ("k", 1), "t": ("a/b/c/d", 4)}


def test_padded_channels_are_rows_before_they_are_worked_out(spark, sf_dir):  # F11
    plan = planned(QUERIES["padded_channels"](spark, sf_dir))
    assert plan.count("lambdafunction") <= 2  # the described channels and the axes' names


def test_factors_of_a_volume_are_compared_once(spark, sf_dir):  # F12
    assert planned(QUERIES["anisotropic_factors"](spark, sf_dir)).count("forall") == 2


def test_isotropic_chunks_are_bounded(spark, sf_dir, monkeypatch):  # F13
    seen, real = [], blocks.to_chunks
    monkeypatch.setattr(upsampling.blocks, "to_chunks", lambda df, shape, chunk, **more: seen.append(chunk) or real(df, shape, chunk, **more))
    QUERIES["isotropic_volume"](spark, sf_dir)
    assert seen == [{"z": 16, "y": 64, "x": 64}]  # whatever the extents are


@pytest.mark.parametrize("limits", [{}, {"chunk": [1, 16, 16, 16]}, {"least_bytes": 1, "least_shape": 4, "most": 3}])
def test_plans_of_many_volumes_are_those_of_each(limits):  # F14
    rng, axes = random.Random(5), list("czyx")
    shape = [[rng.randint(1, 5), rng.randint(1, 700), rng.randint(1, 3000), rng.randint(1, 3000)] for _ in range(300)]
    voxel = [[1.0, *(rng.choice((4.0, 8.0, 12.0, 40.0, 100.0)) for _ in range(3))] for _ in shape]
    got = {}
    for level, (rows, values) in enumerate(pyramid.plan_many(np.array(shape), np.array(voxel), axes, **limits)):
        for i, r in enumerate(rows.tolist()):
            got.setdefault(r, []).append({"level": level} | {n: v[i].tolist() for n, v in values.items()})
    assert [got[r] for r in range(len(shape))] == [pyramid.plan(s, v, axes, **limits) for s, v in zip(shape, voxel, strict=True)]

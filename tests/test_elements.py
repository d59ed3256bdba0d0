"""The data source over stored arrays against the arrays themselves."""

import os
import tempfile

import numpy as np
import pytest
from test_resample import chunked

from chunkframe.sources import elements, zarr


def stored(spark, a, chunk, **options):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/a"
    zarr.write_chunks(chunked(spark, a, chunk), path, list(a.shape), list(chunk), dtype=a.dtype.name, **options)
    elements.register(spark)
    return path


def expected(a, keep):
    return sorted((*map(int, at), a[at].item()) for at in np.ndindex(a.shape) if keep(*at))


@pytest.mark.parametrize("options", [{"format": "zarr3", "codec": "zstd"}, {"format": "zarr2"}, {"format": "n5"}, {"format": "zarr3", "shard": [8, 12]}])
@pytest.mark.parametrize("dtype", ["uint8", "int32", "float64", "uint64"])
def test_elements(spark, options, dtype):
    a = (np.random.default_rng(3).integers(0, 200, (19, 23)) * (0.5 if dtype == "float64" else 1)).astype(dtype)
    path = stored(spark, a, (4, 6), **options)
    read = lambda **box: spark.read.format("chunked_array").options(axes="y,x", **box).load(path)
    assert sorted(map(tuple, read().collect())) == expected(a, lambda y, x: True)
    assert sorted(map(tuple, read(box="y=5:9, x=13:14").collect())) == expected(a, lambda y, x: 5 <= y < 9 and x == 13)
    assert sorted(map(tuple, read(box="y=:7,x=20:").where("x < 22").collect())) == expected(a, lambda y, x: y < 7 and 20 <= x < 22)
    assert read(box="y=30:40").count() == 0


def test_only_chunks_in_range_are_opened(spark):
    a = np.arange(19 * 23, dtype="int16").reshape(19, 23)
    path = stored(spark, a, (4, 6), names=["y", "x"], fill=-1)
    for name in os.listdir(f"{path}/c/0"):  # broken files that the range does not touch
        with open(f"{path}/c/0/{name}", "wb") as f:
            f.write(b"broken")
    os.rename(f"{path}/c/4/3", f"{path}/away")
    read = lambda box: spark.read.format("chunked_array").option("box", box).load(path)
    assert read("").columns == ["y", "x", "v"]
    assert sorted(map(tuple, read("y=4:16").collect())) == expected(a, lambda y, x: 4 <= y < 16)
    assert {r["v"] for r in read("y=16:,x=18:").collect()} == {-1}
    with pytest.raises(Exception, match="gzip|BadGzip|broken"):
        read("y=:4").collect()
    with pytest.raises(Exception, match="axis=first:stop"):
        read("t=1:2").collect()
    with pytest.raises(Exception, match="no array"):
        spark.read.format("chunked_array").load(path + "/none").count()

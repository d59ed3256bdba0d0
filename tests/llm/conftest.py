import pytest

pytest.importorskip("public_tokenizers")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string, component string, score string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    long = "The cat of the mat and a worthless dog. " * 3000
    near = " ".join(f"w{i}" for i in range(300))
    texts = [None, "", "   ", "Hi", "the of and", "Ünïcode ñandú 漢字 ½ — <|endoftext|> 's x\x85y\x1cz", long, near, near + " tail", near.replace("w5 ", "W5  "), near, "12 34 !!", "a\n\n  b\t\tc   ", "\U0001f600 emoji", "Licensed under the Apache License, Version 2.0."]
    rows = [(i, t, ["en", "de", None][i % 3], None, len(t or ""), "b", "c", "s") for i, t in enumerate(texts)]
    rows += [(7, near, "en", "x", None, "b", "c", "s"), (None, "the idiot of the town", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")

"""A corpus from raw documents: language, toxicity, near duplicates, packing.

Defined cases, for every stage: an empty table gives an empty one; columns beyond those of ``documents``, whatever their
names, stay in all but the last; repeated rows are judged alike. Null and empty texts are in no language
and go with the first stage; given to the others, they are not toxic, near no text, and packed as the end id alone. A very long
text is read whole. Null ids are kept like others; of near texts that tie by id, one row stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkframe.llm import language, packing, similar, toxicity
from chunkframe.llm.common import fresh, written
from chunkframe.llm.registry import tokenizer_path

#: A text whose best cosine is below this is in no language that was learned.
LEAST_COSINE = 0.05

#: Near duplicates: words of a shingle, and the least Jaccard similarity in per cent.
NEAR_WIDTH, NEAR_AT_LEAST = 5, 80


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; those without a letter, or unlike all, go."""
    names, prototypes = language.train(docs)
    lang, cosine = fresh(docs, "_lang"), fresh(docs, "_cosine")
    seen = language.predict(docs, names, prototypes, keep=docs.columns, into=(lang, cosine))
    return seen.where((F.col(lang) != "und") & (F.col(cosine) >= LEAST_COSINE)).select(*docs.columns)


def by_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not predict toxic."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score, toxic = fresh(docs, "_score"), fresh(docs, "_toxic")
    seen = toxicity.score(docs, model, keep=docs.columns, into=(score, toxic))
    return seen.where(F.col(toxic) == 0).select(*docs.columns)


def by_similarity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of similar texts: that with the smallest id, a null id counting as larger than any.

    Rows are told apart by a number of their own, since different texts can share an id.
    """
    row = fresh(docs, "_row")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    groups = similar.similar_components(rows.select(F.col(row).alias("doc_id"), "text"), at_least=NEAR_AT_LEAST, width=NEAR_WIDTH)
    of_row = groups.select(F.col("doc_id").alias("row"), "component_id").join(rows.select(F.col(row).alias("row"), "doc_id"), "row")
    firsts = of_row.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
    return rows.join(firsts.select(F.col("first.row").alias(row)), row, "left_semi").select(*docs.columns)


def by_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("language", by_language), ("toxicity", by_toxicity), ("similar", by_similarity), ("packing", by_packing)]

#: No stage but the last can be said in SQL: classifiers, hashes and a tokenizer decide.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

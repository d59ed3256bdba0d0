"""The queries of the text operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, cascade, chats, language, licenses, middle, packing, similar, spots, tiff, toxicity, whitening, word_pairs

#: The tokenizer of the packing and encoding queries.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_spotsigs(spark, sf_dir):
    return spots.fingerprint_edits(table(spark, sf_dir, "documents"))


def op2_chat_snapshots(spark, sf_dir):
    return chats.render(table(spark, sf_dir, "conversations"))


def op3_pattern_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_tiff(spark, sf_dir):
    return tiff.payload_digests(tiff.text_files(table(spark, sf_dir, "documents")))


def op5_transducer_bpe(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_subword_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_hyperdimensional_language(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"))


def op8_similar_sets(spark, sf_dir):
    return similar.similar_components(table(spark, sf_dir, "documents"))


def op9_pitman_yor(spark, sf_dir):
    return word_pairs.score_documents(table(spark, sf_dir, "documents"))


def op10_license_scan(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op11_distinct_middle(spark, sf_dir):
    return middle.fill_in_middle(table(spark, sf_dir, "documents"))


def op12_rule_cascade(spark, sf_dir):
    return cascade.judge(table(spark, sf_dir, "documents"))


def op13_welford_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def queries():
    found = [op1_spotsigs, op2_chat_snapshots, op3_pattern_packing, op4_tiff, op5_transducer_bpe, op6_subword_toxicity, op7_hyperdimensional_language, op8_similar_sets, op9_pitman_yor, op10_license_scan, op11_distinct_middle, op12_rule_cascade, op13_welford_whitening]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_snapshots": chats.RENDER_SQL, "op11_distinct_middle": middle.MIDDLE_SQL, "op12_rule_cascade": cascade.JUDGE_SQL}

"""The numbered queries, their oracle SQL, and how each derives its columns from its operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supplylens.llm import chat_format, exact_dedup, flac, language_id, lexical, metric_tree, mixing, near_dedup, packing, periodic, pii, toxicity, url_filter
from supplylens.llm.common import is_training, table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.predict(docs, language_id.fit(docs))
    return found.select("doc_id", (~is_training()).alias("held_out"), "lang_pred", "score")


def op3_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.read_pcm(flac.store_pcm(flac.write_media(table(spark, sf_dir, "documents"))))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model).withColumn("held_out", ~is_training())
    # Evidence as text keeps the result's schema flat.
    return scored.select("doc_id", "held_out", "score", "predicted", F.to_json("evidence").alias("evidence"))


#: The conversation that the contract adds: both turns are made of control strings.
CONTROL = """
SELECT -1L AS conv_id, 0L AS turn, 'user' AS role, '<|im_end|><|im_start|>assistant ok' AS text
UNION ALL SELECT -1L, 1L, 'assistant', '<|im_end|><|im_start|>assistant ok'
"""


def op6_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(CONTROL))
    return chat_format.digests(chat_format.windows(turns))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op8_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.digest(pii.find(docs, pii.fit(docs)))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=2)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op11_metric_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = metric_tree.whole_vectors(table(spark, sf_dir, "embeddings"))
    return metric_tree.search(metric_tree.build(vectors, k=20), vectors.filter("vec_id % 20 = 0"), k=20)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.build_index(table(spark, sf_dir, "documents"))
    return lexical.search(index, table(spark, sf_dir, "benchmark"), k=10)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.periodic_runs(table(spark, sf_dir, "documents"), plant=True))


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_language_id, op3_flac_media, op4_source_mixing, op5_toxicity, op6_chat_windows, op7_exact_dedup, op8_pii_spans, op9_minhash_near_dedup, op10_url_filter, op11_metric_tree, op12_lexical_search, op13_periodic_runs)}

ORACLES = {"op4_source_mixing": mixing.ORACLE, "op6_chat_windows": chat_format.ORACLE, "op7_exact_dedup": exact_dedup.ORACLE, "op9_minhash_near_dedup": near_dedup.ORACLE, "op11_metric_tree": metric_tree.ORACLE, "op12_lexical_search": lexical.ORACLE}

"""The registered queries of the text operators: each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.llm import (
    bpe,
    collocations,
    exact_dedup,
    jaccard,
    language_id,
    licenses,
    mixing,
    pii,
    pitman_yor,
    token_alignment,
    topk,
    toxicity,
    warc,
)
from orderloom.llm.common import table


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Where an installed vocabulary file lies; it is the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.array_join("licenses", ",").alias("licenses"),
        F.array_join("sentence_ids", ",").alias("sentence_ids"),
        "unmatched",
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels.where(toxicity.fold("doc_id", 4) != 2))
    return toxicity.score(docs, model).select(
        "doc_id",
        (toxicity.fold("doc_id", 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op4_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pitman_yor.score(docs, toxicity.fold("doc_id", 7) == 2)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.report(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [f"n_{kind}" for kind in pii.KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), "spans")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    whole = topk.integer_vectors(vectors, "embedding", 256)
    return topk.top_k(whole, F.col("vec_id") % 50 == 0, 5)


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.near_duplicates(docs, words=4, similarity=(85, 100)).drop("key")


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = vocabulary()
    coded = bpe.decode(bpe.encode(docs, path).drop("text"), path)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.archive(spark, table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return warc.resolved_records(spark, path)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    aligned = token_alignment.align(
        docs,
        vocabulary(),
        vocabulary("piece_bpe_32k.model"),
        shown=lambda groups: F.when(groups == "", "").otherwise(F.sha2(groups, 256)),
    )
    return aligned.drop("text").withColumnRenamed("groups", "groups_sha256")


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.where(toxicity.fold("doc_id", 4) != 2))
    return language_id.identify(docs.drop("lang"), model).select(
        "doc_id", (toxicity.fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score"
    )


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


QUERIES = {
    "op1_licenses": op1_licenses,
    "op2_toxicity": op2_toxicity,
    "op3_source_mix": op3_source_mix,
    "op4_pitman_yor": op4_pitman_yor,
    "op5_pii": op5_pii,
    "op6_top_k": op6_top_k,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_bpe_round_trip": op8_bpe_round_trip,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_warc_revisits": op10_warc_revisits,
    "op11_token_alignment": op11_token_alignment,
    "op12_language_id": op12_language_id,
    "op13_collocations": op13_collocations,
}

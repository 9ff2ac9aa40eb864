"""The registered queries of this subpackage: thin calls of its operators on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm import (
    audit, decontaminate, language, licences, lines, lm, mixing, mtree, negatives, packing, pii, quality, simhash,
)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(doc_id: str, parts: int) -> Column:
    """Fold of a document: crc32 of its id as text, modulo the number of folds."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts


def in_fold(doc_id: str, parts: int, number: int) -> Column:
    """Whether a document is held out, being of that fold; one without an id has no fold and is held out too."""
    return F.coalesce(fold(doc_id, parts) == number, F.lit(True))


def line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "source", "text")
    made = lines.drop_boilerplate(docs, host="source", n_lines="n_lines", n_dropped="n_dropped")
    return made.select(
        "doc_id", F.col("n_lines").cast("bigint").alias("n_lines"), F.col("n_dropped").cast("bigint").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )


def language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    held_out = in_fold("doc_id", 3, 1)
    model = language.train(docs.filter(~held_out))
    found = language.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def packing_batches(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"))


def simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, folder, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.scan(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", F.size("hits").cast("bigint").alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        decontaminate.digest(F.col("items")).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


def licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan(_table(spark, folder, "documents"), licences.known_licences(spark))


def lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    return lm.score(_table(spark, folder, "documents"), in_fold("doc_id", 5, 1))


def nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return mtree.top_k(_table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


def personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.spans(_table(spark, folder, "documents").select("doc_id", "text"))
    counts = [F.size(f"pii_{k.name}").cast("bigint").alias(f"n_{k.name}") for k in pii.BASE + pii.ADDED]
    return found.select(
        "doc_id", *counts, F.sha2(pii.listed(pii.BASE), 256).alias("base_sha256"), pii.listed(pii.BASE + pii.ADDED).alias("spans"),
    )


def quality_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text", in_fold("doc_id", 5, 0).alias("held_out"))
    learned = docs.filter(~F.col("held_out"))
    model = quality.train(learned, _table(spark, folder, "labels").filter(fold("doc_id", 5) != 0))
    found = quality.score(docs, model)
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit.audit(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.shares(_table(spark, folder, "documents"))


def hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label")
    shifted = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return negatives.mine(_table(spark, folder, "embeddings"), vec_id % 100 == 0, label=shifted)


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": line_dedup,
    "op2_licence_scan": licence_scan,
    "op3_language_id": language_id,
    "op4_lm_scoring": lm_scores,
    "op5_packing": packing_batches,
    "op6_simhash": simhash_groups,
    "op7_top_k": nearest_vectors,
    "op8_pii": personal_data,
    "op9_decontamination": decontamination,
    "op10_quality": quality_scores,
    "op11_filter_audit": filter_audit,
    "op12_source_mix": source_mix,
    "op13_hard_negatives": hard_negatives,
    "pipeline": pipeline,
}

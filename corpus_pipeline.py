"""A corpus pipeline: five stages from raw documents to packed batches.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the ``docs`` of the next one. All but the last
return the columns of ``documents``.

Defined results of every stage: rows with a null id are judged by their texts like others, and no group takes
them away; a null text has no letters and goes with the first stage; repeated rows are judged alike, and one of them stays;
very long texts are read whole; an empty table gives no rows; extra columns are kept by all stages but the last,
whatever they are called. What ties are is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm import decontaminate, language, lines, packing, simhash
from rowloom.llm.words import fresh
from rowloom.session import materialize

#: A text whose best language is no likelier than this is rejected.
LEAST_POSTERIOR = 0.5


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: learns from the labelled documents; texts without letters or without a clear language go.

    Two languages that share a text evenly tie at one half, which is not clear. Without any labelled
    document there is no language to tell, and all texts go.
    """
    model = language.train(docs)
    lang, score = fresh(docs.columns, "_lang"), fresh(docs.columns, "_score")
    found = language.predict(docs, model, lang_pred=lang, score=score)
    return found.filter((F.col(lang) != language.UNDETERMINED) & (F.col(score) > LEAST_POSTERIOR)).drop(lang, score)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: lines that too many documents of a source share go; n_chars follows the text.

    A share of just the limit is not above it. A document that loses all its lines stays, empty; one without a source is as it was.
    """
    made = lines.drop_boilerplate(docs, host="source")
    return made.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: one document of each component stays, the one with the smallest id; of rows of equal id, one."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a window of a benchmark item go; an empty benchmark leaves all."""
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: every document gets its bucket, batch and place; equal ids follow each other by length, null ids come first."""
    return packing.pack(docs)


STAGES = [
    ("language_id", keep_known_language),
    ("line_dedup", drop_boilerplate_lines),
    ("simhash", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack_batches),
]

#: A trained language model decides what the later stages see, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; the written result of the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

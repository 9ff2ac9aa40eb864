"""From a bulk file to a line corpus, a learned vocabulary and encoded lines."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.operators.bpe import (
    Vocabulary, encode, learn, longest_encoded, piece_counts, verify, verify_counts,
)
from rowloom.operators.convert import convert, write_counted
from rowloom.operators.profile import length_profile
from rowloom.sources.tables import read_headerless, read_lines, write_lines
from rowloom.sources.tokens import read_token_ids, write_settings, write_token_ids, write_vocabulary


@dataclass
class Corpus:
    """The written files' vocabulary and the reports on them."""

    vocabulary: Vocabulary
    outcomes: DataFrame
    verified: DataFrame
    lengths: DataFrame
    longest: DataFrame


def build_corpus(
    spark: SparkSession,
    source: str,
    folder: str,
    *,
    names: list[str],
    column: str,
    how: Callable[[str], str | None] | Column,
    sep: str = "\t",
    vocab_size: int = 2000,
    min_frequency: int = 2,
    max_merges: int | None = None,
) -> Corpus:
    """Convert, write the lines, learn, encode, write the ids, and check all of them."""
    converted = convert(read_headerless(spark, source, names, sep), column, how).select("output", "ok")
    outcomes = write_counted(converted, lambda lines: write_lines(lines, "value", f"{folder}/lines"))

    lines = read_lines(spark, f"{folder}/lines", "line", "pos")
    counts = piece_counts(lines, "line", terminator="\n")
    vocabulary = learn(counts, vocab_size, min_frequency, max_merges=max_merges)
    write_vocabulary(spark, vocabulary, f"{folder}/vocabulary")
    write_settings(spark, vocabulary, f"{folder}/vocabulary")

    write_token_ids(encode(lines, "line", vocabulary), "ids", f"{folder}/ids")
    stored = read_token_ids(spark, f"{folder}/ids")
    return Corpus(
        vocabulary,
        outcomes,
        verify_counts(verify(stored, lines, "line", vocabulary)),
        length_profile(stored.select(F.size("ids").alias("length")), "length"),
        longest_encoded(lines, "line", vocabulary),
    )

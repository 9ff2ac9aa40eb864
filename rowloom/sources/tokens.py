"""Token-id files and vocabulary files."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.functions.text import words
from rowloom.operators.bpe import Vocabulary, encode
from rowloom.sources.tables import read_lines


def write_token_ids(df: DataFrame, ids: str, path: str, pos: str = "pos") -> None:
    """(pos, ids) as Parquet: the position is stored, so nothing is sorted."""
    df.select(F.col(pos).alias("pos"), F.col(ids).alias("ids")).write.mode("overwrite").parquet(path)


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """(pos, ids) as written."""
    return spark.read.parquet(path)


def _id_line(ids: str) -> Column:
    return F.array_join(F.transform(ids, lambda i: i.cast("string")), " ")


def export_token_ids(df: DataFrame, ids: str, path: str, pos: str = "pos") -> None:
    """Ids joined by one space, one line per row in order of the position, as text for other tools."""
    df.select(pos, _id_line(ids).alias("value")).orderBy(pos).select("value").write.mode("overwrite").text(path)


def export_encoded(df: DataFrame, text: str, vocabulary: Vocabulary, path: str, pos: str = "pos") -> None:
    """The lines of ``export_token_ids`` from texts that are not encoded yet.

    The texts are put in order before they are encoded: they are shorter than their lines,
    and Spark reads what it sorts twice, so each would be encoded twice.
    """
    coded = encode(df.select(pos, text).orderBy(pos), text, vocabulary, "_ids")
    coded.select(_id_line("_ids").alias("value")).write.mode("overwrite").text(path)


def import_token_ids(spark: SparkSession, path: str, pos: str = "pos") -> DataFrame:
    """(pos, ids) from text lines; a blank line is an empty sequence."""
    lines = read_lines(spark, path, "value", pos, keep_blank=True)
    return lines.select(pos, words("value").cast("array<int>").alias("ids"))


def _write_file(spark: SparkSession, path: str, text: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def write_vocabulary(spark: SparkSession, vocabulary: Vocabulary, folder: str) -> None:
    """vocab.json (token -> id) and merges.txt (version line, then ranked pairs)."""
    ordered = dict(sorted(vocabulary.ids.items(), key=lambda item: item[1]))
    _write_file(spark, f"{folder}/vocab.json", json.dumps(ordered, ensure_ascii=False, separators=(",", ":")))
    lines = ["#version: 0.2", *[f"{a} {b}" for a, b in vocabulary.merges]]
    _write_file(spark, f"{folder}/merges.txt", "\n".join(lines) + "\n")


def write_settings(spark: SparkSession, vocabulary: Vocabulary, folder: str, limit: int = 512) -> None:
    """tokenizer.json next to the vocabulary, in the published layout: dictionary, cuts, framing, cut to ``limit``, padding."""
    start, pad, end = vocabulary.special[0], vocabulary.special[1], vocabulary.special[2]
    by_bytes = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    plain = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}
    settings = {
        "version": "1.0",
        "truncation": {"direction": "Right", "max_length": limit, "strategy": "LongestFirst", "stride": 0},
        "padding": {
            "strategy": "BatchLongest", "direction": "Right", "pad_to_multiple_of": None,
            "pad_id": vocabulary.ids[pad], "pad_type_id": 0, "pad_token": pad,
        },
        "added_tokens": [{"id": vocabulary.ids[t], "content": t, **plain} for t in vocabulary.special],
        "normalizer": None,
        "pre_tokenizer": by_bytes,
        "post_processor": {"type": "BertProcessing", "sep": [end, vocabulary.ids[end]], "cls": [start, vocabulary.ids[start]]},
        "decoder": by_bytes,
        "model": {
            "type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None,
            "fuse_unk": False, "byte_fallback": False, "ignore_merges": False,
            "vocab": vocabulary.ids, "merges": [f"{a} {b}" for a, b in vocabulary.merges],
        },
    }
    _write_file(spark, f"{folder}/tokenizer.json", json.dumps(settings, ensure_ascii=False))


def read_vocabulary(spark: SparkSession, folder: str, special: list[str] | None = None) -> Vocabulary:
    """The vocabulary of the two files; both are bounded by the vocabulary size."""
    entries = (
        spark.read.text(f"{folder}/vocab.json", wholetext=True)
        .select(F.explode(F.from_json("value", "map<string,int>")).alias("token", "id")).collect()
    )
    merges = (
        read_lines(spark, f"{folder}/merges.txt", "value", "pos")
        .filter((F.col("pos") > 0) | ~F.col("value").startswith("#version")).orderBy("pos").collect()
    )
    found = Vocabulary(
        {row["token"]: row["id"] for row in entries},
        [tuple(row["value"].split(" ")) for row in merges],
    )
    if special is not None:
        found.special = list(special)
    return found

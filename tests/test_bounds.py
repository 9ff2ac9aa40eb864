"""What a task holds does not grow with its batches, its texts or the table."""

import io
import random
import tracemalloc
from collections.abc import Iterator
from contextlib import redirect_stdout

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from rowloom.functions import arrays
from rowloom.operators import bpe, features, model, profile
from rowloom.sources import tokens


def peak(work) -> int:
    """The most bytes that Python and numpy held at once."""
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_parts_keep_every_row_in_order():
    lists = pa.array([[1, 2], None, [], [3] * 9, [4], [5, 6]], pa.list_(pa.int32()))[1:]
    parts = list(arrays.bounded_parts(lists, np.diff(lists.offsets.to_numpy()), 3))
    assert [part.to_pylist() for part in parts] == [[None, []], [[3] * 9], [[4], [5, 6]]]
    assert list(arrays.bounded_parts(lists[:0], np.zeros(0, int), 3)) == []


def test_encoding_a_large_batch_takes_no_more_than_a_small_one(spark):
    row = [" the", " cat", "s", " of", " 12345", "!"] * 1000
    encoder = bpe._encoder(bpe.Vocabulary.initial(), spark).func

    def encode(rows):
        return lambda: [len(ids) for ids in encoder(iter([pa.array([row] * rows)]))]

    assert peak(encode(2000)) < 1.5 * peak(encode(500))


def test_remembered_pieces_are_bounded_by_what_they_take(spark):
    encoder = bpe._encoder(bpe.Vocabulary.initial(), spark, 1 << 22).func

    def encode(batches):
        def work():
            made = (pa.array([[str(10_000 * i + j) for j in range(10_000)]]) for i in range(batches))
            return [len(ids) for ids in encoder(made)]

        return work

    assert peak(encode(40)) < 1.5 * peak(encode(10))


def test_encoding_in_parts_equals_encoding_at_once(spark, monkeypatch):
    rows = pa.array([["a", " b"], None, [], [" longer", " b", "é"], ["a"]])
    whole = pa.concat_arrays(list(bpe._encoder(bpe.Vocabulary.initial(), spark).func(iter([rows])))).to_pylist()
    monkeypatch.setattr(bpe, "PART_BYTES", 3)
    parts = list(bpe._encoder(bpe.Vocabulary.initial(), spark).func(iter([rows])))
    assert len(parts) > 1 and pa.concat_arrays(parts).to_pylist() == whole
    assert [None if ids is None else len(ids) for ids in whole] == [3, None, 0, 11, 1]


def test_counting_a_large_batch_takes_no_more_than_a_small_one():
    row = np.arange(4000, dtype=np.int32) % 900

    def count(rows):
        lists = pa.array([row] * rows)
        return lambda: [len(x) for x in arrays._counted(iter([lists]))]

    assert peak(count(2000)) < 1.5 * peak(count(500))


def test_only_the_longest_text_is_encoded(spark):
    df = spark.createDataFrame([(3, "bb"), (2, "aa"), (1, None), (4, "a")], "pos bigint, text string")
    longest = bpe.longest_encoded(df, "text", bpe.Vocabulary.initial())
    lines = plan(longest).splitlines()
    encoded = next(i for i, line in enumerate(lines) if "encode_pieces" in line and "EvalPython" in line)
    assert any("Aggregate" in line for line in lines[encoded:]) and "Sort " not in plan(longest)
    assert [tuple(r) for r in longest.select("pos", "length", "n_tokens").collect()] == [(2, 2, 2)]


def test_the_longest_of_no_texts_is_no_row(spark):
    df = spark.createDataFrame([(1, None)], "pos bigint, text string")
    assert profile.longest_row(df, "text").columns == ["pos", "text", "length"]
    assert profile.longest_row(df, "text").collect() == profile.longest_row(df.filter("pos > 1"), "text").collect() == []
    nulls = spark.createDataFrame([(5, "x"), (None, "y")], "pos bigint, text string")
    assert profile.longest_row(nulls, "text").first()["text"] == "y"


def test_token_vectors_are_added_up_in_the_row(spark):
    df = spark.createDataFrame([(i, [i % 3, 1, 1]) for i in range(6)] + [(0, [9]), (7, [9]), (8, None)], "id bigint, ids array<int>")
    vectors = spark.createDataFrame([(0, [1.0, 2.0]), (1, [4.0, 8.0]), (2, [0.5, 0.0])], "token bigint, vector array<float>")
    pooled = features.pool_tokens(df, "id", "ids", vectors)
    assert "Join" not in plan(pooled) and plan(pooled).count("hashpartitioning") == 1
    got = {r["id"]: r["features"] for r in pooled.collect()}
    three = {0: [3.0, 6.0], 1: [4.0, 8.0], 2: [8.5 / 3, 16 / 3]}
    assert got.keys() == {0, 1, 2, 3, 4, 5, 7, 8} and got[7] is None and got[8] is None
    assert all(np.allclose(got[i], three[i % 3]) for i in range(6))


def test_adding_up_a_large_batch_takes_no_more_than_a_small_one():
    row = np.arange(1024, dtype=np.int32) % 90
    tokens, vectors = np.arange(80), np.ones((80, 64))

    def add(rows):
        lists = pa.array([row] * rows)
        return lambda: [len(x) for x in features._sums(lists, tokens, vectors)]

    assert peak(add(2000)) < 1.5 * peak(add(500))


def test_texts_are_encoded_once_for_a_file_in_order(spark, tmp_path, monkeypatch):
    rows = [(i, None if i == 7 else "" if i == 8 else f"text {i} " * (i % 5)) for i in range(200)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "pos bigint, text string").repartition(4)
    initial, calls = bpe.Vocabulary.initial(), spark.sparkContext.accumulator(0)

    def counted(vocabulary, session):
        encoder = encode(vocabulary, session).func

        @F.arrow_udf("array<int>")
        def seen(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for made in encoder(batches):
                calls.add(len(made))
                yield made

        return seen

    encode = bpe._encoder
    monkeypatch.setattr(bpe, "_encoder", counted)
    tokens.export_encoded(df, "text", initial, str(tmp_path / "lines"))
    assert calls.value == len(rows)
    monkeypatch.setattr(bpe, "_encoder", encode)
    tokens.export_token_ids(bpe.encode(df, "text", initial), "ids", str(tmp_path / "plain"))
    read, plain = [[r["ids"] for r in tokens.import_token_ids(spark, str(tmp_path / x)).orderBy("pos").collect()] for x in ("lines", "plain")]
    assert read == plain and len(read) == 200


def test_pieces_are_packed(spark):
    counts = spark.createDataFrame([("ab", 2), ("abc", 3), ("é", 1)], "piece string, n bigint")
    made = bpe._byte_symbols(counts.coalesce(1), bpe.Vocabulary.initial().byte_ids())
    assert dict(made.dtypes)["symbols"] == "binary"
    held = pa.array([r["symbols"] for r in made.collect()], pa.binary())
    flat, weights = bpe._flat(held[1:], np.array([3, 1]))
    assert (np.flatnonzero(flat == -1).tolist(), weights.tolist()) == ([3, 6], [3] * 4 + [1] * 3)
    assert bpe._flat(held[:0], np.array([], dtype=np.int64))[0].tolist() == []


def test_an_ensemble_is_cut_without_another_fit(spark, monkeypatch):
    draw = random.Random(5)
    points = [[draw.gauss(0, 1) for _ in range(3)] for _ in range(240)]
    data = [(x, [int(x[i] + draw.gauss(0, 0.8) > 0) for i in range(3)], i % 4 == 0) for i, x in enumerate(points)]
    df = spark.createDataFrame(data, "x array<double>, y array<int>, val boolean").repartition(2)
    sizes, fit = [], model.GBTClassifier.fit
    monkeypatch.setattr(model.GBTClassifier, "fit", lambda self, rows: sizes.append(self.getMaxIter()) or fit(self, rows))
    fitted = model.fit_labels(df, "x", "y", 3, validation="val", rounds=30, max_depth=3, first=4, at_once=1)
    tried, want = 0, [4, *[len(one.curve) for one in fitted]]
    assert all(size == 30 or size >= one.rounds + 2 for size, one in zip(want[1:], fitted))
    # every fit tries new rounds: none repeats a smaller one up to the best
    for one in fitted:
        while sizes[tried] < len(one.curve):
            assert sizes[tried + 1] == min(30, 2 * sizes[tried])
            tried += 1
        assert sizes[tried] == len(one.curve)
        tried += 1
    assert tried == len(sizes)
    learned = df.filter("not val").select(array_to_vector("x").alias("_x"), F.col("y")[0].cast("double").alias("_y"))
    plain = fit(model.GBTClassifier(featuresCol="_x", labelCol="_y", maxIter=fitted[0].rounds, stepSize=0.1, maxDepth=3, seed=0), learned)
    rows = df.select(array_to_vector("x").alias("_x"))
    assert fitted[0].model.getNumTrees == fitted[0].rounds == plain.getNumTrees
    got, wanted = [[r["probability"] for r in m.transform(rows).collect()] for m in (fitted[0].model, plain)]
    assert np.allclose(got, wanted, atol=1e-12)


def test_later_labels_begin_where_earlier_ones_ended():
    assert model.first_size(8, [], 2) == 8
    assert model.first_size(8, [5], 2) == 8
    assert model.first_size(8, [20, 9, 12, 14], 2) == 16

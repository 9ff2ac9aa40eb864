"""Positive-unlabelled learning and the metric tree against plain versions."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowloom.llm import mtree, quality
from rowloom.llm.queries import nearest_vectors, quality_scores

SMALL = "/root/testdata/sf0.001"


def plain_risk(positive, unlabelled, prior, model):
    """The non-negative risk, row by row, without the weight decay."""
    g = lambda rows: quality.linear(rows, model)
    loss = lambda z: (1 - z) ** 2 / 4
    return prior * loss(g(positive)).mean(), loss(-g(unlabelled)).mean() - prior * loss(-g(positive)).mean()


def test_risk_and_gradient_from_moments():
    rng = np.random.default_rng(1)
    positive, rest = rng.normal(1, 1, (40, 5)), rng.normal(0, 2, (90, 5))
    space = quality.Space(quality.moments(positive), quality.moments(rest))
    w = rng.normal(size=6)
    first, second = plain_risk(positive, rest, 0.4, space.model(w))
    assert np.isclose(0.4 * quality.loss(space.p, w, 1)[0], first)
    assert np.isclose(quality.negative_part(space, w, 0.4)[0], second)
    for i in range(6):
        step = np.eye(6)[i] * 1e-6
        for part in (lambda v: quality.loss(space.p, v, 1), lambda v: quality.negative_part(space, v, 0.4)):
            slope = (part(w + step)[0] - part(w - step)[0]) / 2e-6
            assert np.isclose(part(w)[1][i], slope, atol=1e-5)


def test_risk_is_minimised_and_not_negative():
    rng = np.random.default_rng(2)
    # more features than rows: without the bound the second part would go far below zero
    positive, rest = rng.normal(0.3, 1, (30, 60)), rng.normal(0, 1, (60, 60))
    model = quality.fit(positive, rest, 0.5)
    first, second = plain_risk(positive, rest, 0.5, model)
    zero = plain_risk(positive, rest, 0.5, {**model, "weights": np.zeros(61)})
    assert first + max(0.0, second) < sum(zero) and second > -0.05
    # where it does not bind, the result is the least of the convex risk
    positive, rest = rng.normal(0.3, 1, (4000, 3)), np.concatenate([rng.normal(0.3, 1, (2000, 3)), rng.normal(-0.6, 1, (6000, 3))])
    space = quality.Space(quality.moments(positive), quality.moments(rest))
    w = quality.fit(positive, rest, 0.25)["weights"]
    exact = np.linalg.solve(space.u / 2 + np.diag(space.decay), 0.25 * space.p[-1] - space.u[-1] / 2)
    assert quality.negative_part(space, exact, 0.25)[0] > 0 and np.allclose(w, exact, atol=1e-3)


@pytest.mark.parametrize("prior", [0.2, 0.5, 0.85])
def test_prior_from_positives_and_unlabelled(prior):
    rng = np.random.default_rng(3)
    n = 20_000
    good = rng.random(n) < prior
    scores = np.where(good, rng.normal(0.8, 0.4, n), rng.normal(-0.8, 0.4, n))
    counts = [np.bincount(quality.bins_of(s), minlength=quality.BINS) for s in (rng.normal(0.8, 0.4, 8000), scores)]
    assert abs(quality.share_of_positives(*counts) - prior) < 0.03
    assert quality.share_of_positives(counts[0], counts[0]) > 0.95


def rows_of_words(rng, n, words):
    return [" ".join(rng.choice(words, size=30)) for _ in range(n)]


def test_training_equals_a_plain_version(spark):
    rng = np.random.default_rng(4)
    texts = rows_of_words(rng, 160, ["plain", "words", "go", "here."]) + rows_of_words(rng, 60, ["##", "$$!", "||", "go"])
    texts += [None, "", "go " * 50_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (5, "another text"), (None, "no id")]
    marks = [(i, 1) for i in range(0, 120, 2)] + [(3, 0), (3, 1), (7, None), (None, 1), (9999, 1), (200, 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int").withColumn("trusted", F.lit("x"))
    model = quality.train(docs.withColumn("half", F.lit("x")), labels)

    half = {r[0]: r[1] for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(2))).distinct().collect()}
    good = {i for i, q in marks if q == 1 and i is not None}
    made = quality.features([None if t is None else t.encode() for _, t in rows]) / quality.FULL
    trusted, side = np.array([i in good for i, _ in rows]), np.array([half[i] for i, _ in rows])
    assert trusted.sum() == 60 + 1  # id 3 as well; 5 is odd
    shares = []
    for h in (0, 1):
        there, here = side != h, side == h
        score = quality.separate(quality.moments(made[there & trusted]), quality.moments(made[there]))
        bins = quality.bins_of(quality.linear(made, score))
        shares.append(quality.share_of_positives(*[np.bincount(bins[here & k], minlength=quality.BINS) for k in (trusted, here)]))
    assert np.isclose(model["prior"], np.mean(shares))
    plain = quality.fit(made[trusted], made, model["prior"])
    for name in ("mean", "spread", "weights"):
        assert np.allclose(model[name], plain[name], atol=1e-6)
    again = quality.train(docs.repartition(2), labels)
    assert all(np.array_equal(model[name], again[name]) for name in model)

    # a bound on the positives takes the least hashes, ties and repeats change nothing
    fewer = quality.train(docs, labels, positives=20)
    assert fewer is not None and fewer["prior"] > 0
    assert quality.train(docs.limit(0), labels) is None and quality.train(docs, labels.filter("quality = 0")) is None


def test_scores_keep_clashing_columns_and_long_texts(spark):
    rng = np.random.default_rng(5)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(rows_of_words(rng, 40, ["a", "b."]) + ["x" * 3_000_000, "\n" * 100_000])], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(10)], "doc_id bigint, quality int")
    model = quality.train(docs, labels)
    wide = docs.select("*", F.lit(9).alias("score"), F.lit("x").alias("trusted"), F.lit("y").alias("half"))
    found = quality.score(wide, model).collect()
    assert len(found) == 42 and all(0 <= r["score"] <= 1 and r["trusted"] == "x" and r["half"] == "y" for r in found)


def test_quality_query_over_the_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    labels = dict(spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "quality").collect())
    learned = [r for r in docs if zlib.crc32(str(r["doc_id"]).encode()) % 5]
    made = quality.features([r["text"].encode() for r in learned]) / quality.FULL
    good = np.array([labels.get(r["doc_id"]) == 1 for r in learned])
    query = quality_scores(spark, SMALL)
    found = {r["doc_id"]: r["score"] for r in query.collect()}
    # the prior is the model's, checked above; the rest of the way is the plain one
    table = spark.read.parquet(f"{SMALL}/documents.parquet").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    prior = quality.train(table, spark.read.parquet(f"{SMALL}/labels.parquet"))["prior"]
    plain = quality.fit(made[good], made, prior)
    for r in docs:
        g = float(quality.linear(quality.features([r["text"].encode()]) / quality.FULL, plain)[0])
        assert abs(found[r["doc_id"]] - 1 / (1 + np.exp(-2 * g))) < 1e-5


# -- the metric tree

def clustered(rng, n, clusters=40, length=16):
    middles = rng.normal(size=(clusters, length)) * 4
    return middles[rng.integers(0, clusters, n)] + rng.normal(size=(n, length)) * 0.05


def test_bounds_leave_most_products_out_on_clusters():
    rng = np.random.default_rng(6)
    points = np.floor(clustered(rng, 4000) * 1024).astype(np.int64)
    ids = np.arange(4000)
    shard = mtree.Shard(ids, points)
    sample = (ids[::16], points[::16])
    for q in range(0, 4000, 400):
        floor = mtree.first_bound(sample, q, points[q], 10)
        scores = points @ points[q]
        order = [i for i in np.lexsort((ids, -scores)) if i != q][:10]
        assert shard.best(q, points[q], 10, floor) == [(int(i), int(scores[i])) for i in order]
    assert shard.tree.offered + shard.tree.computed < 0.5 * 10 * 4000


def test_first_bound_lowers_the_work_and_not_the_result():
    rng = np.random.default_rng(7)
    points = np.floor(clustered(rng, 2000) * 1024).astype(np.int64)
    free, bound = mtree.Shard(np.arange(2000), points), mtree.Shard(np.arange(2000), points)
    for q in range(0, 2000, 100):
        best = free.best(q, points[q], 5)
        assert bound.best(q, points[q], 5, best[-1][1]) == best
    assert bound.tree.offered <= free.tree.offered


def test_repeated_rows_do_not_fill_a_shard(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(300)]
    vectors = spark.createDataFrame(rows + [rows[100]] * 2000 + [(500, [])], "vec_id bigint, embedding array<double>")
    once = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    asks = F.col("vec_id") % 100 == 0
    assert sorted(mtree.top_k(vectors, asks, shard_rows=50).collect()) == sorted(mtree.top_k(once, asks).collect())


def test_scores_below_64_bits_are_ties(spark):
    # every product is less than the least 64-bit number: the smaller ids win
    rows = [(0, [1e18])] + [(i, [-1e17 * (50 - i)]) for i in range(1, 40)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = mtree.top_k(vectors, F.col("vec_id") == 0, k=3, page=4, shard_rows=10).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in found] == [(i, -(1 << 63)) for i in (1, 2, 3)]


def test_top_k_query_over_the_tables(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    ids = np.array([r["vec_id"] for r in table])
    points = np.floor(np.array([r["embedding"] for r in table], dtype=np.float64) * 1024).astype(np.int64)
    want = []
    for q in np.flatnonzero(ids % 100 == 0):
        scores = points @ points[q]
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != ids[q]][:10]
        want += [(int(ids[q]), place, int(ids[i]), int(scores[i])) for place, i in enumerate(order, 1)]
    assert sorted(map(tuple, nearest_vectors(spark, SMALL).collect())) == sorted(want)

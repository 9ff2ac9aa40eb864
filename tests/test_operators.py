import bisect
import random

import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from rowloom.operators import curate, features, lists, metrics, model, order, profile
from rowloom.operators.convert import convert, outcome_counts
from rowloom.sources.tables import read_lines
from rowloom.session import materialize


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


# --- order ---------------------------------------------------------------------


def test_dense_order_over_many_partitions(spark):
    df = spark.range(0, 3000, 1, 7).select((F.col("id") * 37 % 3001).alias("v"))
    got = sorted((r["pos"], r["v"]) for r in order.dense_order(df, "v").collect())
    assert got == list(enumerate(sorted(i * 37 % 3001 for i in range(3000))))


def test_ingest_order_over_several_files(spark, tmp_path):
    for name in ("b", "a", "c"):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name}{i}\n" for i in range(50 if name == "a" else 500)))
    got = sorted((r["pos"], r["value"]) for r in order.ingest_order(spark.read.text(str(tmp_path))).collect())
    want = [f"{n}{i}" for n in "abc" for i in range(50 if n == "a" else 500)]
    assert got == list(enumerate(want))


@pytest.fixture
def small_splits(spark):
    """Files are cut into splits of 2 KB, several of which share a task."""
    names = {"spark.sql.files.maxPartitionBytes": "2048", "spark.sql.files.openCostInBytes": "1"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def test_lines_of_many_splits_keep_their_order(spark, tmp_path, small_splits):
    """Files of several splits and of less than one; blank lines are not numbered."""
    want = []
    for name, n in (("a", 900), ("b", 30), ("c", 0), ("d", 2500), ("e", 1)):
        lines = [f"{name}{i}" + "x" * (i % 7) for i in range(n)]
        (tmp_path / f"{name}.txt").write_text("".join(x + ("\n\n" if i % 5 == 0 else "\n") for i, x in enumerate(lines)))
        want += lines
    numbered = read_lines(spark, str(tmp_path), "value", "pos")
    got = sorted((r["pos"], r["value"]) for r in numbered.collect())
    assert got == list(enumerate(want))
    assert numbered.rdd.getNumPartitions() > 4


def test_file_rows_are_numbered_without_a_copy(spark, tmp_path, small_splits):
    """Parquet knows its row numbers; a filter leaves the dense numbers of what it keeps."""
    spark.range(3000).select("id", F.md5(F.col("id").cast("string")).alias("x")).repartitionByRange(3, "id").sortWithinPartitions("id").write.parquet(str(tmp_path / "t"))
    scan = spark.read.parquet(str(tmp_path / "t"))
    numbered = order.ingest_order(scan)
    assert numbered.filter("pos <> id").count() == 0 and numbered.count() == 3000
    plan = numbered._jdf.queryExecution().optimizedPlan().toString()
    assert "file_path" in plan and plan.count("Join") == 1 and "xxhash64" in plan
    kept = order.ingest_order(scan.filter("id % 3 = 1"))
    assert [r["pos"] for r in kept.orderBy("id").collect()] == list(range(1000))


def test_files_cut_anew_are_an_error(spark, tmp_path, small_splits):
    (tmp_path / "a.txt").write_text("".join(f"line {i}\n" for i in range(2000)))
    numbered = order.ingest_order(spark.read.text(str(tmp_path)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    with pytest.raises(Exception, match="cut anew"):
        numbered.agg(F.sum("pos")).collect()


def test_concat_puts_the_second_table_behind(spark):
    left = spark.createDataFrame([("a", 4), ("b", 2)], "x string, pos bigint")
    right = spark.createDataFrame([(9, "c"), (0, "d")], "pos bigint, x string")
    assert rows(order.concat_rows(left, right), "pos", "x") == [(0, "b"), (1, "a"), (2, "d"), (3, "c")]
    loose = order.concat_rows(left, right, dense=False).orderBy("pos")
    assert [r["x"] for r in loose.collect()] == ["b", "a", "d", "c"]


@pytest.mark.parametrize("rows_per_bin", [50, 10**6])
def test_running_sums_with_a_hot_key(spark, rows_per_bin):
    random.seed(1)
    data = {}
    for _ in range(1500):
        data[(random.choice(["hot"] * 5 + ["x", "y"]), random.random() * 10)] = random.randint(0, 4)
    df = materialize(spark.createDataFrame([(k, o, n) for (k, o), n in data.items()], "k string, o double, n bigint"))
    got = {(r["k"], r["o"]): r["run_n"] for r in order.running_sums(df, "o", ["n"], ["k"], rows_per_bin).collect()}
    total = {}
    for (k, o), n in sorted(data.items()):
        total[k] = total.get(k, 0) + n
        assert got[(k, o)] == total[k]
    assert len(got) == len(data)


def test_running_sums_sort_a_hot_key_in_many_tasks(spark):
    df = materialize(spark.range(1000).select(F.lit("hot").alias("k"), F.col("id").alias("o"), F.lit(1).alias("n")))
    plan = order.running_sums(df, "o", ["n"], ["k"], 50)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k" in plan and "_bin" in plan


# --- lists -----------------------------------------------------------------------


def test_ordered_lists_keep_order_and_repeats(spark):
    df = spark.createDataFrame(
        [("u", "b", 5), ("u", "a", 1), ("u", "b", 3), ("v", "c", 2), (None, "d", 4)], "k string, v string, pos bigint"
    ).repartition(3)
    got = {r["k"]: (r["labels"], r["first"]) for r in lists.ordered_lists(df, "k", "v", "pos").collect()}
    assert got == {"u": (["a", "b", "b"], 1), "v": (["c"], 2), None: (["d"], 4)}
    marked = df.withColumn("kept", F.col("v") == "b")
    got = {r["k"]: r["labels"] for r in lists.ordered_lists(marked, "k", "v", "pos", kept="kept").collect()}
    assert got == {"u": ["b", "b"], "v": [], None: []}


def test_long_lists_come_in_bounded_parts(spark):
    df = spark.range(1000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k"),
        F.concat(F.lit("l"), "id").alias("v"), F.col("id").alias("pos"),
    )
    df = df.withColumn("pos", F.col("pos") * 1000)
    got = lists.list_parts(df, "k", "v", "pos", 100).collect()
    hot = sorted((r["part"], r["labels"]) for r in got if r["k"] == "hot")
    assert [len(labels) for _, labels in hot] == [100] * 6 + [66]
    assert [x for _, labels in hot for x in labels] == [f"l{i}" for i in range(1000) if i % 3]
    assert all(r["part"] == 0 for r in got if r["k"] != "hot")


def test_label_counts_count_occurrences_and_rank_by_first_appearance(spark):
    df = spark.createDataFrame([(1, ["b", "b"]), (0, ["c"]), (2, ["a", "c", "a"])], "pos bigint, l array<string>")
    counts = lists.label_counts(df, "l", "pos")
    assert rows(counts, "label", "n") == [("a", 2), ("b", 2), ("c", 2)]
    assert [r["label"] for r in lists.top_labels(counts, 2).collect()] == ["c", "b"]


def test_cumulative_counts_start_at_zero(spark):
    counts = spark.createDataFrame([("a", 5), ("b", 7)], "label string, n bigint")
    got = lists.cumulative_counts(lists.top_labels(counts, 20, "label"), "label").orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(0, "", 0, 0), (1, "b", 7, 7), (2, "a", 5, 12)]


def test_pruning_keeps_emptied_rows(spark):
    df = spark.createDataFrame(
        [(0, "x", ["a", "r", "a"]), (1, "y", ["r"]), (2, "z", []), (3, "w", None)], "pos bigint, name string, l array<string>"
    )
    rare = lists.rare_labels(lists.label_counts(df, "l"), 3)
    assert rows(rare, "label") == [("a",), ("r",)]
    rare = rare.filter("label = 'r'")
    got = {r["name"]: r["l"] for r in lists.prune_labels(df, "l", rare, ["pos"]).collect()}
    assert got == {"x": ["a", "a"], "y": [], "z": [], "w": None}


def test_a_null_label_can_be_rare(spark):
    df = spark.createDataFrame([(0, ["a", None, "a"]), (1, [None])], "pos bigint, l array<string>")
    rare = lists.rare_labels(lists.label_counts(df, "l"), 3)
    got = {r["pos"]: r["l"] for r in lists.prune_labels(df, "l", rare.filter("label IS NULL"), ["pos"]).collect()}
    assert got == {0: ["a", "a"], 1: []}
    assert lists.median_count(lists.label_counts(df, "l")) == 2.0
    assert lists.median_count(lists.label_counts(df.limit(0), "l")) == 0.0


def test_positions_survive_nested_unions(spark):
    one = spark.createDataFrame([(7, "a"), (3, "b")], "pos bigint, v string")
    whole = order.concat_rows(order.concat_rows(one, one, dense=False), order.concat_rows(one, one, dense=False), dense=False)
    got = [r["v"] for r in whole.orderBy("pos").collect()]
    assert got == ["b", "a"] * 4 and whole.select("pos").distinct().count() == 8
    assert order.concat_rows(one.limit(0), one, dense=False).count() == 2


def test_infinite_values_in_bins(spark):
    values = [float("-inf")] * 30 + [float(i) for i in range(40)] + [float("inf")] * 30
    df = materialize(spark.createDataFrame([(v, 1) for v in sorted(set(values))], "o double, n int"))
    got = order.running_sums(df, "o", ["n"], rows_per_bin=5).collect()
    assert sorted(r["run_n"] for r in got) == list(range(1, 43))
    found = profile.describe_numeric(spark.createDataFrame([(v,) for v in [1.0, 2.0, 4.0, float("nan"), None]], "v double"), "v").first()
    assert (found["count"], found["max"], found["p50"]) == (3, 4.0, 2.0)
    infinite = profile.describe_numeric(spark.createDataFrame([(v,) for v in values], "v double"), "v").first()
    assert (infinite["p25"], infinite["p75"]) == (float("-inf"), float("inf"))


def test_counts_are_hashed_and_not_sorted(spark):
    df = spark.createDataFrame([(1, ["b"])], "pos bigint, l array<string>")
    plan = lists.label_counts(df, "l", "pos")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
    keys = spark.createDataFrame([(1, 2, 3)], "k int, e bigint, pos bigint")
    plan = curate.duplicate_entities(keys, ["k"], "e", "pos")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


# --- curation ----------------------------------------------------------------------


def test_null_rules(spark):
    df = spark.createDataFrame([("a", "x"), ("b", None), ("c", "y"), (None, "")], "id string, t string")
    assert {r["id"] for r in curate.exclude_value(df, "t", "x").collect()} == {"b", "c", None}
    assert rows(curate.ids_of_type(df, "id", "t", "x"), "id") == [("a",)]
    assert {r["id"] for r in curate.non_empty(df, "t").collect()} == {"a", "c"}
    ids = spark.createDataFrame([("a",), (None,), ("a",)], "id string")
    assert {r["id"] for r in curate.restrict(df, ids, "id").collect()} == {"a", None}
    assert {r["id"] for r in curate.exclude(df, ids, "id").collect()} == {"b", "c"}
    values = spark.createDataFrame([(None, 1), ("a", 2), ("a", 3)], "id string, v int")
    got = curate.attach(df, values, ["id"], ["v"])
    assert sorted((str(r["id"]), r["v"] or 0) for r in got.collect()) == [("None", 1), ("a", 2), ("a", 3), ("b", 0), ("c", 0)]


def entity_rows():
    random.seed(3)
    keys = [None] * 4 + ["hot"] * 3 + [f"k{i}" for i in range(60)]
    return [(f"e{random.randint(0, 40)}", random.choice(keys), i) for i in range(80)]


def test_duplicate_flags_match_pandas(spark):
    data = entity_rows()
    df = spark.createDataFrame(data, "e string, k string, pos bigint").repartition(4)
    frame = pd.DataFrame(data, columns=["e", "k", "pos"])
    want = frame.duplicated(subset=["k"], keep="first")
    got = curate.flag_duplicates(df, "k", "pos").orderBy("pos").collect()
    assert [r["is_duplicate"] for r in got] == want.tolist()


@pytest.mark.parametrize("nulls_are_equal", [True, False])
def test_duplicate_entities_lose_all_rows(spark, nulls_are_equal):
    data = entity_rows()
    df = spark.createDataFrame(data, "e string, k string, pos bigint").repartition(4)
    frame = pd.DataFrame(data, columns=["e", "k", "pos"])
    base = frame if nulls_are_equal else frame[frame["k"].notna()]
    drop = base[base.duplicated(subset=["k"], keep="first")]["e"]
    want = frame[~frame["e"].isin(drop)]["pos"].tolist()
    got = curate.drop_duplicate_entities(df, ["k"], "e", "pos", nulls_are_equal)
    assert [r["pos"] for r in got.orderBy("pos").collect()] == want
    assert 0 < len(want) < len(data)


def test_first_row_goes_when_its_entity_has_the_duplicate(spark):
    df = spark.createDataFrame([("a", "k", 0), ("a", "k", 1), ("b", "m", 2), ("c", "n", 3)], "e string, k string, pos bigint")
    assert rows(curate.drop_duplicate_entities(df, ["k"], "e", "pos"), "pos") == [(2,), (3,)]


def test_no_window_over_the_duplicate_key(spark):
    df = spark.createDataFrame(entity_rows(), "e string, k string, pos bigint")
    for built in (curate.flag_duplicates(df, "k", "pos"), curate.drop_duplicate_entities(df, ["k"], "e", "pos")):
        assert "Window" not in built._jdf.queryExecution().optimizedPlan().toString()


def test_flagged_rows_stay_where_they_are(spark):
    df = spark.createDataFrame(entity_rows(), "e string, k string, pos bigint").withColumn("wide", F.repeat(F.lit("x"), 1000))
    built = curate.flag_duplicates(df, "k", "pos")
    plan = built._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "BroadcastExchange" in plan
    assert curate.later_places(df, "k", "pos").columns == ["pos"]


def test_lookup_counter_advances_over_failed_details(spark):
    gaps = spark.createDataFrame([("e1", "n1", 7), ("e2", "none", 8), ("e3", "n3", 9)], "entity string, name string, pos bigint")
    dictionary = spark.createDataFrame(
        [("n1", 0, "m1", "v1", True), ("n1", 1, "m2", "v2", False), ("n3", 2, "m3", None, True)],
        "name string, order bigint, matched_name string, matched_value string, found boolean",
    )
    got = curate.lookup(gaps, dictionary, name="name")
    assert rows(got, "entity", "code", "matched_name", "query_name") == [
        ("e1", "DBX071", "m1", "n1"), ("e3", "DBX093", "m3", "n3"),
    ]


# --- profiles -----------------------------------------------------------------------


def test_describe_matches_pandas(spark):
    values = [1.5, 2.0, 2.0, 9.25, -3.0, None, 4.0]
    got = profile.describe_numeric(spark.createDataFrame([(v,) for v in values], "v double"), "v").first()
    want = pd.Series(values, dtype=float).describe()
    assert [got[i] for i in range(8)] == pytest.approx(want.tolist())


def test_describe_of_one_value_has_no_spread(spark):
    got = profile.describe_numeric(spark.createDataFrame([(3,)], "v int"), "v").first()
    assert (got["count"], got["mean"], got["std"], got["p50"]) == (1, 3.0, None, 3.0)


def test_describe_text_with_lists_and_ties(spark):
    df = spark.createDataFrame([(0, "b", ["x"]), (1, "a", ["x"]), (2, "a", []), (3, "b", None)], "pos bigint, s string, l array<string>")
    got = {r["column"]: tuple(r)[1:] for r in profile.describe_text(df, ["s", "l"], "pos").collect()}
    assert got == {"s": (4, 2, "b", 2), "l": (3, 2, '["x"]', 2)}


def test_describe_text_in_one_scan(spark):
    """Numbers tie as numbers, empty columns keep their row, and more columns do not mean more scans."""
    df = spark.createDataFrame([(10, 0.0, None, "x"), (9, -0.0, None, None), (10, 2.5, None, "y"), (9, 1.5, None, "x")], "a int, b double, c string, d string")
    made = profile.describe_text(df, ["a", "b", "c", "d"])
    got = {r["column"]: tuple(r)[1:] for r in made.collect()}
    assert got == {"a": (4, 2, "9", 2), "b": (4, 3, "0.0", 2), "c": (0, 0, None, None), "d": (3, 2, "x", 2)}
    assert made._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2


@pytest.mark.parametrize("size", [64, 200])
def test_merged_sketches_stay_within_their_error(spark, size):
    df = spark.range(60_000).selectExpr("id % 7 AS part", "CAST(pmod(hash(id), 10007) AS BIGINT) * CAST(1 + id % 3 AS BIGINT) AS v")
    parts = profile.length_sketches(df.unionByName(df.limit(1).selectExpr("part", "CAST(NULL AS BIGINT) AS v")), "v", ["part"], size)
    found = profile.sketch_profile(profile.merged_sketches(parts)).first()
    values = sorted(r["v"] for r in df.select("v").collect())
    assert found["n"] == 60_000 and profile.sketch_profile(parts).count() == 7
    for name, q in {"median": 0.5, **profile.LENGTH_FRACTIONS}.items():
        low, high = bisect.bisect_left(values, found[name]) / 60_000, bisect.bisect_right(values, found[name]) / 60_000
        assert low - profile.sketch_error(size) <= q <= high + profile.sketch_error(size)


def test_length_profile_of_one_line(spark):
    got = profile.length_profile(spark.createDataFrame([(4,)], "v int"), "v").first()
    assert (got["n"], got["mean"], got["median"], got["longest"], got["p99_9"]) == (1, 4.0, 4.0, 4, 4.0)


def test_longest_row_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([(2, "bbb"), (1, "aaa"), (0, "x")], "pos bigint, t string")
    assert tuple(profile.longest_row(df, "t").first()) == (1, "aaa", 3)


# --- conversion ------------------------------------------------------------------------


def test_conversion_accounts_for_every_row(spark):
    def double(value):
        if value == "bad":
            raise ValueError(value)
        return "" if value == "empty" else None if value == "none" else value * 2

    df = spark.createDataFrame([("a",), ("bad",), ("empty",), ("none",), (None,)], "t string")
    done = convert(df, "t", double)
    assert {r["t"]: r["output"] for r in done.collect()} == {"a": "aa", "bad": None, "empty": None, "none": None, None: None}
    assert tuple(outcome_counts(done).first()) == (5, 1, 4, 20.0)
    assert tuple(outcome_counts(done.limit(0)).first()) == (0, 0, 0, None)


# --- features and scores -----------------------------------------------------------------


def test_unknown_featuriser_fails_before_any_work(spark):
    with pytest.raises(ValueError):
        features.featurise(None, "id", "text", method="nope")


def test_hashed_vectors_match_their_counts(spark):
    df = spark.createDataFrame([(1, "a b a b"), (2, " "), (3, None), (4, "x")], "id bigint, t string")
    vectors = {r["id"]: r["features"] for r in features.featurise(df, "id", "t", width=16).collect()}
    counts = {}
    for r in features.hashed_counts(df, "id", "t", width=16).collect():
        counts.setdefault(r["id"], [0] * 16)[r["bucket"]] = r["n"]
    assert sum(vectors[1]) == 4 + 3 + 2 + 1 and sum(vectors[4]) == 1
    assert {k: v for k, v in vectors.items() if sum(v)} == counts
    assert vectors[2] == vectors[3] == [0] * 16


def test_hashed_vectors_do_not_shuffle(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    plan = features.featurise(documents, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_mean_pool_without_valid_rows_is_null(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0], 1), ("a", [9.0, 9.0], 0), ("a", [3.0, 4.0], 1), ("b", [1.0, 1.0], 0)],
                               "id string, v array<double>, m int")
    got = {r["id"]: r["features"] for r in features.mean_pool(df, "id", "v", "m").collect()}
    assert got == {"a": [2.0, 3.0], "b": None}


def test_exact_match(spark):
    df = spark.createDataFrame([([1, 0], [1, 0]), ([1, 0], [1, 1])], "y array<int>, p array<int>")
    assert metrics.exact_match(df, "y", "p").first()[0] == 0.5


def test_scores_with_ties_and_single_classes(spark):
    df = spark.createDataFrame(
        [("t", 0.9, 1), ("t", 0.5, 1), ("t", 0.5, 0), ("t", 0.1, 0), ("pos", 0.3, 1), ("neg", 0.3, 0)],
        "label string, score double, truth int",
    )
    got = {r["label"]: (r["roc_auc"], r["avg_precision"]) for r in metrics.ranking_scores(df, "label", "score", "truth").collect()}
    assert got["t"] == pytest.approx((0.875, 0.5 + 0.5 * 2 / 3))
    assert got["pos"] == (None, 1.0) and got["neg"] == (None, 0.0)


def test_label_matrix(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, [None])], "id bigint, l array<string>")
    classes = model.class_list(df, "l")
    assert classes == ["a", "b"]
    assert [r["y"] for r in model.binarize(df, "l", classes).orderBy("id").collect()] == [[1, 1], [0, 0], [0, 0]]
    assert rows(model.label_indices(df, "id", "l"), "id", "index") == [(1, 0), (1, 1)]


def test_split_is_repeatable_and_about_a_fifth(spark):
    df = spark.range(5000).withColumn("t", model.hash_split("id"))
    share = df.filter("t").count() / 5000
    assert 0.18 < share < 0.22
    assert df.filter("t").exceptAll(spark.range(5000).repartition(7).withColumn("t", model.hash_split("id")).filter("t")).count() == 0


def test_best_round_waits_for_patience():
    assert model.best_round([5, 4, 3], 2) == (3, False)
    assert model.best_round([5, 4, 4.5, 3, 3.5, 3.6, 1], 2) == (4, True)
    assert model.best_round([5, 4, 4.5, 3, 3.5, 3.6, 1], 1) == (2, True)
    assert model.best_round([2, 2, 2], 2) == (1, True)
    assert model.best_round([], 2) == (0, False)


def test_boosting_is_cut_at_its_best_round(spark):
    random.seed(3)
    data = []
    for i in range(260):
        x = [random.gauss(0, 1) for _ in range(3)]
        data.append((x, [int(x[0] + random.gauss(0, 0.8) > 0), int(x[1] > 0.2)], i % 4 == 0))
    df = spark.createDataFrame(data, "x array<double>, y array<int>, val boolean").repartition(2)
    fitted = model.fit_labels(df, "x", "y", 2, validation="val", rounds=30, max_depth=3, first=4)
    held = df.filter("val").select(array_to_vector("x").alias("_x"), F.col("y"))
    for i, one in enumerate(fitted):
        best, stopped = model.best_round(one.curve, 2)
        assert one.rounds == best == one.model.getNumTrees and (stopped or len(one.curve) == 30)
        losses = one.model.evaluateEachIteration(held.withColumn("_y", F.col("y")[i].cast("double")))
        assert losses == pytest.approx(one.curve[:best])
    assert fitted[1].curve[fitted[1].rounds - 1] < fitted[1].curve[0]
    scored = model.predict_labels(df, [one.model for one in fitted], "x")
    assert scored.filter(F.col("predicted")[1] == F.col("y")[1]).count() > 230
    whole = model.fit_labels(df.withColumn("val", F.lit(False)), "x", "y", 1, validation="val", rounds=3, max_depth=2)
    assert (whole[0].rounds, whole[0].curve) == (3, [])


@pytest.mark.parametrize("n", [0, 1, 4, 5, 6, 333])
def test_exact_split_has_the_exact_size(spark, n):
    df = spark.createDataFrame([(i, k) for i in range(n) for k in range(1 + i % 2)], "id bigint, k int")
    split = model.exact_split(df, "id")
    assert split.filter("is_test").select("id").distinct().count() == -(-n // 5)
    assert split.groupBy("id").agg(F.count_distinct("is_test").alias("sides")).filter("sides > 1").count() == 0
    again = model.exact_split(df.repartition(3), "id")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, split.collect()))


def test_class_list_is_bounded(spark):
    df = spark.createDataFrame([(["a", "b"],), (["c", None],)], "l array<string>")
    assert model.class_list(df, "l", most=3) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        model.class_list(df, "l", most=2)


@pytest.mark.parametrize("sent_bytes", [1 << 20, 0])
def test_token_vectors_are_pooled(spark, sent_bytes):
    """Both ways of meeting the vectors, with masks, cuts, unknown tokens and empty sequences."""
    vectors = spark.createDataFrame([(t, [float(t), t * t / 2.0]) for t in range(6)], "token int, vector array<double>")
    rows_ = [(1, [0, 1, 2, 3], [1, 0, 1, 1]), (2, [5] * 40, [1] * 40), (3, [], []), (4, [1, 2], [0, 0]), (5, [9, 4], [1, 1]), (6, None, None), (None, [2], [1])]
    df = spark.createDataFrame(rows_, "id int, ids array<int>, mask array<int>")
    got = {r["id"]: r["features"] for r in features.pool_tokens(df, "id", "ids", vectors, mask="mask", limit=3, sent_bytes=sent_bytes, salts=4).collect()}
    assert got == {1: [1.0, 1.0], 2: [5.0, 12.5], 3: None, 4: None, 5: [4.0, 8.0], 6: None, None: [2.0, 2.0]}

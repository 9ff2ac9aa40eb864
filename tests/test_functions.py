from pyspark.sql import functions as F

from rowloom.functions import arrays, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_name_to_code_edges(spark):
    cases = {
        "Cytochrome P450 1A2": "CYP1A2",
        "Cytochrome P450 2C12, female-specific": "CYP2C12",
        "Putative Cytochrome P450 2D7": "CYPP450",
        "cytochrome p450 1A2": None,
        "Cytochrome P450": None,
        "\tCytochrome P450 3A4": "CYP3A4",
        "Albumin": None,
        None: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "name string")
    got = {r[0]: r[1] for r in df.select("name", text.name_to_code("name")).collect()}
    assert got == cases


def test_parse_list_is_no_eval(spark):
    cases = {
        "['a', 'b']": ["a", "b"],
        "[\"a's\", 'b']": ["a's", "b"],
        "[]": [],
        "__import__('os').getcwd()": None,
        "['a', None]": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r[0]: r[1] for r in df.select("t", text.parse_list("t")).collect()}
    assert got == cases


def test_list_text_round_trip(spark):
    value = ["a", 'quote"', "it's", "comma,"]
    df = spark.createDataFrame([(value,)], "l array<string>")
    assert df.select(text.parse_list(text.list_text("l"))).first()[0] == value


def test_word_count_of_blank_text(spark):
    df = spark.createDataFrame([("",), ("  \t",), ("a  b\nc",)], "t string")
    assert [r[0] for r in df.select(text.word_count("t")).collect()] == [0, 0, 3]


def test_indicator_and_top_class(spark):
    df = spark.createDataFrame([(["b", "b"],), ([],)], "l array<string>")
    assert [r[0] for r in df.select(arrays.indicator("l", ["a", "b", "c"])).collect()] == [[0, 1, 0], [0, 0, 0]]
    scores = F.array(F.lit(0.1), F.lit(0.7), F.lit(0.7))
    assert one(spark, arrays.top_class(scores, ["a", "b", "c"])) == "b"


def test_sparse_counts(spark):
    df = spark.createDataFrame([([3, 1, 3],), ([],), ([2],)], "i array<int>").coalesce(1)
    assert [[tuple(x) for x in r[0]] for r in df.select(arrays.sparse_counts("i")).collect()] == [[(1, 1), (3, 2)], [], [(2, 1)]]


def test_dense_vectors_of_many_rows_keep_their_rows(spark):
    df = spark.range(0, 5000, 1, 2).select("id", arrays.tally(3)(F.array((F.col("id") % 3).cast("int"))).alias("v"))
    assert df.filter(F.element_at("v", (F.col("id") % 3 + 1).cast("int")) != 1).count() == 0
    assert df.count() == 5000


def test_framing_counts_the_two_special_ids(spark):
    df = spark.createDataFrame([(list(range(10, 30)),), ([10],)], "ids array<int>")
    framed = df.select(arrays.frame_ids("ids", 8).alias("f"))
    got = framed.select(arrays.pad_ids("f", F.lit(8)), arrays.validity_mask("f", F.lit(8))).collect()
    assert list(got[0][0]) == [0, 10, 11, 12, 13, 14, 15, 2]
    assert list(got[1][0]) == [0, 10, 2, 1, 1, 1, 1, 1]
    assert list(got[1][1]) == [1, 1, 1, 0, 0, 0, 0, 0]


def test_casts(spark):
    row = spark.createDataFrame([([1, 2],)], "v array<int>").select(
        arrays.cast_vector("v", "smallint").alias("s"), arrays.cast_vector("v", "double").alias("d")
    )
    assert [f.dataType.simpleString() for f in row.schema] == ["array<smallint>", "array<double>"]

"""The registered queries: every operator over whole given tables.

Each function takes the session and a folder of Parquet tables. The SQL with the
same meaning is in ``oracles.py`` under the same name.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.functions import arrays, text
from rowloom.operators import bpe, curate, features, lists, metrics, model, order, profile
from rowloom.operators.convert import convert, outcome_counts
from rowloom.plans.baseline import Baseline, baseline
from rowloom.plans.corpus import Corpus, build_corpus
from rowloom.plans.curate import Curated
from rowloom.plans.curate import curate as curate_entities
from rowloom.plans.oracles import FIRST_MERGES
from rowloom.plans.represent import represent
from rowloom.session import materialize, outlasting, scratch_path
from rowloom.sources import matrix, tables, tokens
from rowloom.sources.buckets import write_bucketed
from rowloom.sources.snapshots import Snapshot
from rowloom.streaming.convert import convert_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable[[SparkSession, str], DataFrame]):
    """Register under the function's name."""
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """The documents' ids and texts, dealt out where they come in few row groups."""
    return tables.read_dealt(spark, f"{folder}/documents.parquet", ["doc_id", "text"])


def joined_text(column: str):
    return F.array_join(column, ",")


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if c in columns else F.col(c) for c in df.columns])


# --- lists and label frequencies ---------------------------------------------


def user_lists(spark, folder) -> DataFrame:
    return lists.ordered_lists(table(spark, folder, "events"), "user_id", "event_type", "event_id")


@query
def ordered_label_list(spark, folder):
    return user_lists(spark, folder).select("user_id", "first", joined_text("labels").alias("labels"))


@query
def ordered_label_list_parts(spark, folder):
    """The same in parts of 64 labels."""
    parts = lists.list_parts(table(spark, folder, "events"), "user_id", "event_type", "event_id", 64)
    return parts.select("user_id", "part", joined_text("labels").alias("labels"))


def brand_counts(spark, folder) -> DataFrame:
    """Lines per brand; lines are counted per part before they meet the parts."""
    per_part = table(spark, folder, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    parts = table(spark, folder, "part").select("p_partkey", F.col("p_brand").alias("label"))
    return per_part.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("label").agg(F.sum("n").alias("n"))


@query
def label_counts_top20(spark, folder):
    top = lists.top_labels(brand_counts(spark, folder), 20, tie="label")
    return lists.cumulative_counts(top, tie="label")


@query
def label_counts(spark, folder):
    """Occurrences of every label over the lists."""
    return lists.label_counts(user_lists(spark, folder), "labels", "first").select("label", "n")


@query
def value_counts(spark, folder):
    return profile.value_counts(table(spark, folder, "orders"), "o_orderpriority")


@query
def rare_label_list(spark, folder):
    """Names below the median count."""
    counts = order_name_counts(spark, folder)
    return lists.rare_labels(counts, lists.median_count(counts))


def order_names(spark, folder) -> DataFrame:
    """(customer, label, pos): the part names a customer ordered."""
    lineitem = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    parts = table(spark, folder, "part").select("p_partkey", F.col("p_name").alias("label"))
    return (
        lineitem.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(F.col("o_custkey").alias("customer"), "label", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"))
    )


def order_name_counts(spark, folder) -> DataFrame:
    per_part = table(spark, folder, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    parts = table(spark, folder, "part").select("p_partkey", F.col("p_name").alias("label"))
    return per_part.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("label").agg(F.sum("n").alias("n"))


@query
def prune_rare_labels(spark, folder):
    """Lists without the names below the median count; labels stay rows until the lists are built."""
    counts = order_name_counts(spark, folder)
    rare = lists.rare_labels(counts, lists.median_count(counts))
    marked = lists.mark_kept(order_names(spark, folder), "label", rare)
    whole = lists.ordered_lists(marked, "customer", "label", "pos", kept="kept")
    return whole.select("customer", joined_text("labels").alias("labels"))


@query
def prune_rare_events(spark, folder):
    """The same on lists that exist already: event types below the median count."""
    whole = user_lists(spark, folder)
    counts = lists.label_counts(whole, "labels")
    rare = lists.rare_labels(counts, lists.median_count(counts))
    pruned = lists.prune_labels(whole, "labels", rare, ["user_id"])
    return pruned.select("user_id", joined_text("labels").alias("labels"))


# --- selection and joins -----------------------------------------------------


@query
def name_to_code(spark, folder):
    parts = table(spark, folder, "part")
    name = F.concat_ws(" ", "p_type", "p_name")
    return parts.select("p_partkey", text.name_to_code(name, "small", "X", 3).alias("code"))


def labelled_documents(spark, folder) -> DataFrame:
    labels = table(spark, folder, "labels")
    documents = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    return curate.attach(documents, labels, ["doc_id"], ["quality", "toxic"])


@query
def attach_left(spark, folder):
    return labelled_documents(spark, folder)


@query
def restrict_type(spark, folder):
    ids = curate.ids_of_type(table(spark, folder, "customer"), "c_custkey", "c_mktsegment", "BUILDING")
    orders = table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    return curate.restrict(orders, ids, "c_custkey")


@query
def exclude_ids(spark, folder):
    ids = curate.ids_of_type(table(spark, folder, "customer"), "c_custkey", "c_mktsegment", "BUILDING")
    orders = table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    return curate.exclude(orders, ids, "c_custkey")


@query
def exclude_value(spark, folder):
    """Quality differs from 1; documents without a label stay."""
    return curate.exclude_value(labelled_documents(spark, folder), "quality", 1).select("doc_id", "quality")


@query
def missing_rows(spark, folder):
    return curate.missing(labelled_documents(spark, folder), "quality").select("doc_id", "lang")


@query
def drop_missing(spark, folder):
    return curate.drop_missing(labelled_documents(spark, folder), ["quality", "toxic"]).select("doc_id", "quality")


@query
def non_empty(spark, folder):
    """Conversations whose text without surrounding blanks is not empty."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", F.trim("text").alias("text"))
    return curate.non_empty(turns, "text").select("conv_id", "turn", F.length("text").alias("n_chars"))


@query
def flag_duplicates(spark, folder):
    """Texts are compared by digest, so that the shuffle moves 32 bytes and not the text."""
    documents = table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return curate.flag_duplicates(documents, "digest", "doc_id").select(
        "doc_id", F.col("is_duplicate").cast("int").alias("is_duplicate")
    )


@query
def drop_duplicate_entities(spark, folder):
    """No order stays that has a line whose part and supplier were seen before."""
    place = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos")
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", place)
    return curate.drop_duplicate_entities(lines, ["l_partkey", "l_suppkey"], "l_orderkey", "pos").drop("pos")


def parties(spark, folder) -> tuple[DataFrame, DataFrame]:
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("pos"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")
    )
    suppliers = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("pos"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")
    )
    return customers, suppliers


@query
def concat_sources(spark, folder):
    return order.concat_rows(*parties(spark, folder))


def order_dictionary(spark, folder) -> DataFrame:
    """Orders as entries under their customer's name; open orders lack details."""
    name = F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
    return table(spark, folder, "orders").select(
        name.alias("name"),
        F.col("o_orderkey").alias("order"),
        F.col("o_orderpriority").alias("matched_name"),
        F.concat_ws("/", "o_orderstatus", F.col("o_orderkey").cast("string")).alias("matched_value"),
        (F.col("o_orderstatus") != "P").alias("found"),
    )


@query
def lookup_enrich(spark, folder):
    gaps = table(spark, folder, "customer").filter("c_acctbal < 0").select(
        F.col("c_custkey").alias("pos"), F.col("c_name").alias("name")
    )
    found = curate.lookup(gaps, order_dictionary(spark, folder), name="name")
    return found.select("pos", "query_name", "matched_name", "matched_value", "match_count", "code")


def part_names(spark, folder) -> DataFrame:
    """(entity, name, pos): what each customer ordered, as descriptive names."""
    lineitem = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    name = F.concat_ws(" ", "p_brand", "p_type", F.replace("p_name", F.lit(" "), F.lit("-")))
    parts = table(spark, folder, "part").select("p_partkey", name.alias("name"))
    return (
        lineitem.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(F.col("o_custkey").alias("entity"), "name", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"))
    )


def curated(spark, folder) -> Curated:
    """Customers with the codes of what they ordered.

    A customer in debt has no key and, far in debt, no value either; their orders
    are looked up as further records. Finished orders give a key, others do not.
    """
    balance = F.col("c_acctbal")
    structures = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("entity"),
        F.col("c_name").alias("name"),
        F.when(balance >= 0, F.concat_ws("/", "c_nationkey", "c_mktsegment", F.floor(balance / 50))).alias("key"),
        F.when(balance >= -500, F.concat_ws("/", "c_mktsegment", F.col("c_custkey").cast("string"))).alias("value"),
        F.col("c_custkey").alias("pos"),
    )
    types = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("type")
    )
    return curate_entities(
        part_names(spark, folder), structures, types, order_dictionary(spark, folder),
        wanted_type="1-URGENT",
        to_key=F.when(F.col("value").startswith("F/"), F.concat(F.lit("K/"), F.col("value"))),
        excluded=1, threshold=None, phrase="Brand#1", prefix="X-", token=3,
    )


@query
def curate_table(spark, folder):
    return curated(spark, folder).table.select(
        "entity", "name", "key", "value", joined_text("labels").alias("labels")
    )


@query
def curate_counts(spark, folder):
    """Label counts before pruning, and after it (NULL for a pruned label)."""
    result = curated(spark, folder)
    after = result.counts_after.select("label", F.col("n").alias("n_after"))
    return result.counts_before.select("label", F.col("n").alias("n_before")).join(after, "label", "left")


# --- order -------------------------------------------------------------------


@query
def ingest_positions(spark, folder):
    """File row numbers of the events, which lie in file order of their ids."""
    numbered = order.ingest_order(spark.read.parquet(f"{folder}/events.parquet").select("event_id"))
    return numbered.select("event_id", "pos")


@query
def dense_positions(spark, folder):
    """Rank of every customer by balance, largest first."""
    customers = table(spark, folder, "customer").select("c_custkey", "c_acctbal")
    return order.dense_order(customers, F.desc("c_acctbal"), F.asc("c_custkey"))


@query
def head_rows(spark, folder):
    return order.head(table(spark, folder, "part"), 5, "p_partkey").select("p_partkey", "p_name", "p_brand")


@query
def join_by_position(spark, folder):
    """Events and orders, line by line."""
    events = table(spark, folder, "events").select(F.col("event_id").alias("pos"), "event_type")
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("pos"), "o_orderstatus")
    return curate.join_by_position(events, orders)


@query
def running_value(spark, folder):
    """Running number of events per type in rising value."""
    per_value = table(spark, folder, "events").groupBy("event_type", "value").agg(F.count(F.lit(1)).alias("n"))
    return order.running_sums(materialize(per_value, "values"), "value", ["n"], ["event_type"])


# --- profiles ----------------------------------------------------------------


@query
def distinct_entities(spark, folder):
    return profile.distinct_count(table(spark, folder, "events"), "user_id")


@query
def describe_numeric(spark, folder):
    found = profile.describe_numeric(table(spark, folder, "part"), "p_retailprice")
    return rounded(found, "mean", "std", "p25", "p50", "p75")


@query
def describe_label_counts(spark, folder):
    found = profile.describe_numeric(brand_counts(spark, folder), "n")
    return rounded(found, "mean", "std", "p25", "p50", "p75")


@query
def value_quantiles(spark, folder):
    found = profile.quantiles(table(spark, folder, "events"), "value", [0.01, 0.5, 0.999])
    return rounded(found, "value")


@query
def describe_text(spark, folder):
    return profile.describe_text(table(spark, folder, "documents"), ["lang", "source"])


@query
def length_profile(spark, folder):
    documents = table(spark, folder, "documents")
    found = profile.length_profile(documents.select(F.char_length("text").alias("length")), "length")
    return rounded(found, "mean", *profile.LENGTH_FRACTIONS)


@query
def sketched_lengths(spark, folder):
    """Sketches per source and language, merged per language: rows, and whether every quantile's rank is within the stated error."""
    documents = table(spark, folder, "documents").select("lang", "source", F.char_length("text").cast("bigint").alias("length"))
    stored = materialize(profile.length_sketches(documents, "length", ["lang", "source"]), "sketches")
    found = profile.sketch_profile(profile.merged_sketches(stored, ["lang"]))
    fractions = {"median": 0.5, **profile.LENGTH_FRACTIONS}
    error = profile.sketch_error(200)

    def rank_fits(name: str, q: float):
        below, upto = F.count_if(F.col("length") < F.col(name)), F.count_if(F.col("length") <= F.col(name))
        total = F.count(F.lit(1))
        return (below / total <= q + error) & (upto / total >= q - error)

    fits = [rank_fits(name, q) for name, q in fractions.items()]
    joined = documents.join(found, "lang").groupBy("lang", "n").agg(*[f.alias(f"_{i}") for i, f in enumerate(fits)])
    within = F.forall(F.array(*[f"_{i}" for i in range(len(fits))]), lambda x: x)
    return joined.select("lang", "n", within.cast("int").alias("within"))


@query
def token_length_profile(spark, folder):
    documents = table(spark, folder, "documents").select("text")
    found = profile.length_profile(documents.select(text.word_count("text").alias("length")), "length")
    return rounded(found, "mean", *profile.LENGTH_FRACTIONS)


@query
def longest_row(spark, folder):
    return profile.longest_row(table(spark, folder, "documents").select("doc_id", "text"), "text", "doc_id")


@query
def row_counts(spark, folder):
    """Rows and label list parse failures of the event properties."""
    return profile.unparsed_lists(table(spark, folder, "events"), "props")


# --- conversion --------------------------------------------------------------


def even_property() -> F.Column:
    """The number in the properties as text; odd numbers cannot be converted."""
    k = F.get_json_object("props", "$.k").cast("int")
    return F.when(k % 2 == 0, k.cast("string"))


@query
def convert_outcomes(spark, folder):
    return outcome_counts(convert(table(spark, folder, "events"), "props", even_property()))


@query
def convert_function(spark, folder):
    """The same rule as a Python function that raises on odd numbers."""

    def even(props: str) -> str:
        k = json.loads(props)["k"]
        if k % 2:
            raise ValueError(k)
        return str(k)

    events = table(spark, folder, "events").select("event_id", "props")
    return convert(events, "props", even).select("event_id", "output", "ok")


@query
def stream_convert(spark, folder):
    """The conversion as an incremental job over written files, read back as lines."""
    source, target, state = (scratch_path(spark, name) for name in ("source", "lines", "state"))
    events = table(spark, folder, "events")
    line = F.concat_ws("\t", F.regexp_extract("props", r"\d+", 0), F.col("event_id").cast("string"))
    events.select(line.alias("value")).write.text(source)
    even = F.when(F.col("number").cast("int") % 2 == 0, F.col("number"))
    running = convert_files(spark, source, target, even, state, ["number", "event_id"], "number")
    running.awaitTermination()
    lines = tables.read_lines(spark, target, "output")
    return lines.groupBy("output").agg(F.count(F.lit(1)).alias("n"))


# --- written and read back ---------------------------------------------------


@query
def roundtrip_table(spark, folder):
    """Lists and numbers through delimited files."""
    path = scratch_path(spark, "table")
    whole = user_lists(spark, folder).select("user_id", "first", "labels")
    tables.write_table(whole, path)
    read = tables.read_table(spark, path, "user_id bigint, first bigint, labels string")
    return read.select("user_id", "first", joined_text(text.parse_list("labels")).alias("labels"))


@query
def roundtrip_headerless(spark, folder):
    path = scratch_path(spark, "headerless")
    pages = table(spark, folder, "pages").select("url", F.col("page_id").cast("string").alias("page_id"))
    tables.write_lines(pages.select(F.concat_ws("\t", "url", F.lit(""), "page_id").alias("line")), "line", path)
    return tables.read_headerless(spark, path, ["url", "blank", "page_id"])


@query
def roundtrip_records(spark, folder):
    """Texts with their line breaks and quotes through a delimited file."""
    path = scratch_path(spark, "records")
    tables.write_table(table(spark, folder, "documents").select("doc_id", "text"), path)
    read = tables.read_table(spark, path, "doc_id bigint, text string", multiline=True)
    return read.select("doc_id", F.md5("text").alias("text_md5"))


@query
def roundtrip_lines(spark, folder):
    """Lines with their numbers."""
    path = scratch_path(spark, "lines")
    names = table(spark, folder, "part").orderBy("p_partkey").select("p_name")
    tables.write_lines(names, "p_name", path)
    return tables.read_lines(spark, path, "p_name", "pos")


@query
def roundtrip_matrix(spark, folder):
    path = scratch_path(spark, "matrix")
    vectors = table(spark, folder, "embeddings").select("vec_id", arrays.cast_vector("embedding", "double").alias("v"))
    matrix.write_matrix(vectors, "vec_id", "v", path, 64)
    read = matrix.read_matrix(spark, path, "vec_id")
    long = read.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.posexplode("features").alias("dim", "value"))
    return rounded(long, "value")


@query
def roundtrip_cached(spark, folder):
    path = scratch_path(spark, "cached")
    build = lambda: table(spark, folder, "supplier")
    tables.cached_table(spark, path, build)
    return tables.cached_table(spark, path, build)


@query
def bucketed_join(spark, folder):
    """Documents and labels, both in buckets of the id, joined where they lie."""
    documents = write_bucketed(table(spark, folder, "documents").select("doc_id", "n_chars"), "doc_id")
    labels = write_bucketed(table(spark, folder, "labels"), "doc_id")
    return curate.join_by_position(documents, labels, "doc_id")


@query
def grown_snapshot(spark, folder):
    """Orders by customer, looked up for one market segment first and then for all customers: the second run adds the rest."""
    snapshot = Snapshot(spark, scratch_path(spark, "snapshot"))
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey")
    build = lambda unseen: orders.join(unseen, "o_custkey")
    snapshot.grow(customers.filter(F.col("c_mktsegment") == "BUILDING"), "o_custkey", build)
    return snapshot.grow(customers, "o_custkey", build)


# --- corpus ------------------------------------------------------------------


@query
def piece_counts(spark, folder):
    return bpe.piece_counts(texts(spark, folder), "text", text.PLAIN_PATTERN)


@query
def byte_level_pieces(spark, folder):
    """Pieces by the full pattern: their number and a digest of them, the cuts marked."""
    documents = texts(spark, folder).select("doc_id", text.pieces("text").alias("p"))
    return documents.select("doc_id", F.size("p").alias("n"), F.md5(F.array_join("p", "\x1f")).alias("cuts"))


@query
def pair_counts(spark, folder):
    counts = bpe.piece_counts(texts(spark, folder), "text", text.PLAIN_PATTERN)
    return bpe.pair_counts(counts)


def learned(spark, folder, vocab_size: int = 2000) -> bpe.Vocabulary:
    counts = bpe.piece_counts(texts(spark, folder), "text", terminator="\n")
    return bpe.learn(counts, vocab_size)


#: Where the vocabularies of this run lie, by application and tables.
_LEARNED: dict[tuple[str, str], str] = {}


def shared_vocabulary(spark, folder) -> bpe.Vocabulary:
    """The vocabulary of the original size, learned once per run, written, and read by every query that encodes with it."""
    run = (spark.sparkContext.applicationId, folder)
    if run not in _LEARNED:
        with outlasting():
            where = scratch_path(spark, "vocabulary")
            tokens.write_vocabulary(spark, learned(spark, folder), where)
        _LEARNED[run] = where
    return tokens.read_vocabulary(spark, _LEARNED[run])


@query
def bpe_learn(spark, folder):
    """The whole vocabulary of the original size."""
    documents = table(spark, folder, "documents")
    return bpe.merges_table(documents, learned(spark, folder))


@query
def byte_level_counts(spark, folder):
    """How often each piece of the full pattern occurs, the line's end among them."""
    return bpe.piece_counts(texts(spark, folder), "text", terminator="\n")


@query
def bpe_first_merges(spark, folder):
    """The first merges of the corpus, as the bytes they join: what recursive SQL can follow of ``bpe_learn``."""
    counts = bpe.piece_counts(texts(spark, folder), "text", terminator="\n")
    merges = bpe.learn(counts, max_merges=FIRST_MERGES).merges
    rows = [(i, bpe.token_bytes(left).hex(), bpe.token_bytes(right).hex()) for i, (left, right) in enumerate(merges)]
    return spark.createDataFrame(rows, "rank bigint, left string, right string")


@query
def bpe_roundtrip(spark, folder):
    """Learn, write and read the vocabulary, encode, write and read the ids, check every line.

    Each document shows the digest of the text that its stored ids decode to.
    """
    documents = texts(spark, folder).withColumnRenamed("doc_id", "pos")
    vocabulary = shared_vocabulary(spark, folder)
    ids = scratch_path(spark, "ids")
    tokens.write_token_ids(bpe.encode(documents, "text", vocabulary), "ids", ids)
    stored = tokens.read_token_ids(spark, ids)
    checked = bpe.verify(stored, documents, "text", vocabulary)
    shown = stored.select("pos", F.md5(bpe.decode("ids", vocabulary)).alias("decoded"))
    return checked.join(shown, "pos").select(
        F.col("pos").alias("doc_id"), F.col("ids_match").cast("int").alias("ids_match"),
        F.col("text_match").cast("int").alias("text_match"), "decoded",
    )


def ids_file(spark, folder, vocabulary: bpe.Vocabulary) -> DataFrame:
    """Ids as text lines in order of the documents, read back."""
    path = scratch_path(spark, "lines")
    tokens.export_encoded(texts(spark, folder), "text", vocabulary, path, "doc_id")
    read = tokens.import_token_ids(spark, path)
    return read.select("pos", F.size("ids").alias("n_tokens"), F.aggregate("ids", F.lit(0), lambda a, i: a + i).alias("total"))


@query
def bpe_ids_file(spark, folder):
    """Byte ids in a file: what SQL can follow of ``learned_ids_file``."""
    return ids_file(spark, folder, bpe.Vocabulary.initial())


@query
def learned_ids_file(spark, folder):
    return ids_file(spark, folder, shared_vocabulary(spark, folder))


@query
def byte_encode(spark, folder):
    """Encoding without merges: one id per byte, five behind the special tokens for the first of the alphabet."""
    documents = texts(spark, folder)
    coded = bpe.encode(documents, "text", bpe.Vocabulary.initial())
    total = F.aggregate("ids", F.lit(0), lambda a, i: a + i)
    return coded.select("doc_id", F.size("ids").alias("n_tokens"), total.alias("total"))


def longest_of(spark, folder, vocabulary: bpe.Vocabulary) -> DataFrame:
    documents = texts(spark, folder).withColumnRenamed("doc_id", "pos")
    return bpe.longest_encoded(documents, "text", vocabulary)


@query
def longest_encoded(spark, folder):
    """The longest text in bytes: what SQL can follow of ``learned_longest_encoded``."""
    found = longest_of(spark, folder, bpe.Vocabulary.initial())
    return found.select("pos", "length", "n_tokens", F.size("tokens").alias("n_shown"))


@query
def learned_longest_encoded(spark, folder):
    return longest_of(spark, folder, shared_vocabulary(spark, folder))


def framed_sizes(spark, folder, vocabulary: bpe.Vocabulary) -> DataFrame:
    """Framed, cut and padded sequences, described by their sizes."""
    documents = texts(spark, folder)
    ids = bpe.encode(documents, "text", vocabulary)
    framed = bpe.frame_batches(ids, "ids", "doc_id", batch=16, dropped=("text",))
    valid = F.aggregate("attention_mask", F.lit(0), lambda a, m: a + m)
    return framed.select(
        "doc_id", "batch",
        F.size("input_ids").alias("width"),
        valid.alias("n_valid"),
        F.element_at("input_ids", 1).alias("first_id"),
        F.element_at("input_ids", valid).alias("last_id"),
    )


@query
def frame_batches(spark, folder):
    """Framed bytes: what SQL can follow of ``learned_frame_batches``."""
    return framed_sizes(spark, folder, bpe.Vocabulary.initial())


@query
def learned_frame_batches(spark, folder):
    return framed_sizes(spark, folder, shared_vocabulary(spark, folder))


def cut_masks(spark, folder, vocabulary: bpe.Vocabulary, width: int | None = None) -> DataFrame:
    """The first 1024 positions of each sequence, with their mask up to the longest of the table, or up to ``width``."""
    documents = texts(spark, folder)
    ids = bpe.encode(documents, "text", vocabulary)
    cut = ids.select("doc_id", arrays.truncate("ids").alias("ids"))
    if width is None:
        cut = materialize(cut, "cut")  # measured and masked, but encoded once
        width = cut.agg(F.max(F.size("ids"))).first()[0] or 0
    mask = arrays.validity_mask("ids", F.lit(width))
    total = F.aggregate("ids", F.lit(0), lambda a, i: a + i)
    return cut.select(
        "doc_id", F.size("ids").alias("n_ids"), total.alias("total"),
        F.aggregate(mask, F.lit(0), lambda a, m: a + m).alias("n_valid"),
        F.coalesce(F.array_position(mask, 0), F.lit(0)).alias("first_padding"),
    )


@query
def truncate_mask(spark, folder):
    """Cut byte sequences, masked up to the limit: what SQL can follow of ``learned_truncate_mask``."""
    return cut_masks(spark, folder, bpe.Vocabulary.initial(), 1024)


@query
def learned_truncate_mask(spark, folder):
    return cut_masks(spark, folder, shared_vocabulary(spark, folder))


#: The corpora of this run, by application and tables.
_BUILT: dict[tuple[str, str], Corpus] = {}


def shared_corpus(spark, folder) -> Corpus:
    """The whole corpus pipeline over page addresses, run once; only secure ones can be converted."""
    run = (spark.sparkContext.applicationId, folder)
    if run not in _BUILT:
        with outlasting():
            source, target = scratch_path(spark, "bulk"), scratch_path(spark, "corpus")
            pages = table(spark, folder, "pages").select(F.concat_ws("\t", "url", F.col("page_id").cast("string")).alias("line"))
            tables.write_lines(pages, "line", source)
            host_and_path = F.when(F.col("url").startswith("https://"), F.substring("url", 9, 1 << 30))
            _BUILT[run] = build_corpus(spark, source, target, names=["url", "page_id"], column="url", how=host_and_path)
    return _BUILT[run]


@query
def corpus_report(spark, folder):
    """The accounting of the corpus pipeline."""
    made = shared_corpus(spark, folder)
    longest = made.longest.select(F.lit("longest").alias("report"), F.col("length").cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("n_bad"))
    facts = [
        made.outcomes.select(F.lit("outcomes").alias("report"), F.col("total").alias("n"), F.col("failure").alias("n_bad")),
        made.verified.select(F.lit("verified").alias("report"), F.col("n_lines").alias("n"), (F.col("ids_differ") + F.col("text_differs")).alias("n_bad")),
        made.lengths.select(F.lit("sequences").alias("report"), F.col("n"), F.lit(0).cast("bigint").alias("n_bad")),
    ]
    return facts[0].unionByName(facts[1]).unionByName(facts[2]).unionByName(longest)


@query
def corpus_profile(spark, folder):
    """The lengths of the encoded lines, and the longest line with its first tokens: (report, measure, value, shown)."""
    made = shared_corpus(spark, folder)

    def rows(df: DataFrame, report: str, measures: list[str], shown=F.lit(None).cast("string")) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures])
        return df.select(F.lit(report).alias("report"), F.inline(pairs), shown.alias("shown"))

    sizes = rows(made.lengths, "sequences", made.lengths.columns)
    return sizes.unionByName(rows(made.longest, "longest", ["length", "n_tokens"], F.array_join("tokens", " ")))


# --- features ----------------------------------------------------------------


@query
def hashed_counts(spark, folder):
    documents = texts(spark, folder)
    return features.hashed_counts(documents, "doc_id", "text")


@query
def mean_pool(spark, folder):
    """Mean embedding per label; vectors that start below zero are masked."""
    mask = (F.element_at("embedding", 1) >= 0).cast("int").alias("mask")
    vectors = table(spark, folder, "embeddings").select("label", "embedding", mask)
    pooled = features.mean_pool(vectors, "label", "embedding", "mask")
    return rounded(pooled.select("label", F.posexplode("features").alias("dim", "mean")), "mean")


@query
def pooled_tokens(spark, folder):
    """Mean vector of the first 1024 bytes of each text; every byte token has one of the embeddings as its vector."""
    vocabulary = bpe.Vocabulary.initial()
    embeddings = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    owner = F.pmod(F.col("id") * 31, F.lit(embeddings.count())).alias("vec_id")
    vectors = spark.range(len(vocabulary.ids)).select(F.col("id").alias("token"), owner).join(embeddings, "vec_id")
    documents = texts(spark, folder)
    pooled = features.pool_tokens(bpe.encode(documents, "text", vocabulary), "doc_id", "ids", vectors)
    return rounded(pooled.select("doc_id", F.posexplode("features").alias("dim", "mean")), "mean")


@query
def feature_shape(spark, folder):
    """Both feature matrices of the whole tables, written, read back and measured."""
    where = scratch_path(spark, "features")
    documents = texts(spark, folder)
    vectors = table(spark, folder, "embeddings").select("label", "embedding", F.lit(1).alias("mask"))
    hashed = represent(documents, "doc_id", {"hashed": ("hashed", "text", {})}, where, {"hashed": 2048})
    pooled = represent(vectors, "label", {"pooled": ("pooled", "embedding", {"mask": "mask"})}, where, {"pooled": 64})
    return hashed.unionByName(pooled)


@query
def dense_vectors(spark, folder):
    """Sum and filled places of every hashed vector."""
    documents = texts(spark, folder)
    vectors = features.featurise(documents, "doc_id", "text")
    return vectors.select(
        "doc_id",
        F.aggregate("features", F.lit(0), lambda a, v: a + v).alias("total"),
        F.size(F.filter("features", lambda v: v > 0)).alias("filled"),
        F.typeof("features").alias("kind"),
    )


@query
def featurise_function(spark, folder):
    """Vectors by a function of the caller: lengths of the texts in characters and words."""

    def lengths(df: DataFrame, id_col: str, column: str) -> DataFrame:
        return df.select(id_col, F.array(F.char_length(column), text.word_count(column)).alias("features"))

    documents = texts(spark, folder)
    made = features.featurise(documents, "doc_id", "text", lengths, element="double")
    return made.select("doc_id", F.col("features")[0].alias("chars"), F.col("features")[1].alias("words"))


# --- model -------------------------------------------------------------------


@query
def binarize(spark, folder):
    whole = user_lists(spark, folder)
    classes = model.class_list(whole, "labels")
    return model.binarize(whole, "labels", classes).select("user_id", joined_text("y").alias("y"))


@query
def label_indices(spark, folder):
    return model.label_indices(user_lists(spark, folder), "user_id", "labels")


@query
def top_class(spark, folder):
    """The coordinate with the first highest value of every embedding."""
    names = [f"d{i}" for i in range(64)]
    return table(spark, folder, "embeddings").select("vec_id", arrays.top_class("embedding", names).alias("label"))


@query
def hash_split(spark, folder):
    documents = table(spark, folder, "documents")
    return documents.select("doc_id", model.hash_split("doc_id").cast("int").alias("is_test"))


@query
def exact_split(spark, folder):
    """Exactly a fifth of the documents, by the least hashes."""
    split = model.exact_split(table(spark, folder, "documents").select("doc_id"), "doc_id")
    return split.select("doc_id", F.col("is_test").cast("int").alias("is_test"))


def quality_scores(spark, folder) -> DataFrame:
    """Documents with a quality label; the score is their length."""
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    documents = table(spark, folder, "documents").select("doc_id", "lang", "n_chars")
    return model.join_features(documents, labels, "doc_id")


@query
def exact_match(spark, folder):
    rows = quality_scores(spark, folder).select(
        F.array("quality").alias("truth"), F.array((F.col("n_chars") > 1000).cast("int")).alias("predicted")
    )
    return rounded(metrics.exact_match(rows, "truth", "predicted"), "accuracy")


@query
def ranking_scores(spark, folder):
    found = metrics.ranking_scores(quality_scores(spark, folder), "lang", "n_chars", "quality")
    return rounded(found, "roc_auc", "avg_precision")


@query
def macro_scores(spark, folder):
    found = metrics.macro_mean(metrics.ranking_scores(quality_scores(spark, folder), "lang", "n_chars", "quality"))
    return rounded(found, "macro_roc_auc", "macro_avg_precision")


#: The fitted baselines of this run, by application and tables.
_FITTED: dict[tuple[str, str], Baseline] = {}


def shared_baseline(spark, folder) -> Baseline:
    """The baseline over all embeddings with the original rounds, depth and patience, fitted once per run."""
    run = (spark.sparkContext.applicationId, folder)
    if run not in _FITTED:
        with outlasting():
            vectors = table(spark, folder, "embeddings")
            labelled = vectors.select("vec_id", F.array(F.concat(F.lit("c"), F.col("label").cast("string"))).alias("labels"))
            _FITTED[run] = baseline(vectors.select("vec_id", F.col("embedding").alias("features")), labelled, "vec_id")
    return _FITTED[run]


@query
def gbt_multilabel(spark, folder):
    """What SQL can know of the predictions on every vector."""
    bounded = F.forall("probability", lambda p: (p >= 0) & (p <= 1))
    agree = F.forall(F.zip_with("probability", "predicted", lambda p, y: (p > 0.5).cast("int") == y), lambda x: x)
    return shared_baseline(spark, folder).predictions.select(
        "vec_id", F.col("is_test").cast("int").alias("is_test"), joined_text("y").alias("y"),
        (bounded & agree).cast("int").alias("sound"),
    )


@query
def gbt_probabilities(spark, folder):
    """Probability and truth of every label of every vector."""
    fitted = shared_baseline(spark, folder)
    classes = [row["label"] for row in fitted.curves.select("label").distinct().orderBy("label").collect()]
    scores = model.label_scores(fitted.predictions, "vec_id", "y", "probability", classes)
    return scores.select("vec_id", "label", "truth", F.col("score").alias("probability"))


@query
def gbt_scores(spark, folder):
    """The scores as rows (part, label, measure, value): accuracies, per label and macro areas, rounds and their losses."""
    fitted = shared_baseline(spark, folder)

    def rows(df: DataFrame, part: str, label, *measures: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures])
        return df.select(F.lit(part).alias("part"), label.alias("label"), F.inline(pairs))

    every = F.lit("all")
    kept = fitted.curves.filter("kept").groupBy("label").agg(
        F.count(F.lit(1)).alias("rounds"), F.min("loss").alias("validation_loss"))
    return (
        rows(fitted.train_accuracy, "train", every, "accuracy")
        .unionByName(rows(fitted.test_accuracy, "test", every, "accuracy"))
        .unionByName(rows(fitted.per_label, "test", F.col("label"), "roc_auc", "avg_precision"))
        .unionByName(rows(fitted.macro, "test", every, "macro_roc_auc", "macro_avg_precision"))
        .unionByName(rows(kept, "validation", F.col("label"), "rounds", "validation_loss"))
    )

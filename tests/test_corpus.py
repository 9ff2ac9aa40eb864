import json
import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rowloom.functions.text import pieces
from rowloom.operators import bpe
from rowloom.plans import queries
from rowloom.plans.corpus import build_corpus
from rowloom.sources import matrix, tables, tokens
from rowloom.streaming.convert import convert_files

LINES = [
    "InChI=1S/C2H6O/c1-2-3/h3H,2H2,1H3", "aaaaaaa aaaa aaa", "the cat's hat, we'll see 12345 123",
    "Ünïcödé  naïve\tcafé 日本語 12", "<s> is plain text </s>", "InChI=1S/CH4/h1H4", "x" * 50 + " the the",
]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(LINES * 3)], "pos bigint, text string")


@pytest.fixture(scope="module")
def library(tmp_path_factory):
    tokenizers = pytest.importorskip("tokenizers")
    folder = tmp_path_factory.mktemp("library")
    (folder / "lines.txt").write_bytes("".join(t + "\n" for t in LINES * 3).encode())
    trained = tokenizers.ByteLevelBPETokenizer()
    trained.train([str(folder / "lines.txt")], vocab_size=400, min_frequency=2, special_tokens=bpe.SPECIAL_TOKENS)
    trained.save_model(str(folder))
    return folder, tokenizers.ByteLevelBPETokenizer(str(folder / "vocab.json"), str(folder / "merges.txt"))


@pytest.fixture(scope="module")
def vocabulary(corpus):
    return bpe.learn(bpe.piece_counts(corpus, "text", terminator="\n"), vocab_size=400, ranked=64)


def test_learned_merges_equal_the_library(library, vocabulary):
    folder, _ = library
    merges = [tuple(l.split(" ")) for l in (folder / "merges.txt").read_text().split("\n")[1:] if l]
    assert vocabulary.merges == merges
    assert vocabulary.ids == json.loads((folder / "vocab.json").read_text())


def test_encoding_equals_the_library(corpus, library, vocabulary):
    _, trained = library
    encoded = bpe.encode(corpus, "text", vocabulary)
    shown = encoded.select(
        "text", "ids", bpe.tokens_of("ids", vocabulary).alias("tokens"), bpe.decode("ids", vocabulary).alias("back")
    )
    for row in shown.collect():
        want = trained.encode(row["text"])
        assert list(row["ids"]) == want.ids and list(row["tokens"]) == want.tokens
        assert row["back"] == row["text"]


def test_encoding_of_missing_and_empty_text(spark, vocabulary):
    df = spark.createDataFrame([(0, None), (1, ""), (2, "the")], "pos bigint, text string").coalesce(1)
    got = [r["ids"] for r in bpe.encode(df, "text", vocabulary).orderBy("pos").collect()]
    assert got[0] is None and got[1] == [] and len(got[2]) >= 1


def test_special_ids_are_skipped_or_shown(spark, vocabulary):
    df = spark.createDataFrame([([0, vocabulary.ids["a"], 2],)], "ids array<int>")
    assert df.select(bpe.decode("ids", vocabulary)).first()[0] == "a"
    assert df.select(bpe.decode("ids", vocabulary, skip_special=False)).first()[0] == "<s>a</s>"


def test_broken_bytes_become_replacement_characters(spark):
    first = bpe.Vocabulary.initial()
    half = int(first.byte_ids()["é".encode()[0]])
    df = spark.createDataFrame([([half],)], "ids array<int>")
    assert df.select(bpe.decode("ids", first)).first()[0] == "�"


def test_a_very_long_piece_is_merged_whole(spark):
    df = spark.createDataFrame([("ab" * 60_000,)], "text string")
    vocabulary = bpe.learn(spark.createDataFrame([("abab", 3)], "piece string, n bigint"))
    assert vocabulary.merges == [("a", "b"), ("ab", "ab")]
    assert bpe.encode(df, "text", vocabulary).select(F.size("ids")).first()[0] == 30_000


@given(st.text(alphabet="abc", max_size=40), st.permutations([(a, b) for a in "abc" for b in "abc"]))
def test_merging_equals_the_plain_rule(text, order):
    """Against a loop that looks for the lowest-ranked, leftmost pair each time."""
    ids = {"a": 0, "b": 1, "c": 2}
    ranks = {}
    for rank, (left, right) in enumerate(order[:5]):
        ranks[ids[left], ids[right]] = (rank, 10 + rank)
    ranks[10, 0], ranks[1, 11], ranks[10, 10] = (7, 20), (6, 21), (8, 22)
    plain = [ids[c] for c in text]
    while True:
        open_pairs = [(ranks[pair][0], i) for i, pair in enumerate(zip(plain, plain[1:])) if pair in ranks]
        if not open_pairs:
            break
        _, i = min(open_pairs)
        plain[i : i + 2] = [ranks[plain[i], plain[i + 1]][1]]
    assert bpe.merge_symbols([ids[c] for c in text], ranks) == plain


def test_pieces_rebuild_the_text(corpus):
    wrong = corpus.filter(F.array_join(pieces("text"), "") != F.col("text"))
    assert wrong.count() == 0


def test_files_round_trip_and_every_line_is_verified(spark, corpus, vocabulary, tmp_path):
    tokens.write_vocabulary(spark, vocabulary, str(tmp_path / "v"))
    read = tokens.read_vocabulary(spark, str(tmp_path / "v"))
    assert read.ids == vocabulary.ids and read.merges == vocabulary.merges
    tokens.write_token_ids(bpe.encode(corpus, "text", read), "ids", str(tmp_path / "ids"))
    stored = tokens.read_token_ids(spark, str(tmp_path / "ids"))
    good = bpe.verify(stored, corpus, "text", read)
    assert tuple(bpe.verify_counts(good).first()) == (len(LINES) * 3, 0, 0)
    broken = stored.withColumn("ids", F.when(F.col("pos") == 4, F.array(F.lit(0), F.lit(7))).otherwise(F.col("ids")))
    broken = broken.filter("pos <> 6")
    found = bpe.verify(broken, corpus, "text", read)
    assert tuple(bpe.verify_counts(found).first()) == (len(LINES) * 3, 2, 2)
    shown = {r["pos"]: r["stored_text"] for r in bpe.mismatches(found, broken, corpus, "text", read).collect()}
    assert shown == {4: "<s>#", 6: None}


def test_settings_load_in_the_library(spark, vocabulary, tmp_path):
    """The file frames, cuts and pads there as the operators do here."""
    tokenizers = pytest.importorskip("tokenizers")
    tokens.write_settings(spark, vocabulary, str(tmp_path), limit=16)
    loaded = tokenizers.Tokenizer.from_file(str(tmp_path / "tokenizer.json"))
    assert loaded.get_vocab() == vocabulary.ids
    texts = [t for t in LINES if "<s>" not in t]
    rows = spark.createDataFrame(list(enumerate(texts)), "pos bigint, text string")
    framed = bpe.frame_batches(bpe.encode(rows, "text", vocabulary), "ids", batch=100, limit=16, dropped=("text",))
    for row, want in zip(framed.orderBy("pos").collect(), loaded.encode_batch(texts), strict=True):
        assert list(row["input_ids"]) == want.ids and list(row["attention_mask"]) == want.attention_mask


def test_corpus_is_built_without_a_copy_of_the_conversion(spark, tmp_path):
    (tmp_path / "bulk").mkdir()
    (tmp_path / "bulk" / "a.tsv").write_text("".join(f"{'C' * (i % 9)}{i}\tid{i}\n" for i in range(300)) + "\tempty\n")
    calls = spark.sparkContext.accumulator(0)

    def how(value):
        calls.add(1)
        if value.endswith("7"):
            raise ValueError(value)
        return f"InChI=1S/{value}" if value else ""

    made = build_corpus(spark, str(tmp_path / "bulk"), str(tmp_path / "out"), names=["s", "id"], column="s", how=how, vocab_size=300)
    assert tuple(made.outcomes.first()) == (301, 270, 31, 89.7)
    assert calls.value == 301
    assert tuple(made.verified.first()) == (270, 0, 0)
    lengths, longest = made.lengths.first(), made.longest.first()
    assert lengths["n"] == 270 and lengths["longest"] >= longest["n_tokens"] > 0
    stored = tables.read_lines(spark, str(tmp_path / "out" / "lines"), "line", "pos")
    assert stored.count() == 270 and "".join(longest["tokens"]).startswith("InChI=1S/")


def test_ids_as_text_lines(spark, corpus, vocabulary, tmp_path):
    coded = bpe.encode(corpus, "text", vocabulary)
    tokens.export_token_ids(coded.repartition(3), "ids", str(tmp_path / "lines"))
    read = tokens.import_token_ids(spark, str(tmp_path / "lines"))
    wanted = [r["ids"] for r in coded.orderBy("pos").collect()]
    assert [r["ids"] for r in read.orderBy("pos").collect()] == wanted


def test_batches_are_padded_to_their_longest(spark, corpus, vocabulary):
    coded = bpe.encode(corpus, "text", vocabulary)
    framed = bpe.frame_batches(coded, "ids", batch=4, limit=16, dropped=("text",))
    assert set(framed.columns) == {"batch", "pos", "input_ids", "attention_mask"}
    framed = framed.join(coded.select("pos", "ids"), "pos")
    for batch in framed.groupBy("batch").agg(F.collect_set(F.size("input_ids")).alias("w"), F.max(F.size("ids")).alias("m")).collect():
        assert list(batch["w"]) == [min(batch["m"] + 2, 16)]


def test_loaded_merges_skip_the_version_line(spark, tmp_path):
    (tmp_path / "vocab.json").write_text(json.dumps({"a": 0, "b": 1, "#": 2, "ab": 3, "#v": 4, "v": 5}))
    (tmp_path / "merges.txt").write_text("#version: 0.2\na b\n# v\n")
    assert tokens.read_vocabulary(spark, str(tmp_path)).merges == [("a", "b"), ("#", "v")]


# --- sources --------------------------------------------------------------------------


def test_table_reader_quotes_and_missing_tokens(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,names,v\n1,"a, ""b""",NA\n2,,3.5\n3,"line\nbreak",null\n', encoding="utf-8")
    schema = "id bigint, names string, v double"
    got = tables.read_table(spark, str(tmp_path / "t.csv"), schema, pos="pos", multiline=True).orderBy("pos")
    assert [tuple(r) for r in got.collect()] == [(1, 'a, "b"', None, 0), (2, None, 3.5, 1), (3, "line\nbreak", None, 2)]


def test_tables_without_line_breaks_are_split(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,names\n" + "".join(f"{i},n{i}\n" for i in range(20_000)))
    read = tables.read_table(spark, str(tmp_path / "t.csv"), "id bigint, names string")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        assert read.select(F.spark_partition_id()).distinct().count() > 1 and read.count() == 20_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_headerless_reader_keeps_empties(spark, tmp_path):
    (tmp_path / "t.smi").write_text("C\tx\n\tNA\n\nCC\n")
    got = tables.read_headerless(spark, str(tmp_path / "t.smi"), ["s", "i"], pos="pos").orderBy("pos")
    assert [tuple(r) for r in got.collect()] == [(0, "C", "x"), (1, "", "NA"), (2, "CC", None)]


def test_table_writer_spells_lists(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", 'b"'])], "id bigint, l array<string>")
    tables.write_table(df, str(tmp_path / "o"))
    back = tables.read_table(spark, str(tmp_path / "o"), "id bigint, l string")
    assert json.loads(back.first()["l"]) == ["a", 'b"']


def test_matrix_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a\tb", [1, 2]), ('q"', [0, 5]), ("c", [7, 8])], "id string, v array<int>").repartition(3)
    path = str(tmp_path / "m")
    matrix.write_matrix(df, "id", "v", path, 2)
    got = {r["id"]: r["features"] for r in matrix.read_matrix(spark, path).collect()}
    assert got == {"a\tb": [1.0, 2.0], 'q"': [0.0, 5.0], "c": [7.0, 8.0]}


def test_cached_table_is_frozen(spark, tmp_path):
    path, calls = str(tmp_path / "c"), []

    def build():
        calls.append(1)
        return spark.range(len(calls))

    assert tables.cached_table(spark, path, build).count() == 1
    assert tables.cached_table(spark, path, build).count() == 1
    assert calls == [1]


def test_stream_takes_up_new_files(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()

    def run():
        convert_files(spark, source, target, lambda t: t.upper(), state, ["s", "i"], "s").awaitTermination()
        return sorted(r[0] for r in spark.read.text(target).collect())

    (tmp_path / "in" / "1.smi").write_text("a\t1\n\t2\n")
    assert run() == ["A"]
    (tmp_path / "in" / "2.smi").write_text("b\t3\n")
    assert run() == ["A", "B"]


def test_queries_encode_with_the_learned_vocabulary(spark, tmp_path, monkeypatch):
    """Counts, cuts, masks and tokens of the learned queries against the library, on texts beyond both limits in bytes."""
    tokenizers = pytest.importorskip("tokenizers")
    texts = [f"the cat's hat {i % 7} and the dog's log, we'll see " * (i * 4) for i in range(1, 21)] + ["", "the hat"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    judge = tokenizers.ByteLevelBPETokenizer()
    judge.train_from_iterator([t + "\n" for t in texts], vocab_size=2000, min_frequency=2, special_tokens=bpe.SPECIAL_TOKENS, show_progress=False)
    want = {i: judge.encode(t) for i, t in enumerate(texts)}
    asked, learn = [], bpe.learn
    monkeypatch.setattr(bpe, "learn", lambda counts, size: asked.append(size) or learn(counts, size))
    made = {name: queries.QUERIES[name](spark, str(tmp_path)).collect() for name in (
        "learned_ids_file", "learned_longest_encoded", "learned_frame_batches", "learned_truncate_mask", "bpe_roundtrip")}
    assert asked == [2000]
    assert {r["pos"]: (r["n_tokens"], r["total"] or 0) for r in made["learned_ids_file"]} == {i: (len(w.ids), sum(w.ids)) for i, w in want.items()}
    longest = made["learned_longest_encoded"][0]
    assert (longest["pos"], longest["n_tokens"], list(longest["tokens"])) == (19, len(want[19].ids), want[19].tokens[:15])
    assert {r["doc_id"]: r["n_valid"] for r in made["learned_frame_batches"]} == {i: min(len(w.ids), 510) + 2 for i, w in want.items()}
    assert {r["doc_id"]: (r["n_valid"], r["total"]) for r in made["learned_truncate_mask"]} == {
        i: (min(len(w.ids), 1024), sum(w.ids[:1024])) for i, w in want.items()}
    assert all(r["ids_match"] and r["text_match"] for r in made["bpe_roundtrip"])
    assert len(want[5].ids) < 510 < len(texts[5])


@pytest.mark.parametrize("longest", [9, 1500])
def test_masks_reach_to_the_longest_of_the_table(spark, tmp_path, longest):
    """Cut first, then masked; the byte query masks up to the limit, as its SQL does."""
    texts = [" 1" * longest, " 1 1 1", "", None, " 1 1 1", " 1" * longest]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sizes = {i: None if t is None else min(1024, len(t) // 2) for i, t in enumerate(texts)}
    width = min(longest, 1024)
    made = {r["doc_id"]: r for r in queries.QUERIES["learned_truncate_mask"](spark, str(tmp_path)).collect()}
    assert {i: (r["n_ids"], r["n_valid"]) for i, r in made.items()} == {i: (n, n) for i, n in sizes.items()}
    assert {i: r["first_padding"] for i, r in made.items()} == {i: 0 if n in (None, width) else n + 1 for i, n in sizes.items()}
    plain = queries.QUERIES["truncate_mask"](spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["first_padding"] for r in plain if r["n_ids"] is not None} == {
        i: len(t) + 1 if len(t) < 1024 else 0 for i, t in enumerate(texts) if t is not None}


def plain_merges(counts, vocab_size=2000, least=2):
    """Merges one by one, every pair counted again each time."""
    vocabulary = bpe.Vocabulary.initial()
    tokens, ids, merges = vocabulary.by_id(), vocabulary.ids, []
    byte_ids = vocabulary.byte_ids().tolist()
    pieces_ = [([byte_ids[b] for b in piece.encode()], n) for piece, n in counts.items()]
    while len(ids) < vocab_size:
        found = {}
        for symbols, n in pieces_:
            for pair in zip(symbols, symbols[1:]):
                found[pair] = found.get(pair, 0) + n
        best = min(found, key=lambda p: (-found[p], p), default=None)
        if best is None or found[best] < least:
            return merges
        merges.append((tokens[best[0]], tokens[best[1]]))
        text = "".join(merges[-1])
        if text not in ids:
            ids[text] = len(tokens)
            tokens.append(text)
        pieces_ = [(bpe._merged(symbols, best, ids[text]), n) for symbols, n in pieces_]
    return merges


def random_counts(kind, seed):
    draw = random.Random(seed)
    if kind == "overlaps":
        return {draw.choice("ab") * draw.randrange(1, 40) + draw.choice(["", "ba", "c"]): draw.randrange(1, 6) for _ in range(60)}
    if kind == "ties":
        return {"".join(draw.choice("abcdef") for _ in range(draw.randrange(1, 6))): 2 for _ in range(150)}
    if kind == "digits":
        return {str(draw.randrange(10**draw.randrange(1, 9))): draw.randrange(1, 9) for _ in range(200)}
    return {" " + "".join(draw.choice("etaoinéß") for _ in range(draw.randrange(1, 9))): draw.randrange(1, 400) for _ in range(300)}


@pytest.mark.parametrize("bounds", [{}, {"most_runs": 12, "ranked": 40}, {"run_bytes": 200, "ranked": 9}])
@pytest.mark.parametrize("kind", ["overlaps", "ties", "digits", "words"])
def test_learning_equals_merging_one_by_one(spark, kind, bounds):
    counts = random_counts(kind, 7)
    table = spark.createDataFrame(list(counts.items()), "piece string, n bigint").repartition(3)
    assert bpe.learn(table, vocab_size=290, **bounds).merges == plain_merges(counts, 290)


def test_a_step_decides_many_merges_and_changes_counts_by_deltas(spark, monkeypatch):
    """Few passes over the pieces, and after each the table of pair counts is that of the pieces."""
    counts = random_counts("words", 3)
    table = spark.createDataFrame(list(counts.items()), "piece string, n bigint")
    steps = []
    advance = bpe._advanced

    def watched(written, pairs, rounds):
        made, next_pairs = advance(written, pairs, rounds)
        again = bpe._count_pairs(bpe._state(made), [])
        assert sorted(map(tuple, next_pairs.collect())) == sorted(map(tuple, again.collect()))
        steps.append(bpe._state(made).count())
        return made, next_pairs

    monkeypatch.setattr(bpe, "_advanced", watched)
    merges = bpe.learn(table, vocab_size=600).merges
    assert merges == plain_merges(counts, 600)
    assert len(steps) * 5 < len(merges) and steps[-1] < len(counts)


def test_waves_equal_merges_one_by_one():
    draw = random.Random(1)
    for _ in range(200):
        merges, symbols = [], 4
        for _ in range(draw.randrange(1, 12)):
            pair = draw.randrange(symbols), draw.randrange(symbols)
            if pair not in {m[:2] for m in merges}:
                merges.append((*pair, symbols))
                symbols += 1
        text = [draw.randrange(4) for _ in range(300)] + [-1]
        one = text
        for left, right, made in merges:
            one = bpe._merged(one, (left, right), made)
        flat, _ = bpe._apply(np.array(text, dtype=np.int32), np.ones(len(text), dtype=np.int64), bpe._waves(merges))
        assert flat.tolist() == one

"""SQL with the meaning of the registered queries, for an independent engine."""

from __future__ import annotations

_USER_LISTS = "SELECT user_id, min(event_id) AS first, string_agg(event_type, ',' ORDER BY event_id) AS labels FROM events GROUP BY user_id"

_BRANDS = "SELECT p_brand AS label, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand"

_NAMES = "SELECT p_name AS label, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_name"

_LABELLED = "SELECT d.doc_id, lang, source, n_chars, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"

_BUILDING = "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'"

_DICTIONARY = """SELECT 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS name, o_orderkey AS ord,
 o_orderpriority AS matched_name,
 o_orderstatus || '/' || CAST(o_orderkey AS VARCHAR) AS matched_value,
 o_orderstatus <> 'P' AS found FROM orders"""

_PRUNED = f"""
WITH counts AS ({_NAMES}),
rare AS (SELECT label FROM counts WHERE n < (SELECT median(n) FROM counts)),
long AS (SELECT o_custkey AS customer, p_name AS label, l_orderkey * 8 + l_linenumber AS pos
 FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)
SELECT customer, coalesce(string_agg(label, ',' ORDER BY pos, label)
 FILTER (WHERE label NOT IN (SELECT label FROM rare)), '') AS labels
FROM long GROUP BY customer"""

_CURATED = f"""
WITH coded AS (
 SELECT o_custkey AS entity, l_orderkey * 8 + l_linenumber AS pos, 'X-' || replace(p_name, ' ', '-') AS label
 FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
 WHERE contains(p_brand, 'Brand#1')),
entities AS (SELECT entity, min(pos) AS first FROM coded GROUP BY entity),
structures AS (
 SELECT c_custkey AS entity, c_name AS name,
  CASE WHEN c_acctbal >= 0 THEN c_nationkey || '/' || c_mktsegment || '/' || CAST(floor(c_acctbal / 50) AS BIGINT) END AS key,
  CASE WHEN c_acctbal >= -500 THEN c_mktsegment || '/' || c_custkey END AS value FROM customer),
numbered AS (
 SELECT e.entity, name, key, value, row_number() OVER (ORDER BY first, e.entity) - 1 AS pos
 FROM entities e LEFT JOIN structures s ON e.entity = s.entity),
kept_type AS (
 SELECT * FROM numbered WHERE entity IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')),
dictionary AS ({_DICTIONARY}),
candidates AS (
 SELECT k.entity, d.matched_name, d.matched_value, d.found,
  row_number() OVER (ORDER BY k.pos, d.ord) AS match_count
 FROM kept_type k JOIN dictionary d ON k.name = d.name WHERE k.key IS NULL),
every_row AS (
 SELECT entity, name, key, value, 0 AS src, pos FROM kept_type
 UNION ALL
 SELECT entity, matched_name, CASE WHEN starts_with(matched_value, 'F/') THEN 'K/' || matched_value END,
  matched_value, 1, match_count FROM candidates WHERE found),
valued AS (SELECT * FROM every_row WHERE value IS NOT NULL),
flagged AS (SELECT entity, row_number() OVER (PARTITION BY key ORDER BY src, pos) AS rn FROM valued),
clean AS (
 SELECT * FROM valued WHERE entity NOT IN (SELECT entity FROM flagged WHERE rn > 1) AND entity <> 1),
before AS (SELECT label, count(*) AS n FROM clean JOIN coded USING (entity) GROUP BY label)"""

_WORDS = r"regexp_extract_all(text, '\S+')"

_QUALITY = "SELECT lang, n_chars, quality FROM documents JOIN labels USING (doc_id)"

_SCORES = f"""
WITH q AS ({_QUALITY}),
step AS (SELECT lang AS label, n_chars, sum(quality) AS p, sum(1 - quality) AS n FROM q GROUP BY 1, 2),
run AS (SELECT *, sum(p) OVER w AS cp, sum(n) OVER w AS cn FROM step
 WINDOW w AS (PARTITION BY label ORDER BY n_chars DESC)),
scored AS (SELECT label,
 CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN sum(n * (cp - p / 2.0)) / (sum(p) * sum(n)) END AS roc_auc,
 CASE WHEN sum(p) > 0 THEN sum(p * cp / (cp + cn)) / sum(p) ELSE 0 END AS avg_precision
 FROM run GROUP BY label)"""


def _profile(length: str) -> str:
    q = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99, "p99_9": 0.999}
    parts = ", ".join(f"round(quantile_cont(v, {x}), 6) AS {name}" for name, x in q.items())
    return f"""SELECT count(*) AS n, round(avg(v), 6) AS mean, median(v) AS median,
 CAST(max(v) AS BIGINT) AS longest, CAST(min(v) AS BIGINT) AS shortest, {parts}
FROM (SELECT {length} AS v FROM documents)"""


def _describe(source: str, column: str, kind: str) -> str:
    return f"""SELECT count({column}) AS count, round(avg({column}), 6) AS mean, round(stddev_samp({column}), 6) AS std,
 CAST(min({column}) AS {kind}) AS min, round(quantile_cont({column}, 0.25), 6) AS p25, round(quantile_cont({column}, 0.5), 6) AS p50,
 round(quantile_cont({column}, 0.75), 6) AS p75, CAST(max({column}) AS {kind}) AS max FROM ({source})"""


def _describe_text(column: str) -> str:
    return f"""SELECT '{column}' AS "column", count({column}) AS count, count(DISTINCT {column}) AS "unique",
 (SELECT {column} FROM documents GROUP BY 1 ORDER BY count(*) DESC, {column} LIMIT 1) AS top,
 (SELECT count(*) FROM documents GROUP BY {column} ORDER BY 1 DESC LIMIT 1) AS freq FROM documents"""


_EVEN = "CAST(json_extract_string(props, '$.k') AS INTEGER)"

_BYTES = "octet_length(encode(text))"

_RUNS = f"""
WITH places AS (SELECT doc_id, unnest({_WORDS}) AS g, generate_subscripts({_WORDS}, 1) AS i FROM documents),
codes AS (SELECT doc_id, i, CAST(CAST('0x' || substr(md5(g), 1, 8) AS UBIGINT) AS BIGINT) % 2147483647 AS c FROM places),
near AS (SELECT doc_id, c, lead(c, 1) OVER w AS c1, lead(c, 2) OVER w AS c2, lead(c, 3) OVER w AS c3
 FROM codes WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
runs AS (SELECT doc_id, unnest([c, c + c1 * 31 % 2147483647,
 c + c1 * 31 % 2147483647 + c2 * 961 % 2147483647,
 c + c1 * 31 % 2147483647 + c2 * 961 % 2147483647 + c3 * 29791 % 2147483647]) AS h FROM near),
counts AS (SELECT doc_id, CAST(h % 2048 AS INTEGER) AS bucket, count(*) AS n FROM runs WHERE h IS NOT NULL GROUP BY 1, 2)"""

# The full pattern without lookahead: the last of several blanks before a word is cut off beforehand.
_PIECES = r"""
WITH marked AS (SELECT doc_id, regexp_replace(text, '(\s)(\s\S)', '\1' || chr(30) || '\2', 'g') AS t FROM documents),
cut AS (SELECT doc_id, regexp_extract_all(t, '''s|''t|''re|''ve|''m|''ll|''d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}\x1e]+|\s+') AS p FROM marked)
SELECT doc_id, CAST(len(p) AS INTEGER) AS n, md5(array_to_string(p, chr(31))) AS cuts FROM cut"""

# The same cuts with the line's end behind every text.
_PIECE_COUNTS = r"""
marked AS (SELECT regexp_replace(text || chr(10), '(\s)(\s\S)', '\1' || chr(30) || '\2', 'g') AS t FROM documents),
cut AS (SELECT unnest(regexp_extract_all(t, '''s|''t|''re|''ve|''m|''ll|''d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}\x1e]+|\s+')) AS piece FROM marked),
pieces AS (SELECT piece, count(*) AS n FROM cut GROUP BY piece)"""

#: Merges that recursive SQL learns too.
FIRST_MERGES = 12

# Merging one pair a step over tokens as hexadecimal bytes; ties go to the shorter and then to the order of the byte alphabet.
_MERGES = f"""
WITH RECURSIVE {_PIECE_COUNTS},
state AS (
 SELECT 0 AS step, n, list_transform(range(1, len(h) + 1, 2), lambda i: substr(h, i, 2)) AS toks, '' AS l, '' AS r
 FROM (SELECT n, lower(hex(encode(piece))) AS h FROM pieces)
 UNION ALL
 SELECT step + 1, n, list_reduce(list_transform(toks, lambda t: [t]),
  lambda done, t: CASE WHEN done[-1] = b.l AND t[1] = b.r THEN list_append(done[:-2], b.l || b.r) ELSE done || t END), b.l, b.r
 FROM state, (SELECT l, r FROM (
  SELECT n, toks[i] AS l, toks[i + 1] AS r FROM (SELECT n, toks, unnest(range(1, len(toks))) AS i FROM state))
  GROUP BY l, r HAVING sum(n) >= 2
  ORDER BY sum(n) DESC, len(l), l BETWEEN '21' AND '7e' OR l BETWEEN 'a1' AND 'ac' OR l >= 'ae' DESC, l,
   len(r), r BETWEEN '21' AND '7e' OR r BETWEEN 'a1' AND 'ac' OR r >= 'ae' DESC, r LIMIT 1) b
 WHERE step < {FIRST_MERGES})
SELECT DISTINCT CAST(step - 1 AS BIGINT) AS rank, l AS "left", r AS "right" FROM state WHERE step > 0"""


def _byte_ids(limit: int | None, columns: str | None = None) -> str:
    """Number and sum of the byte ids of each text, of its first ``limit`` bytes if there is a limit, or ``columns`` of each id.

    Ids follow the code points of the printable byte alphabet, behind five special tokens.
    """
    plain = "(33 <= b AND b <= 126) OR (161 <= b AND b <= 172) OR 174 <= b"
    hex_text = "hex(encode(text))" if limit is None else f"substr(hex(encode(text)), 1, {2 * limit})"
    ids = "SELECT doc_id, id FROM bytes JOIN alphabet USING (b)"
    sums = f"""SELECT d.doc_id, CAST(count(id) AS INTEGER) AS n, CAST(coalesce(sum(id), 0) AS INTEGER) AS total
FROM documents d LEFT JOIN ({ids}) x ON x.doc_id = d.doc_id GROUP BY 1"""
    return f"""
WITH alphabet AS (
 SELECT b, 4 + row_number() OVER (ORDER BY CASE WHEN {plain} THEN b ELSE 256 + rest END) AS id FROM (
  SELECT b, row_number() OVER (PARTITION BY {plain} ORDER BY b) - 1 AS rest FROM (SELECT unnest(range(0, 256)) AS b))),
spelled AS (SELECT doc_id, {hex_text} AS h FROM documents),
bytes AS (SELECT doc_id, CAST('0x' || substr(h, 2 * i + 1, 2) AS INTEGER) AS b
 FROM (SELECT doc_id, h, unnest(range(0, CAST(length(h) / 2 AS BIGINT))) AS i FROM spelled))
{sums if columns is None else f"SELECT {columns} FROM ({ids})"}"""


ORACLES: dict[str, str] = {
    "ordered_label_list": _USER_LISTS,
    "ordered_label_list_parts": """
WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS rank FROM events)
SELECT user_id, rank // 64 AS part, string_agg(event_type, ',' ORDER BY event_id) AS labels FROM ranked GROUP BY 1, 2""",
    "label_counts_top20": f"""
WITH top AS (SELECT * FROM ({_BRANDS}) ORDER BY n DESC, label LIMIT 20)
SELECT CAST(0 AS BIGINT) AS rank, '' AS label, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS total
UNION ALL
SELECT row_number() OVER w, label, n, CAST(sum(n) OVER w AS BIGINT) FROM top WINDOW w AS (ORDER BY n DESC, label)""",
    "label_counts": "SELECT event_type AS label, count(*) AS n FROM events GROUP BY 1",
    "value_counts": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1",
    "rare_label_list": f"WITH counts AS ({_NAMES}) SELECT label FROM counts WHERE n < (SELECT median(n) FROM counts)",
    "prune_rare_labels": _PRUNED,
    "prune_rare_events": """
WITH counts AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1),
rare AS (SELECT event_type FROM counts WHERE n < (SELECT median(n) FROM counts))
SELECT user_id, coalesce(string_agg(event_type, ',' ORDER BY event_id)
 FILTER (WHERE event_type NOT IN (SELECT event_type FROM rare)), '') AS labels FROM events GROUP BY 1""",
    "name_to_code": """SELECT p_partkey,
 CASE WHEN contains(p_type || ' ' || p_name, 'small') THEN 'X' || split_part(p_type || ' ' || p_name, ' ', 3) END AS code FROM part""",
    "attach_left": _LABELLED,
    "restrict_type": f"SELECT o_orderkey, o_custkey AS c_custkey, o_totalprice FROM orders WHERE o_custkey IN ({_BUILDING})",
    "exclude_ids": f"SELECT o_orderkey, o_custkey AS c_custkey, o_totalprice FROM orders WHERE o_custkey NOT IN ({_BUILDING})",
    "exclude_value": f"SELECT doc_id, quality FROM ({_LABELLED}) WHERE quality IS DISTINCT FROM 1",
    "missing_rows": f"SELECT doc_id, lang FROM ({_LABELLED}) WHERE quality IS NULL",
    "drop_missing": f"SELECT doc_id, quality FROM ({_LABELLED}) WHERE quality IS NOT NULL AND toxic IS NOT NULL",
    "non_empty": "SELECT conv_id, turn, CAST(length(trim(text)) AS INTEGER) AS n_chars FROM conversations WHERE trim(text) <> ''",
    "flag_duplicates": """SELECT doc_id,
 CAST(row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS INTEGER) AS is_duplicate FROM documents""",
    "drop_duplicate_entities": """
WITH flagged AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) AS rn FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
WHERE l_orderkey NOT IN (SELECT l_orderkey FROM flagged WHERE rn > 1)""",
    "concat_sources": """
WITH every_row AS (SELECT 0 AS src, c_custkey AS old, c_name AS name, c_acctbal AS balance FROM customer
 UNION ALL SELECT 1, s_suppkey, s_name, s_acctbal FROM supplier)
SELECT name, balance, row_number() OVER (ORDER BY src, old) - 1 AS pos FROM every_row""",
    "lookup_enrich": f"""
WITH dictionary AS ({_DICTIONARY}),
candidates AS (SELECT c_custkey AS pos, c_name AS query_name, matched_name, matched_value, found,
 row_number() OVER (ORDER BY c_custkey, ord) AS match_count
 FROM customer JOIN dictionary ON c_name = name WHERE c_acctbal < 0)
SELECT pos, query_name, matched_name, matched_value, match_count, 'DBX0' || pos || match_count AS code
FROM candidates WHERE found""",
    "curate_table": _CURATED + """
, rare AS (SELECT label FROM before WHERE n < (SELECT median(n) FROM before)),
lists AS (SELECT entity, coalesce(string_agg(label, ',' ORDER BY pos, label)
 FILTER (WHERE label NOT IN (SELECT label FROM rare)), '') AS labels FROM coded GROUP BY entity)
SELECT c.entity, c.name, c.key, c.value, l.labels FROM clean c JOIN lists l ON c.entity = l.entity""",
    "curate_counts": _CURATED + """
SELECT label, n AS n_before, CASE WHEN n >= (SELECT median(n) FROM before) THEN n END AS n_after FROM before""",
    "ingest_positions": "SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events",
    "dense_positions": "SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1 AS pos FROM customer",
    "head_rows": "SELECT p_partkey, p_name, p_brand FROM part ORDER BY p_partkey LIMIT 5",
    "join_by_position": "SELECT event_id AS pos, event_type, o_orderstatus FROM events JOIN orders ON event_id = o_orderkey",
    "running_value": """
WITH v AS (SELECT event_type, value, count(*) AS n FROM events GROUP BY 1, 2)
SELECT event_type, value, n, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY value) AS BIGINT) AS run_n FROM v""",
    "distinct_entities": "SELECT count(DISTINCT user_id) AS n_distinct FROM events",
    "describe_numeric": _describe("SELECT p_retailprice FROM part", "p_retailprice", "DOUBLE"),
    "describe_label_counts": _describe(_BRANDS, "n", "DOUBLE"),
    "value_quantiles": """SELECT CAST(q AS DOUBLE) AS q, round(value, 6) AS value FROM (
 SELECT 0.01 AS q, quantile_cont(value, 0.01) AS value FROM events
 UNION ALL SELECT 0.5, quantile_cont(value, 0.5) FROM events
 UNION ALL SELECT 0.999, quantile_cont(value, 0.999) FROM events)""",
    "describe_text": _describe_text("lang") + " UNION ALL " + _describe_text("source"),
    "length_profile": _profile("length(text)"),
    "token_length_profile": _profile(f"len({_WORDS})"),
    "longest_row": "SELECT doc_id, text, CAST(length(text) AS INTEGER) AS length FROM documents ORDER BY length(text) DESC, doc_id LIMIT 1",
    "row_counts": "SELECT count(props) AS n_lists, count(*) FILTER (WHERE json_type(props) <> 'ARRAY') AS n_unparsed FROM events",
    "convert_outcomes": f"""
WITH k AS (SELECT {_EVEN} % 2 = 0 AS good FROM events)
SELECT count(*) AS total, count(*) FILTER (WHERE good) AS success, count(*) FILTER (WHERE NOT good) AS failure,
 round(count(*) FILTER (WHERE good) * 100.0 / count(*), 2) AS success_rate FROM k""",
    "convert_function": f"""SELECT event_id, CASE WHEN {_EVEN} % 2 = 0 THEN CAST({_EVEN} AS VARCHAR) END AS output,
 CAST({_EVEN} % 2 = 0 AS INTEGER) AS ok FROM events""",
    "stream_convert": f"SELECT CAST({_EVEN} AS VARCHAR) AS output, count(*) AS n FROM events WHERE {_EVEN} % 2 = 0 GROUP BY 1",
    "roundtrip_table": _USER_LISTS,
    "roundtrip_headerless": "SELECT url, '' AS blank, CAST(page_id AS VARCHAR) AS page_id FROM pages",
    "bucketed_join": "SELECT doc_id, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id)",
    "grown_snapshot": """SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 2 END AS version, o_custkey, o_orderkey
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "exact_split": """SELECT doc_id, CAST(row_number() OVER (ORDER BY substr(md5(CAST(doc_id AS VARCHAR)), 1, 15), CAST(doc_id AS VARCHAR))
 <= (SELECT ceil(count(*) / 5.0) FROM documents) AS INTEGER) AS is_test FROM documents""",
    "sketched_lengths": "SELECT lang, count(*) AS n, 1 AS within FROM documents GROUP BY lang",
    "roundtrip_records": "SELECT doc_id, md5(text) AS text_md5 FROM documents",
    "roundtrip_lines": "SELECT p_name, row_number() OVER (ORDER BY p_partkey) - 1 AS pos FROM part",
    "roundtrip_matrix": """SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim,
 round(CAST(unnest(embedding) AS DOUBLE), 6) AS value FROM embeddings""",
    "roundtrip_cached": "SELECT * FROM supplier",
    "piece_counts": r"""SELECT piece, count(*) AS n FROM (
 SELECT unnest(regexp_extract_all(text, '\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+')) AS piece FROM documents) GROUP BY piece""",
    "byte_level_pieces": _PIECES,
    "byte_level_counts": f"WITH {_PIECE_COUNTS} SELECT piece, n FROM pieces",
    "bpe_first_merges": _MERGES,
    "pair_counts": r"""
WITH pieces AS (SELECT piece, count(*) AS n FROM (
 SELECT unnest(regexp_extract_all(text, '\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+')) AS piece FROM documents) GROUP BY piece),
places AS (SELECT piece, n, unnest(range(1, length(piece))) AS i FROM pieces)
SELECT substring(piece, i, 1) AS l, substring(piece, i + 1, 1) AS r, CAST(sum(n) AS BIGINT) AS n FROM places GROUP BY 1, 2""",
    "bpe_roundtrip": "SELECT doc_id, 1 AS ids_match, 1 AS text_match, md5(text) AS decoded FROM documents",
    "bpe_ids_file": f"SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, n AS n_tokens, total FROM ({_byte_ids(None)})",
    "byte_encode": f"SELECT doc_id, n AS n_tokens, total FROM ({_byte_ids(None)})",
    "longest_encoded": f"""SELECT doc_id AS pos, CAST(length(text) AS INTEGER) AS length, CAST({_BYTES} AS INTEGER) AS n_tokens,
 CAST(least({_BYTES}, 15) AS INTEGER) AS n_shown FROM documents ORDER BY length(text) DESC, doc_id LIMIT 1""",
    "frame_batches": f"""
WITH f AS (SELECT doc_id, text, doc_id // 16 AS batch, CAST(least({_BYTES}, 510) + 2 AS INTEGER) AS n FROM documents)
SELECT doc_id, batch, max(n) OVER (PARTITION BY batch) AS width, n AS n_valid, 0 AS first_id, 2 AS last_id FROM f""",
    "truncate_mask": f"""SELECT doc_id, n AS n_ids, total, n AS n_valid,
 CAST(CASE WHEN n < 1024 THEN n + 1 ELSE 0 END AS BIGINT) AS first_padding FROM ({_byte_ids(1024)})""",
    "corpus_report": """
SELECT 'outcomes' AS report, count(*) AS n, count(*) FILTER (WHERE NOT starts_with(url, 'https://')) AS n_bad FROM pages
UNION ALL SELECT 'verified', count(*), 0 FROM pages WHERE starts_with(url, 'https://')
UNION ALL SELECT 'sequences', count(*), 0 FROM pages WHERE starts_with(url, 'https://')
UNION ALL SELECT 'longest', max(length(url)) - 8, 0 FROM pages WHERE starts_with(url, 'https://')""",
    "hashed_counts": _RUNS + " SELECT doc_id, bucket, n FROM counts",
    "dense_vectors": _RUNS + """
 SELECT d.doc_id, CAST(coalesce(sum(n), 0) AS INTEGER) AS total, CAST(count(n) AS INTEGER) AS filled, 'array<smallint>' AS kind
FROM documents d LEFT JOIN counts c ON d.doc_id = c.doc_id GROUP BY 1""",
    "featurise_function": f"SELECT doc_id, CAST(length(text) AS DOUBLE) AS chars, CAST(len({_WORDS}) AS DOUBLE) AS words FROM documents",
    "pooled_tokens": f"""
WITH tokens AS ({_byte_ids(1024, "doc_id, id")}),
counts AS (SELECT doc_id, id * 31 % (SELECT count(*) FROM embeddings) AS vec_id, count(*) AS n FROM tokens GROUP BY 1, 2),
long AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding) AS v FROM embeddings)
SELECT doc_id, CAST(dim AS INTEGER) AS dim, round(sum(n * CAST(v AS DOUBLE)) / sum(n), 6) AS mean FROM counts JOIN long USING (vec_id) GROUP BY 1, 2""",
    "mean_pool": """
WITH long AS (SELECT label, embedding[1] >= 0 AS valid, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding) AS v FROM embeddings)
SELECT label, CAST(dim AS INTEGER) AS dim, round(avg(CAST(v AS DOUBLE)), 6) AS mean FROM long WHERE valid GROUP BY 1, 2""",
    "feature_shape": """SELECT 'hashed' AS matrix, count(*) AS n_rows, CAST(2048 AS BIGINT) AS width FROM documents
UNION ALL SELECT 'pooled', count(DISTINCT label), 64 FROM embeddings""",
    "binarize": """
WITH classes AS (SELECT DISTINCT event_type AS c FROM events),
users AS (SELECT DISTINCT user_id FROM events),
had AS (SELECT DISTINCT user_id, event_type FROM events)
SELECT u.user_id, string_agg(CASE WHEN h.event_type IS NULL THEN '0' ELSE '1' END, ',' ORDER BY c) AS y
FROM users u CROSS JOIN classes LEFT JOIN had h ON h.user_id = u.user_id AND h.event_type = c GROUP BY 1""",
    "label_indices": """
WITH classes AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS index FROM (SELECT DISTINCT event_type AS c FROM events))
SELECT DISTINCT user_id, index FROM events JOIN classes ON event_type = c""",
    "top_class": "SELECT vec_id, 'd' || (list_position(embedding, list_max(embedding)) - 1) AS label FROM embeddings",
    "hash_split": """SELECT doc_id,
 CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS UBIGINT) % 100 < 20 AS INTEGER) AS is_test FROM documents""",
    "gbt_multilabel": """
WITH classes AS (SELECT DISTINCT 'c' || label AS c FROM embeddings)
SELECT vec_id, CAST(CAST('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 8) AS UBIGINT) % 100 < 20 AS INTEGER) AS is_test,
 string_agg(CASE WHEN c = 'c' || label THEN '1' ELSE '0' END, ',' ORDER BY c) AS y, 1 AS sound
FROM embeddings CROSS JOIN classes GROUP BY vec_id, label""",
    "exact_match": f"SELECT round(avg(CAST((CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END) = quality AS INTEGER)), 6) AS accuracy FROM ({_QUALITY})",
    "ranking_scores": _SCORES + " SELECT label, round(roc_auc, 6) AS roc_auc, round(avg_precision, 6) AS avg_precision FROM scored",
    "macro_scores": _SCORES + " SELECT round(avg(roc_auc), 6) AS macro_roc_auc, round(avg(avg_precision), 6) AS macro_avg_precision FROM scored",
}

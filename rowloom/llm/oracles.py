"""DuckDB SQL for the queries that SQL can express.

Language, language model, fingerprints, personal data and quality have none: they
are tested against plain versions or by held-out accuracy.
"""

from __future__ import annotations

from itertools import permutations

from rowloom.llm import licences, lines, mixing, negatives, packing

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LINE_DEDUP = rf"""
WITH docs AS (SELECT doc_id, source, coalesce(text, '') AS text, text IS NULL AS missing FROM documents),
split AS (SELECT doc_id, source, missing, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs),
keyed AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS bare FROM split),
totals AS (SELECT source, count(*) AS pages FROM documents WHERE source IS NOT NULL AND text IS NOT NULL GROUP BY 1),
counts AS (SELECT source, bare, count(DISTINCT doc_id) AS n FROM keyed WHERE bare <> '' AND NOT missing GROUP BY 1, 2),
bad AS (SELECT source, bare FROM counts JOIN totals USING (source) WHERE n >= {lines.MIN_PAGES} AND n > {lines.RATIO} * pages),
marked AS (SELECT k.*, b.bare IS NOT NULL AS gone FROM keyed k LEFT JOIN bad b ON k.source = b.source AND k.bare = b.bare)
SELECT doc_id, CASE WHEN any_value(missing) THEN 0 ELSE count(*) END AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS text_sha256
FROM marked GROUP BY doc_id"""


def _canonical(text: str) -> str:
    """Expression for the canonical text of a unit."""
    bare = f"regexp_replace(lower({text}), '{licences.COPYRIGHT}', '', 'g')"
    bones = rf"concat(' ', trim(regexp_replace({bare}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ')"
    for variant, canonical in licences.EQUIVALENT:
        bones = f"replace({bones}, ' {variant} ', ' {canonical} ')"
    return f"trim({bones})"


def _licence_scan() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(name)}, {quoted(text)})" for name, text in licences.KNOWN)
    return f"""
WITH known AS (SELECT DISTINCT licence, {_canonical('text')} AS canon FROM (VALUES {known}) k(licence, text)),
units AS (SELECT doc_id, 0 AS line, text AS unit FROM documents WHERE text IS NOT NULL
 UNION ALL SELECT doc_id, generate_subscripts(p, 1), unnest(p)
 FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE contains(text, chr(10)))),
canon AS (SELECT doc_id, line, {_canonical('unit')} AS canon FROM units)
SELECT doc_id, CAST(line AS INTEGER) AS line, licence FROM canon JOIN known USING (canon)"""


PACKING = rf"""
WITH RECURSIVE sized AS (SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n FROM documents),
rounded AS (SELECT doc_id, n, n AS size FROM sized),
histogram AS (SELECT size, count(*) AS n FROM rounded GROUP BY 1),
ends AS (SELECT row_number() OVER (ORDER BY size) AS j, size, CAST(sum(n) OVER (ORDER BY size) AS DOUBLE) AS total FROM histogram),
points AS (SELECT 0 AS j, CAST(0 AS BIGINT) AS size, CAST(0 AS DOUBLE) AS total UNION ALL SELECT * FROM ends),
last AS (SELECT max(j) AS m FROM points),
best AS (
 SELECT 1 AS k, j, size * total AS cost, CAST(0 AS BIGINT) AS cut FROM points
 UNION ALL
 SELECT b.k + 1, e.j, min(b.cost + e.size * (e.total - p.total)), arg_min(b.j, (b.cost + e.size * (e.total - p.total), b.j))
 FROM best b JOIN points p ON p.j = b.j JOIN ends e ON e.j > b.j
 WHERE b.k < {packing.BUCKETS} GROUP BY b.k, e.j),
chosen AS (SELECT k, j FROM best JOIN last ON j = m WHERE m > 0 ORDER BY cost, k LIMIT 1),
path AS (
 SELECT k, j FROM chosen
 UNION ALL SELECT p.k - 1, b.cut FROM path p JOIN best b ON b.k = p.k AND b.j = p.j WHERE p.k > 1 AND b.cut > 0),
edges AS (SELECT size AS edge, row_number() OVER (ORDER BY size) - 1 AS bucket FROM path JOIN points USING (j)),
placed AS (SELECT r.doc_id, r.n, (SELECT min(edge) FROM edges WHERE edge >= r.size) AS edge FROM rounded r),
numbered AS (SELECT doc_id, n, edge, bucket, row_number() OVER (PARTITION BY bucket ORDER BY doc_id, n) - 1 AS i,
 greatest(1, {packing.BUDGET} // greatest(edge, 1)) AS room FROM placed JOIN edges USING (edge))
SELECT doc_id, n AS n_tokens, CAST(bucket AS INTEGER) AS bucket, edge AS bucket_length,
 CAST(i // room AS BIGINT) AS batch, CAST(i % room AS BIGINT) AS place FROM numbered"""

TOP_K = """
WITH vectors AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v
 FROM embeddings WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
 FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10"""

# The word class of the operator: everything but ASCII that is no digit and no lower-case letter.
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = rf"""
WITH docs AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
items AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
wide AS (SELECT *, least(10, len(w)) AS k FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS window
 FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM wide)),
sizes AS (SELECT DISTINCT k FROM windows),
places AS (SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS window
 FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, sizes)),
met AS (SELECT doc_id, p.k, i, item FROM places p JOIN windows x ON p.k = x.k AND p.window = x.window),
starts AS (SELECT DISTINCT doc_id, k, i FROM met),
hits AS (SELECT doc_id, count(DISTINCT spot) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS spot FROM starts) GROUP BY 1),
named AS (SELECT doc_id, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS list FROM met GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(x.n, 0) AS n_items,
 sha256(coalesce(x.list, '')) AS items_sha256, h.n IS NOT NULL AS contaminated
FROM docs d LEFT JOIN hits h USING (doc_id) LEFT JOIN named x USING (doc_id)"""

_ORDERS = ", ".join(f"('{''.join(p)}')" for p in permutations("ABCDE"))

FILTER_AUDIT = rf"""
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
split AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM docs),
given AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic
 FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
masked AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
 (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
 + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]+', '', 'g'))) > 3 * length(t))::INT
 + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(least < doc_id, false)::INT AS mask
 FROM split LEFT JOIN given USING (doc_id)),
counts AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE toxic) AS x FROM masked GROUP BY 1, 2),
steps AS (SELECT filter_order, step, 1 << (instr('ABCDE', substr(filter_order, step, 1)) - 1) AS bit,
 list_sum(list_transform(range(1, step), lambda i: 1 << (instr('ABCDE', substr(filter_order, i, 1)) - 1))) AS prior
 FROM (VALUES {_ORDERS}) o(filter_order), (SELECT unnest(range(1, 6)) AS step)),
placed AS (SELECT filter_order, CAST(step AS INTEGER) AS step, CAST(bit AS INTEGER) AS bit, CAST(coalesce(prior, 0) AS INTEGER) AS prior FROM steps),
made AS (SELECT part, filter_order, step, bit,
 sum(CASE WHEN mask & (prior | bit) = 0 THEN n ELSE 0 END) AS kept,
 sum(CASE WHEN mask & prior = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
 sum(CASE WHEN mask & prior <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
 sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
 sum(CASE WHEN mask & prior = 0 AND mask & bit <> 0 THEN g ELSE 0 END) AS good_lost,
 sum(CASE WHEN mask & prior = 0 AND mask & bit <> 0 THEN x ELSE 0 END) AS toxic_lost
 FROM counts, placed GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
 good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM made"""

SOURCE_MIX = rf"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
 CAST(CAST('0x' || substr(md5(concat_ws(':', '{mixing.SEED}', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(text, ''))), 1, {mixing.DIGITS}) AS BIGINT) AS DOUBLE)
 / {16**mixing.DIGITS}.0 AS draw FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
 [{', '.join(f'CAST({w} AS DOUBLE)' for w in mixing.WEIGHTS)}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1] AS weight FROM sized GROUP BY 1),
weighed AS (SELECT *, CAST({mixing.MOST} AS DOUBLE) * source_size AS most, CAST({mixing.MOST} AS DOUBLE) * source_size / weight AS full_at FROM sources),
totals AS (SELECT CAST(sum(source_size) AS DOUBLE) * {mixing.SHARE} AS total, sum(weight) AS heft FROM weighed),
levels AS (SELECT full_at, sum(most) AS m, sum(weight) AS w FROM weighed GROUP BY 1),
running AS (SELECT full_at, sum(m) OVER (ORDER BY full_at) - m AS given, heft - (sum(w) OVER (ORDER BY full_at) - w) AS open, total FROM levels, totals),
level AS (SELECT arg_min((total - given) / open, full_at) AS level FROM running WHERE given + full_at * open >= total),
aimed AS (SELECT source, source_size, CASE WHEN level IS NULL THEN most ELSE least(most, level * weight) END AS target FROM weighed, level),
rated AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM aimed)
SELECT doc_id, size, source_size, target, CAST(floor(rate) + (draw < rate - floor(rate))::INT AS BIGINT) AS copies,
 CAST(size * (floor(rate) + (draw < rate - floor(rate))::INT) AS BIGINT) AS taken
FROM sized JOIN rated ON sized.source IS NOT DISTINCT FROM rated.source"""

HARD_NEGATIVES = f"""
WITH vectors AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
 list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {negatives.SCALE}) AS BIGINT)) AS v
 FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
pairs AS (SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id, CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
 FROM vectors a JOIN vectors c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v) WHERE a.vec_id % 100 = 0),
near AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
 QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {negatives.POSITIVES}),
met AS (SELECT n.anchor_id, positive_id, positive_score, p.vec_id AS negative_id, p.score AS negative_score,
 CAST(row_number() OVER (PARTITION BY n.anchor_id, positive_id ORDER BY p.score DESC, p.vec_id) AS INTEGER) AS rank
 FROM near n JOIN pairs p ON n.anchor_id = p.anchor_id AND NOT p.same
 AND {negatives.LEAST} * positive_score <= 100 * p.score AND 100 * p.score <= {negatives.GREATEST} * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM met WHERE rank <= {negatives.NEGATIVES}"""

ORACLES: dict[str, str] = {
    "op1_line_dedup": LINE_DEDUP,
    "op2_licence_scan": _licence_scan(),
    "op5_packing": PACKING,
    "op7_top_k": TOP_K,
    "op9_decontamination": DECONTAMINATION,
    "op11_filter_audit": FILTER_AUDIT,
    "op12_source_mix": SOURCE_MIX,
    "op13_hard_negatives": HARD_NEGATIVES,
}

"""DuckDB SQL for those queries of the subpackage that SQL can express."""

TURNS = """
turns AS (
    SELECT conv_id, role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n
    FROM (SELECT conv_id, turn, role, text FROM conversations
          UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'))"""

OP7 = f"""
WITH {TURNS},
sized AS (SELECT *, CASE role WHEN 'system' THEN 19 WHEN 'user' THEN 18 WHEN 'assistant' THEN 6
                    ELSE 16 + length(role) END
                    + length(text) + length(text) - length(replace(replace(replace(replace(text, '~', ''), '[', ''), '<', ''), ']', '')) AS size
          FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(size)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

OP9 = """
WITH good AS (
    SELECT vec_id, row_number() OVER () AS uid, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS HUGEINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT q.uid, q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
    FROM good q JOIN good c ON len(q.v) = len(c.v) AND q.uid <> c.uid WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""

OP10 = r"""
WITH docs AS (
    SELECT doc_id, row_number() OVER () AS row_no,
           list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
    FROM documents),
windows AS (
    SELECT doc_id, row_no, pos, array_to_string(words[pos:pos + 49], ' ') AS w
    FROM (SELECT doc_id, row_no, words, unnest(generate_series(1, len(words) - 49)) AS pos
          FROM docs WHERE len(words) >= 50 AND doc_id IS NOT NULL)),
hits AS (
    SELECT row_no, pos FROM (SELECT row_no, pos, doc_id, min(doc_id) OVER (PARTITION BY w) AS least FROM windows) WHERE least < doc_id),
gone AS (SELECT DISTINCT row_no, unnest(generate_series(pos, pos + 49)) AS pos FROM hits),
each AS (SELECT row_no, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM docs),
kept AS (SELECT row_no, string_agg(word, ' ' ORDER BY pos) AS text, count(*) AS n
         FROM each ANTI JOIN gone USING (row_no, pos) GROUP BY row_no)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (row_no)
"""


OP11 = """
WITH good AS (
    SELECT vec_id, row_number() OVER () AS uid, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS HUGEINT)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT a.uid, a.vec_id AS anchor_id, a.label = c.label AS same, c.uid AS c_uid, c.vec_id,
           coalesce(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])), 0) AS score
    FROM good a JOIN good c ON len(a.v) = len(c.v) AND a.uid <> c.uid WHERE a.vec_id % 50 = 0),
positives AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id NULLS LAST, c_uid) AS nth FROM scored WHERE same)
    WHERE nth <= 5),
ranked AS (
    SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
           row_number() OVER (PARTITION BY p.uid, p.nth ORDER BY n.score DESC, n.vec_id NULLS LAST) AS rank
    FROM positives p JOIN scored n ON p.uid = n.uid AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, CAST(positive_score AS BIGINT) AS positive_score,
       CAST(negative_score AS BIGINT) AS negative_score
FROM ranked WHERE rank <= 3
"""

_WORDS = r"""list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"""

OP12 = f"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS row_no, {_WORDS} AS words FROM documents),
items AS (SELECT item_id, words, least(len(words), 10) AS k FROM (SELECT item_id, {_WORDS} AS words FROM benchmark) WHERE len(words) > 0),
patterns AS (
    SELECT DISTINCT k, item_id, array_to_string(words[pos:pos + k - 1], ' ') AS w
    FROM (SELECT *, unnest(generate_series(1, len(words) - k + 1)) AS pos FROM items)),
grams AS (
    SELECT row_no, pos, k, array_to_string(words[pos:pos + k - 1], ' ') AS w
    FROM (SELECT row_no, words, k, unnest(generate_series(1, len(words) - k + 1)) AS pos
          FROM docs, (SELECT DISTINCT k FROM items) WHERE len(words) >= k)),
hits AS (SELECT row_no, pos, k, item_id FROM grams JOIN patterns USING (k, w)),
covered AS (SELECT row_no, count(DISTINCT pos) AS n
            FROM (SELECT row_no, unnest(generate_series(pos, pos + k - 1)) AS pos FROM hits) GROUP BY row_no),
named AS (SELECT row_no, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
          FROM (SELECT DISTINCT row_no, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY row_no)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (row_no) LEFT JOIN named USING (row_no)
"""


def oracle() -> dict[str, str]:
    return {"op7_chat_format": OP7, "op9_exact_top_k": OP9, "op10_substring_dedup": OP10, "op11_hard_negatives": OP11,
            "op12_decontamination": OP12}

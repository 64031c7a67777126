"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

WORD_WINDOWS = r"""
WITH doc_words AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents),
item_words AS (
    SELECT item_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark),
grams AS (
    SELECT DISTINCT item_id, least(10, len(w)) AS width,
        unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2),
            lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' '))) AS gram
    FROM item_words WHERE len(w) > 0),
widths AS (SELECT DISTINCT width FROM grams),
spans AS (
    SELECT doc_id, width, unnest(range(1, len(w) - width + 2)) AS i, w
    FROM doc_words, widths WHERE len(w) >= width),
hits AS (
    SELECT doc_id, s.width, i, item_id
    FROM spans s JOIN grams g ON s.width = g.width AND array_to_string(w[i:i + s.width - 1], ' ') = gram),
hit_words AS (
    SELECT doc_id, count(DISTINCT spot) AS n_hit
    FROM (SELECT doc_id, unnest(range(i, i + width)) AS spot FROM hits) GROUP BY doc_id),
hit_items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL)
    GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

MIDDLE_CUTS = r"""
WITH texts AS (
    SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
        sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest
    FROM documents),
drawn AS (
    SELECT doc_id, t, n,
        CAST('0x' || substr(digest, 1, 8) AS BIGINT) % (n + 1) AS one,
        CAST('0x' || substr(digest, 9, 8) AS BIGINT) % (n + 1) AS two,
        CAST('0x' || substr(digest, 17, 8) AS BIGINT) % 100 AS dice,
        CAST('0x' || substr(digest, 25, 8) AS BIGINT) % 100 AS turn
    FROM texts),
cuts AS (
    SELECT doc_id, t, n, least(one, two) AS low, greatest(one, two) AS high,
        CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR dice >= 90
            THEN 'plain' WHEN turn < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM drawn),
parts AS (
    SELECT *, substr(t, 1, low) AS p, substr(t, low + 1, high - low) AS m, substr(t, high + 1) AS s FROM cuts)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
    CASE WHEN form <> 'plain' THEN CAST(low AS BIGINT) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN CAST(high - low AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM parts
"""


def statements() -> dict[str, str]:
    return {"op1_decontamination": WORD_WINDOWS, "op13_fill_in_middle": MIDDLE_CUTS}

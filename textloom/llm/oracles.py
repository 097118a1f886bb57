"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from . import decontaminate, ngram_join

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"


def op10_decontamination(window: int = decontaminate.WINDOW) -> str:
    return f"""WITH i AS (SELECT coalesce(item_id::varchar, '') AS item, {_ALNUM} AS w FROM benchmark WHERE text IS NOT NULL),
g AS (SELECT DISTINCT item, k, array_to_string(w[p + 1 : p + k], ' ') AS gram FROM (SELECT item, w, k, unnest(range(len(w) - k + 1)) AS p FROM (SELECT item, w, least({window}, len(w)) AS k FROM i WHERE len(w) > 0))),
d AS (SELECT row_number() OVER () AS r, doc_id, {_ALNUM} AS w FROM documents),
hits AS (SELECT r, p, g.k, item FROM (SELECT r, k, p, array_to_string(w[p + 1 : p + k], ' ') AS gram FROM (SELECT r, w, k, unnest(range(len(w) - k + 1)) AS p FROM d, (SELECT DISTINCT k FROM g) WHERE len(w) >= k)) JOIN g USING (k, gram)),
n AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS place FROM hits) GROUP BY r), s AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN n USING (r) LEFT JOIN s USING (r)"""


def op2_ngram_join(n: int = ngram_join.N, num: int = ngram_join.NUM, den: int = ngram_join.DEN) -> str:
    """Documents of equal sets are one class; classes are compared through the n-grams that they share."""
    return f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {n} THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(len(w) - {n - 1}), lambda i: array_to_string(w[i + 1 : i + {n}], ' ')))) END AS grams FROM d),
c AS (SELECT sha256(array_to_string(grams, chr(10))) AS node, any_value(grams) AS grams, len(any_value(grams)) AS size, count(*) AS copies, min(doc_id) AS low FROM s WHERE len(grams) > 0 GROUP BY 1),
u AS (SELECT node, size, unnest(grams) AS gram FROM c),
p AS (SELECT a.node AS a, b.node AS b FROM u a JOIN u b ON a.gram = b.gram AND a.node <> b.node AND {den} * a.size >= {num} * b.size AND {den} * b.size >= {num} * a.size GROUP BY a.node, b.node, a.size, b.size HAVING {den} * count(*) >= {num} * (a.size + b.size - count(*))),
t AS (SELECT node, node AS seen FROM c UNION SELECT t.node, p.b FROM t JOIN p ON t.seen = p.a),
m AS (SELECT t.node, min(c.low) AS component FROM t JOIN c ON c.node = t.seen GROUP BY t.node), l AS (SELECT p.a AS node, sum(c.copies) AS links FROM p JOIN c ON c.node = p.b GROUP BY p.a)
SELECT s.doc_id, len(s.grams)::bigint AS n_shingles, coalesce(component, s.doc_id) AS component_id, coalesce(copies - 1 + coalesce(links, 0), 0)::bigint AS n_links FROM s LEFT JOIN c ON len(s.grams) > 0 AND c.node = sha256(array_to_string(s.grams, chr(10))) LEFT JOIN m USING (node) LEFT JOIN l USING (node)"""


ORACLES = {"op2_ngram_join": op2_ngram_join(), "op10_decontamination": op10_decontamination()}

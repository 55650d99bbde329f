"""DuckDB SQL for the corpus queries that SQL can express over whole tables."""

from pairwright.llm.url_filter import RULES, SOFT, SOFT_WEIGHT, STRICT

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
TRIM = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP1 = f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array({LOW.format("coalesce(text, '')")}, '{BETWEEN}'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array({LOW.format("coalesce(text, '')")}, '{BETWEEN}'), lambda x: x <> '') AS w FROM benchmark),
s AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
      FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
k AS (SELECT DISTINCT k FROM s),
p AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, k WHERE len(w) >= k)),
h AS (SELECT doc_id, item_id, i, k FROM p JOIN s USING (k, win)),
n AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM h) GROUP BY doc_id),
g AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM h GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN g USING (doc_id)
"""

_strict = " OR ".join(rf"regexp_matches(u, '(^|[^0-9a-z]){t}($|[^0-9a-z])')" for t in STRICT)
_soft = " + ".join(rf"{w} * CAST(regexp_matches(u, '(^|[^0-9a-z]){t}($|[^0-9a-z])') AS INT)" for t, w in SOFT.items())
_fits = [(h, p, v, rf"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')") for h, p, v in sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r[0]))]
_rule = " ".join(f"WHEN {fit} THEN '{h}{p}'" for h, p, _, fit in _fits)
_verdict = " ".join(f"WHEN {fit} THEN '{v}'" for _, _, v, fit in _fits)

OP3 = f"""
WITH r AS (SELECT page_id, coalesce({LOW.format("url")}, '') AS u, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, u, {LOW.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r)
SELECT page_id, host, path, CASE {_rule} END AS rule,
       CASE {_verdict} WHEN {_strict} OR ({_soft}) >= {SOFT_WEIGHT} THEN 'block' ELSE 'allow' END AS verdict
FROM h
"""

OP5 = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT doc_id, i, line, {LOW.format(f"trim(line, {TRIM})")} AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY doc_id
"""

OP10 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
s AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS norm FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT vec_id, list_transform(e, lambda x: x / norm) AS e FROM s WHERE norm > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_inner_product(a.e, b.e) >= 0.9),
c AS (WITH RECURSIVE r(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a) SELECT a, min(b) AS low FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""

OP11 = r"""
WITH p AS (SELECT row_number() OVER () AS id, lang, string_split_regex(piece, '[ \t]+') AS raw
           FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\x0C\r]')) AS piece FROM documents)),
w AS (SELECT lang, list_filter(raw, lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, w[i:i + k - 1] AS ws
      FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) AS v(k) WHERE len(w) >= k)),
f AS MATERIALIZED (SELECT lang, k, phrase, any_value(ws) AS ws, count(*) AS n FROM g GROUP BY lang, k, phrase),
c AS MATERIALIZED (SELECT lang, k, phrase, ws, n AS a FROM f WHERE k > 1 AND n >= 10),
parts AS MATERIALIZED (SELECT lang, k, phrase, a, j, array_to_string(ws[1:j], ' ') AS head, array_to_string(ws[j + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
cut AS (SELECT *, CAST((1000000 * CAST(a AS HUGEINT) * a) // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score
        FROM parts JOIN (SELECT lang, phrase AS head, n AS l FROM f) USING (lang, head) JOIN (SELECT lang, phrase AS tail, n AS r FROM f) USING (lang, tail)),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
longer AS (SELECT lang, part, max(a) AS a FROM (SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS part FROM c WHERE k = 3) GROUP BY lang, part),
kept AS (SELECT best.* FROM best LEFT JOIN longer ON longer.lang = best.lang AND longer.part = best.phrase WHERE longer.a IS NULL OR 100 * longer.a < 50 * best.a),
total AS (SELECT lang, sum(n) AS n FROM f WHERE k = 1 GROUP BY lang)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN total USING (lang) WHERE rank <= 2000
"""

OP13 = """
WITH own AS (SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS t FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, t, xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
             lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 9 AS n FROM own),
s AS (SELECT h.conv_id, list_concat(coalesce(b.t, [])[1:h.n], h.t[h.n + 1:]) AS t FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 5),
m AS (SELECT conv_id, t, t[1:d] AS p, d FROM (SELECT conv_id, t, unnest(range(0, len(t) + 1)) AS d FROM s)),
n AS (SELECT p, d, min(conv_id) AS first, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(t) = d), '')) AS ends,
             CASE WHEN d > 0 THEN (count(*) - 1) * strlen(p[d].text) ELSE 0 END AS saved FROM m GROUP BY p, d),
k AS (SELECT p[1:d - 1] AS p, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
x AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON k.p = n.p),
u AS (SELECT p[1:i] AS p, sum(CAST(n_children = 0 AS INT)) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT *, unnest(range(0, d + 1)) AS i FROM x) GROUP BY 1)
SELECT x.first AS conv_id, CAST(x.d AS BIGINT) AS depth, up.first AS parent_conv_id, x.n_convs, x.n_children, CAST(u.n_leaves AS BIGINT) AS n_leaves, CAST(u.saved_tokens AS BIGINT) AS saved_tokens, x.ends AS ends_sha256
FROM x JOIN u ON u.p = x.p LEFT JOIN n up ON x.d > 0 AND up.p = x.p[1:x.d - 1]
"""

ORACLES = {
    "op1_decontamination": OP1, "op3_url_filter": OP3, "op5_line_dedup": OP5, "op10_vector_dedup": OP10, "op11_phrase_mining": OP11, "op13_prefix_trie": OP13,
}

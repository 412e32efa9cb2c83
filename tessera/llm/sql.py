"""The queries' results in DuckDB SQL, where it can express them."""

BLANKS = r"[\x20\x09-\x0D]+"

URL_FILTER = r"""
WITH parts AS (
  SELECT page_id, url,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
rules(verdict, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
                                ('block', 'example.net', '/de/8'), ('block', 'org', '/es/'))
SELECT page_id, url, host, path,
       (SELECT h || p FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
        ORDER BY length(h || p) DESC, length(h) DESC, verdict LIMIT 1) AS rule,
       coalesce((SELECT verdict FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
        ORDER BY length(h || p) DESC, length(h) DESC, verdict LIMIT 1), 'allow') AS verdict
FROM parts
"""

EXACT_DEDUP = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
g AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY body)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(n.body) AS text_sha256
FROM n JOIN g USING (body)
"""

LINE_DEDUP = r"""
WITH raw AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
flat AS (SELECT doc_id, text, generate_subscripts(lines, 1) - 1 AS pos, unnest(lines) AS l FROM raw),
plain AS (SELECT doc_id, text, pos, trim(regexp_replace(l, '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS l FROM flat),
masked AS (SELECT doc_id, text, pos, regexp_replace(l, '[^\x20]*[0-9][^\x20]*', '<*>', 'g') AS l FROM plain WHERE l <> ''),
t AS (SELECT *, len(string_split(l, ' ')) AS n, array_to_string(string_split(l, ' ')[1:3], ' ') AS lead FROM masked),
leaves AS (SELECT n, lead FROM t GROUP BY n, lead HAVING count(DISTINCT text) >= CASE WHEN n >= 50 THEN 2 ELSE 10 END),
leaf_lines AS (SELECT n, lead, l, count(DISTINCT text) AS texts FROM t JOIN leaves USING (n, lead) GROUP BY n, lead, l),
tok AS (SELECT n, lead, l, texts, generate_subscripts(string_split(l, ' '), 1) AS ix, unnest(string_split(l, ' ')) AS token
        FROM leaf_lines),
weight AS (SELECT n, lead, ix, token, sum(texts) AS w FROM tok GROUP BY n, lead, ix, token),
modal AS (SELECT n, lead, ix, token AS modal FROM weight
          QUALIFY row_number() OVER (PARTITION BY n, lead, ix ORDER BY w DESC, token DESC) = 1),
first_taken AS (SELECT l, tok.n AS n FROM tok JOIN modal USING (n, lead, ix) GROUP BY tok.n, lead, l
                HAVING avg(CASE WHEN token = modal THEN 1 ELSE 0 END) >= 0.7),
tok_b AS (SELECT tok.* FROM tok ANTI JOIN first_taken f ON tok.l = f.l AND tok.n = f.n),
weight_b AS (SELECT n, lead, ix, token, sum(texts) AS w FROM tok_b GROUP BY n, lead, ix, token),
modal_b AS (SELECT n, lead, ix, token AS modal FROM weight_b
            QUALIFY row_number() OVER (PARTITION BY n, lead, ix ORDER BY w DESC, token DESC) = 1),
second_taken AS (SELECT l, tok_b.n AS n FROM tok_b JOIN modal_b USING (n, lead, ix) GROUP BY tok_b.n, lead, l
                 HAVING avg(CASE WHEN token = modal THEN 1 ELSE 0 END) >= 0.7),
taken AS (SELECT l, n, 1 AS k FROM first_taken UNION ALL SELECT l, n, 2 AS k FROM second_taken),
placed AS (SELECT t.*, CASE WHEN k.l IS NULL THEN 'l ' || t.l ELSE 'n ' || k || ' ' || t.n || ' ' || lead END AS template
           FROM t LEFT JOIN taken k ON t.l = k.l AND t.n = k.n),
gone AS (SELECT template, count(DISTINCT text) AS texts, min(doc_id) AS first_id FROM placed GROUP BY template, n
         HAVING count(DISTINCT text) >= CASE WHEN n >= 50 THEN 2 ELSE 10 END),
dropped AS (SELECT DISTINCT doc_id, text, pos FROM placed JOIN gone USING (template)
            WHERE texts >= 10 OR doc_id IS DISTINCT FROM first_id),
marked AS (SELECT f.doc_id, f.text, f.pos, f.l, d.pos IS NOT NULL AS gone
           FROM (SELECT DISTINCT * FROM flat) f LEFT JOIN dropped d
             ON f.doc_id IS NOT DISTINCT FROM d.doc_id AND f.text = d.text AND f.pos = d.pos),
kept AS (SELECT doc_id, text, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
                coalesce(string_agg(l, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept_text
         FROM marked GROUP BY doc_id, text)
SELECT r.doc_id, n_lines, n_dropped, sha256(kept_text) AS kept_sha256
FROM raw r JOIN kept k ON r.doc_id IS NOT DISTINCT FROM k.doc_id AND r.text = k.text
"""

LINE_DEDUP_ALL = r"""
WITH raw AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
flat AS (SELECT doc_id, text, generate_subscripts(lines, 1) - 1 AS pos, unnest(lines) AS l FROM raw),
plain AS (SELECT doc_id, text, pos, trim(regexp_replace(l, '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS l FROM flat),
masked AS (SELECT doc_id, text, pos, regexp_replace(l, '[^\x20]*[0-9][^\x20]*', '<*>', 'g') AS l FROM plain WHERE l <> ''),
t AS (SELECT *, len(string_split(l, ' ')) AS n, array_to_string(string_split(l, ' ')[1:3], ' ') AS lead FROM masked),
leaves AS (SELECT n, lead FROM t GROUP BY n, lead HAVING count(DISTINCT text) >= CASE WHEN n >= 50 THEN 2 ELSE 10 END),
leaf_lines AS (SELECT n, lead, l, count(DISTINCT text) AS texts FROM t JOIN leaves USING (n, lead) GROUP BY n, lead, l),
tok AS (SELECT n, lead, l, texts, generate_subscripts(string_split(l, ' '), 1) AS ix, unnest(string_split(l, ' ')) AS token
        FROM leaf_lines),
weight AS (SELECT n, lead, ix, token, sum(texts) AS w FROM tok GROUP BY n, lead, ix, token),
modal AS (SELECT n, lead, ix, token AS modal FROM weight
          QUALIFY row_number() OVER (PARTITION BY n, lead, ix ORDER BY w DESC, token DESC) = 1),
first_taken AS (SELECT l, tok.n AS n FROM tok JOIN modal USING (n, lead, ix) GROUP BY tok.n, lead, l
                HAVING avg(CASE WHEN token = modal THEN 1 ELSE 0 END) >= 0.7),
tok_b AS (SELECT tok.* FROM tok ANTI JOIN first_taken f ON tok.l = f.l AND tok.n = f.n),
weight_b AS (SELECT n, lead, ix, token, sum(texts) AS w FROM tok_b GROUP BY n, lead, ix, token),
modal_b AS (SELECT n, lead, ix, token AS modal FROM weight_b
            QUALIFY row_number() OVER (PARTITION BY n, lead, ix ORDER BY w DESC, token DESC) = 1),
second_taken AS (SELECT l, tok_b.n AS n FROM tok_b JOIN modal_b USING (n, lead, ix) GROUP BY tok_b.n, lead, l
                 HAVING avg(CASE WHEN token = modal THEN 1 ELSE 0 END) >= 0.7),
taken AS (SELECT l, n, 1 AS k FROM first_taken UNION ALL SELECT l, n, 2 AS k FROM second_taken),
others AS (SELECT leaf_lines.*, string_split(l, ' ') AS w FROM leaf_lines ANTI JOIN taken USING (l, n)),
heads AS (SELECT n, lead, list_reduce(list([w] ORDER BY texts DESC, l DESC),
            lambda found, x: CASE WHEN len(list_filter(found, lambda h: len(list_filter(list_zip(h, x[1]), lambda z: z[1] = z[2])) / n >= 0.7)) > 0
                                  THEN found ELSE list_concat(found, x) END) AS heads
          FROM others GROUP BY n, lead),
led AS (SELECT l, n, array_to_string(list_filter(heads, lambda h: len(list_filter(list_zip(h, w), lambda z: z[1] = z[2])) / n >= 0.7)[1], ' ') AS head
        FROM others JOIN heads USING (n, lead)),
placed AS (SELECT t.*, CASE WHEN k.l IS NULL THEN 'l ' || coalesce(led.head, t.l) ELSE 'n ' || k || ' ' || t.n || ' ' || lead END AS template
           FROM t LEFT JOIN taken k ON t.l = k.l AND t.n = k.n LEFT JOIN led ON t.l = led.l AND t.n = led.n),
gone AS (SELECT template, count(DISTINCT text) AS texts, min(doc_id) AS first_id FROM placed GROUP BY template, n
         HAVING count(DISTINCT text) >= CASE WHEN n >= 50 THEN 2 ELSE 10 END),
dropped AS (SELECT DISTINCT doc_id, text, pos FROM placed JOIN gone USING (template)
            WHERE texts >= 10 OR doc_id IS DISTINCT FROM first_id),
marked AS (SELECT f.doc_id, f.text, f.pos, f.l, d.pos IS NOT NULL AS gone
           FROM (SELECT DISTINCT * FROM flat) f LEFT JOIN dropped d
             ON f.doc_id IS NOT DISTINCT FROM d.doc_id AND f.text = d.text AND f.pos = d.pos),
kept AS (SELECT doc_id, text, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
                coalesce(string_agg(l, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept_text
         FROM marked GROUP BY doc_id, text)
SELECT r.doc_id, n_lines, n_dropped, sha256(kept_text) AS kept_sha256
FROM raw r JOIN kept k ON r.doc_id IS NOT DISTINCT FROM k.doc_id AND r.text = k.text
"""

REACH = """
edges AS (SELECT a AS x, b AS y FROM links UNION ALL SELECT b, a FROM links),
reach(node, seen) AS (SELECT DISTINCT x, x FROM edges UNION SELECT r.node, e.y FROM reach r JOIN edges e ON e.x = r.seen),
comp AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
"""

MINHASH = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                       'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s
       FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM sh p JOIN sh q ON p.s = q.s AND p.doc_id < q.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
""" + REACH + """
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component_id, w.doc_id) AS component_id,
       coalesce(component_id, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN comp ON comp.node = w.doc_id
"""

COVER_TREE = r"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id < q.vec_id AND len(p.e) = len(q.e)
          WHERE list_cosine_similarity(p.e, q.e) >= 0.95),
""" + REACH + """,
n AS (SELECT x AS vec_id, count(*) AS n_links FROM edges GROUP BY x)
SELECT v.vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, v.vec_id) AS component_id,
       coalesce(component_id, v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN n USING (vec_id) LEFT JOIN comp ON comp.node = v.vec_id
"""

SQL = {
    "op4_cover_tree": COVER_TREE,
    "op10_minhash": MINHASH,
    "op1_url_filter": URL_FILTER,
    "op7_exact_dedup": EXACT_DEDUP,
    "op8_line_dedup": LINE_DEDUP,
    "op8_line_dedup_all": LINE_DEDUP_ALL,
}

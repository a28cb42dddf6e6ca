"""SQL statements of the queries that SQL can express."""


def _leaves(text: str) -> str:
    return (
        f"list_transform(string_split({text}, chr(10)), lambda p: "
        "list_transform(regexp_extract_all(p, '(?s).{1,64}'), lambda x: substring(md5(x), 1, 16)))"
    )


def _paragraphs(tree: str) -> str:
    return f"list_transform({tree}, lambda p: md5(array_to_string(p, '')))"


def _sections(tree: str) -> str:
    return (
        f"list_transform(range(0, len({tree}), 8), lambda i: md5(array_to_string(list_slice({_paragraphs(tree)}, i + 1, i + 8), '')))"
    )


def _fingerprint(tree: str, sections: str) -> str:
    return (
        f"sha256(array_to_string({sections}, '')) || '/' || array_to_string(list_transform({sections}, lambda s: substring(s, 1, 16)), ',') "
        f"|| '/' || array_to_string(list_transform({tree}, lambda p: array_to_string(list_transform(p, lambda x: substring(x, 1, 8)), '.')), ',')"
    )


def _likeness(a: str, b: str) -> str:
    return (
        f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE ELSE coalesce(2.0::DOUBLE * len(list_intersect(flatten({a}), flatten({b}))) "
        f"/ nullif(len(list_distinct(flatten({a}))) + len(list_distinct(flatten({b}))), 0), 0.0) END"
    )


FINGERPRINTS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text
      FROM d WINDOW w AS (ORDER BY doc_id DESC NULLS LAST, text)),
e AS (SELECT *, length(text) AS n_chars,
             substring(text, 1, length(text) - length(text) // 3) || substring(next_text, 1, length(text) // 3) AS edited FROM n),
t AS (SELECT doc_id, n_chars, edited, {_leaves('text')} AS tree, {_leaves('edited')} AS edited_tree, {_leaves('next_text')} AS next_tree FROM e),
s AS (SELECT *, {_sections('tree')} AS sections, {_sections('edited_tree')} AS edited_sections FROM t),
p AS (SELECT *, list_transform(tree, lambda p: array_to_string(list_transform(p, lambda x: substring(x, 1, 8)), '.')) AS pa,
             list_transform(edited_tree, lambda p: array_to_string(list_transform(p, lambda x: substring(x, 1, 8)), '.')) AS pb,
             list_transform(sections, lambda x: substring(x, 1, 16)) AS sa, list_transform(edited_sections, lambda x: substring(x, 1, 16)) AS sb FROM s)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, {_fingerprint('tree', 'sections')} AS fingerprint,
       {_fingerprint('edited_tree', 'edited_sections')} AS edited_fingerprint,
       {_likeness('tree', 'edited_tree')} AS near_edited, {_likeness('tree', 'next_tree')} AS near_next,
       array_to_string(list_filter(range(greatest(len(pa), len(pb))), lambda i: sa[i // 8 + 1] IS DISTINCT FROM sb[i // 8 + 1]
                                   AND pa[i + 1] IS DISTINCT FROM pb[i + 1]), ',') AS edited_paragraphs
FROM p
"""

LINES = r"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(range(len(lines))) AS line, unnest(lines) AS text FROM docs),
w AS (SELECT doc_id, line, list_filter(regexp_split_to_array(text, '[ \t\r\f\v]+'), lambda x: x <> '') AS words FROM l),
d AS (SELECT array_to_string(words, ' ') AS k, min((doc_id, line)) AS place, any_value(words) AS words, len(any_value(words)) AS n
      FROM w WHERE len(words) > 0 GROUP BY 1),
c AS (SELECT k, place, n, words, unnest(range(n)) AS i FROM d WHERE n >= 8),
v AS (SELECT k, place, n, i, array_to_string(list_concat(words[1:i], words[i + 2:]), ' ') AS rest FROM c),
same AS (SELECT rest, i, min(place) AS first FROM v GROUP BY 1, 2),
removed AS (SELECT v.k, v.place, d.k AS short, d.place AS short_place FROM v JOIN d ON d.k = v.rest AND d.n >= 8),
before AS (
  SELECT k, min(first) AS first FROM (
    SELECT v.k, same.first FROM v JOIN same USING (rest, i)
    UNION ALL SELECT k, short_place FROM removed UNION ALL SELECT short, place FROM removed) GROUP BY 1),
kept AS (
  SELECT place[1] AS doc_id, place[2] AS line FROM d LEFT JOIN before USING (k) WHERE first IS NULL OR first >= place
  UNION ALL SELECT doc_id, line FROM w WHERE len(words) = 0)
SELECT docs.doc_id, len(any_value(lines)) AS n_lines, count(line) AS n_kept,
       coalesce(string_agg(line::VARCHAR, ',' ORDER BY line), '') AS kept_lines
FROM docs LEFT JOIN kept ON kept.doc_id = docs.doc_id GROUP BY docs.doc_id
"""

CHATS = """
WITH m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, 'c' || conv_id || '-' AS stem FROM conversations),
calls AS (SELECT *, stem || turn AS id, CASE WHEN turn >= 2 THEN stem || (turn - 2) END AS after FROM m WHERE role = 'user'),
answers AS (SELECT conv_id, turn, text, stem || (turn - 1) AS id, row_number() OVER (PARTITION BY conv_id, stem || (turn - 1) ORDER BY turn, text) AS place FROM m WHERE role = 'assistant'),
results AS (SELECT conv_id, id, text AS result FROM answers WHERE place = 1),
spare AS (SELECT * FROM answers a WHERE place > 1 OR NOT EXISTS (SELECT 1 FROM calls c WHERE c.conv_id = a.conv_id AND c.id = a.id)),
items AS (
  SELECT c.conv_id, turn, 1 AS calls, (result IS NOT NULL)::INT AS linked, (turn % 3 = 2)::INT AS invalid,
         '{"arguments":{' || CASE WHEN after IS NULL THEN '' ELSE '"after":' || to_json(after)::VARCHAR || ',' END
         || CASE WHEN turn % 3 = 2 THEN '"page":' || turn || ',"query":' || to_json(text)::VARCHAR
                 ELSE '"question":' || to_json(text)::VARCHAR || ',"turn":' || turn END
         || '},"id":' || to_json(c.id)::VARCHAR || ',"name":' || CASE WHEN turn % 3 = 2 THEN '"search"' ELSE '"answer"' END
         || CASE WHEN result IS NULL THEN '' ELSE ',"result":' || to_json(result)::VARCHAR END
         || CASE WHEN turn % 3 = 2 THEN ',"violations":["unknown:after","unknown:page"]' ELSE '' END || '}' AS json
  FROM calls c LEFT JOIN results r ON r.conv_id = c.conv_id AND r.id = c.id
  UNION ALL
  SELECT conv_id, turn, 0, 0, 0, '{"content":' || to_json(text)::VARCHAR || ',"role":' || to_json(role)::VARCHAR || '}' FROM m
  WHERE role NOT IN ('user', 'assistant')
  UNION ALL
  SELECT conv_id, turn, 0, 0, 0, '{"content":' || to_json(text)::VARCHAR || ',"orphan":true,"role":"tool","tool_call_id":' || to_json(id)::VARCHAR || '}' FROM spare),
chats AS (SELECT conv_id, sum(calls)::BIGINT AS n_calls, sum(linked)::BIGINT AS n_linked, sum(invalid)::BIGINT AS n_invalid,
                 string_agg(json, ',' ORDER BY turn) AS items FROM items GROUP BY 1),
orphans AS (SELECT conv_id, count(*) AS n_orphans FROM spare GROUP BY 1),
totals AS (SELECT conv_id, count(*) AS n_messages FROM m GROUP BY 1)
SELECT conv_id, n_messages, coalesce(n_calls, 0) AS n_calls, coalesce(n_linked, 0) AS n_linked, coalesce(n_orphans, 0) AS n_orphans,
       coalesce(n_invalid, 0) AS n_invalid, '{"messages":[' || coalesce(items, '') || ']}' AS chat
FROM totals LEFT JOIN chats USING (conv_id) LEFT JOIN orphans USING (conv_id)
"""

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

RANKED = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents),
s AS (SELECT count(*) AS big, CAST(sum(len(ts)) AS BIGINT) AS every FROM d WHERE len(ts) > 0),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(big) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
x AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big) // every)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN tf USING (term), s GROUP BY ALL),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10"""


def _grams(k: int) -> str:
    return (
        f"g{k} AS (SELECT lang, g, count(*) AS a FROM (SELECT lang, unnest(list_transform(range(1, len(ws) - {k - 2}), lambda i: list_slice(ws, i, i + {k - 1}))) AS g "
        f"FROM p WHERE len(ws) >= {k}) GROUP BY ALL HAVING count(*) >= 10)"
    )


def _cut(a: str, left: str, right: str) -> str:
    return f"CAST((CAST({a} AS HUGEINT) * {a} * 1000000) // (CAST({left} AS HUGEINT) * {right}) AS BIGINT)"


COLLOCATIONS = f"""
WITH q AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), {_LOWER}), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM q),
t AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM p GROUP BY lang),
{_grams(1)}, {_grams(2)}, {_grams(3)},
s AS (SELECT lang, g, max(a) AS longer FROM (SELECT lang, list_slice(g, 1, 2) AS g, a FROM g3 UNION ALL SELECT lang, list_slice(g, 2, 3) AS g, a FROM g3) GROUP BY ALL),
c AS (
  SELECT g2.lang, g2.g, g2.a, x.a AS l, y.a AS r, {_cut('g2.a', 'x.a', 'y.a')} AS score
  FROM g2 JOIN g1 x ON x.lang = g2.lang AND x.g = list_slice(g2.g, 1, 1) JOIN g1 y ON y.lang = g2.lang AND y.g = list_slice(g2.g, 2, 2)
  LEFT JOIN s ON s.lang = g2.lang AND s.g = g2.g WHERE s.longer IS NULL OR 100 * s.longer < 50 * g2.a
  UNION ALL
  SELECT lang, g, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM (
    SELECT g3.lang, g3.g, g3.a, x.a AS l1, y.a AS r1, u.a AS l2, v.a AS r2, {_cut('g3.a', 'x.a', 'y.a')} AS s1, {_cut('g3.a', 'u.a', 'v.a')} AS s2
    FROM g3 JOIN g1 x ON x.lang = g3.lang AND x.g = list_slice(g3.g, 1, 1) JOIN g2 y ON y.lang = g3.lang AND y.g = list_slice(g3.g, 2, 3)
    JOIN g2 u ON u.lang = g3.lang AND u.g = list_slice(g3.g, 1, 2) JOIN g1 v ON v.lang = g3.lang AND v.g = list_slice(g3.g, 3, 3))),
k AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM k)
SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN t USING (lang) WHERE rank <= 2000"""

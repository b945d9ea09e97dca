"""DuckDB SQL of the operators, or of the columns of them that SQL can express."""

from __future__ import annotations

from millrace.llm.pii import KINDS
from millrace.llm.url_filter import LOWER, RULES, UPPER

_WORD = r"[^\x20\x09-\x0D]+"
_REACH = "walk AS (SELECT x, x AS y FROM link UNION SELECT walk.x, link.y FROM walk JOIN link ON walk.y = link.x), label AS (SELECT x, min(y) AS least FROM walk GROUP BY x)"

#: All pairs of vectors.
OP1 = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
ok AS MATERIALIZED (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) END >= 0.95),
{_REACH}, n AS (SELECT x, count(*) AS n FROM link GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(least, vec_id) AS component_id, coalesce(least, vec_id) = vec_id AS kept FROM v LEFT JOIN n ON n.x = vec_id LEFT JOIN label ON label.x = vec_id
"""

#: Pairs that share a shingle.
OP3 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_WORD}') AS w FROM documents),
sets AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda k: array_to_string(w[k:k + 3], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
one AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
pairs AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y FROM one a JOIN one b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
link AS MATERIALIZED (SELECT x, y FROM pairs), {_REACH}, n AS (SELECT x, count(*) AS n FROM link GROUP BY x)
SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(least, doc_id) AS component_id, coalesce(n, 0) AS n_links FROM sets LEFT JOIN n ON n.x = doc_id LEFT JOIN label ON label.x = doc_id
"""

#: Every 100-byte string of every text.
OP10 = """
WITH d AS MATERIALIZED (SELECT doc_id, encode(coalesce(text, '')) AS b, strlen(coalesce(text, '')) AS n FROM documents),
strings AS (SELECT doc_id, s, array_slice(b, s + 1, s + 100) AS t FROM (SELECT doc_id, b, unnest(range(n - 99)) AS s FROM d WHERE n >= 100)),
later AS MATERIALIZED (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY t ORDER BY doc_id, s) AS r FROM strings) WHERE r > 1),
marked AS (SELECT doc_id, s, coalesce(s > lag(s) OVER w + 100, true)::INT AS new FROM later WINDOW w AS (PARTITION BY doc_id ORDER BY s)),
runs AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM marked),
spans AS MATERIALIZED (SELECT doc_id, min(s) AS a, max(s) + 100 AS z FROM runs GROUP BY doc_id, run),
gaps AS (SELECT doc_id, coalesce(lag(z) OVER w, 0) AS a, a AS z FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY a) UNION ALL SELECT doc_id, max(z), any_value(n) FROM spans JOIN d USING (doc_id) GROUP BY doc_id),
kept AS (SELECT doc_id, unhex(string_agg(CASE WHEN gaps.z > gaps.a THEN hex(array_slice(b, gaps.a + 1, gaps.z)) ELSE '' END, '' ORDER BY gaps.a)) AS k FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(z - a)::BIGINT AS removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(k, b)) AS kept_sha256 FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def _rule_sql() -> str:
    """The longest fitting rule; the shortest verdicts are tried last."""
    cases = []
    for verdict, host, path in sorted(RULES, key=lambda r: -len(r[1] + r[2])):
        cases.append((f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')", host + path, verdict))
    rule = " ".join(f"WHEN {fits} THEN '{name}'" for fits, name, _ in cases)
    by_rule = " ".join(f"WHEN {fits} THEN '{verdict}'" for fits, _, verdict in cases)
    return f"CASE {rule} END AS rule, CASE {by_rule} END AS by_rule"


URL_RULES = rf"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)
SELECT page_id, host, path, {_rule_sql()} FROM p
"""

_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_DIGIT = "((d[i])::INT * (1 + (len(d) - i) % 2))"
_PASSES = {
    "email": "true",
    "ip": "len(list_filter(string_split(m, '.'), lambda p: len(ltrim(p, '0')) > 3 OR coalesce(try_cast(ltrim(p, '0') AS INT), 0) > 255)) = 0",
    "card": f"len(d) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, len(d) + 1), lambda i: {_DIGIT} - CASE WHEN {_DIGIT} > 9 THEN 9 ELSE 0 END)) % 10 = 0",
    "phone": "len(d) BETWEEN 8 AND 15",
}


def _kind_sql(k: int, kind: str) -> str:
    """Rows (doc_id, k, kind, start, stop) of one kind: every match, placed by the lengths of what stands before it."""
    pattern = _PATTERNS[kind].replace("'", "''")
    return f"""m{k} AS MATERIALIZED (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, regexp_split_to_array(t, '{pattern}') AS g FROM texts),
u{k} AS (SELECT doc_id, unnest(range(1, len(m) + 1)) AS i, m AS ms, g FROM m{k} WHERE len(m) > 0),
s{k} AS (SELECT doc_id, ms[i] AS m, regexp_replace(ms[i], '[^0-9]', '', 'g') AS d, (sum(len(g[i]) + len(ms[i])) OVER (PARTITION BY doc_id ORDER BY i) - len(ms[i]))::BIGINT AS start FROM u{k}),
r{k} AS (SELECT doc_id, {k} AS k, '{kind}' AS kind, start, start + len(m) AS stop FROM s{k} WHERE {_PASSES[kind]})"""


PII_BASE = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), {", ".join(_kind_sql(k, kind) for k, kind in enumerate(KINDS))},
spans AS ({" UNION ALL ".join(f"SELECT * FROM r{k}" for k in range(len(KINDS)))}),
sums AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in KINDS)}, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY k, start) AS joined FROM spans GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in KINDS)}, sha256(coalesce(joined, '')) AS base_sha256 FROM texts LEFT JOIN sums USING (doc_id)
"""

QUALITY_COUNTS = rf"""
WITH w AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
windows AS (SELECT doc_id, k, array_to_string(w[k:k + 7], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS k FROM w WHERE len(w) >= 8)),
twice AS (SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, x) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT spot) AS n FROM (SELECT doc_id, unnest(range(k, k + 8)) AS spot FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l FROM w),
c AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: len(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM w JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c
"""


def quote_links(conversations: str) -> str:
    """Links, reply order and own texts of a table's messages; ``conversations`` is the SQL of that table."""
    norm = lambda x: f"trim(regexp_replace(lower({x}), '\\s+', ' ', 'g'))"
    step = lambda t: f"chr((96 + len({t}::VARCHAR))::INT) || {t}"
    return rf"""
WITH RECURSIVE conversation AS MATERIALIZED ({conversations}),
split_ AS (SELECT conv_id, turn, unnest(range(1, len(l) + 1)) AS i, l FROM (SELECT conv_id, turn, string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10)) AS l FROM conversation)),
parsed AS MATERIALIZED (SELECT conv_id, turn, i, len(regexp_replace(m, '[^>]', '', 'g')) AS level, substr(line, len(m) + 1) AS body FROM (SELECT conv_id, turn, i, l[i] AS line, regexp_extract(l[i], '^[ \t]*(?:>[ \t]*)+') AS m FROM split_)),
kinds AS (SELECT *, CASE WHEN level = 0 AND trim(body) = '' THEN -1 ELSE level END AS kind FROM parsed),
starts AS (SELECT *, coalesce(kind <> lag(kind) OVER w, true)::INT AS new FROM kinds WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i)),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY conv_id, turn ORDER BY i) AS run FROM starts),
runs AS MATERIALIZED (SELECT conv_id, turn, kind AS level, {norm("string_agg(body, chr(10) ORDER BY i)")} AS body FROM numbered WHERE kind >= 0 GROUP BY conv_id, turn, run, kind),
own AS MATERIALIZED (SELECT conv_id, turn, trim(regexp_replace(coalesce(string_agg(body, chr(10) ORDER BY i) FILTER (level = 0), ''), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(13) || chr(10)) AS text, count(*) FILTER (level > 0) AS quoted_lines FROM parsed GROUP BY conv_id, turn),
items AS MATERIALIZED (SELECT DISTINCT * FROM (SELECT conv_id, turn, 0 AS level, 1 AS whole, {norm("text")} AS body FROM own UNION ALL SELECT conv_id, turn, level, 1, body FROM runs UNION ALL SELECT conv_id, turn, level, 0, {norm("body")} FROM parsed
  UNION ALL SELECT conv_id, turn, level, 0, unnest(string_split(regexp_replace(body, '([.!?])\s', '\1' || chr(1), 'g'), chr(1))) FROM runs) WHERE body <> ''),
quoted AS MATERIALIZED (SELECT * FROM items WHERE level > 0),
here AS MATERIALIZED (SELECT conv_id, body, min(turn) AS said FROM items WHERE level = 0 AND body IN (SELECT body FROM quoted) GROUP BY conv_id, body),
found AS (SELECT q.*, h.said, o.conv_id AS pc, o.said AS pt FROM quoted q LEFT JOIN here h ON h.conv_id = q.conv_id AND h.body = q.body AND h.said < q.turn LEFT JOIN here o ON o.body = q.body AND o.conv_id <> q.conv_id AND h.said IS NULL),
targets AS (SELECT conv_id, turn, (said IS NULL)::INT AS far, level, whole, len(body) AS size, coalesce(CASE WHEN said IS NOT NULL THEN conv_id END, pc) AS pc, coalesce(said, pt) AS pt FROM found WHERE said IS NOT NULL OR pc IS NOT NULL),
nearest_ AS (SELECT conv_id, turn, far, level, whole, size, min(pc) AS pc, arg_min(pt, pc) AS pt FROM targets GROUP BY ALL),
links AS MATERIALIZED (SELECT conv_id, turn, arg_min(pc, (far, level, -whole, -size, -pt, pc)) AS parent_conv, arg_min(pt, (far, level, -whole, -size, -pt, pc)) AS parent_turn FROM nearest_ GROUP BY conv_id, turn),
up AS (SELECT conv_id, turn, turn AS cur, 0 AS depth, {step("turn")} AS path FROM own UNION ALL SELECT up.conv_id, up.turn, l.parent_turn, up.depth + 1, {step("l.parent_turn")} || up.path FROM up JOIN links l ON l.conv_id = up.conv_id AND l.turn = up.cur AND l.parent_conv = l.conv_id),
roots AS (SELECT conv_id, turn, max(depth)::INT AS depth, arg_max(cur, depth) AS root_turn, arg_max(path, depth) AS reply_key FROM up GROUP BY conv_id, turn)
SELECT c.conv_id, c.turn, c.role, parent_conv, parent_turn, root_turn, depth, reply_key, quoted_lines::INT AS quoted_lines, own.text FROM conversation c JOIN own USING (conv_id, turn) JOIN roots USING (conv_id, turn) LEFT JOIN links USING (conv_id, turn)
"""


OP4 = quote_links("SELECT conv_id, turn, role, text FROM conversations")

#: The same messages, most of them with lines of one or two earlier ones as quotes.
ANSWERS = f"""
SELECT conv_id, turn, role, CASE WHEN turn % 4 = 1 AND p IS NOT NULL THEN '> ' || split_part(p, chr(10), 1) || chr(10) WHEN turn % 4 = 2 AND pp IS NOT NULL THEN '> > ' || split_part(pp, chr(10), 1) || chr(10) || '> ' || split_part(p, chr(10), 2) || chr(10)
  WHEN turn % 4 = 3 AND p IS NOT NULL THEN '>' || translate(split_part(pp, '. ', 1), '{LOWER}', '{UPPER}') || '.' || chr(10) || chr(10) ELSE '' END || coalesce(text, '') AS text
FROM (SELECT *, lag(text) OVER w AS p, lag(text, 2) OVER w AS pp FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
"""

"""DuckDB SQL for the queries that SQL can follow on whole tables.

Written apart from the operators, from the contracts: token counts, packing, vectors,
fingerprints and archives have no SQL form and are tested by brute force or round trips.
"""

from __future__ import annotations

from tidemark.llm.quality import BOILERPLATE, LineRules

_WORDS = r"regexp_extract_all(t, '[^\t\n\v\f\r ]+')"
_DOCS = "d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)"


# ---- secret scans ---------------------------------------------------------------------------
_KINDS = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]+", 0, 16),
    ("pem", "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 1),
    ("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
]
_found = "\nUNION ALL\n".join(f"""
SELECT doc_id, '{kind}' AS kind, {i} AS ord, list_transform(string_split_regex(t, '{p}'), lambda x: len(x)) AS gaps,
       list_transform(regexp_extract_all(t, '{p}'), lambda x: len(x)) AS whole,
       list_transform(regexp_extract_all(t, '{p}', {g}), lambda x: len(x)) AS part, {least} AS least
FROM d WHERE regexp_matches(t, '{p}')""" for i, (kind, p, g, least) in enumerate(_KINDS))
_show = "string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, ord)"

SECRETS = f"""
WITH {_DOCS}, f AS ({_found}),
k AS (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM f),
s AS (SELECT doc_id, kind, ord, CAST(list_sum(gaps[1:i]) + coalesce(list_sum(whole[1:i - 1]), 0) AS BIGINT) AS a,
             whole[i] AS n FROM k WHERE part[i] >= least),
e AS (SELECT *, a + n AS b FROM s),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
             count(*) FILTER (kind = 'hex') AS n_hex, {_show} FILTER (ord < 3) AS base, {_show} AS spans
      FROM e GROUP BY 1)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access,
       CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)"""

# ---- quality rules --------------------------------------------------------------------------
_r = LineRules()
_less = lambda s, cls: f"len({s}) - len(regexp_replace({s}, '{cls}', '', 'g'))"
_solid = lambda s: f"len(regexp_replace({s}, '[\\t\\n\\v\\f\\r ]+', '', 'g'))"
_line_words = r"len(regexp_extract_all(line, '[^\t\n\v\f\r ]+'))"
_phrases = ("(?:^|[^a-zß-ÿ])(?:" + "|".join(BOILERPLATE) + ")").replace("'", "''")

QUALITY = f"""
WITH {_DOCS}, w AS (SELECT doc_id, t, {_WORDS} AS ws FROM d),
v AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS win
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM v),
r AS (SELECT doc_id, count(DISTINCT i + k.j) AS n FROM c, range(8) k(j) WHERE c.n > 1 GROUP BY 1),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
f AS (SELECT doc_id, line, {_solid('line')} AS solid, {_less('line', '[!?#*$%&|<>~=_^]')} AS marks,
             {_less('line', '[|>»›→•]')} AS seps, {_line_words} AS nw FROM l),
j AS (SELECT *, nw > 0 AND ((marks >= 3 AND marks > {_r.max_punctuation} * solid)
             OR (seps >= {_r.min_separators} AND seps >= {_r.separator_share} * nw)
             OR (nw <= {_r.unfinished_words} AND NOT regexp_matches(line, '[.!?:;,"''”’»)\\]…。！？]\\s*$'))
             OR (nw <= {_r.boilerplate_words} AND regexp_matches(lower(line), '{_phrases}'))) AS fails FROM f),
q AS (SELECT doc_id, count(*) FILTER (nw > 0) - count(DISTINCT line) FILTER (nw > 0) AS n_dup_lines,
             count(*) FILTER (fails) AS n_gone, coalesce(sum(solid) FILTER (fails), 0) AS lost, sum(solid) AS solid
      FROM j GROUP BY 1),
a AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST({_solid('t')} AS BIGINT) AS word_chars,
             CAST({_less('t', '[#*$%&|<>]')} AS BIGINT) AS n_symbols, CAST(q.n_dup_lines AS BIGINT) AS n_dup_lines,
             CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, CAST(n_gone AS BIGINT) AS n_lines_removed,
             CASE WHEN n_gone > 0 THEN CAST(lost AS DOUBLE) / solid ELSE 0.0::DOUBLE END AS lost_share
      FROM w JOIN q USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND lost_share <= {_r.max_lost} AS kept
FROM a"""

# ---- chat formatting ------------------------------------------------------------------------
CHAT = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e AS (SELECT *, len(text) + 2 * len(text) - len(replace(text, '\', '')) - len(replace(text, '#', ''))
                + (len(text) - len(replace(text, '</', ''))) // 2 + len(replace(url_encode(role), '%20', '+')) + 14 AS chars FROM r)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars,
       CASE WHEN string_agg(role, ',' ORDER BY turn NULLS FIRST, role, text) IN ('user,assistant', 'system,user,assistant')
            THEN 'prompt_response' ELSE 'messages' END AS mapping
FROM e GROUP BY 1"""

# ---- substring dedup ------------------------------------------------------------------------
SUBSTRINGS = f"""
WITH {_DOCS}, w AS (SELECT doc_id, {_WORDS} AS ws FROM d),
v AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS win
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
s AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS lo FROM v),
c AS (SELECT doc_id, list(DISTINCT i + k.j) AS gone FROM s, range(50) k(j) WHERE lo < doc_id GROUP BY 1),
p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT doc_id, unnest(gone) AS i, TRUE AS x FROM c),
k AS (SELECT doc_id, count(*) FILTER (x) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (x IS NULL) AS kept
      FROM p LEFT JOIN g USING (doc_id, i) GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)"""

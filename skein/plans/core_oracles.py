"""SQL counterparts of the core queries, for DuckDB."""

from __future__ import annotations

# Fixed value: Unicode White_Space as a character class.
WHITE = r"[\t-\r \x{85}\p{Z}]"
NOT_WHITE = r"[^\t-\r \x{85}\p{Z}]"


def collapse(c: str) -> str:
    return f"trim(regexp_replace({c}, '{WHITE}+', ' ', 'g'), ' ')"


def cut_text(c: str, limit: int, kept: int, mark: str = "'…'") -> str:
    return f"CASE WHEN length({c}) > {limit} THEN left({c}, {kept}) || {mark} ELSE {c} END"


_FIELD = '(?:"(?:[^"]|"")*"|[^",]*)'
_GROUPS = ",".join(['("(?:[^"]|"")*"|[^",]*)'] * 6)
_UNQUOTED = lambda n: f"CASE WHEN f{n} LIKE '\"%' THEN replace(f{n}[2:-2], '\"\"', '\"') ELSE f{n} END"

_INT = "('BIGINT', 'UBIGINT', 'HUGEINT', 'UHUGEINT', 'NULL')"
# json_valid lets commas before a closing bracket and not-a-number words pass; strings are blanked before looking for them
_STRING = r'"(?:[^"\\]|\\.)*"'
_LENIENT = r",\s*[}\]]|(?i:nan|inf)|/[/*]"
def status(table: str = "records") -> str:
    """SQL for the status of every line of a table."""
    return rf"""
  SELECT source, path, line_no, raw, j, CASE
    WHEN raw IS NULL OR raw = '' THEN 'skipped'
    WHEN regexp_full_match(raw, '{WHITE}*') THEN CASE WHEN source = 'dsh' THEN 'skipped' ELSE 'malformed' END
    WHEN j IS NULL THEN 'malformed'
    WHEN json_type(j) = 'NULL' THEN 'skipped'
    WHEN json_type(j) <> 'OBJECT' THEN 'malformed'
    WHEN json_type(j, '$.type') NOT IN ('VARCHAR', 'NULL') THEN 'malformed'
    WHEN source IN ('claude', 'codex') AND json_type(j, '$.timestamp') NOT IN ('VARCHAR', 'NULL') THEN 'malformed'
    WHEN source = 'claude' AND json_type(j, '$.cwd') NOT IN ('VARCHAR', 'NULL') THEN 'malformed'
    WHEN source = 'dsh' AND (json_type(j, '$.seq') NOT IN {_INT} OR json_type(j, '$.time') NOT IN {_INT}) THEN 'malformed'
    ELSE 'record' END AS status
  FROM (SELECT *, CASE WHEN json_valid(raw) AND NOT regexp_matches(regexp_replace(raw, '{_STRING}', '""', 'g'), '{_LENIENT}') THEN raw END AS j FROM {table})"""

_ROWS = rf"""i AS (
  SELECT path, line_no, raw, regexp_full_match(raw, '{_FIELD}(?:,{_FIELD}){{5}}') AS six, {", ".join(f"regexp_extract(raw, '^{_GROUPS}$', {n}) AS f{n}" for n in range(1, 7))}
  FROM index_lines WHERE line_no IS NULL OR line_no > 1
), u AS (SELECT *, {", ".join(f"{_UNQUOTED(n)} AS u{n}" for n in range(1, 7))} FROM i),
x AS (SELECT *, raw IS NULL OR NOT six OR u1 NOT IN ('claude', 'codex', 'dsh') OR NOT regexp_full_match(u5, '[0-9]+')
  OR NOT regexp_full_match(u6, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}Z') OR try_cast(u6 AS TIMESTAMP) IS NULL AS bad FROM u)"""
_P1 = f"WITH s AS ({status()}), {_ROWS} SELECT path, line_no FROM s WHERE status = 'malformed' UNION SELECT path, line_no FROM x WHERE bad"
_INDEX = f"WITH {_ROWS} SELECT path AS index_path, line_no, u1 AS source, u2 AS id, u3 AS path, u4 AS cwd, u5::BIGINT AS bytes, try_cast(u6 AS TIMESTAMP) AS mod_time FROM x WHERE NOT bad"

_P7 = rf"""
WITH r AS (SELECT DISTINCT path, line_no, raw FROM ({status()}) WHERE status = 'record')
SELECT DISTINCT r.path, r.line_no, t.fullkey[3:] AS item
FROM r, json_tree(r.raw) AS t WHERE t.type = 'OBJECT' AND t.fullkey LIKE '%]'
"""

_SESSIONS = "(SELECT DISTINCT source, id, path, cwd, bytes, mod_time FROM sessions)"
_TURN = "(SELECT DISTINCT path, turn_idx, {} FROM turns)"
_CHARS = """(SELECT t.*, coalesce(c.chars, 0) AS chars FROM (SELECT * FROM transcripts QUALIFY row_number() OVER (PARTITION BY path ORDER BY source) = 1) t
  LEFT JOIN (SELECT path, sum(strlen(all_text)) AS chars FROM (SELECT DISTINCT path, turn_idx, role, all_text FROM turns) GROUP BY 1) c USING (path))"""
_TOTAL = "coalesce(usage.input, 0) + coalesce(usage.output, 0) + coalesce(usage.cache_read, 0) + coalesce(usage.cache_write, 0) + coalesce(usage.reasoning, 0)"
_SUMS = f"""count(*) AS sessions, sum(messages)::BIGINT AS messages, sum(tool_calls)::BIGINT AS tool_calls, sum(chars)::BIGINT AS chars,
  {", ".join(f"coalesce(sum(usage.{k}), 0)::BIGINT AS {k}" for k in ("input", "output", "cache_read", "cache_write", "reasoning"))},
  sum({_TOTAL})::BIGINT AS total_tokens, min(started) AS first, max(ended) AS last"""
_MODEL = "CASE WHEN coalesce(model, '') = '' THEN '(unknown)' ELSE model END"
ALL_TEXT = """array_to_string(list_transform(list_filter(blocks, lambda b: b.kind IN ('text', 'thinking', 'tool_use', 'tool_result')),
  lambda b: CASE WHEN b.kind = 'tool_use' THEN coalesce(b.name, '') || ' ' || coalesce(b.input, '') ELSE coalesce(b.text, '') END), chr(10))"""
_NEEDLE = "nightly build"
_NAMED = "(SELECT path, id, title FROM transcripts QUALIFY row_number() OVER (PARTITION BY path ORDER BY source) = 1)"
_SHORT = "left(regexp_replace(id, '^session-', ''), {})"

_WRONG = f"""CASE WHEN regexp_full_match(raw, '{WHITE}*') THEN 'blank_line' WHEN j IS NULL THEN 'syntax' WHEN json_type(j) <> 'OBJECT' THEN 'not_an_object' ELSE 'wrong_type:' ||
  list_filter(json_keys(j), lambda k: CASE k WHEN 'type' THEN json_type(j, '$.type') NOT IN ('VARCHAR', 'NULL') WHEN 'timestamp' THEN source IN ('claude', 'codex') AND json_type(j, '$.timestamp') NOT IN ('VARCHAR', 'NULL')
    WHEN 'cwd' THEN source = 'claude' AND json_type(j, '$.cwd') NOT IN ('VARCHAR', 'NULL') WHEN 'seq' THEN source = 'dsh' AND json_type(j, '$.seq') NOT IN {_INT} WHEN 'time' THEN source = 'dsh' AND json_type(j, '$.time') NOT IN {_INT} ELSE false END)[1] END"""
_PLACES = f"""(SELECT DISTINCT r.path, r.line_no, md5(r.raw) AS line, t.fullkey[3:] AS item FROM (SELECT DISTINCT path, line_no, raw FROM ({status()}) WHERE status = 'record') r, json_tree(r.raw) AS t WHERE t.type = 'OBJECT' AND t.fullkey LIKE '%]')"""
# a snippet is cut by bytes: in hexadecimal, where broken characters at the ends can be told
_HITS = f"""WITH h AS (SELECT DISTINCT source, path, turn_idx, role, ts, all_text, strlen(left(lower(all_text), instr(lower(all_text), '{_NEEDLE}') - 1)) AS hit, strlen(all_text) AS size FROM turns WHERE contains(lower(all_text), '{_NEEDLE}')),
  c AS (SELECT *, greatest(0, least(hit - 80, size)) AS a, least(hit + {len(_NEEDLE)} + 80, size) AS z FROM h),
  x AS (SELECT *, substring(hex(encode(all_text)), (2 * a + 1)::BIGINT, (2 * (z - a))::BIGINT) AS cut FROM c),
  l AS (SELECT *, regexp_extract(cut, '^(?:[89AB].){{0,3}}') AS head FROM x),
  m AS (SELECT *, substring(cut, length(head) + 1) AS rest, regexp_extract(substring(cut, length(head) + 1), '^(?:..)*?((?:[CD].|E.(?:[89AB].)?|F.(?:[89AB].){{0,2}})?)$', 1) AS tail FROM l),
  s AS (SELECT *, repeat('\ufffd', (length(head) // 2)::BIGINT) || decode(unhex(left(rest, length(rest) - length(tail)))) || CASE WHEN tail <> '' THEN '\ufffd' ELSE '' END AS body FROM m)
SELECT s.source, {_SHORT.format(8)} AS session, coalesce(title, '') AS title, role, coalesce(strftime(ts, '%Y-%m-%d %H:%M'), '-') AS time, turn_idx AS turn, CASE WHEN a > 0 THEN '…' ELSE '' END || {collapse("body")} || CASE WHEN z < size THEN '…' ELSE '' END AS snippet
FROM s LEFT JOIN {_NAMED} t USING (path)"""
_ROW = lambda label, value: f"'| {label} | ' || {value} || ' |' || chr(10)"
_IF = lambda c, row: f"CASE WHEN coalesce({c}, '') <> '' THEN {row} ELSE '' END"
_MINUTE = lambda c: f"coalesce(strftime({c}, '%Y-%m-%d %H:%M'), '-')"
_HEADERS = f"""SELECT path, '# ' || CASE WHEN coalesce(title, '') <> '' THEN title ELSE 'Agent session ' || {_SHORT.format(8)} END || chr(10) || chr(10) || '| | |' || chr(10) || '|---|---|' || chr(10)
  || {_ROW("Harness", "'`' || source || '`'")} || {_ROW("Session", "'`' || id || '`'")} || {_IF("cwd", _ROW("Directory", "'`' || cwd || '`'"))} || {_IF("model", _ROW("Model", "'`' || model || '`'"))}
  || {_ROW("Started", _MINUTE("started"))} || {_ROW("Ended", _MINUTE("ended"))} || {_ROW("Messages", "messages")} || {_ROW("Tool calls", "tool_calls")}
  || CASE WHEN {_TOTAL} > 0 THEN {_ROW("Tokens", "'in ' || usage.input || ' / out ' || usage.output || ' / cache-read ' || usage.cache_read")} ELSE '' END || chr(10) AS markdown
FROM transcripts QUALIFY row_number() OVER (PARTITION BY path ORDER BY source) = 1"""

ORACLES: dict[str, str] = {
    "p1_found": _P1,
    "p1_reasons": f"SELECT source, {_WRONG} AS reason, count(*) AS n FROM ({status()}) WHERE status = 'malformed' GROUP BY 1, 2",
    "p1_loaded": f"SELECT source, path, line_no, raw, j ->> '$.type' AS rtype FROM ({status()}) WHERE status = 'record'",
    "p1_index": _INDEX,
    "p7_links": f"SELECT DISTINCT o.path, o.line_no, o.item AS outer_item, i.item AS item FROM {_PLACES} o JOIN {_PLACES} i USING (path, line_no, line) WHERE starts_with(i.item, o.item || '.') OR starts_with(i.item, o.item || '[')",
    "resolve_exact": f"SELECT * FROM {_SESSIONS} WHERE id = (SELECT min(id) FROM sessions)",
    "newest_session": f"SELECT * FROM {_SESSIONS} ORDER BY mod_time DESC NULLS LAST, path LIMIT 1",
    "sessions_selected": f"SELECT * FROM {_SESSIONS} WHERE source IN ('dsh', 'claude')",
    "turn_counts": f"""SELECT path, count(*) FILTER (role IN ('user', 'assistant')) AS messages, sum(tool_calls)::BIGINT AS tool_calls, sum(strlen(all_text))::BIGINT AS chars FROM {_TURN.format("role, tool_calls, all_text")} GROUP BY 1""",
    "search": _HITS,
    "search_turns_only": f"SELECT * FROM ({_HITS}) WHERE role IN ('user', 'assistant')",
    "headers_markdown": _HEADERS,
    "turns_markdown_plain": r"""SELECT DISTINCT path, turn_idx, CASE role WHEN 'user' THEN '## User' WHEN 'assistant' THEN '## Assistant' WHEN 'tool' THEN '### Tool result' ELSE '## ' || role END || chr(10) || chr(10)
      || array_to_string(list_transform(blocks, lambda b: CASE b.kind
        WHEN 'text' THEN rtrim(coalesce(b.text, ''), chr(10)) || chr(10) || chr(10)
        WHEN 'tool_use' THEN '**Tool call: `' || coalesce(b.name, '') || '`**' || chr(10) || chr(10) || CASE WHEN coalesce(b.input, '') <> '' THEN '```json' || chr(10) || b.input || chr(10) || '```' || chr(10) || chr(10) ELSE '' END
        ELSE '' END), '') AS markdown FROM turns""",
    "p7_found": _P7,
    "malformed_count": f"SELECT path, count(*) FILTER (status = 'malformed') AS malformed FROM (SELECT DISTINCT path, line_no, status FROM ({status()})) GROUP BY 1",
    "ls_newest": f"SELECT source, id, '' AS title, cwd, bytes, strftime(mod_time, '%Y-%m-%dT%H:%M:%SZ') AS modified, path FROM {_SESSIONS} ORDER BY mod_time DESC NULLS LAST, path LIMIT 20",
    "ls_titles": f"SELECT s.source, s.id, coalesce(t.title, '') AS title, s.cwd, s.bytes, strftime(s.mod_time, '%Y-%m-%dT%H:%M:%SZ') AS modified, s.path FROM {_SESSIONS} s LEFT JOIN {_NAMED} t USING (path)",
    "sources_summary": f"SELECT source, count(*) AS sessions, max(mod_time) AS newest FROM {_SESSIONS} GROUP BY 1",
    "resolve_fragment": f"SELECT * FROM {_SESSIONS} WHERE contains(lower(id), 'tidepool') OR contains(lower(path), 'tidepool')",
    "stats_by_source": f"SELECT source AS key, {_SUMS} FROM {_CHARS} GROUP BY 1",
    "stats_by_model": f"SELECT {_MODEL} AS key, {_SUMS} FROM {_CHARS} GROUP BY 1",
    "stats_total_rollup": f"SELECT CASE WHEN grouping(source) = 1 THEN 'TOTAL' ELSE source END AS key, {_SUMS} FROM {_CHARS} GROUP BY ROLLUP (source)",
    "search_hits": f"SELECT DISTINCT path, turn_idx, role, strlen(left(lower(all_text), instr(lower(all_text), '{_NEEDLE}') - 1)) AS byte_index FROM turns WHERE contains(lower(all_text), '{_NEEDLE}')",
    "search_capped": f"""SELECT h.source, {_SHORT.format(8)} AS session, coalesce(title, '') AS title, role, coalesce(strftime(ts, '%Y-%m-%d %H:%M'), '-') AS time, turn_idx AS turn
      FROM (SELECT DISTINCT source, path, turn_idx, role, ts, all_text FROM turns WHERE contains(lower(all_text), '{_NEEDLE}')) h
      LEFT JOIN (SELECT path, max(mod_time) AS mod_time FROM sessions GROUP BY 1) s USING (path) LEFT JOIN {_NAMED} t USING (path)
      ORDER BY mod_time DESC NULLS LAST, path, turn_idx LIMIT 50""",
    "search_prefilter": f"SELECT DISTINCT path, turn_idx, role FROM turns WHERE path IN (SELECT path FROM records WHERE contains(lower(raw), '{_NEEDLE}'))",
    "session_titles": f"""SELECT path, {cut_text("t", 100, 99)} AS title FROM (SELECT path, {collapse("arg_min(text, (turn_idx, text))")} AS t FROM turns
      WHERE role = 'user' AND regexp_matches(text, '{NOT_WHITE}') GROUP BY 1)""",
    "turn_texts": f"""SELECT DISTINCT path, turn_idx, array_to_string(list_transform(list_filter(blocks, lambda b: b.kind = 'text' AND coalesce(regexp_matches(b.text, '{NOT_WHITE}'), false)), lambda b: b.text), chr(10)) AS text,
      {ALL_TEXT} AS all_text FROM turns""",
    "visible_blocks": """SELECT DISTINCT path, turn_idx, role, len(list_filter(blocks, lambda b: b.kind NOT IN ('thinking', 'tool_use', 'tool_result')))::INT AS plain, len(blocks)::INT AS "full" FROM turns""",
    "usage_totals": f"SELECT DISTINCT path, {_TOTAL} AS total FROM transcripts",
    "running_clock_turns": """SELECT path, turn_idx::BIGINT AS line_no, max(ts) OVER (PARTITION BY path ORDER BY turn_idx ROWS UNBOUNDED PRECEDING) AS clock
      FROM (SELECT path, turn_idx, max(ts) AS ts FROM turns GROUP BY 1, 2)""",
    "turn_ordinals": "SELECT path, turn_idx::BIGINT AS line_no, (row_number() OVER (PARTITION BY path ORDER BY turn_idx) - 1)::INT AS turn_idx FROM (SELECT DISTINCT path, turn_idx FROM turns)",
    "usual_model": f"""SELECT path, model FROM (SELECT path, model, count(*) AS n FROM {_TURN.format("model")} WHERE model <> '' GROUP BY 1, 2)
      QUALIFY row_number() OVER (PARTITION BY path ORDER BY n DESC, model) = 1""",
    "format_times": "SELECT DISTINCT path, turn_idx, coalesce(strftime(ts, '%Y-%m-%d %H:%M'), '-') AS time FROM turns",
    "turns_markdown": r"""SELECT DISTINCT path, turn_idx, CASE role WHEN 'user' THEN '## User' WHEN 'assistant' THEN '## Assistant' WHEN 'tool' THEN '### Tool result' ELSE '## ' || role END || chr(10) || chr(10)
      || array_to_string(list_transform(blocks, lambda b: CASE b.kind
        WHEN 'text' THEN rtrim(coalesce(b.text, ''), chr(10)) || chr(10) || chr(10)
        WHEN 'tool_use' THEN '**Tool call: `' || coalesce(b.name, '') || '`**' || chr(10) || chr(10) || CASE WHEN coalesce(b.input, '') <> '' THEN '```json' || chr(10) || b.input || chr(10) || '```' || chr(10) || chr(10) ELSE '' END
        WHEN 'thinking' THEN '<details><summary>reasoning</summary>' || chr(10) || chr(10) || rtrim(coalesce(b.text, ''), chr(10)) || chr(10) || chr(10) || '</details>' || chr(10) || chr(10)
        WHEN 'tool_result' THEN '<details><summary>tool result' || CASE WHEN b.is_error THEN ' (error)' ELSE '' END || '</summary>' || chr(10) || chr(10) || '```' || chr(10) || rtrim(coalesce(b.text, ''), chr(10)) || chr(10) || '```' || chr(10) || chr(10) || '</details>' || chr(10) || chr(10)
        ELSE '' END), '') AS markdown FROM turns""",
    "path_names": f"""SELECT DISTINCT path, CASE source WHEN 'claude' THEN CASE WHEN starts_with(split_part(path, '/', 3), '-') THEN replace(split_part(path, '/', 3), '-', '/') ELSE '' END
      WHEN 'dsh' THEN '/' || ltrim(replace(replace(trim(split_part(path, '/', 3), '-'), '~', '/'), '-', '/'), '/') ELSE '' END AS slug_cwd,
      CASE WHEN source = 'codex' THEN regexp_replace(regexp_replace(split_part(path, '/', -1), '\\.jsonl$', ''), '^rollout-(?:[^-]*-){{5}}', '') ELSE id END AS file_id,
      {_SHORT.format(8)} AS short8, {_SHORT.format(9)} AS short9 FROM sessions""".replace("\\\\", "\\"),
    "version_pick": """SELECT regexp_extract(path, '^(.*)/[^/]+$', 1) AS dir, path FROM (SELECT DISTINCT path FROM sessions WHERE source = 'dsh' AND bytes > 0)
      QUALIFY row_number() OVER (PARTITION BY regexp_extract(path, '^(.*)/[^/]+$', 1) ORDER BY CASE WHEN path LIKE '%/session.v3.jsonl.zstd' THEN 1 ELSE 2 END, path) = 1""",
    "text_cuts": f"""SELECT doc_id, c AS collapsed, {cut_text("c", 100, 99)} AS title, {cut_text("c", 200, 200)} AS summary, {cut_text("c", 60, 59)} AS short,
      {cut_text("text", 2000, 2000, "chr(10) || '… (truncated)'")} AS "long",
      regexp_replace(split_part(regexp_replace(text, '^{WHITE}+|{WHITE}+$', '', 'g'), chr(10), 1), '^{WHITE}+|{WHITE}+$', '', 'g') AS line FROM (SELECT doc_id, text, {collapse("text")} AS c FROM documents)""",
}

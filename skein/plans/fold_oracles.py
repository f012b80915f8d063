"""SQL counterparts of decoding and folding, for DuckDB: JSON functions and one CASE an element instead of a reader."""

from __future__ import annotations

from skein.plans.core_oracles import ALL_TEXT, NOT_WHITE, WHITE, collapse, cut_text, status

_INTS = ("BIGINT", "UBIGINT")


def _type(v: str, path: str, *kinds: str) -> str:
    """Missing, null or of one of the kinds."""
    return f"coalesce(json_type({v}, '{path}') IN ({', '.join(repr(k) for k in (*kinds, 'NULL'))}), true)"


def _fits(v: str, **wanted: tuple[str, ...] | str) -> str:
    return " AND ".join(_type(v, "$." + k.replace("__", "."), *([w] if isinstance(w, str) else w)) for k, w in wanted.items())


def _all(items: str, test: str) -> str:
    return f"len(list_filter({items}, lambda x: NOT (json_type(x) = 'NULL' OR json_type(x) = 'OBJECT' AND {test}))) = 0"


def _s(v: str, path: str) -> str:
    return f"CASE WHEN json_type({v}, '{path}') = 'VARCHAR' THEN {v} ->> '{path}' ELSE '' END"


def _i(v: str, path: str) -> str:
    return f"CASE WHEN json_type({v}, '{path}') IN ('BIGINT', 'UBIGINT') THEN ({v} ->> '{path}')::BIGINT ELSE 0 END"


def _items(v: str, path: str) -> str:
    return f"CASE WHEN json_type({v}, '{path}') = 'ARRAY' THEN json_extract({v}, '{path}[*]') ELSE [] END"


def _block(kind: str, text: str = "''", name: str = "''", given: str = "''", error: str = "false") -> str:
    return f"{{'kind': {kind}, 'text': {text}, 'name': {name}, 'input': {given}, 'is_error': {error}}}"


def _said(text: str) -> str:
    return f"regexp_matches({text}, '{NOT_WHITE}')"


def _sorted(j: str, depth: int = 3) -> str:
    """JSON text with the keys of objects sorted, as deep as the tables go."""
    if not depth:
        return f"{j}::VARCHAR"
    k, e = f"k{depth}", f"e{depth}"
    inner = f"""json_extract({j}, '$."' || {k} || '"')"""
    pairs = f"list_transform(list_sort(json_keys({j})), lambda {k}: to_json({k})::VARCHAR || ':' || list_transform([{inner}], lambda {e}: {_sorted(e, depth - 1)})[1])"
    items = f"list_transform(json_extract({j}, '$[*]'), lambda {e}: {_sorted(e, depth - 1)})"
    return f"CASE json_type({j}) WHEN 'OBJECT' THEN '{{' || array_to_string({pairs}, ',') || '}}' WHEN 'ARRAY' THEN '[' || array_to_string({items}, ',') || ']' ELSE {j}::VARCHAR END"


def _summary(j: str) -> str:
    flat = _sorted(j)
    plain = f"replace(replace(replace({flat}, '&', '\\u0026'), '<', '\\u003c'), '>', '\\u003e')"
    return f"coalesce({cut_text(collapse(plain), 200, 200)}, '')"


def _texts(items: str, kinds: dict[str, str]) -> str:
    named = "CASE " + " ".join(f"WHEN x ->> '$.type' = '{t}' THEN '{k}'" for t, k in kinds.items()) + " END"
    kept = f"list_filter({items}, lambda x: json_type(x, '$.type') = 'VARCHAR' AND (x ->> '$.type') IN ({', '.join(repr(t) for t in kinds)}) AND json_type(x, '$.text') = 'VARCHAR' AND {_said(_s('x', '$.text'))})"
    return f"list_transform({kept}, lambda x: {_block(named, _s('x', '$.text'))})"


def _turn(role: str, blocks: str, model: str = "''", calls: str = "0", titles: str = "false") -> str:
    return f"{{'role': {role}, 'model': {model}, 'calls': ({calls})::INT, 'blocks': {blocks}, 'titles': {titles}}}"


_PARTS = "parts"
_claude_ints = {f"usage__{k}": _INTS for k in ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")}
_codex_names = ("input_tokens", "output_tokens", "cached_input_tokens", "cache_write_input_tokens", "reasoning_output_tokens")
_codex_ints = {f"info__total_token_usage__{k}": _INTS for k in _codex_names}
_dsh_names = ("inputTokens", "outputTokens", "cacheReadTokens", "reasoningTokens")
_usage = lambda *parts: "[" + ", ".join(parts) + "]::BIGINT[]"
_none = "[]"
_text_fit = _fits("x", type="VARCHAR", text="VARCHAR")

_CLAUDE = f"""
  c1 AS (SELECT *, j -> '$.message' AS m, {_s("j", "$.type")} AS kind FROM v WHERE source = 'claude'),
  c2 AS (SELECT *, json_type(m) = 'OBJECT' AND {_fits("m", role="VARCHAR", model="VARCHAR", usage="OBJECT", **_claude_ints, usage__output_tokens_details="OBJECT", usage__output_tokens_details__thinking_tokens=_INTS)} AS ok,
    {_items("m", "$.content")} AS parts, {_s("m", "$.content")} AS plain FROM c1),
  c3 AS (SELECT *, CASE WHEN NOT coalesce(ok, false) OR kind NOT IN ('user', 'assistant') THEN [] WHEN {_said("plain")} THEN [{_block("'text'", "plain")}]
    WHEN {_all(_PARTS, _fits("x", type="VARCHAR", text="VARCHAR", thinking="VARCHAR", name="VARCHAR", is_error="BOOLEAN"))} THEN list_transform(
      list_filter(parts, lambda x: CASE {_s("x", "$.type")} WHEN 'text' THEN {_said(_s("x", "$.text"))} WHEN 'thinking' THEN {_said(_s("x", "$.thinking"))} WHEN 'tool_use' THEN true WHEN 'tool_result' THEN true ELSE false END),
      lambda x: CASE x ->> '$.type' WHEN 'text' THEN {_block("'text'", _s("x", "$.text"))} WHEN 'thinking' THEN {_block("'thinking'", _s("x", "$.thinking"))}
        WHEN 'tool_use' THEN {_block("'tool_use'", "''", _s("x", "$.name"), _summary("json_extract(x, '$.input')"))}
        ELSE {_block("'tool_result'", _summary("json_extract(x, '$.content')"), error="coalesce((x ->> '$.is_error')::BOOLEAN, false)")} END)
    ELSE [] END AS blocks FROM c2),
  claude AS (SELECT source, path, line_no, malformed, {_s("j", "$.timestamp")} AS time, 0::BIGINT AS millis, {_s("j", "$.cwd")} AS cwd, '' AS id, '' AS title, '' AS model,
    CASE WHEN kind = 'assistant' AND len(blocks) > 0 THEN {_usage(*(_i("m", f"$.usage.{k}") for k in ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens", "output_tokens_details.thinking_tokens")))} END AS usage,
    CASE WHEN len(blocks) = 0 THEN [] WHEN kind = 'user' THEN [{_turn("'user'", "blocks", titles="true")}] ELSE [{_turn("'assistant'", "blocks", _s("m", "$.model"), "len(list_filter(blocks, lambda b: b.kind = 'tool_use'))")}] END AS turns FROM c3)"""

_CODEX = f"""
  x1 AS (SELECT *, j -> '$.payload' AS p, {_s("j", "$.type")} AS record FROM v WHERE source = 'codex'),
  x2 AS (SELECT *, coalesce(json_type(p) = 'OBJECT' AND {_fits("p", type="VARCHAR", cwd="VARCHAR", id="VARCHAR", role="VARCHAR", name="VARCHAR", input="VARCHAR", content="ARRAY", info="OBJECT", info__total_token_usage="OBJECT", **_codex_ints)} AND {_all(_items("p", "$.content"), _text_fit)}, false) AS ok,
    {_s("p", "$.type")} AS kind, {_s("p", "$.role")} AS role, list_filter(list_transform({_items("p", "$.summary")}, lambda x: {_s("x", "$.text")}), lambda t: {_said("t")}) AS thoughts FROM x1),
  x3 AS (SELECT *, CASE WHEN NOT ok OR record <> 'response_item' THEN []
    WHEN kind = 'message' AND role IN ('user', 'assistant', 'system') THEN [{_turn("role", _texts(_items("p", "$.content"), {"input_text": "text", "output_text": "text", "text": "text"}), titles="role = 'user'")}]
    WHEN kind = 'reasoning' AND {_type("p", "$.summary", "ARRAY")} AND {_all(_items("p", "$.summary"), _fits("x", text="VARCHAR"))} AND len(thoughts) > 0 THEN [{_turn("'assistant'", "[" + _block("'thinking'", "array_to_string(thoughts, chr(10))") + "]")}]
    WHEN kind IN ('function_call', 'custom_tool_call') THEN [{_turn("'assistant'", "[" + _block("'tool_use'", "''", _s("p", "$.name"), _s("p", "$.input")) + "]", calls="1")}]
    WHEN kind IN ('function_call_output', 'custom_tool_call_output') THEN [{_turn("'tool'", "[" + _block("'tool_result'", _s("p", "$.input")) + "]")}] ELSE [] END AS turns FROM x2),
  codex AS (SELECT source, path, line_no, malformed, {_s("j", "$.timestamp")} AS time, 0::BIGINT AS millis, CASE WHEN ok AND record = 'session_meta' THEN {_s("p", "$.cwd")} ELSE '' END AS cwd, CASE WHEN ok AND record = 'session_meta' THEN {_s("p", "$.id")} ELSE '' END AS id, '' AS title, '' AS model,
    CASE WHEN ok AND record = 'event_msg' AND kind = 'token_count' AND json_type(p, '$.info') = 'OBJECT' THEN {_usage(*(_i("p", f"$.info.total_token_usage.{k}") for k in _codex_names))} END AS usage, list_filter(turns, lambda t: len(t.blocks) > 0) AS turns FROM x3)"""

_sum = lambda k: f"list_sum(list_transform(list_filter(stream, lambda x: {_s('x', '$.chunk.type')} = 'usage'), lambda x: {_i('x', f'$.chunk.usage.{k}')}))::BIGINT"
_nested = lambda path: f"len(list_filter({{}}, lambda z: NOT ({_all(_items('z', path), _text_fit)}))) = 0"
_DSH = f"""
  d1 AS (SELECT *, j -> '$.data' AS d, {_s("j", "$.type")} AS record FROM v WHERE source = 'dsh'),
  d2 AS (SELECT *, coalesce(json_type(d) = 'OBJECT', false) AS ok, {_items("d", "$.content")} AS own, {_items("d", "$.inserted")} AS inserted, {_items("d", "$.message.content")} AS said, {_items("d", "$.stream")} AS stream FROM d1),
  d3 AS (SELECT *, {_type("d", "$.content", "ARRAY")} AND {_all("own", _text_fit)} AS own_ok,
    {_type("d", "$.inserted", "ARRAY")} AND {_all("inserted", _fits("x", content="ARRAY"))} AND {_nested("$.content").format("inserted")} AS inserted_ok,
    {_fits("d", message="OBJECT", message__role="VARCHAR", message__content="ARRAY", usage="OBJECT", **{f"usage__{k}": _INTS for k in _dsh_names})} AND {_all("said", _text_fit)} AS said_ok,
    {_fits("d", message="OBJECT", message__content="ARRAY")} AND {_all("said", _fits("x", type="VARCHAR", content="ARRAY"))} AND {_nested("$.content").format("said")} AS result_ok,
    {_type("d", "$.stream", "ARRAY")} AND {_all("stream", _fits("x", chunk="OBJECT", chunk__type="VARCHAR", chunk__usage="OBJECT", chunk__usage__inputTokens=_INTS, chunk__usage__outputTokens=_INTS))} AS stream_ok,
    array_to_string(list_transform(flatten(list_transform(said, lambda z: list_filter({_items("z", "$.content")}, lambda x: {_s("x", "$.type")} = 'text'))), lambda x: {_s("x", "$.text")}), '') AS result FROM d2),
  d4 AS (SELECT *, CASE WHEN NOT ok THEN []
    WHEN record = 'user/message' AND own_ok THEN [{_turn("'user'", _texts("own", {"text": "text"}), titles="true")}]
    WHEN record IN ('user/message', 'agent/inbox/spliced') THEN CASE WHEN inserted_ok THEN list_transform(inserted, lambda z: {_turn("'user'", _texts(_items("z", "$.content"), {"text": "text"}))}) ELSE [] END
    WHEN record = 'assistant/message' AND said_ok THEN [{_turn("'assistant'", _texts("said", {"text": "text", "reasoning": "thinking"}))}]
    WHEN record = 'tool/call' AND {_fits("d", name="VARCHAR", arguments="VARCHAR")} THEN [{_turn("'assistant'", "[" + _block("'tool_use'", "''", _s("d", "$.name"), _s("d", "$.arguments")) + "]", calls="1")}]
    WHEN record = 'tool/result' AND result_ok AND result <> '' THEN [{_turn("'tool'", "[" + _block("'tool_result'", "result") + "]")}] ELSE [] END AS turns FROM d3),
  dsh AS (SELECT source, path, line_no, malformed, '' AS time, {_i("j", "$.time")} AS millis, CASE WHEN ok AND record = 'session' THEN {_s("d", "$.cwd")} ELSE '' END AS cwd, '' AS id, CASE WHEN ok AND record = 'session/title' THEN {_s("d", "$.title")} ELSE '' END AS title,
    CASE WHEN ok AND record = 'request/header' AND {_fits("d", header="OBJECT", header__config="OBJECT", header__config__provider="VARCHAR", header__config__model="VARCHAR")} THEN {_s("d", "$.header.config.model")} ELSE '' END AS model,
    CASE WHEN ok AND record = 'assistant/message' AND said_ok AND json_type(d, '$.usage') = 'OBJECT' THEN {_usage(_i("d", "$.usage.inputTokens"), _i("d", "$.usage.outputTokens"), _i("d", "$.usage.cacheReadTokens"), "0", _i("d", "$.usage.reasoningTokens"))}
      WHEN ok AND record = 'assistant/attempt' AND stream_ok THEN {_usage(f"coalesce({_sum(_dsh_names[0])}, 0)", f"coalesce({_sum(_dsh_names[1])}, 0)", "0", "0", "0")} END AS usage,
    list_filter(turns, lambda t: len(t.blocks) > 0) AS turns FROM d4)"""

_TIME = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:[.,]\d+)?(?:Z|[+-]\d\d:\d\d)$"
_MICROS = r"regexp_replace(replace(time, '','', ''.''), ''(\.\d{6})\d+'', ''\1'')".replace("''", "'")
_DECODED = f"""WITH one AS (SELECT source, path, line_no, min(raw) AS raw FROM records WHERE raw <> '' AND source IN ('claude', 'codex', 'dsh') GROUP BY ALL),
  v AS MATERIALIZED (SELECT source, path, line_no, status = 'malformed' AS malformed, CASE WHEN status = 'record' THEN raw::JSON END AS j FROM ({status("one")}) WHERE status <> 'skipped'),
  {_CLAUDE}, {_CODEX}, {_DSH},
  decoded AS MATERIALIZED (SELECT * EXCLUDE (time, millis), CASE WHEN source = 'dsh' THEN CASE WHEN millis > 0 AND millis < 253402300800000 THEN make_timestamp(millis * 1000) END
      WHEN regexp_matches(time, '{_TIME}') THEN try_cast({_MICROS} AS TIMESTAMPTZ) AT TIME ZONE 'UTC' END AS ts
    FROM (FROM claude UNION ALL BY NAME FROM codex UNION ALL BY NAME FROM dsh)),
  flat AS (SELECT source, path, line_no, max(ts) OVER (PARTITION BY path ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS ts, turns FROM decoded),
  each AS (SELECT source, path, line_no, ts, unnest(turns) AS t, generate_subscripts(turns, 1) AS pos FROM flat),
  folded AS (SELECT source, path, line_no, (row_number() OVER (PARTITION BY path ORDER BY line_no, pos) - 1)::INT AS turn_idx, t.role AS role, ts, t.model AS model, t.calls AS tool_calls, t.blocks AS blocks, t.titles AS titles,
    array_to_string(list_transform(list_filter(t.blocks, lambda b: b.kind = 'text' AND {_said("b.text")}), lambda b: b.text), chr(10)) AS text, {ALL_TEXT.replace("blocks", "t.blocks", 1)} AS all_text FROM each)"""

_trim = lambda c: f"regexp_replace({c}, '^{WHITE}+|{WHITE}+$', '', 'g')"
_FIRST = _trim(f"split_part({_trim('text')}, chr(10), 1)")
_last = lambda c: f"arg_max({c}, line_no) FILTER ({c} <> '')"
_NAMES = ("input", "output", "cache_read", "cache_write", "reasoning")

TURNS = f"""{_DECODED} SELECT source, path, line_no, turn_idx, role, ts, model, tool_calls, array_to_string(list_transform(blocks, lambda b: b.kind || CASE WHEN b.is_error THEN '!' ELSE '' END), ' ') AS block_kinds, text, all_text FROM folded"""
TRANSCRIPTS = f"""{_DECODED},
  lines AS (SELECT source, path, min(ts) AS started, max(ts) AS ended, count(*) FILTER (malformed) AS malformed, {_last("cwd")} AS own_cwd, {_last("id")} AS own_id, {_last("title")} AS given_title, {_last("model")} AS given_model,
    [{", ".join(f"coalesce(sum(usage[{k}]), 0)::BIGINT" for k in range(1, 6))}] AS summed, arg_max(usage, line_no) FILTER (usage IS NOT NULL) AS final FROM decoded GROUP BY 1, 2),
  said AS (SELECT path, count(*) FILTER (role IN ('user', 'assistant')) AS messages, sum(tool_calls)::BIGINT AS tool_calls, sum(strlen(all_text))::BIGINT AS chars,
    arg_min(text, turn_idx) FILTER (titles AND {_said("text")}) AS first_text, arg_min({_FIRST}, turn_idx) FILTER (role = 'user' AND {_FIRST} <> '') AS opening FROM folded GROUP BY 1),
  usual AS (SELECT path, model AS usual_model FROM (SELECT path, model, count(*) AS n FROM folded WHERE source = 'claude' AND model <> '' GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY path ORDER BY n DESC, model) = 1),
  files AS (SELECT path, max(id) AS file_id, max(cwd) AS file_cwd FROM sessions GROUP BY 1),
  t AS (SELECT *, coalesce(given_title, first_text, '') AS best, CASE WHEN source = 'codex' THEN coalesce(final, [0, 0, 0, 0, 0]) ELSE summed END AS u
    FROM lines LEFT JOIN said USING (path) LEFT JOIN usual USING (path) LEFT JOIN files USING (path)),
  named AS (SELECT *, {collapse(f"CASE WHEN {_said('best')} THEN best ELSE coalesce(opening, '') END")} AS c FROM t)
SELECT source, coalesce(own_id, file_id, '') AS id, coalesce(file_id, '') AS file_id, path, coalesce(own_cwd, file_cwd, '') AS cwd, {cut_text("c", 100, 99)} AS title, started, ended,
  CASE source WHEN 'claude' THEN coalesce(usual_model, '') WHEN 'dsh' THEN coalesce(given_model, '') ELSE '' END AS model, malformed, coalesce(messages, 0) AS messages, coalesce(tool_calls, 0) AS tool_calls, coalesce(chars, 0) AS chars,
  {", ".join(f"u[{k}] AS {n}" for k, n in enumerate(_NAMES, 1))} FROM named"""

DECODED = f"""{_DECODED} SELECT source, path, line_no, malformed, ts, nullif(cwd, '') AS cwd, nullif(id, '') AS id, nullif(title, '') AS title, nullif(model, '') AS model, {", ".join(f"coalesce(usage[{k}], -1) AS {n}" for k, n in enumerate(_NAMES, 1))}, len(turns)::INT AS turns FROM decoded"""
ORACLES = {"fold_records_turns": TURNS, "fold_records_transcripts": TRANSCRIPTS, "decoded_records": DECODED}

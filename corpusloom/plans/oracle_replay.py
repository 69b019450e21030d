"""SQL for the queries of replay.py."""

from __future__ import annotations

from ..functions.tables import TOKENS_PER_WORD
from ..streaming.watch import LEAST_BYTES, WAYS_BACK
from .oracle import RUNS, _csv, _detect, _estimate, _fold, _header, _notes, trim


def _handled(name: str, table: str) -> str:
    """CTEs <name>_w (id, text, label, wanted, output, tokens) of table (id, text), whose texts are CSV or plain."""
    rate = TOKENS_PER_WORD["csv"]
    csv = f"(SELECT * FROM {name}_found WHERE label = 'csv')"
    return f"""
{name}_filled AS (SELECT * FROM {table} WHERE {trim('text')} <> ''),
{name}_found AS MATERIALIZED (SELECT id, label, text FROM {name}_filled JOIN ({_detect(name + '_filled', 'id', 'text')}) USING (id)),
{name}_done AS MATERIALIZED (SELECT * FROM ({_csv(False, csv, 'id')})),
{name}_head AS (SELECT * FROM ({_header(name + '_done', 'id', 'cleaned', 'csv', _notes()['csv'])})),
{name}_n AS (SELECT id, header || chr(10) || cleaned AS output, {_estimate('text', rate)} AS original_tokens, {_estimate('cleaned', rate)} AS cleaned_tokens FROM {name}_found JOIN {name}_done USING (id) JOIN {name}_head USING (id)),
{name}_w AS (SELECT t.id, t.text, f.label, n.output, n.original_tokens, n.cleaned_tokens, coalesce(f.label = 'csv' AND strlen(t.text) >= {LEAST_BYTES} AND n.original_tokens > n.cleaned_tokens, false) AS wanted
   FROM {table} t LEFT JOIN {name}_found f USING (id) LEFT JOIN {name}_n n USING (id))"""


def _replayed() -> str:
    """Table r: a row for each text of each session in order, with the state after it."""
    return f"""
WITH RECURSIVE turns AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN coalesce(text, '') ELSE 'turn,place,size' || chr(10) || array_to_string(
  list_transform(regexp_extract_all(coalesce(text, ''), '[^ \\n]+'), lambda w, i: turn || ',' || i || ',' || length(w)), chr(10)) END AS text FROM conversations),
given AS (SELECT conv_id || '/' || turn AS id, text FROM turns), {_handled('g', 'given')},
pasted AS (SELECT id, output AS text FROM g_w WHERE label = 'csv'), {_handled('o', 'pasted')},
e AS (SELECT conv_id, turn * 4 + k AS seq, g_w.* FROM turns, (VALUES (0), (1)) AS v(k), g_w WHERE g_w.id = conv_id || '/' || turn
  UNION ALL SELECT conv_id, turn * 4 + 2, g_w.* FROM turns JOIN g_w ON g_w.id = conv_id || '/' || (turn - 1)
  UNION ALL SELECT conv_id, turn * 4 + 3, o_w.* FROM turns JOIN o_w ON o_w.id = conv_id || '/' || (turn - 1)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY seq) AS n, md5(text) AS text_md5, md5(output) AS output_md5 FROM e),
r AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS own, CAST(NULL AS VARCHAR) AS made, true AS same, CAST(-1 AS BIGINT) AS seq FROM o
  UNION ALL SELECT conv_id, n, CASE WHEN same THEN own ELSE text_md5 END, CASE WHEN same THEN made WHEN wanted THEN output_md5 ELSE text_md5 END, same, seq
  FROM (SELECT o.*, r.own, r.made, coalesce(text_md5 IN (r.own, r.made), false) AS same FROM r JOIN o ON o.conv_id = r.conv_id AND o.n = r.n + 1)),
written AS (SELECT CAST(o.conv_id AS VARCHAR) AS session, o.seq, label, output_md5, original_tokens, cleaned_tokens, original_tokens - cleaned_tokens AS saved,
  count(*) OVER w AS runs, CAST(sum(original_tokens - cleaned_tokens) OVER w AS BIGINT) AS total_saved
  FROM r JOIN o ON o.conv_id = r.conv_id AND o.n = r.n WHERE NOT same AND wanted WINDOW w AS (PARTITION BY o.conv_id ORDER BY o.seq))"""


_EVENT_LOG = """a AS (SELECT 0 AS doc, event_id AS i, '2024-01-01T00:00:00Z ' || CASE WHEN event_id % 1000 < 300 THEN 'INFO' WHEN event_id % 7 = 0 THEN 'ERROR' WHEN event_id % 5 = 0 THEN 'WARN' ELSE 'INFO' END
  || ' ' || CASE WHEN event_id % 1000 < 300 THEN 'beat' ELSE event_type END || ' id=1' || (event_id + 1000) AS line FROM events)"""
_LOG_KEY = "regexp_replace(regexp_replace(line, '\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}Z', 'TS'), '\\b\\d{4,}\\b', 'NUM', 'g')"


def _one_log() -> str:
    note = "'  [... ' || (size - 2) || ' identical lines suppressed]'"
    return f"WITH {_EVENT_LOG}, {_fold('doc', f'SELECT doc, i, line, {_LOG_KEY} AS k FROM a', 'k', 2, note)} SELECT i, line FROM v"


def _one_plain() -> str:
    """Blank lines: two of a run stay, and none at the ends."""
    note = "'  [... ' || (size - 2) || ' identical lines]'"
    return f"""
WITH {_EVENT_LOG}, e AS (SELECT doc, i, CASE WHEN i % 11 < 4 THEN '' WHEN i % 1000 < 300 THEN 'beat' ELSE string_split(line, ' ')[3] END AS line FROM a),
g0 AS (SELECT *, lag(line, 1) OVER w AS l1, lag(line, 2) OVER w AS l2 FROM e WINDOW w AS (ORDER BY i)),
g AS (SELECT doc, i, line FROM g0 WHERE NOT (line = '' AND l1 IS NOT NULL AND l1 = '' AND l2 IS NOT NULL AND l2 = '')),
{_fold('doc', 'SELECT doc, i, line, line AS k FROM g', 'k', 2, note)}
SELECT i, line FROM v WHERE i BETWEEN (SELECT min(i) FROM v WHERE line <> '') AND (SELECT max(i) FROM v WHERE line <> '')"""


ORACLE_SQL = {
    "transcripts_conversations": """
WITH u AS (SELECT 'p' || conv_id % 7 AS project, CASE WHEN turn % 4 = 2 THEN coalesce(text, '') || chr(10) || coalesce(text, '') ELSE text END AS text FROM conversations WHERE role = 'user' AND conv_id % 7 IN (1, 2, 4, 5))
SELECT project, md5(text) AS text_md5, CAST(strlen(text) AS BIGINT) AS bytes FROM u WHERE text <> ''""",
    "ledger_exactly_once": RUNS + "SELECT run_id, ts, content_type, original_tokens, cleaned_tokens, round(savings_pct, 6) AS savings_pct FROM runs",
    "clean_log_one_text": _one_log(), "clean_plain_one_text": _one_plain(),
    "watch_conversations": _replayed() + "\nSELECT * FROM written",
    "watch_state": _replayed()
    + f""",
last AS (SELECT session, string_agg(seq, ',' ORDER BY seq) AS undo FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq DESC) AS k FROM written) WHERE k <= {WAYS_BACK} GROUP BY session)
SELECT t.session, coalesce(w.runs, 0) AS runs, CAST(coalesce(w.saved, 0) AS BIGINT) AS saved, t.last_seq, coalesce(undo, '') AS undo
FROM (SELECT CAST(conv_id AS VARCHAR) AS session, max(seq) AS last_seq FROM r WHERE NOT same GROUP BY conv_id) t
LEFT JOIN (SELECT session, count(*) AS runs, sum(saved) AS saved FROM written GROUP BY session) w USING (session) LEFT JOIN last USING (session)
""",
}

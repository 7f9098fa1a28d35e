"""The same results in DuckDB SQL, straight from the given tables.

The statements share common table expressions. They follow the definitions naively (one
ordered recursion per bucket or rule, self-joins, one window per file), so they check the
distributed operators by a different route.
"""

from __future__ import annotations

from checks.blake_sql import blake2b
from faultline.functions.scoring import HINT_WORDS, SEVERITIES, VERDICTS
from faultline.rules import RULE_LIBRARY
from faultline.schemas import FINDING_FIELDS


def _quote(text: object) -> str:
    return "NULL" if text is None else "'" + str(text).replace("'", "''") + "'"


# Log lines


def _lines(name: str, file: str) -> str:
    return f"""
{name}_base AS (
  SELECT *, {file} AS file,
    CASE user_id % 4 WHEN 3 THEN 0 WHEN 2 THEN 1000000000 - ms ELSE ms END AS clock FROM (
    SELECT *, CAST(floor(epoch_us(ts) / 10000000) AS BIGINT) - 170406720 AS ms FROM events)),
{name} AS (
  SELECT file, row_number() OVER (PARTITION BY file ORDER BY ms, event_id) AS line_no, CASE
    WHEN event_id % 23 = 0 THEN concat('debug dump ', event_id)
    WHEN event_id % 19 = 0 THEN
      concat('  continued at 0x', lpad(CAST(event_id % 100 AS VARCHAR), 2, '0'))
    ELSE concat('[', clock // 1000, '.', lpad(CAST(clock % 1000 AS VARCHAR), 3, '0'),
      '] [t', user_id % 8, '] [', upper(event_type), '] ',
      CASE
        WHEN event_id % 29 = 0 THEN (['check_for_bad_handle: timer 0x1a is already free',
          'Log Type: DIAGNOSTIC Error Msg: assert 7',
          'ASSOC_RESP: Association Failed with status code = 17',
          'WIFI_SET_BACKGROUND_SCAN_CNF with result failure',
          'kernel panic after RNDIS hardReset'])[event_id // 29 % 5 + 1]
        WHEN event_type = 'purchase' AND event_id % 4 < 3 THEN
          concat('SDPQueueManager: classic queue full, ', user_id, ' waiting')
        WHEN event_type = 'error' AND event_id % 7 = 0 THEN
          concat('Deauthenticated (reason 0x0', substr('1237f', CAST(event_id % 5 AS INT) + 1, 1), ')')
        WHEN event_type = 'error' THEN 'Trace |SSPLogger |Error: dump'
        WHEN event_type = 'click' AND event_id % 5 = 0 THEN
          concat('kernel panic at 10.0.0.', event_id % 50)
        WHEN event_type = 'view' THEN
          concat('Warning: scan timeout after ', event_id % 300, ' ms on wlan', event_id % 3)
        ELSE concat('Level6: user ', user_id, ' ', event_type, ' ok') END) END AS value
  FROM {name}_base)"""


LOG = _lines("log", "concat('f', user_id % 4, '.log')")
DAILY = _lines("log", "concat('f', user_id % 4, '-', ms // 8640, '.log')")

PS = r"'^\[(\d+\.\d+)\]\s+\[([^\]]+)\]\s+\[([^\]]+)\]\s+(.+)$'"


def _elapsed(seconds: str) -> str:
    return f"CAST(trunc(CAST({seconds} AS DOUBLE) * 1000) AS BIGINT)"


PS_LINES = rf"""
ps AS (
  SELECT file, line_no, value,
    {_elapsed(f"regexp_extract(value, {PS}, 1)")} AS elapsed_ms,
    trim(regexp_extract(value, {PS}, 3)) AS component,
    trim(regexp_extract(value, {PS}, 4)) AS text
  FROM log WHERE regexp_matches(value, {PS})),
leveled AS (
  SELECT *, coalesce(nullif(
    regexp_extract(text, '^(Level\d+|Version|Warning|Error|Debug)\s*:', 1), ''), 'Unknown') AS level
  FROM ps)"""

META = rf"""
meta AS (
  SELECT file, line_no, value, ts AS timestamp,
    CASE WHEN ts = '' THEN 0 ELSE {_elapsed("nullif(ts, '')")} END AS elapsed_ms,
    coalesce(tags[3], tags[2], '') AS component
  FROM (
    SELECT *, regexp_extract(value, '^\s*\[(\d+\.\d+)\]', 1) AS ts,
      regexp_extract_all(value[1:200], '\[([^\[\]]+)\]', 1) AS tags
    FROM log))"""

ENTRIES = PS_LINES + r""",
anchored AS (
  SELECT log.file, log.line_no, log.value, last_value(ps.line_no IGNORE NULLS) OVER (
    PARTITION BY log.file ORDER BY log.line_no ROWS UNBOUNDED PRECEDING) AS anchor
  FROM log LEFT JOIN ps USING (file, line_no)),
tails AS (
  SELECT file, anchor AS line_no,
    string_agg(trim(value, ' ' || chr(9)), chr(10) ORDER BY line_no) AS tail
  FROM anchored
  WHERE anchor < line_no AND (starts_with(value, ' ') OR starts_with(value, chr(9)))
  GROUP BY ALL),
entries AS (
  SELECT file, line_no, elapsed_ms, component, level,
    CASE WHEN tail IS NULL THEN text ELSE concat(text, chr(10), tail) END AS message
  FROM leveled LEFT JOIN tails USING (file, line_no))"""

# Rules

_RULE_ROWS = ",\n  ".join(
    "(" + ", ".join([
        str(i), *map(_quote, (r.name, r.category, r.severity, r.pattern, r.exclude_pattern)),
        _quote(r.description),
        "NULL" if r.burst_min is None else str(r.burst_min),
        "NULL" if r.burst_window_s is None else str(int(r.burst_window_s * 1000)),
        str(r.context_before), str(r.context_after),
    ]) + ")"
    for i, r in enumerate(RULE_LIBRARY)
)

HITS = f"""
rules(rule_ord, name, category, severity, pattern, exclude, description, burst_min, window_ms,
      before, after) AS (VALUES
  {_RULE_ROWS}),
hits AS (
  SELECT file, line_no, value, elapsed_ms, CAST(rule_ord AS BIGINT) AS rule_ord
  FROM ps, rules
  WHERE regexp_matches(value, concat('(?i)', pattern))
    AND (exclude IS NULL OR NOT regexp_matches(value, concat('(?i)', exclude))))"""

CLUSTERS = """
burst_hits AS (
  SELECT file, h.rule_ord, line_no, elapsed_ms AS ms, window_ms, burst_min,
    row_number() OVER w AS k, lag(line_no) OVER w AS line_before
  FROM hits h JOIN rules r ON h.rule_ord = r.rule_ord AND burst_min IS NOT NULL
  WINDOW w AS (PARTITION BY file, h.rule_ord ORDER BY line_no)),
chain AS (
  SELECT file, rule_ord, k, line_no, line_no AS anchor, ms AS anchor_ms, burst_min
  FROM burst_hits WHERE k = 1
  UNION ALL
  SELECT file, rule_ord, k, line_no, CASE WHEN breaks THEN line_no ELSE anchor END,
    CASE WHEN breaks THEN ms ELSE anchor_ms END, burst_min
  FROM (
    SELECT h.*, c.anchor, c.anchor_ms, CASE WHEN c.anchor_ms = 0 AND h.ms = 0
      THEN h.line_no - h.line_before > 50 ELSE h.ms - c.anchor_ms > h.window_ms END AS breaks
    FROM chain c JOIN burst_hits h
      ON h.file = c.file AND h.rule_ord = c.rule_ord AND h.k = c.k + 1)),
clusters AS (
  SELECT file, rule_ord, anchor AS line_no, count(*) AS size,
    string_agg(CAST(line_no AS VARCHAR), chr(10) ORDER BY line_no) AS lines
  FROM chain GROUP BY file, rule_ord, anchor, burst_min HAVING count(*) >= burst_min)"""

RULE_RANK = "CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END"

TRIGGERS = META + f""",
triggers AS (
  SELECT h.file, h.rule_ord AS source_ord, name AS rule_name, category, severity, description,
    h.line_no AS line_number, m.timestamp, m.elapsed_ms, m.component, h.value AS trigger_line,
    coalesce(lines, '') AS burst_line_numbers, coalesce(size, 1) AS burst_size,
    false AS rare_template, before, after
  FROM hits h JOIN rules USING (rule_ord) JOIN meta m USING (file, line_no)
    LEFT JOIN clusters c USING (file, rule_ord, line_no)
  WHERE burst_min IS NULL OR size IS NOT NULL)"""

CONTEXT = """
context AS (
  SELECT t.file, source_ord, line_number,
    string_agg(value, chr(10) ORDER BY line_no) FILTER (line_no < line_number) AS context_before,
    string_agg(value, chr(10) ORDER BY line_no) FILTER (line_no > line_number) AS context_after,
    list(value ORDER BY line_no) FILTER (line_no < line_number) AS list_before,
    list(value ORDER BY line_no) FILTER (line_no > line_number) AS list_after
  FROM triggers t JOIN log l
    ON l.file = t.file AND line_no BETWEEN line_number - before AND line_number + after
  GROUP BY ALL)"""

SCORE = f"""least(1.0, {RULE_RANK} / 4.0 + least(0.15, (burst_size - 1) * 0.02)
    + CASE WHEN rare_template THEN 0.05 ELSE 0 END)"""


def _ranked(source: str) -> str:
    return f"""
scored AS (SELECT *, CAST({SCORE} AS DOUBLE) AS score, {RULE_RANK} AS severity_rank FROM {source}),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY file
    ORDER BY round(score, 6) DESC, severity_rank DESC, line_number, source_ord) AS rank
  FROM scored)"""


def _verdicts(findings: str) -> str:
    counts = ",\n    ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in SEVERITIES)
    zeros = ", ".join(f"coalesce({s}, 0) AS {s}" for s in SEVERITIES)
    return f"""
counts AS (
  SELECT file, count(*) AS findings,
    {counts}
  FROM {findings} GROUP BY file),
verdicts AS (
  SELECT file, CASE WHEN CRITICAL + HIGH > 0 THEN 'ANOMALOUS' WHEN findings > 0 THEN 'SUSPICIOUS'
      ELSE 'NORMAL' END AS verdict, coalesce(findings, 0) AS findings, {zeros}
  FROM (SELECT DISTINCT file FROM log) LEFT JOIN counts USING (file))"""


TALLIES = ", ".join(f"count(*) FILTER (verdict = '{v}') AS {v}" for v in VERDICTS)

# Masking. DuckDB's word boundary is ASCII-only, so letters beyond ASCII are put between two
# ASCII letters (which occur in no dynamic value) while the pattern is applied.

SPACES = (
    r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
    r"\x{202f}\x{205f}\x{3000}]"
)
DYNAMIC = (
    r"(?:[0-9a-fA-F]{2}:){5}[0-9a-fA-F]{2}|(?:\p{Nd}{1,3}\.){3}\p{Nd}{1,3}"
    r"|\b0x[0-9a-fA-F]+\b|\b\p{Nd}+(?:\.\p{Nd}+)?\b"
)
WRAP, UNWRAP = "jqxw", "vkqy"


def _masking(source: str, keys: str) -> str:
    return rf"""
wrapped AS (
  SELECT {keys}, regexp_replace(message, '([^\x00-\x7F])', '{WRAP}\1{UNWRAP}', 'g') AS w
  FROM {source}),
marked AS (
  SELECT {keys}, w, regexp_replace(regexp_replace(w, '{WRAP}([^\pL\pN])', '\1', 'g'),
      '([^\pL\pN]){UNWRAP}', '\1', 'g') AS bounded
  FROM wrapped),
masked AS (
  SELECT {keys}, list_filter(regexp_split_to_array(
      replace(replace(regexp_replace(bounded, '{DYNAMIC}', '<*>', 'g'), '{WRAP}', ''), '{UNWRAP}', ''),
      '{SPACES}+'), lambda t: t <> '') AS toks,
    array_to_string(regexp_extract_all(bounded, '{DYNAMIC}'), chr(10)) AS params
  FROM marked),
tokens AS (
  SELECT {keys}, array_to_string(toks, ' ') AS masked, CAST(len(toks) AS BIGINT) AS n,
    coalesce(toks[1], '<empty>') AS prefix, params, toks
  FROM masked)"""


DOCS = """
docs AS (
  SELECT doc_id, unnest(range(1, len(parts) + 1)) AS line_no, unnest(parts) AS message
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))"""

# Template mining: one recursion per bucket over its distinct texts, in order.


def _mining(source: str, condition: str = "true") -> str:
    """``source`` has masked, n, prefix, toks and pos."""
    return f"""
texts AS (
  SELECT masked, n, prefix, any_value(toks) AS toks, min(pos) AS pos
  FROM {source} WHERE {condition} GROUP BY masked, n, prefix),
queue AS (
  SELECT *, row_number() OVER (PARTITION BY n, prefix ORDER BY pos) AS k FROM texts),
fold AS (
  SELECT n, prefix, k, [{{'pos': pos, 't': toks}}] AS groups FROM queue WHERE k = 1
  UNION ALL
  SELECT n, prefix, k, CASE
      WHEN n = 0 THEN groups
      WHEN list_max(sims) >= 0.5 * n THEN list_transform(groups, lambda g, i: CASE
        WHEN i = list_position(sims, list_max(sims)) THEN {{'pos': g.pos, 't': list_transform(
          list_zip(g.t, toks), lambda z: CASE WHEN z[1] = z[2] THEN z[1] ELSE '<*>' END)}}
        ELSE g END)
      WHEN len(groups) < 128 THEN list_append(groups, {{'pos': pos, 't': toks}})
      ELSE list_append(groups, {{'pos': pos, 't': list_transform(toks, lambda t: '<*>')}}) END
  FROM (
    SELECT q.*, f.groups, list_transform(f.groups, lambda g: len(list_filter(
      list_zip(g.t, q.toks), lambda z: z[1] = '<*>' OR z[1] = z[2]))) AS sims
    FROM fold f JOIN queue q ON q.n = f.n AND q.prefix = f.prefix AND q.k = f.k + 1)),
mined AS (
  SELECT n, prefix, unnest(groups) AS g FROM fold
  QUALIFY k = max(k) OVER (PARTITION BY n, prefix)),
templates AS (
  SELECT format('E{{:04d}}', ord) AS event_id, * FROM (
    SELECT n, prefix, g.t AS t, array_to_string(g.t, ' ') AS template,
      row_number() OVER (ORDER BY g.pos) - 1 AS ord
    FROM mined))"""


def _matching(source: str) -> str:
    """Best template of every distinct text in ``source``; null below the threshold."""
    return f"""
asked AS (SELECT masked, n, prefix, any_value(toks) AS toks FROM {source} GROUP BY ALL),
compared AS (
  SELECT masked, event_id, template, t, ord, CASE WHEN a.n = 0 THEN 1 ELSE len(list_filter(
    list_zip(t, toks), lambda z: z[1] = '<*>' OR z[1] = z[2])) / a.n END AS sim
  FROM asked a JOIN templates p USING (n, prefix)),
best AS (
  SELECT * FROM compared WHERE sim >= 0.5
  QUALIFY row_number() OVER (PARTITION BY masked ORDER BY sim DESC, ord) = 1),
matched AS (
  SELECT masked, toks, event_id, template, t, sim FROM asked LEFT JOIN best USING (masked))"""


def _log_masked(pos: str, more: str = "") -> str:
    return rf"""{_masking("entries", "file, line_no, elapsed_ms, component, level, message")},
positioned AS (
  SELECT *, {pos} AS pos, day = 0 AND component <> 'VIEW' AS normal{more}
  FROM (
    SELECT *, CAST(regexp_extract(file, '^f(\d+)-(\d+)', 1) AS BIGINT) AS device,
      CAST(regexp_extract(file, '^f(\d+)-(\d+)', 2) AS BIGINT) AS day
    FROM tokens))"""


LOG_MASKED = _log_masked("(device * 1000 + day) * 1000000000 + line_no")

DOC_MASKED = f"""{_masking("docs", "doc_id, line_no")},
positioned AS (
  SELECT t.*, (doc_id << 32) + line_no AS pos, coalesce(quality = 1, false) AS normal
  FROM tokens t LEFT JOIN labels USING (doc_id))"""

TEMPLATE_ROWS = """
SELECT event_id, t.n, t.prefix, t.template, ord, coalesce(n_lines, 0) AS n_lines
FROM templates t LEFT JOIN (
  SELECT event_id, count(*) AS n_lines FROM positioned JOIN matched USING (masked) GROUP BY event_id)
  USING (event_id)"""

HINT = "'(?i)\\b(" + "|".join(HINT_WORDS) + ")\\b'"



def _rare(normal: str, answers: str) -> str:
    return f"""
normal_ids AS (
  SELECT DISTINCT event_id FROM positioned JOIN matched USING (masked)
  WHERE {normal} AND event_id IS NOT NULL),
first_seen AS (
  SELECT file, event_id, template, line_no, elapsed_ms, component, message
  FROM positioned JOIN {answers} USING (masked)
  WHERE event_id IS NOT NULL AND regexp_matches(concat(template, ' ', message), {HINT})
  QUALIFY row_number() OVER (PARTITION BY file, event_id ORDER BY line_no) = 1)"""


RARE = _rare("normal", "matched")


def _vector(text: str) -> str:
    """The md5 embedding: each word adds a weight to a slot."""
    words = (
        f"list_filter(regexp_split_to_array(lower(replace({text}, '<*>', '<VAR>')), '[^a-z0-9]+'),"
        " lambda w: w <> '')"
    )
    parts = f"""list_transform({words}, lambda w: {{
      'slot': CAST(concat('0x', substr(md5(w), 1, 8)) AS BIGINT) % 32,
      'weight': 1 + (CAST(concat('0x', substr(md5(w), 9, 4)) AS BIGINT) % 997) / 997.0::DOUBLE}})"""
    return f"""list_transform(range(32), lambda i: coalesce(list_sum(list_transform(
      list_filter({parts}, lambda p: p.slot = i), lambda p: p.weight)), 0::DOUBLE))"""


NEAR = f"""
template_vectors AS (SELECT event_id, template, {_vector("template")} AS v FROM templates),
missed_vectors AS (
  SELECT masked, {_vector("masked")} AS v FROM matched WHERE event_id IS NULL),
near AS (
  SELECT masked, p.event_id AS near_id, p.template AS near_template,
    coalesce(list_cosine_similarity(m.v, p.v), 0) AS near_sim
  FROM missed_vectors m, template_vectors p
  QUALIFY row_number() OVER (PARTITION BY masked ORDER BY near_sim DESC, near_id) = 1),
answers AS (
  SELECT masked, coalesce(event_id, CASE WHEN near_sim >= 0.55 THEN near_id END) AS event_id,
    coalesce(template, CASE WHEN near_sim >= 0.55 THEN near_template END) AS template,
    CASE WHEN event_id IS NULL THEN coalesce(near_sim >= 0.55, false) END AS by_near,
    CASE WHEN event_id IS NULL AND near_sim >= 0.55 THEN near_sim END AS near_sim
  FROM matched LEFT JOIN near USING (masked))"""


def _hash_slots(texts: str, text: str) -> str:
    """The hash embedding of a text per row: (text, slot, total), ten times the sum of the weights."""
    return rf"""
hash_low AS (SELECT {text}, lower(replace({text}, '<*>', '<VAR>')) AS low FROM {texts}),
hash_uses AS (
  SELECT {text}, concat('w:', unnest(regexp_extract_all(low, '[A-Za-z_][A-Za-z_0-9]+'))) AS feature,
    10 AS weight FROM hash_low
  UNION ALL
  SELECT {text}, concat('3:', substr(low, nth, 3)), 3
  FROM (SELECT *, unnest(range(1, greatest(length(low) - 1, 1))) AS nth FROM hash_low)),
hash_features AS (SELECT DISTINCT feature FROM hash_uses),
{blake2b("hash_features", "feature", "hash_codes")},
hash_slots AS (
  SELECT {text}, CAST(code % 384 AS BIGINT) AS slot,
    sum(CASE WHEN code >= 9223372036854775808 THEN weight ELSE -weight END) AS total
  FROM hash_uses JOIN hash_codes USING (feature) GROUP BY ALL HAVING total <> 0)"""


HASH_NEAR = f"""
hash_texts AS (SELECT template AS body FROM templates UNION SELECT masked FROM matched WHERE event_id IS NULL),
{_hash_slots("hash_texts", "body").strip()},
hash_unit AS (SELECT *, total / sqrt(sum(total * total) OVER (PARTITION BY body)) AS x FROM hash_slots),
hash_likeness AS (
  SELECT q.body AS masked, t.event_id AS near_id, sum(q.x * p.x) AS near_sim
  FROM (SELECT * FROM hash_unit WHERE body IN (SELECT masked FROM matched WHERE event_id IS NULL)) q
  JOIN hash_unit p USING (slot) JOIN templates t ON t.template = p.body GROUP BY ALL),
near AS (
  SELECT * FROM hash_likeness
  QUALIFY row_number() OVER (PARTITION BY masked ORDER BY round(near_sim, 7) DESC, near_id) = 1),
answers AS (
  SELECT masked, coalesce(event_id, CASE WHEN near_sim >= 0.55 THEN near_id END) AS event_id,
    CASE WHEN event_id IS NULL THEN coalesce(near_sim >= 0.55, false) END AS by_near,
    CASE WHEN event_id IS NULL AND near_sim >= 0.55 THEN near_sim END AS near_sim
  FROM matched LEFT JOIN near USING (masked))"""


def _rare_findings(cap: int) -> str:
    return f"""
rare AS (
  SELECT file, 1000000 AS source_ord, 'rare_template' AS rule_name,
    'Novel Log Template' AS category, 'MEDIUM' AS severity,
    concat('Log template not present in any normal-training file: "', template[1:120], '"')
      AS description,
    line_no AS line_number, format('{{:.3f}}', elapsed_ms / 1000) AS timestamp, elapsed_ms,
    component, message AS trigger_line, '' AS burst_line_numbers, 1 AS burst_size,
    true AS rare_template
  FROM (
    SELECT * FROM first_seen WHERE event_id NOT IN (SELECT event_id FROM normal_ids)
    QUALIFY row_number() OVER (PARTITION BY file ORDER BY line_no) <= {cap})
  WHERE (file, line_no) NOT IN (SELECT (file, line_number) FROM triggers))"""


FOUND = """
found AS (
  SELECT * EXCLUDE (before, after) FROM triggers
  UNION ALL BY NAME SELECT * FROM rare)"""


def _with(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",".join(p.strip("\n") for p in parts)


_LOG_RULES = (LOG, PS_LINES, HITS, CLUSTERS, TRIGGERS)
_DAILY_RULES = (DAILY, PS_LINES, HITS, CLUSTERS, TRIGGERS)
_LOG_TRAINED = (DAILY, ENTRIES, LOG_MASKED, _mining("positioned"), _matching("positioned"))
_LOG_HEALTHY = (DAILY, ENTRIES, LOG_MASKED, _mining("positioned", "normal"), _matching("positioned"))
_SCAN = (
    *_LOG_TRAINED, RARE, HITS, CLUSTERS, TRIGGERS, CONTEXT, _rare_findings(15), FOUND,
    _ranked("found"), _verdicts("found"),
)

_LOG_DIRECTORIES = (
    DAILY, ENTRIES,
    _log_masked(
        "row_number() OVER (ORDER BY device >= 2, file, line_no)",
        """,
    device < 2 AS healthy, true AS trained""",
    ),
    _mining("positioned", "trained"), _matching("positioned"), NEAR,
)
_ALL_DIRECTORIES = (
    DAILY, ENTRIES,
    _log_masked(
        "row_number() OVER (ORDER BY day > 0, file, line_no)",
        """,
    day <= 0 AS healthy, true AS trained""",
    ),
    _mining("positioned", "trained"), _matching("positioned"), NEAR,
)
_FIND = (
    *_ALL_DIRECTORIES, _rare("healthy", "answers"), HITS, CLUSTERS, TRIGGERS, CONTEXT,
    _rare_findings(15), FOUND, _ranked("found"), _verdicts("found"),
)

_JSON = {
    "context_before": "coalesce(list_before, [])",
    "context_after": "coalesce(list_after, [])",
    "burst_line_numbers": "CASE WHEN burst_line_numbers = '' THEN []::BIGINT[] ELSE "
    "list_transform(string_split(burst_line_numbers, chr(10)), lambda x: CAST(x AS BIGINT)) END",
    "classifier_attention": "NULL",
    "actionability_score": "score",
}
_JSON_FIELDS = ", ".join(f"'{name}': {_JSON.get(name, name)}" for name in FINDING_FIELDS)
_SEVERITY_COUNTS = ", ".join(
    f"CASE WHEN {s} > 0 THEN concat('`{s}`: ', {s}) END" for s in SEVERITIES
)
_FENCE = "```"

def _json_rows(verdicts: str, ranked: str) -> str:
    return f"""
SELECT file, 0 AS seq, concat('{{"file":', to_json(file), ',"verdict":"', verdict,
  '","finding_count":', findings, ',"findings":[') AS text FROM {verdicts} WHERE findings > 0
UNION ALL
SELECT file, rank, concat(CASE WHEN rank > 1 THEN ',' ELSE '' END, to_json({{{_JSON_FIELDS}}}))
FROM {ranked} LEFT JOIN context USING (file, source_ord, line_number)
UNION ALL
SELECT file, findings + 1, ']}}' FROM {verdicts} WHERE findings > 0"""


def _markdown_rows(name: str, verdicts: str, ranked: str) -> str:
    return f"""
SELECT file, 0 AS seq, concat_ws(chr(10), concat('# Anomaly Report: `', {name}, '`'), '',
  concat('**Verdict:** `', verdict, '`  |  **Findings:** ', findings), '',
  concat('**Severity summary:** ', concat_ws('  ', {_SEVERITY_COUNTS})), '') AS text
FROM {verdicts} WHERE findings > 0
UNION ALL
SELECT file, rank, concat_ws(chr(10), concat('## ', rank, '. `', severity, '` ', description), '',
  concat('- **Category:** ', category),
  concat('- **Line:** ', line_number, '  **Timestamp:** `', timestamp, '`  **Component:** `',
    component, '`  **Actionability:** ', format('{{:.2f}}', score)),
  CASE WHEN burst_size > 1 THEN concat('- **Burst size:** ', burst_size,
    ' matches starting at line ', line_number) END,
  '', '**Trigger line:**', '{_FENCE}', trigger_line, '{_FENCE}',
  CASE WHEN list_before IS NOT NULL OR list_after IS NOT NULL THEN concat_ws(chr(10), '',
    '**Context:**', '{_FENCE}',
    array_to_string(list_transform(list_before, lambda x: concat('  ', x)), chr(10)),
    concat('> ', trigger_line),
    array_to_string(list_transform(list_after, lambda x: concat('  ', x)), chr(10)),
    '{_FENCE}') END,
  '', '---', '')
FROM {ranked} LEFT JOIN context USING (file, source_ord, line_number)"""


def _summary_rows(name: str, verdicts: str) -> str:
    return f"""
SELECT '' AS file, 0 AS seq, concat('{{"total_files":', total_files, ',"verdict_counts":',
  to_json({{{", ".join(f"'{v}': {v}" for v in VERDICTS)}}}), ',"files":[') AS text
FROM (SELECT count(*) AS total_files, {TALLIES} FROM {verdicts})
UNION ALL
SELECT file, 1, concat(CASE WHEN file = (SELECT min(file) FROM {verdicts}) THEN '' ELSE ',' END,
  to_json({{'file': {name}, 'verdict': verdict, 'findings': findings,
    'severity': {{{", ".join(f"'{s}': {s}" for s in SEVERITIES)}}}}}))
FROM {verdicts}
UNION ALL SELECT '', 2, ']}}'"""


ORACLES: dict[str, str] = {
    "corpus_files": _with(DAILY) + """
SELECT file, row_number() OVER (ORDER BY file) - 1 AS file_ord FROM (SELECT DISTINCT file FROM log)""",
    "corpus_lines": _with(DAILY) + "\nSELECT file, line_no, value FROM log",
    "corpus_encodings": _with(DAILY) + """
SELECT file, line_no, concat(value, ' \u00e9\u00fc\u00bf') AS value FROM log""",
    "ps_fields": _with(LOG, PS_LINES) + """
SELECT file, line_no, elapsed_ms, component, level, text AS message FROM leveled""",
    "raw_meta": _with(LOG, META) + """
SELECT file, line_no, timestamp, elapsed_ms, component FROM meta""",
    "entry_assembly": _with(LOG, ENTRIES) + "\nSELECT * FROM entries",
    "rule_library": _with(LOG, PS_LINES, HITS) + """
SELECT name, category, severity, description, burst_min IS NOT NULL AS is_burst,
  CAST(before AS BIGINT) AS context_before, CAST(after AS BIGINT) AS context_after,
  (SELECT count(*) FROM hits h WHERE h.rule_ord = r.rule_ord) AS hits
FROM rules r""",
    "rule_hits": _with(LOG, PS_LINES, HITS) + """
SELECT file, line_no, rule_ord, value, elapsed_ms FROM hits""",
    "device_rules": _with(LOG, PS_LINES) + r"""
, users AS (
  SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS rule_ord
  FROM (SELECT DISTINCT user_id FROM events)),
named AS (
  SELECT file, line_no, value, elapsed_ms, CAST(nullif(concat(
    regexp_extract(value, '\buser (\d+) \w+ ok$', 1),
    regexp_extract(value, 'queue full, (\d+) waiting', 1)), '') AS BIGINT) AS user_id
  FROM ps)
SELECT file, line_no, rule_ord, value, elapsed_ms FROM named JOIN users USING (user_id)""",
    "rule_findings_context": _with(*_LOG_RULES, CONTEXT, recursive=True) + """
SELECT file, rule_name, category, severity, description, line_number, timestamp, elapsed_ms,
  component, trigger_line, CAST(burst_size AS BIGINT) AS burst_size,
  coalesce(context_before, '') AS context_before, coalesce(context_after, '') AS context_after,
  burst_line_numbers
FROM triggers LEFT JOIN context USING (file, source_ord, line_number)""",
    "burst_clusters": _with(LOG, PS_LINES, HITS, CLUSTERS, recursive=True) + """
SELECT file, rule_ord, line_no, size, lines FROM clusters""",
    "findings_ranked": _with(*_LOG_RULES, _ranked("triggers"), recursive=True) + """
SELECT file, rank, rule_name, line_number, severity, round(score, 6) AS actionability_score
FROM ranked""",
    "file_verdicts": _with(*_DAILY_RULES, _verdicts("triggers"), recursive=True)
    + "\nSELECT * FROM verdicts",
    "corpus_summary": _with(*_DAILY_RULES, _verdicts("triggers"), recursive=True) + f"""
SELECT count(*) AS total_files, {TALLIES} FROM verdicts""",
    "mask_log_messages": _with(LOG, ENTRIES, _masking("entries", "file, line_no")) + """
SELECT file, line_no, masked, n, prefix, params FROM tokens""",
    "mask_document_lines": _with(DOCS, _masking("docs", "doc_id, line_no")) + """
SELECT doc_id, line_no, masked, n, prefix, params FROM tokens""",
    "error_hints": _with(LOG, ENTRIES) + f"""
SELECT file, line_no, regexp_matches(message, {HINT}) AS hinted FROM entries""",
    "log_templates": _with(*_LOG_TRAINED, recursive=True) + TEMPLATE_ROWS,
    "document_templates": _with(
        DOCS, DOC_MASKED, _mining("positioned"), _matching("positioned"), recursive=True
    ) + TEMPLATE_ROWS,
    "frozen_match": _with(*_LOG_HEALTHY, recursive=True) + """
SELECT masked, event_id, template, round(CASE WHEN template IS NOT NULL THEN sim END, 6)
    AS similarity, array_to_string(CASE WHEN template IS NOT NULL THEN list_transform(
    list_zip(t, toks), lambda z: CASE WHEN z[1] = z[2] THEN z[1] ELSE '<*>' END) END, ' ') AS merged
FROM matched""",
    "tagged_entries": _with(*_LOG_HEALTHY, recursive=True) + """
SELECT file, line_no, coalesce(event_id, '<unk>') AS event_id,
  coalesce(template, masked) AS template, params,
  CASE WHEN event_id IS NULL THEN false END AS resolved_via_oov
FROM positioned JOIN matched USING (masked)""",
    "dictionary_lookup": _with(*_LOG_HEALTHY, recursive=True) + """
SELECT file, line_no, coalesce(event_id, '<unk>') AS event_id,
  coalesce(template, '<unk>') AS template
FROM positioned JOIN matched USING (masked)""",
    "tagged_by_embedder": _with(*_LOG_HEALTHY, NEAR, recursive=True) + """
SELECT file, line_no, coalesce(event_id, '<unk>') AS event_id, coalesce(template, masked) AS template,
  by_near AS resolved_via_oov, round(near_sim, 4) AS oov_similarity
FROM positioned JOIN answers USING (masked)""",
    "tagged_by_similarity": _with(*_LOG_HEALTHY, HASH_NEAR, recursive=True) + """
SELECT file, line_no, coalesce(event_id, '<unk>') AS event_id, by_near AS resolved_via_oov,
  round(near_sim, 4) AS oov_similarity
FROM positioned JOIN answers USING (masked)""",
    "hash_embeddings": _with(
        DOCS, DOC_MASKED, "texts AS (SELECT DISTINCT masked FROM positioned)",
        _hash_slots("texts", "masked"), recursive=True,
    ) + """
SELECT masked, CASE WHEN count(slot) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS length, count(slot) AS slots,
  coalesce(string_agg(concat(CASE WHEN total > 0 THEN '+' ELSE '-' END, slot), ' ' ORDER BY slot)
    FILTER (slot IS NOT NULL), '')
    AS signs
FROM texts LEFT JOIN hash_slots USING (masked) GROUP BY masked""",
    "vector_norm": """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
n AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS length FROM v)
SELECT vec_id, round(length, 5) AS length,
  round(CASE WHEN length > 0 THEN 1.0 ELSE 0.0 END, 5) AS unit_length,
  CAST(len(e) AS BIGINT) AS dim
FROM n""",
    "nearest_neighbour": """
WITH v AS (SELECT CAST(vec_id AS VARCHAR) AS id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings),
c AS (
  SELECT q.id AS event_id, k.id AS near_id, list_cosine_similarity(q.e, k.e) AS similarity
  FROM v q JOIN v k ON q.label <> 0 AND k.label = 0
  QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY similarity DESC, k.id) = 1)
SELECT event_id, CASE WHEN similarity >= 0.3 THEN near_id ELSE '<unk>' END AS resolved_id,
  round(similarity, 5) AS similarity FROM c
UNION ALL SELECT id, id, 1.0 FROM v WHERE label = 0""",
    "embedding_index": """
SELECT CAST(vec_id AS VARCHAR) AS event_id,
  row_number() OVER (ORDER BY CAST(vec_id AS VARCHAR)) - 1 AS row
FROM embeddings""",
    "normal_ids": _with(*_LOG_TRAINED, RARE, recursive=True)
    + "\nSELECT event_id FROM normal_ids",
    "rare_first_seen": _with(*_LOG_TRAINED, RARE, recursive=True) + """
SELECT file, event_id, template, line_no, elapsed_ms, component, message FROM first_seen""",
    "rare_capped": _with(
        *_LOG_TRAINED, RARE, HITS, CLUSTERS, TRIGGERS, _rare_findings(2), recursive=True
    ) + """
SELECT file, line_number, description, timestamp, elapsed_ms, component, trigger_line FROM rare""",
    "scan_findings": _with(*_SCAN, recursive=True) + """
SELECT file, rank, rule_name, severity, line_number, trigger_line, rare_template,
  round(score, 6) AS actionability_score, coalesce(context_before, '') AS context_before,
  coalesce(context_after, '') AS context_after
FROM ranked LEFT JOIN context USING (file, source_ord, line_number)""",
    "report_json": _with(*_SCAN, recursive=True) + _json_rows("verdicts", "ranked"),
    "report_markdown": _with(*_SCAN, recursive=True)
    + _markdown_rows("file", "verdicts", "ranked"),
    "report_summary": _with(*_DAILY_RULES, _verdicts("triggers"), recursive=True)
    + _summary_rows("file", "verdicts"),
    "train_job": _with(
        DOCS, DOC_MASKED, _mining("positioned"), _matching("positioned"), recursive=True
    ) + """
SELECT event_id, t.template, n_lines, normal
FROM templates t JOIN (
  SELECT event_id, count(*) AS n_lines, bool_or(normal) AS normal
  FROM positioned JOIN matched USING (masked) GROUP BY event_id) USING (event_id)
UNION ALL
SELECT event_id, template, 0, false FROM templates
WHERE event_id NOT IN (SELECT event_id FROM matched WHERE event_id IS NOT NULL)""",
    "find_job": _with(*_DAILY_RULES, _verdicts("triggers"), recursive=True)
    + "\nSELECT * FROM verdicts",
    "train_directories": _with(*_LOG_DIRECTORIES, recursive=True) + f"""
, used AS (
  SELECT event_id, count(*) AS n_lines, bool_or(healthy) AS normal
  FROM positioned JOIN matched USING (masked) WHERE trained GROUP BY event_id)
SELECT event_id, t.template, coalesce(n_lines, 0) AS n_lines, coalesce(normal, false) AS normal,
  round(coalesce(list_sum(v) / nullif(sqrt(list_sum(list_transform(v, lambda x: x * x))), 0), 0), 4)
    AS vec_sum
FROM templates t JOIN template_vectors USING (event_id) LEFT JOIN used USING (event_id)""",
    "train_all_directories": _with(*_ALL_DIRECTORIES, recursive=True) + f"""
, used AS (
  SELECT event_id, count(*) AS n_lines, bool_or(healthy) AS normal
  FROM positioned JOIN matched USING (masked) WHERE trained GROUP BY event_id)
SELECT event_id, t.template, coalesce(n_lines, 0) AS n_lines, coalesce(normal, false) AS normal,
  round(coalesce(list_sum(v) / nullif(sqrt(list_sum(list_transform(v, lambda x: x * x))), 0), 0), 4)
    AS vec_sum
FROM templates t JOIN template_vectors USING (event_id) LEFT JOIN used USING (event_id)""",
    "find_reports": _with(*_FIND, recursive=True) + f"""
SELECT 'json' AS kind, text FROM ({_json_rows("verdicts", "ranked")})
UNION ALL
SELECT 'md', unnest(string_split(text, chr(10))) FROM ({_markdown_rows("''", "verdicts", "ranked")})
UNION ALL
SELECT 'summary', text FROM ({_summary_rows("''", "verdicts")})""",
}

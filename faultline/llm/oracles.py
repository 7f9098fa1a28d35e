"""DuckDB SQL with the results of the queries that SQL can express."""

OP1 = r"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), strings AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS s
  FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS i FROM d WHERE len(h) >= 200)
), later AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM strings)
  WHERE r > 1
), bytes AS (
  SELECT doc_id, h, unnest(range(0, len(h) // 2)) AS i FROM d WHERE doc_id IN (FROM (SELECT doc_id FROM later))
), marked AS (
  SELECT b.doc_id, b.i, substr(b.h, 2 * b.i + 1, 2) AS x,
    coalesce(b.i - max(l.i) OVER (PARTITION BY b.doc_id ORDER BY b.i) < 100, false) AS gone
  FROM bytes b LEFT JOIN later l ON l.doc_id = b.doc_id AND l.i = b.i
), runs AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM marked
), cut AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans,
    coalesce(string_agg(x, '' ORDER BY i) FILTER (NOT gone), '') AS kept
  FROM runs GROUP BY doc_id
)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed,
  coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""

OP5 = r"""
WITH d AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS every FROM documents
), l AS (
  SELECT doc_id, list_filter(every, lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS w FROM d
), places AS (
  SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS n
  FROM l, (SELECT unnest([1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096]) AS k) WHERE len(w) >= k
), runs AS (
  SELECT doc_id, k, n, array_to_string(w[n:n + k - 1], chr(10)) AS run FROM places
), ranked AS (
  SELECT doc_id, k, n, run,
    row_number() OVER (PARTITION BY k, run ORDER BY doc_id, n) AS r,
    count(*) OVER (PARTITION BY k, run) AS many
  FROM runs
), longest AS (
  SELECT doc_id, max(k) AS longest_run FROM ranked WHERE many > 1 GROUP BY doc_id
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(n, n + k)) AS n FROM ranked
  WHERE r > 1 AND (k = 4 OR k < 4 AND
    len(list_filter(regexp_split_to_array(run, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')) >= 20)
), lines AS (
  SELECT doc_id, i, line, regexp_matches(line, '[^ \t\n\x0B\f\r]') AS filled,
    sum(regexp_matches(line, '[^ \t\n\x0B\f\r]')::INT) OVER (PARTITION BY doc_id ORDER BY i) AS n
  FROM (SELECT doc_id, unnest(every) AS line, generate_subscripts(every, 1) AS i FROM d)
), kept AS (
  SELECT lines.doc_id, sum(filled::INT) AS n_lines, count(gone.n) FILTER (filled) AS n_removed,
    string_agg(line, chr(10) ORDER BY i) FILTER (NOT filled OR gone.n IS NULL) AS text
  FROM lines LEFT JOIN gone ON gone.doc_id = lines.doc_id AND gone.n = lines.n GROUP BY lines.doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0) AS n_removed,
  coalesce(longest_run, 0)::BIGINT AS longest_run, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN longest USING (doc_id)
"""

OP3 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), starts AS (
  SELECT item, w, least(13, len(w)) AS m, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i
  FROM b WHERE len(w) > 0
), patterns AS (
  SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS key FROM starts
), places AS (
  SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i
  FROM d, (SELECT DISTINCT m FROM patterns) WHERE len(w) >= m
), hits AS (
  SELECT doc_id, i, places.m, item FROM places
  JOIN patterns ON patterns.m = places.m AND key = array_to_string(w[i:i + places.m - 1], ' ')
), words AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM hits) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)
"""

OP6 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'),
                   (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), escaped AS (
  SELECT *,
    length(regexp_replace(role, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g')) AS role_chars,
    length(regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g')) AS text_chars,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS earlier
  FROM rows
)
SELECT conv_id,
  count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(text_chars + CASE WHEN earlier = role THEN 8 ELSE 8 + role_chars + 8 + 7 END)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""

OP13 = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), words AS (
  SELECT row, lang, source, unnest(w) AS term FROM d
), vocabulary AS (
  SELECT lang, term, count(*)::HUGEINT AS n FROM words
  GROUP BY lang, term HAVING count(DISTINCT row) >= 30
), langs AS (
  SELECT lang, sum(n)::HUGEINT AS total, count(*)::HUGEINT AS v FROM vocabulary GROUP BY lang
), used AS (
  SELECT lang, source, term, count(*)::HUGEINT AS n FROM words SEMI JOIN vocabulary USING (lang, term)
  GROUP BY lang, source, term
), groups AS (
  SELECT DISTINCT lang, source FROM d
), totals AS (
  SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM groups LEFT JOIN used USING (lang, source)
  GROUP BY lang, source
), grid AS (
  SELECT t.lang, t.source, v.term, coalesce(u.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(u.n, 0) + 5)) // (t.total + 5 * l.v) AS p,
    1 + (1000000000::HUGEINT * (v.n + 5)) // (l.total + 5 * l.v) AS q
  FROM totals t JOIN langs l USING (lang) JOIN vocabulary v USING (lang)
    LEFT JOIN used u ON u.lang = t.lang AND u.source = t.source AND u.term = v.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY ALL
), pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
), term AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM grid WHERE n > 0 AND p > q
)
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
  FROM (FROM pair UNION ALL FROM term)
) WHERE part = 'pair' OR rank <= 50
"""

ORACLES = {
    "op1_suffix_dedup": OP1,
    "op3_decontaminate": OP3,
    "op5_line_dedup": OP5,
    "op6_chat_format": OP6,
    "op13_source_divergence": OP13,
}

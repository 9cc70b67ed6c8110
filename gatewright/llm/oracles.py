"""DuckDB SQL for the queries that SQL can express, written independently of the operators."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_RUNS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op2_substring_dedup": f"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
win AS (SELECT doc_id, unnest(range(0, greatest(len(ws) - 19, 0))) AS p, ws FROM w),
txt AS (SELECT doc_id, p, array_to_string(list_slice(ws, p + 1, p + 20), ' ') AS t FROM win),
rep AS (SELECT doc_id, p FROM txt QUALIFY row_number() OVER (PARTITION BY t ORDER BY doc_id, p) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS k FROM rep),
cut AS (SELECT doc_id, list(k) AS ks FROM gone GROUP BY doc_id),
word AS (SELECT doc_id, unnest(ws) AS wd, unnest(range(0, len(ws))) AS k FROM w),
kept AS (SELECT word.doc_id, string_agg(wd, ' ' ORDER BY k) AS t, count(*) AS n FROM word ANTI JOIN gone ON gone.doc_id = word.doc_id AND gone.k = word.k GROUP BY word.doc_id)
SELECT w.doc_id AS doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id""",
    "op6_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, p + 1, p + 5), ' ') AS s FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - 4)) AS p FROM w WHERE len(ws) >= 5)
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT w.doc_id AS doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN low ON low.a = w.doc_id""",
    "op8_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn), '')) AS loss_sha256,
  CAST(sum(length(role) + length(regexp_replace(text, '([<\[])(\\*)(\||/?s>|<SYS>>|</SYS>>|/?INST\])', '\1\2\\\3', 'g')) + 13) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id""",
    "op9_decontaminate": f"""
WITH d AS (SELECT doc_id, {_RUNS} AS ws FROM documents),
b AS (SELECT item_id, {_RUNS} AS ws FROM benchmark),
bw AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, n, array_to_string(list_slice(ws, p + 1, p + n), ' ') AS t
  FROM (SELECT item_id, ws, least(10, len(ws)) AS n, unnest(range(0, greatest(len(ws) - 9, 1))) AS p FROM b WHERE len(ws) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, p, array_to_string(list_slice(ws, p + 1, p + n), ' ') AS t FROM (SELECT doc_id, ws, n, unnest(range(0, greatest(len(ws) - n + 1, 0))) AS p FROM d, ns)),
hit AS (SELECT DISTINCT dw.doc_id, dw.n, dw.p, item FROM dw JOIN bw ON bw.n = dw.n AND bw.t = dw.t),
wd AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS k FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id AS doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN wd ON wd.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id""",
}

"""DuckDB SQL of the registered queries, independent of the Spark formulation.

Text bridge: results are predicted from the keys and the fixed template, not by parsing.
Fact bridge: windows and FILTER where Spark uses aggregates and joins.
"""

from __future__ import annotations

# ---- text bridge: one row per file, key i, L digits of i, M digits of i + 1
_F = "f AS (SELECT c_custkey AS i, length(CAST(c_custkey AS VARCHAR)) AS l, length(CAST(c_custkey + 1 AS VARCHAR)) AS m, 'f' || c_custkey || '.sv' AS file, CAST(c_custkey AS VARCHAR) AS t FROM customer)"
_CASE = "(CASE WHEN i % 3 = 2 THEN 35 ELSE 29 END)"

#: code, line, column, message, condition
_SYNTAX = [
    ("NO_BLOCKING_SEQUENTIAL", "9", "7 + l", "'Blocking assignment used in sequential logic'", "i % 2 = 1"),
    ("NO_BLOCKING_SEQUENTIAL", "10", "7", "'Blocking assignment used in sequential logic'", "true"),
    ("NO_NONBLOCKING_COMBINATIONAL", "13", "7 + l", "'Non-blocking assignment used in combinational logic'", "i % 3 <> 1"),
    ("DEFAULT_CASE", "23", "3", "'Case statement missing default case'", "i % 5 <> 1"),
    ("NO_CASEX_CASEZ", "26", _CASE, "'Use of casex/casez can hide X/Z mismatches'", "i % 4 = 3"),
    ("NO_MIXED_ASSIGNMENT_STYLE", "10", "5", "'Mixed blocking and non-blocking assignments used in the same procedural block'", "i % 2 = 0"),
    ("NO_MIXED_ASSIGNMENT_STYLE", "14", "14", "'Mixed blocking and non-blocking assignments used in the same procedural block'", "i % 3 <> 1"),
    ("NO_INITIAL_BLOCK", "6", "3", "'Use of initial blocks can be unsafe in synthesizable RTL'", "i % 4 = 0"),
    ("NO_FINAL_BLOCK", "7", "3", "'Use of final blocks is usually not appropriate in synthesizable RTL'", "i % 5 = 0"),
    ("NO_ALWAYS_LATCH", "16", "3", "'Use of always_latch can hide unintended latch-oriented design choices'", "i % 7 = 0"),
    ("NO_CASE_GENERATE", "18", "3", "'Use of case generate can make structural intent harder to follow'", "true"),
    ("NO_FULL_PARALLEL_CASE", "18", "3", "'Use of full_case / parallel_case pragmas can hide real case coverage issues'", "i % 4 = 1"),
    ("NO_UNIQUE_PRIORITY_CASE", "26", "28", "'Use of unique/priority case can overstate case completeness or exclusivity'", "i % 3 = 2"),
    ("NO_INOUT_INTERNAL", "5", "3", "'Internal inout declarations are not allowed'", "i % 3 = 0"),
    ("NO_LATCH_IN_ALWAYS_COMB", "12", "3", "'always_comb block contains a conditional-only assignment that can infer latch-like storage'", "i % 3 <> 1"),
    ("NO_DEFPARAM", "25", "3", "'Use of defparam is discouraged; prefer explicit parameter overrides at instantiation'", "i % 6 = 1"),
]
_CODES = ["NO_BLOCKING_SEQUENTIAL", "NO_NONBLOCKING_COMBINATIONAL", "DEFAULT_CASE", "NO_CASEX_CASEZ", "NO_MIXED_ASSIGNMENT_STYLE", "NO_INITIAL_BLOCK", "NO_FINAL_BLOCK", "NO_ALWAYS_LATCH", "NO_CASE_GENERATE", "NO_FULL_PARALLEL_CASE", "NO_UNIQUE_PRIORITY_CASE", "NO_INOUT_INTERNAL", "NO_LATCH_IN_ALWAYS_COMB", "NO_DEFPARAM"]
_MULTI = "'Variable ''q'' is written from multiple procedural blocks (first driver at line '"
_SYMBOL = [
    ("UNUSED_VARIABLE", "5", "CASE WHEN i % 3 = 0 THEN 14 ELSE 8 END", "'Unused variable ''io'''", "true"),
    ("UNDECLARED_VARIABLE", "20", "14", "'Undeclared variable ''w' || t || ''''", "i % 6 = 0"),
    ("NO_IMPLICIT_NET", "20", "14", "'Implicit net ''w' || t || ''' is not allowed'", "i % 6 <> 0"),
    ("NO_IMPLICIT_NET", "25", "14 + l", "'Implicit net ''W'' is not allowed'", "i % 6 = 1"),
    ("NO_MULTIPLE_DRIVERS", "27", "14", "'Variable ''b' || t || ''' is written from multiple procedural blocks (first driver at line 12)'", "i % 3 <> 1"),
    ("NO_MULTIPLE_DRIVERS", "7", "9", _MULTI + " || '6)'", "i % 4 = 0 AND i % 5 = 0"),
    ("NO_MULTIPLE_DRIVERS", "10", "5", _MULTI + " || '6)'", "i % 4 = 0 AND i % 5 <> 0"),
    ("NO_MULTIPLE_DRIVERS", "10", "5", _MULTI + " || '7)'", "i % 4 <> 0 AND i % 5 = 0"),
    ("NO_MULTIPLE_DRIVERS", "16", "16", _MULTI + " || '8)'", "i % 4 <> 0 AND i % 5 <> 0 AND i % 7 = 0"),
    ("READ_BEFORE_WRITE", "8", "20", "'Variable ''clk'' read before write'", "true"),
    ("READ_BEFORE_WRITE", "10", "9", "'Variable ''sel'' read before write'", "true"),
    ("READ_BEFORE_WRITE", "9", "CASE WHEN i % 2 = 0 THEN 10 + l ELSE 9 + l END", "'Variable ''b' || t || ''' read before write'", "true"),
]
_MODULE = [
    ("UNDEFINED_MODULE", "24", "3", "'Instantiation of undefined module ''top_' || (i + 1) || ''''", "i % 2 = 1 AND i + 1 NOT IN (SELECT c_custkey FROM customer)"),
    ("UNDEFINED_MODULE", "24", "3", "'Instantiation of undefined module ''other_' || t || ''''", "i % 2 = 0"),
]
# identifiers: line, column, name, read, write, condition
_IDS = [
    ("6", "11", "'q'", "false", "true", "i % 4 = 0"), ("7", "9", "'q'", "false", "true", "i % 5 = 0"),
    ("8", "20", "'clk'", "true", "false", "true"), ("9", "5", "'a' || t", "false", "true", "true"), ("9", "CASE WHEN i % 2 = 0 THEN 10 + l ELSE 9 + l END", "'b' || t", "true", "false", "true"),
    ("10", "5", "'q'", "false", "true", "true"), ("10", "9", "'sel'", "true", "false", "true"),
    ("13", "5", "'mem'", "false", "true", "i % 3 = 1"), ("13", "5", "'b' || t", "false", "true", "i % 3 <> 1"), ("13", "10 + l", "'sel'", "true", "false", "i % 3 <> 1"),
    ("14", "9", "'sel'", "true", "false", "true"), ("14", "14", "'mem'", "false", "true", "true"), ("14", "23", "'a' || t", "true", "false", "true"),
    ("16", "16", "'q'", "false", "true", "i % 7 = 0"), ("16", "20", "'sel'", "true", "false", "i % 7 = 0"), ("18", "9", "'sel'", "true", "false", "true"),
    ("20", "14", "'w' || t", "false", "true", "true"), ("24", "15 + m + l", "'clk'", "true", "false", "i % 2 = 1"), ("24", "26 + m + l", "'q'", "true", "false", "i % 2 = 1"), ("24", "12 + 2 * l", "'q'", "true", "false", "i % 2 = 0"),
    ("25", "12", "'u' || t", "true", "false", "i % 6 = 1"), ("25", "14 + l", "'W'", "true", "false", "i % 6 = 1"), ("26", "23", "'clk'", "true", "false", "true"),
    ("26", _CASE + " + (CASE WHEN i % 4 = 3 THEN 7 ELSE 6 END)", "'sel'", "true", "false", "true"), ("27", "14", "'b' || t", "true", "true", "true"), ("27", "19 + l", "'q'", "true", "false", "true"),
]
_PROC = "CASE WHEN line = 6 THEN 'InitialBlock' WHEN line = 7 THEN 'FinalBlock' WHEN line IN (8, 9, 10) THEN 'AlwaysBlock' WHEN line IN (13, 14) THEN 'AlwaysCombBlock' WHEN line = 16 THEN 'AlwaysLatchBlock' WHEN line IN (26, 27) THEN 'AlwaysFFBlock' END"
_PROC_LINE = "CASE WHEN line IN (6, 7, 16) THEN line WHEN line IN (8, 9, 10) THEN 8 WHEN line IN (13, 14) THEN 12 WHEN line IN (26, 27) THEN 26 END"


def _predicted(rows) -> str:
    return " UNION ALL ".join(f"SELECT i, file, '{code}' AS code, CAST({line} AS INTEGER) AS line, CAST({col} AS INTEGER) AS col, {message} AS message FROM f WHERE {cond}" for code, line, col, message, cond in rows)


def _ids() -> str:
    return " UNION ALL ".join(f"SELECT i, file, CAST({line} AS INTEGER) AS line, CAST({col} AS INTEGER) AS col, {name} AS name, {r} AS read, {w} AS write FROM f WHERE {cond}" for line, col, name, r, w, cond in _IDS)


# ---- fact bridge
_EV = """ev AS (
  SELECT event_id AS seq, CASE WHEN user_id % 10 = 0 THEN 'global' ELSE 'u' || lpad(CAST(user_id AS VARCHAR), 6, '0') END AS scope_id,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type, user_id, event_id
  FROM events),
fact AS (
  SELECT *, 's' || (k % 40) AS name, event_type IN ('click', 'signup') AS is_decl,
         CASE event_type WHEN 'click' THEN 'variable' WHEN 'signup' THEN 'instance' END AS decl_kind,
         event_type NOT IN ('click', 'signup', 'view') AS rd, event_type NOT IN ('click', 'signup', 'purchase') AS wr, user_id % 3 = 0 AS none_file
  FROM ev),
win AS (
  SELECT *, min(seq) FILTER (WHERE is_decl) OVER (PARTITION BY scope_id, name) AS fd,
         min(seq) FILTER (WHERE NOT is_decl) OVER (PARTITION BY scope_id, name) AS fu,
         min(seq) FILTER (WHERE scope_id = 'global') OVER (PARTITION BY name) AS g
  FROM fact),
bound AS (
  SELECT *, CASE WHEN is_decl OR coalesce(fd <= seq, false) OR ((scope_id = 'global' OR g IS NULL OR fu < g) AND fu <= seq) THEN scope_id ELSE 'global' END AS bs
  FROM win),
sym AS (
  SELECT bs, name, max(CASE WHEN is_decl THEN seq END) AS last_decl, min(seq) AS birth, min(seq) FILTER (WHERE is_decl) AS first_decl, min(seq) FILTER (WHERE NOT is_decl) AS first_use,
         count(*) FILTER (WHERE is_decl) AS n_decl, count(*) FILTER (WHERE NOT is_decl) AS n_use,
         bool_or(is_decl AND k % 5 = 0) AS is_port, bool_or(rd) AS is_read, bool_or(wr) AS is_written,
         min(seq) FILTER (WHERE rd) AS first_read, min(seq) FILTER (WHERE wr) AS first_write
  FROM bound GROUP BY bs, name),
s AS (
  SELECT sym.*, CASE WHEN n_decl > 0 THEN ld.decl_kind WHEN b.none_file THEN 'variable' ELSE 'implicit_net' END AS kind, n_decl = 0 AND NOT b.none_file AS is_implicit
  FROM sym JOIN fact b ON b.seq = sym.birth LEFT JOIN fact ld ON ld.seq = sym.last_decl)"""


def _at(place: str, message: str, where: str) -> str:
    return f"WITH {_EV} SELECT s.bs AS scope_id, s.name AS name, CAST({place} + 1 AS INTEGER) AS line, CAST(p.k + 1 AS INTEGER) AS col, {message} AS message FROM s JOIN fact p ON p.seq = s.{place} WHERE {where}"


_SYMBOL_FACT = {
    "UNUSED_VARIABLE": _at("first_decl", "'Unused variable ''' || s.name || ''''", "kind = 'variable' AND n_use = 0"),
    "UNDECLARED_VARIABLE": _at("first_use", "'Undeclared variable ''' || s.name || ''''", "NOT is_implicit AND n_decl = 0"),
    "NO_IMPLICIT_NET": _at("first_use", "'Implicit net ''' || s.name || ''' is not allowed'", "is_implicit"),
    "NO_MULTIPLE_DRIVERS": f"""WITH {_EV}, d AS (SELECT bs, name, event_id % 4 AS drv, min(seq) AS seq FROM bound WHERE wr AND event_id % 4 < 3 GROUP BY bs, name, event_id % 4),
      r AS (SELECT *, row_number() OVER (PARTITION BY bs, name ORDER BY seq) AS n, first_value(drv) OVER (PARTITION BY bs, name ORDER BY seq) AS d1 FROM d)
      SELECT r.bs AS scope_id, r.name AS name, CAST(r.seq + 1 AS INTEGER) AS line, CAST(p.k + 1 AS INTEGER) AS col, 'Variable ''' || r.name || ''' is written from multiple procedural blocks (first driver at line ' || (d1 + 1) || ')' AS message
      FROM r JOIN fact p ON p.seq = r.seq JOIN s ON s.bs = r.bs AND s.name = r.name WHERE n = 2 AND s.kind = 'variable' AND s.n_decl > 0""",
    "NO_UNDRIVEN_SIGNAL": _at("first_decl", "'Signal ''' || s.name || ''' is read but never driven'", "kind = 'variable' AND n_decl > 0 AND NOT is_port AND is_read AND NOT is_written"),
    "REDECLARED_VARIABLE": f"WITH {_EV} SELECT bs AS scope_id, bound.name AS name, CAST(seq + 1 AS INTEGER) AS line, CAST(k + 1 AS INTEGER) AS col, 'Redeclared symbol ''' || bound.name || ''' (first declared at line ' || (fd + 1) || ')' AS message FROM bound WHERE is_decl AND seq > fd",
    "READ_BEFORE_WRITE": _at("first_read", "'Variable ''' || s.name || ''' read before write'", "kind = 'variable' AND n_decl > 0 AND (first_write IS NULL OR first_read <= first_write)"),
}
_MODS = "mods AS (SELECT c_custkey AS key, 'm' || (c_custkey * 7 % 50) AS name, 'f' || (c_custkey % 2) || '.v' AS file, c_custkey % 2 AS idx, 'c' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS scope_id FROM customer)"
_ASKED = "asked AS (SELECT DISTINCT 'm' || (o_custkey % 60) AS module, 's' || (o_orderkey % 40) AS name FROM orders)"


def oracle_sql() -> dict[str, str]:
    out = {}
    for code in _CODES:
        out[f"syntax_{code.lower()}"] = f"WITH {_F}, p AS ({_predicted([r for r in _SYNTAX if r[0] == code])}) SELECT file, line, col, message FROM p"
    for code, sql in _SYMBOL_FACT.items():
        out[f"symbol_{code.lower()}"] = sql
    rank = "CASE code " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(_CODES)) + " END"
    out["syntax_all"] = f"WITH {_F}, p AS ({_predicted(_SYNTAX)}) SELECT file, row_number() OVER (PARTITION BY i ORDER BY line, col, {rank}) AS pos, code, line, col FROM p"
    out["symbol_resolution"] = f"WITH {_EV} SELECT seq AS event_id, scope_id, name, CASE WHEN is_decl THEN 'decl' ELSE 'use' END AS ev, bs AS bound_scope FROM bound"
    out["symbol_table"] = f"WITH {_EV} SELECT bs AS scope_id, name, kind, is_implicit, is_port, is_read, is_written, birth, first_decl, first_use, n_decl, n_use FROM s"
    out["module_duplicates"] = f"WITH {_MODS}, r AS (SELECT *, row_number() OVER w AS n, first_value(file) OVER w AS f1 FROM mods WINDOW w AS (PARTITION BY name ORDER BY idx, key)) SELECT name, file, CAST(key + 1 AS INTEGER) AS line, 'Duplicate module ''' || name || ''' (first defined in ' || f1 || ')' AS message FROM r WHERE n > 1"
    out["module_undefined_refs"] = f"WITH {_MODS} SELECT 'm' || (o_custkey * 7 % 70) AS name, CAST(o_orderkey + 1 AS INTEGER) AS line, CAST(3 AS INTEGER) AS col, 'Instantiation of undefined module ''m' || (o_custkey * 7 % 70) || '''' AS message FROM orders WHERE NOT EXISTS (SELECT 1 FROM mods WHERE mods.name = 'm' || (o_custkey * 7 % 70))"
    out["module_registry"] = f"WITH {_MODS} SELECT name, count(*) AS n_definitions FROM mods GROUP BY name"
    out["lookup_from_scope"] = f"WITH {_EV} SELECT DISTINCT fact.scope_id, fact.name, CASE WHEN EXISTS (SELECT 1 FROM sym WHERE sym.bs = fact.scope_id AND sym.name = fact.name) THEN fact.scope_id WHEN EXISTS (SELECT 1 FROM sym WHERE sym.bs = 'global' AND sym.name = fact.name) THEN 'global' END AS found_scope FROM fact"
    out["lookup_module_path"] = f"WITH {_MODS}, {_ASKED}, firsts AS (SELECT * FROM mods QUALIFY row_number() OVER (PARTITION BY name ORDER BY idx, key) = 1) SELECT module, asked.name AS name, CASE WHEN 's' || (key % 40) = asked.name THEN scope_id END AS found_scope FROM asked LEFT JOIN firsts ON firsts.name = module"
    out["lookup_module_name"] = f"WITH {_MODS}, {_ASKED}, names AS (SELECT DISTINCT name FROM asked), r AS (SELECT 's' || (key % 40) AS name, scope_id, row_number() OVER (PARTITION BY key % 40 ORDER BY idx, key) AS n FROM mods) SELECT names.name AS name, scope_id AS found_scope FROM names LEFT JOIN r ON r.name = names.name AND n = 1"
    ids = f"WITH {_F}, ids AS ({_ids()})"
    out["access_mode"] = out["access_mode_inherited"] = f"{ids} SELECT file, line, col, name, read, write FROM ids"
    out["driver_id"] = f"{ids} SELECT file, line, col, name, ({_PROC}) || ':' || file || ':' || ({_PROC_LINE}) || ':3' AS driver_id FROM ids WHERE write"
    out["nearest_ancestor"] = f"{ids} SELECT file, line, col, {_PROC} AS anc_kind, CAST({_PROC_LINE} AS INTEGER) AS anc_line FROM ids WHERE ({_PROC}) IS NOT NULL"
    out["nettype_none_files"] = "SELECT 'f' || c_custkey || '.sv' AS file, c_custkey % 6 = 0 AS nettype_none FROM customer"
    out["pragma_line_join"] = "SELECT 'f' || c_custkey || '.sv' AS file, CAST(18 AS INTEGER) AS line, CAST(3 AS INTEGER) AS col, 'CaseKeyword' AS kind FROM customer WHERE c_custkey % 4 = 1"
    out["node_counts"] = f"""WITH {_F}, n AS (
      SELECT file, 'Equals' AS kind, 3 + (CASE WHEN i % 2 = 1 THEN 1 ELSE 0 END) + (CASE WHEN i % 4 = 0 THEN 1 ELSE 0 END) + (CASE WHEN i % 5 = 0 THEN 1 ELSE 0 END) + (CASE WHEN i % 3 = 1 THEN 1 ELSE 0 END) + (CASE WHEN i % 7 = 0 THEN 1 ELSE 0 END) + (CASE WHEN i % 6 = 1 THEN 1 ELSE 0 END) AS n FROM f
      UNION ALL SELECT file, 'LessThanEquals', (CASE WHEN i % 2 = 0 THEN 1 ELSE 0 END) + (CASE WHEN i % 3 <> 1 THEN 1 ELSE 0 END) FROM f
      UNION ALL SELECT file, 'Semicolon', 11 + (CASE WHEN i % 4 = 0 THEN 1 ELSE 0 END) + (CASE WHEN i % 5 = 0 THEN 1 ELSE 0 END) + (CASE WHEN i % 7 = 0 THEN 1 ELSE 0 END) + (CASE WHEN i % 6 = 1 THEN 1 ELSE 0 END) FROM f
      UNION ALL SELECT file, 'BeginKeyword', 3 + (CASE WHEN i % 5 = 1 THEN 1 ELSE 0 END) FROM f
      UNION ALL SELECT file, 'EndKeyword', 3 + (CASE WHEN i % 5 = 1 THEN 1 ELSE 0 END) FROM f)
      SELECT file, kind, CAST(n AS BIGINT) AS n FROM n WHERE n > 0"""
    out["module_references"] = "SELECT CASE WHEN c_custkey % 2 = 1 THEN 'top_' || (c_custkey + 1) ELSE 'other_' || c_custkey END AS name, 'f' || c_custkey || '.sv' AS file, CAST(24 AS INTEGER) AS line, CAST(3 AS INTEGER) AS col FROM customer"
    out["module_scopes"] = "SELECT 'top_' || c_custkey AS name, 'f' || c_custkey || '.sv' AS file, CAST(2 AS INTEGER) AS line, CAST(1 AS INTEGER) AS col, 'global' AS parent_id FROM customer"
    whole = f"WITH {_F}, p AS ({_predicted(_SYNTAX + _SYMBOL + _MODULE)})"
    out["diagnostics_formatted"] = f"{whole} SELECT file || ':' || line || ':' || col || ' - [' || code || '] ' || message AS text FROM p"
    out["diagnostics_summary"] = f"{whole} SELECT code, count(*) AS n FROM p GROUP BY code"
    return out

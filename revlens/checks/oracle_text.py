"""DuckDB CTEs for the synthetic text sources (files, lines, diffs, answers)
and the text operators built on them."""

from __future__ import annotations

TOP = "['internal/auth','api/handler','cmd','deploy/helm','pkg/util','migration']"
EXT = "['go','py','ts','php']"


def _file_cols(k: str) -> str:
    return f"""{TOP}[{k} % 6 + 1] AS top,
         CASE WHEN {k} % 6 = 3 THEN 'yaml' ELSE {EXT}[{k} % 4 + 1] END AS ext,
         'm' || CAST({k} % 7 AS VARCHAR) AS sub, 'file' || CAST({k} AS VARCHAR) AS base"""


def path_expr(k: str) -> str:
    return (f"({TOP}[{k} % 6 + 1] || '/m' || CAST({k} % 7 AS VARCHAR) || '/file' || CAST({k} AS VARCHAR)"
            f" || '.' || CASE WHEN {k} % 6 = 3 THEN 'yaml' ELSE {EXT}[{k} % 4 + 1] END)")


FILES_BASE = f"""
  SELECT part_key, k, 'org/repo-' || CAST(part_key % 25 AS VARCHAR) AS repo_full_name,
         {_file_cols('k')},
         CAST(floor(k / 2) AS BIGINT) AS k2
  FROM (SELECT p_partkey AS part_key, CAST(floor(p_partkey / 25) AS BIGINT) AS k FROM part)"""

CODE_LINES = f"""
  list_concat(
    [CASE ext WHEN 'go' THEN 'package ' || sub WHEN 'py' THEN '# module ' || base
              WHEN 'ts' THEN '// module ' || base ELSE '<?php' END,
     CASE ext WHEN 'go' THEN 'import "' || repo_full_name || '/' || {TOP}[k2 % 6 + 1] || '/m' || CAST(k2 % 7 AS VARCHAR) || '"'
              WHEN 'py' THEN 'from ' || translate({TOP}[k2 % 6 + 1], '/', '.') || ' import m' || CAST(k2 % 7 AS VARCHAR)
              WHEN 'ts' THEN 'import * as m' || CAST(k2 % 7 AS VARCHAR) || ' from "' || {TOP}[k2 % 6 + 1] || '/m' || CAST(k2 % 7 AS VARCHAR) || '"'
              ELSE 'use ' || translate({TOP}[k2 % 6 + 1], '/', '\\') || '\\m' || CAST(k2 % 7 AS VARCHAR) || ';' END],
    flatten(list_transform(range(1, CAST(1 + k % 3 AS BIGINT) + 1), lambda j: list_concat(
      [CASE ext
         WHEN 'go' THEN 'func ' ELSE '' END
       || CASE ext WHEN 'py' THEN 'def ' WHEN 'ts' THEN 'export function ' WHEN 'php' THEN 'public function ' ELSE '' END
       || CASE WHEN j % 2 = 1 THEN 'Handle' ELSE 'helper' END || '_' || CAST(k AS VARCHAR) || '_' || CAST(j AS VARCHAR)
       || '(' || array_to_string(list_transform(range(1, (k + j) % 7 + 1), lambda q:
              CASE ext WHEN 'go' THEN 'a' || CAST(q AS VARCHAR) || ' int'
                       WHEN 'ts' THEN 'a' || CAST(q AS VARCHAR) || ': number'
                       WHEN 'php' THEN '$a' || CAST(q AS VARCHAR)
                       ELSE 'a' || CAST(q AS VARCHAR) END), ', ')
       || CASE ext WHEN 'go' THEN ') error {{' WHEN 'py' THEN '):' ELSE ') {{' END],
      list_transform(range(1, 2 + (k * j) % 40 + 1), lambda i:
        CASE WHEN i = 1 THEN '    m' || CAST(k2 % 7 AS VARCHAR) || '.Handle_' || CAST(k2 AS VARCHAR) || '_1(a)'
             WHEN i = 2 THEN '    helper_' || CAST(k AS VARCHAR) || '_2(a)'
             ELSE '    v' || CAST(i AS VARCHAR) || ' = ' || CAST(i AS VARCHAR) END),
      CASE WHEN ext = 'py' THEN []::VARCHAR[] ELSE ['}}'] END))))"""

FILES_CTE = ("files", f"""
  SELECT part_key, repo_full_name,
         top || '/' || sub || '/' || base || '.' || ext AS path, ext,
         array_to_string(CASE WHEN ext = 'yaml'
              THEN ['kind: Deployment', 'metadata:', '  name: ' || base, 'spec:',
                    '  replicas: ' || CAST(1 + k % 5 AS VARCHAR)]
              ELSE {CODE_LINES} END, chr(10)) AS content,
         false AS is_test
  FROM ({FILES_BASE})
  UNION ALL
  SELECT part_key, repo_full_name,
         CASE WHEN k % 2 = 0 OR ext = 'go' THEN '' ELSE 'tests/' END || top || '/' || sub || '/' ||
         CASE ext WHEN 'go' THEN base || '_test.go' WHEN 'py' THEN 'test_' || base || '.py'
                  WHEN 'ts' THEN base || '.test.ts' ELSE base || 'Test.php' END,
         ext, '// tests for ' || base || chr(10) || 'assert Handle_' || CAST(k AS VARCHAR) || '_1', true
  FROM ({FILES_BASE}) WHERE k % 3 = 0 AND k % 6 <> 3""".replace("{{", "{").replace("}}", "}"))

LINES_CTE = ("file_lines", """
  SELECT repo_full_name, path, ext, is_test, CAST(u.i AS INTEGER) AS line_no, u.text
  FROM files, unnest(string_split(content, chr(10))) WITH ORDINALITY AS u(text, i)""")


def _hunk_header() -> str:
    c = "(1 + (3 * CAST(floor(l_quantity) AS BIGINT)) % 60)"
    d = "(2 * l_linenumber)"
    return (f"CASE WHEN l_linenumber % 4 = 0 THEN '@@ -' || CAST({c} AS VARCHAR) || ' +' || CAST({c} AS VARCHAR) || ' @@' "
            f"ELSE '@@ -' || CAST({c} AS VARCHAR) || ',' || CAST({d} AS VARCHAR) || ' +' || CAST({c} AS VARCHAR) "
            f"|| ',' || CAST({d} AS VARCHAR) || ' @@' END")


_FILE = "CAST(floor(l_partkey / 25) AS BIGINT)"
DIFFS_CTE = ("diffs", f"""
  SELECT l_orderkey AS pull_request_id,
         'org/repo-' || CAST(CAST(floor(l_orderkey / 3) AS BIGINT) % 25 AS VARCHAR) AS repo_full_name,
         string_agg('diff --git a/' || {path_expr(_FILE)} || ' b/' || {path_expr(_FILE)}
                    || chr(10) || '--- a/' || {path_expr(_FILE)} || chr(10) || '+++ b/'
                    || {path_expr(_FILE)} || chr(10) || {_hunk_header()} || chr(10)
                    || '+changed line ' || CAST(l_linenumber AS VARCHAR), chr(10)
                    ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS diff
  FROM lineitem GROUP BY l_orderkey""")

_CATS = "['security','logic','test_coverage','style','performance']"
_SEVS = "['critical','high','medium','low','info']"
_C = "(1 + (3 * CAST(floor(l_quantity) AS BIGINT)) % 60)"
_START = f"(CASE WHEN l_partkey % 23 = 0 THEN {_C} + 500 WHEN l_partkey % 31 <> 0 THEN {_C} + l_linenumber % 2 END)"
_END = f"({_START} + CASE WHEN l_partkey % 37 = 0 THEN 500 ELSE 1 END)"
_SCORE = "(CASE WHEN l_partkey % 19 = 0 THEN 1.5 ELSE round(l_discount * 10, 2) END)"
_TIER = (f"(CASE WHEN l_partkey % 29 = 0 THEN 'low' WHEN {_SCORE} >= 0.8 THEN 'high' WHEN {_SCORE} >= 0.5 THEN 'medium' "
         f"ELSE 'low' END)")

ANSWERS_CTE = ("answers", f"""
  SELECT task_id, o AS pull_request_id, file_path, raw, CAST(ceil(strlen(raw) / 3.33) AS BIGINT) AS completion_tokens
  FROM (SELECT task_id, o, file_path,
               CASE o % 4 WHEN 0 THEN payload
                          WHEN 1 THEN '```json' || chr(10) || payload || chr(10) || '```'
                          WHEN 2 THEN 'Here is my review.' || chr(10) || '```json' || chr(10) || payload
                                      || chr(10) || '```' || chr(10) || 'Done.'
                          ELSE CASE WHEN o % 20 = 3 THEN left(payload, length(payload) - 1)
                               ELSE left(payload, length(payload) - 1) || chr(10) || '```json' || chr(10) || payload
                                    || chr(10) || '```' END END AS raw
        FROM (SELECT l_orderkey * 10 + l_linenumber AS task_id, l_orderkey AS o, {path_expr('CAST(floor(min(l_partkey) / 25) AS BIGINT)')} AS file_path,
                     '{{"findings":[' || string_agg(
                       '{{"category":"' || CASE WHEN l_partkey % 17 = 0 THEN 'bogus'
                                                ELSE {_CATS}[l_suppkey % 5 + 1] END
                       || '","severity":"' || {_SEVS}[l_linenumber % 5 + 1]
                       || '","confidence_tier":"' || {_TIER}
                       || '","confidence_score":' || CAST({_SCORE} AS VARCHAR)
                       || ',"start_line":' || coalesce(CAST({_START} AS VARCHAR), 'null')
                       || ',"end_line":' || coalesce(CAST({_END} AS VARCHAR), 'null')
                       || ',"title":"Issue ' || CAST(l_suppkey AS VARCHAR)
                       || '","body":"Check value ' || CAST(CAST(floor(l_quantity) AS BIGINT) AS VARCHAR)
                       || '"}}', ',' ORDER BY l_partkey, l_suppkey, l_quantity) || ']}}' AS payload
              FROM lineitem GROUP BY l_orderkey, l_linenumber))""".replace("{{", "{").replace("}}", "}"))

TEXT_CTES = [FILES_CTE, LINES_CTE, DIFFS_CTE, ANSWERS_CTE]

"""DuckDB CTEs for the code index by head: file versions, symbols with kinds and ends,
changed symbols, tasks not reviewed yet, references.

Written from the rules, line by line over exploded lines with windows and joins, where
the Spark side folds a file's lines inside its row.
"""

from __future__ import annotations

from .oracle_text import CODE_LINES, FILES_BASE

_CODE = CODE_LINES.replace("{{", "{").replace("}}", "}")
_IDENT = "[A-Za-z_][A-Za-z0-9_]*"
_CALL = "'m' || (k2 % 7) || '.Handle_' || k2 || '_1(a)'"

_KINDS = f"""CASE ext
  WHEN 'go' THEN ['const Max' || k || ' = 1', 'type Box' || k || ' struct {{', '    size int', '}}',
    'func (b *Box' || k || ') Grow' || k || '(a int, c int) int {{', '    if a {{', '        v1 = 1', '    }}', '    v2 = 2',
    '    ' || {_CALL}, '}}']
  WHEN 'py' THEN ['MAX_' || k || ' = 1', 'class Box' || k || ':', '    def grow' || k || '(self, a):', '        if a:',
    '            v1 = 1', '        v2 = 2', '        ' || {_CALL}, '    class Inner' || k || ':',
    '        def deep' || k || '(self):', '            v3 = 3', '']
  WHEN 'ts' THEN ['export interface Shape' || k || ' {{', '    area(): number;', '}}', 'export class Box' || k || ' {{',
    '    grow' || k || '(a: number): number {{', '        if (a) {{', '            v1 = 1', '        }}', '        v2 = 2', '    }}', '}}']
  ELSE ['interface Shape' || k || ' {{', '}}', 'class Box' || k, '{{', '    const SIZE' || k || ' = 3;',
    '    public function grow' || k || '($a) {{', '        v1 = 1', '        v2 = 2', '    }}', '}}', ''] END""".replace("{{", "{").replace("}}", "}")

_MOD = r"(?:(?:public|private|protected|static|final|abstract|async|readonly)\s+)*"
#: Per language (kind, pattern of name and parameters).
_DECLARED = [
    ("go", "method", rf"^func\s+\([^)]*\)\s*({_IDENT})\s*\(([^)]*)\)"), ("go", "func", rf"^func\s+({_IDENT})\s*\(([^)]*)\)"),
    ("go", "interface", rf"^type\s+({_IDENT})\s+interface\b()"), ("go", "type", rf"^type\s+({_IDENT})\s+\S()"),
    ("go", "const", rf"^const\s+({_IDENT})\b()"),
    ("py", "class", rf"^\s*class\s+({_IDENT})()"), ("py", "func", rf"^\s*(?:async\s+)?def\s+({_IDENT})\s*\(([^)]*)\)"),
    ("py", "const", r"^([A-Z][A-Z0-9_]*)\s*=()"),
    ("ts", "interface", rf"^\s*(?:export\s+)?interface\s+({_IDENT})()"), ("ts", "class", rf"^\s*(?:export\s+)?class\s+({_IDENT})()"),
    ("ts", "func", rf"^\s*(?:export\s+)?function\s+({_IDENT})\s*\(([^)]*)\)"), ("ts", "const", rf"^(?:export\s+)?const\s+({_IDENT})\b()"),
    ("ts", "method", rf"^\s+{_MOD}({_IDENT})\s*\(([^)]*)\)[^;{{]*\{{"),
    ("php", "interface", rf"^\s*interface\s+({_IDENT})()"), ("php", "class", rf"^\s*class\s+({_IDENT})()"),
    ("php", "func", rf"^\s*{_MOD}function\s+({_IDENT})\s*\(([^)]*)\)"), ("php", "const", rf"^\s*{_MOD}const\s+({_IDENT})\b()"),
]


def _first(value: str) -> str:
    """CASE over the patterns; ``value`` may use {kind} and {pattern}."""
    whens = "\n".join(f"WHEN ext = '{ext}' AND regexp_matches(text, '{p}')"
                      + (f" AND regexp_extract(text, '{p}', 1) NOT IN ('if','for','while','switch','catch','function','return')"
                         if (ext, kind) == ("ts", "method") else "") + f" THEN {value.replace('{kind}', kind).replace('{pattern}', p)}"
                    for ext, kind, p in _DECLARED)
    return f"CASE {whens} END"


_KEY = "part_key, external_pr_id, from_head"
_SAME = "{a}.part_key = {b}.part_key AND {a}.external_pr_id IS NOT DISTINCT FROM {b}.external_pr_id AND {a}.from_head IS NOT DISTINCT FROM {b}.from_head"


def _same(a: str, b: str) -> str:
    return _SAME.format(a=a, b=b)


VERSION_CTES = [
    ("vfiles", f"""
  SELECT part_key, repo_full_name, ext, top || '/' || sub || '/' || base || '.' || ext AS path,
         CASE WHEN ext = 'yaml' THEN ['kind: Deployment', 'metadata:', '  name: ' || base, 'spec:',
                                      '  replicas: ' || CAST(1 + k % 5 AS VARCHAR)]
              ELSE list_concat(({_CODE})[1:2], {_KINDS}, ({_CODE})[3:]) END AS lines
  FROM ({FILES_BASE})"""),
    ("vedits", """
  SELECT DISTINCT CAST(floor(l_orderkey / 3) AS BIGINT) AS external_pr_id,
         CAST(floor(l_partkey / 25) * 25 + CAST(floor(l_orderkey / 3) AS BIGINT) % 25 AS BIGINT) AS part_key,
         l_orderkey AS o, l_linenumber AS ln, CAST(1 + (3 * CAST(floor(l_quantity) AS BIGINT)) % 60 AS BIGINT) AS c
  FROM lineitem"""),
    ("vheads", """
  SELECT external_pr_id, part_key, o AS from_head, lead(o) OVER (PARTITION BY external_pr_id, part_key ORDER BY o) AS to_head
  FROM (SELECT DISTINCT external_pr_id, part_key, o FROM vedits)"""),
    ("vbase", """
  SELECT part_key, repo_full_name, path, ext, NULL::BIGINT AS external_pr_id, NULL::BIGINT AS from_head, NULL::BIGINT AS to_head, lines FROM vfiles
  UNION ALL
  SELECT part_key, repo_full_name, path, ext, h.external_pr_id, h.from_head, h.to_head, lines FROM vheads h JOIN vfiles USING (part_key)"""),
    ("vlast", """
  SELECT h.external_pr_id, h.part_key, h.from_head, e.c, max({'o': e.o, 'ln': e.ln}) AS e
  FROM vheads h JOIN vedits e ON e.external_pr_id = h.external_pr_id AND e.part_key = h.part_key AND e.o <= h.from_head
  GROUP BY ALL"""),
    ("vlines", r"""
  SELECT b.part_key, b.repo_full_name, b.path, b.ext, b.external_pr_id, b.from_head, b.to_head, b.line_no,
         CASE WHEN l.e IS NOT NULL AND regexp_matches(b.text, '^\s+v[0-9]+ = ')
              THEN regexp_extract(b.text, '^(\s+v[0-9]+ = )', 1) || 'edited ' || l.e.o || '-' || l.e.ln ELSE b.text END AS text
  FROM (SELECT part_key, repo_full_name, path, ext, external_pr_id, from_head, to_head, CAST(u.i AS INTEGER) AS line_no, u.text
        FROM vbase, unnest(lines) WITH ORDINALITY AS u(text, i)) b
  LEFT JOIN vlast l ON l.external_pr_id = b.external_pr_id AND l.part_key = b.part_key AND l.from_head = b.from_head AND l.c = b.line_no"""),
    ("versions", """
  SELECT repo_full_name, path, ext, external_pr_id, from_head, to_head, part_key,
         string_agg(text, chr(10) ORDER BY line_no) AS content, max(line_no) AS n_lines
  FROM vlines GROUP BY ALL"""),
    ("vdepth", f"""
  SELECT *, sum(opened - closed) OVER w AS after_, sum(opened - closed) OVER w - (opened - closed) AS before_
  FROM (SELECT *, length(text) - length(replace(text, '{{', '')) AS opened, length(text) - length(replace(text, '}}', '')) AS closed,
               CASE WHEN trim(text) <> '' THEN length(text) - length(ltrim(text)) END AS indent FROM vlines WHERE ext <> 'yaml')
  WINDOW w AS (PARTITION BY {_KEY} ORDER BY line_no)"""),
    ("vdecl", f"""
  SELECT *, lead(line_no) OVER (PARTITION BY {_KEY} ORDER BY line_no) AS following
  FROM (SELECT *, {_first("'{kind}'")} AS kind, {_first("regexp_extract(text, '{pattern}', 1)")} AS name,
               {_first("regexp_extract(text, '{pattern}', 2)")} AS params FROM vdepth) WHERE kind IS NOT NULL"""),
    ("vopen", f"""
  SELECT d.part_key, d.external_pr_id, d.from_head, d.line_no,
         min(l.line_no) FILTER (WHERE l.opened > 0 AND (d.following IS NULL OR l.line_no < d.following)) AS opening,
         min(l.line_no) FILTER (WHERE l.line_no > d.line_no AND l.indent <= d.indent) AS shallower
  FROM vdecl d JOIN vdepth l ON {_same('d', 'l')} AND l.line_no >= d.line_no GROUP BY ALL"""),
    ("vends", f"""
  SELECT d.*, CASE WHEN d.kind = 'const' THEN d.line_no WHEN d.ext = 'py' THEN e.block WHEN e.opening IS NULL THEN d.line_no
                   ELSE coalesce(e.brace, v.n_lines) END AS end_line
  FROM vdecl d
  JOIN (SELECT o.part_key, o.external_pr_id, o.from_head, o.line_no, o.opening,
               min(l.line_no) FILTER (WHERE l.line_no >= o.opening AND l.after_ <= d.before_) AS brace,
               max(l.line_no) FILTER (WHERE l.indent IS NOT NULL AND (o.shallower IS NULL OR l.line_no < o.shallower)) AS block
        FROM vopen o JOIN vdecl d ON {_same('o', 'd')} AND o.line_no = d.line_no
        JOIN vdepth l ON {_same('o', 'l')} AND l.line_no >= o.line_no GROUP BY ALL) e
    ON {_same('e', 'd')} AND e.line_no = d.line_no
  JOIN versions v ON {_same('v', 'd')}"""),
    ("vnested", f"""
  SELECT d.*, p.kind AS around_kind, p.name AS around
  FROM vends d LEFT JOIN (
    SELECT d.part_key, d.external_pr_id, d.from_head, d.line_no, arg_max(p.kind, p.line_no) AS kind, arg_max(p.name, p.line_no) AS name
    FROM vends d JOIN vends p ON {_same('d', 'p')} AND p.line_no < d.line_no AND p.end_line >= d.end_line GROUP BY ALL) p
  ON {_same('p', 'd')} AND p.line_no = d.line_no"""),
    ("vsymbols", rf"""
  SELECT d.repo_full_name, d.external_pr_id, d.path, d.ext, d.from_head, d.to_head, d.name, d.kind, d.parent, d.start_line, d.end_line,
         CASE WHEN d.kind IN ('func','method') THEN CASE WHEN trim(d.params) = '' THEN 0 ELSE len(string_split(d.params, ',')) END END AS param_count,
         regexp_matches(d.name, '^[A-Z]') AS exported,
         sha256(trim(regexp_replace(array_to_string(string_split(v.content, chr(10))[d.start_line:d.end_line], chr(10)), '\s+', ' ', 'g'))) AS content_hash,
         CASE WHEN d.parent IS NULL THEN d.name ELSE d.parent || '.' || d.name END AS symbol
  FROM (SELECT *, line_no AS start_line, inside_ AS _i, CASE WHEN inside_ THEN around END AS parent
        FROM (SELECT * REPLACE (CASE WHEN kind = 'func' AND coalesce(around_kind IN ('class','interface','type'), false) THEN 'method' ELSE kind END AS kind),
                     coalesce(around_kind IN ('class','interface','type'), false) AS inside_ FROM vnested
              WHERE NOT (kind = 'const' AND around_kind IS NOT NULL AND around_kind NOT IN ('class','interface','type'))
                AND NOT (kind = 'method' AND ext = 'ts' AND NOT coalesce(around_kind IN ('class','interface','type'), false)))) d
  JOIN versions v ON {_same('v', 'd')}"""),
    ("vchanged", """
  SELECT s.*, CAST(sum(least(s.end_line, h."end") - greatest(s.start_line, h.start) + 1) AS BIGINT) AS changed_lines
  FROM hunks h JOIN vsymbols s ON s.external_pr_id = CAST(floor(h.pull_request_id / 3) AS BIGINT) AND s.path = h.path
   AND h.pull_request_id <= s.from_head AND s.start_line <= h."end" AND s.end_line >= h.start
  GROUP BY ALL"""),
]


def task_ctes(path_risk, sec_path) -> list[tuple[str, str]]:
    """Candidate tasks of every head and what was reviewed before."""
    return [
        ("vat", """
  SELECT c.*, p.id AS pull_request_id, t.test_path IS NOT NULL AS has_tests
  FROM vchanged c JOIN pull_requests p ON p.external_pr_id = c.external_pr_id AND p.id >= c.from_head AND (c.to_head IS NULL OR p.id < c.to_head)
  LEFT JOIN test_map t ON t.path = c.path AND t.repo_full_name = c.repo_full_name"""),
        ("vscored", f"""
  SELECT *, round(least({path_risk('path')} + CASE WHEN exported THEN 0.1 ELSE 0.0 END
           + CASE WHEN kind IN ('func','method') THEN 0.05 ELSE 0.0 END
           + CASE WHEN coalesce(param_count, 0) > 5 THEN 0.1 WHEN coalesce(param_count, 0) > 3 THEN 0.05 ELSE 0.0 END
           + CASE WHEN NOT has_tests THEN 0.15 ELSE 0.0 END
           + CASE WHEN changed_lines > 50 THEN 0.2 WHEN changed_lines > 20 THEN 0.1 ELSE 0.0 END, 1.0), 4) AS risk_score,
         count(*) OVER (PARTITION BY pull_request_id) AS n FROM vat"""),
        ("vtasks", f"""
  SELECT pull_request_id, external_pr_id, path, symbol, start_line, risk_score, content_hash,
         unnest(list_filter([CASE WHEN {sec_path('path')} OR (exported AND regexp_matches(lower(name), 'handle|serve')) THEN 'security' END,
           'logic', CASE WHEN NOT has_tests THEN 'test_coverage' END,
           CASE WHEN end_line - start_line > 30 OR coalesce(param_count, 0) > 5 THEN 'style' END], lambda x: x IS NOT NULL)) AS task_type
  FROM vscored WHERE risk_score >= 0.3 OR n < 5
  UNION ALL
  SELECT p.id, v.external_pr_id, v.path, '', 0, {path_risk('v.path')},
         sha256(trim(regexp_replace(v.content, '\\s+', ' ', 'g'))), 'logic'
  FROM versions v JOIN pull_requests p ON p.external_pr_id = v.external_pr_id AND p.id >= v.from_head AND (v.to_head IS NULL OR p.id < v.to_head)
  WHERE NOT EXISTS (SELECT 1 FROM vchanged c WHERE c.external_pr_id = v.external_pr_id AND c.path = v.path AND c.from_head = v.from_head)"""),
        ("voutcomes", """
  SELECT l.pull_request_id, l.path FROM review_tasks t
  JOIN (SELECT o AS pull_request_id, path, min(ln) AS ln
        FROM (SELECT l_orderkey AS o, l_linenumber AS ln, CAST(floor(l_partkey / 25) AS BIGINT) AS k FROM lineitem) x
        JOIN (SELECT DISTINCT CAST(floor(p / 25) AS BIGINT) AS k, path FROM (SELECT part_key AS p, path FROM vfiles)) f ON f.k = x.k
        GROUP BY 1, 2) l ON t.id = l.pull_request_id * 10 + l.ln
  WHERE t.status = 'completed'"""),
    ]


def cone_ctes(go: str, py: str, ts: str, php: str) -> list[tuple[str, str]]:
    """References of every version and the cone of changed symbols."""
    same = "{a}.part_key = {b}.part_key AND {a}.external_pr_id IS NOT DISTINCT FROM {b}.external_pr_id AND {a}.from_head IS NOT DISTINCT FROM {b}.from_head"
    return [
        ("vimps", r"""
  SELECT DISTINCT part_key, external_pr_id, from_head, package, regexp_extract(package, '([^/]+)$', 1) AS alias
  FROM (SELECT part_key, external_pr_id, from_head,
               CASE ext
                 WHEN 'go' THEN regexp_replace(regexp_extract(text, '^import\s+"([^"]+)"', 1), '^[^/]+/[^/]+/', '')
                 WHEN 'py' THEN concat_ws('/', translate(regexp_extract(text, '^from\s+([A-Za-z0-9_.]+)\s+import\s+', 1), '.', '/'),
                                          regexp_extract(text, '^from\s+[A-Za-z0-9_.]+\s+import\s+([A-Za-z0-9_]+)', 1))
                 WHEN 'ts' THEN regexp_extract(text, '^import\s+\*\s+as\s+[A-Za-z0-9_]+\s+from\s+"([^"]+)"', 1)
                 WHEN 'php' THEN translate(regexp_extract(text, '^use\s+([A-Za-z0-9_\\]+);', 1), '\', '/') END AS package
        FROM vlines) WHERE regexp_extract(package, '([^/]+)$', 1) <> ''"""),
        ("vbody", f"""
  SELECT * FROM vlines WHERE ext <> 'yaml' AND {_first("1")} IS NULL
    AND NOT coalesce(CASE ext WHEN 'go' THEN regexp_matches(text, '{go}') WHEN 'py' THEN regexp_matches(text, '{py}')
                              WHEN 'ts' THEN regexp_matches(text, '{ts}') WHEN 'php' THEN regexp_matches(text, '{php}') END, false)"""),
        ("vrefs", f"""
  SELECT DISTINCT c.repo_full_name, c.external_pr_id, c.from_head, c.to_head, c.path AS importer, c.line_no, c.text, i.package, c.name
  FROM (SELECT *, split_part(m, '.', 1) AS alias, regexp_replace(split_part(m, '.', 2), '\\($', '') AS name
        FROM (SELECT *, unnest(regexp_extract_all(text, '{_IDENT}\\.{_IDENT}\\(')) AS m FROM vbody)) c
  JOIN vimps i ON {same.format(a='i', b='c')} AND i.alias = c.alias
  UNION
  SELECT DISTINCT c.repo_full_name, c.external_pr_id, c.from_head, c.to_head, c.path, c.line_no, c.text, i.package, c.name
  FROM (SELECT *, unnest(regexp_extract_all(text, '(?:^|[^.A-Za-z0-9_])({_IDENT})\\(', 1)) AS name FROM vbody) c
  JOIN vimps i ON {same.format(a='i', b='c')}"""),
        ("vown", """
  SELECT external_pr_id, repo_full_name, path AS importer, min(from_head) AS first_own FROM versions WHERE external_pr_id IS NOT NULL GROUP BY ALL"""),
        ("vcone", r"""
  SELECT DISTINCT * FROM (
    SELECT c.external_pr_id, c.path, c.symbol, greatest(c.from_head, r.from_head) AS from_head, least(c.to_head, r.to_head) AS to_head,
           r.importer, r.line_no, r.text
    FROM vchanged c JOIN vrefs r ON r.external_pr_id = c.external_pr_id AND r.repo_full_name = c.repo_full_name
     AND r.package = regexp_extract(c.path, '^(.*)/[^/]+$', 1) AND r.name = c.name
    UNION ALL
    SELECT c.external_pr_id, c.path, c.symbol, c.from_head, least(c.to_head, o.first_own), r.importer, r.line_no, r.text
    FROM vchanged c JOIN vrefs r ON r.external_pr_id IS NULL AND r.repo_full_name = c.repo_full_name
     AND r.package = regexp_extract(c.path, '^(.*)/[^/]+$', 1) AND r.name = c.name
    LEFT JOIN vown o ON o.external_pr_id = c.external_pr_id AND o.repo_full_name = c.repo_full_name AND o.importer = r.importer)
  WHERE to_head IS NULL OR from_head < to_head"""),
    ]

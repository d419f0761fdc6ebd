"""Common table expressions: files, lines, checks, findings. Written against the given tables only."""

from __future__ import annotations

import re

from lintlake import fixed_values as fv
from lintlake.sources.fixtures import SNIPPETS


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def values(items: list[str]) -> str:
    return "(" + ", ".join(lit(i) for i in items) + ")"


WS = "||".join(f"chr({ord(c)})" for c in fv.WHITESPACE)
LF = "chr(10)"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def indent(x: str) -> str:
    return f"(length({x}) - length(ltrim({x}, {WS})))"


def any_contains(x: str, needles: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(n)})" for n in needles) + ")"


def any_starts(x: str, needles: list[str]) -> str:
    return "(" + " OR ".join(f"starts_with({x}, {lit(n)})" for n in needles) + ")"


def any_ends(x: str, needles: list[str]) -> str:
    return "(" + " OR ".join(f"ends_with({x}, {lit(n)})" for n in needles) + ")"


def fill(template: str | None, **exprs: str) -> str:
    if template is None:
        return "NULL"
    parts = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if i % 2:
            parts.append(f"CAST({exprs[piece]} AS VARCHAR)")
        elif piece:
            parts.append(lit(piece))
    return " || ".join(parts) if parts else "''"


BASE = "regexp_extract({p}, '([^/]*)$', 1)"


def base(p: str) -> str:
    return BASE.format(p=p)


def suffix(p: str) -> str:
    return f"regexp_extract({base(p)}, '^.+(\\.[^.]+)$', 1)"


_SNIPPET_ROWS = ", ".join(f"({s}, {lit(body)})" for s, body in SNIPPETS.items())

DOCS = """docs AS (
  SELECT source AS repo, lang || '/' || doc_id || '.txt' AS path, text AS content,
         CAST(octet_length(encode(text)) AS BIGINT) AS size, doc_id
  FROM documents)"""

PAGES = """page_files AS (
  SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS repo, page_id || '.html' AS path, html AS content,
         CAST(octet_length(encode(html)) AS BIGINT) AS size, page_id AS doc_id
  FROM pages)"""

CODE_RAW = f"""snippets(s, body) AS (VALUES {_SNIPPET_ROWS}),
numbered_docs AS (
  SELECT source AS repo, doc_id, doc_id % 20 AS r, doc_id // 20 AS o,
         CASE WHEN doc_id % 20 >= 14 THEN 14
              WHEN doc_id % 20 >= 10 AND (doc_id // 20) % 16 <> 0 THEN 14
              ELSE (doc_id // 20 + doc_id % 20) % 14 END AS s
  FROM documents),
placed AS (
  SELECT repo, doc_id, r, o, replace(body, '{{id}}', CAST(doc_id AS VARCHAR)) AS body
  FROM numbered_docs JOIN snippets USING (s)),
code_raw AS (
  SELECT repo, doc_id, path, content, CAST(octet_length(encode(content)) AS BIGINT) AS size FROM (
    SELECT repo, doc_id,
      CASE WHEN o = 0 AND r % 3 <> 0 THEN 'README.md'
           WHEN o = 0 THEN 'notes.txt'
           WHEN o = 1 AND r % 4 IN (1, 2, 3) THEN '.gitignore'
           WHEN o = 1 THEN 'docs/info.md'
           WHEN o = 2 AND r % 5 IN (0, 1) THEN 'pyproject.toml'
           WHEN o = 2 AND r % 5 = 2 THEN 'package.json'
           WHEN o = 2 AND r % 5 = 3 THEN 'next.config.js'
           WHEN o = 2 THEN 'index.html'
           WHEN o = 3 AND r % 6 = 0 THEN '.env'
           WHEN o = 3 AND r % 6 = 1 THEN 'node_modules/pkg/index.js'
           WHEN o = 3 THEN 'settings.py'
           WHEN o = 4 AND r % 3 = 0 THEN '.github/workflows/ci.yml'
           WHEN o = 4 AND r % 3 = 1 THEN 'run.sh'
           WHEN o = 4 THEN 'app_gui.py'
           WHEN o = 5 AND r % 4 < 2 THEN 'tests/test_core.py'
           WHEN o = 5 THEN 'lib/data.bin'
           WHEN o = 6 AND r = 18 THEN 'src/edge.py'
           WHEN o = 6 AND r = 19 THEN 'src/big.py'
           WHEN r % 10 = 7 AND o % 4 = 2 THEN 'tests/test_' || doc_id || '.py'
           WHEN r % 2 = 0 AND o % 4 IN (0, 3) THEN 'mod_' || doc_id || '.py'
           WHEN o % 4 = 2 THEN 'src/core/mod_' || doc_id || '.py'
           ELSE 'src/mod_' || doc_id || '.py' END AS path,
      CASE WHEN o = 0 AND r % 3 <> 0
             THEN '# Project ' || r || {LF} || {LF} || 'Service number ' || r || ' for invoices.'
           WHEN o = 0 THEN 'notes'
           WHEN o = 1 AND r % 4 = 1 THEN ''
           WHEN o = 1 AND r % 4 IN (2, 3) THEN '.env' || {LF} || '*.pyc'
           WHEN o = 1 THEN 'docker deploy'
           WHEN o = 2 AND r % 5 IN (0, 1) THEN '[project]'
           WHEN o = 2 AND r % 5 = 2 THEN '{{}}'
           WHEN o = 2 AND r % 5 = 3 THEN 'module.exports = {{}}'
           WHEN o = 2 THEN '<html></html>'
           WHEN o = 3 AND r % 6 = 0 THEN 'A=1'
           WHEN o = 3 AND r % 6 = 1 THEN 'x'
           WHEN o = 3 THEN 'MODE = 1'
           WHEN o = 4 AND r % 3 = 0 THEN 'on: push'
           WHEN o = 4 AND r % 3 = 1 THEN 'echo'
           WHEN o = 4 THEN 'import tkinter'
           WHEN o = 5 AND r % 4 < 2 THEN 'def test_a():' || {LF} || '    assert True'
           WHEN o = 5 THEN '0'
           WHEN o = 6 AND r = 18 THEN repeat('x', 500000)
           WHEN o = 6 AND r = 19 THEN repeat('x', 500001)
           ELSE body END AS content
    FROM placed))"""

_NAME_OK = (f"(lower({suffix('path')}) IN {values(fv.CODE_SUFFIXES)} "
            f"OR starts_with({base('path')}, '.'))")
_DIR_OK = (f"NOT list_has_any(string_split(path, '/')[1:-2], "
           f"[{', '.join(lit(d) for d in fv.SKIP_DIRS)}])")

CODE = f"""code AS (
  SELECT repo, path, content, size, doc_id FROM code_raw
  WHERE size <= {fv.MAX_FILE_BYTES} AND {_NAME_OK} AND {_DIR_OK})"""

NAME_OK, DIR_OK = _NAME_OK, _DIR_OK


def lines_cte(files: str, name: str = "ln") -> str:
    return f"""{name} AS (
  SELECT repo, path, no, raw, {strip('raw')} AS txt FROM (
    SELECT repo, path, unnest(range(1, len(l) + 1)) AS no, unnest(l) AS raw
    FROM (SELECT repo, path, string_split(content, {LF}) AS l FROM {files})))"""


# --- checks: SELECT repo, check_id, file, severity, title, description, suggestion, line, code_before,
#     o_phase, o_path, o_check, o_sub ---------------------------------------------------------------

ANALYZER_OF = {"STR": 0, "REU": 1, "CLA": 2, "FUN": 3, "SEC": 4, "AUT": 5, "AST": 6}


def check(
    check_id: str, frm: str, *, line: str = "NULL", file: str = "path", severity: str | None = None,
    title: str | None = None, message: str | None = None, code_before: str = "NULL", phase: int = 0,
    ord_path: str = "path", order: int = 0, sub: str = "0", **exprs: str,
) -> str:
    sev, tit, desc, sugg = fv.MESSAGES[message or check_id]
    exprs = {"line": line, **exprs}
    return f"""SELECT repo, {lit(check_id)} AS check_id, {file} AS file,
       {severity or lit(sev)} AS severity, {title or fill(tit, **exprs)} AS title,
       {fill(desc, **exprs)} AS description, {fill(sugg, **exprs)} AS suggestion,
       CAST({line} AS INTEGER) AS line, CAST({code_before} AS VARCHAR) AS code_before,
       {phase} AS o_phase, {ord_path} AS o_path, {order} AS o_check, CAST({sub} AS INTEGER) AS o_sub
FROM {frm}"""


def _re2(p: str) -> str:
    """The patterns hold no class that differs on this data; the look-ahead is tested separately."""
    return p.replace("(?!.*Loader)", "")


def hits(files: str, patterns: list[tuple[str, str]], where: str = "TRUE") -> str:
    """(repo, path, p, k, title, line) of every pattern hit over the whole text."""
    def newlines(x: str) -> str:
        return f"(length({x}) - length(replace({x}, {LF}, '')))"

    one = []
    for i, (p, title) in enumerate(patterns):
        p = lit(_re2(p))
        loader = ""
        if "yaml" in p:
            loader = f" AND NOT contains(string_split(pieces[k + 1], {LF})[1], 'Loader')"
        one.append(f"""SELECT repo, path, {i} AS p, k, {lit(title)} AS title,
        1 + {newlines("array_to_string(pieces[1:k], '')")} + {newlines("array_to_string(found[1:k-1], '')")} AS line
      FROM (SELECT repo, path, found, pieces, unnest(range(1, len(found) + 1)) AS k
            FROM (SELECT repo, path, regexp_extract_all(content, {p}) AS found,
                         string_split_regex(content, {p}) AS pieces
                  FROM {files} WHERE {where} AND regexp_matches(content, {p})))
      WHERE TRUE{loader}""")
    body = "\n      UNION ALL\n      ".join(one)
    return f"(SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY p, k) - 1 AS sub FROM ({body}))"


_NUM = "row_number() OVER (PARTITION BY repo, path ORDER BY {by}) - 1"
_DEF = "^[\\s]*def ([\\p{L}\\p{N}_]+)"
_DEFC = "^[\\s]*(def|class) ([\\p{L}\\p{N}_]+)"


def sec1(files: str) -> str:
    skip = any_ends("path", fv.SECRET_SKIP_SUFFIXES)
    return check("SEC1", hits(files, fv.SECRET_PATTERNS, f"NOT {skip}"), line="line", title="title", sub="sub")


def sec2(files: str) -> str:
    return check("SEC2", hits(files, fv.UNSAFE_PATTERNS), line="line", title="title", order=1, sub="sub")


def fun1(ln: str = "ln") -> str:
    markers = ", ".join(f"({i}, {lit(m)})" for i, m in enumerate(fv.TODO_MARKERS))
    frm = f"""(SELECT l.*, m, {_NUM.format(by='no, i')} AS sub FROM {ln} l, (VALUES {markers}) t(i, m)
        WHERE contains(upper(raw), m) AND contains(raw, '#'))"""
    severity = f"CASE WHEN m IN {values(fv.TODO_MEDIUM_MARKERS)} THEN 'medium' ELSE 'low' END"
    return check("FUN1", frm, line="no", severity=severity, sub="sub", marker="m", text="txt")


def fun2(ln: str = "ln") -> str:
    quoted = f"(starts_with(x.txt, '\"\"\"') OR starts_with(x.txt, {lit(chr(39)*3)}))"
    count3 = lambda q: f"(length(x.txt) - length(replace(x.txt, {q}, ''))) = 6"
    single = f"({count3(lit(chr(34) * 3))} OR {count3(lit(chr(39) * 3))})"
    frm = f"""(SELECT *, {_NUM.format(by='no')} AS sub FROM (
      SELECT d.repo, d.path, d.no, regexp_extract(d.raw, '{_DEF}', 1) AS name,
        list_reduce(
          list_prepend({{'txt': '', 'in_doc': FALSE, 'body': CAST([] AS VARCHAR[])}},
            list(({{'txt': y.txt, 'in_doc': FALSE, 'body': CAST([] AS VARCHAR[])}}) ORDER BY y.no)),
          lambda a, x: CASE
            WHEN len(a.body) >= 2 THEN a
            WHEN {quoted} AND a.in_doc THEN {{'txt': '', 'in_doc': FALSE, 'body': a.body}}
            WHEN {quoted} AND {single} THEN a
            WHEN {quoted} THEN {{'txt': '', 'in_doc': TRUE, 'body': a.body}}
            WHEN a.in_doc OR x.txt = '' OR starts_with(x.txt, '#') THEN a
            ELSE {{'txt': '', 'in_doc': FALSE, 'body': list_append(a.body, x.txt)}} END).body AS body
      FROM {ln} d JOIN {ln} y ON y.repo = d.repo AND y.path = d.path AND y.no BETWEEN d.no + 1 AND d.no + 9
      WHERE regexp_matches(d.raw, '{_DEF}')
      GROUP BY d.repo, d.path, d.no, d.raw)
      WHERE len(body) = 2 AND body[1] IN {values(fv.STUB_BODIES)} AND {any_starts('body[2]', ['def ', 'class '])})"""
    return check("FUN2", frm, line="no", order=1, sub="sub", name="name", body="body[1]")


def fun3(ln: str = "ln") -> str:
    frm = f"""(SELECT *, {_NUM.format(by='no')} AS sub FROM (
        SELECT *, lead(txt) OVER (PARTITION BY repo, path ORDER BY no) AS following FROM {ln})
      WHERE txt IN {values(fv.BARE_EXCEPTS)} AND following = 'pass')"""
    return check("FUN3", frm, line="no", order=2, sub="sub")


def fun4(ln: str = "ln") -> str:
    word = "[\\p{L}\\p{N}_]+"
    is_import = any_starts("txt", ["import ", "from "])
    frm = f"""(WITH names AS (
        SELECT repo, path, no, 0 AS i, regexp_extract(txt, '^import ({word})', 1) AS name
        FROM {ln} WHERE regexp_matches(txt, '^import {word}')
        UNION ALL
        SELECT repo, path, no, i, name FROM (
          SELECT repo, path, no, i, {strip("string_split(" + strip("part") + ", ' as ')[-1]")} AS name FROM (
            SELECT repo, path, no, unnest(range(1, len(ps) + 1)) AS i, unnest(ps) AS part FROM (
              SELECT repo, path, no, string_split(regexp_extract(txt, '^from \\S+ import (.+)', 1), ',') AS ps
              FROM {ln} WHERE regexp_matches(txt, '^from \\S+ import .+'))))
        WHERE name <> '' AND name <> '*'),
      rest AS (
        SELECT repo, path, coalesce(string_agg(raw, {LF} ORDER BY no) FILTER (WHERE NOT {is_import}), '') AS body
        FROM {ln} GROUP BY repo, path)
      SELECT repo, path, list(name ORDER BY no, i) AS unused
      FROM names JOIN rest USING (repo, path)
      WHERE NOT contains(body, name) AND name <> '__'
      GROUP BY repo, path)"""
    return check("FUN4", frm, order=3, names="array_to_string(unused[1:5], ', ')", n="len(unused)")


def fun5(ln: str = "ln") -> str:
    frm = f"""(SELECT *, {_NUM.format(by='from_line')} AS sub FROM (
      SELECT x.repo, x.path, x.no AS from_line, x.txt AS jump, x.raw AS from_raw,
             arg_min(y.no, y.no) AS no, arg_min(y.raw, y.no) AS raw, arg_min(y.txt, y.no) AS txt
      FROM {ln} x JOIN {ln} y ON y.repo = x.repo AND y.path = x.path
           AND y.no BETWEEN x.no + 1 AND x.no + 4 AND y.txt <> ''
      WHERE x.txt IN {values(fv.JUMP_STATEMENTS)} OR starts_with(x.txt, 'return ')
      GROUP BY ALL)
      WHERE {indent('raw')} > {indent('from_raw')} AND NOT {any_starts('txt', fv.REACHABLE_STARTS)})"""
    return check("FUN5", frm, line="no", order=4, sub="sub", text="jump", from_line="from_line")


def cla1(ln: str = "ln") -> str:
    allowed = values(list(fv.ALLOWED_SINGLE_LETTERS))
    frm = f"""(SELECT *, {_NUM.format(by='no')} AS sub FROM (
      SELECT repo, path, no, list_filter(regexp_extract_all(raw, '\\b([a-z])\\s*=', 1),
                                         lambda m: m NOT IN {allowed}) AS bad
      FROM {ln} WHERE NOT starts_with(txt, '#') AND NOT starts_with(txt, 'def '))
      WHERE len(bad) > 0)"""
    return check("CLA1", frm, line="no", sub="sub", names="array_to_string(bad, ', ')")


def spans(ln: str = "ln") -> str:
    return f"""(SELECT d.repo, d.path, d.no, d.name,
        coalesce(lead(d.no) OVER (PARTITION BY d.repo, d.path ORDER BY d.no), n + 1) - d.no AS len
      FROM (SELECT repo, path, no, regexp_extract(raw, '{_DEF}', 1) AS name FROM {ln}
            WHERE regexp_matches(raw, '{_DEF}')) d
      JOIN (SELECT repo, path, max(no) AS n FROM {ln} GROUP BY ALL) USING (repo, path))"""


def cla2(ln: str = "ln") -> str:
    frm = f"(SELECT *, {_NUM.format(by='no')} AS sub FROM {spans(ln)} WHERE len > 50)"
    return check("CLA2", frm, line="no", order=1, sub="sub", name="name", n="len", limit="50")


def cla3(ln: str = "ln") -> str:
    frm = f"""(SELECT repo, path, list(name ORDER BY no) AS missing FROM (
        SELECT d.repo, d.path, d.no, d.kind, d.name, arg_min(y.txt, y.no) AS following
        FROM (SELECT repo, path, no, regexp_extract(raw, '{_DEFC}', 1) AS kind,
                     regexp_extract(raw, '{_DEFC}', 2) AS name
              FROM {ln} WHERE regexp_matches(raw, '{_DEFC}')) d
        JOIN {ln} y ON y.repo = d.repo AND y.path = d.path AND y.no BETWEEN d.no + 1 AND d.no + 2 AND y.txt <> ''
        GROUP BY ALL)
      WHERE NOT (kind = 'def' AND starts_with(name, '_'))
        AND NOT (starts_with(following, '\"\"\"') OR starts_with(following, {lit(chr(39)*3)}))
      GROUP BY repo, path HAVING count(*) > 3)"""
    return check("CLA3", frm, order=2, n="len(missing)", names="array_to_string(missing[1:5], ', ')")


def cla4(ln: str = "ln") -> str:
    # Runs of word characters and quotes that are not pure digits cannot hold a hit; they become 'x'.
    pure = "regexp_replace(txt, '[\\p{L}\\p{N}_\"]*[\\p{L}\\p{Nl}\\p{No}_\"][\\p{L}\\p{N}_\"]*', 'x', 'g')"
    numbers = f"regexp_extract_all({pure}, '\\p{{Nd}}+(\\.\\p{{Nd}}+)?')"
    ignored = any_starts("txt", ["#", "def ", "class ", "import", "from"])
    allowed = "(" + ", ".join(str(float(v)) for v in fv.MAGIC_NUMBER_WHITELIST) + ")"
    frm = f"""(SELECT repo, path, sum(k) AS n FROM (
        SELECT repo, path, len(list_filter({numbers}, lambda m: CAST(m AS DOUBLE) NOT IN {allowed})) AS k
        FROM {ln} WHERE NOT {ignored} AND NOT contains(lower(path), 'config'))
      GROUP BY repo, path HAVING sum(k) > 10)"""
    return check("CLA4", frm, order=3, n="CAST(n AS BIGINT)")


def cla5(ln: str = "ln") -> str:
    frm = f"""(SELECT repo, path, max(depth) AS depth, arg_min(no, no - depth * 100000000) AS no
      FROM (SELECT repo, path, no, {indent('raw')} // 4 AS depth FROM {ln} WHERE txt <> '')
      GROUP BY repo, path HAVING max(depth) >= 5)"""
    return check("CLA5", frm, line="no", order=4, n="depth")


def str4(ln: str = "ln") -> str:
    frm = f"""(SELECT repo, path, count(*) AS n FROM {ln}
      WHERE (contains(txt, '= 0.') OR contains(txt, '= \"')) AND upper(txt) = txt AND lower(txt) <> txt
        AND NOT contains(lower(path), 'config')
      GROUP BY repo, path HAVING count(*) > 3)"""
    return check("STR4", frm, phase=3, n="n")


def reu3(ln: str = "ln") -> str:
    frm = f"""(SELECT *, {_NUM.format(by='no')} AS sub FROM {ln}
      WHERE length(txt) > 120 AND length(raw) - length(replace(raw, '(', '')) >= 3)"""
    return check("REU3", frm, line="no", phase=2, sub="sub", n="length(txt)")


def blocks(ln: str = "ln") -> str:
    """(repo, path, idx, block) of every three-line window of code lines."""
    return f"""(SELECT repo, path, idx, block FROM (
      SELECT repo, path, idx, txt || {LF} || lead(txt, 1) OVER w || {LF} || lead(txt, 2) OVER w AS block
      FROM (SELECT repo, path, txt, row_number() OVER (PARTITION BY repo, path ORDER BY no) AS idx
            FROM {ln} WHERE txt <> '' AND NOT starts_with(txt, '#'))
      WINDOW w AS (PARTITION BY repo, path ORDER BY idx))
      WHERE block IS NOT NULL AND length(block) >= 30)"""


def reu1(ln: str = "ln") -> str:
    frm = f"""(SELECT repo, block, count(*) AS n, min(path) || ', and ' || (count(*) - 1) || ' more' AS files,
             min(path) AS first_path, arg_min(idx, path) AS first_idx
      FROM (SELECT repo, block, path, min(idx) AS idx FROM {blocks(ln)} GROUP BY repo, block, path)
      GROUP BY repo, block HAVING count(*) >= 2)"""
    return check("REU1", frm, file="files", code_before="block", ord_path="first_path", sub="first_idx",
                 block_size="3", n="n")


def import_sets(ln: str = "ln") -> str:
    return f"""(SELECT repo, path, string_agg(txt, {LF} ORDER BY txt) AS imports FROM {ln}
      WHERE {any_starts('txt', ['import ', 'from '])} GROUP BY repo, path)"""


def reu2(ln: str = "ln") -> str:
    frm = f"""(SELECT repo, count(*) AS n, min(path) || ', and ' || (count(*) - 1) || ' more' AS files, min(path) AS first_path
      FROM {import_sets(ln)} GROUP BY repo, imports HAVING count(*) >= 3)"""
    return check("REU2", frm, file="files", phase=1, ord_path="first_path", n="n")


# --- repository facts ------------------------------------------------------------------------------

_B = f"lower({base('path')})"
KIND = f"""CASE WHEN contains({_B}, 'config') OR {_B} IN {values(fv.CONFIG_NAMES)} THEN 'config'
    WHEN starts_with({_B}, 'test_') OR ends_with({_B}, '_test.py') THEN 'test'
    WHEN contains(content, 'tkinter') OR contains(content, 'tk.') OR contains({_B}, 'gui')
      OR contains({_B}, 'overlay') THEN 'ui'
    WHEN {any_ends(_B, fv.SCRIPT_SUFFIXES)} THEN 'script' ELSE 'logic' END"""

CLI_HOOK = f"({any_contains('content', fv.MAIN_GUARDS)} AND NOT {any_contains('content', fv.CLI_LIBRARIES)})"
N_TOP_DEFS = "len(regexp_extract_all(content, '(?m)^def [\\p{L}\\p{N}_]+'))"
API_HOOK = f"({N_TOP_DEFS} > 5 AND NOT {any_contains('lower(content)', fv.API_LIBRARIES)})"


def repo_facts_cte(files: str = "code", name: str = "facts") -> str:
    is_test = "contains(lower(path), 'test')"
    return f"""{name} AS (
  SELECT repo, count(*) AS n_files,
    count(*) FILTER (WHERE NOT contains(path, '/') AND {any_ends('path', fv.ROOT_CODE_SUFFIXES)}) AS n_root_code,
    coalesce(list_sort(list(DISTINCT {KIND}) FILTER (WHERE NOT contains(path, '/'))), []) AS kinds,
    count(*) FILTER (WHERE ends_with(path, '.py')) AS n_py,
    bool_or({base('path')} IN {values(fv.PACKAGING_NAMES)}) AS has_packaging,
    bool_or(path = '.env') AS has_env,
    bool_or(path = '.gitignore' AND content <> '') AS has_ignore,
    bool_or({any_contains('path', fv.CI_INDICATORS)}) AS has_ci,
    count(*) FILTER (WHERE {is_test} AND ends_with(path, '.py')) AS n_test,
    count(*) FILTER (WHERE NOT {is_test} AND ends_with(path, '.py')) AS n_code,
    bool_or({any_contains('path', fv.LINT_INDICATORS)}) AS has_lint,
    CAST(sum(CAST({CLI_HOOK} AS INTEGER) + CAST({API_HOOK} AS INTEGER)) AS BIGINT) AS n_hooks
  FROM {files} GROUP BY repo)"""


def _repo(check_id: str, where: str, phase: int, file: str = "'(repo root)'", message: str | None = None,
          **exprs: str) -> str:
    return check(check_id, f"(SELECT * FROM facts WHERE {where})", file=file, phase=phase, ord_path="''",
                 message=message, **exprs)


REPO_CHECKS = {
    "STR1": [_repo("STR1", "n_root_code > 5", 0, n="n_root_code")],
    "STR2": [_repo("STR2", "len(kinds) >= 3", 1, kinds="array_to_string(kinds, ', ')")],
    "STR3": [_repo("STR3", "n_py > 2 AND NOT has_packaging", 2)],
    "SEC3": [_repo("SEC3", "has_env", 1, file="'.env'")],
    "SEC4": [_repo("SEC4", "NOT has_ignore", 2, file="'.gitignore'")],
    "AUT1": [_repo("AUT1", "NOT has_ci", 0)],
    "AUT2": [
        _repo("AUT2", "n_test = 0 AND n_code > 0", 1, n="n_code"),
        _repo("AUT2", "n_test > 0 AND n_code > 0 AND n_test / n_code < 0.3", 1, message="AUT2_LOW",
              tests="n_test", n="n_code"),
    ],
    "AUT3": [_repo("AUT3", "NOT has_lint", 2)],
    "AUT4": [_repo("AUT4", "n_hooks > 0", 3, n="n_hooks")],
}

# --- syntax checks: expected facts per snippet, worked out by hand from the snippet texts --------------
# (snippet, check, order, sub, line, name, n, extra)

AST_BY_SNIPPET = [
    (5, "AST1", 0, 0, 1, "os", 0, ""), (5, "AST1", 0, 1, 3, "a.b", 0, ""), (5, "AST1", 0, 2, 4, "List", 0, ""),
    (3, "AST4", 3, 0, 1, "stub_one", 0, ""), (3, "AST4", 3, 1, 4, "stub_two", 0, ""),
    (3, "AST4", 3, 2, 8, "last_stub", 0, ""),
    (7, "AST3", 2, 0, 1, "long_function", 65, "65"), (7, "AST4", 3, 0, 1, "long_function", 0, ""),
    (8, "AST4", 3, 0, 1, "f1", 0, ""), (8, "AST4", 3, 1, 3, "f2", 0, ""), (8, "AST4", 3, 2, 5, "f3", 0, ""),
    (8, "AST4", 3, 3, 9, "f5", 0, ""), (8, "AST4", 3, 4, 13, "f7", 0, ""),
    (10, "AST2", 1, 0, 1, "deep", 14, ""), (10, "AST4", 3, 0, 1, "deep", 0, ""),
    (10, "AST4", 3, 1, 13, "inner", 0, ""),
    (10, "AST5", 4, 0, 1, "deep", 0, "dict"), (10, "AST5", 4, 1, 1, "deep", 0, "list"),
    (12, "AST4", 3, 0, 3, "load_rows", 0, ""),
    (100, "AST1", 0, 0, 1, "tkinter", 0, ""),
    (101, "AST4", 3, 0, 1, "test_a", 0, ""),
]

_AST_ROWS = ", ".join(
    f"({s}, {lit(c)}, {o}, {i}, {ln}, {lit(name)}, {n}, {lit(extra)})"
    for s, c, o, i, ln, name, n, extra in AST_BY_SNIPPET
)

# Which snippet a code file holds: by its numbered name, or one of two fixed files.
AST_CTE = f"""ast_rows(s, c, o, i, line, name, n, extra) AS (VALUES {_AST_ROWS}),
file_snippet AS (
  SELECT code.repo, code.path, code.doc_id,
    CASE WHEN code.path = 'app_gui.py' THEN 100 WHEN code.path = 'tests/test_core.py' THEN 101 ELSE s END AS s
  FROM code JOIN numbered_docs USING (doc_id)
  WHERE ends_with(path, '.py') AND path NOT IN ('settings.py', 'src/edge.py')),
ast_found AS (SELECT repo, path, ast_rows.* FROM file_snippet JOIN ast_rows USING (s))"""
SYNTAX_ERROR_SNIPPETS = "(0, 6, 13)"


def ast_check(check_id: str) -> str:
    order = int(check_id[-1]) - 1
    exprs = {"name": "name", "n": "n", "end": "extra", "kind": "extra"}
    severity = None
    if check_id == "AST2":
        severity = "CASE WHEN n > 20 THEN 'high' ELSE 'medium' END"
    if check_id == "AST3":
        severity = "CASE WHEN n > 100 THEN 'high' ELSE 'medium' END"
    return check(check_id, f"(SELECT * FROM ast_found WHERE c = {lit(check_id)})", line="line",
                 severity=severity, order=order, sub="i", **exprs)


# --- assembled -------------------------------------------------------------------------------------


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


CODE_CTES = (CODE_RAW, CODE)
CODE_LINES = (*CODE_CTES, lines_cte("code"))

_FILE_LEVEL = [str4(), reu3(), cla1(), cla2(), cla3(), cla4(), cla5(), fun1(), fun2(), fun3(), fun4(), fun5(),
               sec1("code"), sec2("code")]


def _analyzer_case(of: str) -> str:
    names = {"STR": ("Structure", "structure"), "REU": ("Reusability", "reusability"),
             "CLA": ("Clarity", "clarity"), "FUN": ("Functionality", "functionality"),
             "SEC": ("Security", "security"), "AUT": ("Automation", "automation"),
             "AST": ("AST Analysis", "ast_analysis")}
    i = 0 if of == "analyzer" else 1
    return "CASE left(check_id, 3) " + " ".join(
        f"WHEN {lit(k)} THEN {lit(v[i])}" for k, v in names.items()) + f" END AS {of}"


_O_ANALYZER = "CASE left(check_id, 3) " + " ".join(
    f"WHEN {lit(k)} THEN {v}" for k, v in ANALYZER_OF.items()) + " END AS o_analyzer"


def findings_cte(parts: list[str], name: str = "findings") -> str:
    union = "\n  UNION ALL\n  ".join(parts)
    return (f"{name} AS (SELECT *, {_analyzer_case('analyzer')}, {_analyzer_case('category')}, {_O_ANALYZER}\n"
            f"  FROM (\n  {union}))")


FILE_FINDINGS = (*CODE_LINES, findings_cte(_FILE_LEVEL))
ALL_FINDINGS = (
    *CODE_LINES, repo_facts_cte(), AST_CTE,
    findings_cte([
        *_FILE_LEVEL, reu1(), reu2(),
        *[sql for parts in REPO_CHECKS.values() for sql in parts],
        *[ast_check(f"AST{i}") for i in range(1, 6)],
    ]),
)
ORDER = "o_analyzer, o_phase, o_path, o_check, o_sub"

OUT = "repo, file, severity, title, description, suggestion, line"

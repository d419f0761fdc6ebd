"""Expected result of every catalog query as DuckDB SQL over the given tables."""

from __future__ import annotations

from lintlake import fixed_values as fv
from lintlake.operators import prompts
from lintlake.plans.catalog import AS_OF
from oracle import views as v
from oracle.views import LF, OUT, fill, lit, strip, with_

ORACLE: dict[str, str] = {}

_CODE = v.CODE_CTES
_DOCS = (v.DOCS,)
_DOC_LINES = (v.DOCS, v.lines_cte("docs"))
_UNION = "SELECT repo, path, content, size FROM "


def _both() -> tuple[str, ...]:
    return (*_CODE, v.DOCS, f"both_files AS ({_UNION}code UNION ALL {_UNION}docs)")


def _three() -> tuple[str, ...]:
    return (*_CODE, v.DOCS, v.PAGES,
            f"three AS ({_UNION}code UNION ALL {_UNION}docs UNION ALL {_UNION}page_files)")


def _pages() -> tuple[str, ...]:
    return (*_CODE, v.PAGES, f"code_pages AS ({_UNION}code UNION ALL {_UNION}page_files)")


def add(name: str, ctes: tuple[str, ...], select: str) -> None:
    ORACLE[name] = (with_(*ctes) if ctes else "") + select


# --- sources ---------------------------------------------------------------------------------

add("src1_files_table", _DOCS, "SELECT repo, path, size, md5(content) AS content_md5 FROM docs")
_TREE = """tree AS (SELECT source AS repo, lang || '/' || doc_id || '.md' AS path, doc_id % 50 AS kind,
  CASE WHEN doc_id % 50 = 7 THEN text || chr(65533) ELSE text END AS content,
  CAST(octet_length(encode(text)) + CASE WHEN doc_id % 50 = 7 THEN 1 ELSE 0 END AS BIGINT) AS size FROM documents)"""
add("src1_directory", (_TREE,), "SELECT repo, path, size, md5(content) AS content_md5 FROM tree WHERE kind NOT IN (8, 9)")
add("src1_refused_files", (_TREE,), """SELECT repo, path, CASE kind WHEN 8 THEN 500001 WHEN 7 THEN size END AS size,
  CASE kind WHEN 7 THEN 'invalid bytes' WHEN 8 THEN 'too large' ELSE 'unreadable' END AS error FROM tree WHERE kind IN (7, 8, 9)""")
add("src2_suffix_filter", (v.CODE_RAW,), f"SELECT repo, path FROM code_raw WHERE {v.NAME_OK}")
add("src3_skip_dirs", (v.CODE_RAW,), f"SELECT repo, path FROM code_raw WHERE {v.DIR_OK}")
add("src4_size_guard", (v.CODE_RAW, v.DOCS),
    "SELECT repo, path, size FROM docs WHERE size <= 500000 "
    "UNION ALL SELECT repo, path, size FROM code_raw WHERE size <= 500000")
add("src5_decode", _DOCS, "SELECT repo, path, md5(content || chr(65533)) AS content_md5 FROM docs")
add("src6_forward_slashes", (v.CODE_RAW,), "SELECT repo, path FROM code_raw")

_SCORE = lambda shift: (
    f"CAST(CAST(((CAST(round(value * 100) AS BIGINT) + {shift * 100}) % 10000 + 50) // 100 AS DECIMAL(6,1)) "
    "* CAST(0.1 AS DECIMAL(2,1)) AS DECIMAL(4,1))"
)
_RUNS = f"""runs AS (
  SELECT 'user_' || user_id AS repo, ts AS run_ts, event_id AS run_id,
    {_SCORE(11)} AS quality, {_SCORE(23)} AS structure, {_SCORE(37)} AS security,
    {_SCORE(53)} AS usefulness, {_SCORE(0)} AS overall,
    event_id % 40 AS findings_count, event_id % 15 AS files_analyzed,
    CASE WHEN event_id % 2 = 0 THEN 'static' ELSE 'smart' END AS mode
  FROM events)"""

add("src7_read_history", (_RUNS,), """SELECT repo, date_trunc('second', run_ts) AS run_ts, quality, structure, security,
  usefulness, overall, findings_count, files_analyzed, mode FROM runs WHERE run_id % 50 NOT IN (0, 1, 2)""")
add("src8_config_lookup", (*_CODE, "r AS (SELECT source AS repo, min(doc_id) % 20 AS r FROM documents GROUP BY source)"),
    """SELECT repo,
  CASE WHEN r % 5 = 0 THEN '3' WHEN r % 3 = 0 THEN '7' ELSE '5' END AS clarity_nesting_threshold,
  CASE WHEN r % 5 = 0 THEN '50' WHEN r % 3 = 0 THEN '80' ELSE '50' END AS clarity_max_function_lines,
  CASE WHEN r % 5 <> 0 AND r % 3 <> 0 AND r % 2 = 0 THEN '2' ELSE '5' END AS structure_root_file_threshold
FROM r WHERE repo IN (SELECT repo FROM code)""")
_OPTS = (
    *v.CODE_LINES, v.repo_facts_cte(), "r AS (SELECT source AS repo, min(doc_id) % 20 AS r FROM documents GROUP BY source)",
    """opts AS (SELECT repo, CASE WHEN r % 5 = 0 THEN 3 WHEN r % 3 = 0 THEN 7 ELSE 5 END AS nesting,
    CASE WHEN r % 5 <> 0 AND r % 3 = 0 THEN 80 ELSE 50 END AS fn_lines,
    CASE WHEN r % 5 <> 0 AND r % 3 <> 0 AND r % 2 = 0 THEN 2 ELSE 5 END AS root_files FROM r)""",
)
_EFFECTIVE = [
    v.check("CLA2", f"(SELECT *, {v._NUM.format(by='no')} AS sub FROM {v.spans()} JOIN opts USING (repo) WHERE len > fn_lines)",
            line="no", order=1, sub="sub", name="name", n="len", limit="fn_lines"),
    v.check("CLA5", f"""(SELECT repo, path, max(depth) AS depth, arg_min(no, no - depth * 100000000) AS no
      FROM (SELECT repo, path, no, {v.indent('raw')} // 4 AS depth FROM ln WHERE txt <> '') JOIN opts USING (repo)
      GROUP BY repo, path HAVING max(depth) >= max(nesting))""", line="no", order=4, n="depth"),
    v._repo("STR1", "n_root_code > (SELECT root_files FROM opts o WHERE o.repo = facts.repo)", 0, n="n_root_code"),
]
add("src8_effective_checks", _OPTS, " UNION ALL ".join(
    f"SELECT repo, check_id, file, description, line FROM ({sql})" for sql in _EFFECTIVE))
_NUMBERED = "r AS (SELECT source AS repo, min(doc_id) % 20 AS r FROM documents GROUP BY source)"
_STYLE = f"""opts AS (SELECT repo,
    CASE r % 4 WHEN 0 THEN 2 WHEN 1 THEN 4 WHEN 2 THEN 5 ELSE 3 END AS width, CASE r % 4 WHEN 0 THEN 20 WHEN 2 THEN 60 ELSE 30 END AS least_chars,
    CASE WHEN r % 4 = 1 THEN 2 ELSE 3 END AS least_files, CASE WHEN r % 4 = 0 THEN 'qw' ELSE {lit(fv.ALLOWED_SINGLE_LETTERS)} END AS letters,
    CASE WHEN r % 4 = 1 THEN [3.5::DOUBLE, 42, 7] ELSE {[float(x) for x in fv.MAGIC_NUMBER_WHITELIST]}::DOUBLE[] END AS numbers,
    CASE WHEN r % 4 = 2 THEN ['HACK', 'NOTHING'] ELSE {fv.TODO_MARKERS} END AS markers FROM r)"""
_STYLED = "(SELECT * FROM ln JOIN opts USING (repo))"
_STYLE_CHECKS = [
    v.cla1(_STYLED).replace(f"m NOT IN {v.values(list(fv.ALLOWED_SINGLE_LETTERS))}", "NOT contains(letters, m)"),
    v.cla4(_STYLED).replace(
        "CAST(m AS DOUBLE) NOT IN (" + ", ".join(str(float(x)) for x in fv.MAGIC_NUMBER_WHITELIST) + ")", "NOT list_contains(numbers, CAST(m AS DOUBLE))"),
    v.fun1(_STYLED).replace("(VALUES ", "(VALUES (9, 'NOTHING'), ").replace("WHERE contains(", "WHERE list_contains(markers, m) AND contains("),
    v.reu2().replace(f"FROM {v.import_sets()} GROUP BY", f"FROM {v.import_sets()} JOIN opts USING (repo) GROUP BY").replace(
        "HAVING count(*) >= 3", "HAVING count(*) >= max(least_files)"),
]
add("src8_style_checks", (*v.CODE_LINES, _NUMBERED, _STYLE), " UNION ALL ".join(
    f"SELECT repo, check_id, file, description, line FROM ({sql})" for sql in _STYLE_CHECKS))
add("reu1_per_repo_blocks", (*_DOC_LINES, _NUMBERED, _STYLE, f"""texts AS (
  SELECT repo, path, list(txt ORDER BY no) AS w FROM ln WHERE txt <> '' AND NOT starts_with(txt, '#') GROUP BY repo, path)""",
  f"""windows AS (SELECT repo, path, width, idx, array_to_string(w[idx:idx + width - 1], {LF}) AS block, least_chars
  FROM (SELECT *, unnest(range(1, len(w) - width + 2)) AS idx FROM texts JOIN opts USING (repo) WHERE len(w) >= width))""",
  """members AS (SELECT repo, path, width, block, min(idx) AS idx FROM windows WHERE length(block) >= least_chars GROUP BY ALL)"""),
    """SELECT repo, md5(block) AS block_md5, count(*) AS n_files, min(path) AS first_file, arg_min(idx, path) AS first_idx, max(width) AS block_size
FROM members GROUP BY repo, block HAVING count(*) >= 2""")
add("src9_portfolio_repos", (), """SELECT repo FROM (SELECT DISTINCT source AS repo FROM documents ORDER BY 1 LIMIT 100)
WHERE repo NOT IN ('src3', 'src7')""")
add("src10_scan_projects", (), """WITH repos AS (SELECT source AS repo, min(doc_id) AS d FROM documents GROUP BY source)
SELECT repo AS project, repo AS name, d % 20 % 3 = 0 AS is_git FROM repos
UNION ALL SELECT repo || '/src', 'src', TRUE FROM repos WHERE d % 20 % 3 = 1""")
_COMMITS = """commits AS (SELECT 'user_' || user_id AS repo, ts AS commit_ts, event_id AS commit_id,
  event_type AS message, CASE WHEN event_id % 4 = 0 THEN 'develop' ELSE 'main' END AS branch, user_id % 7 <> 0 AS is_git FROM events)"""
_LAST = """last AS (SELECT repo, left(CAST(arg_max(commit_ts, (commit_ts, commit_id)) AS VARCHAR), 10) AS last_commit_date,
    arg_max(message, (commit_ts, commit_id)) AS last_commit_msg, arg_max(branch, (commit_ts, commit_id)) AS branch,
    coalesce(bool_or(message = 'error' AND commit_id % 3 = 0), FALSE) AS has_uncommitted
  FROM commits WHERE is_git GROUP BY repo)"""
add("src11_last_commit", (_COMMITS, _LAST), "SELECT * FROM last")

# --- kernels ---------------------------------------------------------------------------------

add("k1_lines", _DOC_LINES, "SELECT repo, path, CAST(no AS INTEGER) AS line_no, md5(raw) AS text_md5 FROM ln")
_WRAPPED = "chr(9) || ' ' || chr(160) || ' ' || raw || ' ' || chr(11) || chr(12288) || chr(9)"
add("k2_strip", _DOC_LINES,
    f"SELECT repo, path, CAST(no AS INTEGER) AS line_no, md5({strip(_WRAPPED)}) AS stripped_md5 FROM ln")
_DOTS = v.hits("docs", [(r"[a-z]\.\n?", "dot")])
_KEYS = v.hits("docs", fv.SECRET_PATTERNS[:1])
add("k3_match_lines", _DOCS, f"""SELECT repo, path, CAST(line AS INTEGER) AS line, count(*) AS n_hits
FROM (SELECT repo, path, line FROM {_DOTS} UNION ALL SELECT repo, path, line FROM {_KEYS}) GROUP BY ALL""")
add("k4_indent", v.CODE_LINES, f"""SELECT repo, path, CAST(no AS INTEGER) AS line_no, CAST({v.indent('raw')} AS INTEGER) AS width,
  CAST({v.indent('raw')} // 4 AS INTEGER) AS depth FROM ln""")
add("k5_next_text_line", v.CODE_LINES, """SELECT x.repo, x.path, CAST(x.no AS INTEGER) AS line, CAST(min(y.no) AS INTEGER) AS next_line
FROM ln x LEFT JOIN ln y ON y.repo = x.repo AND y.path = x.path AND y.no BETWEEN x.no + 1 AND x.no + 4 AND y.txt <> ''
GROUP BY x.repo, x.path, x.no""")
add("k6_paths", (v.CODE_RAW,), f"""SELECT repo, path, {v.base('path')} AS base,
  array_to_string(string_split(path, '/')[1:-2], '/') AS dir, {v.suffix('path')} AS suffix,
  left({v.base('path')}, length({v.base('path')}) - length({v.suffix('path')})) AS stem FROM code_raw""")

# --- checks ----------------------------------------------------------------------------------


def out(sql: str, extra: str = "") -> str:
    return f"SELECT {OUT}{extra} FROM ({sql})"


add("sec1_secrets", _both(), out(v.sec1("both_files")))
add("sec2_unsafe_calls", _CODE, out(v.sec2("code")))
for _name, _sql in {
    "fun1_open_markers": v.fun1(), "fun2_stub_functions": v.fun2(), "fun3_swallowed_exceptions": v.fun3(),
    "fun4_unused_imports": v.fun4(), "fun5_dead_code": v.fun5(), "cla2_long_functions": v.cla2(),
    "cla3_missing_docstrings": v.cla3(), "cla5_deep_nesting": v.cla5(), "str4_hardcoded_constants": v.str4(),
    "reu2_repeated_imports": v.reu2(),
}.items():
    add(_name, v.CODE_LINES, out(_sql))
add("cla1_single_letters", (*_pages(), v.lines_cte("code_pages")), out(v.cla1()))
add("cla4_magic_numbers", (*_three(), v.lines_cte("three")), out(v.cla4()))
add("reu3_inline_logic", (*_three(), v.lines_cte("three")), out(v.reu3()))
add("reu1_duplicate_blocks", _DOC_LINES, out(v.reu1(), ", code_before"))
_BLOCK_FILES = f"""(SELECT repo, block, path, count(*) OVER (PARTITION BY repo, block) AS n_files
  FROM (SELECT DISTINCT repo, block, path FROM {v.blocks()}))"""
add("reu1_block_files", _DOC_LINES, f"SELECT repo, block, path, n_files FROM {_BLOCK_FILES} WHERE n_files >= 2")
add("reu1_corpus_blocks", _DOC_LINES, f"""SELECT block, count(DISTINCT repo || '/' || path) AS n_files,
  min(repo || '/' || path) AS first_file FROM {v.blocks()} GROUP BY block HAVING count(DISTINCT repo || '/' || path) >= 2""")
add("reu2_import_set_files", v.CODE_LINES, f"""SELECT * FROM (SELECT repo, imports, path,
  count(*) OVER (PARTITION BY repo, imports) AS n_files FROM {v.import_sets()}) WHERE n_files >= 3""")
_FACTS = (*_CODE, v.repo_facts_cte())
for _name, _check in {
    "sec3_env_file": "SEC3", "sec4_ignore_file": "SEC4", "str1_flat_structure": "STR1",
    "str2_mixed_concerns": "STR2", "str3_missing_packaging": "STR3", "aut1_ci": "AUT1", "aut2_tests": "AUT2",
    "aut3_lint": "AUT3", "aut4_hook_points": "AUT4",
}.items():
    add(_name, _FACTS, " UNION ALL ".join(out(sql) for sql in v.REPO_CHECKS[_check]))

_ENTRIES = "[" + ", ".join(lit(e) for e in fv.IGNORE_ENTRIES) + "]"
_IGNORE_NOTES = f"""(SELECT repo, {fill(fv.NOTE_GITIGNORE, entries="array_to_string(missing, ', ')")} AS note
  FROM (SELECT repo, list_filter({_ENTRIES}, lambda e: NOT contains(content, e)) AS missing
        FROM code WHERE path = '.gitignore' AND content <> '') WHERE len(missing) > 0)"""
_HOOK_NOTES = f"""(SELECT repo, path, {fill(fv.NOTE_CLI, path='path')} AS note FROM code WHERE {v.CLI_HOOK}
  UNION ALL SELECT repo, path, {fill(fv.NOTE_API, path='path', n=v.N_TOP_DEFS)} AS note FROM code WHERE {v.API_HOOK})"""
_SYNTAX_NOTES = f"""(SELECT repo, {fill(fv.NOTE_SYNTAX, path='path')} AS note FROM file_snippet
  WHERE s IN {v.SYNTAX_ERROR_SNIPPETS})"""
add("sec4_ignore_notes", _CODE, f"SELECT * FROM {_IGNORE_NOTES}")
add("aut4_hook_notes", _CODE, f"SELECT * FROM {_HOOK_NOTES}")

_AST = (*_CODE, v.AST_CTE)
add("ast0_syntax_notes", _AST, f"SELECT * FROM {_SYNTAX_NOTES}")
for _i, _name in enumerate(["ast1_unused_imports", "ast2_complexity", "ast3_function_length", "ast4_return_types",
                            "ast5_mutable_defaults"], 1):
    add(_name, _AST, out(v.ast_check(f"AST{_i}")))
_AST_COUNTS = {1: (1, 0, 0, 0, 0), 3: (0, 0, 0, 3, 0), 5: (7, 1, 1, 0, 0), 7: (0, 0, 0, 1, 0), 8: (0, 0, 0, 7, 0),
               10: (0, 0, 0, 2, 2), 12: (2, 0, 0, 1, 0), 14: (0, 0, 0, 1, 0), 100: (1, 0, 0, 0, 0),
               101: (0, 0, 0, 1, 0)}
_AST_COUNT_ROWS = ", ".join(str((s, *c)) for s, c in _AST_COUNTS.items())
add("ast0_facts", (*_AST, f"counts(s, n_imports, n_exports, n_guarded, n_funcs, n_mutable) AS (VALUES {_AST_COUNT_ROWS})"),
    f"""SELECT code.repo, code.path, coalesce(f.s NOT IN {v.SYNTAX_ERROR_SNIPPETS}, TRUE) AS parsed,
  """ + ", ".join(f"CAST(coalesce({c}, 0) AS INTEGER) AS {c}" for c in
                  ["n_imports", "n_exports", "n_guarded", "n_funcs", "n_mutable"])
    + """ FROM code LEFT JOIN file_snippet f ON f.repo = code.repo AND f.path = code.path
LEFT JOIN counts USING (s) WHERE ends_with(code.path, '.py')""")
ORACLE["ast0_remembered_facts"] = ORACLE["ast0_facts"]

# Imports and public functions per snippet, by hand: (snippet, name, line, guarded) and
# (snippet, order, name, first line, last line).
_IMPORTS = [(1, "os", 1, 0), (5, "os", 1, 0), (5, "sys", 2, 0), (5, "a.b", 3, 0), (5, "List", 4, 0), (5, "D", 4, 0),
            (5, "TYPE_CHECKING", 6, 0), (5, "decimal", 8, 1), (12, "json", 1, 0), (12, "logging", 2, 0),
            (100, "tkinter", 1, 0)]
_FUNCTIONS = [(3, 0, "stub_one", 1, 3), (3, 1, "stub_two", 4, 5), (3, 2, "last_stub", 8, 9),
              (7, 0, "long_function", 1, 65), (8, 0, "f1", 1, 2), (8, 1, "f2", 3, 4), (8, 2, "f3", 5, 6),
              (8, 3, "f4", 7, 8), (8, 4, "f5", 9, 10), (8, 5, "f7", 13, 15), (10, 0, "deep", 1, 16),
              (10, 1, "inner", 13, 15), (12, 0, "load_rows", 3, 7), (14, 0, "helper_{id}", 1, 3),
              (101, 0, "test_a", 1, 2)]
add("jn5_guarded_imports", (*_AST, f"imports(s, name, line, g) AS (VALUES {', '.join(map(str, _IMPORTS))})"),
    "SELECT repo, path, name, line, g = 1 AS guarded FROM file_snippet JOIN imports USING (s)")
_PUBLIC = (*_AST, f"functions(s, seq, name, line, last) AS (VALUES {', '.join(map(str, _FUNCTIONS))})",
           f"""public AS (
  SELECT f.repo, f.path, seq, replace(name, '{{id}}', CAST(f.doc_id AS VARCHAR)) AS name, line,
    array_to_string(string_split(content, {LF})[line:last], {LF}) AS source
  FROM file_snippet f JOIN functions USING (s) JOIN code ON code.repo = f.repo AND code.path = f.path)""")
add("tst1_public_functions", _PUBLIC,
    "SELECT repo, path, name, CAST(NULL AS VARCHAR) AS class, line, source, FALSE AS is_async FROM public")
_FUNCTION_TEXT = "'### ' || name || '() (line ' || line || ')' || chr(10) || '```python' || chr(10) || source || chr(10) || '```'"
add("prm4_test_prompts", _PUBLIC, f"""SELECT repo, path, {fill(prompts._TESTS, path='path', functions='functions', module="regexp_replace(replace(path, '/', '.'), '[.]py$', '')")} AS prompt
FROM (SELECT repo, path, string_agg({_FUNCTION_TEXT}, {LF} || {LF} ORDER BY seq) AS functions FROM public GROUP BY repo, path)""")

# --- findings of the documents, patches ----------------------------------------------------------

_DOC_FINDINGS = (*_DOC_LINES, v.findings_cte([v.sec1("docs"), v.reu1()]))
_KEY = strip("string_split(file, ',')[1]")
add("jn1_finding_content", _DOC_FINDINGS, f"""SELECT f.repo, f.key, title, line, CAST(length(content) AS INTEGER) AS n_chars
FROM (SELECT *, {_KEY} AS key FROM findings) f LEFT JOIN docs ON docs.repo = f.repo AND docs.path = f.key""")
add("win4_finding_index", _DOC_FINDINGS, f"""SELECT repo, key,
  CAST(row_number() OVER (PARTITION BY repo, key ORDER BY {v.ORDER}) AS INTEGER) AS idx, title, line, md5(file) AS file_md5
FROM (SELECT *, {_KEY} AS key FROM findings)""")
add("jn3_fixable", (*_DOC_LINES, v.findings_cte([v.sec1("docs"), v.reu1(), v.cla4()])),
    f"""SELECT {OUT} FROM findings WHERE severity IN ('critical', 'high', 'medium') AND NOT contains(file, ',')
  AND (repo, file) IN (SELECT (repo, path) FROM docs)""")
add("jn4_skip_list", _DOCS, """SELECT repo, count(*) AS n_files FROM docs GROUP BY repo
HAVING NOT bool_or(contains(content, 'license'))""")

# Verdicts by h = document number % 5, stated directly (no JSON).
_VERDICTS = f"""indexed AS (
  SELECT *, TRY_CAST(regexp_extract(key, '([0-9]+)\\.', 1) AS BIGINT) % 5 AS h,
    row_number() OVER (PARTITION BY repo, key ORDER BY {v.ORDER}) AS idx
  FROM (SELECT *, {_KEY} AS key FROM findings)),
validated AS (
  SELECT repo, analyzer, category, file, severity, title, line,
    CASE WHEN h IS NULL OR h = 3 THEN description ELSE description || ' [AI: checked]' END AS description,
    CASE WHEN h = 0 THEN 'Better fix ' || idx ELSE suggestion END AS suggestion
  FROM indexed WHERE h IS NULL OR h IN (0, 2, 3) OR (h IN (1, 4) AND idx > 1))"""
_VALIDATED = (*v.FILE_FINDINGS, _VERDICTS)
add("jn2_validated_findings", _VALIDATED, f"SELECT {OUT} FROM validated")
add("jn6_regrouped", _VALIDATED,
    "SELECT repo, analyzer, category, count(*) AS n_findings FROM validated GROUP BY repo, analyzer, category")
add("ans2_parsed_verdicts", _VALIDATED, """SELECT repo, key,
  CAST(CASE WHEN h = 4 AND idx = 1 THEN 99 ELSE idx END AS INTEGER) AS index, NOT (h = 1 AND idx = 1) AS valid,
  'checked' AS reason, CASE WHEN h = 0 THEN 'Better fix ' || idx END AS improved_suggestion
FROM indexed WHERE h IS NOT NULL AND h <> 3""")

# A broken entry in each answer: findings that no verdict names stay as they are.
_MIXED = _VERDICTS.replace("h = 3 THEN", "h = 3 OR (h = 4 AND idx = 1) THEN").replace("(h IN (1, 4) AND", "h = 4 OR (h = 1 AND")
add("ans2_mixed_verdicts", (*v.FILE_FINDINGS, _MIXED), f"SELECT {OUT} FROM validated")

_REVIEWS = """reviews AS (
  SELECT repo, CAST(regexp_extract(repo, '([0-9]+)', 1) AS INTEGER) AS r FROM (SELECT DISTINCT repo FROM {files})),
ai AS (
  SELECT repo, 'src/a.py' AS file, 'high' AS severity, 'Race' AS title, 'd' || r AS description, 'lock' AS suggestion,
    12 AS line FROM reviews WHERE r % 4 = 0
  UNION ALL SELECT repo, '(unknown)', 'medium', 'Only title', '', '', NULL FROM reviews WHERE r % 4 = 0
  UNION ALL SELECT repo, '(unknown)', 'low', 'AI Finding', '', '', NULL FROM reviews WHERE r % 4 = 1)"""
add("ans2_review_findings", (v.DOCS, _REVIEWS.format(files="docs")), f"SELECT 'ai_review' AS category, {OUT} FROM ai")
add("agg11_ai_summary", (*_VALIDATED, _REVIEWS.format(files="code")), """SELECT repo, coalesce(b, 0) AS n_before,
  coalesce(b, 0) - coalesce(a, 0) AS n_dismissed, coalesce(c, 0) AS n_added
FROM (SELECT repo, count(*) AS b FROM findings GROUP BY repo)
FULL JOIN (SELECT repo, count(*) AS a FROM validated GROUP BY repo) USING (repo)
FULL JOIN (SELECT repo, count(*) AS c FROM ai GROUP BY repo) USING (repo)""")

_FIXED = 'token = os.environ["TOKEN"]'
_HIT = f"regexp_extract(content, {lit(fv.SECRET_PATTERNS[0][0])}, 0)"
_TIMES = lambda n: f"((length(content) - length(replace(content, {n}, ''))) / length({n}))"
_PATCHES = f"""hit_docs AS (
  SELECT repo, path, content, hit FROM (SELECT *, {_HIT} AS hit FROM docs) WHERE hit <> ''),
patches AS (
  SELECT repo, path, content, 0 AS seq, 'Hardcoded secret/credential' AS finding, hit AS original,
    {lit(_FIXED)} AS fixed, 'read from the environment' AS explanation FROM hit_docs
  UNION ALL SELECT repo, path, content, 2, 'Fix', 'e', 'E', 'occurs many times' FROM hit_docs WHERE contains(content, 'e')),
once AS (SELECT * FROM patches WHERE {_TIMES('original')} = 1)"""
_PATCHED = (v.DOCS, _PATCHES)
_PATCH_COLUMNS = "repo, path, CAST(seq AS INTEGER) AS seq, finding, original, fixed, explanation"
add("ans3_patches", _PATCHED, f"SELECT {_PATCH_COLUMNS} FROM patches")
add("jn7_patch_titles", _PATCHED, "SELECT repo, path, CAST(seq AS INTEGER) AS seq, finding FROM patches")
add("fix1_dry_run", _PATCHED, f"SELECT {_PATCH_COLUMNS}, 'would_apply' AS status FROM once")
add("agg13_patch_totals", _PATCHED, "SELECT repo, count(*) AS n_patches FROM patches GROUP BY repo")
# The one-letter patch is judged on the text after the first patch.
_SEQUENTIAL = f"""step1 AS (
  SELECT repo, path, hit, {_TIMES('hit')} = 1 AS ok1,
    CASE WHEN {_TIMES('hit')} = 1 THEN replace(content, hit, {lit(_FIXED)}) ELSE content END AS content FROM hit_docs),
step2 AS (
  SELECT *, {_TIMES("'e'")} = 1 AS ok2, CASE WHEN {_TIMES("'e'")} = 1 THEN replace(content, 'e', 'E') ELSE content END AS patched
  FROM step1)"""
add("fix1_applied", (*_PATCHED, _SEQUENTIAL), f"""SELECT {_PATCH_COLUMNS}, 'applied' AS status FROM patches
JOIN (SELECT repo, path, ok1, ok2 FROM step2) USING (repo, path) WHERE (seq = 0 AND ok1) OR (seq = 2 AND ok2)""")
for _name in ("snk6_patched_files", "snk6_bucketed_files"):
    add(_name, (*_PATCHED, _SEQUENTIAL), """SELECT docs.repo, docs.path,
  CAST(octet_length(encode(coalesce(patched, docs.content))) AS BIGINT) AS size,
  md5(coalesce(patched, docs.content)) AS content_md5
FROM docs LEFT JOIN step2 ON step2.repo = docs.repo AND step2.path = docs.path""")
_DIFF = lambda c, s: f"list_transform(string_split({c}, {LF}), lambda l: {lit(s)} || l)"
add("fix2_patch_report", _PATCHED, f"""SELECT repo, number, CAST(unnest(range(0, len(lines))) AS INTEGER) AS line_no, unnest(lines) AS line
FROM (SELECT repo, number, ['### Patch ' || number || ': ' || finding,
        '**File:** `' || path || '` | **Status:** ready', '', explanation, '', '```diff']
      || {_DIFF('original', '- ')} || {_DIFF('fixed', '+ ')} || ['```', ''] AS lines
  FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY path, seq) AS number FROM once))""")

_PATCHES_SECTION = f"""all_repos AS (SELECT DISTINCT repo FROM code UNION SELECT DISTINCT repo FROM docs),
patch_blocks AS (
  SELECT repo, 0 AS block, CASE WHEN n > 0 THEN [{lit(fv.PATCHES_TITLE)}, '', '**' || n || ' patches generated**', '']
    ELSE [{lit(fv.PATCHES_TITLE)}, '', {lit(fv.NO_PATCHES)}] END AS lines
  FROM all_repos LEFT JOIN (SELECT repo, count(*) AS n FROM once GROUP BY repo) USING (repo)
  UNION ALL SELECT repo, number, ['### Patch ' || number || ': ' || finding,
      '**File:** `' || path || '` | **Status:** ready', '', explanation, '', '```diff']
    || {_DIFF('original', '- ')} || {_DIFF('fixed', '+ ')} || ['```', '']
  FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY path, seq) AS number FROM once))"""
_BLOCK_LINES = "CAST(unnest(range(0, len(lines))) AS INTEGER) AS line_no, unnest(lines) AS line FROM patch_blocks"
add("rep4_patches_section", (*_CODE, *_PATCHED, _PATCHES_SECTION),
    f"SELECT repo, CAST(block AS INTEGER) AS block, '' AS name, {_BLOCK_LINES}")

# --- runs and windows ------------------------------------------------------------------------------

_PREV = """prev AS (SELECT *, lag({c}) OVER (PARTITION BY repo ORDER BY run_ts, run_id) AS previous FROM runs)"""
add("jn8_previous_run", (_RUNS, _PREV.format(c="overall")),
    "SELECT repo, run_ts, run_id, overall, previous AS previous_overall FROM prev")
_CATEGORY_ROWS = " UNION ALL ".join(
    f"""SELECT repo, run_ts, run_id, '{c}' AS category, {c} AS current,
    lag({c}) OVER (PARTITION BY repo ORDER BY run_ts, run_id) AS previous,
    row_number() OVER (PARTITION BY repo ORDER BY run_ts DESC, run_id DESC) AS back FROM runs"""
    for c in fv.SCORE_CATEGORIES)
_TREND = f"""SELECT repo, run_ts, run_id, category, previous, current, CAST(current - previous AS DECIMAL(4,1)) AS delta,
  CASE WHEN current > previous THEN '↑' WHEN current < previous THEN '↓' ELSE '→' END AS arrow,
  current < previous AS regression FROM ({_CATEGORY_ROWS}) WHERE previous IS NOT NULL"""
add("win1_trends", (_RUNS,), _TREND)
add("win1_latest_trends", (_RUNS,), _TREND + " AND back = 1")
add("agg9_history_summary", (_RUNS,),
    "SELECT repo, count(*) AS runs_tracked, max(overall) AS best, min(overall) AS worst FROM runs GROUP BY repo")
_CATS = fv.SCORE_CATEGORIES
_ROW = lambda c: (
    f"'| {'**Overall**' if c == 'overall' else c.capitalize()} | ' || p_{c} || ' | ' || {c} || ' | ' || "
    f"CASE WHEN {c} > p_{c} THEN '↑ +' || ({c} - p_{c}) WHEN {c} < p_{c} THEN '↓ ' || ({c} - p_{c}) ELSE '→ 0.0' END || ' |'")
_WARN = lambda c: (
    f"CASE WHEN {c} < p_{c} THEN '- **{c.capitalize()}** dropped from ' || p_{c} || ' to ' || {c} || ' (' || ({c} - p_{c}) || ')' END")
_SECTION = f"""section AS (
  SELECT repo, CASE WHEN p_overall IS NULL THEN ['## Trend Tracking', '', 'First run — no trend data available yet. Scores from this run will be used as the baseline for future comparisons.']
   ELSE ['## Trend Tracking', '', '**Runs tracked:** ' || n, '', '### Current vs Previous', '',
     '| Category   | Previous | Current | Change |', '|------------|----------|---------|--------|',
     {', '.join(_ROW(c) for c in _CATS)}, '', '**Best overall score:** ' || best || '  ',
     '**Worst overall score:** ' || worst, '']
     || CASE WHEN len(warnings) > 0 THEN ['### Regression Warnings', ''] || warnings || [''] ELSE [] END END AS lines
  FROM (SELECT *, list_filter([{', '.join(_WARN(c) for c in _CATS)}], lambda w: w IS NOT NULL) AS warnings FROM (
    SELECT *, {', '.join(f'lag({c}) OVER w AS p_{c}' for c in _CATS)},
      count(*) OVER (PARTITION BY repo) AS n, max(overall) OVER (PARTITION BY repo) AS best,
      min(overall) OVER (PARTITION BY repo) AS worst,
      row_number() OVER (PARTITION BY repo ORDER BY run_ts DESC, run_id DESC) AS back
    FROM runs WINDOW w AS (PARTITION BY repo ORDER BY run_ts, run_id)) WHERE back = 1))"""
add("win1_trend_section", (_RUNS, _SECTION),
    "SELECT repo, CAST(unnest(range(0, len(lines))) AS INTEGER) AS line_no, unnest(lines) AS line FROM section")
add("snk4_append_run", (_RUNS,), """SELECT repo, run_ts, run_id, quality, structure, security, usefulness,
  CASE WHEN run_id % 5 = 0 THEN CAST(0 AS DECIMAL(4,1)) ELSE overall END AS overall, findings_count, files_analyzed,
  'static' AS mode FROM runs""")
add("win2_blocks", _DOC_LINES, f"SELECT repo, path, CAST(idx AS INTEGER) AS idx, md5(block) AS block_md5 FROM {v.blocks()}")
add("agg14_files_per_block", _DOC_LINES,
    f"SELECT repo, md5(block) AS block_md5, max(n_files) AS n_files FROM {_BLOCK_FILES} WHERE n_files >= 2 GROUP BY repo, block")
add("win3_function_spans", v.CODE_LINES, f"""SELECT repo, path, CAST(no AS INTEGER) AS line, name, CAST(len AS INTEGER) AS n_lines
FROM {v.spans()}""")

_REVIEW_FILES = """review_files AS (
  SELECT repo, regexp_replace(path, '\\.txt$', '.py') AS path, content FROM docs UNION ALL SELECT repo, path, content FROM code)"""
_BUDGET = f"""budget AS (
  SELECT *, before + snippet_chars <= 80000 AS included FROM (
    SELECT repo, path, content, n AS n_chars, snippet_chars,
      coalesce(sum(snippet_chars) OVER (PARTITION BY repo ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM (SELECT *, length(content) AS n, length(CASE WHEN length(content) > 6000 THEN left(content, 6000) || {LF} || '# ... ['
            || (length(content) - 6000) || ' more chars, file continues] ...' ELSE content END) AS snippet_chars
          FROM review_files WHERE NOT {v.any_ends('path', fv.REVIEW_SKIP_SUFFIXES)}))
  WHERE before <= 80000)"""
_REVIEW = (*_CODE, v.DOCS, _REVIEW_FILES, _BUDGET)
add("win5_review_budget", _REVIEW, """SELECT repo, path, CAST(n_chars AS INTEGER) AS n_chars,
  CAST(snippet_chars AS INTEGER) AS snippet_chars, CAST(before AS BIGINT) AS before, included FROM budget""")
add("prm2_review_prompt_parts", _REVIEW, f"""SELECT repo, CAST(1 AS INTEGER) AS part, path, md5({LF} || CASE
  WHEN NOT included THEN '--- ' || path || ' (skipped, ' || n_chars || ' chars) ---'
  ELSE '--- ' || path || ' ---' || {LF} || CASE WHEN n_chars > 6000 THEN left(content, 6000) || {LF} || '# ... ['
    || (n_chars - 6000) || ' more chars, file continues] ...' ELSE content END END) AS text_md5 FROM budget
UNION ALL SELECT DISTINCT repo, 0, '', md5({lit(prompts._REVIEW_HEAD)}) FROM budget
UNION ALL SELECT DISTINCT repo, 2, '', md5({lit(prompts._REVIEW_TAIL)}) FROM budget""")

# --- prompts, fences, tests ------------------------------------------------------------------------

_LINE = "'  ' || idx || '. [' || upper(severity) || '] ' || title || ' (line ' || line || '): ' || description"
_PROMPT_ROWS = """prompt_rows AS (
  SELECT repo, path, string_agg(entry, chr(10) ORDER BY idx) AS findings FROM (
    SELECT repo, file AS path, idx, {entry} AS entry FROM (
      SELECT *, row_number() OVER (PARTITION BY repo, file ORDER BY o_sub) AS idx FROM ({sql}))) GROUP BY repo, path)"""
add("prm1_validation_prompts", (v.DOCS, _PROMPT_ROWS.format(entry=_LINE, sql=v.sec1("docs"))),
    f"""SELECT repo, path, {fill(prompts._VALIDATE, path='path', content='left(content, 8000)', findings='findings')} AS prompt
FROM prompt_rows JOIN docs USING (repo, path)""")
add("prm3_fix_prompts", (v.DOCS, _PROMPT_ROWS.format(
    entry=_LINE + " || chr(10) || '     Suggestion: ' || suggestion", sql=v.sec1("docs"))),
    f"""SELECT repo, path, {fill(prompts._FIX, path='path', content='content', findings='findings')} AS prompt
FROM prompt_rows JOIN docs USING (repo, path)""")
add("ans1_unfenced", _DOCS, f"""SELECT repo, path, md5(CASE doc_id % 3 WHEN 0 THEN content || {LF}
  WHEN 1 THEN {strip('content')} END) AS body_md5 FROM docs""")
_TESTS = f"""test_answers AS (
  SELECT source AS repo, 'pkg' || doc_id || '/mod_' || (doc_id % 7) || '.py' AS path,
    'tests/test_mod_' || (doc_id % 7) || '.py' AS test_path,
    (CASE WHEN doc_id % 2 = 0 THEN 'import pytest' || {LF} ELSE '' END)
    || 'def test_1():' || {LF} || '    pass'
    || CASE WHEN doc_id % 3 >= 1 THEN {LF} || 'def test_2():' || {LF} || '    pass' ELSE '' END
    || CASE WHEN doc_id % 3 = 2 THEN {LF} || 'async def test_3():' || {LF} || '    pass' ELSE '' END
    || CASE WHEN doc_id % 4 = 2 THEN {LF} ELSE '' END AS code,
    CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END + doc_id % 3 AS num_tests
  FROM documents WHERE doc_id % 4 <> 3),
generated AS (
  SELECT repo, test_path, max(path) AS source_path, arg_max(code, path) AS code, arg_max(num_tests, path) AS num_tests
  FROM test_answers GROUP BY repo, test_path)"""
add("tst2_test_paths", (_TESTS,), "SELECT repo, test_path, source_path, CAST(num_tests AS INTEGER) AS num_tests FROM generated")
add("snk7_generated_test_files", (_TESTS,), """SELECT repo, test_path AS path, code AS content,
  CAST(octet_length(encode(code)) AS BIGINT) AS size FROM generated""")
_TEST_TOTALS = """totals AS (SELECT repo, CAST(sum(num_tests) AS BIGINT) AS tests_generated, count(DISTINCT test_path) AS n_files
  FROM test_answers GROUP BY repo)"""
add("agg13_test_totals", (_TESTS, _TEST_TOTALS), "SELECT * FROM totals")
add("tst3_test_report", (_TESTS, _TEST_TOTALS), f"""SELECT repo, CAST(block AS INTEGER) AS block, name,
  CAST(unnest(range(0, len(lines))) AS INTEGER) AS line_no, unnest(lines) AS line FROM (
  SELECT repo, 0 AS block, '' AS name, ['## Generated Tests', '', '**' || tests_generated || ' tests** generated across **'
    || n_files || ' files**', '', '### Files Written'] AS lines FROM totals
  UNION ALL SELECT repo, 1, test_path, ['- `' || test_path || '`'] FROM generated
  UNION ALL SELECT repo, 2, '', [''] FROM totals
  UNION ALL SELECT repo, 2, test_path, ['### `' || test_path || '`', '```python'] || string_split(code, {LF}) || ['```', '']
    FROM generated)""")

# --- scores, totals, report rows -------------------------------------------------------------------

_F = v.ALL_FINDINGS
_POINTS = "CASE severity " + " ".join(
    f"WHEN '{s}' THEN CASE analyzer " + " ".join(
        f"WHEN {lit(row[0])} THEN CAST({row[2 + i]} AS DECIMAL(3,1))" for row in fv.ANALYZERS) + " END"
    for i, s in enumerate(fv.SEVERITIES)) + " END"
_ANALYZER_VALUES = ", ".join(f"({lit(row[0])})" for row in fv.ANALYZERS[:7])
_SCORES = f"""analyzer_scores AS (
  SELECT r.repo, a.analyzer, CAST(greatest(1, least(10, 10 - coalesce(sum({_POINTS.replace('analyzer', 'f.analyzer')}), 0))) AS DECIMAL(6,1)) AS score
  FROM (SELECT DISTINCT repo FROM code) r CROSS JOIN (VALUES {_ANALYZER_VALUES}) a(analyzer)
  LEFT JOIN findings f ON f.repo = r.repo AND f.analyzer = a.analyzer GROUP BY r.repo, a.analyzer)"""
# One decimal HALF_UP in integer arithmetic: tenths and hundredths as BIGINT.
_T = lambda a: f"CAST(round(max(score) FILTER (WHERE analyzer = {lit(a)}) * 10) AS BIGINT)"
_D = lambda x: f"CAST(CAST({x} AS DECIMAL(6,1)) * CAST(0.1 AS DECIMAL(2,1)) AS DECIMAL(4,1))"
_REPO_SCORES = f"""tenths AS (
  SELECT repo, ({_T('Clarity')} + {_T('Functionality')} + 1) // 2 AS q, ({_T('Structure')} + {_T('Reusability')} + 1) // 2 AS st,
    {_T('Security')} AS se, {_T('Automation')} AS au FROM analyzer_scores GROUP BY repo),
usable AS (SELECT *, (au + q + 1) // 2 AS us FROM tenths),
repo_scores AS (
  SELECT repo, {_D('q')} AS quality, {_D('st')} AS structure, {_D('se')} AS security, {_D('us')} AS usefulness,
    {_D('(30 * q + 25 * st + 25 * se + 20 * us + 50) // 100')} AS overall FROM usable)"""
_SCORED = (*_F, _SCORES, _REPO_SCORES)
add("agg1_analyzer_scores", (*_F, _SCORES), "SELECT * FROM analyzer_scores")
_WEIGHTED = _REPO_SCORES.replace("25 * se", "w * se").replace(
    "AS us FROM tenths)", """AS us,
  CASE WHEN r % 5 <> 0 AND r % 3 <> 0 AND r % 2 = 0 THEN 40 ELSE 25 END AS w
  FROM tenths JOIN (SELECT source AS repo, min(doc_id) % 20 AS r FROM documents GROUP BY source) USING (repo))""")
add("agg2_weighted_scores", (*_F, _SCORES, _WEIGHTED), "SELECT repo, overall FROM repo_scores")
add("agg2_repo_scores", _SCORED, "SELECT repo, quality, structure, security, usefulness, overall FROM repo_scores")


def _tags(files: str) -> str:
    counts = []
    for tag, words in fv.TAG_KEYWORDS.items():
        one = " + ".join(
            f"CAST(bool_or(contains(lower(content), {lit(w)})) OR contains(lower(repo), {lit(w)}) AS INTEGER)" for w in words)
        counts.append(f"{one} AS {tag}")
    pick = " ".join(f"WHEN {t} = greatest(biz, ops, lab, util) THEN '{t}'" for t in fv.TAG_KEYWORDS)
    return f"""tags AS (SELECT repo, CASE WHEN greatest(biz, ops, lab, util) = 0 THEN 'util' {pick} END AS tag
  FROM (SELECT repo, {', '.join(counts)} FROM {files} GROUP BY repo))"""


add("agg3_tags", (*_both(), _tags("both_files")), "SELECT repo, tag FROM tags")
_CARD = f"""card AS (
  SELECT repo, quality, structure, security, usefulness, overall, n_files, tag, coalesce(total, 0) AS total,
    CASE WHEN overall >= 7.5 AND n_files > 3 THEN 'promote' WHEN overall >= 4.5 THEN 'maintain'
         WHEN overall >= 2.5 OR n_files <= 2 THEN 'maintain' ELSE 'archive' END AS recommendation
  FROM repo_scores JOIN tags USING (repo) JOIN (SELECT repo, count(*) AS n_files FROM code GROUP BY repo) USING (repo)
  LEFT JOIN (SELECT repo, count(*) AS total FROM findings GROUP BY repo) USING (repo))"""
_CARDS = (*_SCORED, _tags("code"), _CARD)
add("agg4_recommendations", _CARDS, "SELECT repo, overall, n_files, recommendation FROM card")
add("snk3_portfolio_csv", _CARDS,
    'SELECT repo AS "Repo", overall AS "Score", tag AS "Tag", recommendation AS "Recommendation", total AS "Findings" '
    "FROM card ORDER BY overall DESC, repo")
add("top2_portfolio_ranking", _CARDS, 'SELECT repo AS "Repo", overall AS "Score" FROM card ORDER BY overall DESC, repo')
add("prj5_color_bands", _CARDS, """SELECT repo, overall,
  CASE WHEN overall >= 7.5 THEN 'Green' WHEN overall >= 5 THEN 'Yellow' ELSE 'Red' END AS band FROM card""")
add("snk1_metadata", _CARDS, """SELECT repo AS repo_path, n_files AS files_analyzed, total AS total_findings, quality, structure,
  security, usefulness, overall, tag, recommendation, s.score AS security_analyzer, a.score AS ast_analyzer,
  'static' AS mode, FALSE AS auto_fix, FALSE AS fixes_applied
FROM card JOIN (SELECT repo, score FROM analyzer_scores WHERE analyzer = 'Security') s USING (repo)
JOIN (SELECT repo, score FROM analyzer_scores WHERE analyzer = 'AST Analysis') a USING (repo)""")
add("agg5_severity_counts", (*_F, v.DOCS), f"""SELECT repo, count(*) AS total, count(*) FILTER (WHERE severity = 'critical') AS critical,
  count(*) FILTER (WHERE severity = 'high') AS high
FROM (SELECT repo, severity FROM findings UNION ALL SELECT repo, severity FROM ({v.sec1('docs')})) GROUP BY repo""")
add("agg6_findings_by_file", _F, "SELECT repo, file, count(*) AS n_findings FROM findings GROUP BY repo, file")
add("agg7_notes", _AST, f"""SELECT repo, '- [Security] ' || note AS entry FROM {_IGNORE_NOTES}
UNION ALL SELECT repo, '- [Automation] ' || note FROM {_HOOK_NOTES}
UNION ALL SELECT repo, '- [AST Analysis] ' || note FROM {_SYNTAX_NOTES}""")
add("agg12_totals", _F, """SELECT repo, n_files, coalesce(total_findings, 0) AS total_findings
FROM (SELECT repo, count(*) AS n_files FROM code GROUP BY repo)
LEFT JOIN (SELECT repo, count(*) AS total_findings FROM findings GROUP BY repo) USING (repo)""")
_COST = """totals AS (SELECT repo, CAST(sum(length(content)) AS BIGINT) AS chars, count(*) AS file_count FROM docs GROUP BY repo),
tokens AS (SELECT repo, file_count, {i} AS input_tokens, {o} AS output_tokens FROM totals)"""
_USD = """SELECT repo, input_tokens, output_tokens, CAST(CAST((input_tokens * 3 + output_tokens * 15 + 50) // 100 AS DECIMAL(18,0))
  * CAST(0.0001 AS DECIMAL(5,4)) AS DECIMAL(18,4)) AS estimated_cost_usd, file_count FROM tokens"""
add("agg10_cost_smart", (v.DOCS, _COST.format(i="chars // 4 // 4", o="CAST(2000 AS BIGINT)")), _USD)
add("agg10_cost_auto_fix", (v.DOCS, _COST.format(i="chars // 4", o="chars // 4 // 2")), _USD)

_RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 99 END"
_F_AND_DOCS = (*_F, v.DOCS, v.findings_cte([v.sec1("docs")], "doc_findings"))
add("top1_top_findings", _F_AND_DOCS, f"""SELECT repo, CAST(rank AS INTEGER) AS rank, file, severity, title, line FROM (
  SELECT *, row_number() OVER (PARTITION BY repo ORDER BY {_RANK}, {v.ORDER}) AS rank
  FROM (SELECT * FROM findings UNION ALL BY NAME SELECT * FROM doc_findings)) WHERE rank <= 5""")
add("top3_first_names", v.CODE_LINES,
    f"SELECT repo, file, title, description FROM ({v.cla3()} UNION ALL {v.fun4()})")
add("top4_truncation", _DOCS, """SELECT repo, path, md5(left(content, 300)) AS d300, md5(left(content, 8000)) AS d8000,
  md5(left(content, 6000)) AS d6000 FROM docs""")
add("top5_sorted_files", _DOCS, "SELECT repo, path FROM docs ORDER BY repo, path")
add("set1_all_findings", _F, f"SELECT analyzer, category, check_id, {OUT}, code_before FROM findings")
add("ext1_custom_check", _CODE, """SELECT repo, 'Custom' AS analyzer, 'EXT_LONG' AS check_id, path AS file,
  'low' AS severity, 'Long file' AS title, CAST(size AS VARCHAR) || ' bytes' AS description FROM code WHERE size > 1000""")
add("set2_missing_ignore_entries", _CODE, f"""SELECT repo, entry FROM (SELECT repo, content, unnest({_ENTRIES}) AS entry
  FROM code WHERE path = '.gitignore' AND content <> '') WHERE NOT contains(content, entry)""")
add("set3_distinct_kinds", _CODE, f"""SELECT repo, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds
FROM (SELECT repo, {v.KIND} AS kind FROM code WHERE NOT contains(path, '/')) GROUP BY repo""")
add("rep1_descriptions", _CODE, f"""SELECT repo, coalesce(arg_min(d, (rank, path)), {lit(fv.NO_DESCRIPTION)}) AS description
FROM (SELECT repo, 0 AS rank, path, left(regexp_replace(string_split(content, {LF} || {LF})[1], '^[# ]+', ''), 300) AS d
      FROM code WHERE path = 'README.md'
      UNION ALL SELECT DISTINCT repo, 9, '', NULL FROM code)
GROUP BY repo""")
_ICON = "CASE severity " + " ".join(f"WHEN '{s}' THEN '{i}'" for s, i in fv.SEVERITY_ICONS.items()) + " ELSE '⚪' END"
_SUFFIX = "CASE WHEN coalesce(line, 0) <> 0 THEN ' (line ' || line || ')' ELSE '' END"
add("rep3_entries", _F, f"""SELECT repo, file, '- ' || {_ICON} || ' **' || title || '**' || {_SUFFIX} || ': ' || suggestion AS entry,
  upper(severity) AS severity_label, {_SUFFIX} AS line_suffix FROM findings""")
_STEPS = ", ".join(f"({lit('- ' + s)})" for s in fv.AUTOMATABLE_STEPS)
_DEFAULT_STEPS = ", ".join(f"({lit('- [ ] ' + s)})" for s in fv.DEFAULT_AUTOMATION_STEPS)
add("rep2_plan_rows", _F, f"""SELECT repo, CAST(priority AS INTEGER) AS priority, entry FROM (
  SELECT repo, 1 AS priority, '- [ ] **' || title || '** in `' || file || '` — ' || suggestion AS entry
  FROM findings WHERE severity IN ('critical', 'high')
  UNION ALL SELECT repo, 2, '- [ ] ' || suggestion FROM findings WHERE category = 'structure'
  UNION ALL SELECT repo, 3, '- [ ] ' || suggestion FROM findings WHERE category = 'automation'
  UNION ALL SELECT repo, 3, e FROM (SELECT DISTINCT repo FROM code), (VALUES {_DEFAULT_STEPS}) t(e)
    WHERE repo NOT IN (SELECT repo FROM findings WHERE category = 'automation')
  UNION ALL SELECT repo, 4, e FROM (SELECT DISTINCT repo FROM code), (VALUES {_STEPS}) t(e))""")

# --- projects --------------------------------------------------------------------------------------

_ROOT = "NOT contains(path, '/')"
_PROBE = lambda t: f"bool_or({_ROOT} AND ends_with(path, '.py') AND size < 100000 AND contains(content, {lit(t)}))"
_ATTRS = ", ".join(
    "(" + ", ".join("NULL" if x is None else lit(x) for x in row) + ")" for row in fv.PROJECT_TYPES)
_PROJECTS = f"""attributes(project_type, install_command, launch_command, port) AS (VALUES {_ATTRS}),
typed AS (
  SELECT repo, bool_or(starts_with(path, 'node_modules/')) AS node_modules, bool_or(path = 'requirements.txt') AS requirements,
    CASE WHEN bool_or(path IN ('next.config.ts', 'next.config.js')) THEN 'nextjs'
      WHEN bool_or(path IN ('vite.config.js', 'vite.config.ts')) THEN 'vite-react'
      WHEN bool_or(path = 'package.json') AND bool_or(starts_with(path, 'apps/')) THEN 'node-monorepo'
      WHEN bool_or(path IN ('pyproject.toml', 'setup.py')) THEN 'python-package'
      WHEN bool_or(path = 'app.py') AND bool_or(path = 'requirements.txt' AND contains(content, 'streamlit')) THEN 'streamlit'
      WHEN {_PROBE('from fastapi')} OR {_PROBE('import fastapi')} THEN 'fastapi'
      WHEN {_PROBE('from flask')} OR {_PROBE('import flask')} THEN 'flask'
      WHEN bool_or({_ROOT} AND {v.suffix('path')} = '.py') THEN 'python-script'
      WHEN bool_or(path IN ('docker-compose.yml', 'Dockerfile')) THEN 'docker'
      WHEN bool_or(path = 'index.html') THEN 'static-site'
      WHEN bool_or({_ROOT} AND {v.suffix('path')} = '.ps1') THEN 'powershell-scripts' ELSE 'unknown' END AS project_type
  FROM code_raw GROUP BY repo),
projects AS (
  SELECT repo, project_type, install_command, launch_command,
    CASE WHEN project_type IN ('nextjs', 'vite-react', 'node-monorepo') THEN NOT node_modules
      WHEN project_type IN ('python-package', 'streamlit', 'fastapi', 'flask') THEN TRUE
      WHEN project_type = 'python-script' THEN requirements ELSE FALSE END AS needs_install, port,
    CASE WHEN project_type = 'unknown' THEN 'not_scanned' WHEN launch_command IS NOT NULL THEN 'ready'
      ELSE 'not_launchable' END AS status,
    CAST(regexp_extract(repo, '([0-9]+)', 1) AS INTEGER) AS r
  FROM typed LEFT JOIN attributes USING (project_type))"""
_PROJ = (v.CODE_RAW, _PROJECTS)
add("prj1_project_types", _PROJ,
    "SELECT repo, project_type, install_command, launch_command, needs_install, port, status FROM projects")
add("prj2_content_probe", (v.CODE_RAW,), f"SELECT repo, {_PROBE('import json')} AS found FROM code_raw GROUP BY repo")
add("prj3_recent_projects", (_COMMITS, _LAST), f"""SELECT * FROM (
  SELECT repo, bool_or(c.is_git) AS is_git, max(last_commit_date) AS last_commit_date, max(last_commit_msg) AS last_commit_msg, max(last.branch) AS branch
  FROM commits c LEFT JOIN last USING (repo) GROUP BY repo)
WHERE coalesce(last_commit_date, '') >= CAST(CAST(DATE '{AS_OF}' + 4 AS DATE) AS VARCHAR) OR NOT is_git""")
add("prj4_by_name", _PROJ, """SELECT repo, 'named' AS why FROM projects WHERE lower(repo) = 'src4'
UNION ALL SELECT repo, 'launchable' FROM projects WHERE status = 'ready'""")
add("agg8_dashboard", _PROJ, """SELECT count(*) AS total, count(*) FILTER (WHERE r % 3 = 0) AS git_repos,
  count(*) FILTER (WHERE launch_command IS NOT NULL) AS launchable, count(*) FILTER (WHERE r % 4 = 1) AS uncommitted FROM projects""")
add("snk5_session_summary", _PROJ, """SELECT count(*) AS total, count(*) FILTER (WHERE status = 'ready' AND r % 2 = 0) AS launched,
  count(*) FILTER (WHERE status = 'ready' AND r % 2 <> 0) AS failed, count(*) FILTER (WHERE r % 5 = 0) AS reviewed FROM projects""")

# --- the report as a bag of lines per section --------------------------------------------------------

_TITLES = {1: "### Priority 1: Fix Critical Issues", 2: "### Priority 2: Improve Structure",
           3: "### Priority 3: Add Automation", 4: "### Automatable Improvements"}
_PLAN = ORACLE["rep2_plan_rows"].split("SELECT repo, CAST(priority AS INTEGER) AS priority, entry FROM (", 1)[1]
_PARTS = f"""described AS (
  SELECT repo, coalesce(max(d), {lit(fv.NO_DESCRIPTION)}) AS description FROM (
    SELECT repo, CASE WHEN path = 'README.md' THEN left(regexp_replace(string_split(content, {LF} || {LF})[1], '^[# ]+', ''), 300) END AS d
    FROM code) GROUP BY repo),
full_card AS (
  SELECT *, (SELECT count(*) FROM findings f WHERE f.repo = card.repo AND severity = 'critical') AS critical,
    (SELECT count(*) FROM findings f WHERE f.repo = card.repo AND severity = 'high') AS high
  FROM card JOIN described USING (repo)),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY {_RANK}, {v.ORDER}) AS rank FROM findings)
  WHERE rank <= 5),
notes AS (
  SELECT repo, '- [Security] ' || note AS entry FROM {_IGNORE_NOTES}
  UNION ALL SELECT repo, '- [Automation] ' || note FROM {_HOOK_NOTES}
  UNION ALL SELECT repo, '- [AST Analysis] ' || note FROM {_SYNTAX_NOTES}),
plan AS (SELECT * FROM ({_PLAN}),
bags AS (
  SELECT repo, 0 AS section, ['# Quality Report: ' || repo, '', '**Generated:** 2024-01-31 00:00', '**Version:** 1.0.0'] AS lines FROM card
  UNION ALL SELECT repo, unnest([1, 2, 3, 4, 8]), [''] FROM card
  UNION ALL SELECT repo, 1, ['## Summary', '', '**What this app does:** ' || description, '', '**Files analyzed:** ' || n_files,
    '**Total findings:** ' || total || ' (' || critical || ' critical, ' || high || ' high)', '', '### Scores (1-10)', '',
    '| Category   | Score |', '|------------|-------|', '| Quality    | ' || quality || ' |', '| Structure  | ' || structure || ' |',
    '| Security   | ' || security || ' |', '| Usefulness | ' || usefulness || ' |', '| **Overall**| **' || overall || '** |', '',
    '**Tag:** `' || tag || '`', '**Recommendation:** ' || CASE recommendation
      {' '.join(f"WHEN {lit(k)} THEN {lit(x)}" for k, x in fv.RECOMMENDATION_LABELS.items())} END] FROM full_card
  UNION ALL SELECT repo, 2, CASE WHEN total > 0 THEN ['## Top 5 Highest-Impact Improvements', '']
    ELSE ['## Top 5 Improvements', '', 'No significant issues found.'] END FROM card
  UNION ALL SELECT repo, 2, ['### ' || rank || '. ' || {_ICON} || ' [' || upper(severity) || '] ' || title, '**File:** `' || file || '`']
    || CASE WHEN coalesce(line, 0) <> 0 THEN ['**Line:** ' || line] ELSE [] END
    || ['', description, '', '**Suggestion:** ' || suggestion]
    || CASE WHEN coalesce(code_before, '') <> '' THEN ['', '```', '# Before:'] || string_split(code_before, {LF}) || ['```'] ELSE [] END
    || [''] FROM top
  UNION ALL SELECT repo, 3, CASE WHEN total > 0 THEN ['## File-by-File Analysis', '']
    ELSE ['## File-by-File Analysis', '', 'All files look clean.'] END FROM card
  UNION ALL SELECT repo, 3, ['### `' || file || '`', '*' || count(*) || ' finding(s)*', '', ''] FROM findings GROUP BY repo, file
  UNION ALL SELECT repo, 3, ['- ' || {_ICON} || ' **' || title || '**' || {_SUFFIX} || ': ' || suggestion] FROM findings
  UNION ALL SELECT repo, 3, [entry] FROM notes WHERE repo IN (SELECT repo FROM findings)
  UNION ALL SELECT DISTINCT repo, 3, ['### Additional Notes', '', ''] FROM notes WHERE repo IN (SELECT repo FROM findings)
  UNION ALL SELECT repo, 4, ['## Next Iteration Plan', ''] FROM card
  UNION ALL SELECT DISTINCT repo, 4, [CASE priority {' '.join(f"WHEN {n} THEN {lit(t)}" for n, t in _TITLES.items())} END]
    || CASE WHEN priority < 4 THEN [''] ELSE [] END FROM plan
  UNION ALL SELECT repo, 4, [entry] FROM plan
  UNION ALL SELECT repo, 8, ['---', '', '*Generated by lintlake v1.0.0*',
    '*One row set per repository; later runs are compared with this one.*'] FROM card)"""
add("snk2_report_lines", (*_CARDS, _PARTS),
    "SELECT repo, CAST(section AS INTEGER) AS section, unnest(lines) AS line FROM bags")
_SMART_PARTS = _PARTS.replace("'**Version:** 1.0.0'", "'**Version:** 2.0.0 (Smart)'")
_REPO_RUNS = _RUNS.replace("'user_' || user_id AS repo", "'src' || (user_id % 20) AS repo")
_SPLICED = f"""SELECT repo, CAST(section AS INTEGER) AS section, unnest(lines) AS line FROM (
  SELECT * FROM bags
  UNION ALL SELECT repo, 6, ['', '', '## Generated Tests', '', '**' || tests_generated || ' tests** generated across **'
    || n_files || ' files**', ''] FROM totals
  UNION ALL SELECT repo, 6, ['### `' || test_path || '`', '```python'] || string_split(code, {LF}) || ['```', ''] FROM generated
  UNION ALL SELECT repo, 7, ['', ''] || lines FROM section)"""
add("rep4_spliced_report", (*_CARDS, _SMART_PARTS, _TESTS, _TEST_TOTALS, _REPO_RUNS, _SECTION), _SPLICED)


# --- the reviewed run ------------------------------------------------------------------------

_ALL_VERDICTS = _VERDICTS.replace("  SELECT repo, analyzer,", "  SELECT check_id, o_analyzer, o_phase, o_path, o_check, o_sub, repo, analyzer,")
_AI = _REVIEWS.format(files="code")
_AI_POINTS = next(row[2:] for row in fv.ANALYZERS if row[0] == "AI Deep Review")
_AI_SCORE = "ai_score AS (SELECT repo, CAST(greatest(1, 10 - sum(CASE severity " + " ".join(
    f"WHEN {lit(s)} THEN {p}" for s, p in zip(fv.SEVERITIES, _AI_POINTS)) + f" ELSE {_AI_POINTS[-1]} END)) AS DECIMAL(6,1)) AS score FROM ai GROUP BY repo)"  # noqa: B905
_KEPT = """kept AS (
  SELECT repo, analyzer, file, severity, title, description, line, o_analyzer, o_phase, o_path, o_check, o_sub FROM validated
  UNION ALL SELECT repo, 'AI Deep Review', file, severity, title, description, line, 7, 0, '', 0, CASE WHEN title = 'Only title' THEN 1 ELSE 0 END FROM ai)"""
add("jn2_all_findings_validated", (*v.ALL_FINDINGS, _ALL_VERDICTS), f"SELECT check_id, {OUT} FROM validated")
add("agg1_ai_score", (*_CODE, _AI, _AI_SCORE), "SELECT repo, score FROM ai_score")
add("e1_smart_scorecard", (*_CARDS, _ALL_VERDICTS, _AI, _AI_SCORE, _KEPT), """SELECT repo, overall, tag, recommendation, n_files,
  coalesce(k, 0) AS total, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(b, 0) AS n_before,
  coalesce(b, 0) - coalesce(a, 0) AS n_dismissed, coalesce(c, 0) AS n_added, score AS ai_score
FROM card LEFT JOIN (SELECT repo, count(*) AS k, count(*) FILTER (WHERE severity = 'critical') AS critical,
                       count(*) FILTER (WHERE severity = 'high') AS high FROM kept GROUP BY repo) USING (repo)
LEFT JOIN (SELECT repo, count(*) AS b FROM findings GROUP BY repo) USING (repo)
LEFT JOIN (SELECT repo, count(*) AS a FROM validated GROUP BY repo) USING (repo)
LEFT JOIN (SELECT repo, count(*) AS c FROM ai GROUP BY repo) USING (repo) LEFT JOIN ai_score USING (repo)""")
_SMART_FIXES = f"""wanted AS (
  SELECT *, row_number() OVER (PARTITION BY repo, file ORDER BY {v.ORDER}) AS idx FROM kept
  WHERE severity IN ('critical', 'high', 'medium') AND EXISTS (FROM code WHERE code.repo = kept.repo AND path = file)),
hit_docs AS (
  SELECT repo, path, content, {_HIT} AS hit FROM code
  WHERE {_HIT} <> '' AND EXISTS (FROM wanted WHERE wanted.repo = code.repo AND file = path)),
answered AS (
  SELECT repo, path, content, 0 AS seq, 1 AS idx, hit AS original, {lit(_FIXED)} AS fixed, 'read from the environment' AS explanation
  FROM hit_docs
  UNION ALL SELECT repo, path, content, 2, 9, 'e', 'E', 'occurs many times' FROM hit_docs WHERE contains(content, 'e')),
once AS (
  SELECT a.repo, path, seq, coalesce(title, 'Fix') AS finding, original, fixed, explanation
  FROM answered a LEFT JOIN wanted w ON w.repo = a.repo AND w.file = a.path AND w.idx = a.idx
  WHERE {_TIMES('original')} = 1)"""
add("e1_smart_patches_section", (*v.ALL_FINDINGS, _ALL_VERDICTS, _AI, _KEPT, v.DOCS, _SMART_FIXES,
                                 _PATCHES_SECTION.replace(" UNION SELECT DISTINCT repo FROM docs", "")),
    f"SELECT repo, CAST(block AS INTEGER) AS block, '' AS name, {_BLOCK_LINES}")
add("e1_smart_top_findings", (*v.ALL_FINDINGS, _ALL_VERDICTS, _AI, _KEPT), f"""SELECT repo, CAST(rank AS INTEGER) AS rank, analyzer, file,
  severity, title, description, line
FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY {_RANK}, {v.ORDER}) AS rank FROM kept) WHERE rank <= 5""")

"""The file rules restated in plain Python over one text, for differential tests.

Each function returns a list of (line or None, title) in order.
"""

from __future__ import annotations

import ast
import re

from lintlake import fixed_values as fv

QUOTES = ('"""', "'''")


def _texts(content):
    return [(n, raw, raw.strip()) for n, raw in enumerate(content.split("\n"), start=1)]


def _indent(raw):
    return len(raw) - len(raw.lstrip())


def _pattern_hits(content, patterns):
    return [(1 + content.count("\n", 0, m.start()), title)
            for pattern, title in patterns for m in re.compile(pattern).finditer(content)]


def sec1(path, content):
    return [] if path.endswith(tuple(fv.SECRET_SKIP_SUFFIXES)) else _pattern_hits(content, fv.SECRET_PATTERNS)


def sec2(path, content):
    return _pattern_hits(content, fv.UNSAFE_PATTERNS)


def fun1(path, content):
    return [(n, f"{m} at line {n}") for n, raw, _ in _texts(content) if "#" in raw
            for m in fv.TODO_MARKERS if m in raw.upper()]


def fun2(path, content):
    lines = _texts(content)
    result = []
    for n, raw, _ in lines:
        head = re.match(fv.DEF_PATTERN, raw)
        body, in_doc = [], False
        for _, _, txt in lines[n:n + 9] if head else []:
            if len(body) == 2:
                break
            if txt.startswith(QUOTES):
                closes_itself = any(txt.count(q) == 2 for q in QUOTES)
                in_doc = not in_doc and not closes_itself
            elif not in_doc and txt and txt[0] != "#":
                body.append(txt)
        if len(body) == 2 and body[0] in fv.STUB_BODIES and re.match("def |class ", body[1]):
            result.append((n, f"Stub function: {head[1]}()"))
    return result


def fun3(path, content):
    lines = _texts(content)
    return [(a[0], "Silent exception swallowing") for a, b in zip(lines, lines[1:])
            if a[2] in fv.BARE_EXCEPTS and b[2] == "pass"]


def fun4(path, content):
    names, rest = [], []
    for _, raw, txt in _texts(content):
        if not txt.startswith(("import ", "from ")):
            rest.append(raw)
        if m := re.match(fv.IMPORT_PATTERN, txt):
            names.append(m[1])
        elif m := re.match(fv.FROM_IMPORT_PATTERN, txt):
            aliases = (part.strip().split(" as ")[-1].strip() for part in m[1].split(","))
            names += [a for a in aliases if a not in ("", "*")]
    body = "\n".join(rest)
    unused = [n for n in names if n not in body and n != "__"]
    return [(None, "Potentially unused imports: " + ", ".join(unused[:5]))] if unused else []


def fun5(path, content):
    lines = _texts(content)
    result = []
    for n, raw, txt in lines:
        if txt in fv.JUMP_STATEMENTS or txt.startswith("return "):
            later = next((y for y in lines[n:n + 4] if y[2]), None)
            if later and _indent(later[1]) > _indent(raw) and not later[2].startswith(tuple(fv.REACHABLE_STARTS)):
                result.append((later[0], "Unreachable code after return/break"))
    return result


def cla1(path, content):
    result = []
    for n, raw, txt in _texts(content):
        letters = [m for m in re.findall(fv.SINGLE_LETTER_PATTERN, raw) if m not in fv.ALLOWED_SINGLE_LETTERS]
        if letters and not txt.startswith(("#", "def ")):
            result.append((n, f"Single-letter variable: '{', '.join(letters)}'"))
    return result


def cla2(path, content):
    lines = _texts(content)
    heads = [(n, m[1]) for n, raw, _ in lines if (m := re.match(fv.DEF_PATTERN, raw))]
    ends = [n for n, _ in heads[1:]] + [len(lines) + 1]
    return [(n, f"Long function: {name}() ({end - n} lines)")
            for (n, name), end in zip(heads, ends) if end - n > 50]


def cla3(path, content):
    lines = _texts(content)
    missing = 0
    for n, raw, _ in lines:
        m = re.match(fv.DEF_OR_CLASS_PATTERN, raw)
        if m and not (m[1] == "def" and m[2].startswith("_")):
            following = next((y[2] for y in lines[n:n + 2] if y[2]), None)
            missing += following is not None and not following.startswith(QUOTES)
    return [(None, f"{missing} functions/classes missing docstrings")] if missing > 3 else []


def cla4(path, content):
    if "config" in path.lower():
        return []
    skipped = ("#", "def ", "class ", "import", "from")
    numbers = [float(x) for _, _, txt in _texts(content) if not txt.startswith(skipped)
               for x in re.findall(fv.NUMBER_PATTERN, txt)]
    magic = sum(x not in fv.MAGIC_NUMBER_WHITELIST for x in numbers)
    return [(None, f"{magic} magic numbers detected")] if magic > 10 else []


def cla5(path, content):
    depths = [(_indent(raw) // 4, -n) for n, raw, txt in _texts(content) if txt]
    depth, back = max(depths, default=(0, 0))
    return [(-back, f"Deep nesting ({depth} levels)")] if depth >= 5 else []


def str4(path, content):
    constants = [t for _, _, t in _texts(content) if ("= 0." in t or '= "' in t) and t.isupper()]
    loud = len(constants) > 3 and "config" not in path.lower()
    return [(None, "Hardcoded constants in logic file")] if loud else []


def reu3(path, content):
    return [(n, "Complex inline expression") for n, raw, txt in _texts(content)
            if len(txt) > 120 and raw.count("(") >= 3]


FILE_RULES = {f.__name__.upper(): f for f in (
    str4, reu3, cla1, cla2, cla3, cla4, cla5, fun1, fun2, fun3, fun4, fun5, sec1, sec2)}


def shared_blocks(files):
    """{block: sorted paths} of three-line blocks in at least two files."""
    where = {}
    for path, content in files.items():
        code = [t for _, _, t in _texts(content) if t and not t.startswith("#")]
        for three in zip(code, code[1:], code[2:]):
            block = "\n".join(three)
            if len(block) >= 30:
                where.setdefault(block, set()).add(path)
    return {b: sorted(p) for b, p in where.items() if len(p) >= 2}


def complexity(content):
    """{function: decisions + 1}."""
    weight = {ast.BoolOp: lambda n: len(n.values) - 1}
    one = (ast.If, ast.IfExp, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.Assert)
    return {
        f.name: 1 + sum(weight[type(n)](n) if type(n) in weight else isinstance(n, one) for n in ast.walk(f))
        for f in ast.walk(ast.parse(content)) if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef))
    }


def syntax_findings(content):
    """{(check, line, name)} of the five syntax checks, by walks of their own."""
    tree = ast.parse(content)
    everything = list(ast.walk(tree))
    ranges = []
    for n in everything:
        if isinstance(n, ast.If) and "TYPE_CHECKING" in ast.unparse(n.test).split("."):
            ranges.append(range(n.lineno, n.end_lineno + 1))
    bound = {}
    for n in (n for n in everything if isinstance(n, (ast.Import, ast.ImportFrom))):
        for a in n.names:
            if not (isinstance(n, ast.ImportFrom) and a.name == "*") and not any(n.lineno in r for r in ranges):
                bound[a.asname or a.name] = n.lineno
    used = {n.id for n in everything if isinstance(n, ast.Name)}
    for n in tree.body:
        if isinstance(n, ast.Assign) and any(ast.unparse(t) == "__all__" for t in n.targets):
            used |= set(ast.literal_eval(n.value))
    out = {("AST1", line, name) for name, line in bound.items() if name not in used}
    weights = {}
    for name, value in complexity(content).items():
        weights[name] = value
    for f in everything:
        if not isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)):
            continue
        if weights[f.name] > 10:
            out.add(("AST2", f.lineno, f.name))
        if f.end_lineno - f.lineno + 1 > 50:
            out.add(("AST3", f.lineno, f.name))
        if f.returns is None and not f.name.startswith("_"):
            out.add(("AST4", f.lineno, f.name))
        if any(isinstance(d, (ast.List, ast.Dict, ast.Set)) for d in [*f.args.defaults, *filter(None, f.args.kw_defaults)]):
            out.add(("AST5", f.lineno, f.name))
    return out

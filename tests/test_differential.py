"""Spark results against plain Python on hand-made edge texts and on generated ones."""

from __future__ import annotations

import random
import re

import pytest

from lintlake import fixed_values as fv
from lintlake.functions import ranking
from lintlake.operators import pyfacts, reusability
from lintlake.operators.findings import file_findings
from lintlake.options import DEFAULTS
from lintlake.plans.checks import FILE_CHECKS
from lintlake.sources.files import FILES_SCHEMA
from lintlake.sources.fixtures import SNIPPETS
from tests import plain_rules

EDGES = {
    "empty.py": "",
    "newline.py": "\n",
    "spaces.py": " \t\xa0\u3000\x1c\n  \n",
    "no_end.py": "x = eval(a)",
    "tabs.py": "def f():\n\treturn\n\t\tx = 1\n",
    "nbsp.py": "\xa0# todo fixme\xa0\nq\xa0= 1\n",
    "accents.py": "éa = 1\nß= 2\nÀ = \"Ü\"\nſk = 3\nTOKEN\u2003=\u2003'12345678'\n",
    "private.py": "\ue000eval (x) \ue001exec(y)\ue000\n\ue000eval(z)",
    "multi.py": "password =\n\n 'aaaa\nbbbb'\neval\n(1)\nos.system\n(2)",
    "loader.py": "yaml.load(a) ; yaml.load(b, Loader=c)\nyaml.load(\n d) # Loader\nyaml.load(e)",
    "ten.py": "\n".join(f"v{i} = {i + 10}" for i in range(10)),
    "eleven.py": "\n".join(f"v{i} = {i + 10}" for i in range(11)),
    "config_x.py": "\n".join(f"v{i} = {i + 10}" for i in range(30)),
    "numbers.py": "a = 12.5x 3. 1.2.3 \"4\" 5\" \"6 7a 08 100.0 1e5 ٣ 2.50 (9) -11 .12 13\" 14.x 15.16\"\n" * 4,
    "depth4.py": "a\n" + " " * 19 + "b",
    "depth5.py": "a\n" + " " * 20 + "b\n" + " " * 23 + "c\n",
    "f50.py": "def f():\n" + "    a\n" * 49 + "def g():\n    b",
    "f51.py": "def f():\n" + "    a\n" * 50 + "def g():\n    b",
    "docs3.py": "def a():\n    1\nclass B:\n    2\ndef c():\n\n\n    3\ndef _d():\n    4\ndef e():\n    5",
    "docs4.py": "def a():\n    1\nclass _B:\n    2\ndef c():\n\n    3\ndef e():\n    '''x'''\ndef f():\n    5",
    "stub.py": 'def a():\n    """x\n    y\n    """\n    # c\n\n    ...\n    def b(): pass\nclass C:\n    pass',
    "stub2.py": "def a():\n    '''one''' \n    raise NotImplementedError\n\nclass D:\n  pass\ndef z():\n    pass",
    "line120.py": "a(b(c(" + "x" * 111 + ")))\n" + "  a(b(c(" + "x" * 112 + ")))",
    "upper.py": 'A = 0.5\nB = "X"\nC = "Y"\nD = "Z"\nE = "é"\nF = "ß"',
    "imports.py": "import a, b\nimport os.path\nfrom . import (x, y as z ,)\nfrom m import * \nfrom k import __\nq = os",
    "except.py": "try:\n  a\nexcept Exception:\n\n  pass\nexcept:\n pass\n  except Exception: \n\tpass",
    "dead.py": "return 1\n\n\n\n  a\nbreak\n\n\n\n\n  b\ncontinue\n  elif x\nreturn\n    y",
    "lib.dll": "password='abcdefgh1'",
}


def _random_texts(n):
    rng = random.Random(7)
    pieces = [line for body in SNIPPETS.values() for line in body.split("\n")]
    pieces += ["", "   ", "\t", "return", "pass", "except:", '"""', "'''", "import zz", "# todo", "\xa0", "é = 3.25"]
    return {f"r{i}.py": "\n".join(rng.choice(["", "    ", "        "]) + rng.choice(pieces)
                                  for _ in range(rng.randrange(1, 60))) for i in range(n)}


TEXTS = {**EDGES, **_random_texts(120)}


@pytest.fixture(scope="module")
def files(spark):
    rows = [("r", p, c, len(c.encode())) for p, c in TEXTS.items()]
    return spark.createDataFrame(rows, FILES_SCHEMA)


def test_file_checks(files):
    got = {}
    for r in file_findings(files, FILE_CHECKS).orderBy("ord").collect():
        got.setdefault((r["check_id"], r["file"]), []).append((r["line"], r["title"]))
    for check_id, rule in plain_rules.FILE_RULES.items():
        fired = 0
        for path, content in TEXTS.items():
            want = rule(path, content)
            fired += bool(want)
            assert got.get((check_id, path), []) == want, (check_id, path)
        assert fired, check_id


def test_shared_blocks(files):
    got = {r["block"]: (r["first_file"], r["n_files"]) for r in reusability.duplicate_blocks(files).collect()}
    want = {b: (p[0], len(p)) for b, p in plain_rules.shared_blocks(TEXTS).items()}
    assert got == want and want
    members = {(r["block"], r["path"]) for r in reusability.block_files(files).collect()}
    assert members == {(b, p) for b, paths in plain_rules.shared_blocks(TEXTS).items() for p in paths}


def test_large_groups_stay_whole(spark):
    body = "alpha = compute(1)\nbeta = compute(2)\ngamma = compute(3)"
    rows = [("hot" if i % 3 else f"r{i % 7}", f"f{i:05d}.py", body, 60) for i in range(6000)]
    files = spark.createDataFrame(rows, FILES_SCHEMA)
    groups = {r["repo"]: r for r in reusability.duplicate_blocks(files).collect()}
    assert groups["hot"]["n_files"] == 4000 and groups["hot"]["first_file"] == "f00001.py"
    assert sum(g["n_files"] for g in groups.values()) == 6000
    labels = {r["repo"]: r["file"] for r in reusability.duplicate_block_findings(files).collect()}
    assert labels["hot"] == "f00001.py, and 3999 more"
    members = reusability.block_files(files).filter("repo = 'hot'").select("path").collect()
    assert sorted(r["path"] for r in members) == sorted(r[1] for r in rows if r[0] == "hot")


def test_blocks_travel_as_hashes(files):
    """No exchange below the hash filter carries a block or a content."""
    plan = reusability.block_sizes(files)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [repo" in plan
    columns = {f.name for f in reusability._block_members(files, DEFAULTS, "repo").schema}
    assert columns == {"repo", "path", "h", "h2", "idx"}


def test_shared_folder_is_asked_for():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ranking.shared_dir(Session())


def random_program(rng: random.Random) -> str:
    """A valid module with imports, guards, nested functions and branches; names are unique."""
    lines, count = [], iter(range(10_000))

    def block(depth: int, pad: str) -> None:
        for _ in range(rng.randint(1, 4)):
            kind = rng.randrange(9 if depth < 3 else 5)
            x = rng.choice("abcdef")
            if kind == 0:
                lines.append(f"{pad}{x} = {rng.choice(['m1', 'm2', x])} and b or c")
            elif kind == 1:
                lines.append(f"{pad}assert {x} if a else b")
            elif kind == 2:
                lines.append(f"{pad}import m{rng.randrange(6)}, pkg.m{rng.randrange(4)} as n{rng.randrange(4)}")
            elif kind == 3:
                lines.extend([f"{pad}{x} = {i}" for i in range(rng.choice([1, 2, 30]))])
            elif kind == 4:
                lines.append(f"{pad}print(n{rng.randrange(4)}, m{rng.randrange(6)})")
            elif kind in (5, 6):
                head = rng.choice(["if a:", "while b:", "for d in e:", "with f:"])
                lines.append(pad + head)
                block(depth + 1, pad + "    ")
            else:
                name = rng.choice(["f", "_g"]) + str(next(count))
                args = rng.choice(["", "a=[]", "b, *, c={}", "d=None", "e={1}, f=()"])
                lines.append(f"{pad}{rng.choice(['', 'async '])}def {name}({args}){rng.choice(['', ' -> int'])}:")
                block(depth + 1, pad + "    ")
                lines.append(pad + "    return a")

    lines.append("from typing import TYPE_CHECKING")
    if rng.random() < 0.7:
        lines += ["if TYPE_CHECKING:", "    import m5", "    from z import hidden"]
    for _ in range(4):
        block(0, "")
    if rng.random() < 0.5:
        lines.append("__all__ = ['m1', 'n2']")
    return "\n".join(lines)


def test_syntax_checks_against_other_walks(spark):
    rng = random.Random(11)
    texts = {f"s{n}.py": body for n, body in SNIPPETS.items()} | {f"p{i}.py": random_program(rng) for i in range(60)}
    files = spark.createDataFrame([("r", p, c, len(c)) for p, c in texts.items()], FILES_SCHEMA)
    got = {}
    for r in pyfacts.fact_findings(pyfacts.syntax_facts(files)).collect():
        name = re.sub(r"^[^:]*: ?|\(\).*$|^Mutable default argument in ", "", r["title"])
        got.setdefault(r["file"], set()).add((r["check_id"], r["line"], name))
    fired = set()
    for path, body in texts.items():
        try:
            want = plain_rules.syntax_findings(body)
        except SyntaxError:
            want = set()
        fired |= {w[0] for w in want}
        assert got.get(path, set()) == want, path
    assert fired == {"AST1", "AST2", "AST3", "AST4", "AST5"}


def test_complexity(spark):
    body = SNIPPETS[10]
    files = spark.createDataFrame([("r", "a.py", body, 1)], FILES_SCHEMA)
    funcs = pyfacts.syntax_facts(files).selectExpr("inline(funcs)").collect()
    assert {f["name"]: f["decisions"] + 1 for f in funcs} == plain_rules.complexity(body)


@pytest.mark.parametrize("body, want", [
    ("import a.b\nimport a.b as c\nc", ["a.b"]),
    ("import x\ndef f():\n    import x\n", ["x"]),
    ("from typing import TYPE_CHECKING\nif TYPE_CHECKING:\n    import q\nimport r\n", ["r"]),
    ("import typing\nif typing.TYPE_CHECKING:\n    import q\n", []),
    ("import u, v\n__all__ = ('u',)\n", ["v"]),
    ("import w\nw.x.y()\n", []),
])
def test_unused_imports(spark, body, want):
    files = spark.createDataFrame([("r", "a.py", body, 1)], FILES_SCHEMA)
    rows = pyfacts.fact_findings(pyfacts.syntax_facts(files), ["AST1"]).orderBy("ord").collect()
    assert [r["title"].removeprefix("Unused import: ") for r in rows] == want


def test_last_binding_gives_the_line(spark):
    body = "import x\nimport y\ndef f():\n    import x\n"
    files = spark.createDataFrame([("r", "a.py", body, 1)], FILES_SCHEMA)
    rows = pyfacts.fact_findings(pyfacts.syntax_facts(files), ["AST1"]).orderBy("ord").collect()
    assert [(r["title"], r["line"]) for r in rows] == [("Unused import: x", 4), ("Unused import: y", 2)]


def test_methods_and_bad_syntax(spark):
    body = "class A:\n    async def m(self):\n        return 1\n    def _p(self): pass\n    if 1:\n        def n(self): pass\n"
    files = spark.createDataFrame([("r", "a.py", body, 1), ("r", "b.py", "def (", 1), ("r", "c.py", "a\0b", 1)],
                                  FILES_SCHEMA)
    rows = {r["name"]: r for r in pyfacts.public_functions(files).collect()}
    assert set(rows) == {"m", "n"}
    assert (rows["m"]["class"], rows["m"]["is_async"], rows["n"]["class"]) == ("A", True, None)
    assert rows["m"]["source"] == "    async def m(self):\n        return 1"
    notes = {r["note"] for r in pyfacts.syntax_notes(pyfacts.syntax_facts(files)).collect()}
    assert notes == {fv.NOTE_SYNTAX.replace("{path}", p) for p in ("b.py", "c.py")}

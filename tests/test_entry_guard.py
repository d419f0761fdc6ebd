"""The entry works where the optional part cannot be imported."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("missing", ["lintlake.llm", "corpus_pipeline", "xxhash"])
def test_other_queries_stay(missing):
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; print(len(e.queries()), sum(q.startswith('op') for q in e.queries()), 'pipeline' in e.queries())"
    run = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120, check=True)
    n, optional, pipeline = run.stdout.split()
    assert int(n) > 120 and optional == "0" and pipeline == "False"

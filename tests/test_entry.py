import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("gone", [("tidewell/llm",), ("tidewell/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_entry_works_without_the_corpus_operators(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "tests", *(os.path.basename(g) for g in gone)))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), 'pipeline' in q, any(n.startswith('op1_') for n in q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True, check=True)
    n, pipeline, operators = done.stdout.split()
    assert int(n) >= 28 and pipeline == "False" and operators == str("tidewell/llm" not in gone and os.path.exists(f"{ROOT}/tidewell/llm"))

"""The library without its optional subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent


def _listed(folder):
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), len(e.oracle_sql()), sorted(k for k in q if k[:2] in ('p1', 'p6', 'p7', 'p8')))"
    return subprocess.run([sys.executable, "-c", code], cwd=folder, env={**os.environ, "PYTHONPATH": str(folder)}, capture_output=True, text=True)


def test_the_rest_works_without_llm(tmp_path):
    shutil.copytree(REPO / "sigframe", tmp_path / "sigframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    got = _listed(tmp_path)
    assert got.returncode == 0 and got.stdout.strip().endswith("[]"), got.stderr


def test_a_broken_module_is_an_error(tmp_path):
    shutil.copytree(REPO / "sigframe", tmp_path / "sigframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    (tmp_path / "sigframe" / "llm").mkdir()
    (tmp_path / "sigframe" / "llm" / "__init__.py").write_text("")
    (tmp_path / "sigframe" / "llm" / "queries.py").write_text("import a_module_that_is_not_there\n")
    got = _listed(tmp_path)
    assert got.returncode != 0 and "a_module_that_is_not_there" in got.stderr

"""The rest of the repository stands without the optional folders."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
OPTIONAL = ("foliant/llm", "tests/llm")


@pytest.mark.parametrize("without", [OPTIONAL, (*OPTIONAL, "corpus_pipeline.py")])
def test_entry_without_the_optional_folders(tmp_path, without):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=lambda folder, names: [n for n in names if n in (".git", "__pycache__") or os.path.relpath(os.path.join(folder, n), ROOT) in without])
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert 'text_chapters' in q and set(s) <= set(q) and not [n for n in q if n.startswith('op') or n == 'pipeline']"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, check=False)
    assert not done.returncode, done.stderr
    collected = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=copy, capture_output=True, text=True, check=False)
    assert not collected.returncode, collected.stdout


def test_optional_queries_are_there():
    if not os.path.isdir(os.path.join(ROOT, OPTIONAL[0])):
        pytest.skip("the optional folder is not there")
    import __spark_entry__ as e

    assert len([n for n in e.queries() if n.startswith("op")]) == 10 and "pipeline" in e.queries()

"""The driver's entry points, with the optional subpackage and without it."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent
SCRIPT = """
import __spark_entry__ as e
import storyloom.plans.queries, storyloom.plans.workspace, storyloom.streaming.ingest, bench
queries, sql = e.queries(), e.oracle_sql()
assert len(queries) > 90 and set(sql) <= set(queries)
assert not any(k.startswith("op") and k[2].isdigit() or k == "pipeline" for k in queries), sorted(queries)
"""


@pytest.mark.parametrize("gone", [("storyloom/llm", "tests/llm"), ("storyloom/llm", "tests/llm", "corpus_pipeline.py")])
def test_the_rest_works_without_the_optional_subpackage(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    for name in gone:
        if (copy / name).is_dir():
            shutil.rmtree(copy / name)
        else:
            (copy / name).unlink(missing_ok=True)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_queries_and_sql_have_the_same_names():
    sys.path.insert(0, str(REPO))
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

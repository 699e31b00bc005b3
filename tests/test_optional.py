"""The part for training data is optional: everything else works with its folders deleted."""

import os
import shutil
import subprocess
import sys

TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_optional_part(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(TOP, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "spark-warehouse", "metastore_db"))
    for gone in (["corpus_pipeline.py"], []):
        code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'flagship_wide' in q and set(o) <= set(q) and 'pipeline' not in q and not any(n.startswith('op1_') for n in q)"
        done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
        assert done.returncode == 0, done.stderr
        for name in gone:
            (copy / name).unlink(missing_ok=True)

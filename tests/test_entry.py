"""The driver contract, with and without the corpus operators."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as contract

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() == 1


def test_imports_without_corpus_operators(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'graph_statistics' in q and not any(k.startswith('op') for k in q); import provgraph.document, bench"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "repo", check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})

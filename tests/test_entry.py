"""The entry module with and without its optional part."""

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]


def test_contract():
    import __spark_entry__ as e

    queries, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(queries) and len(sql) >= 90 and callable(e.entry)


def test_rest_imports_alone(tmp_path):
    shutil.copytree(REPO, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'lead_view' in q and not any(n.startswith('op') or n == 'pipeline' for n in q), list(q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "repo", check=True, timeout=120)
    for module in ("leadweave.engine", "leadweave.streaming.crawl", "leadweave.streaming.events", "leadweave.sources.connectors", "leadweave.__main__"):
        subprocess.run([sys.executable, "-B", "-c", f"import {module}"], cwd=tmp_path / "repo", check=True, timeout=120)

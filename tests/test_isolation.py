"""The library without its corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_works_without_the_corpus_operators(tmp_path):
    own = tmp_path / "copy"
    shutil.copytree(ROOT, own, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py", "spark-warehouse"))
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 80 and set(s) <= set(q) and not any(k.startswith('op') for k in q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=own, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert not [p for p in own.rglob("*.py") if p.name != "__spark_entry__.py" and p.parent.name != "tests" and "traceloom.llm" in p.read_text()]


def test_queries_run_without_the_corpus_operators(tmp_path, sf_dir):
    own = tmp_path / "copy"
    shutil.copytree(ROOT, own, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py", "spark-warehouse"))
    code = f"""import __spark_entry__ as e
from traceloom.session import get_session
spark = get_session(2, spark__sql__shuffle__partitions="2")
assert e.entry(spark).count() > 0
for name in ("join_asof_click", "set_neighbour", "report_steps", "program_case"):
    assert e.queries()[name](spark, {sf_dir!r}).count() > 0, name
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=own, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]

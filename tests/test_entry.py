"""The driver's contract, with the training-data operators and without them."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry
from factloom.plans.queries import ORACLE_SQL, QUERIES

REPO = Path(__file__).resolve().parents[1]


def test_contract(spark):
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries()) and set(ORACLE_SQL) == set(QUERIES)
    found = entry.entry(spark)
    assert found.columns[0] == "id" and found.count() > 0


def imported(root, code):
    return subprocess.run([sys.executable, "-c", code], cwd=root, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(root), "HOME": str(root)}, capture_output=True, text=True)


def test_without_the_operators(tmp_path):
    shutil.copytree(REPO / "factloom", tmp_path / "factloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    ran = imported(tmp_path, "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))")
    assert ran.stdout.split() == [str(len(QUERIES))] * 2, ran.stderr
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module\n")  # any other missing module is a fault
    assert "no_such_module" in imported(tmp_path, "import __spark_entry__").stderr


def test_engine_needs_no_operators():
    for file in (REPO / "factloom").rglob("*.py"):
        if "llm" not in file.relative_to(REPO).parts:
            assert not re.search(r"\bllm\b", file.read_text()), file

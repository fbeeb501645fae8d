"""The driver contract holds, with and without the corpus subpackage."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
TABLES = Path("/root/testdata/sf0.001")


def test_entry_and_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 100


def test_imports_without_corpus(tmp_path):
    for p in ("__spark_entry__.py", "tracewright"):
        subprocess.run(["cp", "-r", str(ROOT / p), str(tmp_path)], check=True)
    for p in sorted((tmp_path / "tracewright" / "llm").rglob("*"), reverse=True):
        p.rmdir() if p.is_dir() else p.unlink()
    if (tmp_path / "tracewright" / "llm").exists():
        (tmp_path / "tracewright" / "llm").rmdir()
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') or n == 'pipeline' for n in q), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
    assert said.returncode == 0, said.stderr
    assert said.stdout.split()[1] == "False"


@pytest.mark.skipif(not TABLES.exists(), reason="no tables")
def test_flagship(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0

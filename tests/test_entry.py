"""The driver contract, and that the library stands without its optional subpackage."""
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 50


def test_flagship_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "text", "type", "start", "end_", "assertions"]
    assert df.limit(1).count() == 1


def test_optional_parts_may_be_missing(tmp_path):
    """A copy of the package without the optional subpackage still imports and registers the clinical queries."""
    import shutil

    shutil.copytree(ROOT / "medlattice", tmp_path / "medlattice", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'extract_all' in q and not any(n.startswith('op') and n[2].isdigit() for n in q), list(q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
    (tmp_path / "medlattice" / "llm").mkdir()
    for body in ("", "import nosuchmodule"):  # an empty folder is no subpackage; a missing need of a whole one is an error
        (tmp_path / "medlattice" / "llm" / "queries.py").write_text(body or "raise ImportError(name='medlattice.llm')", encoding="utf-8")
        done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
        assert (done.returncode == 0) == (not body), done.stderr
    shutil.rmtree(tmp_path / "medlattice" / "llm")
    for p in (tmp_path / "medlattice").rglob("*.py"):
        assert "medlattice.llm" not in p.read_text(encoding="utf-8") and ".llm" not in p.read_text(encoding="utf-8")

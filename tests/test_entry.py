import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_registry_names_and_columns():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_core_stands_without_the_subpackage():
    code = "import sys; sys.modules['newsloom.llm'] = None; import __spark_entry__ as e; assert e.llm is None and 'p3_found' in e.queries() and 'p1_found' not in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, timeout=120).returncode == 0


def test_nothing_else_imports_the_subpackage():
    named = [p for p in (ROOT / "newsloom").rglob("*.py") if "llm" not in p.parts and "newsloom.llm" in p.read_text()]
    assert named == []

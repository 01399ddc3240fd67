"""The entry module works without the optional folders."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_import_without_llm():
    code = "import sys; sys.modules['millrace.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q); assert e.oracle_sql().keys() <= q.keys()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_nothing_else_imports_llm():
    for path in (ROOT / "millrace").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "llm" not in path.read_text(), path


def test_sql_names_are_queries():
    import __spark_entry__ as entry

    assert entry.oracle_sql().keys() <= entry.queries().keys()

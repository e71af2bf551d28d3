"""The driver's contract, and that the core stands without the llm subpackage."""

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]


def test_contract():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and {"p3_found", "p7_found", "ref_t4_merge_candidates"} <= set(q)


def test_core_without_llm():
    code = "import sys; sys.modules['graphmill.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p7_found' in q and 'p1_found' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True, timeout=120)


def test_core_never_imports_llm():
    for p in (REPO / "graphmill").rglob("*.py"):
        if "llm" not in p.relative_to(REPO).parts:
            assert "graphmill.llm" not in p.read_text() or p.name == "__spark_entry__.py", p


def test_flagship(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["name", "position"]

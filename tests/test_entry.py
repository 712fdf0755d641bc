"""The driver contract holds, with and without the llm subpackage."""

import importlib
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_names_agree():
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"p1_found", "p6_found"} <= set(entry.queries())


def test_core_does_not_import_llm():
    code = "import sys; sys.modules['deuceframe.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(x.startswith(('p2_', 'p7_')) for x in q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
    for path in (ROOT / "deuceframe").rglob("*.py"):
        if "llm" not in path.parts:
            assert "deuceframe.llm" not in path.read_text(), path


def test_flagship(spark):
    rows = importlib.import_module("__spark_entry__").entry(spark).collect()
    assert rows and {"year", "model", "log_loss"} <= set(rows[0].asDict())

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]

WITHOUT = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[:2] == ["pointloom", "llm"] or name == "corpus_pipeline":
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert e.queries() and not any(q.startswith("op") or q == "pipeline" for q in e.queries() if q != "operators")
assert set(e.oracle_sql()) <= set(e.queries())
"""


def test_the_rest_works_without_the_document_operators():
    subprocess.run([sys.executable, "-c", WITHOUT], cwd=ROOT, check=True)


def test_nothing_else_imports_the_document_operators():
    for path in (ROOT / "pointloom").rglob("*.py"):
        if "llm" not in path.parts:
            assert "pointloom.llm" not in path.read_text(), path


def test_entry_and_names(spark):
    got = entry.entry(spark)
    assert got.columns[:4] == ["object_name", "seq", "label", "n"] and got.count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

"""The driver's entry module: registered queries, and life without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"


def test_names_match():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the driver's tables")
def test_flagship(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0


def test_without_the_subpackage():
    code = """
import sys
class Absent:
    def find_spec(self, name, path=None, target=None):
        if name.split('.')[0] == 'corpus_pipeline' or name.startswith('lattica.llm'):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Absent())
import __spark_entry__ as e
assert e.llm is None and len(e.queries()) > 50 and not any(k.startswith('op1_') or k == 'pipeline' for k in e.queries())
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "lattica").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            text = path.read_text()
            assert "lattica.llm" not in text and "from .llm" not in text and "from ..llm" not in text, path

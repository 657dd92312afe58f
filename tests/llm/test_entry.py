"""Registration: the optional part adds its queries, the rest does without."""

import subprocess
import sys
from pathlib import Path

import pytest

from __spark_entry__ import oracle_sql, queries
from tastemill.llm.queries import QUERIES, SQL

ROOT = Path(__file__).resolve().parents[2]


def test_each_operator_has_one_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(queries()) and set(SQL) <= set(oracle_sql())


def test_the_rest_imports_without_the_optional_part():
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('tastemill.llm'):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert not [q for q in e.queries() if q.startswith('op') or q == 'pipeline'] and len(e.queries()) > 100\n"
        "assert not [m for m in sys.modules if m.startswith('tastemill.llm')]\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


@pytest.mark.parametrize("module", ["ahocorasick", "zstandard"])
def test_a_missing_library_takes_the_optional_part_only(module):
    code = f"import sys; sys.modules[{module!r}] = None; import __spark_entry__ as e; assert len(e.queries()) > 100 and 'pipeline' not in e.queries()"
    found = subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, capture_output=True, text=True)
    assert "training-data queries are left out" in found.stderr and module in found.stderr


def test_nothing_else_imports_the_optional_part():
    for source in [*(ROOT / "tastemill").rglob("*.py"), *(ROOT / "checks").rglob("*.py"), ROOT / "bench.py"]:
        if "llm" not in source.parts:
            assert "tastemill.llm" not in source.read_text() and "corpus_pipeline" not in source.read_text(), source

import subprocess
import sys
from pathlib import Path

import pytest

from tests.oracle import check
from wavegrid.plans import catalog

ROOT = Path(__file__).resolve().parents[1]
DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_equals_oracle(spark, name):
    check(spark, DATA, catalog.QUERIES[name], catalog.ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["path", "chunk_idx", "start_s", "end_s", "rank", "species", "confidence"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_corpus_operators(tmp_path):
    """The core works where the corpus package is not installed."""
    import shutil

    shutil.copytree(ROOT / "wavegrid", tmp_path / "wavegrid", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'audio_predict_long' in q and not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_entry_where_the_corpus_operators_cannot_be_imported(tmp_path):
    """A machine without one of their libraries still has the core queries."""
    code = "import sys; sys.modules['zstandard'] = None; import __spark_entry__ as e; q = e.queries(); assert 'audio_predict_long' in q and not any(n.startswith('op') for n in q) and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_the_core_does_not_import_the_corpus_operators():
    for path in (ROOT / "wavegrid").rglob("*.py"):
        if "llm" not in path.parts:
            assert "wavegrid.llm" not in path.read_text(), path

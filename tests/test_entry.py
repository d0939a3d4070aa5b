"""The entry point without the optional subpackage, or a library of it."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parents[1]


@pytest.mark.parametrize("hidden", ["xxhash", "beamloom.llm", "corpus_pipeline"])
def test_engine_queries_stay(hidden):
    code = f"import sys; sys.modules[{hidden!r}] = None; import __spark_entry__ as e; q = e.queries(); assert 'full_run' in q and 'job1_delivered_spots' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


def test_queries_have_oracles_of_their_names():
    sys.path.insert(0, str(ROOT))
    import __spark_entry__

    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) >= 50


def test_entry_runs(spark):
    import __spark_entry__

    assert len(__spark_entry__.entry(spark).collect()) > 0


@pytest.mark.parametrize("left", ["nothing", "pipeline", "caches"])
def test_imports_without_the_training_data_part(tmp_path, left):
    """The two folders are deleted; the pipeline may stay behind, and so may compiled files of a folder."""
    import shutil

    copy = tmp_path / "repo"
    gone = [".git", "llm", "__pycache__"] + (["corpus_pipeline.py"] if left == "nothing" else [])
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(*gone))
    if left == "caches":
        (copy / "rooftide" / "llm" / "__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not any(k.startswith('op') for k in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=120)

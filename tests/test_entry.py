import subprocess
import sys

import __spark_entry__ as entry
from tests.conftest import ROOT


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_the_rest_stands_without_the_llm_folders(tmp_path):
    """A copy without attestor/llm and corpus_pipeline.py imports and lists the other queries."""
    import shutil

    shutil.copytree(f"{ROOT}/attestor", tmp_path / "attestor", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True, check=True)
    n, pipeline, subset = said.stdout.split()
    assert int(n) > 20 and pipeline == "False" and subset == "True"

"""The driver contract holds without the optional parts."""

import os
import shutil
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q), sum(n.startswith('op') for n in q), 'pipeline' in q)"


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_the_optional_folders(tmp_path, pipeline):
    """Whether the pipeline's file stays behind or not, the library's queries are all there, and nothing else."""
    where = tmp_path / "repo"
    where.mkdir()
    shutil.copytree(f"{REPO}/terragrid", where / "terragrid", ignore=lambda d, names: {n for n in names if n in ("llm", "__pycache__")})
    for name in ["__spark_entry__.py", *["corpus_pipeline.py"] * (pipeline and os.path.exists(f"{REPO}/corpus_pipeline.py"))]:
        shutil.copy(f"{REPO}/{name}", where / name)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", ASK], cwd=where, env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    n, corpus, there = out.stdout.split()
    assert int(n) > 90 and corpus == "0" and there == "False"

"""The entry file without the training-data folders: all other queries are there, with or without the pipeline file."""
import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.abspath(entry.__file__))


@pytest.mark.parametrize("pipeline", [True, False])
def test_import_without_the_optional_folders(tmp_path, pipeline):
    shutil.copytree(f"{ROOT}/pulsegrid", tmp_path / "pulsegrid", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline else [])]:
        shutil.copy(f"{ROOT}/{name}", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sorted(e.queries())[:3], any(n.startswith('op') and n[2].isdigit() for n in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert out.returncode == 0, out.stderr
    assert int(out.stdout.split()[0]) > 200 and out.stdout.strip().endswith("False")


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())

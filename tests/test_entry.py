"""The driver's contract, with and without the training-data subpackage."""

import subprocess
import sys

import __spark_entry__ as entry


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_subpackage(tmp_path):
    import os
    import shutil

    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(os.path.join(root, "corvellum"), tmp_path / "corvellum", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(os.path.join(root, "jobs"), tmp_path / "jobs")
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and 'qc_metrics' in q and 'job1_evidence_manifest' in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)

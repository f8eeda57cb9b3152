"""The driver's contract, and that the rest works without the training-data operators."""

import os
import shutil
import subprocess
import sys

import __spark_entry__
import pytest
from conftest import ROOT


def test_entry_and_keys(spark):
    rows = __spark_entry__.entry(spark)
    assert rows.count() > 0 and "bucket" in rows.columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("left", ["nothing", "compiled files", "the pipeline"])
def test_without_the_operators(tmp_path, left):
    shutil.copytree(os.path.join(ROOT, "usagelake"), tmp_path / "usagelake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    if left == "compiled files":
        (tmp_path / "usagelake" / "llm" / "__pycache__").mkdir(parents=True)
    if left == "the pipeline":
        (tmp_path / "corpus_pipeline.py").write_text("from usagelake.llm import quality\n")
    code = ("import __spark_entry__ as e\nassert 'report_daily' in e.queries() and not any(k.startswith('op') or k == 'pipeline' for k in e.queries())\n"
            "assert set(e.oracle_sql()) <= set(e.queries())")
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_errors_in_a_present_module_are_raised(tmp_path):
    (tmp_path / "usagelake" / "llm").mkdir(parents=True)
    (tmp_path / "usagelake" / "llm" / "queries.py").write_text("import a_module_that_is_not_there\n")
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e\ne.queries()"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert run.returncode and "a_module_that_is_not_there" in run.stderr

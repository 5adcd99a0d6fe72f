"""Every query against its SQL, on the smallest tables."""

import glob
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from tidemill import queries as Q

SF = os.environ.get("TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", list(Q.queries()))
def test_query(spark, duck, name):
    got = Q.queries()[name](spark, SF).toPandas()
    if name not in Q.oracle_sql():
        assert len(got)
        return
    want = duck.sql(Q.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert sorted(want.columns) == cols
    flat = lambda df: sorted(map(tuple, df[cols].astype(str).values.tolist()))
    assert flat(got) == flat(want)


def test_entry_without_the_training_data_operators(tmp_path):
    """With that subpackage and what calls it gone, the rest imports and offers its queries."""
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "tidemill", tmp_path / "tidemill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import pkgutil, importlib, tidemill, __spark_entry__ as e\nfor m in pkgutil.walk_packages(tidemill.__path__, 'tidemill.'): importlib.import_module(m.name)\nprint(*sorted(e.queries()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, check=True)
    assert said.stdout.split() == sorted(Q.queries())


def test_entry_does_not_hide_other_missing_modules(tmp_path):
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "tidemill", tmp_path / "tidemill", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    if not (tmp_path / "tidemill/llm").exists():
        pytest.skip("the subpackage is not there")
    (tmp_path / "tidemill/llm/common.py").write_text("import a_module_that_is_not_installed\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env=env, capture_output=True, text=True, check=False)
    assert said.returncode and "a_module_that_is_not_installed" in said.stderr


def test_timeout_then_take_ends_at_a_silence(spark, tmp_path):
    at = [0, 60, 120, 120 + 7199, 120 + 7199 + 7200, 20000]
    spark.createDataFrame([(i, t) for i, t in enumerate(at)], "event_id long, s long").selectExpr("event_id", "timestamp_seconds(s) AS ts").write.parquet(f"{tmp_path}/events.parquet")
    assert sorted(r.event_id for r in Q.queries()["timeout_then_take"](spark, str(tmp_path)).collect()) == [0, 1, 2, 3]

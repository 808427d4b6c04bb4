"""Each registered query gives the rows of its SQL; the entry points work without the optional parts."""

import glob
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from weft.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rounded(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    rows = sorted((tuple(rounded(r[c]) for c in names) for r in df.collect()), key=repr)
    if name not in ORACLES:
        assert rows
        return
    want = duck.sql(ORACLES[name])
    at = [want.columns.index(c) for c in names]
    assert rows == sorted((tuple(rounded(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_without_the_optional_parts(tmp_path):
    for x in ("weft", "__spark_entry__.py", "corpus_pipeline.py"):
        if not os.path.exists(f"{ROOT}/{x}"):
            continue
        copy = shutil.copytree if os.path.isdir(f"{ROOT}/{x}") else shutil.copy
        copy(f"{ROOT}/{x}", tmp_path / x)
    shutil.rmtree(tmp_path / "weft" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and 'bundle' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)


def test_a_library_of_the_optional_parts_is_missing():
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; q = e.queries(); assert 'bundle' in q and set(e.oracle_sql()) <= set(q) and not any(n.startswith('op') for n in q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=env, check=True, timeout=120)

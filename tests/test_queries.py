import glob
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import loamgrid.queries as core
from loamgrid.session import shared_root


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob("/root/testdata/sf0.001/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows(df: pd.DataFrame) -> list:
    plain = lambda v: None if pd.isna(v) else float(v) if isinstance(v, (int, float)) or hasattr(v, "dtype") else v
    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", core.QUERIES)
def test_query_equals_sql(spark, sf_dir, con, name):
    got, want = core.QUERIES[name](spark, sf_dir).toPandas(), con.execute(core.ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["id", "x", "y", "z"]
    assert set(core.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_optional_parts(tmp_path):
    """A copy without the training-data operators, with and without their pipeline, still has all other queries."""
    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "loamgrid", tmp_path / "loamgrid", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (root / name).exists():
            shutil.copy(root / name, tmp_path)
    ask = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    for _ in range(2):
        out = subprocess.run([sys.executable, "-c", ask], cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, check=True)
        assert out.stdout.split() == [str(len(core.QUERIES)), str(len(core.ORACLE_SQL))]
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)


def test_no_machine_local_folder_on_a_cluster():
    class Session:
        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return {}

        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_root(Session)

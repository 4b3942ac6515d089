"""The driver contract in __spark_entry__.py."""

import re

import __spark_entry__ as entry
from convprep.plans.catalog import QUERIES as LIBRARY


def test_oracles_belong_to_queries_and_names_are_plain():
    q = {k: v for k, v in entry.queries().items() if k in LIBRARY}
    o = {k: v for k, v in entry.oracle_sql().items() if k in LIBRARY}
    assert set(o) <= set(q)
    for name in q:
        assert re.fullmatch(r"[a-z][a-z0-9_]*", name), name
        assert not name.startswith("pipeline") and not re.match(r"op\d+_", name), name
    assert set(q) == set(o)


def test_oracle_sql_is_text_over_known_tables():
    from convprep.sources.tables import TABLES

    for name, sql in entry.oracle_sql().items():
        assert isinstance(sql, str) and "select" in sql.lower(), name
        assert any(re.search(rf"\b{t}\b", sql) for t in TABLES), name


def test_python_worker_queries_run_from_another_directory(tmp_path):
    """Executor Python workers import convprep from the shipped zip, not from
    the working directory (a driver may start anywhere)."""
    import os
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import importlib.util
spec = importlib.util.spec_from_file_location("spark_entry", {os.path.join(repo, "__spark_entry__.py")!r})
m = importlib.util.module_from_spec(spec); spec.loader.exec_module(m)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
print("rows", m.queries()["udf_tokenize"](spark, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True,
                         timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    assert "rows 200" in out.stdout

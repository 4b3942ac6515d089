"""Plan checks: built-in paths stay in the JVM and never pair all rows."""

import pytest

from conftest import SF_SMALL
from convprep.plans.catalog import QUERIES as LIBRARY

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "MapInPandas", "FlatMapGroupsInPandas")
PYTHON_OK = {"udf_tokenize", "conversation_corpus_shards", "batch_summaries", "translated_keywords", "translated_keywords_last1", "picked_keywords", "subword_pieces", "subword_encode", "supplier_nucleus_hot", "line_nucleus_by_weight",
             "supplier_draws_hot"}
# Iterative sub-word queries (their plans hold a Python replay by design).
SKIP = {"subword_merges", "subword_pieces", "subword_encode"}


def _plan(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(LIBRARY) - SKIP))
def test_no_cartesian_and_python_only_where_declared(spark, name):
    plan = _plan(LIBRARY[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name not in PYTHON_OK:
        assert not any(n in plan for n in PYTHON_NODES), name


def test_parquet_scan_prunes_and_pushes(spark):
    df = LIBRARY["sender_messages"](spark, SF_SMALL)
    plan = _plan(df)
    assert "ReadSchema: struct<conv_id:bigint,turn:bigint,role:string,text:string>" in plan
    assert "PushedFilters: [IsNotNull(role), EqualTo(role,assistant)" in plan


def test_single_partition_exchange_only_over_bucket_sizes(spark):
    """The dense index has one small single-partition step: the running sum
    over per-bucket sizes. It must sit above an aggregate, never a scan."""
    from pyspark.sql import functions as F

    from convprep.operators.index import dense_index
    from convprep.plans import fixtures as fx

    df = dense_index(fx.load(spark, SF_SMALL, "documents").select("doc_id", "n_chars"), [F.desc("n_chars"), "doc_id"])
    plan = _plan(df)
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            below = "\n".join(lines[i + 1:i + 4])
            assert "HashAggregate" in below, below


@pytest.mark.parametrize("name", sorted(set(LIBRARY) - SKIP))
def test_single_partition_steps_are_over_aggregates(spark, name):
    """No query funnels rows into one task: every single-partition exchange
    reads an aggregate's output (bucket sizes, a global count)."""
    plan = _plan(LIBRARY[name](spark, SF_SMALL))
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            below = []
            for nxt in lines[i + 1:]:
                if "Exchange" in nxt or "Scan" in nxt:
                    below.append(nxt)
                    break
                below.append(nxt)
            assert any("Aggregate" in b for b in below), (name, "\n".join(below))

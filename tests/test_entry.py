"""The driver's contract, on the smallest tables."""

from __future__ import annotations

import os
import re

import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables aren't here")


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["p1_found", "bm25_topk", "acl_longest_prefix", "manifest_difference", "ir_metrics", "interval_overlap"])
def test_sql_agrees(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as e

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    cur = con.execute(e.oracle_sql()[name])
    other, names = cur.fetchall(), [d[0] for d in cur.description]
    df = e.queries()[name](spark, DATA)
    own = df.select(*names).collect()
    flat = lambda rows: sorted(re.sub(r"\b(\d+\.\d{6})\d+", r"\1", repr(tuple(r))) for r in rows)
    assert sorted(df.columns) == sorted(names) and flat(own) == flat(other)


def test_core_does_not_import_llm():
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "corpusmith")
    for folder, _, files in os.walk(root):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    assert "corpusmith.llm" not in open(os.path.join(folder, f)).read(), f


def test_path_scores_sends_hints(spark):
    """The hints are sent to the pieces of all paths; the pieces, of whose number Spark has no estimate, to nobody."""
    import __spark_entry__ as e

    plan = e.queries()["path_scores"](spark, DATA)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("BuildRight") == plan.count("Join ") == 2

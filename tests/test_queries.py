"""Every registered query against its DuckDB oracle on the small tables (row count, column names and an
order-insensitive hash of the values); queries without SQL run and are checked for shape and range."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from commentlab.plans import registry
from tests.conftest import SF_SMALL
from tools.oracle_check import _digest, frame_rows

registry.load_all()
QUERIES = dict(registry.QUERIES)
ORACLE = dict(registry.ORACLE)


def test_every_query_has_a_name_and_most_have_sql():
    assert len(QUERIES) >= 90
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())
    assert len(set(QUERIES) - set(ORACLE)) <= 6


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 2 and set(df.columns) >= {"label", "positives", "total", "mean", "q50"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    got = QUERIES[name](spark, SF_SMALL).toPandas()
    want = duck.execute(ORACLE[name]).df()
    gc, gr = frame_rows(got)
    wc, wr = frame_rows(want)
    assert gc == wc
    assert len(gr) == len(wr)
    assert _digest(gr) == _digest(wr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_non_sql_query_runs(spark, name):
    rows = QUERIES[name](spark, SF_SMALL).collect()
    assert rows
    for r in rows:
        d = r.asDict()
        for k in ("accuracy", "auc", "macro_accuracy"):
            if d.get(k) is not None:
                assert 0.0 <= d[k] <= 1.0
    if name == "model_selection":
        assert sum(r["is_best"] for r in rows) == 1
    if name == "loss_history":
        by = {}
        for r in rows:
            by.setdefault(r["series"], []).append((r["step"], r["value"]))
        for hist in by.values():
            vals = [v for _, v in sorted(hist)]
            assert vals[-1] <= vals[0] + 1e-9

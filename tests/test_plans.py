"""Plan checks: the physical plans are the ones we want at scale."""

import contextlib
import io
import re

import pytest

import __spark_entry__ as E
from testkit import SF_SMALL


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def q():
    return E.queries()


def test_topk_is_take_ordered(spark, q):
    assert "TakeOrderedAndProject" in plan(q["topic_top10"](spark, SF_SMALL))


def test_per_key_cap_uses_window_group_limit(spark, q):
    p = plan(q["cap_per_user"](spark, SF_SMALL))
    assert "WindowGroupLimit" in p


def test_scan_is_pruned_and_filtered(spark, q):
    p = plan(q["scan_pruned"](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in p
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderdate:timestamp_ntz>" in p


def test_literal_lookups_need_no_join(spark, q):
    for name in ("infer_region", "model_topic"):
        p = plan(q[name](spark, SF_SMALL))
        assert "Join" not in p, name


def test_profiles_are_one_scan(spark, q):
    for name in ("null_profile", "minmax_profile", "corr_matrix", "duplicate_counts"):
        p = plan(q[name](spark, SF_SMALL))
        assert len(re.findall(r"^\(\d+\) Scan parquet", p, re.M)) == 1, name


def test_no_python_on_relational_paths(spark, q):
    skip = {"train_eval", "top_contributions"}
    for name, fn in q.items():
        if name in skip or name.startswith("stream_"):
            continue
        p = plan(fn(spark, SF_SMALL))
        assert "EvalPython" not in p and "PythonUDF" not in p, name


def test_dimension_join_is_broadcast(spark, q):
    p = plan(q["region_lookup"](spark, SF_SMALL))
    assert "BroadcastHashJoin" in p or "BroadcastExchange" in p

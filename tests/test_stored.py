"""The views of the test tables that are written before a run."""

from __future__ import annotations

import os

import pytest

from linkweave.plans.adapter import Tables

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_order_lines_are_dealt_by_customer_once(spark):
    """What groups order lines by customer, or by customer and more, shuffles none of them again."""
    t = Tables(spark, SF)
    plan = Tables.listed.func.__wrapped__(t)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan


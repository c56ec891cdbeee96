"""Order queries shuffle lines once by order, and build JSON only for the orders they report on."""

import pytest
from pyspark.sql import functions as F

from tidemark import plans
from tidemark.sources import testmodel as m


def test_lines_are_dealt_by_order_once(spark, sf):
    """both groupings and the join of the orders use one exchange."""
    plan = m.ecommerce(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(l_orderkey") == 1


@pytest.mark.parametrize("name", ["e4_product_ranking", "e7_top_categories", "e10_recent_orders"])
def test_reports_build_only_the_orders_they_need(spark, sf, name, monkeypatch):
    """the lines of other orders never reach the products."""
    built, products = [], m.order_products
    monkeypatch.setattr(m, "order_products", lambda *a, **k: built.append(products(*a, **k)) or built[-1])
    # A path of its own, so that nothing stored by another query is used again.
    assert plans.all_queries()[name](spark, f"{sf}/").count() > 0
    orders = m.order_headers(spark, sf).count()
    assert built and all(b.select(F.count("*")).first()[0] < orders / 4 for b in built)

"""Statements that must be admitted, and those that must not."""

from __future__ import annotations

import pytest

from lumenta.plans.admission import admit


@pytest.fixture(scope="module")
def views(spark):
    return {"orders": spark.createDataFrame([(1, "a", 2.0)], "order_id int, region string, total double"), "customers": spark.createDataFrame([(1, "b")], "customer_id int, name string")}


@pytest.mark.parametrize(
    "sql",
    [
        "select region, sum(total) as t from orders group by region",
        "with x as (select order_id from orders) select order_id from x",
        "select order_id from orders where order_id not in (select customer_id from customers)",
        "select o.order_id from orders o cross join customers c",
        "select 'a;b' as s",
    ],
)
def test_admitted(spark, views, sql):
    own = admit(spark, sql, views)
    assert own.ok, own.findings
    own.frame.collect()


@pytest.mark.parametrize(
    ("sql", "rule"),
    [
        ("drop table orders", "non_read_statement"),
        ("insert into orders values (1, 'a', 1.0)", "non_read_statement"),
        ("select 1; select 2", "multiple_statements"),
        ("selec 1", "parse_failed"),
        ("select x from secrets", "unknown_table"),
        ("select order_id from orders where order_id in (select a from secrets)", "unknown_table"),
        ("select table_name from information_schema.tables", "banned_schema"),
        ("select reflect('java.lang.System', 'exit', 1) as x from orders", "banned_function"),
        ("select order_id from orders, customers", "cartesian_join"),
        ("select no_such from orders", "unknown_column"),
        ("select region, sum(total) from orders", "ungrouped_aggregate_select"),
        ("select * from csv.`/etc/passwd`", "unknown_table"),
    ],
)
def test_refused(spark, views, sql, rule):
    own = admit(spark, sql, views)
    assert not own.ok and rule in own.rules

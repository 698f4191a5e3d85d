"""Sample workflows over order tables."""

from __future__ import annotations

from .workflow import Workflow


def sorted_quantities(lineitem: str = "lineitem", column: str = "l_quantity") -> Workflow:
    """One column, sorted as text."""
    w = Workflow()
    return w.chain(w.add("ScanSource", "scan", tableName=lineitem), w.add("InsertionSort", "sort", attributeName=column, attributeType="string"), w.add("Projection", "project", projectionAttributes=column))


def order_count_distribution(customer: str = "customer", orders: str = "orders") -> Workflow:
    """How many customers have how many orders, of those who have any."""
    w = Workflow()
    w.add("ScanSource", "customers", tableName=customer, columns=[0])
    w.add("ScanSource", "orders", tableName=orders, columns=[0, 1])
    w.add("HashJoin", "join", innerTableAttribute="_c0", outerTableAttribute="_c1")
    w.link("customers", "join").link("orders", "join")
    previous = "join"
    for step in ("by_customer", "by_count"):
        w.add("GroupBy", step, groupByAttribute="_c1", aggregationAttribute="_c0", aggregationFunction="count")
        w.add("GroupByFinal", step + "_final", aggregationFunction="count")
        w.chain(previous, step, step + "_final")
        previous = step + "_final"
    return w.chain(previous, w.add("InsertionSort", "sort", attributeName="_c0", attributeType="int"))


def quantity_by_flag(lineitem: str = "lineitem", until: str = "1998-09-02", function: str = "sum") -> Workflow:
    """Shipped quantity by return flag up to a day, sorted by flag."""
    w = Workflow()
    return w.chain(
        w.add("ScanSource", "scan", tableName=lineitem),
        w.add("Comparison", "shipped", attributeName="l_shipdate", attributeType="date", comparisonType="<=", compareTo=until),
        w.add("GroupBy", "local", groupByAttribute="l_returnflag", aggregationAttribute="l_quantity", aggregationFunction=function),
        w.add("GroupByFinal", "global", aggregationFunction=function),
        w.add("InsertionSort", "sort", attributeName="l_returnflag", attributeType="string"),
    )

"""Derived input tables, written once in SQL that both engines read the same way."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .base import Tables

SPLIT = "timestamp '1998-07-01 00:00:00'"

# Line items before / from the split date are the reference / production side.
FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
FEATURE_SQL = "l_quantity, l_extendedprice, l_discount, l_tax, CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END AS is_f"


def sides(t: Tables, select: str = FEATURE_SQL) -> tuple[DataFrame, DataFrame]:
    li = t.lineitem
    exprs = _split_select(select)
    return li.where(f"l_shipdate < {SPLIT}").selectExpr(*exprs), li.where(f"l_shipdate >= {SPLIT}").selectExpr(*exprs)


def sides_sql(select: str = FEATURE_SQL) -> str:
    return (
        f"ref AS (SELECT {select} FROM lineitem WHERE l_shipdate < {SPLIT}), "
        f"prod AS (SELECT {select} FROM lineitem WHERE l_shipdate >= {SPLIT})"
    )


def order_sides(t: Tables, select: str = "*") -> tuple[DataFrame, DataFrame]:
    o = t.orders
    exprs = _split_select(select)
    return o.where(f"o_orderdate < {SPLIT}").selectExpr(*exprs), o.where(f"o_orderdate >= {SPLIT}").selectExpr(*exprs)


def order_sides_sql(select: str = "*") -> str:
    return (
        f"ref AS (SELECT {select} FROM orders WHERE o_orderdate < {SPLIT}), "
        f"prod AS (SELECT {select} FROM orders WHERE o_orderdate >= {SPLIT})"
    )


def _split_select(select: str) -> list[str]:
    """Split a select list at its top-level commas."""
    parts, depth, current = [], 0, ""
    for ch in select:
        depth += ch == "("
        depth -= ch == ")"
        if ch == "," and depth == 0:
            parts.append(current.strip())
            current = ""
        else:
            current += ch
    return [*parts, current.strip()]


# A scored table from the line items: label, two models' probabilities and predictions, slices.
SCORED_SQL = """scored AS (SELECT *, CASE WHEN pa >= 0.5 THEN 1 ELSE 0 END AS a, CASE WHEN pb >= 0.5 THEN 1 ELSE 0 END AS b FROM (
  SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_shipdate, CASE WHEN l_quantity + 100 * l_tax >= 30 THEN 1 ELSE 0 END AS y,
    l_extendedprice / (l_extendedprice + 50000) AS pa, l_quantity * (1 + l_tax) / (l_quantity * (1 + l_tax) + 27) AS pb FROM lineitem))"""

# Three classes with normalised scores.
MULTI_SQL = """multi AS (SELECT y, p0, p1, p2, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS pred FROM (
  SELECT y, s0 / (s0 + s1 + s2) AS p0, s1 / (s0 + s1 + s2) AS p1, s2 / (s0 + s1 + s2) AS p2 FROM (
    SELECT CASE WHEN l_quantity < 12 THEN 0 WHEN l_quantity < 36 THEN 1 ELSE 2 END AS y, 12000 / (l_extendedprice + 1) AS s0, 1.0E0 AS s1, l_extendedprice / 70000 AS s2 FROM lineitem)))"""

# Two regression models for the price.
REGRESSION_SQL = """reg AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_extendedprice AS y, l_quantity * 1500 AS pa, l_quantity * 1480 + l_discount * 1000 AS pb FROM lineitem)"""


def from_sql(t: Tables, cte: str, name: str) -> DataFrame:
    """A derived table in Spark from the same text the comparison SQL uses."""
    for table in ("lineitem", "events", "orders", "documents", "labels"):
        if table in cte:
            getattr(t, table).createOrReplaceTempView(f"lg_{table}")
            cte = cte.replace(f"FROM {table}", f"FROM lg_{table}").replace(f"JOIN {table}", f"JOIN lg_{table}")
    cte = cte.replace('"', "`")
    return t.spark.sql(f"WITH {cte} SELECT * FROM {name}")

"""The driver's tables seen as domain tables, in SQL that both engines read."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fablespark.sources.stores import fixture

VIEWS = {
    "assertion": """
        SELECT l_orderkey * 8 + l_linenumber AS assertion_id, l_partkey AS chunk_id, c_nationkey AS subject,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'parent_of' WHEN '2-HIGH' THEN 'child_of' WHEN '3-MEDIUM' THEN 'sibling_of' WHEN '4-NOT SPECIFIED' THEN 'engaged_to' ELSE 'married_to' END AS predicate,
               s_nationkey AS object, CASE l_linestatus WHEN 'O' THEN 'narrated' ELSE 'dialogue' END AS assertion_type,
               round(1 - l_discount, 2) AS confidence, CAST(year(l_shipdate) - 1994 AS INT) AS book_order, CAST(month(l_shipdate) AS INT) AS chapter, CAST(dayofyear(l_shipdate) AS INT) AS page
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {supplier} ON l_suppkey = s_suppkey""",
    "mention": """
        SELECT l_orderkey * 8 + l_linenumber AS mention_id, o_custkey AS character_id, l_suppkey AS chunk_id, concat(l_returnflag, '-', CAST(l_suppkey % 7 AS STRING)) AS surface_form,
               CAST(year(l_shipdate) - 1994 AS INT) AS book_order, CAST(month(l_shipdate) AS INT) AS chapter, CAST(dayofyear(l_shipdate) AS INT) AS page
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "link": """
        SELECT DISTINCT a.l_partkey AS u, b.l_partkey AS v FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey
        JOIN {part} p ON p.p_partkey = a.l_partkey JOIN {part} q ON q.p_partkey = b.l_partkey WHERE p.p_brand = q.p_brand""",
    "scene_mention": "SELECT l_orderkey AS scene_id, l_partkey AS character_id FROM {lineitem}",
    "stage": "SELECT event_id, ts, user_id, event_type AS stage, value AS cost, event_type = 'error' AS failed FROM {events}",
    "person": "SELECT c_custkey AS character_id, c_nationkey AS project_id, c_name AS canonical_name, c_mktsegment AS segment, c_acctbal AS balance, CAST(floor(abs(c_acctbal) / 10) AS INT) AS mention_count FROM {customer}",
}
_TABLE = re.compile(r"\{(\w+)\}")


class Domain:
    """Tables and views of one data folder, each read once."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in VIEWS:
                sql = VIEWS[name]
                self._made[name] = self.spark.sql(sql, **{t: self[t] for t in set(_TABLE.findall(sql))})
            else:
                self._made[name] = fixture(self.spark, self.sf_dir, name)
        return self._made[name]


def view_sql(name: str) -> str:
    return _TABLE.sub(r"\1", VIEWS[name]).replace("AS STRING", "AS VARCHAR")


def with_views(body: str) -> str:
    """SQL for DuckDB: the views that ``body`` names go before it as common table expressions."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", body)]
    head = ", ".join(f"{v} AS ({view_sql(v)})" for v in used)
    if body.lstrip().upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head}{', ' if head else ''}{body.lstrip()[14:]}"
    if body.lstrip().upper().startswith("WITH"):
        return f"WITH {head}{', ' if head else ''}{body.lstrip()[4:]}"
    return f"WITH {head} {body}" if head else body


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function of a Domain under its name, with its SQL."""

    def add(f: Callable[[Domain], DataFrame]) -> Callable[[Domain], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Domain(spark, sf_dir))
        if sql is not None:
            SQL[f.__name__] = with_views(sql)
        return f

    return add

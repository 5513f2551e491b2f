"""Registering queries together with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Plans:
    """Named queries of one module, and the DuckDB SQL of those that SQL can express."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(function: Query) -> Query:
            if function.__name__ in self.queries:
                raise ValueError(f"two queries named {function.__name__}")
            self.queries[function.__name__] = function
            if sql:
                self.sql[function.__name__] = sql
            return function

        return add


#: The case view (see ``granary.operators.cases``) in DuckDB SQL.
CASES = """
lines as (
  select l_orderkey, sum(l_extendedprice) as claimed, coalesce(sum(l_extendedprice) filter (where l_returnflag <> 'R'), 0) as approved,
    bool_or(l_returnflag = 'R' and l_linestatus = 'F') as queried, count(*) as n_lines
  from lineitem group by l_orderkey),
cases as (
  select o_orderkey as case_id, n_name as panel, c_mktsegment as kind, o_custkey as member_id, o_orderdate as opened, o_orderstatus as status, o_orderpriority as priority,
    coalesce(claimed, 0) as claimed, coalesce(approved, 0) as approved, coalesce(queried, false) as queried, coalesce(n_lines, 0) as n_lines
  from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey left join lines on l_orderkey = o_orderkey)
"""

"""Ordering, limits, offsets and cursors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import docquery as dq
from ..sources.tables import Tables
from .common import part_documents
from .registry import PASSENGERS, query


@query(
    "order_by",
    PASSENGERS
    + """select passenger_id, pclass, fare from passengers where fare is not null
       order by pclass, fare desc, passenger_id""",
)
def order_by_plan(t: Tables) -> DataFrame:
    order = [("pclass", "ASC"), ("fare", "desc")]
    return dq.order_by(t.passengers, order, "passenger_id").select(
        "passenger_id", "pclass", "fare"
    )


@query(
    "order_by_cli",
    "select cast(p_partkey as varchar) as id, p_size from part order by p_size, id",
)
def order_by_cli_plan(t: Tables) -> DataFrame:
    return dq.doc_query(part_documents(t), order=[("p_size", "asc")], select=["p_size"])


@query(
    "limit_n",
    """select o_orderkey, o_totalprice from orders
       order by o_totalprice desc, o_orderkey limit 25""",
)
def limit_n_plan(t: Tables) -> DataFrame:
    order = [("o_totalprice", "desc")]
    return dq.doc_query(
        t["orders"], order=order, limit=25, select=["o_totalprice"], id_col="o_orderkey"
    )


@query(
    "offset_n",
    """select o_orderkey, o_totalprice from orders
       order by o_totalprice desc, o_orderkey offset 100""",
)
def offset_n_plan(t: Tables) -> DataFrame:
    order = [("o_totalprice", "desc")]
    return dq.doc_query(
        t["orders"], order=order, offset=100, select=["o_totalprice"], id_col="o_orderkey"
    )


@query(
    "offset_limit",
    """select o_orderkey, o_totalprice from orders
       order by o_totalprice desc, o_orderkey limit 40 offset 60""",
)
def offset_limit_plan(t: Tables) -> DataFrame:
    options = {
        "orderBy": [{"field": "o_totalprice", "direction": "desc"}],
        "limit": 40,
        "offset": 60,
        "select": ["o_totalprice"],
    }
    return dq.from_options(t["orders"], options, id_col="o_orderkey")


@query(
    "cursor_page",
    """select l_orderkey * 10 + l_linenumber as id, l_extendedprice,
         strftime(l_shipdate, '%Y-%m-%d') as l_shipday from lineitem
       where l_shipdate > timestamp '1995-06-17' and l_shipdate < timestamp '1996-02-01'
       order by l_shipdate, l_extendedprice desc, id limit 200""",
)
def cursor_page_plan(t: Tables) -> DataFrame:
    """The time itself is the order key, so the cursors reach the scan."""
    lines = t["lineitem"].select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        "l_extendedprice",
        "l_shipdate",
    )
    found = dq.doc_query(
        lines,
        order=[("l_shipdate", "asc"), ("l_extendedprice", "desc")],
        start_after=["1995-06-17"],
        end_before=["1996-02-01"],
        limit=200,
    )
    day = F.date_format("l_shipdate", "yyyy-MM-dd").alias("l_shipday")
    return found.select("id", "l_extendedprice", day)


@query(
    "cursor_between",
    """select o_orderkey, o_totalprice from orders
       where (o_totalprice < 400000.0 or (o_totalprice = 400000.0 and o_orderkey > 500))
         and o_totalprice >= 100000.0
       order by o_totalprice desc, o_orderkey""",
)
def cursor_between_plan(t: Tables) -> DataFrame:
    return dq.doc_query(
        t["orders"],
        order=[("o_totalprice", "desc")],
        start_after=[400000.0, 500],
        end_at=[100000.0],
        select=["o_totalprice"],
        id_col="o_orderkey",
    )


@query(
    "top_rated_available",
    """select p_size > 10 as available, p_retailprice as rating, p_partkey from part
       order by available, rating desc, p_partkey limit 30""",
)
def top_rated_available_plan(t: Tables) -> DataFrame:
    rated = t["part"].select(
        (F.col("p_size") > 10).alias("available"),
        F.col("p_retailprice").alias("rating"),
        "p_partkey",
    )
    order = [("available", "asc"), ("rating", "desc")]
    return dq.doc_query(rated, order=order, limit=30, id_col="p_partkey")

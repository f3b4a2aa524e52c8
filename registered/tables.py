"""Tables with gaps derived from the test tables, in Spark and in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from seriesloom.session import shared_dir

def place(spark, name: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


LINEITEM_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINEITEM_TEXT = ["l_returnflag", "l_linestatus"]
LINEITEM = [*LINEITEM_NUMERIC, *LINEITEM_TEXT, "l_shipdate"]
ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
# A total order of lineitem rows.
LINEITEM_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"]

EVENTS_WITH_GAPS = """(SELECT event_id, ts, CASE WHEN value > 150 THEN NULL ELSE user_id END AS user_id,
  CASE WHEN value < 1 THEN NULL ELSE event_type END AS event_type,
  CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value FROM events)"""
GAP_COLUMNS = ["event_id", "ts", "user_id", "event_type", "value"]


def events_with_gaps(t) -> DataFrame:
    return t("events").select(
        "event_id", "ts", F.when(~(F.col("value") > 150), F.col("user_id")).alias("user_id"),
        F.when(~(F.col("value") < 1), F.col("event_type")).alias("event_type"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("value"),
    )


LABELLED = """(SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"""


def labelled_documents(t) -> DataFrame:
    return t("documents").select("doc_id", "lang", "source", "n_chars").join(t("labels"), "doc_id", "left")


DAILY = """series AS (SELECT o_orderpriority, o_orderdate AS ts, sum(o_totalprice) AS value FROM orders GROUP BY ALL),
ix AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY ts) - 1 AS idx,
  count(*) OVER (PARTITION BY o_orderpriority) AS n FROM series)"""
KEY = ["o_orderpriority"]


def daily_orders(t) -> DataFrame:
    from seriesloom.operators.series import indexed_series

    return indexed_series(t("orders"), "o_orderdate", "o_totalprice", KEY)

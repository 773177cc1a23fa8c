"""Inputs of the reference-style queries, derived from the base tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table

#: Models of the out-of-fold fixture and their hash offsets.
MODELS = {"m_a": 0, "m_b": 1, "m_c": 2}


def oof(spark: SparkSession, folder: str) -> DataFrame:
    """(row_index, rep, model, target, score, fold): three models' scores of every order in three repeats."""
    orders = read_table(spark, folder, "orders").select(F.col("o_orderkey").alias("row_index"))
    both = F.explode(F.array(*(F.struct(F.lit(r).alias("rep"), F.lit(m).alias("model"), F.lit(o).alias("off")) for r in range(3) for m, o in MODELS.items())))
    wide = orders.select("row_index", both.alias("x")).select("row_index", "x.rep", "x.model", "x.off")
    target = F.when(F.col("row_index") % 97 == 0, 1).otherwise(0)
    base = (F.col("row_index") * 7919 + F.col("rep") * 104729 + F.col("off") * 1299709) % 10007
    return wide.select(
        "row_index", "rep", "model", target.alias("target"), (F.lit(0.7) * base.cast("double") / F.lit(10007.0) + F.lit(0.3) * target).alias("score"),
        ((F.col("row_index") * 31 + F.col("rep") * 17) % 5).cast("int").alias("fold"),
    )


OOF = """
WITH oof AS (
  SELECT o_orderkey AS row_index, rep, model, CASE WHEN o_orderkey % 97 = 0 THEN 1 ELSE 0 END AS target,
         0.7::DOUBLE * ((o_orderkey * 7919 + rep * 104729 + off * 1299709) % 10007)::DOUBLE / 10007.0::DOUBLE
           + 0.3::DOUBLE * (CASE WHEN o_orderkey % 97 = 0 THEN 1 ELSE 0 END) AS score,
         CAST((o_orderkey * 31 + rep * 17) % 5 AS INTEGER) AS fold
  FROM orders, (VALUES (0), (1), (2)) r(rep), (VALUES ('m_a', 0), ('m_b', 1), ('m_c', 2)) m(model, off))
"""


def edges(spark: SparkSession, folder: str) -> DataFrame:
    """(account_from, account_to, amount, timestamp) of every event, self-loops included."""
    events = read_table(spark, folder, "events")
    n = events.agg((F.max("user_id") + 1).alias("n"))
    k = F.get_json_object("props", "$.k").cast("bigint")
    return events.crossJoin(F.broadcast(n)).select(  # n is one row
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("account_from"),
        F.concat(F.lit("U"), ((F.col("user_id") * 31 + k) % F.col("n")).cast("string")).alias("account_to"),
        F.col("value").alias("amount"), F.col("ts").cast("timestamp").alias("timestamp"),
    )


EDGES = """
WITH raw_edges AS (
  SELECT 'U' || user_id AS account_from, 'U' || ((user_id * 31 + CAST(json_extract_string(props, '$.k') AS BIGINT)) % (SELECT max(user_id) + 1 FROM events)) AS account_to,
         value AS amount, ts AS "timestamp"
  FROM events),
edges AS (SELECT * FROM raw_edges WHERE account_from <> account_to AND amount > 0)
"""

#: Rail of each event type, and the windows of the grid in days.
RAILS = {"purchase": "UPI", "click": "ATM", "view": "CASH", "error": "POS_PYMT", "signup": "ELEC_XFER"}
WINDOWS = (7, 14, 31)


def grid(spark: SparkSession, folder: str) -> DataFrame:
    """One row per account: amounts by rail, direction and window, totals, balance, tenure and alerts."""
    events = read_table(spark, folder, "events").select("user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"), F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    last = events.agg(F.max("ts").alias("t1"))
    rows = events.crossJoin(F.broadcast(last))  # one row
    inside = {w: F.col("ts") > F.col("t1") - F.expr(f"INTERVAL {w} DAYS") for w in WINDOWS}
    way = {"CR": F.col("k") % 2 == 0, "DB": F.col("k") % 2 == 1}
    columns = []
    for w in WINDOWS:
        for d, test in way.items():
            columns.append(F.sum(F.when(inside[w] & test, F.col("value"))).alias(f"TOT_TXNAMT_{d}_L{w}D"))
            columns += [F.sum(F.when(inside[w] & test & (F.col("event_type") == e), F.col("value"))).alias(f"{rail}_AMT_{d}_L{w}D") for e, rail in RAILS.items()]
    columns += [
        F.avg(F.when(inside[7], F.col("value"))).alias("AVG_BAL_7DAYS"),
        F.avg(F.when(inside[31], F.col("value"))).alias("AVG_BAL_31DAYS"),
        F.count_if(inside[31]).alias("COUNT_TXNS_L31D"),
        F.count_if(inside[31] & (F.hour("ts") < 6)).alias("COUNT_NIGHT_TXNS_L31D"),
        *(F.count_if((F.col("event_type") == "error") & (F.hour("ts") % 4 == h)).alias(f"ALERT_{h}") for h in range(4)),
    ]
    bucket = F.element_at(F.array(*(F.lit(x) for x in ("L7D", "L31D", "L90D", "L180D", "L365D", "G365D", " l31d ", "UNKNOWN"))), (F.col("user_id") % 8 + 1).cast("int"))
    return rows.groupBy("user_id").agg(*columns).withColumn("ACCT_OPN_BUCKET", bucket)


def _grid_sql() -> str:
    parts = []
    for w in WINDOWS:
        for d, bit in (("CR", 0), ("DB", 1)):
            inside = f"ts > t1 - INTERVAL {w} DAY AND k % 2 = {bit}"
            parts.append(f"sum(value) FILTER (WHERE {inside}) AS TOT_TXNAMT_{d}_L{w}D")
            parts += [f"sum(value) FILTER (WHERE {inside} AND event_type = '{e}') AS {rail}_AMT_{d}_L{w}D" for e, rail in RAILS.items()]
    parts += ["avg(value) FILTER (WHERE ts > t1 - INTERVAL 7 DAY) AS AVG_BAL_7DAYS", "avg(value) FILTER (WHERE ts > t1 - INTERVAL 31 DAY) AS AVG_BAL_31DAYS"]
    parts += ["count(*) FILTER (WHERE ts > t1 - INTERVAL 31 DAY) AS COUNT_TXNS_L31D", "count(*) FILTER (WHERE ts > t1 - INTERVAL 31 DAY AND hour(ts) < 6) AS COUNT_NIGHT_TXNS_L31D"]
    parts += [f"count(*) FILTER (WHERE event_type = 'error' AND hour(ts) % 4 = {h}) AS ALERT_{h}" for h in range(4)]
    return (
        "WITH ev AS (SELECT user_id, event_type, value, ts, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, (SELECT max(ts) FROM events) AS t1 FROM events),\n"
        f"grid AS (SELECT user_id, {', '.join(parts)}, ['L7D','L31D','L90D','L180D','L365D','G365D',' l31d ','UNKNOWN'][user_id % 8 + 1] AS ACCT_OPN_BUCKET FROM ev GROUP BY user_id)\n"
    )


GRID = _grid_sql()


def dirty(spark: SparkSession, folder: str) -> DataFrame:
    """Text columns of orders with missing tokens, unparseable values and three date formats."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    day = F.to_date("o_orderdate")
    return read_table(spark, folder, "orders").select(
        key.alias("row_index"),
        F.when(key % 7 == 0, "NA").when(key % 11 == 0, " NA ").otherwise(F.concat(F.lit(" "), cust, F.lit(" "))).alias("num_txt"),
        F.when(key % 13 == 0, "x1").otherwise(cust).alias("cat_txt"),
        F.when(key % 3 == 0, F.date_format(day, "yyyy-MM-dd")).when(key % 3 == 1, F.date_format(day, "MM-dd-yyyy")).otherwise(F.date_format(day, "yyyy-MM-dd 00:00:00")).alias("date_txt"),
    )


DIRTY = """
WITH dirty AS (
  SELECT o_orderkey AS row_index,
         CASE WHEN o_orderkey % 7 = 0 THEN 'NA' WHEN o_orderkey % 11 = 0 THEN ' NA ' ELSE ' ' || o_custkey || ' ' END AS num_txt,
         CASE WHEN o_orderkey % 13 = 0 THEN 'x1' ELSE CAST(o_custkey AS VARCHAR) END AS cat_txt,
         CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%m-%d-%Y') ELSE strftime(o_orderdate, '%Y-%m-%d 00:00:00') END AS date_txt,
         CAST(o_orderdate AS DATE) AS true_date
  FROM orders)
"""


def wide(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with customer and nation as a labelled numeric table with planted faults."""
    orders, customer = read_table(spark, folder, "orders"), read_table(spark, folder, "customer")
    key = F.col("o_orderkey")
    target = F.when(key % 97 == 0, 1).otherwise(0)
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        key.alias("row_index"), target.alias("target"), F.col("o_totalprice").alias("price"), F.when(key % 5 != 0, F.col("c_acctbal")).alias("acctbal"),
        F.col("c_nationkey").cast("double").alias("nation"), F.col("o_totalprice").alias("price_copy"), F.lit(0.0).alias("constant"),
        F.when(key % 500 == 0, 1.0).otherwise(0.0).alias("rare_flag"), F.when(key % 97 == 0, 10.0).otherwise(-10.0).alias("recode"), key.cast("double").alias("ident"),
    )


WIDE_COLUMNS = ("price", "acctbal", "nation", "price_copy", "constant", "rare_flag", "recode", "ident")
WIDE = """
WITH wide AS (
  SELECT o_orderkey AS row_index, CASE WHEN o_orderkey % 97 = 0 THEN 1 ELSE 0 END AS target, o_totalprice AS price, CASE WHEN o_orderkey % 5 <> 0 THEN c_acctbal END AS acctbal,
         c_nationkey::DOUBLE AS nation, o_totalprice AS price_copy, 0.0::DOUBLE AS constant, CASE WHEN o_orderkey % 500 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS rare_flag,
         CASE WHEN o_orderkey % 97 = 0 THEN 10.0::DOUBLE ELSE -10.0::DOUBLE END AS recode, o_orderkey::DOUBLE AS ident
  FROM orders JOIN customer ON o_custkey = c_custkey),
long AS (FROM wide UNPIVOT INCLUDE NULLS (value FOR feature IN (price, acctbal, nation, price_copy, constant, rare_flag, recode, ident)))
"""

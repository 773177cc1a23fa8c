"""Queries on the transaction graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as g
from ..session import cut_lineage
from .fixtures import EDGES, edges
from .registry import Registry

R = Registry()


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    return g.clean_edges(edges(spark, folder))


def r(n: int, *names: str):
    return [F.round(c, n).alias(c) for c in names]


def seeds(df: DataFrame) -> DataFrame:
    """The stated query set: accounts whose number is divisible by 50."""
    both = df.select(F.col("account_from").alias("a")).union(df.select("account_to")).distinct()
    return both.where("CAST(substring(a, 2) AS BIGINT) % 50 = 0")


@R.add(EDGES + """SELECT count(*) AS n_in, count(*) FILTER (WHERE account_from = account_to) AS n_self_loops, count(*) FILTER (WHERE account_from <> account_to AND NOT coalesce(amount > 0, false)) AS n_bad_amount,
count(*) FILTER (WHERE account_from <> account_to AND amount > 0) AS n_kept, count(*) FILTER (WHERE account_from <> account_to AND amount > 0 AND "timestamp" IS NULL) AS n_no_time FROM raw_edges""")
def edges_clean_report(spark: SparkSession, folder: str) -> DataFrame:
    """GR-01/02: what cleaning keeps."""
    return g.edge_report(edges(spark, folder))


_METRICS = EDGES + """
, i AS (SELECT account_to AS account, count(*) AS n_in, count(DISTINCT account_from) AS senders, sum(amount) AS value_in FROM edges GROUP BY 1),
o AS (SELECT account_from AS account, count(*) AS n_out, count(DISTINCT account_to) AS recipients, sum(amount) AS value_out FROM edges GROUP BY 1),
m AS (SELECT account, coalesce(n_in, 0) AS n_in, coalesce(n_out, 0) AS n_out, coalesce(senders, 0) AS senders, coalesce(recipients, 0) AS recipients, coalesce(value_in, 0) AS value_in, coalesce(value_out, 0) AS value_out FROM i FULL JOIN o USING (account)),
metrics AS (SELECT *, coalesce(least(value_in, value_out) / nullif(value_in, 0), 0) AS passthrough, senders / nullif(recipients, 0) AS fan_ratio FROM m)
"""


@R.add(_METRICS + "SELECT account, n_in, n_out, senders, recipients, round(value_in, 2) AS value_in, round(value_out, 2) AS value_out, round(passthrough, 4) AS passthrough, round(fan_ratio, 3) AS fan_ratio FROM metrics")
def account_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """GR-03: degrees, values and ratios of every account."""
    return g.account_metrics(_edges(spark, folder)).select("account", "n_in", "n_out", "senders", "recipients", *r(2, "value_in", "value_out"), *r(4, "passthrough"), *r(3, "fan_ratio"))


_DWELL = _METRICS + """
, d AS (SELECT i.account_to AS account, i."timestamp" AS t, (SELECT min(o."timestamp") FROM edges o WHERE o.account_from = i.account_to AND o."timestamp" >= i."timestamp") AS nxt FROM edges i),
h AS (SELECT account, (epoch_us(nxt) - epoch_us(t)) / 3.6e9::DOUBLE AS hours FROM d WHERE nxt IS NOT NULL),
dwell AS (SELECT account, count(*) AS n_matched, list_sort(list(hours))[count(*) // 2 + 1] AS median_dwell_hours FROM h GROUP BY account)
"""


@R.add(_DWELL + "SELECT account, n_matched, round(median_dwell_hours, 6) AS median_dwell_hours FROM dwell")
def dwell_hours(spark: SparkSession, folder: str) -> DataFrame:
    """GR-04: upper median of the hours from an inflow to the next outflow."""
    return g.dwell_medians(_edges(spark, folder)).select("account", "n_matched", *r(6, "median_dwell_hours"))


_LINKS = EDGES + ", links AS (SELECT DISTINCT account_from AS a, account_to AS b FROM edges), und AS (SELECT a, b FROM links UNION SELECT b, a FROM links)\n"
_RECURSIVE = _LINKS.replace("WITH raw_edges", "WITH RECURSIVE raw_edges", 1)


@R.add(_RECURSIVE + """, walk(account, node) AS (SELECT a, a FROM und UNION SELECT w.account, u.b FROM walk w JOIN und u ON u.a = w.node), comp AS (SELECT account, min(node) AS component FROM walk GROUP BY account)
SELECT account, component, count(*) OVER (PARTITION BY component) AS size FROM comp""")
def weak_components(spark: SparkSession, folder: str) -> DataFrame:
    """GR-05/07: weakly connected components and their sizes."""
    return g.component_sizes(g.weak_components(_edges(spark, folder), cut_lineage), "component")


@R.add(_RECURSIVE + """, walk(account, node) AS (SELECT a, a FROM und UNION SELECT w.account, l.b FROM walk w JOIN links l ON l.a = w.node),
scc AS (SELECT x.account, max(x.node) AS scc FROM walk x JOIN walk y ON x.account = y.node AND x.node = y.account GROUP BY x.account)
SELECT account, scc, count(*) OVER (PARTITION BY scc) AS size FROM scc""")
def strong_components(spark: SparkSession, folder: str) -> DataFrame:
    """GR-06/07: strongly connected components and their sizes."""
    return g.component_sizes(g.strong_components(_edges(spark, folder), cut_lineage), "scc")


@R.add(EDGES + """
, i AS (SELECT account_to AS account, count(DISTINCT account_from) AS senders, list_sort(list(amount))[count(*) // 2 + 1] AS median_inbound FROM edges GROUP BY 1), o AS (SELECT account_from AS account, max(amount) AS largest_outbound FROM edges GROUP BY 1)
SELECT account, senders, median_inbound, largest_outbound, round(median_inbound / largest_outbound, 6) AS ratio, senders >= 5 AND median_inbound / largest_outbound <= 0.25 AS detected FROM i JOIN o USING (account)""")
def smurfing(spark: SparkSession, folder: str) -> DataFrame:
    """GR-08: many senders of small amounts against one large outflow."""
    return g.smurfing(_edges(spark, folder)).select("account", "senders", "median_inbound", "largest_outbound", *r(6, "ratio"), "detected")


@R.add(_METRICS + "SELECT account, senders, recipients, round((value_in - least(value_in, value_out)) / nullif(value_in, 0), 6) AS retained_share, recipients >= 10 AND senders BETWEEN 1 AND 2 AS detected FROM metrics")
def distributor(spark: SparkSession, folder: str) -> DataFrame:
    """GR-09: many recipients, one or two senders."""
    return g.distributors(g.account_metrics(_edges(spark, folder))).select("account", "senders", "recipients", *r(6, "retained_share"), "detected")


@R.add(EDGES + """
, s AS (SELECT account_to AS account, "timestamp" AS t FROM edges UNION ALL SELECT account_from, "timestamp" FROM edges),
w AS (SELECT account, t, count(*) OVER (PARTITION BY account ORDER BY t RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS n FROM s),
a AS (SELECT account, count(*) AS n_stamps, (epoch_us(max(t)) - epoch_us(min(t))) / 3.6e9::DOUBLE AS span, max(n) AS busiest FROM w GROUP BY account),
m AS (SELECT *, CASE WHEN n_stamps >= 4 AND span >= 24 THEN busiest / (n_stamps / (span / 24)) END AS multiple FROM a)
SELECT account, n_stamps, round(span, 6) AS span_hours, busiest, round(multiple, 6) AS multiple, CASE WHEN n_stamps < 4 THEN 'NO_BASELINE' WHEN span <= 0 THEN 'ONE_STAMP' WHEN span < 24 THEN 'SHORT_SPAN' WHEN multiple >= 3 THEN 'BURST' ELSE 'NORMAL' END AS status FROM m""")
def velocity(spark: SparkSession, folder: str) -> DataFrame:
    """GR-10: busiest trailing 24 hours against the account's own rate."""
    return g.velocity(_edges(spark, folder)).select("account", "n_stamps", *r(6, "span_hours"), "busiest", *r(6, "multiple"), "status")


def _chain_sql(most: int) -> str:
    parts = [', e0 AS (SELECT DISTINCT account_from AS f, account_to AS o, epoch_us("timestamp") AS t FROM edges), l1 AS (SELECT *, 1 AS depth FROM e0)']
    for i in range(2, most + 1):
        parts.append(f"l{i} AS (SELECT f, o, t, coalesce((SELECT max(depth) + 1 FROM l{i - 1} n WHERE n.f = e0.o AND n.t BETWEEN e0.t AND e0.t + 86400000000), 1) AS depth FROM e0)")
    return ", ".join(parts) + f", chains AS (SELECT f AS account, max(depth) AS depth FROM l{most} GROUP BY f)\n"


@R.add(EDGES + _chain_sql(4) + "SELECT account, depth FROM chains")
def rapid_chains(spark: SparkSession, folder: str) -> DataFrame:
    """GR-12 to four hops, as its SQL; rapid_chains_eight goes to the full depth."""
    return g.rapid_chains(_edges(spark, folder), cut_lineage, 4)


@R.add(EDGES + _chain_sql(8) + "SELECT account, depth FROM chains")
def rapid_chains_eight(spark: SparkSession, folder: str) -> DataFrame:
    """GR-12: longest chain of hops within a day each, to eight hops."""
    return g.rapid_chains(_edges(spark, folder), cut_lineage)


@R.add(_DWELL + _chain_sql(3) + """
SELECT account, concat_ws(',', CASE WHEN senders >= 10 THEN 'FAN_IN_COLLECTION' END, CASE WHEN recipients >= 10 THEN 'FAN_OUT_DISPERSAL' END, CASE WHEN passthrough >= 0.9 AND median_dwell_hours <= 48 THEN 'RAPID_PASSTHROUGH' END,
       CASE WHEN depth >= 3 THEN 'LAYERING_CHAIN' END) AS patterns FROM metrics LEFT JOIN dwell USING (account) LEFT JOIN chains USING (account)""")
def graph_patterns(spark: SparkSession, folder: str) -> DataFrame:
    """GR-11 without CIRCULAR_FLOW, as its SQL: the other four structures of every account. graph_patterns_all has all five."""
    e = _edges(spark, folder)
    return g.structures(g.account_metrics(e), g.dwell_medians(e), g.rapid_chains(e, cut_lineage, 3))


@R.add(_DWELL.replace("WITH raw_edges", "WITH RECURSIVE raw_edges", 1) + _chain_sql(3) + """, links AS (SELECT DISTINCT account_from AS a, account_to AS b FROM edges),
walk(seed, node, hop) AS (SELECT a, b, 1 FROM links UNION SELECT seed, b, hop + 1 FROM walk JOIN links ON a = node WHERE node <> seed AND hop < 6), looped AS (SELECT DISTINCT seed AS account FROM walk WHERE node = seed)
SELECT account, concat_ws(',', CASE WHEN senders >= 10 THEN 'FAN_IN_COLLECTION' END, CASE WHEN recipients >= 10 THEN 'FAN_OUT_DISPERSAL' END, CASE WHEN passthrough >= 0.9 AND median_dwell_hours <= 48 THEN 'RAPID_PASSTHROUGH' END,
       CASE WHEN depth >= 3 THEN 'LAYERING_CHAIN' END, CASE WHEN account IN (SELECT account FROM looped) THEN 'CIRCULAR_FLOW' END) AS patterns FROM metrics LEFT JOIN dwell USING (account) LEFT JOIN chains USING (account)""")
def graph_patterns_all(spark: SparkSession, folder: str) -> DataFrame:
    """GR-11: the five structures of every account, cycles of up to six edges among them."""
    e = _edges(spark, folder)
    return g.structures(g.account_metrics(e), g.dwell_medians(e), g.rapid_chains(e, cut_lineage, 3), g.cycle_lengths(e, cut_lineage))


@R.add(_RECURSIVE + """, walk(seed, node, hop) AS (SELECT a, b, 1 FROM links WHERE CAST(substring(a, 2) AS BIGINT) % 50 = 0 UNION SELECT seed, b, hop + 1 FROM walk JOIN links ON a = node WHERE node <> seed AND hop < 6)
SELECT seed AS account, CAST(min(hop) AS INTEGER) AS length FROM walk WHERE node = seed GROUP BY seed""")
def shortest_cycle(spark: SparkSession, folder: str) -> DataFrame:
    """GR-13: shortest cycle through each account of the query set, to six edges."""
    e = _edges(spark, folder)
    return g.shortest_cycles(e, seeds(e), cut_lineage)


@R.add(_RECURSIVE + """, walk(seed, account, hop) AS (SELECT DISTINCT a, a, 0 FROM und WHERE CAST(substring(a, 2) AS BIGINT) % 50 = 0 UNION SELECT seed, b, hop + 1 FROM walk JOIN und ON a = account WHERE hop < 2),
near AS (SELECT seed, account, min(hop) AS hop FROM walk GROUP BY seed, account)
SELECT seed, account, CAST(hop AS INTEGER) AS hop FROM near QUALIFY row_number() OVER (PARTITION BY seed ORDER BY hop, account) <= 60""")
def ego_network(spark: SparkSession, folder: str) -> DataFrame:
    """GR-14: the neighbourhood of each account of the query set."""
    e = _edges(spark, folder)
    return g.ego_network(e, seeds(e), cut_lineage)


@R.add(_METRICS + """, p AS (SELECT 'passthrough' AS board, CAST(row_number() OVER (ORDER BY round(passthrough, 4) DESC, round(value_in, 2) DESC, account) AS INTEGER) AS place, account FROM metrics
UNION ALL SELECT 'fan', CAST(row_number() OVER (ORDER BY senders + recipients DESC, account) AS INTEGER), account FROM metrics) SELECT * FROM p WHERE place <= 20""")
def graph_top_accounts(spark: SparkSession, folder: str) -> DataFrame:
    """GR-15: the two top lists."""
    return g.top_accounts(g.account_metrics(_edges(spark, folder)))

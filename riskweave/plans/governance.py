"""Queries on named checks, runs that happen once, sealed runs, narratives, malformed frames and cached tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import governance as gv
from ..operators import graph as g
from ..operators import nested as ne
from ..operators import profiling as pf
from ..operators import ranking as rk
from ..session import read_table, shared_checkpoint_dir
from ..sources import files
from .fixtures import EDGES, OOF, WIDE, WIDE_COLUMNS, edges, oof, wide
from .ranking import POINTS, r6
from .registry import Registry

R = Registry()
K = ["model", "rep"]


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Tables, their keys, and their references.
_KEYS = {"region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "orders": ("o_orderkey",), "events": ("event_id",), "documents": ("doc_id",), "lineitem": ("l_orderkey", "l_linenumber")}
_PARENTS = (("nation", "n_regionkey", "region"), ("customer", "c_nationkey", "nation"), ("supplier", "s_nationkey", "nation"), ("orders", "o_custkey", "customer"), ("lineitem", "l_orderkey", "orders"), ("lineitem", "l_partkey", "part"), ("lineitem", "l_suppkey", "supplier"))
_RANGES = {
    "discount_is_a_share": ("lineitem", "l_discount BETWEEN 0 AND 1"), "quantity_is_positive": ("lineitem", "l_quantity > 0"), "price_is_positive": ("orders", "o_totalprice > 0"),
    "balance_is_not_negative": ("customer", "c_acctbal >= 0"), "small_quantity": ("lineitem", "l_quantity <= 40"), "chars_are_counted": ("documents", "text IS NULL OR n_chars = length(text)"),
}


def _checks_sql() -> str:
    parts = [f"SELECT 'unique_{t}' AS \"check\", count(*) AS n FROM (SELECT {', '.join(k)} FROM {t} GROUP BY ALL HAVING count(*) > 1)" for t, k in _KEYS.items()]
    parts += [f"SELECT 'parent_of_{c}', count(*) FROM {t} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {_KEYS[p][0]} FROM {p})" for t, c, p in _PARENTS]
    parts += [f"SELECT '{n}', count(*) FROM {t} WHERE NOT coalesce({test}, false)" for n, (t, test) in _RANGES.items()]
    parts += [
        "SELECT 'score_in_range', count(*) FROM oof WHERE NOT score BETWEEN 0 AND 1", "SELECT 'one_fold_a_row', count(*) FROM (SELECT rep, row_index FROM oof GROUP BY ALL HAVING count(DISTINCT fold) > 1)",
        "SELECT 'every_model_scores_every_row', count(*) FROM (SELECT rep, row_index FROM oof GROUP BY ALL HAVING count(DISTINCT model) <> 3)", "SELECT 'label_is_steady', count(*) FROM (SELECT row_index FROM oof GROUP BY ALL HAVING count(DISTINCT target) > 1)",
        "SELECT 'low_score', count(*) FROM oof WHERE score > 0.5",
    ]
    return OOF + ", found AS (" + " UNION ALL ".join(parts) + ") SELECT \"check\", n AS n_violations, CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM found"


@R.add(_checks_sql())
def release_checks(spark: SparkSession, folder: str) -> DataFrame:
    """SV-11, 13, 14, EXT-56, 66: 27 named checks over all tables, each with its violations."""
    table = lambda name: read_table(spark, folder, name)
    rows = oof(spark, folder)
    checks = {f"unique_{t}": gv.repeated(table(t), *keys) for t, keys in _KEYS.items()}
    checks |= {f"parent_of_{c}": gv.orphans(table(t), c, table(p), _KEYS[p][0]) for t, c, p in _PARENTS}
    checks |= {n: table(t).where(~F.coalesce(F.expr(test), F.lit(False))) for n, (t, test) in _RANGES.items()}
    checks |= {
        "score_in_range": rows.where(~F.col("score").between(0, 1)),
        "one_fold_a_row": rows.groupBy("rep", "row_index").agg(F.count_distinct("fold").alias("n")).where("n > 1"),
        "every_model_scores_every_row": rows.groupBy("rep", "row_index").agg(F.count_distinct("model").alias("n")).where("n <> 3"),
        "label_is_steady": rows.groupBy("row_index").agg(F.count_distinct("target").alias("n")).where("n > 1"),
        "low_score": rows.where("score > 0.5"),
    }
    return gv.run_checks(checks)


_CELLS = OOF + """
, cells AS (SELECT model, rep, count(*) FILTER (WHERE score >= 0.6 AND target = 1) AS tp, count(*) FILTER (WHERE score >= 0.6 AND target = 0) AS fp, count(*) FILTER (WHERE score < 0.6 AND target = 1) AS fn, count(*) FILTER (WHERE score < 0.6 AND target = 0) AS tn FROM oof GROUP BY ALL)
"""


@R.add(_CELLS + "SELECT model, rep, tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 6) AS \"precision\", round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fn + fp, 0), 6) AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, true AS is_intact FROM cells")
def sealed_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-21, 27, LAB-06..09: predictions sealed before their labels are known, verified, joined to them, and judged at the policy threshold."""
    out = _folder(spark, "seal")
    rows = oof(spark, folder).withColumn("key", F.concat_ws("-", "model", "rep", "row_index"))
    files.seal(rows.select("key", "model", "rep", "score"), out, "key", {"policy": 0.6})
    judged = gv.sealed_metrics(spark, out, rows.select("key", "target"), 0.6, K)
    return judged.select(*K, "tp", "fp", "fn", "tn", *r6("precision", "recall", "f1", "accuracy"), F.lit(files.verify_seal(spark, out)).alias("is_intact"))


@R.add(OOF + "SELECT model AS seal, 'key' AS \"key\", count(*) AS n_rows FROM oof GROUP BY model")
def seal_list(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-28: the sealed runs of a folder by their manifests."""
    out = _folder(spark, "seals")
    rows = oof(spark, folder).withColumn("key", F.concat_ws("-", "rep", "row_index"))
    for model in ("m_a", "m_b", "m_c"):
        files.seal(rows.where(F.col("model") == model).select("key", "score"), f"{out}/{model}", "key", {"model": model})
    return gv.list_seals(spark, out)


@R.add("SELECT 'locked_test' AS name, 1 AS attempt, false AS is_refused UNION ALL SELECT 'locked_test', 2, true")
def locked_test_log(spark: SparkSession, folder: str) -> DataFrame:
    """EXT-19: a locked test is touched once; the second run is logged and refused."""
    out = _folder(spark, "locked")
    report = lambda: rk.average_precision_roc(rk.ranked_points(oof(spark, folder), K), K)
    gv.touch_once(spark, out, "locked_test", report)
    return gv.touch_once(spark, out, "locked_test", report)


_TEXTS = """CASE event_id % 5 WHEN 0 THEN '{"text": "moved 12.5 in 3 hops"}' WHEN 1 THEN '{"text": "Clearly GUILTY, risk 0.97"}' WHEN 2 THEN 'no json' WHEN 3 THEN '{"note": 1}' ELSE '{"text": "seen 3 times"}' END"""


@R.add(f"""WITH t AS (SELECT event_id, {_TEXTS} AS t FROM events), b AS (SELECT *, CASE WHEN json_valid(t) THEN json_extract_string(t, '$.text') END AS body FROM t),
f AS (SELECT *, list_distinct(list_filter(regexp_extract_all(body, '[0-9]+(?:[.][0-9]+)?'), lambda x: x NOT IN ('3', '0.97'))) AS nums FROM b)
SELECT event_id, CASE WHEN NOT json_valid(t) THEN 'NOT_JSON' WHEN body IS NULL THEN 'NO_TEXT' ELSE array_to_string(list_sort(list_concat(list_transform(nums, lambda x: 'NUMBER:' || x), CASE WHEN contains(lower(body), 'guilty') THEN ['PHRASE:guilty'] ELSE [] END)), ',') END AS faults FROM f""")
def narrative_faults(spark: SparkSession, folder: str) -> DataFrame:
    """SV-17: narratives that are no JSON, name numbers that no fact has, or use phrases they may not."""
    texts = read_table(spark, folder, "events").select("event_id", F.expr(_TEXTS).alias("t"))
    faults = gv.narrative_faults(F.col("t"), F.array(F.lit("3"), F.lit("0.97")))
    return texts.select("event_id", F.array_join(faults, ",").alias("faults"))


@R.add("""WITH n AS (SELECT count(*) AS n FROM orders)
SELECT v.variant, CAST(n_missing AS INTEGER) AS n_missing, CAST(n_extra AS INTEGER) AS n_extra, n * times AS n_rows, n * again AS n_repeated, n * lost AS n_null, n * odd AS n_unreadable FROM n, (VALUES
 ('intact', 0, 0, 1, 0, 0, 0), ('column_missing', 1, 0, 1, 0, 1, 0), ('column_extra', 0, 1, 1, 0, 0, 0), ('column_renamed', 1, 1, 1, 0, 1, 0), ('column_order', 0, 0, 1, 0, 0, 0), ('all_null', 0, 0, 1, 0, 1, 0),
 ('text_in_numbers', 0, 0, 1, 0, 0, 1), ('rows_repeated', 0, 0, 2, 1, 0, 0), ('empty', 0, 0, 0, 0, 0, 0), ('case_of_headers', 1, 1, 1, 0, 0, 0)) v(variant, n_missing, n_extra, times, again, lost, odd)""")
def intake_variants(spark: SparkSession, folder: str) -> DataFrame:
    """EXT-64: what an intake notices about nine malformed variants of a frame."""
    df = read_table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    out = None
    for name, variant in gv.malformations(df, "o_orderkey", "o_totalprice").items():
        part = gv.intake_verdict(variant, df.columns, "o_orderkey", "o_totalprice").select(F.lit(name).alias("variant"), "*")
        out = part if out is None else out.unionByName(part)
    return out


@R.add("SELECT count(*) AS n_rows, true AS first_built, false AS second_built FROM orders")
def cached_table(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-04/11: a table that is built on its first use and read after."""
    out = _folder(spark, "cache")
    _, first = gv.cached_table(spark, out, lambda: read_table(spark, folder, "orders"))
    stored, second = gv.cached_table(spark, out, lambda: read_table(spark, folder, "orders"))
    return stored.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(first).alias("first_built"), F.lit(second).alias("second_built"))


@R.add(OOF + "SELECT model, rep, count(*) AS n_rows, count(DISTINCT row_index) AS n_distinct, count(*) = (SELECT count(*) FROM orders) AND count(*) = count(DISTINCT row_index) AS is_complete FROM oof GROUP BY ALL")
def oof_contract(spark: SparkSession, folder: str) -> DataFrame:
    """OOF-02: every model and repeat scores every row once."""
    n = read_table(spark, folder, "orders").agg(F.count(F.lit(1)).alias("n_all"))
    sizes = oof(spark, folder).groupBy(*K).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("row_index").alias("n_distinct"))
    whole = (F.col("n_rows") == F.col("n_all")) & (F.col("n_rows") == F.col("n_distinct"))
    return sizes.crossJoin(F.broadcast(n)).select(*K, "n_rows", "n_distinct", whole.alias("is_complete"))  # one row


@R.add(POINTS + "SELECT model, count(*) AS n_repeats, round(avg(ap), 6) AS mean, round(stddev_samp(ap), 6) AS sd, round(min(ap), 6) AS low, round(max(ap), 6) AS high FROM ap GROUP BY model")
def ap_summary(spark: SparkSession, folder: str) -> DataFrame:
    """EXT-42: average precision over the repeats of every model."""
    ap = rk.average_precision_roc(rk.ranked_points(oof(spark, folder), K), K)
    return ap.groupBy("model").agg(F.count(F.lit(1)).alias("n_repeats"), F.avg("ap").alias("mean"), F.stddev_samp("ap").alias("sd"), F.min("ap").alias("low"), F.max("ap").alias("high")).select("model", "n_repeats", *r6("mean", "sd", "low", "high"))


@R.add(EDGES + ", l AS (SELECT DISTINCT account_from AS a, account_to AS b FROM edges) SELECT a AS account, count(*) AS n_neighbours, min(b) AS first_neighbour FROM l GROUP BY a")
def adjacency(spark: SparkSession, folder: str) -> DataFrame:
    """REL-26: each account's outgoing neighbours, kept as rows."""
    return g.links(g.clean_edges(edges(spark, folder))).groupBy(F.col("a").alias("account")).agg(F.count(F.lit(1)).alias("n_neighbours"), F.min("b").alias("first_neighbour"))


@R.add("SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS INTEGER) AS place FROM lineitem QUALIFY place <= 2")
def ordered_top(spark: SparkSession, folder: str) -> DataFrame:
    """REL-18: the top rows of each group under a total order."""
    order = Window.partitionBy("l_orderkey").orderBy(F.col("l_extendedprice").desc(), "l_linenumber")
    return read_table(spark, folder, "lineitem").withColumn("place", F.row_number().over(order)).where("place <= 2").select("l_orderkey", "l_linenumber", "place")


@R.add(OOF + "SELECT model, rep, count(*) FILTER (WHERE score >= 0.3) AS n_open, count(*) FILTER (WHERE score >= 0.6) AS n_above_monitor, round(max(score) FILTER (WHERE score >= 0.3), 6) AS top_risk FROM oof GROUP BY ALL")
def case_counts(spark: SparkSession, folder: str) -> DataFrame:
    """UI-04, SV-07: open cases and those above the lowest tier, of every model and repeat."""
    s = F.col("score")
    return oof(spark, folder).groupBy(*K).agg(F.count_if(s >= 0.3).alias("n_open"), F.count_if(s >= 0.6).alias("n_above_monitor"), F.round(F.max(F.when(s >= 0.3, s)), 6).alias("top_risk"))


@R.add("SELECT p_partkey, p_size, CASE p_size WHEN 1 THEN 'one' WHEN 7 THEN 'seven' WHEN 31 THEN 'month' END AS named FROM part")
def mapped_levels(spark: SparkSession, folder: str) -> DataFrame:
    """REL-23: a dictionary laid over a column; values it lacks are null."""
    names = F.create_map(*(F.lit(x) for pair in ((1, "one"), (7, "seven"), (31, "month")) for x in pair))
    return read_table(spark, folder, "part").select("p_partkey", "p_size", F.try_element_at(names, F.col("p_size").cast("int")).alias("named"))


@R.add("SELECT * FROM (VALUES ('clean', false), ('hard', true), ('conditional', true), ('fairness', true)) v(frame, is_refused)")
def firewall_refusals(spark: SparkSession, folder: str) -> DataFrame:
    """FW-04: frames that name a column of one of the policy's lists are refused, whichever list it is."""
    from ..operators import firewall as fw

    policy = fw.Policy(hard=("o_comment",), conditional=("o_clerk",), fairness=("o_orderpriority",))
    columns = ["o_orderkey", "o_totalprice"]
    found = []
    for name, extra in (("clean", []), ("hard", ["o_comment"]), ("conditional", ["o_clerk"]), ("fairness", ["o_orderpriority"])):
        try:
            fw.assert_clean([*columns, *extra], policy)
            found.append((name, False))
        except ValueError:
            found.append((name, True))
    return spark.createDataFrame(found, "frame string, is_refused boolean")


@R.add("SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation")
def workbook_table(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-02: a sheet of a workbook made a Parquet table (of nation, a fixed table of 25 rows)."""
    rows = read_table(spark, folder, "nation").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").limit(1000)
    out = _folder(spark, "book")
    files.write_bytes(spark, f"{out}/nation.xlsx", files.workbook_bytes(rows.columns, [tuple(r) for r in rows.collect()]))
    files.read_upload(spark, f"{out}/nation.xlsx").write.option("compression", "zstd").parquet(f"{out}/table")
    return spark.read.parquet(f"{out}/table")


@R.add(WIDE + "SELECT feature, count(*) AS n_rows, count(value) AS n_values, round(sum(value), 2) AS total FROM long GROUP BY feature")
def float_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """PROF-04: all columns but the label as one numeric matrix, by its column sums."""
    long = pf.long_form(wide(spark, folder), list(WIDE_COLUMNS), ["row_index"])
    return long.groupBy("feature").agg(F.count(F.lit(1)).alias("n_rows"), F.count("value").alias("n_values"), F.round(F.sum("value"), 2).alias("total"))


@R.add(WIDE + """, m AS (SELECT row_index % 7 AS fold, feature, round(corr(value, target), 9) AS r FROM long WHERE feature IN ('price', 'acctbal', 'nation', 'rare_flag') GROUP BY ALL), k AS (SELECT feature, row_number() OVER (PARTITION BY fold ORDER BY abs(coalesce(r, 0)) DESC, feature) AS rank FROM m),
f AS (SELECT feature, avg((rank <= 2)::INT) AS frequency FROM k GROUP BY feature)
SELECT feature, round(frequency, 6) AS frequency FROM f WHERE frequency >= 0.4 ORDER BY frequency DESC, feature LIMIT 3""".replace("round(corr(value, target), 9)", "round(CASE WHEN isfinite(coalesce(corr(value, target), 'nan'::DOUBLE)) THEN corr(value, target) ELSE 0 END, 9)"))
def stable_features(spark: SparkSession, folder: str) -> DataFrame:
    """SPL-14, 16: the most frequent of the columns that are among the two best in two fifths of the folds."""
    long = pf.long_form(wide(spark, folder), ["price", "acctbal", "nation", "rare_flag"], ["row_index", "target"]).withColumn("fold", F.col("row_index") % 7)
    told = long.groupBy("fold", "feature").agg(F.round(F.coalesce(rk.pearson(F.col("value"), F.col("target").cast("double")), F.lit(0.0)), 9).alias("r"))
    rank = F.row_number().over(Window.partitionBy("fold").orderBy(F.abs("r").desc(), "feature"))  # one row a column
    frequency = told.withColumn("rank", rank).groupBy("feature").agg(F.avg((F.col("rank") <= 2).cast("double")).alias("frequency"))
    return ne.top_features(frequency, 3, 0.4).select("feature", *r6("frequency"))


@R.add("SELECT 'none' AS given, 'NO_EDGES' AS status, 0::BIGINT AS n_edges UNION ALL SELECT 'events', 'AVAILABLE', count(*) FROM (" + EDGES + "SELECT * FROM edges)")
def edge_availability(spark: SparkSession, folder: str) -> DataFrame:
    """EXT-73: what the graph answers without edges, and with them."""
    kept = g.clean_edges(edges(spark, folder))
    none = g.availability(kept.limit(0)).select(F.lit("none").alias("given"), "*")
    return none.unionByName(g.availability(kept).select(F.lit("events").alias("given"), "*"))

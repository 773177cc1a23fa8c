"""Queries on files: reading back what was written, sealed rows, growing tables, similarity of twins, ledgers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import canonical as can
from ..operators import ranking as rk
from ..operators import store
from ..session import read_table, shared_checkpoint_dir
from ..sources import files
from .fixtures import DIRTY, OOF, dirty, oof
from .ranking import POINTS, r6
from .registry import Registry

R = Registry()


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@R.add(DIRTY + "SELECT row_index::DOUBLE AS row_index, nullif(trim(num_txt), 'NA')::DOUBLE AS num_txt, cat_txt, true_date AS date_txt FROM dirty")
def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-05..07, 20: a CSV written, read as text and typed again."""
    out = _folder(spark, "csv")
    files.write_export(dirty(spark, folder), out)
    return can.canonicalise(files.read_csv_tolerantly(spark, f"{out}/*.csv").drop(files.CORRUPT), dates=("date_txt",))


@R.add(OOF + "SELECT count(*) FILTER (WHERE score <= 0.9) AS n_kept, count(*) FILTER (WHERE score > 0.9) AS n_refused FROM oof")
def append_checked(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-15, 16, 19, SV-03/04: appended rows, those against a check set aside."""
    out = _folder(spark, "append")
    rows = oof(spark, folder)
    for rep in range(3):
        files.append_checked(rows.where(F.col("rep") == rep), out, "score <= 0.9D")
    return spark.read.parquet(f"{out}/rows").agg(F.count(F.lit(1)).alias("n_kept")).crossJoin(spark.read.parquet(f"{out}/refused").agg(F.count(F.lit(1)).alias("n_refused")))  # one row each


@R.add(OOF + "SELECT model, count(*) AS n, round(sum(CASE WHEN model = 'm_b' THEN 2 * score ELSE score END), 4) AS total FROM oof GROUP BY model")
def upsert_model(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-14, REL-29: one model's rows replaced, the others left."""
    out = _folder(spark, "upsert")
    rows = oof(spark, folder)
    rows.write.partitionBy("model").parquet(out)
    files.replace_partition(rows.where("model = 'm_b'").withColumn("score", 2 * F.col("score")), out, "model")
    return spark.read.parquet(out).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 4).alias("total"))


@R.add("""
WITH c AS (SELECT o_orderkey AS case_id, o_custkey AS request, o_totalprice AS risk FROM orders WHERE o_orderstatus = 'O'),
f AS (SELECT c_custkey AS request, c_name FROM customer), a AS (SELECT l_orderkey AS case_id, list(l_linenumber ORDER BY l_linenumber) AS actions FROM lineitem GROUP BY 1)
SELECT case_id, risk, c_name, coalesce(array_to_string(actions, ','), '') AS actions FROM c LEFT JOIN f USING (request) LEFT JOIN a USING (case_id)""")
def case_detail(spark: SparkSession, folder: str) -> DataFrame:
    """SV-02, SRC-18: cases with their scores and lists of actions."""
    cases = read_table(spark, folder, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("case_id"), F.col("o_custkey").alias("request"), F.col("o_totalprice").alias("risk"))
    names = read_table(spark, folder, "customer").select(F.col("c_custkey").alias("request"), "c_name")
    actions = read_table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(F.array_sort(F.collect_list("l_linenumber")).alias("actions"))  # a case's actions are few
    joined = cases.join(names, "request", "left").join(actions, "case_id", "left")
    return joined.select("case_id", "risk", "c_name", F.coalesce(F.array_join("actions", ","), F.lit("")).alias("actions"))


@R.add("SELECT event_id, json_object('k', json_extract_string(props, '$.k')) AS kept FROM events")
def redacted_payload(spark: SparkSession, folder: str) -> DataFrame:
    """FW-11/12: payloads without the keys that may not be served."""
    e = read_table(spark, folder, "events")
    payload = F.to_json(F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("F3912"), F.lit("1"))))
    return e.select("event_id", store.redact(payload, ["F3912"]).alias("kept"))


@R.add("""
WITH c AS (SELECT c_custkey AS id, c_acctbal AS a, CASE WHEN c_custkey % 9 <> 0 THEN c_nationkey::DOUBLE END AS b, c_custkey % 3 = 0 AS is_legit FROM customer), s AS (SELECT greatest(quantile_cont(a, 0.75) - quantile_cont(a, 0.25), 1e-9) AS sa, quantile_cont(b, 0.75) - quantile_cont(b, 0.25) AS sb FROM c WHERE is_legit),
d AS (SELECT q.id AS query, r.id AS twin, round(sqrt(power((q.a - r.a) / sa, 2) + coalesce(power((q.b - r.b) / sb, 2), 0) + ((q.b IS NULL) <> (r.b IS NULL))::INT), 6) AS distance FROM c q, c r, s WHERE q.id % 50 = 0 AND r.is_legit AND q.id <> r.id)
SELECT query, twin, distance FROM d QUALIFY row_number() OVER (PARTITION BY query ORDER BY distance, twin) = 1""")
def nearest_twin(spark: SparkSession, folder: str) -> DataFrame:
    """SIM-23/24/27: the nearest legitimate row of the query set on chosen features."""
    import numpy as np

    from ..operators.quantiles import linear_quantiles, value_counts
    from ..operators.similarity import topk_in_blocks

    c = read_table(spark, folder, "customer").select(F.col("c_custkey").alias("row"), F.col("c_acctbal").alias("a"), F.when(F.col("c_custkey") % 9 != 0, F.col("c_nationkey").cast("double")).alias("b"))
    legit = c.where("row % 3 = 0")
    q = {r["feature"]: r["hi"] - r["lo"] for r in linear_quantiles(value_counts(legit.unpivot(["row"], ["a", "b"], "feature", "value"), ["feature"]), ["feature"], {"lo": 0.25, "hi": 0.75}).collect()}  # two rows
    scale = np.array([q["a"] or 1.0, q["b"] or 1.0])

    def distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(y)))
        for j in range(2):
            d = (x[:, j][:, None] - y[:, j][None, :]) / scale[j]
            out += np.where(np.isnan(d), 0.0, d * d) + (np.isnan(x[:, j])[:, None] != np.isnan(y[:, j])[None, :])
        return np.round(np.sqrt(out), 6)

    v = lambda df: df.select("row", F.array("a", F.coalesce("b", F.lit(float("nan")))).alias("v"))
    return topk_in_blocks(v(legit), v(c.where("row % 50 = 0")), 1, distance).select("query", F.col("row").alias("twin"), "distance")


#: Measured seconds a row of the models, and the budget beyond which one is refused.
_LATENCY, _SECONDS = {"m_a": 0.2, "m_b": 0.3, "m_c": 9.0}, 5.0


@R.add(POINTS + """, hit AS (SELECT model, rep, """ + ", ".join(f"sum(target) FILTER (WHERE rn <= {b}) / max(n_pos) AS r{b}" for b in rk.BUDGETS) + """ FROM ranked GROUP BY ALL),
q AS (SELECT model, rep, avg((score - target) ** 2) AS brier, -avg(target * ln(least(greatest(score, 1e-15), 1 - 1e-15)) + (1 - target) * ln(1 - least(greatest(score, 1e-15), 1 - 1e-15))) AS log_loss FROM oof GROUP BY ALL),
j AS (SELECT * FROM ap JOIN hit USING (model, rep) JOIN q USING (model, rep)), lat(model, seconds) AS (VALUES ('m_a', 0.2::DOUBLE), ('m_b', 0.3::DOUBLE), ('m_c', 9.0::DOUBLE)),
m AS (SELECT model, count(*) AS n_repeats, """ + ", ".join(f"avg({c}) AS {c}_mean, stddev_samp({c}) AS {c}_sd" for c in ("ap", "roc_auc", "brier", "log_loss", *(f"r{b}" for b in rk.BUDGETS))) + """ FROM j GROUP BY model),
top AS (SELECT max(ap_mean) AS best FROM m JOIN lat USING (model) WHERE seconds <= 5)
SELECT model, n_repeats, """ + ", ".join(f"round({c}_mean, 6) AS {c}_mean, round({c}_sd, 6) AS {c}_sd" for c in ("ap", "roc_auc", "brier", "log_loss", *(f"r{b}" for b in rk.BUDGETS))) + """,
  round(ap_mean - 4.302652729696142::DOUBLE * ap_sd / sqrt(n_repeats), 6) AS ap_low, round(ap_mean + 4.302652729696142::DOUBLE * ap_sd / sqrt(n_repeats), 6) AS ap_high, seconds, round(ap_mean - 0.5 * ap_sd + 0.1 * r100_mean, 6) AS generalization,
  CASE WHEN seconds > 5 THEN 'REJECTED' WHEN ap_mean = best THEN 'CHAMPION' WHEN ap_mean >= best - 0.01 THEN 'FINALIST' ELSE 'CHALLENGER' END AS status FROM m JOIN lat USING (model), top""")
def model_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """MET-30/31/34/36/37, SV-15, EXT-31: models side by side with deviations, t intervals, measured latency and a status."""
    from ..operators.resampling import t_critical

    rows = oof(spark, folder)
    keys = ["model", "rep"]
    out = _folder(spark, "latency")
    spark.createDataFrame(list(_LATENCY.items()), "model string, seconds double").coalesce(1).write.json(out)
    latency = spark.read.schema("model string, seconds double").json(out)
    ap = rk.average_precision_roc(rk.ranked_points(rows, keys), keys).select(*keys, "ap", "roc_auc")
    hits = rk.at_budgets(rk.ranked_rows(rows, keys), keys).groupBy(*keys).pivot("budget", list(rk.BUDGETS)).agg(F.first("recall")).toDF(*keys, *(f"r{b}" for b in rk.BUDGETS))
    quality = rk.probability_quality(rows, keys).select(*keys, "brier", "log_loss")
    names = ["ap", "roc_auc", "brier", "log_loss", *(f"r{b}" for b in rk.BUDGETS)]
    m = ap.join(hits, keys).join(quality, keys).groupBy("model").agg(F.count(F.lit(1)).alias("n_repeats"), *(f(c).alias(f"{c}_{n}") for c in names for n, f in (("mean", F.avg), ("sd", F.stddev_samp))))
    told = m.join(latency, "model")  # one row a model
    fits = F.col("seconds") <= _SECONDS
    best = F.max(F.when(fits, F.col("ap_mean"))).over(Window.partitionBy(F.lit(1)))
    half = F.lit(t_critical(2)) * F.col("ap_sd") / F.sqrt("n_repeats")
    status = F.when(~fits, "REJECTED").when(F.col("ap_mean") == best, "CHAMPION").when(F.col("ap_mean") >= best - 0.01, "FINALIST").otherwise("CHALLENGER")
    figures = told.select("*", (F.col("ap_mean") - half).alias("ap_low"), (F.col("ap_mean") + half).alias("ap_high"), (F.col("ap_mean") - 0.5 * F.col("ap_sd") + 0.1 * F.col("r100_mean")).alias("generalization"), status.alias("status"))
    return figures.select("model", "n_repeats", *r6(*(f"{c}_{n}" for c in names for n in ("mean", "sd")), "ap_low", "ap_high"), "seconds", *r6("generalization"), "status")


@R.add("""
SELECT 'orders' AS source, o_orderstatus AS kind, NULL::BIGINT AS priority, count(*) AS n FROM orders GROUP BY o_orderstatus UNION ALL SELECT 'events', event_type, NULL, count(*) FROM events GROUP BY event_type
UNION ALL SELECT 'parts', NULL, p_size, count(*) FROM part GROUP BY p_size""")
def experiment_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """SV-12: rows of different shapes in one ledger; what a source lacks is null."""
    o = read_table(spark, folder, "orders").groupBy(F.col("o_orderstatus").alias("kind")).agg(F.count(F.lit(1)).alias("n")).withColumn("source", F.lit("orders"))
    e = read_table(spark, folder, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n")).withColumn("source", F.lit("events"))
    p = read_table(spark, folder, "part").groupBy(F.col("p_size").cast("bigint").alias("priority")).agg(F.count(F.lit(1)).alias("n")).withColumn("source", F.lit("parts"))
    return o.unionByName(e).unionByName(p, allowMissingColumns=True).select("source", "kind", "priority", "n")


@R.add(OOF + """
, s AS (SELECT row_index, score, target FROM oof WHERE model = 'm_a' AND rep = 0), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, row_index) AS rn FROM s),
c AS (SELECT rn AS budget, sum(target) OVER (ORDER BY rn) AS tp, sum(target) OVER () AS pos FROM r)
SELECT budget, budget * 12.5::DOUBLE / 60 AS hours, budget * 12.5::DOUBLE / 60 * 30 AS cost, tp * 1000.0::DOUBLE AS surfaced, CAST(pos - tp AS BIGINT) AS missed FROM c WHERE budget = 150""")
def impact_simulator(spark: SparkSession, folder: str) -> DataFrame:
    """UI-01: hours, cost and surfaced exposure at a capacity."""
    from ..operators import capacity as cap

    rows = oof(spark, folder).where("model = 'm_a' AND rep = 0").withColumn("k", F.lit(1))
    curve = cap.capacity_curve(rk.ranked_rows(rows, ["k"]), rk.ranked_points(rows, ["k"]), ["k"], cap.budget_grid(spark, read_table(spark, folder, "orders").count()))
    return store.impact(curve, 150, 12.5, 30.0, 1000.0)

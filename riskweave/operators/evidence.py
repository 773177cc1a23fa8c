"""Evidence graphs as nested columns, and the checks on what they say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE = "struct<id:string,type:string,source:string,weight:double>"
EDGE = "struct<from:string,to:string,relation:string,weight:double>"


def _node(name: Column, kind: str, source: Column, weight: Column) -> Column:
    return F.struct(name.alias("id"), F.lit(kind).alias("type"), source.alias("source"), weight.cast("double").alias("weight"))


def evidence_graph(rows: DataFrame, key: str) -> DataFrame:
    """(key, nodes, edges): the account, its reasons for and against, its doubts, and the decision.

    rows: key, risk, reasons array<struct<feature, weight, raises>>, doubts array<struct<doubt, weight>>.
    Null arrays count as empty.
    """
    reasons = F.coalesce("reasons", F.expr("cast(array() as array<struct<feature:string,weight:double,raises:boolean>>)"))
    doubts = F.coalesce("doubts", F.expr("cast(array() as array<struct<doubt:string,weight:double>>)"))
    of = lambda raises, kind, start: F.transform(F.filter(reasons, lambda r: r["raises"] == raises), lambda r: _node(F.concat(F.lit(start), r["feature"]), kind, r["feature"], r["weight"]))
    pro, con = of(True, "EVIDENCE_FOR", "for:"), of(False, "EVIDENCE_AGAINST", "against:")
    doubt = F.transform(doubts, lambda d: _node(F.concat(F.lit("doubt:"), d["doubt"]), "UNCERTAINTY", d["doubt"], d["weight"]))
    account = F.array(_node(F.lit("account"), "ACCOUNT", F.lit("account_reference"), F.col("risk")), _node(F.lit("decision"), "DECISION", F.lit("policy"), F.col("risk")))
    edge = lambda nodes, relation: F.transform(nodes, lambda n: F.struct(F.lit("account").alias("from"), n["id"].alias("to"), F.lit(relation).alias("relation"), n["weight"].alias("weight")))
    result = F.array(F.struct(F.lit("account").alias("from"), F.lit("decision").alias("to"), F.lit("RESULTS_IN").alias("relation"), F.col("risk").cast("double").alias("weight")))
    return rows.select(key, F.concat(account, pro, con, doubt).cast(f"array<{NODE}>").alias("nodes"), F.concat(edge(pro, "RAISED_BY"), edge(con, "MITIGATED_BY"), edge(doubt, "QUALIFIED_BY"), result).cast(f"array<{EDGE}>").alias("edges"))


def is_traceable(nodes: Column, edges: Column) -> Column:
    """Whether every node names a source and every edge ends at nodes."""
    ids = F.transform(nodes, lambda n: n["id"])
    return F.forall(nodes, lambda n: n["source"].isNotNull() & (n["source"] != "")) & F.forall(edges, lambda e: F.array_contains(ids, e["from"]) & F.array_contains(ids, e["to"]))


def source_tokens(nodes: Column) -> Column:
    """The distinct sources of the nodes, in their order."""
    return F.array_distinct(F.transform(nodes, lambda n: n["source"]))


def claims(text: Column, phrases: list[str]) -> Column:
    """The phrases that a text claims, however its words are separated."""
    plain = F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")
    return F.array_compact(F.array(*(F.when(plain.contains(p), F.lit(p)) for p in phrases)))


def packet(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, packet): the columns as one JSON text."""
    return rows.select(key, F.to_json(F.struct(*columns)).alias("packet"))

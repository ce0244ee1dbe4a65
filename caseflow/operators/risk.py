"""Explainable 0-100 risk of entities and cases, from the case's own graph.

A score is the sum of named factors, each a weight times a clipped measure. Scores of one case never depend on another.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.functions import text as t
from caseflow.operators import graph
from caseflow.operators.work import cut, once


@dataclass(frozen=True)
class RiskConfig:
    # fixed values: (weight, saturation) of each factor
    entity: dict = field(default_factory=lambda: {"connectivity": (0.25, 8.0), "counterparties": (0.20, 5.0), "repeats": (0.15, 4.0), "reach": (0.20, 0.6), "relation_types": (0.10, 4.0), "exposure": (0.10, 0.75)})
    case: dict = field(default_factory=lambda: {"peak": (0.40, 1.0), "density": (0.25, 0.10), "linked": (0.20, 1.0), "mean": (0.15, 1.0)})
    hops: int = 3
    high: float = 70.0


def exposure(rels: DataFrame) -> DataFrame:
    """Sum of |amount| of the investigative edges of every key (a self-loop counts once), and the case's peak over all keys.

    Amounts are summed as decimals, so the result does not depend on row order.
    """
    e = graph.investigative(rels).select("case_id", F.explode(F.array_distinct(F.array("source", "target"))).alias("key"), t.magnitude(F.col("amount")).cast("decimal(28,2)").alias("m"))
    sums = e.groupBy("case_id", "key").agg(F.sum("m").alias("exposure"))
    peaks = sums.groupBy("case_id").agg(F.max("exposure").alias("peak"))
    return sums.join(peaks, "case_id").select("case_id", "key", F.col("exposure").cast("double").alias("exposure"), F.col("peak").cast("double").alias("peak"))


def factor(name: str, value: Column, config: dict) -> Column:
    weight, saturation = config[name]
    n = t.unit(value / saturation)
    return F.struct(F.lit(name).alias("name"), t.rounded(n * (weight * 100), 2).alias("points"), t.rounded(n, 4).alias("normalised"))


def total(factors: Column) -> Column:
    return t.rounded(F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.aggregate(factors, F.lit(0.0), lambda a, f: a + f.points))), 2)


def measures(rels: DataFrame, peers: DataFrame | None = None, hops: int = 3, reached: DataFrame | None = None) -> DataFrame:
    """All measures of every peer (case_id, key), connected or not; without ``peers`` of the members of ``rels``. ``reached`` (case_id, key, reach): the reach of all peers, if known already."""
    # read by several jobs: made once
    rels = once(rels, "case_id", "source", "target", "relation", "amount")
    adj = graph.adjacency(rels)
    peers = cut(graph.members(rels)) if peers is None else peers
    peers = peers.filter(~t.is_case_node(F.col("key"))).select("case_id", "key").distinct()
    counts = peers.groupBy("case_id").agg(F.count("*").alias("peers"))
    reached, connected = graph.reach_and_connectivity(adj, hops, peers) if reached is None else (reached, graph.connectivity(adj))
    out = peers.join(counts, "case_id").join(connected, ["case_id", "key"], "left").join(exposure(rels), ["case_id", "key"], "left").join(reached, ["case_id", "key"], "left")
    return out.fillna(0, ["degree", "counterparties", "relation_types", "repeats", "reach"]).fillna(0.0, ["exposure"])


def entity_risk(rels: DataFrame, peers: DataFrame | None = None, config: RiskConfig | None = None) -> DataFrame:
    """Every peer's measures, factors, score and band; the peers are the members of ``rels`` if none are given."""
    config = config or RiskConfig()
    return scored(measures(rels, peers, config.hops), config)


def scored(measured: DataFrame, config: RiskConfig) -> DataFrame:
    """``measured`` with factors, score and band."""
    c = F.col
    reach = F.when(c("peers") > 1, c("reach") / (c("peers") - 1)).otherwise(0.0)
    share = F.when(c("peak") > 0, c("exposure") / c("peak")).otherwise(0.0)
    values = {"connectivity": c("degree"), "counterparties": c("counterparties"), "repeats": c("repeats"), "reach": reach, "relation_types": c("relation_types"), "exposure": share}
    out = measured.withColumn("factors", F.array(*[factor(n, v.cast("double"), config.entity) for n, v in values.items()]))
    return out.withColumn("score", total(c("factors"))).withColumn("band", t.risk_band(c("score")))


def refresh(before: DataFrame, rels: DataFrame, peers: DataFrame, changed: DataFrame, config: RiskConfig | None = None) -> DataFrame:
    """What ``entity_risk(rels, peers)`` returns, from its result ``before`` some edges ``changed`` (added to or taken from ``rels``, columns as there) and peers came or went.

    Cases without a changed edge or peer keep their rows. In the others, measures of single edges and the peaks are made anew, which is one pass over the case, and the reach
    only of keys within ``hops`` of a changed edge or peer; all other keys keep their reach.
    """
    config = config or RiskConfig()
    columns = before.columns
    before = cut(before)
    edges = changed.select("case_id", "source", "target", "relation", "id")
    people = cut(peers.filter(~t.is_case_node(F.col("key"))).select("case_id", "key").distinct())
    old = before.select("case_id", "key")
    keys = people.join(old, ["case_id", "key"], "left_anti").unionByName(old.join(people, ["case_id", "key"], "left_anti"))
    keys = cut(keys.unionByName(edges.select("case_id", F.explode(F.array("source", "target")).alias("key"))).distinct())
    touched = cut(keys.select("case_id").distinct())
    mine = cut(rels.join(touched, "case_id", "left_semi").select("case_id", "source", "target", "relation", "amount", "id"))
    around = cut(graph.near(graph.adjacency(mine.select(edges.columns).unionByName(edges)), keys, config.hops))
    people = people.join(touched, "case_id", "left_semi")
    known = before.join(touched, "case_id", "left_semi").select("case_id", "key", "reach").join(around, ["case_id", "key"], "left_anti")
    reached = graph.reach_counts(graph.adjacency(mine), config.hops, people, of=around).unionByName(known)
    new = scored(measures(mine, people, config.hops, reached), config)
    return before.join(touched, "case_id", "left_anti").unionByName(new.select(columns))


def leaderboard(scored: DataFrame, sort: str = "riskDesc", bucket: str | None = None, k: int | None = None) -> DataFrame:
    """Scored entities of a case in order, with their rank: by risk either way, by degree, or by name or key; ``bucket`` keeps HIGH, MODERATE or LOW risks."""
    c = F.col
    out = scored if bucket is None else scored.filter({"HIGH": c("score") >= 70, "MODERATE": (c("score") >= 40) & (c("score") < 70), "LOW": c("score") < 40}[bucket])
    name = F.lower("name") if "name" in scored.columns else c("key")
    order = {"riskDesc": [F.desc("score")], "riskAsc": [c("score")], "relsDesc": [F.desc("degree")], "nameAsc": [name]}[sort]
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy(*order, "key")))
    return out if k is None else out.filter(c("rank") <= k)


def report(rels: DataFrame, entities: DataFrame, cases: DataFrame, config: RiskConfig | None = None):
    """(entity report, case report) of all cases: case scores with their membership edges counted apart and the declared label (``risk`` of cases) beside the computed band."""
    scored = entity_risk(rels, graph.members(rels, entities), config)
    apart = rels.groupBy("case_id").agg(F.count_if(t.is_investigative(F.col("relation"))).alias("investigative_edges"), F.count_if(~t.is_investigative(F.col("relation"))).alias("membership_edges"))
    out = cases.select("case_id", F.col("risk").alias("declared")).join(case_risk(rels, scored, config), "case_id", "left").join(apart, "case_id", "left")
    return scored, out.fillna(0, ["entities", "linked_entities", "internal_edges", "investigative_edges", "membership_edges"]).fillna(0.0, ["score"])


def case_risk(rels: DataFrame, scored: DataFrame, config: RiskConfig | None = None) -> DataFrame:
    """Every case's factors, score and band from the scores of its peers and its internal edges."""
    config = config or RiskConfig()
    inv = graph.investigative(rels).filter("source <> target")
    keys = scored.select("case_id", "key")
    inside = inv.join(keys.withColumnRenamed("key", "source"), ["case_id", "source"], "left_semi").join(keys.withColumnRenamed("key", "target"), ["case_id", "target"], "left_semi")
    edges = inside.groupBy("case_id").agg(F.count("*").alias("internal_edges"))
    c = F.col
    out = scored.groupBy("case_id").agg(F.count("*").alias("entities"), F.count_if(c("degree") > 0).alias("linked_entities"), F.max("score").alias("peak_score"), F.sum(c("score").cast("decimal(28,2)")).cast("double").alias("score_sum"))
    out = out.join(edges, "case_id", "left").fillna(0, ["internal_edges"])
    pairs = c("entities") * (c("entities") - 1) / 2
    values = {"peak": c("peak_score") / 100, "density": F.when(pairs > 0, c("internal_edges") / pairs).otherwise(0.0), "linked": c("linked_entities") / c("entities"), "mean": c("score_sum") / c("entities") / 100}
    out = out.withColumn("factors", F.array(*[factor(n, v.cast("double"), config.case) for n, v in values.items()]))
    return out.withColumn("score", total(c("factors"))).withColumn("band", t.risk_band(c("score")))


def stored_risk(entities: DataFrame, scored: DataFrame) -> DataFrame:
    """Each entity's greatest score over all cases, 0 where there is none."""
    best = scored.groupBy("key").agg(F.max("score").alias("risk"))
    return entities.select("key").distinct().join(best, "key", "left").fillna(0.0, ["risk"])

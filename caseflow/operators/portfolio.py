"""Validation and registers of cases, and figures of the whole portfolio."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseflow.functions import text as t
from caseflow.operators import graph, risk

# fixed values: allowed labels and lengths
RISKS, STATUSES = ("Low", "Medium", "High"), ("Pending", "Solved", "Open", "Closed")
TITLE, DESCRIPTION, REFERENCE = 255, 5000, 120


def validate_cases(new: DataFrame, existing: DataFrame) -> DataFrame:
    """``new`` (id, title, reference_id, ...) with cleaned risk and status and the list of its violations, empty for good rows."""
    title, ref = t.strip(F.coalesce("title", F.lit(""))), t.strip(F.coalesce("reference_id", F.lit("")))
    known = existing.select(F.col("reference_id").alias("known")).distinct()
    out = new.withColumn("reference_id", ref).join(known, F.col("reference_id") == F.col("known"), "left")
    out = out.withColumn("n", F.row_number().over(Window.partitionBy("reference_id").orderBy("id")))
    checks = [
        F.when((title == "") | (F.length(title) > TITLE), "title"),
        F.when((F.col("reference_id") == "") | (F.length("reference_id") > REFERENCE), "reference").when(F.col("known").isNotNull(), "duplicate").when(F.col("n") > 1, "repeated"),
    ]
    if "description" in new.columns:
        checks.append(F.when(F.length("description") > DESCRIPTION, "description"))
    if "risk" in new.columns:
        out = out.withColumn("risk", F.when(F.col("risk").isin(*RISKS), F.col("risk")).otherwise("Medium"))
    if "status" in new.columns:
        out = out.withColumn("status", F.when(F.col("status").isin(*STATUSES), F.col("status")).otherwise("Pending"))
    return out.withColumn("violations", F.filter(F.array(*checks), lambda v: v.isNotNull())).drop("known", "n")


def backfill_references(cases: DataFrame) -> DataFrame:
    """``cases`` (case_id, reference_id, ...) with blank references set to CL-LEGACY-<id>, and as many X behind as make it differ from all others."""
    blank = t.strip(F.coalesce("reference_id", F.lit(""))) == ""
    base = F.format_string("CL-LEGACY-%03d", F.col("case_id"))
    # taken: references that are a legacy one with some X behind
    stem, tail = F.regexp_extract("reference_id", "^(.*?)(X*)$", 1), F.regexp_extract("reference_id", "^(.*?)(X*)$", 2)
    taken = cases.filter(~blank).select(stem.alias("stem"), F.length(tail).alias("n")).groupBy("stem").agg(F.collect_set("n").alias("used"))
    out = cases.withColumn("stem", F.when(blank, base)).join(taken, "stem", "left")
    free = F.array_min(F.array_except(F.sequence(F.lit(0), F.size(F.coalesce("used", F.array().cast("array<int>")))), F.coalesce("used", F.array().cast("array<int>"))))
    return out.withColumn("reference_id", F.when(F.col("stem").isNull(), F.col("reference_id")).otherwise(F.concat("stem", F.repeat(F.lit("X"), free)))).drop("stem", "used")


def statistics(cases: DataFrame, scored: DataFrame, leads: DataFrame, documents: DataFrame, integrity: DataFrame, blocks: DataFrame, security: DataFrame, audit: DataFrame) -> DataFrame:
    """One row of figures over all cases: cases by status, entities with a risk of 70 or more in some case, leads (edges), documents, integrity, ledger, security and failed logins."""
    active = F.lower("status").isin("open", "active", "pending")
    parts = [
        cases.agg(F.count("*").alias("cases"), F.count_if(active).alias("active"), F.count_if(F.col("status") == "Solved").alias("solved"), F.count_if(F.col("status") == "Pending").alias("pending")),
        scored.filter("score >= 70").agg(F.count_distinct("key").alias("high_risk")),
        leads.agg(F.count("*").alias("leads")),
        documents.agg(F.count("*").alias("documents")),
        integrity.agg(F.count_if(F.col("status").eqNullSafe("VERIFIED")).alias("verified"), F.count_if(~F.col("status").eqNullSafe("VERIFIED")).alias("unverified")),
        blocks.agg(F.count("*").alias("ledger_blocks")),
        security.agg(F.count("*").alias("security_events")),
        audit.agg(F.count_if(F.col("action") == "LOGIN_FAILED").alias("failed_logins")),
    ]
    # frames of one row each
    out = parts[0]
    for x in parts[1:]:
        out = out.join(F.broadcast(x))
    return out


def security_overview(integrity: DataFrame, audit: DataFrame, files: DataFrame) -> DataFrame:
    """One row: fingerprints in all and verified, SECURE if all are or REVIEW, failed logins, and files that the ingest blocked (verdict BLOCKED or REJECTED)."""
    a = integrity.agg(F.count("*").alias("integrity_total"), F.count_if(F.col("status").eqNullSafe("VERIFIED")).alias("verified"))
    a = a.withColumn("state", F.when(F.col("integrity_total") == F.col("verified"), "SECURE").otherwise("REVIEW"))
    b = audit.agg(F.count_if(F.col("action") == "LOGIN_FAILED").alias("failed_logins"))
    c = files.agg(F.count_if(F.col("verdict").isin("BLOCKED", "REJECTED")).alias("blocked_files"))
    return a.join(F.broadcast(b)).join(F.broadcast(c))


def case_counts(cases: DataFrame, documents: DataFrame, rels: DataFrame, entities: DataFrame) -> DataFrame:
    """Documents, relationships, members by edges and own entities of every case, 0 where there is none."""
    out = cases.select("case_id", "reference_id")
    for df, name in ((documents, "documents"), (rels, "relationships"), (graph.members(rels), "member_entities"), (entities, "own_entities")):
        out = out.join(df.groupBy("case_id").agg(F.count("*").alias(name)), "case_id", "left")
    return out.fillna(0)


def entity_list(entities: DataFrame, rels: DataFrame, scored: DataFrame, case_id: int | None = None) -> DataFrame:
    """Every entity with its relationships, risk and band; over all cases the greatest score, or one case's members with their scores there."""
    if case_id is None:
        found, counts = risk.stored_risk(entities, scored), graph.degrees(rels).groupBy("key").agg(F.sum("degree").alias("relationships"))
        out = entities
    else:
        inside = graph.members(rels, entities).filter(F.col("case_id") == case_id).select("key")
        found, out = scored.filter(F.col("case_id") == case_id).select("key", F.col("score").alias("risk")), entities.join(inside, "key", "left_semi")
        counts = graph.degrees(rels.filter(F.col("case_id") == case_id)).select("key", F.col("degree").alias("relationships"))
    out = out.join(counts, "key", "left").join(found, "key", "left").fillna(0, ["relationships"]).fillna(0.0, ["risk"])
    return out.withColumn("band", t.risk_band(F.col("risk")))

"""Deletion of cases and documents with all that hangs on them. Tables are frames; every function gives new versions and changes nothing at rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.functions import text as t


def delete_cases(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """``tables`` without the cases of ``gone`` (case_id): their rows in every table with a case_id, and entities that nothing holds any more.

    An entity goes if no edge of another case touches it and it is of a deleted case, or of no case but touched by an edge of a
    deleted one; so does the node of a deleted case. ``tables`` has relationships and entities; all others are filtered by case_id.
    """
    dead = gone.select("case_id").distinct()
    out = {name: df.join(dead, "case_id", "left_anti").select(df.columns) for name, df in tables.items() if name != "entities"}
    rels, entities = tables["relationships"], tables["entities"]
    ends = lambda df: df.select(F.explode(F.array("source", "target")).alias("key")).distinct()
    held = ends(out["relationships"])
    touched = ends(rels.join(dead, "case_id", "left_semi")).withColumn("touched", F.lit(True))
    own = dead.withColumn("dead", F.lit(True))
    loose = entities.join(held, "key", "left_anti").select("id", "key", "case_id").join(own, "case_id", "left").join(touched, "key", "left")
    lost = loose.filter(F.col("dead") | (F.col("case_id").isNull() & F.col("touched"))).select("id")
    nodes = entities.filter(t.is_case_node(F.col("key"))).join(dead, "case_id", "left_semi").select("id")
    out["entities"] = entities.join(lost.union(nodes), "id", "left_anti").select(entities.columns)
    return out


def delete_documents(requests: DataFrame, documents: DataFrame, integrity: DataFrame, chunks: DataFrame):
    """(report, documents, integrity, chunks) after requests (document_id, case_id; null: any case).

    The report tells DELETED, NOT_FOUND, or MISMATCH for a document of another case, which stays; its counts are the integrity rows and chunks that went.
    """
    owner = documents.select("document_id", F.col("case_id").alias("owner"), F.lit(True).alias("known"))
    r = requests.select("document_id", "case_id").distinct().join(owner, "document_id", "left")
    verdict = F.when(F.col("known").isNull(), "NOT_FOUND").when(F.col("case_id").isNull() | F.col("case_id").eqNullSafe(F.col("owner")), "DELETED").otherwise("MISMATCH")
    r = r.select("document_id", "case_id", verdict.alias("verdict"))
    dead = r.filter("verdict = 'DELETED'").select("document_id").distinct()
    counts = lambda df, name: df.join(dead, "document_id", "left_semi").groupBy("document_id").agg(F.count("*").alias(name))
    report = r.join(counts(integrity, "integrity_rows"), "document_id", "left").join(counts(chunks, "chunks"), "document_id", "left")
    for name in ("integrity_rows", "chunks"):
        report = report.withColumn(name, F.when(F.col("verdict") == "DELETED", F.coalesce(name, F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long")))
    return report, *(df.join(dead, "document_id", "left_anti").select(df.columns) for df in (documents, integrity, chunks))

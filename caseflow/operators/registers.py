"""Registers as a user sees them: filtered by text and category, sorted with places, newest rows first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.functions import text as t
from caseflow.operators.work import cut

# fixed values: the columns that each register's text filter looks at, and those that its category filter compares
FILTERS = {
    "cases": (("title", "reference_id", "description"), ("status",)),
    "entities": (("name", "key", "phone", "email", "account", "vehicle"), ("label",)),
    "relationships": (("source", "target", "relation", "source_name", "target_name"), ()),
    "documents": (("filename", "doc_type", "sha256", "case_reference"), ("doc_type", "data_category")),
    "ledger": (("block_index", "event_type", "block_hash", "previous_hash", "payload"), ("event_type",)),
}
#: Sorts of the entity table; each goes both ways, ties keep the order of ids.
SORTS = ("risk", "relationships", "name", "type", "resolution")
NEWEST = 100


def shown(df: DataFrame, register: str, query: str = "", category: str | None = None) -> DataFrame:
    """The rows of a register that hold ``query`` (in any letter case) and are of ``category``.

    A blank query or no category keeps all rows; null columns are blank, and columns that ``df`` lacks are not looked at. A document's category may be its type, its data
    category or part of its extension. A ledger block is searched as one line: index, type, hash, previous hash and payload with blanks between.
    """
    columns, kinds = FILTERS[register]
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns if c in df.columns]
    text = [F.concat_ws(" ", *text)] if register == "ledger" else text
    out = df.filter(t.contains_any(text, F.lit(query.strip())))
    if category is None:
        return out
    same = [F.upper(F.coalesce(F.col(c), F.lit(""))) == category.upper() for c in kinds if c in df.columns]
    if register == "documents" and "file_extension" in df.columns:
        same.append(F.contains(F.upper(F.coalesce("file_extension", F.lit(""))), F.lit(category.upper())))
    return out.filter(reduce(lambda a, b: a | b, same)) if same else out


def newest(df: DataFrame, by: str = "id", k: int = NEWEST) -> DataFrame:
    """The ``k`` rows of the greatest ``by``, newest first."""
    return df.orderBy(F.desc(by)).limit(k)


def places(df: DataFrame, by: str, *order: Column) -> DataFrame:
    """``df`` with place: 1, 2, ... in each value of ``by``, in order of ``order`` (which must tell all rows apart, else ties have any order).

    Rows are dealt by ranges of (``by``, ``order``) whose bounds Spark samples, so a large value of ``by`` lies in many tasks. A range
    ranks its own rows and adds how many of the value lie in ranges before; only these counts, one for each value and range, meet in a window.
    """
    ranged = cut(df.repartitionByRange(F.col(by), *order).withColumn("range", F.spark_partition_id()))
    counts = ranged.groupBy(by, "range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(F.col(by).alias("of"), F.col("range").alias("in"), F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy(by, "range").orderBy(*order))
    out = ranged.withColumn("own", own).join(counts, F.col(by).eqNullSafe(F.col("of")) & (F.col("range") == F.col("in")))
    return out.withColumn("place", F.col("before") + F.col("own")).drop("range", "own", "of", "in", "before")


def sorted_entities(entities: DataFrame, sort: str, descending: bool = False) -> DataFrame:
    """Entities (case_id, id, key, label, name, and risk, relationships or resolution_status as the sort needs) with their place in their case.

    Numbers that are null count as 0, texts as blank; a blank name is the key. Texts are compared by base letters.
    """
    base = lambda c: F.collate(F.coalesce(c, F.lit("")), "UNICODE_CI_AI")
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    key = {"risk": lambda: number("risk"), "relationships": lambda: number("relationships"), "name": lambda: base(F.coalesce(F.nullif("name", F.lit("")), F.col("key"))), "type": lambda: base(F.col("label")), "resolution": lambda: base(F.col("resolution_status"))}[sort]()
    ranked = entities.withColumn("sort_key", key)
    order = F.desc("sort_key") if descending else F.asc("sort_key")
    return places(ranked, "case_id", order, F.asc("id")).drop("sort_key")


def orphans(entities: DataFrame, rels: DataFrame) -> DataFrame:
    """Keys of entities that no edge of any case touches, case nodes left out."""
    active = rels.select(F.explode(F.array("source", "target")).alias("key")).distinct()
    return entities.filter(~t.is_case_node(F.col("key"))).select("key").distinct().join(active, "key", "left_anti")


def case_reference(reference: Column, case_id: Column) -> Column:
    """A case's reference, or CL-<id> where it has none."""
    return F.coalesce(F.nullif(reference, F.lit("")), F.format_string("CL-%03d", case_id))

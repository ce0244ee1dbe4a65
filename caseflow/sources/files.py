"""Evidence files: record and text scans, classification, reports and document metadata. All scans read many files at once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseflow.functions import text as t
from caseflow.operators.work import cut

# fixed values: extensions, limits and record containers
STRUCTURED = (".csv", ".xlsx", ".xls", ".json")
ALLOWED = (*STRUCTURED, ".txt", ".pdf", ".docx", ".png", ".jpg", ".jpeg")
MAX_BYTES = 25 * 1024 * 1024
CONTENT_CHARS, PREVIEW_CHARS, PREVIEW_ROWS = 100_000, 50_000, 10
CONTAINERS = ("records", "entities", "persons", "people", "items", "entries", "rows", "results", "data")


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, or for a local session without it under the temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.gettempdir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def classify(path: Column) -> Column:
    """STRUCTURED, UNSTRUCTURED or BLOCKED by extension."""
    e = extension(path)
    return F.when(~e.isin(*ALLOWED), "BLOCKED").when(e.isin(*STRUCTURED), "STRUCTURED").otherwise("UNSTRUCTURED")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as cleaned strings, with column file; a byte order mark is skipped."""
    df = spark.read.csv(path, header=True, inferSchema=False, encoding="UTF-8", escape="\"")
    return df.select(F.col("_metadata.file_path").alias("file"), *[t.clean(F.col(f"`{c}`")).alias(c) for c in df.columns])


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(file, content) of whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content"))


def read_binary(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, length, content) of files within the size limit; the limit reaches the scan, so larger files are not loaded."""
    return spark.read.format("binaryFile").load(path).filter(F.col("length") <= max_bytes).select("path", "length", "content")


def oversized(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, length) of the files that ``read_binary`` rejects; contents are not loaded."""
    return spark.read.format("binaryFile").load(path).filter(F.col("length") > max_bytes).select("path", "length")


def _is(v: Column, kind: str) -> Column:
    return F.schema_of_variant(v).startswith(kind)


def _container(v: Column) -> Column:
    """(rows, inner) of the first container key of an object that holds a list of objects or another object; nulls if there is none."""
    out = []
    for name in CONTAINERS:
        inner = F.try_variant_get(v, f"$.{name}", "variant")
        rows = F.try_variant_get(v, f"$.{name}", "array<variant>")
        listed = F.when((F.size(rows) > 0) & F.forall(rows, lambda r: _is(r, "OBJECT")), rows)
        nested = F.when(_is(inner, "OBJECT"), inner)
        out.append(F.when(listed.isNotNull() | nested.isNotNull(), F.struct(listed.alias("rows"), nested.alias("inner"))))
    return F.coalesce(*out)


def json_records(files: DataFrame):
    """(records, rejects): (file, row, record variant) of good files and (file, error) of the others; one bad file stops no other.

    Containers are followed from object to object at any depth, one round of all files a level.
    """
    whole = F.try_variant_get(F.col("v"), "$", "array<variant>")
    listed = F.when(~_is(F.col("v"), "OBJECT") & F.forall(whole, lambda r: _is(r, "OBJECT")), whole)
    top = files.select("file", F.try_parse_json("content").alias("v")).select("file", "v", listed.alias("rows"))
    object_ = F.coalesce(_is(F.col("v"), "OBJECT"), F.lit(False))
    parsed, cur = top.filter(~object_), cut(top.filter(object_).select("file", "v"))
    while not cur.isEmpty():
        step = cur.withColumn("c", _container(F.col("v")))
        parsed = parsed.unionByName(step.filter("c.inner IS NULL").select("file", "v", F.coalesce("c.rows", F.array("v")).alias("rows")))
        cur = cut(step.filter("c.inner IS NOT NULL").select("file", F.col("c.inner").alias("v")))
    records = parsed.filter("size(rows) > 0").select("file", F.posexplode("rows").alias("row", "record"))
    error = F.when(F.col("v").isNull(), "not JSON").when(F.col("rows").isNull(), "not an object or an array of objects").otherwise("no records")
    return records, parsed.filter("rows IS NULL OR size(rows) = 0").select("file", error.alias("error"))


def json_fields(frame: DataFrame, variant: str, keys: list[str], levels: int = 3) -> DataFrame:
    """(keys..., name, value): leaves of a variant object, nested names joined by _ down to ``levels``; lists stay values."""
    view = f"fields_{uuid.uuid4().hex}"
    cols = ", ".join(keys)
    cur, leaves = frame.select(*keys, F.lit("").alias("prefix"), F.col(variant).alias("v")), None
    for level in range(levels):
        cur.createOrReplaceTempView(view)
        step = frame.sparkSession.sql(f"SELECT {cols}, concat_ws('_', nullif(prefix, ''), e.key) AS prefix, e.value AS v, schema_of_variant(e.value) AS kind FROM {view}, LATERAL variant_explode(v) AS e")
        leaf = step if level == levels - 1 else step.filter("kind NOT LIKE 'OBJECT%'")
        leaf = leaf.select(*keys, F.col("prefix").alias("name"), F.coalesce(F.try_variant_get("v", "$", "string"), F.to_json("v")).alias("value"), "kind")
        leaves = leaf if leaves is None else leaves.unionByName(leaf)
        cur = step.filter("kind LIKE 'OBJECT%'").select(*keys, "prefix", "v")
    frame.sparkSession.catalog.dropTempView(view)
    return leaves


def envelope(files: DataFrame) -> DataFrame:
    """(file, name, value): the root object's fields that are no lists."""
    v = files.select("file", F.try_parse_json("content").alias("v")).filter(_is(F.col("v"), "OBJECT"))
    return json_fields(v, "v", ["file"], levels=1).filter("kind NOT LIKE 'ARRAY%'").select("file", "name", "value")


def document_metadata(records: DataFrame, columns: list[str]) -> DataFrame:
    """(file, rows, preview): row counts and the first rows as JSON; records: (file, ordinal, ...)."""
    # only the first rows of a file are gathered: each task's candidates are cut before the shuffle
    row = F.to_json(F.struct(*columns))
    first = records.select("file", "ordinal", row.alias("r")).withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy("ordinal"))).filter(F.col("n") <= PREVIEW_ROWS)
    preview = first.groupBy("file").agg(F.substring(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "r"))), lambda x: x.r), ","), F.lit("]")), 1, PREVIEW_CHARS).alias("preview"))
    return records.groupBy("file").agg(F.count("*").alias("rows")).join(preview, "file")


def field_union(records: DataFrame) -> DataFrame:
    """(file, fields): names of the fields of a file's records (file, row, record variant) in the order in which they are first met; within a record by name, as variants keep them."""
    view = f"records_{uuid.uuid4().hex}"
    records.createOrReplaceTempView(view)
    met = records.sparkSession.sql(f"SELECT file, row, e.key AS name FROM {view}, LATERAL variant_explode(record) AS e")
    records.sparkSession.catalog.dropTempView(view)
    first = met.groupBy("file", "name").agg(F.min("row").alias("row"))
    return first.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "name"))), lambda x: x["name"]).alias("fields"))


def text_metadata(files: DataFrame) -> DataFrame:
    """(file, chars, content, preview) of texts (file, content): length of the whole, and what a register keeps of it."""
    c = F.coalesce("content", F.lit(""))
    return files.select("file", F.length(c).cast("long").alias("chars"), F.substring(c, 1, CONTENT_CHARS).alias("content"), F.substring(c, 1, PREVIEW_CHARS).alias("preview"))


def extracted_counts(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(file, entities, relationships) that were made of each file."""
    e, r = entities.groupBy("file").agg(F.count("*").alias("entities")), edges.groupBy("file").agg(F.count("*").alias("relationships"))
    return e.join(r, "file", "full").fillna(0, ["entities", "relationships"])


def ingest_report(files: DataFrame, good: DataFrame, rejects: DataFrame, extracted: DataFrame | None = None) -> DataFrame:
    """A row a file (file, content): SHA-256, good ones with their counts (of records, and of what ``extracted_counts`` tells), rejected ones with their error."""
    counts = good.groupBy("file").agg(F.count("*").alias("records"))
    out = files.select("file", F.sha2("content", 256).alias("sha256")).join(counts, "file", "left").join(rejects, "file", "left")
    made = [F.lit(0).cast("long").alias(n) for n in ("entities", "relationships")]
    if extracted is not None:
        out, made = out.join(extracted, "file", "left"), [F.coalesce(n, F.lit(0)).alias(n) for n in ("entities", "relationships")]
    return out.select("file", (F.col("error").isNull() & F.col("records").isNotNull()).alias("ok"), F.coalesce("records", F.lit(0)).alias("records"), *made, "sha256", "error")


def write_cases(df: DataFrame, path: str) -> None:
    """Replace the cases that ``df`` holds and leave the others as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("case_id").parquet(path)


def read_case(spark: SparkSession, path: str, case_id: int | None = None) -> DataFrame:
    """The table, or one case of it by partition pruning."""
    df = spark.read.parquet(path)
    return df if case_id is None else df.filter(F.col("case_id") == case_id)



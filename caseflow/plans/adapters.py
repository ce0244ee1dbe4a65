"""The given tables as cases, entities, relationships, logs and questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cases(spark, sf_dir) -> DataFrame:
    n = F.col("n_nationkey")
    status = F.element_at(F.array(*[F.lit(s) for s in ("Pending", "Open", "Solved", "Closed", "Active")]), n % 5 + 1)
    return table(spark, sf_dir, "nation").select(n.cast("long").alias("case_id"), F.format_string("CL-%03d", n).alias("reference_id"), F.col("n_name").alias("title"), status.alias("status"))


def entities(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("CUSTOMER:"), "c_custkey").alias("key"), F.lit("Person").alias("label"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("long").alias("case_id"))
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1_000_000_000).alias("id"), F.concat(F.lit("SUPPLIER:"), "s_suppkey").alias("key"), F.lit("Organization").alias("label"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("long").alias("case_id"))
    return c.unionByName(s)


def _trades(spark, sf_dir) -> DataFrame:
    li, o, c = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    # orders meet their customers first, so the lines travel once
    return li.join(o.join(c, o.o_custkey == c.c_custkey), li.l_orderkey == o.o_orderkey)


def _edges(df: DataFrame, relation) -> DataFrame:
    return df.select(
        F.col("c_nationkey").cast("long").alias("case_id"),
        F.concat(F.lit("CUSTOMER:"), "c_custkey").alias("source"),
        F.concat(F.lit("SUPPLIER:"), "l_suppkey").alias("target"),
        relation.alias("relation"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("timestamp"),
        F.col("l_extendedprice").alias("amount"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyyMMdd")).alias("id"),
    )


def relationships(spark, sf_dir) -> DataFrame:
    flag = F.col("l_returnflag")
    return _edges(_trades(spark, sf_dir), F.when(flag == "R", "RETURNED_TO").when(flag == "A", "ACCEPTED_FROM").otherwise("ORDERED_FROM"))


def documents(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("document_id"), (F.col("doc_id") % 25).alias("case_id"), F.format_string("doc_%d.txt", "doc_id").alias("filename"), F.col("text").alias("content"), "source", "lang", "n_chars")


def questions(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), (F.col("conv_id") % 25).alias("case_id"), F.col("text").alias("question"))


def log_events(spark, sf_dir) -> DataFrame:
    """Events as an audit log: who did what from where."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.format_string("user%d", "user_id").alias("username"), F.format_string("10.0.0.%d", F.col("user_id") % 256).alias("ip"), F.col("event_type").alias("action"), "value", "props")


# The same frames in SQL
CASES_SQL = "cases AS (SELECT n_nationkey::BIGINT AS case_id, printf('CL-%03d', n_nationkey) AS reference_id, n_name AS title, (['Pending','Open','Solved','Closed','Active'])[n_nationkey % 5 + 1] AS status FROM nation)"
ENTITIES_SQL = """entities AS (SELECT c_custkey AS id, 'CUSTOMER:' || c_custkey AS key, 'Person' AS label, c_name AS name, c_nationkey::BIGINT AS case_id FROM customer
UNION ALL SELECT s_suppkey + 1000000000, 'SUPPLIER:' || s_suppkey, 'Organization', s_name, s_nationkey::BIGINT FROM supplier)"""


def _edges_sql(name: str, relation: str) -> str:
    return f"""{name} AS (SELECT c_nationkey::BIGINT AS case_id, 'CUSTOMER:' || c_custkey AS source, 'SUPPLIER:' || l_suppkey AS target, {relation} AS relation,
strftime(l_shipdate, '%Y-%m-%d') AS timestamp, l_extendedprice AS amount, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d')) AS id
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""


RELATIONSHIPS_SQL = _edges_sql("rel", "CASE l_returnflag WHEN 'R' THEN 'RETURNED_TO' WHEN 'A' THEN 'ACCEPTED_FROM' ELSE 'ORDERED_FROM' END")
DOCUMENTS_SQL = "docs AS (SELECT doc_id AS document_id, doc_id % 25 AS case_id, printf('doc_%d.txt', doc_id) AS filename, text AS content, source, lang, n_chars FROM documents)"
QUESTIONS_SQL = "questions AS (SELECT conv_id * 1000 + turn AS question_id, conv_id % 25 AS case_id, text AS question FROM conversations WHERE role = 'user')"
LOG_SQL = "log AS (SELECT event_id AS id, ts, printf('user%d', user_id) AS username, printf('10.0.0.%d', user_id % 256) AS ip, event_type AS action, value, props FROM events)"
_WS = "chr(32) || chr(9) || chr(10) || chr(13)"
CHUNKS_SQL = f"""chunks AS (SELECT document_id * 1000000000 + row_number() OVER (PARTITION BY document_id ORDER BY i) - 1 AS chunk_id, document_id, case_id, (row_number() OVER (PARTITION BY document_id ORDER BY i) - 1)::INTEGER AS chunk_index, trim(substr(t, i, 500), {_WS}) AS chunk FROM
(SELECT *, unnest(range(1, greatest(length(t), 1) + 1, 400)) AS i FROM (SELECT document_id, case_id, trim(content, {_WS}) AS t FROM docs)) WHERE trim(substr(t, i, 500), {_WS}) <> '')"""

"""Registered queries: normalisers, record extraction and text extraction."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from caseflow.functions import roles
from caseflow.functions import text as t
from caseflow.operators import extract as x
from caseflow.operators import portfolio
from caseflow.plans import adapters as a
from caseflow.sources import files

_DIGITS = "regexp_replace(raw, '[^0-9]', '', 'g')"


def _raw_phones(spark, sf):
    k = F.col("c_custkey")
    number = (F.lit(6000000000) + k * 7919)
    raw = F.when(k % 4 == 0, F.concat(F.lit("+91-"), number)).when(k % 4 == 1, F.concat(F.lit(" ("), number, F.lit(") "))).when(k % 4 == 2, number.cast("string"))
    return a.table(spark, sf, "customer").select("c_custkey", raw.alias("raw"))


_RAW_PHONES = "p AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '+91-' || (6000000000 + c_custkey * 7919) WHEN 1 THEN ' (' || (6000000000 + c_custkey * 7919) || ') ' WHEN 2 THEN (6000000000 + c_custkey * 7919)::VARCHAR END AS raw FROM customer)"


def normalize_phone(spark, sf):
    return _raw_phones(spark, sf).select("c_custkey", t.phone(F.col("raw")).alias("phone"))


def normalize_name(spark, sf):
    raw = F.concat(F.lit("  "), F.regexp_replace("c_name", "#", " . "), F.lit("-É "), "c_mktsegment")
    return a.table(spark, sf, "customer").select("c_custkey", t.name(raw).alias("name"))


def normalize_account(spark, sf):
    return a.table(spark, sf, "supplier").select("s_suppkey", t.account(F.concat(F.lit("acc-"), "s_name")).alias("account"), t.vehicle(F.concat(F.lit("ka 01 "), "s_suppkey")).alias("vehicle"))


def normalize_relation(spark, sf):
    o = a.table(spark, sf, "orders")
    raw = F.when(F.col("o_orderkey") % 5 == 0, " has phone ").when(F.col("o_orderkey") % 5 == 1, "Owns-Vehicle").when(F.col("o_orderkey") % 5 == 2, "null").otherwise(F.col("o_orderpriority"))
    return o.select("o_orderkey", t.relation(raw).alias("relation"), t.canonical_relation(raw).alias("counted"), t.relation_type(raw).alias("type"))


def identity_norm(spark, sf):
    label = F.element_at(F.array(*[F.lit(v) for v in ("PhoneNumber", "BankAccount", "Vehicle", "Email", "Person", "Location")]), (F.col("c_custkey") % 6 + 1).cast("int"))
    return a.table(spark, sf, "customer").select("c_custkey", t.identity(label, F.concat(F.lit(" X-"), "c_name", F.lit(" "))).alias("identity"))


def email_norm(spark, sf):
    return a.table(spark, sf, "customer").select("c_custkey", t.email(F.concat(F.lit(" "), "c_name", F.lit("@Example.COM "))).alias("email"))


def clean_nulls(spark, sf):
    v = F.when(F.col("p_size") % 5 == 0, " NaN ").when(F.col("p_size") % 5 == 1, F.lit(None)).when(F.col("p_size") % 5 == 2, "None").otherwise(F.concat(F.lit(" "), "p_name"))
    return a.table(spark, sf, "part").select("p_partkey", t.clean(v).alias("value"))


def doc_type_norm(spark, sf):
    v = F.when(F.col("p_size") % 4 == 0, " call-detail record").when(F.col("p_size") % 4 == 1, "bank transactions").when(F.col("p_size") % 4 == 2, F.lit(None)).otherwise(F.col("p_type"))
    return a.table(spark, sf, "part").select("p_partkey", t.doc_type(v).alias("doc_type"))


def text_norm(spark, sf):
    return a.table(spark, sf, "conversations").select("conv_id", "turn", "role", t.squeeze(F.col("text")).alias("text"))


def amount_parse(spark, sf):
    raw = F.when(F.col("o_orderkey") % 7 == 0, "n/a").when(F.col("o_orderkey") % 7 == 1, "1.2.3").otherwise(F.concat(F.lit("INR "), F.format_number("o_totalprice", 2)))
    return a.table(spark, sf, "orders").select("o_orderkey", t.amount(raw).alias("amount"), t.magnitude(raw).alias("magnitude"))


def clamp_unit(spark, sf):
    x_ = F.when(F.col("event_id") % 9 == 0, F.lit(float("nan"))).otherwise(F.col("value") / 50 - 0.2)
    return a.table(spark, sf, "events").select("event_id", t.unit(x_).alias("unit"))


def canonical_entities(spark, sf):
    c = a.table(spark, sf, "customer")
    return c.select("c_custkey", t.canonical_key(F.lit("Person"), F.col("c_name")).alias("person"), t.canonical_key(F.lit("segment"), F.nullif("c_mktsegment", F.lit("BUILDING"))).alias("segment"))


def member_predicates(spark, sf):
    rels = a.relationships(spark, sf).withColumn("relation", F.when(F.col("amount") > 50000, "part_of_case").otherwise(F.col("relation"))).withColumn("target", F.when(F.col("amount") > 60000, F.concat(F.lit("case:"), "target")).otherwise(F.col("target")))
    return rels.groupBy("case_id").agg(F.count_if(t.is_case_node(F.col("target"))).alias("case_ends"), F.count_if(t.is_investigative(F.col("relation"))).alias("investigative"))


def row_projections(spark, sf):
    e = a.entities(spark, sf)
    return e.select("key", F.coalesce(F.when(F.col("id") % 4 != 0, F.col("name")), F.col("key")).alias("display"), t.case_title(F.concat(F.lit("CASE:CL_"), "id")).alias("title"))


def display_label(spark, sf):
    r = a.relationships(spark, sf)
    return r.select("id", t.edge_label(F.concat(F.lit("SENT_TO_"), "relation"), F.lit(None).cast("double"), F.concat("timestamp", F.lit("T10:00:00"))).alias("label"), t.direction(F.col("source"), F.lit("CUSTOMER:1")).alias("direction"))


def canonical_json(spark, sf):
    return a.table(spark, sf, "nation").select("n_nationkey", t.canonical_json(["n_name", "n_nationkey", "n_regionkey"]).alias("json"))


def reference_backfill(spark, sf):
    """Blank references become CL-LEGACY-nnn, with X's until unique."""
    c = a.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, F.lit(" ")).when(F.col("c_custkey") % 3 == 1, F.format_string("CL-LEGACY-%03d", F.col("c_custkey") - 1)).otherwise(F.format_string("CL-%03d", "c_custkey")).alias("reference"))
    return portfolio.backfill_references(c.select(F.col("id").alias("case_id"), F.col("reference").alias("reference_id"))).select(F.col("case_id").alias("id"), F.col("reference_id").alias("reference"))


def table_filter(spark, sf):
    e = a.entities(spark, sf)
    return e.filter(t.contains_any([F.col("name"), F.col("key"), F.col("label")], F.lit("ER#00000001"))).filter("label = 'Person'").select("key")


def storage_label(spark, sf):
    p = F.element_at(F.array(*[F.lit(v) for v in ("a/b/", "./a//b/", "../", "a/../b/", "/abs/", "a/../../b/", " ")]), (F.col("p_partkey") % 7 + 1).cast("int"))
    path = F.when(F.col("p_partkey") % 7 == 6, " ").otherwise(F.concat(p, F.lit("f"), F.col("p_partkey").cast("string")))
    return a.table(spark, sf, "part").select("p_partkey", t.storage_label(path).alias("stored"))


def validate_cases(spark, sf):
    c = a.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 10 == 0, F.lit(" ")).otherwise(F.col("c_name")).alias("title"), F.concat(F.lit("R-"), (F.col("c_custkey") % 100).cast("string")).alias("reference_id"), F.when(F.col("c_acctbal") < 0, "Severe").otherwise("High").alias("risk"))
    existing = a.table(spark, sf, "nation").select(F.concat(F.lit("R-"), F.col("n_nationkey").cast("string")).alias("reference_id"))
    return portfolio.validate_cases(c, existing).select("id", "risk", F.array_join("violations", ",").alias("violations"))


def snippets(spark, sf):
    d = a.documents(spark, sf)
    return d.select("document_id", t.snippet(F.col("content"), F.lit("of the that with from")).alias("snippet"))


def header_roles(spark, sf):
    """Roles that the columns of written call and transfer files get, by the headers that a scan of them finds; one row a role and column, with how many values it has."""
    out = None
    for kind, df, find in (("CDR", _calls(spark, sf), roles.call_roles), ("FINANCIAL", _transfers(spark, sf), roles.transfer_roles)):
        path = files.work_dir(spark, "headers")
        df.drop("file", "ordinal").write.csv(path, header=True)
        read = files.read_csv(spark, path)
        columns = [c for c in read.columns if c != "file"]
        if roles.record_kind(columns) != kind:
            raise ValueError(f"headers of {kind} records are not seen as such")
        pairs = [F.struct(F.lit(r).alias("role"), F.lit(c).alias("column"), F.col(c).alias("v")) for r, c in find(columns).found.items() if c]
        part = read.select(F.explode(F.array(*pairs)).alias("x")).groupBy(F.lit(kind).alias("kind"), "x.role", "x.column").agg(F.count_if(F.col("x.v") != "").alias("rows"))
        out = part if out is None else out.unionByName(part)
    return out


def _calls(spark, sf):
    o = a.table(spark, sf, "orders")
    num = lambda c: F.when(c % 11 == 0, F.lit("nan")).otherwise((F.lit(9000000000) + c).cast("string"))
    return o.select((F.col("o_orderkey") % 8).alias("file"), F.col("o_orderkey").alias("ordinal"), num(F.col("o_custkey")).alias("Caller"), num((F.col("o_orderkey") * 31) % 1000).alias("Receiver"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("Date"), F.lit("20:40:00").alias("Time"))


def cdr_extract(spark, sf):
    df = _calls(spark, sf)
    ents, edges = x.calls(df, roles.call_roles(df.columns[2:]), date="Date")
    n = ents.groupBy("file").agg(F.count("*").alias("entities"), F.min("key").alias("first_key"))
    e = edges.groupBy("file").agg(F.count("*").alias("edges"), F.min("timestamp").alias("first_time"), F.count_distinct("source").alias("sources"))
    return n.join(e, "file")


def _transfers(spark, sf):
    li = a.table(spark, sf, "lineitem")
    return li.select((F.col("l_orderkey") % 6).alias("file"), F.col("l_orderkey").alias("ordinal"), F.concat(F.lit("ACC"), F.col("l_suppkey").cast("string")).alias("Sender_Account"), F.concat(F.lit(" ACC"), F.col("l_partkey").cast("string")).alias("Receiver_Account"), F.concat(F.lit("INR "), F.col("l_quantity").cast("string")).alias("Amount_INR"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("Date"))


def transfer_extract(spark, sf):
    df = _transfers(spark, sf)
    ents, edges = x.transfers(df, roles.transfer_roles(df.columns[2:]))
    n = ents.groupBy("file").agg(F.count("*").alias("entities"))
    return edges.groupBy("file", "source").agg(F.count("*").alias("edges"), F.sum(F.col("amount").cast("decimal(28,2)")).cast("double").alias("total"), F.max("timestamp").alias("last")).join(n, "file")


def _master(spark, sf):
    c = a.table(spark, sf, "customer")
    k = F.col("c_custkey")
    df = c.select((k % 4).alias("file"), k.alias("ordinal"), F.concat(F.lit("P"), k.cast("string")).alias("entity_id"), F.when(k % 3 == 0, "").when(k % 3 == 1, "person").otherwise("Bank Account").alias("entity_type"), F.col("c_name").alias("name"), F.when(k % 2 == 0, (F.lit(9000000000) + k % 40).cast("string")).otherwise("").alias("phone"), F.when(k % 5 == 0, F.concat(F.lit("City "), (k % 7).cast("string"))).otherwise("none").alias("address"), F.when(k % 4 == 0, "knows").otherwise("").alias("relationship"), F.concat(F.lit("P"), (k - 4).cast("string")).alias("related_entity_id"))
    r = roles.Roles({"id": "entity_id", "type": "entity_type", "name": "name", "phone": "phone", "location": "address", "relation": "relationship", "related": "related_entity_id"})
    return x.master_rows(df, r)


def master_entities(spark, sf):
    return x.master_entities(_master(spark, sf)).groupBy("file", "label").agg(F.count("*").alias("entities"), F.min("key").alias("first_key"))


def master_lookup(spark, sf):
    return x.master_lookup(x.master_entities(_master(spark, sf)))


def master_relations(spark, sf):
    rows = _master(spark, sf)
    return x.master_relations(rows, x.master_lookup(x.master_entities(rows))).groupBy("file", "relation").agg(F.count("*").alias("edges"), F.min("source").alias("first_source"))


def master_links(spark, sf):
    rows = _master(spark, sf)
    stated = x.master_relations(rows, x.master_lookup(x.master_entities(rows)))
    return x.master_links(rows, stated).groupBy("file", "relation").agg(F.count("*").alias("edges"), F.min("source").alias("first_source"))


def _files(spark, sf):
    return a.documents(spark, sf).withColumnRenamed("document_id", "file")


def phone_mentions(spark, sf):
    """Phones in the documents, a third of which end in one."""
    d, k = a.table(spark, sf, "documents"), F.col("doc_id")
    text = F.when(k % 3 == 0, F.concat("text", F.when(k % 2 == 0, F.lit(" tel. +91-")).otherwise(F.lit(" no ")), (F.lit(7000000000) + k).cast("string"), F.lit("."))).otherwise(F.col("text"))
    return d.select("doc_id", F.explode(x.phones(text)).alias("phone")).distinct()


def pattern_mentions(spark, sf):
    """Mentions in texts made of part and supplier rows."""
    li = a.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.min("l_partkey").alias("p"), F.max("l_suppkey").alias("s"))
    reg = F.format_string("ka%02dab%04d", F.col("n"), F.col("p") % 10000)
    content = F.concat(F.lit("Seen "), reg, F.lit(" near acc-"), F.format_string("%05d", "s"), F.lit(", tel +91 "), (F.lit(9000000000) + F.col("p")).cast("string"), F.lit("; x"), F.lit("12345678901234567"))
    return x.pattern_mentions(li.select(F.col("l_orderkey").alias("file"), content.alias("content"))).select("file", "label", "key")


def dictionary_mentions(spark, sf):
    b = a.table(spark, sf, "benchmark").select(F.lit(0).alias("case_id"), F.concat(F.lit("ITEM:"), F.col("item_id").cast("string")).alias("key"), F.col("text").alias("name"))
    return x.dictionary_mentions(_files(spark, sf).withColumn("case_id", F.lit(0)), b)


def sentence_split(spark, sf):
    return x.sentences(_files(spark, sf)).groupBy("file").agg(F.count("*").alias("sentences"), F.max(F.length("sentence")).alias("longest"))


def _reports(spark, sf):
    """Sentences made of part rows: one document a size and brand."""
    p = a.table(spark, sf, "part")
    k = F.col("p_partkey")
    s = F.when(k % 4 == 0, F.format_string("Patrol logged KA%02dAB%04d on the road.", k % 100, k % 10000)).when(k % 4 == 1, F.concat(F.lit("It was seen near "), "p_brand", F.lit("."))).when(k % 4 == 2, F.concat(F.lit("Anna P. called Boris P. about "), "p_brand", F.lit(" on 9"), F.format_string("%09d", k), F.lit("."))).otherwise(F.concat(F.lit("An incident was reported at "), "p_brand", F.lit(".")))
    w = F.row_number().over(Window.partitionBy("p_size").orderBy("p_partkey"))
    return p.select(F.col("p_size").alias("file"), F.lit(0).cast("long").alias("case_id"), (w - 1).alias("pos"), s.alias("sentence"))


def _names(spark, sf):
    brands = a.table(spark, sf, "part").select("p_brand").distinct()
    b = brands.select(F.lit(0).cast("long").alias("case_id"), (F.xxhash64("p_brand") % 1000 + 100000).alias("id"), F.concat(F.lit("LOCATION:"), "p_brand").alias("key"), F.lit("Location").alias("label"), F.col("p_brand").alias("name"))
    fixed = spark.createDataFrame([(0, 1, "PERSON:boris", "Person", "Boris P"), (0, 2, "PERSON:anna", "Person", "Anna P"), (0, 3, "INCIDENT:i1", "Incident", "Case of the parts")], "case_id long, id long, key string, label string, name string")
    return b.unionByName(fixed)


def carry_forward(spark, sf):
    return x.carried_vehicles(_reports(spark, sf)).groupBy("file", "vehicle").agg(F.count("*").alias("sentences"), F.min("pos").alias("first"))


def cue_pairs(spark, sf):
    s, n = _reports(spark, sf), _names(spark, sf)
    return x.text_edges(s, x.sentence_mentions(s, n), n)


QUERIES = {f.__name__: f for f in (normalize_phone, normalize_name, normalize_account, normalize_relation, identity_norm, email_norm, clean_nulls, doc_type_norm, text_norm, amount_parse, clamp_unit, canonical_entities, member_predicates, row_projections, display_label, canonical_json, reference_backfill, table_filter, storage_label, validate_cases, snippets, header_roles, cdr_extract, transfer_extract, master_entities, master_lookup, master_relations, master_links, phone_mentions, pattern_mentions, dictionary_mentions, sentence_split, carry_forward, cue_pairs)}

_SQUEEZE = r"regexp_replace(regexp_replace({0}, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
_CALLS = """calls AS (SELECT o_orderkey % 8 AS file, o_orderkey AS ordinal, CASE WHEN o_custkey % 11 = 0 THEN '' ELSE (9000000000 + o_custkey)::VARCHAR END AS a,
CASE WHEN ((o_orderkey * 31) % 1000) % 11 = 0 THEN '' ELSE (9000000000 + (o_orderkey * 31) % 1000)::VARCHAR END AS b, strftime(o_orderdate, '%Y-%m-%d') || ' 20:40:00' AS timestamp FROM orders),
good AS (SELECT * FROM calls WHERE a <> '' AND b <> '')"""
_MASTER = """m AS (SELECT c_custkey % 4 AS file, c_custkey AS ordinal, 'P' || c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'person' ELSE 'Bank Account' END AS type, c_name AS name,
CASE WHEN c_custkey % 2 = 0 THEN (9000000000 + c_custkey % 40)::VARCHAR END AS phone, CASE WHEN c_custkey % 5 = 0 THEN 'City ' || (c_custkey % 7) END AS location, CASE WHEN c_custkey % 4 = 0 THEN 'KNOWS' END AS relation, 'P' || (c_custkey - 4) AS related FROM customer),
own AS (SELECT *, CASE c_custkey_kind WHEN 0 THEN 'PERSON:' || name WHEN 1 THEN 'PERSON:' || id ELSE 'ACCOUNT:' || id END AS key FROM (SELECT *, ordinal % 3 AS c_custkey_kind FROM m)),
e AS (SELECT DISTINCT file, label, key, name FROM (SELECT file, CASE c_custkey_kind WHEN 2 THEN 'BankAccount' ELSE 'Person' END AS label, key, name FROM own UNION ALL SELECT file, 'PhoneNumber', 'PHONE:' || phone, phone FROM m WHERE phone IS NOT NULL UNION ALL SELECT file, 'Location', 'LOCATION:' || location, location FROM m WHERE location IS NOT NULL)),
firsts AS (SELECT file, key, min(o) AS o FROM (SELECT file, key, ordinal * 5 AS o FROM own UNION ALL SELECT file, 'PHONE:' || phone, ordinal * 5 + 1 FROM m WHERE phone IS NOT NULL UNION ALL SELECT file, 'LOCATION:' || location, ordinal * 5 + 4 FROM m WHERE location IS NOT NULL) GROUP BY ALL),
look AS (SELECT file, value, arg_max(key, o) AS key FROM (SELECT file, lower(name) AS value, key, o FROM e JOIN firsts USING (file, key) UNION ALL SELECT file, lower(regexp_replace(key, '^[^:]*:', '')), key, o FROM firsts) GROUP BY ALL),
stated AS (SELECT DISTINCT m.file, s.key AS source, d.key AS target, relation FROM m JOIN look s ON m.file = s.file AND s.value = lower(m.id) JOIN look d ON m.file = d.file AND d.value = lower(m.related) WHERE relation IS NOT NULL AND s.key <> d.key)"""
_REPORTS = """s AS (SELECT p_size AS file, (row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1)::INTEGER AS pos, p_partkey AS k, p_brand AS brand FROM part)"""

ORACLE_SQL = {
    "normalize_phone": f"WITH {_RAW_PHONES}, d AS (SELECT c_custkey, coalesce({_DIGITS}, '') AS d FROM p) SELECT c_custkey, CASE WHEN length(d) = 12 AND d LIKE '91%' THEN substr(d, 3) ELSE d END AS phone FROM d",
    "normalize_name": r"SELECT c_custkey, trim(regexp_replace(replace(lower(c_name), '#', ' ') || ' é ' || lower(c_mktsegment), '\s+', ' ', 'g')) AS name FROM customer",
    "normalize_account": "SELECT s_suppkey, regexp_replace(upper('acc-' || s_name), '[^A-Z0-9]', '', 'g') AS account, 'KA01' || s_suppkey AS vehicle FROM supplier",
    "normalize_relation": """WITH r AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN ' has phone ' WHEN 1 THEN 'Owns-Vehicle' WHEN 2 THEN 'null' ELSE o_orderpriority END AS raw FROM orders)
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'USES_PHONE' WHEN 1 THEN 'USES_VEHICLE' WHEN 2 THEN '' ELSE trim(regexp_replace(upper(raw), '[^A-Z0-9]+', '_', 'g'), '_') END AS relation,
replace(upper(trim(raw)), ' ', '_') AS counted, regexp_replace(upper(raw), '[^A-Z0-9_]', '_', 'g') AS type FROM r""",
    "identity_norm": "WITH v AS (SELECT c_custkey, ' X-' || c_name || ' ' AS v FROM customer) SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN regexp_replace(v, '[^0-9]', '', 'g') WHEN 1 THEN regexp_replace(upper(v), '[^A-Z0-9]', '', 'g') WHEN 2 THEN regexp_replace(upper(v), '[^A-Z0-9]', '', 'g') WHEN 3 THEN lower(trim(v)) WHEN 4 THEN trim(regexp_replace(regexp_replace(lower(v), '[^a-z0-9_]', ' ', 'g'), ' +', ' ', 'g')) ELSE lower(trim(v)) END AS identity FROM v",
    "email_norm": "SELECT c_custkey, lower(c_name) || '@example.com' AS email FROM customer",
    "clean_nulls": "SELECT p_partkey, CASE WHEN p_size % 5 < 3 THEN '' ELSE trim(p_name) END AS value FROM part",
    "doc_type_norm": "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'CDR' WHEN 1 THEN 'FINANCIAL' WHEN 2 THEN 'OTHER' ELSE replace(replace(upper(trim(p_type)), '-', '_'), ' ', '_') END AS doc_type FROM part",
    "text_norm": f"SELECT conv_id, turn, role, {_SQUEEZE.format('text')} AS text FROM conversations",
    "amount_parse": "WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 < 2 THEN NULL ELSE round(o_totalprice, 2) END AS v FROM orders) SELECT o_orderkey, v AS amount, CASE o_orderkey % 7 WHEN 0 THEN 0.0 ELSE 0.0 END::DOUBLE AS magnitude FROM r",
    "clamp_unit": "SELECT event_id, CASE WHEN event_id % 9 = 0 OR value IS NULL THEN 0.0 ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, value / 50 - 0.2::DOUBLE)) END::DOUBLE AS unit FROM events",
    "canonical_entities": "SELECT c_custkey, 'PERSON:' || c_name AS person, CASE WHEN c_mktsegment <> 'BUILDING' THEN 'SEGMENT:' || c_mktsegment END AS segment FROM customer",
    "member_predicates": f"WITH {a.RELATIONSHIPS_SQL} SELECT case_id, count(*) FILTER (amount > 60000) AS case_ends, count(*) FILTER (amount <= 50000) AS investigative FROM rel GROUP BY case_id",
    "row_projections": f"WITH {a.ENTITIES_SQL} SELECT key, CASE WHEN id % 4 <> 0 THEN name ELSE key END AS display, 'CL ' || id AS title FROM entities",
    "display_label": f"WITH {a.RELATIONSHIPS_SQL} SELECT id, 'SENT TO ' || replace(relation, '_', ' ') || ' | ' || timestamp AS label, CASE WHEN source = 'CUSTOMER:1' THEN 'OUTGOING' ELSE 'INCOMING' END AS direction FROM rel",
    "canonical_json": """SELECT n_nationkey, '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' AS json FROM nation""",
    "reference_backfill": "WITH r AS (SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN printf('CL-LEGACY-%03d', c_custkey - 1) ELSE printf('CL-%03d', c_custkey) END AS reference FROM customer) SELECT id, coalesce(reference, CASE WHEN printf('CL-LEGACY-%03d', id) IN (SELECT reference FROM r WHERE reference IS NOT NULL) THEN printf('CL-LEGACY-%03dX', id) ELSE printf('CL-LEGACY-%03d', id) END) AS reference FROM r",
    "table_filter": f"WITH {a.ENTITIES_SQL} SELECT key FROM entities WHERE label = 'Person' AND (lower(name) LIKE '%er#00000001%' OR lower(key) LIKE '%er#00000001%')",
    "storage_label": "SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'a/b/f' || p_partkey WHEN 1 THEN 'a/b/f' || p_partkey WHEN 3 THEN 'b/f' || p_partkey END AS stored FROM part",
    "validate_cases": """WITH c AS (SELECT c_custkey AS id, c_custkey % 10 = 0 AS untitled, 'R-' || (c_custkey % 100) AS r, c_acctbal < 0 AS odd FROM customer)
SELECT id, CASE WHEN odd THEN 'Medium' ELSE 'High' END AS risk, array_to_string(list_filter([CASE WHEN untitled THEN 'title' END, CASE WHEN id % 100 < 25 THEN 'duplicate' WHEN row_number() OVER (PARTITION BY r ORDER BY id) > 1 THEN 'repeated' END], lambda x: x IS NOT NULL), ',') AS violations FROM c""",
    "snippets": f"""WITH {a.DOCUMENTS_SQL}, t AS (SELECT document_id, {_SQUEEZE.format("coalesce(content, '')")} AS t FROM docs), p AS (SELECT document_id, t, CASE WHEN instr(lower(t), 'that') > 0 THEN instr(lower(t), 'that') WHEN instr(lower(t), 'with') > 0 THEN instr(lower(t), 'with') WHEN instr(lower(t), 'from') > 0 THEN instr(lower(t), 'from') END AS pl FROM t)
SELECT document_id, CASE WHEN pl IS NULL THEN substr(t, 1, 800) ELSE substr(t, greatest(pl - 300, 1), least(pl - 1, 300) + 700) END AS snippet FROM p""",
    "header_roles": "SELECT kind, role, col AS \"column\", rows FROM (SELECT 'CDR' AS kind, unnest(['source', 'target', 'time']) AS role, unnest(['Caller', 'Receiver', 'Time']) AS col, unnest([count(*) FILTER (o_custkey % 11 <> 0), count(*) FILTER (((o_orderkey * 31) % 1000) % 11 <> 0), count(*)]) AS rows FROM orders UNION ALL SELECT 'FINANCIAL', unnest(['source', 'target', 'amount', 'time']), unnest(['Sender_Account', 'Receiver_Account', 'Amount_INR', 'Date']), count(*) FROM lineitem)",
    "cdr_extract": f"WITH {_CALLS}, n AS (SELECT file, count(DISTINCT v) AS entities, min('PHONE:' || v) AS first_key FROM (SELECT file, unnest([a, b]) AS v FROM good) GROUP BY file), e AS (SELECT file, count(*) AS edges, min(timestamp) AS first_time, count(DISTINCT a) AS sources FROM good GROUP BY file) SELECT * FROM n JOIN e USING (file)",
    "transfer_extract": "WITH r AS (SELECT l_orderkey % 6 AS file, 'ACCOUNT:ACC' || l_suppkey AS source, 'ACCOUNT:ACC' || l_partkey AS target, l_quantity AS amount, strftime(l_shipdate, '%Y-%m-%d') AS t FROM lineitem), n AS (SELECT file, count(DISTINCT v) AS entities FROM (SELECT file, unnest([source, target]) AS v FROM r) GROUP BY file) SELECT file, source, count(*) AS edges, sum(amount::DECIMAL(28,2))::DOUBLE AS total, max(t) AS last, any_value(entities) AS entities FROM r JOIN n USING (file) GROUP BY file, source",
    "master_entities": f"WITH {_MASTER} SELECT file, label, count(DISTINCT key) AS entities, min(key) AS first_key FROM e GROUP BY ALL",
    "master_lookup": f"WITH {_MASTER} SELECT * FROM look",
    "master_relations": f"WITH {_MASTER} SELECT file, relation, count(*) AS edges, min(source) AS first_source FROM stated GROUP BY ALL",
    "master_links": f"WITH {_MASTER}, l AS (SELECT file, key AS source, 'PHONE:' || phone AS target, 'USES_PHONE' AS relation FROM own WHERE c_custkey_kind < 2 AND phone IS NOT NULL UNION SELECT file, key, 'LOCATION:' || location, 'LOCATED_AT' FROM own WHERE c_custkey_kind < 2 AND location IS NOT NULL) SELECT file, relation, count(*) AS edges, min(source) AS first_source FROM l WHERE (file, source, target) NOT IN (SELECT (file, source, target) FROM stated) GROUP BY ALL",
    "phone_mentions": r"SELECT DISTINCT doc_id, right(p, 10) AS phone FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\+?\d+')) AS p FROM documents) WHERE regexp_full_match(p, '\+?[6-9]\d{9}') OR regexp_full_match(p, '\+91[6-9]\d{9}') UNION SELECT doc_id, (7000000000 + doc_id)::VARCHAR FROM documents WHERE doc_id % 3 = 0",
    "pattern_mentions": "WITH g AS (SELECT l_orderkey AS file, count(*) AS n, min(l_partkey) AS p, max(l_suppkey) AS s FROM lineitem GROUP BY ALL) SELECT file, 'Vehicle' AS label, printf('VEHICLE:KA%02dAB%04d', n, p % 10000) AS key FROM g UNION ALL SELECT file, 'BankAccount', printf('ACCOUNT:ACC%05d', s) FROM g UNION ALL SELECT file, 'PhoneNumber', 'PHONE:' || (9000000000 + p) FROM g",
    "dictionary_mentions": "SELECT DISTINCT doc_id AS file, 'ITEM:' || item_id AS key FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text)) WHERE length(b.text) > 0",
    "sentence_split": r"SELECT doc_id AS file, count(*) AS sentences, max(length(s))::INTEGER AS longest FROM (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS s FROM documents) GROUP BY doc_id",
    "carry_forward": f"WITH {_REPORTS}, v AS (SELECT file, pos, last_value(CASE WHEN k % 4 = 0 THEN printf('VEHICLE:KA%02dAB%04d', k % 100, k % 10000) END IGNORE NULLS) OVER (PARTITION BY file ORDER BY pos) AS vehicle FROM s) SELECT file, vehicle, count(*) AS sentences, min(pos) AS first FROM v WHERE vehicle IS NOT NULL GROUP BY ALL",
    "cue_pairs": f"""WITH {_REPORTS}, l AS (SELECT DISTINCT p_brand AS b FROM part), pl AS (SELECT file, pos, k, 'LOCATION:' || b AS loc FROM s JOIN l ON contains(lower(brand), lower(b)) WHERE k % 4 <> 0),
v AS (SELECT file, pos, last_value(CASE WHEN k % 4 = 0 THEN printf('VEHICLE:KA%02dAB%04d', k % 100, k % 10000) END IGNORE NULLS) OVER (PARTITION BY file ORDER BY pos) AS vehicle FROM s)
SELECT DISTINCT file, 'PERSON:anna' AS source, 'PERSON:boris' AS target, 'CONTACTED' AS relation FROM s WHERE k % 4 = 2
UNION SELECT file, unnest(['PERSON:anna', 'PERSON:boris']), printf('PHONE:9%09d', k), 'USES_PHONE' FROM s WHERE k % 4 = 2
UNION SELECT file, vehicle, loc, 'SIGHTED_AT' FROM pl JOIN v USING (file, pos) WHERE k % 4 IN (1, 3) AND vehicle IS NOT NULL
UNION SELECT file, 'INCIDENT:i1', loc, 'OCCURRED_AT' FROM pl WHERE k % 4 = 3""",
}

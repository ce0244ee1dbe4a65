"""Registered queries: resolution, ledgers, evidence files and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from caseflow.functions import text as t
from caseflow.functions import roles
from caseflow.operators import cascade, extract, ledger, portfolio, registers, resolve, retrieval
from caseflow.operators.work import cut
from caseflow.plans import adapters as a
from caseflow.plans.adapters import CHUNKS_SQL, DOCUMENTS_SQL, LOG_SQL, RELATIONSHIPS_SQL
from caseflow.sources import files
from caseflow.streaming import arrivals, streams


def _people(spark, sf):
    """Customers as persons with identifiers, most of them shared by several."""
    k = F.col("c_custkey")
    one = lambda cond, v: F.when(cond, v).otherwise(F.lit(""))
    return a.table(spark, sf, "customer").select(
        (k % 4).alias("case_id"), k.alias("id"), F.concat(F.lit("PERSON:"), k.cast("string")).alias("key"), F.when(k % 10 == 9, "Location").otherwise("Person").alias("label"),
        F.concat(F.lit("Name "), (k % 37).cast("string")).alias("name"), one(k % 3 == 0, F.concat(F.lit("+91 "), (F.lit(9000000000) + F.when(k % 11 == 0, 1_000_000 + k).otherwise(k % 29)).cast("string"))).alias("phone"), one(k % 5 < 2, F.concat(F.lit("M"), F.when(k % 11 == 5, 1000 + k).otherwise(k % 41).cast("string"), F.lit("@X.org "))).alias("email"),
        F.lit("").alias("account"), F.lit(None).cast("string").alias("vehicle"), one(k % 7 == 0, F.concat(F.lit("id-"), (k % F.when(k % 2 == 0, 37).otherwise(53)).cast("string"))).alias("identifier"))


def _split(spark, sf):
    """(existing, incoming): of each case every other person."""
    p, side = _people(spark, sf), F.floor(F.col("id") / 4) % 2
    return p.filter(side == 0), p.filter(side == 1)


def _contacts(spark, sf):
    """Edges that link persons to phones, accounts and vehicles; some persons have two phones."""
    k = F.col("c_custkey")
    person = F.concat(F.lit("PERSON:"), k.cast("string"))
    phone = lambda n: F.concat(F.lit("PHONE:"), (F.lit(9000000000) + (k + n) % 29).cast("string"))
    edge = lambda cond, n, a, b: F.when(cond, F.struct(F.format_string("%08d-%d", k, F.lit(n)).alias("id"), a.alias("source"), b.alias("target")))
    made = F.array(edge(k % 6 == 1, 1, person, phone(0)), edge(k % 12 == 1, 2, phone(1), person), edge(k % 6 == 2, 3, person, F.concat(F.lit("ACCOUNT:acc-"), (k % 31).cast("string"))), edge(k % 6 == 3, 4, F.format_string("VEHICLE:KA01AB%04d", k % 43), person))
    return a.table(spark, sf, "customer").select((k % 4).alias("case_id"), F.explode(F.array_compact(made)).alias("e")).select("case_id", "e.id", "e.source", "e.target")


_PEOPLE = """p AS (SELECT c_custkey % 4 AS case_id, c_custkey AS id, (c_custkey // 4) % 2 = 1 AS inc, CASE WHEN c_custkey % 10 = 9 THEN 'location' ELSE 'person' END AS label, 'name ' || (c_custkey % 37) AS n,
CASE WHEN c_custkey % 3 = 0 THEN (9000000000 + CASE WHEN c_custkey % 11 = 0 THEN 1000000 + c_custkey ELSE c_custkey % 29 END)::VARCHAR END AS phone, CASE WHEN c_custkey % 5 < 2 THEN 'm' || CASE WHEN c_custkey % 11 = 5 THEN 1000 + c_custkey ELSE c_custkey % 41 END || '@x.org' END AS email, CASE WHEN c_custkey % 7 = 0 THEN 'ID-' || (c_custkey % CASE WHEN c_custkey % 2 = 0 THEN 37 ELSE 53 END) END AS identifier FROM customer),
own AS (SELECT * FROM (SELECT case_id, id, inc, unnest(['phone', 'email', 'identifier']) AS kind, unnest([phone, email, identifier]) AS value FROM p WHERE label = 'person') WHERE value IS NOT NULL),
links AS (SELECT c_custkey AS id, 'phone' AS kind, (9000000000 + c_custkey % 29)::VARCHAR AS value, 1 AS o FROM customer WHERE c_custkey % 6 = 1 UNION ALL SELECT c_custkey, 'phone', (9000000000 + (c_custkey + 1) % 29)::VARCHAR, 2 FROM customer WHERE c_custkey % 12 = 1
 UNION ALL SELECT c_custkey, 'account', 'ACC' || (c_custkey % 31), 3 FROM customer WHERE c_custkey % 6 = 2 UNION ALL SELECT c_custkey, 'vehicle', printf('KA01AB%04d', c_custkey % 43), 4 FROM customer WHERE c_custkey % 6 = 3),
far AS (SELECT p.case_id, p.id, p.inc, kind, value, o FROM links JOIN p USING (id) WHERE label = 'person'),
isig AS (SELECT case_id, id, kind, value FROM own WHERE inc UNION SELECT case_id, id, kind, arg_min(value, o) FROM far WHERE inc AND (id, kind) NOT IN (SELECT (id, kind) FROM own) GROUP BY ALL),
esig AS (SELECT case_id, id, kind, value FROM own WHERE NOT inc UNION SELECT case_id, id, kind, value FROM far WHERE NOT inc),
strong AS (SELECT i.id, e.id AS cand, string_agg(DISTINCT i.kind, ',' ORDER BY i.kind) AS detail FROM isig i JOIN esig e ON i.case_id = e.case_id AND i.kind = e.kind AND i.value = e.value GROUP BY ALL),
same AS (SELECT i.id, e.id AS cand, i.label FROM p i JOIN p e ON i.case_id = e.case_id AND i.label = e.label AND i.n = e.n AND i.inc AND NOT e.inc),
clash AS (SELECT s.id, s.cand, min(list_position(['phone', 'email', 'account', 'vehicle', 'identifier'], i.kind)) AS k FROM same s JOIN isig i ON i.id = s.id JOIN esig e ON e.id = s.cand AND e.kind = i.kind GROUP BY ALL),
v AS (SELECT s.id, s.cand, 1 AS rank, detail, x.n = y.n AS agrees FROM strong s JOIN p x ON x.id = s.id JOIN p y ON y.id = s.cand
 UNION ALL SELECT id, cand, 1, 'identity', NULL FROM same WHERE label <> 'person'
 UNION ALL SELECT s.id, s.cand, CASE WHEN k IS NULL THEN 3 ELSE 2 END, coalesce((['phone', 'email', 'account', 'vehicle', 'identifier'])[k], 'name'), NULL FROM same s LEFT JOIN clash USING (id, cand) WHERE label = 'person' AND (s.id, s.cand) NOT IN (SELECT (id, cand) FROM strong)),
best AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY rank, cand) = 1)"""


def resolve_entities(spark, sf):
    rels = _contacts(spark, sf)
    return resolve.resolve(*_split(spark, sf), rels, rels)


def resolve_verdicts(spark, sf):
    return resolve_entities(spark, sf).groupBy("verdict", "detail").agg(F.count("*").alias("entities"))


def merge_attributes(spark, sf):
    old, new = _split(spark, sf)
    out = resolve.merge(old, new, resolve_entities(spark, sf))
    return out.select("id", "merged", "status", "reason", F.coalesce(t.phone(F.col("phone")), F.lit("")).alias("phone"), F.coalesce(t.email(F.col("email")), F.lit("")).alias("email"))


def resolve_arrivals(spark, sf):
    """Verdicts of a batch whose rows are candidates for the rows after them."""
    rels = _contacts(spark, sf)
    return resolve.arrive(*_split(spark, sf), rels, rels)


def arrived_entities(spark, sf):
    """The entity table after that batch."""
    old, new = _split(spark, sf)
    return resolve.after_arrival(old, new, resolve_arrivals(spark, sf)).select("side", "id", "key", "merged", "status", *resolve.KINDS)


def scoped_keys(spark, sf):
    """Keys of a batch; some rows have no case, no name, a name with underscores and marks, or a key without a prefix."""
    k = F.col("id")
    p = _people(spark, sf).withColumns({
        "case_id": F.when(k % 5 == 0, F.lit(None)).otherwise(F.col("case_id")),
        "name": F.when(k % 7 == 0, F.lit(None)).when(k % 7 == 1, F.format_string("A_b c-%d", k)).when(k % 7 == 2, "").otherwise(F.col("name")),
        "key": F.when(k % 4 == 1, F.concat(F.lit("K"), k.cast("string"))).otherwise(F.col("key"))})
    # every tenth row comes a second time, later
    p = p.unionByName(p.filter("id % 10 = 3").withColumn("id", k + 1_000_000_000))
    return resolve.new_keys(p.filter("id % 2 = 1"), p.filter("id % 3 = 0 AND id < 1000000000"))


def edge_upsert(spark, sf):
    r = a.relationships(spark, sf).withColumn("timestamp", F.when(F.col("amount") > 1000, F.col("timestamp")))
    return resolve.upsert_edges(r.filter("amount < 30000"), r.filter("amount >= 20000")).groupBy("case_id", "relation").agg(F.count("*").alias("edges"))


def batch_groups(spark, sf):
    return resolve.batch_groups(_people(spark, sf).filter("label = 'Person'"))


def _blocks(spark, sf):
    e = a.log_events(spark, sf)
    payload = F.concat(F.lit('{"audit_id":'), F.col("id").cast("string"), F.lit(',"props":'), F.coalesce("props", F.lit("null")), F.lit("}"))
    rows = e.select(F.col("username").alias("chain_id"), "id", "ts", F.when(F.col("action") == "error", "SECURITY_EVENT").otherwise("AUDIT_EVENT").alias("event_type"), payload.alias("payload"))
    return ledger.append_blocks(rows)




def _body(e: str, prev: str) -> str:
    """A block's canonical JSON in SQL; ``e`` is the alias of the event row."""
    return f"""'{{"created_at":"' || strftime({e}.ts, '%Y-%m-%dT%H:%M:%S.%f') || '","event_type":"' || {e}.event_type || '","index":' || {e}.i || ',"payload":' || {e}.payload || ',"previous_hash":"' || {prev} || '"}}'"""


_CHAIN = f"""{LOG_SQL}, e AS (SELECT username AS chain_id, id, ts, CASE WHEN action = 'error' THEN 'SECURITY_EVENT' ELSE 'AUDIT_EVENT' END AS event_type, '{{"audit_id":' || id || ',"props":' || coalesce(props, 'null') || '}}' AS payload, row_number() OVER (PARTITION BY username ORDER BY id) - 1 AS i FROM log),
b AS (SELECT chain_id, i, id, event_type, 'GENESIS' AS previous_hash, sha256({_body('e', "'GENESIS'")}) AS block_hash FROM e WHERE i = 0
UNION ALL SELECT e.chain_id, e.i, e.id, e.event_type, b.block_hash, sha256({_body('e', 'b.block_hash')}) FROM e JOIN b ON e.chain_id = b.chain_id AND e.i = b.i + 1)"""


# the tree over chain heads: five levels of sixteen are enough for a million chains
_LEVELS = 5
_TREE = f"""heads AS (SELECT chain_id, max(i) AS i, arg_max(block_hash, i) AS h FROM b GROUP BY chain_id),
t0 AS (SELECT chain_id, row_number() OVER (ORDER BY chain_id) - 1 AS place, sha256('{{"block_hash":"' || h || '","block_index":' || i || ',"chain_id":"' || chain_id || '"}}') AS hash FROM heads), """ + ", ".join(
    f"t{k} AS (SELECT place // {ledger.FAN} AS place, sha256(string_agg(hash, '' ORDER BY place)) AS hash FROM t{k - 1} GROUP BY place // {ledger.FAN})" for k in range(1, _LEVELS + 1)
)
_ROOT = "CASE 1 " + " ".join(f"WHEN (SELECT count(*) FROM t{k}) THEN (SELECT min(hash) FROM t{k})" for k in range(_LEVELS + 1)) + " END"


def chain_append(spark, sf):
    return _blocks(spark, sf).select("chain_id", F.col("block_index").cast("long").alias("block_index"), "id", "previous_hash", "block_hash")


def chain_verify(spark, sf):
    b = _blocks(spark, sf)
    n = F.regexp_extract("chain_id", r"(\d+)", 1).cast("int")
    broken = b.withColumn("payload", F.when((n % 3 == 0) & (F.col("block_index") == n % 5), F.lit('{"audit_id":0}')).otherwise(F.col("payload")))
    return ledger.verify_chains(broken).select("chain_id", "valid", "checked_blocks")


def _events_with(spark, sf, changed: bool):
    """The chains of the log; with ``changed`` as if every eleventh user's first event had said something else, and all later blocks were written anew."""
    e = a.log_events(spark, sf)
    payload = F.concat(F.lit('{"audit_id":'), F.col("id").cast("string"), F.lit(',"props":'), F.coalesce("props", F.lit("null")), F.lit("}"))
    if changed:
        # a user's first event: no event of the user is before it
        first = e.groupBy("username").agg(F.min("id").alias("id")).filter(F.regexp_extract("username", r"(\d+)", 1).cast("int") % 11 == 0).withColumn("hit", F.lit(True))
        e = e.join(first, ["username", "id"], "left")
        payload = F.when(F.col("hit"), F.lit('{"audit_id":0}')).otherwise(payload)
    rows = e.select(F.col("username").alias("chain_id"), "id", "ts", F.when(F.col("action") == "error", "SECURITY_EVENT").otherwise("AUDIT_EVENT").alias("event_type"), payload.alias("payload"))
    return ledger.append_blocks(rows)


def ledger_seal(spark, sf):
    """The sealed root over all chains, and each chain's leaf and place."""
    root, proofs = ledger.seal(ledger.chain_heads(_blocks(spark, sf)))
    top = root.first() or (0, 0, None)
    return proofs.select("chain_id", "place", "leaf", F.lit(top[0]).cast("long").alias("chains"), F.lit(top[2]).cast("string").alias("root"))


def sealed_chains(spark, sf):
    """Chains after some were written anew: each is whole in itself, but the root tells which are not the ones that were sealed."""
    root, proofs = ledger.seal(ledger.chain_heads(_blocks(spark, sf)))
    now = cut(_events_with(spark, sf, changed=True))
    return ledger.check_seal(ledger.chain_heads(now), proofs, root).join(ledger.verify_chains(now).select("chain_id", "valid"), "chain_id")


def ledger_lag(spark, sf):
    w = Window.partitionBy("username").orderBy("id")
    return a.log_events(spark, sf).select("id", "username", F.lag("action", 1, ledger.GENESIS).over(w).alias("previous"))


def ledger_anchor(spark, sf):
    out = ledger.anchors(a.log_events(spark, sf), _blocks(spark, sf))
    return out.select("audit_id", F.col("block_index").cast("long").alias("block_index"))


def audit_to_ledger(spark, sf):
    """Audit rows as blocks of their users' ledgers, and those with a severity as security events."""
    e = a.log_events(spark, sf).withColumns({"severity": F.when(F.col("action") == "error", "WARNING"), "resource": F.col("ip")})
    blocks, security = ledger.audit_blocks(e)
    out = blocks.select("id", F.lit("LEDGER").alias("kind"), F.col("block_index").cast("long").alias("block_index"), F.sha2("payload", 256).alias("payload_sha256"), F.lit(None).cast("string").alias("severity"))
    return out.unionByName(security.select("id", F.lit("SECURITY").alias("kind"), F.lit(None).cast("long").alias("block_index"), F.lit(None).cast("string").alias("payload_sha256"), "severity"))


def _audit(spark, sf):
    k = F.col("event_id")
    acts = [*ledger.BY_ID, *ledger.BY_NAME, "LOGIN"]
    action = F.element_at(F.array(*[F.lit(x) for x in acts]), (k % 8 + 1).cast("int"))
    doc = k % 200
    resource = F.when((k % 8 >= 4) & (k % 8 < 7), F.format_string("doc_%d.txt", doc)).otherwise(doc.cast("string"))
    detail = F.when(k % 3 == 0, F.concat(F.lit("case_id="), (k % 25).cast("string"), F.lit("; x"))).otherwise("")
    return a.table(spark, sf, "events").select(k.alias("id"), action.alias("action"), resource.alias("resource"), detail.alias("detail"))


_TRAIL = """au AS (SELECT event_id AS id, event_id % 8 AS act, event_id % 200 AS doc, event_id % 3 = 0 AS named, event_id % 25 AS c FROM events),
trail AS (SELECT DISTINCT document_id, id AS audit_id FROM docs JOIN au ON doc = document_id WHERE act < 4 OR (act < 7 AND (NOT named OR c = case_id)))"""


def audit_trail(spark, sf):
    return ledger.audit_trail(a.documents(spark, sf), _audit(spark, sf))


def _integrity(spark, sf):
    d = a.table(spark, sf, "documents")
    k = F.col("doc_id")
    return d.filter(k % 6 != 5).select(k.alias("document_id"), F.when(k % 6 == 4, F.sha2(F.lit("other"), 256)).otherwise(F.sha2("text", 256)).alias("sha256"), F.when(k % 6 == 3, F.lit(None)).otherwise(F.concat(F.lit("store/"), k.cast("string"))).alias("stored_path"), F.lit("VERIFIED").alias("status"))


def evidence_hash(spark, sf):
    return a.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size"))


def verify_evidence(spark, sf):
    now = a.table(spark, sf, "documents").filter("doc_id % 6 <> 2").select(F.col("doc_id").alias("document_id"), F.sha2("text", 256).alias("sha256"))
    return ledger.verify_evidence(_integrity(spark, sf), now)


def missing_fingerprints(spark, sf):
    """Documents without an integrity row, hashed from their files; every ninth file is gone."""
    d = a.documents(spark, sf)
    stored = d.filter("document_id % 9 <> 8").select("document_id", F.concat(F.lit("store/"), F.col("document_id").cast("string")).alias("path"), F.col("content").cast("binary").alias("content"))
    return ledger.backfill_fingerprints(d, _integrity(spark, sf), stored)


def provenance_steps(spark, sf):
    d = a.documents(spark, sf)
    out = ledger.provenance(d, _integrity(spark, sf), ledger.audit_trail(d, _audit(spark, sf)))
    return out.select("document_id", F.array_join(F.transform("steps", lambda s: F.concat(s.step, F.lit(":"), s.status)), ",").alias("steps"), F.concat_ws("/", F.expr("steps[2].detail"), F.expr("steps[5].detail")).alias("details"))


def document_register(spark, sf):
    """The 50 newest documents with case reference, integrity status and whether they are indexed."""
    d = a.documents(spark, sf)
    indexed = retrieval.sliding_chunks(d).filter("document_id % 4 <> 0")
    return ledger.document_register(d, a.cases(spark, sf), _integrity(spark, sf), indexed)


def delete_document(spark, sf):
    """What users' requests to delete a document (some of another case, some of none) do to every table."""
    d, req = a.documents(spark, sf), a.table(spark, sf, "events").select(F.col("user_id").alias("document_id"), F.when(F.col("event_id") % 3 == 0, F.lit(None)).otherwise(F.col("event_id") % 25).alias("case_id"))
    chunks = retrieval.sliding_chunks(d).select("document_id", "case_id", "chunk_index")
    return cascade.delete_documents(req, d, _integrity(spark, sf), chunks)[0]


def delete_document_rest(spark, sf):
    """Rows of every table that are left after these requests."""
    d, req = a.documents(spark, sf), a.table(spark, sf, "events").select(F.col("user_id").alias("document_id"), F.lit(None).cast("long").alias("case_id"))
    chunks = retrieval.sliding_chunks(d).select("document_id", "case_id", "chunk_index")
    _, *left = cascade.delete_documents(req, d, _integrity(spark, sf), chunks)
    docs, hashes, rest = (df.agg(F.count("*").alias(n)) for df, n in zip(left, ("documents", "integrity_rows", "chunks"), strict=True))
    # three frames of one row each
    return docs.join(F.broadcast(hashes)).join(F.broadcast(rest))


def authorize_actions(spark, sf):
    e = a.table(spark, sf, "events")
    role = F.element_at(F.array(*[F.lit(x) for x in ("Admin", " investigator", "AUDITOR", "guest", "")]), (F.col("user_id") % 5 + 1).cast("int"))
    perm = F.when(F.col("event_type") == "view", "ledger:view").when(F.col("event_type") == "purchase", "case:delete").when(F.col("event_type") == "error", "no:such").otherwise("case:view")
    return ledger.authorize(e.select("event_id", role.alias("role"), perm.alias("permission"))).select("event_id", "verdict")


def scope_check(spark, sf):
    req = a.table(spark, sf, "events").select(F.col("event_id").alias("request_id"), F.col("user_id").alias("document_id"), F.when(F.col("event_id") % 4 == 0, F.lit(None)).otherwise(F.col("event_id") % 25).alias("case_id"))
    return ledger.scope_check(req, a.documents(spark, sf).filter("document_id % 3 <> 0"))


def denied_events(spark, sf):
    """Security events of denied actions and of requests for other cases' documents."""
    e = a.table(spark, sf, "events")
    role = F.element_at(F.array(*[F.lit(x) for x in ("Admin", " investigator", "AUDITOR", "guest", "")]), (F.col("user_id") % 5 + 1).cast("int"))
    perm = F.when(F.col("event_type") == "view", "ledger:view").when(F.col("event_type") == "purchase", "case:delete").when(F.col("event_type") == "error", "no:such").otherwise("case:view")
    acts = ledger.denied_actions(e.select(F.col("event_id").alias("id"), role.alias("role"), perm.alias("permission")))
    req = e.select(F.col("event_id").alias("request_id"), F.col("user_id").alias("document_id"), F.when(F.col("event_id") % 4 == 0, F.lit(None)).otherwise(F.col("event_id") % 25).alias("case_id"))
    return acts.unionByName(ledger.denied_requests(req, a.documents(spark, sf).filter("document_id % 3 <> 0")))


def newest_security(spark, sf):
    e = a.log_events(spark, sf).filter("action = 'error'")
    return registers.newest(e).select("id", "username", "action", "ip")


def newest_blocks(spark, sf):
    return registers.newest(_blocks(spark, sf).select("chain_id", F.col("block_index").cast("long").alias("block_index"), "id", "block_hash")).select("id", "chain_id", "block_index", "block_hash")


def trailing_alerts(spark, sf):
    """Failed events as they arrive, a third of them hours late, against the same window over the table; a last event of another ip moves the watermark past all."""
    src = files.work_dir(spark, "trailing")
    log = a.log_events(spark, sf).filter("action = 'error'").select("ip", "ts", "id")
    late = log.withColumn("batch", F.floor(F.unix_micros("ts") / 3_600_000_000) + F.when(F.col("id") % 3 == 0, F.col("id") % 12).otherwise(0))
    last = log.agg(F.max("ts").alias("ts")).select(F.lit("end").alias("ip"), (F.col("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"), F.lit(-1).cast("long").alias("id"))
    # files in order of arrival
    late.repartitionByRange(6, "batch").sortWithinPartitions("batch").drop("batch").write.parquet(f"{src}/in")
    schema = log.schema
    run = lambda: streams.ingest(streams.trailing_alerts(streams.read_stream(spark, f"{src}/in", schema), 3, 6 * 3600, "60 days"), lambda b, n: b.write.mode("overwrite").parquet(f"{src}/out/batch={n}"), f"{src}/checkpoint")
    run()
    last.withColumn("ts", F.col("ts") + F.expr("INTERVAL 60 DAYS")).coalesce(1).write.mode("append").parquet(f"{src}/in")
    run()
    return spark.read.schema("id long, ip string, recent long, batch long").parquet(f"{src}/out").select("id", "ip", "recent")


def rate_limit(spark, sf):
    e = a.log_events(spark, sf)
    return ledger.rate_limited(e, 3, 6 * 3600).select("id", "ip", "recent")


def security_overview(spark, sf):
    log = a.log_events(spark, sf).withColumn("action", F.when(F.col("action") == "error", "LOGIN_FAILED").otherwise(F.col("action")))
    return portfolio.security_overview(verify_evidence(spark, sf), log, file_classify(spark, sf).withColumnRenamed("category", "verdict"))


def top_logs(spark, sf):
    return a.log_events(spark, sf).orderBy(F.desc("id")).limit(100).select("id", "username", "action")


def newest_documents(spark, sf):
    return a.documents(spark, sf).orderBy(F.desc("document_id")).limit(50).select("document_id", "case_id", "filename")


def _csv(spark, sf):
    path = files.work_dir(spark, "csv")
    o = a.table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 9 == 0, "NaN").otherwise(F.concat(F.lit(" "), "o_orderpriority")).alias("o_orderpriority"), F.concat(F.lit('a "quoted", text '), F.col("o_custkey").cast("string")).alias("note"))
    o.write.csv(path, header=True, escape='"', quoteAll=True)
    return files.read_csv(spark, path)


def csv_records(spark, sf):
    return _csv(spark, sf).select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_orderpriority", "note")


def document_metadata(spark, sf):
    df = _csv(spark, sf).withColumns({"ordinal": F.col("o_orderkey").cast("long"), "file": F.col("o_orderkey").cast("long") % 3})
    return files.document_metadata(df, ["o_orderkey", "o_orderpriority"])


def _json_files(spark, sf):
    """One JSON text an event user: wrapped records, arrays, single objects, and broken ones."""
    e = a.table(spark, sf, "events")
    recs = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type", F.struct("value", F.struct(F.col("props").alias("raw")).alias("in")).alias("more")))).alias("rs"))
    u = F.col("user_id")
    body = F.when(u % 5 == 0, F.to_json(F.struct(u.alias("owner"), F.lit("log").alias("kind"), F.col("rs").alias("entries")))).when(u % 5 == 1, F.to_json("rs")).when(u % 5 == 2, F.to_json(F.struct(F.struct(F.col("rs").alias("items")).alias("data"), F.lit("v1").alias("kind")))).when(u % 5 == 3, F.to_json(F.struct(u.alias("owner"), F.size("rs").alias("n")))).otherwise(F.when(u % 2 == 0, F.lit("[1, 2]")).otherwise(F.lit("{broken")))
    return recs.select(u.alias("file"), body.alias("content"), F.size("rs").alias("n"))


def json_records(spark, sf):
    good, _ = files.json_records(_json_files(spark, sf))
    return good.groupBy("file").agg(F.count("*").alias("records"))


def ingest_report(spark, sf):
    f = _json_files(spark, sf)
    good, bad = files.json_records(f)
    # every record gives an entity, and one of more than an owner an edge
    owner = F.try_variant_get("record", "$.owner", "string")
    made = files.extracted_counts(good.select("file"), good.filter(owner.isNull()).select("file"))
    return files.ingest_report(f, good, bad, made).select("file", "ok", "records", "entities", "relationships", F.length("sha256").alias("hash_length"), "error")


def field_union(spark, sf):
    good, _ = files.json_records(_json_files(spark, sf))
    return files.field_union(good).select("file", F.array_join("fields", ",").alias("fields"))


def text_metadata(spark, sf):
    m = files.text_metadata(a.documents(spark, sf).select(F.col("document_id").alias("file"), F.repeat("content", 40).alias("content")))
    return m.select("file", "chars", F.length("content").cast("long").alias("kept"), F.length("preview").cast("long").alias("preview"))


def json_flatten(spark, sf):
    good, _ = files.json_records(_json_files(spark, sf))
    return files.json_fields(good, "record", ["file", "row"]).groupBy("name").agg(F.count("*").alias("n"), F.count_distinct("value").alias("distinct_values"))


def json_envelope(spark, sf):
    return files.envelope(_json_files(spark, sf)).select("file", "name", "value").filter("name <> 'data'")


#: Lines of a text file that ``text_scan`` writes.
LINES = 10_000


def text_scan(spark, sf):
    path = files.work_dir(spark, "text")
    c = a.table(spark, sf, "conversations")
    # written as the scan's tasks come, in files of at most LINES lines
    lines = c.select((F.col("conv_id") % 6).alias("part"), F.regexp_replace("text", "\\s+", " ").alias("value"))
    lines.write.partitionBy("part").option("maxRecordsPerFile", LINES).text(path)
    df = files.read_text(spark, path)
    return df.select(F.regexp_extract("file", "part=([0-9]+)", 1).cast("long").alias("part"), F.length(F.regexp_replace("content", "\n", "")).alias("n")).groupBy("part").agg(F.sum("n").alias("chars"))


def size_limit(spark, sf, max_bytes=files.MAX_BYTES):
    """Parts of the documents, written as files, and how many of them have a hash for every file; a document over the limit leaves its part without.

    A file holds as many documents as are sure to stay under the limit together: those of up to 16 KB, 1 MB and so on by themselves; a larger document is a file of its own.
    """
    path = files.work_dir(spark, "binary")
    d = a.table(spark, sf, "documents").select((F.col("doc_id") % 8).alias("part"), F.col("text").alias("value"))
    # with its line end
    size, least = F.coalesce(F.octet_length("value"), F.lit(0)) + 1, 0
    for most in (1 << 14, 1 << 20, None):
        some = d.filter((size > least) & (size <= most) if most else size > least)
        some.write.mode("append").partitionBy("part").option("maxRecordsPerFile", max(1, max_bytes // most) if most else 1).text(path)
        least = most
    part = F.regexp_extract("path", "part=([^/]+)", 1).alias("part")
    done = ledger.fingerprints(files.read_binary(spark, path, max_bytes)).select(part, (F.length("sha256") == 64).alias("hashed"))
    over = files.oversized(spark, path, max_bytes).select(part, F.lit(False).alias("hashed"))
    return done.union(over).groupBy("part").agg(F.every("hashed").alias("hashed")).agg(F.count("*").alias("files"), F.count_if("hashed").alias("hashed"))


def file_classify(spark, sf):
    p = a.table(spark, sf, "part")
    ext = F.element_at(F.array(*[F.lit(x) for x in (".csv", ".TXT", ".exe", ".JSON", ".pdf", "")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    path = F.concat(F.lit("a.b/file"), F.col("p_partkey").cast("string"), ext)
    return p.select("p_partkey", files.extension(path).alias("extension"), files.classify(path).alias("category"))


def table_sinks(spark, sf):
    """Write all cases, replace case 1, read one case and all."""
    path = files.work_dir(spark, "sink")
    e = a.entities(spark, sf).select("case_id", "key", "name")
    files.write_cases(e, path)
    files.write_cases(e.filter("case_id = 1").withColumn("name", F.lit("new")), path)
    one = files.read_case(spark, path, 1).agg(F.count("*").alias("case_1"), F.count_if(F.col("name") == "new").alias("replaced"))
    return one.join(F.broadcast(files.read_case(spark, path).agg(F.count("*").alias("everything"))))


def scoped_scan(spark, sf):
    """The edges as a table of cases, one case of it, and all."""
    path = files.work_dir(spark, "cases")
    files.write_cases(a.relationships(spark, sf), path)
    parts = [files.read_case(spark, path, case).groupBy("source").agg(F.count("*").alias("edges")).select(F.lit(name).alias("scope"), "source", "edges") for name, case in (("case 7", 7), ("all", None))]
    return parts[0].unionByName(parts[1])


def file_counts(spark, sf):
    """Entities and relationships that come of each file of call records."""
    df = _call_records(spark, sf)
    return files.extracted_counts(*extract.calls(df, roles.call_roles(df.columns), "Date"))


def _call_records(spark, sf):
    o = a.table(spark, sf, "orders")
    num = lambda c: F.when(c % 11 == 0, F.lit("nan")).otherwise((F.lit(9000000000) + c).cast("string"))
    return o.select((F.col("o_orderkey") % 25).alias("case_id"), (F.col("o_orderkey") % 100).alias("file"), F.col("o_orderkey").alias("ordinal"), num(F.col("o_custkey") % 200).alias("Caller"), num((F.col("o_orderkey") * 31) % 1000).alias("Receiver"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("Date"), F.lit("20:40:00").alias("Time"))


def tumbling_activity(spark, sf):
    return streams.tumbling_activity(a.log_events(spark, sf)).withColumn("start", F.date_format("start", "yyyy-MM-dd"))


def session_activity(spark, sf):
    return streams.session_activity(a.log_events(spark, sf), "6 hours").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "username", "events")


def _streamed(spark, df, name, operate):
    """Write a table, read it as a stream, run the stream to its end and read what it wrote."""
    src = files.work_dir(spark, name)
    df.write.parquet(f"{src}/in")
    # all files at once, however many: no row comes later than a watermark of the files before
    out = operate(streams.read_stream(spark, f"{src}/in", df.schema, 1_000_000))
    streams.run_available(out, f"{src}/out", f"{src}/state")
    return spark.read.schema(out.schema).parquet(f"{src}/out")


def stream_dedup(spark, sf):
    r = a.relationships(spark, sf).withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    r = r.unionByName(r.filter("amount > 30000"))
    return _streamed(spark, r, "dedup", streams.dedup_edges).groupBy("case_id", "relation").agg(F.count("*").alias("edges"))


def _arrived(spark, rows, name, extracted):
    """(case_id, entities, edges) after the files of a table came as two batches."""
    src = files.work_dir(spark, name)
    rows.repartition(4).write.parquet(f"{src}/in")
    ev, batches = arrivals.Evidence(spark, src), []
    handle = ev.handler(extracted)

    def one(batch, batch_id):
        handle(batch, batch_id)
        batches.append(batch_id)

    streams.ingest(streams.read_stream(spark, f"{src}/in", rows.schema, 2), one, f"{src}/state")
    count = lambda df, n: df.groupBy("case_id").agg(F.count("*").alias(n))
    return count(ev.entities(max(batches) + 1), "entities").join(count(ev.edges(max(batches) + 1), "edges"), "case_id")


def stream_ingest(spark, sf):
    """Arriving call records, batch by batch: extracted, resolved against what is known, and added."""
    r = _call_records(spark, sf)
    return _arrived(spark, r, "ingest", arrivals.call_batch(roles.call_roles(r.columns), "Date"))


def stream_transfers(spark, sf):
    """Arriving transfers, batch by batch; the file is the case."""
    li = a.table(spark, sf, "lineitem")
    account = lambda c: F.concat(F.lit("ACC"), F.col(c).cast("string"))
    r = li.select((F.col("l_orderkey") % 6).alias("case_id"), (F.col("l_orderkey") % 6).alias("file"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ordinal"), account("l_suppkey").alias("Sender_Account"), account("l_partkey").alias("Receiver_Account"), F.col("l_quantity").cast("string").alias("Amount"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("Date"))
    return _arrived(spark, r, "transfers", arrivals.transfer_batch(roles.transfer_roles(r.columns[3:])))


def failure_alerts(spark, sf):
    """Failed events as they arrive, in sliding windows; the last state of every window that alerts."""
    src = files.work_dir(spark, "alerts")
    log = a.log_events(spark, sf).filter("action = 'error'").select("ts", "ip", "id")
    log.repartition(4).write.parquet(f"{src}/in")
    out = streams.failure_alerts(streams.read_stream(spark, f"{src}/in", log.schema), 3, "12 hours", "1 hour")
    handle = lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{src}/out/batch={batch_id}")
    streams.ingest(out, handle, f"{src}/state", "update")
    found = spark.read.schema("start timestamp, ip string, failures long, batch long").parquet(f"{src}/out")
    return found.groupBy(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "ip").agg(F.max("failures").alias("failures"))


QUERIES = {f.__name__: f for f in (ledger_seal, sealed_chains, denied_events, newest_security, newest_blocks, trailing_alerts, field_union, text_metadata, delete_document_rest, failure_alerts, resolve_entities, resolve_verdicts, resolve_arrivals, arrived_entities, merge_attributes, scoped_keys, edge_upsert, batch_groups, chain_append, chain_verify, ledger_lag, ledger_anchor, audit_to_ledger, audit_trail, evidence_hash, verify_evidence, missing_fingerprints, provenance_steps, document_register, delete_document, authorize_actions, scope_check, rate_limit, security_overview, top_logs, newest_documents, csv_records, document_metadata, json_records, ingest_report, json_flatten, json_envelope, text_scan, size_limit, file_classify, table_sinks, scoped_scan, file_counts, tumbling_activity, session_activity, stream_dedup, stream_ingest, stream_transfers)}

_INTEGRITY = "integ AS (SELECT doc_id AS document_id, CASE WHEN doc_id % 6 = 4 THEN sha256('other') ELSE sha256(text) END AS sha256, CASE WHEN doc_id % 6 = 3 THEN NULL ELSE 'store/' || doc_id END AS stored_path FROM documents WHERE doc_id % 6 <> 5)"

ORACLE_SQL = {
    "resolve_entities": f"WITH {_PEOPLE} SELECT p.id, CASE rank WHEN 1 THEN 'EXACT_MATCH' WHEN 3 THEN 'AMBIGUOUS' ELSE 'NEW_ENTITY' END AS verdict, CASE WHEN rank = 1 THEN cand END AS candidate_id, coalesce(detail, '') AS detail, agrees AS name_agrees FROM p LEFT JOIN best USING (id) WHERE inc",
    "resolve_verdicts": f"WITH {_PEOPLE} SELECT CASE rank WHEN 1 THEN 'EXACT_MATCH' WHEN 3 THEN 'AMBIGUOUS' ELSE 'NEW_ENTITY' END AS verdict, coalesce(detail, '') AS detail, count(*) AS entities FROM p LEFT JOIN best USING (id) WHERE inc GROUP BY ALL",
    "merge_attributes": f"WITH {_PEOPLE}, m AS (SELECT cand, count(*) AS merged, arg_min(detail, p.id) AS reason, arg_min(phone, p.id) FILTER (phone IS NOT NULL) AS phone, arg_min(email, p.id) FILTER (email IS NOT NULL) AS email FROM best JOIN p USING (id) WHERE rank = 1 GROUP BY cand) SELECT p.id, coalesce(merged, 0)::BIGINT AS merged, CASE WHEN merged > 0 THEN 'MERGED' ELSE 'UNCHANGED' END AS status, coalesce(reason, '') AS reason, coalesce(p.phone, m.phone, '') AS phone, coalesce(p.email, m.email, '') AS email FROM p LEFT JOIN m ON p.id = m.cand WHERE NOT inc",
    "scoped_keys": """WITH c AS (SELECT c_custkey AS k, c_custkey AS id FROM customer UNION ALL SELECT c_custkey, c_custkey + 1000000000 FROM customer WHERE c_custkey % 10 = 3),
p AS (SELECT id, CASE WHEN k % 5 = 0 THEN '0' ELSE (k % 4)::VARCHAR END AS c, CASE WHEN k % 4 = 1 THEN 'K' || k ELSE 'PERSON:' || k END AS key, CASE WHEN k % 7 = 0 THEN 'ENTITY' WHEN k % 7 = 1 THEN 'A_BC' || k WHEN k % 7 = 2 THEN '' ELSE 'NAME' || (k % 37) END AS n FROM c),
t AS (SELECT key FROM p WHERE id % 3 = 0 AND id < 1000000000)
SELECT id, CASE WHEN key IN (SELECT key FROM t) OR id > min(id) OVER (PARTITION BY key) THEN CASE WHEN key LIKE 'K%' THEN 'ENTITY' ELSE 'PERSON' END || ':C' || c || '_' || substr(n, 1, 12) || '_' || upper(substr(sha256(c || '~' || key || '~' || id), 1, 6)) ELSE key END AS key FROM p WHERE id % 2 = 1""",
    "edge_upsert": f"WITH {RELATIONSHIPS_SQL}, r AS (SELECT case_id, source, target, relation, CASE WHEN amount > 1000 THEN timestamp END AS timestamp, amount FROM rel) SELECT case_id, relation, count(*) AS edges FROM (SELECT case_id, source, target, relation, timestamp FROM r WHERE amount >= 20000 EXCEPT SELECT case_id, source, target, relation, timestamp FROM r WHERE amount < 30000) GROUP BY ALL",
    "batch_groups": f"""WITH RECURSIVE {_PEOPLE}, n AS (SELECT case_id, id, unnest(['p' || phone, 'e' || email, 'i' || identifier]) AS v FROM p WHERE label = 'person'), l AS (SELECT DISTINCT x.id AS a, y.id AS b FROM n x JOIN n y ON x.case_id = y.case_id AND x.v = y.v),
r AS (SELECT id AS a, id AS b FROM p WHERE label = 'person' UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a) SELECT a AS id, min(b) AS group_id FROM r GROUP BY a""",
    "ledger_seal": f"WITH RECURSIVE {_CHAIN}, {_TREE} SELECT chain_id, place, hash AS leaf, (SELECT count(*) FROM t0) AS chains, {_ROOT} AS root FROM t0",
    "sealed_chains": f"WITH {LOG_SQL} SELECT DISTINCT username AS chain_id, regexp_extract(username, '\\d+')::INTEGER % 11 <> 0 AS sealed, true AS valid FROM log",
    "chain_append": f"WITH RECURSIVE {_CHAIN} SELECT chain_id, i AS block_index, id, previous_hash, block_hash FROM b",
    "chain_verify": f"WITH RECURSIVE {_CHAIN}, c AS (SELECT chain_id, count(*) AS n, regexp_extract(chain_id, '\\d+')::INTEGER AS k FROM b GROUP BY ALL) SELECT chain_id, NOT (k % 3 = 0 AND k % 5 < n) AS valid, CASE WHEN k % 3 = 0 AND k % 5 < n THEN k % 5 + 1 ELSE n END::BIGINT AS checked_blocks FROM c",
    "ledger_lag": f"WITH {LOG_SQL} SELECT id, username, lag(action, 1, 'GENESIS') OVER (PARTITION BY username ORDER BY id) AS previous FROM log",
    "ledger_anchor": f"WITH {LOG_SQL} SELECT id AS audit_id, CASE WHEN action <> 'error' THEN row_number() OVER (PARTITION BY username ORDER BY id) - 1 END AS block_index FROM log",
    "audit_to_ledger": f"""WITH {LOG_SQL} SELECT id, 'LEDGER' AS kind, row_number() OVER (PARTITION BY username ORDER BY id) - 1 AS block_index, sha256('{{"action":"' || action || '","audit_id":' || id || ',"resource":"' || ip || '","severity":' || CASE WHEN action = 'error' THEN '"WARNING"' ELSE 'null' END || '}}') AS payload_sha256, NULL AS severity FROM log UNION ALL SELECT id, 'SECURITY', NULL, NULL, 'WARNING' FROM log WHERE action = 'error'""",
    "audit_trail": f"WITH {DOCUMENTS_SQL}, {_TRAIL} SELECT * FROM trail",
    "evidence_hash": "SELECT doc_id, sha256(text) AS sha256, octet_length(encode(text))::BIGINT AS size FROM documents",
    "verify_evidence": f"WITH {_INTEGRITY} SELECT document_id, CASE WHEN stored_path IS NULL THEN 'INVALID_PATH' WHEN document_id % 6 = 2 THEN 'MISSING' WHEN document_id % 6 = 4 THEN 'TAMPERED' ELSE 'VERIFIED' END AS status FROM integ",
    "missing_fingerprints": f"WITH {DOCUMENTS_SQL} SELECT document_id, CASE WHEN document_id % 9 <> 8 THEN sha256(content) END AS sha256, CASE WHEN document_id % 9 <> 8 THEN octet_length(encode(content))::BIGINT END AS size, CASE WHEN document_id % 9 <> 8 THEN 'store/' || document_id END AS stored_path, CASE WHEN document_id % 9 <> 8 THEN 'VERIFIED' ELSE 'MISSING' END AS status FROM docs WHERE document_id % 6 = 5",
    "provenance_steps": f"WITH {DOCUMENTS_SQL}, {_TRAIL}, {_INTEGRITY}, n AS (SELECT document_id, count(*) AS events FROM trail GROUP BY ALL) SELECT document_id, 'CASE:OK,DOCUMENT:OK,' || CASE WHEN document_id % 6 IN (3, 5) THEN 'STORAGE:MISSING,' ELSE 'STORAGE:OK,' END || CASE WHEN document_id % 6 = 5 THEN 'HASH:MISSING,INTEGRITY:NOT_CHECKED' ELSE 'HASH:OK,INTEGRITY:VERIFIED' END || CASE WHEN events IS NOT NULL THEN ',AUDIT:OK' ELSE ',AUDIT:MISSING' END AS steps, concat_ws('/', CASE WHEN document_id % 6 NOT IN (3, 5) THEN 'store/' || document_id END, events) AS details FROM docs LEFT JOIN n USING (document_id)",
    "document_register": f"WITH {DOCUMENTS_SQL}, {CHUNKS_SQL}, c AS (SELECT DISTINCT document_id FROM chunks WHERE document_id % 4 <> 0) SELECT document_id, filename, printf('CL-%03d', case_id) AS reference_id, CASE WHEN document_id % 6 = 5 THEN 'NOT_CHECKED' ELSE 'VERIFIED' END AS status, document_id IN (FROM c) AS rag_indexed FROM docs ORDER BY document_id DESC LIMIT 50",
    "delete_document": f"WITH {DOCUMENTS_SQL}, {CHUNKS_SQL}, q AS (SELECT DISTINCT user_id AS document_id, CASE WHEN event_id % 3 <> 0 THEN event_id % 25 END AS case_id FROM events), r AS (SELECT q.document_id, q.case_id, CASE WHEN d.document_id IS NULL THEN 'NOT_FOUND' WHEN q.case_id IS NULL OR q.case_id = d.case_id THEN 'DELETED' ELSE 'MISMATCH' END AS verdict FROM q LEFT JOIN docs d USING (document_id)), c AS (SELECT document_id, count(*) AS n FROM chunks GROUP BY ALL) SELECT r.*, CASE WHEN verdict = 'DELETED' AND document_id % 6 <> 5 THEN 1 ELSE 0 END::BIGINT AS integrity_rows, CASE WHEN verdict = 'DELETED' THEN coalesce(n, 0) ELSE 0 END::BIGINT AS chunks FROM r LEFT JOIN c USING (document_id)",
    "delete_document_rest": f"WITH {DOCUMENTS_SQL}, {CHUNKS_SQL}, u AS (SELECT DISTINCT user_id FROM events) SELECT (SELECT count(*) FROM docs WHERE document_id NOT IN (FROM u)) AS documents, (SELECT count(*) FROM docs WHERE document_id % 6 <> 5 AND document_id NOT IN (FROM u)) AS integrity_rows, (SELECT count(*) FROM chunks WHERE document_id NOT IN (FROM u)) AS chunks",
    "field_union": "SELECT user_id AS file, CASE WHEN user_id % 5 = 3 THEN 'n,owner' ELSE 'event_id,event_type,more' END AS fields FROM events WHERE user_id % 5 < 4 GROUP BY user_id",
    "text_metadata": "SELECT doc_id AS file, (40 * length(text))::BIGINT AS chars, least(100000, 40 * length(text))::BIGINT AS kept, least(50000, 40 * length(text))::BIGINT AS preview FROM documents",
    "failure_alerts": f"WITH {LOG_SQL}, w AS (SELECT ip, date_trunc('hour', ts) - to_hours(j::INTEGER) AS start FROM log, (SELECT unnest(range(0, 12)) AS j) WHERE action = 'error') SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, ip, count(*) AS failures FROM w GROUP BY ALL HAVING count(*) >= 3",
    "authorize_actions": "SELECT event_id, CASE WHEN event_type = 'error' THEN 'DENIED' WHEN user_id % 5 = 0 THEN 'ALLOWED' WHEN user_id % 5 = 1 THEN CASE WHEN event_type = 'view' THEN 'DENIED' ELSE 'ALLOWED' END WHEN user_id % 5 = 2 THEN CASE WHEN event_type = 'purchase' THEN 'DENIED' ELSE 'ALLOWED' END ELSE 'DENIED' END AS verdict FROM events",
    "scope_check": f"WITH {DOCUMENTS_SQL} SELECT event_id AS request_id, CASE WHEN d.document_id IS NULL THEN 'NOT_FOUND' WHEN event_id % 4 = 0 OR event_id % 25 = d.case_id THEN 'OK' ELSE 'DENIED' END AS verdict FROM events LEFT JOIN (FROM docs WHERE document_id % 3 <> 0) d ON user_id = d.document_id",
    "denied_events": f"""WITH {DOCUMENTS_SQL}, e AS (SELECT event_id AS id, user_id % 5 AS r, (['Admin', ' investigator', 'AUDITOR', 'guest', 'unknown'])[user_id % 5 + 1] AS role, CASE event_type WHEN 'view' THEN 'ledger:view' WHEN 'purchase' THEN 'case:delete' WHEN 'error' THEN 'no:such' ELSE 'case:view' END AS p FROM events)
SELECT id, 'AUTHORIZATION_DENIED' AS event_type, 'WARNING' AS severity, p AS resource, 'role=' || role || '; required=' || p AS detail FROM e WHERE p = 'no:such' OR r > 2 OR (r = 1 AND p = 'ledger:view') OR (r = 2 AND p = 'case:delete')
UNION ALL SELECT event_id, 'EVIDENCE_ACCESS_DENIED', 'WARNING', user_id::VARCHAR, 'requested case_id=' || (event_id % 25) || '; document case_id=' || d.case_id FROM events JOIN docs d ON user_id = document_id AND document_id % 3 <> 0 WHERE event_id % 4 <> 0 AND event_id % 25 <> d.case_id""",
    "newest_security": f"WITH {LOG_SQL} SELECT id, username, action, ip FROM log WHERE action = 'error' ORDER BY id DESC LIMIT 100",
    "newest_blocks": f"WITH RECURSIVE {_CHAIN} SELECT id, chain_id, i::BIGINT AS block_index, block_hash FROM b ORDER BY id DESC LIMIT 100",
    "trailing_alerts": f"WITH {LOG_SQL}, c AS (SELECT id, ip, count(*) OVER (PARTITION BY ip ORDER BY epoch_us(ts) RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW) AS recent FROM log WHERE action = 'error') SELECT * FROM c WHERE recent >= 3",
    "rate_limit": f"WITH {LOG_SQL}, c AS (SELECT id, ip, count(*) OVER (PARTITION BY ip ORDER BY epoch_us(ts) RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW) AS recent FROM log) SELECT * FROM c WHERE recent >= 3",
    "security_overview": f"WITH {_INTEGRITY} SELECT count(*) AS integrity_total, count(*) FILTER (document_id % 6 < 2) AS verified, CASE WHEN count(*) = count(*) FILTER (document_id % 6 < 2) THEN 'SECURE' ELSE 'REVIEW' END AS state, (SELECT count(*) FROM events WHERE event_type = 'error') AS failed_logins, (SELECT count(*) FROM part WHERE p_partkey % 6 IN (2, 5)) AS blocked_files FROM integ",
    "top_logs": f"WITH {LOG_SQL} SELECT id, username, action FROM log ORDER BY id DESC LIMIT 100",
    "newest_documents": f"WITH {DOCUMENTS_SQL} SELECT document_id, case_id, filename FROM docs ORDER BY document_id DESC LIMIT 50",
    "csv_records": "SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE trim(o_orderpriority) END AS o_orderpriority, 'a \"quoted\", text ' || o_custkey AS note FROM orders",
    "document_metadata": """WITH o AS (SELECT o_orderkey % 3 AS file, o_orderkey AS k, '{"o_orderkey":"' || o_orderkey || '","o_orderpriority":"' || CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE o_orderpriority END || '"}' AS r FROM orders), n AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY k) AS i, count(*) OVER (PARTITION BY file) AS rows FROM o)
SELECT file, any_value(rows) AS rows, '[' || string_agg(r, ',' ORDER BY i) || ']' AS preview FROM n WHERE i <= 10 GROUP BY file""",
    "json_records": "SELECT user_id AS file, CASE WHEN user_id % 5 = 3 THEN 1 ELSE count(*) END::BIGINT AS records FROM events WHERE user_id % 5 < 4 GROUP BY user_id",
    "ingest_report": "SELECT user_id AS file, user_id % 5 <> 4 AS ok, CASE user_id % 5 WHEN 4 THEN 0 WHEN 3 THEN 1 ELSE count(*) END::BIGINT AS records, CASE user_id % 5 WHEN 4 THEN 0 WHEN 3 THEN 1 ELSE count(*) END::BIGINT AS entities, CASE WHEN user_id % 5 > 2 THEN 0 ELSE count(*) END::BIGINT AS relationships, 64 AS hash_length, CASE WHEN user_id % 5 = 4 THEN CASE WHEN user_id % 2 = 0 THEN 'not an object or an array of objects' ELSE 'not JSON' END END AS error FROM events GROUP BY user_id",
    "json_flatten": "WITH e AS (SELECT * FROM events WHERE user_id % 5 < 3), o AS (SELECT user_id, count(*) AS n FROM events WHERE user_id % 5 = 3 GROUP BY ALL) SELECT 'event_id' AS name, count(*) AS n, count(DISTINCT event_id) AS distinct_values FROM e UNION ALL SELECT 'event_type', count(event_type), count(DISTINCT event_type) FROM e UNION ALL SELECT 'more_value', count(value), count(DISTINCT value) FROM e UNION ALL SELECT 'more_in_raw', count(props), count(DISTINCT props) FROM e HAVING count(props) > 0 UNION ALL SELECT 'owner', count(*), count(DISTINCT user_id) FROM o HAVING count(*) > 0 UNION ALL SELECT 'n', count(*), count(DISTINCT n) FROM o HAVING count(*) > 0",
    "json_envelope": "WITH u AS (SELECT user_id AS file, count(*) AS n FROM events GROUP BY ALL) SELECT file, 'owner' AS name, file::VARCHAR AS value FROM u WHERE file % 5 IN (0, 3) UNION ALL SELECT file, 'kind', 'log' FROM u WHERE file % 5 = 0 UNION ALL SELECT file, 'kind', 'v1' FROM u WHERE file % 5 = 2 UNION ALL SELECT file, 'n', n::VARCHAR FROM u WHERE file % 5 = 3",
    "text_scan": r"SELECT conv_id % 6 AS part, sum(length(regexp_replace(text, '\s+', ' ', 'g')))::BIGINT AS chars FROM conversations GROUP BY ALL",
    "size_limit": "SELECT count(DISTINCT doc_id % 8) AS files, count(DISTINCT doc_id % 8) AS hashed FROM documents",
    "file_classify": "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '.csv' WHEN 1 THEN '.txt' WHEN 2 THEN '.exe' WHEN 3 THEN '.json' WHEN 4 THEN '.pdf' ELSE '' END AS extension, CASE p_partkey % 6 WHEN 0 THEN 'STRUCTURED' WHEN 3 THEN 'STRUCTURED' WHEN 1 THEN 'UNSTRUCTURED' WHEN 4 THEN 'UNSTRUCTURED' ELSE 'BLOCKED' END AS category FROM part",
    "table_sinks": f"WITH {a.ENTITIES_SQL} SELECT count(*) FILTER (case_id = 1) AS case_1, count(*) FILTER (case_id = 1) AS replaced, count(*) AS everything FROM entities",
    "scoped_scan": f"WITH {RELATIONSHIPS_SQL} SELECT 'case 7' AS scope, source, count(*) AS edges FROM rel WHERE case_id = 7 GROUP BY ALL UNION ALL SELECT 'all', source, count(*) FROM rel GROUP BY ALL",
    "file_counts": "WITH c AS (SELECT o_orderkey % 25 AS case_id, o_orderkey % 100 AS file, 'PHONE:' || (9000000000 + o_custkey % 200) AS a, 'PHONE:' || (9000000000 + (o_orderkey * 31) % 1000) AS b, strftime(o_orderdate, '%Y-%m-%d') || ' 20:40:00' AS ts FROM orders WHERE (o_custkey % 200) % 11 <> 0 AND ((o_orderkey * 31) % 1000) % 11 <> 0), e AS (SELECT file, count(DISTINCT k) AS entities FROM (SELECT file, unnest([a, b]) AS k FROM c) GROUP BY file), r AS (SELECT file, count(*) AS relationships FROM c GROUP BY file) SELECT * FROM e JOIN r USING (file)",
    "tumbling_activity": f"WITH {LOG_SQL} SELECT strftime(ts, '%Y-%m-%d') AS start, action, count(*) AS events FROM log GROUP BY ALL",
    "session_activity": f"WITH {LOG_SQL}, g AS (SELECT *, coalesce(ts - lag(ts) OVER w >= INTERVAL 6 HOUR, true) AS new FROM log WINDOW w AS (PARTITION BY username ORDER BY ts)), s AS (SELECT *, sum(new::INTEGER) OVER (PARTITION BY username ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, username, count(*) AS events FROM s GROUP BY username, k",
    "stream_dedup": f"WITH {RELATIONSHIPS_SQL} SELECT case_id, relation, count(*) AS edges FROM (SELECT DISTINCT case_id, source, target, relation, timestamp FROM rel) GROUP BY ALL",
    "stream_transfers": "WITH r AS (SELECT l_orderkey % 6 AS case_id, 'ACC' || l_suppkey AS a, 'ACC' || l_partkey AS b, l_shipdate AS t FROM lineitem), e AS (SELECT case_id, count(DISTINCT k) AS entities FROM (SELECT case_id, unnest([a, b]) AS k FROM r) GROUP BY case_id), x AS (SELECT case_id, count(*) AS edges FROM (SELECT DISTINCT case_id, a, b, t FROM r WHERE a <> b) GROUP BY case_id) SELECT * FROM e JOIN x USING (case_id)",
    "stream_ingest": "WITH c AS (SELECT o_orderkey % 25 AS case_id, o_orderkey % 100 AS file, 'PHONE:' || (9000000000 + o_custkey % 200) AS a, 'PHONE:' || (9000000000 + (o_orderkey * 31) % 1000) AS b, strftime(o_orderdate, '%Y-%m-%d') || ' 20:40:00' AS ts FROM orders WHERE (o_custkey % 200) % 11 <> 0 AND ((o_orderkey * 31) % 1000) % 11 <> 0), e AS (SELECT case_id, count(DISTINCT k) AS entities FROM (SELECT case_id, unnest([a, b]) AS k FROM c) GROUP BY case_id), r AS (SELECT case_id, count(*) AS edges FROM (SELECT DISTINCT case_id, a, b, ts FROM c WHERE a <> b) GROUP BY case_id) SELECT * FROM e JOIN r USING (case_id)",
}

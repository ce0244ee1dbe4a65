"""Evidence integrity, hash-linked ledgers, audit trails and permissions."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.operators import registers
from caseflow.operators.work import cut

# fixed values: permissions of each role, role aliases, and audit actions of documents
PERMISSIONS = {
    "Admin": ("case:view", "case:create", "case:delete", "evidence:view", "evidence:ingest", "evidence:verify", "entity:view", "entity:photo", "graph:view", "assistant:query", "security:view", "ledger:view", "ledger:verify"),
    "Investigator": ("case:view", "case:create", "case:delete", "evidence:view", "evidence:ingest", "evidence:verify", "entity:view", "entity:photo", "graph:view", "assistant:query"),
    "Auditor": ("case:view", "evidence:view", "evidence:verify", "entity:view", "graph:view", "security:view", "ledger:view", "ledger:verify"),
}
ROLE_ALIASES = {"admin": "Admin", "administrator": "Admin", "investigator": "Investigator", "auditor": "Auditor"}
BY_ID = ("EVIDENCE_DOWNLOADED", "EVIDENCE_INTEGRITY_CHECK", "EVIDENCE_ACCESS_DENIED", "EVIDENCE_ACCESS_REJECTED")
BY_NAME = ("EVIDENCE_INGESTED", "EVIDENCE_INGEST_FAILED", "LEGACY_EVIDENCE_FINGERPRINTED")
GENESIS = "GENESIS"
#: Stands for what a block's body gets later.
MARK = "5f2c0e6b9d7a4c1e8b3fd0a617c25e94"


def iso_micros(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def block_body(created_at: Column, event_type: Column, index: Column, payload: Column, previous: Column) -> Column:
    """Canonical JSON of a block; ``payload`` is canonical JSON itself."""
    q = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, r'(["\\])', r"\\$1"), F.lit('"'))
    return F.concat(F.lit('{"created_at":'), q(created_at), F.lit(',"event_type":'), q(event_type), F.lit(',"index":'), index.cast("string"), F.lit(',"payload":'), payload, F.lit(',"previous_hash":'), q(previous), F.lit("}"))


def append_blocks(events: DataFrame) -> DataFrame:
    """(chain_id, block_index, id, event_type, payload, created_at, previous_hash, block_hash).

    events: (chain_id, id, ts, event_type, payload). A chain is read in order of id by one task, since each hash needs the one before; only the last
    hash and index are held. Chains run in parallel, so a chain should be a case or a user.
    """
    created = iso_micros(F.col("ts")).alias("created_at")
    rows = events.select("chain_id", "id", created, "event_type", "payload")
    mark = F.lit(MARK)
    body = F.split(block_body(F.col("created_at"), F.col("event_type"), mark, mark, mark), MARK)
    parts = rows.select("*", body[0].alias("head"), F.concat(body[1], "payload", body[2]).alias("middle"), body[3].alias("tail"))

    def run(batches):
        chain, index, last = (), 0, GENESIS
        for b in batches:
            out = []
            for c, head, middle, tail in zip(*(b.column(n).to_pylist() for n in ("chain_id", "head", "middle", "tail")), strict=True):
                if (c,) != chain:
                    chain, index, last = (c,), 0, GENESIS
                before = last
                known = None not in (head, middle, tail, before)
                last = hashlib.sha256(f"{head}{index}{middle}{before}{tail}".encode()).hexdigest() if known else None
                out.append((index, before, last))
                index += 1
            found = [pa.array([o[k] for o in out], t) for k, t in ((0, pa.int32()), (1, pa.string()), (2, pa.string()))]
            kept = [b.column(n) for n in ("chain_id", "id", "event_type", "payload", "created_at")]
            yield pa.record_batch([kept[0], found[0], *kept[1:], *found[1:]], names=names)

    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    names = ["chain_id", "block_index", "id", "event_type", "payload", "created_at", "previous_hash", "block_hash"]
    schema = ", ".join(f"{n} {kind.get(n, 'int' if n == 'block_index' else 'string')}" for n in names)
    order = ["chain_id", "id", "created_at", "event_type", "payload"]
    return parts.repartition("chain_id").sortWithinPartitions(*order).mapInArrow(run, schema)


def audit_blocks(audit: DataFrame):
    """(blocks, security events) of audit rows (id, ts, username, action, resource, severity): every row becomes a block of its user's chain, and those with a severity a security event too."""
    named = F.to_json(F.struct(F.col("action"), F.col("id").alias("audit_id"), F.col("resource"), F.col("severity")), {"ignoreNullFields": "false"})
    blocks = append_blocks(audit.select(F.col("username").alias("chain_id"), "id", "ts", F.lit("AUDIT_EVENT").alias("event_type"), named.alias("payload")))
    return blocks, audit.filter("severity IS NOT NULL").select("id", "ts", "username", "action", "resource", "severity")


def verify_chains(blocks: DataFrame) -> DataFrame:
    """(chain_id, valid, checked_blocks, first_bad): dense indexes, links and hashes of every chain; all hashes are recomputed in parallel."""
    w = Window.partitionBy("chain_id").orderBy("block_index")
    own = F.sha2(block_body(F.col("created_at"), F.col("event_type"), F.col("block_index"), F.col("payload"), F.col("previous_hash")), 256)
    ok = (F.row_number().over(w) - 1 == F.col("block_index")) & (F.lag("block_hash", 1, GENESIS).over(w) == F.col("previous_hash")) & (own == F.col("block_hash"))
    marked = blocks.withColumn("bad", F.when(~ok, F.col("block_index")))
    return marked.groupBy("chain_id").agg(F.min("bad").alias("first_bad"), F.count("*").alias("n")).select("chain_id", F.col("first_bad").isNull().alias("valid"), F.when(F.col("first_bad").isNull(), F.col("n")).otherwise(F.col("first_bad") + 1).cast("long").alias("checked_blocks"), "first_bad")


def chain_heads(blocks: DataFrame) -> DataFrame:
    """(chain_id, block_index, block_hash) of each chain's last block."""
    return blocks.groupBy("chain_id").agg(F.max(F.struct("block_index", "block_hash")).alias("h")).select("chain_id", "h.block_index", "h.block_hash")


#: Children of a node of the tree over chain heads.
FAN = 16


def head_hash() -> Column:
    """A leaf: the hash of a chain's name, length and head, null where one of them is null."""
    named = F.to_json(F.struct(F.col("block_hash"), F.col("block_index"), F.col("chain_id")), {"ignoreNullFields": "false"})
    return F.when(F.col("chain_id").isNotNull() & F.col("block_index").isNotNull() & F.col("block_hash").isNotNull(), F.sha2(named, 256))


def seal(heads: DataFrame, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """(root, proofs) of a hash tree over chain heads (chain_id, block_index, block_hash) in order of chain_id, one row a chain.

    root: one row (chains, levels, root), none without heads; proofs: (chain_id, place from 0, leaf, path), where path holds for each level, from the leaves up, the
    hashes under the common parent (``fan`` at most). A parent is the hash of its children's hashes, one after the other. Heads without a name, a length or a hash have no
    leaf and take no part. Places come from sampled ranges, a level is one grouping by place and a ``fan``-th of the size of the level below.
    """
    leaves = heads.withColumn("leaf", head_hash()).filter("leaf IS NOT NULL").select(F.lit(0).alias("tree"), "chain_id", "leaf")
    leaves = cut(registers.places(leaves, "tree", F.asc("chain_id")).select("chain_id", "leaf", (F.col("place") - 1).cast("long").alias("place")))
    n = leaves.count()
    level, size, levels = leaves.select("place", F.col("leaf").alias("hash")), n, 0
    proofs = leaves.select("chain_id", "place", "leaf", F.col("place").alias("at"), F.array().cast("array<array<string>>").alias("path"))
    while size > 1:
        above = F.floor(F.col("place") / fan)
        groups = level.groupBy(above.alias("up")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "hash"))), lambda x: x["hash"]).alias("hashes"))
        groups = cut(groups)
        proofs = cut(proofs.withColumn("at", F.floor(F.col("at") / fan)).join(groups, F.col("at") == F.col("up")).withColumn("path", F.concat("path", F.array("hashes"))).drop("up", "hashes"))
        level = groups.select(F.col("up").alias("place"), F.sha2(F.array_join("hashes", ""), 256).alias("hash"))
        size, levels = -(-size // fan), levels + 1
    root = level.select(F.lit(n).cast("long").alias("chains"), F.lit(levels).alias("levels"), F.col("hash").alias("root"))
    return root, proofs.drop("at")


def check_seal(heads: DataFrame, proofs: DataFrame, root: DataFrame, fan: int = FAN) -> DataFrame:
    """(chain_id, sealed): is the head of a chain, as it is now, the one under the root? Each chain is checked alone, from its head, its proof and the root's row.

    A chain without a proof, with a head that has no leaf, with a proof that does not lead to the root, or whose proof names another place or number of levels is not
    sealed; neither is a chain with a proof but without a head any more, nor any chain under an empty root. Unlike ``verify_chains`` this finds a chain that was written anew as a whole.
    """
    now = heads.select("chain_id", head_hash().alias("now"))
    both = now.join(proofs.select("chain_id", "place", "path"), "chain_id", "full")
    top = root.select("chains", "levels", "root").first() or (0, 0, None)
    chains, levels, top = (F.lit(x) for x in top)

    def climb(state, hashes):
        slot = F.get(hashes, F.pmod(state["at"], F.lit(fan)).cast("int"))
        ok = state["ok"] & F.coalesce(slot == state["hash"], F.lit(False))
        return F.struct(ok.alias("ok"), F.floor(state["at"] / fan).alias("at"), F.sha2(F.array_join(hashes, ""), 256).alias("hash"))

    start = F.struct(F.lit(True).alias("ok"), F.col("place").alias("at"), F.col("now").alias("hash"))
    end = F.aggregate("path", start, climb)
    led = end["ok"] & (end["at"] == 0) & (end["hash"] == top) & (F.size("path") == levels) & (F.col("place") < chains)
    return both.select("chain_id", F.coalesce(led, F.lit(False)).alias("sealed"))


def fingerprints(files: DataFrame) -> DataFrame:
    """(path, sha256, size) of binary files (path, content)."""
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("size"))


def verify_evidence(integrity: DataFrame, current: DataFrame) -> DataFrame:
    """(document_id, status): VERIFIED, TAMPERED, MISSING or INVALID_PATH from stored and present fingerprints."""
    now = current.select(F.col("document_id").alias("d"), F.col("sha256").alias("now"))
    status = F.when(F.col("stored_path").isNull(), "INVALID_PATH").when(F.col("now").isNull(), "MISSING").when(F.col("now") == F.col("sha256"), "VERIFIED").otherwise("TAMPERED")
    return integrity.join(now, F.col("document_id") == F.col("d"), "left").select("document_id", status.alias("status"))


def missing_fingerprints(documents: DataFrame, integrity: DataFrame) -> DataFrame:
    return documents.join(integrity.select("document_id"), "document_id", "left_anti")


def backfill_fingerprints(documents: DataFrame, integrity: DataFrame, stored: DataFrame) -> DataFrame:
    """Integrity rows (document_id, sha256, size, stored_path, status) for documents that have none, hashed from their files (document_id, path, content).

    A document without a file gets a row without a hash, with status MISSING.
    """
    lost = missing_fingerprints(documents, integrity).select("document_id")
    hashed = stored.select("document_id", F.col("path").alias("stored_path"), F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("size"))
    return lost.join(hashed, "document_id", "left").select("document_id", "sha256", "size", "stored_path", F.when(F.col("sha256").isNull(), "MISSING").otherwise("VERIFIED").alias("status"))


def audit_trail(documents: DataFrame, audit: DataFrame) -> DataFrame:
    """(document_id, audit_id): events of a document by its id, or by its filename unless the detail names another case."""
    by_id = documents.select("document_id", F.col("document_id").cast("string").alias("resource")).join(audit.filter(F.col("action").isin(*BY_ID)), "resource").select("document_id", F.col("id").alias("audit_id"))
    named = documents.filter("trim(coalesce(filename, '')) <> ''").select("document_id", "case_id", F.col("filename").alias("resource")).join(audit.filter(F.col("action").isin(*BY_NAME)), "resource")
    detail = F.coalesce("detail", F.lit(""))
    elsewhere = F.contains(detail, F.lit("case_id=")) & ~F.contains(detail, F.concat(F.lit("case_id="), F.col("case_id").cast("string"), F.lit(";")))
    return by_id.unionByName(named.filter(~elsewhere).select("document_id", F.col("id").alias("audit_id"))).distinct()


def anchors(audit: DataFrame, blocks: DataFrame) -> DataFrame:
    """(audit_id, block_index, block_hash): the first AUDIT_EVENT block whose payload names the audit event."""
    b = blocks.filter("event_type = 'AUDIT_EVENT'").select(F.get_json_object("payload", "$.audit_id").try_cast("long").alias("audit_id"), "block_index", "block_hash")
    first = b.groupBy("audit_id").agg(F.min_by(F.struct("block_index", "block_hash"), "block_index").alias("b"))
    return audit.select(F.col("id").alias("audit_id")).join(first, "audit_id", "left").select("audit_id", "b.block_index", "b.block_hash")


def authorize(actions: DataFrame) -> DataFrame:
    """``actions`` (role, permission, ...) with verdict ALLOWED or DENIED; unknown roles and permissions are denied."""
    role = F.lower(F.trim(F.coalesce("role", F.lit(""))))
    allowed = F.create_map(*[x for alias, name in ROLE_ALIASES.items() for x in (F.lit(alias), F.array(*[F.lit(p) for p in PERMISSIONS[name]]))])
    ok = F.coalesce(F.array_contains(F.try_element_at(allowed, role), F.col("permission")), F.lit(False))
    return actions.withColumn("verdict", F.when(ok, "ALLOWED").otherwise("DENIED"))


def scope_check(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """``requests`` (request_id, document_id, case_id) with OK, DENIED (another case's document) or NOT_FOUND."""
    d = documents.select("document_id", F.col("case_id").alias("owner"))
    verdict = F.when(F.col("owner").isNull(), "NOT_FOUND").when(F.col("case_id").isNull() | (F.col("case_id") == F.col("owner")), "OK").otherwise("DENIED")
    return requests.join(d, "document_id", "left").select("request_id", verdict.alias("verdict"))


def denied_actions(actions: DataFrame) -> DataFrame:
    """Security events of the denied rows of ``actions`` (id, role, permission, and what else ``authorize`` passes on): (id, event_type, severity, resource, detail)."""
    role = F.coalesce(F.nullif("role", F.lit("")), F.lit("unknown"))
    detail = F.concat(F.lit("role="), role, F.lit("; required="), F.coalesce("permission", F.lit("")))
    return authorize(actions).filter("verdict = 'DENIED'").select("id", F.lit("AUTHORIZATION_DENIED").alias("event_type"), F.lit("WARNING").alias("severity"), F.coalesce("permission", F.lit("")).alias("resource"), detail.alias("detail"))


def denied_requests(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """Security events of the requests (request_id, document_id, case_id) for another case's documents: (id, event_type, severity, resource, detail)."""
    denied = scope_check(requests, documents).filter("verdict = 'DENIED'").select("request_id")
    rows = requests.join(denied, "request_id", "left_semi").join(documents.select("document_id", F.col("case_id").alias("owner")), "document_id")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    detail = F.concat(F.lit("requested case_id="), text("case_id"), F.lit("; document case_id="), text("owner"))
    return rows.select(F.col("request_id").alias("id"), F.lit("EVIDENCE_ACCESS_DENIED").alias("event_type"), F.lit("WARNING").alias("severity"), F.col("document_id").cast("string").alias("resource"), detail.alias("detail"))


def rate_limited(failures: DataFrame, limit: int = 5, seconds: int = 300) -> DataFrame:
    """Failures (ip, ts, id) that are the ``limit``-th or a later one of their ip in less than ``seconds``."""
    w = Window.partitionBy("ip").orderBy(F.unix_micros("ts")).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return failures.withColumn("recent", F.count("*").over(w)).filter(F.col("recent") >= limit)


def provenance(documents: DataFrame, integrity: DataFrame, trail: DataFrame) -> DataFrame:
    """(document_id, steps): case, document, storage, hash, integrity and audit steps, each (step, status, detail)."""
    n = trail.groupBy("document_id").agg(F.count("*").alias("events"))
    d = documents.join(integrity.select("document_id", "sha256", "status", "stored_path"), "document_id", "left").join(n, "document_id", "left")
    step = lambda name, detail, status=None: F.struct(F.lit(name).alias("step"), (F.when(F.col(detail).isNotNull(), "OK").otherwise("MISSING") if status is None else status).alias("status"), F.col(detail).cast("string").alias("detail"))
    steps = F.array(step("CASE", "case_id"), step("DOCUMENT", "filename", F.lit("OK")), step("STORAGE", "stored_path"), step("HASH", "sha256"), step("INTEGRITY", "status", F.coalesce("status", F.lit("NOT_CHECKED"))), step("AUDIT", "events"))
    return d.select("document_id", steps.alias("steps"))


def document_register(documents: DataFrame, cases: DataFrame, integrity: DataFrame, chunks: DataFrame, newest: int = 50) -> DataFrame:
    """The ``newest`` documents with case reference, integrity status, and whether they have chunks in the index."""
    d = documents.orderBy(F.desc("document_id")).limit(newest).select("document_id", "case_id", "filename")
    indexed = chunks.select("document_id").distinct().withColumn("indexed", F.lit(True))
    out = d.join(cases.select("case_id", "reference_id"), "case_id", "left").join(integrity.select("document_id", "status"), "document_id", "left").join(indexed, "document_id", "left")
    return out.select("document_id", "filename", "reference_id", F.coalesce("status", F.lit("NOT_CHECKED")).alias("status"), F.coalesce("indexed", F.lit(False)).alias("rag_indexed"))

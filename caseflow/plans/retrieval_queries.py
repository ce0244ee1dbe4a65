"""Registered queries: chunks, embeddings, retrieval and questions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from caseflow.operators import retrieval as r
from caseflow.operators.ranked import nearest
from caseflow.plans import adapters as a
from caseflow.operators.work import cut, spread
from caseflow.plans.adapters import CHUNKS_SQL, DOCUMENTS_SQL, ENTITIES_SQL, QUESTIONS_SQL, RELATIONSHIPS_SQL
from caseflow.plans.graph_queries import _BAND, _SCORED, scored

_SMALL = "abcdefghijklmnopqrstuvwxyz"
_STOP = "[" + ", ".join(f"'{w}'" for w in r.STOP_WORDS) + "]"


def sliding_chunks(spark, sf):
    c = r.sliding_chunks(a.documents(spark, sf))
    return c.groupBy("document_id").agg(F.count("*").alias("chunks"), F.sum(F.length("chunk")).alias("chars"), F.max(F.md5(F.col("chunk").cast("binary"))).alias("digest"))


def paragraph_chunks(spark, sf):
    """Chunks of 500 characters of the documents' lines, with blank lines between them."""
    d = a.documents(spark, sf).withColumn("content", F.replace("content", F.lit("\n"), F.lit("\n\n")))
    return r.paragraph_chunks(d).select("document_id", "chunk_index", F.length("chunk").alias("chars"), F.md5(F.col("chunk").cast("binary")).alias("digest"))


def structured_chunks(spark, sf):
    e = a.table(spark, sf, "events")
    return r.structured_chunks(e, F.lit("events.csv"), F.col("event_id") + 1, ["event_id", "user_id", "event_type", "props"]).select("event_id", "chunk")


def _chunks(spark, sf):
    # room for 1,000 million chunks of a document
    c = r.sliding_chunks(spread(a.documents(spark, sf)))
    return c.select((F.col("document_id") * 1_000_000_000 + F.col("chunk_index")).alias("chunk_id"), "document_id", "case_id", "chunk_index", "chunk")



def hash_embedding(spark, sf):
    q = a.questions(spark, sf)
    v = r.hash_vectors(q, "question_id", "question")
    return v.select("question_id", F.posexplode("v").alias("idx", "u")).filter("u <> 0")


def hybrid_retrieval(spark, sf):
    return r.hybrid_retrieval(a.questions(spark, sf), _chunks(spark, sf))


def evidence_gate(spark, sf):
    return r.evidence_gate(hybrid_retrieval(spark, sf)).select("question_id", "place", "chunk_id", "score")


def grounded_context(spark, sf):
    q, c, e, rels = _asked(spark, sf), _chunks(spark, sf), a.entities(spark, sf), a.relationships(spark, sf)
    hits = cut(r.hybrid_retrieval(q, c))
    found = r.assistant_mentions(q, e, hits.join(c.select("chunk_id", "chunk"), "chunk_id"))
    out = r.grounded_context(q, r.evidence_gate(hits), c, a.documents(spark, sf), found, scored(spark, sf), rels)
    join = lambda col, f: F.array_join(F.transform(col, f), ",")
    return out.select("question_id", "mode", "confidence", join("sources", lambda s: F.concat_ws("/", s.filename, s.section.cast("string"))).alias("sources"), join("entities", lambda x: F.concat_ws("=", x.key, F.coalesce(x.band, F.lit("-")))).alias("entities"), join("edges", lambda x: x.id).alias("edges"))


def _asked(spark, sf):
    """The questions; two thirds name a customer of their case, by key or by name, and some a file."""
    q, n = a.questions(spark, sf), F.col("question_id")
    e = a.entities(spark, sf).filter("label = 'Person'").withColumn("m", F.row_number().over(Window.partitionBy("case_id").orderBy("id")) - 1)
    size = e.groupBy("case_id").agg(F.count("*").alias("size"))
    q = q.join(F.broadcast(size), "case_id", "left").withColumn("m", F.pmod(n.cast("long"), F.coalesce("size", F.lit(1)))).join(e.select("case_id", "m", "key", "name"), ["case_id", "m"], "left")
    text = F.when(n % 5 == 0, F.concat("question", F.lit(" "), F.lower(F.coalesce("key", F.lit(""))))).when(n % 5 == 1, F.concat(F.lit("about "), F.coalesce("name", F.lit("")), F.lit(": "), "question"))
    text = text.when(n % 5 == 2, F.concat(F.lit("what is in doc_"), F.col("case_id").cast("string"), F.lit(".txt?"))).otherwise(F.col("question"))
    return q.select("question_id", "case_id", text.alias("question"))


_ASKED = """people AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY id) - 1 AS m, count(*) OVER (PARTITION BY case_id) AS size FROM entities WHERE label = 'Person'), sizes AS (SELECT case_id, max(size) AS size FROM people GROUP BY case_id),
asked AS (SELECT question_id, q.case_id, CASE question_id % 5 WHEN 0 THEN question || ' ' || lower(coalesce(key, '')) WHEN 1 THEN 'about ' || coalesce(name, '') || ': ' || question WHEN 2 THEN 'what is in doc_' || q.case_id || '.txt?' ELSE question END AS question
 FROM questions q LEFT JOIN sizes s ON s.case_id = q.case_id LEFT JOIN people p ON p.case_id = q.case_id AND p.m = question_id % coalesce(s.size, 1))"""


def assistant_mentions(spark, sf):
    q, c = _asked(spark, sf), _chunks(spark, sf)
    # to have the fallback found as well, some chunks end in a customer's name
    hits = r.hybrid_retrieval(q, c).join(c.select("chunk_id", "chunk"), "chunk_id")
    hits = hits.withColumn("chunk", F.concat("chunk", F.lit(" customer#"), F.format_string("%09d", F.col("chunk_id") % 150)))
    return r.assistant_mentions(q, a.entities(spark, sf), hits)


def assistant_answers(spark, sf):
    return r.answers(_cued(_asked(spark, sf)), a.entities(spark, sf), a.documents(spark, sf), _typed(a.relationships(spark, sf)), scored(spark, sf))


def _cued(q):
    """Every third question begins with the cue of an intent."""
    cue = F.element_at(F.array(*[F.lit(v) for v in ("Give a  SUMMARY of ", "who has the Most  Connections in ", "phone calls about ", "bank activity of ")]), (F.col("question_id") % 4 + 1).cast("int"))
    return q.withColumn("question", F.when(F.col("question_id") % 3 == 0, F.concat(cue, "question")).otherwise(F.col("question")))


def _typed(rels):
    """Accepted goods as calls, returned ones as transfers."""
    kind = F.when(F.col("relation") == "ACCEPTED_FROM", "CALL_MADE_TO").when(F.col("relation") == "RETURNED_TO", "TRANSFERRED_FUNDS_TO").otherwise(F.col("relation"))
    return rels.withColumn("relation", kind)


def keyword_search(spark, sf):
    return r.keyword_search(a.questions(spark, sf), a.documents(spark, sf))


def intent(spark, sf):
    q = a.questions(spark, sf)
    cue = F.element_at(F.array(*[F.lit(v) for v in ("", "Give a  SUMMARY of ", "who has the Most  Connections in ", "phone calls about ", "bank activity of ")]), (F.col("question_id") % 5 + 1).cast("int"))
    named, filed = F.col("question_id") % 7 == 0, F.col("question_id") % 7 == 1
    return q.select("question_id", r.intent(F.concat(cue, "question"), named, filed).alias("intent"))


def question_guard(spark, sf):
    q = a.questions(spark, sf)
    odd = q.withColumn("question", F.when(F.col("question_id") % 7 == 0, " \n").otherwise(F.col("question"))).withColumn("case_id", F.when(F.col("question_id") % 5 == 0, F.lit(None)).when(F.col("question_id") % 5 == 1, 999).otherwise(F.col("case_id")))
    return r.question_guard(odd, a.cases(spark, sf))


def question_dedup(spark, sf):
    """The questions and, again in capitals with blanks around them, a third of them."""
    q = a.questions(spark, sf)
    again = q.filter("question_id % 3 = 0").select((F.col("question_id") + 1_000_000_000_000).alias("question_id"), "case_id", F.concat(F.lit(" "), F.translate("question", _SMALL, _SMALL.upper()), F.lit("\n")).alias("question"))
    return r.question_dedup(q.unionByName(again))


def question_mentions(spark, sf):
    q = a.questions(spark, sf)
    e = a.entities(spark, sf)
    asked = q.withColumn("question", F.when(F.col("question_id") % 3 == 0, F.concat(F.col("question"), F.lit(" customer:"), (F.col("question_id") % 150).cast("string"))).otherwise(F.concat(F.lit("supplier "), "question")))
    return r.mention_counts(asked, e)


def edge_subset(spark, sf):
    keys = a.entities(spark, sf).filter("id % 9 = 0").select("case_id", "key")
    return r.edge_subset(a.relationships(spark, sf), keys).select("id", "case_id", "source", "target")


def index_missing(spark, sf):
    d = a.documents(spark, sf)
    return d.join(_chunks(spark, sf).filter("document_id % 4 <> 0").select("document_id").distinct(), "document_id", "left_anti").select("document_id", "filename")


def index_refresh(spark, sf):
    c = _chunks(spark, sf).select("document_id", "chunk_index", F.length("chunk").alias("n"))
    new = c.filter("document_id % 3 = 0").withColumn("n", F.lit(-1))
    return r.refresh_index(c, new).groupBy("document_id").agg(F.count("*").alias("chunks"), F.sum("n").alias("n"))


def cosine_topk(spark, sf):
    """Each tenth vector's three nearest vectors of its label, by cosine of whole-number vectors."""
    e = a.table(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000)).alias("v"))
    q = e.filter("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "label", "v")
    return nearest(q, e, 3)


def first_by_ordinal(spark, sf):
    e = a.table(spark, sf, "events")
    return e.groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("first_type"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event"))


def positions(spark, sf):
    d = a.table(spark, sf, "documents")
    return d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("doc_id", "pos", F.length("line").alias("n"))


QUERIES = {f.__name__: f for f in (assistant_mentions, assistant_answers, sliding_chunks, paragraph_chunks, structured_chunks, hash_embedding, hybrid_retrieval, evidence_gate, grounded_context, keyword_search, intent, question_guard, question_dedup, question_mentions, edge_subset, index_missing, index_refresh, cosine_topk, first_by_ordinal, positions)}

_WS = "chr(32) || chr(9) || chr(10) || chr(13)"


def _vec(name: str, source: str, key: str, text: str) -> str:
    return f"""{name}_t AS (SELECT {key}, token, count(*) AS n FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+')) AS token FROM {source}) GROUP BY ALL),
{name}_p AS (SELECT token, token AS p, 2 AS w FROM (SELECT DISTINCT token FROM {name}_t) UNION ALL SELECT token, substr(token, i, 3), 1 FROM (SELECT token, unnest(range(1, length(token) - 1)) AS i FROM (SELECT DISTINCT token FROM {name}_t)) UNION ALL SELECT token, substr(token, i, 4), 1 FROM (SELECT token, unnest(range(1, length(token) - 2)) AS i FROM (SELECT DISTINCT token FROM {name}_t))),
{name}_h AS (SELECT token, w, ('0x' || substr(md5(p), 1, 8))::BIGINT AS h FROM {name}_p),
{name}_v AS (SELECT {key}, (h % 128)::INTEGER AS idx, sum(n * w * CASE WHEN (h & 16) <> 0 THEN 1 ELSE -1 END)::BIGINT AS u FROM {name}_t JOIN {name}_h USING (token) GROUP BY ALL HAVING u <> 0)"""


def _hybrid(source: str) -> str:
    return f"""{RELATIONSHIPS_SQL}, {ENTITIES_SQL}, {QUESTIONS_SQL}, {_ASKED}, {DOCUMENTS_SQL}, {CHUNKS_SQL}, {_vec('q', source, 'question_id', 'question')}, {_vec('c', 'chunks', 'chunk_id', 'chunk')},
qn AS (SELECT question_id, sum(u * u)::DOUBLE AS n FROM q_v GROUP BY ALL), cn AS (SELECT chunk_id, sum(u * u)::DOUBLE AS n FROM c_v GROUP BY ALL),
qw AS (SELECT question_id, list_distinct(list_filter(regexp_extract_all(lower(question), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+'), lambda w: length(w) >= 3 AND NOT list_contains({_STOP}, w))) AS words FROM {source}),
dots AS (SELECT question_id, chunk_id, sum(q_v.u * c_v.u)::DOUBLE AS d FROM {source} JOIN chunks USING (case_id) JOIN q_v USING (question_id) JOIN c_v USING (chunk_id, idx) GROUP BY ALL),
pairs AS (SELECT question_id, chunk_id, len(list_filter(words, lambda w: contains(lower(chunk), w))) AS hits FROM {source} JOIN chunks USING (case_id) JOIN qw USING (question_id)),
sc AS (SELECT question_id, chunk_id, hits::INTEGER AS hits, floor(greatest(0.0::DOUBLE, coalesce(d, 0) / sqrt(qn.n * cn.n) + least(0.3::DOUBLE, hits / 10.0::DOUBLE)) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS score FROM pairs LEFT JOIN dots USING (question_id, chunk_id) JOIN qn USING (question_id) JOIN cn USING (chunk_id)),
hy AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id)::INTEGER AS rank FROM sc QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) <= 4),
gate AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rank)::INTEGER AS place FROM hy WHERE (hits > 0 AND score >= 0.12) OR score >= 0.40 QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY rank) <= 3)"""


_HYBRID, _ASKED_HYBRID = _hybrid("questions"), _hybrid("asked")
# phrases of a text: whose name or key it contains, by least lengths; then the fallback to retrieved chunks
_MENTIONS = """direct AS (SELECT DISTINCT question_id, q.case_id, key FROM asked q JOIN entities e ON q.case_id = e.case_id AND ((length(name) >= 3 AND contains(lower(question), lower(name))) OR (length(key) >= 4 AND contains(lower(question), lower(key))))),
tops AS (SELECT hy.question_id, a.case_id, lower(chunk {suffix}) AS text FROM hy JOIN asked a USING (question_id) JOIN chunks c USING (chunk_id) WHERE hy.rank <= 2 AND question_id NOT IN (SELECT question_id FROM direct)),
mentions AS (SELECT * FROM direct UNION SELECT DISTINCT question_id, t.case_id, key FROM tops t JOIN entities e ON t.case_id = e.case_id AND ((length(name) >= 4 AND contains(text, lower(name))) OR (length(key) >= 5 AND contains(text, lower(key)))))"""

ORACLE_SQL = {
    "assistant_mentions": f"WITH {_ASKED_HYBRID}, {_MENTIONS.format(suffix="|| ' customer#' || printf('%09d', chunk_id % 150)")} SELECT * FROM mentions",
    "assistant_answers": f"""WITH {RELATIONSHIPS_SQL}, {_SCORED}, {ENTITIES_SQL}, {QUESTIONS_SQL}, {_ASKED}, {DOCUMENTS_SQL},
cued AS (SELECT question_id, case_id, CASE WHEN question_id % 3 = 0 THEN (['Give a  SUMMARY of ', 'who has the Most  Connections in ', 'phone calls about ', 'bank activity of '])[question_id % 4 + 1] ELSE '' END || question AS question FROM asked),
nm AS (SELECT DISTINCT question_id, q.case_id, key FROM cued q JOIN entities e ON q.case_id = e.case_id AND (contains(lower(question), lower(name)) OR contains(lower(question), lower(key)))),
fl AS (SELECT DISTINCT question_id, filename FROM cued q JOIN docs d ON q.case_id = d.case_id AND contains(lower(question), lower(filename))),
x AS (SELECT question_id, case_id, question, regexp_replace(lower(question), '[ \t\n\r]+', ' ', 'g') AS q FROM cued),
i AS (SELECT question_id, case_id, question, CASE """
    + " ".join("WHEN " + " OR ".join(f"contains(q, '{c}')" for c in cues) + f" THEN '{name}'" for name, cues in r.INTENTS)
    + """ WHEN question_id IN (SELECT question_id FROM nm) THEN 'ENTITY' WHEN question_id IN (SELECT question_id FROM fl) THEN 'DOCUMENT' ELSE 'SEARCH' END AS intent FROM x),
shown AS (SELECT case_id, source || ' -> ' || target AS item, CASE relation WHEN 'ACCEPTED_FROM' THEN 'CALL_MADE_TO' WHEN 'RETURNED_TO' THEN 'TRANSFERRED_FUNDS_TO' ELSE relation END AS relation, timestamp, id FROM rel),
deg AS (SELECT case_id, key, count(*) AS degree FROM (SELECT case_id, unnest([source, target]) AS key FROM rel) GROUP BY ALL),
rows AS (SELECT 'SUMMARY' AS intent, case_id, 1 AS place, 'entities' AS item, count(*)::VARCHAR AS value FROM (SELECT case_id, key FROM members UNION SELECT case_id, key FROM entities) GROUP BY ALL
UNION ALL SELECT 'SUMMARY', case_id, 2, 'relationships', count(*)::VARCHAR FROM rel GROUP BY ALL UNION ALL SELECT 'SUMMARY', case_id, 3, 'documents', count(*)::VARCHAR FROM docs GROUP BY ALL
UNION ALL SELECT 'MOST_CONNECTED', case_id, row_number() OVER (PARTITION BY case_id ORDER BY degree DESC, key), key, degree::VARCHAR FROM deg
UNION ALL SELECT 'COMMUNICATION', case_id, row_number() OVER (PARTITION BY case_id ORDER BY timestamp DESC, id), item, relation FROM shown WHERE relation = 'CALL_MADE_TO'
UNION ALL SELECT 'FINANCIAL', case_id, row_number() OVER (PARTITION BY case_id ORDER BY timestamp DESC, id), item, relation FROM shown WHERE relation = 'TRANSFERRED_FUNDS_TO'),
w AS (SELECT question_id, case_id, list_filter(regexp_extract_all(lower(question), '[a-z0-9]+'), lambda w: length(w) >= 3) AS words FROM i WHERE intent = 'SEARCH'),
s AS (SELECT question_id, document_id, filename, len(list_filter(words, lambda w: contains(lower(content), w))) AS score FROM w JOIN docs USING (case_id)),
o AS (SELECT question_id, intent, place, item, value FROM i JOIN rows USING (intent, case_id)
UNION ALL SELECT question_id, 'ENTITY', row_number() OVER (PARTITION BY question_id ORDER BY score DESC NULLS LAST, nm.key), nm.key, score::VARCHAR FROM nm JOIN i USING (question_id) LEFT JOIN scored s ON s.case_id = nm.case_id AND s.key = nm.key WHERE intent = 'ENTITY'
UNION ALL SELECT question_id, 'DOCUMENT', row_number() OVER (PARTITION BY question_id ORDER BY filename), filename, NULL FROM fl JOIN i USING (question_id) WHERE intent = 'DOCUMENT'
UNION ALL SELECT question_id, 'SEARCH', row_number() OVER (PARTITION BY question_id ORDER BY score DESC, document_id), filename, score::VARCHAR FROM s WHERE score > 0)
SELECT question_id, intent, place::INTEGER AS place, item, value FROM o WHERE place <= 5""".replace("{{", "{"),
    "sliding_chunks": f"WITH {DOCUMENTS_SQL}, t AS (SELECT document_id, trim(content, {_WS}) AS t FROM docs), c AS (SELECT document_id, trim(substr(t, i, 500), {_WS}) AS chunk FROM (SELECT *, unnest(range(1, greatest(length(t), 1) + 1, 400)) AS i FROM t)) SELECT document_id, count(*) AS chunks, sum(length(chunk))::BIGINT AS chars, max(md5(chunk)) AS digest FROM c WHERE chunk <> '' GROUP BY ALL",
    "paragraph_chunks": f"""WITH RECURSIVE {DOCUMENTS_SQL}, p AS (SELECT document_id, list_filter(list_transform(string_split(trim(replace(content, chr(10), chr(10) || chr(10)), {_WS}), chr(10) || chr(10)), lambda x: trim(x, {_WS})), lambda x: x <> '') AS ps FROM docs),
st AS (SELECT document_id, ps, 1::BIGINT AS i, 0 AS c, length(ps[1])::BIGINT + 2 AS n FROM p WHERE len(ps) > 0
UNION ALL SELECT document_id, ps, i + 1, CASE WHEN n + length(ps[i + 1]) > 500 THEN c + 1 ELSE c END, CASE WHEN n + length(ps[i + 1]) > 500 THEN length(ps[i + 1]) ELSE n + length(ps[i + 1]) + 2 END FROM st WHERE i < len(ps)),
o AS (SELECT document_id, c AS chunk_index, string_agg(ps[i], chr(10) || chr(10) ORDER BY i) AS chunk FROM st GROUP BY ALL) SELECT document_id, chunk_index, length(chunk)::INTEGER AS chars, md5(chunk) AS digest FROM o""",
    "structured_chunks": "SELECT event_id, '[Evidence: events.csv | Row ' || (event_id + 1) || '] ' || concat_ws(' | ', 'event_id: ' || event_id, 'user_id: ' || user_id, 'event_type: ' || event_type, 'props: ' || props) AS chunk FROM events",
    "hash_embedding": f"WITH {QUESTIONS_SQL}, {_vec('q', 'questions', 'question_id', 'question')} SELECT question_id, idx, u FROM q_v",
    "hybrid_retrieval": f"WITH {_HYBRID} SELECT question_id, rank, chunk_id, hits, score FROM hy",
    "evidence_gate": f"WITH {_HYBRID} SELECT question_id, place, chunk_id, score FROM gate",
    "grounded_context": f"""WITH {_ASKED_HYBRID}, {_SCORED}, {_MENTIONS.format(suffix="")},
src AS (SELECT question_id, string_agg(filename || '/' || (chunk_index + 1), ',' ORDER BY place) AS sources FROM gate JOIN chunks USING (chunk_id) JOIN docs USING (document_id) GROUP BY ALL),
ent AS (SELECT question_id, string_agg(m.key || '=' || CASE WHEN score IS NULL THEN '-' ELSE {_BAND} END, ',' ORDER BY m.key) AS entities FROM mentions m LEFT JOIN scored s ON s.case_id = m.case_id AND s.key = m.key GROUP BY ALL),
touch AS (SELECT DISTINCT question_id, r.id FROM mentions m JOIN rel r ON r.case_id = m.case_id AND r.source = m.key UNION SELECT DISTINCT question_id, r.id FROM mentions m JOIN rel r ON r.case_id = m.case_id AND r.target = m.key),
ed AS (SELECT question_id, string_agg(id, ',' ORDER BY id) AS edges FROM (SELECT * FROM touch QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY id) <= 15) GROUP BY ALL)
SELECT q.question_id, CASE WHEN sources IS NULL THEN 'NO_EVIDENCE' ELSE 'GROUNDED' END AS mode, CASE WHEN sources IS NULL THEN 0.5 ELSE 0.85 END::DOUBLE AS confidence, sources, CASE WHEN sources IS NULL THEN '' ELSE coalesce(entities, '') END AS entities, CASE WHEN sources IS NULL THEN '' ELSE coalesce(edges, '') END AS edges
FROM asked q LEFT JOIN src USING (question_id) LEFT JOIN ent USING (question_id) LEFT JOIN ed USING (question_id)""",
    "keyword_search": f"WITH {QUESTIONS_SQL}, {DOCUMENTS_SQL}, q AS (SELECT question_id, case_id, list_filter(regexp_extract_all(lower(question), '[a-z0-9]+'), lambda w: length(w) >= 3) AS words FROM questions), s AS (SELECT question_id, document_id, len(list_filter(words, lambda w: contains(lower(content), w)))::INTEGER AS score FROM q JOIN docs USING (case_id)) SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, document_id)::INTEGER AS rank, document_id, score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY score DESC, document_id) <= 5",
    "intent": f"WITH {QUESTIONS_SQL}, x AS (SELECT question_id, regexp_replace(lower((['', 'Give a  SUMMARY of ', 'who has the Most  Connections in ', 'phone calls about ', 'bank activity of '])[question_id % 5 + 1] || question), '\\s+', ' ', 'g') AS q FROM questions) SELECT question_id, CASE "
    + " ".join("WHEN " + " OR ".join(f"contains(q, '{c}')" for c in cues) + f" THEN '{name}'" for name, cues in r.INTENTS)
    + " WHEN question_id % 7 = 0 THEN 'ENTITY' WHEN question_id % 7 = 1 THEN 'DOCUMENT' ELSE 'SEARCH' END AS intent FROM x",
    "question_guard": f"WITH {QUESTIONS_SQL} SELECT question_id, CASE WHEN question_id % 7 = 0 THEN 'EMPTY' WHEN question_id % 5 = 0 THEN 'NO_CASE' WHEN question_id % 5 = 1 THEN 'UNKNOWN_CASE' ELSE 'OK' END AS mode FROM questions",
    "question_dedup": f"WITH {QUESTIONS_SQL} SELECT question_id, min(question_id) OVER (PARTITION BY case_id, trim(lower(question), {_WS})) AS answer_id FROM (SELECT question_id, case_id, question FROM questions UNION ALL SELECT question_id + 1000000000000, case_id, translate(question, '{_SMALL}', '{_SMALL.upper()}') FROM questions WHERE question_id % 3 = 0)",
    "question_mentions": f"""WITH {QUESTIONS_SQL}, {ENTITIES_SQL}, e AS (SELECT * FROM entities), q AS (SELECT question_id, case_id, lower(CASE WHEN question_id % 3 = 0 THEN question || ' customer:' || (question_id % 150) ELSE 'supplier ' || question END) AS q FROM questions),
x AS (SELECT question_id, key FROM q JOIN e USING (case_id) WHERE contains(q, lower(name)) OR contains(q, lower(key))), l AS (SELECT * FROM q WHERE question_id NOT IN (SELECT question_id FROM x)),
a AS (SELECT question_id, case_id, unnest(regexp_extract_all(q, '[\\p{{L}}\\p{{N}}\\p{{M}}_]+')) AS w FROM l), b AS (SELECT case_id, key, unnest(regexp_extract_all(lower(name), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+')) AS w FROM e),
m AS (SELECT * FROM x UNION SELECT question_id, key FROM a JOIN b USING (case_id, w) WHERE length(w) >= 4) SELECT question_id, count(*) AS entities, min(key) AS first_key FROM m GROUP BY ALL""",
    "edge_subset": f"WITH {RELATIONSHIPS_SQL}, {ENTITIES_SQL}, k AS (SELECT case_id, key FROM entities WHERE id % 9 = 0) SELECT DISTINCT id, case_id, source, target FROM rel WHERE (case_id, source) IN (SELECT (case_id, key) FROM k) OR (case_id, target) IN (SELECT (case_id, key) FROM k)",
    "index_missing": f"WITH {DOCUMENTS_SQL}, {CHUNKS_SQL} SELECT document_id, filename FROM docs WHERE document_id NOT IN (SELECT document_id FROM chunks WHERE document_id % 4 <> 0)",
    "index_refresh": f"WITH {DOCUMENTS_SQL}, {CHUNKS_SQL} SELECT document_id, count(*) AS chunks, sum(CASE WHEN document_id % 3 = 0 THEN -1 ELSE length(chunk) END)::BIGINT AS n FROM chunks GROUP BY ALL",
    "cosine_topk": "WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 1000)) AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, e.vec_id, floor(list_dot_product(q.v, e.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(e.v, e.v)) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE AS score FROM e q JOIN e USING (label) WHERE q.vec_id % 10 = 0 AND q.vec_id <> e.vec_id) SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 3",
    "first_by_ordinal": "SELECT user_id, arg_min(event_type, (ts, event_id)) AS first_type, arg_max(event_id, (ts, event_id)) AS last_event FROM events GROUP BY user_id",
    "positions": "SELECT doc_id, (i - 1)::INTEGER AS pos, length(lines[i])::INTEGER AS n FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))",
}

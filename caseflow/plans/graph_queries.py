"""Registered queries: case graphs, risk and portfolio figures on the trade graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from caseflow.functions import text as t
from caseflow.operators import cascade, extract, graph, portfolio, registers, retrieval, risk
from caseflow.operators.work import cut
from caseflow.plans import adapters as a
from caseflow.plans.adapters import CASES_SQL, CHUNKS_SQL, DOCUMENTS_SQL, ENTITIES_SQL, RELATIONSHIPS_SQL

_ADJ = "adj AS (SELECT case_id, source AS key, target AS other, relation, id FROM rel UNION ALL SELECT case_id, target, source, relation, id FROM rel)"
_MEMBERS = "members AS (SELECT DISTINCT case_id, unnest([source, target]) AS key FROM rel)"


def _factor(value: str, weight: float, sat: float) -> str:
    n = f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, coalesce(({value})::DOUBLE / {sat}::DOUBLE, 0)))"
    return f"floor({n} * {weight * 100}::DOUBLE * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE"


_REACH = f"""{_ADJ}, {_MEMBERS}, step AS (SELECT DISTINCT case_id, key AS a, other AS b FROM adj),
r2 AS (SELECT DISTINCT x.case_id, x.a, y.b FROM step x JOIN step y ON x.case_id = y.case_id AND x.b = y.a WHERE x.a <> y.b),
r3 AS (SELECT DISTINCT x.case_id, x.a, y.b FROM r2 x JOIN step y ON x.case_id = y.case_id AND x.b = y.a WHERE x.a <> y.b),
reach AS (SELECT case_id, a AS key, b AS reached FROM step UNION SELECT case_id, a, b FROM r2 UNION SELECT case_id, a, b FROM r3)"""
_POINTS = f"""pts AS (SELECT *, {_factor('degree', 0.25, 8.0)} AS p1, {_factor('counterparties', 0.20, 5.0)} AS p2, {_factor('repeats', 0.15, 4.0)} AS p3,
  {_factor('reach::DOUBLE / (peers - 1)', 0.20, 0.6)} AS p4, {_factor('relation_types', 0.10, 4.0)} AS p5, {_factor('exposure / peak', 0.10, 0.75)} AS p6 FROM base),
scored AS (SELECT *, floor((p1 + p2 + p3 + p4 + p5 + p6) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS score FROM pts)"""


def _scored_sql(peers: str) -> str:
    """The scores of all ``peers`` (a SQL table all_members), connected or not; the points as in ``_SCORED``."""
    return f"""{_REACH}, {peers},
con AS (SELECT case_id, key, count(*) AS degree, count(DISTINCT other) AS counterparties, count(DISTINCT replace(upper(relation), ' ', '_')) AS relation_types FROM adj GROUP BY ALL),
expo AS (SELECT case_id, key, sum(abs(amount)::DECIMAL(28,2))::DOUBLE AS exposure FROM (SELECT case_id, unnest([source, target]) AS key, amount FROM rel) GROUP BY ALL),
cnt AS (SELECT case_id, key, count(*) AS reach FROM reach GROUP BY ALL),
base AS (SELECT m.case_id, m.key, coalesce(degree, 0) AS degree, coalesce(counterparties, 0) AS counterparties, coalesce(relation_types, 0) AS relation_types, greatest(0, coalesce(degree - counterparties, 0)) AS repeats, coalesce(reach, 0) AS reach, coalesce(exposure, 0) AS exposure,
  count(*) OVER (PARTITION BY m.case_id) AS peers, max(exposure) OVER (PARTITION BY m.case_id) AS peak
  FROM all_members m LEFT JOIN con USING (case_id, key) LEFT JOIN cnt USING (case_id, key) LEFT JOIN expo USING (case_id, key)),
{_POINTS}"""


_SCORED = _scored_sql("all_members AS (SELECT case_id, key FROM members)")
_DELETED = f"""{ENTITIES_SQL}, e2 AS (SELECT id, key, CASE WHEN label = 'Organization' AND id % 5 = 0 THEN NULL ELSE case_id END AS case_id FROM entities), dead AS (SELECT n_nationkey::BIGINT AS case_id FROM nation WHERE n_nationkey % 5 = 2),
kept_ends AS (SELECT DISTINCT unnest([source, target]) AS key FROM rel WHERE case_id NOT IN (FROM dead)), dead_ends AS (SELECT DISTINCT unnest([source, target]) AS key FROM rel WHERE case_id IN (FROM dead)),
gone AS (SELECT id FROM e2 WHERE key NOT IN (FROM kept_ends) AND (case_id IN (FROM dead) OR (case_id IS NULL AND key IN (FROM dead_ends))))"""
_BAND = "CASE WHEN score >= 85 THEN 'CRITICAL' WHEN score >= 70 THEN 'HIGH' WHEN score >= 40 THEN 'MODERATE' ELSE 'LOW' END"


def scored(spark, sf):
    return risk.entity_risk(a.relationships(spark, sf))


def case_membership(spark, sf):
    return graph.members(a.relationships(spark, sf))


def entity_degree(spark, sf):
    return graph.degrees(a.relationships(spark, sf))


def connectivity(spark, sf):
    return graph.connectivity(graph.adjacency(a.relationships(spark, sf)))


def adjacency(spark, sf):
    return graph.adjacency(a.relationships(spark, sf)).select("case_id", "key", "other", "id")


def exposure(spark, sf):
    return risk.exposure(a.relationships(spark, sf))


def reach_3hop(spark, sf):
    return graph.reach_counts(graph.adjacency(a.relationships(spark, sf)))


def entity_risk(spark, sf):
    return scored(spark, sf).select("case_id", "key", "degree", "counterparties", "repeats", "relation_types", "reach", "score", "band")


def refreshed_risk(spark, sf):
    """Risk kept up to date while edges arrive: scores of most edges, then two batches of later ones, a case in three at a time."""
    rels = cut(a.relationships(spark, sf))
    batch = F.when(F.pmod(F.xxhash64("source"), F.lit(40)) == 0, F.col("case_id") % 3).otherwise(0)
    have = rels.filter(batch == 0)
    out = risk.entity_risk(have, graph.members(have))
    for k in (1, 2):
        new = rels.filter(batch == k)
        have = have.unionByName(new)
        out = risk.refresh(out, have, graph.members(have), new)
    return out.select("case_id", "key", "degree", "counterparties", "repeats", "relation_types", "reach", "score", "band")


def risk_leaderboard(spark, sf):
    return risk.leaderboard(scored(spark, sf), k=10).select("case_id", "rank", "key", "score", "band")


def leaderboard_sorts(spark, sf):
    """All four orders, with and without a bucket."""
    named = _sorted(scored(spark, sf), a.entities(spark, sf))
    out = None
    for sort in ("riskDesc", "riskAsc", "relsDesc", "nameAsc"):
        for bucket in (None, "HIGH", "MODERATE", "LOW"):
            part = risk.leaderboard(named, sort, bucket, 5).select(F.lit(sort).alias("sort"), F.lit(bucket or "ALL").alias("bucket"), "case_id", "rank", "key")
            out = part if out is None else out.unionByName(part)
    return out


def _sorted(s, e):
    from caseflow.operators.work import cut

    # read sixteen times, so written once
    return cut(s.join(e.select("key", "name"), "key").select("case_id", "key", "name", "score", "degree"))


def case_risk(spark, sf):
    rels = a.relationships(spark, sf)
    return risk.case_risk(rels, risk.entity_risk(rels, graph.members(rels))).select("case_id", "entities", "linked_entities", "internal_edges", "score", "band")


def risk_report(spark, sf):
    """Case reports with membership edges apart and the declared label beside the computed band."""
    rels, e = a.relationships(spark, sf), a.entities(spark, sf)
    member = extract.backbone(e.select(F.col("case_id").alias("file"), "key", "label"), rels.select(F.col("case_id").alias("file"), "source", "target", "relation"), F.format_string("CASE:CL-%03d", F.col("file")))
    both = rels.unionByName(member.select(F.col("file").alias("case_id"), "source", "target", "relation", F.lit(None).cast("string").alias("timestamp"), F.lit(None).cast("double").alias("amount"), F.concat_ws("-", F.lit("M"), "file", "source").alias("id")))
    declared = a.cases(spark, sf).withColumn("risk", F.element_at(F.array(F.lit("Low"), F.lit("Medium"), F.lit("High")), F.col("case_id").cast("int") % 3 + 1))
    _, out = risk.report(both, e, declared)
    return out.select("case_id", "declared", "entities", "linked_entities", "internal_edges", "investigative_edges", "membership_edges", "score", "band")


def stored_risk(spark, sf):
    return risk.stored_risk(a.entities(spark, sf), scored(spark, sf))


def high_risk_count(spark, sf):
    s = scored(spark, sf)
    return s.groupBy("case_id").agg(F.count_if(F.col("score") >= 70).alias("high_risk"), F.count("*").alias("entities"))


def relationship_endpoints(spark, sf):
    rels, e = a.relationships(spark, sf), a.entities(spark, sf)
    # some suppliers go by another key there, so their edges fall back to the key
    d = e.withColumn("key", F.when((F.col("label") == "Organization") & (F.col("id") % 2 == 1), F.concat("key", F.lit("?"))).otherwise(F.col("key")))
    return graph.with_endpoints(rels, d).select("id", "source_name", "source_label", "target_name", "target_label")


def dangling_edges(spark, sf):
    return graph.dangling(a.relationships(spark, sf), _renamed(a.entities(spark, sf))).select("id", "source", "target")


def _renamed(e):
    """The entities, a tenth of them under another key, so that their edges dangle."""
    return e.withColumn("key", F.when(F.col("id") % 10 == 3, F.concat("key", F.lit("?"))).otherwise(F.col("key")))


def top_connected(spark, sf):
    return graph.top_by_degree(a.relationships(spark, sf)).select("case_id", "rank", "key", "degree")


def graph_filter(spark, sf):
    e = a.entities(spark, sf)
    nodes = risk.stored_risk(e, scored(spark, sf)).join(e, "key")
    rels = a.relationships(spark, sf)
    nodes = nodes.drop("case_id").join(graph.members(rels), "key")
    _, edges = graph.filter_graph(nodes, rels, query="er#0", bucket="HIGH", relation="RETURNED_TO")
    return edges.select("id", "case_id", "source", "target")


def subgraph_by_relation(spark, sf):
    e = a.entities(spark, sf)
    e = e.unionByName(e.filter("label = 'Organization'").withColumn("label", F.lit("Person")))
    return graph.typed_subgraph(a.relationships(spark, sf), "RETURNED_TO", e, "Person").groupBy("case_id", "source", "target").agg(F.count("*").alias("edges"), F.sum(F.col("amount").cast("decimal(28,2)")).cast("double").alias("total"))


def property_graph_export(spark, sf):
    _, edges = graph.property_graph(a.entities(spark, sf), a.relationships(spark, sf))
    return edges


def current_case(spark, sf):
    e = a.entities(spark, sf).withColumn("label", F.when(F.col("id") % 7 == 0, "Incident").when(F.col("id") % 7 == 1, "Case").otherwise(F.col("label")))
    return graph.current_case(a.cases(spark, sf).filter("case_id % 3 = 0"), e, "#000000001")


def entity_dossier(spark, sf):
    out = graph.dossier(a.relationships(spark, sf), a.entities(spark, sf), scored(spark, sf))
    return out.select("case_id", "key", "name", F.array_join(F.transform("cases", lambda c: c.cast("string")), ",").alias("cases"), "connections", "outgoing", "degree", "score", "band", F.size("factors").cast("long").alias("factors"))


def connection_sort(spark, sf):
    out = graph.sorted_connections(a.relationships(spark, sf), a.entities(spark, sf))
    return out.select("case_id", "key", "place", F.lower("other_name").alias("name"), "relation", "timestamp", "direction", "amount")


def label_counts(spark, sf):
    rels, e = a.relationships(spark, sf), a.entities(spark, sf)
    return graph.members(rels).join(e.select("key", "label"), "key").groupBy("case_id", "label").agg(F.count("*").alias("entities"))


def shortest_path(spark, sf):
    """Paths between each case's first and last customers."""
    rels = a.relationships(spark, sf)
    ends = rels.groupBy("case_id").agg(F.min("source").alias("source"), F.max("source").alias("target"))
    pairs = ends.select(F.col("case_id").alias("pair_id"), "case_id", "source", "target")
    return graph.shortest_paths(pairs, rels, 5).select("pair_id", "hops", F.array_join("path", ">").alias("path"), F.array_join("relations", ">").alias("relations"))


def portfolio_rollup(spark, sf):
    rels = a.relationships(spark, sf)
    out = rels.rollup("case_id").agg(F.count("*").alias("edges"), F.count_distinct("source").alias("customers"), F.count_distinct("target").alias("suppliers"), F.sum(F.col("amount").cast("decimal(28,2)")).cast("double").alias("total"))
    return out


def portfolio_statistics(spark, sf):
    lab, log = a.table(spark, sf, "labels"), a.log_events(spark, sf)
    integrity = lab.select(F.col("doc_id").alias("document_id"), F.when(F.col("quality") == 1, "VERIFIED").otherwise("PENDING").alias("status"))
    action = F.when(F.col("action") == "error", "LOGIN_FAILED").otherwise(F.col("action"))
    blocks = log.filter("action <> 'view'").select("id")
    security = log.filter("action = 'error'").select("id")
    return portfolio.statistics(a.cases(spark, sf), scored(spark, sf), a.relationships(spark, sf), a.documents(spark, sf), integrity, blocks, security, log.withColumn("action", action))


def case_counts(spark, sf):
    return portfolio.case_counts(a.cases(spark, sf), a.documents(spark, sf), a.relationships(spark, sf), a.entities(spark, sf))


def entity_list(spark, sf):
    return portfolio.entity_list(a.entities(spark, sf), a.relationships(spark, sf), scored(spark, sf)).select("id", "key", "label", "name", "relationships", "risk", "band")


def backbone_edges(spark, sf):
    """Membership edges of all persons, and of the entities that no edge of the case touches."""
    rels, e = a.relationships(spark, sf), a.entities(spark, sf)
    batch = e.select(F.col("case_id").alias("file"), "key", "label"), rels.select(F.col("case_id").alias("file"), "source", "target", "relation")
    return extract.backbone(*batch, F.format_string("CASE:CL-%03d", F.col("file"))).withColumnRenamed("file", "case_id")


def case_nodes(spark, sf):
    c = a.cases(spark, sf)
    return extract.case_nodes(c.select(F.col("case_id").alias("file"), F.col("reference_id").alias("case_ref"), "title")).withColumnRenamed("file", "case_id")


def relationship_dedup(spark, sf):
    """The trade edges, some of them made self edges, without these and without repeats."""
    rels = a.relationships(spark, sf)
    rels = rels.withColumn("target", F.when(F.col("amount") % 10 < 1, F.col("source")).otherwise(F.col("target")))
    return graph.distinct_edges(rels).groupBy("case_id", "relation").agg(F.count("*").alias("edges"), F.min("id").alias("first_id"))


def endpoint_remap(spark, sf):
    """Endpoints renamed by a key map, self edges dropped, repeats merged."""
    rels = a.relationships(spark, sf)
    to = a.entities(spark, sf).filter("id % 3 = 0").select("key", F.concat(F.lit("E:"), (F.col("id") % 50).cast("string")).alias("to"))
    return graph.remap(rels, to)


def key_union(spark, sf):
    rels = a.relationships(spark, sf)
    # both ends in one pass, so the trades are joined once
    return rels.select(F.explode(F.array("source", "target")).alias("key")).distinct()


def orphan_entities(spark, sf):
    """Entities and case nodes, once the edges of every ninth customer are gone."""
    rels = a.relationships(spark, sf).filter("CAST(substring(source, 10) AS BIGINT) % 9 <> 0")
    nodes = a.cases(spark, sf).select(F.concat(F.lit("CASE:"), "reference_id").alias("key"))
    return registers.orphans(a.entities(spark, sf).select("key").unionByName(nodes), rels)


def key_intersection(spark, sf):
    rels = a.relationships(spark, sf)
    # each key once before it travels: an intersection sorts all rows of both sides
    return a.entities(spark, sf).select("key").intersect(rels.select(F.col("target").alias("key")).distinct())


def delete_case(spark, sf):
    """Rows of every table that are left when the solved cases go."""
    left = cascade.delete_cases(_case_tables(spark, sf), a.cases(spark, sf).filter("status = 'Solved'").select("case_id"))
    parts = [df.groupBy("case_id").agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), F.col("case_id").cast("long").alias("case_id"), "rows") for name, df in left.items()]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def deleted_entities(spark, sf):
    """Entities that go with the solved cases."""
    tables = _case_tables(spark, sf)
    left = cascade.delete_cases(tables, a.cases(spark, sf).filter("status = 'Solved'").select("case_id"))
    return tables["entities"].join(left["entities"].select("id"), "id", "left_anti").select("id", "key", "case_id")


def _case_tables(spark, sf):
    """All tables of the cases; suppliers of every fifth id have no case of their own, and edges of some small orders are missing, so that entities get loose."""
    d = a.documents(spark, sf)
    e = a.entities(spark, sf).withColumn("case_id", F.when((F.col("label") == "Organization") & (F.col("id") % 5 == 0), F.lit(None)).otherwise(F.col("case_id")))
    return {
        "cases": a.cases(spark, sf),
        "documents": d.select("document_id", "case_id", "filename"),
        "integrity": d.select("document_id", F.sha2("content", 256).alias("sha256")).join(d.select("document_id", "case_id"), "document_id"),
        "chunks": retrieval.sliding_chunks(d).select("document_id", "case_id", "chunk_index"),
        "relationships": a.relationships(spark, sf),
        "entities": e,
    }


def risk_bands(spark, sf):
    x = t.unit(F.col("o_totalprice") / 400000) * 100
    return a.table(spark, sf, "orders").select("o_orderkey", t.rounded(x, 2).alias("score")).withColumn("band", t.risk_band(F.col("score"))).groupBy("band").agg(F.count("*").alias("n"), F.max("score").alias("top"))


def entity_sort(spark, sf):
    """Each case's entities by name in base-letter collation."""
    return registers.sorted_entities(a.entities(spark, sf), "name").select("case_id", F.col("place").cast("int").alias("place"), "key")


def _table(spark, sf):
    """The entity table: risk of a case's members, number of edges, and a resolution status."""
    e = a.entities(spark, sf).join(scored(spark, sf).select("case_id", "key", F.col("score").alias("risk")), ["case_id", "key"], "left")
    e = e.join(graph.degrees(a.relationships(spark, sf)).withColumnRenamed("degree", "relationships"), ["case_id", "key"], "left")
    status = F.element_at(F.array(*[F.lit(x) for x in ("NEW_ENTITY", "EXACT_MATCH", "AMBIGUOUS")]), (F.col("id") % 3 + 1).cast("int"))
    return cut(e.withColumn("resolution_status", F.when(F.col("id") % 7 > 0, status)))


def entity_table_sorts(spark, sf):
    """The five sorts of the entity table, both ways: the first three places of each case."""
    e = _table(spark, sf)
    out = [registers.sorted_entities(e, sort, down).filter("place <= 3").select(F.lit(sort).alias("sort"), F.lit(down).alias("descending"), "case_id", F.col("place").cast("int").alias("place"), "key") for sort in registers.SORTS for down in (False, True)]
    return reduce(lambda x, y: x.unionByName(y), out)


def register_filters(spark, sf):
    """Rows of four registers that a text and a category leave."""
    cases, e, rels = a.cases(spark, sf), a.entities(spark, sf), a.relationships(spark, sf)
    d = a.documents(spark, sf).join(cases.select("case_id", F.col("reference_id").alias("case_reference")), "case_id", "left")
    d = d.withColumns({"file_extension": F.lit(".txt"), "data_category": F.lit("UNSTRUCTURED"), "doc_type": F.upper("source")})
    found = {
        "cases": registers.shown(cases, "cases", " IN", "open").select(F.col("case_id").cast("string").alias("row")), "entities": registers.shown(e, "entities", "#00000001", "PERSON").select(F.col("key").alias("row")),
        "relationships": registers.shown(graph.with_endpoints(rels, e), "relationships", "supplier#000000007").select(F.col("id").alias("row")), "documents": registers.shown(d, "documents", "cl-01", "TXT").select(F.col("document_id").cast("string").alias("row")),
    }
    return reduce(lambda x, y: x.unionByName(y), [df.select(F.lit(name).alias("register"), "row") for name, df in found.items()])


def graph_payload(spark, sf):
    nodes, _ = graph.payload(a.relationships(spark, sf), a.entities(spark, sf), scored(spark, sf))
    return nodes.select("case_id", "key", "label", "name", "risk", "band")


def graph_payload_edges(spark, sf):
    rels = a.relationships(spark, sf)
    _, edges = graph.payload(rels, a.entities(spark, sf), graph.members(rels).withColumns({"score": F.lit(0.0), "band": F.lit("LOW")}))
    return edges.select("case_id", "id", "source", "target", "label")


def case_tables(spark, sf):
    return a.cases(spark, sf).orderBy("case_id")


QUERIES = {f.__name__: f for f in (refreshed_risk, entity_table_sorts, register_filters, leaderboard_sorts, risk_report, case_nodes, deleted_entities, graph_payload_edges, case_membership, entity_degree, connectivity, adjacency, exposure, reach_3hop, entity_risk, risk_leaderboard, case_risk, stored_risk, high_risk_count, relationship_endpoints, dangling_edges, top_connected, graph_filter, subgraph_by_relation, property_graph_export, current_case, entity_dossier, connection_sort, label_counts, shortest_path, portfolio_rollup, portfolio_statistics, case_counts, entity_list, backbone_edges, relationship_dedup, endpoint_remap, key_union, orphan_entities, key_intersection, delete_case, risk_bands, entity_sort, graph_payload, case_tables)}

ORACLE_SQL = {
    "case_membership": f"WITH {RELATIONSHIPS_SQL}, {_MEMBERS} SELECT * FROM members",
    "entity_degree": f"WITH {RELATIONSHIPS_SQL} SELECT case_id, key, count(*) AS degree FROM (SELECT case_id, unnest([source, target]) AS key FROM rel) GROUP BY ALL",
    "connectivity": f"WITH {RELATIONSHIPS_SQL}, {_ADJ} SELECT case_id, key, count(*) AS degree, count(DISTINCT other) AS counterparties, count(DISTINCT relation) AS relation_types, greatest(0, count(*) - count(DISTINCT other))::BIGINT AS repeats FROM adj GROUP BY ALL",
    "adjacency": f"WITH {RELATIONSHIPS_SQL}, {_ADJ} SELECT case_id, key, other, id FROM adj",
    "exposure": f"WITH {RELATIONSHIPS_SQL}, s AS (SELECT case_id, key, sum(abs(amount)::DECIMAL(28,2)) AS e FROM (SELECT case_id, unnest([source, target]) AS key, amount FROM rel) GROUP BY ALL) SELECT case_id, key, e::DOUBLE AS exposure, (max(e) OVER (PARTITION BY case_id))::DOUBLE AS peak FROM s",
    "reach_3hop": f"WITH {RELATIONSHIPS_SQL}, {_REACH} SELECT case_id, key, count(*) AS reach FROM reach GROUP BY ALL",
    "refreshed_risk": f"WITH {RELATIONSHIPS_SQL}, {_SCORED} SELECT case_id, key, degree, counterparties, repeats::BIGINT AS repeats, relation_types, reach, score, {_BAND} AS band FROM scored",
    "entity_risk": f"WITH {RELATIONSHIPS_SQL}, {_SCORED} SELECT case_id, key, degree, counterparties, repeats::BIGINT AS repeats, relation_types, reach, score, {_BAND} AS band FROM scored",
    "risk_leaderboard": f"WITH {RELATIONSHIPS_SQL}, {_SCORED} SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, key)::INTEGER AS rank, key, score, {_BAND} AS band FROM scored QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY score DESC, key) <= 10",
    "case_risk": f"""WITH {RELATIONSHIPS_SQL}, {_SCORED}, g AS (SELECT case_id, count(*) AS entities, count(*) FILTER (degree > 0) AS linked_entities, max(score) AS top, sum(score::DECIMAL(28,2))::DOUBLE AS s FROM scored GROUP BY case_id),
i AS (SELECT case_id, count(*) AS internal_edges FROM rel GROUP BY case_id),
f AS (SELECT *, {_factor('top / 100', 0.40, 1.0)} + {_factor('internal_edges / (entities * (entities - 1) / 2)', 0.25, 0.10)} + {_factor('linked_entities / entities', 0.20, 1.0)} + {_factor('s / entities / 100', 0.15, 1.0)} AS sum FROM g JOIN i USING (case_id)),
r AS (SELECT *, floor(sum * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS score FROM f) SELECT case_id, entities, linked_entities, internal_edges, score, {_BAND} AS band FROM r""",
    "stored_risk": f"WITH {RELATIONSHIPS_SQL}, {_SCORED}, {ENTITIES_SQL} SELECT key, coalesce(max(score), 0)::DOUBLE AS risk FROM (SELECT DISTINCT key FROM entities) LEFT JOIN scored USING (key) GROUP BY key",
    "leaderboard_sorts": f"""WITH {RELATIONSHIPS_SQL}, {_SCORED}, {ENTITIES_SQL}, n AS (SELECT s.*, lower(name) AS nm FROM scored s JOIN entities e USING (key)),
b AS (SELECT n.*, bucket FROM n, (SELECT unnest(['ALL', 'HIGH', 'MODERATE', 'LOW']) AS bucket) WHERE bucket = 'ALL' OR bucket = CASE WHEN score >= 70 THEN 'HIGH' WHEN score >= 40 THEN 'MODERATE' ELSE 'LOW' END),
x AS (SELECT 'riskDesc' AS sort, bucket, case_id, row_number() OVER (PARTITION BY bucket, case_id ORDER BY score DESC, key) AS rank, key FROM b UNION ALL SELECT 'riskAsc', bucket, case_id, row_number() OVER (PARTITION BY bucket, case_id ORDER BY score, key), key FROM b
 UNION ALL SELECT 'relsDesc', bucket, case_id, row_number() OVER (PARTITION BY bucket, case_id ORDER BY degree DESC, key), key FROM b UNION ALL SELECT 'nameAsc', bucket, case_id, row_number() OVER (PARTITION BY bucket, case_id ORDER BY nm, key), key FROM b)
SELECT sort, bucket, case_id, rank::INTEGER AS rank, key FROM x WHERE rank <= 5""",
    "risk_report": f"""WITH {RELATIONSHIPS_SQL}, {ENTITIES_SQL}, {_scored_sql("all_members AS (SELECT case_id, key FROM members UNION SELECT case_id, key FROM entities)")},
g AS (SELECT case_id, count(*) AS entities, count(*) FILTER (degree > 0) AS linked_entities, max(score) AS top, sum(score::DECIMAL(28,2))::DOUBLE AS s FROM scored GROUP BY case_id),
i AS (SELECT case_id, count(*) AS internal_edges FROM rel GROUP BY case_id), mem AS (SELECT case_id, count(*) AS membership_edges FROM (SELECT DISTINCT case_id, key FROM entities WHERE label = 'Person' OR (case_id, key) NOT IN (SELECT (case_id, key) FROM members)) GROUP BY case_id),
f AS (SELECT *, {_factor('top / 100', 0.40, 1.0)} + {_factor('internal_edges / (entities * (entities - 1) / 2)', 0.25, 0.10)} + {_factor('linked_entities / entities', 0.20, 1.0)} + {_factor('s / entities / 100', 0.15, 1.0)} AS sum FROM g JOIN i USING (case_id) JOIN mem USING (case_id)),
r AS (SELECT *, floor(sum * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS score FROM f) SELECT n_nationkey::BIGINT AS case_id, (['Low', 'Medium', 'High'])[n_nationkey % 3 + 1] AS declared, coalesce(entities, 0)::BIGINT AS entities, coalesce(linked_entities, 0)::BIGINT AS linked_entities, coalesce(internal_edges, 0)::BIGINT AS internal_edges, coalesce(internal_edges, 0)::BIGINT AS investigative_edges, coalesce(membership_edges, 0)::BIGINT AS membership_edges, coalesce(score, 0)::DOUBLE AS score, CASE WHEN score IS NOT NULL THEN {_BAND} END AS band FROM nation LEFT JOIN r ON n_nationkey = case_id""",
    "case_nodes": f"WITH {CASES_SQL} SELECT case_id, 'CASE:' || reference_id AS key, 'Case' AS label, title AS name FROM cases",
    "deleted_entities": f"WITH {RELATIONSHIPS_SQL}, {_DELETED} SELECT id, key, case_id FROM e2 WHERE id IN (SELECT id FROM gone)",
    "graph_payload_edges": f"WITH {RELATIONSHIPS_SQL} SELECT case_id, id, source, target, concat_ws(' | ', replace(relation, '_', ' '), CASE WHEN amount <> 0 THEN format('{{:,.2f}}', amount) END, nullif(timestamp, '')) AS label FROM rel",
    "high_risk_count": f"WITH {RELATIONSHIPS_SQL}, {_SCORED} SELECT case_id, count(*) FILTER (score >= 70) AS high_risk, count(*) AS entities FROM scored GROUP BY case_id",
    "relationship_endpoints": f"WITH {RELATIONSHIPS_SQL}, {ENTITIES_SQL} SELECT rel.id, coalesce(s.name, source) AS source_name, coalesce(s.label, 'Entity') AS source_label, coalesce(t.name, target) AS target_name, coalesce(t.label, 'Entity') AS target_label FROM rel LEFT JOIN entities s ON source = s.key LEFT JOIN (FROM entities WHERE NOT (label = 'Organization' AND id % 2 = 1)) t ON target = t.key",
    "dangling_edges": f"WITH {RELATIONSHIPS_SQL}, {ENTITIES_SQL}, k AS (SELECT key FROM entities WHERE id % 10 <> 3) SELECT id, source, target FROM rel WHERE source NOT IN (FROM k) OR target NOT IN (FROM k)",
    "top_connected": f"WITH {RELATIONSHIPS_SQL}, d AS (SELECT case_id, key, count(*) AS degree FROM (SELECT case_id, unnest([source, target]) AS key FROM rel) GROUP BY ALL) SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY degree DESC, key)::INTEGER AS rank, key, degree FROM d QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY degree DESC, key) <= 10",
    "graph_filter": f"WITH {RELATIONSHIPS_SQL}, {_SCORED}, {ENTITIES_SQL}, n AS (SELECT m.case_id, e.key FROM entities e JOIN members m USING (key) JOIN (SELECT key, max(score) AS risk FROM scored GROUP BY key) s USING (key) WHERE (lower(name) LIKE '%er#0%' OR lower(e.key) LIKE '%er#0%' OR lower(label) LIKE '%er#0%') AND risk >= 70) SELECT id, case_id, source, target FROM rel WHERE relation = 'RETURNED_TO' AND (case_id, source) IN (SELECT (case_id, key) FROM n) AND (case_id, target) IN (SELECT (case_id, key) FROM n)",
    "subgraph_by_relation": f"WITH {RELATIONSHIPS_SQL} SELECT case_id, source, target, count(*) AS edges, sum(amount::DECIMAL(28,2))::DOUBLE AS total FROM rel WHERE relation = 'RETURNED_TO' GROUP BY ALL",
    "property_graph_export": f"WITH {RELATIONSHIPS_SQL} SELECT source, target, upper(regexp_replace(relation, '[^A-Za-z0-9_]', '_', 'g')) AS type, arg_max(timestamp, id) AS timestamp, arg_max(amount, id) AS amount FROM rel GROUP BY ALL",
    "current_case": f"WITH {CASES_SQL}, {ENTITIES_SQL}, x AS (SELECT case_id, 1 AS rank, 0 AS id, title AS name FROM cases WHERE case_id % 3 = 0 UNION ALL SELECT case_id, CASE WHEN id % 7 = 0 THEN 2 WHEN lower(name) LIKE '%#000000001%' THEN 3 ELSE 4 END, id, name FROM entities WHERE id % 7 < 2) SELECT case_id, rank::INTEGER AS rank, name FROM x QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY rank, id) = 1",
    "entity_dossier": f"WITH {RELATIONSHIPS_SQL}, {_SCORED}, {ENTITIES_SQL}, m AS (SELECT case_id, key FROM members UNION SELECT case_id, key FROM entities), h AS (SELECT key, string_agg(case_id::VARCHAR, ',' ORDER BY case_id) AS cases FROM m GROUP BY key), o AS (SELECT case_id, key, count(*) AS connections, count(*) FILTER (o = 1) AS outgoing FROM (SELECT case_id, source AS key, 1 AS o FROM rel UNION ALL SELECT case_id, target, 0 FROM rel) GROUP BY ALL) SELECT m.case_id, m.key, e.name, cases, coalesce(connections, 0)::BIGINT AS connections, coalesce(outgoing, 0)::BIGINT AS outgoing, coalesce(degree, 0)::BIGINT AS degree, score, CASE WHEN score IS NOT NULL THEN {_BAND} END AS band, CASE WHEN score IS NULL THEN NULL ELSE 6 END::BIGINT AS factors FROM m JOIN entities e USING (key) JOIN h USING (key) LEFT JOIN o ON o.case_id = m.case_id AND o.key = m.key LEFT JOIN scored s ON s.case_id = m.case_id AND s.key = m.key",
    "connection_sort": f"WITH {RELATIONSHIPS_SQL}, {ENTITIES_SQL}, b AS (SELECT case_id, source AS key, target AS other, relation, timestamp, 'OUTGOING' AS direction, amount FROM rel UNION ALL SELECT case_id, target, source, relation, timestamp, 'INCOMING', amount FROM rel) SELECT b.case_id, b.key, row_number() OVER (PARTITION BY b.case_id, b.key ORDER BY lower(name), relation, other, timestamp, direction, amount)::INTEGER AS place, lower(name) AS name, relation, timestamp, direction, amount FROM b JOIN entities e ON other = e.key",
    "label_counts": f"WITH {RELATIONSHIPS_SQL}, {_MEMBERS}, {ENTITIES_SQL} SELECT m.case_id, label, count(*) AS entities FROM members m JOIN entities e USING (key) GROUP BY ALL",
    "shortest_path": f"""WITH {RELATIONSHIPS_SQL}, {_ADJ}, step AS (SELECT case_id, key AS a, other AS b, arg_min(relation, id) AS via FROM adj GROUP BY ALL), ends AS (SELECT case_id, min(source) AS source, max(source) AS target FROM rel GROUP BY case_id),
h0 AS (SELECT case_id, source AS node, [source] AS path, []::VARCHAR[] AS bys FROM ends),
"""
    + ",\n".join(f"h{i} AS (SELECT h.case_id, b AS node, min(list_append(path, b)) AS path, arg_min(list_append(bys, via), list_append(path, b)) AS bys FROM h{i - 1} h JOIN step s ON h.case_id = s.case_id AND h.node = s.a GROUP BY ALL)" for i in range(1, 6))
    + """, found AS ("""
    + " UNION ALL ".join(f"SELECT {i} AS hops, case_id, node, path, bys FROM h{i}" for i in range(6))
    + """)
SELECT e.case_id AS pair_id, hops::BIGINT AS hops, array_to_string(path, '>') AS path, array_to_string(bys, '>') AS relations FROM ends e JOIN found f ON e.case_id = f.case_id AND f.node = e.target
QUALIFY row_number() OVER (PARTITION BY e.case_id ORDER BY hops) = 1""",
    "portfolio_rollup": f"WITH {RELATIONSHIPS_SQL} SELECT case_id, count(*) AS edges, count(DISTINCT source) AS customers, count(DISTINCT target) AS suppliers, sum(amount::DECIMAL(28,2))::DOUBLE AS total FROM rel GROUP BY ROLLUP (case_id)",
    "portfolio_statistics": f"WITH {RELATIONSHIPS_SQL}, {_SCORED}, {CASES_SQL} SELECT count(*) AS cases, count(*) FILTER (lower(status) IN ('open', 'active', 'pending')) AS active, count(*) FILTER (status = 'Solved') AS solved, count(*) FILTER (status = 'Pending') AS pending, (SELECT count(*) FROM (SELECT key FROM scored GROUP BY key HAVING max(score) >= 70)) AS high_risk, (SELECT count(*) FROM rel) AS leads, (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM labels WHERE quality = 1) AS verified, (SELECT count(*) FROM labels WHERE quality <> 1 OR quality IS NULL) AS unverified, (SELECT count(*) FROM events WHERE event_type <> 'view') AS ledger_blocks, (SELECT count(*) FROM events WHERE event_type = 'error') AS security_events, (SELECT count(*) FROM events WHERE event_type = 'error') AS failed_logins FROM cases",
    "case_counts": f"WITH {RELATIONSHIPS_SQL}, {_MEMBERS}, {ENTITIES_SQL}, {CASES_SQL} SELECT case_id, reference_id, (SELECT count(*) FROM documents WHERE doc_id % 25 = c.case_id) AS documents, (SELECT count(*) FROM rel r WHERE r.case_id = c.case_id) AS relationships, (SELECT count(*) FROM members m WHERE m.case_id = c.case_id) AS member_entities, (SELECT count(*) FROM entities e WHERE e.case_id = c.case_id) AS own_entities FROM cases c",
    "entity_list": f"WITH {RELATIONSHIPS_SQL}, {_SCORED}, {ENTITIES_SQL}, d AS (SELECT unnest([source, target]) AS key FROM rel), n AS (SELECT key, count(*) AS relationships FROM d GROUP BY key), s AS (SELECT key, max(score) AS score FROM scored GROUP BY key), x AS (SELECT id, key, label, name, coalesce(relationships, 0)::BIGINT AS relationships, coalesce(score, 0)::DOUBLE AS score FROM entities LEFT JOIN n USING (key) LEFT JOIN s USING (key)) SELECT id, key, label, name, relationships, score AS risk, {_BAND} AS band FROM x",
    "backbone_edges": f"WITH {RELATIONSHIPS_SQL}, {_MEMBERS}, {ENTITIES_SQL} SELECT DISTINCT case_id, key AS source, printf('CASE:CL-%03d', case_id) AS target, 'PART_OF_CASE' AS relation FROM entities WHERE label = 'Person' OR (case_id, key) NOT IN (SELECT (case_id, key) FROM members)",
    "relationship_dedup": f"WITH {RELATIONSHIPS_SQL} SELECT case_id, relation, count(*) AS edges, min(id) AS first_id FROM (SELECT case_id, source, target, relation, timestamp, min(id) AS id FROM rel WHERE NOT (amount % 10 < 1) GROUP BY ALL) GROUP BY ALL",
    "endpoint_remap": f"WITH {RELATIONSHIPS_SQL}, {ENTITIES_SQL}, m AS (SELECT key, 'E:' || (id % 50) AS t FROM entities WHERE id % 3 = 0), x AS (SELECT case_id, coalesce(s.t, source) AS source, coalesce(d.t, target) AS target, relation, timestamp FROM rel LEFT JOIN m s ON source = s.key LEFT JOIN m d ON target = d.key) SELECT DISTINCT * FROM x WHERE source <> target",
    "key_union": f"WITH {RELATIONSHIPS_SQL} SELECT source AS key FROM rel UNION SELECT target FROM rel",
    "orphan_entities": f"WITH {RELATIONSHIPS_SQL}, {ENTITIES_SQL}, left_ AS (SELECT * FROM rel WHERE substr(source, 10)::BIGINT % 9 <> 0) SELECT key FROM entities EXCEPT (SELECT source FROM left_ UNION SELECT target FROM left_)",
    "entity_table_sorts": f"""WITH {RELATIONSHIPS_SQL}, {_SCORED}, {ENTITIES_SQL}, deg AS (SELECT case_id, key, count(*) AS n FROM (SELECT case_id, unnest([source, target]) AS key FROM rel) GROUP BY ALL),
t AS (SELECT e.case_id, e.id, e.key, coalesce(score, 0) AS risk, coalesce(n, 0) AS relationships, lower(name) AS name, lower(label) AS type, CASE WHEN id % 7 > 0 THEN (['new_entity', 'exact_match', 'ambiguous'])[id % 3 + 1] ELSE '' END AS resolution FROM entities e LEFT JOIN scored s ON s.case_id = e.case_id AND s.key = e.key LEFT JOIN deg d ON d.case_id = e.case_id AND d.key = e.key),
p AS ("""
    + " UNION ALL ".join(f"SELECT '{c}' AS sort, {down} AS descending, case_id, row_number() OVER (PARTITION BY case_id ORDER BY {c} {'DESC' if down == 'true' else 'ASC'}, id) AS place, key FROM t" for c in ("risk", "relationships", "name", "type", "resolution") for down in ("false", "true"))
    + """) SELECT sort, descending, case_id, place::INTEGER AS place, key FROM p WHERE place <= 3""",
    "register_filters": f"""WITH {RELATIONSHIPS_SQL}, {CASES_SQL}, {ENTITIES_SQL}, {DOCUMENTS_SQL}
SELECT 'cases' AS register, case_id::VARCHAR AS row FROM cases WHERE (contains(lower(title), 'in') OR contains(lower(reference_id), 'in')) AND status = 'Open'
UNION ALL SELECT 'entities', key FROM entities WHERE contains(lower(name), '#00000001') AND label = 'Person'
UNION ALL SELECT 'relationships', r.id FROM rel r LEFT JOIN entities s ON s.key = r.source LEFT JOIN entities d ON d.key = r.target WHERE contains(lower(coalesce(s.name, r.source)), 'supplier#000000007') OR contains(lower(coalesce(d.name, r.target)), 'supplier#000000007')
UNION ALL SELECT 'documents', document_id::VARCHAR FROM docs LEFT JOIN cases USING (case_id) WHERE contains(lower(reference_id), 'cl-01')""",
    "key_intersection": f"WITH {RELATIONSHIPS_SQL}, {ENTITIES_SQL} SELECT key FROM entities INTERSECT SELECT target FROM rel",
    "delete_case": f"""WITH {RELATIONSHIPS_SQL}, {CASES_SQL}, {DOCUMENTS_SQL}, {CHUNKS_SQL}, {_DELETED}, k AS (SELECT case_id FROM cases WHERE status <> 'Solved')
SELECT 'cases' AS table, case_id, count(*) AS rows FROM k GROUP BY ALL UNION ALL SELECT 'documents', case_id, count(*) FROM docs JOIN k USING (case_id) GROUP BY ALL UNION ALL SELECT 'integrity', case_id, count(*) FROM docs JOIN k USING (case_id) GROUP BY ALL
UNION ALL SELECT 'chunks', case_id, count(*) FROM chunks JOIN k USING (case_id) GROUP BY ALL UNION ALL SELECT 'relationships', case_id, count(*) FROM rel JOIN k USING (case_id) GROUP BY ALL UNION ALL SELECT 'entities', case_id, count(*) FROM e2 WHERE id NOT IN (SELECT id FROM gone) GROUP BY ALL""",
    "risk_bands": f"WITH s AS (SELECT floor(least(1.0::DOUBLE, greatest(0.0::DOUBLE, o_totalprice / 400000)) * 100 * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS score FROM orders) SELECT {_BAND} AS band, count(*) AS n, max(score) AS top FROM s GROUP BY ALL",
    "entity_sort": f"WITH {ENTITIES_SQL} SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY lower(name), id)::INTEGER AS place, key FROM entities",
    "graph_payload": f"WITH {RELATIONSHIPS_SQL}, {_SCORED}, {ENTITIES_SQL}, m AS (SELECT case_id, key FROM members UNION SELECT case_id, key FROM entities) SELECT m.case_id, m.key, label, name, score AS risk, CASE WHEN score IS NOT NULL THEN {_BAND} END AS band FROM m JOIN entities e USING (key) LEFT JOIN scored s ON m.case_id = s.case_id AND m.key = s.key",
    "case_tables": f"WITH {CASES_SQL} SELECT * FROM cases",
}

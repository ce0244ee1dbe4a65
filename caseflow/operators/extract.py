"""Entities and relationships from records and from text.

Entities: (file, key, label, name, ordinal, ...), relationships: (file, source, target, relation, timestamp, amount).
All inputs hold many files at once; ``file`` may be any id column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.functions import text as t
from caseflow.functions.roles import Roles
from caseflow.operators.patterns import phrases_in

# fixed values: patterns of mentions and cues
PHONE = r"(?<!\d)(?:\+91[\s-]?)?[6-9]\d{9}(?!\d)"
VEHICLE = r"\b[A-Z]{2}\d{2}[A-Z]{1,3}\d{4}\b"
ACCOUNT = r"\b(?:ACC|A/C|ACCOUNT)[-_ ]?[A-Z0-9]{3,15}\b"
SENTENCE = r"(?<=[.!?])\s+"
CONTACT = r"(?i)\b(contacted|contact|called|spoke with|spoke to)\b"
SIGHTING = r"(?i)\b(observed near|observed at|seen near|seen at|saw .* near|saw .* at|seeing .* near|seeing .* at|sighted near|sighted at|reported near|reported at|located near|located at|associated with|present at)\b"
PERSON_SIGHTING = r"(?i)\b(seen near|seen at|saw .* near|saw .* at|seeing .* near|seeing .* at|observed near|observed at|located at|located near|present at|described as .* near|described as .* at)\b"
INCIDENT = r"(?i)\b(incident|occurred|reported)\b"



def first_wins(entities: DataFrame, by=("file", "key"), ordinal: str = "ordinal") -> DataFrame:
    """The first entity of every key, with its ordinal; attributes of later ones are dropped."""
    rest = [c for c in entities.columns if c not in by]
    return entities.groupBy(*by).agg(F.min_by(F.struct(*rest), ordinal).alias("e")).select(*by, "e.*")


def _col(df: DataFrame, name: str | None) -> Column:
    return t.clean(F.col(name)) if name else F.lit("")


def _ends(rows: DataFrame, label: str) -> DataFrame:
    """The two entities of every row (file, ordinal, a, b)."""
    pair = F.explode(F.array(F.struct((F.col("ordinal") * 2).alias("o"), F.col("a").alias("v")), F.struct((F.col("ordinal") * 2 + 1).alias("o"), F.col("b").alias("v"))))
    # values are merged as they stand first, by a plain minimum, so that keys are made and structs compared once a value
    e = rows.select("file", pair.alias("p")).groupBy("file", F.col("p.v").alias("name")).agg(F.min("p.o").alias("ordinal"))
    return first_wins(e.withColumns({"label": F.lit(label), "key": t.canonical_key(F.lit(label), F.col("name"))}))


def _timed(df: DataFrame, roles: Roles, date: str | None) -> Column:
    """The time column alone, or date and time joined where a date column is given."""
    return F.concat_ws(" ", F.nullif(_col(df, date), F.lit("")), F.nullif(_col(df, roles.time), F.lit(""))) if date and date != roles.time else _col(df, roles.time)


def calls(df: DataFrame, roles: Roles, date: str | None = None):
    """(entities, edges) of call records (file, ordinal, ...): one CALL_MADE_TO edge a row; rows without both numbers are skipped."""
    rows = df.select("file", "ordinal", _col(df, roles.source).alias("a"), _col(df, roles.target).alias("b"), _timed(df, roles, date).alias("timestamp")).filter("a <> '' AND b <> ''")
    key = lambda c: t.canonical_key(F.lit("PhoneNumber"), F.col(c))
    return _ends(rows, "PhoneNumber"), rows.select("file", key("a").alias("source"), key("b").alias("target"), F.lit("CALL_MADE_TO").alias("relation"), "timestamp", F.lit(None).cast("double").alias("amount"))


def transfers(df: DataFrame, roles: Roles, date: str | None = None):
    """(entities, edges) of a transaction log, with amounts."""
    amt = t.amount(F.nullif(_col(df, roles.amount), F.lit("")))
    rows = df.select("file", "ordinal", _col(df, roles.source).alias("a"), _col(df, roles.target).alias("b"), _timed(df, roles, date).alias("timestamp"), amt.alias("amount")).filter("a <> '' AND b <> ''")
    key = lambda c: t.canonical_key(F.lit("BankAccount"), F.col(c))
    return _ends(rows, "BankAccount"), rows.select("file", key("a").alias("source"), key("b").alias("target"), F.lit("TRANSFERRED_FUNDS_TO").alias("relation"), "timestamp", "amount")


def master_rows(df: DataFrame, roles: Roles) -> DataFrame:
    """Cleaned role columns of an entity master: (file, ordinal, id, type, name, phone, ...)."""
    return df.select("file", "ordinal", *[_col(df, getattr(roles, r)).alias(r) for r in ("id", "type", "name", "phone", "account", "vehicle", "location", "person_id", "email", "relation", "related", "source", "target")])


def _type_label(kind: Column) -> Column:
    k = F.lower(kind)
    out = F.when(k.contains("person"), "Person").when(k.contains("phone") | k.contains("mobile"), "PhoneNumber").when(k.contains("account") | k.contains("bank"), "BankAccount")
    return out.when(k.contains("vehicle"), "Vehicle").when(k.contains("location"), "Location")


def master_entities(rows: DataFrame) -> DataFrame:
    """Typed rows, explicit value columns, and untyped rows as persons; the first of every key stays."""
    c = F.col
    typed = _type_label(c("type"))
    ident = F.coalesce(F.nullif("id", F.lit("")), F.nullif("name", F.lit("")))
    person = F.coalesce(F.nullif("person_id", F.lit("")), F.nullif("name", F.lit("")), F.nullif("id", F.lit("")))

    def entity(label, identifier, name, place):
        return F.struct(label.alias("label"), identifier.alias("identifier"), name.alias("name"), F.lit(place).alias("place"))

    shown = F.coalesce(F.nullif("name", F.lit("")), ident)
    parts = [entity(F.coalesce(typed, F.when(c("type") == "", F.lit("Person"))), F.when(typed.isNotNull(), ident).otherwise(person), F.when(typed.isNotNull(), shown).otherwise(F.coalesce(F.nullif("name", F.lit("")), person)), 0)]
    for i, (col, label) in enumerate((("phone", "PhoneNumber"), ("account", "BankAccount"), ("vehicle", "Vehicle"), ("location", "Location")), 1):
        parts.append(entity(F.lit(label), F.nullif(col, F.lit("")), c(col), i))
    e = rows.select("file", "ordinal", "email", F.explode(F.array(*parts)).alias("e")).filter("e.label IS NOT NULL AND e.identifier IS NOT NULL")
    e = e.select("file", (c("ordinal") * 5 + c("e.place")).alias("ordinal"), t.canonical_key(c("e.label"), c("e.identifier")).alias("key"), c("e.label").alias("label"), c("e.name").alias("name"), F.when(c("e.place") == 0, F.nullif("email", F.lit(""))).alias("email"))
    return first_wins(e)


def master_lookup(entities: DataFrame) -> DataFrame:
    """(file, value, key): names and identifiers in lower case; of several entities the last one in order (``ordinal``)."""
    ident = F.lower(F.regexp_replace("key", "^[^:]*:", ""))
    return entities.select("file", F.explode(F.array(F.lower("name"), ident)).alias("value"), "key", "ordinal").groupBy("file", "value").agg(F.max_by("key", "ordinal").alias("key"))


def master_relations(rows: DataFrame, lookup: DataFrame) -> DataFrame:
    """Edges that rows state by source and target ids (or id and related id); unresolved ids and self edges are dropped."""
    source = F.lower(F.coalesce(F.nullif("source", F.lit("")), F.nullif("id", F.lit(""))))
    target = F.lower(F.coalesce(F.nullif("related", F.lit("")), F.nullif("target", F.lit(""))))
    r = rows.filter("relation <> ''").select("file", source.alias("s"), target.alias("d"), t.relation(F.col("relation")).alias("relation"))
    a, b = lookup.select("file", F.col("value").alias("s"), F.col("key").alias("source")), lookup.select("file", F.col("value").alias("d"), F.col("key").alias("target"))
    return r.join(a, ["file", "s"]).join(b, ["file", "d"]).filter("source <> target").select("file", "source", "target", "relation").distinct()


def master_links(rows: DataFrame, stated: DataFrame) -> DataFrame:
    """Person to phone, account, vehicle and location of the same row, unless the pair has a stated relation."""
    c = F.col
    is_person = F.lower("type").contains("person") | (c("type") == "")
    ident = F.coalesce(F.nullif("person_id", F.lit("")), F.when(c("type") != "", F.nullif("id", F.lit(""))), F.nullif("name", F.lit("")), F.nullif("id", F.lit("")))
    kinds = (("phone", "PhoneNumber", "USES_PHONE"), ("account", "BankAccount", "OWNS_ACCOUNT"), ("vehicle", "Vehicle", "USES_VEHICLE"), ("location", "Location", "LOCATED_AT"))
    ends = F.array(*[F.struct(t.canonical_key(F.lit(label), c(col)).alias("target"), F.lit(rel).alias("relation")) for col, label, rel in kinds])
    out = rows.filter(is_person).select("file", t.canonical_key(F.lit("Person"), ident).alias("source"), F.explode(ends).alias("e")).select("file", "source", "e.target", "e.relation").filter("source IS NOT NULL AND target IS NOT NULL")
    return out.join(stated.select("file", "source", "target").distinct(), ["file", "source", "target"], "left_anti").distinct()


def phones(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(PHONE), F.lit(0)), lambda p: F.right(F.regexp_replace(p, r"\D", ""), F.lit(10)))


def vehicles(text: Column) -> Column:
    return F.regexp_extract_all(F.upper(text), F.lit(VEHICLE), F.lit(0))


def accounts(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.upper(text), F.lit(ACCOUNT), F.lit(0)), lambda a: F.regexp_replace(a, "[^A-Z0-9]", ""))


def pattern_mentions(docs: DataFrame, text: str = "content") -> DataFrame:
    """(file, key, label, name) of phones, vehicles and accounts in whole texts, once each."""
    parts = [(phones, "PhoneNumber"), (vehicles, "Vehicle"), (accounts, "BankAccount")]

    def named(f, label):
        return F.transform(F.array_distinct(f(F.col(text))), lambda v: F.struct(F.lit(label).alias("label"), v.alias("name")))

    found = F.concat(*[named(f, label) for f, label in parts])
    return docs.select("file", F.explode(found).alias("m")).select("file", "m.label", "m.name", t.canonical_key(F.col("m.label"), F.col("m.name")).alias("key"))


def dictionary_mentions(docs: DataFrame, names: DataFrame, text: str = "content", **sizes) -> DataFrame:
    """(file, key) for every known name (case_id, key, name) that occurs in a text of its case (file, case_id, text), in any letter case.

    Names of any number and length go through automata (see ``patterns.phrases_in``, which takes ``sizes``).
    """
    phrases = names.select("case_id", "key", F.lower("name").alias("phrase"))
    return phrases_in(docs.select(F.col("file").alias("id"), "case_id", F.lower(text).alias("text")), phrases, **sizes).select(F.col("id").alias("file"), "key").distinct()


def sentences(docs: DataFrame, text: str = "content") -> DataFrame:
    """(file, case_id, pos, sentence)."""
    return docs.select("file", "case_id", F.posexplode(F.split(F.col(text), SENTENCE)).alias("pos", "sentence"))


def sentence_mentions(sents: DataFrame, names: DataFrame) -> DataFrame:
    """(file, pos, key, label, rank): known names in order of their id, then phones, then vehicles, each once a sentence."""
    listed = names.select("case_id", F.col("id").alias("o"), "key", "label", "name")
    # each sentence is a text of its own
    found = dictionary_mentions(sents.select(F.struct("file", "pos").alias("file"), "case_id", "sentence"), listed, "sentence")
    known = found.select("file.file", "file.pos", "key").join(sents.select("file", "pos", "case_id"), ["file", "pos"]).join(listed, ["case_id", "key"])
    known = known.select("file", "pos", F.struct(F.lit(0).alias("kind"), "o").alias("order"), "key", "label")
    listed = []
    for kind, (f, label) in enumerate(((phones, "PhoneNumber"), (vehicles, "Vehicle")), 1):
        m = sents.select("file", "pos", F.posexplode(f(F.col("sentence"))).alias("o", "v"))
        listed.append(m.select("file", "pos", F.struct(F.lit(kind).alias("kind"), F.col("o").cast("long").alias("o")).alias("order"), t.canonical_key(F.lit(label), F.col("v")).alias("key"), F.lit(label).alias("label")))
    known = known.withColumn("order", F.struct(F.col("order.kind").alias("kind"), F.col("order.o").cast("long").alias("o")))
    out = known.unionByName(listed[0]).unionByName(listed[1]).groupBy("file", "pos", "key", "label").agg(F.min("order").alias("order"))
    w = Window.partitionBy("file", "pos").orderBy("order", "key")
    return out.withColumn("rank", F.row_number().over(w)).drop("order")


def text_edges(sents: DataFrame, mentions: DataFrame, names: DataFrame) -> DataFrame:
    """Edges (file, source, target, relation) that sentences state: CONTACTED, USES_PHONE, SIGHTED_AT and OCCURRED_AT."""
    cue = lambda pattern: sents.filter(F.col("sentence").rlike(pattern)).select("file", "pos")
    of = lambda label: mentions.filter(F.col("label") == label)

    def pairs(pattern, a, b, relation):
        s = cue(pattern)
        left = a.select("file", "pos", F.col("key").alias("source"))
        right = b.select("file", "pos", F.col("key").alias("target"))
        return s.join(left, ["file", "pos"]).join(right, ["file", "pos"]).select("file", "source", "target", F.lit(relation).alias("relation"))

    persons = of("Person")
    listed = cue(CONTACT).join(persons, ["file", "pos"]).groupBy("file", "pos").agg(F.array_sort(F.collect_list(F.struct("rank", "key"))).alias("p")).filter("size(p) >= 2")
    contacted = listed.select("file", F.expr("p[1].key").alias("source"), F.expr("p[0].key").alias("target"), F.lit("CONTACTED").alias("relation"))
    phone_links = pairs(CONTACT, persons, of("PhoneNumber"), "USES_PHONE")
    places = of("Location")
    seen_vehicle = carried_vehicles(sents)
    direct = pairs(SIGHTING, of("Vehicle"), places, "SIGHTED_AT")
    bare = cue(SIGHTING).join(of("Vehicle").select("file", "pos").distinct(), ["file", "pos"], "left_anti")
    carried = bare.join(seen_vehicle, ["file", "pos"]).join(places.select("file", "pos", F.col("key").alias("target")), ["file", "pos"]).select("file", F.col("vehicle").alias("source"), "target", F.lit("SIGHTED_AT").alias("relation"))
    people = pairs(PERSON_SIGHTING, persons, places, "SIGHTED_AT")
    incident = names.filter("label = 'Incident'").groupBy("case_id").agg(F.min_by("key", "id").alias("source"))
    occurred = sents.filter(F.col("sentence").rlike(INCIDENT)).select("file", "pos", "case_id").join(incident, "case_id").join(places.select("file", "pos", F.col("key").alias("target")), ["file", "pos"]).select("file", "source", "target", F.lit("OCCURRED_AT").alias("relation"))
    out = contacted
    for e in (phone_links, direct, carried, people, occurred):
        out = out.unionByName(e)
    return out.filter("source <> target").distinct()


def carried_vehicles(sents: DataFrame) -> DataFrame:
    """(file, pos, vehicle): the first registration of the sentence, else the latest one of the sentences before."""
    own = F.try_element_at(vehicles(F.col("sentence")), F.lit(1))
    w = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    found = sents.withColumn("vehicle", F.last(t.canonical_key(F.lit("Vehicle"), own), ignorenulls=True).over(w))
    return found.filter("vehicle IS NOT NULL").select("file", "pos", "vehicle")


def case_nodes(cases: DataFrame) -> DataFrame:
    """The CASE entity of every case (file, case_ref, title); its name is the title, or the reference where there is none."""
    name = F.coalesce(F.nullif(t.clean(F.col("title")), F.lit("")), F.col("case_ref"))
    return cases.select("file", F.concat(F.lit("CASE:"), "case_ref").alias("key"), F.lit("Case").alias("label"), name.alias("name"))


def backbone(entities: DataFrame, edges: DataFrame, case_key: Column) -> DataFrame:
    """PART_OF_CASE edges of persons, incidents and of entities without another edge in the batch."""
    touched = edges.filter("relation <> 'PART_OF_CASE'").select("file", F.explode(F.array("source", "target")).alias("key")).distinct()
    chosen = entities.filter("label IN ('Person', 'Incident')").select("file", "key").union(entities.join(touched, ["file", "key"], "left_anti").select("file", "key")).distinct()
    return chosen.select("file", F.col("key").alias("source"), case_key.alias("target"), F.lit("PART_OF_CASE").alias("relation"))

"""Column functions: cleaning, normalisation, keys, amounts and labels. All are JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: document type aliases
DOC_TYPES = {
    "CDR": "CDR",
    "CALL_DETAIL_RECORD": "CDR",
    "CALL_DETAILS": "CDR",
    "CALL_RECORD": "CDR",
    "CALL_RECORDS": "CDR",
    "FINANCIAL": "FINANCIAL",
    "FINANCIAL_TRANSACTION_LOG": "FINANCIAL",
    "FINANCIAL_LOG": "FINANCIAL",
    "TRANSACTION_LOG": "FINANCIAL",
    "BANK_TRANSACTION": "FINANCIAL",
    "BANK_TRANSACTIONS": "FINANCIAL",
    "FIR": "FIR",
    "FIR_POLICE_REPORT": "FIR",
    "POLICE_REPORT": "FIR",
    "SURVEILLANCE": "SURVEILLANCE",
    "SURVEILLANCE_REPORT": "SURVEILLANCE",
    "CRIMINAL_RECORD": "CRIMINAL_RECORD",
    "CRIMINAL_RECORDS": "CRIMINAL_RECORD",
    "ENTITY_MASTER": "ENTITY_MASTER",
}
# fixed values: key prefixes of entity labels
KEY_PREFIX = {"Person": "PERSON", "PhoneNumber": "PHONE", "BankAccount": "ACCOUNT", "Vehicle": "VEHICLE", "Location": "LOCATION", "Incident": "INCIDENT", "Organization": "ORGANIZATION"}
# fixed values: relation aliases
RELATIONS = {
    "PHONE": "USES_PHONE",
    "USES_MOBILE": "USES_PHONE",
    "HAS_PHONE": "USES_PHONE",
    "OWNS_PHONE": "USES_PHONE",
    "ACCOUNT": "ASSOCIATED_WITH",
    "HAS_ACCOUNT": "ASSOCIATED_WITH",
    "OWNS_ACCOUNT": "ASSOCIATED_WITH",
    "VEHICLE": "USES_VEHICLE",
    "HAS_VEHICLE": "USES_VEHICLE",
    "OWNS_VEHICLE": "USES_VEHICLE",
    "LOCATION": "ASSOCIATED_WITH",
    "HAS_LOCATION": "ASSOCIATED_WITH",
}
# fixed values: words that stand for no value
NO_VALUE = ("", "nan", "none", "null", "nat")


def _lookup(table: dict[str, str], x: Column) -> Column:
    pairs = F.create_map(*[F.lit(v) for kv in table.items() for v in kv])
    return F.coalesce(F.try_element_at(pairs, x), x)


#: All white space of Unicode, as \\s has it in patterns with (?U).
SPACES = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(x: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(x, F.lit(SPACES))


def doc_type(x: Column) -> Column:
    t = F.upper(strip(F.coalesce(F.nullif(x, F.lit("")), F.lit("OTHER"))))
    return _lookup(DOC_TYPES, F.translate(t, "- ", "__"))


def clean(x: Column) -> Column:
    # one expression in which the value stands once, so that nested uses do not multiply it
    return F.regexp_replace(strip(F.coalesce(x, F.lit(""))), rf"(?i)^(?:{'|'.join(filter(None, NO_VALUE))})\z", "")


def canonical_key(label: Column, identifier: Column) -> Column:
    name = strip(F.coalesce(F.nullif(label, F.lit("")), F.lit("Entity")))
    prefixes = F.create_map(*[F.lit(v) for kv in KEY_PREFIX.items() for v in kv])
    ident = F.nullif(clean(identifier), F.lit(""))
    return F.concat(F.coalesce(F.try_element_at(prefixes, name), F.upper(name)), F.lit(":"), ident)


def squeeze(x: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", " "))


def name(x: Column) -> Column:
    return squeeze(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"(?U)[^\w\s]", " "))


def phone(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"[^0-9]", ""), r"^91([0-9]{10})\z", "$1")


def email(x: Column) -> Column:
    return F.lower(strip(F.coalesce(x, F.lit(""))))


def account(x: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(x, F.lit(""))), r"[^A-Z0-9]", "")


vehicle = account


def identity(label: Column, value: Column) -> Column:
    k = F.lower(F.coalesce(label, F.lit("")))
    has = lambda *words: F.greatest(*[k.contains(w) for w in words]) if len(words) > 1 else k.contains(words[0])
    out = F.when(has("phone", "mobile"), phone(value)).when(has("account", "bank"), account(value)).when(has("vehicle"), vehicle(value))
    return out.when(has("email"), email(value)).when(has("person"), name(value)).otherwise(F.lower(strip(F.coalesce(value, F.lit("")))))


def relation(x: Column) -> Column:
    """Relation of an entity master row: upper-case words joined by _, with aliases."""
    t = F.regexp_replace(F.upper(clean(x)), r"[^A-Z0-9]+", "_")
    return _lookup(RELATIONS, F.regexp_replace(t, r"^_+|_+$", ""))


def canonical_relation(x: Column) -> Column:
    """Relation as it is counted in risk measures."""
    return F.coalesce(F.nullif(F.translate(F.upper(strip(F.coalesce(x, F.lit("")))), " ", "_"), F.lit("")), F.lit("RELATED_TO"))


def relation_type(x: Column) -> Column:
    """Relation as a property graph's edge type."""
    return F.regexp_replace(F.upper(F.coalesce(x, F.lit("RELATED_TO"))), r"(?U)[^\p{L}\p{N}_]", "_")


def amount(x: Column) -> Column:
    return F.regexp_replace(x, r"[^0-9.\-]", "").try_cast("double")


def magnitude(x: Column) -> Column:
    return F.coalesce(F.abs(x.try_cast("double")), F.lit(0.0))


def unit(x: Column) -> Column:
    """Clipped to 0..1; null and NaN are 0."""
    x = x.cast("double")
    return F.when(x.isNull() | F.isnan(x), F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))


def rounded(x: Column, digits: int) -> Column:
    """Half up on the double itself, the same in any engine."""
    return F.floor(x * float(10**digits) + 0.5).cast("double") / float(10**digits)


def risk_band(score: Column) -> Column:
    return F.when(score >= 85, "CRITICAL").when(score >= 70, "HIGH").when(score >= 40, "MODERATE").otherwise("LOW")


def is_case_node(key: Column) -> Column:
    return F.upper(F.coalesce(key, F.lit(""))).startswith("CASE:")


def is_investigative(rel: Column) -> Column:
    return F.upper(F.coalesce(rel, F.lit(""))) != "PART_OF_CASE"


def canonical_json(names: list[str]) -> Column:
    """Compact JSON with sorted keys, nulls kept."""
    return F.to_json(F.struct(*[F.col(n) for n in sorted(names)]), {"ignoreNullFields": "false"})


def edge_label(rel: Column, amt: Column, timestamp: Column) -> Column:
    """Relation with spaces, the amount of a transfer, and the date of a timestamp."""
    parts = [F.replace(rel, F.lit("_"), F.lit(" ")), F.when(amt.isNotNull() & (amt != 0), F.format_number(amt, 2)), F.nullif(F.split_part(timestamp, F.lit("T"), F.lit(1)), F.lit(""))]
    return F.concat_ws(" | ", *parts)


def case_title(key: Column) -> Column:
    return F.replace(F.regexp_replace(key, "^(?i)CASE:", ""), F.lit("_"), F.lit(" "))


def direction(source: Column, key: Column) -> Column:
    return F.when(source == key, "OUTGOING").otherwise("INCOMING")


def storage_label(path: Column) -> Column:
    """Relative path inside the store without . and .. parts; null if blank or if it leads out of the store."""
    t = F.translate(strip(F.coalesce(path, F.lit(""))), "\\", "/")
    step = lambda s, p: (
        F.when((p == "") | (p == "."), s)
        .when(p == "..", F.struct(F.slice(s.parts, 1, F.greatest(F.size(s.parts) - 1, F.lit(0))).alias("parts"), (s.out | (F.size(s.parts) == 0)).alias("out")))
        .otherwise(F.struct(F.concat(s.parts, F.array(p)).alias("parts"), s.out.alias("out")))
    )
    start = F.struct(F.array().cast("array<string>").alias("parts"), t.startswith("/").alias("out"))
    done = F.aggregate(F.split(t, "/"), start, step)
    return F.when((t != "") & ~done.out & (F.size(done.parts) > 0), F.array_join(done.parts, "/"))


def contains_any(columns: list[Column], query: Column) -> Column:
    """Case-insensitive containment in any of the columns; a blank query holds for all rows."""
    q = F.lower(F.coalesce(query, F.lit("")))
    out = q == ""
    for c in columns:
        out = out | F.coalesce(F.lower(c.cast("string")).contains(q), F.lit(False))
    return out


def snippet(content: Column, question: Column) -> Column:
    """300 characters before and 700 after the question's first word of four letters or more that occurs; else the first 800."""
    text = squeeze(content)
    words = F.filter(F.regexp_extract_all(F.lower(question), F.lit(r"(?U)(\w+)"), 1), lambda w: F.length(w) >= 4)
    places = F.filter(F.transform(words, lambda w: F.instr(F.lower(text), w)), lambda p: p > 0)
    at = F.try_element_at(places, F.lit(1))
    return F.when(at.isNull(), F.substring(text, 1, 800)).otherwise(F.substring(text, F.greatest(at - 300, F.lit(1)), F.least(at - 1, F.lit(300)) + 700))

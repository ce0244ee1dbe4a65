"""Entity resolution inside a case: deterministic verdicts for incoming entities against existing ones.

Both frames: (case_id, id, key, label, name, phone, email, account, vehicle, identifier); ids are unique in each frame.
Candidates meet by equal normalised values, never by label alone.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.functions import text as t
from caseflow.operators.work import cut

# fixed values: identifiers in the order in which conflicts are reported
KINDS = ("phone", "email", "account", "vehicle", "identifier")


def _normal(kind: str, x: Column) -> Column:
    return {"phone": t.phone, "email": t.email, "account": t.account, "vehicle": t.vehicle, "identifier": lambda v: F.upper(t.strip(F.coalesce(v, F.lit(""))))}[kind](x)


def identifier_of(node: Column) -> tuple[Column, Column]:
    """Kind and normalised value of a PHONE:, ACCOUNT: or VEHICLE: key; the kind of any other key is null."""
    prefix, raw = F.split_part(node, F.lit(":"), F.lit(1)), F.substring(node, F.instr(node, ":") + 1, F.length(node))
    kind = F.try_element_at(F.create_map(*[F.lit(v) for k in ("phone", "account", "vehicle") for v in (k.upper(), k)]), prefix)
    return kind, F.when(kind == "phone", t.phone(raw)).otherwise(t.account(raw))


def _linked(rels: DataFrame) -> DataFrame:
    """(case_id, key, kind, value, edge): identifiers that edges to PHONE:, ACCOUNT: and VEHICLE: nodes give to the other end."""
    ends = F.explode(F.array(F.struct(F.col("source").alias("key"), F.col("target").alias("other")), F.struct(F.col("target").alias("key"), F.col("source").alias("other"))))
    e = rels.select("case_id", "id", ends.alias("e")).select("case_id", F.col("id").alias("edge"), "e.key", "e.other")
    kind, value = identifier_of(F.col("other"))
    return e.select("case_id", "key", kind.alias("kind"), value.alias("value"), "edge").filter("kind IS NOT NULL AND value <> ''")


def signals(entities: DataFrame, rels: DataFrame | None = None, fill_only: bool = False) -> DataFrame:
    """(case_id, id, label, kind, value), without blanks. Edges add values, or with ``fill_only`` only the first one of a kind that the entity lacks."""
    parts = F.array(*[F.struct(F.lit(k).alias("kind"), _normal(k, F.col(k)).alias("value")) for k in KINDS])
    own = entities.select("case_id", "id", F.lower("label").alias("label"), F.explode(parts).alias("s")).select("case_id", "id", "label", "s.kind", "s.value").filter("value <> ''")
    if rels is None:
        return own
    more = entities.select("case_id", "id", F.lower("label").alias("label"), "key").join(_linked(rels), ["case_id", "key"])
    if fill_only:
        more = more.groupBy("case_id", "id", "label", "kind").agg(F.min_by("value", "edge").alias("value")).join(own.select("id", "kind"), ["id", "kind"], "left_anti")
    return own.unionByName(more.select("case_id", "id", "label", "kind", "value")).distinct()


def _bits(c: Column) -> Column:
    """Bit masks of the kinds that a column of kinds names."""
    return F.bit_or(F.element_at(F.create_map(*[F.lit(v) for i, k in enumerate(KINDS) for v in (k, 1 << i)]), c))


def _kind_of(mask: Column) -> Column:
    """The first kind in a mask, in the order of KINDS; null for none."""
    out = F.lit(None).cast("string")
    for i, k in reversed(list(enumerate(KINDS))):
        out = F.when(mask.bitwiseAND(1 << i) != 0, k).otherwise(out)
    return out


def persons(df: DataFrame) -> DataFrame:
    return df.filter(F.coalesce(F.lower("label").contains("person"), F.lit(False)))


def known_by(df: DataFrame) -> DataFrame:
    """(case_id, label, v, id) of entities that are no persons; v: what they are known by."""
    rest = df.filter(~F.coalesce(F.lower("label").contains("person"), F.lit(False)))
    return rest.select("case_id", F.lower("label").alias("label"), t.identity(F.col("label"), F.coalesce(F.nullif("name", F.lit("")), F.col("key"))).alias("v"), "id").filter("v <> ''")


def _named(df: DataFrame, found: DataFrame) -> DataFrame:
    """(case_id, label, n, id, mask): persons with a name, and the kinds of identifiers that ``found`` has for them."""
    masks = found.groupBy("id").agg(_bits(F.col("kind")).alias("mask"))
    out = persons(df).select("case_id", F.lower("label").alias("label"), t.name(F.col("name")).alias("n"), "id").filter("n <> ''")
    return out.join(masks, "id", "left").select("case_id", "label", "n", "id", F.coalesce("mask", F.lit(0)).alias("mask"))


def resolve(existing: DataFrame, incoming: DataFrame, existing_rels: DataFrame | None = None, incoming_rels: DataFrame | None = None) -> DataFrame:
    """(id, verdict, candidate_id, detail, name_agrees) of every incoming entity against ``existing`` as it stands (see ``arrive`` for rows that meet earlier ones of their batch).

    ``detail`` lists the kinds that match or conflict; ``name_agrees`` tells for a match by identifiers whether the names are equal too. EXACT_MATCH by a shared identifier (for others than persons: by equal normalised identity), the candidate of the least id; NEW_ENTITY if only a
    namesake with a conflicting identifier is there; AMBIGUOUS if a namesake has nothing to compare; else NEW_ENTITY.

    Candidates are folded before they meet anything: to the least id of a value, and of a name to the least id of each set of kinds (32 at most). So
    a value or name that many rows share on both sides costs a row for each of them and no pairs.
    """
    c = F.col
    inc_s, old_s = signals(persons(incoming), incoming_rels, fill_only=True), signals(persons(existing), existing_rels)
    least = old_s.groupBy("case_id", "label", "kind", "value").agg(F.min("id").alias("cand"))
    chosen = inc_s.join(least, ["case_id", "label", "kind", "value"]).groupBy("id").agg(F.min("cand").alias("cand"))
    # all kinds in which the chosen one agrees
    asked = inc_s.join(chosen, "id").select("id", "cand", "kind", "value")
    agreed = asked.join(old_s.select(c("id").alias("cand"), "kind", "value"), ["cand", "kind", "value"]).groupBy("id", "cand").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("detail"))
    named = lambda df, i: persons(df).select(c("id").alias(i), t.name(c("name")).alias(f"{i}_name"))
    strong = agreed.join(named(incoming, "id"), "id").join(named(existing, "cand"), "cand")
    agrees = F.coalesce((c("id_name") == c("cand_name")) & (c("id_name") != ""), F.lit(False))
    none = F.lit(None).cast("boolean").alias("agrees")
    found = strong.select("id", "cand", F.lit(1).alias("rank"), "detail", agrees.alias("agrees"))

    same = known_by(existing).groupBy("case_id", "label", "v").agg(F.min("id").alias("cand"))
    other = known_by(incoming).join(same, ["case_id", "label", "v"])
    found = found.unionByName(other.select("id", "cand", F.lit(1).alias("rank"), F.lit("identity").alias("detail"), none))

    folded = _named(existing, old_s).groupBy("case_id", "label", "n", "mask").agg(F.min("id").alias("cand")).withColumnRenamed("mask", "cand_mask")
    weak = _named(incoming, inc_s).join(chosen.select("id"), "id", "left_anti").join(folded, ["case_id", "label", "n"])
    detail = _kind_of(c("mask").bitwiseAND(c("cand_mask")))
    weak = weak.select("id", "cand", F.when(detail.isNotNull(), 2).otherwise(3).alias("rank"), F.coalesce(detail, F.lit("name")).alias("detail"), none)
    best = found.unionByName(weak).groupBy("id").agg(F.min(F.struct("rank", "cand", "detail", "agrees")).alias("b"))
    verdict = F.when(c("b.rank") == 1, "EXACT_MATCH").when(c("b.rank") == 3, "AMBIGUOUS").otherwise("NEW_ENTITY")
    return incoming.select("id").join(best, "id", "left").select("id", verdict.alias("verdict"), F.when(c("b.rank") == 1, c("b.cand")).alias("candidate_id"), F.coalesce("b.detail", F.lit("")).alias("detail"), c("b.agrees").alias("name_agrees"))


def _replay(rows: DataFrame) -> DataFrame:
    """Matches and changes of candidates, component by component, in order. rows: (comp, side, id, key, taken, own, all); side 0: existing, 1: incoming.

    (id, cand_side, cand, kinds, mask): for an incoming row its match and the kinds that agreed; with kinds null, a candidate whose
    kinds became ``mask`` when row ``id`` came. Rows stream through; a task holds a component's values with their first holders, whatever the number of rows.
    """

    def run(batches):
        comp, least, values, kinds, keys = None, {}, {}, {}, set()
        mask = lambda who: sum({1 << int(s[0]) for s in values[who]})
        for b in batches:
            out = []
            for c, side, i, key, taken, own, every in zip(*(col.to_pylist() for col in b.columns), strict=True):
                if c != comp:
                    comp, least, values, kinds, keys = c, {}, {}, {}, set()
                who = (side, i)
                if side == 0:
                    values[who], kinds[who] = set(every), {s[0] for s in own}
                    for s in every:
                        least[s] = min(least.get(s, who), who)
                    continue
                hits = [least[s] for s in every if s in least]
                if hits:
                    who = min(hits)
                    out.append((i, *who, ",".join(sorted(KINDS[int(s[0])] for s in every if s in values[who])), None))
                    before = mask(who)
                    for s in own:
                        if s[0] not in kinds[who]:
                            kinds[who].add(s[0])
                            values[who].add(s)
                            least[s] = min(least.get(s, who), who)
                    if mask(who) != before:
                        out.append((i, *who, None, mask(who)))
                    continue
                # a new candidate has its own identifiers, and those that edges give to its key, if it gets that key
                mine = set(own) | (set() if taken is None or key in keys else set(taken))
                keys.add(key)
                values[who], kinds[who] = mine, {s[0] for s in own}
                for s in mine:
                    least.setdefault(s, who)
                out.append((i, *who, None, mask(who)))
            yield pa.record_batch([pa.array(list(x), kind) for x, kind in zip(zip(*out, strict=True) if out else [()] * 5, (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int32()), strict=True)], names=["id", "cand_side", "cand", "kinds", "mask"])

    order = ["comp", "side", "id"]
    return rows.select("comp", "side", "id", "key", "taken", "own", "all").repartition("comp").sortWithinPartitions(*order).mapInArrow(run, "id long, cand_side int, cand long, kinds string, mask int")


def _as_of(events: DataFrame, asked: DataFrame, part: int) -> DataFrame:
    """(id, cand_side, cand, kind): for every row of ``asked`` (case_id, label, n, id, mask) the namesake that decides, as candidates stood when it came: the first
    that has a kind in common, with the first such kind, else the first of all (kind null). events: (case_id, label, n, side, cand, time, mask).

    A name that many rows ask for is dealt into parts of about ``part`` rows, each of which meets all events of the name.
    """
    name = ["case_id", "label", "n"]
    parts = asked.groupBy(*name).agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))
    dealt = asked.join(parts, name).withColumn("salt", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    dealt = dealt.select(*name, "salt", F.col("id").alias("time"), F.lit(0).alias("event"), F.lit(1).alias("side"), F.col("id").alias("cand"), "mask")
    told = events.join(parts, name).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = dealt.unionByName(told.select(*name, "salt", "time", F.lit(1).alias("event"), "side", "cand", "mask"))

    def run(batches):
        group, heaps, now = None, {}, {}
        for b in batches:
            out = []
            for *g, time, event, side, cand, mask in zip(*(col.to_pylist() for col in b.columns), strict=True):
                if g != group:
                    group, heaps, now = g, {}, {}
                if event:
                    now[side, cand] = mask
                    heapq.heappush(heaps.setdefault(mask, []), (side, cand))
                    continue
                first = clash = None
                for m, heap in heaps.items():
                    while heap and now[heap[0]] != m:
                        heapq.heappop(heap)  # has more kinds by now
                    if heap:
                        first = heap[0] if first is None else min(first, heap[0])
                        if m & mask:
                            clash = min(clash or (heap[0], m), (heap[0], m))
                if clash:
                    both = clash[1] & mask
                    out.append((cand, *clash[0], KINDS[(both & -both).bit_length() - 1]))
                elif first:
                    out.append((cand, *first, None))
            yield pa.record_batch([pa.array(list(x), kind) for x, kind in zip(zip(*out, strict=True) if out else [()] * 4, (pa.int64(), pa.int32(), pa.int64(), pa.string()), strict=True)], names=["id", "cand_side", "cand", "kind"])

    keys = [*name, "salt"]
    return rows.repartition(*keys).sortWithinPartitions(*keys, "time", "event").mapInArrow(run, "id long, cand_side int, cand long, kind string")


def arrive(existing: DataFrame, incoming: DataFrame, existing_rels: DataFrame | None = None, incoming_rels: DataFrame | None = None, part: int = 100_000) -> DataFrame:
    """(id, verdict, candidate_id, candidate_new, detail, name_agrees): verdicts of ``incoming`` one after the other, in order of their ids.

    As ``resolve``, but every row that is no match becomes a candidate for the rows after it (candidate_new: candidate_id is such a row), and a match gives its
    candidate the identifiers that this lacks, which later rows can match. Existing candidates come before new ones, and these in order.

    Rows that share an identifier or key, directly or through others, are replayed in order in one task, which streams them; rows of a case that share none
    are replayed apart. Names match nothing and change nothing, so they tie no rows together: verdicts on namesakes are made afterwards, from the candidates
    as they stood at the time. Identifiers that existing edges give to a new row's key count unless an existing entity has the key or an earlier row of its component took it. Null and blank names and identifiers are never equal.
    """
    c = F.col
    old, new = persons(existing), persons(incoming)
    if new.isEmpty():
        return _judged(incoming, _alike(existing, incoming))
    old_s, own_s = cut(signals(old, existing_rels)), signals(new)
    inc_s = cut(signals(new, incoming_rels, fill_only=True))
    value = ["case_id", "label", "kind", "value"]
    # of existing holders of a value only the first can be matched, so only these are replayed
    least = old_s.groupBy(*value).agg(F.min("id").alias("id"))
    used = least.join(inc_s.select(*value).unionByName(own_s.select(*value)).distinct(), value, "left_semi").select("id").distinct()
    played = cut(old_s.join(used, "id", "left_semi"))
    free = new.join(existing.select("key").distinct(), "key", "left_anti").select("case_id", "id", F.lower("label").alias("label"), "key")
    given = free.join(_linked(existing_rels), ["case_id", "key"]).select("case_id", "id", "label", "kind", "value").distinct() if existing_rels is not None else inc_s.limit(0)

    node = lambda side: (c("id") * 2 + side).alias("node")
    shared = ["case_id", "label", "kind", "value"]
    holders = played.select(*shared, node(0)).unionByName(inc_s.select(*shared, node(1))).unionByName(given.select(*shared, node(1)))
    holders = holders.unionByName(new.filter("key IS NOT NULL").select("case_id", F.lower("label").alias("label"), F.lit("key").alias("kind"), F.col("key").alias("value"), node(1)))
    comp = least_reachable(_stars(holders, shared, "node"), new.select(node(1)).union(played.select(node(0)).distinct()))

    coded = F.concat(F.element_at(F.create_map(*[F.lit(v) for i, k in enumerate(KINDS) for v in (k, str(i))]), c("kind")), c("value"))
    listed = lambda df, what: df.groupBy("id").agg(F.array_sort(F.collect_set(coded)).alias(what))
    nothing = F.array().cast("array<string>")

    def side(entities, n, every, own, extra):
        df = entities.select("id", "key").join(listed(every, "all"), "id", "left").join(listed(own, "own"), "id", "left").join(extra, "id", "left")
        return df.select("id", "key", F.lit(n).alias("side"), "taken", F.coalesce("own", nothing).alias("own"), F.coalesce("all", nothing).alias("all"))

    got_key = free.select("id", F.lit(True).alias("free")).join(listed(given, "given"), "id", "left").select("id", F.coalesce("given", nothing).alias("taken"))
    there = old.join(played.select("id").distinct(), "id", "left_semi")
    rows = side(there, 0, played, signals(there), there.select("id", F.lit(None).cast("array<string>").alias("taken"))).unionByName(side(new, 1, inc_s, own_s, got_key))
    done = cut(_replay(rows.withColumn("node", c("id") * 2 + c("side")).join(comp, "node")))
    matched, changed = done.filter("kinds IS NOT NULL"), done.filter("kinds IS NULL")

    names = lambda df, n: persons(df).select(F.lit(n).alias("cand_side"), c("id").alias("cand"), "case_id", F.lower("label").alias("label"), t.name(c("name")).alias("n"))
    people = names(existing, 0).unionByName(names(incoming, 1))
    # candidates that never changed count once for each set of kinds, all others one by one
    born = changed.filter("cand_side = 1 AND id = cand").select("cand_side", "cand", c("id").alias("time"), "mask")
    first = _named(existing, old_s).select(F.lit(0).alias("cand_side"), c("id").alias("cand"), F.lit(-(1 << 62)).alias("time"), "mask").unionByName(born)
    later = changed.filter("NOT (cand_side = 1 AND id = cand)").select("cand_side", "cand", c("id").alias("time"), "mask")
    told = first.unionByName(later).join(people, ["cand_side", "cand"]).filter("n <> ''").join(later.select("cand_side", "cand", F.lit(True).alias("moves")).distinct(), ["cand_side", "cand"], "left")
    still = told.filter("moves IS NULL").groupBy("case_id", "label", "n", "mask").agg(F.min(F.struct("cand_side", "cand", "time")).alias("f"))
    fixed = still.select("case_id", "label", "n", c("f.cand_side").alias("side"), c("f.cand").alias("cand"), c("f.time").alias("time"), "mask")
    events = fixed.unionByName(told.filter("moves").select("case_id", "label", "n", c("cand_side").alias("side"), "cand", "time", "mask"))
    asked = _named(incoming, inc_s).join(matched.select("id"), "id", "left_anti")
    weak = _as_of(events, asked, part)

    none = F.lit(None).cast("boolean").alias("agrees")
    both = matched.join(people.select("cand_side", "cand", c("n").alias("cand_n")), ["cand_side", "cand"]).join(people.filter("cand_side = 1").select(c("cand").alias("id"), "n"), "id")
    found = both.select("id", F.lit(1).alias("rank"), "cand_side", "cand", c("kinds").alias("detail"), ((c("n") == c("cand_n")) & (c("n") != "")).alias("agrees"))
    found = found.unionByName(weak.select("id", F.when(c("kind").isNotNull(), 2).otherwise(3).alias("rank"), "cand_side", "cand", F.coalesce("kind", F.lit("name")).alias("detail"), none))
    return _judged(incoming, found.unionByName(_alike(existing, incoming)))


def _alike(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """(id, rank, cand_side, cand, detail, agrees): matches of incoming rows that are no persons, by what they are known by."""
    c, known = F.col, known_by(incoming)
    alike = known_by(existing).select("case_id", "label", "v", F.lit(0).alias("cand_side"), c("id").alias("cand")).unionByName(known.select("case_id", "label", "v", F.lit(1).alias("cand_side"), c("id").alias("cand")))
    alike = alike.groupBy("case_id", "label", "v").agg(F.min(F.struct("cand_side", "cand")).alias("f"))
    other = known.join(alike, ["case_id", "label", "v"]).filter("f.cand_side = 0 OR f.cand <> id")
    return other.select("id", F.lit(1).alias("rank"), "f.cand_side", "f.cand", F.lit("identity").alias("detail"), F.lit(None).cast("boolean").alias("agrees"))


def _judged(incoming: DataFrame, found: DataFrame) -> DataFrame:
    """The verdicts of ``arrive`` from what was found for its rows (one match a row)."""
    c = F.col
    verdict = F.when(c("rank") == 1, "EXACT_MATCH").when(c("rank") == 3, "AMBIGUOUS").otherwise("NEW_ENTITY")
    hit = c("rank") == 1
    return incoming.select("id").join(found, "id", "left").select("id", verdict.alias("verdict"), F.when(hit, c("cand")).alias("candidate_id"), F.when(hit, c("cand_side") == 1).alias("candidate_new"), F.coalesce("detail", F.lit("")).alias("detail"), c("agrees").alias("name_agrees"))


def after_arrival(existing: DataFrame, incoming: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The entity table after ``arrive``: existing rows and the new ones, each with what its matches added, and keys that no other row has.

    (side, id, key, case_id, label, name, the identifiers, merged, status, reason); side 0: existing, 1: new.
    """
    c = F.col
    cols = ["case_id", "key", "label", "name", *KINDS]
    new = incoming.join(verdicts.filter("candidate_id IS NOT NULL").select("id"), "id", "left_anti")
    keys = new_keys(new, existing)
    own = {k: F.nullif(_normal(k, c(k)), F.lit("")).alias(k) for k in KINDS}
    new = new.drop("key").join(keys, "id").select("id", "case_id", "key", "label", "name", *own.values())
    table = existing.select((c("id") * 2).alias("id"), *cols).unionByName(new.select((c("id") * 2 + 1).alias("id"), *cols))
    to = verdicts.withColumn("candidate_id", c("candidate_id") * 2 + c("candidate_new").cast("int"))
    out = merge(table, incoming, to)
    return out.withColumns({"side": F.pmod("id", F.lit(2)).cast("int"), "id": F.shiftright("id", 1)})


def _stars(holders: DataFrame, value: list[str], node: str) -> DataFrame:
    """(a, b) both ways: each holder of a value and the least one."""
    hubs = holders.groupBy(*value).agg(F.min(node).alias("hub"))
    links = holders.join(hubs, value).filter(F.col(node) != F.col("hub")).select(F.col(node).alias("a"), F.col("hub").alias("b")).distinct()
    return links.union(links.select("b", "a")).toDF("a", "b").distinct()


def least_reachable(both: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, comp): the least node that each of ``nodes`` reaches over edges (a, b) given both ways; labels spread until nothing changes, with a checkpoint a round."""
    both = cut(both)
    labels = cut(nodes.select("node", F.col("node").alias("comp")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("comp").alias("m"))
        step = labels.join(near, labels.node == near.a, "left").select("node", F.least("comp", "m").alias("comp"))
        hop = step.select(F.col("node").alias("g"), F.col("comp").alias("gg"))
        new = cut(step.join(hop, step.comp == hop.g, "left").select("node", F.coalesce("gg", "comp").alias("comp")))
        if new.join(labels, ["node", "comp"], "left_anti").isEmpty():
            return new
        labels = new


def batch_groups(incoming: DataFrame, rels: DataFrame | None = None) -> DataFrame:
    """(id, group_id): incoming entities of a case that share an identifier, directly or through others; the least id names the group.

    Each identifier links its holders to the least of them, so a value that many share gives a star and not all pairs.
    """
    s = signals(incoming, rels)
    found = least_reachable(_stars(s, ["case_id", "label", "kind", "value"], "id"), incoming.select(F.col("id").alias("node")))
    return found.select(F.col("node").alias("id"), F.col("comp").alias("group_id"))


def merge(existing: DataFrame, incoming: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``existing`` with missing attributes filled from its matches, in order of their ids and normalised; no stated attribute is changed.

    merged counts the matches; status is MERGED where there is one, and reason lists what matched, first match first.
    """
    hit = incoming.join(verdicts.filter("candidate_id IS NOT NULL").select("id", "candidate_id", "detail"), "id")
    value = {k: F.nullif(_normal(k, F.col(k)), F.lit("")) for k in KINDS}
    new = hit.groupBy("candidate_id").agg(*[F.min_by(v, F.when(v.isNotNull(), F.col("id"))).alias(f"new_{k}") for k, v in value.items()], F.count("*").alias("merged"), F.min_by("detail", "id").alias("reason"))
    out = existing.join(new, existing.id == new.candidate_id, "left")
    keep = [c for c in existing.columns if c not in KINDS]
    return out.select(*keep, *[F.coalesce(F.nullif(k, F.lit("")), f"new_{k}").alias(k) for k in KINDS], F.coalesce("merged", F.lit(0)).alias("merged"), F.when(F.col("merged") > 0, "MERGED").otherwise("UNCHANGED").alias("status"), F.coalesce("reason", F.lit("")).alias("reason"))


def scoped_key(key: Column, case_id: Column, name: Column, seed: Column) -> Column:
    """PREFIX:C<case>_<NAME12>_<6 hex> for an entity whose key is taken; the hex digits come from a hash of the row.

    A null case counts as case 0, a null name as ENTITY; a key without a colon has the prefix ENTITY. The name keeps its Latin letters, digits and underscores.
    """
    case = F.coalesce(case_id.cast("string"), F.lit("0"))
    short = F.substring(F.upper(F.regexp_replace(F.coalesce(name, F.lit("entity")), "[^A-Za-z0-9_]", "")), 1, 12)
    prefix = F.when(F.contains(key, F.lit(":")), F.split_part(key, F.lit(":"), F.lit(1))).otherwise("ENTITY")
    digest = F.sha2(F.concat_ws("~", case, F.coalesce(key, F.lit("")), seed.cast("string")), 256)
    return F.concat(prefix, F.lit(":C"), case, F.lit("_"), short, F.lit("_"), F.upper(F.substring(digest, 1, 6)))


def new_keys(incoming: DataFrame, taken: DataFrame) -> DataFrame:
    """(id, key): the key itself, or a scoped one where ``taken`` (key) or an earlier row (by id) has it."""
    known = taken.select("key").distinct().withColumn("known", F.lit(True))
    first = incoming.groupBy("key").agg(F.min("id").alias("first"))
    out = incoming.join(known, "key", "left").join(first, "key", "left")
    scoped = F.col("known").isNotNull() | (F.col("id") > F.col("first"))
    return out.select("id", F.when(scoped, scoped_key(F.col("key"), F.col("case_id"), F.col("name"), F.col("id"))).otherwise(F.col("key")).alias("key"))


def upsert_edges(existing: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of ``new`` that are not there yet, once each; null case ids and timestamps equal each other."""
    on = ["case_id", "source", "target", "relation", "timestamp"]
    n = new.dropDuplicates(on)
    cond = F.lit(True)
    for k in on:
        cond = cond & n[k].eqNullSafe(existing[k])
    return n.join(existing, cond, "left_anti")

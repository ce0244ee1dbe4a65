"""Case graphs: membership, adjacency, degrees, reach, shortest paths, filters and export.

Relationships: (case_id, source, target, relation, timestamp, amount, id). Every operator works on all cases at once.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseflow.functions import text as t
from caseflow.operators.work import cut


def investigative(rels: DataFrame) -> DataFrame:
    return rels.filter(t.is_investigative(F.col("relation")))


def members(rels: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """Distinct (case_id, key) of endpoints; with ``entities`` also those that the entities' own case_id names."""
    ends = rels.select("case_id", F.explode(F.array("source", "target")).alias("key"))
    if entities is not None:
        ends = ends.unionByName(entities.filter("case_id IS NOT NULL").select("case_id", "key"))
    return ends.filter("coalesce(key, '') <> ''").distinct()


def adjacency(rels: DataFrame) -> DataFrame:
    """(case_id, key, other, relation, id): investigative edges both ways, without blank endpoints and self-loops; parallel edges are kept."""
    e = investigative(rels).filter("coalesce(source, '') <> '' AND coalesce(target, '') <> '' AND source <> target")
    ends = F.explode(F.array(F.struct(F.col("source").alias("key"), F.col("target").alias("other")), F.struct(F.col("target").alias("key"), F.col("source").alias("other"))))
    rest = [c for c in ("relation", "id") if c in e.columns]
    return e.select("case_id", ends.alias("e"), *rest).select("case_id", "e.key", "e.other", *rest)


def degrees(rels: DataFrame) -> DataFrame:
    """Endpoint counts over all edges; a self-loop counts twice."""
    return rels.select("case_id", F.explode(F.array("source", "target")).alias("key")).groupBy("case_id", "key").agg(F.count("*").alias("degree"))


def connectivity(adj: DataFrame) -> DataFrame:
    """degree, counterparties, repeat connections and relation types of every connected key."""
    # a link once, not once from each end and again for its relation
    links = adj.filter("key < other").select("case_id", "key", "other").distinct()
    met = links.select("case_id", F.explode(F.array("key", "other")).alias("key")).groupBy("case_id", "key").agg(F.count("*").alias("counterparties"))
    return _connected(adj, met)


def _connected(adj: DataFrame, met: DataFrame) -> DataFrame:
    """As ``connectivity``, from the counterparties (case_id, key, counterparties) of all keys of ``adj``."""
    kinds = adj.groupBy("case_id", "key", t.canonical_relation(F.col("relation")).alias("kind")).agg(F.count("*").alias("n"))
    out = kinds.groupBy("case_id", "key").agg(F.sum("n").alias("degree"), F.count("kind").alias("relation_types")).join(met, ["case_id", "key"])
    return out.select("case_id", "key", "degree", "counterparties", "relation_types", F.greatest(F.lit(0), F.col("degree") - F.col("counterparties")).cast("long").alias("repeats"))


def reach_pairs(adj: DataFrame, hops: int = 3) -> DataFrame:
    """Distinct (case_id, key, reached), reached within ``hops`` and other than the key.

    Each hop joins only the pairs that were new in the hop before, on distinct neighbours; the frontier is checkpointed.
    """
    step = cut(adj.select("case_id", F.col("key").alias("a"), F.col("other").alias("b")).distinct())
    seen = step
    frontier = step
    for _ in range(hops - 1):
        onward = frontier.select("case_id", "a", F.col("b").alias("via")).join(step.select("case_id", F.col("a").alias("via"), "b"), ["case_id", "via"])
        found = onward.filter("a <> b").select("case_id", "a", "b").distinct()
        frontier = cut(found.join(seen, ["case_id", "a", "b"], "left_anti"))
        seen = seen.unionByName(frontier)
    return seen.select("case_id", F.col("a").alias("key"), F.col("b").alias("reached"))


def numbered(adj: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, step): keys (case_id, key) with a number n, those of a case one after the other, and the distinct links (a, b) of numbers, both ways as in ``adj``."""
    nodes, half = _numbered_once(adj)
    return nodes, cut(_both_ways(half))


def _both_ways(half: DataFrame) -> DataFrame:
    return half.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")


def _numbered_once(adj: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``numbered``, each link once (a < b) and links of near numbers side by side."""
    nodes = adj.select("case_id", "key").distinct().repartitionByRange("case_id", "key").sortWithinPartitions("case_id", "key")
    nodes = cut(nodes.withColumn("n", F.monotonically_increasing_id()))
    ends = adj.filter("key < other").select("case_id", "key", "other")
    ends = ends.join(nodes.withColumnRenamed("n", "a"), ["case_id", "key"]).join(nodes.select("case_id", F.col("key").alias("other"), F.col("n").alias("b")), ["case_id", "other"])
    # numbers are compared, not keys; rows of one ``a`` are in one range, whose bounds are sampled from a table
    return nodes, cut(cut(ends.select("a", "b")).repartitionByRange("a").distinct())


#: Nodes and links of a part whose links one task holds; words of the bit matrix of a share of its columns at a time, and of its whole matrix; rows that are gathered at once.
PART_NODES, PART_LINKS, PART_WORDS, MATRIX_WORDS, GATHERED = 1 << 20, 3 << 22, 64, 1 << 24, 1 << 11
#: Nodes times links of a share of a part's columns, at least, and links of the small parts that one group holds, about.
SHARE, GROUP_LINKS = 1 << 34, 1 << 19
#: Rounds in which parts are looked for; what has not come to rest then is counted by joins.
ROUNDS = 8


def _stars(batches):
    """Links (a, b) of the same connections as those of ``batches``, a million at a time: every node with the least one it is connected to."""

    def star(held):
        a, b = (np.concatenate([h.column(c).to_numpy() for h in held]) for c in (0, 1))
        ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
        x, y, label = at[: len(a)], at[len(a) :], np.arange(len(ids))
        while (label[x] != label[y]).any():
            low = np.minimum(label[x], label[y])
            # of what two labels stand for as well, so that long chains take few turns
            for side in (x, y, label[x], label[y]):
                np.minimum.at(label, side, low)
            label = label[label]
        return pa.record_batch([pa.array(ids[label]), pa.array(ids)], names=["a", "b"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= 1 << 20:
            yield star(held)
            held, n = [], 0
    if n:
        yield star(held)


def closed_parts(half: DataFrame, part_nodes: int = PART_NODES, part_links: int = PART_LINKS) -> DataFrame:
    """(n, part, links): the nodes of the parts that no link of ``half`` (a, b) leaves, of at most these sizes; ``links``: those of ``half`` that begin at the node.

    Stars of the links of a task have the same connections and are far fewer; on them the least number is passed on for some rounds.
    """
    stars = half.mapInArrow(_stars, "a long, b long").distinct()
    both = cut(_both_ways(stars).distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("part")))
    for turn in range(ROUNDS):
        across = both.join(labels, "a").join(labels.select(F.col("a").alias("b"), F.col("part").alias("other")), "b").filter("part <> other")
        if across.isEmpty():
            across = None
            break
        if turn < ROUNDS - 1:
            labels = cut(both.join(labels.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("part").alias("part")))
    begun = half.groupBy("a").agg(F.count("*").alias("links"))
    known = cut(labels.join(begun, "a", "left").select(F.col("a").alias("n"), "part", F.coalesce("links", F.lit(0)).alias("links")))
    fit = known.groupBy("part").agg(F.count("*").alias("size"), F.sum("links").alias("all")).filter((F.col("size") <= part_nodes) & (F.col("all") <= part_links)).select("part")
    if across is not None:
        fit = fit.join(across.select(F.explode(F.array("part", "other")).alias("part")).distinct(), "part", "left_anti")
    return cut(known.join(fit, "part", "left_semi").select("n", "part", "links"))


class _Rounds:
    """Rows of lists ``at[starts[i]:starts[i + 1]]`` in order of falling length, so that all rows of a stretch are gathered one entry at a time."""

    def __init__(self, rows: np.ndarray, starts: np.ndarray, lengths: np.ndarray, at: np.ndarray):
        order = np.argsort(-lengths, kind="stable")
        self.rows, self.starts, self.lengths, self.at = rows[order], starts[order], lengths[order], at

    def ored(self, seen: np.ndarray):
        """(rows, OR of the rows of ``seen`` in their lists), some rows at a time; the array is used again for the next ones."""
        got, held = (np.empty((GATHERED, seen.shape[1]), np.uint64) for _ in range(2))
        # long lists one by one, in slices
        many = int(np.searchsorted(-self.lengths, -GATHERED, "right"))
        for i in range(many):
            s, e = self.starts[i], self.starts[i] + self.lengths[i]
            held[0] = 0
            for k in range(s, e, GATHERED):
                some = np.take(seen, self.at[k : min(e, k + GATHERED)], axis=0, out=got[: min(e, k + GATHERED) - k], mode="clip")
                held[0] |= np.bitwise_or.reduce(some, axis=0)
            yield self.rows[i : i + 1], held[:1]
        for i in range(many, len(self.rows), GATHERED):
            starts, lengths = self.starts[i : i + GATHERED], self.lengths[i : i + GATHERED]
            held[: len(starts)] = 0
            for k, n in enumerate(np.searchsorted(-lengths, -np.arange(lengths[0]), "left").tolist()):
                np.take(seen, self.at[starts[:n] + k], axis=0, out=got[:n], mode="clip")
                held[:n] |= got[:n]
            yield self.rows[i : i + GATHERED], held[: len(starts)]


def _reach_of_part(a: np.ndarray, b: np.ndarray, peers: np.ndarray, hops: int, share: int = 0, shares: int = 1) -> np.ndarray:
    """How many other ``peers`` each of the nodes 0, 1, ... reaches, of those in one of ``shares`` shares of the columns; every node has a link (a, b), a other than b."""
    size = len(peers)
    src, dst = np.concatenate((a, b)), np.concatenate((b, a))
    order = np.argsort(src, kind="stable")
    starts, dst = np.searchsorted(src[order], np.arange(size + 1)), dst[order]
    del src, order
    total, one = np.zeros(size, np.int64), np.uint64(1)
    columns = 64 * max(1, min(PART_WORDS, MATRIX_WORDS // size))
    for lo in range(share * columns, size, shares * columns):
        own = np.arange(lo, min(size, lo + columns))
        words = -(-len(own) // 64)
        mask = np.zeros(words * 8, np.uint8)
        packed = np.packbits(peers[own], bitorder="little")
        mask[: len(packed)] = packed
        mask = mask.view(np.uint64)
        seen = np.zeros((size, words), np.uint64)
        met, column = dst[starts[lo] : starts[own[-1] + 1]], np.repeat(own - lo, np.diff(starts[lo : own[-1] + 2]))
        np.bitwise_or.at(seen, (met, column >> 6), one << (column & 63).astype(np.uint64))
        changed = np.zeros(size, bool)
        changed[met] = True
        counted = np.zeros(size, bool)
        for hop in range(2, hops + 1):
            # only links to rows that the hop before changed bring anything new
            on = changed[dst]
            ends = np.concatenate(([0], np.cumsum(on)))[starts]
            rows = np.flatnonzero(np.diff(ends))
            rounds = _Rounds(rows, ends[rows], ends[rows + 1] - ends[rows], dst if on.all() else dst[on])
            changed = np.zeros(size, bool)
            if hop == hops:
                for some, bits in rounds.ored(seen):
                    bits |= seen[some]
                    bits &= mask
                    total[some] += np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
                    counted[some] = True
                break
            grown = np.empty((len(rows), words), np.uint64)
            at, done = np.empty(len(rows), np.int64), 0
            for some, bits in rounds.ored(seen):
                bits |= seen[some]
                changed[some] = (bits != seen[some]).any(axis=1)
                grown[done : done + len(some)], at[done : done + len(some)] = bits, some
                done += len(some)
            seen[at] = grown
        rest = np.flatnonzero(~counted)
        for i in range(0, len(rest), GATHERED):
            total[rest[i : i + GATHERED]] += np.bitwise_count(seen[rest[i : i + GATHERED]] & mask).sum(axis=1, dtype=np.int64)
        if hops > 1:
            # by a link and back
            total[own] -= peers[own]
    return total


def _counted_parts(people: DataFrame, half: DataFrame, parts: DataFrame, hops: int, share: float = SHARE) -> DataFrame:
    """(n, reach) of all nodes of ``parts``; people: (n, peer).

    A group holds the links of some small parts, which are counted one after the other, or those of a large part and a share of the columns of its bit matrix: what a group holds at a
    time grows with its links alone, and a part's links travel once for each share.
    """
    cores = people.sparkSession.sparkContext.defaultParallelism
    work = F.col("size").cast("double") * F.col("all")
    sizes = cut(parts.groupBy("part").agg(F.count("*").alias("size"), F.sum("links").alias("all")))
    total, links = sizes.agg(F.sum(work), F.sum("all")).first()
    groups = max(1, (links or 0) // GROUP_LINKS)
    shares = F.greatest(F.lit(1), F.ceil(work / max(share, (total or 0) / (4 * cores)))).cast("int")
    dealt = F.when(F.col("shares") > 1, -1 - F.col("part")).otherwise(F.pmod(F.xxhash64("part"), F.lit(groups))).alias("g")
    parts = parts.join(sizes.select("part", shares.alias("shares")), "part")
    each = F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share")
    nodes = people.join(parts.select("n", "part", "shares"), "n").select(dealt, "shares", each, "part", "n", "peer")
    links = half.join(parts.select(F.col("n").alias("a"), *[F.col(c).alias(c) for c in ("part", "shares")]), "a").select(dealt, each, "part", "a", "b")
    # small rows, long work: a number of tasks that adaptive execution leaves as it is
    tasks = int(people.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nodes, links = (df.repartition(tasks, "g", "share") for df in (nodes, links))

    def run(held: pa.Table, linked: pa.Table) -> pa.Table:
        held, linked = held.sort_by([("part", "ascending"), ("n", "ascending")]), linked.sort_by("part")
        of, n, peer = (held.column(c).to_numpy() for c in ("part", "n", "peer"))
        at, a, b = (linked.column(c).to_numpy() for c in ("part", "a", "b"))
        first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(of) else np.empty(0, np.int64)
        out = np.zeros(len(n), np.int64)
        mine = (held.column("share")[0].as_py(), held.column("shares")[0].as_py()) if len(n) else ()
        for i, j, s, e in zip(first, [*first[1:], len(n)], np.searchsorted(at, of[first]), np.searchsorted(at, of[first], "right")):
            out[i:j] = _reach_of_part(np.searchsorted(n[i:j], a[s:e]), np.searchsorted(n[i:j], b[s:e]), peer[i:j], hops, *mine)
        return pa.table({"n": n, "reach": out})

    found = nodes.groupBy("g", "share").cogroup(links.groupBy("g", "share")).applyInArrow(run, "n long, reach long")
    return found.groupBy("n").agg(F.sum("reach").alias("reach"))


def near(adj: DataFrame, keys: DataFrame, hops: int) -> DataFrame:
    """(case_id, key) of ``keys`` and of all keys within ``hops`` links of one of them."""
    step = cut(adj.select("case_id", "key", "other").distinct())
    seen = front = cut(keys.select("case_id", "key").distinct())
    for _ in range(hops):
        onward = step.join(front, ["case_id", "key"], "left_semi").select("case_id", F.col("other").alias("key")).distinct()
        front = cut(onward.join(seen, ["case_id", "key"], "left_anti"))
        seen = seen.unionByName(front)
    return seen


def merge_twins(step: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes (n, twin), links (a, b)): nodes with equal neighbours, and nodes that are linked with each other and have all others in common, become one class.

    Such nodes reach the same nodes, so one of them stands for its class: ``links`` holds the links between classes, numbered anew so that classes with a common
    least neighbour lie side by side, and of a class whose members are linked with each other a link to itself. Neighbour lists are compared by two XORs
    of 64-bit hashes and their length; no list is gathered.
    """
    mark = lambda seed, c: F.xxhash64(F.lit(seed), c)
    sets = step.groupBy("a").agg(F.bit_xor(mark(1, "b")).alias("s"), F.bit_xor(mark(2, "b")).alias("t"), F.count("*").alias("d"), F.min("b").alias("near"))
    sets = cut(sets.withColumns({"s_own": F.col("s").bitwiseXOR(mark(1, "a")), "t_own": F.col("t").bitwiseXOR(mark(2, "a"))}))
    # a node has twins of one kind at most
    apart = sets.groupBy("s", "t", "d").agg(F.min("a").alias("first"))
    linked = sets.groupBy("s_own", "t_own", "d").agg(F.min("a").alias("first_linked"), F.count("*").alias("size_linked"))
    found = sets.join(apart, ["s", "t", "d"]).join(linked, ["s_own", "t_own", "d"])
    found = cut(found.select("a", "near", F.least("first", "first_linked").alias("head"), (F.col("size_linked") > 1).alias("closed")))
    heads = found.filter("a = head").repartitionByRange("near", "a").sortWithinPartitions("near", "a")
    heads = cut(heads.select("head", "closed", F.monotonically_increasing_id().alias("twin")))
    classes = found.join(heads, "head").select(F.col("a").alias("n"), "twin")
    one, two = heads.select(F.col("head").alias("a"), F.col("twin").alias("ta")), heads.select(F.col("head").alias("b"), F.col("twin").alias("tb"))
    links = step.join(one, "a").join(two, "b").select(F.col("ta").alias("a"), F.col("tb").alias("b"))
    return classes, cut(links.unionByName(heads.filter("closed").select(F.col("twin").alias("a"), F.col("twin").alias("b"))))


#: 64-bit words of a block of a bit set, and rows that the joins of one tile may make.
WORDS, TILE_ROWS = 4, 2**32
_W = [f"w{k}" for k in range(WORDS)]


def _bits(c: str) -> list:
    """The block of number ``c`` and its words, of which one has the number's bit."""
    word = F.expr(f"shiftright({c}, 6)")
    of = [F.when(F.pmod(word, F.lit(WORDS)) == k, F.expr(f"shiftleft(1L, int({c} & 63))")).otherwise(F.lit(0).cast("long")).alias(w) for k, w in enumerate(_W)]
    return [F.floor(word / WORDS).alias("block"), *of]


def _or(*more) -> list:
    return [F.bit_or(w).alias(w) for w in _W] + list(more)


def reached_bits(links: DataFrame, hops: int, rows: int = TILE_ROWS, of: DataFrame | None = None):
    """Tiles (a, block, w0, w1, ...) of what every node of ``links`` (a, b) reaches by 1 to ``hops`` links, as bit sets in blocks of words; a block may come in several rows.

    A tile holds all rows of a share of the blocks; tiles need nothing of each other, so what is stored at a time has a bound however large a case is. The number of
    tiles comes from the rows that the join of the second hop makes. A hop joins only bits that the hop before found, and the last hop's bits are not stored.
    ``of`` (a): only the sets of these nodes are wanted; sets of others are made only as far as these need them.
    """
    # by the hops that are still to come: the links from nodes whose sets these hops need
    by_hop = [links] * hops
    if of is not None:
        need = cut(of.select("a").distinct())
        for k in range(hops):
            by_hop[hops - 1 - k] = links.join(need, "a", "left_semi")
            if k < hops - 1:
                need = cut(need.unionByName(by_hop[hops - 1 - k].select(F.col("b").alias("a"))).distinct())
    first = cut(by_hop[0].select("a", *_bits("b")).groupBy("a", "block").agg(*_or()))
    tiles = 1
    if hops > 1:
        made = by_hop[1].join(first.groupBy("a").agg(F.count("*").alias("m")).withColumnRenamed("a", "b"), "b").agg(F.sum("m")).first()[0] or 0
        tiles = max(1, -(-made // rows))
    for tile in range(tiles):
        seen = frontier = first if tiles == 1 else first.filter(F.pmod("block", F.lit(tiles)) == tile)
        for hop in range(2, hops + 1):
            onward = by_hop[hop - 1].join(frontier.withColumnRenamed("a", "b"), "b").select("a", "block", *_W)
            if hop < hops:
                none = F.lit(0).cast("long")
                both = onward.select("a", "block", *_W, *[none.alias(f"old_{w}") for w in _W]).unionByName(seen.select("a", "block", *[none.alias(w) for w in _W], *[F.col(w).alias(f"old_{w}") for w in _W]))
                new = both.groupBy("a", "block").agg(*[F.bit_or(w).bitwiseAND(F.bitwise_not(F.bit_or(f"old_{w}"))).alias(w) for w in _W])
                onward = frontier = cut(new.filter(" OR ".join(f"{w} <> 0" for w in _W)))
            seen = seen.unionByName(onward)
        yield seen if of is None else seen.join(of.select("a").distinct(), "a", "left_semi")


def reach_counts(adj: DataFrame, hops: int = 3, peers: DataFrame | None = None, rows: int = TILE_ROWS, of: DataFrame | None = None, part_nodes: int = PART_NODES) -> DataFrame:
    """(case_id, key, reach): how many other keys (of ``peers``, if given) are reached within ``hops``; keys without a link have no row. ``of``: only for these (case_id, key).

    The pairs of ``reach_pairs`` are never made. Parts of a case that no link leaves and that have ``part_nodes`` keys at most are counted by one task each, so only their links are
    shuffled; all other keys by joins (``_joined_counts``).
    """
    nodes, half = _numbered_once(adj)
    return _reach_of(nodes, half, hops, peers, rows, of, part_nodes)


def reach_and_connectivity(adj: DataFrame, hops: int, peers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What ``reach_counts`` and ``connectivity`` give; the links are found once for both."""
    nodes, half = _numbered_once(adj)
    met = half.select(F.explode(F.array("a", "b")).alias("n")).groupBy("n").agg(F.count("*").alias("counterparties"))
    return _reach_of(nodes, half, hops, peers), _connected(adj, nodes.join(met, "n").drop("n"))


def _reach_of(nodes: DataFrame, half: DataFrame, hops: int, peers: DataFrame | None, rows: int = TILE_ROWS, of: DataFrame | None = None, part_nodes: int = PART_NODES) -> DataFrame:
    known = F.lit(True) if peers is None else F.coalesce("peer", F.lit(False))
    people = nodes if peers is None else nodes.join(peers.select("case_id", "key").distinct().withColumn("peer", F.lit(True)), ["case_id", "key"], "left")
    people = cut(people.select("n", "case_id", "key", known.alias("peer")))
    parts = closed_parts(half, part_nodes)
    larger = people.join(parts, "n", "left_anti")
    wanted = people if of is None else people.join(of.select("case_id", "key").distinct(), ["case_id", "key"], "left_semi")
    if of is not None:
        parts = parts.join(parts.join(wanted, "n", "left_semi").select("part").distinct(), "part", "left_semi")
    out = cut(_counted_parts(people.select("n", "peer"), half, parts, hops))
    if not larger.isEmpty():
        larger = cut(larger)
        rest = cut(_both_ways(half.join(larger.select(F.col("n").alias("a")), "a", "left_semi")))
        out = out.unionByName(_joined_counts(rest, larger, hops, rows, None if of is None else wanted.select("n")))
    return wanted.join(out, "n").select("case_id", "key", "reach")


def _joined_counts(step: DataFrame, people: DataFrame, hops: int, rows: int, of: DataFrame | None) -> DataFrame:
    """(n, reach) of ``people`` (n, peer), or of those of them in ``of`` (n).

    Keys with the same neighbours are merged to classes (``merge_twins``), and bit sets of classes are joined tile by tile
    (``reached_bits``). A class counts as often as it has peers: weights are kept as bit planes beside each block, so a count is a sum of ``bit_count``.
    """
    classes, links = merge_twins(step)
    people = cut(people.select("n", "peer").join(classes, "n"))
    planes = people.groupBy("twin").agg(F.count_if("peer").alias("weight"))
    planes = planes.select("twin", "weight", F.explode(F.sequence(F.lit(0), F.lit(62))).alias("plane")).filter(F.expr("shiftright(weight, plane) & 1") == 1)
    planes = planes.select("plane", *_bits("twin")).groupBy("block", "plane").agg(*_or())
    planes = cut(planes.groupBy("block").agg(F.collect_list(F.struct("plane", *[F.col(w).alias(f"p_{w}") for w in _W])).alias("planes")))
    ones = lambda p: sum((F.bit_count(F.col(w).bitwiseAND(p[f"p_{w}"])) for w in _W[1:]), F.bit_count(F.col(_W[0]).bitwiseAND(p[f"p_{_W[0]}"])))
    weight = F.aggregate("planes", F.lit(0).cast("long"), lambda total, p: total + F.call_function("shiftleft", ones(p).cast("long"), p["plane"]))
    block, *own = _bits("a")
    itself = sum((F.bit_count(F.col(w).bitwiseAND(o)) for w, o in zip(_W[1:], own[1:], strict=True)), F.bit_count(F.col(_W[0]).bitwiseAND(own[0])))
    itself = F.when(F.col("block") == block, itself).otherwise(0)
    if of is not None:
        people = cut(people.join(of, "n", "left_semi"))
    counts = []
    for seen in reached_bits(links, hops, rows, None if of is None else people.select(F.col("twin").alias("a"))):
        whole = seen.groupBy("a", "block").agg(*_or())
        counts.append(cut(whole.join(planes, "block").groupBy("a").agg(F.sum(weight).alias("reach"), F.max(itself).alias("itself"))))
    counts = reduce(DataFrame.unionByName, counts).groupBy("a").agg(F.sum("reach").alias("reach"), F.max("itself").alias("itself"))
    # a class that reaches itself counts the key itself, if that is a peer
    out = people.join(counts, people.twin == counts.a, "left")
    return out.select("n", (F.coalesce("reach", F.lit(0)) - F.when(F.col("peer"), F.coalesce("itself", F.lit(0))).otherwise(0)).cast("long").alias("reach"))


def shortest_paths(pairs: DataFrame, rels: DataFrame, max_hops: int = 5, exclude=()) -> DataFrame:
    """(pair_id, hops, path, relations) for pairs (pair_id, case_id, source, target) that are connected within ``max_hops``.

    Edges of all relations (but ``exclude``) count both ways. Among shortest paths that with the least sequence of keys is
    taken, and of parallel edges that with the least id. Each pair is searched from both ends; a hop moves on the side that has fewer nodes
    at its front, and a pair is done when the fronts have a node in common. Each side keeps one row for each pair and node.
    """
    e = rels.filter("source <> target").filter(~F.col("relation").isin(*exclude)) if exclude else rels.filter("source <> target")
    ends = F.explode(F.array(F.struct(F.col("source").alias("node"), F.col("target").alias("next")), F.struct(F.col("target").alias("node"), F.col("source").alias("next"))))
    both = e.select("case_id", ends.alias("e"), "id", "relation").select("case_id", "e.node", "e.next", "id", "relation")
    both = cut(both.groupBy("case_id", "node", "next").agg(F.min_by("relation", "id").alias("relation")))
    none = F.array().cast("array<string>")
    start = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("source").alias("node")), F.struct(F.lit(1).alias("side"), F.col("target").alias("node"))))
    front = cut(pairs.filter("source <> target").select("pair_id", "case_id", start.alias("e")).select("pair_id", "case_id", "e.side", "e.node", F.array("e.node").alias("path"), none.alias("relations")))
    done = pairs.filter("source = target").select("pair_id", F.array("source").alias("path"), none.alias("relations"))
    seen = front.select("pair_id", "side", "node")
    ahead = F.col("side") == 0
    for _ in range(max_hops):
        if front.isEmpty():
            break
        sizes = front.groupBy("pair_id").agg(F.count_if(ahead).alias("f"), F.count_if(~ahead).alias("b")).filter("f > 0 AND b > 0")
        turn = front.join(sizes.select("pair_id", F.when(F.col("f") <= F.col("b"), 0).otherwise(1).alias("turn")), "pair_id")
        grown = turn.filter("side = turn").join(both.withColumnRenamed("relation", "by"), ["case_id", "node"])
        path = F.when(ahead, F.concat("path", F.array("next"))).otherwise(F.concat(F.array("next"), "path"))
        by = F.when(ahead, F.concat("relations", F.array("by"))).otherwise(F.concat(F.array("by"), "relations"))
        grown = grown.groupBy("pair_id", "case_id", "side", F.col("next").alias("node")).agg(F.min(F.struct(path.alias("path"), by.alias("relations"))).alias("p"))
        grown = grown.join(seen, ["pair_id", "side", "node"], "left_anti").select("pair_id", "case_id", "side", "node", "p.path", "p.relations")
        now = cut(grown.withColumn("new", F.lit(True)).unionByName(turn.filter("side <> turn").drop("turn").withColumn("new", F.lit(False))))
        there = now.filter(~ahead).select("pair_id", "node", F.col("path").alias("rest"), F.col("relations").alias("rest_by"))
        joined = F.struct(F.concat("path", F.slice("rest", 2, F.greatest(F.size("rest") - 1, F.lit(0)))).alias("path"), F.concat("relations", "rest_by").alias("relations"))
        met = cut(now.filter(ahead).join(there, ["pair_id", "node"]).groupBy("pair_id").agg(F.min(joined).alias("p")).select("pair_id", "p.path", "p.relations"))
        done = done.unionByName(met)
        seen = seen.unionByName(now.filter("new").select("pair_id", "side", "node"))
        front = cut(now.drop("new").join(met, "pair_id", "left_anti"))
    return done.select("pair_id", F.size("relations").cast("long").alias("hops"), "path", "relations")


def dangling(rels: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges with an endpoint that is no entity."""
    keys = entities.select("key").distinct().withColumn("known", F.lit(True))
    s, d = keys.select(F.col("key").alias("source"), F.col("known").alias("s_known")), keys.select(F.col("key").alias("target"), F.col("known").alias("t_known"))
    return rels.join(s, "source", "left").join(d, "target", "left").filter("s_known IS NULL OR t_known IS NULL").drop("s_known", "t_known")


def filter_graph(nodes: DataFrame, rels: DataFrame, query: str = "", label: str | None = None, bucket: str | None = None, relation: str | None = None):
    """(nodes, edges) that a user sees: nodes by text, label and risk bucket (HIGH, MODERATE, LOW), edges by relation with both ends seen."""
    n = nodes.filter(t.contains_any([F.col("name"), F.col("key"), F.col("label")], F.lit(query)))
    if label:
        n = n.filter(F.col("label") == label)
    if bucket:
        r = F.col("risk")
        n = n.filter({"HIGH": r >= 70, "MODERATE": (r >= 40) & (r < 70), "LOW": r < 40}[bucket])
    e = rels.filter(F.col("relation") == relation) if relation else rels
    keys = n.select("case_id", "key").distinct()
    e = e.join(keys.withColumnRenamed("key", "source"), ["case_id", "source"], "left_semi").join(keys.withColumnRenamed("key", "target"), ["case_id", "target"], "left_semi")
    return n, e


def typed_subgraph(rels: DataFrame, relation: str, entities: DataFrame | None = None, label: str | None = None) -> DataFrame:
    """Edges of one relation, both ends entities of ``label`` if given."""
    e = rels.filter(F.col("relation") == relation)
    if label:
        keys = entities.filter(F.col("label") == label).select("key").distinct()
        e = e.join(keys.withColumnRenamed("key", "source"), "source", "left_semi").join(keys.withColumnRenamed("key", "target"), "target", "left_semi")
    return e


def property_graph(entities: DataFrame, rels: DataFrame):
    """(nodes, edges) for export: a node a key, an edge a (source, target, type) with the newest row's values, both ends present."""
    nodes = entities.groupBy("key").agg(F.max_by(F.struct("label", "name"), "id").alias("n")).select("key", "n.*")
    e = rels.withColumn("type", t.relation_type(F.col("relation")))
    e = e.groupBy("source", "target", "type").agg(F.max_by(F.struct("timestamp", "amount"), "id").alias("v")).select("source", "target", "type", "v.*")
    keys = nodes.select("key")
    return nodes, e.join(keys.withColumnRenamed("key", "source"), "source", "left_semi").join(keys.withColumnRenamed("key", "target"), "target", "left_semi")


def current_case(cases: DataFrame, entities: DataFrame, prefer: str) -> DataFrame:
    """One row a case id: the case itself, else an Incident, else a Case entity of the preferred name, else any Case entity."""
    c = cases.select("case_id", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("id"), F.col("title").alias("name"))
    e = entities.select("case_id", F.when(F.col("label") == "Incident", 2).when((F.col("label") == "Case") & F.lower("name").contains(prefer.lower()), 3).when(F.col("label") == "Case", 4).alias("rank"), "id", "name").filter("rank IS NOT NULL")
    return c.unionByName(e).groupBy("case_id").agg(F.min(F.struct("rank", "id", "name")).alias("m")).select("case_id", F.col("m.rank").alias("rank"), F.col("m.name").alias("name"))


def connections(rels: DataFrame, entities: DataFrame) -> DataFrame:
    """Dossier rows: every entity's edges with direction and the other end; edges whose other end is unknown are left out."""
    ends = F.explode(F.array(F.struct(F.col("source").alias("key"), F.col("target").alias("other")), F.struct(F.col("target").alias("key"), F.col("source").alias("other"))))
    b = rels.filter("source <> target").select("case_id", ends.alias("e"), "source", "relation", "timestamp", "amount").select("case_id", "e.key", "e.other", t.direction(F.col("source"), F.col("e.key")).alias("direction"), "relation", "timestamp", "amount")
    names = entities.select(F.col("key").alias("other"), F.col("name").alias("other_name"), F.col("label").alias("other_label"))
    return b.join(names, "other")


def sorted_connections(rels: DataFrame, entities: DataFrame) -> DataFrame:
    """All dossier rows with their place: by lower name, relation, other key, time, direction and amount, for each entity of a case."""
    w = Window.partitionBy("case_id", "key").orderBy(F.lower("other_name"), "relation", "other", "timestamp", "direction", "amount")
    return connections(rels, entities).withColumn("place", F.row_number().over(w))


def dossier(rels: DataFrame, entities: DataFrame, scored: DataFrame) -> DataFrame:
    """A row an entity of a case: its cases in all, connections by direction, degree, risk, band and factors. Entities outside the case give no row.

    scored: what ``risk.entity_risk`` gives. Connections themselves: ``sorted_connections``.
    """
    inside = members(rels, entities)
    home = inside.groupBy("key").agg(F.array_sort(F.collect_set("case_id")).alias("cases"))
    seen = connections(rels, entities).groupBy("case_id", "key").agg(F.count("*").alias("connections"), F.count_if(F.col("direction") == "OUTGOING").alias("outgoing"))
    named = entities.groupBy("key").agg(F.min_by(F.struct("label", "name"), "id").alias("e")).select("key", "e.*")
    out = inside.join(named, "key").join(home, "key").join(seen, ["case_id", "key"], "left").join(scored.select("case_id", "key", "degree", "score", "band", "factors"), ["case_id", "key"], "left")
    return out.fillna(0, ["connections", "outgoing", "degree"])


def with_endpoints(rels: DataFrame, entities: DataFrame) -> DataFrame:
    """``rels`` with name and label of both ends; an end that is no entity is shown by its key, as an Entity."""
    out = rels
    for side in ("source", "target"):
        e = entities.select(F.col("key").alias(side), F.col("name").alias(f"{side}_name"), F.col("label").alias(f"{side}_label"))
        out = out.join(e, side, "left")
    for side in ("source", "target"):
        out = out.withColumns({f"{side}_name": F.coalesce(f"{side}_name", side), f"{side}_label": F.coalesce(f"{side}_label", F.lit("Entity"))})
    return out


def distinct_edges(rels: DataFrame) -> DataFrame:
    """The first row (by id) of each (case_id, source, target, relation, timestamp), without self edges."""
    on = ["case_id", "source", "target", "relation", "timestamp"]
    rest = [c for c in rels.columns if c not in on]
    return rels.filter("source <> target").groupBy(*on).agg(F.min_by(F.struct(*rest), "id").alias("r")).select(*on, "r.*")


def remap(rels: DataFrame, to: DataFrame) -> DataFrame:
    """Endpoints renamed by (key, to); edges that become self edges go, repeats merge, and a missing relation is RELATED_TO."""
    out = rels
    for side in ("source", "target"):
        out = out.join(to.select(F.col("key").alias(side), F.col("to").alias(f"new_{side}")), side, "left").withColumn(side, F.coalesce(f"new_{side}", side))
    return out.select("case_id", "source", "target", F.coalesce("relation", F.lit("RELATED_TO")).alias("relation"), "timestamp").filter("source <> target").distinct()


def payload(rels: DataFrame, entities: DataFrame, scored: DataFrame):
    """(nodes, edges) to draw: every member of a case with name, risk and band, and every edge between two of them."""
    nodes = members(rels, entities).join(entities.groupBy("key").agg(F.min_by(F.struct("label", "name"), "id").alias("e")).select("key", "e.*"), "key")
    nodes = nodes.join(scored.select("case_id", "key", F.col("score").alias("risk"), "band"), ["case_id", "key"], "left")
    keys = nodes.select("case_id", "key")
    edges = rels.join(keys.withColumnRenamed("key", "source"), ["case_id", "source"], "left_semi").join(keys.withColumnRenamed("key", "target"), ["case_id", "target"], "left_semi")
    return nodes, edges.select("case_id", "id", "source", "target", t.edge_label(F.col("relation"), F.col("amount"), F.col("timestamp")).alias("label"), "timestamp", "amount")


def top_by_degree(rels: DataFrame, k: int = 10) -> DataFrame:
    w = Window.partitionBy("case_id").orderBy(F.desc("degree"), "key")
    return degrees(rels).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

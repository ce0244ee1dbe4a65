"""Document fingerprints as invertible Bloom lookup sketches of hashed paragraphs, in DataFrame and SQL functions only.

A text's paragraphs (lines, runs of sentences, and stretches of long ones that have neither) are dealt by digest into blocks, and each block is a small sketch: three tables of cells. A
paragraph's 40-bit digest falls on one cell of each table, which sums a count, the digests and their check values. A cell that holds one
digest alone (however often) shows it; taking it off its other cells uncovers more, until all are zero: peeling. A block that can't be
peeled is made again with larger tables, so a fingerprint gives back its own paragraphs. Two fingerprints subtract cell by cell, which leaves
what differs; where that can't be peeled, both blocks are made again larger from their own paragraphs. Nothing but fingerprints enters a likeness.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, table
from .sharding import Cuts, part_of, range_cuts

#: Ends of paragraphs: line ends, and blanks between sentences where the next begins with one of five letters (about a fourth of them, wherever the text is cut).
#: What is longer than LONG code points after that, in any script, ends after every four code points whose hash is 0 modulo STRETCH as well, so that where it ends depends on what stands there.
LONG, STRETCH = 1024, 256
#: A paragraph's repeats in a cell: sums stay below 2**63.
MANY = 1 << 20
ENDS = r"\n|(?<=[.!?]) (?=[A-E])"
#: Cells in each of a block's three tables, the next ones for blocks that can't be peeled; paragraphs of a block, about.
WIDTHS = (8, 16, 32, 64, 256, 1024)
LOAD = 12
#: Rounds of peeling after which a sketch counts as one that cannot be peeled.
ROUNDS = 8
#: Characters of text in a bin of neighbouring documents, about, and the most bins.
BIN_CHARS = 1 << 20
MAX_BINS = 16384
_INNER = 128
_CELLS = "array<struct<c: bigint, k: bigint, x: bigint>>"
_BLOCK = f"struct<w: int, cells: {_CELLS}, d: array<struct<k: bigint, c: bigint>>>"


def digests_sql(text: str) -> str:
    """40-bit digests of a text's paragraphs."""
    digest = lambda p: f"shiftrightunsigned(xxhash64({p}), 24)"
    here = f"(xxhash64(concat(cs[i - 3], cs[i - 2], cs[i - 1], c)) & {STRETCH - 1}) = 0"
    ends = f"filter(transform(cs, (c, i) -> IF(i < 3, 0, IF({here}, i + 1, 0))), x -> x > 0 AND x < size(cs))"
    parts = f"transform(sequence(0, size(bs) - 2), j -> {digest("array_join(slice(cs, bs[j] + 1, bs[j + 1] - bs[j]), '')")})"
    stretches = _bind("regexp_extract_all(p, '(?s).', 0)", "cs", _bind(f"concat(array(0), {ends}, array(size(cs)))", "bs", parts))
    return f"flatten(transform(split({text}, r'{ENDS}', -1), p -> IF(length(p) <= {LONG}, array({digest('p')}), {stretches})))"


def counted_sql(digests: str) -> str:
    """(k digest, c count) of the distinct ones of an array of digests, by digest."""
    last = "filter(transform(ks, (k, i) -> IF(i = size(ks) - 1, named_struct('k', k, 'i', i), IF(ks[i + 1] <> k, named_struct('k', k, 'i', i), NULL))), e -> e IS NOT NULL)"
    counted = "transform(ls, (e, j) -> named_struct('k', e.k, 'c', CAST(IF(j = 0, e.i + 1, e.i - ls[j - 1].i) AS BIGINT)))"
    return _bind(f"array_sort({digests})", "ks", _bind(last, "ls", counted))


def _check(k: str) -> str:
    return f"shiftrightunsigned(xxhash64({k}, 1), 40)"


def _bind(value: str, name: str, body: str) -> str:
    """SQL: body, with ``name`` for a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _placed(k: str, c: str, width: int) -> str:
    """A digest with its count, check value and the numbers of its three cells."""
    bits = width.bit_length() - 1
    at = ", ".join(f"'p{t}', int(shiftrightunsigned(h, {bits * t}) & {width - 1}) + {t * width}" for t in range(3))
    return _bind(f"xxhash64({k}, {width})", "h", f"named_struct('k', {k}, 'c', {c}, 'x', {_check(k)}, {at})")


def cells_sql(entries: str, width: int) -> str:
    """Cells (c, k, x) of an array of (k digest, c count); the sketch is the same in any order of the array."""
    add = "IF(y.p0 = i OR y.p1 = i OR y.p2 = i, named_struct('c', a.c + y.c, 'k', a.k + y.c * y.k, 'x', a.x + y.c * y.x), a)"
    cells = f"transform(sequence(0, {3 * width - 1}), i -> aggregate(ys, named_struct('c', 0L, 'k', 0L, 'x', 0L), (a, y) -> {add}))"
    return _bind(f"transform({entries}, e -> {_placed('e.k', 'e.c', width)})", "ys", cells)


def peel_sql(cells: str, width: int, most: str) -> str:
    """(k, c) of all digests that cells hold, ``most`` at most; null if they cannot be peeled whole (in ROUNDS rounds)."""
    pure = f"IF(c.c = 0, false, c.k % c.c = 0 AND c.x = c.c * {_check('(c.k div c.c)')})"
    # all cells that show a digest at once, each digest once
    shown = f"array_distinct(transform(filter(s.cells, c -> {pure}), c -> named_struct('k', c.k div c.c, 'c', c.c)))"
    found = f"transform({shown}, e -> {_placed('e.k', 'e.c', width)})"
    off = "IF(i = y.p0 OR i = y.p1 OR i = y.p2, named_struct('c', c.c - y.c, 'k', c.k - y.c * y.k, 'x', c.x - y.c * y.x), c)"
    # a round that shows nothing is the last
    take = f"aggregate(ys, s, (t, y) -> named_struct('cells', transform(t.cells, (c, i) -> {off}), 'd', concat(t.d, array(named_struct('k', y.k, 'c', y.c))), 'go', true))"
    step = f"IF(s.go, {_bind(found, 'ys', f"IF(size(ys) = 0, named_struct('cells', s.cells, 'd', s.d, 'go', false), {take})")}, s)"
    start = f"named_struct('cells', {cells}, 'd', CAST(array() AS array<struct<k: bigint, c: bigint>>), 'go', true)"
    run = f"aggregate(sequence(1, least({ROUNDS}, greatest(1, {most}))), {start}, (s, r) -> {step})"
    return _bind(run, "z", "IF(forall(z.cells, c -> c.c = 0 AND c.k = 0 AND c.x = 0), z.d, NULL)")


def block_sql(entries: str) -> str:
    """The smallest sketch of a block's (k, c) that can be peeled: (w, cells, d paragraphs as peeled). Where none can, or one paragraph is there over MANY times, w is 0 and the cells list the paragraphs."""
    tries = [_bind(cells_sql(entries, w), "cs", _bind(peel_sql("cs", w, f"size({entries})"), "f", f"IF(f IS NULL, CAST(NULL AS {_BLOCK}), named_struct('w', {w}, 'cells', cs, 'd', f))")) for w in WIDTHS]
    listed = f"named_struct('w', 0, 'cells', transform({entries}, e -> named_struct('c', e.c, 'k', e.k, 'x', 0L)), 'd', transform({entries}, e -> named_struct('k', e.k, 'c', e.c)))"
    return f"IF(exists({entries}, e -> e.c > {MANY}), {listed}, coalesce({', '.join(tries)}, {listed}))"


def sketch_sql(entries: str, bits: str) -> str:
    """A fingerprint of 2**bits blocks from an array of (k, c); entries are dealt in two rounds, so that long texts cost little more than in proportion."""
    low = f"({bits} div 2)"
    dealt = f"transform({entries}, e -> named_struct('k', e.k, 'c', e.c, 'b', int(xxhash64(e.k, 7) & (shiftleft(1, {bits}) - 1))))"
    first = f"transform(sequence(0, shiftleft(1, {low}) - 1), g -> filter(es, e -> (e.b & (shiftleft(1, {low}) - 1)) = g))"
    second = f"transform(sequence(0, shiftleft(1, {bits} - {low}) - 1), j -> filter(gs, e -> shiftright(e.b, {low}) = j))"
    blocks = f"flatten(transform({first}, gs -> {second}))"
    return _bind(dealt, "es", f"transform({blocks}, bs -> {block_sql('bs')})")


def bits_sql(n: str) -> str:
    """Blocks of a text of n distinct paragraphs, as a power of two."""
    return f"int(greatest(0, ceil(log2({n} / {LOAD}.0))))"


def text_sketch_sql(digests: str) -> str:
    return _bind(counted_sql(digests), "ds", sketch_sql("ds", bits_sql("size(ds)")))


def _difference(p: str, q: str) -> str:
    """Paragraphs (repeats counted) that differ between two blocks."""
    tries = []
    for w in WIDTHS:
        a, b = (f"IF({x}.w = {w}, {x}.cells, {cells_sql(f'{x}.d', w)})" for x in (p, q))
        minus = f"zip_with({a}, {b}, (m, n) -> named_struct('c', m.c - n.c, 'k', m.k - n.k, 'x', m.x - n.x))"
        peeled = _bind(peel_sql(minus, w, f"size({p}.d) + size({q}.d)"), "f", "IF(f IS NULL, CAST(NULL AS BIGINT), aggregate(f, 0L, (t, e) -> t + abs(e.c)))")
        tries.append(f"IF({w} < greatest({p}.w, {q}.w), CAST(NULL AS BIGINT), {peeled})")
    of = lambda x: f"aggregate({x}.d, 0L, (t, e) -> IF(e.k = k, t + e.c, t))"
    listed = f"aggregate(array_distinct(transform(concat({p}.d, {q}.d), e -> e.k)), 0L, (u, k) -> u + abs({of(p)} - {of(q)}))"
    sketched = f"coalesce({', '.join(tries)}, {listed})"
    return f"IF({p}.cells = {q}.cells, 0L, IF({p}.w = 0 OR {q}.w = 0, {listed}, {sketched}))"


def _larger(sketch: str, other: str) -> str:
    """``sketch`` with as many blocks as ``other`` where that has more, made again from its own paragraphs."""
    again = sketch_sql(f"flatten(transform({sketch}, b -> b.d))", f"int(log2(size({other})))")
    return f"IF(size({sketch}) >= size({other}), {sketch}, {again})"


def difference_sql(a: str, b: str) -> str:
    return f"aggregate(zip_with({a}, {b}, (p, q) -> {_difference('p', 'q')}), 0L, (t, d) -> t + d)"


def count_sql(sketch: str) -> str:
    """Paragraphs that a fingerprint holds, repeats counted."""
    return f"aggregate({sketch}, 0L, (t, b) -> t + aggregate(b.d, 0L, (u, e) -> u + e.c))"


def hex_sql(sketch: str) -> str:
    """A fingerprint as text: blocks parted by bars, a block's cells by blanks; empty cells are left blank. A block that lists its paragraphs begins with an exclamation mark."""
    cell = "IF(c.c = 0 AND c.k = 0 AND c.x = 0, '', concat_ws('.', lower(hex(c.c)), lower(hex(c.k)), lower(hex(c.x))))"
    return f"array_join(transform({sketch}, b -> concat(IF(b.w = 0, '!', ''), array_join(transform(b.cells, c -> {cell}), ' '))), '|')"


def parse_sql(text: str) -> str:
    """The blocks of a fingerprint that is given as text (see ``hex_sql``)."""
    num = lambda i: f"CAST(conv(split(t, '[.]')[{i}], 16, -10) AS BIGINT)"
    cells = f"transform(split(ltrim('!', b), ' ', -1), t -> IF(t = '', named_struct('c', 0L, 'k', 0L, 'x', 0L), named_struct('c', {num(0)}, 'k', {num(1)}, 'x', {num(2)})))"
    peeled = ", ".join(f"IF(size(cs) = {3 * w}, {peel_sql('cs', w, 'size(cs)')}, NULL)" for w in WIDTHS)
    listed = "transform(cs, c -> named_struct('k', c.k, 'c', c.c))"
    block = f"IF(startswith(b, '!'), named_struct('w', 0, 'cells', cs, 'd', {listed}), named_struct('w', int(size(cs) div 3), 'cells', cs, 'd', coalesce({peeled})))"
    return f"transform(split({text}, '[|]'), b -> {_bind(cells, 'cs', block)})"


def _range_of(id_col: str, cuts: list[int]) -> Column:
    """Number of cuts at or below the id (0 for null), found in two steps."""
    if not cuts:
        return F.lit(0)
    at = lambda c: c <= F.col(id_col)
    outer = F.size(F.filter(F.array(*[F.lit(c) for c in cuts[_INNER - 1 :: _INNER]]), at)) if len(cuts) >= _INNER else F.lit(0)
    groups = [cuts[a : a + _INNER] for a in range(0, len(cuts), _INNER)]
    groups += [[]] * (len(cuts) % _INNER == 0)
    inner = F.array(*[F.array(*[F.lit(c) for c in g]) if g else F.array().cast("array<bigint>") for g in groups])
    return F.coalesce(outer * _INNER + F.size(F.filter(F.element_at(inner, outer + 1), at)), F.lit(0))


def _bin(id_col: str, hash_col: str, cuts: Cuts) -> Column:
    """The bin of a row: ascending ones hold ascending (null first, id, hash). An id of more than a bin's worth of text has several, by ranges of the hash."""
    at = _range_of(id_col, cuts.starts)
    hot = [(r, n) for r, n in enumerate(cuts.parts) if n > 1]
    first, parts = at + cuts.null_parts, F.lit(1)
    if hot:
        listed = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(n).alias("n")) for r, n in hot])
        first = first + F.aggregate(F.filter(listed, lambda x: x.r < at), F.lit(0), lambda t, x: t + x.n - 1)
        parts = F.aggregate(F.filter(listed, lambda x: x.r == at), parts, lambda t, x: x.n)
    out = first + part_of(F.col(hash_col), parts)
    return F.when(F.col(id_col).isNull(), part_of(F.col(hash_col), F.lit(max(1, cuts.null_parts)))).otherwise(out) if cuts.null_parts else out


def with_next(ws: Workspace, docs: DataFrame, bin_chars: int = BIN_CHARS) -> DataFrame:
    """(doc_id, text, fp_a, next_text, fp_n): every document and its fingerprint with those of the one after it in descending doc_id, the last with the first.

    Documents are dealt into bins of neighbouring ids and sorted there, so the text moves once; a bin's last document meets a copy of the next bin's first.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sizes = ws.save(rows.select("doc_id", F.length("text").alias("size")), "sizes")
    total = sizes.agg(F.sum(F.col("size").cast("double"))).first()[0] or 0
    cuts = range_cuts(sizes, "doc_id", "size", int(max(bin_chars, total / MAX_BINS)))
    rows = rows.withColumns({"th": F.xxhash64("text"), "copy": F.lit(0)})
    rows = rows.withColumn("bin", _bin("doc_id", "th", cuts))
    # one row a bin, and bins are bounded by MAX_BINS (cuts of a target's worth each): these are ordered in one window and broadcast
    heads = ws.save(rows.groupBy("bin").agg(F.max(F.struct("doc_id", "th")).alias("h")), "heads")
    around = F.coalesce(F.lead("bin").over(Window.orderBy("bin")), F.min("bin").over(Window.partitionBy()))
    heads = heads.select(F.col("h.doc_id").alias("h_id"), F.col("h.th").alias("h_th"), F.col("bin").alias("h_bin"), around.alias("to"))
    match = F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("th") == F.col("h_th")) & (F.col("bin") == F.col("h_bin"))
    copies = rows.join(F.broadcast(heads), match).select("doc_id", "text", F.col("to").alias("bin"), "th", F.lit(1).alias("copy")).dropDuplicates(["bin"])
    # the text alone moves; fingerprints are made where the window finds them
    rows = rows.unionByName(copies).repartition("bin").withColumn("fp_a", F.expr(_bind(digests_sql("text"), "ks", text_sketch_sql("ks"))))
    order = Window.partitionBy("bin").orderBy("copy", F.desc_nulls_last("doc_id"), F.desc("th"))
    out = rows.withColumns({"next_text": F.lead("text").over(order), "fp_n": F.lead("fp_a").over(order)})
    return out.filter("copy = 0").select("doc_id", "text", "fp_a", "next_text", "fp_n")


def fingerprint_pairs(spark: SparkSession, docs: DataFrame, bin_chars: int = BIN_CHARS) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The likeness of two texts is the number of paragraphs (lines, runs of sentences, stretches) they share over that of both together, repeats counted, from what
    their fingerprints tell. Null texts are empty: one empty paragraph. Rows may share an id (a hash of the text
    orders them, falling) and null ids come last; a single row is its own next document. Empty tables give no rows; other columns are not read. Of long texts without line
    ends or sentences, in any script, stretches are paragraphs (LONG). Any number of repeats of a paragraph is counted.
    """
    ws = Workspace(spark, "fingerprints")
    rows = with_next(ws, docs, bin_chars)
    half = "int(length(text) div 2)"
    edited = F.expr(f"concat(substring(text, 1, length(text) - {half}), substring(next_text, 1, {half}))").alias("edited")
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), edited, "fp_a", "fp_n")
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fp_a", F.expr(_bind(digests_sql("edited"), "ks", text_sketch_sql("ks"))).alias("fp_e"), "fp_n")

    # a step a projection: the analyzer resolves only so many nested lambdas at a time
    rows = rows.withColumns({name: F.expr(_larger(*pair)) for name, pair in {"a_e": ("fp_a", "fp_e"), "e_a": ("fp_e", "fp_a"), "a_n": ("fp_a", "fp_n"), "n_a": ("fp_n", "fp_a")}.items()})
    rows = rows.withColumns({"d_e": F.expr(difference_sql("a_e", "e_a")), "d_n": F.expr(difference_sql("a_n", "n_a")), **{f"count_{c}": F.expr(count_sql(f"fp_{c}")) for c in "aen"}})
    likeness = lambda b: ((F.col("count_a") + F.col(f"count_{b}") - F.col(f"d_{b}")) / (F.col("count_a") + F.col(f"count_{b}") + F.col(f"d_{b}"))).cast("double")
    return rows.select("doc_id", "n_chars", "edited_sha256", F.expr(hex_sql("fp_a")).alias("fingerprint"), F.expr(hex_sql("fp_e")).alias("edited_fingerprint"), likeness("e").alias("near_edited"), likeness("n").alias("near_next"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_pairs(spark, table(spark, sf_dir, "documents"))


QUERIES = {"op8_fingerprints": op8_fingerprints}
ORACLE_SQL: dict[str, str] = {}

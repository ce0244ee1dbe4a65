import hashlib
import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from caseflow.llm import fingerprints as fp


def paragraphs(text):
    for p in re.split(fp.ENDS, text):
        start = 0
        if len(p) > fp.LONG:
            for i in range(4, len(p)):
                if xxhash.xxh64_intdigest(p[i - 4 : i].encode(), 42) % fp.STRETCH == 0:
                    yield p[start:i]
                    start = i
        yield p[start:]


def likeness(a, b):
    a, b = (Counter(paragraphs(x)) for x in (a, b))
    return (a & b).total() / (a | b).total()


def brute(rows):
    """rows: (doc_id, text) of distinct ids."""
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: -r[0])
    out = {}
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        h = len(t) // 2
        edited = t[: len(t) - h] + nxt[:h]
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), likeness(t, edited), likeness(t, nxt), edited)
    return out


def compare(got, want):
    assert len(got) == len(want)
    by_text = {}
    for r in got:
        n, sha, near_edited, near_next, _ = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, sha), r.doc_id
        assert r.near_edited == pytest.approx(near_edited) and r.near_next == pytest.approx(near_next), r.doc_id
    return by_text


def test_whole_table_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = fp.op8_fingerprints(spark, sf).collect()
    compare(got, brute(rows))
    text = dict(rows)
    seen = {}
    for r in got:
        assert seen.setdefault(text[r.doc_id], r.fingerprint) == r.fingerprint
    assert len(set(seen.values())) == len(seen)
    compare(fp.fingerprint_pairs(spark, docs.repartition(5), bin_chars=3000).collect(), brute(rows))


def test_many_paragraphs_repeats_and_sparse_ids(spark):
    rng = random.Random(3)
    rows = [(i**5 - 10**6, "\n".join(rng.choice(["x", "y", "", "é" * 3, f"p{rng.randint(0, 9999)}"]) for _ in range(rng.choice([1, 5, 30, 400])))) for i in range(150)]
    rows += [(5, "same\n" * 3000), (6, "same\n" * 2990 + "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    compare(fp.fingerprint_pairs(spark, docs, bin_chars=500).collect(), brute(rows))


def test_bins_number_the_cuts(spark):
    for n in (0, 1, 127, 128, 129, 256, 300):
        cuts = list(range(10, 10 + 2 * n, 2))
        got = spark.range(0, 640, 7).withColumn("b", fp._range_of("id", cuts)).collect()
        assert all(r.b == sum(c <= r.id for c in cuts) for r in got), n


@pytest.mark.parametrize("script", ["абвгдежзийклмнопрстуфхцчшщыэюя", "的一是不了人我在有他这中大来上国个到说们为子和你地出道也时年得就那要下以生会自着去之过家学对可"])
def test_long_texts_of_any_script_without_line_ends(spark, script):
    """Half of each text stays, so about a third of the paragraphs of both together is shared where the next text is as long."""
    rng = random.Random(8)
    blank = "" if script[0] == "的" else " "
    rows = [(i, "".join("".join(rng.choices(script, k=rng.randint(2, 9))) + blank for _ in range(n))) for i, n in enumerate((9000, 9000, 60, 3000, 2000))]
    got = {r.doc_id: r for r in fp.fingerprint_pairs(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    compare(list(got.values()), brute(rows))
    assert all(0.25 < got[i].near_edited < 0.42 for i in (1, 4)) and all(got[i].near_next < 0.02 for i in range(5))


def test_millions_of_equal_lines(spark):
    rows = [(1, "\n" * 2_000_000), (2, "\n" * 1_500_000 + "x"), (3, "a\nb")]
    got = {r.doc_id: r for r in fp.fingerprint_pairs(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2].near_next == pytest.approx(1_500_000 / 2_000_002) and got[3].near_next == 0.0 and got[2].fingerprint.startswith("!")
    assert got[1].near_edited == pytest.approx(1_000_001 / 2_000_003)


@pytest.mark.parametrize("hot", [7, None])
def test_one_id_many_times_is_split(spark, hot):
    rows = [(hot if i % 3 else i, f"text {i}\nsame\n" * 9) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bins = fp.with_next(fp.Workspace(spark, "t"), docs, bin_chars=1500).select("doc_id", "text", "next_text").collect()
    assert sorted((str(r.doc_id), r.text) for r in bins) == sorted((str(i), x) for i, x in rows)
    # the order is one circle through all rows, by falling id and then falling hash
    after = {r.text: r for r in bins}
    at, seen = bins[0].text, []
    while at not in seen:
        seen.append(at)
        at = after[at].next_text
    assert len(seen) == 300
    keys = [after[t].doc_id for t in seen]
    start = keys.index(max(k for k in keys if k is not None))
    keys = [k if k is not None else -1 for k in keys[start:] + keys[:start]]
    assert keys == sorted(keys, reverse=True)
    cuts = fp.range_cuts(docs.withColumn("n", F.length("text")), "doc_id", "n", 1500)
    assert cuts.null_parts > 3 if hot is None else max(cuts.parts) > 3


def test_nulls_ties_single_rows_and_clashing_columns(spark):
    rows = [(None, None, "x"), (None, "a\nb", "y"), (4, "same", "z"), (4, "same", "z"), (4, "other", "z"), (9, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pos string")
    got = fp.fingerprint_pairs(spark, docs).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in got) == sorted([("None", 0), ("None", 3), ("4", 4), ("4", 4), ("4", 5), ("9", 0)])
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    one = fp.fingerprint_pairs(spark, docs.filter("doc_id = 9")).collect()
    assert [(r.near_edited, r.near_next) for r in one] == [(1.0, 1.0)]
    assert fp.fingerprint_pairs(spark, docs.limit(0)).count() == 0


def test_published_fingerprints_alone_give_the_likeness(spark, sf):
    """The likeness again from the two strings; and one changed cell is seen."""
    rows = fp.op8_fingerprints(spark, sf).select("doc_id", "fingerprint", "edited_fingerprint", "near_edited")
    a, b = fp._bind(fp.parse_sql("fingerprint"), "x", "x"), fp._bind(fp.parse_sql("edited_fingerprint"), "x", "x")
    parsed = rows.select("doc_id", "near_edited", F.expr(a).alias("one"), F.expr(b).alias("two"))
    parsed = parsed.select("doc_id", "near_edited", F.expr(fp._larger("one", "two")).alias("one"), F.expr(fp._larger("two", "one")).alias("two"))
    got = parsed.select("near_edited", F.expr(fp.difference_sql("one", "two")).alias("d"), F.expr(f"{fp.count_sql('one')} + {fp.count_sql('two')}").alias("n")).collect()
    assert all((r.n - r.d) / (r.n + r.d) == pytest.approx(r.near_edited) for r in got) and len({r.d for r in got}) > 3
    damaged = rows.select(F.expr("regexp_replace(fingerprint, '^([ |]*)1[.]', '$12.')").alias("fingerprint")).select(F.expr(f"exists({fp.parse_sql('fingerprint')}, b -> b.d IS NULL)").alias("lost"))
    assert damaged.filter("lost").count() > 0


def test_blocks_that_cannot_be_peeled_grow(spark):
    """Many paragraphs in one block: the sketch takes a larger width, still gives all of them back, and a smaller one fails."""
    for n in (1, 10, 40, 150):
        entries = spark.range(n).agg(F.collect_list(F.struct(F.expr("shiftrightunsigned(xxhash64(id), 24)").alias("k"), F.lit(2).cast("long").alias("c"))).alias("es"))
        r = entries.select("es", F.expr(fp.block_sql("es")).alias("b"), F.expr(fp.peel_sql(fp.cells_sql("es", 8), 8, "size(es)")).alias("small")).first()
        assert sorted((x.k, x.c) for x in r.b.d) == sorted((x.k, x.c) for x in r.es)
        assert (n <= 10) == (r.b.w == 8) or r.b.w == 16 and n == 10
        assert n <= 10 or r.small is None

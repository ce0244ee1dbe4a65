import itertools

import corpus_pipeline as cp
from caseflow.llm import lang_id

from .test_substring_dedup import brute
from .test_tokens import WORD, check_packing, plain

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def near_copy_components(texts):
    """Smallest id reachable over pairs with a Jaccard similarity of 0.8 or more of their 5-word shingles, by all pairs."""
    sets = {}
    for i, text in texts.items():
        words = text.lower().encode().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(texts), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and root(a) != root(b):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in texts}


def test_mixed_texts_of_known_languages_stay_and_others_go(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one = {r.lang: r.text for r in docs.filter("lang is not null and n_chars > 300").collect()}
    mixed = " ".join(" ".join(t.split()[k : k + 12]) for k in range(0, 60, 12) for t in one.values())
    rows = [(10**9, mixed, None, "s", 1), (10**9 + 1, "Все люди рождаются свободными и равными в своем достоинстве и правах", None, "s", 1), (10**9 + 2, "这是 一个 文本 我们 测试", None, "s", 1)]
    got = cp.language(spark, docs.union(spark.createDataFrame(rows, SCHEMA)), sf).filter("doc_id >= 1000000000").collect()
    assert len(one) > 2 and [r.doc_id for r in got] == [10**9]


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    rows = {r.doc_id: r for r in docs.collect()}

    kept = {r.doc_id: r for r in cp.language(spark, docs, sf).collect()}
    labels = dict(zip(rows, lang_id.train(docs).judge_texts([r.text for r in rows.values()]), strict=True))
    assert set(kept) == {i for i, (lang, _, familiar) in labels.items() if lang != "und" and familiar >= cp.MIN_FAMILIAR}
    assert all(kept[i] == rows[i] for i in kept) and len(kept) > 0.95 * len(rows)

    second = cp.near_dedup(spark, spark.createDataFrame(list(kept.values()), SCHEMA), sf).cache()
    comp = near_copy_components({i: r.text for i, r in kept.items()})
    assert sorted(second.collect()) == sorted(kept[i] for i in kept if comp[i] == i)

    third = cp.substring(spark, second, sf).cache()
    assert third.columns == cp.COLUMNS
    want = brute([(r.doc_id, r.text) for r in second.collect()], 20)
    gone = {i: n for i, _, n, _ in want}
    for r in third.collect():
        assert r.n_chars == len(r.text) and (r.lang, r.source) == (rows[r.doc_id].lang, rows[r.doc_id].source)
        assert len(r.text.encode().split()) == len(rows[r.doc_id].text.encode().split()) - gone[r.doc_id]
        assert gone[r.doc_id] or r.text == rows[r.doc_id].text

    packed = cp.packed(spark, third, sf).collect()
    check_packing(packed, [x + [1] for x in plain(WORD, [r.text for r in third.collect()])], 2048)

    whole = cp.run(spark, sf)
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, whole.select(key).collect())) == sorted(tuple(r[k] for k in key) for r in packed)


def test_stages_with_nulls_repeats_and_no_rows(spark, sf):
    text = "the quick words of an ordinary english text that goes on"
    rows = [(None, None, None, None, None), (1, text, "en", "s", 3), (1, text, "en", "s", 3), (2, text, None, None, None), (3, "", "en", "s", 0), (None, text, "en", "s", 1), (4, "12 !!", "fr", "s", 5)]
    docs = spark.createDataFrame(rows, SCHEMA)
    one = cp.language(spark, docs, sf)
    assert sorted(str(r.doc_id) for r in one.collect()) == ["1", "1", "2", "None"]
    two = cp.near_dedup(spark, one, sf)
    assert [tuple(r) for r in two.collect()] == [rows[1]]
    for name, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name


def test_stage_list():
    assert [n for n, _ in cp.STAGES] == ["language", "near_dedup", "substring", "packing"] and cp.ORACLE_SQL is None


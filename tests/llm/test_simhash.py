import random
import re

import numpy as np
import pytest
import xxhash

from caseflow.llm import simhash
from caseflow.llm.common import Workspace, connected_components


def slow_fingerprint(text, k=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def slow_components(fps):
    """doc_id -> least doc_id reachable over links of at most 4 bits."""
    comp = {i: i for i, _ in fps}
    changed = True
    while changed:
        changed = False
        for a, x in fps:
            for b, y in fps:
                if (x ^ y).bit_count() <= 4 and comp[b] < comp[a]:
                    comp[a] = comp[b]
                    changed = True
    return comp


def test_fingerprint_matches_the_definition():
    for t in [None, "", "  \t\n", "One", "a b c", "A b c D e f a b c d É ß\x1cx\xa0y", "x " * 50]:
        assert int.from_bytes(simhash.fingerprint(t), "big") == slow_fingerprint(t)


@pytest.mark.parametrize("radius,copies", [(1, 1), (3, 1), (4, 1), (2, 2)])
def test_masks_cover_the_radius(radius, copies):
    masks = [m & (2**64 - 1) for m in simhash.covering_masks(radius, copies)]
    rng = random.Random(1)
    for _ in range(2000):
        diff = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(diff & m == 0 for m in masks)


def test_whole_table_against_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    fps = [(r.doc_id, slow_fingerprint(r.text)) for r in rows]
    want = slow_components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op1_simhash_near_dedup(spark, sf).collect()}
    assert got == {i: (f"{x:016x}", want[i]) for i, x in fps}


@pytest.mark.parametrize("bucket,radius", [(4096, 4), (3, 4), (3, 3)])
def test_links_connect_exactly_the_pairs_in_the_radius(spark, bucket, radius):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = sorted({b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(9)})
    signed = [(int(np.uint64(x).astype(np.int64)),) for x in fps]
    ws = Workspace(spark, "t")
    nodes = spark.createDataFrame(signed, "fp long")
    edges = simhash.links(ws, nodes, radius=radius, bucket=bucket)
    found = {r.node: r.component for r in connected_components(ws, edges).collect()}
    groups = {x: {x} for x in fps}
    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= radius and groups[a] is not groups[b]:
                merged = groups[a] | groups[b]
                for x in merged:
                    groups[x] = merged
    want = {frozenset(map(lambda x: int(np.uint64(x).astype(np.int64)), g)) for g in groups.values() if len(g) > 1}
    by = {}
    for n, c in found.items():
        by.setdefault(c, set()).add(n)
    assert {frozenset(v) for v in by.values()} == want


def test_nulls_repeats_empty_and_clashing_columns(spark):
    rows = [(1, None, "fp"), (2, "", "t"), (3, "a b c d e", None), (3, "a b c d e", None), (None, "a b c d e", "x"), (5, "q " * 30000, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(spark, docs).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (3, 3), (3, 3), (None, 3), (5, 5)], key=str)
    assert simhash.near_duplicates(spark, docs.limit(0)).count() == 0

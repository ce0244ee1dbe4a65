"""Nearest vectors in blocks, against all pairs."""

import math
import random

from caseflow.operators import ranked
from caseflow.plans import retrieval_queries


def test_nearest_of_all_pairs(spark):
    """Equal vectors in several blocks, equal scores once rounded, opposite vectors, own ids twice, labels of fewer rows than asked for, vectors without a cosine."""
    rng = random.Random(5)
    rows = [(i, i % 3, [rng.randrange(-3, 4) for _ in range(4)]) for i in range(240)] + [(i, 7, [1000, i - 300, 1, 0]) for i in range(300, 340)]
    rows += [(400, 8, [1, 2, 3, 4]), (401, 8, [-1, -2, -3, -4]), (402, 9, [1, 1, 1, 1]), (8, 2, [5, 5, 5, 5]), (403, 0, None), (404, 0, [1, None, 2, 3]), (405, 0, [0, 0, 0, 0]), (406, None, [1, 2, 3, 4])]
    vectors = spark.createDataFrame(rows, "vec_id long, label int, v array<long>")
    asked = [r for r in rows if r[0] % 4 == 0]
    queries = spark.createDataFrame(asked, "query_id long, label int, v array<long>")
    got = ranked.nearest(queries, vectors, 3, vector_block=25, query_block=10).collect()
    has = lambda v: v is not None and None not in v and any(v)
    want = {}
    for q, label, a in asked:
        for i, other, b in rows:
            if i != q and label is not None and label == other and has(a) and has(b):
                cosine = sum(x * y for x, y in zip(a, b)) / math.sqrt(float(sum(x * x for x in a)) * float(sum(x * x for x in b)))
                want.setdefault(q, []).append((-math.floor(cosine * 1e6 + 0.5) / 1e6, i))
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == {(q, n + 1, i, -s) for q, found in want.items() for n, (s, i) in enumerate(sorted(found)[:3])}


def test_no_row_for_a_pair(spark, sf):
    plan = retrieval_queries.cosine_topk(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "zip_with" not in plan

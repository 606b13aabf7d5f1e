"""Exact search on huge components, ties, repeated queries, few rows and empty tables."""

import math
import random
from fractions import Fraction

from quire.llm import bitslice

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, queries, k):
    """Sorted (query_id, rank, vec_id, exact score) by fractions."""
    good = [(i, [math.floor(256 * Fraction(x)) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {(i, tuple(v)) for i, v in good if i in queries}
    out = []
    for q, w in asked:
        best = sorted((-sum(a * b for a, b in zip(w, v)), i) for i, v in good if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def found(df, queries, k, **options):
    rows = bitslice.search(df, df.where(df.vec_id.isin(queries)), k, **options).collect()
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in rows)


def test_huge_components_are_exact(spark):
    rows = [(0, [1e30, 1.0]), (1, [1e30, 2.0]), (2, [-1e300, 5.0]), (3, [3.5, -2.25]), (4, [1e30, 3.0]), (5, [0.0, 1e18]), (6, [2.0**52, -1.5])]
    df = spark.createDataFrame(rows, SCHEMA)
    clamp = lambda s: max(-(2**63), min(2**63 - 1, s))
    want = [(q, n, i, clamp(s)) for q, n, i, s in brute(rows, [0, 2, 3, 6], 4)]
    assert found(df, [0, 2, 3, 6], 4) == want


def test_ties_repeated_queries_and_few_rows(spark):
    rows = [(i, [0.5, 0.25]) for i in range(9, -1, -1)] + [(0, [0.5, 0.25]), (0, [-1.0, 2.0]), (3, None), (4, [None, 1.0]), (5, [float("inf")]), (11, [])]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(df, [0, 50], 5) == brute(rows, [0, 50], 5)
    assert found(df, [0], 40) == brute(rows, [0], 40)
    assert found(df.where("false"), [0], 5) == []


def test_many_blocks(spark):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 3) for _ in range(rng.randrange(1, 9))]) for i in range(500)] + [(7, [1.0])] * 30 + [(600 + i, [1e25 * (i - 3)]) for i in range(6)]
    df = spark.createDataFrame(rows, SCHEMA)
    clamp = lambda s: max(-(2**63), min(2**63 - 1, s))
    want = sorted((q, n, i, clamp(s)) for q, n, i, s in brute(rows, range(0, 500, 50), 5))
    assert found(df, list(range(0, 500, 50)), 5, block_rows=40, query_rows=3) == want


def test_sortable_keys_keep_the_order():
    numbers = sorted([0, 1, -1, 255, 256, -256, 2**63, -(2**63), 2**2000, -(2**2000), 7])
    assert sorted(numbers, key=bitslice.sortable) == numbers

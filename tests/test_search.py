import numpy as np
import pytest

from docketry.operators import search


def by_hand(vectors, queries, k, cutoff):
    unit = lambda v: np.array(v) / max(np.linalg.norm(v), 1e-12)
    out = set()
    for query, asked in queries:
        best: dict[int, float] = {}
        for page, vector in vectors:
            best[page] = max(best.get(page, -9.0), round(float(unit(vector) @ unit(asked)), 6))
        kept = sorted((-score, page) for page, score in best.items() if score >= cutoff)[:k]
        out |= {(query, page, round(-score, 4)) for score, page in kept}
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
@pytest.mark.parametrize("cutoff", [-1.0, 0.45])
def test_nearest_of_each_equals_all_products(spark, block_bytes, cutoff):
    """Pages of several chunks, equal vectors, a zero vector, nulls, and queries in one block and in several."""
    rng = np.random.default_rng(3)
    rows = [(i % 40, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(120)] + [(100 + i, [1.0, 0.0, 0.0, 0.0]) for i in range(30)] + [(200, [0.0] * 4)]
    asked = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(17)] + [(50, [1.0, 0.0, 0.0, 0.0])]
    vectors = spark.createDataFrame([*rows, (300, None)], "page_id long, vector array<float>").repartition(3)
    queries = spark.createDataFrame([*asked, (99, None)], "query_id long, vector array<float>")
    found = search.nearest_of_each(vectors, queries, 7, cutoff, block_bytes).collect()
    assert {(r["query_id"], r["page_id"], round(r["score"], 4)) for r in found} == by_hand(rows, asked, 7, cutoff)
    assert len(found) == len({(r["query_id"], r["page_id"]) for r in found})


def test_nearest_of_nothing(spark):
    vectors = spark.createDataFrame([], "page_id long, vector array<float>")
    queries = spark.createDataFrame([(1, [1.0])], "query_id long, vector array<float>")
    assert search.nearest_of_each(vectors, queries, 3).count() == 0
    assert search.nearest_of_each(queries.withColumnRenamed("query_id", "page_id"), queries.where("false"), 3).count() == 0


def test_best_rows_takes_earlier_ones_first():
    scores = np.array([[1.0, 2.0], [1.0, 5.0], [1.0, 5.0], [0.0, 5.0]])
    assert search.best_rows(scores, 2).T.tolist() == [[True, True, False, False], [False, True, True, False]]

"""Nearest neighbours against brute force: recall, exact scores, order, odd vectors."""

import numpy as np
import pytest


def brute(rows, queries, k=10):
    ids = np.array([i for i, _ in rows])
    points = np.array([v for _, v in rows], np.float32).astype(np.float64)
    for i, v in queries:
        d = np.sqrt(((points - np.asarray(v, np.float32).astype(np.float64)) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
        yield i, [(int(ids[j]), float(d[j])) for j in order]


@pytest.mark.parametrize("shard", [64, 4096])
def test_recall_and_order(spark, shard):
    from tidemark.llm.hnsw import nearest

    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").selectExpr("vec_id as id", "embedding")
    queries = table.where("id % 10 = 0")
    rows = [(r["id"], r["embedding"]) for r in table.collect()]
    got = {}
    for r in sorted(nearest(table, queries, shard=shard).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    hits = 0
    for i, best in brute(rows, [x for x in rows if x[0] % 10 == 0]):
        assert len(got[i]) == 10 and got[i] == sorted(got[i], key=lambda x: (x[1], x[0]))
        hits += len({x for x, _ in best} & {x for x, _ in got[i]})
        exact = dict(best)
        assert all(abs(exact[x] - s) < 1e-12 for x, s in got[i] if x in exact)
    assert hits >= 0.95 * 10 * len(got)


def test_odd_vectors_and_copies(spark):
    from tidemark.llm.hnsw import nearest

    same = [1.0, 2.0]
    rows = [(i, same) for i in range(1, 40)] + [(100, [1.5, 2.0]), (101, [0.0, 0.0]), (102, None), (103, [1.0, None]), (104, [float("nan"), 1.0]), (105, [float("inf"), 1.0]), (106, [1.0, 2.0, 3.0]), (107, []), (None, [1.0, 1.0]), (100, [1.5, 2.0])]
    table = spark.createDataFrame(rows, "id long, embedding array<float>")
    got = {}
    for r in sorted(nearest(table, table.where("id in (5, 20, 100, 101, 102, 106)")).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got[5] == [(i, 0.0) for i in [1, 2, 3, 4, 6, 7, 8, 9, 10, 11]]
    assert got[20] == [(i, 0.0) for i in range(1, 11)]
    assert got[100] == [(i, 0.5) for i in range(1, 11)]
    assert set(got) == {5, 20, 100}
    assert nearest(table.limit(0), table).count() == nearest(table, table.limit(0)).count() == 0


def test_the_query_itself_with_clashing_columns(spark, tmp_path):
    """Columns of the table that have the names of the operator's own."""
    from tidemark.llm.queries import op5_hnsw

    rows = [(i, [float(i), 1.0], -1, 0.5, 7, "x", 3) for i in range(1, 150)] + [(200, None, 1, 1.0, 1, "y", 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id long, score double, rank int, query_id string, shard int")
    table.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in op5_hnsw(spark, str(tmp_path)).collect())
    want = dict(brute([(i, v) for i, v, *_ in rows if v], [(100, [100.0, 1.0])]))[100]
    assert got == [(100, n, i, d) for n, (i, d) in enumerate(want, 1)]

import numpy as np

from convoweave.llm.neighbours import BITS, Codes, _distances, fit_codes, nearest_neighbours
from convoweave.llm.queries import op3_neighbours


def exact(ids, x, queries, k=5):
    x = np.array(x, float)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in queries:
        at = np.flatnonzero(ids == q)[0]
        score = x @ x[at]
        rest = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), score[i]) for i in rest]
    return out


def test_recall_and_scores(spark):
    for sf in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        table = spark.read.parquet(f"{sf}/embeddings.parquet").toArrow()
        ids, x = table["vec_id"].to_numpy(), table["embedding"].to_pylist()
        queries = [i for i in ids.tolist() if i % 50 == 0]
        truth, hit = exact(ids, x, queries), 0
        found = {}
        for r in op3_neighbours(spark, sf).collect():
            found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
        assert set(found) == set(queries)
        unit = {i: np.array(v, float) / np.linalg.norm(v) for i, v in zip(ids.tolist(), x)}
        for q, rows in found.items():
            assert sorted(rows) == [1, 2, 3, 4, 5]
            assert all(abs(s - unit[q] @ unit[v]) < 1e-12 for v, s in rows.values())
            assert [rows[i][1] for i in range(1, 6)] == sorted((s for _, s in rows.values()), reverse=True)
            hit += len({v for v, _ in rows.values()} & {v for v, _ in truth[q]})
        assert hit >= 0.9 * 5 * len(queries)


def test_all_codes_within_the_radius_are_found(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    codes = fit_codes(df)
    codes = Codes(codes.mean, codes.rotation, 22)
    packed = codes.encode(x / np.linalg.norm(x, axis=1, keepdims=True))
    near = _distances(packed, packed) <= 22
    truth = exact(np.arange(300), x, range(0, 300, 50), k=300)
    found = {}
    for r in nearest_neighbours(df, "vec_id % 50 = 0", k=3, codes=codes).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    for q in range(0, 300, 50):
        inside = [v for v, _ in truth[q] if near[q, v]]
        expected = inside[:3] if len(inside) >= 3 else [v for v, _ in truth[q]][:3]
        assert [v for _, v in sorted(found[q])] == expected


def test_odd_vectors_ties_and_few_candidates(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, []), (None, [1.0, 1.0]),
        (8, [2.0, 0.0]), (7, [3.0, 0.0]), (9, [-1.0, 0.0]), (50, [1e-300, 1e-300]), (100, [0.0, 0.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    df = df.selectExpr("vec_id", "embedding", "1 AS id", "2 AS code", "3 AS rank")
    found = {}
    for r in nearest_neighbours(df, "vec_id % 50 = 0").collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, round(r.score, 9)))
    assert sorted(found) == [0, 50]
    assert sorted(found[0]) == [(1, 7, 1.0), (2, 8, 1.0), (3, 50, 0.707106781), (4, 9, -1.0)]
    assert [v for _, v, _ in sorted(found[50])] == [0, 7, 8, 9]
    assert nearest_neighbours(df.where("false"), "true").count() == 0
    assert fit_codes(df.where("false")).radius == BITS

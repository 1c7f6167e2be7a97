"""Nearest neighbours of every vector against brute force."""

import numpy as np

from polystrata.plans import registry

registry.load()


def test_every_vector_is_a_query(spark, tmp_path):
    r = np.random.default_rng(3)
    x = r.standard_normal((1500, 8)).round(1)
    x[700:720] = x[0]  # ties
    spark.createDataFrame([(i, v.tolist(), i % 10) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").repartition(2).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {}
    for y in registry.QUERIES["knn_self_join"](spark, str(tmp_path)).collect():
        got.setdefault(y.query_id, []).append((-y.score, y.vec_id))
    x = x.astype(np.float32).astype(float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    assert len(got) == len(x)
    for i, own in got.items():
        want = sorted((-s[i, j], j) for j in range(len(x)) if j != i)[:5]
        assert np.allclose(sorted(-a for a, _ in own), sorted(-a for a, _ in want), atol=2e-6)
        assert all(abs(-a - s[i, j]) < 2e-6 for a, j in own)

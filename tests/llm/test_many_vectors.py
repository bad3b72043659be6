"""Enough vectors for several pivots, as they are set, against all pairs."""

import numpy as np

from reachwell.llm import embeddings


def test_several_cells(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(600, 6))
    x = np.repeat(centres, 15, axis=0) + rng.normal(size=(9000, 6)) * rng.choice([0.02, 0.2, 0.6], size=(9000, 1))
    assert len(x) > 2 * embeddings.EACH
    x[5000] = x[1]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(8)
    found = {r["vec_id"]: r for r in embeddings.near_duplicates(df).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    doubt = {int(i) for i in np.flatnonzero((np.abs(unit @ unit.T - 0.9) < 1e-12).any(axis=1))}
    counts = near.sum(axis=1)
    assert [found[i]["n_links"] for i in range(9000) if i not in doubt] == [int(counts[i]) for i in range(9000) if i not in doubt]
    root = np.arange(9000)
    while True:
        least = np.minimum(root, np.where(near, root[None, :], 9000).min(axis=1))
        if (least == root).all():
            break
        root = least
    assert [found[i]["component_id"] for i in range(9000)] == root.tolist()

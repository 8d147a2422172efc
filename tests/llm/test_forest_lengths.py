import numpy as np
import pytest
from pyspark.sql import functions as F

from rooftally.llm.hash_forest import nearest


@pytest.mark.parametrize("kind", ["lognormal", "one long", "few lengths"])
def test_recall_on_unlike_lengths(table, kind):
    rng = np.random.default_rng(11)
    vectors = rng.standard_normal((4096, 32))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    if kind == "lognormal":
        vectors *= rng.lognormal(0, 0.8, (len(vectors), 1))
    elif kind == "one long":
        vectors[1] *= 5
    else:
        vectors *= rng.choice([1.0, 1.0, 1.0, 4.0], (len(vectors), 1))
    df = table([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {}
    for r in nearest(df, F.col("vec_id") % 20 == 0, block=1024).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = []
    for q in range(0, len(vectors), 20):
        scores = vectors @ vectors[q]
        scores[q] = -np.inf
        hits.append(len(got[q] & set(np.argsort(-scores)[:20].tolist())) / 20)
    assert np.mean(hits) >= 0.9
    print(kind, np.mean(hits))

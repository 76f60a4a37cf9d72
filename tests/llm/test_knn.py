import numpy as np
from pyspark.sql import functions as F

from feedlens.llm import knn

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, k=5, every=50):
    found = {}
    usable = [(i, v) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dim = max((len(v) for _, v in usable), default=0)
    whole = [(i, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v)) for i, v in usable]
    pad = lambda v: list(v) + [0] * (dim - len(v))
    for q, qv in sorted(whole):
        if q % every == 0:
            best = sorted((-int(np.dot(pad(qv), pad(v))), i) for i, v in whole if i != q)[:k]
            found[q] = [(i, -s) for s, i in best]
    return found


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    df = df.where(knn.usable(F.col("embedding"))).select("vec_id", knn.scaled(F.col("embedding")).alias("vector"), "score")
    out = knn.top_k(df, df.where("vec_id % 50 = 0"), 5, "vec_id", "vector", **more).collect()
    found = {}
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    return found


def test_matches_brute_force_with_bad_vectors_ties_and_repeats(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)], "x") for i in range(400)]
    rows += [(400 + i, rows[7][1], "copy") for i in range(12)]  # ties
    rows += [rows[3], rows[50], rows[7]]  # repeated rows, one of them among the ties
    rows += [(450, None, "x"), (500, [1.0, None], "x"), (550, [float("nan")], "x"), (600, [float("inf")], "x"), (650, [], "x"), (700, [0.5, 0.25], "x"), (None, [1.0], "x")]
    for more in ({}, {"n_pivots": 5, "group": 3, "part": 40}):
        assert run(spark, rows, **more) == brute(rows)


def test_few_rows_and_empty_tables(spark):
    rows = [(0, [1.0, 0.0], "a"), (1, [0.5, 0.5], "b")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == {}
    assert run(spark, [(1, [1.0], "no query")]) == {}
    assert run(spark, [(50, [1.0], "alone")]) == {}

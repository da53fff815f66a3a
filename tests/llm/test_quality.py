import zlib

import numpy as np

from jobstrata.llm import quality as Q

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r for r in Q.classify(docs, labels).collect()}
    assert len(rows) == docs.count()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [d for d in truth if rows[d].held_out]
    assert all(rows[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d in rows)
    right = np.mean([rows[d].predicted == truth[d] for d in held])
    assert right >= 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows.values())
    kept = Q.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in rows.values())


def test_sums_over_tasks_give_the_plain_ridge(spark):
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(200, Q.N_STATS))
    y = (x[:, 0] > 0).astype(float)
    rows = spark.createDataFrame([(r.tolist(), float(v), i % 2) for i, (r, v) in enumerate(zip(x, y))], "x array<double>, y double, fold int").repartition(40)
    m = Q.fit(rows, dims=32)
    z = Q.fourier(x, x.mean(0), x.std(0), 32)
    penalty = Q.RIDGE * 200 * np.eye(33)
    penalty[-1, -1] = 1e-9
    assert np.allclose(m.weights, np.linalg.solve(z.T @ z + penalty, z.T @ y), atol=1e-6)


def test_isotonic():
    at, value = Q.isotonic(np.array([0, 2, 1, 1, 0, 4.]), np.array([0, 0, 1, 0, 0, 4.]))
    assert value.tolist() == [0, 0.5, 1] and (np.diff(at) > 0).all()


def test_edges(spark, documents):
    docs = documents([(1, None), (2, ""), (3, "x" * 200000), (3, "x" * 200000), (None, "some text"), (5, "\n\n  ")]).selectExpr("*", "1 as x", "2 as score")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in Q.classify(docs, none).collect()] == [0.5] * 6
    some = spark.createDataFrame([(1, 1), (3, 0), (3, 1), (None, 1), (5, None), (2, 1)], "doc_id long, quality int")
    rows = Q.classify(docs, some).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows) and not [r for r in rows if r.doc_id is None][0].held_out
    assert Q.classify(documents([]), some).count() == 0

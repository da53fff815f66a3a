import random

import numpy as np

from pyspark.sql import functions as F

from jobstrata.llm import vectors as V
from jobstrata.llm.graph import components


def roots(nodes, pairs):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            up[n] = n = up[up[n]]
        return n
    for a, b in (p for p in pairs if p[0] != p[1]):
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rnd = random.Random(4)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(i + 1, i) for i in range(300, 340)] + [(1000, i) for i in range(1001, 1200)] + [(5, 5)]
    pairs += [(rnd.randrange(2000, 2100), rnd.randrange(2000, 2100)) for _ in range(90)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs + pairs[:9] + [(None, 3)], "a long, b long")).collect()}
    nodes = {n for p in pairs if p[0] != p[1] for n in p}
    assert got == roots(nodes, pairs)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute(rows, t=0.98):
    ok = [(i, np.array(v, float), lab) for i, v, lab in rows if i is not None and v and lab is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    pairs, n = [], {}
    for x in range(len(ok)):
        for y in range(x):
            (a, u, p), (b, w, q) = ok[x], ok[y]
            if p == q and len(u) == len(w) and u @ w / np.linalg.norm(u) / np.linalg.norm(w) >= t:
                pairs.append((a, b))
                n[x], n[y] = n.get(x, 0) + 1, n.get(y, 0) + 1
    links = {}
    for k, (a, _, _) in enumerate(ok):
        links.setdefault(a, []).append(n.get(k, 0))
    return links, roots({i for i, _, _ in rows if i is not None}, pairs)


def test_against_brute_force(spark):
    rnd = np.random.default_rng(7)
    rows = []
    for g in range(30):
        base = rnd.normal(size=64)
        for _ in range(rnd.integers(1, 9)):
            rows.append((len(rows), (base + rnd.normal(size=64) * rnd.choice([0.02, 0.1, 0.14])).tolist(), int(g % 3)))
    base = rnd.normal(size=64)
    rows += [(1000 + i, (base + rnd.normal(size=64) * 0.09).tolist(), 1) for i in range(90)]
    rows += [(1200 + i, base.tolist(), 1) for i in range(40)] + [(1300, base.tolist(), 2), (1301, (base * 3).tolist(), 1)]
    rows += [(1400, None, 1), (1401, [0.0] * 64, 1), (1402, [float("nan")] + [1.0] * 63, 1), (1403, [None] + [1.0] * 63, 1), (1404, base.tolist(), None), (1405, [], 1), (1406, [float("inf")] * 64, 1),
             (1407, base[:5].tolist(), 1), (1408, base[:5].tolist(), 1), (1500, base.tolist(), 1), (1500, base.tolist(), 1), (1600, (-base).tolist(), 1), (1600, rnd.normal(size=64).tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as rep", "2 as key")
    links, component = brute(rows)
    for block, kind in ((512, "double"), (16, "float")):
        got = V.near_duplicates(df.withColumn("embedding", F.col("embedding").cast(f"array<{kind}>")), block_rows=block).collect()
        assert len(got) == len(rows)
        assert all(r.component_id == component[r.vec_id] and r.kept == (r.vec_id == r.component_id) for r in got)
        mine = {}
        for r in got:
            mine.setdefault(r.vec_id, []).append(r.n_links)
        assert all(sorted(n) == sorted(links.get(i, [0] * len(n))) for i, n in mine.items())
    assert V.near_duplicates(df.limit(0)).count() == 0


def test_recall_at_the_threshold():
    rnd = np.random.default_rng(9)
    for rows, d in ((5000, 64), (10 ** 6, 128), (3000, 8)):
        f = V.Filters.design(d, rows)
        x = rnd.normal(size=(300, d))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z = rnd.normal(size=(300, d))
        z -= (z * x).sum(1, keepdims=True) * x
        y = 0.98 * x + np.sqrt(1 - 0.98 ** 2) * z / np.linalg.norm(z, axis=1, keepdims=True)
        a, b = f.listed(x), f.listed(y)
        assert np.mean([len(np.intersect1d(p, q)) > 0 for p, q in zip(a, b)]) >= 0.985

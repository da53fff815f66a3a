import random
import re

import numpy as np
import pyarrow as pa
import pytest

from jobstrata.llm import ngram_join as N

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t, size=5):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute(docs):
    sets = [(i, shingles(t)) for i, t in docs]
    group = list(range(len(sets)))
    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            both = len(a & b)
            if a and b and 100 * both >= 75 * (len(a) + len(b) - both):
                old, new = group[x], group[y]
                group = [new if g == old else g for g in group]
    out = []
    for k, (i, s) in enumerate(sets):
        ids = [sets[j][0] for j in range(len(sets)) if group[j] == group[k] and sets[j][0] is not None]
        out.append((i, len(s), min(ids) if ids else None))
    return sorted(out, key=repr)


def corpus(rnd, groups=25):
    vocab = [f"w{i}" for i in range(400)] + ["Ünd", "ß"]
    text = lambda k: [rnd.choice(vocab) for _ in range(k)]
    line = text(14)
    docs = []
    for _ in range(groups):
        base = text(rnd.choice([1, 3, 5, 6, 9, 30, 80]))
        for _ in range(rnd.choice([1, 2, 6])):
            w = list(base)
            for _ in range(rnd.randrange(4)):
                w.insert(rnd.randrange(len(w) + 1), rnd.choice(vocab))
            docs.append(" ".join(w + (line if rnd.random() < .4 else [])))
    base = text(120)
    for _ in range(60):  # a large group of near copies
        w = list(base)
        for _ in range(rnd.randrange(7)):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        docs.append(" ".join(w))
    docs += [" ".join(line)] * 9 + [" ".join(line + text(k)) for k in (1, 2, 3, 3, 4, 5)]
    return docs


@pytest.mark.parametrize("margin,bits", [(64, 20), (2, 20), (-1e9, 20)])
def test_against_brute_force(spark, documents, monkeypatch, margin, bits):
    """With few, some and all tokens in the frequent class."""
    monkeypatch.setattr(N, "MARGIN", margin)
    docs = list(enumerate(corpus(random.Random(8)), 1))
    docs += [(900, None), (901, ""), (902, " \n\t"), (903, "one"), (904, "ONE"), (5, docs[40][1]), (None, docs[70][1]), (None, "alone and without any id at all"), (905, "long " * 30000), (905, "long " * 30000)]
    df = documents(docs).selectExpr("*", "1 as id", "2 as node")
    got = N.near_documents(df)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs)


def test_one_of_each_stays(spark, documents):
    docs = [(i, t) for i, t in enumerate(corpus(random.Random(2), 6), 1)] + [(700, None), (701, "")]
    twice = next(i for i, _, c in brute(docs) if i == c)
    docs.append((twice, dict(docs)[twice]))
    df = documents(docs).selectExpr("*", "1 as n")
    kept = N.keep_one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({i for i, _, c in brute(docs) if i == c})
    assert N.near_documents(documents([])).count() == 0


def test_runs_do_not_depend_on_batches():
    rnd = random.Random(1)
    rows = sorted((k, -1 if k % 3 else rnd.randrange(2), v % 3, 9, v) for k, v in ((rnd.randrange(12), rnd.randrange(6)) for _ in range(80)))
    want = set()
    for k, s in {r[:2] for r in rows}:
        nodes = sorted({r for r in rows if r[:2] == (k, s)})
        want |= {(*r, *nodes[0][2:]) for r in nodes if len(nodes) > 1 or s >= 0}
    for size in (1, 2, 3, 7, 80):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in p], pa.int64()) for i in range(5)], names=["key", "salt", "r", "n", "node"]) for p in (rows[i:i + size] for i in range(0, len(rows), size))]
        got = [tuple(r.values()) for b in N._runs(iter(batches)) for r in b.to_pylist()]
        assert len(got) == len(set(got)) and set(got) == want, size


def test_prefix_keys_miss_no_pair():
    rnd = np.random.default_rng(6)
    for trial in range(200):
        n = int(rnd.integers(1, 40))
        base = np.unique(rnd.integers(0, 1 << 63, n).astype(np.uint64))
        other = np.unique(np.concatenate([base[rnd.random(len(base)) > 0.12], rnd.integers(0, 1 << 63, int(rnd.integers(0, 4))).astype(np.uint64)]))
        both = len(np.intersect1d(base, other))
        if 4 * both < 3 * (len(base) + len(other) - both) or not len(other):
            continue
        frequent = rnd.random(1 << N.CELL_BITS) < rnd.random()
        doc, key, _, _ = N.prefix_keys(np.concatenate([base, other]), np.array([0, len(base), len(base) + len(other)]), frequent, 75, 100)
        assert np.intersect1d(key[doc == 0], key[doc == 1]).size


def test_rows_of_one_id_are_judged_by_their_own_text(spark, documents):
    rnd = random.Random(31)
    base, unique = ([f"w{rnd.randrange(10 ** 6)}" for _ in range(60)] for _ in range(2))
    near = [*base[:-1], "changed"]
    rows = [(3, " ".join(base)), (5, " ".join(near)), (5, " ".join(unique)), (5, " ".join(unique))]
    assert sorted((r.doc_id, r.text) for r in N.keep_one_of_each(documents(rows)).collect()) == [(3, rows[0][1]), (5, rows[2][1])]
    got = sorted((r.doc_id, r.component_id) for r in N.near_documents(documents(rows)).collect())
    assert got == [(3, 3), (5, 3), (5, 5), (5, 5)]


def test_links_through_a_text_without_an_id(spark, documents):
    rnd = random.Random(32)
    a = [f"w{rnd.randrange(10 ** 6)}" for _ in range(60)]
    b, c = a[6:] + [f"x{k}" for k in range(1)], a[12:] + [f"x{k}" for k in range(1)] + ["y"]
    rows = [(1, " ".join(a)), (None, " ".join(b)), (2, " ".join(c)), (None, "nothing like the others at all here")]
    got = sorted(((r.doc_id, r.component_id) for r in N.near_documents(documents(rows)).collect()), key=repr)
    assert got == [(1, 1), (2, 1), (None, 1), (None, None)]


def test_pairs_that_share_many_keys_meet_once(spark, documents, monkeypatch):
    """Long texts with a common half: each two share hundreds of keys, and parity bits of so many tokens tell nothing."""
    rnd = random.Random(8)
    parts = [" ".join(f"w{rnd.randrange(10 ** 6)}" for _ in range(8)) for _ in range(400)]
    docs = [(i, " ".join(p for p in parts if rnd.random() < .7)) for i in range(10)]
    rows_of, pairs = [], N._Graph.pairs

    def counted(self, rows, x, y):
        if y == "other":
            rows_of.append((rows.count(), rows.select(x, y).distinct().count()))
        return pairs(self, rows, x, y)

    monkeypatch.setattr(N._Graph, "pairs", counted)
    got = N.near_documents(documents(docs)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(i, len(shingles(t)), i) for i, t in docs]
    (rows, distinct), = rows_of
    assert distinct == 45 and rows <= 2 * distinct

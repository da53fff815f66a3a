import hashlib
import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from jobstrata.llm import suffixes as S
from jobstrata.llm import words


def brute(docs):
    first = {}
    texts = [(i, (t or "").encode()) for i, t in docs]
    for i, t in texts:
        for k in range(len(t) - 49 if i is not None else 0):
            first[t[k:k + 50]] = min(i, first.get(t[k:k + 50], i))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - 49 if i is not None else 0):
            if first[t[k:k + 50]] < i:
                gone[k:k + 50] = b"\x01" * 50
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in S.digests(df).collect()), key=repr)


def corpus(rnd, n):
    passages = ["".join(rnd.choice("abcdé \n日") for _ in range(rnd.choice([20, 48, 49, 50, 51, 60, 130, 400]))) for _ in range(25)]
    hot = "the hot passage that every document of this corpus has in the middle of its text"
    docs = []
    for i in range(n):
        text = "".join(rnd.choice([rnd.choice(passages), "".join(rnd.choice("ab c") for _ in range(rnd.randrange(70)))]) for _ in range(rnd.randrange(6)))
        docs.append((rnd.randrange(2 * n), text + hot * (i % 3 == 0) + rnd.choice(passages)[rnd.randrange(40):]))
    return docs


def test_against_brute_force(spark, documents):
    rnd = random.Random(5)
    docs = corpus(rnd, 250)
    docs += [(900, None), (901, ""), (None, docs[0][1]), (None, "only here " * 20), (902, "x" * 49), (903, "x" * 50), (904, "x" * 51), (905, "ab" * 3000), (1, "ab" * 100), (906, "a\0b" * 40), (907, "a\0b" * 40)]
    docs += [docs[3], docs[3], (docs[3][0], "other text of the same id " * 5), (10 ** 12, docs[5][1] * 3), (-4, docs[6][1])]
    df = documents(docs).selectExpr("*", "1 as id", "2 as key", "3 as spans").repartition(5)
    want = brute(docs)
    assert sum(w[2] for w in want) > 20000
    assert got(df) == want


def test_hot_token_fills_several_ranges(spark, documents, monkeypatch):
    rnd = random.Random(8)
    hot = "one passage that stands in every text, whatever else the text may say"
    docs = [(i, "".join(rnd.choice("abcdefgh ") for _ in range(30)) + hot + "".join(rnd.choice("abcdefgh ") for _ in range(30))) for i in range(300)]
    real, seen = S.splitters, []
    monkeypatch.setattr(S, "RATE", 1)
    monkeypatch.setattr(S, "splitters", lambda docs, ranges: seen.append(real(docs, ranges)) or seen[-1])
    assert got(documents(docs)) == brute(docs)
    assert len(set(seen[0])) < len(seen[0])


def in_process(docs, borders, rows=7):
    """The same rows from the functions of the tasks, called here, so that their bounds can be made small."""
    batches = [pa.RecordBatch.from_pydict({"id": pa.array([i for i, _ in part], pa.int64()), "key": pa.array([hash(t) for _, t in part], pa.int64()), "text": pa.array([t for _, t in part])}) for part in (docs[k:k + rows] for k in range(0, len(docs), rows))]
    blocks = [(r, b) for out in S._blocks(SimpleNamespace(value=borders))(batches) for r, b in zip(out.column("range").to_pylist(), out.column("block").to_pylist())]
    blocks.sort(key=lambda x: x[0])
    dealt = [pa.RecordBatch.from_pydict({"range": pa.array([r for r, _ in part]), "block": pa.array([b for _, b in part], pa.binary())}) for part in (blocks[k:k + 3] for k in range(0, len(blocks), 3))]
    spans = {}
    for out in S._resolved(dealt):
        for i, k, s in zip(*(out.column(c).to_pylist() for c in ("id", "key", "spans"))):
            spans.setdefault((i, k), []).append(s)
    rows = []
    for i, t in docs:
        data = t.encode()
        gone = S.merged(np.frombuffer(b"".join(spans.get((i, hash(t)), [])), "<i4").reshape(-1, 2))
        cut = set().union(*(range(a, b) for a, b in gone))
        rows.append((i, len(data), len(cut), len(gone), hashlib.sha256(bytes(c for k, c in enumerate(data) if k not in cut)).hexdigest()))
    return sorted(rows, key=repr)


def test_small_bounds(monkeypatch):
    rnd = random.Random(2)
    docs = corpus(rnd, 120)
    long = "".join(rnd.choice("abcde") for _ in range(9000))
    docs += [(1, long[4000:4300]), (2, long), (300, "q" + long[100:8000] + "q"), (400, long[1360:1420]), (500, "a" * 4000), (600, "a" * 700)]
    want, grams = brute(docs), sorted(t.encode()[k:k + 16] for _, t in docs for k in range(0, len(t), 40) if len(t.encode()[k:k + 16]) == 16)
    hot = b"hot passage that"
    few, many = np.array(grams[::len(grams) // 9], "S16"), np.array(sorted(grams[::20] + [hot, b"a" * 16] * 5), "S16")
    monkeypatch.setattr(S, "CHUNK_BYTES", 700)
    monkeypatch.setattr(words, "CHUNK_BYTES", 1500)
    for held, part, borders in ((1 << 19, 1 << 15, few), (300, 7, few), (300, 7, many), (1, 1, many), (5000, 50, many[:0])):
        monkeypatch.setattr(S, "HELD_RECORDS", held)
        monkeypatch.setattr(S, "SLICE_RECORDS", part)
        assert in_process(docs, borders) == want


def test_pieces_cover_every_string_once():
    rnd = np.random.default_rng(1)
    data = rnd.integers(97, 100, 5000).astype(np.uint8)
    lo, run, anchor, doc = S.anchored(data, np.array([0, 10, 60, 60, 3000, 5000]))
    starts = sorted(s for a, n in zip(lo, run) for s in range(a, a + n))
    assert starts == [*range(10, 11), *range(60, 2951), *range(3000, 4951)]
    assert (run <= S.RUN).all() and (anchor >= lo + run - 1).all() and (anchor + S.GRAM <= lo + S.SPAN).all()


def test_empty(spark, documents):
    assert S.digests(documents([])).count() == 0

import hashlib
import random
import re

from jobstrata.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, n=10):
    wins = []
    for i, t in items:
        w = words(t)
        wins += [(tuple(w[k:k + n]), i) for k in range(max(1, len(w) - n + 1))] if w else []
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for win, i in wins:
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k:k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    found |= {i}
        ids = ",".join(sorted(str(x) for x in found if x is not None))
        out.append((d, len(w), len(hit), len(found - {None}), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_against_brute_force(spark, documents):
    rnd = random.Random(3)
    vocab = ["Aa", "bé", "c1", "dÉ", "E", "f-g", "ñ", "日本"]
    text = lambda k: " ".join(rnd.choice(vocab) for _ in range(k))
    items = [(i, text(rnd.choice([1, 2, 5, 9, 10, 11, 14]))) for i in range(30)] + [(3, text(12)), (90, None), (91, ""), (92, "--"), (93, text(12)), (94, None)]
    docs = [(i, text(rnd.randrange(0, 60))) for i in range(60)]
    docs += [(100, items[5][1].upper()), (101, "x" + items[30][1] + "."), (102, None), (103, ""), (103, ""), (104, "A" * 50000 + " " + items[33][1]), (None, items[33][1])]
    items_df = spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 19, 7):
        got = D.contamination(documents(docs), items_df, block=block)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, items)


def test_spans_documents_and_clashing_columns(spark, documents):
    ten = " ".join(f"w{i}" for i in range(10))
    docs = documents({1: f"Ünder {ten.upper()}, after", 2: "clean text", 3: None}).selectExpr("*", "1 as n_hit", "2 as h")
    bench = spark.createDataFrame([(7, ten)], "item_id long, text string")
    assert {r.doc_id: r.text for r in D.remove_spans(docs, bench).collect()} == {1: "Ünder , after", 2: "clean text", 3: None}
    kept = D.drop_documents(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]
    spans = {r.doc_id: [tuple(s) for s in r._dc_chars] for r in D.scan(docs, bench).collect()}
    assert spans == {1: [(6, 6 + len(ten))], 2: [], 3: []}
    assert D.contamination(documents([]), bench).count() == 0
    assert {r.n_hit for r in D.contamination(docs, bench.limit(0)).collect()} == {0}

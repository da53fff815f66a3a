import random
import re
from collections import Counter, defaultdict

import pyarrow as pa

from jobstrata.llm import divergence as D


def brute(docs, least=30, top=50):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        words = re.findall("[a-z\x80-\U0010ffff]+", (text or "").translate(lower))
        groups[lang].add(source)
        count[lang, source].update(words)
        df[lang].update(set(words))
    out = set()
    for lang, sources in groups.items():
        kept = {t for t, n in df[lang].items() if n >= least}

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 1000000000 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}
        p = {s: shares(count[lang, s]) for s in sources}
        q = shares(sum((count[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(q[t] - p[s][t], t.encode()) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, rows in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, o.decode(), -v, k + 1) for k, (v, o) in enumerate(rows)}
    return out


def table(spark, docs):
    return spark.createDataFrame(docs, "text string, lang string, source string").selectExpr("*", "1 as term", "2 as count", "3 as item")


def test_against_brute_force(spark):
    rnd = random.Random(11)
    vocab = [f"{a}{b}" for a in "abcdefgé日" for b in "xyzwvu"] + ["Ab", "AB", "ab", "ÄB", "x1y", "_q", "don't"]
    docs = []
    for i in range(500):
        own = rnd.sample(vocab, 12)
        docs.append((" ".join(rnd.choice(own) for _ in range(rnd.randrange(25))), rnd.choice(["en", "en", "de"]), f"s{rnd.randrange(9)}"))
    docs += docs[:40] * 3 + [("ax ax ay", "en", "hot")] * 600 + [("AX ax ay", "en", s) for s in ("hot", "s1", "é")] * 4
    docs += [(None, None, None), (None, "en", "silent"), ("", "en", "silent"), ("12 34 ?!", "de", "signs"), ("only few", "xx", "one"), ("only few", "xx", "two"), ("ax " * 90000, "de", "s1"), ("no lang", None, "s1"), ("no source", "en", None)]
    df = table(spark, docs)
    got = [tuple(r) for r in D.divergence(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(docs)
    assert {tuple(r) for r in D.divergence(df, min_documents=1, top_terms=3).collect()} == brute(docs, 1, 3)


def test_empty(spark):
    assert D.divergence(table(spark, [])).count() == 0
    assert [tuple(r) for r in D.divergence(table(spark, [(None, None, None)])).collect()] == []


def test_copies_are_one_row(spark):
    docs = [("same text", "en", f"s{i % 3}") for i in range(900)] + [("same text", "de", "s0"), ("other", "en", "s0")]
    rows = {(r.lang, r.text): {s.source: s.copies for s in r.sources} for r in D.collapsed(table(spark, docs).select("lang", "source", "text").repartition(5)).collect()}
    assert rows == {("en", "same text"): {"s0": 300, "s1": 300, "s2": 300}, ("de", "same text"): {"s0": 1}, ("en", "other"): {"s0": 1}}


def test_small_bounds(monkeypatch):
    """The functions of the tasks, called here: sums do not depend on how much a task holds."""
    rnd = random.Random(3)
    texts = [pa.RecordBatch.from_pydict({"lang": ["en"] * 20, "source": [rnd.choice("ab") for _ in range(20)], "text": [rnd.choice(["x y", "y y z", "", "Z"]) for _ in range(20)]}) for _ in range(9)]
    lists = pa.array([[{"source": "a", "copies": 2}, {"source": "b", "copies": 5}], [{"source": "b", "copies": 1}], [{"source": "a", "copies": 3}]] * 4)
    lists = pa.RecordBatch.from_pydict({"lang": ["en", "de", "en"] * 4, "text": ["x y y", "", "q X"] * 4, "sources": lists})
    for rows in (1 << 19, 8, 1):
        monkeypatch.setattr(D, "HELD_ROWS", rows)
        monkeypatch.setattr(D, "HELD_BYTES", rows)
        copies, sums = Counter(), Counter()
        for b in D._copies(texts):
            for r in b.to_pylist():
                copies[r["source"], r["text"]] += r["copies"]
        assert copies == Counter((s, t) for b in texts for s, t in zip(b.column("source").to_pylist(), b.column("text").to_pylist()))
        for b in D._term_counts([lists.slice(0, 5), lists.slice(5), lists.slice(0, 0)]):
            for r in b.to_pylist():
                sums[r["lang"], r["source"], r["term"], "count"] += r["count"]
                sums[r["lang"], r["source"], r["term"], "docs"] += r["docs"]
        want = {("a", "x"): (20, 20), ("b", "x"): (20, 20), ("a", "y"): (16, 8), ("b", "y"): (40, 20), ("a", "q"): (12, 12)}
        assert sums == {("en", s, t, k): n for (s, t), pair in want.items() for k, n in zip(("count", "docs"), pair)}

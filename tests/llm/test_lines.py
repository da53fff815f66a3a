import random
import re

from jobstrata.llm import lines as L


def sets(t):
    w = [x for x in re.split("[ \t\x0b\f\r]+", t.lower()) if x]
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(docs):
    rows = sorted((i, k, s) for i, t in docs if i is not None and t is not None for k, x in enumerate(t.split("\n")) if (s := sets(x)))
    out = set()
    for i, k, s in rows:
        for j, m, r in rows:
            if (j, m) < (i, k) and 4 * len(s & r) >= 3 * len(s | r):
                out.add((i, k))
                break
    return out


def corpus(rnd):
    vocab = [f"w{i}" for i in range(60)] + ["É", "ß"]
    pool = [[rnd.choice(vocab) for _ in range(rnd.choice([1, 2, 4, 5, 6, 9, 20, 40]))] for _ in range(30)]
    docs = []
    for i in range(70):
        lines = []
        for _ in range(rnd.randrange(6)):
            x = list(rnd.choice(pool))
            if rnd.random() < .5:
                x[rnd.randrange(len(x))] = rnd.choice(vocab)
            if rnd.random() < .2:
                x += pool[0]
            lines.append(rnd.choice([" ", "  ", "\t"]).join(x))
        docs.append((i, "\n".join(lines)))
    return docs


def test_against_brute_force(spark, documents, monkeypatch):
    docs = corpus(random.Random(4)) + [(200, None), (201, ""), (202, "\n \n"), (None, "w1 w2"), (203, "long " * 9000), (204, "LONG " * 9000), (205, "tie one\nTIE  ONE"), (206, "same"), (206, "same")]
    want = brute(docs)
    assert len(want) > 60
    df = documents(docs).selectExpr("*", "1 as no", "2 as id")
    for common in (48, 4):
        monkeypatch.setattr(L, "COMMON", common)
        got = [(r.doc_id, r.no) for r in L.repeated_lines(df).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    rows = L.line_report(df).collect()
    assert len(rows) == len(docs)
    assert all(r.removed == sorted(k for i, k in want if i == r.doc_id) and r.n_removed == len(r.removed) for r in rows)
    kept = {r.doc_id: r.text for r in L.without_repeated_lines(df).collect() if r.doc_id not in (None, 206)}
    for i, t in docs:
        if i in (None, 206):
            continue
        left = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in want)
        assert kept.get(i, "gone") == left or (i not in kept and not left.strip() and any(j == i for j, _ in want))
    assert L.repeated_lines(documents([])).count() == 0


def test_rows_of_one_id_lose_lines_of_their_own(spark, documents):
    line, other = "a line of several words that stands twice", "quite another line that stands only once here"
    rows = [(1, line), (2, line), (2, other), (2, other + "\n" + line)]
    report = sorted((r.doc_id, r.n_lines, r.removed) for r in L.line_report(documents(rows)).collect())
    assert report == [(1, 1, []), (2, 1, []), (2, 1, [0]), (2, 2, [1])]
    left = sorted((r.doc_id, r.text) for r in L.without_repeated_lines(documents(rows)).collect())
    assert left == [(1, line), (2, other), (2, other)]


def test_lines_that_repeat_word_for_word_are_not_dealt_out(spark, documents, monkeypatch):
    """Copies go before postings are made, whose sets are made once, and a report moves no text."""
    kept = {}

    class Recorded(L.Stages):
        def keep(self, df, name="stage"):
            out = super().keep(df, name)
            kept.setdefault(name, []).append((out.count(), df._jdf.queryExecution().optimizedPlan().toString()))
            return out

    monkeypatch.setattr(L, "Stages", Recorded)
    line, near = "one two three four five six seven eight nine ten", "one two three four five six seven eight nine ten eleven"
    report = L.line_report(documents([(i, line) for i in range(6)] + [(6, "quite another line"), (7, "LINE   without\tmany words"), (8, "line without many words")]))
    assert sorted((r.doc_id, r.removed) for r in report.collect()) == [(0, [])] + [(i, [0]) for i in range(1, 6)] + [(6, []), (7, []), (8, [0])]
    (rows, plan), = kept["met"]
    assert rows == 0 and plan.count("array_distinct(") == 1
    assert not any(n > 0 for n, _ in kept["sets"])
    kept.clear()
    assert sorted(r.doc_id for r in L.line_report(documents([(1, line), (2, line), (3, near), (4, near)])).collect() if r.removed) == [2, 3, 4]
    assert {n for n, _ in kept["lines"]} == {4, 2}  # those with words; those of a shared shingle

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobstrata.llm import infill as I


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def brute(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
    h = [int(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()[k:k + 8], 16) for k in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    x, y, z = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(t in text for t in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (len(units), "plain", None, None, sha(text), sha(text))
    form = "spm" if h[3] % 100 < 20 else "psm"
    return (len(units), form, len(x), len(y), sha(f"<S>{z}<P>{x}<M>{y}" if form == "spm" else f"<P>{x}<S>{z}<M>{y}"), sha(text))


def test_ranks():
    rnd = np.random.default_rng(3)
    for n in (0, 1, 63, 64, 65, 1000):
        x = rnd.integers(0, 8, n).astype(np.uint8)
        matrix, at = I.WaveletMatrix(x), np.arange(n + 1)
        for symbol in range(8):
            assert matrix.rank(symbol, at).tolist() == [int((x[:k] == symbol).sum()) for k in at]


def test_against_brute_force(spark, documents):
    rnd = random.Random(7)
    bits = ["word", "A", " ", "\n", "é", "\U0001f600", "7", "<", "P>", "<P", "日本", "\r\n", "x" * 70, "<P><S>"[:rnd.randrange(6)]]
    docs = [(i, "".join(rnd.choice(bits) for _ in range(rnd.randrange(30)))) for i in range(400)]
    docs += [(1000, None), (1001, ""), (None, "no id here"), (1002, "has <M> inside"), (1003, "long words " * 200000), (1004, "q" * 500000), (1005, "é" * 100000), (7, "another text"), (7, "another text"), (-3, "x")]
    df = documents(docs).selectExpr("*", "1 as n", "2 as id", "3 as output")
    rows = I.digests(df).collect()
    key = lambda r: tuple((v is not None, v) if v is not None else (False, 0) for v in r)
    want = sorted([(i, *brute(i, t)) for i, t in docs], key=key)
    assert sorted([tuple(r) for r in rows], key=key) == want
    assert {f for _, _, f, *_ in want} == {"plain", "psm", "spm"}
    assert I.digests(documents([])).count() == 0


def test_other_units_and_sentinels(spark, documents):
    marks = I.Sentinels("[pre]", "[suf]", "[mid]")
    out = I.infill(documents([(i, f"ab12 cd{i}34  \n ef") for i in range(300)]), plain_percent=0, spm_percent=50, runs=(I.LETTER, I.DIGIT, I.SPACE), sentinels=marks)
    rows = out.select("doc_id", "n", "form", I.restored(F.col("output"), F.col("form"), marks).alias("back")).collect()
    assert {r.form for r in rows} == {"psm", "spm"}
    assert all(r.back == f"ab12 cd{r.doc_id}34  \n ef" and r.n == 7 for r in rows)
    for bad in (I.Sentinels("<P>", "<P>", "<M>"), I.Sentinels("aba", "<S>", "<M>"), I.Sentinels("<P>", "x<P>y", "<M>")):
        with pytest.raises(ValueError):
            I.infill(documents([]), sentinels=bad)

import re

import corpus_pipeline as C
from jobstrata.llm import pieces, quality

from tests.llm import test_decontaminate, test_lines, test_ngram_join

SF = "/root/testdata/sf0.001"


def test_run_against_brute_force(spark):
    """Later stages by brute force; what the classifier keeps is its own (its accuracy has a test of its own)."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id: r.text for r in quality.keep_good(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    gone = test_lines.brute(sorted(kept.items()))
    left = {}
    for i, t in kept.items():
        text = "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)
        if not any(j == i for j, _ in gone) or text.strip():
            left[i] = text
    one = {i for i, _, c in test_ngram_join.brute(sorted(left.items())) if i == c}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    wins = set()
    for _, t in items:
        w = test_decontaminate.words(t)
        wins |= {tuple(w[k:k + min(10, len(w))]) for k in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in wins}

    def hit(t):
        w = test_decontaminate.words(t)
        return any(tuple(w[k:k + n]) in wins for n in sizes for k in range(len(w) - n + 1))

    clean = {i: left[i] for i in one if not hit(left[i])}
    v = pieces.load_vocabulary(C.MODEL_FILE)
    enc = pieces.Encoder(v)
    got = {r.doc_id: r for r in C.run(spark, SF).collect()}
    assert set(got) == set(clean) and len(clean) < docs.count()
    for i, t in clean.items():
        assert got[i].round_trip and list(got[i].ids) == enc.encode([t])[0].tolist()
        assert b"".join(v.surface[x] for x in got[i].ids).decode() == (" " + t if t else "")


def test_stages_keep_the_columns(spark, documents):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    base = [(i, f"Some quite ordinary words of document {i} that stand in no other one, as they should.") for i in range(20)]
    docs = documents(base + [(50, None), (51, ""), (51, ""), (None, "no id here"), (52, "word " * 4000)])
    for _, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
    assert C.STAGES[-1][1](spark, docs, SF).count() > 0
    assert len(C.STAGES) == 5 and re.match("quality", C.STAGES[0][0])
    empty = documents([])
    for _, stage in C.STAGES:
        empty_out = stage(spark, empty, SF)
        assert empty_out.count() == 0

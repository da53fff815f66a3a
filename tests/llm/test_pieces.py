import random

from jobstrata.llm import pieces as P

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def brute(v, text):
    """Best path over the whole text by plain dynamic programming: every piece at every position."""
    if not text:
        return []
    text = " " + text
    piece = {s.decode(): i for i, (s, ok) in enumerate(zip(v.surface, v.matchable)) if ok}
    low = min(v.score[i] for i in piece.values()) - P.FALLBACK_PENALTY
    best = [(0.0, [])]
    for e in range(1, len(text) + 1):
        options = [(best[s][0] + v.score[piece[text[s:e]]], -s, best[s][1] + [piece[text[s:e]]]) for s in range(max(0, e - 20), e) if text[s:e] in piece]
        if text[e - 1] not in piece:
            options.append((best[e - 1][0] + low, -e, best[e - 1][1] + [v.byte_ids[b] for b in text[e - 1].encode()]))
        top = max(o[0] for o in options)
        best.append(min((-o[1], o) for o in options if o[0] == top)[1][::2])
    return best[-1][1]


def test_best_path_and_round_trip(spark, documents):
    v = P.load_vocabulary(MODEL)
    rnd = random.Random(1)
    texts = ["", None, " ", "  two  blanks ", "a\nb\n\n", "▁meta ▁", "naïve 日本語 \U0001f600 <0x0A> <s> </s>", "x" * 300, "\x00\x01", "Hello world, hello World", "Hello world, hello World"]
    texts += ["".join(rnd.choice("ab e\néß.T1") for _ in range(rnd.randrange(40))) for _ in range(60)]
    docs = documents(list(enumerate(texts))).selectExpr("*", "1 as ids_", "2 as n_pieces")
    rows = {r.doc_id: r for r in P.encoded_documents(docs, v).collect()}
    assert all(r.round_trip for r in rows.values()) and len(rows) == len(texts)
    for i, t in enumerate(texts):
        if len(t or "") < 200:
            assert list(rows[i].ids) == brute(v, t), t
    back = P.decode(P.encode(docs, v), v).collect()
    assert all(r.decoded == (r.text or "") for r in back)
    assert P.encoded_documents(documents([]), v).count() == 0


def test_cache_limit_changes_nothing(monkeypatch):
    v = P.load_vocabulary(MODEL)
    texts = [f"word{i} other{i % 7} thing\n" for i in range(200)]
    want = P.Encoder(v).encode(texts)[0].tolist()
    monkeypatch.setattr(P, "CACHED_UNITS", 3)
    enc, got = P.Encoder(v), []
    for t in texts:
        got += enc.encode([t])[0].tolist()
    assert got == want

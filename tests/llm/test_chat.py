import hashlib
import random

from jobstrata.llm import chat


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def brute(rows):
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        said = [x for _, _, r, x in turns if r == "assistant"]
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, _, r, x in turns)), len("".join(said)), sha("".join(said)))
    return out


def test_round_trip_of_everything(spark):
    rnd = random.Random(5)
    bits = ["</s>", "<s>", "[INST]", "~", "~0", "~1", "\n", "<<SYS>>", "é", "\U0001f600", " ", "a", "\\"]
    rows = [(c, t, rnd.choice(["user", "assistant", "system", "odd\nrole~<", None]), "".join(rnd.choice(bits) for _ in range(rnd.randrange(9)))) for c in range(40) for t in range(rnd.randrange(1, 9))]
    rows += [(50, 1, "assistant", None), (51, None, "user", "x"), (51, None, "user", "x"), (51, 1, "assistant", "y"), (None, 1, "user", "only"), (52, 0, "assistant", "z" * 30000), (52, 1, "user", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as turns", "2 as n")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(df).collect()}
    assert got == brute(rows)
    assert chat.digests(df.limit(0)).count() == 0


def test_examples_hold_their_context(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "a<b"), (1, 2, "assistant", "r1"), (1, 3, "user", "c"), (1, 4, "assistant", "r[2"), (1, 5, "user", "tail")]
    ex = sorted(chat.expand(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect(), key=lambda r: r.example_no)
    first = "<s>system\ns</s><s>user\na~1b</s><s>assistant\nr1</s>"
    assert [r.text for r in ex] == [first, first + "<s>user\nc</s><s>assistant\nr~22</s>", first + "<s>user\nc</s><s>assistant\nr~22</s><s>user\ntail</s>"]
    assert [None if r.loss_start is None else r.text[r.loss_start:r.loss_end] for r in ex] == ["r1", "r~22", None]


def test_examples_of_a_long_conversation_are_dealt_out(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"<{t}>") for t in range(901)] + [(2, 0, "user", "q"), (2, 1, "assistant", "a")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = chat.expand(turns, run=10_000).collect()
    parts = chat.expand(turns, run=50)
    assert len(whole) == 452 and sorted(map(tuple, parts.collect())) == sorted(map(tuple, whole))
    assert parts.where("conv_id = 1").selectExpr("spark_partition_id() as p").distinct().count() > 1
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(turns).collect()}
    assert got == brute(rows)

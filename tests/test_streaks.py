"""Runs that come out of order give the streaks and baselines of the ordered pass."""
import random

from jobstrata.streaming import streams

HOUR = 3_600_000_000


def in_order(runs):
    out = []
    for source in {r[0] for r in runs}:
        streak, recent = 0, []
        for _, us, cards, status in sorted(r for r in runs if r[0] == source):
            base = None
            if len(recent) >= 3:
                s = sorted(recent)
                base = (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2
            streak = 0 if cards > 0 else streak + 1
            out.append((source, us, streak, base))
            recent = (recent + [cards])[-7:] if status == "OK" else recent
    return sorted(out)


def test_any_order_equals_the_ordered_pass(spark):
    rng = random.Random(11)
    runs = [(s, i * HOUR + rng.randrange(3), rng.choice([0, 0, 2, 5]), rng.choice(["OK", "OK", "недоступне"])) for s in ("a", "b") for i in range(40)]
    runs += [("a", 5 * HOUR + 7, 0, "OK")]  # two runs within one millisecond
    first = [r for r in runs if r[1] < 25 * HOUR and not 18 * HOUR < r[1] < 20 * HOUR]
    rest = [r for r in runs if r not in first]
    rng.shuffle(first), rng.shuffle(rest)
    schema = "source string, run_us long, cards long, status string"
    far = [[("~", (10_000 + 1000 * i) * HOUR, 1, "OK")] for i in range(2)]
    late = [("a", HOUR + 500, 0, "OK")]  # behind the watermark: dropped
    parts = [spark.createDataFrame(p, schema) for p in (first, rest, far[0], late + far[1])]
    with streams.rocksdb_state(spark):
        out = streams.run_in_order(parts, lambda d: streams.streaks_in_any_order(d, "12 hours"), "test_any_order")
    assert sorted(tuple(r) for r in out.where("source <> '~'").collect()) == in_order(runs)

import hashlib
import random
import re

from jobstrata.llm import pii

BASE = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def luhn(d):
    return sum((x if i % 2 == 0 else x * 2 - 9 * (x > 4)) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def ok(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def brute(t):
    out = []
    for kind, p in BASE:
        out += [(kind, m.start(), m.end()) for m in re.finditer(p, t or "") if ok(kind, m[0])]
    return out


def test_base_spans(spark, documents):
    rnd = random.Random(3)
    bits = ["4111 1111 1111 1111", "4111-1111-1111-1112", "10.2.3.4", "1.2.3.4.5.6.7.8", "999.1.1.1", "007.0.0.1", "+1 (743) 555-3824", "+12", "a.b@c.d-e.org", "x@y", "a@b.c%d@e.f", "é", "\U0001f600", "+", "-", " ", "\n", "12", "@", ".",
            'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "555-123-4567", "call 555-123-4567", "5555555555554444"]
    texts = ["".join(rnd.choice(bits) + rnd.choice(["", " ", ""]) for _ in range(rnd.randrange(12))) for _ in range(150)]
    texts += [None, "", "A" * 60000 + " b@c.de", "1" * 60000, "+1" + " " * 30000, "1 2-" * 9000, "a@b." * 5000]
    docs = documents(list(enumerate(texts))).selectExpr("*", "1 as kind", "2 as spans")
    got = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = brute(t)
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest(), t
        assert got[i].spans.startswith(text)
        assert [got[i][f"n_{k}"] for k, _ in BASE] == [sum(x[0] == k for x in want) for k, _ in BASE]
    assert pii.personal_data(documents([])).count() == 0


def test_added_spans_are_real_ones(spark, documents):
    secret = 'set token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" here'
    plain = "averylongwordwithoutanydigits and chapter12345678901234567890a of it"
    docs = documents([(i, secret) for i in range(20)] + [(100 + i, plain) for i in range(20)] + [(200, "é " + secret)])
    got = {r.doc_id: r.spans for r in pii.personal_data(docs).collect()}
    assert got[0] == "secret:13:53" and got[200] == "secret:15:55" and got[100] == ""


def test_estimate_separates_votes():
    post = pii.estimate({0b0111: 50, 0b0011: 20, 0b0101: 20, 0b0000: 300, 0b1000: 30, 0b0001: 15})
    assert post[0b0111] > 0.9 and post[0] < 0.1


def test_context_reaches_beyond_other_matches(spark, documents):
    number = "call 555-123-4567, 555-123-4568 today"
    table = "ssn 123-45-6789 | 123-45-6780 | 124-45-6789 end"
    docs = documents([(i, number) for i in range(20)] + [(100 + i, table) for i in range(20)] + [(200 + i, "555-123-4567 is my phone") for i in range(20)] + [(300 + i, "part 000-00-0000 of it, 555.123-4567 too") for i in range(60)])
    got = {r.doc_id: r.spans for r in pii.personal_data(docs).collect()}
    assert got[0] == "national_phone:5:17,national_phone:19:31"
    assert got[100] == "social_number:4:15,social_number:18:29,social_number:32:43"
    assert got[200] == "national_phone:0:12" and got[300] == ""


def test_the_classifier_decides_on_one_vote():
    shape = {0b0011 * 12 + 4: 500, 0b0001 * 12 + 4: 100, 0b0000 * 12 + 1: 900}
    assert pii.train(shape) == {0b0011 * 12 + 4, 0b0001 * 12 + 4}


def account(rnd, country, size):
    body = "".join(rnd.choice("0123456789") for _ in range(size - 4))
    number = lambda check: int("".join(str(int(c, 36)) for c in body + country + check))
    return country + f"{98 - number('00') % 97:02d}" + body


def planted(rnd):
    """(kind, span, what stands before it) of a real span of any kind, some without any word that names it."""
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    hexes = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    kind = rnd.choice([k for k, _, _ in pii.CANDIDATES])
    bare = rnd.random() < 0.25
    if kind == "secret":
        span = rnd.choice(["ghp_" + hexes(36), "sk_live_" + hexes(24) + "Ab9", hexes(40)])
        return kind, span, rnd.choice(["token = ", 'password: "', "api_key='"])
    if kind == "national_phone":
        return kind, f"{rnd.choice(pii.AREA_CODES)}-{rnd.randrange(2, 9)}{rnd.randrange(20, 99)}-{digits(4)}", "see " if bare else rnd.choice(["call ", "my phone is ", "fax: "])
    if kind == "social_number":
        return kind, f"{rnd.randrange(1, 660):03d}-{rnd.randrange(1, 99):02d}-{rnd.randrange(1, 9999):04d}", "ssn " if not bare else "taxpayer: "
    if kind == "bank_account":
        country = rnd.choice(["DE", "FR", "PL", "NL", "UA"])
        span = account(rnd, country, pii.ACCOUNT_LENGTHS[country])
        return kind, span, "pay to " if bare else rnd.choice(["iban ", "account: ", "bank transfer to "])
    return kind, f"{rnd.choice(['jo', 'ann.lee', 'x_1'])} [at] {rnd.choice(['gmail', 'proton', 'yahoo'] if bare else ['acme', 'gmail'])} [dot] {rnd.choice(['com', 'org', 'de'])}", "by " if bare else "contact "


def decoy(rnd):
    """What matches a candidate pattern by accident."""
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    return rnd.choice([lambda: "chapter" + digits(20), lambda: "some_long_name_of_version_" + digits(2), lambda: f"{rnd.choice('01')}{digits(2)}.{digits(3)}-{digits(4)}", lambda: f"9{digits(2)}-00-{digits(4)}",
                       lambda: f"XQ{digits(2)}" + "".join(rnd.choice("ABCDEFG0123") for _ in range(16)), lambda: "look [at] this [dot] here"])()


def test_spans_of_all_kinds_are_found(spark, documents):
    rnd, texts, real = random.Random(8), [], set()
    for i in range(1500):
        if i % 3:
            texts.append((i, f"the item {decoy(rnd)} is listed and stays"))
        else:
            kind, span, before = planted(rnd)
            real.add((kind, i, 6 + len(before), 6 + len(before) + len(span)))
            texts.append((i, f"words {before}{span} more of them"))
    found = {(kind, r.doc_id, int(a), int(b)) for r in pii.personal_data(documents(texts)).collect() for kind, a, b in (x.split(":") for x in r.spans.split(",") if x) if kind not in dict(BASE)}
    figures = {}
    for kind, _, _ in pii.CANDIDATES:
        of = [{x for x in s if x[0] == kind} for s in (real, found)]
        figures[kind] = len(of[0]), len(of[0] & of[1]) / len(of[0]), len(of[0] & of[1]) / max(1, len(of[1]))
    print(figures)
    assert all(n > 50 and recall >= 0.95 and precision >= 0.95 for n, recall, precision in figures.values()), figures


def test_gazetteer_and_checksum(spark):
    from pyspark.sql import functions as F
    rnd = random.Random(4)
    good = [account(rnd, c, n) for c, n in pii.ACCOUNT_LENGTHS.items()] + ["GB29 NWBK 6016 1331 9268 19"]
    rows = [(g, True) for g in good] + [(g[:-1] + str((int(g[-1]) + 1) % 10), False) for g in good]
    df = spark.createDataFrame(rows, "a string, ok boolean")
    assert df.where((pii.checksum(F.col("a")) == 1) != F.col("ok")).count() == 0
    assert df.where(~pii._looked_up("bank_account", F.col("a"))).count() == 0
    cases = [("secret", "ghp_0123456789abcdef0123", True), ("secret", "xghp_0123456789abcdef0123", False), ("national_phone", "(212) 334-5566", True), ("national_phone", "212-134-5566", False), ("national_phone", "211-334-5566", False),
             ("social_number", "772-01-0001", True), ("social_number", "773-01-0001", False), ("social_number", "666-01-0001", False), ("bank_account", "DE001234", False), ("bank_account", "XX00123456789", False),
             ("masked_email", "jo (AT) Gmail (dot) com", True), ("masked_email", "jo [at] mygmail [dot] com", False)]
    for kind, hit, want in cases:
        assert spark.range(1).select(pii._looked_up(kind, F.lit(hit))).first()[0] is want, hit

"""Personal data by weak supervision, in DataFrame expressions only.

Base kinds are patterns with checks. Candidates of further kinds come from wider patterns. Five labelers vote on each: its
shape or checksum, a gazetteer in which parts of the span are looked up, words nearby, an assignment and a quotation. Vote patterns are counted over the corpus; expectation-maximisation on these few counts estimates
each labeler's reliability, and the resulting probabilities train the final span classifier (naive Bayes over votes and
length, digits and parts of a span), which decides. What reaches the driver is one row per kind and code, of which there is a fixed number.

Positions need no user function: the pieces between matches and the matches themselves have lengths whose running sum is
the place of each match, in code points."""
from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns. Repeats are possessive and starts inside a run are ruled out where that changes no
# match, so that a text of one endless run takes linear time and no deep recursion.
_LOCAL = "[A-Za-z0-9._%+-]"
BASE = (("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
        ("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
        ("card", r"[0-9](?:[\x20-]?[0-9])++", None),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+"))
BYTE = r"^0*([0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"

# Candidate patterns of further kinds (choices of this module), and for each the words that speak for it nearby.
CANDIDATES = (
    ("secret", r"(?<![0-9A-Za-z_+/=.-])(?=[A-Za-z_+/=.-]*[0-9])(?=[0-9_+/=.-]*[A-Za-z])[0-9A-Za-z_+/-]{20,}+", ("token", "secret", "password", "passwd", "api_key", "apikey", "api key", "bearer", "credential")),
    ("national_phone", r"(?<![0-9A-Za-z+().-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])", ("phone", "call", "tel", "mobile", "fax", "whatsapp")),
    ("social_number", r"(?<![0-9A-Za-z+().-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", ("ssn", "social security", "taxpayer", "insurance number")),
    ("bank_account", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[0-9A-Z]{4}){3,7}(?:\x20?[0-9A-Z]{1,3})?(?![0-9A-Za-z])", ("iban", "account", "bank", "transfer")),
    ("masked_email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[(]\x20?at\x20?[\])]\x20?[A-Za-z0-9-]{1,63}+(?:\x20?[\[(]\x20?dot\x20?[\])]\x20?[A-Za-z0-9-]{1,63}+)+", ("mail", "contact", "write to", "reach")),
)
# What a span of each kind looks like when it is no accident; bank accounts have a checksum instead.
SHAPES = {"secret": r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,}|(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9]).{24,})$", "national_phone": r"^\([0-9]{3}\)\x20|^[0-9]{3}([.-])[0-9]{3}\1", "social_number": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)",
          "masked_email": r"(?i)dot\x20?[\])]\x20?(?:com|org|net|edu|io|de|fr|es|uk)$"}
# The gazetteer. How issued keys begin; the area codes of the first numbering plan and the toll-free ones; the
# last area number given out by place, with those never used; account lengths by country; hosts of public mail.
ISSUERS = ("AIza", "AKIA", "ASIA", "SG.", "dckr_pat_", "eyJ", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "hf_", "npm_", "pk_live_", "rk_live_", "sk_live_", "sk_test_", "sk-", "xoxb-", "xoxp-")
AREA_CODES = ("201 202 203 205 206 207 208 212 213 214 215 216 217 218 301 302 303 304 305 306 307 312 313 314 315 316 317 319 401 402 403 404 405 406 412 413 414 415 416 418 419 501 502 503 504 505 "
              "512 513 514 515 517 518 601 602 603 604 605 612 613 614 616 617 618 701 702 703 704 712 713 715 717 801 802 803 812 814 815 901 902 913 914 915 916 800 833 844 855 866 877 888").split()
LAST_AREA, UNUSED_AREAS = "772", ("000", "666", "729", "730", "731", "732", "733")
ACCOUNT_LENGTHS = {"AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IT": 27, "LT": 20, "LU": 20, "LV": 21,
                   "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "UA": 29}
MAIL_HOSTS = ("aol", "fastmail", "gmail", "gmx", "googlemail", "hotmail", "icloud", "live", "mail", "mailbox", "outlook", "proton", "protonmail", "tutanota", "ukr", "web", "yahoo", "yandex", "zoho")
ASSIGNED = r"[=:]\s*[\"'`]?$"
QUOTED = r"[\"'`(<]$"
CONTEXT = 40
AHEAD = 5  # matches are 8 code points long or more where context counts, so these reach CONTEXT
PLACES = "array<struct<start:int,end:int,hit:string,before:string,after:string>>"
N_VOTES = 5
CODES = 3 * (1 << N_VOTES) * 12
STEPS = 50
ACCEPT = 0.5


def located(text: Column, pattern: str, needed: str | None) -> tuple[Column, Column]:
    """(matches, pieces between them) of a pattern; empty without a look at the pattern if a needed character is missing."""
    has = F.lit(True) if needed is None else F.contains(text, F.lit(needed))
    nothing = F.array().cast("array<string>")
    return F.when(has, F.regexp_extract_all(text, F.lit(pattern), 0)).otherwise(nothing), F.when(has, F.split(text, pattern, -1)).otherwise(nothing)


def places(hits: Column, pieces: Column) -> Column:
    """Array of (start, end, hit, before, after) for matches and the pieces around them, in code points.

    `before` and `after` are the CONTEXT code points of the text there, whatever other matches lie in them."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), F.array().cast(PLACES).alias("done"))

    def step(acc, pair):
        start = acc["at"] + F.length(pair["p"])
        end = start + F.length(pair["h"])
        before = F.right(F.concat(acc["tail"], F.right(pair["p"], F.lit(CONTEXT))), F.lit(CONTEXT))
        near = [F.left(F.coalesce(pair[f"{c}{k}"], F.lit("")), F.lit(CONTEXT)) for k in range(1, AHEAD + 1) for c in "ph"]
        row = F.struct(start.alias("start"), end.alias("end"), pair["h"].alias("hit"), before.alias("before"), F.left(F.concat(*near), F.lit(CONTEXT)).alias("after"))
        return F.struct(end.alias("at"), F.right(F.concat(before, F.right(pair["h"], F.lit(CONTEXT))), F.lit(CONTEXT)).alias("tail"), F.concat(acc["done"], F.array(row)).alias("done"))

    n = F.size(hits)
    later = [x for k in range(1, AHEAD + 1) for x in (F.slice(pieces, k + 1, n).alias(f"p{k}"), F.slice(hits, k + 1, n).alias(f"h{k}"))]
    pairs = F.arrays_zip(hits.alias("h"), F.slice(pieces, 1, n).alias("p"), *later)
    return F.when(n > 0, F.aggregate(pairs, zero, step)["done"]).otherwise(zero["done"])


def _valid(kind: str, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: p.rlike(BYTE))
    if kind == "card":
        return F.length(digits).between(13, 19) & F.when(F.length(digits) <= 19, F.call_function("luhn_check", digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def checksum(account: Column) -> Column:
    """Remainder by 97 of an account number, its first four characters moved to the end, letters as 10 to 35."""
    plain = F.replace(account, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(plain, 5, 64), F.left(plain, F.lit(4)))

    def step(rest, c):
        code = F.ascii(c)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97).cast("int")

    return F.aggregate(F.split(moved, ""), F.lit(0), lambda rest, c: F.when(c == "", rest).otherwise(step(rest, c)))


def _looked_up(kind: str, hit: Column) -> Column:
    """Whether the part of a span that names its issuer, place or host is in the gazetteer."""
    if kind == "secret":
        return reduce(lambda a, b: a | b, [hit.startswith(x) for x in ISSUERS])
    if kind == "national_phone":
        digits = F.regexp_replace(hit, "[^0-9]", "")
        return F.left(digits, F.lit(3)).isin(AREA_CODES) & digits.rlike("^...[2-9](?!11)")  # no exchange begins otherwise
    if kind == "social_number":
        area = F.left(hit, F.lit(3))
        return (area <= LAST_AREA) & ~area.isin(*UNUSED_AREAS)
    if kind == "bank_account":
        lengths = F.create_map(*[F.lit(x) for pair in ACCOUNT_LENGTHS.items() for x in pair])
        return F.coalesce(F.length(F.replace(hit, F.lit(" "), F.lit(""))) == F.try_element_at(lengths, F.left(hit, F.lit(2))), F.lit(False))
    return F.regexp_extract(F.lower(hit), r"[\[(]\x20?at\x20?[\])]\x20?([a-z0-9-]+)", 1).isin(*MAIL_HOSTS)


def _votes(kind: str, words: tuple[str, ...], c: Column) -> Column:
    """Bits: shape or checksum, trigger words on either side, assignment context, quotation context, gazetteer."""
    near = F.lower(F.concat(c["before"], F.lit("\n"), c["after"]))
    named = reduce(lambda a, b: a | b, [F.contains(near, F.lit(w)) for w in words])
    shape = checksum(c["hit"]) == 1 if kind == "bank_account" else c["hit"].rlike(SHAPES[kind])
    voters = (shape, named, c["before"].rlike(ASSIGNED), c["before"].rlike(QUOTED), _looked_up(kind, c["hit"]))
    return reduce(lambda a, b: a + b, [F.when(v, F.lit(1 << i)).otherwise(F.lit(0)) for i, v in enumerate(voters)])


def _parts(hit: Column) -> Column:
    """Three classes of the number of parts of a span: one, two or three, more."""
    n = F.size(F.split(hit, r"[^0-9A-Za-z]+"))
    return F.when(n < 2, 0).when(n < 4, 1).otherwise(2)


def _shape_bits(hit: Column) -> Column:
    """Four length classes and three classes of the share of digits, in one number."""
    n = F.length(hit)
    digits = F.length(F.regexp_replace(hit, "[^0-9]", ""))
    size = F.when(n < 12, 0).when(n < 24, 1).when(n < 48, 2).otherwise(3)
    return size * 3 + F.when(digits * 4 < n, 0).when(digits * 4 < n * 3, 1).otherwise(2)


def _base_spans(k: int, kind: str) -> Column:
    valid = F.filter(F.col(f"_pii_b{k}"), lambda c: _valid(kind, c["hit"]))
    return F.transform(valid, lambda c: F.struct(F.lit(k).alias("kind"), c["start"].alias("start"), c["end"].alias("end")))


def _coded(k: int, kind: str, words: tuple[str, ...], taken: Column) -> Column:
    free = F.filter(F.col(f"_pii_c{k}"), lambda c: ~F.exists(taken, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return F.transform(free, lambda c: F.struct(F.lit(k).alias("kind"), c["start"].alias("start"), c["end"].alias("end"), ((_parts(c["hit"]) * (1 << N_VOTES) + _votes(kind, words, c)) * 12 + _shape_bits(c["hit"])).alias("code")))


def spans(docs: DataFrame, text: str) -> DataFrame:
    """docs with `_pii_base` (kind number, start, end) and `_pii_more` (kind number, start, end, code) of each text.

    Base spans stay as they are; a candidate that overlaps one of them is not considered."""
    t = F.coalesce(text, F.lit(""))
    df = docs
    every = [(f"b{k}", p, need) for k, (_, p, need) in enumerate(BASE)] + [(f"c{k}", p, None) for k, (_, p, _) in enumerate(CANDIDATES)]
    found = {name: located(t, p, need) for name, p, need in every}
    df = df.withColumns({f"_pii_h{n}": h for n, (h, _) in found.items()})
    df = df.withColumns({f"_pii_{n}": F.when(F.size(f"_pii_h{n}") > 0, places(F.col(f"_pii_h{n}"), pieces)).otherwise(F.array().cast(PLACES)) for n, (_, pieces) in found.items()})
    df = df.withColumn("_pii_base", F.concat(*[_base_spans(k, kind) for k, (kind, _, _) in enumerate(BASE)]))
    taken = F.transform("_pii_base", lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end")))
    more = F.concat(*[_coded(k, kind, words, taken) for k, (kind, _, words) in enumerate(CANDIDATES)])
    return df.withColumn("_pii_more", more).drop(*[f"_pii_h{n}" for n in found], *[f"_pii_{n}" for n in found])


def estimate(counts: dict[int, int]) -> dict[int, float]:
    """Probability that a span is real for each vote pattern, by expectation-maximisation over pattern counts.

    Two hidden classes; each labeler votes with its own rate in each. It starts from labelers that are right four times
    in five, which fixes which class is which; a weak prior keeps rates off 0 and 1."""
    right, wrong, share = [0.8] * N_VOTES, [0.2] * N_VOTES, 0.5
    post: dict[int, float] = {}
    for _ in range(STEPS):
        for p in counts:
            a, b = math.log(share), math.log(1 - share)
            for i in range(N_VOTES):
                on = p >> i & 1
                a += math.log(right[i] if on else 1 - right[i])
                b += math.log(wrong[i] if on else 1 - wrong[i])
            post[p] = 1 / (1 + math.exp(min(50, b - a)))
        yes = sum(counts[p] * post[p] for p in counts)
        no = sum(counts.values()) - yes
        share = (yes + 1) / (yes + no + 2)
        for i in range(N_VOTES):
            right[i] = (sum(counts[p] * post[p] for p in counts if p >> i & 1) + 4) / (yes + 5)
            wrong[i] = (sum(counts[p] * (1 - post[p]) for p in counts if p >> i & 1) + 1) / (no + 5)
    return post


def votes_of(code: int) -> int:
    return code // 12 % (1 << N_VOTES)


def train(counts: dict[int, int]) -> set[int]:
    """Codes that the span classifier accepts: naive Bayes over votes, length, digits and parts, trained on the estimates.

    A span without any vote is never accepted."""
    votes: dict[int, int] = {}
    for code, n in counts.items():
        votes[votes_of(code)] = votes.get(votes_of(code), 0) + n
    post = estimate(votes)

    def features(code: int) -> list[tuple[str, int]]:
        return [("size", code % 12 // 3), ("digits", code % 3), ("parts", code // 12 >> N_VOTES)] + [(f"vote{i}", votes_of(code) >> i & 1) for i in range(N_VOTES)]

    weight = {c: (n * post[votes_of(c)], n * (1 - post[votes_of(c)])) for c, n in counts.items()}
    total = [sum(w[k] for w in weight.values()) + 1 for k in (0, 1)]
    seen: dict[tuple[str, int], list[float]] = {}
    for c, w in weight.items():
        for f in features(c):
            both = seen.setdefault(f, [0.5, 0.5])
            both[0], both[1] = both[0] + w[0], both[1] + w[1]
    accepted = set()
    for c in counts:
        odds = math.log(total[0] / total[1]) + sum(math.log(seen[f][0] / total[0]) - math.log(seen[f][1] / total[1]) for f in features(c))
        if odds > math.log(ACCEPT / (1 - ACCEPT)) and votes_of(c):
            accepted.add(c)
    return accepted


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_email, n_ip, n_card, n_phone, base_sha256, spans (kind:start:end, base kinds first, then the added ones).

    Null texts count as empty; repeated rows get a row each."""
    found = spans(docs.select(F.col(id_col).alias("_pii_id"), F.col(text_col).alias("_pii_text")), "_pii_text").drop("_pii_text")
    counted = found.select(F.explode("_pii_more").alias("c")).groupBy("c.kind", "c.code").agg(F.count(F.lit(1)).alias("n"))
    by_kind: dict[int, dict[int, int]] = {}
    for r in counted.collect():  # at most 1152 codes for each kind
        by_kind.setdefault(r["kind"], {})[r["code"]] = r["n"]
    accepted = sorted(k * CODES + c for k, counts in by_kind.items() for c in train(counts))
    chosen = F.filter("_pii_more", lambda c: (c["kind"] * CODES + c["code"]).isin(accepted) if accepted else F.lit(False))
    name = lambda kinds: lambda s: F.concat_ws(":", F.element_at(F.array(*[F.lit(k[0]) for k in kinds]), s["kind"] + 1), s["start"], s["end"])
    base, more = F.transform("_pii_base", name(BASE)), F.transform(chosen, name(CANDIDATES))
    n_of = lambda k: F.size(F.filter("_pii_base", lambda s: s["kind"] == k)).cast("long")
    return found.select(F.col("_pii_id").alias(id_col), *[n_of(k).alias(f"n_{kind}") for k, (kind, _, _) in enumerate(BASE)],
                        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.concat(base, more), ",").alias("spans"))

"""Personal data by weak supervision, in DataFrame expressions only.

Candidates come from patterns. Three groups of labelers vote on each (+1, 0 for no opinion, -1): the
pattern's own check, a gazetteer, and the words before it. Expectation maximisation over the counts of
vote patterns estimates how reliable each labeler is for each kind, and a logistic span classifier is
trained on the expected labels. Only the table of patterns, at most kinds * 3**4 * 4 = 1,944 rows
whatever the input, is read by the driver; candidates are found and classified on the executors.

Base spans (the contract's patterns and checks) always stay; matches that fail their check serve the
estimates but are never added. The classifier adds candidates of the other kinds that overlap no base span. Offsets are code points, ends exclusive.

Defined results: a null or empty text has no spans; every row gives one row, repeated or not; ids may be
null; other columns are left out. Quantifiers are possessive and starts are anchored at run boundaries, so
matching takes linear time and constant stack in a text of any length; spans are placed and compared in one sweep each.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitspark.session import rewritten

KINDS = ("email", "ip", "card", "phone", "secret", "address")
BASE = KINDS[:4]

# What each kind looks like. A start inside a run of the same characters can match only where
# a start at the run's beginning does, so starts are the beginning of a run or the end of the last match.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"""(?<=[=:] ?["']?)(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{16,}+(?![A-Za-z0-9_/+=-])""",
    "address": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[({](?:at|AT)[\])}] ?[A-Za-z0-9-]{1,63}+(?: ?(?:[\[({](?:dot|DOT)[\])}]|\.) ?[A-Za-z0-9-]{2,63}+)++",
}
# Gazetteers and cue words.
TOP_DOMAINS = "com org net edu gov info io eu de fr es it uk ch at nl be us ca au jp cn in br example".split()
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 98 351 352 353 358 380 385 386 420 421".split()
CARD_PREFIX = r"^(?:4|5[1-5]|2[2-7]|3[47]|30|35|36|38|6011|64|65)"
SECRET_PREFIX = r"^(?:AKIA|ghp_|gho_|sk_|pk_|xox|eyJ)"
CUES = {
    "email": r"(?i)(?:e-?mail|contact|write|reply|mailto)\W*(?:\w+\W+)?$",
    "ip": r"(?i)(?:\bip\b|host|server|address|client|from)\W*(?:\w+\W+)?$",
    "card": r"(?i)(?:card|visa|credit|payment|iban|pay)\W*(?:\w+\W+)?$",
    "phone": r"(?i)(?:phone|tel|call|fax|mobile|cell)\W*(?:\w+\W+)?$",
    "secret": r"(?i)(?:token|secret|passw|api_?key|\bkey\b|credential)\W*$",
    "address": r"(?i)(?:e-?mail|contact|write|reply)\W*(?:\w+\W+)?$",
}
AGAINST = r"(?i)(?:version|isbn|order|invoice|chapter|section|commit|sha\d*|hash|id)\W*$"

_CANDIDATE = "array<struct<kind:int,start:int,stop:int,base:boolean,votes:array<int>,traits:array<int>>>"


_HITS = "array<struct<skip:int,length:int,before:string,hit:string>>"


def running(df: DataFrame, columns: dict[str, str], step) -> DataFrame:
    """Adds, for each (new column, column of integers), what step(so far, value) gives before each value, from 0 on.

    The values are cut into about as many blocks as a block has values. A fold copies what it has so far at each step, so
    only arrays of one block's length are built by folds: n values cost n**1.5 copies of an integer, not n**2. Every stage
    is a column of its own, since a lambda evaluates what it captures anew for each element.
    """

    def growing(part: Column, begin: Column) -> Column:
        first = F.struct(begin.alias("now"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part, first, lambda acc, x: F.struct(step(acc["now"], x).alias("now"), F.concat(acc["out"], F.array(acc["now"])).alias("out")), lambda acc: acc["out"])

    def blocks(values: str) -> Column:
        n = F.size(values)
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(n)).cast("int"))
        cut = F.transform(F.sequence(F.lit(0), ((n - 1) / width).cast("int")), lambda b: F.slice(values, b * width + 1, width))
        return F.when(n > 0, cut).otherwise(F.array().cast("array<array<int>>"))

    df = df.withColumns({f"{out}_blocks": blocks(values) for out, values in columns.items()})
    df = df.withColumns({f"{out}_begins": growing(F.transform(f"{out}_blocks", lambda part: F.aggregate(part, F.lit(0), step)), F.lit(0)) for out in columns})
    return df.withColumns({out: F.flatten(F.zip_with(f"{out}_blocks", f"{out}_begins", growing)) for out in columns})


def hits(text: Column, pattern: str) -> Column:
    """All matches from left to right, each with the length of the gap before it and that gap's last 40 code points."""
    zipped = F.zip_with(
        F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, hit: F.struct(F.length(gap).alias("skip"), F.length(hit).alias("length"), F.substring(gap, -40, 40).alias("before"), hit.alias("hit")),
    )
    return F.filter(zipped, lambda x: x["hit"].isNotNull())  # the last gap has no hit after it


def apart(df: DataFrame, spans: str, others: str) -> DataFrame:
    """Leaves in `spans` those that overlap none of `others`, by one sweep over the starts of these and the ends of those.

    A span overlaps if some other that starts before its end ends after its start.
    """
    kind = _CANDIDATE[6:-1]
    starts = F.transform(others, lambda o: F.struct(o["start"].alias("at"), F.lit(1).alias("turn"), o["stop"].alias("reach"), F.lit(None).cast(kind).alias("span")))
    ends = F.transform(spans, lambda c: F.struct(c["stop"].alias("at"), F.lit(0).alias("turn"), F.lit(0).alias("reach"), c.alias("span")))
    df = df.withColumn("line", F.array_sort(F.concat(starts, ends)))
    df = df.withColumn("reaches", F.transform("line", lambda x: x["reach"]))
    df = running(df, {"far": "reaches"}, lambda far, x: F.greatest(far, x))
    met = F.zip_with("line", "far", lambda x, far: F.struct(x["span"].alias("span"), (far <= x["span"]["start"]).alias("clear")))
    return df.withColumn(spans, F.transform(F.filter(met, lambda x: x["clear"]), lambda x: x["span"]))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def passes(kind: str, hit: Column) -> Column:
    """The contract's check of a match; for kinds beyond it, a strict form."""
    if kind == "ip":
        part = lambda p: F.length(F.regexp_replace(p, "^0+(?=[0-9])", "")) <= 3
        return F.forall(F.split(hit, r"\."), lambda p: part(p) & (F.expr("1") * F.substring(F.regexp_replace(p, "^0+(?=[0-9])", ""), 1, 3).cast("int") <= 255))
    if kind == "card":
        return F.length(_digits(hit)).between(12, 19) & luhn(F.substring(_digits(hit), 1, 19))
    if kind == "phone":
        return F.length(_digits(hit)).between(9, 15)
    if kind == "secret":
        return hit.rlike("[0-9]") & hit.rlike("[A-Za-z]") & (F.length(hit) >= 20)
    return F.lit(True)


def known(kind: str, hit: Column) -> Column:
    """The gazetteer's vote."""
    yes = lambda c, no=0: F.when(c, 1).otherwise(no)
    if kind in ("email", "address"):
        return yes(F.lower(F.regexp_extract(hit, r"([A-Za-z0-9-]+)$", 1)).isin(TOP_DOMAINS))
    if kind == "ip":
        return F.when(hit.rlike(r"^(?:0|127|255)\."), -1).otherwise(yes(hit.rlike(r"^(?:10|172|192)\.|^[1-9][0-9]{0,2}\.")))
    if kind == "card":
        return yes(_digits(hit).rlike(CARD_PREFIX), -1)
    if kind == "phone":
        return yes(_digits(hit).rlike("^(?:" + "|".join(CALLING_CODES) + ")"))
    return yes(hit.rlike(SECRET_PREFIX))


def shape(kind: str, hit: Column) -> Column:
    """Whether the span is written as its kind usually is."""
    usual = {
        "email": r"^.{5,80}$",
        "ip": r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$",
        "card": r"^(?:[0-9]{4}[ -]?){3,4}[0-9]{0,4}$",
        "phone": r"^\+[0-9]{1,3}[ (.-]",
        "secret": r"^(?:[0-9a-f]{32,}|(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9]).{20,})$",
        "address": r"^.{5,90}$",
    }
    return F.when(hit.rlike(usual[kind]), 1).otherwise(-1)


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, found): all candidate spans with the votes on them."""

    def of(kind: str):
        def make(x: Column, at: Column) -> Column:
            hit, before, start, number = x["hit"], x["before"], at + x["skip"], KINDS.index(kind)
            ok = passes(kind, hit)
            cue = F.when(before.rlike(AGAINST), -1).when(before.rlike(CUES[kind]), 1).otherwise(0)
            votes = [F.when(ok, 1).otherwise(-1), known(kind, hit), cue, shape(kind, hit)]
            traits = [x["length"] > 24, hit.rlike("[ .()-]")]
            return F.struct(
                F.lit(number).alias("kind"), start.alias("start"), (start + x["length"]).alias("stop"),
                (ok & F.lit(kind in BASE)).alias("base"), F.array(*votes).alias("votes"), F.array(*[t.cast("int") for t in traits]).alias("traits"),
            )

        return make

    # a text without a kind's necessary character is not searched for it
    text, none = F.col("text"), F.array().cast(_HITS)
    need = {"email": text.contains("@"), "phone": text.contains("+"), "secret": text.contains("=") | text.contains(":"), "address": text.rlike(r"[\[({](?:at|AT)[\])}]")}
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    df = df.withColumns({f"{k}_hits": F.when(need.get(k, text.rlike("[0-9]")), hits(text, PATTERNS[k]).cast(_HITS)).otherwise(none) for k in KINDS}).drop("text")
    df = df.withColumns({f"{k}_lengths": F.transform(f"{k}_hits", lambda x: x["skip"] + x["length"]) for k in KINDS})
    df = running(df, {f"{k}_at": f"{k}_lengths" for k in KINDS}, lambda at, n: at + n)
    return df.select("doc_id", F.concat(*[F.zip_with(f"{k}_hits", f"{k}_at", of(k)).cast(_CANDIDATE) for k in KINDS]).alias("found"))


def _reliabilities(rows: list[tuple], rounds: int = 30) -> dict[tuple, float]:
    """Expected labels of the vote patterns (kind, votes, traits): Dawid and Skene's estimate for each kind."""
    expected: dict[tuple, float] = {}
    for kind in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == kind]
        q = [1 / (1 + math.exp(-sum(r[1]) - r[1][0])) for r in own]
        for _ in range(rounds):
            share = [1.0, 1.0]
            table: dict[tuple, list[float]] = defaultdict(lambda: [1.0, 1.0])
            for (_, votes, _, n), p in zip(own, q):
                share[0] += n * (1 - p)
                share[1] += n * p
                for j, v in enumerate(votes):
                    table[j, v][0] += n * (1 - p)
                    table[j, v][1] += n * p
            # a labeler is better than chance: what it votes for is not less likely when it is true
            lift = {}
            for (j, v), (no, yes) in table.items():
                x = math.log((yes / (share[1] + 2)) / (no / (share[0] + 2)))
                lift[j, v] = max(x, 0.0) if v > 0 else min(x, 0.0) if v < 0 else x / 2
            prior = math.log(share[1] / share[0])
            q = [1 / (1 + math.exp(-max(-30, min(30, prior + sum(lift[j, v] for j, v in enumerate(r[1])))))) for r in own]
        expected |= {(r[0], r[1], r[2]): p for r, p in zip(own, q)}
    return expected


def _inputs(votes, traits) -> list[float]:
    return [1.0, *map(float, votes), *map(float, traits)]


def _classifier(rows: list[tuple], expected: dict[tuple, float], steps: int = 300) -> dict[int, list[float]]:
    """Weights of a logistic span classifier for each kind, fitted to the expected labels of the patterns."""
    weights = {}
    for kind in {r[0] for r in rows}:
        own = [(_inputs(r[1], r[2]), r[3], expected[r[:3]]) for r in rows if r[0] == kind]
        total = sum(n for _, n, _ in own)
        w = [0.0] * 7
        for _ in range(steps):
            slope = [0.01 * x for x in w]
            for x, n, p in own:
                miss = (1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(w, x)))))) - p) * n / total
                slope = [s + miss * b for s, b in zip(slope, x)]
            w = [a - s for a, s in zip(w, slope)]
        weights[kind] = w
    return weights


def find_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, base, added): arrays of (kind, start, stop), each sorted by start, then kind."""
    found = rewritten(candidates(docs), "candidates")
    patterns = found.select(F.explode("found").alias("c")).groupBy("c.kind", "c.votes", "c.traits").count()
    rows = [(r[0], tuple(r[1]), tuple(r[2]), r[3]) for r in patterns.collect()]
    rows.sort()
    weights = _classifier(rows, _reliabilities(rows))

    def likely(c: Column) -> Column:
        """Whether the classifier holds the candidate to be personal data."""
        out = F.lit(False)
        for kind, w in sorted(weights.items()):
            inputs = [F.lit(1.0), *(c["votes"][j] for j in range(4)), *(c["traits"][j] for j in range(2))]
            score = sum((F.lit(a) * x for a, x in zip(w, inputs)), F.lit(0.0))
            out = F.when(c["kind"] == kind, score >= 0).otherwise(out)
        return out

    def bare(array: Column) -> Column:
        ordered = F.array_sort(F.transform(array, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["stop"].alias("stop"))))
        return ordered

    base = F.filter("found", lambda c: c["base"])
    more = F.filter("found", lambda c: (c["kind"] >= len(BASE)) & likely(c))
    spans = apart(found.select("doc_id", base.alias("base"), more.alias("more")), "more", "base")
    return spans.select("doc_id", bare(F.col("base")).alias("base"), bare(F.col("more")).alias("added"))


def rendered(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def span_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row."""
    of = lambda k: F.filter("base", lambda s: s["kind"] == k)
    counts = [F.size(of(k)).cast("long").alias(f"n_{name}") for k, name in enumerate(BASE)]
    return find_spans(docs).select("doc_id", *counts, F.sha2(rendered(F.col("base")), 256).alias("base_sha256"), rendered(F.array_sort(F.concat("base", "added"))).alias("spans"))

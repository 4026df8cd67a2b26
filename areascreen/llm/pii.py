"""Personal data by weak supervision, in Spark expressions only.

Base patterns find mail addresses, network addresses, cards and phone numbers. Other spans come from candidates on which
labelers vote: shape patterns, a gazetteer of words, and the context. Expectation maximisation over the counts of all
vote patterns estimates how reliable each labeler is, and its posteriors train the span classifier.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

#: Kinds in the order that decides between spans of one start; SECRET is what the method adds.
KINDS = ("email", "ip", "card", "phone")
SECRET = "secret"

# Every pattern is free of repeated groups and of backtracking over long runs, so very long texts cost linear time. Two
# of them read a text of equal length in which marks that cannot be inside a match are replaced.
_LOCAL = "[A-Za-z0-9._%+-]"
_PATTERN = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9][0-9 -]+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Tokens that may be secrets: at least 12 characters of the alphabets of keys, a digit among them.
_CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{12,}+"
#: Words before a value that mark it as secret, and characters of text before a candidate that are read for them.
SECRET_WORDS = ["token", "secret", "password", "passwd", "pwd", "key", "apikey", "api_key", "auth", "bearer", "credential"]
_BEFORE = 32
#: Rounds of expectation maximisation, and posterior from which a span counts.
ROUNDS, ACCEPT = 25, 0.5
LABELERS = ("hex", "mixed", "assigned", "quoted", "gazetteer", "digits", "wordlike")
FEATURES = ("length", "letters", "context", "gazetteer")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the checksum of cards."""
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda d, k: F.when(k % 2 == 0, d.cast("int")).otherwise(
        d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))
    if kind == "card":
        return F.length(_digits(match)).between(14, 19) & _luhn(_digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    return F.lit(True)


def _matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, match) of all leftmost matches, in code points: what splitting leaves gives the places."""
    found, gaps = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), F.split(text, pattern, -1)
    sizes = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("own"), m.alias("text")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("spans"))
    return F.aggregate(sizes, start, lambda acc, m: F.when(m["text"].isNull(), acc).otherwise(F.struct(  # no match follows the last gap
        (acc["at"] + m["gap"] + m["own"]).alias("at"),
        F.concat(acc["spans"], F.array(F.struct((acc["at"] + m["gap"]).alias("start"), (acc["at"] + m["gap"] + m["own"]).alias("end"), m["text"].alias("text")))).alias("spans"))))["spans"]


#: Columns used inside.
_OWN = ["_candidates", "_digits", *[f"_{k}" for k in KINDS]]
_NO_MATCH = "array<struct<start:int,end:int,text:string>>"


def _with_base(docs: DataFrame) -> DataFrame:
    """``docs``, one array of spans per kind, and ``_digits``: whether a text holds any. A kind is searched only in texts
    that hold what it needs; all but mail addresses need digits, which many texts lack."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    read = {
        "email": F.regexp_replace(text, r"\.(?![A-Za-z0-9-])", "%"), "ip": text,
        "card": F.regexp_replace(text, r"[ -](?![0-9])", "x"), "phone": text}
    needs = {kind: F.col("_digits") & text.rlike(p) for kind, p in (("ip", r"[0-9]\.[0-9]"), ("card", r"[0-9][0-9 -]{12}"), ("phone", r"\+[0-9]"))}
    needs["email"] = F.contains(text, F.lit("@"))

    def spans(kind: str) -> Column:
        return F.when(needs[kind], F.filter(_matches(read[kind], _PATTERN[kind]), lambda m: _valid(kind, m["text"]))).otherwise(F.array().cast(_NO_MATCH))

    return docs.withColumn("_digits", text.rlike("[0-9]")).withColumns({f"_{kind}": spans(kind) for kind in KINDS})


def _with_candidates(docs: DataFrame) -> DataFrame:
    """``docs`` and ``_candidates``: spans with their text and the text before them, but for those inside base spans."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = F.concat(*[F.col(f"_{k}") for k in KINDS])
    found = F.when(F.col("_digits") & text.rlike(_CANDIDATE), _matches(text, _CANDIDATE)).otherwise(F.array().cast(_NO_MATCH))
    # A bound variable holds the base spans; as a plain expression they would be searched again for each candidate.
    free = F.flatten(F.transform(F.array(base), lambda spans: F.filter(
        found, lambda m: ~F.exists(spans, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))))
    return docs.withColumn("_candidates", F.transform(free, lambda m: F.struct(
        m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text"),
        F.lower(F.substr(text, F.greatest(F.lit(1), m["start"] + 1 - _BEFORE), F.least(F.lit(_BEFORE), m["start"]))).alias("before"))))


def _votes(c: Column) -> Column:
    """One vote per labeler: 1 (personal), 0 (not) or -1 (none)."""
    def vote(yes: Column, no: Column | None = None) -> Column:
        return F.when(yes, 1).when(no if no is not None else F.lit(False), 0).otherwise(-1)

    text, before = c["text"], c["before"]
    return F.array(
        vote(text.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$") & text.rlike("[a-fA-F]") & (F.length(text) >= 16)),
        vote(text.rlike("[a-zA-Z]") & (F.length(_digits(text)) > 2), F.length(_digits(text)) < 2),
        vote(before.rlike(r"[=:]\s*[\"']?$"), ~before.rlike(r"[=:\"']\s*$")),
        vote(before.rlike(r"[\"']$")),
        vote(before.rlike(r"(?:^|[^a-z])(?:" + "|".join(SECRET_WORDS) + r")[^a-z0-9]{0,4}$")),
        vote(F.lit(False), text.rlike("^[0-9_-]+$")),
        vote(F.lit(False), text.rlike("^[A-Za-z]+[0-9]{0,4}$|^[0-9]{0,4}[A-Za-z]+$")))


def _features(c: Column) -> Column:
    """Closed values that the span classifier reads."""
    text, before = c["text"], c["before"]
    return F.array(
        F.concat(F.lit("length "), F.least(F.lit(6), F.floor(F.length(text) / 8)).cast("string")),
        F.concat(F.lit("letters "), F.when(text.rlike("^[0-9a-fA-F]+$"), "hex").when(text.rlike("^[0-9_-]+$"), "digits").when(text.rlike("^[A-Za-z]+[0-9]+$"), "word").otherwise("mixed")),
        F.concat(F.lit("context "), F.when(before.rlike(r"[=:]\s*[\"']?$"), "assigned").when(before.rlike(r"[\"']$"), "quoted").otherwise("plain")),
        F.concat(F.lit("gazetteer "), before.rlike("|".join(SECRET_WORDS)).cast("string")))


def reliabilities(patterns: dict[tuple[int, ...], int], rounds: int = ROUNDS) -> tuple[float, list[tuple[float, float]], dict[tuple[int, ...], float]]:
    """Share of personal spans, (hit, false alarm) rates of every labeler, and the posterior of every vote pattern.

    Works on the counts of vote patterns, a table whose size the number of labelers bounds, so all spans count.
    """
    share, rates = 0.5, [(0.8, 0.2)] * len(LABELERS)
    posterior: dict[tuple[int, ...], float] = {}
    total = sum(patterns.values())
    for _ in range(rounds if total else 0):
        for votes in patterns:
            yes, no = math.log(share), math.log(1 - share)
            for v, (hit, alarm) in zip(votes, rates):
                if v >= 0:
                    yes += math.log(hit if v else 1 - hit)
                    no += math.log(alarm if v else 1 - alarm)
            posterior[votes] = 1 / (1 + math.exp(max(-60.0, min(60.0, no - yes))))
        share = min(0.99, max(0.01, sum(n * posterior[v] for v, n in patterns.items()) / total))
        for k in range(len(LABELERS)):
            said = [(v[k], n, posterior[v]) for v, n in patterns.items() if v[k] >= 0]
            hit = (sum(n * p * v for v, n, p in said) + 4) / (sum(n * p for _, n, p in said) + 5)
            alarm = (sum(n * (1 - p) * v for v, n, p in said) + 1) / (sum(n * (1 - p) for _, n, p in said) + 5)
            rates[k] = (hit, alarm)
    return share, rates, posterior


def candidate_spans(docs: DataFrame) -> DataFrame:
    """c: every candidate of every document. Texts without a token of the right form are left out ahead of the base spans."""
    text = F.col("text").cast("string")
    holding = docs.select("text").filter(text.rlike("[0-9]")).filter(text.rlike(_CANDIDATE))
    # The outer form, as the plain one would add a filter that works the array out a second time.
    return _with_candidates(_with_base(holding)).select(F.explode_outer("_candidates").alias("c")).filter("c IS NOT NULL")


def train(docs: DataFrame) -> dict[str, float]:
    """Log odds of every feature value, and of the share ("share"), from the candidates of all documents."""
    spans = candidate_spans(docs)
    counts = spans.select(_votes(F.col("c")).alias("votes"), _features(F.col("c")).alias("features")).groupBy("votes", "features").agg(F.count(F.lit(1)).alias("n"))
    held = [(tuple(r["votes"]), tuple(r["features"]), r["n"]) for r in counts.collect()]  # closed values: bounded by their number
    patterns: dict[tuple[int, ...], int] = {}
    for votes, _, n in held:
        patterns[votes] = patterns.get(votes, 0) + n
    share, _, posterior = reliabilities(patterns)
    weights = {"share": math.log(share / (1 - share))}
    yes = sum(n * posterior[v] for v, _, n in held) + 1
    no = sum(n * (1 - posterior[v]) for v, _, n in held) + 1
    seen: dict[str, list[float]] = {}
    for votes, features, n in held:
        for f in features:
            pair = seen.setdefault(f, [0.0, 0.0])
            pair[0] += n * posterior[votes]
            pair[1] += n * (1 - posterior[votes])
    return weights | {f: math.log((a + 0.5) / yes) - math.log((b + 0.5) / no) for f, (a, b) in seen.items()}


def find(docs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """All columns of ``docs`` and ``pii``: array of (start, kind, end) by start and then kind as listed.

    Places are code points, ends exclusive. Base spans are what the patterns and their checks give; spans that the
    classifier accepts are added as SECRET. Null or empty texts have no spans. Each row stands for itself, so repeated
    rows have equal results; other columns pass through, but a column called ``pii`` is replaced; an empty table gives no rows.
    """
    taken = {c: f"_kept {n} {c}" for n, c in enumerate(docs.columns) if c in _OWN}
    docs = docs.withColumnsRenamed(taken)  # columns called like those used inside come back under their names
    weight = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else F.create_map(F.lit("share"), F.lit(0.0))
    found = _with_candidates(_with_base(docs.drop("pii")))
    odds = lambda c: F.aggregate(_features(c), F.lit(float(weights.get("share", 0.0))), lambda a, f: a + F.coalesce(F.element_at(weight, f), F.lit(0.0)))
    limit = math.log(ACCEPT / (1 - ACCEPT))
    added = F.filter("_candidates", lambda c: odds(c) >= limit)

    def named(spans: Column, order: int, kind: str) -> Column:
        return F.transform(spans, lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("order"), m["end"].alias("end"), F.lit(kind).alias("kind")))

    arrays = [named(F.col(f"_{kind}"), n, kind) for n, kind in enumerate(KINDS)] + [named(added, len(KINDS), SECRET)]
    return found.withColumn("pii", F.array_sort(F.concat(*arrays))).drop(*_OWN).withColumnsRenamed({v: k for k, v in taken.items()})


def redact(found: DataFrame) -> DataFrame:
    """``text`` with every span replaced by its kind in brackets. Spans that overlap an earlier one go with it."""
    text = F.coalesce(F.col("text"), F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    done = F.aggregate("pii", start, lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(
        s["end"].alias("at"), F.concat(acc["parts"], F.array(F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.concat(F.lit("["), s["kind"], F.lit("]")))).alias("parts"))
    ).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["parts"].alias("parts"))))
    whole = F.concat(F.array_join(done["parts"], ""), F.substr(text, done["at"] + 1))
    return found.withColumn("text", F.when(F.size("pii") > 0, whole).otherwise(F.col("text")))

"""Secret scans: fixed patterns, and strings that a character model of random strings explains better.

Two models give the chance of each character after the one before it: one of random strings, one of ordinary
words, identifiers and paths. The part of a string with the largest log-likelihood ratio is judged,
so a random part of a path is found and the path around it is left alone.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

# The base kinds, in the order in which they are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ("assign", "access", "hex", "random")

#: Strings that the models compare.
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
#: Documents, on average, whose strings train the models.
TRAINING_DOCS = 4_000
#: Log-likelihood ratio from which part of a string counts as random: ten thousand to one, as the best of many parts is
#: judged. Part of so many characters at least.
THRESHOLD = 9.2
SHORTEST = 16
#: Share of each model's chances that goes by the kinds of the two characters alone, so that a pair that the training
#: rows happen to lack does not decide. Random characters depend on their kinds only, in truth.
BACKED = {"random": 0.5, "ordinary": 0.2}
MASK = "[SECRET]"
_FIRST, _SYMBOLS = 32, 96
_SPANS = "array<struct<start:int,end:int>>"


def _spans(text: Column, pattern: str, wanted=None, part=None) -> Column:
    """array<struct<start, end>>: code points of the leftmost non-overlapping matches that are wanted.

    What stands between the matches and the matches themselves give the places, in one walk.
    ``wanted`` gets the match and the group 2 of it, if the pattern has one. ``part`` gives the span
    inside a match that is taken, null for none, instead of whole matches.
    """
    rx = F.lit(pattern)
    hits = F.regexp_extract_all(text, rx, F.lit(0))
    values = F.regexp_extract_all(text, rx, F.lit(2)) if "(" in pattern else hits
    between = F.split(text, pattern, -1)

    def whole(x: Column) -> Column:
        ok = x["hit"].isNotNull() & F.coalesce(wanted(x["hit"], x["value"]), F.lit(False))
        return F.when(ok, F.struct(F.lit(0).alias("start"), F.length(x["hit"]).alias("end")))

    parts = F.transform(F.arrays_zip(F.transform(between, lambda x: F.length(x)).alias("gap"), hits.alias("hit"), values.alias("value")),
                        lambda x: F.struct(F.coalesce(x["gap"], F.lit(0)).alias("gap"),
                                           F.coalesce(F.length(x["hit"]), F.lit(0)).alias("n"),
                                           (whole(x) if part is None else F.when(x["hit"].isNotNull(), part(x["hit"]))).alias("part")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("found"))

    def step(seen: Column, x: Column) -> Column:
        begin = seen["at"] + x["gap"]
        one = F.array(F.struct((begin + x["part"]["start"]).alias("start"), (begin + x["part"]["end"]).alias("end")))
        return F.struct((begin + x["n"]).alias("at"),
                        F.when(x["part"].isNotNull(), F.concat(seen["found"], one)).otherwise(seen["found"]).alias("found"))

    return F.when(F.regexp_like(text, rx), F.aggregate(parts, start, step, lambda x: x["found"])).otherwise(
        F.array().cast(_SPANS))


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of each fixed kind.

    Runs of hexadecimal digits and of capitals after AKIA end only where the run ends, so
    asking for the least length in the pattern gives the same matches as dropping short ones.
    """
    return {
        "assign": _spans(text, ASSIGN, lambda hit, value: F.length(value) >= LEAST["assign"]),
        "access": _spans(text, ACCESS.replace("+", f"{{{LEAST['access'] - 4},}}"), lambda hit, value: F.lit(True)),
        "hex": _spans(text, HEX.replace("+", f"{{{LEAST['hex']},}}"), lambda hit, value: F.lit(True)),
    }


def _pairs(strings: DataFrame) -> DataFrame:
    """Counts of neighbouring characters by class, from (label, value)."""
    at = F.explode(F.sequence(F.lit(1), F.length("value") - 1))
    return (strings.where(F.length("value") > 1).select("label", "value", at.alias("i"))
            .groupBy("label", F.expr("substring(value, i, 2)").alias("pair")).count())


def train(docs: DataFrame, sample: int = TRAINING_DOCS) -> list[float]:
    """Log-likelihood ratios of every pair of neighbouring characters, random over ordinary.

    Labelled strings come from about ``sample`` rows, chosen by a hash of doc_id and text: what
    the fixed patterns find there, and digests of the rows in the usual writings, are random;
    the other strings of six or more characters are ordinary, as are identifiers and paths made of each three
    words in a row. The driver gets one count per class and pair of printable characters.
    """
    total = docs.count()
    chance = min(1.0, sample / max(total, 1))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text)
    chosen = docs.select(named.alias("name"), text.alias("text")).where(
        F.pmod("name", F.lit(1 << 20)) < int(chance * (1 << 20)) + (chance >= 1))
    digest = F.sha2(F.col("name").cast("string"), 256)
    found = F.concat(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)),
                     F.regexp_extract_all("text", F.lit(ACCESS + r"|[0-9a-f]{16,}"), F.lit(0)))
    made = F.array(digest, F.base64(F.unhex(digest)), F.upper(F.substring(digest, 1, 20)))
    pieces = chosen.select(
        F.filter(found, lambda x: F.length(x) >= 12).alias("secret"), made.alias("made"),
        F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9+/_=-]{6,}"), F.lit(0)).alias("plain"),
        F.regexp_extract_all("text", F.lit(r"\b[A-Za-z]{2,12}\b"), F.lit(0)).alias("words"))
    random = pieces.select(F.lit(1).alias("label"), F.explode(F.concat("secret", "made")).alias("value"))
    plain = F.filter("plain", lambda x: ~F.exists("secret", lambda s: F.contains(s, x)))
    ordinary = pieces.select(F.lit(0).alias("label"), F.explode(F.concat(plain, identifiers(F.col("words")))).alias("value"))
    counts = np.full((2, _SYMBOLS, _SYMBOLS), 0.05)
    for r in _pairs(random.unionByName(ordinary)).collect():
        a, b = (ord(x) - _FIRST for x in r["pair"])
        if 0 <= a < _SYMBOLS and 0 <= b < _SYMBOLS:
            counts[r["label"], a, b] += r["count"]
    random_, ordinary_ = (_chances(counts[i], BACKED[name]) for i, name in ((1, "random"), (0, "ordinary")))
    return np.round(np.log(random_) - np.log(ordinary_), 6).ravel().tolist()


def identifiers(words: Column) -> Column:
    """Each three words in a row as identifiers and paths in the usual writings, one writing after the other."""
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(words) - 2, F.lit(1)), F.lit(3)), lambda i: i + 2 <= F.size(words))

    def made(i: Column) -> Column:
        low = F.transform(F.slice(words, i, F.lit(3)), lambda w: F.lower(w))
        high = F.transform(low, lambda w: F.initcap(w))
        writings = F.array(F.array_join(high, ""), F.concat(low[0], F.array_join(F.slice(high, 2, 2), "")), F.array_join(low, "_"),
                           F.array_join(low, "/"), F.array_join(low, "-"), F.upper(F.array_join(low, "_")))
        return F.get(writings, F.pmod(F.floor(i / 3), F.lit(6)).cast("int"))

    return F.transform(starts, made)


def _chances(counts: np.ndarray, backed: float) -> np.ndarray:
    """The chance of each symbol after each other: partly by the pair, partly by the kinds of both."""
    symbols = [chr(_FIRST + i) for i in range(_SYMBOLS)]
    kind = np.array([0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 + i for i, c in enumerate(symbols)])
    member = (kind[:, None] == np.arange(kind.max() + 1)[None, :]).astype(float)
    by_kind = member.T @ counts @ member
    by_kind /= np.maximum(by_kind.sum(1, keepdims=True), 1e-300)
    back = by_kind[kind][:, kind] / member.sum(0)[kind][None, :]
    return (1 - backed) * counts / counts.sum(1, keepdims=True) + backed * back


def _gains(value: Column, model: list[float]):
    """The log-likelihood ratio of the character after place i, from 1."""
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")  # folded to one constant

    def symbol(i: Column) -> Column:
        return F.ascii(F.substring(value, i, F.lit(1))) - _FIRST

    return lambda i: F.get(table, symbol(i) * _SYMBOLS + symbol(i + 1))


def score(value: Column, model: list[float]) -> Column:
    """The log-likelihood ratio of a string, random over ordinary."""
    gain = _gains(value, model)
    return F.aggregate(F.sequence(F.lit(1), F.length(value) - 1), F.lit(0.0), lambda s, i: s + gain(i))


def random_part(value: Column, model: list[float], threshold: float = THRESHOLD) -> Column:
    """struct<start, end> of the part of a string, of ``SHORTEST`` characters or more, with the largest ratio, if that reaches
    ``threshold``; else null. It is widened to whole runs of letters and digits, and to padding. A running maximum finds it in one walk."""
    gain = _gains(value, model)
    kinds = "struct<run:double,since:int,best:double,start:int,end:int>"
    first = F.struct(F.lit(0.0).alias("run"), F.lit(1).alias("since"), F.lit(float("-inf")).alias("best"), F.lit(0).alias("start"),
                     F.lit(0).alias("end")).cast(kinds)

    def step(s: Column, i: Column) -> Column:
        since = F.when(s["run"] > 0, s["since"]).otherwise(i)
        run = F.greatest(s["run"], F.lit(0.0)) + gain(i)
        better = (run > s["best"]) & (i - since + 2 >= SHORTEST)
        return F.struct(run.alias("run"), since.alias("since"), F.when(better, run).otherwise(s["best"]).alias("best"),
                        F.when(better, since - 1).otherwise(s["start"]).alias("start"),
                        F.when(better, i + 1).otherwise(s["end"]).alias("end")).cast(kinds)

    def widened(s: Column) -> Column:
        before = F.length(F.regexp_extract(F.substring(value, F.lit(1), s["start"]), r"[A-Za-z0-9]*$", 0))
        after = F.length(F.regexp_extract(F.substring(value, s["end"] + 1, F.length(value)), r"^[A-Za-z0-9]*=*", 0))
        return F.when(s["best"] >= threshold, F.struct((s["start"] - before).alias("start"), (s["end"] + after).alias("end")))

    return F.aggregate(F.sequence(F.lit(1), F.length(value) - 1), first, step, widened)


def scan(docs: DataFrame, model: list[float] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` (doc_id, text) with ``spans``, array<struct<start, rank, end>> in order, rank by KINDS.

    start and end are code points of the text, end exclusive. The kinds assign, access and hex
    are the fixed patterns; random adds parts of strings of 16 and more characters whose ratio reaches
    ``threshold`` and that do not lie in a fixed span; they may overlap one, and a string has one at the most. A null or
    empty text has no spans. Spans with one start are in the order of their kinds; repeated rows get equal spans.
    All columns stay.
    """
    model = model if model is not None else train(docs)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.withColumns({f"_{kind}": spans for kind, spans in base_spans(text).items()})
    found = found.withColumn("_random", _spans(text, CANDIDATE, part=lambda hit: random_part(hit, model, threshold)))
    fixed = F.concat("_assign", "_access", "_hex")
    found = found.withColumn("_fixed", fixed).withColumn("_random", F.filter("_random", lambda x: ~F.exists(
        "_fixed", lambda y: (y["start"] <= x["start"]) & (x["end"] <= y["end"]))))

    def ranked(kind: str) -> Column:
        rank = KINDS.index(kind)
        return F.transform(f"_{kind}", lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end")))

    return (found.withColumn("spans", F.array_sort(F.concat(*[ranked(k) for k in KINDS])))
            .drop("_fixed", *[f"_{k}" for k in KINDS]))


def written(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.get(kinds, x["rank"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by MASK; spans that touch or overlap give one."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(seen: Column, x: Column) -> Column:
        kept = F.concat(F.substring(text, seen["at"] + 1, x["start"] - seen["at"]), F.lit(MASK))
        return F.struct(F.greatest(seen["at"], x["end"]).alias("at"),
                        F.when(x["start"] >= seen["at"], F.concat(seen["out"], F.array(kept)))
                        .otherwise(seen["out"]).alias("out"))

    def rest(seen: Column) -> Column:
        return F.concat(F.array_join(seen["out"], ""), F.substring(text, seen["at"] + 1, F.length(text)))

    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, rest)).otherwise(text)

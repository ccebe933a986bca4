"""Language ID: evidence of text, declared language, address and host, fused by Bayes' rule."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from txnrisk.llm.extraction import main_text
from txnrisk.session import stage

#: Hash buckets of letter trigrams.
BUCKETS = 1 << 14
#: Labelled documents, on average, that train the text model, and the least that a language must have.
TRAINING_DOCS, LEAST_DOCS = 8_000, 5
#: Documents, on average, of a language that has more, however many languages there are.
LEAST_SAMPLE = 100
#: Share of a language's model that is spread evenly, so that unseen trigrams favour no language.
EVEN = 0.02
#: Trigrams of a text count as at most this many independent ones.
INDEPENDENT = 200
#: Documents that a parent's prior counts as, and strength of the uniform share of marks.
PRIOR_DOCS, MARK_DOCS = 20.0, 5.0
#: Least posterior of an accepted language.
CERTAIN = 0.5
_HASHES = 1 << 40
_LETTER: np.ndarray | None = None


@dataclass(frozen=True)
class TextModel:
    languages: list[str]
    logs: np.ndarray  # log probability of each bucket (rows) in each language


def trigrams(text: str | None) -> np.ndarray:
    """Buckets of the trigrams of letters, lower-cased; a run of other characters is one space."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.array([chr(i).isalpha() for i in range(1 << 16)])
    if not text:
        return np.empty(0, np.int64)
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    letter = (codes >= 1 << 16) | _LETTER[np.minimum(codes, (1 << 16) - 1)]
    codes = np.where(letter, codes, 32)
    codes = codes[letter | np.append(True, letter[:-1])]
    if len(codes) < 3:
        return np.empty(0, np.int64)
    return (codes[:-2] * 31 * 31 * 31 + codes[1:-1] * 8191 + codes[2:] * 131) % 2147483647 % BUCKETS


def _equal_share(counts: list[int], sample: int) -> float:
    """Rows of each language so that ``sample`` come together, where some have fewer."""
    left, share = float(sample), 0.0
    for i, n in enumerate(sorted(counts)):
        share = left / (len(counts) - i)
        if n > share:
            break
        left -= n
    return max(share, LEAST_SAMPLE)


def train(labelled: DataFrame, sample: int = TRAINING_DOCS) -> TextModel:
    """A trigram model of each language from ``labelled`` (doc_id, text, lang).

    Languages with fewer than ``LEAST_DOCS`` labelled rows are left out, counted over all of them.
    Uses whole texts of about ``sample`` rows, chosen by a hash of doc_id and text: an equal
    number of each language, all rows of those that have fewer, and at least one. With many
    languages it is LEAST_SAMPLE rows of each. The driver gets a count and at most BUCKETS
    trigram counts for each language, so their number bounds what it holds. Rows without a label are not used.
    """
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "text", F.col("lang").cast("string").alias("lang"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(_HASHES)).alias("_hash"))
    found = (known.groupBy("lang").agg(F.count("*").alias("n"), F.min("_hash").alias("least"))
             .where(F.col("n") >= LEAST_DOCS).collect())
    share = _equal_share([r["n"] for r in found], sample)
    cuts = known.sparkSession.createDataFrame(
        [(r["lang"], _HASHES if r["n"] <= share else max(int(share / r["n"] * _HASHES), r["least"] + 1)) for r in found],
        "lang string, _cut long")
    chosen = known.join(F.broadcast(cuts), "lang").where("_hash < _cut").select("text", "lang")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"]):
                counts = held.setdefault(lang, np.zeros(BUCKETS))
                counts += np.bincount(trigrams(text), minlength=BUCKETS)
        for lang, counts in held.items():
            at = np.flatnonzero(counts)
            yield pd.DataFrame({"lang": lang, "bucket": at.astype(np.int32), "n": counts[at]})

    counted = stage(chosen.mapInPandas(count, "lang string, bucket int, n double")
                    .groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "trigrams")
    rows = counted.collect()
    languages = sorted({r["lang"] for r in rows})
    place = {lang: i for i, lang in enumerate(languages)}
    counts = np.zeros((BUCKETS, len(languages)))
    for r in rows:
        counts[r["bucket"], place[r["lang"]]] += r["n"]
    share = (1 - EVEN) * counts / counts.sum(0) + EVEN / BUCKETS
    return TextModel(languages, np.log(share).astype(np.float32))


def score_texts(rows: DataFrame, model: TextModel, column: str = "text", prepare=None) -> DataFrame:
    """``rows`` with ``evidence``, array<double>: log-likelihoods, and ``grams`` in place of ``column``.

    The log-likelihoods of a text are damped to those of ``INDEPENDENT`` trigrams. ``grams`` is
    the number of trigrams. ``prepare`` turns the column's value into text first.
    """
    others = [c for c in rows.columns if c != column]
    shared = rows.sparkSession.sparkContext.broadcast(model.logs)

    @F.pandas_udf("evidence array<double>, grams long")
    def scored(texts: pd.Series) -> pd.DataFrame:
        logs, out = shared.value, []
        for text in texts:
            found = trigrams(prepare(text) if prepare else text)
            total = logs[found].sum(0, dtype=np.float64) if len(found) else np.zeros(logs.shape[1])
            out.append((total * min(1.0, INDEPENDENT / max(len(found), 1)), len(found)))
        return pd.DataFrame(out, columns=["evidence", "grams"])

    return rows.select(*others, scored(F.col(column).cast("string")).alias("_s")).select(*others, "_s.evidence", "_s.grams")


def _log_softmax_pick(scores: Column) -> Column:
    """struct(best place, its posterior) of an array of log scores; ties go to the first."""
    top = F.array_max(scores)
    total = F.aggregate(scores, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.struct((F.array_position(scores, top) - 1).cast("int").alias("best"), (1 / total).alias("posterior"))


def _counts(rows: DataFrame, key: list[str], languages: int) -> DataFrame:
    """How many rows of each key the text alone gives to each language, as one array."""
    each = [F.sum((F.col("guess") == i).cast("double")).alias(f"_{i}") for i in range(languages)]
    return rows.groupBy(*key).agg(*each).select(*key, F.array(*[f"_{i}" for i in range(languages)]).alias("n"))


def fuse(scored: DataFrame, model: TextModel, marks: list[str], host: str, site: str | None = None,
         certain: float = CERTAIN) -> DataFrame:
    """Add language, posterior and accepted to ``scored`` (evidence, grams, marks, host, site).

    By the text alone every row votes for a language. Grouped counts of the votes give, for each
    column of ``marks`` (a declared language, an address suffix), how likely its value is in each
    language, and for hosts a prior: a host's votes are smoothed towards its site's, the
    site's towards all rows'. A missing mark is no evidence; a missing host or site has its parent's prior.
    Accepted: some trigrams, explained better than by chance, and a posterior of at least ``certain``.
    Without a trained language nothing is accepted and language is null.

    Votes are summed before they are shuffled; rows keep a few numbers each when they are
    joined to them.
    """
    number = len(model.languages)
    if not number:
        return scored.withColumns({"language": F.lit(None).cast("string"), "posterior": F.lit(None).cast("double"),
                                   "accepted": F.lit(False)})
    voted = stage(scored.withColumn("guess", F.when(F.col("grams") > 0, _log_softmax_pick(F.col("evidence"))["best"])), "language-votes")
    overall = [voted.agg(*[F.sum((F.col("guess") == i).cast("double")) for i in range(number)]).head()[i] or 0.0 for i in range(number)]
    everywhere = np.array(overall) + 1.0
    top = F.array(*[F.lit(float(x)) for x in everywhere / everywhere.sum()])

    def smoothed(counts: Column, parent: Column) -> Column:
        seen = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
        return F.zip_with(counts, parent, lambda n, p: (n + PRIOR_DOCS * p) / (seen + PRIOR_DOCS))

    out = voted
    if site:
        sites = _counts(voted.where(F.col(site).isNotNull()), [site], number)
        sites = sites.select(F.col(site).alias("_site"), smoothed(F.col("n"), top).alias("_site_prior"))
        out = out.join(sites, F.col(site) == F.col("_site"), "left").drop("_site")
    else:
        out = out.withColumn("_site_prior", F.lit(None).cast("array<double>"))
    hosts = _counts(voted.where(F.col(host).isNotNull()), [host], number).select(F.col(host).alias("_host"), F.col("n").alias("_host_n"))
    out = out.join(hosts, F.col(host) == F.col("_host"), "left").drop("_host")
    out = out.withColumn("_parent", F.coalesce("_site_prior", top))
    prior = F.when(F.col("_host_n").isNull(), F.col("_parent")).otherwise(smoothed(F.col("_host_n"), F.col("_parent")))
    total = F.zip_with("evidence", prior, lambda e, p: e + F.log(p))
    out = out.withColumn("_score", total)
    for mark in marks:
        counts = _counts(voted.where(F.col(mark).isNotNull()), [mark], number)
        kinds = max(counts.count(), 1)
        share = F.transform(F.col("n"), lambda n, i: F.log(
            (n + MARK_DOCS / kinds) / (F.get(F.array(*[F.lit(float(x)) for x in overall]), i) + MARK_DOCS)))
        likely = counts.select(F.col(mark).alias("_mark"), share.alias("_likely"))
        out = out.join(likely, F.col(mark) == F.col("_mark"), "left").drop("_mark")
        out = out.withColumn("_score", F.when(F.col("_likely").isNull(), F.col("_score")).otherwise(
            F.zip_with("_score", "_likely", lambda a, b: a + b))).drop("_likely")
    names = F.array(*[F.lit(x) for x in model.languages])
    out = out.withColumn("_pick", _log_softmax_pick(F.col("_score")))
    chance = -float(np.log(BUCKETS)) * F.least(F.col("grams"), F.lit(INDEPENDENT))
    fits = (F.col("grams") > 0) & (F.array_max("evidence") > chance) & (F.col("_pick.posterior") >= certain)
    return (out.withColumn("language", F.get(names, F.col("_pick.best"))).withColumn("posterior", F.col("_pick.posterior"))
            .withColumn("accepted", F.coalesce(fits, F.lit(False)))
            .drop("_pick", "_score", "_parent", "_site_prior", "_host_n", "guess", "evidence"))


def identify_pages(pages: DataFrame, labelled: DataFrame, model: TextModel | None = None) -> DataFrame:
    """page_id, url, declared, suffix, host, grams, language, posterior, accepted of every page.

    ``pages`` has page_id, url and html; the text model is trained on ``labelled`` (doc_id, text,
    lang). Evidence: the page's main text, the language its markup declares, the last part of
    its host name and a two- or three-letter first part of its path, and its host and site.
    """
    model = model or train(labelled)
    host = F.lower(F.regexp_extract(F.col("url"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    parts = pages.select(
        "page_id", "url", F.col("html").cast("string").alias("html"),
        _found(F.lower(F.regexp_extract("html", r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})""", 1))).alias("declared"),
        _found(host).alias("host"),
        _found(F.lower(F.regexp_extract("url", r"^[^:]+://[^/]+/([a-zA-Z]{2,3})(?:[/?#]|$)", 1))).alias("path"))
    parts = parts.withColumns({
        "suffix": _found(F.regexp_extract("host", r"\.([a-z]+)$", 1)),
        "site": _found(F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1))})
    scored = score_texts(parts, model, "html", main_text)
    return fuse(scored, model, ["declared", "suffix", "path"], "host", "site").drop("site", "path")


def _found(value: Column) -> Column:
    return F.when(value != "", value)


def identify_documents(docs: DataFrame, model: TextModel | None = None) -> DataFrame:
    """doc_id, key, language, posterior, accepted, grams of every row of ``docs`` (doc_id, text, lang, source).

    The declared language is lang, the host is source; both also train the text model here.
    ``key`` is a hash of the text, which tells rows of one doc_id apart.
    """
    model = model or train(docs)
    parts = docs.select("doc_id", F.xxhash64("text").alias("key"), F.col("text").cast("string").alias("text"),
                        F.col("lang").cast("string").alias("declared"), F.col("source").cast("string").alias("host"))
    return fuse(score_texts(parts, model), model, ["declared"], "host")


def keep_identified(docs: DataFrame, model: TextModel | None = None) -> DataFrame:
    """``docs`` without the rows whose language was not accepted; all columns stay as they are."""
    model = model or train(docs)
    if not model.languages:  # nothing labelled: nothing can be said against any row
        return docs
    refused = (identify_documents(docs, model).where(~F.col("accepted"))
               .select(F.col("doc_id").alias("_d"), F.col("key").alias("_k")).distinct())
    return docs.join(refused, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_k")), "left_anti")

"""Near-duplicate classes by Order MinHash: ordered samples of word k-mers, verified by banded alignment."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BinaryType
from pyspark.sql.window import Window

from txnrisk.session import stage

#: Words of a k-mer, and share of aligned k-mers of two near-duplicates.
WORDS, SIMILAR = 5, 0.8
#: Of longer runs without white space (text that does not separate words) every character counts as a word.
LONGEST = 128
#: A sketch has so many entries, each of two least k-mers; a bucket's key is ROWS entries in a row.
ENTRIES, ROWS, BUCKETS = 96, 2, 24
#: Equal entries below which no pair as similar as SIMILAR is expected: the mean of a pair at
#: SIMILAR, less 4.5 deviations. With few k-mers the mean is lower, so below FEW nothing is ruled out.
LEAST_EQUAL, FEW = 40, 50
#: Rounds in which every row of a bucket meets one other, before rows still apart meet in blocks.
ROUNDS, BLOCK = 3, 512
_SEED = 77


def normal(text: Column) -> Column:
    """Lower case, white space as one space, trimmed; a null text is empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"\s+", " "))


def kmers(text: str) -> np.ndarray:
    """Hashes of the k-mers of a normal text in text order, each labelled with its occurrence.

    A text of fewer words than a k-mer has one k-mer of all of them; an empty text has none.
    """
    words = text.split(" ") if text else []
    if not words:
        return np.empty(0, np.uint64)
    if max(map(len, words)) > LONGEST:
        words = [w for run in words for w in (run if len(run) > LONGEST else (run,))]
    each = pd.util.hash_array(np.array(words, object), categorize=False)
    n = max(1, len(each) - WORDS + 1)
    out = np.zeros(n, np.uint64)
    for j in range(min(WORDS, len(each))):
        out = _mixed(out ^ each[j:j + n])
    order = np.argsort(out, kind="stable")
    ranked = out[order]
    same = np.flatnonzero(ranked[1:] == ranked[:-1]) + 1
    if len(same):
        first = np.zeros(n, np.int64)
        first[1:] = np.where(ranked[1:] == ranked[:-1], 0, np.arange(1, n))
        times = np.arange(n) - np.maximum.accumulate(first)
        out[order] = _mixed(ranked + times.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _keys() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(_SEED)
    return tuple(rng.integers(0, 1 << 63, ENTRIES, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def sketch(x: np.ndarray, at_once: int = 4096) -> np.ndarray:
    """ENTRIES numbers; each says which two k-mers are least under a hash and which comes first."""
    factor, shift = _keys()
    values, places, every = [], [], np.arange(ENTRIES)
    for at in range(0, len(x), at_once):
        v = x[None, at:at + at_once] * factor[:, None] + shift[:, None]
        for _ in range(2):
            p = v.argmin(1)
            values.append(v[every, p])
            places.append(p + at)
            v[every, p] = np.uint64(0xFFFFFFFFFFFFFFFF)
    value, place = np.stack(values, 1), np.stack(places, 1)
    order = np.argsort(value, axis=1, kind="stable")[:, :2]
    place = np.sort(np.take_along_axis(place, order, 1), axis=1)
    pair = x[place]
    # one k-mer alone is taken twice
    return (_mixed(pair[:, 0] * np.uint64(3) + _mixed(pair[:, 1])) >> np.uint64(32)).astype("<u4")


def sketches(texts: DataFrame) -> DataFrame:
    """doc_id (as text), key, raw, size (k-mers), entries (binary) and buckets of (doc_id, key, raw, norm)."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        which = np.arange(BUCKETS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            sizes, entries, buckets = [], [], []
            for text in batch["norm"]:
                x = kmers(text)
                sizes.append(len(x))
                if not len(x):
                    entries.append(b"")
                    buckets.append(np.empty(0, np.int64))
                    continue
                found = sketch(x)
                entries.append(found.tobytes())
                rows = found[:BUCKETS * ROWS].reshape(BUCKETS, ROWS).astype(np.uint64)
                held = which
                for k in range(ROWS):
                    held = _mixed(held ^ _mixed(rows[:, k] + np.uint64(k + 1)))
                buckets.append(held.view(np.int64))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "key": batch["key"], "raw": batch["raw"], "size": sizes, "entries": entries, "buckets": buckets})

    return texts.mapInPandas(work, "doc_id string, key binary, raw long, size long, entries binary, buckets array<long>")


def aligned(a: np.ndarray, b: np.ndarray) -> int:
    """Most k-mers of a and b that can be matched in order, within the band that SIMILAR allows.

    Each labelled k-mer is once in a text, so an alignment is an ascending run of places.
    A pair as similar as SIMILAR leaves so few k-mers unmatched that no match lies further
    off the diagonal than their number.
    """
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    off = (len(a) + len(b)) * (1 - SIMILAR) / (1 + SIMILAR) + 1
    near = np.abs(i - j) <= off
    i, j = i[near], j[near]
    tails: list[int] = []
    for place in j[np.argsort(i)].tolist():
        at = bisect_left(tails, place)
        if at == len(tails):
            tails.append(place)
        else:
            tails[at] = place
    return len(tails)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Aligned k-mers over all k-mers of both, counted once where aligned, reach SIMILAR."""
    if not len(a) or not len(b) or min(len(a), len(b)) < SIMILAR * max(len(a), len(b)):
        return False
    n = aligned(a, b)
    return n >= SIMILAR * (len(a) + len(b) - n) - 1e-9


def _texts(docs: DataFrame, unique: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, norm) of the texts of ``keys``, once each; stored.

    Rows are found by a hash of the text as it stands, so only those found are normalised.
    All of ``docs`` is dealt out for it, so this is done once, for every text that any round needs.
    """
    wanted = unique.select("key", "raw").join(keys, "key", "left_semi")
    found = (docs.select(F.col("text").cast("string").alias("text")).withColumn("raw", F.xxhash64("text")).join(wanted, "raw")
             .select("key", normal(F.col("text")).alias("norm")).where(F.unhex(F.md5("norm")) == F.col("key")))
    return stage(found.groupBy("key").agg(F.min("norm").alias("norm")), "near-texts")


def _likely(pairs: DataFrame, unique: DataFrame) -> DataFrame:
    """The pairs (a, b) of keys that their sketches, a few hundred bytes each, do not rule out."""
    slim = unique.select("key", "entries", "size")
    drawn = (pairs.join(slim.toDF("a", "ea", "na"), "a").join(slim.toDF("b", "eb", "nb"), "b"))

    @F.pandas_udf("boolean")
    def close(left: pd.Series, right: pd.Series) -> pd.Series:
        x = np.frombuffer(b"".join(left), "<u4").reshape(len(left), ENTRIES)
        y = np.frombuffer(b"".join(right), "<u4").reshape(len(right), ENTRIES)
        return pd.Series((x == y).sum(1) >= LEAST_EQUAL)

    return drawn.where((F.least("na", "nb") < FEW) | close("ea", "eb")).select("a", "b")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of keys whose texts are similar when aligned; stored."""
    likely = stage(pairs, "near-pairs")
    both = likely.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")

    @F.pandas_udf("boolean")
    def match(left: pd.Series, right: pd.Series) -> pd.Series:
        held: dict[str, np.ndarray] = {}

        def of(text: str) -> np.ndarray:
            if text not in held:
                if len(held) > 64:
                    held.clear()
                held[text] = kmers(text)
            return held[text]

        return pd.Series([similar(of(x), of(y)) for x, y in zip(left, right)])

    return stage(both.where(match("ta", "tb")).select("a", "b"), "near-links")


def _lifted(links: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``links`` (a, b) of keys as edges between their labels; a key without a label is its own."""
    if labels is not None:
        for end in ("a", "b"):
            links = links.join(labels.toDF(end, "_l"), end, "left").withColumn(end, F.coalesce("_l", end)).drop("_l")
    return links.select("a", "b")


def _contracted(edges: DataFrame, labels: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """One step of contraction: ``edges`` (a, b) between new labels, and ``labels`` (vertex, label) moved to them.

    Every label takes the least one within two edges of it, and its edges go along, so what was
    connected stays so. Labels are hashes: a chain of n is down to one in about log n steps.
    Without edges the same ``labels`` come back.
    """
    edges = stage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-edges")
    if not edges.head(1):
        return edges, labels
    both = edges.union(edges.select("b", "a"))
    one = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("b"), F.least("a", "b").alias("low"))
    # the least label around a neighbour is at most the vertex itself
    two = stage(both.join(one, "b").groupBy(F.col("a").alias("vertex")).agg(F.min("low").alias("low")), "near-steps")
    moved = edges.join(two.toDF("a", "x"), "a").join(two.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    if labels is None:
        return moved, two.toDF("vertex", "label")
    old = labels.join(two.toDF("label", "low"), "label", "left").select("vertex", F.coalesce("low", "label").alias("label"))
    fresh = two.join(labels, "vertex", "left_anti").toDF("vertex", "label")
    return moved, stage(old.union(fresh), "near-labels")


def components(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """vertex, label: the least vertex reachable over ``edges`` (a, b), for every vertex that has an edge to another.

    ``labels`` are those that the edges are between, from contractions before.
    """
    while True:
        edges, after = _contracted(edges, labels)
        if after is labels:
            return edges.toDF("vertex", "label") if labels is None else labels
        labels = after


def _blocked(rows: DataFrame) -> DataFrame:
    """Pairs of keys that share a bucket, are not in one class yet, and share enough k-mers.

    ``rows`` is (bucket, key, label, n, grams). A bucket's rows are cut into blocks; every two blocks of
    one bucket meet in a task of their own. There the shared k-mers are counted in memory,
    and only pairs that have enough of them to be similar come out.
    """
    cut = rows.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn(
        "own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(x, "<u4") for x in group["grams"]]
        sizes = np.array([len(x) for x in sets])
        ends = np.cumsum(sizes)
        grams = np.unique(np.concatenate(sets), return_inverse=True)[1]
        labels = pd.factorize(group["label"])[0]
        keys, own = group["key"].to_numpy(), group["own"].to_numpy()
        apart = group["i"].iloc[0] != group["j"].iloc[0]
        mark = np.zeros(int(grams.max()) + 1, bool)
        out_a, out_b = [], []
        for k in range(len(group) - 1):
            open_ = labels[k + 1:] != labels[k]
            if apart:
                open_ &= own[k + 1:] != own[k]
            if not open_.any():
                continue
            mine = grams[ends[k] - sizes[k]:ends[k]]
            mark[mine] = True
            shared = np.add.reduceat(mark[grams[ends[k]:]], ends[k:-1] - ends[k], dtype=np.int64)
            mark[mine] = False
            least = SIMILAR / (1 + SIMILAR) * (sizes[k] + sizes[k + 1:]) - 1e-6
            for h in np.flatnonzero(open_ & (shared >= least)) + k + 1:
                out_a.append(min(keys[k], keys[h]))
                out_b.append(max(keys[k], keys[h]))
        return pd.DataFrame({"a": out_a, "b": out_b})

    return cut.groupBy("bucket", "i", "j").applyInPandas(compare, "a binary, b binary").distinct()


@F.pandas_udf(BinaryType())
def _grams(texts: pd.Series) -> pd.Series:
    """The k-mers of each normal text as 32-bit numbers, for counting only."""
    return pd.Series([(kmers(x) >> np.uint64(32)).astype("<u4").tobytes() for x in texts])


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(bucket, key) rows with the label of their key; a key without links is its own label."""
    if labels is None:
        return rows.withColumn("label", F.col("key"))
    return rows.join(labels.toDF("key", "_l"), "key", "left").withColumn("label", F.coalesce("_l", "key")).drop("_l")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, text_key of every row of ``docs`` (doc_id, text).

    Rows are in one class if a chain of links joins them. A link: equal texts but for letter
    case and white space, or k-mers of five words of which SIMILAR and more can be aligned in
    order. class_id is the least doc_id of the class. Texts without words are in no class but
    their own. Rows without a doc_id count in classes but give none its id. Repeated rows are in
    one class. Other columns are not read.

    Equal texts count once from here on. Every text is in BUCKETS buckets by its sketch; a pair
    at SIMILAR shares none with a chance of three in a million, two in 100,000 with few k-mers. Inside a bucket every text
    meets one text, which then leaves it, and, as far as classes still differ, another, ROUNDS
    times; that takes rows in proportion to the bucket. What is still apart then meets in blocks,
    where shared k-mers are counted, so no pair of a bucket is left out: up to ROUNDS + 1 texts
    have all met in the rounds. Only buckets that go on holding several classes get that far.
    """
    base = docs.select(F.col("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("raw"),
                       normal(F.col("text")).alias("norm")).withColumn("key", F.unhex(F.md5("norm")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    all_rows = stage(sketches(base.withColumn("doc_id", F.col("doc_id").cast("string"))), "near-sketches")
    members = all_rows.select(F.col("doc_id").cast(kind).alias("doc_id"), "key", "size")
    unique = stage(all_rows.where("size > 0").groupBy("key").agg(
        F.first("raw").alias("raw"), F.first("size").alias("size"), F.first("entries").alias("entries"), F.first("buckets").alias("buckets")), "near-unique")
    placed = unique.select("key", F.explode("buckets").alias("bucket"))
    several = placed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    rows = stage(placed.join(several, "bucket"), "near-rows")
    # a text that shares no bucket is compared with none
    texts = _texts(docs, unique, rows.select("key").distinct())
    edges, labels = None, None
    for _ in range(ROUNDS):
        open_ = _labelled(rows, labels)
        centre = (open_.groupBy("bucket").agg(
            F.min(F.struct(F.xxhash64("key").alias("s"), "key", "label")).alias("c"),
            F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
            .select("bucket", F.col("c.key").alias("centre"), F.col("c.label").alias("centre_label")))
        met = stage(open_.join(stage(centre, "near-centres"), "bucket"), "near-met")
        pairs = (met.where("label <> centre_label")
                 .select(F.least("key", "centre").alias("a"), F.greatest("key", "centre").alias("b")).distinct())
        # the centre has met every text of its bucket, so the next round's centre is another
        rows = met.where("key <> centre").select("bucket", "key", "n")
        found = _verified(_likely(pairs, unique), texts)
        # one step between rounds; labels that differ inside a class only cost some pairs
        lifted = _lifted(found, labels)
        edges, labels = _contracted(lifted if edges is None else edges.union(lifted), labels)
    labels = components(edges, labels)
    open_ = _labelled(rows, labels)
    mixed = open_.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    mixed = stage(mixed.where("low <> high").select("bucket"), "near-mixed")
    if mixed.head(1):
        still = stage(open_.join(mixed, "bucket"), "near-open")
        grams = texts.join(still.select("key").distinct(), "key", "left_semi").select("key", _grams("norm").alias("grams"))
        apart = still.join(stage(grams, "near-grams"), "key")
        labels = components(_lifted(_verified(_blocked(apart), texts), labels), labels)
    classed = members.join(labels.toDF("key", "_l"), "key", "left").withColumn("label", F.coalesce("_l", "key")).drop("_l")
    least = classed.where("size > 0").groupBy("label").agg(F.min("doc_id").alias("class_id"))
    out = classed.join(least, "label", "left")
    return out.select("doc_id", F.when(F.col("size") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
                      F.hex("key").alias("text_key"))


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: that with the least doc_id.

    Of several rows with that doc_id the one with the least text key stays. Texts without words
    all stay, and rows without a doc_id whose class has no id.
    """
    classes = near_duplicates(docs)
    drop = stage(classes.where(F.col("class_id").isNotNull()).where(
        F.col("doc_id").isNull() | (F.col("doc_id") != F.col("class_id"))).select(
        F.col("doc_id").alias("_d"), F.col("text_key").alias("_k")).distinct(), "near-dropped")
    keyed = docs.withColumn("_key", F.upper(F.md5(normal(F.col("text")))))
    kept = keyed.join(drop, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k")), "left_anti")
    wordless = F.col("_key") == F.upper(F.md5(F.lit("")))
    named = kept.withColumn("_nth", F.row_number().over(Window.partitionBy("doc_id", "_key").orderBy(F.lit(1))))
    return named.where((F.col("_nth") == 1) | wordless).select(*docs.columns)

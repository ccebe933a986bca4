"""Document fingerprints by winnowing: the least hash of every window of word k-grams, with its place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from txnrisk.operators.ordering import MAX_RANGES, range_marks, with_range

#: Words of a k-gram, and k-grams of a window (a power of two). Two texts that share
#: GRAM + WINDOW - 1 words in a row share a fingerprint entry there.
GRAM, WINDOW = 5, 8
#: Of longer runs without white space (text that does not separate words, data) every character is a word, so that what
#: two texts share is found wherever it stands in them.
LONGEST = 32
#: Documents that are put in order in one task.
RANGE_ROWS = 1024
_PLACE = (1 << 32) - 1


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``, array<long>: the selected k-grams of column ``text`` in text order.

    An entry is a 31-bit hash of the k-gram, lower-cased, times 2 ** 32, plus 2 ** 32 - 1 less its
    word number. So the least entry of a window is the least hash and, of equal ones, the
    rightmost. The minimum over a window is taken by doubling. Texts with fewer words than a
    k-gram have one k-gram of all words, texts with fewer k-grams than a window one window;
    a null or empty text has no entries.
    """
    words, grams, size = f"{out}_w", f"{out}_g", f"{out}_n"
    lower = F.lower(F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn(words, F.regexp_extract_all(lower, F.lit(rf"(?<!\S)\S{{1,{LONGEST}}}(?!\S)|\S"), F.lit(0)))

    def entry(i: Column) -> Column:
        gram = F.xxhash64(*[F.get(words, i + j) for j in range(GRAM)])  # places past the end are left out
        return F.shiftleft(gram.bitwiseAND(F.lit((1 << 31) - 1)), 32) + (F.lit(_PLACE) - i)

    places = F.sequence(F.lit(0), F.greatest(F.size(words) - GRAM, F.lit(0)))
    df = df.withColumn(grams, F.when(F.size(words) > 0, F.transform(places, entry)).otherwise(
        F.array().cast("array<long>"))).drop(words)
    df = df.withColumn(size, F.size(grams))
    least, reach = grams, 1
    while reach < WINDOW:
        number = F.greatest(F.col(size) - (2 * reach - 1), F.lit(0))
        following = F.zip_with(F.slice(least, F.lit(1), number), F.slice(least, F.lit(1 + reach), number),
                               lambda x, y: F.least(x, y))
        # a text shorter than the window keeps its k-grams; their least is taken below
        step = f"{out}_{reach}"
        df = df.withColumn(step, F.when(F.col(size) >= WINDOW, following).otherwise(F.col(grams)))
        if least != grams:
            df = df.drop(least)
        least, reach = step, 2 * reach
    chosen = F.when(F.col(size) >= WINDOW, F.array_distinct(least)).when(
        F.col(size) > 0, F.array(F.array_min(least))).otherwise(F.array().cast("array<long>"))
    return df.withColumn(out, chosen).drop(grams, size, least)


def hashes(entries: Column) -> Column:
    """The distinct hashes of a fingerprint, without places."""
    return F.array_distinct(F.transform(entries, lambda x: F.shiftright(x, 32).cast("int")))


def written(entries: Column) -> Column:
    """A fingerprint as text: place:hash in hexadecimal, comma-separated, in text order."""
    return F.array_join(F.transform(entries, lambda x: F.concat(
        (F.lit(_PLACE) - x.bitwiseAND(F.lit(_PLACE))).cast("string"), F.lit(":"),
        F.lower(F.hex(F.shiftright(x, 32))))), ",")


def likeness(left: Column, right: Column) -> Column:
    """Shared distinct hashes over all distinct hashes; 1 for two empty fingerprints."""
    every = F.size(F.array_union(left, right))
    return F.when(every == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(left, right)) / every)


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``next``, a struct of ``columns`` of the row that follows in ascending doc_id order.

    Missing ids come first, rows of one doc_id are in order of their text, and the first row
    follows the last. ``docs`` has doc_id and text. Rows are cut into doc_id ranges that are put in order
    side by side. Every range gets a copy of the first row of the next range that has rows; at
    most ``MAX_RANGES`` such ids reach the driver.
    """
    total = docs.count()
    if not total:
        return docs.withColumn("next", F.lit(None).cast(docs.select(F.struct(*columns)).schema[0].dataType))
    _, marks = range_marks(docs, "doc_id", max(1, min(MAX_RANGES, total // RANGE_ROWS)))
    ranged = with_range(docs, "doc_id", marks, "_range")
    light = with_range(docs.select("doc_id"), "doc_id", marks, "_range")
    first = light.groupBy("_range").agg(F.min("doc_id").alias("id"), F.max(F.col("doc_id").isNull()).alias("missing"))
    starts = sorted((r["_range"], None if r["missing"] else r["id"]) for r in first.collect())
    follow = [(starts[i][0], starts[(i + 1) % len(starts)][0], starts[(i + 1) % len(starts)][1]) for i in range(len(starts))]
    kind = docs.schema["doc_id"].dataType.simpleString()
    wanted = docs.sparkSession.createDataFrame(follow, f"_for int, _from int, _id {kind}")
    found = ranged.join(F.broadcast(wanted), (F.col("_range") == F.col("_from")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    found = found.withColumn("_nth", F.row_number().over(Window.partitionBy("_for").orderBy("text")))
    ends = found.where("_nth = 1").withColumn("_range", F.col("_for")).withColumn("_end", F.lit(True))
    rows = ranged.withColumn("_end", F.lit(False))
    order = Window.partitionBy("_range").orderBy("_end", F.col("doc_id").asc_nulls_first(), "text")
    both = rows.unionByName(ends.select(rows.columns))
    return both.withColumn("next", F.lead(F.struct(*columns)).over(order)).where(~F.col("_end")).drop("_range", "_end")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text of ``docs`` (doc_id, text) and of its edited text, with likenesses.

    The edited text is the text with its last quarter (of code points, rounded down) replaced by
    as many from the start of the next document, or all of it if it is shorter. Gives
    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    A null text counts as empty.
    """
    plain = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    paired = with_next(with_fingerprint(plain, "text", "own"), ["text", "own"])
    counted = paired.withColumn("n_chars", F.length("text").cast("long"))
    edited = counted.withColumn("edited", F.expr(
        "concat(substring(text, 1, int(n_chars - n_chars div 4)), substring(next.text, 1, int(n_chars div 4)))"))
    slim = edited.select("doc_id", "n_chars", "own", "edited", F.sha2("edited", 256).alias("edited_sha256"),
                         hashes(F.col("own")).alias("own_h"), hashes(F.col("next.own")).alias("next_h"))
    both = with_fingerprint(slim, "edited", "changed").withColumn("changed_h", hashes(F.col("changed")))
    return both.select(
        "doc_id", "n_chars", "edited_sha256", written(F.col("own")).alias("fingerprint"),
        written(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own_h"), F.col("changed_h")).alias("near_edited"),
        likeness(F.col("own_h"), F.col("next_h")).alias("near_next"))

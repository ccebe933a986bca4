"""Spelling variants: words one edit apart, by pairs of trie nodes, and the most frequent form of each.

The nodes of a trie of all words and of a trie of all reversed words are numbered. A word is then, at every
place, a pair of integers: the node of what stands before and the node of what stands after. With the
letter at the place skipped, the pair is that of every word with another letter there, and that of
the word without any. Words that meet in a pair are one edit apart and no others are, so neighbours are
found by one grouping on two integers, whatever the length of the words.

A pair names one string before and one after the place, so as many words meet in it as there are letters, and
one more. Counts and the best neighbour come from each group as a whole; no pairs of words are made.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from txnrisk.session import stage

LEAST_CHARS = 5
LEAST_COUNT = 3
#: A form has at least so many times the occurrences of its variant.
RATIO = 2
#: One in so many pairs of document and run loses a letter.
EDITED = 97
#: Words of a shard of the dictionary; a shard is numbered in one task.
SHARD_WORDS = 50_000
#: Words, and their characters, that a task counts before it passes them on.
HELD_WORDS = 200_000
HELD_CHARS = 16 << 20
_LETTERS = "[a-zA-ZÀ-ÿ]"
#: Nodes of a shard are numbered from 0, those of its last word by their depth from here on.
_EDGE = 1 << 39
_SHARD = 40


def _runs(text: str, least: int) -> Counter:
    """Maximal runs of at least ``least`` letters; a shorter run never holds a longer match."""
    found = re.compile(f"{_LETTERS}{{{least},}}")
    return Counter(found.findall(text) if len(text) < 1 << 22 else (m.group() for m in found.finditer(text)))


def _count(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    held: dict[str, int] = {}
    chars = 0

    def passed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if raw is None:
                continue
            start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
            for run, n in _runs(raw.lower().decode(errors="replace"), least).items():  # lower() of bytes: A-Z only
                drawn = zlib.crc32(run.encode(), start)
                if drawn % EDITED == 0:
                    at = drawn % len(run)
                    run = run[:at] + run[at + 1:]
                    if len(run) < least:
                        continue
                if run not in held:
                    chars += len(run)
                held[run] = held.get(run, 0) + n
            if len(held) > HELD_WORDS or chars > HELD_CHARS:
                yield passed()
                held, chars = {}, 0
    yield passed()


def counted_words(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the words of ``docs`` (doc_id, text) and their occurrences.

    A run of letters in lower case (A-Z only) is a word, less the letter at h % length where h, the crc32
    of "<doc_id>:<run>", is divisible by 97. A null text has no words; a missing doc_id is
    written as nothing; repeated rows count each. Counted in each task before the shuffle.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    counts = plain.mapInArrow(lambda batches: _count(batches, least_chars), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _common(a: str, b: str) -> int:
    if a.startswith(b) or b.startswith(a):
        return min(len(a), len(b))
    k = 0
    while a[k:k + 256] == b[k:k + 256]:
        k += 256
    while a[k] == b[k]:
        k += 1
    return k


def _owners(edges: list[tuple[int, str, str]]) -> dict[int, list[int]]:
    """For each shard (number, first word, last word), in order, and each prefix of its first word that
    earlier shards have too, by length: the first shard that has it. There, it is a prefix of the last word."""
    out: dict[int, list[int]] = {}
    before: tuple[int, str, str] | None = None
    for now in edges:
        own: list[int] = []
        if before is not None:
            through = min(len(out[before[0]]) - 1, _common(before[1], before[2]))  # shared by all of the shard before
            own = [out[before[0]][j] if j <= through else before[0] for j in range(_common(before[2], now[1]) + 1)]
        out[now[0]] = own
        before = now
    return out


def _number(shard: int, words: list[str], own: list[int]) -> list[list[int]]:
    """The trie nodes of the prefixes of each of these sorted words, from the empty one to the word.

    A node on the shard's edge may be met in other shards. It has the number that its first shard gives it.
    """
    first, last, base = words[0], words[-1], shard << _SHARD
    out, path, before, free = [], [], None, 0
    for word in words:
        kept = _common(before, word) + 1 if before is not None else 0
        del path[kept:]
        shared, edge = min(_common(word, first), len(own) - 1), _common(word, last)
        for j in range(kept, len(word) + 1):
            if j <= shared:
                path.append(own[j] << _SHARD | _EDGE | j)
            elif j <= edge:
                path.append(base | _EDGE | j)
            else:
                path.append(base | free)
                free += 1
        out.append(path[:])
        before = word
    return out


def in_order(words: DataFrame, shards: int) -> DataFrame:
    """``words`` with ``place``: shard (by ranges of ``word``) and rank inside in one number, ascending with the word."""
    return stage(words.repartitionByRange(shards, "word").sortWithinPartitions("word")
                 .withColumn("place", F.monotonically_increasing_id()), "spelling-words")


def trie_nodes(placed: DataFrame) -> DataFrame:
    """(id, nodes): the numbers of the trie nodes of every ``word``'s prefixes, shortest first.

    ``placed`` (id, word, place) comes from ``in_order``. Two words of each shard reach the driver.
    """
    sharded = placed.withColumn("shard", F.shiftright("place", 33))
    edges = sharded.groupBy("shard").agg(F.min("word"), F.max("word")).orderBy("shard").toLocalIterator()
    owners = placed.sparkSession.sparkContext.broadcast(_owners([tuple(r) for r in edges]))

    def number(key: tuple, table: pa.Table) -> pa.Table:
        shard, table = key[0].as_py(), table.sort_by("place")
        nodes = _number(shard, table.column("word").to_pylist(), owners.value[shard])
        return pa.table({"id": table.column("id"), "nodes": pa.array(nodes, pa.list_(pa.int64()))})

    return sharded.groupBy("shard").applyInArrow(number, "id long, nodes array<long>")


def neighbours(words: DataFrame, shards: int | None = None) -> DataFrame:
    """(id, word, n, n_near, best_n, best): each word of ``words`` (word, n; distinct), its number of near words and,
    of these, the occurrences and the id of the one with most. Ids ascend with the words in code-point
    order; of equally frequent near words the smallest is best."""
    held = stage(words.select("word", "n"), "spelling-counts")
    shards = shards or max(1, -(-held.count() // SHARD_WORDS))
    placed = in_order(held, shards).withColumn("id", F.col("place"))
    back = in_order(placed.select("id", F.reverse("word").alias("word")), shards)
    # letters in an array: their place in a string would be looked for from its start each time
    spelled = (placed.select("id", "n", F.split("word", "").alias("letters"), F.length("word").alias("l"))
               .join(trie_nodes(placed.select("id", "word", "place")).withColumnRenamed("nodes", "before"), "id")
               .join(trie_nodes(back).withColumnRenamed("nodes", "after"), "id"))

    def met(i, skip: bool):
        end = F.col("l") - i - (1 if skip else 0)
        # of equal letters in a row, skipping any is the same; the first one stands for them
        first = (i == 0) | (F.element_at("letters", i + 1) != F.element_at("letters", F.greatest(i, F.lit(1)))) if skip else F.lit(True)
        return F.struct(F.element_at("before", i + 1).alias("p"), F.element_at("after", end + 1).alias("q"), F.lit(skip).alias("skip"),
                        first.alias("first"))

    places = F.concat(F.transform(F.sequence(F.lit(0), F.col("l") - 1), lambda i: met(i, True)),
                      F.transform(F.sequence(F.lit(0), F.col("l")), lambda i: met(i, False)))
    entries = spelled.select("id", "n", F.explode(places).alias("e"))
    one = F.struct("n", (-F.col("id")).alias("minus"), "e.skip", "e.first")
    groups = entries.groupBy("e.p", "e.q").agg(F.collect_list(one).alias("met")).where(F.size("met") > 1)
    # of a group, sorted by occurrences: words with a letter at the place, and the word with none if there is one
    falling = groups.select(F.sort_array("met", asc=False).alias("met"))
    parts = falling.select(F.filter("met", lambda x: x["skip"]).alias("some"), F.filter("met", lambda x: x["skip"] & x["first"]).alias("firsts"),
                           F.filter("met", lambda x: ~x["skip"]).alias("whole"))

    def at(array: str, i: int):
        return F.try_element_at(array, F.lit(i))

    def best(x):
        return F.struct(x["n"].alias("n"), x["minus"].alias("minus"))

    def for_some(x):
        other = F.when(at("some", 1)["minus"] == x["minus"], at("some", 2)).otherwise(at("some", 1))
        other = F.when(other.isNotNull(), best(other))
        whole = F.when(x["first"] & (F.size("whole") > 0), best(at("whole", 1)))
        near = F.size("some") - 1 + F.when(whole.isNotNull(), 1).otherwise(0)
        return F.struct((-x["minus"]).alias("id"), near.alias("near"), F.greatest(other, whole).alias("best"))

    def for_whole(x):
        return F.struct((-x["minus"]).alias("id"), F.size("firsts").alias("near"), F.when(F.size("firsts") > 0, best(at("firsts", 1))).alias("best"))

    each = parts.select(F.inline(F.concat(F.transform("some", for_some), F.transform("whole", for_whole)))).where("near > 0")
    total = each.groupBy("id").agg(F.sum("near").alias("n_near"), F.max("best").alias("best"))
    return (placed.select("id", "word", "n").join(total, "id", "left")
            .select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                    F.col("best.n").alias("best_n"), (-F.col("best.minus")).alias("best")))


def _roots(links: DataFrame) -> DataFrame:
    """(id, root) of ``links`` (id, form): where following the forms ends. Each round doubles the steps taken."""
    found = stage(links.select("id", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = found.select(F.col("id").alias("root"), F.col("root").alias("next"))
        moved = stage(found.join(further, "root", "left").select("id", F.coalesce("next", "root").alias("root"),
                                                                 F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if not moved.where("moved").limit(1).count():
            return moved.select("id", "root")
        found = moved.select("id", "root")


def spelling_variants(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """One row per word of ``docs`` (doc_id, text): word, form, root, n, n_near, form_n.

    Near words differ by exactly one inserted, deleted or replaced code point. A word's form is its most
    frequent near word, the smallest of equals, if that is at least ``ratio`` times as frequent; else null. ``root``
    is where following the forms ends, the word itself if it has none. No texts or no letters: no rows. Other
    columns of ``docs`` are not read.
    """
    found = stage(neighbours(counted_words(docs, least_chars, least_count)), "spelling-neighbours")
    form = F.when(F.col("best_n") >= ratio * F.col("n"), F.col("best"))
    linked = found.withColumn("form_id", form)
    roots = _roots(linked.where("form_id is not null").select("id", F.col("form_id").alias("form")))
    named = found.select(F.col("id").alias("form_id"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    named_root = found.select(F.col("id").alias("root_id"), F.col("word").alias("root"))
    out = (linked.join(roots.withColumnRenamed("root", "root_id"), "id", "left")
           .join(named, "form_id", "left").join(named_root, "root_id", "left"))
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

"""Mixing sources to target weights: blocks of words, drawn per output shard and joined by index.

A source's documents are one row of words, cut into blocks of fixed length. Every output shard draws how
many blocks it takes of each source; the draws are multinomial, with the sources' shares, given that
each source's counts add up to its target (so that it is met to a block). A source's slots, numbered
shard after shard, take its blocks by a pseudorandom permutation of the block numbers, another
one for each pass, and meet the blocks' words in a join by source and block number.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from txnrisk.session import stage

#: Words of a block.
BLOCK = 64
#: Most times that a source is repeated.
REPEATS = 3
WEIGHTS = (1, 2, 3)
#: Slots of an output shard, on average.
SHARD_SLOTS = 4096
#: Rows of a source that are put in order in one task, at least ``PARTS`` parts a source.
PART_ROWS, PARTS = 20_000, 64
WORD = r"[^\x20\x09-\x0D]+"
#: Modulus of the scrambling.
PRIME = 2147483647
#: Rounds of the index permutation.
ROUNDS = 12
_HALF = 1 << 20


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def scrambled(number: Column, keys: tuple[int, ...] = (48271, 69621, 16807, 39373)) -> Column:
    """A one-to-one mapping of 0 .. 2 ** 40 - 1: four rounds, each changing one half by the other."""
    left, right = (number / F.lit(_HALF)).cast("long"), F.pmod(number, F.lit(_HALF))
    for key in keys:
        once = (right * F.lit(key) + F.lit(key + 11)) % F.lit(PRIME)
        turned = (once * once) % F.lit(PRIME) % F.lit(_HALF)
        left, right = right, F.pmod(left + turned, F.lit(_HALF))
    return left * F.lit(_HALF) + right


def permuted(number: Column, size: Column, *keys: Column) -> Column:
    """A pseudorandom one-to-one mapping of 0 .. ``size`` - 1, for any size, another one for other ``keys``.

    In each round a number and its mirror image around a drawn point change places or not, by one
    bit of a hash that both agree on (the swap-or-not shuffle).
    """
    def turn(x: Column, i: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(i, *keys), size) - x, size)
        swap = F.pmod(F.xxhash64(i, F.greatest(x, mirror), *keys), F.lit(2)) == 1
        return F.when(swap, mirror).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1).cast("long"), F.lit(ROUNDS).cast("long")), number.cast("long"), turn)


def source_targets(sizes: DataFrame, block: int = BLOCK, repeats: int = REPEATS,
                   weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Target words of each source from (source, size), one row per source.

    Sources in code point order, missing last, weigh ``weights`` in turn and share all words.
    With sources in order of size over weight, one is held at ``repeats`` times its size if its
    share of what the ones before it leave is larger; all after it then share the rest. Adds
    blocks, slots (blocks to take, repeats counted) and the number of slots before it. The
    windows run over one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]),
                          ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    ranked = (sizes.withColumn("rank", F.row_number().over(order).cast("long"))
              .withColumn("weight", weight.cast("long")))
    ratio = Window.orderBy((F.col("size") * repeats / F.col("weight")), "rank")
    every = Window.partitionBy()
    capped = ((F.col("size") * repeats).cast("double") * F.col("later")
              <= F.col("weight").cast("double") * (F.col("all") - F.col("earlier")))
    held = (ranked.withColumns({
        "all": F.sum("size").over(every),
        "earlier": F.coalesce(F.sum(F.col("size") * repeats).over(
            ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "later": F.sum("weight").over(ratio.rowsBetween(0, Window.unboundedFollowing))})
        .withColumn("held", capped))
    shared = held.withColumns({
        "rest": F.col("all") - F.sum(F.when(F.col("held"), F.col("size") * repeats).otherwise(0)).over(every),
        "sharing": F.sum(F.when(F.col("held"), 0).otherwise(F.col("weight"))).over(every)})
    target = F.when(F.col("held"), (F.col("size") * repeats).cast("double")).otherwise(
        (F.col("weight") * F.col("rest")).cast("double") / F.col("sharing"))
    blocks = F.ceil(F.col("size") / F.lit(block)).cast("long")
    slots = F.when(F.col("size") > 0, F.least(
        F.col("blocks") * repeats, F.floor(F.col("target") * F.col("blocks") / F.col("size") + 0.5).cast("long")))
    return (shared.withColumn("target", target).withColumn("blocks", blocks)
            .withColumn("slots", F.coalesce(slots, F.lit(0)))
            .withColumn("before", F.sum("slots").over(Window.orderBy("rank")) - F.col("slots"))
            .select("source", "rank", "weight", "size", "target", "blocks", "slots", "before"))


def _each(rows: DataFrame, count: str, name: str) -> DataFrame:
    """A row per number below ``count``, in ``name``, spread out by runs of 65,536."""
    step = 1 << 16
    runs = (rows.where(f"{count} > 0").withColumn("run", F.explode(F.expr(f"sequence(0L, ({count} - 1) div {step})")))
            .repartition("rank", "run"))
    return runs.withColumn(name, F.explode(F.expr(
        f"sequence(run * {step}, least(run * {step} + {step}, {count}) - 1)"))).drop("run")


def draw_counts(sources: DataFrame, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """shard, rank, drawn (blocks the shard takes of the source, not 0) and first (the source's blocks in shards before).

    Every slot of every source falls to a shard pseudorandomly. So a shard's counts are a multinomial
    draw with the sources' shares, given the totals.
    """
    total = sources.agg(F.sum("slots")).head()[0] or 0
    shards = max(1, -(-total // shard_slots))
    dealt = _each(sources.select("rank", "slots", "before"), "slots", "n")
    counts = (dealt.groupBy(F.pmod(scrambled(F.col("before") + F.col("n")), F.lit(shards)).alias("shard"), "rank")
              .agg(F.count("*").alias("drawn")))
    # shards are added up in groups of a thousand, then inside a group: no window runs over all shards of a source
    grouped = counts.withColumn("group", F.expr("shard div 1000"))
    sums = grouped.groupBy("rank", "group").agg(F.sum("drawn").alias("in_group"))
    groups = sums.withColumn("to_group", F.sum("in_group").over(Window.partitionBy("rank").orderBy("group")) - F.col("in_group"))
    inside = F.sum("drawn").over(Window.partitionBy("rank", "group").orderBy("shard")) - F.col("drawn")
    return (grouped.withColumn("inside", inside).join(groups.select("rank", "group", "to_group"), ["rank", "group"])
            .select("shard", "rank", "drawn", (F.col("to_group") + F.col("inside")).alias("first")))


def draw_slots(sources: DataFrame, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """shard, rank, slot, pass, block of every slot of the mix.

    A source's slots are numbered through the shards by the drawn counts. They take its blocks in the order
    of a pseudorandom permutation of the block numbers that changes with every pass; no block is taken twice in a pass.
    """
    drawn = stage(draw_counts(sources, shard_slots), "mix-counts")
    numbered = _each(drawn.join(sources.select("rank", "blocks"), "rank"), "drawn", "n")
    taken = numbered.withColumn("slot", F.col("first") + F.col("n")).withColumn("pass", F.expr("slot div blocks"))
    block = permuted(F.expr("slot % blocks"), F.col("blocks"), F.col("rank"), F.col("pass"))
    return taken.select("shard", "rank", "slot", "pass", block.alias("block"))


def _laid(docs: DataFrame, block: int, repeats: int, weights: tuple[int, ...]) -> tuple[DataFrame, DataFrame]:
    """Every row of ``docs`` with the place of its words in its source, and the sources."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = stage(docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), words(text).alias("size"),
                              F.xxhash64(F.col("doc_id").cast("long"), text).alias("name")), "mix-sizes")
    by_source = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
    sources = stage(source_targets(by_source.select("source", "size"), block, repeats, weights), "mix-sources")
    parts = max(PARTS, math.ceil(sized.count() / PART_ROWS))
    # a null-safe comparison with the sources, which are few
    of_source = sources.select(F.col("source").alias("_s"), "rank", F.col("size").alias("source_size"), "target")
    known = (sized.join(of_source, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
             .withColumn("_part", F.pmod("name", F.lit(parts))))
    # a document's words stay together, so ties are in order only between like rows
    row = Window.partitionBy("rank", "_part").orderBy("name", "doc_id", "size")
    running = F.sum("size").over(row.rowsBetween(Window.unboundedPreceding, 0))
    per_part = (known.groupBy("rank", "_part").agg(F.sum("size").alias("_n"))
                .withColumn("_before", F.sum("_n").over(Window.partitionBy("rank").orderBy("_part")) - F.col("_n"))
                .select("rank", "_part", "_before"))
    laid = (known.withColumn("_end", running).join(per_part, ["rank", "_part"])
            .withColumn("_end", F.col("_end") + F.col("_before"))
            .withColumn("_start", F.col("_end") - F.col("size")).drop("_part", "_before", "name"))
    return stage(laid, "mix-laid"), sources


def _mixed(laid: DataFrame, sources: DataFrame, block: int, shard_slots: int) -> DataFrame:
    """The slots of all shards with what documents fill them: a row per slot and document in its block."""
    inside = laid.where("size > 0").withColumn(
        "block", F.explode(F.expr(f"sequence(_start div {block}, (_end - 1) div {block})")))
    since = F.greatest("_start", F.col("block") * block)
    filled = inside.withColumns({"first_word": since - F.col("_start"), "words": F.least("_end", (F.col("block") + 1) * block) - since})
    # the few sources that slots are made from would have them taken for small and broadcast
    return draw_slots(sources, shard_slots).hint("merge").join(filled, ["rank", "block"])


def mix_blocks(docs: DataFrame, block: int = BLOCK, repeats: int = REPEATS, weights: tuple[int, ...] = WEIGHTS,
               shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The mix itself, a row per slot and document in its block: shard, source, slot, block, doc_id, first_word, words.

    A slot's words are those of the documents of its block, in turn, from their word number ``first_word`` (from 0) on.
    Inside a shard, slots may be read in any order. See ``take_documents`` for nulls and ties.
    """
    laid, sources = _laid(docs, block, repeats, weights)
    return _mixed(laid, sources, block, shard_slots).select("shard", "source", "slot", "block", "doc_id", "first_word", "words")


def take_documents(docs: DataFrame, block: int = BLOCK, repeats: int = REPEATS,
                   weights: tuple[int, ...] = WEIGHTS, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of ``docs`` (doc_id, text, source).

    The documents of a source, in a pseudorandom order, are one long row of words, cut into
    blocks of ``block`` words; ``taken`` sums the words of a document in the slots of all shards.
    A source that takes whole passes takes every word of it as often; no word is taken more
    than ``repeats`` times. Null and empty texts have no words and nothing of them is taken.
    Rows may repeat; ids and sources may be missing. The result depends on the rows alone.

    A source is put in order in parts by a hash of doc_id and text and the parts are added up, so a source
    with a third of all rows is no single task; only equal rows share a part.
    """
    laid, sources = _laid(docs, block, repeats, weights)
    keys = ["rank", "_start", "doc_id", "source", "size", "source_size", "target"]
    taken = _mixed(laid, sources, block, shard_slots).groupBy(*keys).agg(F.sum("words").alias("taken"))
    columns = ["doc_id", "source", "size", "source_size", "target", "taken"]
    # documents of which the mix takes nothing, or which have nothing
    rest = (laid.join(taken.select("rank", "_start", "size").withColumn("_met", F.lit(True)), ["rank", "_start", "size"], "left")
            .where("_met IS NULL").withColumn("taken", F.lit(0).cast("long")))
    return taken.select(*columns).unionByName(rest.select(*columns))


def mix_rows(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``docs`` with every row as often as the mix takes its words, rounded up or down.

    The fraction decides by a hash of doc_id, so that a source's words stay near its target and
    reruns agree. Rows without words stay once: the mix says nothing about them. Rows that
    agree in doc_id, source and size share their counts.
    """
    size = words(F.col("text").cast("string"))
    chance = F.pmod(scrambled(F.pmod(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.lit(1 << 40))),
                    F.lit(1 << 20)) / F.lit(1 << 20)
    times = (take_documents(docs, block).where("size > 0")
             .groupBy("doc_id", "source", "size").agg((F.sum("taken") / F.count("*")).alias("_mean"))
             .select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_n"),
                     F.floor(F.col("_mean") / F.col("size") + chance).cast("int").alias("_times")))
    sized = docs.withColumn("_size", size)
    joined = sized.join(times, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_s"))
                        & (F.col("_size") == F.col("_n")), "left")
    often = F.explode(F.sequence(F.lit(1), F.coalesce("_times", F.lit(1))))
    kept = joined.where((F.col("_size") == 0) | (F.col("_times") > 0))
    return kept.withColumn("_copy", often).select(*docs.columns)

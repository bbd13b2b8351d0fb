"""Benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.common import settle, table, text_or_empty

#: Word positions that count in a seed; the others between are ignored. In any 13 words of which
#: at most 3 differ, at least one of these masks fits at some offset (tests go through all cases).
MASKS = ((0, 1, 5, 6, 8), (0, 4, 6, 7, 8), (0, 1, 3, 6, 8), (0, 2, 3, 7, 8))
SPAN, WINDOW, MOST_CHANGED = 9, 13, 3
#: Items of fewer words say too little and are not looked for.
LEAST_WORDS = 5
#: Benchmark seeds in one broadcast, about 250 bytes each; a larger benchmark is taken in blocks.
BLOCK_SEEDS = 300_000
#: Hashes of contaminated texts that may be broadcast: some 100 bytes each.
BROADCAST_TEXTS = 400_000
_AROUND = range(SPAN - WINDOW, WINDOW)  # offsets of windows that hold a seed's span


def hashed_words(text: Column) -> Column:
    """Hashes of the lower-cased words (runs of letters and digits) of a text."""
    words = F.array_remove(F.split(F.lower(text_or_empty(text)), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _with_seeds(at: DataFrame, masks: list[tuple[int, ...]], words: str, position: str, keep: list[str]) -> DataFrame:
    """A row (``seed`` and the kept columns) for each position and mask.

    A seed is the exclusive or of the mask's word hashes, each shifted by its
    rank: cheap, and enough, as every hit is compared word by word. Words beyond
    the end count as 0. No seed is null, else the join would add a filter that
    computes it twice; and each word is fetched once for all masks, so that the
    generated loop is short enough to be compiled.
    """
    offsets = sorted({i for m in masks for i in m})
    fetched = at.select(*keep, *[F.coalesce(F.get(words, F.col(position) + F.lit(i)), F.lit(0)).alias(f"__{i}") for i in offsets])
    mixed = [reduce(Column.bitwiseXOR, [F.shiftleft(f"__{i}", 5 * rank) for rank, i in enumerate(m)], F.lit(sum(1 << i for i in m)).cast("long")) for m in masks]
    return fetched.select(*keep, F.explode(F.array(*mixed)).alias("seed"))


def benchmark_seeds(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(seed, mask length, item, position, words, the words around) of each item.

    Items of at least SPAN words have a seed for each mask and position, shorter
    ones one seed of all their words.
    """
    hashed = items.select(F.col(id_col).alias("item_id"), hashed_words(F.col(text_col)).alias("b")).withColumn("n_item", F.size("b"))
    around = F.array(*[F.get("b", F.col("j") + F.lit(o)) for o in _AROUND])
    parts = []
    for least, most, masks in [(SPAN, None, list(MASKS))] + [(n, n, [tuple(range(n))]) for n in range(LEAST_WORDS, SPAN)]:
        size = F.col("n_item") >= least if most is None else F.col("n_item") == most
        last = F.col("n_item") - (SPAN if most is None else most)
        at = hashed.where(size).withColumn("j", F.explode(F.sequence(F.lit(0), last)))
        parts.append(_with_seeds(at, masks, "b", "j", ["item_id", "j", "n_item", "b"]).withColumn("around", around).drop("b"))
    return reduce(DataFrame.union, parts)


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_seeds: int = BLOCK_SEEDS,
) -> DataFrame:
    """Which rows hold a passage of which benchmark item, words changed or not.

    A row holds one if 13 words in a line of the item stand in it with at most 3
    of them changed; of an item of 5 to 12 words, if all stand in a line.
    Shorter items are not looked for. Each position of a text is hashed under
    each mask and looked up among the benchmark's seeds, which are broadcast in
    blocks of a fixed size; at each hit the windows that hold the seed are compared
    word by word. Texts are never shuffled, only one row per row and item is.

    Returns (id, ``item_id``, ``first_word``, ``last_word``, ``matched``): word
    positions of the outermost matching windows, and the most equal words of a
    window; only rows that hold a passage. Null and empty texts hold none; rows
    that repeat an id are reported together; null ids form one row. An empty
    table or benchmark gives an empty result. Other columns are not read.
    """
    seeds = settle(benchmark_seeds(items, item_id, item_text), "benchmark-seeds")
    facts = seeds.groupBy(F.least(F.col("n_item"), F.lit(SPAN)).alias("size")).count().collect()  # at most five rows
    sizes = {r["size"] for r in facts}
    blocks = max(1, -(-sum(r["count"] for r in facts) // block_seeds))
    masks = [m for m in MASKS if SPAN in sizes] + [tuple(range(n)) for n in range(LEAST_WORDS, SPAN) if n in sizes] or [tuple(range(SPAN))]
    shortest = min(m[-1] for m in masks) + 1

    words = docs.select(F.col(id_col).alias("__id"), hashed_words(F.col(text_col)).alias("h"))
    # Not a filter on the size: that would be pushed down and hash every word twice.
    last = F.size("h") - shortest
    at = words.select("__id", "h", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last))).alias("i"))
    probes = _with_seeds(at, masks, "h", "i", ["__id", "h", "i"])

    # What follows the join runs for hits alone, on higher-order functions: they keep it out of the
    # generated code of the probes, which would else be too long to be compiled.
    before, after = WINDOW - SPAN, WINDOW - 1
    start = F.greatest(F.col("i") - before, F.lit(0))
    beside = F.slice("h", start + 1, F.col("i") + after + 1 - start)
    aligned = F.slice("around", start - F.col("i") + before + 1, F.size("beside"))
    same = F.zip_with("beside", aligned, lambda x, y: F.coalesce(x == y, F.lit(False)).cast("int"))

    def window(o: Column, size: Column | int) -> Column:
        return F.struct(o.alias("o"), F.aggregate(F.slice("same", o + 1, size), F.lit(0), lambda x, y: x + y).alias("m"))

    long = F.col("n_item") >= WINDOW
    offsets = F.sequence(F.lit(0), F.greatest(F.size("same") - WINDOW, F.lit(0)))
    good = F.when(long, F.filter(F.transform(offsets, lambda o: window(o, WINDOW)), lambda w: w["m"] >= WINDOW - MOST_CHANGED)).otherwise(
        F.filter(F.array(window(F.lit(0), F.size("same"))), lambda w: w["m"] == F.col("n_item"))
    )
    first = F.when(long, F.col("start") + F.col("w.o")).otherwise(F.col("i") - F.col("j"))
    size = F.when(long, F.least(F.lit(WINDOW), F.col("n_words") - F.col("start") - F.col("w.o"))).otherwise(F.col("n_item"))

    def block(n: int) -> DataFrame:
        part = seeds if blocks == 1 else seeds.where(F.pmod(F.xxhash64("seed"), F.lit(blocks)) == n)
        hits = probes.join(F.broadcast(part), "seed")
        hits = hits.select("__id", "item_id", "i", "j", "n_item", "around", start.alias("start"), F.size("h").alias("n_words"), beside.alias("beside"))
        # Exploding the windows that fit, where a filter on them would be pushed below and repeat their sums.
        fits = hits.withColumn("same", same).withColumn("w", F.explode(good))
        return fits.select("__id", "item_id", first.alias("a"), (first + size - 1).alias("z"), F.col("w.m").alias("m"))

    found = reduce(DataFrame.union, [block(n) for n in range(blocks)])
    return found.groupBy("__id", "item_id").agg(F.min("a").cast("long").alias("first_word"), F.max("z").cast("long").alias("last_word"), F.max("m").alias("matched")).withColumnRenamed("__id", id_col)


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose text holds no passage of the benchmark, with all their columns.

    Rows are told by a 128-bit hash of their text, as the text alone decides:
    null and repeated ids do no harm. Null and empty texts stay; an empty
    benchmark takes nothing. Up to BROADCAST_TEXTS hashes are broadcast.
    """
    named = docs.withColumn("__text", F.md5(text_or_empty(text_col)))
    held = settle(contamination(named, items, "__text", text_col, **options).select("__text").distinct(), "contaminated")
    return named.join(F.broadcast(held) if held.count() <= BROADCAST_TEXTS else held, "__text", "left_anti").select(*docs.columns)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

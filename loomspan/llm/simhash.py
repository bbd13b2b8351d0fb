"""SimHash near-deduplication by deletion-variant signatures."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.llm.common import discard, settle, table
from loomspan.operators.components import connected_components

#: Keys of shared signatures that may be broadcast: 16 bytes each.
BROADCAST_KEYS = 400_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Ids that may be broadcast: 8 bytes each.
BROADCAST_IDS = 400_000
#: Keys of a text, and minima in each.
BANDS, BAND_ROWS = 16, 4
#: Texts of a key shared by more than this meet the key's LEADERS first.
FREQUENT, LEADERS = 5, 8
#: Shingles in an Arrow batch, beyond those of its last text.
BATCH_SHINGLES = 1 << 17
_TURNS, _FACTORS = np.random.default_rng(5).integers(0, 1 << 63, (2, BANDS * BAND_ROWS), dtype=np.uint64)
_FACTORS = _FACTORS << np.uint64(1) | np.uint64(1)
#: Signatures shared by more fingerprints than this are joined on eight more bits.
CROWDED = 200
#: Fingerprints in a task that makes their signatures; these mostly differ, so the task's hash table holds 64 rows for each.
TASK_PRINTS = 1 << 14


def fingerprint(text: str | None, width: int = 3) -> int:
    """The signed 64-bit value whose unsigned bits are the text's SimHash.

    Words are runs without white space of the text with A-Z lower-cased,
    shingles are ``width`` words with single spaces between (a shorter text is
    one shingle), each hashed with XXH64 (seed 42) and counted as often as it
    occurs. A bit is 1 if set in more than half of the hashes; no words: 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(lengths + 1) - 1
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], 42) for a, b in zip((ends - lengths)[: 1 - width].tolist(), ends[width - 1 :].tolist(), strict=True)]
    votes = np.zeros(64, dtype=np.int64)
    array = np.array(hashes, dtype="<u8")
    for at in range(0, len(array), 1 << 14):  # 64 bytes a shingle, so that long texts need little memory
        bits = np.unpackbits(array[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(array), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int = 3) -> DataFrame:
    """(id, ``fp`` long), one row for each row."""

    @F.arrow_udf("long")
    def prints(texts: pa.Array) -> pa.Array:
        return pa.array((fingerprint(t.as_py(), width) for t in texts), pa.int64())

    return docs.select(id_col, prints(F.col(text_col)).alias("fp"))


def _halves(fp: Column) -> tuple[Column, Column]:
    low = F.lit(0xFFFFFFFF)
    return F.shiftrightunsigned(fp, 32), fp.bitwiseAND(low)


def _variants(nodes: DataFrame) -> DataFrame:
    """Each fingerprint's 64 signatures: either half with one bit taken out.

    ``key`` holds the half's number and the bit's in its bits 37 to 32, and the
    rest of the half below.
    """
    high, low = _halves(F.col("fp"))
    half = F.when(F.col("wild") < 32, high).otherwise(low)
    gone = F.expr("shiftleft(1L, wild % 32)")
    return (
        nodes.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("wild"))
        .select("fp", F.shiftleft(F.col("wild").cast("long"), 32).bitwiseOR(half.bitwiseAND(F.bitwise_not(gone))).alias("key"))
    )


def _linked(key: Column, x: Column, y: Column, distance: int) -> Column:
    """True at just one of the keys that two linked fingerprints share."""
    differ = x.bitwiseXOR(y)
    high, low = _halves(differ)
    wild = F.shiftright(key, 32)
    bit = F.expr("shiftleft(1L, cast(shiftright({k}, 32) % 32 as int))".format(k="key"))

    def at(half: Column, first: int) -> Column:
        return F.when(half == 0, wild == first).otherwise(half == bit)

    in_high = F.bit_count(high) <= 1
    return (F.bit_count(differ) <= distance) & F.when(in_high, (wild < 32) & at(high, 0)).otherwise((wild >= 32) & at(low, 32))


def links(nodes: DataFrame, distance: int = 3, crowded: int = CROWDED, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """All pairs (``a`` < ``b``) of distinct fingerprints that differ in at most three bits.

    Of two halves of such a pair one differs in at most one bit, so with that
    bit taken out the pair shares a signature. Signatures are grouped first:
    those of one fingerprint go, those of two give their pair at once, and only
    for those of more the fingerprints are joined. A signature that more than
    ``crowded`` fingerprints share is joined on a byte of the other half as well:
    of its four bytes one is equal, as at most three bits differ. Each pair is
    emitted once, at the first signature that it shares.
    """
    if not 0 <= distance <= 3:
        raise ValueError("two halves with one wildcard find up to three differing bits")
    # Fingerprints are small, so that files of them make few tasks.
    variants = _variants(nodes.repartition(-(-nodes.count() // TASK_PRINTS) or 1, "fp"))
    shared = variants.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    shared = settle(shared, "simhash-signatures")
    pairs = shared.where("n = 2").where(_linked(F.col("key"), F.col("a"), F.col("b"), distance)).select("a", "b")
    many = shared.where("n > 2").select("key", "n")
    how_many = many.count()
    if not how_many:
        return pairs
    members = variants.join(F.broadcast(many) if how_many <= broadcast_keys else many, "key")
    members = settle(members, "simhash-members")
    verified = (F.col("a") < F.col("b")) & _linked(F.col("key"), F.col("a"), F.col("b"), distance)

    few = members.where(F.col("n") <= crowded)
    near = few.select("key", F.col("fp").alias("a")).join(few.select(F.col("key").alias("key_b"), F.col("fp").alias("b")), (F.col("key") == F.col("key_b")) & verified)
    pairs = pairs.union(near.select("a", "b"))

    high, low = _halves(F.col("fp"))
    other = F.when(F.shiftright("key", 32) < 32, low).otherwise(high)
    byte = F.expr("cast(shiftrightunsigned(other, 8 * part) & 255 as int)")
    dense = (
        members.where(F.col("n") > crowded)
        .withColumn("other", other)
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(3))))
        .select("key", "part", byte.alias("byte"), "fp", "other")
    )
    left = dense.select("key", "part", "byte", F.col("fp").alias("a"), F.col("other").alias("other_a"))
    right = dense.select(F.col("key").alias("key_b"), F.col("part").alias("part_b"), F.col("byte").alias("byte_b"), F.col("fp").alias("b"), F.col("other").alias("other_b"))
    differ = F.col("other_a").bitwiseXOR(F.col("other_b"))
    first_equal = F.coalesce(*[F.when(F.shiftrightunsigned(differ, 8 * i).bitwiseAND(F.lit(255)) == 0, F.lit(i)) for i in range(4)])
    on = (F.col("key") == F.col("key_b")) & (F.col("part") == F.col("part_b")) & (F.col("byte") == F.col("byte_b"))
    dense_pairs = left.join(right, on & (F.col("part") == first_equal) & verified)
    return pairs.union(dense_pairs.select("a", "b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 3, width: int = 3) -> DataFrame:
    """Links texts whose fingerprints differ in at most ``distance`` bits and labels components.

    Fingerprints are reduced to distinct ones before any join, so copies of a
    text, be they a third of the table, are one node. Returns one row per input
    row: the id, ``fp`` (long) and ``component_id``, the smallest id that can be
    reached over links, its own included. Null and blank texts have
    fingerprint 0 and link like any other. Null ids are never the smallest of a
    component with another id. Repeated rows give repeated rows. Other input
    columns are not read. An empty table gives an empty result.
    """
    prints = settle(fingerprints(docs, id_col, text_col, width), "simhash-prints")
    nodes = settle(prints.groupBy("fp").agg(F.min(id_col).alias("first")), "simhash-nodes")
    roots = connected_components(links(nodes.select("fp"), distance), "a", "b")
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = named.join(least, "root").select("fp", "component_id")
    return prints.join(labels, "fp", "left").select(id_col, "fp", "component_id")


def linked_rows(docs: DataFrame, id_col: str, text_col: str = "text", distance: int = 3, width: int = 3) -> DataFrame:
    """The operator's links as pairs (``a``, ``b``) of ids: each row and the first row of its fingerprint, if
    another, and the first rows of each two fingerprints that differ in at most ``distance`` bits. Ids aren't null."""
    prints = settle(fingerprints(docs, id_col, text_col, width), "simhash-prints")
    nodes = settle(prints.groupBy("fp").agg(F.min(id_col).alias("first"), F.max(id_col).alias("last")), "simhash-nodes")
    near = links(nodes.select("fp"), distance)
    left, right = nodes.select(F.col("fp").alias("a"), F.col("first").alias("x")), nodes.select(F.col("fp").alias("b"), F.col("first").alias("y"))
    across = near.join(left, "a").join(right, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    several = nodes.where("first <> last").select("fp", "first")
    return across.union(prints.join(several, "fp").where(F.col(id_col) != F.col("first")).select(F.col("first").alias("a"), F.col(id_col).alias("b")))


def _word_hashes(text: str | None) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending; a shorter text is one shingle, an empty one has none."""
    words = _word_hashes(text)
    if not len(words):
        return words
    size = min(width, len(words))
    h = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        h = (h ^ words[k : k + len(h)]) * _MIX
        h ^= h >> np.uint64(29)
    return np.unique(h)


def minima(found: np.ndarray, count: int) -> np.ndarray:
    """The least of a set of hashes under each of ``count`` permutations."""
    out = np.full(count, np.iinfo(np.uint64).max)
    for at in range(0, len(found), 1 << 12):  # so that long texts need little memory
        mixed = (found[None, at : at + (1 << 12)] ^ _TURNS[:count, None]) * _FACTORS[:count, None]
        np.minimum(out, (mixed ^ (mixed >> np.uint64(32))).min(axis=1), out=out)
    return out


def band_keys(found: np.ndarray) -> np.ndarray:
    """A key for each band: sets of Jaccard similarity s share it with probability s ** BAND_ROWS."""
    rows = minima(found, BANDS * BAND_ROWS).reshape(BANDS, BAND_ROWS)
    keys = np.arange(BANDS, dtype=np.uint64)
    for k in range(BAND_ROWS):
        keys = (keys ^ rows[:, k]) * _MIX
        keys ^= keys >> np.uint64(29)
    return keys


def similar_texts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: DataFrame | None = None, similarity: float = 0.8, width: int = 5, frequent: int = FREQUENT
) -> DataFrame:
    """Groups of ids: (``node``, ``root``) of those whose sets of shingles are connected by a Jaccard similarity of
    at least ``similarity``, and by the pairs (``a``, ``b``) of ``known``; ids without any link have no row.

    For texts beyond the reach of three bits: a few changed words in a text of
    usual length change ten bits of its fingerprint. Candidates share one of
    BANDS keys of BAND_ROWS minima each, whatever their lengths: of pairs with
    similarity 0.8 all but 0.02 % do, of more similar ones all but fewer. Every
    candidate is verified on the whole shingle sets. A key of up to ``frequent``
    texts pairs these all; of more, each meets the key's leaders, which are the
    same for all keys of a group of copies. Texts of keys that this leaves in
    several groups then meet those of other groups that share one of their
    rarest shingles, as any two of that similarity do (``_across_groups``). So
    only pairs go uncompared that are connected already or can't be similar.

    Null ids are left out, null and empty texts are similar to none. Repeated
    ids are one. An empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")

    def banded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [shingles(t, width) for t in part.column(1).to_pylist()]
                rows = np.flatnonzero([len(f) > 0 for f in found])
                keys = np.concatenate([band_keys(found[r]) for r in rows] or [np.zeros(0, np.uint64)])
                sizes = np.array([len(f) for f in found], np.int32)
                rows = np.repeat(rows, BANDS)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), pa.array(sizes[rows]), pa.array(keys.view(np.int64))], ["id", "size", "key"])

    keys = settle(texts.mapInArrow(banded, f"id {kind}, size int, key bigint"), "band-keys")
    shared = settle(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "band-shared")
    few_keys = shared.count() <= BROADCAST_KEYS
    members = settle(keys.join(F.broadcast(shared) if few_keys else shared, "key"), "band-members")
    discard(keys)

    a, b = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    alike = F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * F.lit(similarity)
    few, many = members.where(F.col("n") <= frequent), members.where(F.col("n") > frequent)

    def side(rows: DataFrame, x: str) -> DataFrame:
        return rows.select("key", F.col("id").alias(x), F.col("size").alias(f"size_{x}"))

    pairs = side(few, "a").join(side(few, "b"), "key").where((F.col("a") < F.col("b")) & alike).select("a", "b")
    # By hashes of the ids, so that a group of copies has the same leaders in all its keys.
    led = [F.min(F.struct(F.xxhash64("id", F.lit(k)).alias("h"), "id", "size")) for k in range(LEADERS)]
    leaders = settle(many.groupBy("key").agg(F.array(*led).alias("led")).select("key", F.explode("led").alias("l")).select("key", F.col("l.id").alias("b"), F.col("l.size").alias("size_b")).distinct(), "band-leaders")
    star = side(many, "a").join(leaders, "key").where((F.col("a") != F.col("b")) & alike).select(a, b)
    first = settle(pairs.unionAll(star).distinct(), "similar-candidates")
    near = _verified(texts, first, similarity, width).select("a", "b")
    groups = settle(connected_components(near if known is None else near.union(known.select("a", "b")), "a", "b"), "similar-groups")
    if many.isEmpty():
        return groups

    # Each key's groups are counted before its texts meet them, so a frequent key is no hot one.
    named = settle(many.join(groups.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id")), "band-grouped")
    split = named.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("key")
    apart = settle(named.join(settle(split, "band-split"), "key").select("id", "root").distinct(), "band-apart")
    rest = settle(_across_groups(texts, apart, similarity, width).join(first, ["a", "b"], "left_anti"), "similar-rest")
    if rest.isEmpty():
        return groups
    late = _verified(texts, rest, similarity, width).select("a", "b")
    return connected_components(late.union(groups.select(F.col("node").alias("a"), F.col("root").alias("b"))), "a", "b")


def _halved(found: np.ndarray) -> np.ndarray:
    """The upper 32 bits of hashes, enough to compare two sets, up to one in some millions of shingles; ascending, distinct."""
    return np.unique((found >> np.uint64(32)).astype(np.uint32))


def _across_groups(texts: DataFrame, apart: DataFrame, similarity: float, width: int) -> DataFrame:
    """Distinct pairs (``a`` < ``b``) of ids of different roots in ``apart``, a settled table (id, root): all that have the similarity, and others.

    Prefix filter: with all shingles in one order, two sets of that similarity
    share one among the first size - similarity * size + 1 of each. The order
    is by the number of texts, rarest first, so texts that were changed much
    have prefixes of shingles of their own and meet none. A pair counts where
    its sets, if this is the first shingle they share, can still share enough
    (positional filter). Per shingle, texts of its largest group do not meet
    each other, and only texts of sizes near enough meet at all: a size's class and the two beside it.
    """
    kind = texts.schema["id"].dataType.simpleString()
    few = apart.count() <= BROADCAST_IDS
    held = texts.join(F.broadcast(apart) if few else apart, "id")

    def listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, at = [], 0
            for row in range(batch.num_rows):
                found.append(_halved(shingles(batch.column(1)[row].as_py(), width)).view(np.int32))
                if sum(map(len, found)) > BATCH_SHINGLES or len(found) == 512 or row + 1 == batch.num_rows:
                    part = batch.slice(at, len(found))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(found, pa.list_(pa.int32()))], ["id", "root", "shingles"])
                    found, at = [], row + 1

    sets = settle(held.select("id", "text", "root").mapInArrow(listed, f"id {kind}, root {kind}, shingles array<int>"), "apart-shingles")
    terms = sets.select("id", "root", F.size("shingles").alias("size"), F.explode("shingles").alias("s"))
    common = settle(terms.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "apart-common")
    mine = Window.partitionBy("id")
    # What no other text has comes first in the order and pairs none, so it only counts.
    place = F.col("size") - F.count(F.lit(1)).over(mine) + F.row_number().over(mine.orderBy("n", "s"))
    # A little less than the product, for rounding.
    length = F.col("size") - F.ceil(F.col("size") * F.lit(similarity) - F.lit(1e-6)) + 1
    prefix = terms.join(common, "s").withColumn("place", place).where(F.col("place") <= length)
    prefix = settle(prefix.select("s", "id", "root", "size", (F.col("size") - F.col("place") + 1).alias("left")), "apart-prefixes")
    per_root = prefix.groupBy("s", "root").agg(F.count(F.lit(1)).alias("k"))
    mixed = per_root.groupBy("s").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.count(F.lit(1)).alias("roots")).where("roots > 1").drop("roots")
    mixed = settle(prefix.join(settle(mixed, "apart-mixed"), "s"), "apart-meeting")

    def side(x: str) -> list[Column]:
        return [F.col("id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("root", "size", "left")]]

    # Sizes that differ by no more than the similarity are at most one class apart.
    size_class = F.floor(F.log(F.col("size")) / -math.log(min(similarity, 0.99) * 0.999)).cast("int")
    classes = F.explode(F.array(size_class - 1, size_class, size_class + 1)).alias("class")
    left, right = mixed.where("root <> main").select("s", "main", classes, *side("a")), mixed.select("s", size_class.alias("class"), *side("b"))
    other = (F.col("root_a") != F.col("root_b")) & ((F.col("a") < F.col("b")) | (F.col("root_b") == F.col("main")))
    # Sets of sizes x and y share at least (x + y) * similarity / (1 + similarity).
    enough = F.least("left_a", "left_b") >= (F.col("size_a") + F.col("size_b")) * F.lit(similarity / (1 + similarity)) - F.lit(1e-6)
    return left.join(right, ["s", "class"]).where(other & enough).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _verified(texts: DataFrame, wanted: DataFrame, similarity: float, width: int) -> DataFrame:
    """The pairs (a, b) of ``wanted``, a settled table, whose sets of shingles are similar enough."""
    kind = texts.schema["id"].dataType.simpleString()
    ids = settle(wanted.select(F.col("a").alias("id")).union(wanted.select("b")).distinct(), "similar-ids")
    held = texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = pa.array([_halved(shingles(t, width)).tobytes() for t in part.column(1).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), found], ["id", "shingles"])

    hashed = settle(held.mapInArrow(sets, f"id {kind}, shingles binary"), "similar-shingles")
    left, right = hashed.select(F.col("id").alias("a"), F.col("shingles").alias("x")), hashed.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    x, y = F.octet_length("x"), F.octet_length("y")
    near = wanted.join(left, "a").join(right, "b").where((F.least(x, y) > 0) & (F.least(x, y) >= F.greatest(x, y) * F.lit(similarity)))

    # Not a UDF, which the filter on its result would compute a second time, in workers of their own.
    def alike(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for one, other in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(one.as_buffer(), np.uint32), np.frombuffer(other.as_buffer(), np.uint32)
                common = len(np.intersect1d(p, q, assume_unique=True))
                out.append(common / (len(p) + len(q) - common))
            found = pa.array(out, pa.float64())
            rows = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], ["a", "b", "similarity"])
            yield rows.filter(pa.array([s >= similarity for s in out], pa.bool_()))

    return near.select("a", "b", "x", "y").mapInArrow(alike, f"a {kind}, b {kind}, similarity double").distinct()


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

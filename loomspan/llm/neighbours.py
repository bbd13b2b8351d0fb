"""Approximate nearest neighbours by cross-polytope hashing.

A table's hash turns a unit vector by fast Hadamard pseudo-rotations and names
the nearest signed axis. A query looks into the buckets of several axes near it
in each table, as many as measured recall asks for, and ranks what is there by
exact inner products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.llm.common import settle, table
from loomspan.session import settle_measured

K = 20
TABLES = 4
#: Share of the sampled queries' true neighbours that the probed buckets hold.
RECALL = 0.96
#: Queries of which recall is measured, against all rows.
SAMPLE_QUERIES = 256
#: Axes are split into more hashes while a bucket holds so many rows, and a query needs no more probes than these.
BUCKET_ROWS, MOST_PROBES = 512, 512
#: A query's first probes, in one table, are one of so many of that table's.
FIRST_SHARE = 3
#: Candidates and queries that one task compares at a time are about so many each.
SLICE = 2048
#: Rows (some 30 bytes each) of bucket sizes that may be broadcast.
BROADCAST_BUCKETS = 500_000
#: Queries without enough neighbours that are compared with all rows in one pass.
EXACT_BLOCK = 2048


def matrix(vectors: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Each row times the orthonormal Hadamard matrix; rows have a power of two of entries."""
    n, width = x.shape
    step = 1
    while step < width:
        pairs = x.reshape(n, -1, 2, step)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return x / np.sqrt(width)


class CrossPolytope:
    """The hashes of all tables, for vectors of ``dim`` entries within ``most_norm``.

    Where norms differ, a row gets one more entry that makes all norms equal, and
    a query a zero, so that the nearest axis follows the inner product. The turned
    vector is cut into ``hashes`` parts, each with its nearest signed axis.
    """

    def __init__(self, dim: int, tables: int, hashes: int, scale: float = 1.0, most_norm: float = 1.0, one_norm: bool = True, seed: int = 7):
        self.dim, self.tables, self.hashes, self.scale, self.most_norm, self.one_norm = dim, tables, hashes, scale, most_norm, one_norm
        self.width = max(2, 1 << (dim + (not one_norm) - 1).bit_length())
        self.axes = 2 * self.width // hashes
        self.buckets = self.axes**hashes
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, 3, self.width))

    def _turned(self, x: np.ndarray, at: int) -> np.ndarray:
        for signs in self.signs[at]:
            x = hadamard(x * signs)
        return x.reshape(len(x), self.hashes, -1)

    def _units(self, x: np.ndarray, rows: bool) -> np.ndarray:
        x = x / self.scale
        norms = np.sqrt((x * x).sum(1))
        out = np.zeros((len(x), self.width))
        if rows and not self.one_norm:
            out[:, : self.dim] = x / self.most_norm
            out[:, self.dim] = np.sqrt(np.maximum(0, 1 - (norms / self.most_norm) ** 2))
        else:
            out[:, : self.dim] = x / norms[:, None]
        return out

    def rows(self, x: np.ndarray) -> np.ndarray:
        """Each row's bucket in each table."""
        units, found = self._units(x, True), []
        for at in range(self.tables):
            turned = self._turned(units, at)
            axis = np.abs(turned).argmax(2)
            side = np.take_along_axis(turned, axis[:, :, None], 2)[:, :, 0] < 0
            name = np.full(len(x), at, np.int64)
            for part in (2 * axis + side).T:
                name = name * self.axes + part
            found.append(name)
        return np.stack(found, 1)

    def queries(self, x: np.ndarray, probes: int) -> np.ndarray:
        """For each query and table the ``probes`` buckets whose axes it lies nearest to, nearest first."""
        units, found = self._units(x, False), []
        for at in range(self.tables):
            turned = self._turned(units, at)
            near = np.stack([turned, -turned], 3).reshape(len(x), self.hashes, -1)
            names, scores = np.full((len(x), 1), at, np.int64), np.zeros((len(x), 1))
            # The nearest of several parts have the nearest of the first parts, so each step keeps these alone.
            for part in range(self.hashes):
                names = (names[:, :, None] * self.axes + np.arange(self.axes)).reshape(len(x), -1)
                scores = (scores[:, :, None] + near[:, part, None, :]).reshape(len(x), -1)
                order = np.argsort(-scores, axis=1, kind="stable")[:, :probes]
                names, scores = np.take_along_axis(names, order, 1), np.take_along_axis(scores, order, 1)
            found.append(names)
        return np.stack(found, 1)


def probes_for(hasher: CrossPolytope, queries: np.ndarray, truth: list[np.ndarray], recall: float, most: int) -> int | None:
    """The fewest probes for each table with which so large a share of the true neighbours is in a probed bucket."""
    most = min(most, hasher.buckets)
    probed = hasher.queries(queries, most)
    ranks = []
    for lists, near in zip(probed, truth, strict=True):
        if len(near):
            held = hasher.rows(near)
            same = lists[None] == held[:, :, None]
            ranks.append(np.where(same.any(2), same.argmax(2), most).min(1))
    if not ranks:
        return 1
    ranks = np.sort(np.concatenate(ranks))
    needed = int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)])
    return needed + 1 if needed < most else None


def inner_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, summed from the first entry to the last, so that equal vectors have equal products wherever they are compared."""
    total = np.zeros(len(x))
    for a, b in zip(x.T, y.T, strict=True):
        total += a * b
    return total


def best_of(x: np.ndarray, ids: np.ndarray, q: np.ndarray, least: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query its ``most`` nearest rows (ties to the smaller id) with no less than its ``least`` product: query, row, product."""
    found: list[tuple[np.ndarray, ...]] = []
    slack = 1e-12 * x.shape[1] * np.sqrt((x * x).sum(1).max())
    for begin in range(0, len(q), 512):
        part = q[begin : begin + 512]
        scores = part @ x.T
        bound = least[begin : begin + 512]
        if len(x) > most:
            bound = np.maximum(bound, np.partition(scores, len(x) - most, axis=1)[:, len(x) - most])
        who, what = np.nonzero(scores >= (bound - slack * np.sqrt((part * part).sum(1)))[:, None])
        exact = inner_products(x[what], part[who])
        order = np.lexsort((ids[what], -exact, who))
        who, what, exact = who[order], what[order], exact[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        found.append((who[rank < most] + begin, what[rank < most], exact[rank < most]))
    return tuple(np.concatenate(parts) for parts in zip(*found, strict=True))


def _order(ids: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The ids' order as numbers, null after all others."""
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    order = pa.compute.sort_indices(ids, null_placement="at_end").to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank


def nearest(
    vectors: DataFrame, asks: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding",
    tables: int = TABLES, recall: float = RECALL, slice_rows: int = SLICE, bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """For each row that ``asks``, the ``k`` nearest of all other rows by inner product, as far as its probed buckets hold them.

    Every row is in one bucket of each table. How many buckets a query probes is
    the least number at which those of SAMPLE_QUERIES queries hold ``recall`` of their true
    neighbours, which are found by comparing the sample with all rows; so expected recall
    hardly depends on the data, and hard data cost more probes. A query whose
    buckets hold fewer than ``k`` rows is compared with all rows. Buckets of any
    size are compared whole, in slices of about ``slice_rows`` rows and queries; a
    query's nearest buckets come first, so that the others give few rows.
    Of rows with the same vector one is hashed; the ``k + 1`` of least id, all that
    can be among a query's nearest, come back with it.

    Returns the asking row's id (``query_id``), ``rank`` (int, from 1), the found
    row's id and ``score`` (double: products summed in the entries' order in double
    precision). Ties go to the smaller id, null last. A row isn't its own
    neighbour, but rows that repeat its id or vector are. Vectors that are null,
    empty, zero or hold null or non-finite entries take no part, nor do those of
    another length than most have (of two such lengths the smaller counts). Other columns are not read. No
    rows or no questions give an empty result.
    """
    spark = vectors.sparkSession
    held = vectors.schema[vector_col].dataType.elementType
    vector = vectors[vector_col] if isinstance(held, (T.FloatType, T.DoubleType)) else vectors[vector_col].cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    rows = vectors.select(vectors[id_col].alias("id"), vector.alias("vec"), F.coalesce(asks, F.lit(False)).alias("asks")).where(finite)
    rows = settle(rows.withColumn("row", F.monotonically_increasing_id()), "ann-rows")
    id_type = rows.schema["id"].dataType
    schema = T.StructType().add("query_id", id_type).add("rank", T.IntegerType()).add(id_col, id_type).add("score", T.DoubleType())
    usual = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if usual is None:
        return spark.createDataFrame([], schema)
    dim = usual["dim"]
    rows = rows.where(F.size("vec") == dim)

    # Rows of one vector: the first stands for all. Spark limits each to k + 1 before the shuffle, too.
    of_vector = Window.partitionBy("vec").orderBy(F.asc_nulls_last("id"), "row")
    upto = of_vector.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    members = rows.select("id", "row", "vec", F.row_number().over(of_vector).alias("nth"), F.first("row").over(upto).alias("head")).where(F.col("nth") <= k + 1)
    members = members.withColumn("vec", F.when(F.col("nth") == 1, F.col("vec")))
    largest = F.max(F.greatest(F.array_max("vec"), -F.array_min("vec")).cast("double"))
    members, seen = settle_measured(members, "ann-members", heads=F.count("vec"), others=F.count(F.lit(1)) - F.count("vec"), scale=largest)
    heads = members.where("nth = 1").select("id", "row", "vec")
    others = members.where("nth > 1").select("head", F.col("id").alias("other_id"), F.col("row").alias("other"))
    scale = seen["scale"]
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda total, x: total + (x.cast("double") / scale) ** 2))
    norms = heads.agg(F.min(norm).alias("least"), F.max(norm).alias("most")).first()
    one_norm = norms["most"] - norms["least"] <= 1e-6 * norms["most"]

    asking = rows.where("asks").select(F.col("id").alias("query_id"), F.col("row").alias("query"), "vec")
    sample = asking.orderBy(F.xxhash64("query"), "query").limit(SAMPLE_QUERIES).toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], schema)

    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    pair = T.StructType().add("query_id", id_type).add("query", T.LongType()).add("id", id_type).add("row", T.LongType()).add("score", T.DoubleType())

    def paired(queries: pa.Table, ids, row_ids, who: np.ndarray, what: np.ndarray, scores: np.ndarray) -> pa.Table:
        return pa.table([queries["query_id"].take(who), queries["query"].take(who), ids.take(what), row_ids.take(what), pa.array(scores)], [f.name for f in pair])

    def against_all(queries: pa.Table) -> DataFrame:
        """These few queries with all rows, exactly: each batch gives its best."""
        q, narrow = matrix(queries["vec"], dim), queries.select(["query_id", "query"])
        least = np.full(len(q), -np.inf)

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    best = best_of(matrix(batch.column("vec"), dim), _order(batch.column("id")), q, least, k + 1)
                    yield from paired(narrow, batch.column("id"), batch.column("row"), *best).to_batches()

        return heads.mapInArrow(compare, pair)

    def ranked(pairs: DataFrame) -> DataFrame:
        """The k best of each query, after copies of what was found and without the query itself."""
        if seen["others"]:
            copies = pairs.join(others, F.col("row") == F.col("head")).select("query_id", "query", F.col("other_id").alias("id"), F.col("other").alias("row"), "score")
            pairs = pairs.unionByName(copies)
        pairs = pairs.where("row != query").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        return pairs.select("query", "query_id", "rank", F.col("id").alias(id_col), "row", "score")

    def distinct_best(pairs: DataFrame) -> DataFrame:
        """A row may be found in several tables."""
        return pairs.repartition("query").dropDuplicates(["query", "row"])

    true = against_all(sample).where("row != query").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    true = settle(true.select("query", "row"), "ann-true")
    near = true.join(heads, "row").select("query", "vec").toArrow()  # at most k for each sampled query
    near_of, near_vec = near["query"].to_numpy(), matrix(near["vec"], dim)
    truth = [near_vec[near_of == query] for query in sample["query"].to_pylist()]
    sampled = matrix(sample["vec"], dim)

    hashes, probes = 4, None
    while probes is None:
        hasher = CrossPolytope(dim, tables, hashes, scale, norms["most"], one_norm) if 2 * dim >= 8 * hashes or hashes == 1 else None
        if hasher and (hashes == 1 or seen["heads"] >= bucket_rows * hasher.buckets):
            probes = probes_for(hasher, sampled, truth, recall, MOST_PROBES if hashes > 1 else hasher.buckets)
        hashes //= 2

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = pa.array(list(hasher.rows(matrix(batch.column("vec"), dim))), pa.list_(pa.int64()))
                yield pa.record_batch([*batch.columns, found], [*batch.schema.names, "buckets"])

    def probing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                q = matrix(batch.column("vec"), dim)
                found = pa.array(list(hasher.queries(q, probes).reshape(len(q), -1)), pa.list_(pa.int64()))
                yield pa.record_batch([*batch.columns, found], [*batch.schema.names, "buckets"])

    longs = T.ArrayType(T.LongType())
    stored = heads.mapInArrow(hashed, T.StructType([*heads.schema]).add("buckets", longs))
    asked = settle(asking.mapInArrow(probing, T.StructType([*asking.schema]).add("buckets", longs)), "ann-queries")

    def numbers(upto: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(upto) - 1))

    def sliced(buckets: DataFrame, into: str) -> DataFrame:
        return buckets.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / slice_rows).cast("int").alias(into))

    id_kind = sample.schema.field("query_id").type
    pair_schema = pa.schema([("query_id", id_kind), ("query", pa.int64()), ("id", id_kind), ("row", pa.int64()), ("score", pa.float64())])

    def compare(stored: pa.Table, asked: pa.Table) -> pa.Table:
        if not stored.num_rows or not asked.num_rows:
            return pair_schema.empty_table()
        ids, row_ids = stored["id"].combine_chunks(), stored["row"].combine_chunks()
        found = best_of(matrix(stored["vec"], dim), _order(ids), matrix(asked["vec"], dim), asked["least"].to_numpy(), k + 1)
        return paired(asked, ids, row_ids, *found)

    def compared(stored: DataFrame, asked: DataFrame) -> DataFrame:
        """What each query finds in its buckets: of each slice the best, down to its ``least`` score."""
        # How many slices of rows and of queries a bucket takes; buckets that no query probes are left out.
        held = sliced(stored.select(F.explode("buckets").alias("bucket")), "slices")
        met = sliced(asked.select(F.explode("buckets").alias("bucket")), "parts")
        loads, sizes = settle_measured(held.join(met, "bucket"), "ann-buckets", rows=F.count(F.lit(1)))
        loads = F.broadcast(loads) if sizes["rows"] <= BROADCAST_BUCKETS else loads
        left = stored.select("id", "row", "vec", F.explode("buckets").alias("bucket")).join(loads, "bucket")
        left = left.select("id", "row", "vec", "bucket", F.pmod(F.xxhash64("row"), "slices").cast("int").alias("slice"), numbers("parts").alias("part"))
        right = asked.select("query_id", "query", "vec", "least", F.explode("buckets").alias("q_bucket")).join(loads.withColumnRenamed("bucket", "q_bucket"), "q_bucket")
        right = right.select("query_id", "query", "vec", "least", "q_bucket", numbers("slices").alias("q_slice"), F.pmod(F.xxhash64("query"), "parts").cast("int").alias("q_part"))
        return left.groupBy("bucket", "slice", "part").cogroup(right.groupBy("q_bucket", "q_slice", "q_part")).applyInArrow(compare, pair)

    # The nearest buckets of one table come first: their (k + 1)-th best score bounds what the others need to give.
    first = -(-probes // FIRST_SHARE)
    ahead = asked.select("query_id", "query", "vec", F.lit(float("-inf")).alias("least"), F.slice("buckets", 1, first).alias("buckets"))
    near = compared(stored.withColumn("buckets", F.slice("buckets", 1, 1)), ahead)
    near = settle(near.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1), "ann-near")
    least = near.where(F.col("nth") == k + 1).select("query", F.col("score").alias("least"))
    behind = asked.withColumn("buckets", F.slice("buckets", first + 1, tables * probes)).join(least, "query", "left").fillna(float("-inf"), ["least"])
    found = settle(ranked(distinct_best(compared(stored, behind).unionByName(near.drop("nth")))), "ann-found")

    enough = found.groupBy("query").count().where(F.col("count") >= k).select("query")
    lacking = settle(asked.select("query_id", "query", "vec").join(enough, "query", "left_anti"), "ann-lacking")
    result = found
    if not lacking.isEmpty():
        exact = []
        order = lacking.orderBy("query")
        last = -1
        while (block := order.where(F.col("query") > last).limit(EXACT_BLOCK).toArrow()).num_rows:
            exact.append(ranked(against_all(block)))
            last = block["query"][-1].as_py()
        result = found.join(enough, "query", "left_semi")
        for rest in exact:
            result = result.unionByName(rest)
    return result.select("query_id", F.col("rank").cast("int").alias("rank"), id_col, "score")


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)

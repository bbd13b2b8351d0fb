"""The training-data pipeline: five stages over ``documents``, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.common import settle, table
from loomspan.llm.decontaminate import decontaminate
from loomspan.llm.mixing import mix_sources
from loomspan.llm.quality import fit, with_score
from loomspan.llm.sharding import shard_documents
from loomspan.llm.simhash import BROADCAST_IDS, linked_rows, similar_texts

#: Documents that score less are rejected.
LEAST_QUALITY = 0.3
SHARDS = 8


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose quality score is below LEAST_QUALITY.

    The classifier learns from labelled rows that aren't held out; each
    document's score depends on its whole text alone. Null and empty texts have
    the score of no words.
    """
    model = fit(docs, table(spark, sf_dir, "labels"))
    return with_score(docs, model, into="__score").where(F.col("__score") >= LEAST_QUALITY).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays: one with the smallest id, a null id if there is no other.

    Rows of one text are one group, whatever their ids, and rows of one id with
    different texts are not. Groups are connected by SimHash links (three words,
    three bits, as the operator's query has them) and by a similarity of at
    least 0.8 on five words, each over all distinct texts. An empty table gives
    an empty result.
    """
    # Each distinct text, by a 128-bit hash, has a number, which is settled before it is used.
    keyed = docs.withColumn("__text", F.md5(F.coalesce("text", F.lit(""))))
    names = keyed.groupBy("__text").agg(F.min("doc_id").alias("first"))
    names = settle(names.withColumn("node", F.monotonically_increasing_id()), "distinct-texts")
    few = names.count() <= BROADCAST_IDS
    # Where one id has a text twice, both rows are here, which does no harm.
    texts = keyed.join(F.broadcast(names) if few else names, "__text").where(F.col("doc_id").eqNullSafe(F.col("first"))).select("node", "text")
    texts = texts if few else settle(texts, "texts")

    groups = settle(similar_texts(texts, "node", known=linked_rows(texts, "node")), "near-groups")
    order = F.struct(F.col("first").isNull().alias("none"), "first", "node")
    best = groups.join(names, "node").groupBy("root").agg(F.min(order).alias("best")).select(F.col("best.node").alias("node"))
    gone = settle(groups.select("node").join(best, "node", "left_anti").join(names, "node").select("__text"), "near-copies")
    kept = names.join(gone, "__text", "left_anti").select("__text", F.col("first").alias("__first"))

    rows = keyed.join(F.broadcast(kept) if few else kept, "__text").where(F.col("doc_id").eqNullSafe(F.col("__first")))
    again = keyed.groupBy("__text", "doc_id").count().where("count > 1").select("__text", F.col("doc_id").alias("__again"))
    again = settle(again.join(kept, "__text").where(F.col("__again").eqNullSafe(F.col("__first"))).select("__text"), "repeated-rows")
    if again.isEmpty():
        return rows.select(*docs.columns)
    small = again.count() <= BROADCAST_IDS
    again = F.broadcast(again) if small else again
    once = rows.join(again, "__text", "left_semi").dropDuplicates(["__text"])
    return rows.join(again, "__text", "left_anti").unionByName(once).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go.

    A text decides alone, whatever its row's id: null and repeated ids lose no
    clean row. Null and empty texts stay. An empty table or benchmark changes nothing.
    """
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands as often as its source's target asks for, which may be not at all.

    Null sources are one source; rows that repeat an id share a draw; rows of
    null id draw by their texts. An empty table gives an empty result.
    """
    taken = mix_sources(docs).where(F.col("copies") > 0)
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deals all rows, whatever their ids and texts, into SHARDS shards of nearly equal bytes; adds ``size``, ``shard`` and ``slot``."""
    return shard_documents(docs, SHARDS)


STAGES = [("quality", keep_quality), ("near_duplicates", drop_near_duplicates), ("decontaminate", drop_contaminated), ("mix", mix), ("shard", shard)]

#: Training and fingerprints are beyond SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; what each returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

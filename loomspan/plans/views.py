"""Interval, chain, edge, status and sequence tables derived from the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _intervals(spark: SparkSession, sf_dir: str, kind: str, turn: int) -> DataFrame:
    events = read(spark, sf_dir, "events").where(F.col("event_type") == kind)
    start = F.expr("unix_micros(cast(ts as timestamp)) div 60000000") - 28401120
    return events.select(F.col("user_id").alias("k"), F.col("event_id").alias("id"), start.alias("s")).withColumn("e", F.col("s") + 60 * (1 + F.col("id") % turn))


def iv_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _intervals(spark, sf_dir, "view", 48)


def iv_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _intervals(spark, sf_dir, "purchase", 24)


def chain_blocks_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("chain_id"),
        F.row_number().over(order).cast("long").alias("block_no"),
        F.col("l_quantity").cast("long").alias("size"),
        (F.col("l_partkey") % 17).cast("long").alias("dt"),
        (F.col("l_suppkey") % 13).cast("long").alias("dq"),
    )


def chain_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chain_id")).distinct()
    return ids.select("chain_id", (F.col("chain_id") * 10).alias("t_start"), (F.col("chain_id") * 7).alias("q_start"))


def chain_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspan.operators.chains import decode_blocks

    return decode_blocks(chain_headers(spark, sf_dir), chain_blocks_raw(spark, sf_dir))


def bed_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One track per chain with its blocks as arrays, and a coding part."""
    blocks = chain_blocks(spark, sf_dir).groupBy(F.col("chain_id").alias("id"))
    rows = blocks.agg(F.min("t_start").alias("start"), F.max("t_end").alias("end"), F.array_sort(F.collect_list(F.struct(F.col("t_start").alias("s"), F.col("t_end").alias("e")))).alias("blocks"))
    return rows.select("id", "start", "end", (F.col("start") + 15).alias("thick_start"), F.greatest(F.col("end") - 20, F.col("start") + 15).alias("thick_end"), "blocks", F.when(F.col("id") % 2 == 0, "+").otherwise("-").alias("strand"))


def edge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge per line item, between five reference and five query genes of each two orders."""
    rows = read(spark, sf_dir, "lineitem")
    five = F.expr("l_orderkey div 2") * 5
    gene, query = F.concat(F.lit("P"), five + F.col("l_partkey") % 5), F.concat(F.lit("O"), five + F.col("l_suppkey") % 5)
    return rows.select(gene.alias("r_gene"), query.alias("q_gene"), F.round(F.col("l_discount") * 100).cast("long").alias("score"))


def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    named = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    joined = lines.join(named, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.select(F.col("l_partkey").alias("item"), F.col("n_name").alias("assembly"), ((F.col("l_partkey") * 7 + F.col("l_suppkey") * 3) % 8 - 1).cast("long").alias("rank")).distinct()


def dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    return read(spark, sf_dir, "documents").select("doc_id", F.translate(letters, "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTNN").alias("seq"))


SQL = {
    "iv_a": "SELECT user_id k, event_id id, (epoch_us(ts)//60000000) - 28401120 s, (epoch_us(ts)//60000000) - 28401120 + 60*(1+event_id%48) e FROM events WHERE event_type='view'",
    "iv_b": "SELECT user_id k, event_id id, (epoch_us(ts)//60000000) - 28401120 s, (epoch_us(ts)//60000000) - 28401120 + 60*(1+event_id%24) e FROM events WHERE event_type='purchase'",
    "chain_blocks_raw": """SELECT l_orderkey chain_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,l_partkey,l_suppkey,l_extendedprice,l_quantity,l_shipdate) block_no,
        CAST(l_quantity AS BIGINT) size, l_partkey%17 dt, l_suppkey%13 dq FROM lineitem""",
    "chain_blocks": """SELECT chain_id, block_no, CAST(chain_id*10 + coalesce(sum(size+dt) OVER w,0) AS BIGINT) t_start, CAST(chain_id*10 + coalesce(sum(size+dt) OVER w,0) + size AS BIGINT) t_end,
        CAST(chain_id*7 + coalesce(sum(size+dq) OVER w,0) AS BIGINT) q_start, CAST(chain_id*7 + coalesce(sum(size+dq) OVER w,0) + size AS BIGINT) q_end
        FROM chain_blocks_raw WINDOW w AS (PARTITION BY chain_id ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "bed_like": """SELECT chain_id id, min(t_start) start_, max(t_end) end_, min(t_start)+15 thick_start, greatest(max(t_end)-20, min(t_start)+15) thick_end, count(*) n_blocks FROM chain_blocks GROUP BY 1""",
    "edge_scores": "SELECT 'P'||(l_orderkey//2*5+l_partkey%5) r_gene, 'O'||(l_orderkey//2*5+l_suppkey%5) q_gene, CAST(round(l_discount*100) AS BIGINT) score FROM lineitem",
    "edges": "SELECT DISTINCT r_gene, q_gene FROM edge_scores",
    "status": "SELECT DISTINCT l_partkey item, n_name assembly, CAST((l_partkey*7+l_suppkey*3)%8 - 1 AS BIGINT) rank FROM lineitem JOIN supplier ON s_suppkey=l_suppkey JOIN nation ON n_nationkey=s_nationkey",
    "dna": "SELECT doc_id, translate(regexp_replace(lower(text),'[^a-z]','','g'),'abcdefghijklmnopqrstuvwxyz','ACGTACGTACGTACGTACGTACGTNN') seq FROM documents",
}


def with_views(names: str, body: str, recursive: bool = False) -> str:
    """A query over the named views (in order of need)."""
    ctes = ",\n".join(f"{n} AS ({SQL[n]})" for n in names.split())
    head = "WITH RECURSIVE " if recursive else "WITH "
    return f"{head}{ctes}{',' if body.lstrip().startswith(',') else ''}\n{body.lstrip().removeprefix(',')}"

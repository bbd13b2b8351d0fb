"""Queries on what a browser shows of projections: orders as projections of customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators import browser_tables
from loomspan.plans import views
from loomspan.plans.views import with_views


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("t"), F.col("id") % 40, F.lit("."), "id")
    tracks = views.bed_like(spark, sf_dir).select(
        name.alias("name"), F.when(F.col("id") % 13 == 0, "None").otherwise(F.concat(F.lit("c"), F.col("id") % 9)).alias("chrom"), "start", "end", "strand",
        F.when(F.col("id") % 11 == 0, F.concat("blocks", F.array(F.element_at("blocks", 1)))).otherwise(F.col("blocks")).alias("blocks"),
    )
    orders = views.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey")
    info = orders.where("id % 3 > 0").select(name.alias("name"), F.concat(F.lit("q"), F.col("o_custkey") % 50).alias("place"), F.when(F.col("id") % 2 == 0, "I").otherwise("L").alias("class"), (F.col("id") % 100 / 100).alias("score"))
    features = orders.where("id % 4 > 0").select(name.alias("name"), *[(F.col("id") % n / 100).alias(c) for n, c in ((7, "ignore_m"), (11, "intact_m"), (17, "intact_codons"), (19, "out_of_chain"))])
    proteins = orders.where("id % 5 > 0").select(name.alias("name"), F.lit("MK").alias("ref"), F.repeat(F.lit("M"), (F.col("id") % 4 + 1).cast("int")).alias("query"))
    items = views.chain_blocks_raw(spark, sf_dir).withColumnRenamed("chain_id", "id")
    mutations = items.where("dt % 4 = 0").select(name.alias("name"), F.col("block_no").alias("exon"), F.concat(F.lit("FS_"), "dq").alias("mut_id"), F.col("size").alias("position"))
    exons = items.where("id % 6 > 0").select(name.alias("name"), F.col("block_no").alias("exon"), "size")
    links = views.read(spark, sf_dir, "nation").select(F.concat(F.lit("t"), "n_nationkey").alias("transcript"), F.concat(F.lit("page/"), "n_name").alias("link"))
    return browser_tables.annotation_rows(tracks, info, features, proteins, mutations, exons, links)


def browser_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every shown projection with its data, its mutations and exons as texts."""
    text = lambda rows, *names: F.array_join(F.transform(rows, lambda x: F.concat_ws(":", *[x[n].cast("string") for n in names])), ",")
    rows = _rows(spark, sf_dir)
    return rows.select("name", "chrom", "start", "end", "link", "info_place", "info_class", "info_score", "features_ignore_m", "features_out_of_chain", "protein_query", text("mutations", "exon", "mut_id", "position").alias("mutations"), text("exons", "exon", "size").alias("exons"))


QUERIES = {"browser_rows": browser_rows}
SQL = {
    "browser_rows": with_views("chain_blocks_raw chain_blocks", """, nm AS (SELECT DISTINCT chain_id id, 't'||(chain_id%40)||'.'||chain_id AS name FROM chain_blocks),
      tk AS (SELECT chain_id id, min(t_start) "start", max(t_end) "end" FROM chain_blocks WHERE chain_id%13<>0 AND chain_id%11<>0 GROUP BY 1),
      mt AS (SELECT chain_id id, string_agg(block_no||':FS_'||dq||':'||size, ',' ORDER BY block_no, 'FS_'||dq) m FROM chain_blocks_raw WHERE dt%4=0 GROUP BY 1),
      xt AS (SELECT chain_id id, string_agg(block_no||':'||size, ',' ORDER BY block_no) x FROM chain_blocks_raw WHERE chain_id%6>0 GROUP BY 1)
      SELECT name, 'c'||(id%9) chrom, "start", "end", coalesce('page/'||n_name, 't'||(id%40)) link, CASE WHEN id%3>0 THEN 'q'||(o_custkey%50) ELSE 'Undefined' END info_place, CASE WHEN id%3=0 THEN 'Undefined' WHEN id%2=0 THEN 'I' ELSE 'L' END info_class,
        CASE WHEN id%3>0 THEN id%100/100 ELSE 0.0 END::DOUBLE info_score, CASE WHEN id%4>0 THEN id%7/100 ELSE 0.0 END::DOUBLE features_ignore_m, CASE WHEN id%4>0 THEN id%19/100 ELSE 0.0 END::DOUBLE features_out_of_chain,
        CASE WHEN id%5>0 THEN repeat('M', (id%4+1)::INT) ELSE '' END protein_query, coalesce(m,'') mutations, coalesce(x,'') exons
      FROM tk JOIN nm USING (id) JOIN orders ON o_orderkey=id LEFT JOIN mt USING (id) LEFT JOIN xt USING (id) LEFT JOIN nation ON n_nationkey=id%40"""),
}

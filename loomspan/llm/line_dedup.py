"""Cross-site line deduplication on HyperLogLog sketches of each line's sites."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.common import settle, table, text_or_empty

#: A line on so many distinct sites or more is boilerplate.
LEAST_SITES = 10
#: The sketches have 2^LG_K registers; their relative standard error is about 1.04 / sqrt(2^LG_K).
LG_K = 12
#: Boilerplate or near-threshold lines (20 bytes each) that may be broadcast.
BROADCAST_LINES = 1_000_000


def boilerplate_lines(lines: DataFrame, least_sites: int = LEAST_SITES, lg_k: int = LG_K) -> DataFrame:
    """The hashes of lines that stand on at least ``least_sites`` distinct sites.

    ``lines`` has ``h1``, ``h2`` and ``site``. Each line's sites are sketched
    with HyperLogLog, in each input partition first, and the sketches merged by
    the aggregation: a line that fills the corpus is one row per partition when
    it is shuffled. Where the estimate is so near to the threshold that the
    sketch could err (four standard errors, at least one site), the distinct
    sites are counted.
    """
    margin = max(1.0, 4 * 1.04 / math.sqrt(1 << lg_k) * least_sites)
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("sites"))
    spread = settle(spread.where(F.col("sites") >= least_sites - margin), "line-spread")
    sure = spread.where(F.col("sites") > least_sites + margin).select("h1", "h2")
    near = spread.where(F.col("sites") <= least_sites + margin).select("h1", "h2")
    if near.count() <= BROADCAST_LINES:
        near = F.broadcast(near)
    exact = lines.join(near, ["h1", "h2"], "left_semi").distinct().groupBy("h1", "h2").count().where(F.col("count") >= least_sites).select("h1", "h2")
    return settle(sure.union(exact), "boilerplate")


def remove_boilerplate(
    docs: DataFrame, least_sites: int = LEAST_SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", lg_k: int = LG_K
) -> DataFrame:
    """Takes lines that stand on many distinct sites out of whole texts.

    Lines are parted by line feeds and compared without blanks, tabs and
    carriage returns at their ends; lines that are then empty never count and
    always stay. Every place of a boilerplate line goes, with its line feed.

    Returns one row per input row: the id, ``n_lines`` (lines that are not
    empty), ``n_removed`` (both long) and ``clean_text``. Null text counts as
    empty; a null site is a site of its own; null and repeated ids do no harm:
    lines are put together by id and text. Other columns are not read. An empty
    table gives an empty result. Texts are shuffled once, to meet the positions
    of their boilerplate lines; texts without any stay whole.
    """
    base = docs.select(
        F.col(id_col).alias("id"),
        text_or_empty(text_col).alias("text"),
        F.coalesce(F.concat(F.lit("s"), F.col(site_col).cast("string")), F.lit("-")).alias("site"),
    )
    exploded = base.select("id", F.xxhash64("text").alias("digest"), "site", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    line = F.btrim("line", F.lit(" \t\r"))
    hashed = exploded.where(line != "").select("id", "digest", "site", "at", F.xxhash64(line).alias("h1"), F.hash(line).alias("h2"))
    found = boilerplate_lines(hashed.select("h1", "h2", "site"), least_sites, lg_k)
    if found.count() <= BROADCAST_LINES:
        found = F.broadcast(found)
    # Copies of a row find the same lines, so the positions are a set.
    gone = hashed.join(found, ["h1", "h2"], "left_semi").select("id", "digest", "at").distinct().groupBy("id", "digest").agg(F.collect_list("at").alias("gone"))

    lines = F.split("text", "\n")
    stays = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    kept = F.transform(stays, lambda i: F.get(lines, i))
    full = F.size(F.filter(lines, lambda x: F.btrim(x, F.lit(" \t\r")) != ""))
    texts = base.select("id", "text", F.xxhash64("text").alias("digest"))
    joined = texts.join(gone.withColumnRenamed("id", "id_gone"), F.col("id").eqNullSafe(F.col("id_gone")) & (texts["digest"] == gone["digest"]), "left")
    return joined.select(
        F.col("id").alias(id_col),
        full.cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("clean_text"),
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_boilerplate(table(spark, sf_dir, "documents"))


SQL = """
WITH split AS (SELECT doc_id, coalesce(text, '') AS text, coalesce('s' || source, '-') AS site,
                      string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, site, unnest(range(len(lines))) AS pos, unnest(lines) AS raw FROM split),
trimmed AS (SELECT *, trim(raw, ' ' || chr(9) || chr(13)) AS line FROM lines),
boiler AS (SELECT line FROM trimmed WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= 10),
marked AS (SELECT *, line IN (SELECT line FROM boiler) AS gone FROM trimmed)
SELECT doc_id, count(*) FILTER (WHERE line <> '')::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_removed,
       coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS clean_text
FROM marked GROUP BY doc_id
"""

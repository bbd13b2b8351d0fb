"""Queries on components of long paths and hubs, training rows, and checks of inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.operators import classify, mutations
from loomspan.operators.components import connected_components
from loomspan.plans import checks, views
from loomspan.sources import readers


def path_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of orders in a row, cut at every 97th customer's, and of each customer's orders around them."""
    orders = views.read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    # The month only spreads the rows: within it orders stand in a row.
    month = Window.partitionBy(F.expr("o_orderkey div 5000")).orderBy("o_orderkey")
    path = orders.select(F.when(F.col("o_custkey") % 97 > 0, F.lag("o_orderkey").over(month)).otherwise(F.col("o_orderkey")).alias("a"), F.col("o_orderkey").alias("b"))
    path = path.select(F.coalesce("a", "b").alias("a"), "b")
    hubs = orders.select((-1 - F.col("o_custkey")).alias("a"), (10**12 + F.col("o_orderkey")).alias("b"))
    return connected_components(path.unionByName(hubs), "a", "b")


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows of parts that have one to thirteen chains."""
    items = views.read(spark, sf_dir, "lineitem")
    chain = F.col("l_suppkey") % (1 + F.col("l_partkey") % 13)
    pairs = items.groupBy(F.col("l_partkey").alias("transcript"), chain.alias("chain_id")).agg(F.sum(F.col("l_quantity").cast("long") % 7).alias("cds"))
    features = pairs.withColumn("gene_overs", F.count(F.lit(1)).over(Window.partitionBy("transcript"))).withColumn("exon_perc", F.col("cds") / 100)
    sizes = views.read(spark, sf_dir, "part").select((F.col("p_partkey") % 700).alias("gene"), F.col("p_partkey").alias("transcript"), F.col("p_size").cast("long").alias("size"))
    one2one = sizes.where("gene % 2 = 0").select("gene").distinct()
    return classify.training_set(features, one2one, sizes).select("gene", "transcript", "chain_id", F.col("y").cast("long").alias("y"))


def wrong_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as chromosomes against what line items say of them."""
    chroms = views.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("chrom"), F.col("p_size").cast("long").alias("size"))
    genome = views.read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("chrom")).agg(F.max("l_quantity").cast("long").alias("size"))
    return checks.wrong_sizes(chroms, genome)


def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotation lines of orders, a line ending each, numbered by kind: the numbers without a single task for all lines."""
    rows = views.chain_blocks_raw(spark, sf_dir)
    kind = F.when(F.col("dt") % 3 == 0, "CDS").when(F.col("dt") % 3 == 1, "exon").otherwise("mRNA")
    lines = rows.select((F.col("chain_id") * 1000 + F.col("block_no")).alias("at"), F.concat(F.lit("c\tx\t"), kind).alias("line"))
    ends = rows.select((F.col("chain_id") * 1000 + 999).alias("at"), F.lit("###").alias("line")).distinct()
    found = readers.number_repeats(lines.unionByName(ends), "at", "line")
    return found.select("at", "gene_no", "kind", F.col("number").cast("long").alias("number"))


def lost_exon_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of mutations once exons are deleted or missing as a whole."""
    rows = views.chain_blocks_raw(spark, sf_dir)
    mclass = F.element_at(F.array(*map(F.lit, ["STOP", "FS_DEL", "DEL_EXON", "MISS_EXON", "FS_INS"])), (F.col("dt") % 5 + 1).cast("int"))
    found = mutations.drop_in_lost_exons(rows.select("chain_id", F.expr("block_no div 3").alias("exon"), mclass.alias("mclass")), "chain_id")
    return found.groupBy("chain_id", "mclass").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (path_components, training_rows, wrong_sizes, numbered_lines, lost_exon_mutations)}
SQL = {
    "path_components": """WITH x AS (SELECT o_orderkey k, o_custkey c, CASE WHEN o_custkey%97=0 OR lag(o_orderkey) OVER (PARTITION BY o_orderkey//5000 ORDER BY o_orderkey) IS NULL THEN o_orderkey END b FROM orders)
        SELECT k node, max(b) OVER (PARTITION BY k//5000 ORDER BY k) root FROM x UNION ALL SELECT 1000000000000+k, -1-c FROM x UNION ALL SELECT DISTINCT -1-c, -1-c FROM x""",
    "training_rows": """WITH p AS (SELECT l_partkey t, l_suppkey%(1+l_partkey%13) ch, sum(l_quantity::BIGINT%7) cds FROM lineitem GROUP BY 1,2), f AS (SELECT *, count(*) OVER (PARTITION BY t) o FROM p),
        z AS (SELECT p_partkey%700 gene, p_partkey t, row_number() OVER (PARTITION BY p_partkey%700 ORDER BY p_size DESC, p_partkey) n FROM part),
        k AS (SELECT gene, f.t transcript, ch chain_id, count(*) OVER w c, min(ch) OVER w m FROM f JOIN z ON z.t=f.t AND n=1 AND gene%2=0 WHERE o<=10 AND cds/100>0.1 WINDOW w AS (PARTITION BY f.t)) SELECT gene, transcript, chain_id, (c=1)::BIGINT y FROM k WHERE c=1 OR chain_id<>m""",
    "wrong_sizes": "SELECT p_partkey chrom, p_size::BIGINT size FROM part LEFT JOIN (SELECT l_partkey k, max(l_quantity)::BIGINT z FROM lineitem GROUP BY 1) ON k=p_partkey WHERE z IS NULL OR z<>p_size",
    "numbered_lines": views.with_views("chain_blocks_raw", """, g AS (SELECT chain_id, block_no, dt%3 d, dense_rank() OVER (ORDER BY chain_id)-1 n FROM chain_blocks_raw)
        SELECT chain_id*1000+block_no AS "at", n gene_no, CASE d WHEN 0 THEN 'CDS' ELSE 'exon' END kind, row_number() OVER (PARTITION BY chain_id, d ORDER BY block_no) number FROM g WHERE d<2"""),
    "lost_exon_mutations": views.with_views("chain_blocks_raw", """, m AS (SELECT chain_id, block_no//3 exon, ['STOP','FS_DEL','DEL_EXON','MISS_EXON','FS_INS'][dt%5+1] mclass, dt%5 IN (2,3) w FROM chain_blocks_raw), l AS (SELECT *, bool_or(w) OVER (PARTITION BY chain_id, exon) a FROM m)
        SELECT chain_id, mclass, count(*) n FROM l WHERE w OR NOT a GROUP BY 1,2"""),
}

"""Queries on intervals, chains, tracks and ordered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions import tracks
from loomspan.operators import chains, classify, intervals, mutations, runs
from loomspan.plans import views
from loomspan.plans.views import with_views

BIN = 1024


def overlap_join_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = intervals.overlap_totals(views.iv_a(spark, sf_dir), views.iv_b(spark, sf_dir), ["k"], ["k", "id"], BIN)
    return found.withColumnsRenamed({"a_k": "k", "a_id": "id"})


def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = intervals.overlap_join(views.iv_a(spark, sf_dir), views.iv_b(spark, sf_dir), ["k"], BIN)
    size = intervals.overlap_size(F.col("a_s"), F.col("a_e"), F.col("b_s"), F.col("b_e"))
    return pairs.select("k", "a_id", "b_id", size.alias("bases"))


def overlap_touching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.overlap_join(views.iv_a(spark, sf_dir), views.iv_b(spark, sf_dir), ["k"], BIN, closed=True).select("k", "a_id", "b_id")


def overlap_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.skipped(views.iv_a(spark, sf_dir), views.iv_b(spark, sf_dir), ["k"], BIN)


def interval_union_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.union_intervals(views.iv_a(spark, sf_dir), ["k"])


def interval_union_inclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Coarse starts, so that some intervals abut.
    coarse = views.iv_a(spark, sf_dir).select("k", (F.expr("s div 60") * 60).alias("s"), (F.expr("s div 60") * 60 + F.col("e") - F.col("s")).alias("e"))
    return intervals.union_intervals(coarse, ["k"], merge_adjacent=True)


def nested_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.nested(views.iv_a(spark, sf_dir), ["k"])


def coverage_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.coverage(views.iv_a(spark, sf_dir), views.iv_b(spark, sf_dir), ["k"], "id", BIN)


def neighbour_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.neighbour_overlaps(views.iv_a(spark, sf_dir), ["k"], "id")


def chain_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.chain_blocks(spark, sf_dir)


def chain_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.aligned_gaps(views.chain_blocks(spark, sf_dir))


def chain_score_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = views.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chain_id"), F.round("o_totalprice").cast("long").alias("score"))
    return chains.score_filter(orders, 150000)


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ranges for each chain: one within, one that begins before it."""
    ids = views.chain_headers(spark, sf_dir)
    spans = F.array(F.struct(F.lit(1).alias("region"), (F.col("t_start") + 12).alias("s"), (F.col("t_start") + 70).alias("e")), F.struct(F.lit(2).alias("region"), (F.col("t_start") - 40).alias("s"), (F.col("t_start") - 5).alias("e")))
    return ids.select("chain_id", F.explode(spans).alias("r")).select("chain_id", "r.region", "r.s", "r.e")


_REGIONS = """regions AS (SELECT DISTINCT l_orderkey chain_id, r region, CASE WHEN r=1 THEN l_orderkey*10+12 ELSE l_orderkey*10-40 END s,
 CASE WHEN r=1 THEN l_orderkey*10+70 ELSE l_orderkey*10-5 END e FROM lineitem, (VALUES (1),(2)) v(r))"""


def sub_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.sub_chain(views.chain_blocks(spark, sf_dir), _regions(spark, sf_dir))


def project_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.project_ranges(views.chain_blocks(spark, sf_dir), _regions(spark, sf_dir))


def project_range_widened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.project_ranges(views.chain_blocks(spark, sf_dir), _regions(spark, sf_dir), shift=2)


def cds_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.explode_blocks(tracks.coding_blocks(views.bed_like(spark, sf_dir)), "cds", "id")


def four_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tracks.four_tracks(views.bed_like(spark, sf_dir), "id")
    return rows.groupBy("id", "track").agg(F.count(F.lit(1)).alias("n_blocks"), F.min("s").alias("s"), F.max("e").alias("e"), F.sum(F.col("e") - F.col("s")).alias("bases"))


def gene_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.sizes(views.bed_like(spark, sf_dir)).select("id", "gene_len", "n_exons", "cds_bases", "intron_bases")


def gene_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tracks.reject_reason(views.bed_like(spark, sf_dir))
    return rows.select("id", "reason").where("reason IS NOT NULL")


def coding_exon_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.coding_sizes(views.bed_like(spark, sf_dir), "id")


def run_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = views.chain_blocks_raw(spark, sf_dir).where("size % 3 <> 0")
    return runs.runs(gone, ["chain_id"], "block_no", 2)


def bridged_exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("size") % 5 == 0, "M").when(F.col("size") % 3 == 0, "I").otherwise("D")
    return runs.bridged_pairs(views.chain_blocks_raw(spark, sf_dir).withColumn("state", state), ["chain_id"], "block_no", "state")


def prefix_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.prefix_sums(views.chain_blocks_raw(spark, sf_dir).select("chain_id", "block_no", "size"), ["chain_id"], ["block_no"], "size")


def label_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.gap_clusters(views.iv_a(spark, sf_dir), ["k"], "s", 600)


def falling_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.falling_runs(views.chain_blocks_raw(spark, sf_dir).select("chain_id", "block_no", "size"), ["chain_id"], ["block_no"], "size")


def top_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.chain_blocks_raw(spark, sf_dir).select("chain_id", "block_no", "size")
    return runs.top_rows(rows, ["chain_id"], [F.col("size").desc(), "block_no"], 2)


def chain_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of chains (b, one per user and 8-hour window) over transcripts (a) from covered bases of four tracks."""
    a, b = views.iv_a(spark, sf_dir), views.iv_b(spark, sf_dir)
    third = F.expr("(e - s) div 3")
    parts = [
        ("exons", F.array(F.struct(F.col("s"), (F.col("s") + third).alias("e")), F.struct((F.col("e") - third).alias("s"), F.col("e")))),
        ("cds", F.array(F.struct((F.col("s") + 5).alias("s"), (F.col("s") + third).alias("e")), F.struct((F.col("e") - third).alias("s"), (F.col("e") - 5).alias("e")))),
        ("body", F.array(F.struct("s", "e"))),
        ("flanks", F.array(F.struct((F.col("s") - 1000).alias("s"), (F.col("e") + 1000).alias("e")))),
    ]
    rows = a.select("k", F.col("id").alias("transcript"), F.explode(F.array(*[F.struct(F.lit(t).alias("track"), blocks.alias("blocks")) for t, blocks in parts])).alias("t"))
    rows = rows.select("k", "transcript", "t.track", F.explode("t.blocks").alias("x")).select("k", "transcript", "track", "x.s", "x.e")
    merged = intervals.union_intervals(b.select("k", "s", "e"), ["k"]).drop("n_parts")
    pairs = intervals.overlap_join(rows, merged, ["k"], BIN)
    size = intervals.overlap_size(F.col("a_s"), F.col("a_e"), F.col("b_s"), F.col("b_e"))
    of = lambda t: F.coalesce(F.sum(F.when(F.col("a_track") == t, size)), F.lit(0))
    hit = F.count_distinct(F.when(F.col("a_track") == "cds", F.col("a_s")))
    covered = pairs.groupBy(F.col("k").alias("chain_id"), F.col("a_transcript").alias("transcript")).agg(*[of(t).alias(t) for t, _ in parts], hit.alias("cds_exons"))
    features = classify.pair_features(covered)
    totals = merged.groupBy(F.col("k").alias("chain_id")).agg(F.sum(F.col("e") - F.col("s")).alias("block_bases"), (F.max("e") - F.min("s")).alias("q_len"))
    return classify.chain_features(features, totals).select("chain_id", "block_bases", "q_len", "synteny", "chain_cds", F.round("global_exo", 9).alias("global_exo"), F.round("exlen_to_qlen", 9).alias("exlen_to_qlen"))


def exon_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = _regions(spark, sf_dir).where("region = 1")
    blocks = views.chain_blocks(spark, sf_dir)
    near = regions.join(blocks, "chain_id")
    held = lambda p: F.bool_or((F.col("t_start") <= p) & (p < F.col("t_end")))
    facts = near.groupBy("chain_id", "s", "e").agg(
        F.min("t_start").alias("lo"), F.max("t_end").alias("hi"), held(F.col("s")).alias("a"), held(F.col("e") - 1).alias("z"), F.bool_or((F.col("t_start") < F.col("e")) & (F.col("s") < F.col("t_end"))).alias("any")
    )
    label = mutations.exon_class(F.col("s"), F.col("e"), F.col("lo"), F.col("hi"), F.col("a"), F.col("z"), ~F.col("any"))
    return facts.select("chain_id", label.alias("exon_class"))


QUERIES = {
    f.__name__: f
    for f in (
        overlap_join_agg, overlap_pairs, overlap_touching, overlap_skipped, interval_union_strict, interval_union_inclusive, nested_tracks, coverage_profile, neighbour_overlap,
        chain_decode, chain_gaps, chain_score_filter, sub_chain, project_range, project_range_widened, cds_clip, four_tracks, gene_sizes, gene_rejects, coding_exon_sizes,
        run_detection, bridged_exons, prefix_sums, label_clusters, falling_runs, top_blocks, chain_features, exon_classes,
    )
}

_PAIRS = "SELECT a.k, a.id a_id, b.id b_id, least(a.e,b.e)-greatest(a.s,b.s) bases, b.s b_s FROM iv_a a JOIN iv_b b ON a.k=b.k AND a.s<b.e AND b.s<a.e"
_ISLANDS = """, marked AS (SELECT *, CASE WHEN max(e) OVER w IS NULL OR s {op} max(e) OVER w THEN 1 ELSE 0 END fresh FROM {src}
 WINDOW w AS (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) island FROM marked),
 merged AS (SELECT k, min(s) s, max(e) e, count(*) n_parts FROM numbered GROUP BY k, island)"""
_CLIPPED = """, bl AS (SELECT chain_id id, min(t_start) start, max(t_end) "end", min(t_start)+15 a, greatest(max(t_end)-20, min(t_start)+15) z, CASE WHEN chain_id%2=0 THEN '+' ELSE '-' END strand FROM chain_blocks GROUP BY 1),
 cds AS (SELECT id, strand, greatest(t_start, a) s, least(t_end, z) e FROM bl JOIN chain_blocks ON chain_id=id WHERE t_end > a AND t_start < z)"""
_CHAIN = "chain_blocks_raw chain_blocks"
_PROJECT = """, {regions}, b AS (SELECT chain_id, min(block_no) b0, max(block_no) b1, min(t_start) t0, max(t_end) t1, min(q_start) q0, max(q_end) q1 FROM chain_blocks GROUP BY 1),
 f AS (SELECT r.chain_id, r.region, r.s, r.e, b0, b1, t0, t1, q0, q1, min(CASE WHEN t_end > s THEN block_no END) fb, max(CASE WHEN t_start < e THEN block_no END) lb
   FROM regions r JOIN b USING (chain_id) JOIN chain_blocks c USING (chain_id) GROUP BY ALL),
 g AS (SELECT f.*, x.t_start ft, x.q_start fq, y.t_end lt, y.q_end lq, y.t_start ls, y.q_start lqs FROM f
   LEFT JOIN chain_blocks x ON x.chain_id=f.chain_id AND x.block_no = greatest(fb-{n}, b0) LEFT JOIN chain_blocks y ON y.chain_id=f.chain_id AND y.block_no = least(lb+{n}, b1))
 SELECT chain_id, region, CASE WHEN e<=t0 THEN q0 WHEN s>=t1 THEN q1-1 {a} END q_from, CASE WHEN e<=t0 THEN q0+1 WHEN s>=t1 THEN q1 {z} END q_to FROM g"""

SQL = {
    "overlap_join_agg": with_views("iv_a iv_b", f"SELECT k, a_id id, count(*) n_hits, sum(bases)::BIGINT bases, count(DISTINCT b_s) n_starts FROM ({_PAIRS}) GROUP BY 1,2"),
    "overlap_pairs": with_views("iv_a iv_b", f"SELECT k, a_id, b_id, bases FROM ({_PAIRS})"),
    "overlap_touching": with_views("iv_a iv_b", "SELECT a.k, a.id a_id, b.id b_id FROM iv_a a JOIN iv_b b ON a.k=b.k AND a.s<=b.e AND b.s<=a.e"),
    "overlap_skipped": with_views("iv_a iv_b", """SELECT k, id, s, e, CASE WHEN k NOT IN (SELECT k FROM iv_b) THEN 'chromosome is not aligned' ELSE 'no intersecting chains' END reason
        FROM iv_a a WHERE NOT EXISTS (SELECT 1 FROM iv_b b WHERE a.k=b.k AND a.s<b.e AND b.s<a.e)"""),
    "interval_union_strict": with_views("iv_a", _ISLANDS.format(op=">=", src="iv_a") + " SELECT * FROM merged"),
    "interval_union_inclusive": with_views("iv_a", ", coarse AS (SELECT k, s//60*60 s, s//60*60+e-s e FROM iv_a)" + _ISLANDS.format(op=">", src="coarse") + " SELECT * FROM merged"),
    "nested_tracks": with_views("iv_a", _ISLANDS.format(op=">=", src="iv_a") + " SELECT k, sum(n_parts)::BIGINT n_ranges, count(*) n_islands, sum(e-s)::BIGINT covered, count(*) < sum(n_parts) is_nested FROM merged GROUP BY k"),
    "coverage_profile": with_views("iv_a iv_b", _ISLANDS.format(op=">=", src="iv_b") + """ SELECT a.k, a.id, max(a.e-a.s) span, coalesce(sum(CASE WHEN m.s IS NOT NULL THEN least(a.e,m.e)-greatest(a.s,m.s) END),0)::BIGINT covered
        FROM iv_a a LEFT JOIN merged m ON a.k=m.k AND a.s<m.e AND m.s<a.e GROUP BY 1,2"""),
    "neighbour_overlap": with_views("iv_a", """SELECT k, previous, id, pe - s AS shared FROM (SELECT k, id, s, lag(id) OVER w previous, lag(e) OVER w pe FROM iv_a WINDOW w AS (PARTITION BY k ORDER BY s,e,id)) WHERE pe > s"""),
    "chain_decode": with_views(_CHAIN, "SELECT * FROM chain_blocks"),
    "chain_gaps": with_views(_CHAIN, """SELECT chain_id, block_no, tf t_from, t_start t_to, qf q_from, q_start q_to FROM (SELECT *, lag(t_end) OVER w tf, lag(q_end) OVER w qf FROM chain_blocks
        WINDOW w AS (PARTITION BY chain_id ORDER BY block_no)) WHERE tf IS NOT NULL AND (t_start > tf OR q_start > qf)"""),
    "chain_score_filter": "SELECT o_orderkey chain_id, round(o_totalprice)::BIGINT score FROM orders WHERE round(o_totalprice) > 150000",
    "sub_chain": with_views(_CHAIN, f", {_REGIONS} SELECT r.chain_id, region, block_no, t_start, t_end, q_start, q_end FROM regions r JOIN chain_blocks c ON r.chain_id=c.chain_id AND t_end>=s AND t_start<e"),
    "project_range": with_views(_CHAIN, _PROJECT.format(regions=_REGIONS, n=0, a="WHEN s>ft THEN fq+s-ft ELSE fq", z="WHEN e<lt THEN lqs+e-ls ELSE lq")),
    "project_range_widened": with_views(_CHAIN, _PROJECT.format(regions=_REGIONS, n=2, a="ELSE fq", z="ELSE lq")),
    "cds_clip": with_views(_CHAIN, _CLIPPED + " SELECT id, row_number() OVER (PARTITION BY id ORDER BY s, e) n, s, e FROM cds"),
    "four_tracks": with_views(_CHAIN, _CLIPPED + """, t AS (SELECT chain_id id, 'exons' track, t_start s, t_end e FROM chain_blocks UNION ALL SELECT id, 'cds', s, e FROM cds UNION ALL SELECT id, 'body', start, "end" FROM bl
        UNION ALL SELECT id, 'flanks', greatest(start-10000,1), "end"+10000 FROM bl) SELECT id, track, count(*) n_blocks, min(s) s, max(e) e, sum(e-s)::BIGINT bases FROM t GROUP BY 1,2"""),
    "gene_sizes": with_views(_CHAIN, _CLIPPED + """, c AS (SELECT id, sum(e-s) n FROM cds GROUP BY 1), x AS (SELECT chain_id id, count(*) n, sum(t_end-t_start) b FROM chain_blocks GROUP BY 1)
        SELECT id, "end"-start gene_len, x.n n_exons, coalesce(c.n,0)::BIGINT cds_bases, ("end"-start-b)::BIGINT intron_bases FROM bl JOIN x USING (id) LEFT JOIN c USING (id)"""),
    "gene_rejects": with_views(_CHAIN, _CLIPPED + """, c AS (SELECT id, sum(e-s) n FROM cds GROUP BY 1), r AS (SELECT id, CASE WHEN a>=z THEN 'no coding part' WHEN c.n IS NULL THEN 'no coding blocks' WHEN c.n%3<>0 THEN 'out of frame' END reason
        FROM bl LEFT JOIN c USING (id)) SELECT * FROM r WHERE reason IS NOT NULL"""),
    "coding_exon_sizes": with_views(_CHAIN, _CLIPPED + " SELECT id, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN strand='-' THEN -s ELSE s END, CASE WHEN strand='-' THEN -e ELSE e END) exon, e-s AS size FROM cds"),
    "run_detection": with_views("chain_blocks_raw", """, g AS (SELECT chain_id, block_no, block_no - row_number() OVER (PARTITION BY chain_id ORDER BY block_no) i FROM chain_blocks_raw WHERE size%3<>0)
        SELECT chain_id, min(block_no) AS "first", max(block_no) AS "last", count(*) length FROM g GROUP BY chain_id, i HAVING count(*)>=2"""),
    "bridged_exons": with_views("chain_blocks_raw", """, g AS (SELECT chain_id, block_no, CASE WHEN size%5=0 THEN 'M' WHEN size%3=0 THEN 'I' ELSE 'D' END st FROM chain_blocks_raw),
        n AS (SELECT chain_id, block_no, st, lag(block_no) OVER w lb, lag(st) OVER w ls FROM g WHERE st<>'D' WINDOW w AS (PARTITION BY chain_id ORDER BY block_no))
        SELECT chain_id, lb left_exon, block_no right_exon FROM n WHERE st='I' AND ls='I' AND block_no-lb>1"""),
    "prefix_sums": with_views("chain_blocks_raw", """SELECT chain_id, block_no, size, coalesce(sum(size) OVER (PARTITION BY chain_id ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)::BIGINT AS "before" FROM chain_blocks_raw"""),
    "label_clusters": with_views("iv_a", """, g AS (SELECT k, s, CASE WHEN s - lag(s) OVER (PARTITION BY k ORDER BY s) > 600 OR lag(s) OVER (PARTITION BY k ORDER BY s) IS NULL THEN 1 ELSE 0 END f FROM iv_a),
        n AS (SELECT k, s, sum(f) OVER (PARTITION BY k ORDER BY s) c FROM g) SELECT k, c::BIGINT AS cluster, min(s) AS "first", max(s) AS "last", count(*) n_members FROM n GROUP BY 1,2"""),
    "falling_runs": with_views("chain_blocks_raw", """, g AS (SELECT chain_id, block_no, size, CASE WHEN size <= lag(size) OVER (PARTITION BY chain_id ORDER BY block_no) THEN 1 ELSE 0 END f FROM chain_blocks_raw)
        SELECT chain_id, block_no, size, (sum(f) OVER (PARTITION BY chain_id ORDER BY block_no))::BIGINT part FROM g"""),
    "top_blocks": with_views("chain_blocks_raw", "SELECT * FROM (SELECT chain_id, block_no, size, row_number() OVER (PARTITION BY chain_id ORDER BY size DESC, block_no) AS rank FROM chain_blocks_raw) WHERE rank<=2"),
    "chain_features": with_views("iv_a iv_b", _ISLANDS.format(op=">=", src="iv_b") + """, tr AS (
        SELECT k, id, 'exons' t, s, s+(e-s)//3 e FROM iv_a UNION ALL SELECT k, id, 'exons', e-(e-s)//3, e FROM iv_a UNION ALL SELECT k, id, 'cds', s+5, s+(e-s)//3 FROM iv_a
        UNION ALL SELECT k, id, 'cds', e-(e-s)//3, e-5 FROM iv_a UNION ALL SELECT k, id, 'body', s, e FROM iv_a UNION ALL SELECT k, id, 'flanks', s-1000, e+1000 FROM iv_a),
        c AS (SELECT tr.k, id, coalesce(sum(least(tr.e,m.e)-greatest(tr.s,m.s)) FILTER (WHERE t='exons'),0) ex, coalesce(sum(least(tr.e,m.e)-greatest(tr.s,m.s)) FILTER (WHERE t='cds'),0) cds,
          count(DISTINCT CASE WHEN t='cds' THEN tr.s END) hits FROM tr JOIN merged m ON tr.k=m.k AND tr.s<m.e AND m.s<tr.e GROUP BY 1,2),
        p AS (SELECT k, count(*) FILTER (WHERE cds>0) synteny, sum(cds) chain_cds, sum(ex-cds) utr, max(hits) most FROM c GROUP BY 1),
        q AS (SELECT k, sum(e-s) block_bases, max(e)-min(s) q_len FROM merged GROUP BY 1)
        SELECT k chain_id, block_bases::BIGINT block_bases, q_len, synteny, chain_cds::BIGINT chain_cds, round(chain_cds/block_bases, 9)::DOUBLE global_exo,
          round(CASE WHEN most>1 AND q_len-utr<>0 THEN chain_cds/(q_len-utr) ELSE 0 END, 9)::DOUBLE exlen_to_qlen FROM q JOIN p USING (k)"""),
    "exon_classes": with_views(_CHAIN, f""", {_REGIONS}, f AS (SELECT r.chain_id, s, e, min(t_start) lo, max(t_end) hi, bool_or(t_start<=s AND s<t_end) a, bool_or(t_start<=e-1 AND e-1<t_end) z, bool_or(t_start<e AND s<t_end) y
        FROM regions r JOIN chain_blocks USING (chain_id) WHERE region=1 GROUP BY 1,2,3) SELECT chain_id, CASE WHEN s<lo OR e>hi THEN 'M' WHEN a AND z THEN 'A' WHEN NOT y THEN 'C' ELSE 'B' END exon_class FROM f"""),
}

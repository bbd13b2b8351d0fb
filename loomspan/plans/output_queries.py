"""Queries on aligned exons' places and on an aligner's records, written as text and read back, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators import aligner_output, placing
from loomspan.plans import relation_queries, views
from loomspan.plans.views import with_views
from loomspan.session import scratch


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exons of each document's alignment with the next one, with introns behind columns 25 and 70."""

    def parted(name: str, first: str, second: str) -> Column:
        return F.concat(F.substring(name, 1, 25), F.lit(first), F.substring(name, 26, 45), F.lit(second), F.substring(name, 71, 1 << 30)).alias(name)

    pairs = relation_queries._aligned(spark, sf_dir).select("doc_id", parted("ref", "    ", "    "), parted("query", "gtag", "gcag"))
    return placing.exon_spans(pairs, "doc_id")


def placed_exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exons in the genome, every second locus being inverted."""
    start = F.col("doc_id") * 1000
    loci = views.read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("c"), F.col("doc_id") % 7).alias("chrom"), start.alias("start"), (start + 100_000).alias("end"), (F.col("doc_id") % 2 == 0).alias("forward"))
    found = placing.place_exons(_spans(spark, sf_dir), loci, "doc_id")
    return found.select("doc_id", "exon", "chrom", "s", "e", "strand", F.md5("ref_seq").alias("ref"), F.md5("que_seq").alias("query"))


def _fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = F.posexplode(F.array(*map(F.lit, (20, 40, 100_000)))).alias("nth", "size")
    rows = views.read(spark, sf_dir, "documents").select("doc_id", sizes)
    start = (F.col("nth") + 1) * 500
    return rows.select(
        "doc_id", "nth", (F.col("doc_id") * 10 + F.col("nth")).alias("chain_id"), F.concat(F.lit("c"), (F.col("doc_id") + F.col("nth")) % 7).alias("chrom"), start.cast("long").alias("start"), (start + F.col("size")).cast("long").alias("end"),
        ((F.col("doc_id") + F.col("nth")) % 2 == 0).alias("forward"), F.when(F.col("nth") < 2, 2000).otherwise(F.when(F.col("doc_id") % 3 == 0, 2500).otherwise(200_000)).cast("long").alias("chrom_size"),
    )


def fragment_exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exons of sequences joined from three fragments each, by their first base."""
    found = placing.place_on_fragments(_spans(spark, sf_dir), _fragments(spark, sf_dir), "doc_id")
    return found.select("doc_id", "exon", "chain_id", "chrom", "s", "e", "strand")


def fragment_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same exons, cut at the borders of fragments."""
    found = placing.place_on_fragments(_spans(spark, sf_dir), _fragments(spark, sf_dir), "doc_id", split=True)
    return found.select("doc_id", "exon", "chain_id", "n_bases", "chrom", "s", "e", "strand")


def clashing_exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views of a user that begin before an earlier one has ended, as exons of a joined projection."""
    rows = views.iv_a(spark, sf_dir).select("k", F.col("id").alias("exon"), F.lit("c").alias("chrom"), "s", "e")
    return placing.clashing_exons(rows, "k").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("exon").alias("first"))


def _records(spark: SparkSession, sf_dir: str) -> str:
    """The path of a file with a section for each order: its line items are exons."""
    rows = views.chain_blocks_raw(spark, sf_dir)
    name, exon = F.concat(F.lit("t"), "chain_id"), (F.col("block_no") - 1).cast("string")
    chain = F.when(F.col("chain_id") % 5 == 0, -1).otherwise(1 + F.col("dt") % 2).cast("string")
    a = F.col("dq") * 1000 + F.col("block_no") * 100
    b = a + F.col("size") * 3
    places = F.when(F.col("chain_id") % 2 == 0, F.concat(a.cast("string"), F.lit("-"), b.cast("string"))).otherwise(F.concat(b.cast("string"), F.lit("-"), a.cast("string")))
    region = F.when(F.col("size") % 11 == 0, "N/A").otherwise(F.concat(F.lit("c"), (F.col("dt") % 3).cast("string"), F.lit(":"), places))
    kind = F.element_at(F.array(*map(F.lit, ["A", "A+", "B", "C", "M"])), (F.col("size") % 5 + 1).cast("int"))
    score = F.when(F.col("size") % 13 == 0, "much").otherwise(((F.col("dq") * 7) % 80).cast("string"))
    fields = [name, exon, chain, region, ((F.col("dt") * 6) % 100).cast("string"), score, F.lit("OK"), kind, F.lit("exp:1-2"), F.when(F.col("size") % 2 == 0, "INC").otherwise("EXCL"), F.lit("False"), F.lit("query_exon")]
    short = F.when(F.col("size") % 17 == 0, F.concat_ws(" | ", *fields[1:])).otherwise(F.concat_ws(" | ", *fields))
    times = (F.col("size") % 4 + 1).cast("int")
    entry = F.concat(F.lit(">"), F.concat_ws(" | ", name, exon, chain, F.lit("reference_exon")), F.lit("\n"), F.repeat(F.lit("AC-"), times), F.lit("\n>"), short, F.lit("\n"), F.repeat(F.lit("A-T"), times), F.lit("\n"))
    sections = rows.groupBy("chain_id").agg(F.concat_ws("", F.array_sort(F.collect_list(entry))).alias("body"))
    more = F.when(F.col("chain_id") % 7 == 0, ">what\nAC\n").otherwise("")
    extra = F.concat(F.lit(">"), F.concat_ws(" | ", F.concat(name, F.lit(".1")), F.lit("PROT"), F.lit("QUERY")), F.lit("\nMK*\n! a remark\n>"), F.concat_ws(" | ", F.concat(name, F.lit(".1")), F.lit("CODON"), F.lit("QUERY")), F.lit("\nATG AAA TAA\n"))
    path = f"{scratch(spark)}/aligner-{uuid.uuid4().hex}"
    sections.select(F.concat(F.lit("#"), name, F.lit("\n"), F.when(F.col("chain_id") % 9 == 0, "stray words\n").otherwise(""), extra, more, F.col("body")).alias("value")).write.option("compression", "gzip").text(path)
    return path


def _annotation(spark: SparkSession, sf_dir: str, reused: bool = False) -> aligner_output.Annotation:
    excluded = views.read(spark, sf_dir, "orders").where("o_orderkey % 8 = 3").select(F.concat(F.lit("t"), "o_orderkey").alias("transcript"))
    return aligner_output.annotate_output(aligner_output.read_sections(spark, _records(spark, sf_dir)), excluded, reused)


def output_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _annotation(spark, sf_dir).tracks
    return found.select("name", "chrom", "strand", "part", "start", "end", F.size("blocks").cast("long").alias("n_blocks"), F.concat_ws(",", F.transform("exons", lambda x: x.cast("string"))).alias("exons"))


def output_exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _annotation(spark, sf_dir).exons.select("transcript", F.col("exon").cast("long").alias("exon"), "chain", "region", "included", "identity", "score", "class", "mark")


def output_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _annotation(spark, sf_dir).removed


def output_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _annotation(spark, sf_dir).sequences


def output_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proteins and codons, and the fragments that joined projections take."""
    found = _annotation(spark, sf_dir)
    lines = aligner_output.fragment_lines(found.tracks).select(F.concat_ws(":", "name", "chrom", F.col("start").cast("string")).alias("header"), F.format_string("%d-%d", "first_exon", "last_exon").alias("seq"))
    return found.proteins.unionByName(found.codons).unionByName(lines)


def output_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projections that were skipped and entries that were rejected, by reason."""
    found = _annotation(spark, sf_dir, reused=True)
    rows = found.skipped.select("name", "reason").unionByName(found.rejects.select(F.col("transcript").alias("name"), "reason"))
    return rows.groupBy("name", "reason").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (placed_exons, fragment_exons, fragment_pieces, clashing_exons, output_tracks, output_exons, output_removed, output_sequences, output_entries, output_skipped)}

_SPANS = f""", {relation_queries._ALIGNED},
 sp AS (SELECT doc_id, substr(ref,1,25)||'    '||substr(ref,26,45)||'    '||substr(ref,71) ref, substr(que,1,25)||'gtag'||substr(que,26,45)||'gcag'||substr(que,71) que FROM al),
 cz AS (SELECT doc_id, unnest(range(1,length(ref)+1)) i, unnest(string_split(ref,'')) t, unnest(string_split(que,'')) q FROM sp),
 c0 AS (SELECT *, CASE WHEN i<=25 THEN 0 WHEN i<=74 THEN 1 ELSE 2 END exon, (sum((q<>'-')::INT) OVER (PARTITION BY doc_id ORDER BY i)-1)::BIGINT co FROM cz),
 es AS (SELECT doc_id, exon, min(CASE WHEN q<>'-' THEN co END) fa, count(*) FILTER (WHERE q<>'-') nb, string_agg(t,'' ORDER BY i) ref_seq, string_agg(q,'' ORDER BY i) que_seq FROM c0 WHERE t<>' ' GROUP BY 1,2),
 fg AS (SELECT doc_id, nth, doc_id*10+nth chain_id, 'c'||((doc_id+nth)%7) chrom, (nth+1)*500 st, (nth+1)*500+z en, (doc_id+nth)%2=0 fw, CASE WHEN nth<2 THEN 2000 WHEN doc_id%3=0 THEN 2500 ELSE 200000 END cs, b, b+z d
   FROM documents, (VALUES (0,20,0),(1,40,20),(2,100000,60)) v(nth,z,b))"""


def _in_fragment(touched: str, first: str, bases: str) -> str:
    return f""", ft AS (SELECT es.doc_id, exon, chain_id, chrom, fw, cs, {bases} nb, CASE WHEN fw THEN st+{first}-b ELSE en-({first}-b)-({bases}) END s, CASE WHEN fw THEN st+{first}-b+({bases}) ELSE en-({first}-b) END e FROM es LEFT JOIN fg ON fg.doc_id=es.doc_id AND {touched}),
     fx AS (SELECT *, coalesce(s>0 AND e<=cs, false) ok FROM ft)"""


_FX = "CASE WHEN ok THEN chrom END chrom, CASE WHEN ok THEN s END s, CASE WHEN ok THEN e END e, CASE WHEN ok THEN CASE WHEN fw THEN '+' ELSE '-' END END strand FROM fx"

_OUTPUT = """, r0 AS (SELECT 't'||chain_id transcript, chain_id, block_no-1 exon, CASE WHEN chain_id%5=0 THEN -1 ELSE 1+dt%2 END ch, size, dq*1000+block_no*100 a, dq*1000+block_no*100+size*3 b, CASE WHEN size%11=0 THEN NULL ELSE 'c'||(dt%3) END chrom,
    CASE WHEN chain_id%2=0 THEN '+' ELSE '-' END strand, (dt*6)%100 pid, (dq*7)%80 bl, ['A','A+','B','C','M'][size%5+1] k, size%2=0 inc, size%4+1 n FROM chain_blocks_raw WHERE chain_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey%8=3)),
   rf AS (SELECT *, transcript||'.'||ch projection FROM r0),
   qx AS (SELECT *, CASE WHEN k IN ('A','A+','B') AND inc THEN CASE WHEN pid>65 AND bl>40 THEN 'HQ' ELSE 'AQ' END WHEN (k IN ('A','A+','B') AND NOT inc) OR (k='C' AND inc) THEN CASE WHEN pid>65 AND bl>40 THEN 'AQ' WHEN pid>45 AND bl>25 THEN 'LQ' END END mark
     FROM rf WHERE size%17<>0 AND size%13<>0),
   kp AS (SELECT * FROM qx WHERE mark IS NOT NULL AND chrom IS NOT NULL),
   f0 AS (SELECT *, CASE WHEN ch=-1 AND w<=lag(w) OVER (PARTITION BY projection, chrom, strand ORDER BY exon) THEN 1 ELSE 0 END c FROM (SELECT *, CASE WHEN strand='-' THEN -a ELSE a END w FROM kp)),
   f1 AS (SELECT *, sum(c) OVER (PARTITION BY projection, chrom, strand ORDER BY exon) part FROM f0),
   tr AS (SELECT projection AS name, chrom, strand, part::BIGINT part, min(a) "start", max(b) "end", count(*) n_blocks, string_agg((exon+1)::VARCHAR, ',' ORDER BY exon) exons, min(exon)+1 xf, max(exon)+1 xl FROM f1 GROUP BY 1,2,3,4)"""


def _output(body: str) -> str:
    return with_views("chain_blocks_raw", _OUTPUT + body)


SQL = {
    "placed_exons": with_views("dna", _SPANS + """ SELECT doc_id, exon::BIGINT exon, CASE WHEN fa IS NOT NULL THEN 'c'||(doc_id%7) END chrom, CASE WHEN doc_id%2=0 THEN doc_id*1000+fa ELSE doc_id*1000+100000-fa-CASE WHEN fa IS NOT NULL THEN nb END END s,
        CASE WHEN doc_id%2=0 THEN doc_id*1000+fa+nb ELSE doc_id*1000+100000-fa END e, CASE WHEN fa IS NOT NULL THEN CASE WHEN doc_id%2=0 THEN '+' ELSE '-' END END strand, md5(ref_seq) AS ref, md5(que_seq) AS query FROM es"""),
    "fragment_exons": with_views("dna", _SPANS + _in_fragment("fa>=b AND fa<d", "fa", "nb") + f" SELECT doc_id, exon::BIGINT exon, chain_id, {_FX}"),
    "fragment_pieces": with_views("dna", _SPANS + _in_fragment("fa<d AND fa+nb>b", "greatest(fa,b)", "coalesce(least(fa+nb,d)-greatest(fa,b), nb)") + f" SELECT doc_id, exon::BIGINT exon, chain_id, nb n_bases, {_FX}"),
    "clashing_exons": with_views("iv_a", """, o AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) l FROM iv_a) SELECT k, count(*) n, min(id) AS "first" FROM o WHERE s<l GROUP BY 1"""),
    "output_tracks": _output(' SELECT name, chrom, strand, part, "start", "end", n_blocks, exons FROM tr'),
    "output_exons": _output(""" SELECT transcript, exon, ch AS "chain", CASE WHEN chrom IS NULL THEN 'N/A' WHEN strand='+' THEN chrom||':'||a||'-'||b ELSE chrom||':'||b||'-'||a END region, CASE WHEN inc THEN 'INC' ELSE 'EXCL' END included, pid::DOUBLE AS identity, bl::DOUBLE score, k AS "class", coalesce(mark,'NA') mark FROM qx"""),
    "output_removed": _output(" SELECT chrom, a s, b e, transcript||'.'||exon||'.'||ch AS name, pid*10 score FROM qx WHERE mark IS NULL AND chrom IS NOT NULL"),
    "output_sequences": _output(""" SELECT rf.projection, string_agg(CASE WHEN qx.mark IS NULL THEN repeat('AC', rf.n::INT) ELSE repeat('AC-', rf.n::INT) END, '' ORDER BY rf.exon) AS ref, string_agg(CASE WHEN qx.mark IS NULL THEN repeat('--', rf.n::INT) ELSE repeat('A-T', rf.n::INT) END, '' ORDER BY rf.exon) AS query
        FROM rf LEFT JOIN qx ON qx.projection=rf.projection AND qx.exon=rf.exon WHERE rf.projection IN (SELECT projection FROM qx WHERE mark IS NOT NULL) GROUP BY 1"""),
    "output_entries": _output(""", t AS (SELECT DISTINCT transcript FROM r0) SELECT transcript||'.1 | PROT | QUERY' AS header, 'MK*' AS seq FROM t UNION ALL SELECT transcript||'.1 | CODON | QUERY', 'ATG AAA TAA' FROM t UNION ALL SELECT name||':'||chrom||':'||"start", xf||'-'||xl FROM tr WHERE ends_with(name,'.-1')"""),
    "output_skipped": _output(""", w AS (SELECT 't'||l_orderkey AS name, 'excluded' reason FROM lineitem WHERE l_orderkey%8=3 GROUP BY 1 UNION ALL SELECT projection, 'all exons are deleted' FROM qx GROUP BY 1 HAVING count(*) FILTER (WHERE mark IS NOT NULL AND chrom IS NOT NULL)=0
        UNION ALL SELECT transcript, CASE WHEN size%17=0 THEN 'wrong number of fields' ELSE 'score is no number' END FROM r0 WHERE size%17=0 OR size%13=0 UNION ALL SELECT DISTINCT transcript, 'unknown kind of entry' FROM r0 WHERE chain_id%7=0
        UNION ALL SELECT DISTINCT transcript, 'text before the first entry' FROM r0 WHERE chain_id%9=0) SELECT name, reason, count(*) n FROM w GROUP BY 1,2"""),
}

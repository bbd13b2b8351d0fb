"""Queries on classes, losses, orthology, sequences and codons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions import sequences
from loomspan.operators import aligned, classify, genome, loss, mutations, orthology, projections, resources, runs, stitch
from loomspan.plans import views
from loomspan.plans.views import with_views


def _chain_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chain features from line items, with a model's score in hundredths."""
    l = views.read(spark, sf_dir, "lineitem")  # noqa: E741
    grouped = l.groupBy(F.col("l_partkey").alias("gene"), F.col("l_suppkey").alias("chain_id")).agg(F.sum(F.col("l_quantity").cast("long")).alias("q"), F.min("l_linenumber").cast("long").alias("n"))
    return grouped.select(
        "gene", "chain_id",
        (F.col("q") % 4 * 100).alias("exon_cover"), (F.col("n") % 3).alias("synt"), (F.col("gene") % 5 + 1).alias("ex_num"), F.lit(400).cast("long").alias("ex_fract"),
        ((F.col("q") % 50 + 50) / 100).alias("exon_qlen"), ((F.col("q") * 7 + F.col("n")) % 100 / 100).alias("score"),
    )


_TABLE = """t AS (SELECT gene, chain_id, q%4*100 exon_cover, n%3 synt, gene%5+1 ex_num, 400 ex_fract, (q%50+50)/100 exon_qlen, ((q*7+n)%100)/100 score
 FROM (SELECT l_partkey gene, l_suppkey chain_id, sum(l_quantity::BIGINT)::BIGINT q, min(l_linenumber) n FROM lineitem GROUP BY 1,2)),
 c AS (SELECT *, CASE WHEN exon_cover=0 AND synt>1 THEN -1.0 WHEN ex_num>1 AND synt=1 AND exon_qlen>0.95 AND score<0.5 AND exon_cover/ex_fract>0.65 THEN -2.0 ELSE score END::DOUBLE pred
   FROM t WHERE (exon_cover=0 AND synt>1) OR (exon_cover>0 AND synt>0)),
 d AS (SELECT *, CASE WHEN pred=-1 THEN 'SPAN' WHEN pred=-2 THEN 'P_PGENES' WHEN pred<0.5 THEN 'PARA' ELSE 'ORTH' END chain_class FROM c)"""


def chain_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.classify_chains(_chain_table(spark, sf_dir)).select("gene", "chain_id", F.round("pred", 4).alias("pred"), "chain_class")


def class_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.class_lists(classify.classify_chains(_chain_table(spark, sf_dir)))


def choose_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.choose_chains(classify.classify_chains(_chain_table(spark, sf_dir)), limit=3)


def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = views.read(spark, sf_dir, "lineitem")  # noqa: E741
    pairs = l.groupBy(F.col("l_suppkey").alias("chain_id"), F.col("l_partkey").alias("transcript")).agg(F.sum(F.col("l_quantity").cast("long") % 7).alias("cds"))
    chains = views.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("chain_id"), F.round("s_acctbal").cast("long").alias("gl_score"))
    parts = views.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("transcript"), F.col("p_size").cast("long").alias("gene_len"))
    isoforms = parts.where("transcript % 11 <> 0").select(F.col("transcript"), (F.col("transcript") % 100).cast("string").alias("gene"))
    return classify.feature_table(pairs, chains, parts, isoforms)


def projection_fate(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity").cast("long")
    rows = views.read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), F.when(q % 3 == 0, "SPAN").otherwise("ORTH").alias("chain_class"), (q * 10).alias("t_len"), (F.col("l_partkey") % 60 * q * 12).alias("q_len"), (q * 300).alias("cds_len"), (q % 2 == 0).alias("has_gap")
    )
    return classify.projection_fate(rows).groupBy("id", "n", "fate").count()


def training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = feature_table(spark, sf_dir).withColumn("exon_perc", F.col("cds") / 20)
    sizes = views.read(spark, sf_dir, "part").select((F.col("p_partkey") % 700).alias("gene"), F.col("p_partkey").alias("transcript"), F.col("p_size").cast("long").alias("size"))
    one2one = sizes.where("gene % 2 = 0").select("gene").distinct()
    return classify.training_set(table.drop("gene"), one2one, sizes).select("gene", "transcript", "chain_id", F.col("y").cast("long").alias("y"))


def longest_isoform(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = views.read(spark, sf_dir, "part").select((F.col("p_partkey") % 300).alias("gene"), F.col("p_partkey").alias("transcript"), F.col("p_size").cast("long").alias("size"))
    return runs.top_rows(parts, ["gene"], [F.col("size").desc(), "transcript"], 1).drop("rank")


def gbt_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees on chain features, trained and applied; labels from the features, so accuracy is known."""
    table = _chain_table(spark, sf_dir).withColumn("y", (F.col("exon_cover") * F.col("exon_qlen") > 150).cast("int"))
    names = ["exon_cover", "synt", "ex_num", "exon_qlen"]
    model = classify.train_classifier(table.where("chain_id % 5 <> 0"), names, trees=10)
    return classify.predict(model, table, "p").select("gene", "chain_id", "y", F.round("p", 6).alias("p"))


def _loss_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = views.read(spark, sf_dir, "lineitem")  # noqa: E741
    g = l.groupBy(F.col("l_orderkey").alias("projection")).agg(F.sum(F.col("l_quantity").cast("long")).alias("q"), F.count(F.lit(1)).alias("exons"), F.sum("l_partkey").alias("p"), F.sum("l_suppkey").alias("s"))
    mod = lambda c, n: F.col(c) % n
    return g.select(
        "projection", (mod("q", 23) == 0).alias("is_paralog"), "exons", mod("p", 4).alias("effective"), (mod("p", 100) / 100).alias("ignore_m"), (mod("s", 100) / 100).alias("intact_m"), (mod("q", 100) / 100).alias("codons"),
        (mod("p", 97) / 97).alias("out_of_chain"), (mod("s", 19) == 0).alias("all_missing"), (mod("s", 17) == 0).alias("all_deleted"), (mod("s", 2) == 0).alias("any_missing"), (mod("q", 10) / 10).alias("missing_share"),
        (mod("p", 3) == 0).alias("middle_intact"), (mod("q", 2) == 0).alias("middle_present"), (mod("s", 5) == 0).alias("single_deleted"), (mod("s", 7) == 0).alias("single_missing"), mod("p", 5).alias("affected"),
        (mod("q", 7) == 0).alias("big_exon_two"), (mod("q", 5) == 0).alias("big_exon_deleted"),
    )


_LOSS = """g AS (SELECT l_orderkey projection, sum(l_quantity::BIGINT)::BIGINT q, count(*) exons, sum(l_partkey)::BIGINT p, sum(l_suppkey)::BIGINT s FROM lineitem GROUP BY 1),
 f AS (SELECT *, CASE WHEN p%97/97>0.5 THEN 'PM' ELSE 'M' END gone FROM g),
 losses AS (SELECT projection, CASE WHEN q%23=0 THEN 'PG' WHEN exons=0 THEN 'N' WHEN p%4=0 AND p%100/100>0.6 THEN 'I'
   WHEN q%100/100<0.35 THEN CASE WHEN p%97/97>0.65 THEN 'M' ELSE 'L' END WHEN s%19=0 THEN gone WHEN s%17=0 THEN 'L' WHEN s%100/100<0.2 THEN 'L'
   WHEN p%3=0 THEN CASE WHEN q%100/100<0.49 THEN 'UL' WHEN s%2<>0 THEN 'I' WHEN q%2=0 THEN 'I' WHEN q%10/10<0.5 THEN 'PI' ELSE gone END
   WHEN exons=1 THEN CASE WHEN s%5=0 THEN 'L' WHEN s%7=0 THEN gone WHEN p%100/100<0.6 AND p%4>=2 THEN 'L' ELSE 'UL' END
   WHEN s%100/100<0.6 THEN CASE WHEN p%5 >= CASE WHEN exons<=10 THEN 2.0 ELSE exons/5 END THEN 'L' WHEN q%7=0 THEN 'L' WHEN q%5=0 THEN 'L' ELSE 'UL' END
   WHEN p%97/97>0.5 THEN 'PM' ELSE 'UL' END AS loss FROM f)"""


def loss_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loss.loss_class(_loss_rows(spark, sf_dir)).select("projection", "loss")


def loss_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = loss_tree(spark, sf_dir).select(F.concat(F.lit("p"), "projection").alias("projection"), F.concat(F.lit("t"), F.expr("projection div 20")).alias("transcript"), "loss")
    isoforms = found.select("transcript").distinct().select((F.substring("transcript", 2, 20).cast("long") % 150).cast("string").alias("gene"), "transcript")
    given = isoforms.where("transcript LIKE 't%7'").select(F.lit("TRANSCRIPT").alias("level"), F.col("transcript").alias("id"), F.lit("M").alias("class"))
    return loss.roll_up(found, isoforms, given)


def loss_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loss_tree(spark, sf_dir).select("projection", loss.colour_of(F.col("loss")).alias("item_rgb"))


def intact_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", "IIIIIIIDIIIIIIIIIIIIMLIIII")
    rows = loss.intact_features(views.read(spark, sf_dir, "documents").select("doc_id", states.alias("states")).where("length(states) > 0"))
    shares = [F.round(c, 9).alias(c) for c in ("intact_ignore_m", "intact_intact_m", "intact_codons")]
    return rows.select("doc_id", *shares, "middle_is_intact", "middle_is_present")


def confidence_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = views.read(spark, sf_dir, "lineitem")  # noqa: E741
    q = F.col("l_quantity").cast("long")
    marks = l.select(F.col("l_orderkey").alias("projection"), F.when(q % 20 == 0, "LQ").when(q % 19 == 0, "NA").when(q % 3 == 0, "AQ").otherwise("HQ").alias("mark"))
    scores = views.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("projection"), (F.col("o_custkey") % 100 / 100).alias("score"))
    return loss.confidence(marks, scores, 0.5)


def exon_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity").cast("long")
    kind = F.element_at(F.array(*map(F.lit, ["A", "A+", "B", "C", "M"])), (q % 5 + 1).cast("int"))
    mark = loss.exon_mark(kind, q % 2 == 0, F.col("l_partkey") % 100, F.col("l_suppkey") % 80)
    return views.read(spark, sf_dir, "lineitem").select(mark.alias("mark"), kind.alias("kind")).groupBy("kind", "mark").count()


_STATUSES = ["I", "PI", "UL", "L", "M", "PM", "PG", "N", "abs"]


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.status(spark, sf_dir).select("item", "assembly", loss.label_of(F.col("rank")).alias("status"))


_STATUS = "s AS (SELECT item, assembly, ['N','PG','PM','M','L','UL','PI','I'][rank+2] AS status FROM status)"


def precedence_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loss.precedence(_status(spark, sf_dir), _STATUSES)


def assembly_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loss.assembly_counts(_status(spark, sf_dir), _STATUSES[:-1])


def status_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = _status(spark, sf_dir).groupBy("item", "assembly").agg(F.max("status").alias("status"))
    return loss.status_matrix(one, ["FRANCE", "GERMANY", "JAPAN"])


def edge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orthology.edge_scores(views.edge_scores(spark, sf_dir))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orthology.with_components(orthology.edge_scores(views.edge_scores(spark, sf_dir)))


def edge_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).select("r_gene", "q_gene", "component")


def component_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orthology.component_classes(_edges(spark, sf_dir))


def strong_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.read(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 300).cast("string").alias("r_gene"), (F.col("l_suppkey") % 50).cast("string").alias("q_gene")).distinct()
    return orthology.strong_pairs(rows, 30)


def orphan_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    genes = views.read(spark, sf_dir, "part").select(F.concat(F.lit("P"), "p_partkey").alias("r_gene"))
    return orthology.orphans(genes, views.edge_scores(spark, sf_dir))


def leaf_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Scores in the range of a classifier's, so that the comparisons of scores decide both ways.
    rows = views.edge_scores(spark, sf_dir).withColumn("score", (F.col("score") * 7 + F.substring("q_gene", 2, 9).cast("long") % 5) / 75)
    found = orthology.split_many2many(orthology.with_components(orthology.edge_scores(rows)))
    return found.select("r_gene", "q_gene", "component")


def orthology_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    genes = views.read(spark, sf_dir, "part").select(F.concat(F.lit("P"), "p_partkey").alias("r_gene"))
    rows = views.edge_scores(spark, sf_dir).withColumn("score", F.col("score") / 10)
    return orthology.orthology_types(genes, rows)


def query_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    exons = views.iv_a(spark, sf_dir).select(F.col("k").alias("chrom"), F.when(F.col("id") % 2 == 0, "+").otherwise("-").alias("strand"), "s", "e", F.col("id").alias("name"))
    return orthology.genes_of_overlaps(exons).groupBy("gene", "chrom", "strand", "s", "e").agg(F.count(F.lit(1)).alias("n_members"))


def stitch_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of users' sessions: views as exons, purchases as chains, users as transcripts."""
    a, b = views.iv_a(spark, sf_dir), views.iv_b(spark, sf_dir)
    exons = a.select(F.col("k").alias("transcript"), F.lit("c").alias("chrom"), F.col("id").alias("exon"), (F.col("k") * 1_000_000 + F.col("s")).alias("s"), (F.col("k") * 1_000_000 + F.col("e")).alias("e"))
    chains = b.select(F.col("id").alias("chain_id"), F.lit("c").alias("chrom"), (F.col("k") * 1_000_000 + F.col("s")).alias("s"), (F.col("k") * 1_000_000 + F.col("e")).alias("e"))
    scores = b.select(F.col("k").alias("transcript"), F.col("id").alias("chain_id"), ((F.col("id") % 50 + 50) / 100).alias("score"))
    return stitch.stitch_fragments(scores, chains, exons)


def reverse_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.dna(spark, sf_dir).select("doc_id", sequences.reverse_complement(F.col("seq")).alias("rc"))


def translate_codons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.dna(spark, sf_dir).select("doc_id", sequences.translate(F.col("seq")).alias("protein"))


def codon_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.dna(spark, sf_dir).select("doc_id", F.posexplode(sequences.codons(F.col("seq"))).alias("at", "codon"))
    return rows.groupBy("codon").agg(F.count(F.lit(1)).alias("n"), F.min("at").cast("long").alias("first_at"))


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's letters beside its next one's, with gaps for some letters and behind the shorter one's end."""
    rows = views.dna(spark, sf_dir)
    other = rows.select((F.col("doc_id") - 1).alias("doc_id"), F.regexp_replace("seq", "GG", "--").alias("query"))
    size = F.greatest(F.length("seq"), F.length("query"))
    return rows.join(other, "doc_id").select("doc_id", F.rpad(F.regexp_replace("seq", "CA", "--"), size, F.lit("-")).alias("ref"), F.rpad("query", size, F.lit("-")).alias("query"))


_ALIGNED = """d AS (SELECT doc_id, seq FROM dna),
 al AS (SELECT a.doc_id, rpad(replace(a.seq,'CA','--'), greatest(length(a.seq),length(b.seq))::INT, '-') ref, rpad(replace(b.seq,'GG','--'), greatest(length(a.seq),length(b.seq))::INT, '-') que FROM d a JOIN d b ON b.doc_id=a.doc_id+1),
 ch AS (SELECT doc_id, unnest(range(1,length(ref)+1)) i, unnest(string_split(ref,'')) r, unnest(string_split(que,'')) q FROM al)"""


def percent_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _aligned(spark, sf_dir)
    return rows.select("doc_id", F.round(sequences.identity_with_gaps(F.col("ref"), F.col("query")), 6).alias("with_gaps"), F.round(sequences.identity_of_bases(F.col("ref"), F.col("query")), 6).alias("of_bases"))


def substitution_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = {a + b: 5 if a == b else (1 if {a, b} in ({"A", "G"}, {"C", "T"}) else -4) for a in "ACGT" for b in "ACGT"}
    return _aligned(spark, sf_dir).select("doc_id", sequences.substitution_score(F.col("ref"), F.col("query"), matrix).cast("long").alias("score"))


def unknown_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.dna(spark, sf_dir).withColumn("seq", F.regexp_replace("seq", "[GT]", "N"))
    return rows.select("doc_id", F.coalesce(sequences.longest_unknown(F.col("seq")), F.lit(0)).cast("long").alias("longest"), sequences.has_gap(F.col("seq"), 5).alias("has_gap"))


def mask_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    codon = F.posexplode(sequences.codons(F.col("seq"))).alias("at", "codon")
    rows = views.dna(spark, sf_dir)
    starts = rows.select("doc_id", codon).where("codon = 'ATC'").groupBy("doc_id").agg(F.collect_list((F.col("at") + 1).cast("long")).alias("starts"))
    facts = rows.select("doc_id", F.ceil(F.length("seq") / 3).alias("n"), codon).join(starts, "doc_id", "left").withColumn("starts", F.coalesce("starts", F.array().cast("array<bigint>")))
    masked = sequences.mutation_masked((F.col("at") + 1).cast("long"), F.col("n"), F.col("starts"))
    return facts.groupBy("doc_id").agg(F.count(F.when(masked, 1)).alias("n_masked"), F.count(F.lit(1)).alias("n_codons"))


def projection_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat_ws(".", F.lit("ENST"), (F.col("l_partkey") % 9).cast("string"), F.col("l_orderkey").cast("string"))
    t, c = sequences.projection_parts(name)
    return views.read(spark, sf_dir, "lineitem").select(t.alias("transcript"), c.cast("long").alias("chain_id")).groupBy("transcript").agg(F.count(F.lit(1)).alias("n"), F.max("chain_id").alias("most"))


def codon_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    codons = mutations.codon_rows(_aligned(spark, sf_dir), "doc_id")
    return mutations.codon_mutations(codons, "doc_id").groupBy("doc_id", "mclass").agg(F.count(F.lit(1)).alias("n"), F.min("codon").alias("first_codon"))


def compensated_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    codons = mutations.codon_rows(_aligned(spark, sf_dir), "doc_id")
    shifts = mutations.codon_mutations(codons, "doc_id").where("mclass IN ('FS_INS', 'FS_DEL')").select("doc_id", "codon", "size")
    return mutations.compensations(codons, shifts, "doc_id")


def splice_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.dna(spark, sf_dir).select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("exon"), "seq")
    site = lambda off: F.substring("seq", F.greatest(F.lit(1), F.col("exon") * F.expr("length(seq) div 5") + off).cast("int"), F.lit(2))
    exons = rows.select("doc_id", "exon", F.when(F.col("exon") > 1, site(0)).alias("acceptor"), F.when(F.col("exon") < 4, site(4)).alias("donor"))
    minor = rows.where("doc_id % 3 = 0 AND exon = 2").select("doc_id", "exon", F.lit("A").alias("side"))
    return mutations.splice_mutations(exons, "doc_id", minor).groupBy("doc_id", "side").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("masked"), 1)).alias("n_masked"))


def codon_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codons of alignments with an intron of blanks after 25 columns."""
    pairs = _aligned(spark, sf_dir).select(
        "doc_id", F.concat(F.substring("ref", 1, 25), F.lit("    "), F.substring("ref", 26, 1 << 30)).alias("ref"), F.concat(F.substring("query", 1, 25), F.lit("gtag"), F.substring("query", 26, 1 << 30)).alias("query")
    )
    return aligned.codon_table(pairs, "doc_id")


def deletion_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.chain_blocks_raw(spark, sf_dir).select(F.col("chain_id"), F.col("block_no").alias("exon"), "size", F.when(F.col("dt") % 2 == 0, "D").when(F.col("dt") % 5 == 0, "M").otherwise("I").alias("state"))
    return aligned.settle_deletions(rows, "chain_id").groupBy("chain_id", "state").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bases"))


def exon_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity").cast("long")
    kind = F.element_at(F.array(*map(F.lit, ["A", "A+", "B", "C", "M"])), (q % 5 + 1).cast("int"))
    rows = views.read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"), kind.alias("class"), (q % 7 == 0).alias("in_gap"), (q % 2 == 0).alias("included"), (F.col("l_partkey") % 100).alias("identity"), (F.col("l_suppkey") % 80).alias("score"), (q % 11 == 0).alias("is_missing")
    )
    return aligned.exon_status(rows).groupBy("id", "state").count()


def memory_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = views.chain_blocks_raw(spark, sf_dir).groupBy("chain_id").agg(F.collect_list("size").alias("sizes"), F.sum("size").alias("r_len"), (F.max("dq") * 100_000).alias("q_len"))
    planned = resources.plan_jobs(jobs, 0.5, 1.3)
    return planned.select("chain_id", "gig", "fits", resources.bucket(F.col("gig"), [1, 1.5, 2]).alias("bucket"))


def species_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.dna(spark, sf_dir).select(F.expr("doc_id div 4").alias("species"), (F.col("doc_id") % 4).alias("exon"), "seq")
    return aligned.exon_alignments(rows, [0, 1, 2, 3])


def gap_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genome.gap_spans(views.dna(spark, sf_dir).withColumn("seq", F.regexp_replace("seq", "[GT]", "N")), "doc_id", least=4)


def genome_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearly all of each sequence and a short region of it, from chunks of 64 bases."""
    entries = views.dna(spark, sf_dir).where("length(seq) >= 150").select(F.col("doc_id").cast("string").alias("header"), "seq")
    spans = F.array(F.struct(F.lit(10).alias("s"), (F.length("seq") - 10).alias("e"), F.lit("+").alias("strand")), F.struct(F.lit(60).alias("s"), F.lit(70).alias("e"), F.lit("-").alias("strand")))
    regions = entries.select(F.col("header").alias("chrom"), F.explode(spans).alias("r")).select("chrom", F.col("r.s").cast("long").alias("s"), F.col("r.e").cast("long").alias("e"), "r.strand")
    return genome.fetch(genome.chunk_genome(entries, 64), regions, 64)


def masked_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genome.reference_exons(views.dna(spark, sf_dir).where("length(seq) > 0")).select("doc_id", "problem", "masked")


def split_codon_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.dna(spark, sf_dir)
    return rows.select("doc_id", genome.mark_split_codons(F.col("seq"), F.col("doc_id") % 100).alias("marked"))


def pseudogene_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = classify.classify_chains(_chain_table(spark, sf_dir)).withColumn("chain_class", F.when(F.col("score") < 0.2, "P_PGENES").otherwise("ORTH"))
    chain = F.col("s_suppkey")
    headers = views.read(spark, sf_dir, "supplier").select(
        chain.alias("chain_id"), (F.col("s_nationkey") % 5).cast("string").alias("q_name"), F.lit(100000).cast("long").alias("q_size"), F.when(chain % 2 == 0, "+").otherwise("-").alias("q_strand"),
        (chain * 37 % 9000).cast("long").alias("q_start"), (chain * 37 % 9000 + 100 + chain % 400).cast("long").alias("q_end"),
    )
    genes = views.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("gene"), F.when(F.col("p_size") % 2 == 0, "+").otherwise("-").alias("strand"))
    return projections.pseudogene_track(table, headers, genes)


def exon_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = projections.exon_scores(codon_table(spark, sf_dir), "doc_id")
    return found.select("doc_id", "exon", F.round("identity", 6).alias("identity"))


def projection_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.chain_blocks_raw(spark, sf_dir).select(
        F.col("chain_id").alias("projection"), F.col("block_no").alias("exon"), (F.col("dt") % 2).cast("string").alias("chrom"), F.when(F.col("chain_id") % 2 == 0, "+").otherwise("-").alias("strand"), (F.col("dq") * 100).alias("s"), (F.col("dq") * 100 + F.col("size")).alias("e")
    )
    return projections.projection_tracks(rows).select("name", "chrom", "strand", "part", "start", "end", F.size("blocks").cast("long").alias("n_blocks"))


def info_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = views.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("projection"), F.col("o_custkey").alias("transcript"))
    places = views.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("projection")).agg(F.min("l_partkey").alias("place")).where("place % 3 <> 0")
    regions = views.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("transcript"), F.col("c_nationkey").alias("region")).where("transcript % 4 <> 1")
    scores = orders.where("projection % 5 <> 2").select("projection", (F.col("projection") % 100 / 100).alias("score"))
    return projections.info_table(orders, places, regions, scores, loss_tree(spark, sf_dir).withColumnRenamed("loss", "class")).fillna(-1, ["place", "region"])


def chosen_orthologs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.element_at(F.array(*map(F.lit, ["one2one", "one2many", "one2zero"])), (F.col("o_orderkey") % 3 + 1).cast("int"))
    rows = views.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("species"), F.col("o_orderkey").alias("projection"), kinds.alias("orthology_class"))
    lone = projections.species_without(views.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("species")), rows)
    return projections.chosen_orthologs(rows, most_copies=8).unionByName(lone.select("species"), allowMissingColumns=True).fillna(-1, ["projection", "copies"]).fillna("none", ["orthology_class"])


def frame_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intactness of aligned frames of two exons, from codons, exon states and stops."""
    codons = codon_table(spark, sf_dir)
    exons = codons.select("doc_id", (F.col("t_exon") + 1).alias("exon")).distinct()
    state = F.element_at(F.array(*map(F.lit, ["I", "I", "D", "mD", "M", "I"])), ((F.col("doc_id") + F.col("exon") * 5) % 6 + 1).cast("int"))
    hits = codons.where(F.regexp_replace("que_codon", "-", "").isin("TAA", "TAG", "TGA"))
    found = loss.intact_features(aligned.frame_states(codons, exons.withColumn("state", state), hits, "doc_id"))
    return found.select("doc_id", "states", "middle_is_intact", "middle_is_present", F.round("intact_codons", 9).alias("intact_codons"))


def query_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = loss_tree(spark, sf_dir)
    paralogs = found.where("projection % 7 = 0").select("projection")
    return orthology.query_transcripts(found.select("projection"), paralogs, found.where("projection % 5 <> 1").withColumnRenamed("loss", "class"))


def job_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"))
    return runs.near_equal_parts(rows, ["k"], ["id"], 4).select("k", "id", F.col("part").cast("long").alias("part"))


def whole_codon_exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = aligned.whole_codon_exons(codon_table(spark, sf_dir), "doc_id")
    kind = aligned.upgraded_class(F.when(F.col("doc_id") % 2 == 0, "A").otherwise("B"), F.col("whole"), F.col("doc_id") % 3 > 0, F.col("t_exon") == 0)
    return whole.select("doc_id", "t_exon", "whole", kind.alias("kind"))


def region_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity").cast("long")
    mark = aligned.region_mark(F.col("l_partkey") % 300, F.col("l_partkey") % 300 + q, F.col("l_suppkey") % 300 + q, F.col("l_suppkey") % 300)
    return views.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), mark.alias("mark")).groupBy("id", "mark").count()


def exons_beside_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    exons = views.iv_a(spark, sf_dir).withColumnRenamed("id", "exon")
    return aligned.beside_gap(exons, views.iv_b(spark, sf_dir), ["k"]).select("k", "exon", "in_gap")


QUERIES = {
    f.__name__: f
    for f in (
        chain_class, class_lists, choose_chains, feature_table, projection_fate, training_set, longest_isoform, gbt_classify, loss_tree, loss_rollup, loss_colours, intact_features, confidence_label, exon_marks,
        precedence_merge, assembly_stats, status_matrix, edge_scores, edge_components, component_classes, strong_pairs, orphan_genes, leaf_split, orthology_type, query_genes, stitch_fragments,
        reverse_complement, translate_codons, codon_chunks, percent_identity, substitution_score, unknown_runs, mask_rule, projection_names, codon_mutations, compensated_shifts, splice_sites, codon_table, deletion_states, exon_states, memory_plan, species_alignment,
        gap_spans, genome_fetch, masked_stops, split_codon_marks, pseudogene_track, exon_scores, projection_tracks, info_table, chosen_orthologs, frame_states, query_transcripts, job_parts,
        whole_codon_exons, region_marks, exons_beside_gaps,
    )
}

_COD = """cod AS (SELECT doc_id, n, unnest(range(0, len(l))) i, unnest(l) c FROM (SELECT doc_id, length(seq) n, regexp_extract_all(seq, '.{1,3}') l FROM dna))"""
_FEATURES = """p AS (SELECT l_suppkey chain_id, l_partkey transcript, sum(l_quantity::BIGINT%7)::BIGINT cds FROM lineitem GROUP BY 1,2),
 sy AS (SELECT chain_id, count(DISTINCT CASE WHEN transcript%11<>0 THEN (transcript%100)::VARCHAR ELSE '-' END) synteny FROM p GROUP BY 1), ov AS (SELECT transcript, count(*) gene_overs FROM p GROUP BY 1),
 ft AS (SELECT transcript, p.chain_id, cds, round(s_acctbal)::BIGINT gl_score, synteny, p_size::BIGINT gene_len, gene_overs FROM p JOIN supplier ON s_suppkey=p.chain_id JOIN sy ON sy.chain_id=p.chain_id JOIN part ON p_partkey=transcript JOIN ov USING (transcript))"""
_COMPONENTS = """ed AS (SELECT r_gene, q_gene, max(score) score FROM edge_scores GROUP BY 1,2), u AS (SELECT '#R#'||r_gene x, '#Q#'||q_gene y FROM ed UNION SELECT '#Q#'||q_gene, '#R#'||r_gene FROM ed),
 walk(n, m) AS (SELECT x, x FROM u UNION SELECT walk.n, u.y FROM walk JOIN u ON u.x=walk.m), roots AS (SELECT n, min(m) component FROM walk GROUP BY 1),
 ce AS (SELECT r_gene, q_gene, score, component FROM ed JOIN roots ON n='#R#'||r_gene),
 cc AS (SELECT component, count(DISTINCT r_gene) n_ref, count(DISTINCT q_gene) n_query, count(*) n_edges FROM ce GROUP BY 1)"""
_CLASS = "CASE WHEN n_ref=1 AND n_query=1 THEN 'one2one' WHEN n_ref=1 THEN 'one2many' WHEN n_query=1 THEN 'many2one' ELSE 'many2many' END"


def _translated() -> str:
    cases = " ".join(f"WHEN '{c}' THEN '{a}'" for c, a in sequences.CODONS.items())
    return f"CASE c {cases} WHEN '---' THEN '-' ELSE 'X' END"


SQL = {
    "chain_class": f"WITH {_TABLE} SELECT gene, chain_id, round(pred,4) pred, chain_class FROM d",
    "class_lists": f"WITH {_TABLE} SELECT gene, " + ", ".join(f"coalesce(string_agg(DISTINCT chain_id::VARCHAR, ',' ORDER BY chain_id) FILTER (WHERE chain_class='{c}'),'0') {c}" for c in classify.CLASSES).replace("DISTINCT ", "") + " FROM d GROUP BY 1",
    "choose_chains": f"""WITH {_TABLE}, e AS (SELECT *, CASE chain_class WHEN 'ORTH' THEN 0 WHEN 'SPAN' THEN 1 ELSE 2 END p FROM d WHERE chain_class<>'P_PGENES'),
        b AS (SELECT *, min(p) OVER (PARTITION BY gene) m FROM e), r AS (SELECT gene, chain_id, chain_class, row_number() OVER (PARTITION BY gene ORDER BY chain_id) AS rank FROM b WHERE p=m) SELECT *, rank<=3 AS kept FROM r""",
    "feature_table": f"WITH {_FEATURES} SELECT * FROM ft",
    "projection_fate": """WITH r AS (SELECT l_orderkey id, l_linenumber n, l_quantity::BIGINT q, l_partkey p FROM lineitem), x AS (SELECT id, n, q, q*10 t, p%60*q*12 ql, q*300 c FROM r)
        SELECT id, n, CASE WHEN q%3=0 AND (abs(ql-t)/t>50 OR abs(ql-t)>1000000) THEN 'too long' WHEN ql<0.05*c AND q%2=0 THEN 'M' WHEN ql<0.05*c THEN 'L' ELSE 'project' END fate, count(*) "count" FROM x GROUP BY 1,2,3""",
    "training_set": f"""WITH {_FEATURES}, z AS (SELECT p_partkey%700 gene, p_partkey transcript, row_number() OVER (PARTITION BY p_partkey%700 ORDER BY p_size DESC, p_partkey) n FROM part),
        k AS (SELECT z.gene, ft.transcript, chain_id, count(*) OVER w c, min(chain_id) OVER w f FROM ft JOIN z ON z.transcript=ft.transcript AND n=1 AND z.gene%2=0 WHERE gene_overs<=10 AND cds/20>0.1 WINDOW w AS (PARTITION BY ft.transcript))
        SELECT gene, transcript, chain_id, (c=1)::BIGINT y FROM k WHERE c=1 OR chain_id<>f""",
    "longest_isoform": "SELECT gene, transcript, size FROM (SELECT p_partkey%300 gene, p_partkey transcript, p_size::BIGINT size, row_number() OVER (PARTITION BY p_partkey%300 ORDER BY p_size DESC, p_partkey) n FROM part) WHERE n=1",
    "loss_tree": f"WITH {_LOSS} SELECT * FROM losses",
    "loss_rollup": f"""WITH {_LOSS}, rk AS (SELECT unnest(['N','PG','PM','M','L','UL','PI','I']) c, unnest(range(-1,7)) r), p AS (SELECT 'p'||projection id, 't'||(projection//20) t, loss c FROM losses),
        t AS (SELECT t id, arg_max(c, r) c FROM p JOIN rk USING (c) GROUP BY 1), t2 AS (SELECT id, CASE WHEN id LIKE 't%7' THEN 'M' ELSE c END c FROM t),
        gn AS (SELECT (substr(id,2)::BIGINT%150)::VARCHAR id, arg_max(c, r) c FROM t2 JOIN rk USING (c) GROUP BY 1)
        SELECT 'PROJECTION' AS level, id, c AS class FROM p UNION ALL SELECT 'TRANSCRIPT', id, c FROM t2 UNION ALL SELECT 'GENE', id, c FROM gn""",
    "loss_colours": f"WITH {_LOSS} SELECT projection, CASE loss " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in loss.COLOURS.items()) + " END item_rgb FROM losses",
    "intact_features": """WITH x AS (SELECT doc_id, translate(regexp_replace(lower(text),'[^a-z]','','g'),'abcdefghijklmnopqrstuvwxyz','IIIIIIIDIIIIIIIIIIIIMLIIII') s FROM documents),
        y AS (SELECT doc_id, s, length(s) n, length(s)//10 t, replace(s,'D','') k FROM x WHERE length(s)>0)
        SELECT doc_id, round(list_max(list_transform(string_split(replace(k,'M',''),'L'), lambda v: length(v)))/n, 9)::DOUBLE intact_ignore_m, round(list_max(list_transform(string_split(replace(k,'M','I'),'L'), lambda v: length(v)))/n, 9)::DOUBLE intact_intact_m,
          round(CASE WHEN n-length(regexp_replace(s,'[^M]','','g'))=0 THEN 1.0 ELSE length(regexp_replace(s,'[^I]','','g'))/(n-length(regexp_replace(s,'[^M]','','g'))) END, 9)::DOUBLE intact_codons,
          CASE WHEN t=0 THEN true ELSE NOT contains(substr(s,1,n-t),'L') END middle_is_intact, CASE WHEN t=0 THEN true ELSE NOT contains(substr(s,t+1,n-2*t),'M') END middle_is_present FROM y""",
    "confidence_label": """WITH m AS (SELECT l_orderkey projection, CASE WHEN l_quantity::BIGINT%20=0 THEN 'LQ' WHEN l_quantity::BIGINT%19=0 THEN 'NA' WHEN l_quantity::BIGINT%3=0 THEN 'AQ' ELSE 'HQ' END mark FROM lineitem)
        SELECT projection, CASE WHEN bool_or(mark='LQ') THEN 'low_confidence' WHEN bool_or(mark='NA') THEN 'partial' WHEN bool_and(mark='HQ') AND max(coalesce(o_custkey%100/100,0))>=0.5 THEN 'high_confidence' ELSE 'average_confidence' END confidence_level
        FROM m LEFT JOIN orders ON o_orderkey=projection GROUP BY 1""",
    "exon_marks": """WITH x AS (SELECT ['A','A+','B','C','M'][l_quantity::BIGINT%5+1] kind, l_quantity::BIGINT%2=0 inc, l_partkey%100>65 AND l_suppkey%80>40 good, l_partkey%100>45 AND l_suppkey%80>25 fair FROM lineitem)
        SELECT kind, CASE WHEN kind IN ('A','A+','B') AND inc THEN CASE WHEN good THEN 'HQ' ELSE 'AQ' END WHEN (kind IN ('A','A+','B') AND NOT inc) OR (kind='C' AND inc) THEN CASE WHEN good THEN 'AQ' WHEN fair THEN 'LQ' END END mark, count(*) "count" FROM x GROUP BY 1,2""",
    "precedence_merge": with_views("status", f", {_STATUS}, o AS (SELECT unnest({_STATUSES!r}) AS status, unnest(range(9)) i) SELECT item, arg_min(s.status, i) AS status FROM s JOIN o USING (status) GROUP BY 1"),
    "assembly_stats": with_views("status", f", {_STATUS} SELECT assembly, " + ", ".join(f'count(*) FILTER (WHERE status=\'{s}\') "{s}"' for s in _STATUSES[:-1])
        + ", count(*) FILTER (WHERE status='I') intact, count(*) FILTER (WHERE status IN ('L','UL')) inactivated, count(*) FILTER (WHERE status IN ('PI','M','PM','PG','N')) missing FROM s GROUP BY 1"),
    "status_matrix": with_views("status", f", {_STATUS} SELECT item, " + ", ".join(f"coalesce(max(status) FILTER (WHERE assembly='{a}'),'abs') \"{a}\"" for a in ("FRANCE", "GERMANY", "JAPAN")) + " FROM s GROUP BY 1"),
    "edge_scores": with_views("edge_scores", "SELECT r_gene, q_gene, max(score) score FROM edge_scores GROUP BY 1,2"),
    "edge_components": with_views("edge_scores", f", {_COMPONENTS} SELECT r_gene, q_gene, component FROM ce", True),
    "component_classes": with_views("edge_scores", f", {_COMPONENTS} SELECT *, {_CLASS} orthology_class, n_edges=n_ref*n_query is_complete FROM cc", True),
    "strong_pairs": """WITH e AS (SELECT DISTINCT (l_partkey%300)::VARCHAR r, (l_suppkey%50)::VARCHAR q FROM lineitem) SELECT a.r a, b.r b, count(*) n_common FROM e a JOIN e b ON a.q=b.q AND a.r<b.r GROUP BY 1,2 HAVING count(*)>=30""",
    "orphan_genes": with_views("edge_scores", "SELECT 'P'||p_partkey r_gene FROM part WHERE 'P'||p_partkey NOT IN (SELECT r_gene FROM edge_scores)"),
    "query_genes": with_views("iv_a", """, n AS (SELECT k, CASE WHEN id%2=0 THEN '+' ELSE '-' END strand, id, s, e FROM iv_a), m AS (SELECT *, CASE WHEN max(e) OVER w IS NULL OR s >= max(e) OVER w THEN 1 ELSE 0 END f FROM n
        WINDOW w AS (PARTITION BY k, strand ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), i AS (SELECT *, sum(f) OVER (PARTITION BY k, strand ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) g FROM m),
        r AS (SELECT k chrom, strand, min(s) s, max(e) e, count(*) n_members, min(id) x FROM i GROUP BY k, strand, g)
        SELECT 'reg_'||lpad((row_number() OVER (ORDER BY chrom, s, strand, x))::VARCHAR, 11, '0') gene, chrom, strand, s, e, n_members FROM r"""),
    "reverse_complement": with_views("dna", "SELECT doc_id, reverse(translate(seq,'ACGT','TGCA')) rc FROM dna"),
    "translate_codons": with_views("dna", f""", {_COD}
        SELECT dna.doc_id, coalesce(string_agg({_translated()}, '' ORDER BY i), '') protein FROM dna LEFT JOIN cod ON cod.doc_id=dna.doc_id GROUP BY 1"""),
    "codon_chunks": with_views("dna", f", {_COD} SELECT c codon, count(*) n, min(i) first_at FROM cod GROUP BY 1"),
    "percent_identity": with_views("dna", f""", {_ALIGNED} SELECT doc_id, round(coalesce(count(*) FILTER (WHERE r=q AND r<>'N')*100/nullif(count(*) FILTER (WHERE r<>'N' AND q<>'N'),0),0), 6)::DOUBLE with_gaps,
        round(coalesce(count(*) FILTER (WHERE r=q AND r NOT IN ('N','-'))*100/nullif(count(*) FILTER (WHERE r NOT IN ('N','-') AND q NOT IN ('N','-')),0),0), 6)::DOUBLE of_bases FROM ch GROUP BY 1"""),
    "substitution_score": with_views("dna", f""", {_ALIGNED} SELECT doc_id, sum(CASE WHEN r='-' AND q='-' THEN 0 WHEN r='-' OR q='-' THEN -1 WHEN r='N' OR q='N' THEN 0 WHEN r=q THEN 5 WHEN r||q IN ('AG','GA','CT','TC') THEN 1 ELSE -4 END)::BIGINT score FROM ch GROUP BY 1"""),
    "unknown_runs": with_views("dna", """, x AS (SELECT doc_id, regexp_replace(seq,'[GT]','N','g') seq FROM dna)
        SELECT doc_id, coalesce(list_max(list_transform(string_split(regexp_replace(seq,'[^N]+',' ','g'),' '), lambda v: length(v))),0) longest, regexp_matches(seq,'N{5,}') has_gap FROM x"""),
    "mask_rule": with_views("dna", f""", {_COD}, c AS (SELECT doc_id, i+1 n, c, (n+2)//3 m FROM cod),
        f AS (SELECT *, min(CASE WHEN c='ATC' THEN n END) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) nx FROM c)
        SELECT doc_id, count(*) FILTER (WHERE n >= m-m//10 OR (n <= m//10 AND nx <= m//10)) n_masked, count(*) n_codons FROM f GROUP BY 1"""),
    "projection_names": "SELECT 'ENST.'||(l_partkey%9) transcript, count(*) n, max(l_orderkey) most FROM lineitem GROUP BY 1",
    "codon_mutations": with_views("dna", f""", {_ALIGNED}, nb AS (SELECT *, coalesce(sum((r<>'-')::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)//3+1 codon FROM ch),
        cd AS (SELECT doc_id, codon, count(*) FILTER (WHERE r='-') - count(*) FILTER (WHERE q='-') z, coalesce(string_agg(q,'' ORDER BY i) FILTER (WHERE q<>'-'),'') b FROM nb GROUP BY 1,2),
        k AS (SELECT *, max(codon) OVER (PARTITION BY doc_id) l FROM cd),
        m AS (SELECT doc_id, codon, 'START_MISSING' mclass FROM k WHERE codon=1 AND b<>'ATG' UNION ALL SELECT doc_id, codon, CASE WHEN z>0 THEN 'BIG_INS' ELSE 'BIG_DEL' END FROM k WHERE abs(z)>=50
          UNION ALL SELECT doc_id, codon, CASE WHEN z>0 THEN 'FS_INS' ELSE 'FS_DEL' END FROM k WHERE abs(z)<50 AND z%3<>0 UNION ALL SELECT doc_id, codon, 'STOP' FROM k WHERE b IN ('TAA','TAG','TGA') AND codon<l)
        SELECT doc_id, mclass, count(*) n, min(codon)::BIGINT first_codon FROM m GROUP BY 1,2"""),
    "splice_sites": with_views("dna", """, x AS (SELECT doc_id, e, seq FROM dna, range(1,5) t(e)), y AS (SELECT doc_id, e, 'A' side, substr(seq, greatest(1, e*(length(seq)//5)), 2) s FROM x WHERE e>1 UNION ALL SELECT doc_id, e, 'D', substr(seq, greatest(1, e*(length(seq)//5)+4), 2) FROM x WHERE e<4),
        z AS (SELECT *, contains(s,'N') OR contains(s,'-') OR (doc_id%3=0 AND e=2 AND side='A') k FROM y WHERE CASE side WHEN 'A' THEN s<>'AG' ELSE s NOT IN ('GT','GC') END) SELECT doc_id, side, count(*) n, count(*) FILTER (WHERE k) n_masked FROM z GROUP BY 1,2"""),
}

_SPLIT_SCORES = "sc AS (SELECT r_gene, q_gene, max((score*7 + substr(q_gene,2)::BIGINT%5)/75) score FROM edge_scores GROUP BY 1,2)"


def _split(scores: str, final: str) -> str:
    """The rules of splitting as SQL, over ``ce`` and edges' scores."""
    return with_views("edge_scores", f""", {_COMPONENTS}, {scores},
        mm AS (SELECT ce.r_gene, ce.q_gene, sc.score, component, count(*) OVER (PARTITION BY ce.r_gene) rd, count(*) OVER (PARTITION BY ce.q_gene) qd FROM ce JOIN sc USING (r_gene, q_gene) JOIN cc USING (component)
          WHERE n_ref>1 AND n_query>1 AND n_edges<>n_ref*n_query),
        hb AS (SELECT *, CASE WHEN qd=1 THEN '#R#'||r_gene WHEN rd=1 THEN '#Q#'||q_gene END hub FROM mm),
        rp AS (SELECT DISTINCT r_gene, hub rh FROM hb WHERE hub IS NOT NULL), qp AS (SELECT DISTINCT q_gene, hub qh FROM hb WHERE hub IS NOT NULL),
        pl AS (SELECT hb.*, rh, qh, coalesce(hub, CASE WHEN rh IS NULL AND qh IS NULL THEN '#rest#'||component END) part FROM hb LEFT JOIN rp USING (r_gene) LEFT JOIN qp USING (q_gene)),
        alone AS (SELECT component FROM pl WHERE rh IS NULL GROUP BY component, r_gene HAVING count(part)=0 UNION SELECT component FROM pl WHERE qh IS NULL GROUP BY component, q_gene HAVING count(part)=0),
        home AS (SELECT DISTINCT component, r_gene, coalesce(rh,'#rest#') h FROM pl),
        parted AS (SELECT DISTINCT a.component FROM (SELECT x.r_gene ra, y.r_gene rb FROM mm x JOIN mm y ON x.q_gene=y.q_gene AND x.r_gene<y.r_gene GROUP BY 1,2 HAVING count(*)>1) JOIN home a ON a.r_gene=ra JOIN home b ON b.r_gene=rb WHERE a.h<>b.h),
        cl AS (SELECT component, count(*) FILTER (WHERE rh IS NOT NULL OR qh IS NOT NULL) lv, min(score) FILTER (WHERE part IS NOT NULL) mn, max(score) FILTER (WHERE part IS NULL) mx FROM pl GROUP BY 1),
        sp AS (SELECT component FROM cl WHERE lv>0 AND (mx IS NULL OR mx=0 OR mx<0.9*mn OR mx<0.75) AND component NOT IN (SELECT component FROM alone) AND component NOT IN (SELECT component FROM parted)),
        done AS (SELECT r_gene, q_gene, component FROM ce WHERE component NOT IN (SELECT component FROM sp) UNION ALL SELECT r_gene, q_gene, part FROM pl WHERE part IS NOT NULL AND component IN (SELECT component FROM sp))
        {final}""", True)


SQL["leaf_split"] = _split(_SPLIT_SCORES, "SELECT * FROM done")
SQL["orthology_type"] = _split(
    "sc AS (SELECT r_gene, q_gene, max(score)/10 score FROM edge_scores GROUP BY 1,2)",
    f""", fin AS (SELECT component, count(DISTINCT r_gene) n_ref, count(DISTINCT q_gene) n_query FROM done GROUP BY 1)
    SELECT r_gene, q_gene, {_CLASS} orthology_class FROM done JOIN fin USING (component) UNION ALL SELECT 'P'||p_partkey, NULL, 'one2zero' FROM part WHERE 'P'||p_partkey NOT IN (SELECT r_gene FROM done)""",
)

SQL["exon_states"] = """WITH x AS (SELECT l_orderkey id, ['A','A+','B','C','M'][l_quantity::BIGINT%5+1] kind, l_quantity::BIGINT%2=0 inc, l_partkey%100>65 AND l_suppkey%80>40 good, l_partkey%100>45 AND l_suppkey%80>25 fair,
    l_quantity::BIGINT%7=0 OR l_quantity::BIGINT%11=0 gap FROM lineitem), y AS (SELECT id, CASE WHEN gap OR kind='M' THEN 'M' WHEN kind IN ('A','A+','B') AND inc THEN 'I' WHEN (kind IN ('A','A+','B') OR inc) AND (good OR fair) THEN 'I' ELSE 'D' END state FROM x)
    SELECT id, state, count(*) "count" FROM y GROUP BY 1,2"""
SQL["memory_plan"] = with_views("chain_blocks_raw", """, j AS (SELECT chain_id, sum(39+6*(size//3))::DOUBLE n, sum(size)::DOUBLE r, max(dq)*100000.0::DOUBLE q FROM chain_blocks_raw GROUP BY 1),
    g AS (SELECT chain_id, ceil((n*32+n*q*4+n*304+(q*2+r)*8+(q+r)*2+100000)/1e9)+0.25 gig FROM j)
    SELECT chain_id, gig, CASE WHEN gig<=0.5 THEN 'fit' WHEN gig<=1.3 THEN 'big' ELSE 'no' END fits, CASE WHEN gig<=1 THEN 1.0 WHEN gig<=1.5 THEN 1.5 WHEN gig<=2 THEN 2.0 END::DOUBLE AS bucket FROM g""")
SQL["species_alignment"] = with_views("dna", """, r AS (SELECT doc_id//4 species, doc_id%4 exon, seq FROM dna), w AS (SELECT exon, max(length(seq)) w FROM r GROUP BY 1),
    f AS (SELECT DISTINCT species, e exon FROM r, range(4) t(e)) SELECT species, string_agg(rpad(coalesce(seq,''), w::INT, '-'), '' ORDER BY exon) seq FROM f JOIN w USING (exon) LEFT JOIN r USING (species, exon) GROUP BY 1""")
SQL["codon_table"] = with_views("dna", f""", {_ALIGNED}, sp AS (SELECT doc_id, substr(ref,1,25)||'    '||substr(ref,26) ref, substr(que,1,25)||'gtag'||substr(que,26) que FROM al),
    cz AS (SELECT doc_id, unnest(range(1,length(ref)+1)) i, unnest(string_split(ref,'')) t, unnest(string_split(que,'')) q FROM sp), c0 AS (SELECT *, CASE WHEN i<=25 THEN 0 ELSE 1 END ex FROM cz),
    c1 AS (SELECT *, sum((q<>'-')::INT) OVER (PARTITION BY doc_id ORDER BY i)-1 co, coalesce(sum((t NOT IN ('-',' '))::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) le FROM c0),
    c2 AS (SELECT *, le//3 b, min(CASE WHEN t<>'-' THEN ex END) OVER (PARTITION BY doc_id, le//3) fe FROM c1 WHERE t<>' '),
    c3 AS (SELECT *, CASE WHEN t='-' AND le%3=0 AND (fe IS NULL OR ex<fe) THEN 0 ELSE 1 END p FROM c2), c4 AS (SELECT doc_id, b, p, string_agg(t,'' ORDER BY i) ref_codon, string_agg(upper(q),'' ORDER BY i) que_codon, max(ex) t_exon, count(*) FILTER (WHERE ex=0) z, count(*) n,
      min(CASE WHEN q<>'-' THEN co END) first_at, max(CASE WHEN q<>'-' THEN co END) last_at FROM c3 GROUP BY 1,2,3)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY b, p) codon, ref_codon, que_codon, t_exon::BIGINT t_exon, t_exon::BIGINT q_exon, CASE WHEN t_exon=1 THEN z ELSE 0 END AS split, first_at, last_at FROM c4""")

_STOPS = "('TAA','TAG','TGA')"
SQL["gap_spans"] = with_views("dna", """, x AS (SELECT doc_id, regexp_replace(seq,'[GT]','N','g') seq FROM dna), u AS (SELECT doc_id, unnest(range(1,length(seq)+1)) i, unnest(string_split(seq,'')) b FROM x WHERE seq<>''), c AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) g FROM u WHERE b='N')
    SELECT doc_id, min(i)-1 s, max(i) e FROM c GROUP BY doc_id, g HAVING count(*)>=4""")
SQL["genome_fetch"] = with_views("dna", """, x AS (SELECT doc_id::VARCHAR chrom, seq FROM dna WHERE length(seq)>=150) SELECT chrom, 10::BIGINT s, (length(seq)-10)::BIGINT e, '+' strand, substr(seq,11,length(seq)-20) seq FROM x
    UNION ALL SELECT chrom, 60::BIGINT, 70::BIGINT, '-', reverse(translate(substr(seq,61,10),'ACGT','TGCA')) FROM x""")
SQL["masked_stops"] = with_views("dna", f""", {_COD}, c AS (SELECT doc_id, n, i, (n-1)//3 l, c FROM cod)
    SELECT doc_id, CASE WHEN max(n)%3<>0 THEN 'out of frame' WHEN max(CASE WHEN i=0 THEN c END)<>'ATG' THEN 'no start codon' WHEN max(CASE WHEN i=l THEN c END) NOT IN {_STOPS} THEN 'no stop codon' END problem,
      string_agg(CASE WHEN c IN {_STOPS} AND i<l THEN 'NNN' ELSE c END, '' ORDER BY i) masked FROM c GROUP BY 1""")
SQL["split_codon_marks"] = with_views("dna", """, x AS (SELECT doc_id, seq q, length(seq) n, (3-doc_id%100%3)%3 h, (doc_id%100+length(seq))%3 t FROM dna)
    SELECT doc_id, lower(substr(q,1,h))||upper(substr(q,h+1,n-h-t))||lower(substr(q,n+1-t)) marked FROM x""")
SQL["pseudogene_track"] = f"""WITH {_TABLE}, h AS (SELECT s_suppkey chain_id, (s_nationkey%5)::VARCHAR chrom, s_suppkey%2=0 plus, s_suppkey*37%9000 a, s_suppkey*37%9000+100+s_suppkey%400 b FROM supplier),
    r AS (SELECT chrom, CASE WHEN (p_size%2=0)=plus THEN '+' ELSE '-' END strand, CASE WHEN plus THEN a ELSE 100000-b END s, CASE WHEN plus THEN b ELSE 100000-a END e, gene FROM d JOIN h USING (chain_id) JOIN part ON p_partkey=gene WHERE score<0.2),
    m AS (SELECT *, CASE WHEN max(e) OVER w IS NULL OR s > max(e) OVER w THEN 1 ELSE 0 END f FROM r WINDOW w AS (PARTITION BY chrom, strand ORDER BY s, e, gene ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    i AS (SELECT *, sum(f) OVER (PARTITION BY chrom, strand ORDER BY s, e, gene ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) g FROM m)
    SELECT chrom, strand, min(s) s, max(e) e, count(*) n_parts, arg_min(gene, (s, e, gene)) AS name FROM i GROUP BY chrom, strand, g"""
SQL["exon_scores"] = SQL["codon_table"].replace("SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY b, p) codon", ", tb AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY b, p) codon") + """),
    cx AS (SELECT doc_id, t_exon, unnest(string_split(ref_codon,'')) r, unnest(string_split(que_codon,'')) q FROM tb)
    SELECT doc_id, t_exon exon, round(count(*) FILTER (WHERE r=q)*100/count(*), 6)::DOUBLE AS identity FROM cx WHERE r<>'N' AND q<>'N' GROUP BY 1,2"""
SQL["projection_tracks"] = with_views("chain_blocks_raw", """, x AS (SELECT chain_id AS name, block_no, (dt%2)::VARCHAR chrom, CASE WHEN chain_id%2=0 THEN '+' ELSE '-' END strand, dq*100 s, dq*100+size e, CASE WHEN chain_id%2=0 THEN dq ELSE -dq END w FROM chain_blocks_raw),
    f AS (SELECT *, CASE WHEN w <= lag(w) OVER (PARTITION BY name, chrom, strand ORDER BY block_no) THEN 1 ELSE 0 END c FROM x), g AS (SELECT *, sum(c) OVER (PARTITION BY name, chrom, strand ORDER BY block_no) part FROM f)
    SELECT name, chrom, strand, part::BIGINT AS part, min(s) AS "start", max(e) AS "end", count(*) n_blocks FROM g GROUP BY 1,2,3,4""")
SQL["info_table"] = f"""WITH {_LOSS}, pl AS (SELECT l_orderkey projection, min(l_partkey) place FROM lineitem GROUP BY 1 HAVING min(l_partkey)%3<>0)
    SELECT o_orderkey projection, o_custkey transcript, coalesce(place,-1) place, coalesce(c_nationkey,-1) region, CASE WHEN o_orderkey%5<>2 THEN o_orderkey%100/100 ELSE 0.5 END::DOUBLE score, coalesce(loss,'M') AS "class"
    FROM orders LEFT JOIN pl ON projection=o_orderkey LEFT JOIN customer ON c_custkey=o_custkey AND c_custkey%4<>1 LEFT JOIN losses ON losses.projection=o_orderkey"""
SQL["chosen_orthologs"] = """WITH r AS (SELECT o_custkey species, o_orderkey projection, ['one2one','one2many','one2zero'][o_orderkey%3+1] orthology_class FROM orders), k AS (SELECT *, count(*) OVER (PARTITION BY species) copies FROM r WHERE orthology_class<>'one2zero')
    SELECT * FROM k WHERE copies<=8 UNION ALL SELECT c_custkey, -1, 'none', -1 FROM customer WHERE c_custkey NOT IN (SELECT species FROM k)"""

SQL["frame_states"] = SQL["codon_table"].replace("SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY b, p) codon", ", tb AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY b, p) codon") + """),
    st AS (SELECT doc_id, codon, que_codon, ['I','I','D','mD','M','I'][((doc_id + (t_exon+1)*5)%6+1)::INT] es FROM tb),
    lt AS (SELECT doc_id, codon, CASE WHEN es='M' THEN 'M' WHEN replace(que_codon,'-','') IN ('TAA','TAG','TGA') THEN 'L' WHEN es='mD' THEN 'D' WHEN es='D' THEN 'L' WHEN que_codon='---' THEN 'D' ELSE 'I' END x FROM st),
    sx AS (SELECT doc_id, string_agg(x, '' ORDER BY codon) states, count(*) n, count(*)//10 t, count(*) FILTER (WHERE x='I') i, count(*) FILTER (WHERE x='M') m FROM lt GROUP BY 1)
    SELECT doc_id, states, CASE WHEN t=0 THEN true ELSE NOT contains(substr(states,1,n-t),'L') END middle_is_intact, CASE WHEN t=0 THEN true ELSE NOT contains(substr(states,t+1,n-2*t),'M') END middle_is_present,
      round(CASE WHEN n=m THEN 1.0 ELSE i/(n-m) END, 9)::DOUBLE intact_codons FROM sx"""
SQL["query_transcripts"] = f"WITH {_LOSS} SELECT projection FROM losses WHERE projection%7<>0 AND projection%5<>1 AND loss IN ('I','PI','UL')"
SQL["job_parts"] = "SELECT o_custkey k, o_orderkey id, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS part FROM orders"

SQL["whole_codon_exons"] = SQL["codon_table"].replace("SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY b, p) codon", ", tb AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY b, p) codon") + """),
    w AS (SELECT doc_id, t_exon, bool_and(length(ref_codon)=3 AND length(que_codon)=3 AND NOT contains(ref_codon,'-') AND NOT contains(que_codon,'-')) whole FROM tb GROUP BY 1,2)
    SELECT *, CASE WHEN doc_id%2=0 AND whole AND doc_id%3>0 AND t_exon=0 THEN 'A+' WHEN doc_id%2=0 THEN 'A' ELSE 'B' END kind FROM w"""
SQL["region_marks"] = """WITH x AS (SELECT l_orderkey id, l_partkey%300 a, l_suppkey%300 b, l_quantity::BIGINT q FROM lineitem)
    SELECT id, CASE WHEN least(a+q,b+q) > greatest(a,b) THEN 'INC' ELSE 'EXCL' END mark, count(*) "count" FROM x GROUP BY 1,2"""
SQL["exons_beside_gaps"] = with_views("iv_a iv_b", "SELECT k, id exon, EXISTS (SELECT 1 FROM iv_b b WHERE a.k=b.k AND a.s-50<=b.e AND b.s<=a.e+50) in_gap FROM iv_a a")

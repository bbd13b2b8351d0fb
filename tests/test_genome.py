import random

import pytest
from pyspark.sql import functions as F

from loomspan.operators import genome, projections


@pytest.mark.parametrize("size", [7, 64, 4096])
def test_fetch(spark, size):
    rng = random.Random(1)
    seqs = {"c1": "".join(rng.choice("ACGTN") for _ in range(300)), "c2": "acgt" * 20}
    chunks = genome.chunk_genome(spark.createDataFrame([(f"{k} note", v) for k, v in seqs.items()], "header string, seq string"), size)
    regions = [(rng.choice(["c1", "c2"]), s := rng.randrange(80), s + rng.randrange(1, 200), rng.choice("+-")) for _ in range(30)] + [("c3", 0, 5, "+"), ("c2", 500, 510, "-"), ("c1", 5, 5, "+")]
    got = genome.fetch(chunks, spark.createDataFrame(regions, "chrom string, s long, e long, strand string"), size).collect()
    turn = str.maketrans("ACGT", "TGCA")
    for r in got:
        want = seqs.get(r["chrom"], "")[r["s"] : r["e"]].upper()
        assert r["seq"] == (want.translate(turn)[::-1] if r["strand"] == "-" else want)
    assert len(got) == len(regions) and chunks.agg(F.max(F.length("seq"))).first()[0] <= size


def test_gap_spans(spark):
    df = spark.createDataFrame([(1, "nnnACNNGTNNNN"), (2, ""), (3, "ACGT"), (4, None)], "k int, seq string")
    assert sorted(tuple(r) for r in genome.gap_spans(df, "k", least=3).collect()) == [(1, 0, 3), (1, 9, 13)]


def test_reference_exons(spark):
    df = spark.createDataFrame([("ATGTGACTGTAA",), ("ATGC",), ("CTGTAA",), ("ATGCTG",), ("",)], "seq string")
    got = [(r["problem"], r["masked"]) for r in genome.reference_exons(df).collect()]
    assert got == [(None, "ATGNNNCTGTAA"), ("out of frame", "ATGC"), ("no start codon", "CTGTAA"), ("no stop codon", "ATGCTG"), ("empty", "")]


def test_split_codon_marks(spark):
    df = spark.createDataFrame([("ATGCATG", 0), ("ATGCATG", 1), ("AC", 1), ("A", 1)], "seq string, n long")
    assert [r[0] for r in df.select(genome.mark_split_codons(F.col("seq"), F.col("n"))).collect()] == ["ATGCATg", "atGCAtg", "ac", "a"]


def test_exon_records(spark):
    head = "g.1 | 0 | 5 | chr1:20-10 | 80.5 | 50 | OK | A | exp:1-9 | INC | False | query_exon"
    got = projections.exon_records(spark.createDataFrame([(head, "ACG"), ("g | exon0 | 5 | reference_exon", "A"), (head.replace("chr1:20-10", "N/A"), "A")], "header string, seq string")).collect()
    assert [(r["gene"], r["exon"], r["chrom"], r["s"], r["e"], r["strand"], r["mark"]) for r in got] == [("g.1", 0, "chr1", 10, 20, "-", "HQ")]


def test_projection_tracks(spark):
    rows = [("p", 1, "c", "+", 10, 20), ("p", 2, "c", "+", 30, 40), ("p", 3, "c", "+", 5, 8), ("m", 1, "c", "-", 30, 40), ("m", 2, "c", "-", 10, 20)]
    got = projections.projection_tracks(spark.createDataFrame(rows, "projection string, exon int, chrom string, strand string, s long, e long")).collect()
    assert sorted((r["name"], r["part"], r["start"], r["end"], len(r["blocks"])) for r in got) == [("m", 0, 10, 40, 2), ("p", 0, 10, 40, 2), ("p", 1, 5, 8, 1)]


def test_pseudogenes(spark):
    classes = spark.createDataFrame([("a", 1, "P_PGENES"), ("b", 2, "P_PGENES"), ("a", 3, "ORTH")], "gene string, chain_id long, chain_class string")
    heads = spark.createDataFrame([(1, "q", 1000, "+", 100, 200), (2, "q", 1000, "-", 700, 800), (3, "q", 1000, "+", 0, 5)], "chain_id long, q_name string, q_size long, q_strand string, q_start long, q_end long")
    genes = spark.createDataFrame([("a", "+"), ("b", "-")], "gene string, strand string")
    got = projections.pseudogene_track(classes, heads, genes).collect()
    assert [(r["chrom"], r["strand"], r["s"], r["e"], r["n_parts"], r["name"]) for r in got] == [("q", "+", 100, 300, 2, "a")]


def test_exon_scores(spark):
    codons = spark.createDataFrame([("k", 0, "ATG", "ATG"), ("k", 0, "CTG", "CTA"), ("k", 1, "A-AA", "ACAN")], "k string, t_exon int, ref_codon string, que_codon string")
    matrix = spark.createDataFrame([("ATG", "ATG", 5), ("CTG", "CTG", 5), ("CTG", "CTA", 3)], "ref string, que string, score int")
    got = {r["exon"]: (r["identity"], r["score"]) for r in projections.exon_scores(codons, "k", matrix).collect()}
    assert got[0] == (pytest.approx(500 / 6), 80.0) and got[1] == (pytest.approx(200 / 3), 0.0)

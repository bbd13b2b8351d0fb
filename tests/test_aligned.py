import random

import pytest
from pyspark.sql import functions as F

from loomspan.operators import aligned, resources
from loomspan.plans import annotation, checks
from loomspan.sources import readers


def scan(ref, query):
    """The codon table by reading column after column."""
    codons, letters, q_exon, t_exon, last, coord = [], 0, 0, 0, " ", -1
    current = None
    for n, (t, q) in enumerate(zip(ref, query, strict=True)):
        coord += q != "-"
        if t == " ":
            if last != " ":
                q_exon, t_exon = q_exon + 1, t_exon + 1
                if current and current["letters"] == 0:
                    codons.append(current)
                    current = None
                elif current:
                    current["split"] = len(current["ref"])
        else:
            if t == ">" and last != ">":
                t_exon += 1
            current = current or {"ref": "", "que": "", "letters": 0, "split": 0, "at": []}
            current["ref"] += "-" if t == ">" else t.upper()
            current["que"] += q.upper()
            current |= {"q_exon": q_exon, "t_exon": t_exon}
            current["at"] += [coord] if q != "-" else []
            if t.isalpha():
                current["letters"] += 1
                letters += 1
                if current["letters"] == 3:
                    codons.append(current)
                    current = None
        last = t
    if current:
        codons.append(current)
    return [(c["ref"], c["que"], c["t_exon"], c["q_exon"], c["split"], min(c["at"], default=None), max(c["at"], default=None)) for c in codons]


ALIGNMENTS = {
    1: ("ATGGCA   CTGTAA", "ATGGCAgtaCTGTAA"),
    2: ("ATGGCa   aaGTAA", "ATGG-AgtaAAGTAA"),
    3: ("ATG--GCA---   CTGTAA", "ATGCCG-ATTTgtaCTGTAA"),
    4: ("ATGGCA>>>CTGTAA", "ATGGCA---CTGTAA"),
    5: ("   ATGc   cc   TAA", "aaaATGCgtgCCgagTAA"),
    6: ("ATG---", "ATGAAA"),
}


def test_codon_table_matches_a_scan(spark):
    rng = random.Random(1)
    pairs = dict(ALIGNMENTS)
    for k in range(10, 30):
        ref, left = "", 60
        while left:
            ref += rng.choice(["A", "C", "G", "-"])
            left -= ref[-1] != "-"
            if rng.random() < 0.08 and left:
                ref += "   "
        pairs[k] = (ref, "".join("g" if t == " " else rng.choice("ACGT-") if t != "-" else rng.choice("ACGT") for t in ref))
    df = spark.createDataFrame([(k, *p) for k, p in pairs.items()], "k int, ref string, query string")
    found = {}
    for r in aligned.codon_table(df, "k").orderBy("k", "codon").collect():
        found.setdefault(r["k"], []).append(tuple(r)[2:])
    for k, (ref, query) in pairs.items():
        assert found[k] == scan(ref, query), (k, ref, query)


def test_compensated_exons(spark):
    cases = {"a": {2: 10, 3: 11, 4: 5}, "b": {2: 10, 3: 10, 4: 10}, "c": {2: 10, 3: 10}, "d": {2: 9, 3: 10, 4: 1, 5: 2, 6: 1}}
    rows = [(k, exon, size, "D") for k, sizes in cases.items() for exon, size in sizes.items()] + [(k, e, 100, "I") for k in cases for e in (1, 9)]
    df = spark.createDataFrame(rows, "k string, exon long, size long, state string")
    kept = {k: {r["exon"] for r in aligned.settle_deletions(df.where(F.col("k") == k), "k").where("state = 'mD'").collect()} for k in cases}
    # In d exon 2 is whole codons by itself; the first series is that of exon 4.
    assert kept == {"a": {2, 3}, "b": {2, 3, 4}, "c": set(), "d": {2, 4, 5}}


def test_deletions(spark):
    rows = [("a", 1, 19, "D"), ("a", 2, 30, "D"), ("a", 3, 50, "I"), ("a", 4, 31, "D"), ("a", 5, 32, "D"), ("a", 6, 40, "I"), ("b", 1, 40, "D"), ("b", 2, 12, "M")]
    got = {(r["k"], r["exon"]): r["state"] for r in aligned.settle_deletions(spark.createDataFrame(rows, "k string, exon long, size long, state string"), "k").collect()}
    assert got == {("a", 1): "M", ("a", 2): "mD", ("a", 3): "I", ("a", 4): "mD", ("a", 5): "mD", ("a", 6): "I", ("b", 1): "D", ("b", 2): "M"}


def test_exon_states(spark):
    rows = [("A", False, True, 70, 50, False), ("M", False, True, 70, 50, False), ("A", True, True, 70, 50, False), ("C", False, False, 90, 90, False), ("C", False, True, 50, 30, None), ("A", False, True, 0, 0, True), (None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "class string, in_gap boolean, included boolean, identity int, score int, is_missing boolean")
    assert [r["state"] for r in aligned.exon_status(df).collect()] == ["I", "M", "M", "D", "I", "M", "D"]


def test_split_stop_across_a_deleted_exon(spark):
    # The first exon ends in T, the deleted one is G...A, the last begins with AA: TAA where they meet.
    df = spark.createDataFrame([("k", "ATGt   gcCCCa   aaTAA", "ATGTgtaGCCCCAgtaAATAA")], "k string, ref string, query string")
    exons = spark.createDataFrame([("k", 1, "I"), ("k", 2, "D"), ("k", 3, "I")], "k string, exon long, state string")
    assert [tuple(r) for r in aligned.split_stops(aligned.codon_table(df, "k"), exons, "k").collect()] == [("k", 1, 3, "TAA")]


def test_out_of_chain_share(spark):
    codons = spark.createDataFrame([("a", 0), ("a", 0), ("a", 1), ("b", 0)], "k string, t_exon long")
    got = {r["k"]: r["out_of_chain"] for r in aligned.out_of_chain_share(codons, spark.createDataFrame([("a", 1)], "k string, t_exon long"), "k").collect()}
    assert got == {"a": pytest.approx(1 / 3), "b": 0}


def test_exon_alignments(spark):
    rows = spark.createDataFrame([("x", 1, "ACG"), ("x", 3, "TT"), ("y", 3, "TTA")], "species string, exon int, seq string")
    assert {r["species"]: r["seq"] for r in aligned.exon_alignments(rows, [1, 2, 3]).collect()} == {"x": "ACGTT-", "y": "---TTA"}


def test_memory(spark):
    row = spark.createDataFrame([([300, 90],)], "sizes array<long>").select(resources.states(F.col("sizes")).alias("n"), resources.bucket(F.lit(3.25), [2, 5, 10]).alias("b"), resources.bucket(F.lit(99), [2]).alias("none")).first()
    assert (row["n"], row["b"], row["none"]) == (2 * 39 + 6 * 130, 5.0, None)


def test_checks(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b c",)], "name string")
    assert checks.duplicates(df, "name").count() == 1 and checks.bad_names(df, "name").first()["name"] == "b c"
    with pytest.raises(ValueError, match="twice"):
        checks.require(checks.duplicates(df, "name"), "twice")
    sizes = spark.createDataFrame([("c1", 5), ("c2", 6), ("c3", 7)], "chrom string, size long")
    genome = spark.createDataFrame([("c1", 5), ("c2", 7)], "chrom string, size long")
    assert {r["chrom"] for r in checks.wrong_sizes(sizes, genome).collect()} == {"c2", "c3"}
    assert checks.unknown(sizes, genome, "chrom").count() == 1


BED = "chr1\t100\t400\tt1\t0\t+\t110\t380\t0\t3\t50,40,60,\t0,100,240,\nchr1\t5000\t5300\tt2\t0\t-\t5000\t5300\t0\t1\t300,\t0,\nchr2\t5\t20\tt3\t0\t-\t5\t20\t0\t1\t15,\t0,\nchr1\t90\t99\tbad\t0\t-\t95\t95\t0\t1\t9,\t0,\n"
CHAIN = "chain 20000 chr1 9000 + 50 450 q1 1000 + 0 380 7\n150\t50\t30\n200\n\nchain 15000 chr1 9000 + 0 9000 q2 9000 + 0 9000 8\n9000\n\nchain 30000 chr1 9000 + 105 135 q3 700 - 10 40 9\n30\n"


def test_annotation_pipeline(spark, tmp_path):
    (tmp_path / "g.bed").write_text(BED)
    (tmp_path / "a.chain").write_text(CHAIN)
    genes = readers.read_bed12(spark, str(tmp_path / "g.bed"))
    headers, raw = readers.read_chains(spark, str(tmp_path / "a.chain"))
    out = annotation.annotate(genes, headers, raw, bin_size=64)
    assert [tuple(r) for r in out["rejected"].collect()] == [("bad", "no coding part")]
    assert {tuple(r) for r in out["overlaps"].collect()} == {("t1", 7), ("t1", 9)}
    assert {tuple(r) for r in out["skipped"].collect()} == {("t2", "no intersecting chains"), ("t3", "chromosome is not aligned")}
    rows = {r["chain_id"]: r for r in out["features"].collect()}
    # Chain 7 has 50-200 and 250-450: exons 100-150 and 340-400 whole, 200-240 not at all.
    assert rows[7]["exon_cover"] == 40 + 40 and rows[7]["ex_fract"] == 120 and rows[7]["gene_overs"] == 2 and rows[7]["chain_len"] == 350
    assert rows[9]["exon_cover"] == 25 and rows[9]["gl_exo"] == pytest.approx(25 / 30)
    classes = {r["chain_id"]: r["chain_class"] for r in out["classes"].collect()}
    assert classes == {7: "ORTH", 9: "PARA"}
    assert [(r["chain_id"], r["kept"]) for r in out["chosen"].collect()] == [(7, True)]
    assert [(r["region"], r["q_from"], r["q_to"]) for r in out["loci"].collect()] == [("t1", 50, 330)]
    assert set(annotation.annotate(genes, headers, raw, up_to="overlaps")) == {"genes", "rejected", "chains", "overlaps", "skipped"}


def test_frame_states(spark):
    codons = spark.createDataFrame([("k", 1, "ATG", 0), ("k", 2, "---", 0), ("k", 3, "TAA", 0), ("k", 4, "CCC", 1), ("k", 5, "CCC", 2), ("k", 6, "TAA", 3), ("k", 7, "CCC", 4)], "k string, codon long, que_codon string, t_exon long")
    exons = spark.createDataFrame([("k", 1, "I"), ("k", 2, "D"), ("k", 3, "mD"), ("k", 4, "M")], "k string, exon long, state string")
    hits = spark.createDataFrame([("k", 3), ("k", 6)], "k string, codon long")
    assert [tuple(r) for r in aligned.frame_states(codons, exons, hits, "k").collect()] == [("k", "IDLLDMI")]


def test_regions_and_gaps(spark):
    df = spark.createDataFrame([(1, 5, 4, 9), (5, 1, 9, 5), (1, 5, 5, 9), (1, 9, 4, 3)], "a long, b long, s long, e long")
    assert [r[0] for r in df.select(aligned.region_mark(F.col("a"), F.col("b"), F.col("s"), F.col("e"))).collect()] == ["INC", "EXCL", "EXCL", "INC"]
    exons = spark.createDataFrame([("c", 1, 100, 150), ("c", 2, 400, 450), ("d", 1, 100, 150)], "chrom string, exon int, s long, e long")
    gaps = spark.createDataFrame([("c", 160, 170), ("c", 470, 480)], "chrom string, s long, e long")
    got = aligned.beside_gap(exons, gaps, ["chrom"], flank=10).collect()
    assert {(r["chrom"], r["exon"]): r["in_gap"] for r in got} == {("c", 1): True, ("c", 2): False, ("d", 1): False}
    codons = spark.createDataFrame([("k", 0, "ATG", "ATG"), ("k", 0, "CTG", "CT-"), ("k", 1, "CTG", "CTA")], "k string, t_exon int, ref_codon string, que_codon string")
    assert {r["t_exon"]: r["whole"] for r in aligned.whole_codon_exons(codons, "k").collect()} == {0: False, 1: True}


def test_codons_of_a_batch_of_texts_are_made_in_parts(spark):
    from unittest.mock import Mock

    import pyarrow as pa

    pairs = Mock(schema=spark.createDataFrame([], "k long, ref string, query string").schema)
    pairs.select.return_value.mapInArrow = lambda f, _: f
    texts = ["ACG" * 20_000] * 50
    parts = list(aligned.codon_table(pairs, "k")(iter([pa.record_batch({"k": list(range(50)), "ref": texts, "query": texts})])))
    assert sum(x.num_rows for x in parts) == 1_000_000 and max(x.num_rows for x in parts) <= 2 * aligned.MOST_LETTERS // 3
    assert [k for x in parts for k in x.column("k").to_pylist()][::20_000] == list(range(50))

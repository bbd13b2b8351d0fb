"""Files of all kinds, hand-made; the registered queries hold the same against SQL."""

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from loomspan.functions import sequences
from loomspan.operators import chains
from loomspan.sources import formats, readers


def put(path, text):
    path.write_text(text)
    return str(path)


def test_scores(spark, tmp_path):
    scores = formats.read_kind(spark, "orthology_scores", put(tmp_path / "s", "gene\tchain\tpred\nt.1\t5\t-1\nt.1\t6\t0.9\nu\t7\t0.2\n"))
    assert {tuple(r) for r in formats.projection_scores(scores).collect()} == {("t.1.5", 0.5), ("t.1.6", 0.9), ("u.7", 0.2)}
    assert [tuple(r) for r in formats.fragment_scores(scores).collect()] == [("t.1", 6, 0.9)]


def test_lines_of_another_shape_fail(spark, tmp_path):
    path = put(tmp_path / "s", "chr1\tmany\n")
    with pytest.raises((PySparkException, Py4JJavaError)):
        formats.read_kind(spark, "chrom_sizes", path).collect()


def test_predefined_goes_before_missing(spark):
    given = spark.createDataFrame([("t1", "TRANSCRIPT", "L"), ("p", "PROJECTION", "I")], "id string, level string, class string")
    one, two = (spark.createDataFrame([(n,) for n in names], "name string") for names in (["t1", "t2"], ["t2", "t3"]))
    assert {tuple(r) for r in formats.predefined_classes(given, one, two).collect()} == {("TRANSCRIPT", "t1", "L"), ("TRANSCRIPT", "t2", "M"), ("TRANSCRIPT", "t3", "M"), ("PROJECTION", "p", "I")}


def test_chain_features_round_trip(spark, tmp_path):
    one = spark.createDataFrame([(3, 2, 90, 0.5, 0.25, 700)], "chain_id long, synteny long, score long, global_exo double, exlen_to_qlen double, chain_len long")
    pairs = spark.createDataFrame([(3, "a", 0.5, 12, 4, 0.1), (3, "b", 0.0, 0, 0, 0.0)], "chain_id long, gene string, local_exo double, coverage long, introns long, flank double")
    path = str(tmp_path / "f")
    formats.chain_feature_lines(one, pairs).select("value").write.text(path)
    found, again, overlaps = formats.read_chain_features(spark, path)
    assert [tuple(r) for r in found.collect()] == [(3, 2, 90, 0.5, 0.25, 700)]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, pairs.collect())) and [tuple(r) for r in overlaps.collect()] == [("a", 3)]


def test_chains_as_text(spark, tmp_path):
    text = "chain 15001 chr1 5000 + 100 155 q1 1000 - 10 50 7\n10\t10\t5\n20\t10\t0\n5\n\nchain 900 chr1 5000 + 300 310 q2 500 + 0 10 8\n10\n\n"
    heads, raw = readers.read_chains(spark, put(tmp_path / "a.chain", text))
    formats.write_chains(heads, raw, str(tmp_path / "out"))
    again = readers.read_chains(spark, str(tmp_path / "out"))
    for a, b in zip((heads, chains.decode_blocks(heads, raw)), (again[0], chains.decode_blocks(*again)), strict=True):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_reports(spark, tmp_path):
    text = "# g\t1\t2\t5\tSTOP\tx\tunmasked\tS_1\n# g\t1\t1\t0\tDeleted exon\t-\tmasked\tE_1\n# g\t1\t1\t3\tCOMPENSATION\tFS_2-4\tunmasked\tC_1\n# g\t1\t1\t3\tCOMPENSATION\tFS_5,6\tunmasked\tC_2\n# g\t1\tMIDDLE_80%_INTACT TRUE\n# g\t1\tINTACT_CODONS_PROP 0.5\n"
    found, features = readers.read_mutations(spark, put(tmp_path / "m", text))
    row = formats.feature_table_of(features).first()
    assert (row["projection"], row["codons"], row["middle_intact"], row["middle_present"], row["ignore_m"]) == ("g.1", 0.5, True, None, None)
    assert [tuple(r) for r in formats.lost_exons(found).collect()] == [("g.1", 1, "Deleted exon")] and formats.last_exon(found).first()["exons"] == 2
    assert sorted((r["a"], r["b"]) for r in formats.compensation_pairs(found).collect()) == [(2, 3), (3, 4), (5, 6)]
    starts = spark.createDataFrame([("g", 1, 0), ("g", 2, 9)], "gene string, exon int, before long")
    at = {r["mut_id"]: r["at"] for r in formats.placed_mutations(found, starts, ("STOP",)).collect()}
    assert at["S_1"] == 4 and at["E_1"] == 0


def test_small_helpers(spark):
    frags = spark.createDataFrame([("t", "5,6,"), ("u", "")], "transcript string, chains string")
    assert [tuple(r) for r in formats.fragment_chains(frags).collect()] == [("t", 0, "5"), ("t", 1, "6")]
    seqs = spark.createDataFrame([("ATG !TG XTA ---",)], "s string").select(formats.clean_codons("s").alias("s"))
    assert seqs.first()["s"] == "ATG -TG NTA ---" and seqs.select(formats.protein_of("s", sequences.CODONS).alias("p")).first()["p"] == "MXX-"
    sizes = spark.createDataFrame([("g", 1, 0, 4), ("g", 2, 4, 5), ("g", 3, 9, 3)], "gene string, exon int, before long, size long")
    assert sorted((r["codon"], r["exon"], r["split"]) for r in formats.codon_exons(sizes).collect()) == [(0, 1, False), (1, 1, True), (2, 2, False), (3, 3, False)]


def test_jobs_hold_every_chain_once(spark, tmp_path):
    pairs = spark.createDataFrame([(c, f"g{c % 3}") for c in range(20)] + [(5, "h")], "chain_id long, gene string")
    formats.write_jobs(formats.job_lines(pairs, 4), str(tmp_path / "jobs"))
    found = formats.read_jobs(spark, str(tmp_path / "jobs")).collect()
    assert sorted((r["chain_id"], r["gene"]) for r in found) == sorted(map(tuple, pairs.collect())) and len({r["job"] for r in found}) > 1

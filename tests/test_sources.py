from pyspark.sql import functions as F

from loomspan.functions import tracks
from loomspan.operators import chains
from loomspan.sources import readers, writers

BED = """chr1\t100\t400\tT.1\t0\t+\t120\t380\t0,0,0\t3\t50,40,60,\t0,100,240,
chr1\t1000\t1300\tNO_CDS\t0\t-\t1000\t1000\t0,0,0\t1\t300,\t0,
chr1\t2000\t2060\tOUF\t0\t-\t2000\t2050\t0,0,0\t1\t60,\t0,
"""
CHAIN = """# made by hand
chain 15001 chr1 5000 + 100 155 q1 1000 - 10 50 7
10\t10\t5
20\t10\t0
5

chain 900 chr1 5000 + 300 310 q2 500 + 0 10 8
10
"""


def put(path, text):
    path.write_text(text)
    return str(path)


def test_bed_round_trip(spark, tmp_path):
    df = readers.read_bed12(spark, put(tmp_path / "a.bed", BED))
    assert "\n".join(r["v"] for r in df.select(writers.bed12_line(df).alias("v")).collect()) + "\n" == BED
    reasons = {r["name"]: r["reason"] for r in tracks.reject_reason(df).collect()}
    assert reasons == {"T.1": "out of frame", "NO_CDS": "no coding part", "OUF": "out of frame"}
    sizes = {r["exon"]: r["size"] for r in tracks.coding_sizes(df, "name").where("name = 'T.1'").collect()}
    assert sizes == {1: 30, 2: 40, 3: 40}


def test_block_that_ends_at_the_coding_start_goes(spark):
    blocks = F.array(F.struct(F.lit(0).alias("s"), F.lit(10).alias("e")), F.struct(F.lit(20).alias("s"), F.lit(30).alias("e")))
    row = spark.range(1).select(tracks.clip_blocks(blocks, F.lit(10), F.lit(25)).alias("x")).first()
    assert [tuple(b) for b in row["x"]] == [(20, 25)]


def test_flank_starts_at_one(spark, tmp_path):
    df = readers.read_bed12(spark, put(tmp_path / "a.bed", BED))
    row = tracks.four_tracks(df, "name").where("name = 'T.1' AND track = 'flanks'").first()
    assert (row["s"], row["e"]) == (1, 10400)


def test_chain_file(spark, tmp_path):
    headers, raw = readers.read_chains(spark, put(tmp_path / "a.chain", CHAIN))
    assert sorted((r["chain_id"], r["score"], r["q_strand"], r["q_size"]) for r in headers.collect()) == [(7, 15001, "-", 1000), (8, 900, "+", 500)]
    got = [tuple(r)[1:] for r in chains.decode_blocks(headers, raw).where("chain_id = 7").orderBy("block_no").collect()]
    assert got == [(1, 100, 110, 10, 20), (2, 120, 140, 25, 45), (3, 150, 155, 45, 50)]


def test_fasta(spark, tmp_path):
    text = ">p.1 | PROT | REFERENCE\nMK\nL\n>p.1 | PROT | QUERY\nMKX\n!note\n>empty | PROT | QUERY\n\n"
    found = readers.read_fasta(spark, put(tmp_path / "a.fa", text))
    assert [tuple(r) for r in readers.paired_fasta(found).collect()] == [("p.1", "PROT", "MKL", "MKX")]


def test_small_readers(spark, tmp_path):
    known = spark.createDataFrame([("t1",)], "transcript string")
    assert [tuple(r) for r in readers.read_isoforms(spark, put(tmp_path / "i", "gene\ttranscript\ng\tt1\n"), known).collect()] == [("g", "t1")]
    assert [tuple(r) for r in readers.read_minor_introns(spark, put(tmp_path / "u", "t1\t2\tA\nt1\tx\tD\nt1\t0\tD\n")).collect()] == [("t1", 2, "A")]
    regions = spark.createDataFrame([("chr1:5-9",), ("what",)], "region string")
    assert [tuple(r)[1:] for r in readers.read_regions(regions).collect()] == [("chr1", 5, 9), ("N", 1, 1)]
    assert spark.range(1).select(readers.parse_pairs(F.lit("a=1,b=2.5,")).alias("m")).first()["m"] == {"a": 1.0, "b": 2.5}
    muts, feats = readers.read_mutations(spark, put(tmp_path / "m", "# g\t1\t2\t5\tSTOP\tx\tunmasked\tS_1\n# g\t1\tMIDDLE_IS_INTACT TRUE\nother\n"))
    assert muts.first()["position"] == 5 and not muts.first()["masked"] and feats.first()["value"] == "TRUE"


def test_lines_are_numbered_within_genes(spark):
    rows = [(1, "c\tx\texon"), (2, "c\tx\texon"), (3, "###"), (4, "c\tx\texon"), (5, "c\tx\tCDS")]
    got = readers.number_repeats(spark.createDataFrame(rows, "at int, line string"), "at", "line").orderBy("at").collect()
    assert [(r["at"], r["number"]) for r in got] == [(1, 1), (2, 2), (4, 1), (5, 1)]


def test_alignments_and_matrix(spark, tmp_path):
    found = readers.read_alignments(spark, put(tmp_path / "a.txt", ">reference\nATG  CC\n>p.1\nATGgtCC\n>reference\nA\n>p.2\nC\n"))
    assert sorted(tuple(r) for r in found.collect()) == [("p.1", "ATG  CC", "ATGgtCC"), ("p.2", "A", "C")]
    matrix = readers.read_matrix(spark, put(tmp_path / "m.txt", "# note\n   A  R\nA  4 -1\nR -1  5\n"))
    assert sorted(tuple(r) for r in matrix.collect()) == [("A", "A", 4), ("A", "R", -1), ("R", "A", -1), ("R", "R", 5)]

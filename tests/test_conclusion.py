"""From an aligner's output to losses and orthology."""

from loomspan.operators import aligner_output
from loomspan.plans import conclusion


def section(name, *projections):
    lines = [f"#{name}"]
    for chain, place, seq in projections:
        lines += [f">{name} | 0 | {chain} | reference_exon", "ATG", f">{name} | 0 | {chain} | {place} | 90.0 | 90.0 | OK | A | e | INC | False | query_exon", seq]
    return "\n".join(lines) + "\n"


def test_losses_and_orthology(spark, tmp_path):
    whole = "ATG" + "AAA" * 40 + "TAA"
    broken = "ATG" + "AAA" * 10 + "TAA" + "AAA" * 10 + "TGA" + "AAA" * 18 + "TAA"
    (tmp_path / "out.txt").write_text(section("t1", (1, "c:100-226", whole), (2, "c:900-1026", whole)) + section("t2", (1, "c:5000-5126", broken)) + section("t3", (5, "d:126-0", whole)))
    pairs = spark.createDataFrame([("t1.1", whole, whole), ("t1.2", whole, whole), ("t2.1", whole, broken), ("t3.5", whole, whole)], "projection string, ref string, query string")
    isoforms = spark.createDataFrame([("g1", "t1"), ("g2", "t2"), ("g3", "t3")], "gene string, transcript string")
    scores = spark.createDataFrame([("t1.1", 0.9), ("t1.2", 0.8), ("t3.5", 0.7)], "projection string, score double")
    paralogs = spark.createDataFrame([("t9.9",)], "projection string")
    found = conclusion.conclude(pairs, aligner_output.read_sections(spark, str(tmp_path)), isoforms, scores, paralogs)
    assert {(r["level"], r["id"]): r["class"] for r in found["losses"].collect()} == {
        ("PROJECTION", "t1.1"): "I", ("PROJECTION", "t1.2"): "I", ("PROJECTION", "t2.1"): "L", ("PROJECTION", "t3.5"): "I",
        ("TRANSCRIPT", "t1"): "I", ("TRANSCRIPT", "t2"): "L", ("TRANSCRIPT", "t3"): "I", ("GENE", "g1"): "I", ("GENE", "g2"): "L", ("GENE", "g3"): "I",
    }
    assert {(r["exon"], r["position"], r["mut"]) for r in found["mutations"].where("mclass = 'STOP' AND NOT masked").collect()} == {(1, 12, "AAA->TAA"), (1, 23, "AAA->TGA")}
    types = [(r["r_gene"], r["orthology_class"]) for r in found["orthology"].collect()]
    assert sorted(types) == [("g1", "one2many"), ("g1", "one2many"), ("g2", "one2zero"), ("g3", "one2one")]
    assert {r["name"]: (r["chrom"], r["start"], r["end"], r["strand"]) for r in found["tracks"].collect()}["t3.5"] == ("d", 0, 126, "-")
    assert found["query_genes"].select("gene").distinct().count() == 3

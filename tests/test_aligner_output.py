"""Places of exons and the tables of an aligner's records, against hand-made and plain versions."""

import random

from loomspan.operators import aligner_output, placing


def test_exons_lie_where_their_letters_are(spark):
    rng = random.Random(2)
    rows, want = [], []
    for k in range(60):
        ref, que = [], []
        for _ in range(rng.randrange(5)):
            for t in (" " * rng.randrange(1, 4), "".join(rng.choices("ACg->", [4, 4, 2, 1, 1], k=rng.randrange(1, 9)))):
                ref.append(t)
                que.append("".join(rng.choices("acgt-", [4, 4, 2, 1, 6], k=len(t))))
        ref, que = "".join(ref), "".join(que)
        rows.append((k, ref, que))
        start, end, forward = 1000 * k, 1000 * k + 500, k % 2 == 0
        # Each query letter has a place of its own in the locus.
        places = {}
        for i, q in enumerate(que):
            if q != "-":
                places[i] = start + len(places) if forward else end - 1 - len(places)
        exon = -1
        for i, t in enumerate(ref):
            if t != " " and (i == 0 or ref[i - 1] == " "):
                exon += 1
                want.append([k, exon, []])
            if t != " " and i in places:
                want[-1][2].append(places[i])
    pairs = spark.createDataFrame(rows + [(99, None, None)], "k int, ref string, query string")
    loci = spark.createDataFrame([(k, "c", 1000 * k, 1000 * k + 500, k % 2 == 0) for k in range(100)], "k int, chrom string, start long, end long, forward boolean")
    got = {(r["k"], r["exon"]): (r["s"], r["e"], r["strand"], r["n_bases"]) for r in placing.place_exons(placing.exon_spans(pairs, "k"), loci, "k").collect()}
    assert got == {(k, x): (min(p), max(p) + 1, "+" if k % 2 == 0 else "-", len(p)) if p else (None, None, None, 0) for k, x, p in want}


def test_exons_on_joined_fragments(spark):
    spans = spark.createDataFrame([("a", 0, 5, 10), ("a", 1, 45, 10), ("a", 2, 90, 20), ("a", 3, None, 0), ("a", 4, 200, 5)], "k string, exon long, first_at long, n_bases long")
    parts = [("a", 0, 7, "x", 100, 150, True, 1000), ("a", 1, 8, "y", 300, 350, False, 340), ("a", 2, 9, "z", 40, 60, True, 55)]
    fragments = spark.createDataFrame(parts, "k string, nth int, chain_id long, chrom string, start long, end long, forward boolean, chrom_size long")
    place = lambda r: (r["chrom"], r["s"], r["e"], r["strand"])
    got = {r["exon"]: place(r) for r in placing.place_on_fragments(spans, fragments, "k").collect()}
    none = (None,) * 4
    assert got == {0: ("x", 105, 115, "+"), 1: ("x", 145, 155, "+"), 2: ("y", 290, 310, "-"), 3: none, 4: none}
    cut = sorted(((r["exon"], r["n_bases"], place(r)) for r in placing.place_on_fragments(spans, fragments, "k", split=True).where("exon < 3").collect()), key=repr)
    assert cut == sorted([(0, 10, ("x", 105, 115, "+")), (1, 5, ("x", 145, 150, "+")), (1, 5, none), (2, 10, ("y", 300, 310, "-")), (2, 10, ("z", 40, 50, "+"))], key=repr)
    clash = placing.clashing_exons(placing.place_on_fragments(spans, fragments, "k"), "k").collect()
    assert clash == []


SECTIONS = """#one
>one.4 | PROT | QUERY
MK
!remark
L*
>one | 0 | 4 | reference_exon
ATG-A
>one | 0 | 4 | chr1:500-490 | 90.0 | 80.0 | OK | A | exp:1-2 | INC | False | query_exon
ATGCA
>one | 1 | 4 | reference_exon
CC-
>one | 1 | 4 | chr1:480-470 | 10.0 | 5.0 | GAP | C | exp:1-2 | EXCL | False | query_exon
CCC
>one | 2 | 4 | reference_exon
TAA
>one | 2 | 4 | chr1:460-457 | 50.0 | 30.0 | OK | B | exp:1-2 | EXCL | False | query_exon
TAG
>one | x | 4 | chr1:1-2 | 50.0 | 30.0 | OK | B | exp:1-2 | EXCL | False | query_exon
TAG
#two
lost words
>two | 0 | 7 | reference_exon
ATG
>two | 0 | 7 | None:0 | 90.0 | 90.0 | N/A | A | exp | INC | False | query_exon
NNN
#three
>three.1 | CODON | REFERENCE
ATG TAA
#four
>four | 0 | -1 | chr1:10-20 | 90 | 90 | OK | A | e | INC | False | query_exon
A
>four | 1 | -1 | chr1:30-40 | 90 | 90 | OK | A | e | INC | False | query_exon
A
>four | 2 | -1 | chr1:5-8 | 90 | 90 | OK | A | e | INC | False | query_exon
A
>four | 3 | -1 | chr2:9-7 | 90 | 90 | OK | A | e | INC | False | query_exon
A
"""


def test_records_become_tables(spark, tmp_path):
    (tmp_path / "a.txt").write_text(SECTIONS)
    (tmp_path / "b.txt").write_text("#gone\n>gone | 0 | 1 | reference_exon\nAC\n")
    found = aligner_output.annotate_output(aligner_output.read_sections(spark, str(tmp_path)), spark.createDataFrame([("gone",)], "transcript string"))
    tracks = sorted((r["name"], r["chrom"], r["strand"], r["part"], r["start"], r["end"], r["exons"]) for r in found.tracks.collect())
    assert tracks == [
        ("four.-1", "chr1", "+", 0, 10, 40, [1, 2]), ("four.-1", "chr1", "+", 1, 5, 8, [3]), ("four.-1", "chr2", "-", 0, 7, 9, [4]), ("one.4", "chr1", "-", 0, 457, 500, [1, 3]),
    ]
    assert {(r["transcript"], r["exon"]): r["mark"] for r in found.exons.collect() if r["transcript"] != "four"} == {("one", 0): "HQ", ("one", 1): "NA", ("one", 2): "LQ", ("two", 0): "HQ"}
    assert [tuple(r) for r in found.removed.collect()] == [("chr1", 470, 480, "one.1.4", 100)]
    assert {r["projection"]: (r["ref"], r["query"]) for r in found.sequences.collect()} == {"one.4": ("ATG-ACCTAA", "ATGCA--TAG"), "two.7": ("ATG", "NNN")}
    assert [tuple(r) for r in found.proteins.collect()] == [("one.4 | PROT | QUERY", "MKL*")]
    assert [tuple(r) for r in found.codons.collect()] == [("three.1 | CODON | REFERENCE", "ATG TAA")]
    assert sorted(map(tuple, found.skipped.collect())) == [("gone", "excluded"), ("two.7", "all exons are deleted")]
    assert sorted((r["transcript"], r["reason"]) for r in found.rejects.collect()) == [("one", "exon or chain is no number"), ("two", "text before the first entry")]
    lines = sorted(tuple(r)[4:] for r in aligner_output.fragment_lines(found.tracks).collect())
    assert lines == [(1, 2), (3, 3), (4, 4)]


def test_an_empty_file(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n")
    found = aligner_output.annotate_output(aligner_output.read_sections(spark, str(tmp_path)))
    assert all(table.count() == 0 for table in found)


def test_tables_read_once_are_those_of_written_entries_and_write_nothing(spark, tmp_path, monkeypatch):
    entries = lambda name: "".join(f">{name} | {x} | {c} | reference_exon\nAC-\n>{name} | {x} | {c} | c1:{100 - 9 * x}-{103 - 9 * x} | {70 if x else 1} | {60 if x else 1} | OK | {'A' if x else 'C'} | exp:1-2 | EXCL | False | query_exon\nA-T\n" for c in (-1, 3) for x in range(3))
    (tmp_path / "a.txt").write_text("".join(f"#{name}\n{entries(name)}" for name in ("t1", "t2")))
    out = spark.createDataFrame([("t2",)], "transcript string")
    read = lambda: aligner_output.read_sections(spark, str(tmp_path / "a.txt"))
    written = aligner_output.annotate_output(read(), out)
    want = {name: sorted(map(str, df.collect())) for name, df in written._asdict().items()}
    assert len(want["tracks"]) == 3 and len(want["sequences"]) == 2
    monkeypatch.setattr(aligner_output, "settle", None)
    once = aligner_output.annotate_output(read(), out, reused=False)
    assert {name: sorted(map(str, df.collect())) for name, df in once._asdict().items()} == want

import itertools
import random

import pytest
from pyspark.sql import functions as F

from loomspan.functions import sequences
from loomspan.operators import classify, loss, mutations, orthology, stitch
from loomspan.operators.components import connected_components


def roots_of(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(40)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {r["node"]: r["root"] for r in got} == roots_of(edges)


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def edge_table(spark, edges):
    return orthology.with_components(spark.createDataFrame([(r, q, float(s)) for r, q, s in edges], "r_gene string, q_gene string, score double"))


def test_classes(spark):
    edges = [("a", "1", 1), ("b", "2", 1), ("b", "3", 1), ("c", "4", 1), ("d", "4", 1)] + [(r, q, 1) for r in "ef" for q in "56"]
    found = orthology.component_classes(edge_table(spark, edges)).collect()
    assert sorted((r["orthology_class"], r["is_complete"]) for r in found) == [("many2many", True), ("many2one", True), ("one2many", True), ("one2one", True)]
    genes = spark.createDataFrame([(g,) for g in "abz"], "r_gene string")
    types = orthology.orthology_types(genes, spark.createDataFrame([("a", "1", 0.0)], "r_gene string, q_gene string, score double")).collect()
    assert {(r["r_gene"], r["orthology_class"]) for r in types} == {("a", "one2one"), ("b", "one2zero"), ("z", "one2zero")}


def parts_of(spark, edges):
    found = orthology.split_many2many(edge_table(spark, edges)).collect()
    return sorted(sorted((r["r_gene"], r["q_gene"]) for r in group) for _, group in itertools.groupby(sorted(found, key=lambda r: r["component"]), key=lambda r: r["component"]))


def test_leaf_split_removes_a_weak_bridge(spark):
    edges = [("a", "1", 0.99), ("a", "2", 0.99), ("b", "3", 0.99), ("b", "2x", 0.99), ("a", "3x", 0.1), ("b", "3x", 0.99)]
    whole = [("a", "1", 1.0), ("a", "2", 1.0), ("b", "3", 1.0), ("b", "4", 1.0), ("a", "m", 0.1), ("b", "m", 0.2)]
    # The middle gene touches no leaf edge and would stand alone: not split.
    assert len(parts_of(spark, whole)) == 1
    joined = [("a", "1", 1.0), ("b", "2", 1.0), ("a", "x", 0.1), ("b", "x", 0.1), ("c", "x", 1.0), ("c", "y", 1.0), ("d", "y", 1.0), ("d", "x", 1.0)]
    assert len(parts_of(spark, joined)) == 3
    strong = [(r, q, 0.9 if s == 0.1 else s) for r, q, s in joined]
    assert len(parts_of(spark, strong)) == 1  # what would be removed scores too well
    assert edges


def test_leaf_split_keeps_strongly_connected_genes_together(spark):
    edges = [("a", "1", 1.0), ("a", "2", 0.1), ("a", "3", 0.1), ("b", "2", 1.0), ("b", "3", 1.0), ("c", "2", 1.0), ("c", "3", 1.0)]
    assert len(parts_of(spark, edges)) == 1


def test_sequences(spark):
    df = spark.createDataFrame([("ATGNAC-", "ATGTAAGG", "")], "a string, b string, c string")
    row = df.select(
        sequences.reverse_complement(F.col("a")).alias("rc"), sequences.translate(F.col("b")).alias("p"), sequences.translate(F.col("c")).alias("none"),
        sequences.projection_parts(F.lit("ENS.1.22"))[0].alias("t"), sequences.projection_parts(F.lit("ENS.1.22"))[1].alias("n"),
        sequences.identity_with_gaps(F.lit("AC-N"), F.lit("AT-A")).alias("i1"), sequences.identity_of_bases(F.lit("AC-N"), F.lit("AT-A")).alias("i2"),
    ).first()
    assert (row["rc"], row["p"], row["none"], row["t"], row["n"]) == ("-GTNCAT", "M*X", "", "ENS.1", "22")
    assert row["i1"] == pytest.approx(200 / 3) and row["i2"] == 50


def test_genetic_code():
    assert len(sequences.CODONS) == 64 and sequences.CODONS["ATG"] == "M" and [c for c, a in sequences.CODONS.items() if a == "*"] == ["TAA", "TAG", "TGA"]


@pytest.mark.parametrize(("states", "want"), [("I" * 9 + "L", (0.9, True, True)), ("ILMILMILI", (1 / 9, True, True)), ("I" * 8 + "LI", (0.8, False, True)), ("IMIIIIIIII", (0.9, True, False)), ("MMMM", (0.0, True, True)), ("I" * 18 + "LM", (0.9, True, True))])
def test_intact_features(spark, states, want):
    row = loss.intact_features(spark.createDataFrame([(states,)], "states string")).first()
    assert row["intact_ignore_m"] == pytest.approx(want[0]) and (row["middle_is_intact"], row["middle_is_present"]) == want[1:]


BASE = {"is_paralog": False, "exons": 3, "effective": 2, "ignore_m": 0.5, "intact_m": 0.5, "codons": 0.9, "out_of_chain": 0.0, "all_missing": False, "all_deleted": False, "any_missing": False, "missing_share": 0.0, "middle_intact": False, "middle_present": True, "single_deleted": False, "single_missing": False, "affected": 0, "big_exon_two": False, "big_exon_deleted": False}


@pytest.mark.parametrize(
    ("change", "want"),
    [
        ({"is_paralog": True}, "PG"), ({"exons": 0}, "N"), ({"effective": 0, "ignore_m": 0.7}, "I"), ({"codons": 0.3}, "L"), ({"codons": 0.3, "out_of_chain": 0.7}, "M"),
        ({"all_missing": True, "out_of_chain": 0.51}, "PM"), ({"all_missing": True, "out_of_chain": 0.5}, "M"), ({"all_deleted": True}, "L"), ({"intact_m": 0.1}, "L"),
        ({"middle_intact": True}, "I"), ({"middle_intact": True, "codons": 0.4}, "UL"), ({"middle_intact": True, "any_missing": True, "middle_present": False, "missing_share": 0.3}, "PI"),
        ({"middle_intact": None}, "UL"), ({"affected": 2}, "L"), ({"exons": 1, "effective": 2}, "L"), ({"exons": 1, "effective": 1}, "UL"), ({"intact_m": 0.7, "out_of_chain": 0.6}, "PM"),
    ],
)
def test_loss_ladder(spark, change, want):
    values = BASE | change
    kinds = ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'int' if isinstance(v, int) else 'double'}" for k, v in BASE.items())
    assert loss.loss_class(spark.createDataFrame([tuple(values[k] for k in BASE)], kinds)).first()["loss"] == want


def test_roll_up_takes_the_best_and_predefined_wins(spark):
    found = spark.createDataFrame([("p1", "t1", "L"), ("p2", "t1", "I"), ("p3", "t2", "UL")], "projection string, transcript string, loss string")
    isoforms = spark.createDataFrame([("g", "t1"), ("g", "t2"), ("h", "t3")], "gene string, transcript string")
    given = spark.createDataFrame([("PROJECTION", "p2", "M"), ("TRANSCRIPT", "t3", "M")], "level string, id string, class string")
    got = {(r["level"], r["id"]): r["class"] for r in loss.roll_up(found, isoforms, given).collect()}
    assert got[("TRANSCRIPT", "t1")] == "L" and got[("GENE", "g")] == "UL" and got[("GENE", "h")] == "M" and got[("PROJECTION", "p2")] == "M"


def plain_compensations(shifts, codons):
    """Series begun at each shift in turn; the whole-codon ones without a stop and without used shifts."""
    found, used = [], 0
    for i in range(len(shifts)):
        j = next((j for j in range(i + 1, len(shifts)) if sum(s for _, s in shifts[i : j + 1]) % 3 == 0), None)
        if j is None or i < used:
            continue
        bases = "".join(codons[n].replace("-", "") for n in sorted(codons) if shifts[i][0] <= n <= shifts[j][0])
        if not {bases[k : k + 3] for k in range(0, len(bases), 3)} & {"TAA", "TAG", "TGA"}:
            found.append((i + 1, j + 1, shifts[i][0], shifts[j][0]))
            used = j + 1
    return found


def test_compensations(spark):
    rng = random.Random(6)
    plain = dict.fromkeys(range(1, 20), "AAA")
    cases = {
        1: ([(2, 1), (4, 1), (6, 1)], plain),
        2: ([(2, 1), (4, 2), (6, -1), (8, 1)], plain),
        3: ([(2, 1), (4, 1), (6, 1)], plain | {3: "ATAAAA", 2: "AA"}),  # AAA TAA: a stop in the shifted frame
        4: ([(2, 1)], plain),
    }
    for k in range(5, 45):
        codons = {n: "".join(rng.choices("ACGT-", [3, 2, 2, 3, 1], k=rng.choice([3, 3, 3, 4, 2, 5]))) for n in range(1, rng.randrange(2, 60))}
        cases[k] = ([(n, rng.choice([-2, -1, 1, 2, 4])) for n in sorted(rng.sample(sorted(codons), rng.randrange(len(codons)) // 3))], codons)
    codons = spark.createDataFrame([(k, n, c) for k, (_, cs) in cases.items() for n, c in cs.items()], "k int, codon long, que_codon string")
    shifts = spark.createDataFrame([(k, n, z) for k, (ss, _) in cases.items() for n, z in ss], "k int, codon long, size long")
    got = {}
    for r in mutations.compensations(codons, shifts, "k").orderBy("k", "first_shift").collect():
        got.setdefault(r["k"], []).append(tuple(r)[1:])
    assert got == {k: found for k, (ss, cs) in cases.items() if (found := plain_compensations(ss, cs))}
    assert got[1] == [(1, 3, 2, 6)] and got[2] == [(1, 2, 2, 4), (3, 4, 6, 8)] and 3 not in got and 4 not in got


def paths(chains, overlap=250):
    best = (0.0, [])
    for n in range(1, len(chains) + 1):
        for p in itertools.permutations(chains, n):
            if all(y[0] >= x[1] - overlap and y[0] > x[0] for x, y in itertools.pairwise(p)):
                best = min(best, (-sum(c[2] for c in p), [c[3] for c in p]), key=lambda o: (round(o[0], 9), o[1]))
    return -best[0]


@pytest.mark.parametrize("seed", range(6))
def test_best_path_matches_brute_force(seed):
    rng = random.Random(seed)
    chains = [(s := rng.randrange(3000), s + rng.randrange(100, 900), rng.randrange(50, 100) / 100, i) for i in range(6)]
    found = stitch.best_path(chains)
    by = {c[3]: c for c in chains}
    assert sum(by[i][2] for i in found) == pytest.approx(paths(chains))
    assert all(by[y][0] >= by[x][1] - 250 for x, y in itertools.pairwise(found))


def test_choose_chains_by_priority(spark):
    rows = [("g", 5, "PARA"), ("g", 7, "ORTH"), ("g", 3, "ORTH"), ("h", 1, "PARA"), ("h", 2, "SPAN"), ("i", 9, "P_PGENES")]
    got = classify.choose_chains(spark.createDataFrame(rows, "gene string, chain_id long, chain_class string"), limit=1).collect()
    assert {(r["gene"], r["chain_id"], r["kept"]) for r in got} == {("g", 3, True), ("g", 7, False), ("h", 2, True)}


def test_losses_of_a_frame_without_bases(spark):
    exons = spark.createDataFrame([(1, 1, 0), (2, 1, 6)], "k long, exon long, size long")
    found = spark.createDataFrame([(1, 1, "Deleted exon", False)], "k long, exon long, mclass string, masked boolean")
    shares = spark.createDataFrame([], "k long, ignore_m double, intact_m double, intact_codons double, middle_is_intact boolean, middle_is_present boolean")
    none = spark.createDataFrame([], "k long, out_of_chain double")
    rows = loss.loss_features(found, shares, exons, none, none.select("k"), "k")
    got = {r["k"]: (r["missing_share"], r["big_exon_deleted"]) for r in rows.collect()}
    # As in SQL, no share of no bases is below any limit.
    assert got == {1: (None, True), 2: (0.0, False)}


def test_components_of_neighbouring_edges_take_one_round(spark, monkeypatch):
    from loomspan.operators import components

    settled, calls = components.settle_measured, []
    monkeypatch.setattr(components, "settle_measured", lambda *a, **k: (calls.append(1), settled(*a, **k))[1])
    edges = spark.range(0, 3000, 1, 1).where("id % 100 < 99").select(F.concat(F.lit("n"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("a"), F.concat(F.lit("n"), F.lpad((F.col("id") + 1).cast("string"), 5, "0")).alias("b"))
    got = {tuple(r) for r in connected_components(edges, "a", "b").collect()}
    assert got == {(f"n{i:05}", f"n{i // 100 * 100:05}") for i in range(3000)} and len(calls) == 2

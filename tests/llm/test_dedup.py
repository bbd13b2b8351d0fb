import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomspan.llm import exact_dedup, line_dedup, simhash
from loomspan.llm.common import settle

EDGE = [(1, None), (2, ""), (3, "a"), (4, "a"), (4, "a"), (None, "a"), (5, "x" * 300_000), (6, "x" * 300_000 + "y"), (7, "x" * 300_000), (8, " \n\t"), (9, "é ü\n\n"), (10, "e u"), (None, "nameless"), (None, "nameless")]


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(i, t, "s", "clash", 1) for i, t in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, keep_id string, size int")


@pytest.mark.parametrize("broadcast_keys", [exact_dedup.BROADCAST_KEYS, 0])
def test_exact_dedup_matches_brute_force(spark, edge, broadcast_keys):
    got = exact_dedup.exact_dedup(edge, carry={"sha": lambda t: F.sha2(t, 256)}, broadcast_keys=broadcast_keys).collect()
    groups = {}
    for i, t in EDGE:
        groups.setdefault(t or "", []).append(i)
    want = sorted((i or -1, max((x for x in g if x is not None), default=-1), len(g)) for g in groups.values() for i in g)
    assert sorted((r["doc_id"] or -1, r["keep_id"] or -1, r["group_size"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    by = {r["doc_id"]: r["sha"] for r in got}
    assert by[9] == hashlib.sha256("é ü\n\n".encode()).hexdigest()


def test_exact_dedup_normalises(spark):
    df = spark.createDataFrame([(1, "A b"), (2, "a B")], "doc_id long, text string")
    assert {r["keep_id"] for r in exact_dedup.exact_dedup(df, normalise=F.lower).collect()} == {2}


def test_empty_tables(spark, edge):
    none = edge.where("doc_id = -1")
    assert exact_dedup.exact_dedup(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert line_dedup.remove_boilerplate(none).count() == 0


def slow_print(text, width=3):
    words = []
    for w in (text or "").encode().split():
        words.append(bytes(c + 32 if 65 <= c <= 90 else c for c in w))
    if not words:
        return 0
    grams = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "One two", "One two three", "a b c d e f a b c d", "É e É e " * 50, "w " * 40_000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) & (2**64 - 1) == slow_print(text)


def brute_links(prints, distance):
    return {tuple(sorted((a, b))) for i, a in enumerate(prints) for b in prints[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= distance}


def close_prints(seed, n, most=5):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(8)]
    found = set()
    while len(found) < n:
        x = rng.choice(centres)
        for _ in range(rng.randrange(most)):
            x ^= 1 << rng.randrange(64)
        found.add(x)
    return sorted(np.array(sorted(found), dtype=np.uint64).view(np.int64).tolist())


@pytest.mark.parametrize(("distance", "crowded", "broadcast_keys"), [(3, 200, 2_000_000), (3, 2, 2_000_000), (3, 2, 0), (2, 3, 10), (0, 5, 10)])
def test_links_match_brute_force_each_once(spark, distance, crowded, broadcast_keys):
    prints = close_prints(distance, 300)
    got = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), distance, crowded, broadcast_keys).collect()
    assert sorted(map(tuple, got)) == sorted(brute_links(prints, distance))


def test_fingerprints_in_one_half(spark):
    """Many fingerprints with one half equal: the crowded way, all bits of the other half apart or close."""
    rng = random.Random(9)
    prints = sorted({(7 << 32) | (rng.getrandbits(7) << rng.randrange(25)) for _ in range(400)})
    got = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), 3, 20).collect()
    assert len(got) == len(set(map(tuple, got))) and {tuple(sorted(r)) for r in got} == brute_links(prints, 3)


def test_near_duplicates_label_components(spark, edge):
    base = [f"w{i}" for i in range(400)]
    rows = [(20, " ".join(base)), (12, " ".join([*base[:399], "other"])), (30, " ".join(base)), (40, "quite another text"), (None, "quite another text"), (50, None), (51, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()}
    prints = {i: simhash.fingerprint(t) for i, t in rows}
    linked = (prints[20] ^ prints[12]).bit_count() <= 3
    assert got == {20: 12 if linked else 20, 12: 12, 30: 12 if linked else 20, 40: 40, None: 40, 50: 50, 51: 50}
    assert simhash.near_duplicates(edge).count() == len(EDGE)


def test_boilerplate_by_distinct_sites(spark):
    rows = [(i, f"own {i}\n common \nshared\t", f"s{i % 12}") for i in range(40)] + [(100, "twice\ntwice", "s1"), (101, None, None), (102, "", "s2"), (103, "common", None), (103, "common", None)]
    rows += [(200 + i, "copied often in one site", "s1") for i in range(50)] + [(300 + i, "at ten sites", f"t{i}") for i in range(10)] + [(400 + i, "at nine sites", f"t{i}") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_lines", F.lit("clash"))
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["clean_text"]) for r in line_dedup.remove_boilerplate(df, 10).collect()}
    assert got[5] == (3, 2, "own 5") and got[100] == (2, 0, "twice\ntwice") and got[101] == (0, 0, "") and got[102] == (0, 0, "")
    assert got[103] == (1, 1, "") and got[200] == (1, 0, "copied often in one site") and got[300] == (1, 1, "") and got[400] == (1, 0, "at nine sites")
    assert line_dedup.remove_boilerplate(df, 10).count() == len(rows)


def test_sketches_that_err_are_counted(spark):
    """With tiny sketches estimates are far off; the lines near the threshold are right all the same."""
    rows = [(n * 100 + i, f"line {n}", f"site {i}") for n in range(30, 50) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"] // 100 for r in line_dedup.remove_boilerplate(df, 40, lg_k=4).where("n_removed > 0").collect()}
    assert got == set(range(40, 50))


def test_shingles_and_minima():
    assert len(simhash.shingles("a b c")) == 1 and len(simhash.shingles("a b c d e f")) == 2 and len(simhash.shingles("a " * 50)) == 1
    assert len(simhash.shingles(None)) == len(simhash.shingles(" ")) == 0
    rng = np.random.default_rng(4)
    for common in (50, 90):
        sets = [np.unique(rng.integers(0, 1 << 63, (2, n), dtype=np.uint64)) for n in (common, (100 - common) // 2 or 1)]
        x, y = np.concatenate(sets[:1] + [sets[1][::2]]), np.concatenate(sets[:1] + [sets[1][1::2]])
        true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        same = np.mean([(simhash.minima(x ^ np.uint64(t), 64) == simhash.minima(y ^ np.uint64(t), 64)).mean() for t in range(1, 40)])
        assert abs(same - true) < 0.05
    # Long sets are taken in parts.
    long = rng.integers(0, 1 << 63, 10_000, dtype=np.uint64)
    assert (simhash.minima(long, 8) == np.minimum(simhash.minima(long[:5000], 8), simhash.minima(long[5000:], 8))).all()


def brute_similar(rows):
    sets = {i: set(simhash.shingles(t).tolist()) for i, t in rows if i is not None and t}
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}


def groups_of(pairs):
    label = {i: i for p in pairs for i in p}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return label


def found_groups(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["node"]: r["root"] for r in simhash.similar_texts(df, **options).collect()}


@pytest.mark.parametrize("frequent", [simhash.FREQUENT, 5])
def test_similar_texts_match_brute_force(spark, frequent):
    rng = random.Random(11)
    base = [f"w{rng.randrange(3000)}" for _ in range(200)]
    texts = {0: base}
    for i in range(1, 60):  # copies of one text, nearer to it than to each other
        texts[i] = list(base)
        for k in rng.sample(range(200), rng.randrange(1, 5)):
            texts[i][k] = f"x{rng.randrange(10**6)}"
    for i in range(100, 400, 2):
        texts[i] = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(8, 300))]
        texts[i + 1] = texts[i][: rng.randrange(5, len(texts[i]) + 1)] + ["tail"]
    rows = [(i, " ".join(t)) for i, t in texts.items()] + [(900, None), (901, ""), (902, ""), (None, " ".join(base)), (903, "one"), (904, "one"), (905, "one two")]
    assert found_groups(spark, rows, frequent=frequent) == groups_of(brute_similar(rows))


def test_known_pairs_count(spark):
    rows = [(i, " ".join(f"{i}-{k}" for k in range(20))) for i in range(5)] + [(9, " ".join(f"4-{k}" for k in range(20)))]
    known = spark.createDataFrame([(1, 0), (3, 4)], "a long, b long")
    assert found_groups(spark, rows, known=known) == {0: 0, 1: 0, 3: 3, 4: 3, 9: 3}
    assert found_groups(spark, rows[:5]) == {} and found_groups(spark, []) == {}


def test_short_copies_with_one_word_changed_are_all_found(spark):
    rng = random.Random(5)
    rows = []
    for i in range(0, 600, 2):
        words = [f"w{rng.randrange(50_000)}" for _ in range(rng.randrange(50, 65))]
        rows.append((i, " ".join(words)))
        words[rng.randrange(len(words))] = "changed"
        rows.append((i + 1, " ".join(words)))
    want = brute_similar(rows)
    assert len(want) > 200 and found_groups(spark, rows) == groups_of(want)


def test_near_copies_within_a_template_hang_together(spark, monkeypatch):
    """More texts than ``frequent`` share a template; those among them that are near copies meet whoever leads."""
    rng = random.Random(8)
    template = [f"t{k}" for k in range(300)]
    rows = []
    for i in range(0, 120, 2):
        words = template + [f"w{rng.randrange(10**6)}" for _ in range(40 if i < 20 else 100)]
        rows.append((i, " ".join(words)))
        for k in rng.sample(range(len(words)), 3):
            words[k] = f"x{rng.randrange(10**6)}"
        rows.append((i + 1, " ".join(words)))
    # A chain, each near the next alone: a leader has no more than two of it.
    chain = [f"c{k}" for k in range(600)]
    rows += [(200 + i, " ".join(chain[10 * i : 10 * i + 100])) for i in range(50)]
    want = groups_of(brute_similar(rows))
    monkeypatch.setattr(simhash, "LEADERS", 1)
    for frequent in (1, 5):
        assert found_groups(spark, rows, frequent=frequent) == want, frequent


def test_linked_rows_connect_what_the_operator_connects(spark):
    rng = random.Random(2)
    base = [f"w{k}" for k in range(900)]
    rows = [(i, " ".join(base if i % 3 else [*base[:500], f"x{rng.randrange(4)}", *base[501:]])) for i in range(12)] + [(20, ""), (21, None), (22, "alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    label = groups_of([tuple(r) for r in simhash.linked_rows(df, "doc_id").collect()])
    assert {i: label.get(i, i) for i, _ in rows} == {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()}


def test_changed_copies_of_a_template_meet_only_their_like(spark):
    rng = random.Random(23)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(150):  # a third close to the template, the rest in families of three far from it and from each other
        if i % 3 == 0 or i < 6:
            words = list(base)
            changes = rng.randrange(3) if i % 3 == 0 else 5
        else:
            words = list(base)
            family = random.Random(i // 6)
            for k in family.sample(range(120), 14):
                words[k] = f"f{family.randrange(10**6)}"
            changes = 1
        for k in rng.sample(range(120), changes):
            words[k] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    assert found_groups(spark, rows) == groups_of(brute_similar(rows))


def test_prefixes_lose_no_similar_pair_of_different_roots(spark):
    rng = random.Random(29)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(120):
        words = list(base[: rng.randrange(40, 61)])
        for k in rng.sample(range(len(words)), rng.randrange(4)):
            words[k] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    texts = spark.createDataFrame(rows, "id long, text string")
    apart = settle(texts.select("id", (F.col("id") % 7).alias("root")), "test-apart")
    found = {(r["a"], r["b"]) for r in simhash._across_groups(texts, apart, 0.8, 5).collect()}
    wanted = {(a, b) for a, b in brute_similar(rows) if a % 7 != b % 7}
    assert wanted <= found and all(a % 7 != b % 7 for a, b in found)
    assert len(wanted) > 50

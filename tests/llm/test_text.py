import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.llm import decontaminate, licenses, passages, quality


def test_masks_find_three_changed_words_in_thirteen():
    for changed in itertools.combinations(range(decontaminate.WINDOW), decontaminate.MOST_CHANGED):
        hit = any(all(at + i not in changed for i in m) for m in decontaminate.MASKS for at in range(decontaminate.WINDOW - m[-1]))
        assert hit, changed


def words(rng, n):
    return [f"{rng.choice('abcdefgh')}{rng.randrange(500)}" for _ in range(n)]


def leaked(item, text):
    if len(item) < decontaminate.LEAST_WORDS:
        return False
    if len(item) < decontaminate.WINDOW:
        return any(text[i : i + len(item)] == item for i in range(len(text) - len(item) + 1))
    return any(sum(x == y for x, y in zip(item[a : a + 13], text[b : b + 13], strict=True)) >= 10 for a in range(len(item) - 12) for b in range(len(text) - 12))


@pytest.mark.parametrize("block_seeds", [decontaminate.BLOCK_SEEDS, 40])
def test_contamination_matches_brute_force(spark, block_seeds):
    rng = random.Random(3)
    items = [words(rng, n) for n in (3, 5, 7, 8, 9, 12, 13, 14, 40, 40)]
    texts = []
    for item in items:
        for changed in (0, 1, 3, 4, 6):
            copy = list(item)
            for i in rng.sample(range(len(copy)), min(changed, len(copy))):
                copy[i] = "changed"
            texts.append(words(rng, rng.randrange(30)) + copy + words(rng, rng.randrange(30)))
        texts.append(item[:13])
        texts.append(item[-13:] + words(rng, 5))
    docs = [(i, " ".join(t).upper() if i % 2 else ", ".join(t), "clash") for i, t in enumerate(texts)] + [(900, None, ""), (901, "", ""), (None, " ".join(items[8]), "")]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)] + [(90, None), (91, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contamination(df, bench, block_seeds=block_seeds).collect()}
    assert got == {(d, i) for d, t in enumerate(texts) for i, item in enumerate(items) if leaked(item, t)} | {(None, 8)}
    kept = decontaminate.decontaminate(df, bench)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {d for d, _, _ in docs} - {d for d, _ in got}


def test_contamination_of_nothing(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h i j k l m n")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(df, none).count() == 0
    assert decontaminate.contamination(df.where("doc_id = 2"), df.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_licenses(spark):
    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    rows = [
        (1, "All rights reserved. Under CC-BY; all RIGHTS reserved"), (2, "the GNU General Public License, version 3."), (3, "general public licensee"), (4, None), (5, ""), (6, notice),
        (7, "Released under the MIT License."), (8, "the mit is a place with a license"), (9, "word " * 50_000 + "all rights reserved"), (10, "all all rights reserved reserved"), (10, "cc by cc by"),
        (11, "This work is licensed under the GNU General Public License, version 3."), (12, "rights reserved all rights"),
    ]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, labels string")
    got = [tuple(r) for r in licenses.scan_licenses(df).collect()]
    by = {}
    for r in got:
        by.setdefault(r[0], []).append(r[1:])
    assert by[1][0][:5] == (9, 3, 0, 6, "cc-by,reserved") and by[3][0][:5] == (3, 0, None, None, "")
    assert by[4] == by[5] == [(0, 0, None, None, "", "", 0.0)]
    assert by[6][0][4:6] == ("", "mit") and by[6][0][6] >= 0.99 and by[7][0][5] == "mit" and by[8][0][5] == ""
    assert by[9][0][1:4] == (1, 50_000, 50_000) and sorted(x[1:4] for x in by[10]) == [(1, 1, 1), (2, 0, 2)]
    assert by[11][0][5] == "gpl,gpl-3.0" and by[12][0][4] == "" and all(0 <= r[7] <= 1 for r in got)
    assert licenses.scan_licenses(df.where("doc_id = 0")).count() == 0


def test_base_phrases_match_brute_force(spark):
    rng = random.Random(5)
    parts = ["all", "rights", "reserved", "cc", "by", "general", "public", "license", "x"]
    texts = [" ".join(rng.choice(parts) for _ in range(60)) for _ in range(60)]
    got = {r["doc_id"]: (r["n_base"], r["first_word"], r["last_word"]) for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        w = t.split()
        at = [k for p in licenses.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        assert got[i] == (len(at), min(at, default=None), max(at, default=None))


def test_template_labels_match_brute_force():
    """Changed notices in other words: every place of every template is tried without the index."""
    rng = random.Random(9)
    templates = licenses.all_templates()
    index = licenses.RareTokenIndex(templates, {b"the": 900, b"of": 800, b"software": 90, b"license": 40, b"public": 60}, 1000)
    common = [b"the", b"of", b"software", b"license", b"x", b"public", b"copyright", b"notice"]
    labelled = 0
    for _ in range(250):
        text = [rng.choice(common) for _ in range(rng.randrange(30))]
        for t in rng.sample(templates, rng.randrange(3)):
            notice = list(t.words)
            for _ in range(rng.randrange(1 + len(notice) // 4)):
                at = rng.randrange(len(notice))
                notice[at : at + rng.randrange(2)] = [rng.choice(common)] * rng.randrange(2)
            text += notice + [rng.choice(common) for _ in range(rng.randrange(20))]
        places, shares = index.scan(text)
        for n, t in enumerate(templates):
            if t.base:
                assert places.get(n, []) == [o for o in range(len(text)) if tuple(text[o : o + len(t.words)]) == t.words]
            else:
                best = max(index.share(n, text, o) for o in range(-len(t.words), len(text) + 1))
                assert shares.get(n, 0.0) == (best if best >= licenses.LEAST_SHARE else 0.0), (t.label, text)
                labelled += n in shares
    assert labelled > 100


def test_licence_bodies(spark):
    """Whole texts of well-known licences, as they stand in files."""
    mit = '''Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:'''
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    apache = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    rows = [(1, mit), (2, bsd), (3, apache), (4, gpl), (5, "permission to use the software is a matter of licence conditions and public notice")]
    got = {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "mit", 2: "bsd", 3: "apache-2.0", 4: "gpl,gpl-family", 5: ""}


SMALL = passages.Settings(kmer=3, window=4, least_words=20)


def test_seeds_leave_no_long_run_without():
    rng = random.Random(1)
    w = np.array([rng.getrandbits(63) for _ in range(500)], dtype=np.uint64)
    at, h = passages.seeds_of(w, 5, 12, 50)
    assert np.diff(at).max() <= 12 and at[0] < 12 and at[-1] >= len(w) - 5 - 12 and len(set(at.tolist())) == len(at)
    again, _ = passages.seeds_of(w[100:300], 5, 12, 50)
    assert set((again + 100).tolist()) - set(at.tolist()) <= set(range(100, 112)) | set(range(285, 300))
    for n in (0, 1, 4, 5, 6, 16):
        assert len(passages.seeds_of(w[:n], 5, 12, 50)[0]) == (0 if n < 5 else len(passages.seeds_of(w[:n], 5, 12, 50)[0]))


def test_fenwick_is_a_prefix_maximum():
    rng = random.Random(2)
    tree, values = passages.Fenwick(40), {}
    for step in range(300):
        at, v = rng.randrange(40), rng.random()
        tree.put(at, (v, step))
        values[at] = max(values.get(at, (-1e300, -1)), (v, step))
        upto = rng.randrange(41)
        assert tree.upto(upto) == max([v for k, v in values.items() if k < upto], default=(-1e300, -1))


@pytest.mark.parametrize(("reach", "most_gap"), [(100, 150), (900, 150), (900, 40)])
def test_chains_are_collinear_and_best(reach, most_gap):
    """Against a quadratic chainer with the same greatest gap; far better chains beside near ones are among the cases."""
    rng = random.Random(reach + most_gap)
    settings = passages.Settings(kmer=3, window=4, least_words=20, most_gap=most_gap)
    for _ in range(60):
        n = rng.choice((12, 60))
        d, s = np.array([rng.randrange(reach) for _ in range(n)]), np.array([rng.randrange(reach) for _ in range(n)])
        if rng.random() < 0.5:  # a long run at the start, the rest beyond the greatest gap
            d, s = np.concatenate((np.arange(0, 300, 3), d + 450)), np.concatenate((np.arange(0, 300, 3), s + 450))
        found = passages.chains(d, s, settings)
        runs = passages.runs(d, s, settings.window, settings.kmer)
        assert sorted(r for _, c in found for r in c) == sorted(runs)
        best = []
        for x, y, m in runs:
            gain = 0.0
            for j, (a, b, k) in enumerate(runs[: len(best)]):
                gaps = x - a - k, y - b - k
                if 0 <= min(gaps) and max(gaps) <= most_gap:
                    gain = max(gain, best[j] - settings.gap_cost * sum(gaps))
            best.append(m + gain)
        assert found[0][0] == pytest.approx(max(best))
        for _, chain in found:
            assert all(0 <= y[k] - x[k] - x[2] <= most_gap for x, y in itertools.pairwise(chain) for k in (0, 1))


def test_of_chains_within_a_better_one_the_best_is_left():
    d = np.concatenate((np.arange(0, 90, 3), np.arange(30, 60, 3), np.arange(300, 330, 3)))
    source = np.concatenate((np.full(30, 2), np.full(10, 1), np.full(10, 1)))
    kept = passages.best_chains(d, source, d + 7, SMALL)
    assert [(n, c[0][0], c[-1][0] + c[-1][2]) for n, c in kept] == [(2, 0, 90), (1, 300, 330)]


def test_passages_whose_pieces_have_other_owners(spark):
    """Earlier rows that quote pieces, and a long common opening far before, hide no passage that two rows share."""
    rng = random.Random(12)
    long, opening = words(rng, 80), words(rng, 1000)
    second = words(rng, 30), words(rng, 30)
    filler = lambda: words(rng, rng.randrange(5, 30))
    texts = {i: filler() + long[8 * i : 8 * i + 20] + filler() for i in range(8)}
    texts |= {100: filler() + long + filler(), 200: filler() + long + filler()}
    texts |= {300: opening + words(rng, 4000) + second[0] + second[1], 301: opening + words(rng, 4000) + second[0] + words(rng, 2) + second[1]}
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    got = {(r["doc_id"], r["source_id"], r["n_words"]) for r in passages.repeated_passages(df).collect()}
    assert any(d == 200 and s == 100 and n >= 80 for d, s, n in got)
    assert any(d == 301 and s == 300 and 60 <= n <= 64 for d, s, n in got) and any(d == 301 and n >= 1000 for d, _, n in got)
    assert {d for d, _, _ in got} == {200, 301}


@pytest.mark.parametrize("owners", [4, 9])
def test_passages_whose_every_piece_has_many_owners(spark, owners):
    rng = random.Random(13)
    long = words(rng, 80)
    filler = lambda: words(rng, rng.randrange(5, 30))
    texts = {owners * i + k: filler() + long[10 * i : 10 * i + 20] + filler() for i in range(7) for k in range(owners)}
    texts |= {100: filler() + long + filler(), 200: filler() + long + filler()}
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    got = [(r["doc_id"], r["source_id"], r["n_words"]) for r in passages.repeated_passages(df).collect()]
    assert [(d, s) for d, s, _ in got] == [(200, 100)] and got[0][2] >= 80


@pytest.mark.parametrize("owners", [5, 60])
def test_passages_whose_pieces_rows_between_have_too(spark, owners):
    """Rows before and between the two quote all pieces, by ``owners`` each: no cap hides the passage."""
    rng = random.Random(14)
    long = words(rng, 80)
    filler = lambda: words(rng, rng.randrange(5, 30))
    texts = {at + owners * i + k: filler() + long[10 * i : 10 * i + 20] + filler() for at in (0, 5000) for i in range(7) for k in range(owners)}
    texts |= {1000: filler() + long + filler(), 9000: filler() + long + filler()}
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    got = [(r["doc_id"], r["source_id"], r["n_words"]) for r in passages.repeated_passages(df).collect()]
    assert [(d, s) for d, s, _ in got] == [(9000, 1000)] and got[0][2] >= 80


def test_windows_of_crowded_seeds():
    """Each stretch with at most one seed of few rows has a hash, which its words alone decide."""
    rng = random.Random(15)
    w = np.array([rng.getrandbits(63) for _ in range(300)], dtype=np.uint64)
    seeds, _ = passages.seeds_of(w, 5, 6, 50)
    hot = seeds[(seeds >= 100) & (seeds < 200)]
    at, h = passages.crowded_windows(w, hot, passages.Settings())
    want = [i for i in range(251) if sum(i + 5 <= x <= i + 40 for x in seeds if x not in hot) <= 1 and any(i <= x <= i + 45 for x in hot)]
    assert at.tolist() == want and len(set(h.tolist())) == len(h) and len(want) >= 50
    again, same = passages.crowded_windows(w[90:], hot - 90, passages.Settings())
    assert set(zip(at.tolist(), h.tolist(), strict=True)) >= {x for x in zip((again + 90).tolist(), same.tolist(), strict=True) if 95 <= x[0]}
    assert {x for x in zip(at.tolist(), h.tolist(), strict=True) if x[0] >= 90} <= set(zip((again + 90).tolist(), same.tolist(), strict=True))
    assert len(passages.crowded_windows(w[:49], seeds, passages.Settings())[0]) == 0


def test_covering_ranges():
    rng = random.Random(16)
    for _ in range(300):
        starts = np.array([rng.randrange(60) for _ in range(rng.randrange(1, 25))])
        ends = starts + np.array([rng.randrange(1, 20) for _ in starts])
        kept = passages.covering(starts, ends)
        held = lambda ks: {w for k in ks for w in range(starts[k], ends[k])}  # noqa: E731, B023
        assert held(kept) == held(range(len(starts))) and all(held(set(kept) - {k}) != held(kept) for k in kept)
    assert passages.covering(np.arange(0, 100, 2), np.arange(50, 150, 2)) == [0, 25, 49]


def test_free_stretches():
    """What a span holds goes, stretches on one diagonal are one, and of those on many few are left."""
    at = np.array([3, 4, 5, 30, 31, 90, 92, 94, 96, 4])
    source = np.array([1, 1, 1, 0, 0, 2, 2, 2, 2, 1])
    source_at = np.array([13, 14, 15, 30, 31, 7, 7, 7, 7, 14])
    got = passages.free_stretches(at, source, source_at, [(25, 60), (0, 2)], 20)
    assert got == [(1, (3, 13, 22)), (2, (90, 7, 20)), (2, (96, 7, 20))]
    assert passages.free_stretches(at, source, source_at, [(0, 200)], 20) == [] and len(passages.free_stretches(at, source, source_at, [], 20)) == 4


def test_previous_holders_across_ranges(spark):
    rows = [(7, i, i % 5) for i in range(400)] + [(seed, i, 1) for seed in range(8, 60) for i in range(seed % 4)]
    df = spark.createDataFrame(rows, "seed long, id long, at int").repartition(7)
    got = sorted(map(tuple, passages.previous_holders(df).collect()))
    want = [(i, i % 5, i - 1, (i - 1) % 5) for i in range(1, 400)] + [(i, 1, i - 1, 1) for seed in range(8, 60) for i in range(1, seed % 4)]
    assert got == sorted(want)
    assert passages.previous_holders(df.where("seed = 0")).count() == 0


def test_recall_of_passages_against_brute_force(spark):
    """Random rows with copied stretches, overlapping quotations and scattered changes; all pairs of rows are compared by a plain alignment of diagonals."""
    rng = random.Random(21)
    pool = [words(rng, 120) for _ in range(12)]
    texts = []
    for _ in range(150):
        t = words(rng, rng.randrange(20, 60))
        for p in rng.sample(pool, rng.choice((0, 1, 1, 2))):
            n = rng.choice((20, 25, 60, 70, 90))
            a = rng.randrange(len(p) - n + 1)
            copy = list(p[a : a + n])
            for i in rng.sample(range(n), int(n * rng.choice((0, 0, 0.05, 0.1)))):
                copy[i] = rng.choice("abc") + "changed"
            t += copy + words(rng, rng.randrange(10, 40))
        texts.append(t)
    arrays = [np.array([zlib.crc32(w.encode()) for w in t]) for t in texts]
    want = set()  # (row, a passage's middle word): rows with 50 words of which 80 % stand on a diagonal of an earlier row
    for i, x in enumerate(arrays):
        for y in arrays[:i]:
            same = x[:, None] == y[None, :]
            for k in range(-len(x) + 50, len(y) - 49):
                sums = np.concatenate(([0], np.cumsum(np.diagonal(same, k))))
                hits = np.flatnonzero(sums[50:] - sums[:-50] >= 42)
                want |= {(i, int(h) + max(0, -k) + 25) for h in hits}
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = passages.repeated_passages(df).collect()
    covered = {(r["doc_id"], w) for r in got for w in range(r["first_word"], r["last_word"] + 1)}
    assert len(want) > 1000 and len(want & covered) >= 0.98 * len(want)
    for r in got:  # nothing is reported that is not there
        x, y = texts[r["doc_id"]][r["first_word"] : r["last_word"] + 1], texts[r["source_id"]][r["source_first_word"] : r["source_last_word"] + 1]
        assert passages.common_words([zlib.crc32(w.encode()) for w in x], [zlib.crc32(w.encode()) for w in y]) >= 0.8 * max(len(x), len(y))


def test_common_words():
    rng = random.Random(6)
    for _ in range(50):
        a, b = [rng.randrange(4) for _ in range(rng.randrange(1, 15))], [rng.randrange(4) for _ in range(rng.randrange(1, 15))]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert passages.common_words(a, b) == table[-1][-1]


def test_repeated_passages(spark):
    rng = random.Random(7)
    shared, other = words(rng, 70), words(rng, 60)
    fuzzy = [w if i % 9 else "changed" for i, w in enumerate(shared)]
    gapped = shared[:30] + words(rng, 4) + shared[30:]
    texts = {
        1: words(rng, 80) + shared + words(rng, 10), 2: words(rng, 20) + shared, 3: fuzzy + words(rng, 30), 4: words(rng, 50) + gapped, 5: words(rng, 200), 6: shared[:40], 7: other, 8: other,
        9: shared + words(rng, 9) + shared, 10: ["same"] * 90, 11: words(rng, 3) + ["same"] * 70, 12: [], 13: ["short"] * 30,
    }
    rows = [(i, " ".join(t).upper() if i == 2 else "\n".join(t)) for i, t in texts.items()] + [(14, None), (None, " ".join(shared)), (7, " ".join(other))]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, source_id int")
    got = passages.repeated_passages(df).collect()
    found = {(r["doc_id"], r["source_id"]) for r in got}
    assert {d for d, _ in found} == {2, 3, 4, 8, 9, 11}
    assert {(2, 1), (4, 1), (8, 7), (9, 1), (11, 10)} <= found and {(3, 1), (3, 2)} & found
    spans = {r["doc_id"]: (r["first_word"], r["last_word"]) for r in got if r["doc_id"] in (2, 4, 8, 11)}
    assert spans[2] == (20, 89) and spans[4] == (50, 123) and spans[8] == (0, 59) and spans[11] == (3, 72)
    assert len([r for r in got if r["doc_id"] == 9]) == 2 and all(r["identity"] >= 0.8 and r["n_words"] >= 50 for r in got)
    assert passages.repeated_passages(df.where("doc_id = 0")).count() == 0


def test_features_of_a_text_sum_to_one():
    at, weight = quality.features("one two two three " * 50)
    assert weight.sum() == pytest.approx(1) and (np.diff(at) > 0).all()
    assert len(quality.features(None)[0]) == len(quality.features(" \n")[0]) == 0
    assert quality._bucket(np.array([0], np.uint64))[0] == 0


def test_scorer_equals_features():
    rng = np.random.default_rng(1)
    model = quality.Model(rng.normal(size=quality.BUCKETS).astype(np.float32), 0.3)
    texts = ["one two two three", None, "", "a", "É <> é " * 2000, "w " * 50_000, "one two two three"]
    for cached in (400_000, 1):
        got = [s for t in texts for s in quality.Scorer(model, cached).scores([t])]
        assert got == pytest.approx([quality.score_features(model, *quality.features(t)) for t in texts], abs=1e-6)
        assert quality.Scorer(model, cached).scores(texts) == pytest.approx(got, abs=1e-9)


def junk(rng, i):
    return " ".join(w + "%%%" for w in words(rng, 40)) if i % 2 else " ".join([rng.choice(words(rng, 3))] * 40)


def test_classifier_learns_and_ignores_what_is_held_out(spark):
    rng = random.Random(8)
    rows = [(i, junk(rng, i // 4) if i % 4 == 0 else " ".join(words(rng, 40)), int(i % 4 != 0)) for i in range(400)]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows] + [(1000, None, 0.1), (1001, "", 0.1), (None, "x", 0.1)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(5000, 1), (1000, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    scored = quality.with_score(docs, model).withColumn("held", quality.held_out(docs["doc_id"])).collect()
    truth = {i: q for i, _, q in rows}
    held = [r for r in scored if r["held"] and r["doc_id"] in truth]
    assert len(held) > 40 and sum((r["score"] >= 0.3) == bool(truth[r["doc_id"]]) for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in scored) and len(scored) == 403
    turned = labels.select("doc_id", quality.held_out(labels["doc_id"]).alias("h"), "quality").selectExpr("doc_id", "IF(h, 1 - quality, quality) AS quality")
    again = quality.fit(docs, turned)
    assert (again.part == model.part).all() and again.bias == model.bias


def test_classifier_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert quality.with_score(docs, model).first()["score"] == 0.5
    assert quality.with_score(docs.where("doc_id = 2"), model).count() == 0


def test_training_rows_are_bounded_whatever_repeats(spark, monkeypatch):
    """Ids with very many rows, and texts of one id that differ, are one training row each."""
    seen = []
    monkeypatch.setattr(quality, "train", lambda rows, **k: seen.append(rows) or quality.Model(np.zeros(quality.BUCKETS, np.float32), 0.0))
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5]
    docs = [(ids[0], "the same")] * 3000 + [(ids[0], f"another {k}") for k in range(20)] + [(i, f"text {i}") for i in ids[1:60]] + [(None, "none")]
    labels = [(i, 1) for i in ids] + [(ids[1], 0), (None, 1), (ids[2], None)]
    for bound, want in ((1000, 60), (10, 10)):
        quality.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"), sample_rows=bound)
        assert len(seen[-1]) == want
    quality.fit(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"))
    assert seen[-1] == []


def test_long_texts_are_scored_whole(spark, monkeypatch):
    monkeypatch.setattr(quality, "SCORED_BYTES", 50)
    rng = np.random.default_rng(3)
    model = quality.Model(rng.normal(size=quality.BUCKETS).astype(np.float32), 0.3)
    texts = [None, "", "a b", "word " * 50_000 + "end", "a b"] + [f"t {k} u" for k in range(500)]
    rows = quality.with_score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("score", F.lit("clash")), model).collect()
    by = {r["doc_id"]: r["score"] for r in rows}
    assert len(by) == len(texts) and by[2] == by[4] and by[0] == by[1]
    for i, t in enumerate(texts[:60]):
        assert by[i] == pytest.approx(quality.score_features(model, *quality.features(t)))

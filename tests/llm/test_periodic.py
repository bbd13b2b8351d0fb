"""Periodic runs against a plain search over all stretches and periods."""

import math
import random
import re
import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.llm import periodic

DATA = "/root/testdata/sf0.001"


def brute(words):
    """All (start, length, period), period by period."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def kept(words, runs):
    return " ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs))


@pytest.mark.parametrize("letters", [1, 2, 3, 8])
def test_runs_of_random_words(letters):
    rng = random.Random(letters)
    texts = []
    for _ in range(150):
        words = rng.choices("abcdefgh"[:letters], k=rng.randrange(60))
        if rng.random() < 0.6 and words:
            a, p = rng.randrange(len(words)), rng.randrange(1, 9)
            words[a:a] = (words[a : a + p] * 20)[: rng.randrange(5 * p + 1)]
        texts.append(words)
    for words, runs in zip(texts, periodic.runs_of(texts), strict=True):
        want = brute(words)
        assert [tuple(r) for r in runs.tolist()] == want
        assert periodic.collapsed(words, runs) == kept(words, want)


def test_wrong_hashes_are_found_out(monkeypatch):
    monkeypatch.setattr(periodic, "_mixed", lambda codes: (codes % 2).astype(np.uint64))
    rng = random.Random(5)
    texts = [rng.choices("abcd", k=40) + list("abcab" * 7) for _ in range(20)]
    assert [[tuple(r) for r in runs.tolist()] for runs in periodic.runs_of(texts)] == [brute(t) for t in texts]


def test_long_texts_of_one_word_and_of_a_long_period():
    rng = random.Random(1)
    period = [f"w{rng.randrange(10**9)}" for _ in range(40_000)]
    found = periodic.runs_of([["x"] * 200_000, period * 5, [f"u{i}" for i in range(1000)], []])
    assert [r.tolist() for r in found] == [[[0, 200_000, 1]], [[0, 200_000, 40_000]], [], []]


def test_least_overlap():
    assert periodic.least_overlap(6, 4) == 5
    assert periodic.least_overlap(10, 2) == 5


def test_edges(spark):
    rows = [(1, None), (2, ""), (2, " \t\n"), (None, "a a a a a a"), (None, "a a a a a"), (4, "x\x1fy z " * 6), (5, "b " * 90_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"runs": F.lit(1), "id": F.lit("x"), "n_words": F.lit(None).cast("int")})
    got = {(r["doc_id"], r["n_words"]): ([tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.periodic_runs(docs).collect()}
    assert got == {
        (1, 0): ([], ""), (2, 0): ([], ""), (None, 6): ([(0, 6, 1)], "a"), (None, 5): ([], "a a a a a"),
        (4, 6): ([(0, 6, 1)], "x\x1fy z"), (5, 90_000): ([(0, 90_000, 1)], "b"),
    }
    assert periodic.periodic_runs(docs.where("false")).count() == 0


def test_query_equals_plain_search(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, None if i % 17 == 0 else " \n".join(rng.choices(["aa", "bé", "c", "d"], k=rng.randrange(50)))) for i in range(400)] + [(7, "a b"), (None, "q " * 9)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in periodic.op11_periodic(spark, str(tmp_path)).collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1:2], r[-1]))
    want = []
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(i).encode()), len(words)
        if i is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + math.floor((n - a) / (3 + g % 8))
            words = [words[j] if j < a else words[a + (j - a) % p] for j in range(n)]
        runs = brute(words)
        s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        want.append((i, len(runs), s, n, q, 1000 * n // q if runs else None, sha256(lines.encode()).hexdigest(), sha256(kept(words, runs).encode()).hexdigest()))
    assert got == sorted(want, key=lambda r: (r[0] is not None, r[0] or 0, r[1:2], r[-1]))

"""A quality classifier on supervised subword embeddings, trained with numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.common import table

#: Hash buckets for words, character n-grams and word pairs (their ids fit 16 bits).
BUCKETS = 1 << 16
#: Lengths in bytes of the character n-grams, counted within "<word>".
GRAMS = (2, 3, 4)
#: At most so many labelled rows are learnt from, chosen by a hash of their ids. Each has at most
#: BUCKETS features of 4 bytes: some 25 MB on the driver for usual texts, never over 800 MB.
SAMPLE_ROWS = 3000
#: Words whose sums one worker remembers.
CACHED_WORDS = 100_000
#: Characters of texts that are split into words together.
SCORED_BYTES = 4 << 20
#: Texts that are scored together.
SCORED_TEXTS = 50

_PRIME, _SPREAD = np.uint64(1099511628211), np.uint64(0x9E3779B97F4A7C15)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    """Spreads 64-bit hashes over the buckets; 0 stays 0."""
    mixed = (hashes ^ (hashes >> np.uint64(32))) * _SPREAD
    return (mixed >> np.uint64(48)).astype(np.int64) & (BUCKETS - 1)


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For distinct words: the word and the bucket of each feature, and a hash per word.

    A word's features are itself and the n-grams of its bytes between "<" and ">".
    """
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    data = np.frombuffer(b"<" + b"><".join(words) + b">", dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    owner = np.repeat(np.arange(len(words)), sizes)
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    place = np.arange(len(data)) - np.repeat(first, sizes)
    powers = np.cumprod(np.full(int(sizes.max()), _PRIME), dtype=np.uint64)
    whole = np.add.reduceat(data * powers[place], first)
    owners, buckets = [np.arange(len(words))], [_bucket(whole)]
    for n in GRAMS:
        if len(data) < n:
            continue
        h = np.full(len(data) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            h = h * _PRIME + data[k : len(data) - n + 1 + k]
        inside = owner[: len(h)] == owner[n - 1 :]
        owners.append(owner[: len(h)][inside])
        buckets.append(_bucket(h[inside]))
    return np.concatenate(owners), np.concatenate(buckets), whole


def _pairs(hashes: np.ndarray) -> np.ndarray:
    """Buckets of neighbouring words; by the difference, so that any word said twice has bucket 0."""
    return _bucket(hashes[1:] - hashes[:-1])


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """A text as an average over words and word pairs: buckets (ascending) and their weights."""
    words = split_words(text)
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    distinct, ids = np.unique(np.array(words, dtype=object), return_inverse=True)
    owners, buckets, hashes = subwords(distinct.tolist())
    count = np.bincount(ids, minlength=len(distinct))
    weight = (count / np.bincount(owners, minlength=len(distinct)))[owners]
    dense = np.bincount(buckets, weights=weight, minlength=BUCKETS)
    pairs = _pairs(hashes[ids])
    dense += np.bincount(pairs, minlength=BUCKETS)
    dense /= len(words) + len(pairs)
    at = np.flatnonzero(dense)
    return at, dense[at]


@dataclass(frozen=True)
class Model:
    """Each bucket's part of the logit (its vector times the difference of the two output rows), and the bias."""

    part: np.ndarray
    bias: float


def train(rows: list[tuple[bytes, bytes, int]], dimension: int = 8, epochs: int = 12, rate: float = 0.5, seed: int = 7) -> Model:
    """Learns bucket vectors and a softmax over two classes by stochastic gradient descent.

    A row holds its buckets (unsigned 16-bit) and weights (16-bit floats) as
    bytes, and its label; they are unpacked one row at a time to spare memory.
    Without labelled rows all scores are 0.5.
    """
    rng = np.random.default_rng(seed)
    vectors = (rng.random((BUCKETS, dimension)) - 0.5) / dimension
    output, bias = np.zeros((dimension, 2)), np.zeros(2)
    steps, total = 0, max(1, epochs * len(rows))
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            label = rows[k][2]
            at, weight = np.frombuffer(rows[k][0], "<u2"), np.frombuffer(rows[k][1], "<f2").astype(np.float64)
            step = rate * (1 - steps / total)
            steps += 1
            hidden = weight @ vectors[at]
            z = hidden @ output + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1.0
            back = output @ p
            output -= step * np.outer(hidden, p)
            bias -= step * 0.1 * p
            # Weights are small where a text is long; the step on a vector is scaled to the largest.
            vectors[at] -= step * np.outer(weight / weight.max(), back) if len(at) else 0.0
    gap = output[:, 1] - output[:, 0]
    return Model((vectors @ gap).astype(np.float32), float(bias[1] - bias[0]))


def score_features(model: Model, at: np.ndarray, weight: np.ndarray) -> float:
    """The score from features; for tests, ``Scorer`` gives the same from words."""
    return float(1 / (1 + np.exp(-(weight @ model.part[at].astype(np.float64) + model.bias))))


class Scorer:
    """Scores texts, remembering each word's part of the logit and its hash."""

    def __init__(self, model: Model, cached: int = CACHED_WORDS):
        self.model, self.cached = model, cached
        self.known: dict[bytes, int] = {}
        self.sums, self.hashes = np.zeros(0), np.zeros(0, np.uint64)

    def _learn(self, words: Iterable[bytes]) -> None:
        new = [w for w in words if w not in self.known]
        if not new:
            return
        owners, buckets, hashes = subwords(new)
        part = np.bincount(owners, weights=self.model.part[buckets], minlength=len(new)) / np.bincount(owners, minlength=len(new))
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.sums, self.hashes = np.concatenate((self.sums, part)), np.concatenate((self.hashes, hashes))

    def scores(self, texts: list[str | None]) -> list[float]:
        out = []
        split = [split_words(t) for t in texts]
        if len(self.known) > self.cached:
            self.known, self.sums, self.hashes = {}, np.zeros(0), np.zeros(0, np.uint64)
        self._learn(dict.fromkeys(w for words in split for w in words))
        for words in split:
            total = self.model.bias
            if words:
                ids = np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))
                pairs = self.model.part[_pairs(self.hashes[ids])]
                total += (self.sums[ids].sum() + pairs.sum(dtype=np.float64)) / (len(words) + len(pairs))
            out.append(float(1 / (1 + np.exp(-total))))
        return out


def held_out(id_col: Column) -> Column:
    """Whether the CRC-32 of the id as text is divisible by 5; a null id counts as empty text."""
    return F.crc32(F.encode(F.coalesce(id_col.cast("string"), F.lit("")), "UTF-8")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Trains on labelled rows of ``docs`` that are not held out, at most ``sample_rows`` of them, chosen by a hash.

    Of repeated labels of an id the largest counts; null ids and other labels
    than 0 and 1 are left out. Of rows that repeat an id with different texts one
    is learnt from, that whose text has the least hash; rows that repeat an id and
    text are one. So the bound holds for rows, whatever repeats. Whole texts
    are turned into features on the executors, a few at a time. Without
    labelled rows, or with an empty table, all scores are 0.5.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col))).groupBy(id_col).agg(F.max(label_col).cast("int").alias("__label"))
    hashed = F.xxhash64(F.coalesce(text_col, F.lit("")))
    # Only ids and hashes are shuffled, and those without a label are left out before they are grouped.
    hashes = docs.select(id_col, hashed.alias("__own"))
    rows = hashes.join(known.select(id_col), id_col, "left_semi").groupBy(id_col).agg(F.min("__own").alias("__hash"))
    chosen = known.join(rows, id_col).orderBy(F.md5(F.col(id_col).cast("string")), id_col).limit(sample_rows)

    def featurise(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("__text")
            found = [features(texts[k].as_py()) for k in range(len(texts))]
            yield pa.RecordBatch.from_pydict(
                {
                    "__id": batch.column("__id"),
                    "__label": batch.column("__label"),
                    "at": pa.array([a.astype("<u2").tobytes() for a, _ in found], pa.binary()),
                    "weight": pa.array([w.astype("<f2").tobytes() for _, w in found], pa.binary()),
                }
            )

    same = docs.join(F.broadcast(chosen), id_col).where(hashed == F.col("__hash"))
    once = same.groupBy(F.col(id_col).cast("string").alias("__id"), "__label").agg(F.min(text_col).alias("__text"))
    rows = once.mapInArrow(featurise, "__id string, __label int, at binary, weight binary").toArrow().to_pylist()
    rows.sort(key=lambda r: r["__id"])
    return train([(r["at"], r["weight"], r["__label"]) for r in rows])


def with_score(docs: DataFrame, model: Model, text_col: str = "text", into: str = "score") -> DataFrame:
    """Adds the probability of label 1, from whole texts alone; map-only.

    Null and blank texts get the bias's score; very long texts count in full,
    SCORED_BYTES of texts or one text at a time. Equal texts have equal scores,
    so repeated rows do no harm. A column of that name is replaced. An empty
    table gives an empty result.
    """

    # On Arrow, so that few texts at a time are Python's; a worker's memory stays with it.
    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(model)
        for texts in batches:
            out, at = [], 0
            while at < len(texts):
                some, size = [], 0
                while at < len(texts) and len(some) < SCORED_TEXTS and size < SCORED_BYTES:
                    some.append(texts[at].as_py())
                    size += len(some[-1] or "")
                    at += 1
                out += scorer.scores(some)
            yield pa.array(out, pa.float64())

    return docs.withColumn(into, score(F.col(text_col)))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = with_score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))

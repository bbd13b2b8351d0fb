"""Periodic runs of words, such as a phrase said over and over, and texts without their repetitions.

In a run of period q and length n the words all but the last q stand again q words
later, so every word of it lies in a k-gram that the document repeats, where k is
the least that n - q can be. Words outside repeated k-grams part a document into
segments; Main and Lorentz's divide and conquer finds the runs of each segment."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.llm.common import BLANKS, table, text_or_empty

#: A run has at least so many words, and at least so many times its period.
LEAST_WORDS, LEAST_TIMES = 6, 4
#: Words that are searched together; a longer text is searched by itself.
BATCH_WORDS = 1 << 18
#: Pairs of places that are compared together.
BATCH_PAIRS = 1 << 21
WORD = re.compile(f"[^{BLANKS}]+")
RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])

_BASE = np.uint64(0x9E3779B97F4A7C15)


def least_overlap(least_words: int, least_times: int) -> int:
    """The least number of words that a run shares with itself one period on."""
    return min(max(least_words, least_times * q) - q for q in range(1, least_words + 1))


def _mixed(codes: np.ndarray) -> np.ndarray:
    """Numbers spread over 64 bits."""
    x = codes.astype(np.uint64) * _BASE
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def in_repeated_grams(values: np.ndarray, texts: np.ndarray, k: int) -> np.ndarray:
    """Which words lie in a k-gram that occurs twice in their text (``texts``: each
    word's text, ascending). Grams are compared by hash: chance may keep a word too many."""
    n = len(values) - k + 1
    alive = np.zeros(len(values), bool)
    if n <= 0:
        return alive
    grams = _mixed(texts[:n])
    for j in range(k):
        grams = grams * _BASE + values[j : j + n]
    places = np.flatnonzero(texts[:n] == texts[k - 1 :])
    order = places[np.argsort(grams[places])]
    same = grams[order[1:]] == grams[order[:-1]]
    again = np.zeros(len(order), bool)
    again[1:] |= same
    again[:-1] |= same
    edges = np.zeros(len(values) + 1, np.int64)
    np.add.at(edges, order[again], 1)
    np.add.at(edges, order[again] + k, -1)
    return np.cumsum(edges[:-1]) > 0


def _stretches(alive: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest stretches of such words, each within one text."""
    cut = np.flatnonzero(np.concatenate([[True], (alive[1:] != alive[:-1]) | (texts[1:] != texts[:-1])])) if len(alive) else np.zeros(0, np.int64)
    ends = np.append(cut[1:], len(alive))
    live = alive[cut] if len(alive) else np.zeros(0, bool)
    return cut[live], ends[live]


class _Compared:
    """How far words that stand q apart stay equal, by hashes of prefixes."""

    def __init__(self, values: np.ndarray, most_period: int):
        powers = np.full(len(values), _BASE)
        powers[:1] = 1
        powers = np.multiply.accumulate(powers)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers, dtype=np.uint64)])
        self.shift = np.concatenate([powers, powers[-1:] * _BASE])[: most_period + 1].copy()

    def _equal(self, a: np.ndarray, b: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (self.sums[b] - self.sums[a]) * self.shift[q] == self.sums[b + q] - self.sums[a + q]

    def forward(self, at: np.ndarray, q: np.ndarray, room: np.ndarray) -> np.ndarray:
        low, high = np.zeros_like(at), room.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self._equal(at, at + mid, q)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def backward(self, at: np.ndarray, q: np.ndarray, room: np.ndarray) -> np.ndarray:
        low, high = np.zeros_like(at), room.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self._equal(at - mid, at, q)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low


def _crossing(values: np.ndarray, compared: _Compared, at: np.ndarray, q: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Stretches (start, end, q) around each place ``at`` in which words q apart are equal."""
    inside = (at >= first) & (at + q <= last)
    at, q, first, last = at[inside], q[inside], first[inside], last[inside]
    right = np.minimum(at + q, len(values) - 1)
    near = ((at + q < last) & (values[np.minimum(at, len(values) - 1)] == values[right])) | ((at > first) & (values[at - 1] == values[at + q - 1]))
    at, q, first, last = at[near], q[near], first[near], last[near]
    forth = compared.forward(at, q, last - at - q)
    back = compared.backward(at, q, at - first)
    return np.stack([at - back, at + forth + q, q], 1)


def _plain_runs(codes: np.ndarray, first: int, last: int, least_words: int, least_times: int) -> list[tuple[int, int, int]]:
    """The runs of one segment by comparing it with itself at each period."""
    found: dict[tuple[int, int], int] = {}
    for q in range(1, (last - first) // least_times + 1):
        same = codes[first : last - q] == codes[first + q : last]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a + q >= max(least_words, least_times * q):
                found.setdefault((first + a, first + b + q), q)
    return [(s, e, q) for (s, e), q in found.items()]


def segment_runs(codes: np.ndarray, firsts: np.ndarray, lasts: np.ndarray, least_words: int = LEAST_WORDS, least_times: int = LEAST_TIMES) -> np.ndarray:
    """All runs (start, end, smallest period) within the segments ``[firsts, lasts)``, sorted.

    Every run lies in a segment, and in the first of its halves, quarters and so
    on whose middle it holds. There, for each period q that fits, words q apart
    are compared outwards from the middle, and from q words before it; all
    segments take a level at once. Of a stretch found with several periods the
    smallest counts; the others are its multiples. What hashes say is checked word by word.
    """
    values = _mixed(codes)
    long = lasts - firsts >= least_words
    firsts, lasts = firsts[long], lasts[long]
    found = [np.zeros((0, 3), np.int64)]
    if len(firsts):
        compared = _Compared(values, int((lasts - firsts).max()) // least_times)
        low, high, own = firsts, lasts, np.arange(len(firsts))
        while len(low):
            middle = (low + high) // 2
            periods = (high - low) // least_times
            ends = np.cumsum(periods)
            for begin in range(0, int(ends[-1]), BATCH_PAIRS):
                pair = np.arange(begin, min(begin + BATCH_PAIRS, int(ends[-1])))
                node = np.searchsorted(ends, pair, side="right")
                q = pair - (ends[node] - periods[node]) + 1
                for at in (middle[node], middle[node] - q):
                    made = _crossing(values, compared, at, q, firsts[own[node]], lasts[own[node]])
                    made = made[made[:, 1] - made[:, 0] >= np.maximum(least_words, least_times * made[:, 2])]
                    if len(made):
                        found.append(np.unique(made, axis=0))
            low, high, own = np.concatenate([low, middle]), np.concatenate([middle, high]), np.concatenate([own, own])
            long = high - low >= least_words
            low, high, own = low[long], high[long], own[long]
    runs = np.unique(np.concatenate(found), axis=0)
    runs = runs[np.concatenate([[True], (runs[1:, :2] != runs[:-1, :2]).any(1)])] if len(runs) else runs
    wrong = [s for s, e, q in runs.tolist() if not np.array_equal(codes[s : e - q], codes[s + q : e])]
    if wrong:  # by a chance of some 2 ** -60 for a comparison
        bad = np.unique(np.searchsorted(firsts, wrong, side="right") - 1)
        runs = runs[~np.isin(np.searchsorted(firsts, runs[:, 0], side="right") - 1, bad)]
        plain = [r for b in bad.tolist() for r in _plain_runs(codes, int(firsts[b]), int(lasts[b]), least_words, least_times)]
        runs = np.concatenate([runs, np.asarray(plain, np.int64).reshape(-1, 3)])
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def runs_of(texts: list[list[str]], least_words: int = LEAST_WORDS, least_times: int = LEAST_TIMES) -> list[np.ndarray]:
    """For each text, given as its words, its runs as rows of start, length and period, by start, then period."""
    words = [w for text in texts for w in text]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(sizes) - sizes
    code = {w: i for i, w in enumerate(dict.fromkeys(words))}
    codes = np.fromiter(map(code.__getitem__, words), np.int64, len(words))
    text = np.repeat(np.arange(len(texts)), sizes)
    alive = in_repeated_grams(_mixed(codes), text, least_overlap(least_words, least_times))
    runs = segment_runs(codes, *_stretches(alive, text), least_words, least_times)
    home = text[runs[:, 0]] if len(runs) else np.zeros(0, np.int64)
    rows = np.stack([runs[:, 0] - starts[home], runs[:, 1] - runs[:, 0], runs[:, 2]], 1)
    cuts = np.searchsorted(home, np.arange(len(texts) + 1))
    return [rows[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def collapsed(words: list[str], runs: np.ndarray) -> str:
    """The text without what runs repeat: of each run only the first period stays, unless another run takes that."""
    if not len(runs):
        return " ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return " ".join([words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, least_times: int = LEAST_TIMES) -> DataFrame:
    """The periodic runs of each text, and the text without their repetitions.

    Words are what stands between blanks and line ends. A run is a stretch of
    consecutive words with smallest period q (words q apart are equal) of at least
    ``least_words`` words and ``least_times * q``, that no neighbouring word extends.

    Returns for each row: the id, ``n_words`` (long), ``runs`` (start, length and
    period as long, by start, then period) and ``collapsed`` (the words that no run
    holds after its first period, joined by one blank). Null, empty and blank
    texts have no words. Ids may be null or repeated: each row is worked on by
    itself, where it is read, in time n log n and memory proportional to the longest
    text. Other columns are not read. An empty table gives an empty result.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            begin, pending, size = 0, [], 0
            for at in range(batch.num_rows):
                pending.append(WORD.findall(texts[at].as_py()))
                size += len(pending[-1])
                if size >= BATCH_WORDS or at + 1 == batch.num_rows:
                    yield answer(batch.column("id").slice(begin, len(pending)), pending)
                    begin, pending, size = at + 1, [], 0

    def answer(ids: pa.Array, texts: list[list[str]]) -> pa.RecordBatch:
        runs = runs_of(texts, least_words, least_times)
        flat = np.concatenate(runs)
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
        items = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)], ["start", "length", "period"])
        made = [ids, pa.array([len(t) for t in texts], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)]
        return pa.record_batch([*made, pa.array(map(collapsed, texts, runs), pa.string(), size=len(texts))], ["id", "n_words", "runs", "collapsed"])

    rows = docs.select(docs[id_col].alias("id"), text_or_empty(docs[text_col]).alias("text"))
    schema = T.StructType([rows.schema["id"]]).add("n_words", T.LongType()).add("runs", T.ArrayType(RUN)).add("collapsed", T.StringType())
    return rows.mapInArrow(search, schema).withColumnRenamed("id", id_col)


def made_periodic(docs: DataFrame) -> DataFrame:
    """The query's input: in a tenth of the documents, by a hash of their ids, words from some place on repeat."""
    inner = F.btrim(text_or_empty("text"), F.lit(" \t\n\x0b\f\r"))
    of_id = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    g = F.floor(of_id / 10).cast("long")
    docs = docs.select("doc_id", "text", F.when((of_id % 10 == 0) & (inner != ""), F.split(inner, f"[{BLANKS}]+")).alias("words"), g.alias("g"))
    docs = docs.withColumn("n", F.size("words")).withColumn("a", F.expr("g % n").cast("int"))
    docs = docs.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)").cast("int")).withColumn("times", F.expr("(n - a + p - 1) div p").cast("int"))
    repeated = F.expr("concat(slice(words, 1, a), slice(flatten(array_repeat(slice(words, a + 1, p), times)), 1, n - a))")
    return docs.select("doc_id", F.when(F.col("words").isNull(), F.col("text")).otherwise(F.array_join(repeated, " ")).alias("text"))


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(made_periodic(table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines: Column = F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n")))
    best = found.withColumns({"best": longest, "lines": F.array_join(lines, "")})
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )

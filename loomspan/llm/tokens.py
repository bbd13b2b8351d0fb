"""Token-id output: flat unsigned integer files and 64-bit document offsets, memory-mapped."""

from __future__ import annotations

import json
import os
import re
import sys
import types
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.common import scratch, table

#: Pieces of text whose ids one worker process remembers (some 200 MB).
CACHED_PIECES = 1_000_000
#: Texts that are encoded together; bytes of text in one part, and the least of a part that is cut so that every core has some.
ROWS, PART_BYTES, LEAST_PART_BYTES, PARTS_PER_CORE = 2500, 1 << 30, 16 << 20, 4
#: Ids that a reader asks for at once where files cannot be mapped, and documents between.
READ_IDS, READ_DOCS = 1 << 22, 4096
#: Stands for a null id in the files.
NO_ID = -(1 << 63)
#: White space other than blanks and line feeds, and runs of these; they tie words together.
_OTHER_SPACE = re.compile(r"[^\S\n ]")
_RUNS = ("  ", "\n\n", " \n", "\n ")
#: Marks that part from the letters before them. No apostrophe, which takes letters along.
_MARKS = ",.;:!?%&*#$|()[]{}-_/\"+=<>~@^`"


#: Mark a text's first word, its end, and a text that is encoded as a whole.
FIRST, LAST, WHOLE = "\x01", "\x02", "\x03"


class Encoder:
    """Encodes texts with a tokenizer (the content of its file), each distinct piece once.

    With a byte-level pre-tokenizer that starts a piece at each single blank or
    line feed, a text's ids are its pieces' ids in a row: the first word's, and
    each further word's with the blank or line feed before it. Of a new piece
    that is letters and then marks, the letters are looked up again. Texts with
    other white space or with a special token's text are encoded as a whole;
    tokenizers of other kinds always encode whole texts.
    """

    def __init__(self, definition: str, end_id: int, width: str, cached: int = CACHED_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores are the tasks'; waiting threads cost a third of the time
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        spec = json.loads(definition)
        pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.by_piece = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space", True) and pre.get("use_regex", True) and not spec.get("normalizer")
        # In a byte-level vocabulary a token has a character for each byte of text.
        self.lengths = np.zeros(max([0, *self.tokenizer.get_vocab().values()]) + 1, np.int64)
        for token, n in (model.get("vocab") or {}).items() if self.by_piece else ():
            self.lengths[n] = len(token)
        self.width, self.cached = np.dtype(width), cached
        self.end = np.array([end_id], self.width).tobytes()
        #: Ids of pieces: a word (said after a blank), a line feed and a word, FIRST and a text's first word; and of marks.
        self.known: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.width).tobytes()

    def _learn(self, words: list[str], lead: str) -> None:
        """Encodes words with a blank or line feed before, 64 to a text, and cuts the ids where each word's bytes end."""
        size, key = self.width.itemsize, "" if lead == " " else lead
        for at in range(0, len(words), 4096):
            part = words[at : at + 4096]
            some = [lead + lead.join(part[k : k + 64]) for k in range(0, len(part), 64)]
            encoded = self.tokenizer.encode_batch_fast(some, add_special_tokens=False)
            ids = np.array(list(chain.from_iterable(e.ids for e in encoded)), np.int64)
            ends = np.cumsum(self.lengths[ids])
            data = np.frombuffer("".join(some).encode("utf-8", "surrogatepass"), np.uint8)
            wanted = np.append(np.flatnonzero(data == ord(lead))[1:], len(data))
            cut = np.searchsorted(ends, wanted)
            if len(wanted) == len(part) and int(cut[-1]) < len(ends) and (ends[cut] == wanted).all():
                flat = ids.astype(self.width).tobytes()
                stops = ((cut + 1) * size).tolist()
                self.known.update([(key + p, flat[a:z]) for p, a, z in zip(part, [0, *stops], stops)])
            else:
                self.known.update([(key + p, self._whole(lead + p)) for p in part])

    def _meet(self, pieces: list[str]) -> None:
        """Makes new pieces known."""
        known, marks = self.known, self.marks
        plain: dict[str, set[str]] = {" ": set(), "\n": set()}
        marked = []
        for piece in pieces:
            if piece[0] == FIRST:
                known[piece] = self._whole(piece[1:])
                continue
            lead, word = ("\n", piece[1:]) if piece[0] == "\n" else (" ", piece)
            stem = word.rstrip(_MARKS)
            if len(stem) < len(word) and stem.isalpha():
                tail = word[len(stem) :]
                base = piece[: len(piece) - len(tail)]
                marked.append((piece, base, tail))
                if base not in known:
                    plain[lead].add(stem)
                if tail not in marks:
                    marks[tail] = self._whole(tail)
            else:
                plain[lead].add(word)
        for lead, words in plain.items():
            self._learn(list(words), lead)
        known.update([(piece, known[base] + marks[tail]) for piece, base, tail in marked])

    def _parts(self, text: str) -> bool:
        """Whether the text's words can be encoded one by one."""
        if not text or not self.by_piece or text[0] in " \n" or text[-1] in " \n":
            return False
        if any(c in text for c in (FIRST, LAST, WHOLE)):
            return False
        return not any(r in text for r in _RUNS) and not any(s in text for s in self.special) and not _OTHER_SPACE.search(text)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, an end id behind each, and how many there are of each.

        Each distinct piece of the texts is looked up once; the ids are then
        gathered by its number at each place.
        """
        if len(self.known) > self.cached:
            self.known.clear()
        own = {LAST: self.end}
        lines = []
        for n, text in enumerate(texts):
            if self._parts(text):
                lines.append(f"{FIRST}{text.replace(chr(10), ' ' + chr(10))} {LAST}")
            else:
                own[f"{WHOLE}{n}"] = self._whole(text)
                lines.append(f"{WHOLE}{n} {LAST}")
        split = pc.split_pattern(pa.array(lines, pa.large_string()), " ")
        numbered = split.values.dictionary_encode()
        pieces = numbered.dictionary.to_pylist()
        ids = list(map(self.known.get, pieces))
        new = [n for n, found in enumerate(ids) if found is None]
        self._meet([pieces[n] for n in new if pieces[n] not in own])
        for n in new:
            ids[n] = self.known.get(pieces[n]) or own.get(pieces[n], b"")
        flat = np.frombuffer(b"".join(ids), self.width)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.width.itemsize
        at = numbered.indices.to_numpy()
        here = sizes[at]
        ends = np.cumsum(here)
        gather = np.arange(int(ends[-1])) + np.repeat((np.cumsum(sizes) - sizes)[at] - (ends - here), here)
        offsets = split.offsets.to_numpy()
        return flat[gather], np.diff(np.concatenate(([0], ends))[offsets])


def _encoder(definition: str, end_id: int, width: str) -> Encoder:
    """This worker process's encoder: later tasks go on with its remembered pieces.

    Tasks bring their own copy of this module's variables, so the encoders are
    kept where a process has one place only, under their whole arguments.
    """
    kept = sys.modules.setdefault("_loomspan_worker", types.ModuleType("_loomspan_worker")).__dict__.setdefault("encoders", {})
    key = (definition, end_id, width)
    if key not in kept:
        kept[key] = Encoder(definition, end_id, width)
    return kept[key]


def width_for(definition: str, end_id: int) -> str:
    """The narrowest unsigned type that holds every id of a tokenizer (the content of its file) and the end id."""
    from tokenizers import Tokenizer

    most = max([end_id, *Tokenizer.from_str(definition).get_vocab(with_added_tokens=True).values()])
    return "<u2" if most < 1 << 16 else "<u4"


def _opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _unmapped(uri: str) -> str:
    """pyarrow wants file:///path for file:/path."""
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


@dataclass(frozen=True)
class Part:
    """One partition's files: ``name``.bin has the ids, ``name``.idx the end of each document
    (unsigned 64-bit, in ids from the part's start), ``name``.doc the document ids (signed 64-bit)."""

    name: str
    documents: int
    tokens: int
    first_id: int
    base: int = 0


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, width: str | None = None, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None
) -> list[Part]:
    """Encodes whole texts and writes them to ``folder`` in ascending order of ids.

    The rows are range-partitioned and sorted by id; each partition streams its
    rows into one set of files under a name of its own attempt, so a task that
    is run again leaves no half-written file in use, and reports one row. From
    the reported counts, one row for each partition, prefix sums give each
    part's base: the ids of all documents before it. ``manifest.json`` holds the
    format, the parts in order and their bases. Without a number of parts there
    is one for each PART_BYTES of text. The ids are as wide as the vocabulary
    asks for; a ``width`` too narrow for it is refused. Small inputs have parts down to LEAST_PART_BYTES, as long as cores lack some.

    Null texts count as empty and give the end id alone. Null ids come first and
    are held as the least signed 64-bit integer, which reads back as null.
    Rows that repeat an id stay, in any order among themselves. An empty table
    gives an empty manifest. Other columns are not read.
    """
    folder = _unmapped(folder)
    with open(tokenizer, encoding="utf-8") as f:
        definition = f.read()  # travels with the tasks, so executors need no copy of the file
    fits = width_for(definition, end_id)
    width = width or fits
    if end_id < 0 or np.dtype(width).itemsize < np.dtype(fits).itemsize:
        raise ValueError(f"ids of this tokenizer do not fit {width}")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, target, name = _encoder(definition, end_id, width), None, f"part-{uuid.uuid4().hex}"
        documents = tokens = first = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if target is None:
                system, path = _opened(folder)
                system.create_dir(path, recursive=True)
                target = [system.open_output_stream(f"{path}/{name}.{end}") for end in ("bin", "idx", "doc")]
                first = batch.column(0)[0].as_py()
            for at in range(0, batch.num_rows, ROWS):
                piece = batch.slice(at, ROWS)
                ids, counts = encoder.encode([t or "" for t in piece.column(1).to_pylist()])
                ends = tokens + np.cumsum(counts)
                target[0].write(ids.tobytes())
                target[1].write(ends.astype("<u8").tobytes())
                target[2].write(piece.column(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                documents, tokens = documents + len(counts), int(ends[-1])
        if target is not None:
            for stream in target:
                stream.close()
            row = {"name": [name], "documents": [documents], "tokens": [tokens], "first_id": [first]}
            yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("name", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64()), ("first_id", pa.int64())]))

    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).alias("text"))
    if parts is None:
        size = rows.agg(F.sum(F.octet_length("text") + 8).alias("n")).first()["n"] or 0
        cores = docs.sparkSession.sparkContext.defaultParallelism
        parts = max(1, -(-size // PART_BYTES), min(-(-size // LEAST_PART_BYTES), PARTS_PER_CORE * cores))
    ranged = rows.repartitionByRange(parts, "id")
    written = ranged.sortWithinPartitions("id").mapInArrow(write, "name string, documents bigint, tokens bigint, first_id bigint")
    base, out = 0, []
    for r in sorted(written.collect(), key=lambda r: r["first_id"]):  # one row for each partition
        out.append(Part(r["name"], r["documents"], r["tokens"], r["first_id"], base))
        base += r["tokens"]
    system, path = _opened(folder)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/manifest.json") as f:
        f.write(json.dumps({"width": width, "end_id": end_id, "parts": [p.__dict__ for p in out]}).encode())
    return out


def read_manifest(folder: str) -> tuple[str, list[Part]]:
    system, path = _opened(_unmapped(folder))
    with system.open_input_stream(f"{path}/manifest.json") as f:
        found = json.loads(f.read())
    return found["width"], [Part(**p) for p in found["parts"]]


class _File:
    """A file as an array: memory-mapped where the file system is local, else read by ranges as they are asked for."""

    def __init__(self, system: pafs.FileSystem, path: str, kind: str):
        self.kind = np.dtype(kind)
        self.file, self.mapped = None, None
        if isinstance(system, pafs.LocalFileSystem):
            self.size = os.path.getsize(path) // self.kind.itemsize
            self.mapped = np.memmap(path, dtype=kind, mode="r") if self.size else np.zeros(0, kind)
        else:
            self.file = system.open_input_file(path)
            self.size = self.file.size() // self.kind.itemsize

    def __getitem__(self, part: slice) -> np.ndarray:
        if self.mapped is not None:
            return self.mapped[part]
        a, z, _ = part.indices(self.size)
        return np.frombuffer(self.file.read_at((z - a) * self.kind.itemsize, a * self.kind.itemsize), self.kind)


def _crc32(ids: _File, a: int, z: int) -> int:
    sum_ = 0
    for at in range(a, z, READ_IDS):  # so that a long document needs little memory
        sum_ = zlib.crc32(ids[at : min(z, at + READ_IDS)].astype("<u4").tobytes(), sum_)
    return sum_


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Reads a folder's files back: (doc_id, ``start``, ``n_tokens``, ``ids_crc32``).

    ``start`` is the part's base and the document's offset in it; ``ids_crc32``
    the unsigned CRC-32 of the document's ids as little-endian unsigned 32-bit
    integers. A document's ids are ``ids[start - base : start - base + n_tokens]``
    of its part.
    """
    folder = _unmapped(folder)
    width, parts = read_manifest(folder)
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    if not parts:
        return spark.createDataFrame([], schema)

    def read(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, path = _opened(folder)
        for batch in batches:
            for name, base in zip(batch["name"], batch["base"], strict=True):
                ids, ends, docs = (_File(system, f"{path}/{name}.{end}", kind) for end, kind in (("bin", width), ("idx", "<u8"), ("doc", "<i8")))
                first = 0
                for at in range(0, docs.size, READ_DOCS):
                    ends_here = ends[at : at + READ_DOCS].astype(np.int64)
                    starts = np.concatenate(([first], ends_here[:-1])).astype(np.int64)
                    first = int(ends_here[-1])
                    sums = [_crc32(ids, a, z) for a, z in zip(starts.tolist(), ends_here.tolist(), strict=True)]
                    found = docs[at : at + READ_DOCS]
                    named = pd.array(found, dtype="Int64")
                    named[found == NO_ID] = pd.NA
                    yield pd.DataFrame({"doc_id": named, "start": starts + base, "n_tokens": ends_here - starts, "ids_crc32": sums})

    listed = spark.createDataFrame([(p.name, p.base) for p in parts], "name string, base bigint")
    return listed.repartition(len(parts), "name").mapInPandas(read, schema)


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{scratch(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_tokens(spark, folder)

"""Packing documents into training sequences by sum-of-squares.

Each task packs its own rows as they come.  What a document has beyond whole
windows is placed into the fill level that leaves the least sum of squared
counts of partially filled windows; the counts are one array by level.  Windows
still open at the end (or when ``MAX_OPEN`` are) are filled from one another by
cutting pieces, so that no sequence needs padding.
"""

from __future__ import annotations

import re
import struct
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 2048
#: The id that ends every document.
END_ID = 1
#: Open windows of a task; the next one makes the open ones fill each other.
MAX_OPEN = 4096
#: Chunks whose ids a worker remembers, and the longest one remembered.
MAX_CHUNKS, MAX_CHUNK_CHARS = 1 << 19, 48
#: Sequence ids of a task start at its number times this.
TASK_IDS = 1 << 40

PIECES = "doc_id {id}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class ChunkEncoder(dict):
    """Ids (little-endian unsigned 32-bit) of a text by a ``tokenizers`` file.

    A tokenizer that drops white space before it looks for words gives a text
    the ids of its space-separated chunks, one after another; the dictionary
    holds the ids of the chunks met, the library encodes each new one."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        with open(path, encoding="utf-8") as f:
            if not _drops_space(json.load(f)):
                raise ValueError("the tokenizer must drop white space between words")
        super().__init__()
        self._encoder = Tokenizer.from_file(path)
        self._words = Tokenizer(self._encoder.model)  # for words that need no normalising and no search for words
        self._words.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)

    def __missing__(self, chunk: str) -> bytes:
        if chunk.isascii() and chunk.islower() and chunk.isalpha():  # most of them: a word as it is
            ids = _bytes(self._words, chunk)
        elif not _PLAIN(chunk) or "<|" in chunk:
            ids = _bytes(self._encoder, chunk)
        else:
            words = _WORDS(chunk.lower())
            ids = _bytes(self._words, chunk) if len(words) == 1 and words[0] == chunk else b"".join(map(self.__getitem__, words))
        if len(chunk) <= MAX_CHUNK_CHARS and len(self) < MAX_CHUNKS:
            self[chunk] = ids
        return ids

    def ids(self, text: str) -> bytes:
        for space in "\t\n\r":
            text = text.replace(space, " ")
        return b"".join(map(self.__getitem__, text.split(" ")))


_LATIN = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
#: Chunks of printable ASCII and composed Latin letters: lower-casing them is all that normalising does.
_PLAIN = re.compile(f"[!-~{_LATIN}]+").fullmatch
#: The file's words, in such text (fixed value: the pattern of `word_bpe`, its classes restricted to that text).
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LATIN}]+|[0-9]|[^\sa-z0-9{_LATIN}]+").findall


def _bytes(encoder, text: str) -> bytes:
    ids = encoder.encode(text, add_special_tokens=False).ids
    return struct.pack(f"<{len(ids)}I", *ids)


def encoder(path: str) -> ChunkEncoder:
    """The encoder of a file; a Python worker keeps it, with its chunks, from
    task to task (in a module of its own, as functions come anew with a task)."""
    held = sys.modules.setdefault("_ledgerlens_encoders", types.ModuleType("_ledgerlens_encoders")).__dict__
    if path not in held:
        held[path] = ChunkEncoder(path)
    return held[path]


#: Fixed value: the pattern that `word_bpe` files look for words by.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _drops_space(spec: dict) -> bool:
    """Whether lower-cased matches of ``_PATTERN``, which hold no white space, go to byte-level BPE."""
    pre = spec.get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    normal = spec.get("normalizer") or {}
    kinds = {n.get("type") for n in (normal.get("normalizers") or [normal])}
    return (first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
            and first["pattern"].get("Regex", "") == _PATTERN and kinds <= {"NFC", "Replace", "Lowercase"} and "Lowercase" in kinds
            and (spec.get("model") or {}).get("type") == "BPE")


class Packer:
    """Sequences of at most ``window`` ids.  A piece is [doc, start, ids,
    doc_tokens]; ``add`` and ``finish`` yield closed sequences (lists of pieces)."""

    def __init__(self, window: int = WINDOW, max_open: int = MAX_OPEN):
        self.window, self.max_open = window, max_open
        self.counts = np.zeros(window + 1, np.int64)        # open windows by level; a full one is closed
        self.open: list[list] = [[] for _ in range(window + 1)]
        self.n_open = 0

    def level_for(self, size: int) -> int:
        """The level (0: a new window) with the least sum of squared counts
        after placing ``size``; the fullest of equal ones."""
        n, w = self.counts, self.window
        low = n[:w - size + 1].copy()
        after = n[size:w + 1]
        # counts[h] falls by one, counts[h + size] grows by one; a full window counts nothing
        cost = 2 * (after - low) + 2
        cost[-1] = 1 - 2 * low[-1]
        cost[0] = 2 * n[size] + 1 if size < w else 0
        possible = low > 0
        possible[0] = True
        cost = np.where(possible, cost, np.iinfo(np.int64).max)
        return len(cost) - 1 - int(np.argmin(cost[::-1]))

    def add(self, doc, ids: np.ndarray) -> Iterator[list]:
        total, w = len(ids), self.window
        whole = total // w * w
        for start in range(0, whole, w):
            yield [[doc, start, ids[start:start + w], total]]
        if whole < total:
            yield from self._place([doc, whole, ids[whole:].copy(), total])
        if self.n_open > self.max_open:
            yield from self._fill()

    def _place(self, piece: list) -> Iterator[list]:
        size = len(piece[2])
        level = self.level_for(size)
        pieces = []
        if level:
            pieces = self.open[level].pop()
            self.counts[level] -= 1
            self.n_open -= 1
        pieces.append(piece)
        if level + size == self.window:
            yield pieces
        else:
            self.open[level + size].append(pieces)
            self.counts[level + size] += 1
            self.n_open += 1

    def _fill(self) -> Iterator[list]:
        """Closes all open windows but one: the fullest takes what it lacks
        from the emptiest, whole pieces first, then a cut one."""
        windows = [[level, p] for level in range(self.window - 1, 0, -1) for p in self.open[level]]
        self.open = [[] for _ in range(self.window + 1)]
        self.counts[:] = 0
        self.n_open = 0
        first, last = 0, len(windows) - 1
        while first < last:
            level, pieces = windows[first]
            while level < self.window and first < last:
                source = windows[last]
                doc, start, ids, total = source[1].pop()
                take = min(self.window - level, len(ids))
                pieces.append([doc, start, ids[:take], total])
                if take < len(ids):
                    source[1].append([doc, start + take, ids[take:], total])
                level += take
                source[0] -= take
                if not source[1]:
                    last -= 1
            windows[first][0] = level
            if level == self.window:
                yield pieces
                first += 1
        if first == last:
            level, pieces = windows[first]
            if level == self.window:
                yield pieces
            else:
                self.open[level].append(pieces)
                self.counts[level] += 1
                self.n_open += 1

    def finish(self) -> Iterator[list]:
        """Closes what is open; the last window, if not full, is cut into
        sequences whose lengths are powers of two."""
        yield from self._fill()
        for level in range(1, self.window):
            for pieces in self.open[level]:
                for bit in reversed(range(level.bit_length())):
                    if level >> bit & 1:
                        room, sequence = 1 << bit, []
                        while room:
                            doc, start, ids, total = pieces.pop()
                            sequence.append([doc, start, ids[:room], total])
                            if len(ids) > room:
                                pieces.append([doc, start + room, ids[room:], total])
                            room -= len(sequence[-1][2])
                        yield sequence
        self.open = [[] for _ in range(self.window + 1)]
        self.counts[:] = 0
        self.n_open = 0


def _pack_task(path: str, window: int, max_open: int, id_type: pa.DataType):
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    types = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches):
        from pyspark import TaskContext

        chunks, packer = encoder(path), Packer(window, max_open)
        next_id = TaskContext.get().partitionId() * TASK_IDS
        end = np.array([END_ID], "<u4").tobytes()
        rows: list[tuple] = []
        size = 0

        def out():
            nonlocal rows, size
            cols = list(zip(*rows)) if rows else [()] * len(names)
            rows, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names)

        def note(sequences):
            nonlocal next_id, size
            for pieces in sequences:
                at = 0
                for doc, start, ids, total in pieces:
                    rows.append((doc, start, len(ids), ids.tobytes(), total, next_id, at))
                    at += len(ids)
                size += 4 * at
                next_id += 1

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                note(packer.add(doc, np.frombuffer(chunks.ids(text.as_py() or "") + end, "<u4")))
                if size > 16 << 20:
                    yield out()
        note(packer.finish())
        yield out()

    return run


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, max_open: int = MAX_OPEN,
         text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per piece of a document: doc_id, start (ids of the document before it),
    length, ids (binary, little-endian unsigned 32-bit), doc_tokens (with the
    end id), sequence_id and offset (ids of the sequence before it).

    Every document's ids by the tokenizer file, then ``END_ID``, lie in exactly
    one piece each.  A sequence holds ``window`` ids, or a smaller power of
    two (at most one of each per task); none is padded.  Null and empty texts
    are the end id alone; each row is a document of its own, also when its id
    is null or repeated; an empty table gives no rows.  A task's memory is
    bounded by ``max_open`` windows, the chunks remembered, and its longest
    text.  Sequence ids depend on the dealing of rows to tasks; a retried task
    gives the same ones.
    """
    if window < 2 or window & (window - 1):
        raise ValueError("the window must be a power of two")
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[doc_id].dataType
    return (docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
            .mapInArrow(_pack_task(tokenizer, window, max_open, to_arrow_type(kind)),
                        PIECES.format(id=kind.simpleString())))


def packing_report(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The pieces of ``pack`` with the CRC-32 of their ids in their place."""
    return pack(docs, tokenizer).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                                        "sequence_id", "offset")

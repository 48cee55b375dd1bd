"""Best-fit packing of tokenised documents into sequences of a fixed length.

Every task packs what it reads, in one pass, into a bounded number of open bins. A bitset has bit ``f`` set when some
open bin has ``f`` places free, so the best fit for an item is the lowest set bit at or above its length. When all
bins are open and nothing fits, the fullest closes. Bins that a task leaves open are taken apart and packed again by
a task for each FAN_IN of them, until one task is left; those levels hold a few bins for each task of the level before.

The tokenizer cuts at white space, so the ids of a document are those of its white-space separated chunks in a row;
each worker keeps a bounded table of chunks it has met and asks the tokenizer for new ones only.

Nulls count as empty texts; an empty text is the end id alone. Rows that repeat are packed as often as they occur. An
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import give_back, materialise, union_all

SEQUENCE = 4096
END_ID = 1
OPEN_BINS = 512
FAN_IN = 64
#: Bytes, about, of a worker's newer table of chunks; as many are in the one before it, and in that of their letters.
REMEMBERED_BYTES = 45 << 20

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, is_open boolean"
_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("is_open", pa.bool_())])

_encoders: dict[str, "ChunkEncoder"] = {}


#: Letters that no normalisation but lower case changes, with marks after them: the letters are one token word,
#: the marks another, whatever else the text holds.
PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,!#$%&*()]*)")


class ChunkEncoder:
    """Text to token ids, as little-endian unsigned 32-bit numbers.

    Words of plain letters go to the tokenizer's model directly; all else goes through the whole tokenizer.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED_BYTES) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.shown = {b: level.pre_tokenize_str(bytes([b]).decode("latin-1"))[0][0][-1] for b in range(33, 127)}
        for b in range(128, 192):  # the second byte of a letter, then the first
            self.shown[b] = level.pre_tokenize_str(bytes([0xC3, b]).decode())[0][0][-1]
        self.shown[0xC3] = level.pre_tokenize_str("\u00e0")[0][0][0]
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.cores: dict[str, bytes] = {}
        self.held = self.held_cores = 0
        self.remembered = remembered

    def __call__(self, text: bytes) -> bytes:
        chunks = text.split()
        try:
            return b"".join(map(self.known.__getitem__, chunks))
        except KeyError:
            if self.held > self.remembered:
                self.older, self.known, self.held = self.known, {}, 0
            if self.held_cores > self.remembered:
                self.cores, self.held_cores = {}, 0
            for c in set(chunks).difference(self.known):
                self.known[c] = ids = self.older.get(c) or self.chunk(c)
                self.held += len(c) + len(ids) + 170
            return b"".join(map(self.known.__getitem__, chunks))

    def chunk(self, raw: bytes) -> bytes:
        text = raw.decode()
        if not (m := PLAIN.fullmatch(text)):
            return b"".join(i.to_bytes(4, "little") for i in self.tokenizer.encode(text, add_special_tokens=False).ids)
        core, mark = m.groups()
        core = core.lower()
        return (self.cores.get(core) or self.core(core)) + (mark and (self.cores.get(mark) or self.core(mark)) or b"")

    def core(self, text: str) -> bytes:
        found = self.tokenizer.model.tokenize(text.encode().decode("latin-1").translate(self.shown))
        self.cores[text] = ids = b"".join([t.id.to_bytes(4, "little") for t in found])
        self.held_cores += len(text) + len(ids) + 190
        return ids


def encoder(path: str) -> ChunkEncoder:
    """One for each worker and tokenizer file."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


class BestFit:
    """Bounded-space online best fit. ``put`` returns the bins that closed, as lists of (item, offset)."""

    def __init__(self, capacity: int, bins: int) -> None:
        self.capacity, self.bins = capacity, bins
        self.free_bits, self.n_open = 0, 0
        self.by_free: list[list[list]] = [[] for _ in range(capacity + 1)]

    def put(self, item: tuple, size: int) -> list[list]:
        closed = []
        fits = self.free_bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            held = self._take(free)
        else:
            if self.n_open == self.bins:
                closed.append(self._take((self.free_bits & -self.free_bits).bit_length() - 1))
            free, held = self.capacity, []
        held.append((item, self.capacity - free))
        if free == size:
            closed.append(held)
        else:
            self.by_free[free - size].append(held)
            self.free_bits |= 1 << (free - size)
            self.n_open += 1
        return closed

    def _take(self, free: int) -> list:
        here = self.by_free[free]
        held = here.pop()
        if not here:
            self.free_bits &= ~(1 << free)
        self.n_open -= 1
        return held

    def rest(self) -> list[list]:
        return [held for here in self.by_free for held in here]


def _packed(items: Iterator[list[tuple]], level: int, capacity: int, bins: int, last: bool) -> Iterator[pa.RecordBatch]:
    """items: batches of (doc_id, piece, start, length, crc)."""
    fit, number = BestFit(capacity, bins), 0
    base = (level << 58) + (TaskContext.get().partitionId() << 32)
    out: list[tuple] = []

    def emit(held: list, is_open: bool) -> None:
        nonlocal number
        out.extend((*item, base + number, offset, is_open) for item, offset in held)
        number += 1

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[]] * len(_ARROW)
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ARROW.types, strict=True)], schema=_ARROW)
        out.clear()
        return made

    for some in items:
        for item in some:
            for held in fit.put(item, item[3]):
                emit(held, False)
        if len(out) >= 4096:
            yield batch()
    for held in fit.rest():
        emit(held, not last)
    yield batch()


def pieces_of(doc_id: int, ids: bytes, capacity: int) -> list[tuple]:
    n = len(ids) // 4
    if n <= capacity:
        return [(doc_id, 0, 0, n, zlib.crc32(ids))]
    return [(doc_id, k, at, min(capacity, n - at), zlib.crc32(ids[4 * at : 4 * (at + capacity)])) for k, at in enumerate(range(0, n, capacity))]


def pack(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = SEQUENCE, end_id: int = END_ID, bins: int = OPEN_BINS, fan_in: int = FAN_IN, remembered: int | None = None) -> DataFrame:
    """One row per piece: where its document's ids start and how many, their CRC-32, its sequence and its place there.

    ``tokenizer`` is the path of a tokenizer file that every executor has. A worker keeps tokenizer and chunks for its next
    tasks; with ``remembered``, bytes of a table of chunks, it gives both back after each.
    """
    end = end_id.to_bytes(4, "little")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ChunkEncoder(tokenizer, remembered) if remembered else encoder(tokenizer)

        def items() -> Iterator[list[tuple]]:
            for b in batches:
                texts = b.column(1).cast(pa.binary())
                for at in range(0, b.num_rows, 256):
                    yield [p for d, t in zip(b.column(0).slice(at, 256).to_pylist(), texts.slice(at, 256).to_pylist(), strict=True) for p in pieces_of(d, encode(t or b"") + end, capacity)]

        yield from _packed(items(), 0, capacity, bins, False)
        if remembered:
            del encode
            give_back()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = rows.rdd.getNumPartitions()
    level = materialise(rows.mapInArrow(first, PIECES))
    done = [level.where("not is_open")]
    number = 0
    while True:
        number, parts = number + 1, -(-parts // fan_in)
        last = parts <= 1

        def again(batches: Iterator[pa.RecordBatch], number: int = number, last: bool = last) -> Iterator[pa.RecordBatch]:
            return _packed((list(zip(*(b.column(k).to_pylist() for k in range(5)), strict=True)) for b in batches), number, capacity, bins * (4 if last else 1), last)

        left = level.where("is_open").select("doc_id", "piece", "start", "length", "ids_crc32").repartition(max(1, parts))
        mixed = left.sortWithinPartitions(F.xxhash64("doc_id", "piece", "ids_crc32"), "doc_id", "piece")
        level = materialise(mixed.mapInArrow(again, PIECES))
        done.append(level.where("not is_open"))
        if last:
            return union_all(done).drop("is_open")

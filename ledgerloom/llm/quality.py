"""Compression bands: zstandard ratios reject repetitive and incompressible text.

The ratio of plain to compressed bytes is taken over the whole document and over each fixed chunk of it, the last one
ending with the text. Limits depend on the length, as short texts compress little whatever they hold. Below the lower
one a text is as good as random: letters drawn at random from an alphabet stay under it, in base64 or in plain small
letters. Above the upper one it repeats itself: prose of any language here stays a fifth under it. A document is out
when its whole ratio is outside its band, or when more than a quarter of its chunks are outside theirs, which finds a
part of another kind in a longer text.

Null counts as empty; an empty text has no words and so fails the base rule. An empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVEL = 3
#: Bands begin at these lengths in bytes; each has a lowest and highest ratio.
BAND_FROM = (0, 128, 256, 512, 1024, 2048, 8192, 32768)
BAND_LIMITS = ((0.0, 2.0), (1.0, 2.1), (1.25, 2.2), (1.4, 2.6), (1.55, 2.9), (1.72, 3.2), (1.8, 3.5), (1.8, 4.2))
#: A chunk's bytes, its limits, and the share of a document's chunks that may be outside them.
CHUNK, CHUNK_LIMITS, CHUNK_SHARE = 1024, (1.5, 2.8), 0.25
MIN_WORDS, REPEAT_PERCENT, WINDOW = 50, 50, 3
SYMBOLS, SPACES = "#*$%&|<>", " \t\n\v\f\r"

COLUMNS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, chunks int, chunks_out int"
_ARROW = pa.schema([(c, t) for t, names in ((pa.int64(), "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words"), (pa.bool_(), "base_failed kept"), (pa.float64(), "ratio"), (pa.int32(), "chunks chunks_out")) for c in names.split()])


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows that are found twice or more, each word once."""
    shifted = [words[k:] for k in range(window)]
    n_windows = len(shifted[-1])
    if len(set(zip(*shifted, strict=False))) == n_windows:
        return 0
    seen = Counter(zip(*shifted, strict=False))
    n, end = 0, 0
    for i, w in enumerate(zip(*shifted, strict=False)):
        if seen[w] > 1:
            n += i + window - max(i, end)
            end = i + window
    return n


def dup_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def chunks_of(raw: bytes) -> list[bytes]:
    """Of CHUNK bytes each; the last one ends with the text and may overlap the one before. None in a shorter text."""
    begins = [*range(0, len(raw) - CHUNK + 1, CHUNK)]
    if begins and begins[-1] + CHUNK < len(raw):
        begins.append(len(raw) - CHUNK)
    return [raw[at : at + CHUNK] for at in begins]


def bands(raw: bytes, compress: zstandard.ZstdCompressor) -> tuple[bool, float, int, int]:
    """Verdict, whole ratio, chunks, those outside their limits."""
    ratio = len(raw) / len(compress.compress(raw))
    low, high = BAND_LIMITS[bisect_right(BAND_FROM, len(raw)) - 1]
    each = [CHUNK / len(compress.compress(c)) for c in chunks_of(raw)]
    out = sum(not CHUNK_LIMITS[0] <= r <= CHUNK_LIMITS[1] for r in each)
    return low <= ratio <= high and out <= CHUNK_SHARE * len(each), ratio, len(each), out


def judge(text: str, compress: zstandard.ZstdCompressor) -> tuple:
    raw = text.encode()
    words = raw.split()
    n, repeated = len(words), repeat_words(words)
    failed = n < MIN_WORDS or 100 * repeated > REPEAT_PERCENT * n
    good, ratio, chunks, out = bands(raw, compress)
    return n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup_lines(text), repeated, failed, good and not failed, ratio, chunks, out


def compression_quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the base measures, the ratios, and whether it is kept."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=LEVEL)
        for b in batches:
            rows = []
            for at in range(0, b.num_rows, 256):
                rows += [judge(t or "", compress) for t in b.column(1).slice(at, 256).to_pylist()]
            columns = list(zip(*rows, strict=True)) or [[]] * (len(_ARROW) - 1)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, _ARROW.types[1:], strict=True))], schema=_ARROW)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, COLUMNS)

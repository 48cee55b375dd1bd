"""Near copies by word shingles: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Equal sets are one node. Two things propose pairs. SimHash: a set's fingerprint has the bits that over half of its hashes
have, fingerprints are joined and grouped as in ``simhash``, and nodes of one group meet. Its two bits reach the nearest
only, so minima under BANDS * BAND_ROWS permutations, in bands, propose the rest: two sets of similarity 0.8 share no band
with a chance of (1 - 0.8 ** 4) ** 24, three in a million. What either proposes is verified on the whole sets, so a link
is never a guess.

Sets meet in one task for each group or band value, all pairs of which are compared as products of 0/1 matrices; what the task
returns is a spanning forest of the links, never the pairs. Values with the same nodes are taken once. A value with more
than HOT nodes is dealt out by pairs of blocks of them, each to a task of its own, which loses no pair.

Texts: A-Z lower-cased, null counts as empty, fewer than SHINGLE words are one shingle, texts of no words are alike. One
row of each component stays, that of the smallest id. An empty table gives an empty result. Other columns pass through
untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import FILE_KEY, ROW, ROW_KEY, file_backed, give_back, materialise, with_row_key, without_rows
from ledgerloom.llm import simhash
from ledgerloom.llm.simhash import Forest, components

SHINGLE, SEED, LIKE = 5, 42, 0.8
BANDS, BAND_ROWS = 24, 4
#: The permutations: x -> (x ^ FLIP) * ODD modulo 2 ** 64. Shingles that are permuted at once.
_DRAWN = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * BAND_ROWS, 1), dtype=np.uint64)
FLIP, ODD = _DRAWN[0], _DRAWN[1] * np.uint64(2) + np.uint64(1)
AT_ONCE = 1 << 12
#: Nodes of one band value that one task compares; above, they are dealt into blocks. Cells of one dense matrix.
HOT, CELLS = 2048, 1 << 22


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes."""
    words = text.lower().split()  # bytes: A-Z only, and the six white-space characters
    if not words:
        return np.zeros(0, np.uint64)
    parts = zip(*(words[k:] for k in range(SHINGLE)), strict=False) if len(words) >= SHINGLE else iter([words])
    made = []
    while hashed := b"".join([xxhash.xxh64_digest(b" ".join(s), SEED) for s in islice(parts, 1 << 16)]):
        made.append(np.frombuffer(hashed, np.uint64))
    return np.unique(np.concatenate(made))


def bands(hashes: np.ndarray) -> list[int]:
    """A signed 64-bit number for each band; none for an empty set."""
    if not len(hashes):
        return []
    low = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), AT_ONCE):
        low = np.minimum(low, ((hashes[None, at : at + AT_ONCE] ^ FLIP) * ODD).min(axis=1))
    return [np.uint64(xxhash.xxh64_intdigest(x.tobytes(), k)).view(np.int64).item() for k, x in enumerate(low.reshape(BANDS, BAND_ROWS))]


def node(hashes: np.ndarray) -> int:
    return np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64).item()


def fingerprint(hashes: np.ndarray) -> int:
    """The set's SimHash, as a signed 64-bit number; zero for an empty set."""
    digests, counts = hashes.view(np.uint8), np.zeros(64, np.int64)
    for at in range(0, len(digests), 1 << 19):
        counts += simhash.ones(digests[at : at + (1 << 19)])
    return simhash.majority(counts, len(hashes))


def alike(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the first of its component, by links of at least LIKE."""
    n, size = len(sets), np.array([len(x) for x in sets])
    _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, column = np.repeat(np.arange(n), size)[held[column] > 1], column[held[column] > 1]
    column = np.unique(column, return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both, wide = np.zeros((n, n), np.float32), max(1, CELLS // n)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, wide):
        begin, end = np.searchsorted(column, [at, at + wide])
        x = np.zeros((n, min(wide, int(column[-1]) + 1 - at)), np.float32)
        x[row[begin:end], column[begin:end] - at] = 1
        both += x @ x.T
    forest = Forest(n)
    for k in range(n):
        near = np.flatnonzero(both[k, :k] / (size[k] + size[:k] - both[k, :k].astype(np.float64)) >= LIKE)
        forest.add(np.full(len(near), k), near)
    return forest.root


def _texts(column: pa.Array) -> Iterator[bytes]:
    texts = column.cast(pa.binary())
    for at in range(0, len(texts), 256):
        yield from (t or b"" for t in texts.slice(at, 256).to_pylist())


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp, sims, values = [], [], []
        for t in _texts(b.column(3)):
            h = shingles(t)
            fp.append(node(h))
            sims.append(fingerprint(h))
            values.append(bands(h))
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(fp, pa.int64()), pa.array(sims, pa.int64()), pa.array(values, pa.list_(pa.int64()))], names=[*ROW, "doc_id", "fp", "sim", "bands"])
    give_back()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            made = pa.array([shingles(t).tobytes() for t in _texts(part.column(1))], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), made], names=["fp", "hashes"])
    give_back()


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (band, blocks, fp, hashes), those of one band and pair of blocks together."""
    at, fps, sets = None, [], []

    def done() -> Iterator[pa.RecordBatch]:
        if len(fps) > 1:
            a, root = np.array(fps, np.int64), alike(sets)
            linked = np.flatnonzero(root != np.arange(len(root)))
            u, v = a[linked], a[root[linked]]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])

    for b in batches:
        for band, blocks, fp, hashes in zip(*(b.column(k).to_pylist() for k in range(3)), b.column(3), strict=True):
            if (band, blocks) != at:
                yield from done()
                at, fps, sets = (band, blocks), [], []
            fps.append(fp)
            sets.append(np.frombuffer(hashes.as_py(), np.uint64))
    yield from done()
    del fps, sets
    give_back()


def links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges (u > v) that connect what links connect; members: band, fp; sets: fp, hashes."""
    same = members.groupBy("band").agg(F.count("*").alias("n"), F.bit_xor("fp").alias("x"), F.bit_xor(F.xxhash64("fp")).alias("y"))
    once = materialise(same.groupBy("n", "x", "y").agg(F.min("band").alias("band")).select("band", F.ceil(F.col("n") / HOT).alias("g")))
    mine, other = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("g")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1))
    dealt = members.join(once, "band").select("band", "fp", mine.alias("mine"), other.alias("other")).select("band", "fp", (F.greatest("mine", "other") * (1 << 30) + F.least("mine", "other")).alias("blocks"))
    rows = dealt.join(sets, "fp").select("band", "blocks", "fp", "hashes").repartition("band", "blocks").sortWithinPartitions("band", "blocks")
    return rows.mapInArrow(_compare, "u long, v long").distinct()


def proposals(nodes: DataFrame) -> DataFrame:
    """(fp, band): nodes that share a band may be alike; nodes: fp, sim, bands. A group of fingerprints is a band too."""
    sims = materialise(nodes.select(F.col("sim").alias("fp")).distinct())
    groups = materialise(components(simhash.links(sims, sims.count()))).withColumnRenamed("fp", "sim")
    grouped = nodes.select("fp", "sim").join(groups, "sim", "left").select("fp", F.xxhash64(F.lit("simhash"), F.coalesce("root", "sim")).alias("band"))
    return grouped.unionByName(nodes.select("fp", F.explode("bands").alias("band")))


def near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """ROW, doc_id, fp and root, which names the component, for every row of ``docs``."""
    docs = file_backed(docs)
    text = F.col(text_col).cast("string").alias("text")
    rows = materialise(with_row_key(docs, F.col(id_col).cast("long").alias("doc_id"), text).mapInArrow(_signatures, f"{FILE_KEY} long, {ROW_KEY} long, doc_id long, fp long, sim long, bands array<long>"))
    nodes = rows.groupBy("fp").agg(F.min(F.struct(*ROW, "sim", "bands")).alias("r")).select("fp", "r.*")
    dealt = materialise(proposals(nodes))
    shared = dealt.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    members = materialise(dealt.join(shared, "band", "left_semi").select("band", "fp"))
    whose = nodes.join(members.select("fp").distinct(), "fp", "left_semi").select("fp", *ROW)
    sets = materialise(with_row_key(docs, text).join(whose, ROW).select("fp", "text").mapInArrow(_sets, "fp long, hashes binary"))
    return rows.join(materialise(components(links(members, sets))), "fp", "left").select(*ROW, "doc_id", "fp", F.coalesce("root", "fp").alias("root"))


def near_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, that of the smallest id."""
    docs = file_backed(docs)
    groups = materialise(near_copies(docs, id_col=id_col, text_col=text_col))
    who = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *ROW)
    stays = groups.groupBy("root").agg(F.min(who).alias("w"), F.count("*").alias("n")).where("n > 1").select("root", "w")
    gone = groups.join(stays, "root").where(~who.eqNullSafe(F.col("w"))).select(*ROW)
    return without_rows(docs, gone)

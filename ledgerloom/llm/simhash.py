"""Near duplicates by SimHash fingerprints and a binary-trie self-join.

Fingerprints that differ in at most BUDGET bits are linked. Distinct fingerprints only are joined, so copies cost
nothing. Two that differ in at most two bits agree in one of three blocks of the 64; each block in turn is rotated to
the front and fingerprints are dealt out by it. A task then holds binary tries, one below each block value, as ranges
of a sorted array, and walks pairs of nodes down together: bits in which the two paths differ add up, and a pair past
the budget is dropped with all below it. A block value with more than HOT fingerprints is dealt out further, by pairs
of sub-nodes within the budget, each to a task of its own.

What a task returns is a spanning forest of the links it found, never the pairs themselves, so a group of n costs
n - 1 rows for each block. Components are then found by alternating large-star and small-star steps on that forest,
with aggregates and joins only.

Texts: A-Z lower-cased, null counts as empty, no words give fingerprint zero, linked like any other. A component is
named by its smallest id; rows that repeat an id are in its component. A null id never names one unless all are
null. An empty table gives an empty result. Other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import FILE_KEY, ROW, ROW_KEY, file_backed, materialise, parts_for, with_row_key, without_rows

SHINGLE, SEED, BUDGET = 3, 42, 2
#: Widths of the three blocks.
BLOCKS = (22, 21, 21)
#: Fingerprints below one block value that one task joins; above, the value is split by SPLIT_BITS more bits.
HOT, SPLIT_BITS = 100_000, 8
#: Pairs of nodes that are expanded at once, and the size up to which two nodes are compared leaf by leaf.
FRONTIER, LEAVES = 1 << 20, 16


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """As a signed 64-bit number."""
    words = text.lower().split()  # bytes: A-Z only, and the six white-space characters
    if not words:
        return 0
    parts = [words[k:] for k in range(shingle)] if len(words) >= shingle else [[b" ".join(words)]]
    each, n, counts = zip(*parts, strict=False), 0, np.zeros(64, np.int64)
    while hashed := b"".join([xxhash.xxh64_digest(b" ".join(s), seed) for s in islice(each, 1 << 16)]):
        counts += ones(np.frombuffer(hashed, np.uint8))
        n += len(hashed) // 8
    return majority(counts, n)


def ones(digests: np.ndarray) -> np.ndarray:
    """How many of the digests, 8 bytes each, have each of 64 bits."""
    return np.unpackbits(digests.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def majority(counts: np.ndarray, n: int) -> int:
    """The bits that over half of n have, as a signed 64-bit number."""
    return int(np.packbits(2 * counts > n).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """ROW, doc_id and fp, a signed 64-bit number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made: list[int] = []
            texts = b.column(3).cast(pa.binary())
            for at in range(0, b.num_rows, 256):
                made += [fingerprint(t or b"") for t in texts.slice(at, 256).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(made, pa.int64())], names=[*ROW, "doc_id", "fp"])

    rows = with_row_key(docs, F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"{FILE_KEY} long, {ROW_KEY} long, doc_id long, fp long")


class Forest:
    """Union-find over 0..n-1; takes links in bulk."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.root[a], self.root[b]
            apart = a != b
            a, b = a[apart], b[apart]
            if not len(a):
                return
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up


def trie_links(bits: np.ndarray, left: np.ndarray, right: np.ndarray, budget: int = BUDGET) -> Forest:
    """Links between fingerprints of paired tries.

    bits: unsigned, sorted within each trie; left and right: for each pair of tries (begin, end) in bits; a trie
    paired with itself is self-joined.
    """
    forest = Forest(len(bits))
    ones = np.zeros(len(bits) + 1, np.int64)
    stack = [(0, np.column_stack([left, right, np.zeros(len(left), np.int64)]))]
    while stack:
        depth, pairs = stack.pop()
        if len(pairs) > FRONTIER:
            half = len(pairs) // 2
            stack += [(depth, pairs[half:]), (depth, pairs[:half])]
            continue
        a0, a1, b0, b1, err = pairs.T
        itself = a0 == b0
        small = ((a1 - a0) * (b1 - b0) <= LEAVES) | (depth == 64)
        if small.any():
            s = pairs[small]
            wide = s[:, 3] - s[:, 2]
            n = (s[:, 1] - s[:, 0]) * wide
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            wide = np.repeat(wide, n)
            i, j = np.repeat(s[:, 0], n) + k // wide, np.repeat(s[:, 2], n) + k % wide
            near = (i != j) & (np.bitwise_count(bits[i] ^ bits[j]) <= budget)
            forest.add(i[near], j[near])
            pairs = pairs[~small]
            if not len(pairs):
                continue
            a0, a1, b0, b1, err = pairs.T
            itself = a0 == b0
        np.cumsum((bits >> np.uint64(63 - depth)) & np.uint64(1), out=ones[1:])
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        made = [
            np.column_stack([a0, am, b0, bm, err]),
            np.column_stack([am, a1, bm, b1, err]),
            np.column_stack([a0, am, bm, b1, err + 1]),
            np.column_stack([am, a1, b0, bm, err + 1])[~itself],
        ]
        made = np.concatenate(made)
        live = (made[:, 0] < made[:, 1]) & (made[:, 2] < made[:, 3]) & (made[:, 4] <= budget)
        live &= ~((made[:, 0] == made[:, 2]) & (made[:, 1] - made[:, 0] == 1))
        if live.any():
            stack.append((depth + 1, made[live]))
    return forest


def _join(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (node, other, side, fp, turned): the tries of one partition, joined."""
    rows = pd.concat([pd.DataFrame({"node": [], "other": [], "side": [], "fp": [], "turned": []}, dtype="int64"), *frames])
    node, other, side, fp, turned = (rows[c].to_numpy() for c in ("node", "other", "side", "fp", "turned"))
    if not len(fp):
        return
    turned = turned.view(np.uint64)
    order = np.lexsort((turned, side, other, node))
    node, other, side, fp, turned = (x[order] for x in (node, other, side, fp, turned))
    new_pair = np.r_[True, (node[1:] != node[:-1]) | (other[1:] != other[:-1])]
    new_trie = new_pair | np.r_[True, side[1:] != side[:-1]]
    begin = np.flatnonzero(new_trie)
    end = np.r_[begin[1:], len(fp)]
    pair = np.cumsum(new_pair)[begin]
    two = np.r_[pair[1:] == pair[:-1], False]  # this trie and the next are a pair
    one = (other[begin] == 0) & (end - begin > 1)  # a trie of its own
    left, right = np.r_[np.flatnonzero(two), np.flatnonzero(one)], np.r_[np.flatnonzero(two) + 1, np.flatnonzero(one)]
    if len(left):
        root = trie_links(turned, np.column_stack([begin[left], end[left]]), np.column_stack([begin[right], end[right]])).root
        linked = np.flatnonzero(root != np.arange(len(root)))
        a, b = fp[linked], fp[root[linked]]
        yield pd.DataFrame({"u": np.maximum(a, b), "v": np.minimum(a, b)})


def links(fps: DataFrame, n_fps: int) -> DataFrame:
    """Edges (u > v) between fingerprints of ``fps`` (distinct) that connect what links of at most BUDGET bits connect."""
    shifts = [sum(BLOCKS[:k]) for k in range(len(BLOCKS))]
    turn = [F.col("fp")] + [F.shiftleft("fp", s).bitwiseOR(F.shiftrightunsigned("fp", 64 - s)) for s in shifts[1:]]
    turned = F.explode(F.array(*(F.struct(F.lit(k).alias("block"), t.alias("turned"), F.shiftrightunsigned(t, 64 - w).alias("value")) for k, (t, w) in enumerate(zip(turn, BLOCKS, strict=True)))))
    rows = fps.select("fp", turned.alias("t")).select("fp", "t.turned", (F.col("t.value") * 4 + F.col("t.block")).alias("node"))
    hot = rows.groupBy("node").agg(F.count("*").alias("__n")).where(F.col("__n") > HOT).select("node", F.lit(True).alias("__hot"))
    rows = rows.join(hot, "node", "left")
    # Below a hot value: sub-nodes are named by the SPLIT_BITS bits after the block; a row goes to every pair of them in
    # which it can have links. other is 0 for a trie joined with itself, and else names the pair.
    width = F.element_at(F.array(*map(F.lit, BLOCKS)), (F.col("node") % 4 + 1).cast("int"))
    sub = F.expr(f"shiftrightunsigned(shiftleft(turned, cast(w as int)), {64 - SPLIT_BITS})")
    masks = sorted({(1 << i) | (1 << j) for i in range(SPLIT_BITS) for j in range(SPLIT_BITS)} | {0})
    plain = rows.where("__hot is null").select("node", F.lit(0).cast("long").alias("other"), F.lit(0).alias("side"), "fp", "turned")
    split = rows.where("__hot").withColumn("w", width).withColumn("sub", sub).withColumn("mask", F.explode(F.array(*(F.lit(m).cast("long") for m in masks))))
    low = F.least("sub", F.col("sub").bitwiseXOR(F.col("mask")))
    split = split.select(
        (F.col("node") + (low + 1) * (1 << 30)).alias("node"),
        F.col("mask").alias("other"),
        F.when(F.col("sub") == low, 0).otherwise(1).alias("side"),
        "fp", "turned",
    )
    dealt = plain.unionByName(split).select("node", "other", F.col("side").cast("long").alias("side"), "fp", "turned").repartition(parts_for(3 * n_fps, 1 << 17), "node", "other")
    return dealt.mapInPandas(_join, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(fp, root) for every fingerprint with an edge; edges (u > v). Large-star and small-star steps until nothing moves."""
    edges = materialise(edges)
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u > v").distinct()
        edges = materialise(small)
        now = tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
        if now == state:
            return edges.select(F.col("u").alias("fp"), F.col("v").alias("root"))
        state = now


def near_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """ROW, doc_id, fp and component_id for every row of ``docs``."""
    rows = materialise(fingerprints(docs, id_col, text_col))
    fps = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    found = materialise(components(links(fps.select("fp"), fps.count())))
    named = fps.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rows.join(named.join(first, "root").select("fp", "component_id"), "fp")


def near_report(docs: DataFrame) -> DataFrame:
    return near_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, that of the smallest id."""
    docs = file_backed(docs)
    groups = materialise(near_groups(docs, id_col=id_col, text_col=text_col))
    who = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *ROW)
    stays = groups.groupBy("component_id").agg(F.min(who).alias("w"), F.count("*").alias("n")).where("n > 1").select("component_id", "w")
    gone = groups.alias("g").join(stays.alias("s"), F.col("g.component_id").eqNullSafe(F.col("s.component_id"))).where(~F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *ROW).eqNullSafe(F.col("w"))).select(*ROW)
    return without_rows(docs, gone)

"""The pipeline's near-dedup stage against brute force over five-word shingles."""

import numpy as np

import corpus_pipeline
from ledgerloom.llm import near_copies, simhash

from fixtures_llm import PROSE


def brute_roots(texts):
    sets = [{" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in (t.lower().split() for t in texts)]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= 0.8 * len(a | b):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    return root


def texts():
    """Copies with a few changed words, of one base each; two copies of a base may be unlike and meet over it only."""
    rng, clean = np.random.default_rng(6), PROSE.split()
    out = []
    for _ in range(12):
        base = [f"{rng.choice(clean)}{rng.choice(list('abcdefgh'))}" for _ in range(int(rng.integers(60, 300)))]
        out.append(" ".join(base))
        for k in range(8):
            words = list(base)
            for at in rng.choice(len(words), max(1, len(words) * (k % 4 + 1) // 120), replace=False):
                words[at] = f"changed{rng.integers(1000)}"
            out.append(" ".join(words).upper() if k == 3 else " ".join(words))
    return [*out, "", "  ", "one two", "ONE two", "one two three"]


def test_stage_drops_near_copies(spark, frame):
    rows = texts()
    want = brute_roots(rows)
    kept = corpus_pipeline.drop_near_copies(spark, frame([(k, t, "en", "a", 1) for k, t in enumerate(rows)]), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want)) and len(set(want)) < len(rows) / 2


def test_blocks_lose_no_link(frame, monkeypatch):
    rows = texts()
    monkeypatch.setattr(near_copies, "HOT", 3)
    found = {r.doc_id: r.root for r in near_copies.near_copies(frame([(k, t, "en", "a", 1) for k, t in enumerate(rows)])).collect()}
    want = brute_roots(rows)
    assert len(set(zip((found[k] for k in range(len(rows))), want, strict=True))) == len(set(found.values())) == len(set(want))


def test_stage_joins_fingerprints(spark, frame, monkeypatch):
    """The stage's pairs come from the SimHash operator too: it is given every set's fingerprint."""
    rows, seen, links = texts(), [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda fps, n: seen.append({r.fp for r in fps.collect()}) or links(fps, n))
    near_copies.near_copies(frame([(k, t, "en", "a", 1) for k, t in enumerate(rows)]))
    want = set()
    for t in rows:
        w = t.lower().encode().split()
        distinct = list(dict.fromkeys(b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4)))) if w else []
        hashed = [int.from_bytes(near_copies.xxhash.xxh64_digest(s, 42), "big") for s in distinct]
        bits = sum((2 * sum(h >> k & 1 for h in hashed) > len(hashed)) << k for k in range(64))
        want.add(bits - (bits >> 63 << 64))
    assert seen == [want]


def test_fingerprints_propose(spark):
    """Without any band, nodes within two bits, or of one fingerprint, or over others, share a group; others don't."""
    sims = [0b111, 0b1, 0b11111, 0b111, -1, -1 ^ 1 << 40 ^ 1 << 50, 0xFF << 20]
    nodes = spark.createDataFrame([(k, s, []) for k, s in enumerate(sims)], "fp long, sim long, bands array<long>")
    groups = {}
    for r in near_copies.proposals(nodes).collect():
        groups.setdefault(r.band, set()).add(r.fp)
    assert sorted(map(sorted, groups.values())) == [[0, 1, 2, 3], [4, 5], [6]]


def test_hard_rows(hard, empty):
    kept = near_copies.near_dedup(hard)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == hard.columns and len(ids) == len(set(ids)) and {1, 3, 6, 7, 8, None, 11} <= set(ids) and not {2, 4, 5} & set(ids)
    assert near_copies.near_dedup(empty).count() == 0

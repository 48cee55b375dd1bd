"""The pipeline's stages on a small corpus, each against a brute-force version of it."""

import collections
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerloom.llm import queries, toxicity
from ledgerloom.llm.common import documents, materialise

from fixtures_llm import COLUMNS, PROSE

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), t or "")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng, clean, rude = np.random.default_rng(1), PROSE.split(), ["scoundrel", "blockhead", "numbskull"]
    rows, labels = [], []
    for k in range(240):
        words = [f"{rng.choice(clean)}{rng.choice(list('abcdefgh'))}" for _ in range(int(rng.integers(5, 400)))]
        if k % 5 == 0:
            words[2::12] = [str(rng.choice(rude)) for _ in words[2::12]]
        rows.append((k, " ".join(words), "en", ("a", "a", "a", "b", "c", None)[k % 6], 1))
        labels.append((k, 1, int(k % 5 == 0)))
    for k in range(20):
        rows.append((300 + k, rows[k + 1][1].upper() if k % 2 else rows[k + 1][1], "en", "a", 1))  # copies
        rows.append((400 + k, rows[k + 1][1] + " end", "en", "b", 1))  # near copies
    rows += [rows[3], rows[3], (500, None, None, None, None), (501, "", "en", "a", 0)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, corpus):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "near_dedup", "mix_sources", "pack"]
    docs = documents(spark, corpus)
    columns = docs.columns

    model = toxicity.train(*toxicity.sample(docs, spark.read.parquet(f"{corpus}/labels.parquet")))
    margin = toxicity.Scorer(model)
    keep = materialise(stages["toxicity"](spark, docs, corpus))
    before = docs.collect()
    assert keep.columns == columns
    assert sorted(map(str, keep.collect())) == sorted(str(r) for r in before if margin((r.text or "").encode()) < 0)
    rude = [r.doc_id for r in keep.collect() if r.text and "scoundrel" in r.text]
    assert len(rude) <= 3 and keep.count() > 200

    unique = materialise(stages["exact_dedup"](spark, keep, corpus))
    best = {}
    for r in keep.collect():
        best[lower(r.text)] = max(best.get(lower(r.text), r), r, key=lambda x: x.doc_id)
    assert unique.columns == columns and sorted(map(str, unique.collect())) == sorted(map(str, best.values()))

    single = materialise(stages["near_dedup"](spark, unique, corpus))
    rows = sorted(unique.collect(), key=lambda r: r.doc_id)

    def shingles(t):
        w = lower(t).encode().split()
        return {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {b" ".join(w)} if w else set()

    sets, root = [shingles(r.text) for r in rows], list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a == b or len(a & b) >= 0.8 * len(a | b):
                    root[i] = min(root[i], root[j])
    assert single.columns == columns and sorted(r.doc_id for r in single.collect()) == sorted({rows[i].doc_id for i in root})

    mixed = materialise(stages["mix_sources"](spark, single, corpus))
    size = {r.doc_id: len(WORD.findall(r.text or "")) for r in single.collect()}
    have, got, copies = collections.Counter(), collections.Counter(), collections.Counter()
    for r in single.collect():
        have[r.source] += size[r.doc_id]
    for r in mixed.collect():
        got[r.source] += size[r.doc_id]
        copies[r.doc_id] += 1
    target, open_ = {}, set(have)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(have, key=lambda s: (s is None, s or "")))}
    while True:
        left = sum(have.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] >= 3 * have[s]}
        if not full:
            break
        target |= {s: 3 * have[s] for s in full}
        open_ -= full
    target |= share
    assert mixed.columns == columns and max(copies.values()) <= 3
    assert all(abs(got[s] - target[s]) <= max(size.values()) / 2 + 1 for s in have)

    packed = stages["pack"](spark, mixed, corpus).collect()
    tok = Tokenizer.from_file(queries.TOKENIZER)
    want = collections.Counter()
    for r in mixed.collect():
        ids = np.array(tok.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
        want[(r.doc_id, len(ids), zlib.crc32(ids.tobytes()))] += 1
    assert collections.Counter((r.doc_id, r.length, r.ids_crc32) for r in packed) == want
    room = collections.defaultdict(list)
    for r in packed:
        room[r.sequence_id].append((r.offset, r.length))
    for parts in room.values():
        assert [o for o, _ in sorted(parts)] == list(np.cumsum([0] + [n for _, n in sorted(parts)])[:-1]) and sum(n for _, n in parts) <= 4096
    assert len(room) <= -(-sum(r.length for r in packed) // 4096) * 1.1 + 1


def test_run_is_the_stages(spark, corpus):
    out = corpus_pipeline.run(spark, corpus)
    assert {"doc_id", "piece", "start", "length", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0

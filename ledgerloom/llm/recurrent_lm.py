"""Scores of whole documents under a gated recurrent language model, beside those of a unigram base.

Counts of every token come from all training documents. Each task counts the distinct words of its blocks of rows, and
counts combine before they move. Words that make up a fixed share of all tokens, COMMON at most in number, go to every
task with the model; the other words of a block meet their counts in a shuffle, and go back to their blocks, where the
block's texts wait for them. So no word brings more rows to a task than its share allows. Blocks are of about
BLOCK_BYTES: as many rows as have that on average, documents of LONG times the average apart.

The output softmax is factored by classes. The HEAD_WORDS most frequent words are dealt into classes of like mass and
have a softmax of their own in each; all other words fall into TAIL_CLASSES by their first letters and share their
class by corpus counts, c + 0.5 each, with one more 0.5 for a word never met. So every word has a probability, and what
the model says of rare words rests on the counts of all documents.

The recurrent weights are trained in numpy by truncated backpropagation, with the state carried from window to window,
on all training documents, whole and of any length. Those with the lowest hashes, FIRST_TOKENS tokens of them, come
first, in one task; then every task goes on from its weights over its part of all the others, and the tasks' weights are
averaged by their tokens, in a tree. A corpus of no more tokens than that is learned in the one task, EPOCHS times over
if small. Nothing but one table of weights a task is gathered. In scoring, documents of a block run side by side, longest
first, and each one's state is carried over its whole length.

Words are split, looked up and counted by Arrow, a few megabytes of texts at a time; no word becomes a Python object but
the first letters of rare ones, each once.

Inside, what only one step needs is (time, hidden, lane), so a step works in a core's cache; states are (hidden, time,
lane), with rows a little longer than that, as rows a power of two apart would share few of the cache's lines. Places to
take from are always in range; numpy is told to clip them, as checking takes it twice as long.

Null counts as empty: one token, the end. Rows that repeat are scored alike. Without training documents every count is
zero. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import FILE_KEY, ROW_KEY, file_backed, give_back, keep_freed, materialise, parts_for, with_row_key

#: The end of a document; no word is empty.
END = b""
BLOCK_BYTES, LONG = 8 << 20, 128
#: Bytes of words that wait to be counted, about, at most.
WAITING_BYTES = 32 << 20
#: Bytes of text, about, that one partition of the shuffled blocks has.
PARTITION_BYTES = 32 << 20
HEAD_WORDS, HEAD_CLASSES, TAIL_CLASSES, TAIL_LETTERS, COMMON = 800, 24, 40, 3, 100_000
HIDDEN, LANES, WINDOW, EPOCHS, RATE, CLIP, SEED = 24, 64, 32, 3, 0.01, 1.0, 5
#: Tokens, about, that are learned first, in one task, by documents of at most so many bytes.
FIRST_TOKENS, FIRST_BYTES = 1_000_000, 1 << 20
#: At which rate the other tasks learn, in how many lanes, how many tokens at a time, from how many tokens at least, and
#: how many tasks' weights one task averages.
TASK_RATE, TASK_LANES, TASK_TOKENS, TASK_LEAST, FAN_IN = 0.006, 512, 1 << 17, 4_000_000, 64
#: Bytes of texts, about, whose words are looked up at once.
TEXT_BYTES = 8 << 20
SCORED_LANES, SCORED_WINDOW = 512, 32
#: Targets whose class softmax is worked out at once: more than this leaves the products' fast form and a core's own cache.
AT_ONCE = 1 << 9
#: Floats by which rows of states are longer than they need be; logits below this need no shift before exp.
PAD, SAFE = 16, 60.0
BLOCK = [FILE_KEY, "block"]


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 1, F.lit(False))


def tail_class(word: bytes) -> int:
    return zlib.crc32(word[:TAIL_LETTERS]) % TAIL_CLASSES


def words_of(texts: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Of some texts at a time, about TEXT_BYTES, all words, A-Z in lower case, and where each text's begin and the last's end."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    size, lo = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + TEXT_BYTES, side="right")))
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts.slice(lo, hi - lo)))
        words, ends = split.flatten().cast(pa.binary()), np.r_[0, np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))]
        filled = pc.greater(pc.binary_length(words), 0)
        if filled.true_count < len(filled):  # space at a text's begin or end leaves an empty word
            words, ends = words.filter(filled), np.r_[0, np.cumsum(filled.to_numpy(zero_copy_only=False))][ends]
        yield words, ends
        lo = hi


class Vocabulary:
    """head: most frequent words and counts, in order; tail: mass of each tail class; types, tokens: V and N."""

    def __init__(self, head: list[tuple[bytes, int]], tail: list[float], types: int, tokens: int) -> None:
        if END not in dict(head):
            head = [*head, (END, 0)]
        self.tail, self.types, self.tokens = np.array(tail), types, tokens
        self.place = {w: k for k, (w, _) in enumerate(head)}
        mass = np.array([c + 0.5 for _, c in head])
        ends = np.cumsum(mass) / mass.sum()
        self.head_class = np.minimum(((ends - mass / mass.sum() / 2) * HEAD_CLASSES).astype(int), HEAD_CLASSES - 1)
        self.members = [np.flatnonzero(self.head_class == k) for k in range(HEAD_CLASSES)]
        of_class = np.array([mass[m].sum() for m in self.members])
        self.class_bias = np.log(np.r_[np.maximum(of_class, 1e-3), self.tail] / (mass.sum() + self.tail.sum())).astype(np.float32)
        self.word_bias = np.log(mass / of_class[self.head_class]).astype(np.float32)
        self.n_head = len(head)
        self.head = pa.array(list(self.place), pa.binary())
        self.class_of = np.r_[self.head_class, HEAD_CLASSES + np.arange(TAIL_CLASSES)].astype(np.uint8)
        self.rank = np.zeros(self.n_head, int)
        for m in self.members:
            self.rank[m] = np.arange(len(m))

    def token(self, word: bytes) -> int:
        return self.place[word] if word in self.place else self.n_head + tail_class(word)

    def encode(self, words: pa.Array) -> np.ndarray:
        """A head word's place, or the number of the head and the tail class."""
        tokens = pc.fill_null(pc.index_in(words, value_set=self.head), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        rare = np.flatnonzero(tokens < 0)
        first = pc.binary_slice(words.take(pa.array(rare)), 0, TAIL_LETTERS).dictionary_encode()
        tokens[rare] = self.n_head + np.array([tail_class(w) for w in first.dictionary.to_pylist()], np.int64)[first.indices.to_numpy()]
        return tokens

    def by_class(self, targets: np.ndarray) -> tuple[np.ndarray, ...]:
        """An order of the targets by class; in it, their classes and head words' ranks in theirs; where classes begin."""
        cls = self.class_of[targets]
        order = np.argsort(cls, kind="stable")
        cls = cls[order]
        begins = np.searchsorted(cls, np.arange(HEAD_CLASSES + 1))
        return order, cls, self.rank[targets[order[: begins[-1]]]], begins


class Recurrent:
    def __init__(self, vocabulary: Vocabulary) -> None:
        rng, v = np.random.default_rng(SEED), vocabulary
        small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        self.vocabulary, self.moments, self.n = v, None, 0
        self.w = {
            "into": small(v.n_head + TAIL_CLASSES, 3 * HIDDEN), "round": small(HIDDEN, 3 * HIDDEN), "classes": small(HIDDEN, HEAD_CLASSES + TAIL_CLASSES),
            "class_bias": v.class_bias.copy(), "words": small(v.n_head, HIDDEN), "word_bias": v.word_bias.copy(),
        }

    def _run(self, h: np.ndarray, inputs: np.ndarray) -> tuple[np.ndarray, ...]:
        """States (hidden, time, lane) after inputs (time, lane), from h (hidden, lane), and what the way back needs, by
        time. A document's first input is the end of another: it starts from zero."""
        (span, lanes), kind = inputs.shape, self.w["into"].dtype
        into, turn = self._inputs()
        alive = (inputs != self.vocabulary.place[END]).astype(kind)
        before, new, less = (np.empty((span, HIDDEN, lanes), kind) for _ in range(3))
        gates, own = np.empty((span, 2 * HIDDEN, lanes), kind), np.empty((span, 3 * HIDDEN, lanes), kind)
        states, x = self._rows(HIDDEN, inputs.shape), np.empty((3 * HIDDEN, lanes), kind)
        for t in range(span):
            h = np.multiply(h, alive[t], out=before[t])
            np.take(into, inputs[t], axis=1, mode="clip", out=x)
            h = self._turn(h, np.matmul(turn, h, out=own[t]), x, gates[t], new[t], less[t])
            states[:, t] = h
        return states, before, gates[:, :HIDDEN], gates[:, HIDDEN:], new, less, own[:, 2 * HIDDEN :], alive

    def _rows(self, n: int, shape: tuple[int, int]) -> np.ndarray:
        """Room for n rows of (time, lane), PAD apart."""
        rows = np.empty((n, shape[0] * shape[1] + PAD), self.w["into"].dtype)
        return rows[:, : shape[0] * shape[1]].reshape(n, *shape)

    def _inputs(self) -> tuple[np.ndarray, np.ndarray]:
        """What inputs and the state add to the gates, halved as _turn wants it, and to the new state, by row."""
        half = np.repeat(np.array([0.5, 0.5, 1], self.w["into"].dtype), HIDDEN)
        return np.ascontiguousarray((self.w["into"] * half).T), np.ascontiguousarray((self.w["round"] * half).T)

    @staticmethod
    def _turn(h: np.ndarray, u: np.ndarray, x: np.ndarray, gates: np.ndarray, new: np.ndarray, less: np.ndarray) -> np.ndarray:
        """State after h; u and x as from _inputs. Gates, new state and what h is more than that are written where told."""
        np.add(u[: 2 * HIDDEN], x[: 2 * HIDDEN], out=gates)
        np.tanh(gates, out=gates)  # the logistic function by tanh of half, which needs no division
        gates *= 0.5
        gates += 0.5
        np.multiply(u[2 * HIDDEN :], gates[HIDDEN:], out=new)
        new += x[2 * HIDDEN :]
        np.tanh(new, out=new)
        np.subtract(h, new, out=less)
        h = less * gates[:HIDDEN]
        h += new
        return h

    def _states(self, h: np.ndarray, inputs: np.ndarray, into: np.ndarray, turn: np.ndarray) -> np.ndarray:
        """The states alone, of lanes in which no document begins after another; into and turn as from _inputs."""
        lanes = inputs.shape[1]
        states = self._rows(HIDDEN, inputs.shape)
        x, u, gates, new, less = (np.empty((k * HIDDEN, lanes), states.dtype) for k in (3, 3, 2, 1, 1))
        for t in range(len(inputs)):
            np.take(into, inputs[t], axis=1, mode="clip", out=x)
            h = self._turn(h, np.matmul(turn, h, out=u), x, gates, new, less)
            states[:, t] = h
        return states

    def step(self, h: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, ...]:
        """New state of each lane (lane, hidden), and what the way back needs."""
        states, *kept = self._run(h.T, tokens[None])
        return states[:, 0].T, *kept

    @staticmethod
    def _with_one(states: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Columns of states (hidden, any), and a row of ones, which takes the bias."""
        out = np.empty((HIDDEN + 1, len(places)), states.dtype)
        np.take(states, places, axis=1, mode="clip", out=out[:HIDDEN])
        out[HIDDEN] = 1
        return out

    def _softmaxes(self) -> tuple[np.ndarray, np.ndarray, bool]:
        """Weights with the bias of classes and of head words, by row, and whether no logit can leave exp's range. States
        lie between -1 and 1."""
        w = self.w
        both = np.c_[w["classes"].T, w["class_bias"]], np.c_[w["words"], w["word_bias"]]
        return *both, max(float(np.abs(x).sum(axis=1).max()) for x in both) < SAFE

    def log_probs(self, h: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Of the class, and of the word in it for head words; h (lane, hidden)."""
        return self._log_probs(h.T, np.arange(len(h)), targets, *self._softmaxes())

    def _log_probs(self, states: np.ndarray, places: np.ndarray, targets: np.ndarray, classes: np.ndarray, words: np.ndarray, safe: bool) -> np.ndarray:
        """The same for columns of states (hidden, any); the rest as from _softmaxes."""
        order, cls, rank, begins = self.vocabulary.by_class(targets)
        states = self._with_one(states, places[order])
        found, total, every = np.empty(len(targets), states.dtype), np.empty(len(targets), states.dtype), np.arange(len(targets))

        def softmax(weights: np.ndarray, lo: int, hi: int, wanted: np.ndarray) -> None:
            logits = weights @ states[:, lo:hi]
            if not safe:
                logits -= logits.max(axis=0)
            found[lo:hi] = logits[wanted, every[: hi - lo]]
            np.sum(np.exp(logits, out=logits), axis=0, out=total[lo:hi])

        for lo in range(0, len(targets), AT_ONCE):
            softmax(classes, lo, min(lo + AT_ONCE, len(targets)), cls[lo : lo + AT_ONCE])
        out = found - np.log(total)
        found[: begins[-1]], total[: begins[-1]] = 0, 1
        for members, (lo, hi) in zip(self.vocabulary.members, pairwise(begins), strict=True):
            if hi > lo and len(members) > 1:
                softmax(words[members], lo, hi, rank[lo:hi])
        out[: begins[-1]] += found[: begins[-1]] - np.log(total[: begins[-1]])
        found[order] = out
        return found

    def _window(self, h: np.ndarray, inputs: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Forward and back over one window (time, lane); the last state (lane, hidden) and the gradients."""
        w, n, (span, lanes) = self.w, targets.size, inputs.shape
        states, before, z, r, new, less, own, alive = self._run(h.T, inputs)
        every, (classes, words, safe) = np.arange(n), self._softmaxes()
        order, cls, rank, begins = self.vocabulary.by_class(targets.ravel())
        ordered = self._with_one(states.base, order)
        d_states, kind = np.empty((HIDDEN, n), states.dtype), states.dtype
        g_classes, g_words, g_round = np.zeros_like(classes), np.zeros_like(words), np.zeros_like(w["round"])

        def softmax(weights: np.ndarray, lo: int, hi: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Gradients by the weights and by the states; p is never divided, as states have fewer rows."""
            here = ordered[:, lo:hi]
            p = weights @ here
            if not safe:
                p -= p.max(axis=0)
            total = np.exp(p, out=p).sum(axis=0)
            p[wanted, every[: hi - lo]] -= total
            scale = np.reciprocal(total * n)
            d = weights[:, :HIDDEN].T @ p
            d *= scale
            return p @ (here * scale).T, d

        for lo in range(0, n, AT_ONCE):
            g, d_states[:, lo : lo + AT_ONCE] = softmax(classes, lo, min(lo + AT_ONCE, n), cls[lo : lo + AT_ONCE])
            g_classes += g
        for members, (lo, hi) in zip(self.vocabulary.members, pairwise(begins), strict=True):
            if hi > lo and len(members) > 1:
                g_words[members], d = softmax(words[members], lo, hi, rank[lo:hi])
                d_states[:, lo:hi] += d
        back = np.empty(n, np.int64)
        back[order] = every
        back = back.reshape(span, lanes)
        d = self._rows(3 * HIDDEN, inputs.shape)
        dh, held, kept = np.zeros((HIDDEN, lanes), kind), np.empty((HIDDEN, lanes), kind), np.empty((HIDDEN, lanes), kind)
        here = np.empty((3 * HIDDEN, lanes), kind)  # of the gates and of what the state adds to the new one
        by_z, by_r, by_own = here[:HIDDEN], here[HIDDEN : 2 * HIDDEN], here[2 * HIDDEN :]
        for t in range(span - 1, -1, -1):
            dh += np.take(d_states, back[t], axis=1, mode="clip", out=held)
            np.multiply(dh, z[t], out=kept)
            dh -= kept
            np.multiply(new[t], new[t], out=held)
            np.subtract(1, held, out=held)
            dh *= held  # of the new state, now
            np.multiply(kept, z[t], out=held)
            np.subtract(kept, held, out=held)
            np.multiply(held, less[t], out=by_z)
            np.multiply(dh, r[t], out=by_own)
            np.multiply(by_own, r[t], out=held)
            np.subtract(by_own, held, out=held)
            np.multiply(held, own[t], out=by_r)
            d[: 2 * HIDDEN, t], d[2 * HIDDEN :, t] = here[: 2 * HIDDEN], dh
            g_round += before[t] @ here.T
            np.matmul(w["round"], here, out=dh)
            dh += kept
            dh *= alive[t]
        g_into = np.zeros_like(w["into"])
        tokens = inputs.ravel().astype(np.uint16 if len(g_into) < 1 << 16 else np.int64)  # 16 bits sort by radix
        by_token = np.argsort(tokens, kind="stable")
        tokens = tokens[by_token]
        starts = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
        g_into[tokens[starts]] = np.concatenate([np.add.reduceat(np.take(d.base[k : k + 4], by_token, axis=1, mode="clip"), starts, axis=1) for k in range(0, 3 * HIDDEN, 4)]).T
        g = {"into": g_into, "round": g_round, "classes": g_classes[:, :HIDDEN].T, "class_bias": g_classes[:, HIDDEN], "words": g_words[:, :HIDDEN], "word_bias": g_words[:, HIDDEN]}
        return states[:, -1].T, g

    def _stream(self, documents: list[np.ndarray]) -> np.ndarray:
        """Documents one after another, an end before each and after the last."""
        end = np.array([self.vocabulary.place[END]])
        return np.concatenate([x for d in documents for x in (end, d)] + [end]).astype(np.int64)

    def fit(self, documents: list[np.ndarray], epochs: int = EPOCHS, rate: float = RATE, most: int = LANES, fade: bool = True) -> "Recurrent":
        """documents: tokens without the end."""
        stream = self._stream(documents)
        lanes = max(1, min(most, len(stream) // (2 * WINDOW)))
        length = (len(stream) - 1) // lanes
        if length < 1:
            return self
        inputs = stream[: lanes * length].reshape(lanes, length).T
        targets = stream[1 : lanes * length + 1].reshape(lanes, length).T
        if self.moments is None:
            self.moments = {k: np.zeros_like(x) for k, x in self.w.items()}, {k: np.zeros_like(x) for k, x in self.w.items()}
        mean, square = self.moments
        steps, done = epochs * -(-length // WINDOW), 0
        for _ in range(epochs):
            h = np.zeros((lanes, HIDDEN), np.float32)
            for at in range(0, length, WINDOW):
                h, g = self._window(h, inputs[at : at + WINDOW], targets[at : at + WINDOW])
                self.n, done = self.n + 1, done + 1
                norm = math.sqrt(sum(float((x * x).sum()) for x in g.values()))
                now = rate * (1 - done / (steps + 1)) if fade else rate
                for k, x in g.items():
                    x *= min(1.0, CLIP / max(norm, 1e-9))
                    mean[k] += 0.1 * (x - mean[k])
                    square[k] += 0.01 * (x * x - square[k])
                    self.w[k] -= np.float32(now) * (mean[k] / (1 - 0.9**self.n)) / (np.sqrt(square[k] / (1 - 0.99**self.n)) + np.float32(1e-8))
        return self

    def learn(self, documents: Iterator[np.ndarray]) -> int:
        """One pass over any number of documents; how many tokens they had."""
        self.moments, self.n, total = None, 0, 0
        some, n = [], 0
        for d in documents:
            for at in range(0, max(1, len(d)), TASK_TOKENS):
                some.append(d[at : at + TASK_TOKENS])
                n += len(some[-1]) + 1
                if n >= TASK_TOKENS:
                    self.fit(some, 1, TASK_RATE, TASK_LANES, fade=False)
                    some, n, total = [], 0, total + n
        if some:
            self.fit(some, 1, TASK_RATE, TASK_LANES, fade=False)
        return total + n

    def take(self, weights: DataFrame) -> "Recurrent":
        """The weights of the table's one row; its own remain where there is none."""
        for r in weights.collect():
            flat, at = np.frombuffer(r["weights"], np.float32), 0
            for k, x in self.w.items():
                self.w[k] = flat[at : at + x.size].reshape(x.shape).copy()
                at += x.size
        return self

    def score(self, documents: list[np.ndarray]) -> np.ndarray:
        """Natural log-probability of each document's tokens and its end, but for what rare words share of their class."""
        sizes = np.array([len(d) + 1 for d in documents])
        stream, begins = self._stream(documents), np.cumsum(sizes) - sizes
        order = np.argsort(-sizes, kind="stable")
        out, turns, softmaxes = np.zeros(len(documents)), self._inputs(), self._softmaxes()
        for first in range(0, len(order), SCORED_LANES):
            ids = order[first : first + SCORED_LANES]
            lengths = sizes[ids]
            h = np.zeros((HIDDEN, len(ids)), np.float32)
            for at in range(0, lengths[0], SCORED_WINDOW):
                live = int(np.searchsorted(-lengths, -at, side="left"))  # longest first: those longer than at
                span = min(SCORED_WINDOW, lengths[0] - at)
                # tokens at - 1 .. at + span, the end before the first; past a document's end another's, which don't count
                grid = np.take(stream, begins[ids[:live]] + (at + np.arange(span + 1))[:, None], mode="clip")
                states = self._states(h[:, :live], grid[:-1], *turns)
                h = states[:, -1]
                real = np.flatnonzero((at + np.arange(span))[:, None] < lengths[None, :live])
                found = self._log_probs(states.base, real, grid[1:].ravel()[real], *softmaxes)
                out[ids[:live]] += np.bincount(real % live, found, live)
        return out


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What block_words gives, of batches of FILE_KEY, block, held_out and text."""
    at, some, size = None, [], 0  # of one block: words, whether they are training documents', how many such documents

    def done() -> Iterator[pa.RecordBatch]:
        if not some:
            return
        found = pa.chunked_array([w for w, *_ in some]).combine_chunks().dictionary_encode()
        of = np.concatenate([learned for _, learned, _ in some])
        places, words = found.indices.to_numpy(), found.dictionary
        n = np.bincount(places[of], minlength=len(words))
        words = pa.concat_arrays([words, pa.array([END], pa.binary())])
        n = np.r_[n, sum(ends for *_, ends in some)]
        for k in range(0, len(n), 50_000):
            rows = len(n[k : k + 50_000])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(rows, at[0])), pa.array(np.full(rows, at[1])), words.slice(k, rows), pa.array(n[k : k + 50_000])], names=[FILE_KEY, "block", "word", "n"])
        some.clear()

    for b in batches:
        file, block, held = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        cuts = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
        for lo, hi in pairwise([0, *cuts.tolist(), b.num_rows]):
            if hi > lo and (file[lo], block[lo]) != at:
                yield from done()
                at, size = (file[lo], block[lo]), 0
            row = lo
            for words, ends in words_of(b.column(3).slice(lo, hi - lo)):
                learns = ~held[row : row + len(ends) - 1]
                some.append((words, np.repeat(learns, np.diff(ends)), int(learns.sum())))
                row, size = row + len(learns), size + words.nbytes
                if size > WAITING_BYTES:  # a block may come in several parts
                    yield from done()
                    size = 0
    yield from done()


def block_words(blocks: DataFrame) -> DataFrame:
    """BLOCK, word and how often the block's training documents in a task have it (0 for words of held-out ones only)."""
    return blocks.select(*BLOCK, "held_out", "text").mapInArrow(counted, f"{FILE_KEY} long, block long, word binary, n long")


def blocks_of(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """BLOCK, doc_id, held_out and text of every row, and the bytes of all texts."""
    text = F.col(text_col).cast("string")
    rows, size = docs.select(F.octet_length(text).alias("n")).agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    mean = max(1, size // max(1, rows))
    named = with_row_key(docs, F.col(id_col).cast("long").alias("doc_id"), is_held_out(F.col(id_col)).alias("held_out"), text.alias("text"))
    block = F.when(F.octet_length("text") > LONG * mean, -1 - F.col(ROW_KEY)).otherwise(F.expr(f"{ROW_KEY} div {max(1, BLOCK_BYTES // mean)}"))
    return named.select(FILE_KEY, block.alias("block"), "doc_id", "held_out", "text"), size


def vocabulary(counts: DataFrame) -> tuple[Vocabulary, dict[bytes, int]]:
    """The vocabulary, and the counts of common words. A fixed number of rows comes to the driver, whatever the corpus."""
    known = counts.where("c > 0")
    # crc32 of the first bytes, as tail_class has it
    masses = known.groupBy(F.pmod(F.crc32(F.substring("word", 1, TAIL_LETTERS)), F.lit(TAIL_CLASSES)).alias("k")).agg(F.count("*").alias("types"), F.sum("c").alias("tokens")).collect()
    tokens = sum(r["tokens"] for r in masses)
    # Words of at least this share of all tokens are at most COMMON in number, whatever the number of tasks.
    common = {bytes(r["word"]): r["c"] for r in known.where(F.col("c") * COMMON >= tokens).collect()}
    head = sorted(common.items(), key=lambda x: (-x[1], x[0]))[:HEAD_WORDS]
    tail = [0.5] * TAIL_CLASSES
    for r in masses:
        tail[r["k"]] += r["tokens"] + 0.5 * r["types"]
    for w, c in head:
        tail[tail_class(w)] -= c + 0.5
    return Vocabulary(head, [max(0.5, m) for m in tail], sum(r["types"] for r in masses), tokens), common


def train(docs: DataFrame, vocab: Vocabulary, *, id_col: str = "doc_id", text_col: str = "text") -> Recurrent:
    usable = docs.where(~is_held_out(F.col(id_col))).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    drawn = F.xxhash64("id", "text", F.lit(SEED))
    is_first = (F.pmod(drawn, F.lit(1 << 20)) < math.ceil((1 << 20) * FIRST_TOKENS / max(1, vocab.tokens))) & (F.octet_length("text") <= FIRST_BYTES)
    epochs = min(EPOCHS, max(1, FIRST_TOKENS // max(1, vocab.tokens)))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for b in batches:
            for words, ends in words_of(b.column("text")):
                yield from np.split(vocab.encode(words), ends[1:-1])

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        sequences = list(texts(batches))
        if sequences:
            yield _weights(Recurrent(vocab).fit(sequences, epochs).w, sum(map(len, sequences)) + len(sequences))
        del sequences
        give_back()

    model = Recurrent(vocab)
    # In the order of their hashes, so that reruns agree.
    one = usable.where(is_first).repartition(1).sortWithinPartitions(drawn, "id", "text").select("text")
    model.take(materialise(one.mapInArrow(begin, "weights binary, n long")))
    begun = model.w

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        model = Recurrent(vocab)
        model.w = {k: x.copy() for k, x in begun.items()}
        n = model.learn(texts(batches))
        if n:
            yield _weights(model.w, n)
        del model
        give_back()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for b in batches:
            for blob, k in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                x = k * np.frombuffer(blob.as_py(), np.float32).astype(np.float64)
                total, n = x if total is None else total + x, n + k
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([(total / n).astype(np.float32).tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["weights", "n"])

    others = usable.where(~is_first).select("text")
    parts = max(1, min(others.rdd.getNumPartitions(), vocab.tokens // TASK_LEAST))
    level = materialise(others.coalesce(parts).mapInArrow(learn, "weights binary, n long"))
    while parts > 1:
        parts = -(-parts // FAN_IN)
        level = materialise(level.repartition(parts).mapInArrow(add, "weights binary, n long"))
    return model.take(level)


def _weights(w: dict[str, np.ndarray], n: int) -> pa.RecordBatch:
    blob = np.concatenate([x.ravel() for x in w.values()]).astype(np.float32).tobytes()
    return pa.RecordBatch.from_arrays([pa.array([blob], pa.binary()), pa.array([n], pa.int64())], names=["weights", "n"])


class Lexicon:
    """What scoring needs to know of words: token, base score, share of its class, whether training has it."""

    def __init__(self, v: Vocabulary, words: pa.Array, c: np.ndarray) -> None:
        token = v.encode(words)
        share, rare = np.zeros(len(c)), token >= v.n_head
        share[rare] = np.log((c[rare] + 0.5) / v.tail[token[rare] - v.n_head])
        self.columns = token, np.log10((c + 0.5) / (v.tokens + 0.5 * (v.types + 1))), share, c > 0


def score(blocks: DataFrame, size: int, rare: DataFrame, common: dict[bytes, int], model: Recurrent) -> DataFrame:
    """rare: BLOCK, word, c for all words of a block that are not common."""
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    held = pa.array(list(common), pa.binary())
    shared: list[Lexicon] = []  # one for each worker's task

    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        keep_freed()
        v = model.vocabulary
        if not shared:
            shared.append(Lexicon(v, held, np.array(list(common.values()), np.int64)))
        own = words.column("word").cast(pa.binary()).combine_chunks()
        here = Lexicon(v, own, words.column("c").to_numpy())
        token, base, share, known = (np.concatenate(c) for c in zip(shared[0].columns, here.columns, strict=True))
        every = pa.concat_arrays([held, own])
        end = pc.index(every, pa.scalar(END, pa.binary())).as_py()
        tokens, rows = [], []
        for t in texts.column("text").chunks:
            for some, ends in words_of(t):
                ids = pc.index_in(some, value_set=every).to_numpy()
                parts = [np.split(x[ids], ends[1:-1]) for x in (token, base, share, known)]
                tokens += parts[0]
                rows += [(len(b) + 1, int(k.sum() + known[end]), float(b.sum() + base[end]), float(s.sum())) for b, s, k in zip(*parts[1:], strict=True)]
        scores = (model.score(tokens) + np.array([r[3] for r in rows])) / math.log(10)
        n = len(rows)
        return pa.table([texts.column("doc_id"), texts.column("held_out"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([v.tokens] * n, pa.int64()), pa.array([r[2] for r in rows], pa.float64()), pa.array(scores, pa.float64())], names=names)

    parts = parts_for(size, PARTITION_BYTES)
    by_block = blocks.repartition(parts, *BLOCK).groupBy(*BLOCK).cogroup(rare.select(*BLOCK, "word", "c").repartition(parts, *BLOCK).groupBy(*BLOCK))
    return by_block.applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def lm_scores(docs: DataFrame) -> DataFrame:
    docs = file_backed(docs)
    blocks, size = blocks_of(docs)
    words = materialise(block_words(blocks))
    counts = materialise(words.groupBy("word").agg(F.sum("n").alias("c")))
    vocab, common = vocabulary(counts)
    rare = counts.where(F.col("c") * COMMON < vocab.tokens) if vocab.tokens else counts
    return score(blocks, size, words.select(*BLOCK, "word").join(rare, "word"), common, train(docs, vocab))

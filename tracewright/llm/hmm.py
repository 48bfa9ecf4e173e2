"""Language-model scoring with a hidden Markov model.

Words have classes (hash buckets), so the model's size does not depend on the vocabulary: hidden states emit classes,
and a word is drawn within its class by smoothed counts of the training text. Both parts are exact: the likelihood of
a text is the scaled forward recursion over its classes times the words' shares of their classes.

1. Tasks cut their texts into blocks of a few MB and number the words of a block; a block (word numbers, word list,
   training counts) is one row of a written table, so no later step splits text again.
2. Counts of all training words are summed by word in one shuffle and joined back to the word lists of the blocks.
3. Baum-Welch: each iteration every task runs forward and backward over its blocks in lock step and adds up expected
   counts; these are summed by state and class (states x classes numbers reach the driver, whatever the data). For
   training, texts are cut into runs of `RUN` words; all training text is read in every iteration. Counts are summed
   as whole numbers (in 2^-20 steps), so the order of tasks does not change the model.
4. Scoring runs the forward recursion over whole texts.

Defined cases: a null or blank text is one end token; rows with a null id are held out or not by crc32 of the empty
text (not held out); equal texts get equal scores; texts of any length are scored whole; without training rows all
words are unknown and the states keep their first guess; an empty table gives no rows; words of equal count are ordered by
themselves; only doc_id and text are read, whatever other columns there are.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .common import blocks, doc_hash_remainder

STATES = 8
CLASSES = 4096
ITERATIONS = 5
RUN = 256
BLOCK = 4 << 20  # larger blocks repeat fewer words
TOGETHER = 1 << 17  # words trained on in lock step, which bounds a task's memory
STEP = 1 << 20  # expected counts are summed in these parts of one
END = b" "  # no word contains a blank
SEED = 42


@dataclass(frozen=True)
class Model:
    start: np.ndarray  # of a text
    resume: np.ndarray  # of a later run of a text, in training
    move: np.ndarray
    emit: np.ndarray  # class x state


_PACKED = pa.schema([("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())),
                     ("ids", pa.list_(pa.int32())), ("classes", pa.list_(pa.int32()))])


def _pack(*columns) -> bytes:
    """A block's numbers as one compressed Arrow batch of one row."""
    row = pa.RecordBatch.from_arrays([pa.array([c], t.type) for c, t in zip(columns, _PACKED)], schema=_PACKED)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _PACKED, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(row)
    return sink.getvalue().to_pybytes()


def _unpack(packed: pa.Scalar) -> dict[str, np.ndarray]:
    row = next(iter(pa.ipc.open_stream(packed.as_buffer())))
    return {c: row.column(c)[0].values.to_numpy(zero_copy_only=False) if c != "doc_ids" else row.column(c)[0].values
            for c in _PACKED.names}


def word_blocks(docs: DataFrame, classes: int = CLASSES, parts: int = 5, left_out: int = 1) -> DataFrame:
    """One row per block of texts, written once; word 0 of a block is the end token."""
    read = docs.select("doc_id", "text", (doc_hash_remainder(parts) == left_out).alias("held_out"))

    def run(batches):
        part, n = TaskContext.get().partitionId(), 0
        for block in blocks(batches, limit=BLOCK):
            words: dict[bytes, int] = {END: 0}
            number = words.setdefault
            ids, sizes = [], []
            for text in block.column("text").to_pylist():
                tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
                ids += [number(w, len(words)) for w in tokens]
                ids.append(0)
                sizes.append(len(tokens) + 1)
            ids = np.array(ids, np.int32)
            held = block.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            counts = np.bincount(ids[np.repeat(~held, sizes)], minlength=len(words))
            of = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words)).view(np.int64) % classes
            packed = _pack(block.column("doc_id").to_pylist(), held, sizes, ids, of.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | n]), pa.array([packed], pa.binary()), pa.array([list(words)], pa.list_(pa.binary())),
                 pa.array([counts], pa.list_(pa.int64()))], ["block", "packed", "words", "counts"])
            n += 1
    return cut_lineage(read.mapInArrow(run, "block long, packed binary, words array<binary>, counts array<long>"))


def vocabulary(table: DataFrame, classes: int = CLASSES) -> DataFrame:
    """(word, class, c): training words with their counts."""
    listed = table.select(F.explode(F.arrays_zip("words", "counts")).alias("w")).select(
        F.col("w.words").alias("word"), F.col("w.counts").alias("n")).where("n > 0")
    return listed.groupBy("word").agg(F.sum("n").alias("c")).select(
        "word", F.pmod(F.xxhash64("word"), F.lit(classes)).cast("int").alias("class"), "c")


class Lockstep:
    """Sequences laid out by time: step t holds word t of all sequences that long, the longest sequence first."""

    def __init__(self, symbols: np.ndarray, sizes: np.ndarray):
        order = np.argsort(-sizes, kind="stable")
        rank = np.empty(len(sizes), np.int64)
        rank[order] = np.arange(len(sizes))
        self.order, self.longest = order, int(sizes.max(initial=0))
        active = len(sizes) - np.cumsum(np.bincount(sizes, minlength=self.longest + 1))[:self.longest]
        self.active = active
        self.at = np.concatenate([[0], np.cumsum(active)])
        t = np.arange(len(symbols)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.symbols = np.empty(len(symbols), np.int64)
        self.sequence = np.repeat(rank, sizes)  # in input order, for sums by sequence
        place = self.at[t] + self.sequence
        self.symbols[place] = symbols
        self.place = place

    def forward(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray, keep: bool):
        """Scales of all steps, and if asked for the emissions and scaled forward values."""
        scale = np.empty(len(self.symbols))
        seen = emit[self.symbols] if keep else None
        alpha = np.empty((len(self.symbols), len(move))) if keep else None
        last = None
        for t in range(self.longest):
            a, b = self.at[t], self.at[t + 1]
            now = (start if t == 0 else last[:b - a] @ move) * (seen[a:b] if keep else emit[self.symbols[a:b]])
            scale[a:b] = now.sum(axis=1)
            now /= scale[a:b, None]
            if keep:
                alpha[a:b] = now
            last = now
        return scale, seen, alpha

    def log10(self, start, move, emit) -> np.ndarray:
        """log10 likelihood of every sequence, in input order."""
        scale, _, _ = self.forward(np.tile(start, (len(self.order), 1)), move, emit, False)
        return np.bincount(self.sequence, np.log10(scale[self.place]), minlength=len(self.order))[np.argsort(self.order)]

    def expected(self, start, move, emit, begin, moves, emits) -> None:
        """Add expected counts: starts (per sequence), moves, and emissions by class."""
        scale, seen, alpha = self.forward(start, move, emit, True)
        beta = None
        for t in range(self.longest - 1, -1, -1):
            a, b = self.at[t], self.at[t + 1]
            now = np.ones((b - a, len(move)))
            if beta is not None:
                ahead = seen[b:self.at[t + 2]] * beta / scale[b:self.at[t + 2], None]
                moves += alpha[a:a + len(ahead)].T @ ahead
                now[:len(ahead)] = ahead @ move.T
            beta = now
            alpha[a:b] *= now  # from here on the probabilities of states
        begin[:] = alpha[:self.active[0]]
        for k in range(len(move)):
            emits[:, k] += np.bincount(self.symbols, alpha[:, k], minlength=len(emits))


def _runs(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the training runs of texts, and which of them begin a text."""
    n = -(-sizes // RUN)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.minimum(np.repeat(sizes, n) - nth * RUN, RUN), nth == 0


def first_guess(share: np.ndarray, states: int) -> Model:
    """States that differ at random around the classes' shares, and mostly stay."""
    noise = np.exp(np.random.default_rng(SEED).normal(0, 0.7, (len(share), states)))
    emit = share[:, None] * noise
    even = np.full(states, 1 / states)
    return Model(even, even, 0.05 / states + 0.95 * np.eye(states), emit / emit.sum(axis=0))


def iterate(table: DataFrame, model: Model, share: np.ndarray) -> Model:
    """One iteration of Baum-Welch over all training texts."""
    shared = table.sparkSession.sparkContext.broadcast(model)
    n, states = model.emit.shape

    def run(batches):
        m = shared.value
        begins, moves, emits = np.zeros((2, states)), np.zeros((states, states)), np.zeros((n, states))
        for batch in batches:
            for packed in batch.column("packed"):
                b = _unpack(packed)
                sizes, held = b["sizes"].astype(np.int64), b["held"].astype(bool)
                symbols, sizes = b["classes"][b["ids"][np.repeat(~held, sizes)]], sizes[~held]
                if not len(sizes):
                    continue
                sizes, heads = _runs(sizes)
                ends = np.cumsum(sizes)
                for some in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(ends // TOGETHER)) + 1):
                    steps = Lockstep(symbols[ends[some[0]] - sizes[some[0]]:ends[some[-1]]], sizes[some])
                    first = heads[some][steps.order]
                    begin = np.where(first[:, None], m.start, m.resume)
                    found = np.empty_like(begin)
                    steps.expected(begin, m.move, m.emit, found, moves, emits)
                    begins += [found[first].sum(axis=0), found[~first].sum(axis=0)]
        full = np.concatenate([begins, moves * m.move, emits])
        at = np.flatnonzero(full)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(np.round(full.ravel()[at] * STEP).astype(np.int64))], ["i", "n"])
    sums = table.select("packed").mapInArrow(run, "i long, n long").groupBy("i").agg(
        F.sum("n").alias("n")).toArrow()
    full = np.zeros((2 + states + n) * states)
    full[sums["i"].to_numpy()] = sums["n"].to_numpy() / STEP
    full = full.reshape(-1, states)
    even = lambda x: (x + 1 / states) / (x + 1 / states).sum(axis=-1, keepdims=True)
    emits = full[2 + states:] + share[:, None]  # one word's worth of the plain shares
    return Model(even(full[0]), even(full[1]), even(full[2:2 + states]), emits / emits.sum(axis=0))


def train(table: DataFrame, share: np.ndarray, states: int = STATES, iterations: int = ITERATIONS) -> Model:
    model = first_guess(share, states)
    for _ in range(iterations):
        model = iterate(table, model, share)
    return model


def score(docs: DataFrame, states: int = STATES, classes: int = CLASSES, iterations: int = ITERATIONS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of `docs`."""
    table = word_blocks(docs, classes)
    words = cut_lineage(vocabulary(table, classes))
    per = words.groupBy("class").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).toArrow()  # a row per class
    total, kinds = np.zeros(classes, np.int64), np.zeros(classes, np.int64)
    total[per["class"].to_numpy()], kinds[per["class"].to_numpy()] = per["c"].to_numpy(), per["v"].to_numpy()
    share = (total + 0.5) / (total + 0.5).sum()
    model = train(table, share, states, iterations)
    train_tokens, vocab = int(total.sum()), int(kinds.sum())
    within = total + 0.5 * (kinds + 1)  # a class keeps one share for unknown words, like the base model
    base = float(np.log10(train_tokens + 0.5 * (vocab + 1)))
    shared = docs.sparkSession.sparkContext.broadcast((model, np.log10(within)))

    listed = table.select("block", F.posexplode("words").alias("at", "word"))
    counted = listed.join(words.select("word", "c"), "word").groupBy("block").agg(
        F.collect_list(F.struct("at", "c")).alias("known"))  # at most the words of a block

    def run(batches):
        m, log_within = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                b = _unpack(batch.column("packed")[i])
                sizes, ids, of = b["sizes"].astype(np.int64), b["ids"], b["classes"]
                c = np.zeros(len(of), np.int64)
                if batch.column("known")[i].is_valid:
                    known = batch.column("known")[i].values
                    c[known.field("at").to_numpy()] = known.field("c").to_numpy()
                rest, known = np.log10(c + 0.5), c > 0
                doc = np.repeat(np.arange(len(sizes)), sizes)
                add = lambda values: np.bincount(doc, values[ids], minlength=len(sizes))
                likely = Lockstep(of[ids].astype(np.int64), sizes).log10(m.start, m.move, m.emit)
                yield pa.RecordBatch.from_arrays(
                    [b["doc_ids"], pa.array(b["held"].astype(bool)), pa.array(sizes),
                     pa.array(add(known.astype(float)).astype(np.int64)), pa.array(np.full(len(sizes), train_tokens)),
                     pa.array(add(rest) - base * sizes), pa.array(likely + add(rest - log_within[of]))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return table.select("block", "packed").join(counted, "block", "left").mapInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

"""Periodic runs in texts: stretches of words that repeat with a period, and texts with the repeats collapsed.

A run is a stretch of consecutive words with smallest period q and at least max(`LEAST`, 2 q) words that no neighbouring
word extends with period q. Every run of period q has two words q apart that agree at a multiple of max(q, `LEAST` - q).
So for every period the pairs on that grid, harmonically many in all, are extended to both sides, and the longest common
extensions give every run.

An extension is answered from a difference cover (`COVER`, modulo `MODULUS`): only suffixes at covered places are sorted,
by packed words first and by the ranks a doubling distance further on then. For any two places some covered pair lies
the same small distance ahead of both. The words up to there are compared one by one, which settles nearly all pairs; the
rest is the minimum of neighbours' common prefixes between two ranks, from a sparse table. Places to the left are those
of the reversed words.

Texts are worked on in blocks of many; the words of a block become numbers, and a number of its own ends each text, so
nothing reaches from one text into the next. A long text is a block of its own, and its grid is walked in pieces of
`PAIRS` pairs. There is no shuffle.

Defined cases: null, empty and blank texts have no words and no runs; every row, repeated or not and whatever its id,
has its own result; whole texts are read, of any length; an empty table gives no rows; `words`, `runs` and `collapsed`
take the place of input columns of these names, and no other column is touched. A tie between runs cannot arise: no two
have the same place and length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import add_columns

LEAST = 12  # words of a run at least
PAIRS = 1 << 20  # grid pairs in memory at a time
MODULUS = 31
COVER = (0, 1, 3, 8, 12, 18)  # fixed values: every distance modulo 31 is a difference of two of these
RUN = StructType([StructField("start", LongType()), StructField("length", LongType()), StructField("period", LongType())])


def sync_table() -> np.ndarray:
    """[i % MODULUS, (j - i) % MODULUS]: the least distance ahead at which both i and j are covered."""
    place = np.arange(MODULUS)
    covered = np.isin(place, COVER)
    table = np.full((MODULUS, MODULUS), -1, np.int8)
    for ahead in reversed(range(MODULUS)):
        first = covered[(place + ahead) % MODULUS]
        both = first[:, None] & covered[(place[:, None] + place[None, :] + ahead) % MODULUS]
        table[both] = ahead
    return table


SYNC = sync_table()


class Extensions:
    """Longest common extensions of words (whole numbers); the last word must occur nowhere else."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.rank = np.zeros(0, np.int32)
        self.levels: list[np.ndarray] = []
        self._sort()

    def _sort(self) -> None:
        words, n = self.words, len(self.words)
        at = np.flatnonzero(np.isin(np.arange(MODULUS), COVER)[np.arange(n) % MODULUS])
        bits = int(words.max()).bit_length() + 1
        per = max(1, 62 // bits)
        padded = np.concatenate([words.astype(np.int64) + 1, np.zeros(MODULUS + per, np.int64)])
        rank, tied = np.zeros(len(at), np.int64), np.arange(len(at))
        prefix = np.full(len(at), np.iinfo(np.int32).max, np.int32)  # words shared with the suffix one rank below

        def split(key, shared):
            """Order ties by `key`; `shared(a, b)` is what the keys of two neighbours say of their common words."""
            nonlocal tied
            order = np.lexsort((key, rank[tied]))
            tied, key = tied[order], key[order]
            group = rank[tied]
            other = np.concatenate([[True], group[1:] != group[:-1]])
            start = np.maximum.accumulate(np.where(other, np.arange(len(tied)), 0))
            slot = group + np.arange(len(tied)) - start
            differs = np.concatenate([[True], key[1:] != key[:-1]])
            new = np.flatnonzero(differs & ~other)
            prefix[slot[new]] = shared(key[new - 1], key[new])
            heads = np.maximum.accumulate(np.where(differs | other, np.arange(len(tied)), 0))
            rank[tied] = slot[heads]
            alone = (differs | other) & np.append((differs | other)[1:], True)
            tied = tied[~alone]

        for first in range(0, MODULUS, per):
            if not len(tied):
                break
            here = at[tied] + first
            key = padded[here].copy()
            for k in range(1, min(per, MODULUS - first)):
                key = key << bits | padded[here + k]
            width = min(per, MODULUS - first)

            def shared(a, b, first=first, width=width):
                return first + sum(((a ^ b) >> (bits * (width - k)) == 0).astype(np.int32) for k in range(1, width))
            split(key, shared)
        ahead, places = MODULUS, np.full(n + 1, -1, np.int64)
        while len(tied):  # a tie has seen no end of text, so the place `ahead` of it exists
            places[at] = rank
            levels = _minima(prefix)
            split(places[at[tied] + ahead], lambda a, b, ahead=ahead, levels=levels: ahead + _least(levels, a, b))
            ahead *= 2
        self.rank = np.full(n, -1, np.int32)
        self.rank[at] = rank
        self.levels = _minima(prefix)

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words from i and from j on (i and j differ everywhere)."""
        words, out = self.words, np.zeros(len(i), np.int64)
        left, due = np.arange(len(i)), SYNC[i % MODULUS, (j - i) % MODULUS]
        for t in range(MODULUS):
            met = due[left] == t
            if met.any():
                k = left[met]
                out[k] = t + _least(self.levels, self.rank[i[k] + t], self.rank[j[k] + t])
                left = left[~met]
            left = left[words[i[left] + t] == words[j[left] + t]]
            if not len(left):
                break
            out[left] = t + 1
        return out


def _minima(values: np.ndarray) -> list[np.ndarray]:
    """Sparse table: level k holds the minimum of 2^k values from each place on."""
    levels, size = [values], 1
    while 2 * size <= len(values):
        levels.append(np.minimum(levels[-1][:-size], levels[-1][size:]))
        size *= 2
    return levels


def _least(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum of the values above the lower up to the higher of two different ranks."""
    low, high = np.minimum(a, b) + 1, np.maximum(a, b)
    level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    out = np.empty(len(low), np.int64)
    for k in np.unique(level).tolist():
        m = level == k
        out[m] = np.minimum(levels[k][low[m]], levels[k][high[m] + 1 - (1 << k)])
    return out


def find_runs(words: np.ndarray, first: np.ndarray, size: np.ndarray, least: int = LEAST) -> np.ndarray:
    """[start, length, period] of all runs, by start and period.

    Texts are at words[first:first + size]; the word before and after each occurs nowhere else.
    """
    found = [np.zeros((0, 3), np.int64)]
    long = size >= least
    first, half = first[long], size[long] // 2
    if len(first):
        ahead, back, n = Extensions(words), Extensions(words[::-1].copy()), len(words)
        size = size[long]
        text = np.repeat(np.arange(len(first)), half)
        period = np.arange(1, len(text) + 1) - np.repeat(np.cumsum(half) - half, half)
        step = np.maximum(period, least - period)
        pairs = -(-(size[text] - period) // step)
        piece = np.cumsum(pairs) // PAIRS
        edges = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(text)]
        for x, y in zip(edges, edges[1:]):
            many = pairs[x:y]
            row = np.repeat(np.arange(x, y), many)
            i = first[text[row]] + (np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)) * step[row]
            p = period[row]
            right = ahead.of(i, i + p)
            some = right > 0
            i, p, right, step_ = i[some], p[some], right[some], step[row[some]]
            left = back.of(n - i, n - i - p)
            whole = left + right >= step_
            found.append(np.stack([(i - left)[whole], (p + left + right)[whole], p[whole]], axis=1))
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    # A stretch is found again by other pairs and by multiples of its period: the smallest period is its own.
    same = (runs[1:, 0] == runs[:-1, 0]) & (runs[1:, 1] == runs[:-1, 1])
    runs = runs[np.concatenate([[True], ~same])[:len(runs)]]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def block_runs(texts: list[bytes], least: int = LEAST) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, the text of each run, [start, length, period] in it, and the words that stay, end to end."""
    split = [t.split() for t in texts]  # bytes: ASCII blanks only
    size = np.fromiter(map(len, split), np.int64, len(split))
    numbers: dict[bytes, int] = {}
    get = numbers.setdefault
    words = np.zeros(size.sum() + len(split) + 1, np.int32)
    first = np.cumsum(size + 1) - size
    for at, row in zip(first.tolist(), split):
        words[at:at + len(row)] = [get(w, len(numbers)) for w in row]
    ends = np.append(first - 1, len(words) - 1)
    words[ends] = len(numbers) + np.arange(len(ends))
    runs = find_runs(words, first, size, least)
    of = np.searchsorted(first, runs[:, 0], side="right") - 1
    gone = np.zeros(len(words) + 1, np.int32)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
    stays = np.cumsum(gone)[:-1] == 0
    runs[:, 0] -= first[of]
    return split, of, runs, stays[np.setdiff1d(np.arange(len(words)), ends, assume_unique=True)]


def collapse(docs: DataFrame, keep: list[str] | None = None, least: int = LEAST) -> DataFrame:
    """`keep` columns (all if not given) with words (their number), runs (array of start, length, period by start and
    period, in words from 0) and collapsed: the words that no run repeats, joined by one space.

    A word goes if a run has it after the run's first `period` words.
    """
    fields = [StructField("words", LongType()), StructField("runs", ArrayType(RUN)), StructField("collapsed", StringType())]

    def run(block):
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in block.column("text").to_pylist()]
        split, of, runs, stays = block_runs(texts, least)
        size = np.fromiter(map(len, split), np.int64, len(split))
        kept, at = [], 0
        hit = np.zeros(len(split), bool)
        hit[of] = True
        for row, n, any_ in zip(split, size.tolist(), hit.tolist()):
            if any_:
                row = [row[k] for k in np.flatnonzero(stays[at:at + n]).tolist()]
            kept.append(b" ".join(row).decode("utf-8", "surrogatepass"))
            at += n
        ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(split)))]).astype(np.int32)
        structs = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(runs[:, k])) for k in range(3)], RUN.names)
        return [pa.array(size), pa.ListArray.from_arrays(pa.array(ends), structs), pa.array(kept, pa.string())]
    return add_columns(docs, docs.columns if keep is None else keep, fields, run)


def longest(runs: Column) -> Column:
    """The run of greatest length; of equal ones that of the smallest start, then period. Null if there is none."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    return F.struct((-best["col2"]).alias("start"), best["length"].alias("length"), (-best["col3"]).alias("period"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """`docs` with a periodic tail in the texts of every tenth crc32 of the id (others, null ids among them, as they are).

    With g = crc32 div 10 and n words, the words from a = g % n on repeat with period 1 + (n - a) div (3 + g % 8).
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.expr("crc32(cast(doc_id as string)) div 10")
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1)
    n = F.size(words)
    a = (g % n).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
    times = F.ceil((n - a) / p).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), times)), F.lit(1), n - a)
    planted = F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")
    return docs.withColumn("text", F.when((h % 10 == 0) & (n > 0), planted).otherwise(F.col("text")))

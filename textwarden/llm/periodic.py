"""Runs of words that repeat with a period, by recursive frequency splitting and a lag scan.

A run is a stretch of words in which words one period apart are the same, at least twice the
period and LEAST words long, that neither neighbour continues; its period is the smallest.

1.  Splitting.  Every word of a run stands in it at least twice, a period apart.  A word that
    stands less than twice in a segment is in no run of that segment, so it splits it; what is
    shorter than a run goes.  The parts are counted and split anew until nothing splits any
    more.  All texts of a piece are split together: each round sorts the words that are left.
2.  Lag scan of the segments that are left.  A run of period q holds q or more neighbouring
    words that are the same q further on.  So one of the windows of half that length that begin
    at multiples of it is the same q further on; windows are compared by hash, all lags and
    windows of a segment at once.  From each window that is, the run is as long as the words
    agree, found by halving on the same hashes; then the words themselves are compared.

Runs with the same ends are one, with the smallest lag: a stretch of at least two periods that
also has a smaller period has a divisor of it.  Neighbours outside the segment continue no run:
the run would hold them, and they would not have split it.

Words are told apart by 64-bit hashes, only ever within one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.llm.store import by_batch
from textwarden.llm.words import Hasher, pieces

LEAST = 12  # words of a run
TIMES = 2  # a word stands in a run at least so often
BLOCK = 1 << 20  # windows compared at once
LONG = 1 << 12  # words from which on a run rules out the lags that are its multiples
BASE = 0x9E3779B97F4A7C15


def split(words: np.ndarray, segment: np.ndarray, least: int = LEAST) -> list[np.ndarray]:
    """The places of the words of every segment in which each word stands twice or more.

    ``segment`` is the number of the text of each word; places of a segment are neighbours.
    """
    at = np.arange(len(words))
    while True:
        _, at, segment = _long_enough(at, segment, least)
        if not len(at):
            return []
        order = np.lexsort((words[at], segment))
        w, s = words[at][order], segment[order]
        new = np.r_[True, (w[1:] != w[:-1]) | (s[1:] != s[:-1])]
        group = np.cumsum(new) - 1
        keep = np.empty(len(at), bool)
        keep[order] = np.bincount(group)[group] >= TIMES
        if keep.all():
            return np.split(at, np.flatnonzero(np.diff(segment)) + 1)
        at, segment = at[keep], segment[keep]


def _long_enough(at: np.ndarray, segment: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The segments, cut where places are missing, that are long enough; numbered anew."""
    if not len(at):
        return at, at, segment
    new = np.r_[True, (np.diff(at) != 1) | (np.diff(segment) != 0)]
    number = np.cumsum(new) - 1
    sizes = np.bincount(number)
    keep = sizes[number] >= least
    return sizes, at[keep], number[keep]


class Windows:
    """Hashes of all windows of a segment's words."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.powers = np.cumprod(np.r_[np.uint64(1), np.full(n, BASE, np.uint64)])
        self.sums = np.r_[np.uint64(0), np.cumsum(words * self.powers[:n])]

    def same(self, a: np.ndarray, lag: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the windows at a and a + lag look the same; equal ones always do."""
        x, y = self.sums[a + size] - self.sums[a], self.sums[a + lag + size] - self.sums[a + lag]
        return x * self.powers[lag] == y

    def reach(self, a: np.ndarray, lag: np.ndarray, ahead: bool) -> np.ndarray:
        """How many words from a on (or before a) look the same as those a lag further on."""
        lo, hi = np.zeros(len(a), np.int64), (len(self.sums) - 1 - lag - a if ahead else a.copy())
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            ok = self.same(a if ahead else a - mid, lag, mid)
            lo, hi = np.where(ok, mid, lo), np.where(ok, hi, mid - 1)
        return lo


def _lags(n: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place, lag, size) of the windows to compare in a segment of n words, lags rising, in blocks."""
    lags = np.arange(1, n // 2 + 1)
    sizes = (np.maximum(lags, least - lags) + 1) // 2
    many = (n - lags - sizes) // sizes + 1  # windows that end, a lag further on, within the segment
    lags, sizes, many = (x[many > 0] for x in (lags, sizes, many))
    low = 0
    while low < len(lags):
        sums = np.cumsum(many[low:])
        # blocks double, so that long runs found among short lags rule out longer ones
        high = low + max(1, min(int(np.searchsorted(sums, BLOCK, "right")), low + 64))
        lag, size, k = (x[low:high] for x in (lags, sizes, many))
        number = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        size = np.repeat(size, k)
        yield number * size, np.repeat(lag, k), size
        low = high


def runs_of(words: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a segment, sorted."""
    n, found, long = len(words), {}, []
    windows = Windows(words)
    for a, lag, size in _lags(n, least):
        hit = windows.same(a, lag, size)
        for s, e, q in long:
            # a window inside a run whose period divides the lag is of that very run
            hit &= ~((lag % q == 0) & (a >= s) & (a + lag + q <= e))
        a, lag = a[hit], lag[hit]
        if not len(a):
            continue
        start = a - windows.reach(a, lag, ahead=False)
        end = a + windows.reach(a, lag, ahead=True) + lag
        ok = end - start >= np.maximum(least, 2 * lag)
        for s, e, q in np.unique(np.stack([start[ok], end[ok], lag[ok]], axis=1), axis=0).tolist():
            if found.get((s, e), n) <= q:
                continue
            if not np.array_equal(words[s : e - q], words[s + q : e]):
                return plain_runs(words, least)  # two windows with one hash
            found[s, e] = q
            if e - s >= LONG:
                long.append((s, e, q))
    return sorted((s, e - s, q) for (s, e), q in found.items())


def plain_runs(words: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """The same, comparing all words at all lags."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        same = np.r_[False, words[:-q] == words[q:], False]
        edges = np.flatnonzero(same[1:] != same[:-1])
        for s, e in edges.reshape(-1, 2).tolist():
            if e + q - s >= max(least, 2 * q):
                found.setdefault((s, e + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def runs_of_texts(words: np.ndarray, begin: np.ndarray, least: int = LEAST) -> dict[int, list[tuple[int, int, int]]]:
    """Per text that has any, its runs; ``begin`` says where the words of each text begin."""
    text = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    out: dict[int, list] = {}
    for at in split(words, text, least):
        found = runs_of(words[at], least)
        if found:
            mine = int(text[at[0]])
            out.setdefault(mine, []).extend((int(at[0] - begin[mine]) + s, size, q) for s, size, q in found)
    return {t: sorted(r) for t, r in out.items()}


def periodic_runs(docs: DataFrame, key: str, text: str, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs, n_dropped and collapsed per row; row work, no shuffle.

    ``runs`` is a list of (start, length, period) in words, sorted.  ``collapsed`` is the text
    of the words outside runs and of the first period of each run, joined by one space; a word
    that any run drops is dropped.  Words are runs of characters other than the six ASCII
    spaces, upper and lower case told apart.  Null and empty texts, and those without words,
    have no run and collapse to an empty text.  Rows repeated under one id, and rows without
    id, each stand for themselves.  Other columns are not carried, whatever they are called.
    """
    kept = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("__text"))

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        hasher = Hasher(fold=False)
        counts, lists, dropped, texts = [], [], [], []
        for _, data, cuts in pieces(batch.column(1)):
            words, begin = hasher.words(data, cuts)
            runs = runs_of_texts(words, begin, least)
            gone = np.zeros(len(words), bool)
            for t, rows in runs.items():
                for start, size, q in rows:
                    gone[begin[t] + start + q : begin[t] + start + size] = True
            counts.append(np.diff(begin))
            before = np.r_[0, np.cumsum(gone)]
            dropped.append(np.diff(before[begin]))
            lists.extend(runs.get(t, []) for t in range(len(cuts) - 1))
            texts.extend(_collapsed(data, cuts, hasher, begin, gone))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.concatenate(counts), pa.int64()), _run_lists(lists),
             pa.array(np.concatenate(dropped), pa.int64()), pa.array(texts, pa.string())],
            ["doc_id", "n_words", "runs", "n_dropped", "collapsed"],
        )

    kind = kept.schema["doc_id"].dataType.simpleString()
    return by_batch(
        kept,
        make,
        f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>,"
        " n_dropped long, collapsed string",
    )


def _run_lists(lists: list[list[tuple[int, int, int]]]) -> pa.ListArray:
    offsets = np.zeros(len(lists) + 1, np.int32)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    flat = np.array([r for x in lists for r in x], np.int64).reshape(-1, 3)
    fields = [pa.array(np.ascontiguousarray(flat[:, i])) for i in range(3)]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))


def _collapsed(data: np.ndarray, cuts: np.ndarray, hasher: Hasher, begin: np.ndarray, gone: np.ndarray) -> Iterator[str]:
    """The kept words of every text, joined by one space: bytes of kept words, each with the space behind it."""
    if not len(data):
        yield from [""] * (len(cuts) - 1)
        return
    starts, ends = hasher.spans(data, cuts)
    starts, ends = starts[~gone], ends[~gone]
    sizes = ends - starts + 2  # with a space
    out_cuts = np.r_[0, np.cumsum(sizes)]
    out = np.full(out_cuts[-1], ord(" "), np.uint8)
    steps = np.zeros(len(data) + 1, np.int64)
    steps[starts] = 1
    steps[ends + 1] -= 1
    inside = np.cumsum(steps[:-1]).astype(bool)
    place = np.arange(out_cuts[-1])
    behind = np.zeros(len(out), bool)
    behind[out_cuts[1:] - 1] = True
    out[place[~behind]] = data[inside]
    before = np.r_[0, np.cumsum(~gone)][begin]  # kept words before each text
    whole = out.tobytes()
    for a, b in zip(out_cuts[before[:-1]].tolist(), out_cuts[before[1:]].tolist()):
        yield whole[a : max(a, b - 1)].decode()

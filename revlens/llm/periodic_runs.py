"""Periodic runs of words (operator 12): maximal repetitions, found with difference-cover LCE queries.

A run is a stretch of consecutive words with smallest period q (words q apart are the same), of
``max(least_words, exponent * q)`` words or more, that can't be made longer on either side.

1. The words of a slice of documents become numbers in one array, an own number after each document.
2. Harmonic grid: a run of period q holds ``max(least_words, exponent * q) - q`` places whose word
   comes again q words later, so a grid of that step has a place in each. The pairs (place, place + q)
   of all grids are n log n in number; they are made in chunks of ``PAIRS`` and most differ at once.
3. How far a pair agrees to the right and to the left (its longest common extension): a pair that
   differs within ``V`` words both ways is settled by comparing them. For all others
   the suffixes at places of a difference cover modulo ``V`` are sorted, by blocks of ``V`` words and then
   by doubling; fewer than ``V`` words from any two places lie two such places, and their common
   prefix is a range minimum over the sorted suffixes' neighbours, taken from a sparse table. The left
   side does the same on the reversed array.
4. A stretch found with several periods has the smallest of them.

A word is dropped from the collapsed text if a run holds it after that run's first q words.

All of a document is in one task, and nothing is shuffled: memory is that of one slice of documents or
of one long text (some 40 bytes a word where runs are likely).

Defined results: a null, empty or wordless text has no runs and an empty collapsed text; null ids and
repeated rows are rows like any other; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import bound_batches

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Differences of these places modulo V give every remainder.
V, COVER = 31, (0, 1, 3, 8, 12, 18)
#: Characters of text worked on at once, and pairs of the grids.
SLICE_CHARS, PAIRS = 2_000_000, 1_000_000
SCHEMA = "doc_id bigint, starts array<bigint>, lengths array<bigint>, periods array<bigint>, collapsed string"


@dataclass(frozen=True)
class Settings:
    least_words: int = 6
    exponent: int = 4


def _shifts() -> np.ndarray:
    """For remainders r, s of two places: the fewest words that bring both to places of the cover."""
    into = np.isin(np.arange(2 * V) % V, COVER)
    out = np.zeros((V, V), dtype=np.int64)
    for r in range(V):
        for s in range(V):
            out[r, s] = next(k for k in range(V) if into[(r + k) % V] and into[(s + k) % V])
    return out


SHIFT = _shifts()


def agree(x: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray | int) -> np.ndarray:
    """How many words from i and j are the same, ``most`` at most, by comparing them."""
    most = np.broadcast_to(most, i.shape)
    out = most.astype(np.int64).copy()
    left = np.flatnonzero(most > 0)
    for t in range(int(most.max(initial=0))):
        same = x[i[left] + t] == x[j[left] + t]
        out[left[~same]] = t
        left = left[same]
        left = left[most[left] > t + 1]
        if not len(left):
            break
    return out


class Extensions:
    """Longest common extensions to the right in ``x``, whose suffixes all differ before its end."""

    def __init__(self, x: np.ndarray):
        top = int(x.max(initial=0)) + 1
        blocks = -(-len(x) // V) + 1
        # Places after the end hold numbers of their own.
        self.x = np.concatenate([x, top + np.arange(blocks * V + V - len(x))]).astype(np.int64)
        self.index = np.full(V, -1)
        self.index[list(COVER)] = np.arange(len(COVER))
        places = (np.arange(blocks)[:, None] * V + np.array(COVER)[None, :]).ravel()
        self.places = places
        m = len(places)
        bits = int(self.x.max()).bit_length()
        each = max(1, 62 // bits)
        keys = []
        for a in range(0, V, each):
            key = np.zeros(m, dtype=np.int64)
            for t in range(a, min(V, a + each)):
                key = (key << bits) | self.x[places + t]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        new = np.zeros(m, dtype=bool)
        for key in keys:
            new[1:] |= key[order[1:]] != key[order[:-1]]
        levels = [self._ranks(order, new)]
        step = len(COVER)
        while int(levels[-1].max()) + 1 < m:
            rank = levels[-1].astype(np.int64)
            later = np.zeros(m, dtype=np.int64)
            if step < m:
                later[:-step] = rank[step:] + 1
            key = rank * (m + 1) + later
            order = np.argsort(key, kind="stable")
            new = np.zeros(m, dtype=bool)
            new[1:] = key[order[1:]] != key[order[:-1]]
            levels.append(self._ranks(order, new))
            step *= 2
        self.rank = levels[-1]
        self.least = self._sparse_table(self._neighbours(order, levels[:-1]))

    @staticmethod
    def _ranks(order: np.ndarray, new: np.ndarray) -> np.ndarray:
        out = np.empty(len(order), dtype=np.int32)
        out[order] = np.cumsum(new)
        return out

    def _neighbours(self, order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Common prefix of each sorted suffix with the one before it (0 for the first)."""
        a, b = order[:-1], order[1:]
        off = np.zeros(len(a), dtype=np.int64)
        m = len(order)
        for n, rank in reversed(list(enumerate(levels))):
            # Suffixes that reach the end differ there, so an equal rank is an equal stretch.
            inside = np.flatnonzero((a + off < m) & (b + off < m))
            same = inside[rank[a[inside] + off[inside]] == rank[b[inside] + off[inside]]]
            off[same] += len(COVER) << n
        words = off // len(COVER) * V
        i, j = self.places[a] + words, self.places[b] + words
        rest = agree(self.x, i, j, np.minimum(V, len(self.x) - np.maximum(i, j)))
        return np.concatenate([[0], words + rest]).astype(np.int32)

    @staticmethod
    def _sparse_table(values: np.ndarray) -> list[np.ndarray]:
        table, step = [values], 1
        while 2 * step <= len(values):
            table.append(np.minimum(table[-1][:-step], table[-1][step:]))
            step *= 2
        return table

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """i and j differ in every pair and lie before the end."""
        shift = SHIFT[i % V, j % V]
        out = agree(self.x, i, j, shift)
        met = np.flatnonzero(out == shift)
        if len(met):
            a, b = i[met] + shift[met], j[met] + shift[met]
            a = self.rank[a // V * len(COVER) + self.index[a % V]]
            b = self.rank[b // V * len(COVER) + self.index[b % V]]
            low, high = np.minimum(a, b) + 1, np.maximum(a, b)
            level = np.log2(high - low + 1).astype(np.int64)
            found = np.empty(len(met), dtype=np.int64)
            for n in np.unique(level):
                at = np.flatnonzero(level == n)
                row = self.least[n]
                found[at] = np.minimum(row[low[at]], row[high[at] + 1 - (1 << int(n))])
            out[met] += found
        return out


def grid_pairs(low: np.ndarray, n: np.ndarray, s: Settings) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, place, period) of all grids, in chunks; documents begin at ``low`` and have ``n`` words."""
    most = np.where(n >= s.least_words, np.maximum(n // s.exponent, np.where(n >= max(s.least_words, s.exponent), 1, 0)), 0)
    for lo, hi in _chunks(most):
        doc = np.repeat(np.arange(lo, hi), most[lo:hi])
        q = np.arange(len(doc)) - np.repeat(np.cumsum(most[lo:hi]) - most[lo:hi], most[lo:hi]) + 1
        step = np.maximum(s.least_words, s.exponent * q) - q
        count = (n[doc] - q - 1) // step + 1
        for a, b in _chunks(count):
            of = np.repeat(np.arange(a, b), count[a:b])
            at = np.arange(len(of)) - np.repeat(np.cumsum(count[a:b]) - count[a:b], count[a:b])
            yield doc[of], low[doc[of]] + at * step[of], q[of]


def _chunks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of entries whose sizes sum up to about ``PAIRS``."""
    part = (np.cumsum(sizes) - 1).clip(0) // PAIRS
    edges = np.flatnonzero(np.diff(part)) + 1
    yield from zip([0, *edges.tolist()], [*edges.tolist(), len(sizes)], strict=True)


def runs_of(texts: list[np.ndarray], s: Settings) -> list[np.ndarray]:
    """Per sequence of numbers its runs as rows (start, length, period), by start, then period."""
    n = np.array([len(t) for t in texts], dtype=np.int64)
    low = np.cumsum(n + 1) - n - 1
    if not len(n):
        return []
    top = max((int(t.max(initial=-1)) for t in texts), default=-1) + 1
    x = np.empty(int(n.sum()) + len(n), dtype=np.int64)
    for k, t in enumerate(texts):
        x[low[k]:low[k] + n[k]] = t
        x[low[k] + n[k]] = top + k
    found: list[tuple[np.ndarray, ...]] = []
    open_pairs: list[tuple[np.ndarray, ...]] = []
    back = x[::-1]
    for doc, i, q in grid_pairs(low, n, s):
        keep = np.flatnonzero(x[i] == x[i + q])
        doc, i, q = doc[keep], i[keep], q[keep]
        right = agree(x, i, i + q, np.minimum(V, low[doc] + n[doc] + 1 - i - q))
        left = agree(back, len(x) - i, len(x) - i - q, np.minimum(V, i - low[doc]))
        settled = (right < V) & (left < V)
        found.append((doc[settled], i[settled], q[settled], left[settled], right[settled]))
        open_pairs.append((doc[~settled], i[~settled], q[~settled]))
    if open_pairs and sum(len(p[0]) for p in open_pairs):
        doc, i, q = (np.concatenate(c) for c in zip(*open_pairs, strict=True))
        docs, own = np.unique(doc, return_inverse=True)
        lows = np.cumsum(n[docs] + 1) - n[docs] - 1
        sub = np.concatenate([x[low[d]:low[d] + n[d] + 1] for d in docs])
        at = i - low[doc] + lows[own]
        right = Extensions(sub)(at, at + q)
        # Reversed, every document begins with its own number; the first word has nothing to its left.
        flipped = Extensions(sub[::-1].copy())
        left = np.zeros(len(at), dtype=np.int64)
        inner = np.flatnonzero(at > lows[own])
        left[inner] = flipped(len(sub) - at[inner], len(sub) - at[inner] - q[inner])
        left = np.minimum(left, at - lows[own])
        found.append((doc, i, q, left, right))
    doc, i, q, left, right = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 5
    long_enough = left + right + q >= np.maximum(s.least_words, s.exponent * q)
    doc, i, q, left, right = (c[long_enough] for c in (doc, i, q, left, right))
    start, length = i - left - low[doc], left + right + q
    order = np.lexsort((q, length, start, doc))
    doc, start, length, q = doc[order], start[order], length[order], q[order]
    first = np.ones(len(doc), dtype=bool)
    first[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    doc, rows = doc[first], np.stack([start[first], length[first], q[first]], axis=1)
    rows = rows[order := np.lexsort((rows[:, 2], rows[:, 0], doc))]
    doc = doc[order]
    edges = np.searchsorted(doc, np.arange(len(n) + 1))
    return [rows[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def collapse(words: list[str], runs: np.ndarray) -> list[str]:
    """The words that no run holds after its first period."""
    if not len(runs):
        return words
    turns = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(turns, runs[:, 0] + runs[:, 2], 1)
    np.add.at(turns, runs[:, 0] + runs[:, 1], -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(turns[:-1]) == 0).tolist()]


def find_runs(docs: DataFrame, s: Settings | None = None) -> DataFrame:
    """``docs`` (doc_id, text) to doc_id, runs (start, length, period; by start, then period) and the
    collapsed text, words joined by one space."""
    s = s or Settings()
    bound_batches(docs.sparkSession)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            a = 0
            while a < len(ids):
                chars, words, b = 0, [], a
                while b < len(ids) and chars < SLICE_CHARS:
                    text = texts[b].as_py() or ""
                    chars += len(text)
                    words.append(WORD.findall(text))
                    b += 1
                yield _rows(ids[a:b], words, s)
                a = b

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(part, SCHEMA)
    return found.select("doc_id", F.arrays_zip(F.col("starts").alias("start"), F.col("lengths").alias("length"),
                                               F.col("periods").alias("period")).alias("runs"), "collapsed")


def _rows(ids: list[int | None], words: list[list[str]], s: Settings) -> pa.RecordBatch:
    number: dict[str, int] = {}
    runs = runs_of([np.fromiter((number.setdefault(w, len(number)) for w in ws), np.int64, len(ws)) for ws in words], s)
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in runs])]), pa.int32())
    flat = np.concatenate(runs)
    lists = [pa.ListArray.from_arrays(offsets, pa.array(flat[:, c], pa.int64())) for c in range(3)]
    collapsed = pa.array([" ".join(collapse(w, r)) for w, r in zip(words, runs, strict=True)], pa.string())
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *lists, collapsed],
                                      names=["doc_id", "starts", "lengths", "periods", "collapsed"])

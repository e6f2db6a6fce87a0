"""Cross-tokenizer alignment (operator 13): which ids of two tokenizers stand for the same bytes.

A text is encoded whole by A (a byte-level BPE file of the ``tokenizers`` library, over space + text)
and by B (a ``sentencepiece`` model, which puts the space in itself). Byte offsets where tokens of both
end cut the tokens into groups; every A-B pair of occurrences in a group is a link.

1. ``align`` encodes documents and finds anchors: ends of an A token before a token that begins with a
   space, where a B token ends as well. They split a document into windows (about a word each). Of the
   windows of a slice of documents, those with the same pair of id tuples are found by a hash of the
   ids, compared, and aligned once for all. A task puts its documents into blocks
   of ``BLOCK_CHARS`` characters; a block's distinct id pairs are one more row, with the number
   of its documents that hold each, and documents hold places in that list.
2. ``with_link_counts`` adds up the blocks' numbers per id pair over the corpus, marks pairs whose count
   is the highest of their A id, and sends each block the counts of its own pairs.

Nothing but ids and counts is shuffled: each id pair once per block, and documents' places to the
counts of their block. The highest count per A id is at most one row per entry of A's vocabulary.

A's ids are put together from those of pieces between single spaces, where the tokenizer's own
splitting begins a new word (``token_files.PieceEncoder``); tests compare them with its call on whole
texts. Tokens' bytes: A's entry with its byte-level letters decoded; B's piece in UTF-8 with U+2581 as space,
``<0xHH>`` as that byte. Strings of special tokens inside a text are plain text.

Defined results: texts that are null or empty, or whose joined bytes of A or B are not space + text,
have no tokens: all numbers 0 and an empty ``groups``. Null ids are kept; repeated rows all
count as documents; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import bound_batches, known_id, null_id, stored
from revlens.llm.token_files import RARE_SPACE, SPACE, PieceEncoder

#: Characters encoded at once, and characters of a block's documents (the last may be longer).
SLICE_CHARS, BLOCK_CHARS = 1_500_000, 4_000_000
#: Pieces of text whose ids of A a worker remembers, some 150 MB; beyond them it starts anew.
CACHE_PIECES = 700_000
#: Documents in one batch of output.
ROWS_OUT = 500
#: Pairs of a group beyond which ids that repeat are counted before they are paired.
LARGE_GROUP = 256
NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
ALIGNED = ("block bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, "
           "links binary, pairs array<bigint>, holders array<bigint>")


class TokenizerA(PieceEncoder):
    """Ids of space + text by a byte-level BPE file; pieces between single spaces are encoded once."""

    def __init__(self, path: str):
        super().__init__(path, CACHE_PIECES)
        self.tokenizer.encode_special_tokens = True
        letters = {c: b for b, c in self.printable.items()}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        added = {k: t.content for k, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.bytes = [b""] * (max([*vocabulary.values(), *added], default=-1) + 1)
        for entry, k in [*vocabulary.items(), *((c, k) for k, c in added.items())]:
            self.bytes[k] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        self.odd: set[str] = set()

    def __missing__(self, piece: str) -> bytes:
        found = super().__missing__(piece)
        if b"".join(map(self.bytes.__getitem__, np.frombuffer(found, self.dtype).tolist())) != piece.encode():
            self.odd.add(piece)
        return found

    def ids(self, text: str) -> np.ndarray | None:
        """None if the entries' bytes are not those of space + text."""
        if self.any_added and self.any_added.search(text):  # as plain text, whatever lies between
            ids = np.array(self.tokenizer.encode(" " + text, add_special_tokens=False).ids)
            whole = b"".join(map(self.bytes.__getitem__, ids.tolist()))
            return ids if whole == (" " + text).encode() else None
        if text[0].isspace() or text[-1].isspace() or "  " in text or "\n " in text or " \n" in text or "\x00" in text \
                or RARE_SPACE.search(text):
            pieces = SPACE.split(" " + text)
        else:
            pieces = (" " + text).replace(" ", "\x00 ").split("\x00")[1:]
        found = b"".join(map(self.__getitem__, pieces))
        if self.odd and not self.odd.isdisjoint(pieces):
            return None
        return np.frombuffer(found, self.dtype)


class TokenizerB:
    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [bytes([int(self.library.id_to_piece(k)[3:-1], 16)]) if self.library.is_byte(k)
                      else self.library.id_to_piece(k).replace("▁", " ").encode()
                      for k in range(self.library.get_piece_size())]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)

    def covers(self, whole: str, ids: list[int]) -> bool:
        return b"".join(map(self.bytes.__getitem__, ids)) == whole.encode()


class Aligner:
    """Aligns the documents of a slice at once, each window of the same id tuples once."""

    def __init__(self, a: TokenizerA, b: TokenizerB):
        self.a, self.b = a, b
        self.width_a, self.width_b = (np.array([len(x) for x in t.bytes], dtype=np.int64) for t in (a, b))
        self.space_a, self.space_b = (np.array([x[:1] == b" " for x in t.bytes]) for t in (a, b))
        # An id as text and what follows it: more of its side, the other side, the next group.
        self.shown = [f"{k}{after}" for after in ",|;" for k in range(max(len(a.bytes), len(b.bytes)))]

    def documents(self, texts: list[str]) -> list[tuple[int, int, int, int, str, np.ndarray, np.ndarray]]:
        """Per text n_a, n_b, n_groups, n_links, groups, distinct pair keys and how often each is linked."""
        none = np.empty(0, np.int64)
        out = [(0, 0, 0, 0, "", none, none)] * len(texts)
        ids_a = [self.a.ids(t) if t else None for t in texts]
        ids_b = self.b.encode(texts)
        kept = [k for k, t in enumerate(texts) if ids_a[k] is not None and self.b.covers(" " + t, ids_b[k])]
        if not kept:
            return out
        a, n_a = np.concatenate([ids_a[k] for k in kept]).astype(np.int64), np.array([len(ids_a[k]) for k in kept])
        b, n_b = _flat([ids_b[k] for k in kept])
        cuts_a, cuts_b = self._anchors(a, b)
        window, of = self._windows(a, b, cuts_a, cuts_b)
        shown, groups, size, keys, times = self._align(*_cut(a, cuts_a, of), *_cut(b, cuts_b, of))
        # All links of a document, from those of its windows.
        distinct, place = np.unique(keys, return_inverse=True)
        first = np.searchsorted(cuts_a[:-1], np.concatenate([[0], np.cumsum(n_a)]))
        doc = np.repeat(np.arange(len(kept)), np.diff(first))
        at = _ranges((np.cumsum(size) - size)[window], size[window])
        code, own = np.unique(np.repeat(doc, size[window]) * len(distinct) + place[at], return_inverse=True)
        linked = np.bincount(own, weights=times[at], minlength=len(code)).astype(np.int64)
        edges = np.searchsorted(code, np.arange(len(kept) + 1) * len(distinct))
        groups, window = groups[window], window.tolist()
        for n, k in enumerate(kept):
            lo, hi = edges[n], edges[n + 1]
            out[k] = (int(n_a[n]), int(n_b[n]), int(groups[first[n]:first[n + 1]].sum()), int(linked[lo:hi].sum()),
                      ";".join([shown[w] for w in window[first[n]:first[n + 1]]]), distinct[code[lo:hi] - n * len(distinct)], linked[lo:hi])
        return out

    def _anchors(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where windows begin, and the end: A ends before a token that begins with a space, and B ends
        there before such a token too. Every document begins with a space, so its end is an anchor."""
        ends_a, ends_b = np.cumsum(self.width_a[a]), np.cumsum(self.width_b[b])
        before = np.flatnonzero(np.append(self.space_a[a[1:]], True))
        at = np.searchsorted(ends_b, ends_a[before])
        verified = (ends_b[at] == ends_a[before]) & np.append(self.space_b[b[1:]], True)[at]
        return np.concatenate([[0], before[verified] + 1]), np.concatenate([[0], at[verified] + 1])

    def _windows(self, a: np.ndarray, b: np.ndarray, cuts_a: np.ndarray, cuts_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of equal windows and one window of each, found by a hash of the ids and compared."""
        mark = _mixed(a, cuts_a, 1) + _mixed(b, cuts_b, 2)
        _, of, window = np.unique(mark, return_index=True, return_inverse=True)
        like = of[window]
        same = _equal(a, cuts_a, like) & _equal(b, cuts_b, like)
        if not same.all():  # two windows of one hash: each has a number of its own
            odd = np.flatnonzero(~same)
            window[odd] = len(of) + np.arange(len(odd))
            of = np.concatenate([of, odd])
        return window, of

    def _align(self, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Aligns windows laid end to end (both sides cover the same bytes, so their ends are shared):
        per window its groups as text, their number and that of its links' keys; the keys and times."""
        ends_a, ends_b = np.cumsum(self.width_a[a]), np.cumsum(self.width_b[b])
        at = np.searchsorted(ends_b, ends_a)
        last_a = np.flatnonzero(ends_b[at] == ends_a)
        last_b = at[last_a]
        size_a, size_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        # Text: each group's A ids, then its B ids.
        start = np.cumsum(size_a + size_b) - size_a - size_b
        seq = np.empty(len(a) + len(b), np.int64)
        width = len(self.shown) // 3
        put_a, put_b = _ranges(start, size_a), _ranges(start + size_a, size_b)
        seq[put_a], seq[put_b] = a, b
        seq[start + size_a - 1] += width
        seq[start + size_a + size_b - 1] += 2 * width
        shown = [self.shown[k] for k in seq.tolist()]
        # Links: each A id of a group with each of its B ids; of large groups, ids are counted first.
        by_window = np.searchsorted(last_a, np.concatenate([[0], np.cumsum(n_a)]))
        from_a, from_b = last_a + 1 - size_a, last_b + 1 - size_b
        pairs = size_a * size_b
        large = np.flatnonzero(pairs > LARGE_GROUP)
        pairs[large] = 0
        group = np.repeat(np.arange(len(pairs)), pairs)
        nth = np.arange(len(group)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        keys = a[from_a[group] + nth // size_b[group]] << 32 | b[from_b[group] + nth % size_b[group]]
        times = np.ones(len(keys), np.int64)
        if len(large):
            counted = [_counted_pairs(a[from_a[g]:last_a[g] + 1], b[from_b[g]:last_b[g] + 1]) for g in large.tolist()]
            group = np.concatenate([group, np.repeat(large, [len(c[0]) for c in counted])])
            order = np.argsort(group, kind="stable")
            keys = np.concatenate([keys, *(c[0] for c in counted)])[order]
            times = np.concatenate([times, *(c[1] for c in counted)])[order]
            group = group[order]
        size = np.diff(np.searchsorted(group, by_window))
        text = np.concatenate([start, [len(seq)]])[by_window].tolist()
        joined = ["".join(shown[i:j])[:-1] for i, j in zip(text, text[1:], strict=False)]
        return joined, np.diff(by_window), size, keys, times


def _cut(ids: np.ndarray, cuts: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of windows ``of``, one after another, and how many each has."""
    sizes = np.diff(cuts)[of]
    return ids[_ranges(cuts[of], sizes)], sizes


#: Per worker process, so that later tasks use the pieces of earlier ones.
_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def _flat(lists: list) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum())), sizes


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each size, one after another."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def _mixed(ids: np.ndarray, cuts: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each window's ids in order."""
    place = np.arange(len(ids)) - np.repeat(cuts[:-1], np.diff(cuts))
    h = (ids.astype(np.uint64) + np.uint64(seed << 40)) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.add.reduceat(h ^ (h >> np.uint64(32)), cuts[:-1])


def _equal(ids: np.ndarray, cuts: np.ndarray, like: np.ndarray) -> np.ndarray:
    """Whether each window has the same ids as window ``like``."""
    sizes = np.diff(cuts)
    same = sizes == sizes[like]
    short = np.minimum(sizes, sizes[like])
    differs = ids[_ranges(cuts[:-1], short)] != ids[_ranges(cuts[like], short)]
    return same & (np.add.reduceat(differs, np.cumsum(short) - short) == 0)


def _counted_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all pairs of ids of a group, and how many pairs of occurrences each stands for."""
    a, times_a = np.unique(a, return_counts=True)
    b, times_b = np.unique(b, return_counts=True)
    return np.repeat(a << 32, len(b)) | np.tile(b, len(a)), np.repeat(times_a, len(b)) * np.tile(times_b, len(a))


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``docs`` (doc_id, text) to one row per document (n_a, n_b, n_groups, n_links, groups as
    ``a1,a2|b1;...``, and packed links) and one per block (its distinct pairs and how many of its
    documents hold each; these have no ``links``)."""
    bound_batches(docs.sparkSession)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path_a, path_b) not in _ALIGNERS:
            _ALIGNERS[path_a, path_b] = Aligner(TokenizerA(path_a), TokenizerB(path_b))
        aligner = _ALIGNERS[path_a, path_b]
        block, held, chars = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            a = 0
            while a < len(ids):
                some, size = [], 0
                while a + len(some) < len(ids) and size < SLICE_CHARS:
                    some.append(texts[a + len(some)].as_py() or "")
                    size += len(some[-1])
                held += [(doc_id, *one) for doc_id, one in zip(ids[a:], aligner.documents(some), strict=False)]
                a, chars = a + len(some), chars + size
                if chars >= BLOCK_CHARS:
                    yield from _block_rows(block, held)
                    block, held, chars = block + 1, [], 0
        if held:
            yield from _block_rows(block, held)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(part, ALIGNED)


def _block_rows(block: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
    """A block's documents, some at a time, and its row of pairs. A document's links are places in
    that row and times, as 32-bit integers, compressed."""
    pairs, own, holders = np.unique(np.concatenate([h[6] for h in held]), return_inverse=True, return_counts=True)
    edges = np.cumsum([0, *(len(h[6]) for h in held)])
    schema = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), *((n, pa.int64()) for n in NUMBERS), ("groups", pa.string()),
                        ("links", pa.binary()), ("pairs", pa.list_(pa.int64())), ("holders", pa.list_(pa.int64()))])
    for a in range(0, len(held), ROWS_OUT):
        rows = [{"block": block, "doc_id": h[0], **dict(zip(NUMBERS, h[1:5], strict=True)), "groups": h[5],
                 "links": packed_links(own[edges[k]:edges[k + 1]], h[7])} for k, h in enumerate(held[a:a + ROWS_OUT], a)]
        yield pa.RecordBatch.from_pylist(rows, schema=schema)
    yield pa.RecordBatch.from_arrays(
        [pa.array([block]), *(pa.nulls(1, schema.field(k).type) for k in range(1, 8)),
         *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, pa.int64())) for x in (pairs, holders))],
        schema=schema)


def packed_links(places: np.ndarray, times: np.ndarray) -> bytes:
    return zlib.compress(np.diff(places, prepend=0).astype("<u4").tobytes() + times.astype("<u4").tobytes(), 1)


def unpacked_links(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer(zlib.decompress(data), dtype="<u4").astype(np.int64)
    return np.cumsum(flat[:len(flat) // 2]), flat[len(flat) // 2:]


def pair_counts(aligned: DataFrame) -> DataFrame:
    """key, a, b, n (documents that hold the pair linked) and best (no pair of ``a`` has more)."""
    each = aligned.where("pairs is not null").select(F.explode(F.arrays_zip("pairs", "holders")).alias("x"))
    counts = stored(each.groupBy(F.col("x.pairs").alias("key")).agg(F.sum("x.holders").alias("n"))
                    .withColumn("a", F.shiftrightunsigned("key", 32)), "pair-counts")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))  # one row per entry of A's vocabulary at most
    return counts.join(most, "a").select("key", "a", F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b"), "n",
                                         (F.col("n") == F.col("most")).alias("best"))


def with_link_counts(aligned: DataFrame) -> DataFrame:
    """The documents of ``align`` with n_best (links whose count is the highest of their A id) and
    count_sum (over all links). ``aligned`` is read several times, so it should be a stored table."""
    counts = stored(pair_counts(aligned).select("key", "n", "best"), "best-pairs")
    wanted = aligned.where("pairs is not null").select("block", F.posexplode("pairs").alias("place", "key"))
    answers = wanted.join(counts, "key").select(F.col("block").alias("of_block"), "place", "n", "best")
    docs = aligned.where("links is not null").drop("pairs", "holders")
    own = [c for c in docs.columns if c not in ("block", "links")]

    def looked_up(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values("place")
        n, best = found["n"].to_numpy(), found["best"].to_numpy(dtype=bool)
        sums = [(int(times[best[at]].sum()), int((times * n[at]).sum())) for at, times in map(unpacked_links, rows["links"])]
        return rows[own].assign(n_best=[s[0] for s in sums], count_sum=[s[1] for s in sums])

    docs = docs.withColumn("doc_id", known_id())
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in own)
    out = docs.groupBy("block").cogroup(answers.groupBy("of_block")).applyInPandas(
        looked_up, f"{kinds}, n_best bigint, count_sum bigint")
    return out.withColumn("doc_id", null_id())

"""Katz backoff language model over words (operator 5).

Tokens of a text are its words, ASCII letters lower-cased, and one end. The model is of order two:

    P(w | h) = d(c) c(h w) / c(h)                if h w was learned, c its count
             = alpha(h) P(w)                     if h was learned, but not followed by w
             = P(w)                              otherwise
    P(w)     = d1(c) c(w) / N                    if w was learned
             = what the others leave             for the one unknown word

d and d1 are Good-Turing discounts for counts up to ``K`` from the counts of counts of all n-grams
of that order; larger counts keep all but ``SPARED`` of their mass, so every context has mass to
back off with. alpha(h) = (1 - sum of P(w | h) over words learned after h) / (1 - sum of P(w) over
them), so that P(. | h) sums to 1 over the learned words and the unknown one.

Documents are dealt to blocks and stored in a table bucketed by block. Then, for each order, blocks
ask the tables: a block sends each partition of the n-gram table the distinct n-grams it holds of
that partition with their counts in learning documents, packed in one row, and gets back the counts
in all blocks in the same order. A partition of the table holds all of its n-grams, so counts,
counts of counts and context sums are exact. Bigrams are partitioned by context; contexts that would
fill a good part of a partition are split by their next word, and their sums are put together from
one row per part. What moves is in proportion to the text, and no row per token is ever made.

Defined results: a null text is an empty text, whose only token is its end; rows with a null
``learn`` are not learned from; without learning documents every word is the unknown one, P = 1;
repeated rows are separate documents; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm.common import bound_batches, known_id, null_id, run_folder, shuffle_width, stored

#: Counts up to K are discounted; larger ones keep all but SPARED.
K, SPARED = 5, 1e-6
#: Hash of the end token; words hash to other values but for 1 in 2^64.
END = np.uint64(0x5851F42D4C957F2D)
START = 0                    # id of the context before the first word
STATS, HOT = -1, -2          # "blocks" of rows that carry counts of counts, and parts of split contexts
SCORED = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
          "score double")


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pack(*columns: np.ndarray) -> bytes:
    """Columns of numbers, each as planes of its bytes, compressed."""
    import zstandard

    parts = []
    for c in columns:
        raw = np.ascontiguousarray(c)
        parts.append(np.frombuffer(raw.tobytes(), np.uint8).reshape(len(raw), raw.itemsize).T.tobytes())
    sizes = np.array([len(columns), *map(len, columns)], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(sizes + b"".join(parts))


def unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    sizes, at, out = np.frombuffer(raw, "<i8", n, 8), 8 * (n + 1), []
    for size, kind in zip(sizes.tolist(), kinds, strict=True):
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, size * width, at).reshape(width, size)
        out.append(np.frombuffer(planes.T.tobytes(), kind))
        at += size * width
    return out


def discounts(met: np.ndarray) -> np.ndarray:
    """Good-Turing discount factors d(0..K + 1); the last is that of all larger counts. ``met``:
    numbers of n-grams met 1, 2, ... K + 1 times. Counts without a usable estimate are not
    discounted by more than the larger counts."""
    d = np.full(K + 2, 1 - SPARED)
    d[0] = 0
    if met[0] > 0:
        rest = (K + 1) * met[K] / met[0]
        for r in range(1, K + 1):
            if met[r - 1] > 0 and met[r] > 0 and rest < 1:
                value = ((r + 1) * met[r] / (r * met[r - 1]) - rest) / (1 - rest)
                if 0 < value < 1:
                    d[r] = min(value, 1 - SPARED)
    return d


@dataclass(frozen=True)
class Unigrams:
    """What all blocks know of the words: number of tokens and words learned, discounts, ids."""

    tokens: int
    words: int
    learned_docs: int
    d: np.ndarray
    unknown: float
    bases: np.ndarray        # of each partition of the table, the first id of its words

    def probability(self, count: np.ndarray) -> np.ndarray:
        if not self.tokens:
            return np.ones(len(count))
        c = np.asarray(count, float)
        return np.where(c > 0, self.d[np.minimum(count, K + 1)] * c / self.tokens, self.unknown)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.1) / (self.tokens + 0.1 * (self.words + 1)))


class Block:
    """The tokens of one block's documents, and its distinct words, whatever the rows' order."""

    def __init__(self, texts: list[str | None], learn: np.ndarray) -> None:
        cut = [t.encode("utf-8", "surrogatepass").lower().split() if t else [] for t in texts]
        self.sizes = np.fromiter(map(len, cut), np.int64, len(cut)) + 1
        self.ends = self.sizes.cumsum() - 1
        flat = np.array([w for c in cut for w in c], dtype=object)
        tokens = np.full(int(self.sizes.sum()), END)
        body = np.ones(len(tokens), bool)
        body[self.ends] = False
        tokens[body] = pd.util.hash_array(flat, categorize=False) if len(flat) else flat.astype(np.uint64)
        self.words, self.at = np.unique(tokens, return_inverse=True)
        self.learn = np.repeat(learn, self.sizes)
        self.learned = np.bincount(self.at, self.learn, len(self.words)).astype(np.uint32)

    def word_parts(self, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """Words in the order they are asked for, and the partition of each."""
        to = mix(self.words) % np.uint64(parts)
        order = np.argsort(to, kind="stable")
        return order, to[order].astype(np.int64)

    def set_words(self, replies: pd.DataFrame, uni: Unigrams) -> None:
        """Take in ids and counts of all words."""
        order, to = self.word_parts(len(uni.bases))
        ids, counts = np.zeros(len(self.words), np.uint64), np.zeros(len(self.words), np.uint32)
        for part, begin, end in runs(to):
            steps, count = unpack(replies[part], "u4", "u4")
            ids[order[begin:end]] = steps.astype(np.uint64).cumsum() + np.uint64(uni.bases[part])
            counts[order[begin:end]] = count
        self.ids, self.counts = ids, counts
        # Contexts: 0 is the start of a text, i + 1 the i-th word.
        before = np.concatenate(([0], self.at[:-1] + 1))
        before[self.ends[:-1] + 1] = 0
        width = len(self.words)
        pairs, self.pair_at = np.unique(before * width + self.at, return_inverse=True)
        self.context, self.next = pairs // width, pairs % width
        self.context_ids = np.concatenate(([START], ids)).astype(np.uint64)
        self.context_counts = np.concatenate(([uni.learned_docs], counts)).astype(np.uint32)
        self.pair_learned = np.bincount(self.pair_at, self.learn, len(pairs)).astype(np.uint32)

    def pair_parts(self, parts: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs in the order they are asked for, and the partition of each. Contexts learned more
        than ``limit`` times are split by their next word."""
        splits = self.context_counts[self.context].astype(np.uint64) // np.uint64(limit) + np.uint64(1)
        part = mix(self.ids[self.next]) % splits
        to = mix(self.context_ids[self.context] * np.uint64(0x9E3779B97F4A7C15) + part) % np.uint64(parts)
        order = np.argsort(to, kind="stable")
        return order, to[order].astype(np.int64)


def runs(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, begin, end) of the runs of equal values."""
    if len(values):
        cut = np.concatenate(([0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]))
        yield from zip(values[cut[:-1]].tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True)


ASKED = "part int, block int, data binary"


def ask_words(pdf: pd.DataFrame, parts: int) -> pd.DataFrame:
    block = Block(pdf["text"].tolist(), pdf["learn"].to_numpy(bool))
    order, to = block.word_parts(parts)
    rows = [(part, int(pdf["block"].iloc[0]), pack(block.words[order[a:b]], block.learned[order[a:b]]))
            for part, a, b in runs(to)]
    return pd.DataFrame(rows, columns=["part", "block", "data"])


def count_words(pdf: pd.DataFrame) -> pd.DataFrame:
    """One partition of the word table: replies to all blocks, and its sums."""
    asked = [unpack(d, "u8", "u4") for d in pdf["data"]]
    words, at = np.unique(np.concatenate([w for w, _ in asked]), return_inverse=True)
    counts = np.bincount(at, np.concatenate([n for _, n in asked]), len(words)).astype(np.uint32)
    rows, begin, part = [], 0, int(pdf["part"].iloc[0])
    for block, (own, _) in zip(pdf["block"], asked, strict=True):
        place = at[begin:begin + len(own)]
        begin += len(own)
        # Both sides are in order, so ids are sent as steps.
        rows.append((part, block, pack(np.diff(place, prepend=0).astype(np.uint32), counts[place])))
    met = np.bincount(np.minimum(counts, K + 2), minlength=K + 3)[1:K + 2]
    end = counts[words == END].sum()
    rows.append((part, STATS, pack(np.array([counts.sum(dtype=np.int64), (counts > 0).sum(), len(words), end, *met],
                                            np.int64))))
    return pd.DataFrame(rows, columns=["part", "block", "data"])


def unigrams_of(replies: DataFrame, parts: int) -> Unigrams:
    sums = np.zeros((parts, 4 + K + 1), np.int64)
    for r in replies.where(F.col("block") == STATS).collect():  # one row per partition
        sums[r["part"]] = unpack(bytes(r["data"]), "i8")[0]
    tokens, words, _, docs = (int(x) for x in sums[:, :4].sum(0))
    met = sums[:, 4:].sum(0)
    d = discounts(met)
    # Mass of all learned words; the rest is the unknown word's.
    larger = tokens - int((met[:K] * np.arange(1, K + 1)).sum())
    mass = ((met[:K] * np.arange(1, K + 1) * d[1:K + 1]).sum() + larger * d[K + 1]) / max(1, tokens)
    return Unigrams(tokens, words, docs, d, 1 - mass, np.concatenate(([1], 1 + sums[:, 2].cumsum()[:-1])))


def ask_pairs(texts: pd.DataFrame, replies: pd.DataFrame, uni: Unigrams, parts: int, limit: int) -> pd.DataFrame:
    if not len(texts):
        return pd.DataFrame({"part": [], "block": [], "data": []})
    block = Block(texts["text"].tolist(), texts["learn"].to_numpy(bool))
    block.set_words(dict(zip(replies["part"], replies["data"], strict=True)), uni)
    order, to = block.pair_parts(parts, limit)
    rows = []
    for part, a, b in runs(to):
        pairs = order[a:b]
        contexts = block.context[pairs]
        first = np.flatnonzero(np.concatenate(([True], contexts[1:] != contexts[:-1])))
        rows.append((part, int(texts["block"].iloc[0]), pack(
            block.ids[block.next[pairs]], block.counts[block.next[pairs]], block.pair_learned[pairs],
            block.context_ids[contexts[first]], block.context_counts[contexts[first]],
            np.diff(np.append(first, len(pairs))).astype(np.uint32))))
    return pd.DataFrame(rows, columns=["part", "block", "data"])


def count_pairs(pdf: pd.DataFrame, uni: Unigrams, limit: int) -> pd.DataFrame:
    """One partition of the bigram table: counts for all blocks, sums of the contexts they need."""
    asked = [unpack(d, "u8", "u4", "u4", "u8", "u4", "u4") for d in pdf["data"]]
    word, word_count, learned, context, context_count, size = (np.concatenate(c) for c in zip(*asked, strict=True))
    pair_context = np.repeat(context, size)
    pairs, first, at = np.unique(mix(pair_context * np.uint64(0x9E3779B97F4A7C15) + mix(word)),
                                 return_index=True, return_inverse=True)
    counts = np.bincount(at, learned, len(pairs)).astype(np.int64)
    contexts, of = np.unique(pair_context[first], return_inverse=True)
    sums = np.zeros((len(contexts), K + 2))
    for r in range(1, K + 1):
        sums[:, r - 1] = np.bincount(of, counts == r, len(contexts))
    sums[:, K] = np.bincount(of, np.where(counts > K, counts, 0), len(contexts))
    sums[:, K + 1] = np.bincount(of, np.where(counts > 0, uni.probability(word_count[first]), 0), len(contexts))
    rows, part = [], int(pdf["part"].iloc[0])
    begin = 0
    for block, a in zip(pdf["block"], asked, strict=True):
        n, own, own_count, sizes = len(a[0]), a[3], a[4], a[5]
        count = counts[at[begin:begin + n]]
        begin += n
        new = np.bincount(np.repeat(np.arange(len(own)), sizes), count == 0, len(own)) > 0
        need = np.flatnonzero(new & (own_count > 0) & (own_count < limit))
        rows.append((part, block, pack(count.astype(np.uint32), need.astype(np.uint32), *sums_columns(
            sums[np.searchsorted(contexts, own[need])]))))
    met = np.bincount(np.minimum(counts, K + 2), minlength=K + 3)[1:K + 2]
    rows.append((part, STATS, pack(met.astype(np.int64))))
    total = np.zeros(len(contexts), np.int64)
    total[np.searchsorted(contexts, context)] = context_count
    hot = np.flatnonzero(total >= limit)
    if len(hot):
        rows.append((part, HOT, pack(contexts[hot], *sums_columns(sums[hot]))))
    return pd.DataFrame(rows, columns=["part", "block", "data"])


SUMS = ["u4"] * K + ["i8", "f8"]


def sums_columns(sums: np.ndarray) -> list[np.ndarray]:
    return [sums[:, i].astype(kind) for i, kind in enumerate(SUMS)]


def backoff(sums: np.ndarray, context_count: np.ndarray, d: np.ndarray) -> np.ndarray:
    """alpha of contexts from their sums."""
    seen = (sums[:, :K] @ (d[1:K + 1] * np.arange(1, K + 1)) + sums[:, K] * d[K + 1]) / context_count
    return (1 - seen) / (1 - sums[:, K + 1])


def score_block(texts: pd.DataFrame, replies: pd.DataFrame, uni: Unigrams, parts: int, limit: int,
                d: np.ndarray, hot: dict[int, np.ndarray]) -> pd.DataFrame:
    """Scores of a block's documents from the replies of both tables."""
    if not len(texts):
        return pd.DataFrame({c.split()[0]: [] for c in SCORED.split(", ")})
    block = Block(texts["text"].tolist(), texts["learn"].to_numpy(bool))
    for_words, for_pairs = (replies[replies["n"] == n] for n in (1, 2))
    block.set_words(dict(zip(for_words["part"], for_words["data"], strict=True)), uni)
    order, to = block.pair_parts(parts, limit)
    data = dict(zip(for_pairs["part"], for_pairs["data"], strict=True))
    known = uni.probability(block.counts)
    score = np.zeros(len(order))
    for part, a, b in runs(to):
        pairs = order[a:b]
        count, need, *sums = unpack(data[part], "u4", "u4", *SUMS)
        contexts = block.context[pairs]
        n = block.context_counts[contexts].astype(float)
        with np.errstate(divide="ignore"):
            seen = np.log10(d[np.minimum(count, K + 1)] * count / np.maximum(n, 1))
        first = np.flatnonzero(np.concatenate(([True], contexts[1:] != contexts[:-1])))
        run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(pairs))))
        weight = np.ones(len(first))
        if len(need):
            weight[need] = backoff(np.stack(sums, 1), n[first[need]], d)
        for i in np.flatnonzero(block.context_counts[contexts[first]] >= limit).tolist():
            c = contexts[first[i]]
            weight[i] = backoff(hot[int(block.context_ids[c])][None], n[first[i:i + 1]], d)[0]
        score[pairs] = np.where(count > 0, seen, np.log10(weight[run]) + np.log10(known[block.next[pairs]]))
    begin = block.ends - block.sizes + 1
    return pd.DataFrame({
        "doc_id": texts["doc_id"].to_numpy(), "held_out": texts["held_out"].to_numpy(bool), "n_tokens": block.sizes,
        "n_known": np.add.reduceat(block.counts[block.at] > 0, begin, dtype=np.int64), "train_tokens": uni.tokens,
        "base_score": np.add.reduceat(uni.base(block.counts.astype(float))[block.at], begin),
        "score": np.add.reduceat(score[block.pair_at], begin)})


def block_values(spark: SparkSession, n: int) -> list[int]:
    """Of each of n hash partitions, a number that Spark's hash deals to it."""
    got: dict[int, int] = {}
    size = 16 * n
    while len(got) < n:
        for r in spark.range(size).select(F.col("id").cast("int").alias("v"), F.pmod(F.hash(F.col("id").cast(
                "int")), F.lit(n)).alias("p")).groupBy("p").agg(F.min("v").alias("v")).collect():
            got.setdefault(r["p"], r["v"])
        size *= 4
    return [got[p] for p in range(n)]


def katz_scores(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Learn from the rows of ``docs`` (doc_id, text, learn, held_out) whose ``learn`` is true, and
    score all; columns as SCORED."""
    spark = docs.sparkSession
    bound_batches(spark)
    parts = parts or shuffle_width(spark)
    values = F.array(*[F.lit(v) for v in block_values(spark, parts)])
    wanted = docs.select(known_id(), F.coalesce("text", F.lit("")).alias("text"),
                         F.coalesce("learn", F.lit(False)).alias("learn"),
                         F.coalesce("held_out", F.lit(False)).alias("held_out"))
    name = f"katz_texts_{uuid.uuid4().hex}"
    (wanted.withColumn("block", F.get(values, F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int")))
     .repartition(parts, "block").write.bucketBy(parts, "block").option("path", run_folder(spark, "katz-texts"))
     .format("parquet").saveAsTable(name))
    texts = spark.table(name)
    words = stored(texts.groupBy("block").applyInPandas(lambda pdf: ask_words(pdf, parts), ASKED)
                   .groupBy("part").applyInPandas(count_words, ASKED), "katz-words")
    uni = unigrams_of(words, parts)
    limit = max(1, uni.tokens // (4 * parts))
    asked = texts.groupBy("block").cogroup(words.groupBy("block")).applyInPandas(
        lambda t, r: ask_pairs(t, r, uni, parts, limit), ASKED)
    pairs = stored(asked.groupBy("part").applyInPandas(lambda pdf: count_pairs(pdf, uni, limit), ASKED), "katz-pairs")
    met, hot = np.zeros(K + 1, np.int64), {}
    # One row of sums per partition, and the parts of split contexts: at most 4 parts contexts.
    for r in pairs.where(F.col("block") < 0).collect():
        if r["block"] == STATS:
            met += unpack(bytes(r["data"]), "i8")[0]
        else:
            context, *sums = unpack(bytes(r["data"]), "u8", *SUMS)
            for c, s in zip(context.tolist(), np.stack(sums, 1), strict=True):
                hot[c] = hot[c] + s if c in hot else s
    d = discounts(met)
    replies = words.withColumn("n", F.lit(1)).unionByName(pairs.withColumn("n", F.lit(2))).where("block >= 0")
    return (texts.groupBy("block").cogroup(replies.groupBy("block"))
            .applyInPandas(lambda t, r: score_block(t, r, uni, parts, limit, d, hot), SCORED)
            .withColumn("doc_id", null_id()))


def perplexity(log10_probability: float, tokens: int) -> float:
    return math.pow(10, -log10_probability / max(1, tokens))

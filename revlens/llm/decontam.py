"""Benchmark decontamination (operator 2), in DataFrame operations only.

1. Words are runs of letters and digits, lower-cased. A window of a document has as many words as a
   benchmark item, and its similarity to the item is the share of the weight of the item's distinct
   ``k``-word shingles that the window holds; a shingle weighs ln(1 + items / items that hold it).
2. The fingerprint of an item is the 128-bit SimHash of its shingles, voting with their weights; that of
   a window is the vote of those of its shingles that items of its length hold. So both fingerprints
   see the weights that the similarity sees, and words of no item change nothing.
3. Windows begin at each shingle that an item of their length holds, or are the document's last. The
   best window of all can be moved right to such a start without losing a shingle.
4. Fingerprints are cut into ``BLOCKS`` blocks of ``BLOCK_BITS`` bits. Two within ``radius`` bits differ by
   three bits at most in some block; an item's blocks are listed with up to two bits flipped and a
   window's with up to one, so an equi join of block and bits finds all (window, item) pairs within the
   radius. Of a window of similarity 0.8 some 19 of 128 bits differ, with a deviation of four.
5. In the (document, item) pairs found, windows begin as in 3 and where the item would begin if a shingle
   of it stood at its own place. All are compared exactly; of those of ``least`` or more the best is the
   match of a document and an item.

A match's ``distance`` is the least of the fingerprints of the document's windows from the item's.

The item side is broadcast while it has at most ``BROADCAST_ROWS`` rows; beyond that the joins are
shuffled. Documents' texts take no part in a shuffle but those in which a shingle was found, and all of
them only if more than ``BROADCAST_KEYS`` documents hold a leak.

Defined results: null, empty or wordless texts match nothing, and items without words are ignored; an
item or document with fewer than ``k`` words has one shingle, all of its words, so a short item is
found only as the same run of words in a window of its length; a null id is carried as null; rows
repeated with id and text are one document; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import bound, stored

BROADCAST_ROWS = 1_000_000
#: Keys of documents with a leak that are broadcast: 8 MB of longs, some 32 MB as a hash table.
BROADCAST_KEYS = 1_000_000
BITS = 64
#: A fingerprint has two longs, cut into eight blocks.
BLOCKS, BLOCK_BITS, FLIPPED = 8, 16, 3
#: Weights vote as whole numbers, so that sums don't depend on their order.
VOTE_SCALE = 1_000_000
#: Sums of the same weights in other orders differ by less.
ROUNDING = 1e-9


@dataclass(frozen=True)
class Settings:
    k: int = 5
    least: float = 0.8
    radius: int = BLOCKS * (FLIPPED + 1) - 1


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), "")


def shingles_of(words: Column, k: int) -> Column:
    """Hashes of the k-word shingles by position; none for fewer words."""
    n = F.size(words)
    return F.when(n >= k, F.transform(
        F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))),
        lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))).otherwise(F.array().cast("array<bigint>"))


def simhash(votes: Column) -> Column:
    """(low, high) of an array of (h, w): of every bit, what most of the weight has there."""
    def half(hashed) -> Column:
        bits = F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda b: F.when(
            F.aggregate(votes, F.lit(0).cast("bigint"), lambda n, v: n + F.when(
                F.call_function("shiftright", hashed(v), b).bitwiseAND(F.lit(1).cast("bigint")) == 1, v["w"]).otherwise(-v["w"])) > 0,
            F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint")))
        return F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))

    return F.struct(half(lambda v: v["h"]).alias("low"), half(lambda v: v["g"]).alias("high"))


def vote(h: Column, w: Column) -> Column:
    """One shingle's vote: its two hashes and its weight."""
    return F.struct(h.alias("h"), F.xxhash64(h).alias("g"), F.round(w * VOTE_SCALE).cast("bigint").alias("w"))


def blocks_of(fingerprint: Column, radius: int) -> Column:
    """(block, bits) of each of radius + 1 blocks."""
    edges = [round(BITS * i / (radius + 1)) for i in range(radius + 2)]
    return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fingerprint, a).bitwiseAND(
        F.lit((1 << (b - a)) - 1).cast("bigint")).alias("bits"))
        for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))])


def flipped_blocks(mark: Column, flips: int) -> Column:
    """(block, bits) of a fingerprint's blocks, as they are and with up to ``flips`` bits flipped."""
    each = BITS // BLOCK_BITS
    cut = F.concat(blocks_of(mark["low"], each - 1), F.transform(blocks_of(mark["high"], each - 1), lambda x: F.struct(
        (x["block"] + each).alias("block"), x["bits"].alias("bits"))))
    masks = {0}
    for _ in range(flips):
        masks |= {x ^ 1 << b for x in masks for b in range(BLOCK_BITS)}
    all_masks = F.array(*[F.lit(x).cast("bigint") for x in sorted(masks)])
    return F.flatten(F.transform(cut, lambda x: F.transform(all_masks, lambda m: F.struct(
        x["block"].alias("block"), x["bits"].bitwiseXOR(m).alias("bits")))))


def benchmark_items(benchmark: DataFrame, s: Settings) -> DataFrame:
    """item, item_id, m (words), width (of its shingles), shingles by position, weights by shingle."""
    items = (benchmark.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0).distinct()
             .select("item_id", "words", F.size("words").alias("m"), F.least(F.lit(s.k), F.size("words")).alias("width")))
    by_width = [F.when(F.col("width") == k, shingles_of(F.col("words"), k)) for k in range(1, s.k + 1)]
    items = stored(items.select("*", F.coalesce(*by_width).alias("shingles"),
                                F.xxhash64("item_id", "words").alias("item")), "benchmark-items")
    total = items.count()
    each = items.select("item", F.explode(F.array_distinct("shingles")).alias("h"))
    weight = each.groupBy("h").agg(F.log(1 + F.lit(float(total)) / F.count("*")).alias("w"))
    weights = each.join(weight, "h").groupBy("item").agg(
        F.sort_array(F.collect_list(F.struct("h", "w"))).alias("weights"))  # shingles of one item
    return stored(items.join(weights, "item"), "benchmark-weights")


def document_key() -> Column:
    return F.xxhash64("doc_id", F.lit("\x00"), "text")


def windows_of(held: DataFrame, votes: DataFrame, k: int) -> DataFrame:
    """(doc, m, mark): the fingerprints of the windows of m words of each document.

    ``held``: doc, n (words), at, h; ``votes``: h, m and the vote of h among items of m words."""
    met = held.join(votes, "h").groupBy("doc", "n", "m").agg(
        F.sort_array(F.collect_set(F.struct("at", "vote"))).alias("hits"))  # shingles of one document
    m, last = F.col("m"), F.greatest(F.lit(0), F.col("n") - F.col("m"))
    starts = met.select("doc", "m", "hits", last.alias("last"), F.posexplode("hits").alias("i", "hit"))
    # A window has m places, so its hits are among the m before and behind the one it begins at.
    near = starts.select("doc", "m", F.least("hit.at", "last").alias("start"), F.slice(
        "hits", F.greatest(F.lit(1), F.col("i") + 1 - m), 2 * m).alias("near"))
    inside = F.array_distinct(F.transform(F.filter("near", lambda x: (x["at"] >= F.col("start")) & (
        x["at"] <= F.col("start") + F.greatest(F.lit(0), m - k))), lambda x: x["vote"]))
    return near.dropDuplicates(["doc", "m", "start"]).select("doc", "m", bound(inside, simhash).alias("mark")).distinct()


def near_pairs(windows: DataFrame, items: DataFrame, s: Settings) -> DataFrame:
    """(doc, item, distance) of all windows and items of one length within ``radius`` bits."""
    marked = items.select("item", "m", F.col("mark").alias("item_mark"), F.inline(flipped_blocks(F.col("mark"), FLIPPED - 1)))
    asked = windows.select("doc", "m", "mark", F.inline(flipped_blocks(F.col("mark"), 1)))
    apart = sum(F.bit_count(F.col(f"mark.{x}").bitwiseXOR(F.col(f"item_mark.{x}"))) for x in ("low", "high"))
    small = items.count() <= BROADCAST_ROWS // (BLOCKS * (1 + BLOCK_BITS + BLOCK_BITS * (BLOCK_BITS - 1) // 2))
    return (asked.join(F.broadcast(marked) if small else marked, ["m", "block", "bits"])
            .select("doc", "item", apart.alias("distance")).where(F.col("distance") <= s.radius)
            .groupBy("doc", "item").agg(F.min("distance").alias("distance")))


def find_leaks(docs: DataFrame, benchmark: DataFrame, s: Settings | None = None) -> DataFrame:
    """Matches: doc, doc_id, item_id, similarity, first_word, n_words, distance. ``doc`` is the
    document's key, see ``document_key``."""
    s = s or Settings()
    items = benchmark_items(benchmark, s)
    voted = lambda x: vote(x["h"], x["w"])
    marked = stored(items.select("item", "m", "width", bound(F.transform("weights", voted), simhash).alias("mark")), "item-marks")
    votes = stored(items.select("m", "width", F.explode("weights").alias("x")).distinct().select(
        "m", "width", "x.h", voted(F.col("x")).alias("vote")), "item-votes")
    widths = [r["width"] for r in items.select("width").distinct().collect()]  # k values at most
    small = items.agg(F.sum(F.size("shingles"))).first()[0] or 0
    hint = F.broadcast if small <= BROADCAST_ROWS else (lambda df: df)
    keyed = docs.select(document_key().alias("doc"), "doc_id", "text")
    found = []
    for k in widths:
        held = keyed.select("doc", words_of(F.col("text")).alias("words")).select(
            "doc", F.size("words").alias("n"), F.posexplode(shingles_of(F.col("words"), k)).alias("at", "h"))
        windows = windows_of(held, hint(votes.where(F.col("width") == k).drop("width")), k)
        found.append(near_pairs(windows, marked.where(F.col("width") == k), s))
    empty = docs.sparkSession.createDataFrame([], "doc bigint, item bigint, distance int")
    pairs = stored(reduce(DataFrame.unionByName, found, empty), "leak-pairs")
    texts = stored(keyed.join(pairs.select("doc").distinct(), "doc").dropDuplicates(["doc"]).select(
        "doc", "doc_id", words_of(F.col("text")).alias("words")), "leak-texts")
    places = items.select("item", "m", "width", F.posexplode("shingles").alias("offset", "h")).distinct()
    total = F.aggregate("weights", F.lit(0.0), lambda a, x: a + x["w"])
    weighed = stored(items.select("item", "item_id", "m", "width", total.alias("total"),
                                  F.map_from_entries("weights").alias("by_shingle")), "benchmark-maps")
    last = F.greatest(F.lit(0), F.col("n") - F.col("m"))
    found = []
    for k in widths:
        shingled = texts.select("doc", "doc_id", "words", F.size("words").alias("n"), shingles_of(F.col("words"), k).alias("shingles"))
        # Only the shingles that an item holds meet the pairs.
        hits = shingled.select("doc", "n", F.posexplode("shingles").alias("at", "h")).join(
            hint(places.where(F.col("width") == k)), "h").join(pairs, ["doc", "item"], "left_semi")
        windows = hits.select("doc", "item", F.explode(F.array(
            F.greatest(F.lit(0), F.least(F.col("at") - F.col("offset"), last)), F.least(F.col("at"), last))).alias("start")).distinct()
        own = F.array_distinct(F.slice("shingles", F.col("start") + 1, F.greatest(F.lit(1), F.col("m") - k + 1)))
        held = F.aggregate(own, F.lit(0.0), lambda a, h: a + F.coalesce(F.element_at("by_shingle", h), F.lit(0.0)))
        found.append(windows.join(hint(weighed.where(F.col("width") == k)), "item").join(shingled, "doc").select(
            "doc", "doc_id", "item", "item_id", "m", "start", (held / F.col("total")).alias("similarity")).where(F.col("similarity") >= s.least - ROUNDING))
    none = docs.sparkSession.createDataFrame([], found[0].schema) if found else docs.sparkSession.createDataFrame(
        [], "doc bigint, doc_id bigint, item bigint, item_id bigint, m int, start int, similarity double")
    both = reduce(DataFrame.unionByName, found, none)
    best = F.max_by(F.struct("similarity", "start", "m"),
                    F.struct("similarity", -F.col("start"))).alias("best")
    best = both.groupBy("doc", "doc_id", "item", "item_id").agg(best)
    return best.join(pairs, ["doc", "item"]).select(
        "doc", "doc_id", "item_id", F.round("best.similarity", 6).alias("similarity"),
        F.col("best.start").alias("first_word"), F.col("best.m").alias("n_words"), "distance")


def without_leaks(docs: DataFrame, benchmark: DataFrame, s: Settings | None = None) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark passage, with their own columns."""
    key = f"leak-{uuid.uuid4().hex}"  # clashes with no column of docs
    leaks = stored(find_leaks(docs, benchmark, s).select(F.col("doc").alias(key)).distinct(), "leak-keys")
    few = leaks.count() <= BROADCAST_KEYS  # one long a row, so this bounds its bytes
    return docs.join(F.broadcast(leaks) if few else leaks, document_key() == F.col(f"`{key}`"), "left_anti")

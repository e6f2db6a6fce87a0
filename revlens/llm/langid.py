"""Language identification of mixed texts (operator 4).

* Scripts: every word is of the script of its letters (fixed code-point ranges). A word's candidates
  are the languages whose learning words are of that script at least now and then.
* Word scores: log-likelihood ratios of hashed character n-grams of the word with its ends marked,
  for each language, from a bounded sample of learning documents per language.
* Viterbi: the labels of all words of a text are the path with the highest sum of word scores less
  ``switch_penalty`` for every change of language. Runs of equal labels are the spans.

The predicted language is that with the most letters over all spans (ties: the first by name); the
score is its share of the letters. All words of a text take part.

Defined results: ``und`` with score 0 for a null text or one without a letter; words without letters
take the label of the path around them; without learning rows every text is ``und``; rows with null
lang are not learned from; repeated rows are predicted one by one; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import bound_batches, known_id, null_id, slices

# First code points of script ranges, and the scripts that begin there. Letters
# between two entries belong to the earlier one.
SCRIPT_RANGES = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Indic"), (0x0E00, "Thai"), (0x0E80, "Other"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"),
    (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"),
    (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Other"), (0x20000, "Han"), (0x30000, "Other"),
)
SCRIPTS = tuple(dict.fromkeys(name for _, name in SCRIPT_RANGES))
UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    docs_per_language: int = 1_500   # expected size of the learning sample of a language
    buckets: int = 1 << 16           # hashed n-grams
    longest: int = 4                 # characters of an n-gram, at most
    switch_penalty: float = 6.0
    script_share: float = 1e-3       # of a language's learning words, for a script to be its own
    cached_words: int = 300_000      # of one Python worker


def letters_of(points: np.ndarray) -> np.ndarray:
    """Which code points are letters; a table of all of them is kept per worker."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTERS[points]


_LETTERS: np.ndarray | None = None


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, each framed by line breaks, and where each word begins."""
    text = "\n" + "\n".join(words) + "\n"
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return points, np.concatenate(([0], (sizes + 1).cumsum()))


def n_grams(points: np.ndarray, begins: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of letters and word ends: bucket and word number of each."""
    word = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    # Punctuation and digits all count as a word's end, so they carry no language.
    keyed = np.where(letters_of(points), points, 10).astype(np.uint64)
    word = np.append(word, len(begins) - 2)
    buckets, words = [], []
    h = keyed + np.uint64(1)
    for n in range(1, s.longest + 1):
        if n > 1:
            if len(keyed) < n:
                break
            h = (h[:-1] * np.uint64(0x100000001B3)) ^ keyed[n - 1:]
        mixed = (h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        at = word[: len(h)]
        # The last character of the window lies in the word or is its end.
        inside = np.arange(len(h)) + n - 1 <= begins[at + 1]
        inside &= (keyed[: len(h)] != 10) | (n > 1)
        buckets.append((mixed >> np.uint64(40))[inside] % np.uint64(s.buckets))
        words.append(at[inside])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(words)


def script_of(points: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per word: the script of its first letter (-1 without one), and its number of letters."""
    starts = np.array([a for a, _ in SCRIPT_RANGES])
    number = np.array([SCRIPTS.index(n) for _, n in SCRIPT_RANGES])
    letter = letters_of(points)
    count = np.add.reduceat(letter, begins[:-1]).astype(np.int64) if len(begins) > 1 else np.zeros(0, np.int64)
    at = np.flatnonzero(letter)
    word = np.searchsorted(begins, at, side="right") - 1
    first, where = np.unique(word, return_index=True)
    script = np.full(len(begins) - 1, -1)
    script[first] = number[np.searchsorted(starts, points[at[where]], side="right") - 1]
    return script, count


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray            # buckets x languages, log-likelihood less the mean over languages
    allowed: np.ndarray          # scripts x languages
    settings: Settings
    _place: dict[str, int] = field(default_factory=dict)
    _scores: np.ndarray | None = None
    _letters: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_place": {}, "_scores": None, "_letters": None}

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of words for every language, and their letters; 0 for words without letters."""
        points, begins = code_points(words)
        bucket, word = n_grams(points, begins, self.settings)
        k = len(self.languages)
        scores = np.stack([np.bincount(word, self.table[bucket, j], len(words)) for j in range(k)], 1)
        script, letters = script_of(points, begins)
        known = self.allowed[script] & (script >= 0)[:, None]
        # Languages that never use the script are no candidates; if none does, all are.
        scores[known.any(1)[:, None] & ~known] = -1e3
        scores[letters == 0] = 0
        return scores.astype(np.float32), letters

    def cached(self, words: list[str]) -> np.ndarray:
        """Row numbers of words in the worker's cache of scores."""
        if len(self._place) > self.settings.cached_words:
            self._place, self._scores, self._letters = {}, None, None
        new = [w for w in dict.fromkeys(words) if w not in self._place]
        if new:
            self._place.update(zip(new, range(len(self._place), len(self._place) + len(new)), strict=True))
            scores, letters = self.word_scores(new)
            if self._scores is not None:
                scores, letters = np.concatenate([self._scores, scores]), np.concatenate([self._letters, letters])
            self._scores, self._letters = scores, letters
        return np.fromiter(map(self._place.__getitem__, words), np.int64, len(words))

    def label(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Per text: the language number of every word, and the words' letters."""
        cut = [t.lower().split() if t else [] for t in texts]
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        rows = self.cached([w for c in cut for w in c])
        ends = sizes.cumsum()
        if not len(rows):
            return [np.zeros(0, np.int64)] * len(cut), [np.zeros(0, np.int64)] * len(cut)
        path = viterbi(self._scores, rows, ends - sizes, sizes, self.settings.switch_penalty)
        letters = self._letters[rows]
        return np.split(path, ends[:-1]), np.split(letters, ends[:-1])


def viterbi(scores: np.ndarray, rows: np.ndarray, begins: np.ndarray, sizes: np.ndarray,
            penalty: float) -> np.ndarray:
    """Best labels of many sequences at once: step t handles the t-th word of every sequence that
    has one. ``rows`` points into ``scores`` (rows x labels)."""
    k = scores.shape[1]
    order = np.argsort(-sizes, kind="stable")
    at, longest = begins[order], int(sizes.max(initial=0))
    alive = np.searchsorted(-sizes[order], -np.arange(longest), side="left")
    switched_from = np.zeros(len(rows), np.uint8)       # the best label before, if switched
    switches = np.zeros((len(rows), k), bool)
    best = np.zeros((len(order), k), np.float64)
    for t in range(longest):
        n = int(alive[t])
        spots = at[:n] + t
        b = best[:n]
        if t:
            top = b.argmax(1)
            reach = b[np.arange(n), top][:, None] - penalty
            change = b < reach
            switches[spots] = change
            switched_from[spots] = top
            np.maximum(b, reach, out=b)
        b += scores[rows[spots]]
    label = best.argmax(1)
    path = np.zeros(len(rows), np.int64)
    for t in range(longest - 1, -1, -1):
        n = int(alive[t])
        spots = at[:n] + t
        own = label[:n]
        path[spots] = own
        if t:
            label[:n] = np.where(switches[spots, own], switched_from[spots], own)
    return path


def fit(docs: DataFrame, learn_from: Column, s: Settings | None = None) -> LanguageModel:
    """Learn from the text and non-null lang of the rows for which ``learn_from`` holds."""
    s = s or Settings()
    bound_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull()).where(learn_from)
    met = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(met)
    if not languages:
        return LanguageModel([], np.zeros((s.buckets, 0)), np.zeros((len(SCRIPTS), 0), bool), s)
    # A share of each language's documents by their hash: about docs_per_language of each.
    unit = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.element_at(F.create_map(*[x for lang in languages for x in (
        F.lit(lang), F.lit(min(1.0, s.docs_per_language / met[lang])))]), F.col("lang"))
    number = {lang: i for i, lang in enumerate(languages)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams = np.zeros((len(languages), s.buckets), np.int64)
        scripts = np.zeros((len(languages), len(SCRIPTS)), np.int64)
        for pdf in slices(batches):
            for text, lang in zip(pdf["text"], pdf["lang"], strict=True):
                words = text.lower().split() if text else []
                if words:
                    points, begins = code_points(words)
                    bucket, _ = n_grams(points, begins, s)
                    grams[number[lang]] += np.bincount(bucket, minlength=s.buckets)
                    script, _ = script_of(points, begins)
                    scripts[number[lang]] += np.bincount(script[script >= 0], minlength=len(SCRIPTS))
        for i in range(len(languages)):
            used = np.flatnonzero(grams[i])
            yield pd.DataFrame({"i": i, "bucket": used, "n": grams[i][used]})
            used = np.flatnonzero(scripts[i])
            yield pd.DataFrame({"i": i, "bucket": s.buckets + used, "n": scripts[i][used]})

    got = (rows.where(unit < share).mapInPandas(count, "i int, bucket int, n long")
           .groupBy("i", "bucket").agg(F.sum("n").alias("n")).toPandas())  # languages x buckets at most
    counts = np.zeros((len(languages), s.buckets + len(SCRIPTS)))
    counts[got["i"].to_numpy(np.int64), got["bucket"].to_numpy(np.int64)] = got["n"].to_numpy()
    grams, scripts = counts[:, : s.buckets], counts[:, s.buckets:]
    log = np.log(grams + 0.5) - np.log(grams.sum(1, keepdims=True) + 0.5 * s.buckets)
    log -= log.mean(0)
    allowed = scripts >= s.script_share * np.maximum(scripts.sum(1, keepdims=True), 1)
    return LanguageModel(languages, log.T.copy(), (allowed & (scripts > 0)).T.copy(), s)


def spans(path: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of equal labels: first word, number of words, label."""
    if not len(path):
        return []
    first = np.flatnonzero(np.concatenate(([True], path[1:] != path[:-1])))
    return list(zip(first.tolist(), np.diff(np.append(first, len(path))).tolist(), path[first].tolist(), strict=True))


def predict_rows(model: LanguageModel, texts: list[str | None]) -> Iterator[tuple[str, float, list]]:
    """Language, score and spans of each text."""
    if not model.languages:
        yield from ((UNKNOWN, 0.0, []) for _ in texts)
        return
    for path, letters in zip(*model.label(texts), strict=True):
        total = int(letters.sum())
        if not total:
            yield UNKNOWN, 0.0, []
            continue
        share = np.bincount(path, letters, len(model.languages))
        top = int(share.argmax())
        yield model.languages[top], float(share[top] / total), spans(path)


PREDICTED = ("doc_id long, lang_pred string, score double, "
             "spans array<struct<first_word:int,n_words:int,lang:string>>")


def predict_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score and the spans of every document."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # buckets x languages numbers

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches):
            model = shared.value
            got = list(predict_rows(model, [t if isinstance(t, str) else None for t in pdf["text"]]))
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"].to_numpy(), "lang_pred": [g[0] for g in got], "score": [g[1] for g in got],
                "spans": [[{"first_word": a, "n_words": n, "lang": model.languages[k]} for a, n, k in g[2]]
                          for g in got]})

    return docs.select(known_id(), "text").mapInPandas(predict, PREDICTED).withColumn("doc_id", null_id())


def keep_known(docs: DataFrame, model: LanguageModel, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with one language that holds ``least`` of their letters or more."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def known(texts: pd.Series) -> pd.Series:
        return pd.Series([lang != UNKNOWN and score >= least for part in slices([texts.to_frame("text")])
                          for lang, score, _ in predict_rows(shared.value, [
                              t if isinstance(t, str) else None for t in part["text"]])], dtype=bool)

    return docs.where(known("text"))

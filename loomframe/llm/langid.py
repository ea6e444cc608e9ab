"""Language identification: words first, then ever shorter character n-grams."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm.common import is_held_out, is_learnable, materialize, release, table

UNDETERMINED = "und"
WORD = re.compile(r"[^\W\d_]+")
MAX_GRAM = 5
EVIDENCE_WORDS = 20
CACHE_BYTES = 24 << 20
CACHED_WORD = 170  # bytes of a word in the table besides its numbers
TEXTS_AT_ONCE = 500


def words_of(text: str) -> Counter:
    return Counter(WORD.findall(text.lower()))


def grams_of(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for lang, texts in pdf.groupby("lang")["text"]:
            words: Counter = Counter()
            for t in texts:
                words.update(words_of(t))
            for n in range(MAX_GRAM + 1):  # 0: whole words
                grams: Counter = Counter()
                for w, c in words.items():
                    for g in [w] if n == 0 else grams_of(w, n):
                        grams[g] += c
                if grams:
                    yield pd.DataFrame({"lang": lang, "n": n, "gram": list(grams), "c": list(grams.values())})


def key_of(gram: str) -> int:
    """The xxhash64 that stands for a gram, as Spark has it, but unsigned."""
    return xxhash.xxh64_intdigest(gram.encode(), 42)


class LanguageModel:
    """Log frequencies of words and n-grams, in sparse rows: a gram's hash, and the languages that have it.

    What a language lacks costs the same in all languages, a tenth of one occurrence in the language with most to learn
    from: a floor of its own would favour a language for having been learned from little. Arrays of some 24 bytes an entry
    hold all of it; the words met last are kept with their scores in a table of bounded size.
    """

    def __init__(self, langs: list[str], counts: pd.DataFrame, totals: dict[tuple[str, int], int]):
        """counts: (lang, n, key, c), key being ``key_of`` the gram as a signed number; n is 0 for whole words."""
        self.langs = langs
        self.keys: list[np.ndarray] = []  # sorted hashes, by order n
        self.first: list[np.ndarray] = []  # where each key's entries begin
        self.at: list[np.ndarray] = []  # an entry's language
        self.gain: list[np.ndarray] = []  # an entry's log frequency above the floor
        self.floor: list[float] = []
        number = {lang: i for i, lang in enumerate(langs)}
        for n in range(MAX_GRAM + 1):
            own = counts[counts["n"] == n]
            key = own["key"].to_numpy(np.int64).view(np.uint64)
            at = np.fromiter(map(number.get, own["lang"]), np.int32, len(own))
            total = np.array([max(1, totals.get((lang, n), 0)) for lang in langs], np.float64)
            floor = float(np.log10(0.1 / total.max(initial=1)))
            order = np.lexsort((at, key))
            keys, first = np.unique(key[order], return_index=True)
            self.keys.append(keys)
            self.first.append(np.append(first, len(key)))
            self.at.append(at[order])
            self.gain.append((np.log10(own["c"].to_numpy(np.float64)[order] / total[at[order]]) - floor).astype(np.float32))
            self.floor.append(floor)
        self._start()

    def _start(self) -> None:
        most = max(1000, CACHE_BYTES // (CACHED_WORD + 4 * len(self.langs)))
        self.rows: dict[str, int] = {}
        self.scores = np.zeros((most, len(self.langs)), np.float32)
        self.known = np.zeros(most, bool)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("rows", "scores", "known")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._start()

    def means(self, n: int, grams: list[str], owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """For each of ``size`` owners, the mean score of those of its grams that any language has, and whether there is one
        that is more than a word's edge. owner: the owner of each gram."""
        wanted = np.fromiter(map(key_of, grams), np.uint64, len(grams))
        keys = self.keys[n]
        row = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
        hit = keys[row] == wanted if len(keys) else np.zeros(len(grams), bool)
        row, mine = row[hit], owner[hit]
        edge = np.fromiter((g == " " for g in grams), bool, len(grams))[hit]
        sums = np.zeros((size, len(self.langs)))
        spread = self.first[n][row + 1] - self.first[n][row]
        entry = np.repeat(self.first[n][row] - np.concatenate([[0], np.cumsum(spread)[:-1]]), spread) + np.arange(spread.sum()) if len(row) else np.zeros(0, int)
        np.add.at(sums, (np.repeat(mine, spread), self.at[n][entry]), self.gain[n][entry])
        count = np.bincount(mine, minlength=size)
        return sums / np.maximum(1, count)[:, None] + self.floor[n], np.bincount(mine, ~edge, minlength=size) > 0

    def _meet(self, words: list[str]) -> None:
        """Score words that are not in the table: whole, else by the longest n-grams that any language has."""
        first = len(self.rows)
        self.rows.update(zip(words, range(first, first + len(words))))
        left = np.arange(len(words))
        for n in (0, *range(MAX_GRAM, 0, -1)):
            grams = [[words[i]] if n == 0 else grams_of(words[i], n) for i in left]
            owner = np.repeat(np.arange(len(left)), [len(g) for g in grams])
            mean, known = self.means(n, [g for own in grams for g in own], owner, len(left))
            self.scores[first + left[known]] = mean[known]
            self.known[first + left[known]] = True
            left = left[~known]
            if not len(left):
                break
        self.known[first + left] = False

    def judge_all(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        return [j for i in range(0, len(texts), TEXTS_AT_ONCE) for j in self._judge_some(texts[i : i + TEXTS_AT_ONCE])]

    def _judge_some(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        counted = [words_of(t) if t else {} for t in texts]
        fresh = list(dict.fromkeys(w for words in counted for w in words if w not in self.rows))
        if len(self.rows) + len(fresh) > len(self.scores):
            self.rows = {}
            if len(set().union(*counted)) > len(self.scores):
                if len(texts) > 1:
                    return [j for half in (texts[: len(texts) // 2], texts[len(texts) // 2 :]) for j in self._judge_some(half)]
                self.scores, self.known = np.zeros((len(counted[0]), len(self.langs)), np.float32), np.zeros(len(counted[0]), bool)
            fresh = list(dict.fromkeys(w for words in counted for w in words))
        for i in range(0, len(fresh), 5000):
            self._meet(fresh[i : i + 5000])
        return [self._judged(words) for words in counted]

    def _judged(self, words: Counter) -> tuple[str, float, bool]:
        if not self.langs or not any(ch.isalpha() for w in words for ch in w):
            return UNDETERMINED, 0.0, False
        row = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
        weight = np.fromiter(words.values(), np.float64, len(words))
        told = self.known[row]
        if not told.any():  # letters of no language learned: all are as likely
            return self.langs[0], 1.0 / len(self.langs), False
        weight = weight[told]
        mean = weight @ self.scores[row[told]] / weight.sum()
        odds = np.exp((mean - mean.max()) * math.log(10) * min(EVIDENCE_WORDS, weight.sum()))
        best = int(np.argmax(mean))
        return self.langs[best], float(odds[best] / odds.sum()), True

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.judge(text)[:2]

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, known): known is whether any word or n-gram of the text was learned in any language."""
        return self.judge_all([text])[0]


def fit_language_model(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    rows_per_lang: int = 2000,
    max_rows: int = 100_000,
    max_entries: int = 1_500_000,
) -> LanguageModel:
    """Fit on about ``rows_per_lang`` learnable labelled rows of each language, chosen by a hash of their ids.

    Bounds: a sample of at most about ``max_rows`` rows over all languages; every word and n-gram of it is kept. Should that
    make more than ``max_entries`` (word or n-gram, language) pairs, the sample is halved until it does not, so that what
    is broadcast, some 24 bytes an entry, has a bound. Rows without text, label or id are not learned from.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(
        is_learnable(F.col("id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    sizes = materialize(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    wanted = min(rows_per_lang, max_rows / max(1, sizes.count()))
    chance = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    counts = None
    while True:
        release(counts)
        sample = rows.join(sizes, "lang").where(chance < wanted / F.col("n")).select("lang", "text")
        counted = sample.mapInPandas(_counted, "lang string, n int, gram string, c long").groupBy("lang", "n", "gram")
        counts = materialize(counted.agg(F.sum("c").alias("c")), "language-counts")
        if counts.count() <= max_entries:
            break
        wanted /= 2
    kept = counts.select("lang", "n", F.xxhash64("gram").alias("key"), "c").toArrow().to_pandas()  # no texts reach the driver
    release(counts, sizes)
    return LanguageModel(sorted(kept["lang"].unique()), kept, kept.groupby(["lang", "n"])["c"].sum().to_dict())


def predict_language(spark: SparkSession, model: LanguageModel, text: Column) -> Column:
    """struct(lang, score, known) of a text: ``und``, 0 and false for null, empty or letterless texts; ties go to the first language in order."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, known boolean")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame(shared.value.judge_all(texts.tolist()), columns=["lang", "score", "known"])

    return udf(text.cast("string"))


def identify_languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **bounds: int
) -> DataFrame:
    """``docs`` plus ``lang_pred`` and ``lang_score``.

    Words are runs of letters of the whole lower-cased text. A word that the model knows scores its log frequency in each
    language; another the mean of its longest n-grams that any language knows. The language of the highest mean wins, ties
    going to the first in order; the score is the normalised likelihood of up to EVIDENCE_WORDS words. Null texts and texts
    without letters: ``und`` and 0, as everything is when nothing can be learned. Columns of these names are replaced.
    """
    model = fit_language_model(docs, id_col, text_col, lang_col, **bounds)
    rest = docs.drop("lang_pred", "lang_score")
    found = rest.withColumn("__loomframe_pick", predict_language(docs.sparkSession, model, F.col(text_col)))
    return found.select(*rest.columns, F.col("__loomframe_pick.lang").alias("lang_pred"), F.col("__loomframe_pick.score").alias("lang_score"))


def drop_unidentified(
    docs: DataFrame, min_score: float = 0.0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **bounds: int
) -> DataFrame:
    """``docs`` whose language is identified, with at least ``min_score`` if that is asked for.

    Not identified are undetermined texts and those without one word or n-gram of any language learned, for which all
    languages are as likely. Short texts and texts of like languages stay, however low their score.
    """
    model = fit_language_model(docs, id_col, text_col, lang_col, **bounds)
    pick = predict_language(docs.sparkSession, model, F.col(text_col))
    found = docs.withColumn("__loomframe_pick", pick)
    return found.where(F.col("__loomframe_pick.known") & (F.col("__loomframe_pick.score") >= min_score)).select(*docs.columns)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from three of four folds."""
    found = identify_languages(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))

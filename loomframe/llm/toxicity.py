"""Toxicity: Kneser-Ney bigram models of toxic and ordinary texts over one shared back-off, compared word by word."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm.common import materialize, release, table

THRESHOLD = 0.7
FOLDS, HELD_OUT = 3, 1
WORD = re.compile(r"[^\W_]+")
DISCOUNTS = [float(1 << i) for i in range(9)]
SPAN = 3
FLUSH = 2_000_000  # bigrams that a task gathers before it passes on the distinct ones


def is_held_out(id_col: Column) -> Column:
    """True where crc32 of the id as text leaves HELD_OUT; a null id is never held out (and never learned from)."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


@dataclass
class ClassCounts:
    """Continuation counts of one class: in how many contexts each bigram (key: u * V + w) and each word is found, and the
    bigram contexts that begin with each word."""

    keys: np.ndarray
    counts: np.ndarray
    begun: np.ndarray
    different: np.ndarray

    def smoothed(self, discount: float, shared: np.ndarray) -> ClassModel:
        """Discounted bigrams, then discounted words, then the shared distribution."""
        gain = np.maximum(self.counts - discount, 0.0)
        given = np.zeros(len(shared))
        np.add.at(given, self.keys // len(shared), gain)
        word = np.maximum(self.different - discount, 0.0) / self.different.sum()
        total = np.maximum(self.begun, 1.0)
        return ClassModel(self.keys, gain / total[self.keys // len(shared)], 1.0 - given / total, word + (1.0 - word.sum()) * shared)


@dataclass
class ClassModel:
    """P(w | u) of one class. keys: sorted bigrams; gain: their discounted probability; left: by u, the mass that backs off;
    word: by w, the probability that is backed off to."""

    keys: np.ndarray
    gain: np.ndarray
    left: np.ndarray
    word: np.ndarray

    def log_likelihood(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        p = self.left[u] * self.word[w]
        if len(self.keys):
            key = u * len(self.word) + w
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            p = p + np.where(self.keys[at] == key, self.gain[at], 0.0)
        return np.log(p)


@dataclass
class ToxicityModel:
    """A vocabulary (number 0: every other word, and the start), a model for each class (ordinary, toxic) and the calibration."""

    number: dict[str, int] = field(default_factory=dict)
    classes: list[ClassModel] = field(default_factory=list)
    bias: float = 0.0
    slopes: tuple[float, float] = (0.0, 0.0)
    span: int = SPAN

    def coded(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        get = self.number.get
        return np.fromiter((get(w, 0) for w in words), np.int64, len(words))

    def compared(self, text: str | None) -> tuple[float, float]:
        """Log-likelihood of the toxic model above the ordinary one, a word: of the whole text, and of its most toxic run of
        ``span`` words. 0 and 0 without words."""
        w = self.coded(text)
        if not len(w) or not self.classes:
            return 0.0, 0.0
        u = np.concatenate([[0], w[:-1]])
        ratio = self.classes[1].log_likelihood(u, w) - self.classes[0].log_likelihood(u, w)
        sums = np.concatenate([[0.0], np.cumsum(ratio)])
        n = min(self.span, len(w))
        return float(sums[-1] / len(w)), float((sums[n:] - sums[:-n]).max() / n)


def calibrated(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic weights (bias first) of a few columns, and their mean log-loss: by Newton's method with a slight ridge.

    No weight but the bias is below zero: what the toxic model finds likelier never counts against a text.
    """
    used = list(range(x.shape[1]))
    while True:
        own = np.column_stack([np.ones(len(x)), x[:, used]])
        ridge = np.diag([0.0] + [1e-3] * len(used))
        weights = np.zeros(own.shape[1])
        for step in range(31):
            p = 1 / (1 + np.exp(-(own @ weights).clip(-30, 30)))
            if step < 30:
                weights = weights + np.linalg.solve((own.T * (p * (1 - p) + 1e-6)) @ own + ridge, own.T @ (y - p) - ridge @ weights)
        if not used or weights[1:].min() >= 0:
            break
        del used[int(weights[1:].argmin())]
    told = np.zeros(x.shape[1] + 1)
    told[[0, *(i + 1 for i in used)]] = weights
    return told, float(-np.mean(np.log(np.where(y == 1, p, 1 - p).clip(1e-12))))


def _word_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for y, texts in pdf.groupby("y")["text"]:
            seen: Counter = Counter()
            for t in texts:
                seen.update(set(words_of(t)))
            if seen:
                yield pd.DataFrame({"y": y, "word": list(seen), "docs": list(seen.values())})


def bigram_keys(w: np.ndarray, size: int) -> np.ndarray:
    return np.concatenate([[0], w[:-1]]) * size + w if len(w) else w


def trigram_keys(w: np.ndarray, size: int) -> np.ndarray:
    return np.concatenate([[0, 0], w[:-2]])[: len(w)] * size * size + bigram_keys(w, size) if len(w) else w


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    rows_per_class: int = 6000,
    longest_learned: int = 1 << 20,
    max_vocabulary: int = 40_000,
    min_docs: int = 3,
    span: int = SPAN,
) -> ToxicityModel:
    """Fit on about ``rows_per_class`` learnable labelled texts of each class, chosen by a hash of their ids.

    Bounds of what is learned from labels: that many texts of at most ``longest_learned`` bytes, and the ``max_vocabulary``
    words found in the largest shares of the texts of a class, ``min_docs`` texts at least. An id with several labels takes
    their majority (ties: toxic); equal texts of a class count once. Three quarters give the counts of the classes, one the
    calibration, and with it the discount, of DISCOUNTS, that tells classes apart best. The shared counts, in how many
    different contexts each word stands, are taken from every whole text of ``docs``, labelled or not.
    Without labels, or with those of one class only, there is nothing to compare: the score is 0.5, 0.01 or 0.99.
    """
    spark = docs.sparkSession
    marks = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y"))
        .where(F.col("id").isNotNull() & F.col("y").isNotNull() & ~is_held_out(F.col("id")))
        .groupBy("id")
        .agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    )
    sizes = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    wanted = F.lit(0.0)
    for y, n in sizes.items():
        wanted = F.when(F.col("y") == y, F.lit(rows_per_class / n)).otherwise(wanted)
    chance = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(F.octet_length("text") <= longest_learned)
    checks = (F.pmod(F.xxhash64("text"), F.lit(4)) == 0).alias("checks")
    chosen = F.broadcast(marks.where(chance < wanted))
    sample = materialize(texts.join(chosen, "id").select("y", "text", checks).distinct(), "toxicity-sample")
    found = {(r["y"], r["checks"]): r["count"] for r in sample.groupBy("y", "checks").count().collect()}
    learned = {y: found.get((y, False), 0) for y in (0, 1)}
    if not all(learned.values()):
        release(sample)
        return ToxicityModel(bias=0.0 if not any(learned.values()) else 4.6 if learned[1] else -4.6)

    counting = sample.where(~F.col("checks"))
    seen = counting.mapInPandas(_word_rows, "y int, word string, docs long").groupBy("word")
    by_class = [F.sum(F.when(F.col("y") == y, F.col("docs")).otherwise(0)) for y in (0, 1)]
    share = F.greatest(*[n / learned[y] for y, n in enumerate(by_class)])
    often = seen.agg((by_class[0] + by_class[1]).alias("docs"), share.alias("share")).where(F.col("docs") >= min_docs)
    vocabulary = [r["word"] for r in often.orderBy(F.desc("share"), "word").limit(max_vocabulary).collect()]
    size = len(vocabulary) + 1
    model = ToxicityModel({w: i for i, w in enumerate(vocabulary, 1)}, span=span)
    coder = spark.sparkContext.broadcast(model)

    def class_trigrams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for y, group in pdf.groupby("y")["text"]:
                yield pd.DataFrame({"y": y, "key": np.unique(np.concatenate([trigram_keys(coder.value.coded(t), size) for t in group]))})

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        for pdf in batches:
            held += [bigram_keys(coder.value.coded(t), size) for t in pdf["text"]]
            if sum(map(len, held)) > FLUSH:
                held = [np.unique(np.concatenate(held))]
                if len(held[0]) > FLUSH // 2:
                    yield pd.DataFrame({"key": held.pop()})
        if held:
            yield pd.DataFrame({"key": np.unique(np.concatenate(held))})

    bigram = F.pmod("key", F.lit(size * size)).alias("key")
    pairs = counting.mapInPandas(class_trigrams, "y int, key long").distinct().groupBy("y", bigram)
    pairs = materialize(pairs.agg(F.count(F.lit(1)).alias("c")), "toxicity-bigrams")
    everywhere = docs.select(F.col(text_col).cast("string").alias("text")).where(F.col("text") != "").mapInPandas(contexts, "key long").distinct()
    shared = _by_number(everywhere, F.pmod("key", F.lit(size)), F.count(F.lit(1)), size) + 1.0
    shared /= shared.sum()
    counts = [_class_counts(pairs.where(F.col("y") == y), size) for y in (0, 1)]

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tried = {d: ToxicityModel(coder.value.number, [c.smoothed(d, shared) for c in counts], span=span) for d in DISCOUNTS}
        for pdf in batches:
            for d, own in tried.items():
                got = [own.compared(t) for t in pdf["text"]]
                yield pd.DataFrame({"y": pdf["y"], "discount": d, "whole": [g[0] for g in got], "run": [g[1] for g in got]})

    checked = sample.where("checks").mapInPandas(judged, "y int, discount double, whole double, run double").toPandas()
    release(pairs, sample)
    fits = {d: calibrated(own[["whole", "run"]].to_numpy(), own["y"].to_numpy()) for d, own in checked.groupby("discount") if own["y"].nunique() == 2}
    if fits:
        discount = min(fits, key=lambda d: fits[d][1])
        model.bias, *model.slopes = map(float, fits[discount][0])
    else:  # too few texts to calibrate by: even odds where both models find a run as likely
        discount, model.slopes = DISCOUNTS[0], (0.0, float(span))
    model.classes = [c.smoothed(discount, shared) for c in counts]
    return model


def _by_number(rows: DataFrame, number: Column, value: Column, size: int) -> np.ndarray:
    """An aggregate for each of ``size`` numbers, as an array: as long as the vocabulary."""
    found = rows.groupBy(number.cast("long").alias("i")).agg(value.cast("double").alias("n")).toArrow()
    out = np.zeros(size)
    out[found["i"].to_numpy()] = found["n"].to_numpy()
    return out


def _class_counts(pairs: DataFrame, size: int) -> ClassCounts:
    """pairs: (key, c) of one class. Bigrams of one context would lose all of it to the least discount: they are not brought here."""
    begun = _by_number(pairs, F.floor(F.col("key") / size), F.sum("c"), size)
    different = _by_number(pairs, F.pmod("key", F.lit(size)), F.count(F.lit(1)), size)
    kept = pairs.where(F.col("c") > 1).select("key", "c").orderBy("key").toArrow()
    return ClassCounts(kept["key"].to_numpy(), kept["c"].to_numpy().astype(float), begun, different)


def compare_texts(spark: SparkSession, model: ToxicityModel, docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` plus ``__loomframe_compared``, a struct of ``whole`` and ``run``: see ``ToxicityModel.compared``."""
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("whole double, run double")
    def compared(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([held.value.compared(t) for t in texts], columns=["whole", "run"], dtype="float64")

    return docs.withColumn("__loomframe_compared", compared(F.col(text_col).cast("string")))


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` plus ``toxicity`` (0 to 1) and ``toxic_predicted`` (int).

    The two length-normalised log-likelihood ratios, of the whole text and of its most toxic run of words, are weighed by
    the calibration. Null texts and texts without words have ratios of 0. Rows and other columns stay as they are; columns of the added names are
    replaced.
    """
    rest = docs.drop("toxicity", "toxic_predicted")
    compared = compare_texts(docs.sparkSession, model, rest, text_col)
    odds = F.lit(model.bias) + F.col("__loomframe_compared.whole") * model.slopes[0] + F.col("__loomframe_compared.run") * model.slopes[1]
    scored = compared.withColumn("toxicity", 1.0 / (1.0 + F.exp(-odds)))
    return scored.select(*rest.columns, "toxicity", (F.col("toxicity") >= threshold).cast("int").alias("toxic_predicted"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from two of three folds of ``labels``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), F.col("toxic_predicted").alias("predicted"))

"""Benchmark decontamination over a distributed positional inverted index."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomframe.llm.common import materialize, release, table, text_keys, text_or_empty

WINDOW_WORDS = 13
SLOP = 2
MAX_BROADCAST_BYTES = 32 << 20
TERM_OVERHEAD = 160  # bytes of a dict entry besides the term
_KEEP = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) runs of digits, letters and all characters beyond ASCII."""
    return text.translate(_KEEP).split()


def count_words(text: Column) -> Column:
    """Words of a text, 0 for null; splitting bytes is several times as fast here as counting matches of a regex."""

    @F.pandas_udf("long")
    def udf(texts: pd.Series) -> pd.Series:
        return pd.Series([len(words_of(t)) for t in texts], dtype="int64")

    return udf(text_or_empty(text).cast("binary"))


def item_windows(items: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """``(item, phrase)``: the n-word windows of each item, or the item itself if it has fewer words."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for item, text in zip(pdf["item"], pdf["text"]):
                words = [w.decode() for w in words_of(text)]
                if words:
                    found = {" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}
                    yield pd.DataFrame({"item": item, "phrase": list(found)}, dtype="object")

    source = items.select(F.col(id_col).cast("string").alias("item"), text_or_empty(F.col(text_col)).cast("binary").alias("text"))
    return source.mapInPandas(cut, "item string, phrase string").distinct()


def _term_blocks(terms: DataFrame, columns: list[str]) -> Iterator[Broadcast]:
    """The rows as broadcast dicts of first column to the others, one after another, each of bounded size.

    Most sets are one block. A larger one costs a pass over the documents for each block, and gives the same rows.
    """
    spark, term = terms.sparkSession, F.col(columns[0])
    size = terms.agg(F.coalesce(F.sum(F.octet_length(term) + TERM_OVERHEAD), F.lit(0))).first()[0]
    n_blocks = max(1, math.ceil(size / MAX_BROADCAST_BYTES))
    for block in range(n_blocks):
        rows = terms.where(F.pmod(F.xxhash64(term), F.lit(n_blocks)) == block).select(*columns).collect()
        yield spark.sparkContext.broadcast({r[0].encode(): tuple(r[1:]) for r in rows})


def term_counts(docs: DataFrame, terms: DataFrame, text_col: str) -> DataFrame:
    """``(term, c)``: how often each of ``terms(term)`` stands in the documents; terms that never do are left out."""
    texts = docs.select(F.col(text_col).cast("string").cast("binary").alias("text")).where("text is not null")

    def count(wanted: Broadcast):
        def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                found: Counter = Counter()
                for text in pdf["text"]:
                    found.update(filter(wanted.value.__contains__, words_of(text)))
                if found:
                    yield pd.DataFrame({"term": [t.decode() for t in found], "c": list(found.values())})

        return texts.mapInPandas(of, "term string, c long")

    parts = [count(block) for block in _term_blocks(terms, ["term"])]
    return reduce(DataFrame.union, parts).groupBy("term").agg(F.sum("c").alias("c"))


def postings(docs: DataFrame, needed: DataFrame, text_col: str) -> DataFrame:
    """The positional index: ``(h1, h2, term, pos, before, near)``, one row for each place of a needed term in each text.

    needed: ``(term, back, ahead)``, how many words around an occurrence its posting carries (``near``, of which
    ``before`` precede it). A document goes by two hashes of its text, so copies have one set of postings.
    """
    text = F.col(text_col).cast("string")
    source = docs.select(*text_keys(text_col), text.cast("binary").alias("text")).where("text is not null")
    columns = ["h1", "h2", "term", "pos", "before", "near"]

    def emit(wanted: Broadcast):
        def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out: list[tuple] = []
                once = pdf.drop_duplicates(["h1", "h2"])
                for h1, h2, text in zip(once["h1"], once["h2"], once["text"]):
                    words = words_of(text)
                    for pos, w in enumerate(words):
                        if (hit := wanted.value.get(w)) is not None:
                            low = max(0, pos - hit[0])
                            near = b" ".join(words[low : pos + hit[1] + 1]).decode()
                            out.append((h1, h2, w.decode(), pos, pos - low, near))
                    if len(out) >= 20_000:
                        yield pd.DataFrame(out, columns=columns)
                        out = []
                if out:
                    yield pd.DataFrame(out, columns=columns)

        return source.mapInPandas(of, "h1 long, h2 long, term string, pos int, before int, near string")

    parts = [emit(block) for block in _term_blocks(needed, ["term", "back", "ahead"])]
    return reduce(DataFrame.union, parts).dropDuplicates(["h1", "h2", "term", "pos"])


def _span(words: list[str], at: int, phrase: list[str], off: int, most: int) -> tuple[int, int] | None:
    """The shortest (start, stop) in ``words`` that holds the phrase's words in order, word ``off`` being the one at ``at``; None beyond ``most`` words."""
    start = stop = at
    for w in reversed(phrase[:off]):
        start -= 1
        while start >= 0 and words[start] != w:
            start -= 1
        if start < 0:
            return None
    for w in phrase[off + 1 :]:
        stop += 1
        while stop < len(words) and words[stop] != w:
            stop += 1
        if stop == len(words):
            return None
    return (start, stop + 1) if stop + 1 - start <= most else None


def _verified(candidates: DataFrame, slop: int) -> DataFrame:
    """Of candidates (h1, h2, phrase, off, pos, before, near), the spans that hold all words of their phrases in order."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                phrase = r.phrase.split(" ")
                found = _span(r.near.split(" "), r.before, phrase, r.off, len(phrase) + slop)
                if found is not None and found[1] - found[0] > len(phrase):
                    out.append((r.h1, r.h2, r.phrase, r.pos - r.before + found[0], found[1] - found[0]))
            if out:
                yield pd.DataFrame(out, columns=["h1", "h2", "phrase", "start", "n"])

    return candidates.mapInPandas(check, "h1 long, h2 long, phrase string, start int, n int")


def phrase_matches(docs: DataFrame, phrases: DataFrame, text_col: str = "text", slop: int = 0) -> DataFrame:
    """Where ``phrases(phrase)`` stand in the documents: ``(h1, h2, phrase, start, n, kind)``, n words from word ``start``.

    Every phrase is looked up by its two rarest terms in the corpus. Their posting lists, moved by the terms' offsets, are
    intersected: what is left has both terms within ``slop`` words of where the phrase has them. It is compared with the words
    that the rarest term's postings carry: ``exact`` is the phrase itself, ``near`` a shortest run of words with all of the
    phrase's words in their order and 1 to ``slop`` others between them. Phrases with a term that the corpus lacks are
    dropped at once.
    """
    words = phrases.select("phrase", F.posexplode(F.split("phrase", " ")).alias("off", "term"))
    counts = materialize(term_counts(docs, words.select("term").distinct(), text_col), "term-counts")
    own = Window.partitionBy("phrase")
    ranked = (
        words.join(counts, "term", "left")
        .select("phrase", "off", "term", "c", F.min(F.coalesce("c", F.lit(0))).over(own).alias("least"), F.count(F.lit(1)).over(own).alias("n"))
        .where("least > 0")
        .withColumn("rank", F.row_number().over(own.orderBy("c", "term", "off")))
    )
    two = ranked.where("rank <= 2").groupBy("phrase", F.col("n").cast("int").alias("n"))
    pick = lambda c, rank: F.max(F.when(F.col("rank") == rank, F.col(c)))
    anchors = two.agg(pick("term", 1).alias("term"), pick("off", 1).alias("off"), pick("term", 2).alias("term2"), pick("off", 2).alias("off2"))
    anchors = materialize(anchors, "anchors")
    own_reach = anchors.select("term", (F.col("off") + slop).alias("back"), (F.col("n") - 1 - F.col("off") + slop).alias("ahead"))
    others = anchors.where("term2 is not null").select(F.col("term2").alias("term"), F.lit(0).alias("back"), F.lit(0).alias("ahead"))
    needed = own_reach.union(others).groupBy("term").agg(F.max("back").cast("int").alias("back"), F.max("ahead").cast("int").alias("ahead"))
    index = materialize(postings(docs, needed, text_col), "postings")
    moved = index.join(anchors.drop("off2"), "term").withColumn("start", F.col("pos") - F.col("off"))
    padded = F.concat(F.lit(" "), "near", F.lit(" "))
    likely = F.col("term2").isNull() | F.contains(padded, F.concat(F.lit(" "), "term2", F.lit(" ")))
    # Written, so that Spark knows how few they are before it moves the other lists.
    rarest = materialize(moved.where(likely).select("h1", "h2", "phrase", "start", "n", "off", "pos", "before", "near"), "rarest")
    other = index.select("h1", "h2", F.col("term").alias("term2"), "pos").join(anchors.select("phrase", "term2", "off2"), "term2")
    other = other.select("h1", "h2", "phrase", (F.col("pos") - F.col("off2")).alias("other"))
    step = slop + 1
    around = [F.floor(F.col("start") / step) + d for d in ((-1, 0, 1) if slop else (0,))]
    left = rarest.where("n > 1").withColumn("cell", F.explode(F.array(*around)))
    right = other.withColumn("cell", F.floor(F.col("other") / step))
    key = ["h1", "h2", "phrase", "cell"]
    close = (F.abs(left["start"] - right["other"]) <= slop) & reduce(Column.__and__, [left[c] == right[c] for c in key])
    met = left.join(right, close, "left_semi").drop("cell").distinct()
    words_here = F.array_join(F.slice(F.split("near", " "), F.col("before") - F.col("off") + 1, "n"), " ")
    same = F.when((F.col("before") >= F.col("off")) & (F.col("start") >= 0), words_here == F.col("phrase"))
    told = met.union(rarest.where("n = 1")).withColumn("same", F.coalesce(same, F.lit(False)))
    told = materialize(told, "intersection")
    exact = told.where("same").select("h1", "h2", "phrase", "start", "n", F.lit("exact").alias("kind"))
    release(counts, anchors, index, rarest)
    if not slop:
        return exact
    near = _verified(told.where("not same and n > 1").select("h1", "h2", "phrase", "off", "pos", "before", "near"), slop).distinct()
    return exact.union(near.withColumn("kind", F.lit("near")))


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW_WORDS,
    share: int = 20,
    slop: int = 0,
) -> DataFrame:
    """One row per document: id, h1, h2, n_words, n_hit, n_items, items (sorted strings), contaminated and n_near.

    A word is hit inside any occurrence of a window of an item; a document is contaminated if at least one in ``share``
    of its words is hit. n_near counts the windows that occur nearly, with up to ``slop`` other words between their own, and
    not exactly; they hit nothing. Null texts have no words; items without words have no windows; items with a null id are counted
    as none. Repeated rows give repeated rows; empty tables give no hits.
    """
    windows = materialize(item_windows(items, item_id_col, item_text_col, window), "windows")
    every_match = materialize(phrase_matches(docs, windows.select("phrase").distinct(), text_col, slop), "matches")
    matches = every_match.where("kind = 'exact'")
    by_phrase = every_match.groupBy("h1", "h2", "phrase").agg(F.min("kind").alias("kind"))
    nearly = by_phrase.groupBy("h1", "h2").agg(F.count_if(F.col("kind") == "near").alias("n_near"))
    earlier = Window.partitionBy("h1", "h2").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1)
    spans = matches.select("h1", "h2", "start", (F.col("start") + F.col("n")).alias("end"), "n").distinct()
    reach = F.coalesce(F.max("end").over(earlier), F.lit(0))
    fresh = spans.select("h1", "h2", F.greatest(F.lit(0), F.col("end") - F.greatest("start", reach)).alias("fresh"))
    hits = fresh.groupBy("h1", "h2").agg(F.sum("fresh").alias("n_hit"))
    in_items = (
        matches.select("h1", "h2", "phrase").distinct().join(windows, "phrase").select("h1", "h2", "item").distinct()
        .groupBy("h1", "h2").agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    found = materialize(nearly.join(hits.join(in_items, ["h1", "h2"]), ["h1", "h2"], "left"), "contamination")
    release(windows, every_match)
    every = docs.select(F.col(id_col), *text_keys(text_col), count_words(F.col(text_col)).alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return every.join(found, ["h1", "h2"], "left").select(
        id_col, "h1", "h2", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), listed.alias("items"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"), F.coalesce("n_near", F.lit(0)).alias("n_near"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", **names: str) -> DataFrame:
    """``docs`` without the contaminated ones; the decision is a matter of the text alone, so it is joined by text.

    Null and empty texts have no words and stay, repeated rows stay or go together, and columns of any name stay as they are.
    An empty table of documents gives an empty result; one of items drops nothing.
    """
    bad = contamination(docs, items, text_col=text_col, **names).where("contaminated").select("h1", "h2").distinct()
    bad = materialize(bad, "contaminated")
    own = ["__loomframe_h1", "__loomframe_h2"]
    keyed = docs.withColumns(dict(zip(own, text_keys(text_col))))
    match = (keyed[own[0]] == bad["h1"]) & (keyed[own[1]] == bad["h2"])
    return keyed.join(bad, match, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document; n_near: windows that are there only with up to two words between their own."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=SLOP)
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated", "n_near")

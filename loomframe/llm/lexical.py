"""Ranked lexical search: exact top k by TPUT (three phases with a uniform threshold) over term-partitioned postings."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.llm.common import arrow_rows, materialize, materialize_lean, release, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The same over UTF-8 bytes: letters in lower case, other ASCII but digits a space, bytes beyond ASCII as they are.
BYTES = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).translate(bytes.maketrans(UPPER.encode(), LOWER.encode()))
WHOLE = -1  # the term number of the row that each document has for itself
TERMS_AT_ONCE = 200_000
ROWS_TO_BROADCAST = 200_000
FRAGMENTS = 16  # of a term's list, so that no list is one task


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))


def _item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, item_id, term), written: the number, the id and terms of each item; rows of one id are one item, a null id is an id."""
    key = F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit(""))
    names = materialize(items.select(key.alias("key"), F.col(id_col).alias("item_id")).distinct().withColumn("item", F.monotonically_increasing_id()), "lexical-names")
    terms = items.select(key.alias("key"), F.explode(terms_of(F.col(text_col))).alias("term")).distinct()
    asked = materialize(terms.join(names, "key").select("item", "item_id", "term"), "lexical-items")
    release(names)
    return asked


def _list_rows(numbers: dict[bytes, int], id_type: pa.DataType, wholes: bool):
    """mapInArrow: (row, doc_id, text) to (term, row, n, tf, doc_id), doc_id only in a document's WHOLE row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            term, row, length, tf, own = [], [], [], [], []
            for r, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = text.encode().translate(BYTES).split()
                if not words:
                    continue
                n = len(words)
                found = [(numbers[w], c) for w, c in Counter(words).items() if w in numbers]
                if wholes:
                    found.append((WHOLE, n))
                term += [t for t, _ in found]
                tf += [c for _, c in found]
                row += [r] * len(found)
                length += [n] * len(found)
                own += [None] * len(found)
                if wholes:
                    own[-1] = doc_id
            columns = [pa.array(term, pa.int32()), pa.array(row, pa.int64()), pa.array(length, pa.int64()), pa.array(tf, pa.int64()), pa.array(own, id_type)]
            yield pa.RecordBatch.from_arrays(columns, ["term", "row", "n", "tf", "doc_id"])

    return run


def term_postings(docs: DataFrame, terms: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Postings (term, row, n, tf, doc_id) of the given terms in all whole texts, partitioned by term, and the numbers (term, number).

    A document is a row: rows that repeat an id count each. Terms go to the workers TERMS_AT_ONCE at most; where there are more,
    the documents are read in as many turns.
    """
    spark = docs.sparkSession
    turns = -(-terms.count() // TERMS_AT_ONCE) or 1
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    if turns > 1:
        numbered = materialize(numbered, "lexical-documents")
    id_type = docs.schema[id_col].dataType
    kind = T.StructType(
        [T.StructField("term", T.IntegerType()), *[T.StructField(x, T.LongType()) for x in ("row", "n", "tf")], T.StructField("doc_id", id_type)]
    )
    arrow_type = docs.select(id_col).limit(0).toArrow().schema.field(0).type
    lists, names, first = [], [], 0
    for turn in range(turns):
        own = [r["term"] for r in terms.where(F.pmod(F.xxhash64("term"), F.lit(turns)) == turn).orderBy("term").collect()]
        numbers = {t.encode(): first + i for i, t in enumerate(own)}
        names.append(spark.createDataFrame([(t, first + i) for i, t in enumerate(own)], "term string, number int"))
        first += len(own)
        rows = numbered.mapInArrow(_list_rows(numbers, arrow_type, turn == 0), kind)
        spread = rows.repartition("term", F.pmod(F.xxhash64("row"), F.lit(FRAGMENTS))).sortWithinPartitions("term")
        with arrow_rows(spark, 500):
            lists.append(materialize_lean(spread, "lexical-postings"))
    known = materialize(_all_of(names), "lexical-terms")
    if turns > 1:
        whole = materialize(_all_of(lists), "lexical-postings")
        release(numbered, *lists)
        return whole, known
    return lists[0], known


def _all_of(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _best(scores: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "row"))
    return scores.withColumn("place", place).where(F.col("place") <= k)


def _kth(scores: DataFrame, k: int, name: str) -> DataFrame:
    """(item, name): the k-th highest score of each item, 0 where it has fewer."""
    return _best(scores, k).groupBy("item").agg(F.max(F.when(F.col("place") == k, F.col("score")).otherwise(0)).alias(name))


def _sized(df: DataFrame) -> DataFrame:
    """``df``, a written table, to be broadcast only while it is small."""
    return F.broadcast(df) if df.count() <= ROWS_TO_BROADCAST else df


def rank_documents(
    docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """The ``k`` documents of highest score above 0 for each item: (item_id, rank, doc_id, score), exactly.

    Score: for each distinct term of the item, its weight by rarity times its saturated frequency in the document, in integers.
    TPUT: (1) the k greatest postings of each term's list give lower bounds; the k best by these are looked up, and their k-th
    score is t; (2) of all lists of an item, postings above one threshold are fetched, the greatest at which a document
    without any cannot reach t; the k best by these are looked up, which raises t; what is missing is at most that
    threshold, and at most its list's greatest posting, so documents that cannot reach t are dropped; (3) the exact scores
    of the others are looked up.
    Equal scores go by ascending id (null first), then by the row read first. Null texts and items without terms have no terms; items that
    nothing matches have no rows. Rows that repeat an id are documents of their own.
    """
    asked = _item_terms(items, item_col, item_text_col)
    terms = materialize(asked.select("term").distinct(), "lexical-asked")
    postings, known = term_postings(docs, terms, id_col, text_col)
    whole, lists = postings.where(F.col("term") == WHOLE), postings.where(F.col("term") != WHOLE).drop("doc_id")
    n_docs, length = whole.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()

    rarity = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1)))
    weights = lists.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", rarity.cast("long").alias("w")).where("w > 0")
    weights = materialize(weights, "lexical-weights")
    of_items = asked.withColumnRenamed("term", "name").join(known.withColumnRenamed("term", "name"), "name").select("item", F.col("number").alias("term"))
    of_items = materialize(of_items.join(weights, "term"), "lexical-item-terms")
    norm = F.expr(f"50 + (50 * n * {n_docs}) div {max(1, length)}")
    saturated = F.expr("(1000000000 * tf) div (1000 * tf + 20 * m)")
    valued = lambda bars: lists.join(_sized(bars), "term").withColumn("m", norm).withColumn("v", F.col("w") * saturated)

    asks = of_items.select("item", "term")

    def scores_of(pairs: DataFrame) -> DataFrame:
        """(item, row, score): exact scores, looked up by term and document; pairs: a written table of (item, row)."""
        near = valued(weights).select("term", "row", "v").join(_sized(pairs.select("row").distinct()), "row", "left_semi")
        return pairs.join(_sized(asks), "item").join(near, ["term", "row"]).groupBy("item", "row").agg(F.sum("v").alias("score"))

    # 1: heads of the lists; the k documents of an item that they say most of are looked up, and the k-th gives t
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("v"), "row"))
    heads = valued(weights).select("term", "row", "v").withColumn("place", place).where(F.col("place") <= k)
    heads = materialize(heads.join(_sized(asks), "term"), "lexical-heads")
    best = materialize(_best(heads.groupBy("item", "row").agg(F.sum("v").alias("score")), k).select("item", "row"), "lexical-best")
    first = _kth(scores_of(best), k, "t")
    tops = heads.where("place = 1").groupBy("term").agg(F.max("v").alias("top"))
    held = of_items.join(first, "item").join(tops.withColumnRenamed("term", "of"), F.col("term") == F.col("of")).drop("of")
    # The uniform threshold: the greatest T at which postings of at most T, or their list's top if that is less, stay below t.
    by_top = Window.partitionBy("item").orderBy("top", "term")
    below, left = F.coalesce(F.sum("top").over(by_top.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), F.count(F.lit(1)).over(by_top.rowsBetween(0, Window.unboundedFollowing))
    levels = held.select("item", F.greatest(F.lit(0), F.floor((F.col("t") - 1 - below) / left)).cast("long").alias("level")).groupBy("item").agg(F.max("level").alias("level"))
    bars = materialize(held.join(levels, "item").withColumn("cap", F.least("top", "level")), "lexical-bars")

    # 2: all postings above the threshold, brought together by document, where they are summed for each item; bounds
    lowest = materialize(bars.where("top > level").groupBy("term").agg(F.first("w").alias("w"), F.min("level").alias("lowest")), "lexical-lowest")
    likely = valued(lowest).where(F.col("v") > F.col("lowest")).select("term", "row", "v").repartition("row")
    fetched = likely.join(_sized(bars.select("item", "term", "level", "cap")), "term").where(F.col("v") > F.col("level"))
    summed = fetched.groupBy("item", "row").agg(F.sum("v").alias("score"), F.sum("cap").alias("known"))
    better = materialize_lean(_best(summed, k).select("item", "row"), "lexical-better")
    second = _kth(scores_of(better), k, "t2").join(bars.groupBy("item").agg(F.sum("cap").alias("caps"), F.max("t").alias("t")), "item")
    second = materialize(second.select("item", (F.greatest("t", "t2") - F.col("caps")).alias("least")), "lexical-thresholds")
    bounded = summed.join(_sized(second), "item").where(F.col("score") - F.col("known") >= F.col("least"))
    candidates = materialize_lean(bounded.select("item", "row"), "lexical-candidates")

    # 3: exact scores of the candidates
    exact = scores_of(candidates)
    own = whole.select("row", "doc_id").join(_sized(candidates.select("row").distinct()), "row")
    exact = exact.join(own, "row")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"), "row"))
    top = exact.withColumn("rank", place).where(F.col("rank") <= k)
    named = asked.select("item", "item_id").distinct()
    found = materialize_lean(top.join(named, "item").select("item_id", "rank", "doc_id", "score"), "lexical-found")
    release(asked, terms, postings, known, weights, of_items, heads, best, bars, lowest, better, second, candidates)
    return found


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 documents of highest score for each benchmark item."""
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text")
    return rank_documents(docs, items)


OP12_SQL = rf"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS ts FROM documents
), g AS (
    SELECT count(*)::BIGINT AS nd, sum(len(ts))::BIGINT AS l FROM d WHERE len(ts) > 0
), p AS (
    SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ts) AS t FROM d) GROUP BY r, t
), w AS (
    SELECT t, floor(1000 * ln((2.0::DOUBLE * nd + 2) / (2.0::DOUBLE * df + 1)))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM p GROUP BY t), g
), q AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')) AS t FROM benchmark
), s AS (
    SELECT item_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(ts) * nd) // l))))::BIGINT AS score
    FROM q JOIN w USING (t) JOIN p USING (t) JOIN d USING (r), g GROUP BY item_id, r
), ranked AS (
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST, r)::INTEGER AS rank, doc_id, score
    FROM s JOIN d USING (r) WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""

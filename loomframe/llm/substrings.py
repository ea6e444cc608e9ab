"""Repeated byte strings, found by sorting suffixes at content-defined anchors."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomframe.llm.common import materialize_lean, release, table, text_keys, text_or_empty

LENGTH = 200
LEAD = 32
SPREAD = LENGTH - LEAD + 1
#: Strings of a group share 201 - w bytes: the lead at first, then the stretch common to strings whose leads stand at up to w places.
WIDTHS = (42, 8, 1)
BUCKET_RECORDS = 2000
_CHUNK = 1 << 22
_ROWS_A_FRAME = 50_000
_RECORDS_A_FRAME = 20_000
_POSITION = np.uint64((1 << 24) - 1)
_ODD = [np.uint64((k * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019 | 1) & (1 << 64) - 1) for k in range(1, 10)]
_BLOCK_WORDS = 9
_BLOCKS = (0, 64, 128)  # 72 bytes from each cover 200


def _words(data: bytes, n: int) -> np.ndarray:
    """The 8-byte word that starts at each of the first n bytes; data must go on 8 bytes further."""
    return np.ndarray((n,), dtype="<u8", buffer=data, strides=(1,))


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(29)
    h *= _ODD[1]
    h ^= h >> np.uint64(32)
    return h


def anchored(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram, first, count, offset) of a text's anchors.

    Each 200-byte string has one anchor: the leftmost of its 32-byte leads with the least hash. ``count`` strings, the
    first at byte ``first``, share an anchor, which stands ``offset`` bytes after ``first``; gram is the lead's hash.
    Equal strings have equal anchors, wherever they stand.
    """
    grams, firsts, counts, offsets = [], [], [], []
    for base in range(0, max(0, len(text) - LENGTH + 1), _CHUNK):
        part = text[base : base + _CHUNK + LENGTH - 1]
        m = len(part) - LEAD + 1
        w = _words(part + b"\0" * 8, len(part))
        h = w[0:m] * _ODD[0]
        for j in range(1, LEAD // 8):
            h += w[8 * j : 8 * j + m] * _ODD[j]
        h = _mixed(h)
        least = (h & ~_POSITION) | np.arange(m, dtype=np.uint64)
        step = 1
        while step * 2 <= SPREAD:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if step < SPREAD:
            least = np.minimum(least[: len(least) - SPREAD + step], least[SPREAD - step :])
        at = (least & _POSITION).astype(np.int64)
        start = np.concatenate([[0], np.nonzero(np.diff(at))[0] + 1])
        grams.append(h[at[start]])
        firsts.append(start + base)
        counts.append(np.diff(np.concatenate([start, [len(at)]])))
        offsets.append(at[start] - start)
    if not grams:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in (grams, firsts, counts, offsets))


_ANCHORS = ["h1", "h2", "gram", "whole", "first", "count", "offset"]


def _emit_anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Anchors of many texts at a time: a frame for each text would cost more than its anchors do."""
    for pdf in batches:
        parts: list[tuple] = []
        ready = 0
        for h1, h2, text in zip(pdf["h1"], pdf["h2"], pdf["text"]):
            gram, first, count, offset = anchored(text)
            n = len(gram)
            if n:
                digest = xxhash.xxh64_intdigest
                whole = [digest(text[a : a + c + LENGTH - 1]) for a, c in zip(first.tolist(), count.tolist())]
                parts.append((np.full(n, h1), np.full(n, h2), gram.view(np.int64), np.array(whole, np.uint64).view(np.int64), first, count, offset))
                ready += n
            if ready >= _ROWS_A_FRAME:
                yield _anchor_frame(parts)
                parts, ready = [], 0
        if parts:
            yield _anchor_frame(parts)


def _anchor_frame(parts: list[tuple]) -> pd.DataFrame:
    columns = dict(zip(_ANCHORS, (np.concatenate(c) for c in zip(*parts))))
    return pd.DataFrame(columns).astype({"first": np.int32, "count": np.int16, "offset": np.int16})


def repeated_in_bucket(group: np.ndarray, offset: np.ndarray, contents: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(record, index) of each 200-byte string that another record of its group holds at the same place from the lead.

    A multikey quicksort over three tokens of 72 bytes each (64-bit digests, overlapping to 200 bytes): strings are ordered
    by the current token, and only runs of equal ones go on to the next. Different bytes may share tokens, so what is left
    after the last is compared byte by byte: only equal strings are repeated.
    """
    sizes = np.array([len(c) for c in contents], np.int64)
    data = b"".join(contents) + b"\0" * 80
    n = len(data) - 80
    words = _words(data, n + 72)
    token = words[:n] * _ODD[0]
    for j in range(1, _BLOCK_WORDS):
        token += words[8 * j : 8 * j + n] * _ODD[j]
    token = _mixed(token)
    counts = sizes - LENGTH + 1
    record = np.repeat(np.arange(len(contents)), counts)
    index = np.arange(len(record)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = np.repeat(np.cumsum(sizes) - sizes, counts) + index
    run = group[record] * 256 + (offset[record] - index)
    for block in _BLOCKS:
        key = token[start + block]
        order = np.lexsort((key, run))
        key, run = key[order], run[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (run[1:] != run[:-1])]) if len(run) else np.zeros(0, bool)
        run = np.cumsum(new)
        many = np.bincount(run, minlength=1)[run] > 1
        order = order[many]
        record, index, start, run = record[order], index[order], start[order], run[many]
    again = _equal_to_another(data, words, start, run)
    return record[again], index[again]


def _equal_to_another(data: bytes, words: np.ndarray, start: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Whether each 200-byte string (at ``start``; runs are adjacent) has the very bytes of another one of its run."""
    if not len(start):
        return np.zeros(0, bool)
    new = np.concatenate([[True], run[1:] != run[:-1]])
    first = np.nonzero(new)[0]
    own = np.cumsum(new) - 1
    head = start[first][own]
    differs = np.zeros(len(start), bool)
    for j in range(0, LENGTH, 8):
        differs |= words[start + j] != words[head + j]
    again = np.ones(len(start), bool)
    last = np.append(first[1:], len(start))
    for k in np.unique(own[differs]).tolist():  # runs of strings that only share their tokens
        strings = [data[a : a + LENGTH] for a in start[first[k] : last[k]].tolist()]
        counts = Counter(strings)
        again[first[k] : last[k]] = [counts[x] > 1 for x in strings]
    return again


def _runs(record: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of neighbouring strings as (record, from, to), in bytes of the record."""
    order = np.lexsort((index, record))
    record, index = record[order], index[order]
    new = np.concatenate([[True], (record[1:] != record[:-1]) | (index[1:] != index[:-1] + 1)])
    first = np.nonzero(new)[0]
    last = np.concatenate([first[1:], [len(record)]]) - 1
    return record[first], index[first], index[last] + LENGTH


def _sort_bucket(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Records in order of their leading bytes -> repeated runs; leading bytes that go on in the next batch are carried over."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        group = pdf["lead"].factorize()[0].astype(np.int64)
        record, index = repeated_in_bucket(group, pdf["offset"].to_numpy(np.int64), list(pdf["content"]))
        if not len(record):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("gram", "whole", "low", "high")})
        record, low, high = _runs(record, index)
        gram, whole, base = (pdf[c].to_numpy()[record] for c in ("gram", "whole", "base"))
        return pd.DataFrame({"gram": gram, "whole": whole, "low": low + base, "high": high + base})

    rest: pd.DataFrame | None = None
    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        last = pdf["lead"] == pdf["lead"].iloc[-1] if len(pdf) else []
        rest = pdf[last]
        if len(rest) < len(pdf):
            yield solve(pdf[~last].reset_index(drop=True))
    if rest is not None and len(rest):
        yield solve(rest.reset_index(drop=True))


_RECORD = "gram long, whole long, base int, offset short, lead binary, key long, print long, content binary"
_RECORD_COLUMNS = ["gram", "whole", "base", "offset", "lead", "key", "print", "content"]


def _cut_records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The surroundings of anchors, cut out of their texts; key is the lead's hash, print that of the whole content."""
    for pdf in batches:
        out: list[tuple] = []
        for text, records in zip(pdf["text"], pdf["records"]):
            for r in records:
                content = text[r["first"] : r["first"] + r["count"] + LENGTH - 1]
                lead = content[r["offset"] : r["offset"] + LEAD]
                out.append((r["gram"], r["whole"], 0, r["offset"], lead, r["gram"], r["whole"], content))
            if len(out) >= _RECORDS_A_FRAME:
                yield pd.DataFrame(out, columns=_RECORD_COLUMNS)
                out = []
        if out:
            yield pd.DataFrame(out, columns=_RECORD_COLUMNS)


def narrowed(content: bytes, offset: int, width: int) -> list[tuple[int, bytes, bytes]]:
    """(start, leading bytes, content) of a record's parts: its strings by the place of the lead in them, ``width`` places together.

    All strings of a part hold its leading bytes, 201 - width of them: from the first place's start to the last one's end.
    """
    parts = []
    lowest = offset - (len(content) - LENGTH)  # place of the lead in the record's last string
    for a in range(lowest // width * width, offset + 1, width):
        first, last = max(0, offset - (a + width - 1)), min(len(content) - LENGTH, offset - a)
        parts.append((first, content[offset - a : offset - (a + width - 1) + LENGTH], content[first : last + LENGTH]))
    return parts


def _narrow(width: int):
    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = xxhash.xxh64_intdigest
        for pdf in batches:
            out: list[tuple] = []
            for gram, whole, base, offset, content in zip(pdf["gram"], pdf["whole"], pdf["base"], pdf["offset"], pdf["content"]):
                for first, lead, part in narrowed(content, offset, width):
                    key, own = digest(lead, width), digest(part, width + 1)
                    out.append((gram, whole, base + first, offset - first, lead, key - (key >> 63 << 64), own - (own >> 63 << 64), part))
                if len(out) >= _RECORDS_A_FRAME:
                    yield pd.DataFrame(out, columns=_RECORD_COLUMNS)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=_RECORD_COLUMNS)

    return split


_SPAN = ["gram", "whole", "low", "high"]


def _fitting_buckets(records: DataFrame, found: list[DataFrame], used: list[DataFrame]) -> list[DataFrame]:
    """Records by leading bytes in groups that fit a bucket: too large a group is split by more of its leading bytes.

    records: distinct ones. Parts that are alike in two records are repeated as they are, which goes to ``found``; one of
    them stays for the others to meet. A part that shares its leading bytes with no other is done with. At the last width the
    leading bytes are the whole string, so nothing is left to sort.
    """
    fitting = []
    for width in (*WIDTHS, 0):
        # Few keys are that large: so small a table is joined without moving the records.
        large = materialize_lean(records.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BUCKET_RECORDS).select("key"), "large-keys")
        used.append(large)
        if large.isEmpty():
            fitting.append(records)
            break
        fitting.append(records.join(large, "key", "left_anti"))
        if not width:
            break
        crowd = records.join(large, "key", "left_semi")
        parts = materialize_lean(crowd.mapInPandas(_narrow(width), _RECORD), "narrowed")
        alike = parts.groupBy("key", "print").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("gram", "whole", "base")).alias("one")).where("n > 1")
        alike = materialize_lean(alike.select("key", "print", F.col("one").alias("__one")), "alike")
        met = parts.join(alike, ["key", "print"], "left")
        whole = met.where("__one is not null")
        found.append(whole.select("gram", "whole", F.col("base").alias("low"), (F.col("base") + F.octet_length("content")).cast("int").alias("high")))
        own = F.struct("gram", "whole", "base")
        records = materialize_lean(met.where(F.col("__one").isNull() | (F.col("__one") == own)).drop("__one"), "narrowed-once")
        used += [parts, alike, records]
    return fitting


def repeated_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(h1, h2, spans)``: of each text (by its hashes), the maximal byte runs covered by 200-byte strings found elsewhere.

    Method: suffix sorting at anchors. A string's anchor depends on its content alone, so only suffixes at anchors are
    compared, each with the bytes before it that its strings need. (1) Anchors are counted by lead: a lead that occurs
    once has no repeated string; one whose surroundings are always alike is repeated as a whole, without a look at its
    bytes. (2) The distinct surroundings of the other leads are cut out of their texts and range-partitioned by their
    leading bytes at splitters that Spark samples; equal leads meet in one bucket, so that no match crosses a boundary
    between buckets. (3) A bucket is sorted by lead and, within it, by multikey quicksort over tokens of 72 bytes;
    strings that agree in all tokens are then compared byte by byte. Before that, leads with more surroundings than a bucket
    holds are split by more of the bytes that their strings share, as often as is needed, up to whole strings.
    Texts match themselves too; matches never cross documents.
    """
    text = text_or_empty(F.col(text_col))
    keys = text_keys("__text")
    source = docs.select(text.alias("__text")).select(*keys, F.col("__text").cast("binary").alias("text"))
    long_enough = source.where(F.octet_length("text") >= LENGTH)
    shape = "h1 long, h2 long, gram long, whole long, first int, count short, offset short"
    anchors = materialize_lean(long_enough.mapInPandas(_emit_anchors, shape), "anchors")
    grams = anchors.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), (F.min("whole") != F.max("whole")).alias("mixed"))
    grams = materialize_lean(grams.where("n > 1").select("gram", "mixed"), "grams")
    alive = materialize_lean(anchors.join(grams, "gram"), "alive-anchors")

    place = F.struct("h1", "h2", "first", "count", "offset")
    distinct = alive.where("mixed").groupBy("gram", "whole").agg((F.count(F.lit(1)) > 1).alias("many"), F.min(place).alias("at"))
    distinct = materialize_lean(distinct.select("gram", "whole", "many", "at.*"), "distinct-records")
    record = F.struct("gram", "whole", "first", "count", "offset")
    by_text = distinct.groupBy("h1", "h2").agg(F.collect_list(record).alias("records"))
    # Copies of a text are dropped by the task that reads them, so that one a task is left to move, not all of them.
    once = long_enough.dropDuplicates(["h1", "h2"])
    cut = once.join(by_text, ["h1", "h2"]).select("text", "records").mapInPandas(_cut_records, _RECORD)
    records = materialize_lean(cut, "records")

    wholly = distinct.where("many").select("gram", "whole", F.lit(0).alias("low"), (F.col("count") + LENGTH - 1).cast("int").alias("high"))
    known, used = [wholly], [anchors, grams, distinct, records]
    fitting = reduce(DataFrame.unionByName, _fitting_buckets(records, known, used))
    buckets = fitting.select("lead", "gram", "whole", "base", "offset", "content").repartitionByRange("lead").sortWithinPartitions("lead")
    sorted_out = buckets.mapInPandas(_sort_bucket, "gram long, whole long, low int, high int")
    found = materialize_lean(reduce(DataFrame.union, [d.select(*_SPAN) for d in (sorted_out, *known)]), "repeated")

    alike = alive.where("not mixed").select("h1", "h2", F.col("first").alias("start"), (F.col("first") + F.col("count") + LENGTH - 1).alias("stop"))
    placed = alive.where("mixed").select("h1", "h2", "gram", "whole", "first").join(found, ["gram", "whole"])
    placed = placed.select("h1", "h2", (F.col("first") + F.col("low")).alias("start"), (F.col("first") + F.col("high")).alias("stop"))
    every = alike.union(placed).groupBy("h1", "h2", "start").agg(F.max("stop").alias("stop"))
    order = Window.partitionBy("h1", "h2").orderBy("start")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = every.withColumn("__new", (reach.isNull() | (F.col("start") > reach)).cast("int"))
    numbered = marked.withColumn("__no", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    islands = numbered.groupBy("h1", "h2", "__no").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    listed = islands.groupBy("h1", "h2").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    spans = materialize_lean(listed, "spans")
    release(*used, alive, found)
    return spans


def _spanned(docs: DataFrame, text_col: str, added: str) -> DataFrame:
    """``docs`` plus the runs of each text as ``added``; private names otherwise."""
    spans = repeated_spans(docs, text_col)
    keyed = docs.withColumn("__loomframe_text", text_or_empty(F.col(text_col)))
    keyed = keyed.withColumns(dict(zip(("__loomframe_h1", "__loomframe_h2"), text_keys("__loomframe_text")))).drop("__loomframe_text")
    match = (keyed["__loomframe_h1"] == spans["h1"]) & (keyed["__loomframe_h2"] == spans["h2"])
    none = F.expr("cast(array() as array<struct<start:int,stop:int>>)")
    return keyed.join(spans.withColumnRenamed("spans", "__loomframe_spans"), match, "left").select(
        *[keyed[c] for c in docs.columns], F.coalesce("__loomframe_spans", none).alias(added)
    )


def with_repeated_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``repeated``: array<struct<start, stop>>, byte runs of the whole UTF-8 text, in order.

    Null texts count as empty; texts below 200 bytes have no runs. Repeated rows match each other, so they are covered as
    a whole. A column of this name is replaced.
    """
    return _spanned(docs.drop("repeated"), text_col, "repeated")


def kept_bytes(text: bytes, spans) -> bytes:
    out, at = [], 0
    for s in spans:
        out.append(text[at : s["start"]])
        at = s["stop"]
    return b"".join([*out, text[at:]])


def _kept(digest: bool, kind: str):
    @F.pandas_udf(kind)
    def udf(texts: pd.Series, spans: pd.Series) -> pd.Series:
        kept = (kept_bytes(t, s) for t, s in zip(texts, spans))
        return pd.Series([hashlib.sha256(k).hexdigest() if digest else k.decode(errors="ignore") for k in kept], dtype="object")

    return udf


def drop_repeated(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated runs cut out of the texts; bytes of a character cut in two are dropped as well."""
    spans = "__loomframe_repeated"
    found = _spanned(docs, text_col, spans)
    cut = _kept(False, "string")(text_or_empty(F.col(text_col)).cast("binary"), F.col(spans))
    return found.withColumn(text_col, F.when(F.size(spans) > 0, cut).otherwise(F.col(text_col))).select(*docs.columns)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is removed from, and what is left of, every document."""
    found = with_repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    raw = text_or_empty(F.col("text")).cast("binary")
    removed: Column = F.aggregate("repeated", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    digest = F.when(F.size("repeated") == 0, F.sha2(raw, 256)).otherwise(_kept(True, "string")(raw, F.col("repeated")))
    return found.select(
        "doc_id",
        F.octet_length(raw).cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("repeated").cast("long").alias("n_spans"),
        digest.alias("kept_sha256"),
    )

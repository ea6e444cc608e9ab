"""Token counts by section: one encoding of the whole document, attributed through its tokens' spans.

A token of a byte-level vocabulary may end inside a character, so spans are kept in bytes for the join, and characters are what
sections are returned in.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm.common import table, text_or_empty

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern published with this vocabulary.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_VOCABULARY_BYTES = 64 << 20


@cache
def _encoder(vocabulary: bytes, pattern: str):
    """The encoding and the byte length of each token."""
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in vocabulary.splitlines() if line)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes


def attribute(stops: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and of those how many cross a boundary.

    stops: where each token ends; bounds: where each section ends, rising, the last at the text's end. The sorted spans are
    interval-joined by binary search. A token that crosses boundaries goes to the section that holds most of its bytes,
    the first of them if there is a tie.
    """
    n = len(bounds)
    starts = np.concatenate([[0], stops[:-1]]).astype(np.int64)
    first = np.searchsorted(bounds, starts, side="right")
    last = np.searchsorted(bounds, stops - 1, side="right")
    owner, crossing = first.copy(), np.nonzero(first != last)[0]
    for t in crossing:
        cuts = [starts[t], *bounds[first[t] : last[t]], stops[t]]
        owner[t] = first[t] + int(np.argmax(np.diff(cuts)))
    return np.bincount(owner, minlength=n), np.bincount(owner[crossing], minlength=n)


def section_tokens(
    spark: SparkSession, parts: Column, ranks_path: str = DEFAULT_RANKS, pattern: str = SPLIT_PATTERN
) -> Column:
    """array<struct<start, stop, tokens, crossing>> for an array of consecutive sections of one document.

    The document is the sections joined; start and stop are its characters (code points), crossing the tokens that have bytes in
    several sections, counted where they are counted. Sections may be empty; an empty one has no tokens. The vocabulary file is read once
    by the driver and broadcast; a file above MAX_VOCABULARY_BYTES is refused.
    """
    raw = spark.read.format("binaryFile").load(ranks_path if "://" in ranks_path else f"file://{ranks_path}").first()
    if raw["length"] > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{ranks_path}: {raw['length']} bytes are too many to broadcast")
    shared = spark.sparkContext.broadcast(bytes(raw["content"]))

    @F.pandas_udf("array<struct<start:long,stop:long,tokens:long,crossing:long>>")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding, sizes = _encoder(shared.value, pattern)
        for series in batches:
            out = []
            for sections in series:
                ends = np.cumsum([len(s.encode()) for s in sections], dtype=np.int64)
                chars = np.cumsum([len(s) for s in sections], dtype=np.int64)
                ids = encoding.encode_to_numpy("".join(sections), disallowed_special=())
                if len(ids):
                    tokens, crossing = attribute(np.cumsum(sizes[ids]), ends)
                else:
                    tokens = crossing = np.zeros(len(sections), np.int64)
                starts = [0, *chars[:-1]]
                out.append([
                    {"start": int(a), "stop": int(b), "tokens": int(t), "crossing": int(x)}
                    for a, b, t, x in zip(starts, chars, tokens, crossing)
                ])
            yield pd.Series(out, dtype="object")

    return udf(parts)


def lines_of(text: Column) -> Column:
    """A text as its lines, each with the line feed that ends it; an empty text has one empty line."""
    pieces = F.split(text_or_empty(text), "\n")
    return F.transform(pieces, lambda p, i: F.when(i < F.size(pieces) - 1, F.concat(p, F.lit("\n"))).otherwise(p))


def count_by_section(docs: DataFrame, text_col: str = "text", **vocabulary: str) -> DataFrame:
    """``docs`` plus ``sections``: the lines of each whole text with their character spans and token counts.

    Null and empty texts have one empty section of no tokens. Counts of a document add up to its tokens. Special-token
    strings are ordinary text. A column of this name is replaced.
    """
    rest = docs.drop("sections")
    spark = docs.sparkSession
    return rest.withColumn("sections", section_tokens(spark, lines_of(F.col(text_col)), **vocabulary))


def count_by_field(docs: DataFrame, fields: list[str], joint: str = "\n", **vocabulary: str) -> DataFrame:
    """``docs`` plus ``sections``, one for each field: the fields' texts, each but the last with ``joint`` behind it, are encoded as one."""
    parts = [
        F.concat(text_or_empty(F.col(f)), F.lit(joint)) if i < len(fields) - 1 else text_or_empty(F.col(f))
        for i, f in enumerate(fields)
    ]
    return docs.drop("sections").withColumn("sections", section_tokens(docs.sparkSession, F.array(*parts), **vocabulary))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document and of each of its lines."""
    found = count_by_section(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def total(name: str) -> Column:
        return F.aggregate(F.col("sections")[name], F.lit(0).cast("long"), lambda a, x: a + x)

    return found.select(
        "doc_id",
        total("tokens").alias("n_tokens"),
        F.size("sections").cast("long").alias("n_sections"),
        total("crossing").alias("n_crossing"),
        F.col("sections")["tokens"].alias("section_tokens"),
    )

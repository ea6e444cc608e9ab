"""Secret scans: a trigram inverted index picks the texts that a rule's regex has to read."""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as sre_parse
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.functions.text import let
from loomframe.llm.common import materialize, table, text_or_empty

MAX_ALTERNATIVES = 64
MASK_BITS = 62
SPAN_BLOCK = 256
KEY = "__loomframe_key"


@dataclass(frozen=True)
class Rule:
    """A match of ``pattern`` counts if its group ``group`` has at least ``least`` characters."""

    name: str
    pattern: str
    group: int = 0
    least: int = 0


# Of `AKIA[A-Z0-9]+` and `[0-9a-f]+` only runs of 18 and 16 characters count. A run that is too short has no long enough
# run inside it, so asking for the length in the pattern finds the same spans. In `assign` a match that fails still uses
# up its characters, so there the length is checked afterwards.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """What a text must hold for ``pattern`` to match: any one of the sets, with all of its lower-cased trigrams.

    None: no trigram is mandatory on some way through the pattern, so every text has to be scanned.
    """
    ways = _ways(sre_parse.parse(pattern), [("", frozenset())])
    sets = {seen | _trigrams(run) for run, seen in ways}
    if any(not s for s in sets):
        return None
    return sorted((s for s in sets if not any(o < s for o in sets)), key=sorted)


def _trigrams(run: str) -> frozenset[str]:
    return frozenset(run[i : i + 3] for i in range(len(run) - 2))


def _flush(ways: list) -> list:
    return list(dict.fromkeys(("", seen | _trigrams(run)) for run, seen in ways))


def _ways(items, ways: list) -> list:
    """The (current literal run, trigrams so far) of each way through ``items``."""
    for op, arg in items:
        if op is sre.LITERAL:
            letter = chr(arg).lower()
            ways = [(run + letter, seen) for run, seen in ways]
        elif op is sre.BRANCH:
            ways = [w for branch in arg[1] for w in _ways(branch, ways)]
        elif op is sre.SUBPATTERN:
            ways = _ways(arg[-1], ways)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, sub = arg
            once = _ways(sub, ways)
            if low == 0:
                ways = ways + once if high == 1 else _flush(ways)
            else:
                ways = once if low == high == 1 else _flush(once)
        elif op is not sre.AT:
            ways = _flush(ways)
        ways = list(dict.fromkeys(ways))
        if len(ways) > MAX_ALTERNATIVES:
            ways = [("", frozenset.intersection(*(seen for _, seen in _flush(ways))))]
    return ways


def trigram_postings(docs: DataFrame, trigrams: list[str], text_col: str) -> DataFrame:
    """``(key, no)``: which of the trigrams stands in which text, for the trigrams that rules ask for.

    A text goes by its xxhash64, so copies share postings; should two texts share a hash, both count as holding either's
    trigrams, which only adds candidates.
    """
    lowered = docs.select(F.xxhash64(F.col(text_col)).alias("key"), F.lower(F.col(text_col)).alias("low")).where("low is not null")
    held = F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams)])
    return lowered.select("key", F.explode(F.array_compact(held)).alias("no"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...], text_col: str) -> tuple[DataFrame | None, dict[str, str | None]]:
    """Texts whose postings satisfy some rule's trigram query, and the name of each rule's flag column (None: scan all)."""
    queries = {r.name: trigram_query(r.pattern) for r in rules}
    trigrams = sorted({t for q in queries.values() if q for s in q for t in s})
    flags = {r.name: f"may_{i}" if queries[r.name] else None for i, r in enumerate(rules)}
    if not trigrams:
        return None, flags
    at = {t: i for i, t in enumerate(trigrams)}
    words = range(0, len(trigrams), MASK_BITS)
    no = F.col("no")
    masks = [
        F.bit_or(F.when((no >= w) & (no < w + MASK_BITS), F.expr(f"shiftleft(1L, no - {w})")).otherwise(F.lit(0).cast("long"))).alias(f"m{w}")
        for w in words
    ]

    def holds(wanted: frozenset[str]) -> Column:
        parts = []
        for w in words:
            bits = sum(1 << at[t] - w for t in wanted if w <= at[t] < w + MASK_BITS)
            if bits:
                parts.append(F.col(f"m{w}").bitwiseAND(F.lit(bits)) == bits)
        return reduce(Column.__and__, parts)

    ways = {flags[n]: reduce(Column.__or__, [holds(s) for s in q]) for n, q in queries.items() if q}
    met = trigram_postings(docs, trigrams, text_col).groupBy("key").agg(*masks).select("key", *[c.alias(f) for f, c in ways.items()])
    return materialize(met.where(reduce(Column.__or__, [F.col(f) for f in ways])), "secret-candidates"), flags


def _no_spans() -> Column:
    return F.expr("cast(array() as array<struct<start:int,kind:int,stop:int>>)")


def _spans(rule: Rule, no: int, text: Column) -> Column:
    """array<struct<start, kind, stop>> of a rule's counting matches, in code points.

    The pieces between matches and the matches themselves give the positions: each starts where all before it end. Lengths
    are summed block by block, so that a text with very many matches does not copy a growing array for each of them.
    """
    pattern = F.lit(rule.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    values = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else matches
    pieces = F.split(text, rule.pattern)

    def lengths(found: Column) -> Column:
        gaps = F.transform(F.slice(found["pieces"], F.lit(1), F.size(found["matches"])), lambda p: F.length(p))
        sizes = F.transform(found["matches"], lambda m: F.length(m))
        counts = F.transform(found["values"], lambda v: F.length(v) >= rule.least)
        return F.arrays_zip(gaps.alias("gap"), sizes.alias("size"), counts.alias("counts"))

    def placed(rows: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / SPAN_BLOCK).cast("int"))
        block = lambda b: F.slice(rows, b * SPAN_BLOCK + 1, F.lit(SPAN_BLOCK))
        total = lambda b: F.aggregate(block(b), F.lit(0), lambda at, x: at + x["gap"] + x["size"])
        none_yet = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("starts"))
        run = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts"))
        starts = F.aggregate(F.transform(blocks, total), none_yet, run)["starts"]

        def add(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["gap"]
            stop = start + x["size"]
            one = F.array(F.struct(start.alias("start"), F.lit(no).alias("kind"), stop.alias("stop")))
            return F.struct(stop.alias("at"), F.when(x["counts"], F.concat(acc["spans"], one)).otherwise(acc["spans"]).alias("spans"))

        return let(starts, lambda at: F.flatten(F.transform(blocks, lambda b: F.aggregate(block(b), F.struct(F.get(at, b).alias("at"), _no_spans().alias("spans")), add)["spans"])))

    found = F.struct(pieces.alias("pieces"), matches.alias("matches"), values.alias("values"))
    return F.when(F.regexp_like(text, pattern), let(let(found, lengths), placed)).otherwise(_no_spans())


def _scanned(docs: DataFrame, rules: tuple[Rule, ...], text_col: str, added: str) -> DataFrame:
    """``docs`` plus the spans as ``added``; private names otherwise."""
    found, flags = candidates(docs.select(text_col), rules, text_col)
    keyed = docs.withColumn(KEY, F.xxhash64(F.col(text_col)))
    if found is not None:
        keyed = keyed.join(found.select(F.col("key").alias(KEY), *[F.col(f).alias(f"{KEY}_{f}") for f in found.columns if f != "key"]), KEY, "left")
    text, parts = text_or_empty(F.col(text_col)), []
    for no, rule in enumerate(rules):
        spans = _spans(rule, no, text)
        parts.append(spans if flags[rule.name] is None else F.when(F.col(f"{KEY}_{flags[rule.name]}"), spans).otherwise(_no_spans()))
    return keyed.select(*docs.columns, F.array_sort(F.concat(*parts)).alias(added))


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``secret_spans``: array<struct<start, kind, stop>>, sorted by start, then kind (the rule's number).

    Per rule the matches are leftmost and do not overlap; those whose group is too short are dropped. Rules with mandatory
    trigrams read only the texts that the index returns; the others read every text. Null and empty texts have no spans.
    A column of this name is replaced; all others stay, and repeated rows stay repeated.
    """
    return _scanned(docs.drop("secret_spans"), rules, text_col, "secret_spans")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, by the base rules; the index adds no spans of its own."""
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.array(*[F.lit(r.name) for r in BASE_RULES])
    told = F.transform("secret_spans", lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string")))
    counts = [
        F.expr(f"cast(size(filter(secret_spans, s -> s.kind = {i})) as long)").alias(f"n_{r.name}") for i, r in enumerate(BASE_RULES)
    ]
    spans = found.select("doc_id", *counts, F.array_join(told, ",").alias("spans"))
    return spans.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("spans", 256).alias("base_sha256"), "spans")


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES, text_col: str = "text", mark: str = "<secret>") -> DataFrame:
    """``docs`` with every span of ``scan_secrets`` (overlaps merged from the left) replaced by ``mark``; null texts stay null."""
    spans = f"{KEY}_spans"
    found = _scanned(docs, rules, text_col, spans)

    def cut(acc: Column, s: Column) -> Column:
        kept = F.substring(F.col(text_col), acc["at"] + 1, s["start"] - acc["at"])
        inside = s["start"] < acc["at"]
        return F.struct(
            F.greatest(acc["at"], s["stop"]).alias("at"),
            F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], kept, F.lit(mark))).alias("out"),
        )

    rest = F.aggregate(
        spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), cut,
        lambda acc: F.concat(acc["out"], F.substring(F.col(text_col), acc["at"] + 1, F.length(text_col))),
    )
    clean = F.when(F.size(spans) > 0, rest).otherwise(F.col(text_col))
    return found.withColumn(text_col, clean).select(*docs.columns)


_ASSIGN_SQL = (
    "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    """["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
)


def _kind_sql(kind: str, no: int, pattern: str, group: int, least: int) -> str:
    return f"""
    SELECT rid, {no} AS no, '{kind}' AS kind, stop - len(m) AS start, stop, len(v) >= {least} AS counts FROM (
      SELECT rid, m, v, sum(len(p) + len(m)) OVER (PARTITION BY rid ORDER BY i ROWS UNBOUNDED PRECEDING) AS stop FROM (
        SELECT rid, unnest(ms) AS m, unnest(vs) AS v, unnest(ps[1:len(ms)]) AS p, unnest(range(len(ms))) AS i FROM (
          SELECT rid, regexp_extract_all(t, '{pattern}') AS ms, regexp_extract_all(t, '{pattern}', {group}) AS vs,
                 regexp_split_to_array(t, '{pattern}') AS ps
          FROM d)))"""


OP2_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({_kind_sql("assign", 0, _ASSIGN_SQL, 2, 12)} UNION ALL {_kind_sql("access", 1, "AKIA[A-Z0-9]+", 0, 18)}
  UNION ALL {_kind_sql("hex", 2, "[0-9a-f]+", 0, 16)}),
g AS (SELECT rid, count(*) FILTER (no = 0) AS n_assign, count(*) FILTER (no = 1) AS n_access, count(*) FILTER (no = 2) AS n_hex,
  string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, no) AS spans FROM s WHERE counts GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
  coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)
"""

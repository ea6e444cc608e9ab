"""The corpus queries as they are registered, every column against brute force, and the pipeline stage by stage."""

import base64
import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
import tiktoken
from pyspark.sql import functions as F
from test_operators import ALL_IDS, SF, area_under_curve, brute_components, brute_contamination, brute_repeats, docs, ids, plain_simhash  # noqa: F401

import corpus_pipeline
from loomframe.llm import decontamination as de
from loomframe.llm import langid as li
from loomframe.llm import mixing as mi
from loomframe.llm import quality as qu
from loomframe.llm import secret_scan as ss
from loomframe.llm import sharding as sh
from loomframe.llm import simhash as si
from loomframe.llm import substrings as su
from loomframe.llm import token_counts as tc
from loomframe.llm.common import materialize
from loomframe.llm.queries import QUERIES


@pytest.fixture(scope="module")
def rows(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()


def told(spark, name):
    return {r["doc_id"]: r for r in QUERIES[name](spark, SF).collect()}


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def plain_sections(encoding, text):
    """Each token's characters, one by one, to the line that most of its bytes stand in; crossing: tokens with bytes in several lines."""
    lines = text.split("\n")
    lines = [x + "\n" for x in lines[:-1]] + lines[-1:]
    owner = [i for i, line in enumerate(lines) for _ in line.encode()]
    counts, crossing, at = [0] * len(lines), 0, 0
    for token in encoding.encode_ordinary(text):
        n = len(encoding.decode_single_token_bytes(token))
        votes = Counter(owner[at : at + n])
        counts[max(votes, key=lambda i: (votes[i], -i))] += 1
        crossing += len(votes) > 1
        at += n
    return counts, crossing


def test_op3(spark, rows):
    ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in open(tc.DEFAULT_RANKS, "rb").read().splitlines() if line)}
    encoding = tiktoken.Encoding("plain", pat_str=tc.SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = told(spark, "op3_token_counts")
    assert len(got) == len(rows)
    for r in rows:
        counts, crossing = plain_sections(encoding, r["text"] or "")
        o = got[r["doc_id"]]
        assert (o["section_tokens"], o["n_crossing"], o["n_tokens"], o["n_sections"]) == (counts, crossing, sum(counts), len(counts))


def test_op4(spark, rows):
    got = told(spark, "op4_language_id")
    langs = {r["lang"] for r in rows if r["lang"]}
    assert all(got[r["doc_id"]]["held_out"] == held_out(r["doc_id"]) for r in rows)
    assert all(o["lang_pred"] in langs | {"und"} and 0 <= o["score"] <= 1 for o in got.values())
    assert all((o["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) for r in rows for o in [got[r["doc_id"]]])


def test_op5(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = QUERIES["op5_quality"](spark, sf).collect()
    assert all(o["held_out"] == held_out(o["doc_id"]) and o["predicted"] == (o["score"] >= 0.7) and 0 <= o["score"] <= 1 for o in got)
    assert area_under_curve([(o["score"], labels[o["doc_id"]]) for o in got if o["held_out"] and o["doc_id"] in labels]) > 0.93


def test_op6(spark, rows):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()
    got = told(spark, "op6_decontamination")
    for doc_id, n_words, n_hit, found, bad in brute_contamination([(r["doc_id"], r["text"]) for r in rows], items):
        o = got[doc_id]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert (o["n_words"], o["n_hit"], o["n_items"], o["items_sha256"], o["contaminated"]) == (n_words, n_hit, len(found), digest, bad)


def test_op8(spark, rows):
    got = told(spark, "op8_simhash")
    want = brute_components([(r["doc_id"], plain_simhash(r["text"])) for r in rows])
    assert [(d, got[d]["fingerprint"], got[d]["component_id"]) for d, *_ in want] == [(d, f"{f:016x}", c) for d, f, c in want]


def test_op9(spark, rows):
    got = told(spark, "op9_sharding")
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in rows}
    assert set(got) == set(texts)
    by, slots = Counter(), defaultdict(list)
    for d, o in got.items():
        assert (o["size"], o["text_crc32"], o["law"], o["grown_shard"]) == (len(texts[d]) + 1, zlib.crc32(texts[d]), "bytes", None)
        by[o["shard"]] += o["size"]
        slots[o["shard"]].append(o["slot"])
    assert set(by) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(by.values()) - min(by.values()) <= 2 * max(len(t) + 1 for t in texts.values())


def test_op10(spark, rows):
    got = sorted((o["n_bytes"], o["n_removed"], o["n_spans"], o["kept_sha256"]) for o in told(spark, "op10_suffix_dedup").values())
    assert got == brute_repeats([r["text"] for r in rows])


def test_pipeline_stages(spark):
    """What each stage drops, worked out again for its own input."""
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    before = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"lang_pred": F.lit("mine"), "rate": F.lit("r"), "h1": F.lit("h")})
    columns = before.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = materialize(stage(spark, before, SF), f"test-{name}")
        was, now = ([tuple(r) for r in d.select("doc_id", "text").collect()] for d in (before, after))
        assert after.columns == columns and after.where("lang_pred = 'mine' and rate = 'r' and h1 = 'h'").count() == len(now)
        if name == "language_id":
            assert sorted(now) == sorted(x for x in was if any(c.isalpha() for c in x[1] or ""))
        elif name == "near_dedup":
            classes = brute_components([(d, plain_simhash(t)) for d, t in was])
            assert sorted(d for d, _ in now) == sorted({c for *_, c in classes})
        elif name == "decontamination":
            assert sorted(d for d, _ in now) == sorted(d for d, *_, bad in brute_contamination(was, items) if not bad)
        else:
            copies = {r["doc_id"]: r["copies"] for r in mi.mix(before, labels).collect()}
            assert Counter(d for d, _ in now) == Counter({d: c for d, c in copies.items() if c})
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, before, SF).collect()
    assert sorted((r["doc_id"], r["text"]) for r in last) == sorted(now) and {r["shard"] for r in last} <= set(range(16))


def test_nothing_gives_nothing(spark, docs):  # noqa: F811
    none, labels = docs.limit(0), spark.read.parquet(f"{SF}/labels.parquet")
    assert not tc.count_by_section(none).count()
    assert not li.identify_languages(none).count() and not li.drop_unidentified(none).count()
    assert not qu.score_quality(none, qu.fit_rules(none, labels)).count()
    assert not de.drop_contaminated(none, spark.createDataFrame([], "item_id int, text string")).count()
    assert not su.drop_repeated(none).count() and not si.drop_near_duplicates(none).count()


def test_added_names_replace_and_stages_keep(spark, docs):  # noqa: F811
    clash = {"secret_spans", "sections", "lang_pred", "lang_score", "quality_score", "quality_predicted", "repeated", "shard", "slot", "h1", "text_crc32"}
    own = docs.drop(*clash).withColumns({c: F.lit("mine") for c in sorted(clash)})
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    added = {
        "secret_spans": ss.scan_secrets(own), "sections": tc.count_by_section(own), "lang_pred": li.identify_languages(own), "quality_score": qu.score_quality(own, qu.RuleModel()),
        "repeated": su.with_repeated_spans(own), "shard": sh.shard_documents(own, n_shards=2),
    }
    for name, df in added.items():
        assert name in df.columns and df.where(F.col("h1") == "mine").count() == len(ALL_IDS) and ids(df) == ALL_IDS
    items = spark.createDataFrame([(1, "nothing of the kind here at all")], "item_id int, text string")
    kept = [ss.redact_secrets(own), li.drop_unidentified(own), su.drop_repeated(own), si.drop_near_duplicates(own), de.drop_contaminated(own, items), mi.mixed_documents(own, labels)]
    for df in kept:
        assert df.columns == own.columns
        assert {tuple(r) for r in df.select(*sorted(clash)).distinct().collect()} <= {("mine",) * len(clash)}

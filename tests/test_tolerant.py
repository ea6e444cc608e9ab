"""JSON with faults, and the first page of each address in a stream."""

import datetime

from loomframe.sources import tolerant as tl
from loomframe.streaming import pages as st

GOOD = {'{"k": 5}': (5, None, None), '{"k": null, "t": ["a"]}': (None, ["a"], None), '{"z": {"y": 1}, "k": 2}': (2, None, {"z": '{"y":1}'}), "{}": (None, None, None)}
BAD = {
    None: "nothing", "": "nothing", "  ": "nothing", "{": "not JSON", '{"k": 1}x': "not JSON", "1, 2": "not JSON", "[1]": "not an object", '"k"': "not an object", "null": "not an object",
    '{"k": "x"}': "k is not bigint", '{"k": 1, "t": 3}': "t is not array<string>", '{"k": [1]}': "k is not bigint",
}


def test_tolerant(spark):
    texts = [*GOOD, *BAD]
    rows = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)], "id int, raw string, fault string")
    parsed = tl.parse_tolerant(rows, "raw", "k bigint, t array<string>")
    assert parsed.columns == ["id", "raw", "k", "t", "others", "fault"]
    got = {r["raw"]: r for r in parsed.collect()}
    for t, (k, tags, others) in GOOD.items():
        assert (got[t]["k"], got[t]["t"], got[t]["others"], got[t]["fault"]) == (k, tags, others, None), t
    for t, fault in BAD.items():
        assert got[t]["fault"] == fault, t
    good, faulty = tl.split_quarantine(parsed)
    assert good.count() == len(GOOD) and faulty.count() == len(BAD) and "fault" not in good.columns
    counts = {r["fault"]: r["n"] for r in tl.fault_counts(parsed).collect()}
    assert counts[None] == len(GOOD) and counts["nothing"] == 3
    needed = tl.parse_tolerant(rows, "raw", "k bigint", required=("k",)).where("raw = '{}'").first()
    assert needed["fault"] == "k is missing" and not tl.parse_tolerant(rows.limit(0), "raw", "k bigint").count()


def test_each_address_once_in_a_stream(spark, tmp_path):
    """An address in three batches gives one row, also when the stream was stopped and begun again from its checkpoint."""
    source, out, checkpoint = (str(tmp_path / d) for d in ("in", "out", "check"))
    batch = lambda rows: spark.createDataFrame(rows, st.PAGE_SCHEMA + ", fetched_at timestamp").coalesce(1).write.mode("append").parquet(source)
    when = lambda day: datetime.datetime(2026, 1, day)
    batch([(1, "http://ex.org/a?utm_source=x", "first", when(1)), (2, "https://ex.org/b", "b", when(1))])
    for rows in ([(3, "https://ex.org/a#top", "again", when(2))], [(4, "https://EX.org/a", "third", when(3)), (5, "https://ex.org/c", "c", when(3))]):
        st.stream_first_pages(spark, source, out, checkpoint, within="30 days").awaitTermination()
        batch(rows)
    st.stream_first_pages(spark, source, out, checkpoint, within="30 days").awaitTermination()
    found = sorted(tuple(r) for r in spark.read.parquet(out).select("page_id", "html").collect())
    assert found == [(1, "first"), (2, "b"), (5, "c")]
    # Far beyond the delay the address is forgotten, and its state with it.
    batch([(6, "https://ex.org/d", "d", datetime.datetime(2026, 6, 1))])
    st.stream_first_pages(spark, source, out, checkpoint, within="30 days").awaitTermination()
    batch([(7, "https://ex.org/a", "much later", datetime.datetime(2026, 6, 2))])
    st.stream_first_pages(spark, source, out, checkpoint, within="30 days").awaitTermination()
    assert spark.read.parquet(out).where("page_id = 7").count() == 1

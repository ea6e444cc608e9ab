"""Pages as a stream: new page files become token and link tables as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomframe.functions.urls import canon_url
from loomframe.operators.extract import page_links, page_tokens
from loomframe.sources.html import nodes_of, parse_pages

PAGE_SCHEMA = "page_id long, url string, html string"


def stream_pages(spark: SparkSession, path: str, out: str, checkpoint: str, files_per_trigger: int = 1000) -> StreamingQuery:
    """Reads page files once each and appends their links and tokens, batch by batch; ends when all there are are read.

    A batch that is replayed after a failure overwrites its own folder, so no row is written twice.
    """
    pages = spark.readStream.schema(PAGE_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)

    def write(batch: DataFrame, number: int) -> None:
        parsed = parse_pages(batch).persist()
        nodes = nodes_of(parsed)
        links = page_links(nodes, batch).select("page_id", "node", "url", "host", "path", "text", "aside")
        links.write.mode("overwrite").parquet(f"{out}/links/batch={number}")
        page_tokens(nodes).write.mode("overwrite").parquet(f"{out}/tokens/batch={number}")
        parsed.unpersist()

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_pages(pages: DataFrame, time_col: str = "fetched_at", within: str | None = "30 days", url_col: str = "url") -> DataFrame:
    """The pages of a stream without those whose canonical URL came before: the fetch's memo, kept as state of the stream.

    ``within``: an address is remembered for at least so long after its page's time, so state is bounded by the addresses of
    that time; null remembers all for ever. Pages that are later than the newest by more than that are dropped. Pages without a
    usable address are one address, the empty one, and are left out.
    """
    canon = pages.withColumn("canon", canon_url(F.col(url_col))).where("canon <> ''")
    if within is None:
        return canon.dropDuplicates(["canon"])
    return canon.withWatermark(time_col, within).dropDuplicatesWithinWatermark(["canon"])


def stream_first_pages(
    spark: SparkSession, path: str, out: str, checkpoint: str, within: str | None = "30 days", files_per_trigger: int = 1000
) -> StreamingQuery:
    """Appends the first page of each address among the page files at ``path`` to ``out``; ends when all there are are read.

    State and the list of files read are in ``checkpoint``, from which a later call goes on.
    """
    pages = spark.readStream.schema(PAGE_SCHEMA + ", fetched_at timestamp").option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    found = first_pages(pages, within=within)
    return found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()

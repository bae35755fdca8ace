"""New page files flow through the batch stages into the store, once per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import publish, scrape, store
from ..schemas import PAGES

ANALYSED = "analysed"


def read_pages(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of JSON page files: ``article_id, url, html``."""
    reader = spark.readStream.schema(PAGES)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(folder).select(F.col("page_id").alias("article_id"), "url", "html")


def scraped_stream(pages: DataFrame) -> DataFrame:
    """The stateless stages, the same functions as in batch."""
    return pages.transform(scrape.valid_urls).transform(scrape.scrape)


def ingest(
    articles: DataFrame,
    analyse: Callable[[DataFrame], DataFrame],
    base: str,
    checkpoint: str,
    topic: str,
    created_at: Callable[[int], Column],
) -> StreamingQuery:
    """Start the ingest of a stream of scraped articles; it ends when all present files are read.

    ``analyse`` turns a micro-batch into analysed articles; what it finds by comparing articles, such as
    themes, it finds within the batch. The analysed articles, their log rows and the session row of a
    batch go to folders named after the batch id, which are replaced if the batch is repeated. The
    analysed ones are written first and read again, so a lost executor costs no second analysis.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        analysed = analyse(batch)
        run, at = f"batch{batch_id:012d}", created_at(batch_id)
        path = f"{base}/{ANALYSED}/run={run}"
        analysed.write.mode("overwrite").parquet(path)
        rows = publish.store_view(analysed.sparkSession.read.schema(analysed.schema).parquet(path))
        store.save_articles(rows, base, run, at)
        store.save_session(rows, base, run, topic, at)

    return (
        articles.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

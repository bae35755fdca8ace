"""Main text of pages with its headings and lists, chosen by the density of text and links.

The blocks of a page come from one pass over its tags in Arrow batches; what is kept of them, and how it is shown, are
expressions inside the row. There is no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import text
from ..functions.blocks import HEADINGS, page_blocks

BLOCK = "struct<kind string, text string, words int, link_words int, chrome boolean, article boolean, section_words int>"
PAGE_BYTES = 8 << 20  # of pages taken apart at a time
LINK_SHARE = 2  # a block with more than one in so many words linked is a list of links
SECTION_SHARE = 5  # a section with less than one in so many of the best section's words is left out


def with_blocks(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``blocks`` instead of ``html``. A null or empty page has none."""
    kept = [f for f in pages.schema.fields if f.name != html]
    output = T.StructType([*kept, T.StructField("blocks", T.StructType.fromDDL(f"b array<{BLOCK}>")["b"].dataType)])
    arrow = to_arrow_schema(output)
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = max(1, batch.num_rows * PAGE_BYTES // max(PAGE_BYTES, batch.nbytes))
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                blocks = [page_blocks(page.as_py()) for page in part.column(html)]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(n) for n in names), pa.array(blocks, arrow.field("blocks").type)], names=[*names, "blocks"]
                )

    return pages.select(*names, html).mapInArrow(run, output)


def main_blocks(blocks: Column) -> Column:
    """The blocks of the main text.

    Candidates are no page chrome and have few links. Those in an article are the text, if there are any. Otherwise it is
    the candidates of sections with nearly as many words as the best one, and headings right before them.
    """

    def by_density(own: Column) -> Column:
        best = F.array_max(F.transform(own, lambda b: b["section_words"]))

        def is_dense(b: Column) -> Column:
            return b["section_words"] * SECTION_SHARE >= best

        def is_kept(b: Column, i: Column) -> Column:
            leads = b["kind"].isin(*HEADINGS) & F.coalesce(is_dense(F.get(own, i + 1)), F.lit(False))
            return is_dense(b) | leads

        return F.filter(own, is_kept)

    def choose(own: Column) -> Column:
        within = F.filter(own, lambda b: b["article"])
        return text.bind(within, lambda w: F.when(F.size(w) > 0, w).otherwise(by_density(own)))

    few_links = F.filter(blocks, lambda b: ~b["chrome"] & (b["link_words"] * LINK_SHARE <= b["words"]))
    return text.bind(few_links, choose)


def marked(blocks: Column) -> Column:
    """One line a block: headings after ``#`` by their level, items after ``-``, quotes after ``>``."""

    def line(b: Column) -> Column:
        level = F.when(b["kind"].isin(*HEADINGS), F.concat(F.repeat(F.lit("#"), F.substring(b["kind"], 2, 1).cast("int")), F.lit(" ")))
        sign = F.when(b["kind"] == "li", "- ").when(b["kind"] == "quote", "> ").otherwise("")
        return F.concat(F.coalesce(level, sign), b["text"])

    return F.array_join(F.transform(blocks, line), "\n")


def formatted_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``text``, ``n_blocks`` and ``n_kept`` instead of ``html``; '' where a page has no text."""
    found = with_blocks(pages, html)
    kept = text.bind(
        main_blocks(F.col("blocks")),
        lambda own: F.struct(marked(own).alias("text"), F.size("blocks").alias("n_blocks"), F.size(own).alias("n_kept")),
    )
    return text.add_columns_once(found, kept).drop("blocks")

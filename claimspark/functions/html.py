"""Main text and metadata of an HTML page, as regular expressions on Columns."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind, collapse_ws

# Character references replaced in extracted text; `&amp;` must come last.
ENTITIES = [
    ("&nbsp;", " "),
    ("&middot;", "·"),
    ("&copy;", "©"),
    ("&reg;", "®"),
    ("&euro;", "€"),
    ("&hellip;", "…"),
    ("&ndash;", "–"),
    ("&mdash;", "—"),
    ("&lsquo;", "‘"),
    ("&rsquo;", "’"),
    ("&ldquo;", "“"),
    ("&rdquo;", "”"),
    ("&quot;", '"'),
    ("&apos;", "'"),
    ("&#39;", "'"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&amp;", "&"),
]
# Every pattern matches from the first opening mark on, an unclosed element reaching to the end of
# the page, and no tag reaches over another opening bracket. So a page is read in linear time
# however broken it is.
ARTICLE = r"(?is)<article\b[^<>]*>(.*?)(?:</article>|\z)"
BODY = r"(?is)<body\b[^<>]*>(.*?)(?:</body>|\z)"
INVISIBLE = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script>|\z)|<style\b.*?(?:</style>|\z)"
CHROME = (
    r"(?is)<title\b.*?(?:</title>|\z)|<nav\b.*?(?:</nav>|\z)|<header\b.*?(?:</header>|\z)|"
    r"<footer\b.*?(?:</footer>|\z)|<aside\b.*?(?:</aside>|\z)"
)
TITLE = r"(?is)<title\b[^<>]*>(.*?)(?:</title>|</head>|<body\b|\z)"
TAG = r"<[^<>]*>"


def decode_entities(c: Column) -> Column:
    pairs = F.from_json(F.lit(json.dumps(ENTITIES)), "array<array<string>>")
    return F.aggregate(pairs, c, lambda done, pair: F.replace(done, pair[0], pair[1]))


def _plain(markup: Column) -> Column:
    return collapse_ws(decode_entities(F.regexp_replace(markup, TAG, " ")))


def main_text(html: Column) -> Column:
    """The text of the first article element; without one, of the body minus page chrome."""
    visible = F.regexp_replace(html, INVISIBLE, " ")
    return bind(
        visible,
        lambda v: _plain(
            F.coalesce(
                F.nullif(F.regexp_extract(v, ARTICLE, 1), F.lit("")),
                F.regexp_replace(
                    F.coalesce(F.nullif(F.regexp_extract(v, BODY, 1), F.lit("")), v), CHROME, " "
                ),
            )
        ),
    )


def title(html: Column) -> Column:
    return F.coalesce(_plain(F.regexp_extract(html, TITLE, 1)), F.lit(""))


def _meta_tag(names: str) -> str:
    return rf"(?is)<meta\b[^<>]*\b(?:name|property)\s*=\s*[\"'](?:{names})[\"'][^<>]*>"


CONTENT_ATTRIBUTE = r"(?is)\bcontent\s*=\s*(?:\"([^\"]*)\"|'([^']*)')"
META = {
    "description": _meta_tag("description|og:description"),
    "author": _meta_tag("author|article:author"),
    "date": _meta_tag("date|article:published_time|pubdate"),
}


def meta(html: Column, field: str) -> Column:
    """The content of a meta element, whatever the order of its attributes; '' if absent."""
    tag = F.regexp_extract(html, META[field], 0)
    value = F.concat(
        F.regexp_extract(tag, CONTENT_ATTRIBUTE, 1), F.regexp_extract(tag, CONTENT_ATTRIBUTE, 2)
    )
    return F.coalesce(collapse_ws(decode_entities(value)), F.lit(""))

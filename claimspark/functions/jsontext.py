"""JSON inside free text: find it, and parse it strictly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

FENCE = "```"


def _fenced(text: Column, opening: str) -> Column:
    """What stands between the first ``opening`` and the fence after it; null if either is absent."""
    start = F.position(F.lit(opening), text)
    inside = start + len(opening)
    end = F.position(F.lit(FENCE), text, inside)
    return F.when((start > 0) & (end > 0), strip(F.substr(text, inside, end - inside)))


def _braced(text: Column) -> Column:
    """From the first opening to the last closing brace; null if not in that order."""
    first = F.instr(text, "{")
    from_end = F.position(F.lit("}"), F.reverse(text))
    last = F.length(text) - from_end + 1
    return F.when(
        (first > 0) & (from_end > 0) & (last > first), F.substr(text, first, last - first + 1)
    )


def extract_json(text: Column) -> Column:
    """JSON text of a response: a json fence, any fence, outermost braces, or all of it."""
    return F.coalesce(_fenced(text, FENCE + "json"), _fenced(text, FENCE), _braced(text), strip(text))


def strict_variant(json_text: Column) -> Column:
    """``[value, sentinel]`` as a variant, or null unless the text is exactly one JSON value.

    The JSON reader stops after the first value, so trailing text would pass. Wrapped in an
    array in front of a sentinel, anything but one whole value moves or loses the sentinel.
    The sentinel is a digest of the text, so the text cannot contain it.
    """
    sentinel = F.md5(json_text)
    wrapped = F.try_parse_json(F.concat(F.lit("["), json_text, F.lit(',"'), sentinel, F.lit('"]')))
    in_place = F.try_variant_get(wrapped, "$[1]", "string") == sentinel
    return F.when(in_place & F.try_variant_get(wrapped, "$[2]", "variant").isNull(), wrapped)

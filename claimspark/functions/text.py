"""Whitespace, case, title, sentence and token helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Every Unicode white-space character and the four ASCII separators 0x1C-0x1F.
WHITESPACE = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"
SENTENCE_END = "[.!?]+"
_WORD = r"\p{L}\p{N}"
_CASED_RUNS = r"([\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+)"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def add_columns_once(df: DataFrame, values: Column) -> DataFrame:
    """``df`` with the fields of the struct ``values``, which is computed once per row.

    A filter on a plainly added column is pushed below the projection and computes the column
    again there. It cannot pass a generator, and the optimizer does not copy one either.
    """
    return df.select("*", F.inline(F.array(values)))


def collapse_ws(c: Column) -> Column:
    """Runs of white space become one blank; none is left at either end."""
    return F.trim(F.regexp_replace(c, f"{WHITESPACE}+", " "))


def strip(c: Column) -> Column:
    """White space removed from both ends, kept inside.

    The look-behind lets only the start of a run try to reach the end, so long runs stay cheap.
    """
    return F.regexp_replace(c, rf"^{WHITESPACE}+|(?<!{WHITESPACE}){WHITESPACE}+\z", "")


def is_blank(c: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return ~F.coalesce(F.regexp_like(c, F.lit(rf"[^\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]")), F.lit(False))


def cut(c: Column, limit: int, mark: str = "") -> Column:
    """Text of at most ``limit`` characters, with ``mark`` appended where something was cut."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(mark))).otherwise(c)


def clean_content(c: Column, min_chars: int = 100, max_chars: int = 5000) -> Column:
    """White space collapsed; too short becomes empty, too long is cut and marked."""
    return bind(
        collapse_ws(F.coalesce(c, F.lit(""))),
        lambda t: F.when(F.length(t) < min_chars, F.lit("")).otherwise(cut(t, max_chars, "...")),
    )


def title_case(c: Column) -> Column:
    """Upper case at the start of each run of cased letters, lower case in the rest of it."""
    runs = F.regexp_extract_all(c, F.lit(_CASED_RUNS), F.lit(1))
    return F.array_join(
        F.transform(
            runs,
            lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substr(r, F.lit(2)))),
        ),
        "",
    )


def url_title(url: Column) -> Column:
    """A readable title from a url: last path segment if it has no dot, else the host."""
    last = F.element_at(F.split(url, "/"), -1)
    after_scheme = F.try_element_at(F.split(url, "//"), F.lit(2))
    host = F.element_at(F.split(after_scheme, "/"), 1)
    words = F.replace(F.replace(last, F.lit("-"), F.lit(" ")), F.lit("_"), F.lit(" "))
    named = (last != "") & ~F.contains(last, F.lit("."))
    return (
        F.when(named, title_case(words))
        .when(host.isNotNull(), title_case(F.replace(host, F.lit("www."), F.lit(""))))
        .otherwise(F.lit("Untitled"))
    )


def is_web_url(url: Column) -> Column:
    return F.coalesce(url.startswith("http://") | url.startswith("https://"), F.lit(False))


def sentences(c: Column) -> Column:
    """Stripped pieces between runs of sentence-ending marks, empty ones included."""
    return F.transform(F.split(c, SENTENCE_END), strip)


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.array_remove(F.split(F.lower(c), f"[^{_WORD}]+"), "")


def token_counts(words: Column) -> Column:
    """Map of the distinct tokens of a list to their counts.

    In the sorted list equal tokens are neighbours, and a back reference finds each run of them
    in one pass; the length of a run gives its count.
    """
    joined = F.array_join(F.sort_array(words), " ")
    runs = F.regexp_extract_all(joined, F.lit(r"([^ ]+)(?: \1(?![^ ]))*+"), F.lit(0))

    def token(run: Column) -> Column:
        return F.substring_index(run, " ", 1)

    def count(run: Column) -> Column:
        return (F.length(run) + 1) / (F.length(token(run)) + 1)

    return bind(runs, lambda r: F.map_from_arrays(F.transform(r, token), F.transform(r, count)))


def normalised(c: Column) -> Column:
    """Lower-case words joined by single blanks: the key for exact text matches."""
    return F.trim(F.regexp_replace(F.lower(c), f"[^{_WORD}]+", " "))

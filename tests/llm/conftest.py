"""Small tables with awkward rows for every operator of the subpackage."""

import re
from collections import Counter

import pytest

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    """A-Z only."""
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(lower(text))


LINE = "Shared words stand here on every page of the site, and nobody reads them twice in a row today."
LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(30_000))
TEXTS = [
    None,
    "",
    " \n\t ",
    "!!! ...",
    "one",
    "a b c",
    LINE,
    LINE,
    "x" * 5000,
    "Ünïcödé wörds, 日本語 und 😀 emoji\x00\x7f▁ end",
    LONG,
    LONG,
    LINE + "\n" + LINE + "\n\n" + LONG[:3000],
    LONG[:3000] + " changed " + LONG[3000:3400],
    "tie tie tie tie tie tie tie tie tie tie tie tie tie tie tie tie tie tie",
]
# Names that operators add or use inside, as columns of the input.
CLASHES = (
    "n_words Items hit_spans size shard slot unit pieces n_lines class_row in_class label a b bands node score features "
    "prediction lang_pred ids decoded n_tokens base_score kept n_removed_words spans n_bytes token key _text _row _key _a"
).split()


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in any column, empty and long texts, repeated rows, clashing names."""
    rows = [(None if i == 3 else i, t, None if i % 5 == 4 else f"s{i % 3}", None if i % 4 == 3 else "en") for i, t in enumerate(TEXTS)]
    rows += [rows[6], rows[10], rows[0]]
    names = ", ".join(f"`{c}` string" for c in CLASHES)
    blank = ["was here"] * len(CLASHES)
    return spark.createDataFrame([(*r, *blank) for r in rows], f"doc_id long, text string, source string, lang string, {names}")


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang", "source")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.collect()}


@pytest.fixture(scope="session")
def others():
    """What operators must leave of the clashing columns, given those they add."""

    def check(out, *new):
        assert all(n == 1 for n in Counter(c.lower() for c in out.columns).values())
        added = {n.lower() for n in new}
        wanted = {c for c in CLASHES if not c.startswith("_") and c.lower() not in added}
        assert wanted <= set(out.columns)
        values = {v for r in out.select(*sorted(wanted)).distinct().collect() for v in r}
        assert values <= {"was here"}

    return check

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from claimspark.functions import jsontext, text
from claimspark.operators import claims, summarize


def test_url_filter(one):
    urls = ["http://a", "https://a", "HTTP://a", "ftp://a", "", " http://a", None]
    assert one(text.is_web_url, urls) == [True, True, False, False, False, False, False]


def test_clean_content_limits(one):
    texts = [None, "", "a" * 99, "a" * 100, "a" * 5000, "a" * 5001, "a" * 60 + " " * 200 + "b" * 39]
    cleaned = one(text.clean_content, texts)
    assert cleaned[:3] == ["", "", ""]
    assert cleaned[3] == "a" * 100
    assert len(cleaned[4]) == 5000
    assert cleaned[5] == "a" * 5000 + "..."
    assert cleaned[6] == "a" * 60 + " " + "b" * 39


def test_white_space_is_unicode(one):
    assert one(text.collapse_ws, ["\x1f　a \x85b \x0bc "]) == ["a b c"]


@pytest.mark.parametrize(
    ("url", "title"),
    [
        ("https://x.org/gmo-is_bad", "Gmo Is Bad"),
        ("https://www.x.org/a.html", "X.Org"),
        ("https://x.org/a/", "X.Org"),
        ("https://x.org/825?page=2", "825?Page=2"),
        ("https://x.org", "X.Org"),
        ("abc.def", "Untitled"),
        ("abc", "Abc"),
        ("https://x.org/bad's-day", "Bad'S Day"),
        (None, "Untitled"),
    ],
)
def test_url_title(one, url, title):
    assert one(text.url_title, [url]) == [title]


def test_claims(one):
    twenty, one_more = "a" * 20, "a" * 21
    seven = ". ".join(f"this is the long sentence number {i}" for i in range(7))
    got = one(
        claims.claim_list,
        ["", "Short. Tiny!", twenty + ".", one_more + ".", seven, "Value is 3.14 in this long sentence"],
    )
    assert got[0] == [""]
    assert got[1] == ["Short. Tiny!"]
    assert got[2] == [twenty + "."]
    assert got[3] == [one_more]
    assert got[4] == [f"this is the long sentence number {i}" for i in range(5)]
    assert got[5] == ["14 in this long sentence"]


FENCE = "```"


@pytest.mark.parametrize(
    ("response", "found"),
    [
        (f'{FENCE}json\n{{"a":1}}\n{FENCE}', '{"a":1}'),
        (f'{FENCE}\n{{"a":1}}\n{FENCE}', '{"a":1}'),
        (f'{FENCE}json\n{{"a":1}}', '{"a":1}'),
        ('Sure: {"a":{"b":1}} done', '{"a":{"b":1}}'),
        ("}{", "}{"),
        (" plain ", "plain"),
        (f'x {FENCE}json {{"a":1}} {FENCE} y {FENCE} {{"b":2}} {FENCE}', '{"a":1}'),
        (f"{FENCE}one{FENCE}json two", "one"),
    ],
)
def test_extract_json(one, response, found):
    assert one(jsontext.extract_json, [response]) == [found]


def test_strict_json(one):
    good = ['{"a":1}', "[1]", "null", "3", '"x"', '{"a":1,"a":2}']
    bad = ["", "{bad", "{'a':1}", '{"a":1} x', "{}{}", "1],[2", '{"a":1,}', '1],"~end~"],[2']
    accepted = one(lambda c: jsontext.strict_variant(c).isNotNull(), good + bad)
    assert accepted == [True] * len(good) + [False] * len(bad)


def plain_summary(body: str) -> str | None:
    """The summary rule in plain words, for the check of the column expression."""
    words = re.findall(r"\w+", body.lower())
    scored = []
    for pos, sentence in enumerate(re.split(r"[.!?]+", body)):
        own = re.findall(r"\w+", sentence.lower())
        if own:
            scored.append((-round(sum(map(words.count, own)) / len(own), 6), pos, sentence.strip()))
    chosen = sorted((pos, sentence) for _, pos, sentence in sorted(scored)[:3])
    return ". ".join(s for _, s in chosen) + "." if chosen else None


words = st.sampled_from(["a", "ab", "abc", "b", "ba", "zz", "."])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(words, max_size=40).map(" ".join), min_size=5, max_size=20))
def test_summary_agrees_with_plain_python(one, bodies):
    got = one(summarize.extractive_summary, bodies)
    assert got == [plain_summary(b) for b in bodies]

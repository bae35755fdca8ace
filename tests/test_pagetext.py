"""Main text of pages against a tree of plain Python."""

import time
from html.parser import HTMLParser

import duckdb
import pytest

from claimspark.functions.blocks import BLOCKS, CHROME, ENDED_BY, KINDS, SECTIONS, page_blocks
from claimspark.operators import pagetext


class Node:
    def __init__(self, name, up):
        self.name, self.up, self.children = name, up, []


class Tree(HTMLParser):
    """A tree of block elements, links and texts; hidden elements are left out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", None)
        self.hidden = None

    def block(self):
        node = self.at
        while node.name == "a":
            node = node.up
        return node

    def handle_starttag(self, name, attrs):
        if name in ("script", "style"):
            self.hidden = name
        elif name == "br":
            self.at.children.append(" ")
        elif name in BLOCKS or name == "a":
            if name != "a":
                for ends in ({"p"}, ENDED_BY.get(name, set())):
                    while self.block().name in ends:
                        self.at = self.block().up
            node = Node(name, self.at)
            node.classes = set((dict(attrs).get("class") or "").split())
            self.at.children.append(node)
            self.at = node

    def handle_endtag(self, name):
        if name == self.hidden:
            self.hidden = None
        if name == "a" and self.at.name != "a":
            return
        node = self.at
        while node is not None and node.name != name:
            node = node.up
        if node is not None:
            self.at = node.up

    def handle_data(self, data):
        if not self.hidden:
            self.at.children.append(data)


def tree_blocks(page):
    parser = Tree()
    parser.feed(page)
    parser.close()
    found, text, links = [], [], []

    def end(kind, chrome, article):
        words = "".join(text).split()
        if words:
            found.append((kind, " ".join(words), len("".join(links).split()), chrome, article))
        text.clear()
        links.clear()

    def walk(node, kind, chrome, article, linked):
        for child in node.children:
            if isinstance(child, str):
                text.append(child)
                if linked:
                    links.append(child)
            elif child.name == "a":
                links.append(" ")
                walk(child, kind, chrome, article, True)
            else:
                end(kind, chrome, article)
                inner = KINDS.get(child.name, "text" if child.name in SECTIONS else kind)
                here = article or child.name == "article"
                hides = chrome or child.name in CHROME or "ad" in child.classes
                walk(child, inner, hides, here, linked)
                end(inner, hides, here)

    walk(parser.root, "text", False, False, False)
    return found


def shown(page):
    return [(b["kind"], b["text"], b["link_words"], b["chrome"], b["article"]) for b in page_blocks(page)]


def test_blocks_equal_those_of_a_tree_on_all_pages(small):
    pages = duckdb.sql(f"SELECT html FROM '{small}/pages.parquet'").fetchall()
    assert pages
    for (page,) in pages:
        assert shown(page) == tree_blocks(page)
        lists = page.replace("<p>", "<li>", 3).replace("</p>", "", 5).replace("<b>", "<ul><li><a href='x'>linked</a> ")
        assert shown(lists) == tree_blocks(lists)


def test_kinds_links_and_broken_marks():
    page = (
        "<h2>A &amp; b</h2><ul><li>one<li><a href=x>two</a> more</ul><blockquote>said</blockquote><table><tr><th>k<td>v<tr><td>l</td><td>w</td></table>"
        "un<b>bro</b>ken<br>line </div> a < b <!-- gone --> <a href=y>open<p>next"
    )
    assert [(b["kind"], b["text"], b["link_words"]) for b in page_blocks(page)] == [
        ("h2", "A & b", 0), ("li", "one", 0), ("li", "two more", 1), ("quote", "said", 0), ("row", "k | v", 0), ("row", "l | w", 0),
        ("text", "unbroken line a < b open", 1), ("text", "next", 1),
    ]
    assert page_blocks(None) == page_blocks("") == page_blocks(" <p> </p><!-- x") == []
    assert [b["text"] for b in page_blocks("a<script>b</scr")] == ["a"]


@pytest.mark.parametrize("piece", ["<", "<div>", "<p><b>", "</p>", "<a href=", "<li><div>", "<!--", "<script>", '<div class="', "<td>", "<x "])
def test_broken_pages_take_linear_time(piece):
    def seconds(n):
        started = time.perf_counter()
        page_blocks(piece * n + "x")
        return time.perf_counter() - started

    seconds(1000)
    assert seconds(200_000) < 5.0


LONG = " ".join(f"word{i}" for i in range(40))


def test_main_text_by_density(spark):
    links = "".join(f"<li><a href='/{i}'>Place {i}</a></li>" for i in range(20))
    story = f"<h1>Head</h1><p>{LONG}</p><h2>Part</h2><ul><li>first</li><li>second</li></ul><p>{LONG} <a href=z>see</a></p>"
    pages = {
        1: f"<body><ul>{links}</ul><div class='sidebar'>{LONG}</div><div id=story>{story}</div><div>few words</div></body>",
        2: f"<body><div>{LONG}</div><main><header><h1>Head</h1></header><p>only this</p></main></body>",
        3: f"<body><h1>Head</h1><div>{LONG}</div></body>",
        4: "<body><nav>x</nav></body>",
        5: None,
        6: "",
        7: "no marks at all",
    }
    df = spark.createDataFrame([(k, f"u{k}", v) for k, v in pages.items()], "article_id long, url string, html string")
    found = {r["article_id"]: r for r in pagetext.formatted_text(df).collect()}
    assert found[1]["text"] == f"# Head\n{LONG}\n## Part\n- first\n- second\n{LONG} see"
    assert found[2]["text"] == "# Head\nonly this"
    assert found[3]["text"] == f"# Head\n{LONG}"
    assert [found[k]["text"] for k in (4, 5, 6, 7)] == ["", "", "", "no marks at all"]
    assert [found[5]["n_blocks"], found[5]["n_kept"], found[4]["n_blocks"]] == [0, 0, 1]
    assert pagetext.formatted_text(df.limit(0)).count() == 0


def test_other_columns_stay(spark):
    df = spark.createDataFrame([(1, "<p>a", "keep", 2)], "page_id long, page string, blocks_of string, n int")
    assert [r.asDict() for r in pagetext.formatted_text(df, "page").collect()] == [
        {"page_id": 1, "blocks_of": "keep", "n": 2, "text": "a", "n_blocks": 1, "n_kept": 1}
    ]

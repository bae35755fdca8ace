"""URL filters, ranked search and the Merkle manifest against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimspark.llm import merkle, queries, search, urls

from .conftest import CLASHES, LINE, lower

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


# --- urls ------------------------------------------------------------------------------------


def brute_parts(url):
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (lower(found[1]), found[2]) if found else ("", "")


def brute_rule(host, path):
    fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


URLS = [
    None, "", "no scheme", "://", "http://", "http://COM", "http://com/", "http://Example.COM/en/x", "http://example.com/EN/x",
    "https://www.example.com/en/1?x=/es/", "https://a.www.example.com/en/", "https://notexample.com/en/", "ftp://x.net/es/#a",
    "http://net/fr/", "http://x.net?/es/", "http://x.net#/es/", "http://x.org/a://b.net/es/", "a://b://c/d", "http://x.net/es",
    "http://ünï.net/fr/é\n/x", "http://" + "casino." * 20_000 + "com/" + "p/" * 20_000,
]


@pytest.fixture(scope="module")
def model(spark):
    return urls.learn(urls.labelled_urls(spark))


def test_parts_and_rules_equal_brute_force(spark, model):
    clashing = ("host", "Path", "verdict", "_host", "_rest", "_features", "prediction", "_probability", "label", "features")
    names = ", ".join(f"`{c}` string" for c in clashing)
    table = spark.createDataFrame([(i, u, *["was here"] * len(clashing)) for i, u in enumerate(URLS)] * 2, f"page_id long, url string, {names}")
    rows = urls.judge(table, model).collect()
    assert len(rows) == 2 * len(URLS)
    for r in rows:
        host, path = brute_parts(r["url"])
        rule = brute_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule.name)
        assert r["verdict"] == (rule.verdict if rule else "block" if r["url_score"] >= urls.THRESHOLD else "allow")
        assert {r[c] for c in clashing[3:]} == {"was here"}
    assert Counter(c.lower() for c in rows[0].asDict()).most_common(1)[0][1] == 1
    assert urls.judge(table.where("false"), model).count() == 0


def test_scores_are_those_of_the_weights(spark, model):
    tf = urls.HashingTF(numFeatures=urls.BUCKETS)
    weights, base = model.regression.coefficients.toArray(), model.regression.intercept

    def grams(mark, text):
        own = f"{mark}{text}{mark}" if text else ""
        return [mark + " ".join(own[i : i + n]) for n in urls.GRAMS for i in range(len(own) - n + 1)]

    some = [u for u in URLS if u is None or len(u) < 1000]
    table = spark.createDataFrame([(u,) for u in some], "url string")
    for r in urls.judge(table, model).collect():
        host, path = brute_parts(r["url"])
        cells = {tf.indexOf(g) for g in grams("<", host) + grams(">", re.sub("[0-9]+", "0", lower(path)))}
        assert r["url_score"] == pytest.approx(1 / (1 + math.exp(-base - sum(weights[c] for c in cells))), abs=1e-9)


def test_regression_generalises_to_names_it_has_not_seen(spark):
    table = urls.labelled_urls(spark)
    fold = F.pmod(F.xxhash64(urls.host(F.col("url"))), F.lit(4))
    right = Counter()
    for k in range(2):
        out = urls.judge(table.where(fold == k), urls.learn(table.where(fold != k)), rules=())
        for r in out.collect():
            right[r["label"], (r["verdict"] == "block") == (r["label"] == 1)] += 1
    assert right[0, True] >= 0.85 * (right[0, True] + right[0, False])
    assert right[1, True] >= 0.6 * (right[1, True] + right[1, False])


def test_unwanted_hosts_of_the_pages(spark, small):
    rows = queries.REGISTRY["op11_urls"](spark, "/root/testdata/sf0.1").where("rule is null").collect()
    bad = re.compile(r"(adult|spam|pills|ads-|casino|bets)")
    assert any(bad.search(r["host"]) for r in rows)
    assert all((r["verdict"] == "block") == bool(bad.search(r["host"])) for r in rows)


def test_models_without_both_labels(spark):
    table = spark.createDataFrame([("http://a.org/", None), (None, 1), ("http://b.org/", 1)], "url string, label int")
    judged = lambda labelled: urls.judge(table, urls.learn(labelled)).collect()
    assert {r["url_score"] for r in judged(table)} == {1.0}
    assert {r["verdict"] for r in judged(table.where("false"))} == {"allow"}


# --- search ----------------------------------------------------------------------------------


def brute_search(docs, items, k):
    terms = [(name, Counter(TERM.findall(lower(text)))) for name, text in docs]
    terms = [(name, c) for name, c in terms if c]
    total, n_docs = sum(sum(c.values()) for _, c in terms), len(terms)
    df = Counter(t for _, c in terms for t in c)
    out = []
    for item, text in items:
        own, scores = set(TERM.findall(lower(text))), []
        for name, c in terms:
            m = 50 + (50 * sum(c.values()) * n_docs) // total
            weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in own if t in c}
            score = sum(w * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t, w in weight.items())
            if score > 0:
                scores.append((-score, name is None, name or 0, name))
        out += [(item, i + 1, s[3], -s[0]) for i, s in enumerate(sorted(scores)[:k])]
    return Counter(out)


@pytest.mark.parametrize("block", [search.BLOCK_TERMS, 100])
def test_search_equals_brute_force(spark, small, documents, texts, block):
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    out = search.search(documents, items, k=20, block_terms=block).collect()
    brute = brute_search(list(texts.items()), [(r["item_id"], r["text"]) for r in items.collect()], 20)
    assert Counter(map(tuple, out)) == brute


def test_search_of_awkward_rows(spark, edge):
    items = [(1, None), (2, ""), (3, "One W5X5"), (None, "tie Tie wörds"), (5, LINE), (5, LINE), (7, "!!"), (8, "absent")]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("was here"))
    rows = [(r["doc_id"], r["text"]) for r in edge.select("doc_id", "text").collect()]
    for k in (3, 50):
        out = search.search(edge, table, k=k)
        assert out.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
        assert Counter(map(tuple, out.collect())) == brute_search(rows, items, k)
    assert search.search(edge.where("false"), table).collect() == []
    assert search.search(edge, table.where("false")).collect() == []
    assert search.search(edge.where("text = ''"), table).collect() == []


def test_shared_sums_are_exact_and_save_additions():
    rng = np.random.default_rng(5)
    common = [list(range(10)), list(range(10, 25)), [30, 31]]
    items = [sorted({*common[i % 3], *common[i % 2], *rng.integers(40, 400, 5).tolist()}) for i in range(60)]
    sums = search.share(items, 400)
    parts = rng.integers(0, 1 << 40, (400, 17))
    assert (search.totals(sums, parts) == np.stack([parts[own].sum(axis=0) for own in items])).all()
    assert sums.additions() < 0.5 * sum(len(own) - 1 for own in items)
    alone = search.share([[3], [2, 1]], 4)
    assert alone.levels == [] and search.totals(alone, parts[:4]).tolist() == [parts[3].tolist(), (parts[1] + parts[2]).tolist()]


def test_best_rows_of_a_task_keep_ties_by_key():
    import pyarrow as pa

    best = search._Best(1, 2, pa.int64())
    for keys in ([5, None, 9], [7, 3, None]):
        best.put(np.array([[4, 4, 4]]), pa.array(keys, pa.int64()))
    best.cut()
    assert best.rows[2].to_pylist() == [3, 5] and best.floor.tolist() == [4]


# --- manifest --------------------------------------------------------------------------------


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_tree(hashes):
    """The root, and for each leaf the (before, after) of every level."""
    nodes, paths = list(hashes), [[] for _ in hashes]
    at = list(range(len(hashes)))
    while len(nodes) > 1:
        for leaf, i in enumerate(at):
            run = nodes[i - i % 16 : i - i % 16 + 16]
            paths[leaf].append(("".join(run[: i % 16]), "".join(run[i % 16 + 1 :])))
            at[leaf] = i // 16
        nodes = [h("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
    return nodes[0], paths


def brute_manifest(rows):
    """``rows``: key, group, leaf, tampered."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
        trees.append(brute_tree([r[2] for r in groups[g]]))
    root, above = brute_tree([t[0] for t in trees])
    out = Counter()
    for g, (subroot, paths), upper in zip(names, trees, above, strict=True):
        for (key, _, leaf, other), path in zip(groups[g], paths, strict=True):
            folded = other or leaf
            for before, after in path + upper:
                folded = h(before + folded + after)
            out[key, leaf, subroot, root, h("".join(b + a for b, a in path + upper)), folded, folded == root] += 1
    return out


def test_blocks_end_at_their_own_root():
    names = [h(str(i)) for i in range(300)]
    assert merkle.block_levels(names[:1], True) == [names[:1]]
    assert [len(x) for x in merkle.block_levels(names, True)] == [300, 19, 2, 1]
    assert [len(x) for x in merkle.block_levels(names[:1], False)] == [1, 1, 1, 1]


@pytest.mark.parametrize("sizes", [(16, 1), (17, 3, 255, 257), (4500, 40), (2,) * 600])
def test_manifest_equals_brute_force(spark, sizes):
    rows = [(i, None if g == 1 else f"g{g % 7}ü{g}", h(f"{g} {i}"), h("x") if i % 5 == 0 else None) for g, n in enumerate(sizes) for i in range(n)]
    table = spark.createDataFrame(rows, "doc_id long, source string, a string, b string")
    out = merkle.manifest(table, F.col("a"), F.col("b"), rows_of_a_task=300, local=1)  # blocks of 16: many rounds on few rows
    assert Counter(map(tuple, out.collect())) == brute_manifest(rows)


def test_manifest_of_awkward_rows(spark, edge):
    def value(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    own = [F.col(c) for c in ("doc_id", "source", "text")]
    table = edge.where("text is null or length(text) < 100000")
    rows = []
    for r in table.select(*own).collect():
        leaf, bad = (h("".join(map(value, (r["doc_id"], r["source"], t)))) for t in (r["text"], lower(r["text"]) if r["text"] is not None else None))
        rows.append((r["doc_id"], r["source"], leaf, bad if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 else None))
    leaf = merkle.digest(*map(merkle.field, own))
    low = merkle.digest(*map(merkle.field, own[:2]), merkle.field(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, low)
    assert set(CLASHES) <= set(table.columns)
    out = merkle.manifest(table, leaf, tampered)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(map(tuple, out.collect())) == brute_manifest(rows)
    assert merkle.manifest(table.where("false"), leaf, tampered).collect() == []
    one = merkle.manifest(table.where("doc_id = 4"), leaf, F.lit(None).cast("string")).collect()[0]
    assert one["root"] == one["leaf"] == one["subroot"] and one["proof_sha256"] == h("") and one["verified"]

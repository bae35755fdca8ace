"""Line dedup, near duplicates, language model, quality rules, repeats and the pipeline."""

import hashlib
import os
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from claimspark.llm import arrays, components, hmm, linededup, minhash, quality, queries, repeats, sql
from claimspark.llm.tables import ROW

from .conftest import TOKEN, lower, words

WS = " \t\n\x0b\x0c\r"


@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_query_equals_its_sql(spark, small, name):
    db = duckdb.connect()
    for table in ("documents", "benchmark", "labels"):
        path = f"{small}/{table}.parquet"
        db.sql(f"create view {table} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    want = db.sql(sql.ORACLES[name])
    got = queries.REGISTRY[name](spark, small)
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(want.columns)
    rows = lambda found: Counter(tuple(r) for r in found)
    assert rows(got.select(columns).collect()) == rows(want.select(*columns).fetchall())


# --- lines -----------------------------------------------------------------------------------


def brute_line_dedup(rows, sites):
    normal = lambda line: " ".join(TOKEN.findall(line))
    spread, first = defaultdict(set), {}
    for i, (text, site) in enumerate(rows):
        for k, line in enumerate((text or "").split("\n")):
            if normal(line):
                spread[normal(line)].add(site)
                first.setdefault(normal(line), (i, k))
    out = []
    for i, (text, _) in enumerate(rows):
        lines = (text or "").split("\n")
        gone = [bool(normal(x)) and len(spread[normal(x)]) >= sites and first[normal(x)] != (i, k) for k, x in enumerate(lines)]
        kept = "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)
        out.append((0 if text is None else len(lines), sum(gone), kept if text is not None else None))
    return out


def test_line_dedup_equals_brute_force_near_the_limit(spark):
    rows = [(f"unique {i}\nshared by {i % 7}\n\n  on  {i % 30}\ttwo \nall", f"site{i * 7 % 31}") for i in range(240)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, source string").coalesce(1)
    for sites in (8, 20):
        out = {r["doc_id"]: (r["n_lines"], r["n_removed_lines"], r["text"]) for r in linededup.dedup_lines(df, min_sites=sites).collect()}
        assert [out[i] for i in range(len(rows))] == brute_line_dedup(rows, sites)


def test_line_dedup_of_awkward_rows(edge, others):
    out = linededup.dedup_lines(edge.coalesce(1), min_sites=2)
    others(out, "n_lines", "n_removed_lines")
    got = Counter((r["n_lines"], r["n_removed_lines"], r["text"]) for r in out.collect())
    rows = [(r["text"], r["source"]) for r in edge.coalesce(1).collect()]
    assert got == Counter(brute_line_dedup(rows, 2))
    assert linededup.dedup_lines(edge.where("false")).count() == 0


def brute_base(text):
    own = TOKEN.findall(text or "")
    windows = [tuple(own[i : i + 5]) for i in range(len(own) - 4)]
    twice = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if twice[w] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if x.strip(WS)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(own), sum(map(len, own)), symbols, len(lines) - len(set(lines)), len(hit)


def test_quality_of_awkward_rows(edge, others):
    out = quality.judge(edge)
    others(out.withColumn("Items", F.col("Items")), *quality.MEASURES)
    got = Counter(tuple(r) for r in out.select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    assert got == Counter(brute_base(r["text"]) for r in edge.collect())
    assert quality.judge(edge.where("false")).count() == 0


def test_lines_above_the_limits_deplete_documents(spark):
    common = " ".join(f"c{k}" for k in range(12))
    rows = [(i, f"{common}\n" + " ".join(f"u{i}x{k}" for k in range(3 if i < 30 else 40)), "host" if i < 90 else None) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r["doc_id"]: r for r in quality.judge(df, max_docs=20).collect()}
    assert all(r["n_removed_words"] == 12 for r in out.values())
    assert [i for i, r in out.items() if not r["kept"]] == [i for i in range(30)] or {i for i, r in out.items() if not r["kept"]} == set(range(30))
    assert all(r["kept"] or i < 30 and r["base_failed"] for i, r in ((r["doc_id"], r) for r in quality.judge(df, max_docs=200).collect()) if i >= 30)


# --- near duplicates -------------------------------------------------------------------------


def brute_classes(texts, least=0.8, size=5):
    sets = {}
    for k, t in texts.items():
        w = words(t)
        sets[k] = frozenset(zip(*[w[i:] for i in range(size)], strict=False)) if len(w) >= size else frozenset([tuple(w)])
    parent = {k: k for k in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = [k for k, t in texts.items() if t is not None]
    holders = defaultdict(list)
    for k in keys:
        for s in sets[k]:
            holders[s].append(k)
    for k in keys:
        for o, n in Counter(o for s in sets[k] for o in holders[s] if o > k).items():
            if n >= least * (len(sets[k]) + len(sets[o]) - n):
                parent[find(o)] = find(k)
    out = defaultdict(set)
    for k in texts:
        out[find(k)].add(k)
    return {frozenset(v) for v in out.values()}


def classes_of(df):
    out = defaultdict(set)
    for r in df.collect():
        out[r["class_row"]].add(r[ROW])
    return {frozenset(v) for v in out.values()}


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(2)
    element = rng.integers(1, 2**63, 40).astype(np.uint64)
    x, y = rng.uniform(0.1, 3, 40), rng.uniform(0.1, 3, 40)
    sig = minhash.signatures(np.tile(element, 2), np.repeat([0, 1], 40), 3, 4000, np.concatenate([x, y]))
    assert abs((sig[0] == sig[1]).mean() - np.minimum(x, y).sum() / np.maximum(x, y).sum()) < 0.04
    assert not sig[2].any() and sig[:2].all()
    same = minhash.signatures(np.concatenate([element, element, element[:1]]), np.repeat([0, 1, 1], [40, 40, 1]), 2, 160)
    assert (same[0] == same[1]).all()  # a repeated element counts once


def test_near_duplicates_equal_brute_force(documents, texts):
    df = documents.select(F.col("doc_id").alias(ROW), "text")
    assert classes_of(minhash.near_duplicates(df)) == brute_classes(texts)


def test_chains_and_shared_passages_keep_every_link(spark):
    rng = np.random.default_rng(9)
    base = [f"b{k}" for k in range(60)]
    texts, passage = {}, [f"p{k}" for k in range(40)]
    for i in range(120):  # edits that wander away from the first text, and copies of it
        own = list(base)
        for k in rng.choice(60, int(rng.integers(0, 4)), replace=False):
            own[k] = f"e{i}_{k}"
        texts[i] = " ".join(own)
        if i % 3 == 0:
            base[int(rng.integers(60))] = f"d{i}"
    for i in range(120, 180):
        texts[i] = " ".join(passage + [f"u{i}_{k}" for k in range(int(rng.integers(2, 30)))])
    df = spark.createDataFrame(list(texts.items()), f"{ROW} long, text string")
    assert classes_of(minhash.near_duplicates(df)) == brute_classes(texts)


def test_near_duplicates_of_awkward_rows(edge, others):
    rows = edge.drop("_row").coalesce(1).withColumn(ROW, F.monotonically_increasing_id())
    out = minhash.near_duplicates(rows)
    others(out.select(*[c for c in out.columns]), "class_row", "in_class")
    texts = {r[ROW]: r["text"] for r in rows.collect()}
    assert classes_of(out) == brute_classes(texts)
    sizes = Counter(r["class_row"] for r in out.collect())
    assert all(r["in_class"] == sizes[r["class_row"]] for r in out.collect())
    assert minhash.near_duplicates(rows.where("false")).count() == 0


def test_components_of_a_chain_a_star_and_a_loop(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(201, 200), (200, 202), (201, 202), (202, 202)]
    out = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert out == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 160)}, **{k: 200 for k in (200, 201, 202)}}


# --- language model --------------------------------------------------------------------------


def plain_forward(chain, kinds):
    state, total = chain.start, 0.0
    for k in kinds:
        state = (state @ chain.move) * chain.emit[:, k]
        total += np.log(state.sum())
        state = state / state.sum()
    return total


def plain_expected(chain, kinds):
    alpha, now = [chain.start], chain.start
    for k in kinds:
        now = (now @ chain.move) * chain.emit[:, k]
        now = now / now.sum()
        alpha.append(now)
    beta = np.ones(len(chain.start))
    move, seen = np.zeros_like(chain.move), np.zeros_like(chain.emit)
    for t in range(len(kinds) - 1, -1, -1):
        value = chain.emit[:, kinds[t]] * beta
        joint = chain.move * np.outer(alpha[t], value)
        move += joint / joint.sum()
        seen[:, kinds[t]] += joint.sum(axis=0) / joint.sum()
        beta = chain.move @ value
        beta = beta / beta.sum()
    start = chain.start * beta
    return start / start.sum(), move, seen


def test_blocks_equal_the_plain_recursions():
    rng = np.random.default_rng(4)
    chain = hmm.first_chain(rng.dirichlet(np.ones(hmm.CLASSES)), 3)
    texts = [rng.integers(0, hmm.CLASSES, n) for n in (1, 5, 63, 64, 65, 400, 2)]
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    kinds = np.concatenate(texts)
    assert np.allclose(hmm.log_likelihood(chain, kinds, first), [plain_forward(chain, t) for t in texts])
    want = [sum(x) for x in zip(*(plain_expected(chain, t) for t in texts), strict=True)]
    for got, plain in zip(hmm.expected(chain, kinds, first), want, strict=True):
        assert np.allclose(got, plain)


def test_training_raises_the_likelihood(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("text")
    kinds = rows.mapInArrow(hmm._classed, "kinds binary")
    parts = [np.frombuffer(r["kinds"], "<u2").astype(np.int64) for r in kinds.collect()]
    first = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    flat = np.concatenate(parts)
    shares = np.bincount(flat, minlength=hmm.CLASSES) / len(flat)
    got = [hmm.log_likelihood(hmm.train(kinds, shares, rounds=n), flat, first).sum() for n in (0, 1, 3)]
    assert got[0] < got[1] < got[2]


def plain_class(token):
    """The class of a token from its last two bytes and its length; None is the end."""
    if token is None:
        return hmm.CLASSES - 1
    own = token.encode()
    code = own[-1] | (own[-2] << 8 if len(own) > 1 else 0) | min(len(own), 12) // 3 << 16
    return int(arrays.mixed(np.array([code + 1], np.uint64))[0] % np.uint64(hmm.CLASSES - 1))


def test_score_equals_plain_forward_and_counts(spark, documents):
    """The whole score: the chain over classes, and each token given its class, frequent ones and others alike."""
    df = documents.select("doc_id", "text")
    model = hmm.learn(df.where("doc_id % 3 > 0"), frequent=100, rounds=1)
    taught = Counter(t for r in df.where("doc_id % 3 > 0").collect() for t in [*TOKEN.findall(lower(r["text"])), None])
    of_class, kinds_of_class = Counter(), Counter()
    for token, n in taught.items():
        of_class[plain_class(token)] += n
        kinds_of_class[plain_class(token)] += 1
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    rows = hmm.score(df, model).collect()
    assert len(rows) == len(texts)
    for r in rows:
        own = [*TOKEN.findall(lower(texts[r["doc_id"]])), None]
        kinds = [plain_class(t) for t in own]
        given = sum(np.log10((taught[t] + 1) / (of_class[k] + kinds_of_class[k] + 1)) for t, k in zip(own, kinds, strict=True))
        assert r["score"] == pytest.approx(plain_forward(model.chain, kinds) / np.log(10) + given)


def test_base_score_equals_brute_force(spark, documents, edge, others):
    df = documents.select("doc_id", "text")
    model = hmm.learn(df.where("doc_id % 3 > 0"), frequent=100, rounds=1)
    counts = Counter(t for r in df.where("doc_id % 3 > 0").collect() for t in [*TOKEN.findall(lower(r["text"])), None])
    total, distinct = sum(counts.values()), len(counts)

    def want(text):
        own = [*TOKEN.findall(lower(text)), None]
        return len(own), sum(counts[t] > 0 for t in own), sum(np.log10((counts[t] + 1) / (total + distinct + 1)) for t in own)

    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    out = hmm.score(df, model).collect()
    for r in out:
        n, known, base = want(texts[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["base_score"] == pytest.approx(base) and r["score"] < 0
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    odd = hmm.score(edge, model)
    others(odd, "n_tokens", "n_known", "train_tokens", "base_score", "score")
    assert Counter(r["n_tokens"] for r in odd.collect()) == Counter(want(r["text"])[0] for r in edge.collect())
    empty = hmm.learn(df.where("false"))
    assert all(r["n_known"] == 0 and np.isfinite(r["score"]) for r in hmm.score(edge, empty).collect())
    assert hmm.score(edge.where("false"), model).count() == 0


def test_probabilities_of_a_class_sum_to_one(documents):
    model = hmm.learn(documents.select("text"), rounds=1, frequent=50)
    seen = model.of_class.sum() + model.kinds_of_class.sum()
    assert seen == model.total + model.distinct
    assert np.allclose(model.chain.emit.sum(axis=1), 1) and np.allclose(model.chain.move.sum(axis=1), 1)


# --- repeats ---------------------------------------------------------------------------------


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(x[p : p + length] for x in raw for p in range(len(x) - length + 1))
    out = []
    for x in raw:
        gone = np.zeros(len(x), bool)
        for p in range(len(x) - length + 1):
            if seen[x[p : p + length]] > 1:
                gone[p : p + length] = True
        edge = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        kept = np.frombuffer(x, np.uint8)[~gone].tobytes()
        out.append((len(x), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def digest_rows(out):
    return out.select("n_bytes", repeats.n_removed().alias("n"), F.size("spans").alias("k"), F.sha2("kept", 256).alias("h")).collect()


def test_repeats_equal_brute_force(documents, texts):
    out = repeats.remove_repeats(documents.select("doc_id", "text"))
    assert Counter(map(tuple, digest_rows(out))) == Counter(brute_repeats(texts.values(), 200))


def test_repeats_at_every_boundary(spark):
    rng = np.random.default_rng(8)
    draw = lambda n: "".join(rng.choice(list("abcdé "), n))
    core, texts = draw(260), []
    for i in range(60):  # parts of one passage, cut at all places, so that no pair is enough
        a, b = sorted(rng.integers(0, 261, 2).tolist())
        texts.append(draw(int(rng.integers(0, 60))) + core[a:b] + draw(int(rng.integers(0, 60))))
    period = draw(7) * 60
    texts += [core, core, period, period[:290] + "x", "z" * 500, "z" * 199, "z" * 200, draw(300), None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for length, gram in ((200, 32), (60, 16)):
        out = repeats.remove_repeats(df, length=length, gram=gram)
        assert Counter(map(tuple, digest_rows(out))) == Counter(brute_repeats(texts, length))


def test_repeats_of_awkward_rows(edge, others):
    out = repeats.remove_repeats(edge)
    others(out, "n_bytes", "spans", "kept")
    assert Counter(map(tuple, digest_rows(out))) == Counter(brute_repeats([r["text"] for r in edge.collect()], 200))
    assert repeats.remove_repeats(edge.where("false")).count() == 0


# --- pipeline --------------------------------------------------------------------------------


def test_pipeline_stages_act_on_what_they_get(spark, small, documents, texts):
    columns = spark.read.parquet(f"{small}/documents.parquet").columns
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.written(stage(spark, docs, small))
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
            kept[name] = {r["doc_id"]: r for r in docs.collect()}
            assert all(r["n_chars"] == len(r["text"]) for r in kept[name].values())
    assert len(kept["toxicity"]) < len(texts) and set(kept["line_dedup"]) == set(kept["toxicity"])
    classes = brute_classes({k: r["text"] for k, r in kept["line_dedup"].items()})
    assert all(len(c & set(kept["near_dedup"])) == 1 for c in classes)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    from .test_simple_operators import brute_hits

    bad = {k for k, r in kept["near_dedup"].items() if (x := brute_hits(r["text"], items))[1] and 20 * x[1] >= x[0]}
    assert set(kept["decontaminate"]) == set(kept["near_dedup"]) - bad
    assert {r["doc_id"] for r in docs.collect()} == set(kept["decontaminate"])


def test_pipeline_stages_give_the_right_rows(spark, small):
    import sentencepiece

    docs, given = spark.read.parquet(f"{small}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        given[name] = {r["doc_id"]: r for r in docs.collect()}
        docs = corpus_pipeline.written(stage(spark, docs, small))
    scores = {r["doc_id"]: r["score"] for r in queries.REGISTRY["op5_toxicity"](spark, small).collect()}
    assert given["line_dedup"] == {k: r for k, r in given["toxicity"].items() if scores[k] < 0.3}
    before = [given["line_dedup"][k] for k in sorted(given["line_dedup"])]
    want = brute_line_dedup([(r["text"], r["source"]) for r in before], 8)
    assert any(n for _, n, _ in want)
    assert {k: r["text"] for k, r in given["near_dedup"].items()} == {r["doc_id"]: t for r, (_, _, t) in zip(before, want, strict=True)}
    for name, last in (("decontaminate", "near_dedup"), ("encode", "decontaminate")):
        assert all(r == given[last][k] for k, r in given[name].items())
    library = sentencepiece.SentencePieceProcessor(model_file=queries.pieces_model())
    digest = lambda raw: hashlib.sha256(raw).hexdigest()
    out = {r["doc_id"]: r for r in docs.collect()}
    assert set(out) == set(given["encode"])
    for k, r in out.items():
        ids = library.encode(given["encode"][k]["text"], add_bos=True, add_eos=True)
        raw = np.array(ids, "<u4").tobytes()
        assert (r["n_tokens"], bytes(r["ids"]), r["ids_sha256"]) == (len(ids), raw, digest(raw))
        assert r["decoded_sha256"] == digest(library.decode(ids).encode())


def test_pipeline_of_awkward_rows(spark, small, edge):
    """Whatever extra columns are called, a stage leaves their values to their rows."""
    more = ("first", "whole_text", "_id", "document", "n_removed_lines", "a.b")
    docs = edge.select("*", F.length("text").cast("long").alias("n_chars"))
    docs = docs.withColumns({c: F.lit("was here") for c in more}).withColumn("_row", F.concat(F.lit("row of "), F.coalesce("doc_id", F.lit(-1))))
    names = [f"`{c}`" for c in docs.columns if c not in ("doc_id", "text", "source", "lang", "n_chars", "_row")]
    for some in (docs, docs.where("false")):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            columns = some.columns
            some = corpus_pipeline.written(stage(spark, some, small))
            if k + 1 < len(corpus_pipeline.STAGES):
                assert some.columns == columns
                assert some.where(F.col("_row") != F.concat(F.lit("row of "), F.coalesce("doc_id", F.lit(-1)))).count() == 0
                assert {v for r in some.select(*names).distinct().collect() for v in r} <= {"was here"}
                assert some.count() > 5 or not docs.count() or some.isEmpty()
        assert some.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]


def test_run_is_registered(spark, small):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.run(spark, small).count() > 0


def test_queries_without_sql_are_those_that_sql_cannot_express():
    without = {"op2_shard", "op5_toxicity", "op6_languages", "op7_pieces", "op8_hmm", "op11_urls"}
    assert set(queries.REGISTRY) - set(sql.ORACLES) == without and set(sql.ORACLES) <= set(queries.REGISTRY)
    assert sorted(int(name[2:].split("_")[0]) for name in queries.REGISTRY) == list(range(1, 14))

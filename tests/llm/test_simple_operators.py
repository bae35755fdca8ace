"""Decontamination, sharding, pieces, language and toxicity against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from claimspark.llm import arrays, bloom, decontaminate, languages, pieces, queries, shard, toxicity

from .conftest import LINE, LONG, TEXTS, words


def rows_of(df):
    return df.collect()


# --- words and hashes ------------------------------------------------------------------------


def test_words_and_hashes_follow_the_texts():
    view = arrays.views(pa.array(TEXTS))
    found = arrays.words(view, arrays.ALNUM)
    assert found.counts().tolist() == [len(words(t)) for t in TEXTS]
    hashes = arrays.word_hashes(view, found)
    flat = [w for t in TEXTS for w in words(t)]
    named = defaultdict(set)
    for w, h in zip(flat, hashes.tolist(), strict=True):
        named[w].add(h)
    assert all(len(h) == 1 for h in named.values()) and len({h for x in named.values() for h in x}) == len(named)


def test_slices_cover_batches_and_views_of_slices():
    batch = pa.RecordBatch.from_arrays([pa.array(TEXTS)], names=["text"])
    parts = [(b.column(0).to_pylist(), t) for b, t in arrays.slices([batch.slice(2)], "text", 100)]
    assert [x for p, _ in parts for x in p] == TEXTS[2:]
    assert all(t.text(i).decode() == (x or "") for p, t in parts for i, x in enumerate(p))


def test_filter_knows_its_keys(spark):
    df = spark.range(5000).select(F.xxhash64("id").alias("key"))
    known = bloom.filter_of(df, "key")
    keys = np.array([r["key"] for r in df.collect()], np.int64).view(np.uint64)
    assert known.has(keys).all()
    assert known.has(arrays.mixed(np.arange(1, 20_000, dtype=np.uint64))).mean() < 0.02
    assert not bloom.filter_of(df.where("false"), "key").has(keys).any()


# --- decontamination -------------------------------------------------------------------------


def brute_hits(text, items, size=13):
    own = words(text)
    hit, found = [False] * len(own), set()
    for name, item in items:
        w = words(item)
        n = min(size, len(w))
        windows = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
        for k in range(len(own) - n + 1):
            if tuple(own[k : k + n]) in windows:
                found.add(str(name) if name is not None else "")
                hit[k : k + n] = [True] * n
    return len(own), sum(hit), sorted(found)


@pytest.mark.parametrize("block", [decontaminate.BLOCK_WINDOWS, 900])
def test_decontamination_equals_brute_force(spark, small, documents, texts, block):
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    plain = [(r["item_id"], r["text"]) for r in items.collect()]
    out = decontaminate.decontaminate(documents.limit(200), items, block_windows=block)
    for r in out.select("doc_id", "n_words", decontaminate.n_hit().alias("hit"), "items").collect():
        assert (r["n_words"], r["hit"], r["items"]) == brute_hits(texts[r["doc_id"]], plain)


def test_decontamination_of_awkward_rows(spark, edge, others):
    items = [(1, None), (2, ""), (3, "One"), (4, "a b c"), (5, LINE), (5, LINE), (None, "tie tie tie"), (7, "Shared words"), (8, "")]
    table = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.decontaminate(edge, table)
    others(out, "n_words", "hit_spans", "items")
    for r in out.select("text", "n_words", decontaminate.n_hit().alias("hit"), "items").collect():
        assert (r["n_words"], r["hit"], r["items"]) == brute_hits(r["text"], items)
    none = decontaminate.decontaminate(edge, table.where("false"))
    assert all(not r["items"] for r in none.collect())
    assert decontaminate.decontaminate(edge.where("false"), table).count() == 0


# --- sharding --------------------------------------------------------------------------------


def test_best_fit_takes_the_tightest_bin():
    assert shard.best_fit([7, 6, 3, 2, 2], 2) == [0, 1, 0, 1, 1]
    bins = shard.Bins(10)
    assert [bins.put(s) for s in (6, 7, 3, 4)] == [0, 1, 1, 0]
    assert shard.best_fit([], 3) == [] and max(shard.best_fit([5] * 7, 3)) == 2


def check_shards(rows, shards, spread):
    size, slots, groups = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        groups[r["text_crc32"]].add(r["shard"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert set(size) <= set(range(shards))
    assert max(size.values()) - min(size.get(k, 0) for k in range(shards)) <= spread
    return groups


def test_shards_of_documents(documents, texts):
    rows = shard.shard(documents, shards=8, slot_rows=20).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))
    total = sum(r["size"] for r in rows)
    groups = check_shards(rows, 8, max(total // 8 // 20, 8000))
    assert all(len(s) == 1 for s in groups.values())


def test_a_group_above_a_fair_share_is_dealt(spark, edge, others):
    hot = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "same text").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    rows = shard.shard(hot, shards=5, slot_rows=300).collect()
    assert len(rows) == 4000
    check_shards(rows, 5, 4000)
    out = shard.shard(edge, shards=3)
    others(out, "size", "text_crc32", "shard", "slot")
    assert out.count() == edge.count()
    assert shard.shard(edge.where("false")).count() == 0


# --- pieces ----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    with open(queries.pieces_model(), "rb") as f:
        return pieces.Vocabulary(f.read())


def test_pieces_equal_the_library(vocabulary, texts):
    rng = np.random.default_rng(3)
    letters = list("aab \n\t▁éßñ日😀\x00.,01 ") + ["  ", "   ", "the", "ing", "<s>", "<0x41>"]
    odd = ["".join(rng.choice(letters, size=n)) for n in (0, 1, 2, 3, 10, 60, 400) for _ in range(40)]
    plain = [t or "" for t in TEXTS] + odd + list(texts.values()) + [" " * 3000, "y" * 3000, "▁" * 70]
    own, agrees = vocabulary.encode(plain)
    assert all(agrees)
    checked = vocabulary.library.encode(plain, add_bos=True, add_eos=True)
    assert [np.frombuffer(x, "<u4").tolist() for x in own] == checked
    assert [vocabulary.decode(x).decode() for x in own] == vocabulary.library.decode(checked)
    assert vocabulary.encode(plain) == (own, agrees)  # now from the cache
    vocabulary.forget()


def test_a_chunk_that_the_library_encodes_otherwise_is_noticed(vocabulary, monkeypatch):
    vocabulary.forget()
    monkeypatch.setattr(vocabulary, "merge_many", lambda chunks: [b"\0\0\0\0"] * len(chunks))
    assert vocabulary.encode(["", "two words"])[1] == [True, False]
    vocabulary.forget()


def test_a_wrong_cut_into_chunks_is_noticed(vocabulary, monkeypatch):
    vocabulary.forget()
    monkeypatch.setattr(vocabulary, "chunk", re.compile("(?s)."))  # the library agrees on each chunk
    plain = ["", "two words"]
    ids, agrees = vocabulary.encode(plain)
    assert agrees == [True, False]
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == vocabulary.library.encode(plain, add_bos=True, add_eos=True)
    vocabulary.forget()


def test_new_chunks_are_spelled_in_one_go(vocabulary, monkeypatch):
    vocabulary.forget()
    calls, unpacked = [], pieces._unpacked
    monkeypatch.setattr(pieces, "_unpacked", lambda ids: calls.append(len(ids)) or unpacked(ids))
    assert vocabulary.encode([" ".join(f"wörd{i}" for i in range(500))])[1] == [True]
    assert len(calls) == 1
    vocabulary.forget()


def test_chunks_that_are_not_spelled_by_their_ids(vocabulary):
    a, b, c = ([vocabulary.library.piece_to_id(x)] for x in "abc")
    made = [np.array(ids, "<u4").tobytes() for ids in (a, b + c, a)]
    assert vocabulary._odd(["a", "bc", "a"], made) == {}
    assert vocabulary._odd(["ab", "c", "a"], made) == {"ab": b"a", "c": b"bc"}  # the same bytes in all
    assert vocabulary._odd(["a", "bc", "é"], made) == {"é": b"a"}
    assert vocabulary._odd([], []) == {}


def test_heap_and_rounds_agree(vocabulary):
    chunks = ["▁international", "aaaaaaaa", "▁▁▁▁▁", "xyzzyzzy", "日本語", "▁t", "q"]
    by_round = vocabulary.merge_many(chunks)
    assert by_round == [np.array(vocabulary.merge_heap(c), "<u4").tobytes() for c in chunks]


def test_pieces_of_awkward_rows(edge, others):
    out = pieces.encode(edge, queries.pieces_model())
    others(out, "ids", "decoded", "library_agrees")
    for r in out.select("text", "decoded", "library_agrees", pieces.n_tokens().alias("n")).collect():
        assert r["library_agrees"]
        if not r["text"]:
            assert (r["n"], r["decoded"]) == (2, "")
        elif "▁" not in r["text"]:
            assert r["decoded"] == r["text"]
    assert pieces.encode(edge.where("false"), queries.pieces_model()).count() == 0


# --- languages -------------------------------------------------------------------------------


def test_languages_of_held_out_documents(spark, small, documents):
    lang = {r["doc_id"]: r["lang"] for r in documents.collect()}
    rows = [r for r in queries.REGISTRY["op6_languages"](spark, small).collect() if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in rows]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_filters_hold_their_ngrams_and_correct_for_chance():
    rng = np.random.default_rng(1)
    grams = {f"l{k}": rng.integers(0, 2**32, 3000).astype(np.uint64) for k in range(70)}
    filters = languages.Filters(list(grams), grams)
    codes = np.concatenate([grams["l3"][:500], grams["l69"][:500]])
    shares = filters.shares(codes, np.array([500, 0, 500]))
    assert shares[0].argmax() == 3 and shares[2].argmax() == 69 and not shares[1].any()
    assert shares[0, 3] == 1 and abs(np.delete(shares[0], 3)).max() < 0.02


def plain_grams(text):
    """The 4-byte n-grams of a text, A-Z lower-cased and all ASCII white space as blanks."""
    data = re.sub(rb"[\x09-\x0d]", b" ", (text or "").encode().lower())
    return [int.from_bytes(data[i : i + 4], "little") for i in range(len(data) - 3)]


def test_every_ngram_of_a_language_is_in_its_filter(spark, texts, documents, monkeypatch):
    """The filters hold the plain sets of n-grams not much rarer than elsewhere; shares are those of the sets but for chance."""
    taught = {}
    monkeypatch.setattr(languages, "Filters", lambda names, grams, made=languages.Filters: taught.update(grams) or made(names, grams))
    filters = languages.learn(documents)
    lang = {r["doc_id"]: r["lang"] for r in documents.collect()}
    counts = {name: Counter() for name in filters.languages}
    for doc, text in texts.items():
        if lang[doc] is not None:
            counts[lang[doc]].update(plain_grams(text))
    rates = {name: {g: n / c.total() for g, n in c.items()} for name, c in counts.items()}
    most = {g: max(r.get(g, 0) for r in rates.values()) for r in rates.values() for g in r}
    expected = {name: {g for g, rate in r.items() if rate >= languages.LEAST_SHARE * most[g]} for name, r in rates.items()}
    assert {name: set(g.tolist()) for name, g in taught.items()} == expected
    assert filters.entries >= languages.ENTRIES_PER_GRAM * max(map(len, expected.values()))
    some = [t for t in texts.values() if t][:50] + ["zzzzqqqq xxxxjjjj", "the"]
    codes = [plain_grams(t) for t in some]
    shares = filters.shares(np.array([c for own in codes for c in own], np.uint64), np.array([len(c) for c in codes]))
    for own, row in zip(codes, shares, strict=True):
        for name, share, chance in zip(filters.languages, row, filters.chance, strict=True):
            found = sum(c in expected[name] for c in own) / max(1, len(own))
            assert chance < 0.05 and abs(share - found) < 0.05 + 4 * math.sqrt(chance / max(1, len(own)))


def test_languages_of_awkward_rows(edge, others):
    filters = languages.learn(edge)
    out = languages.identify(edge, filters)
    others(out, "lang_pred", "score")
    for r in out.collect():
        letters = any(c.isalpha() for c in r["text"] or "")
        assert r["lang_pred"] == ("en" if letters else "und")
    none = languages.identify(edge, languages.learn(edge.where("false")))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}
    assert languages.identify(edge.where("false"), filters).count() == 0


# --- toxicity --------------------------------------------------------------------------------


def test_features_of_a_text():
    view = arrays.views(pa.array(["You IDIOT! you are a id1ot, idiots", "", None]))
    lexicon = toxicity.Lexicon(*(np.array(x) for x in (toxicity._hashes_of(["idiot"]), [2.0])))
    rows = toxicity.features_of(view, lexicon)
    f = dict(zip(toxicity.FEATURES, rows[0], strict=True))
    assert (f["hits"], f["weight"], f["hidden_hits"], f["near_hits"], f["kinds"]) == (1, 2, 1, 1, 1)
    assert f["loud_words"] == pytest.approx(1 / 7) and f["second_density"] == pytest.approx(2 / 7)
    assert not rows[1:].any()


def test_toxicity_learns_and_scores_every_row(spark, edge, others):
    rng = np.random.default_rng(5)
    plain = [f"v{k}" for k in range(300)]
    bad = ["scum", "clown", "trash"]
    rows = []
    for i in range(900):
        own = list(rng.choice(plain, 40))
        toxic = int(i % 3 == 0)
        if toxic:
            own[int(rng.integers(40))] = str(rng.choice(bad))
        rows.append((i, " ".join(own), toxic))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(table, table.select("doc_id", "toxic").where("doc_id < 600"))
    scored = {r["doc_id"]: r["score"] for r in toxicity.score(table.drop("toxic"), model).collect()}
    right = [(scored[i] >= toxicity.THRESHOLD) == bool(t) for i, _, t in rows if i >= 600]
    assert np.mean(right) > 0.97 and all(0 <= s <= 1 for s in scored.values())
    out = toxicity.score(edge, model)
    others(out, "score")
    assert out.count() == edge.count() and out.where("score is null").count() == 0
    nothing = toxicity.learn(edge, table.select("doc_id", "toxic").where("false"))
    assert {r["score"] for r in toxicity.score(edge, nothing).collect()} == {0.0}
    assert toxicity.score(edge.where("false"), model).count() == 0


def test_only_exact_copies_of_labelled_texts_are_dropped(spark):
    header = "All pages of the site begin with this line of far more than 64 characters. "
    some = [(3, "a", 0), (1, "a", 0), (2, "a", 1), (4, "b", 0), (5, "b ", 0), (6, "", 1), (7, "", 1)]
    sample = spark.createDataFrame([(k, header + t, y) for k, t, y in some], "_key long, text string, label int")
    assert sorted(r["_key"] for r in toxicity._without_copies(sample).collect()) == [1, 2, 4, 5, 6]
    rng = np.random.default_rng(6)
    rows = []
    for i in range(900):
        own = list(rng.choice([f"v{k}" for k in range(300)], 40))
        if i % 3 == 0:
            own[int(rng.integers(40))] = str(rng.choice(["scum", "clown", "trash"]))
        rows.append((i, header + " ".join(own), int(i % 3 == 0)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(table, table.select("doc_id", "toxic").where("doc_id < 600"))
    scored = {r["doc_id"]: r["score"] for r in toxicity.score(table.drop("toxic"), model).collect()}
    assert np.mean([(scored[i] >= toxicity.THRESHOLD) == bool(t) for i, _, t in rows if i >= 600]) > 0.97


def test_held_out_rows_do_not_teach(spark, small):
    rows = queries.REGISTRY["op5_toxicity"](spark, small).collect()
    assert len(rows) == 200
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_query_digests(spark, small, texts):
    for r in queries.REGISTRY["op7_pieces"](spark, small).where("doc_id < 5").collect():
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=queries.pieces_model())
        ids = library.encode(texts[r["doc_id"]], add_bos=True, add_eos=True)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert len(LONG) > 100_000


# --- quality and leaks of what is learned ----------------------------------------------------

SF = "/root/testdata/sf0.1"


def test_toxicity_of_held_out_rows(spark):
    """Recall and precision at the cut on labelled rows that nothing was learned from."""
    rows = queries.REGISTRY["op5_toxicity"](spark, SF).where("held_out").select("doc_id", "predicted")
    labels = spark.read.parquet(f"{SF}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {(r["toxic"], r["predicted"]): r["count"] for r in rows.join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()}
    caught = n[1, 1]
    assert caught >= 100
    assert caught / (caught + n.get((1, 0), 0)) >= 0.9 and caught / (caught + n.get((0, 1), 0)) >= 0.9


def test_held_out_labels_do_not_teach(spark, small, tmp_path):
    """The scores are the same whatever the labels of held-out rows say."""
    labels = spark.read.parquet(f"{small}/labels.parquet")
    held = queries.held_out(4, 2)
    scores = []
    for name, toxic in (("as given", F.col("toxic")), ("turned", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))):
        folder = tmp_path / name
        labels.withColumn("toxic", toxic.cast("int")).write.parquet(str(folder / "labels.parquet"))
        spark.read.parquet(f"{small}/documents.parquet").write.parquet(str(folder / "documents.parquet"))
        scores.append({r["doc_id"]: r["score"] for r in queries.REGISTRY["op5_toxicity"](spark, str(folder)).collect()})
    assert scores[0] == scores[1]


def plain_best_fit(sizes, shards, capacity):
    """Each size, in descending order, into the fullest bin that holds it; null if one fits nowhere."""
    room, out = [], []
    for size in sizes:
        fits = [(r, k) for k, r in enumerate(room) if r >= size]
        if not fits:
            if len(room) == shards or size > capacity:
                return None
            room.append(capacity)
            fits = [(capacity, len(room) - 1)]
        _, k = min(fits)
        room[k] -= size
        out.append(k)
    return out


def test_best_fit_equals_the_plain_one():
    rng = np.random.default_rng(2)
    for n, shards in ((1, 3), (7, 3), (200, 8), (500, 40)):
        sizes = sorted((int(x) for x in rng.pareto(1.2, n) * 50 + 1), reverse=True)
        placed = shard.best_fit(sizes, shards)
        loads = [sum(s for s, k in zip(sizes, placed, strict=True) if k == b) for b in range(shards)]
        capacity = next(c for c in range(max(loads) - 2, 2 * max(loads) + 1) if plain_best_fit(sizes, shards, c))
        assert plain_best_fit(sizes, shards, capacity) == placed and capacity >= max(loads)

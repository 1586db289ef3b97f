"""Orders of text ids, clashing names, whole texts in the fit, and plain loops beside array code."""

import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tallyframe.llm import fingerprints, lm_scoring, ngram_join, quality_classifier


def test_text_ids_of_one_prefix_are_spread(spark):
    docs = spark.range(2000).select(F.format_string("document-%012d", "id").alias("doc_id"), F.lit("t").alias("_text"))
    got = Counter((r._range, r._guest) for r in fingerprints.with_ranges(docs, "doc_id").select("_range", "_guest").collect())
    own = {r: n for (r, guest), n in got.items() if not guest}
    assert sum(own.values()) == 2000 and len(own) >= 31 and max(own.values()) <= 5 * fingerprints.RANGE_ROWS
    assert sum(n for (_, guest), n in got.items() if guest) == len(own)


def test_next_documents_by_text_ids(spark, tmp_path):
    ids = [f"document-{i * 7919 % 1000:06d}" for i in range(400)]
    texts = {d: " ".join(f"{d}w{j}" for j in range(20)) for d in ids}
    spark.createDataFrame([(d, t) for d, t in texts.items()], "doc_id string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    order = sorted(ids)
    got = {r.doc_id: r for r in fingerprints.query(spark, str(tmp_path)).collect()}
    assert len(got) == len(ids)
    for i, d in enumerate(order):
        t, nxt = texts[d], texts[order[(i + 1) % len(order)]]
        edited = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
        assert got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()


def test_fingerprints_hold_places(spark, tmp_path):
    text = "x y z " * 3 + " ".join(f"word{i}" for i in range(300))
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = fingerprints.query(spark, str(tmp_path)).first()
    words = got.fingerprint.split("|")[0].split(".")
    places = [int(w.split(":")[1], 16) for w in words]
    k, w = fingerprints.BY_WORDS
    assert places == sorted(places) and places[-1] < 309 - k + 1
    assert all(b - a <= w for a, b in zip(places, places[1:]))  # a hash of every window is kept


def test_one_of_each_group_beside_clashing_names(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text), (2, text), (2, text), (3, "another text of its own words altogether here"), (None, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("_th", "_own", "_id", "_nth", "_row", "_key", "_head", "class_id", "group_id")})
    out = ngram_join.keep_one(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 3] and {r._th for r in out.collect()} == {"_th"}


def test_links_between_members_that_are_unlike_their_node(spark):
    """2 and 3 share a node with 1 only, which is like neither."""
    r = np.random.default_rng(5)
    one, two = (r.integers(0, 256, ngram_join.TREES * ngram_join.DEPTH, dtype=np.uint8) for _ in "ab")
    two[: ngram_join.DEPTH] = one[: ngram_join.DEPTH]
    three = two.copy()
    three[ngram_join.DEPTH :: ngram_join.DEPTH] += 1
    df = spark.createDataFrame([(n, bytearray(x.tobytes())) for n, x in ((1, one), (2, two), (3, three))], "cid long, signature binary")
    assert {frozenset((x.a, x.b)) for x in ngram_join.forest_links(df).collect()} == {frozenset((2, 3))}


def plain_score(model, passages):
    """The attention's score of one text by loops over its passages."""
    encoded = [[math.tanh(sum((x - m) / s * w for x, m, s, w in zip(p, model.mean, model.scale, model.w["enc"][:, j])) + model.w["enc_b"][j]) for j in range(len(model.w["enc_b"]))] for p in passages]
    logits = []
    for e in encoded:
        t = [math.tanh(sum(x * model.w["v"][i, q] for i, x in enumerate(e))) for q in range(len(model.w["a"]))]
        g = [1 / (1 + math.exp(-sum(x * model.w["u"][i, q] for i, x in enumerate(e)))) for q in range(len(model.w["a"]))]
        logits.append(sum(a * b * c for a, b, c in zip(t, g, model.w["a"])))
    top = max(logits)
    weights = [math.exp(x - top) for x in logits]
    z = [sum(w * e[j] for w, e in zip(weights, encoded)) / sum(weights) for j in range(len(encoded[0]))]
    return 1 / (1 + math.exp(-(sum(a * b for a, b in zip(z, model.w["c"])) + model.w["c_b"][0])))


def test_attention_equals_loops_over_passages():
    r = np.random.default_rng(7)
    texts = [" ".join(f"w{r.integers(0, 300)}" for _ in range(n)) for n in (3, 64, 65, 300, 1000)] + [""]
    (first, last, x, counts), *more = quality_classifier.bags(texts)
    assert (first, last) == (0, len(texts)) and not more and counts.tolist() == [1, 1, 2, 5, 16, 1]
    model = quality_classifier.fit(x, counts, np.array([1.0, 0, 1, 0, 1, 0]))
    got, at = model.score(x, counts), 0
    for y, n in zip(got, counts):
        assert abs(plain_score(model, x[at : at + n].tolist()) - y) < 1e-5
        at += n


def test_whole_texts_are_fitted_within_the_bound(spark, monkeypatch):
    long = " ".join(f"w{i % 977}" for i in range(64 * 200))
    docs = spark.createDataFrame([(i, long if i == 1 else "a few words only") for i in range(40)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    seen = []
    monkeypatch.setattr(quality_classifier, "fit", lambda x, counts, y: seen.append((len(x), counts.tolist())) or None)
    quality_classifier.train_on(docs, labels)
    assert 200 in seen[0][1] and seen[0][0] == sum(seen[0][1]) and len(seen[0][1]) > 20
    quality_classifier.train_on(docs, labels, size=500)
    assert 200 not in seen[1][1] and 0 < len(seen[1][1]) < len(seen[0][1])


def test_members_of_one_node_meet_in_blocks_and_not_in_pairs(spark, monkeypatch):
    """A node of a head that is like none, 40 like one another and 40 like nobody; few rows come out, however the blocks lie."""
    r = np.random.default_rng(6)
    width = ngram_join.TREES * ngram_join.DEPTH
    draw = lambda: r.integers(0, 256, width, dtype=np.uint8)
    head, one, rows = draw(), draw(), []
    for n in range(81):
        x = head.copy() if n == 0 else one.copy() if n <= 40 else draw()
        if n and n <= 40:  # of each tree's path one value of its own, so no tree's prefix is shared but the first
            x[ngram_join.DEPTH :: ngram_join.DEPTH] = n
        x[: ngram_join.DEPTH] = head[: ngram_join.DEPTH]
        rows.append((n, bytearray(x.tobytes())))
    df = spark.createDataFrame(rows, "cid long, signature binary")
    for size in (1024, 7):
        monkeypatch.setattr(ngram_join, "NODE_BLOCK", size)
        links = [(x.a, x.b) for x in ngram_join.forest_links(df).collect()]
        spanned = {x.node: x.label for x in ngram_join.components(spark.createDataFrame(links, "a long, b long")).collect()}
        assert spanned == dict.fromkeys(range(1, 41), 1)
        assert len(links) == 39 if size == 1024 else len(links) < 40 * 39 / 2


def test_links_of_a_unit_equal_plain_loops():
    r = np.random.default_rng(7)
    base = r.integers(0, 256, (4, 256), dtype=np.uint8)
    signatures = np.where(r.random((60, 256)) < 0.15, r.integers(0, 256, (60, 256)), base[r.integers(0, 4, 60)]).astype(np.uint8)
    cids, block, part = np.arange(60) * 3 - 50, r.integers(0, 2, 60), r.integers(0, 30, 60)
    for same in (True, False):
        pairs = [(a, b) for a in range(60) for b in range(a) if part[a] != part[b] and (same or block[a] != block[b]) and ((signatures[a] == signatures[b]).mean() * 256 - 1) / 255 >= ngram_join.LINK]
        root = list(range(60))
        for _ in range(60):
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        assert sorted(ngram_join.meet(cids, block, part, signatures, same)) == sorted((cids[k], cids[v]) for k, v in enumerate(root) if k != v)


def test_each_different_word_is_looked_up_once():
    class Counted(dict):
        looks = 0

        def get(self, *x):
            Counted.looks += 1
            return dict.get(self, *x)

        def __contains__(self, x):
            Counted.looks += 1
            return dict.__contains__(self, x)

        def __getitem__(self, x):
            Counted.looks += 1
            return dict.__getitem__(self, x)

    model = lm_scoring.classes({i: 1 for i in range(400)}, 1, lm_scoring.VOCABULARY)
    model.cache = Counted()
    texts = [[f"w{i * k % 30}".encode() for i in range(500)] for k in range(1, 5)]
    got = model.numbers(texts)
    assert Counted.looks <= 30 and len(set(got.tolist())) == 30
    assert np.array_equal(model.numbers(texts), got) and Counted.looks <= 60
    assert [k for n in got.tolist() for k, v in model.cache.items() if v == n] == [w for ws in texts for w in ws]


def test_words_of_an_array_are_those_of_each_text():
    texts = ["", " \t\x0b\x0c\r\n", "A bC\n\nd ", "\u00c9t\u00e9 \u00a0x\u2003y \x1c z", "x" * 5000 + "  Y", " one", "\U0001f600\x00 \x85"]
    flat, n = lm_scoring.split(pa.array(texts))
    assert n.tolist() == [len(lm_scoring.words(t)) for t in texts] and flat.to_pylist() == [w for t in texts for w in lm_scoring.words(t)]
    flat, n = lm_scoring.split(pa.array(texts).slice(2, 3))
    assert n.tolist() == [3, 4, 2] and len(flat) == 9 and len(lm_scoring.split(pa.array([], pa.string()))[0]) == 0


def test_steps_of_training_in_place_are_those_of_adam():
    r = np.random.default_rng(5)
    pairs = lm_scoring.output_bias(r.integers(0, 9, (lm_scoring.CLASSES, lm_scoring.CLASSES)).astype(float))
    windows = r.integers(0, 480, (lm_scoring.FIRST_BATCH * 3, lm_scoring.WINDOW + 1)).astype(np.uint16)
    windows[::5, 20:] = lm_scoring.PAD
    trainer = lm_scoring.Trainer(lm_scoring.new_weights(), pairs, 11)
    order = np.random.default_rng(11).permutation(len(windows))
    trainer.learn(windows)
    w = {k: v.copy() for k, v in lm_scoring.new_weights().items()}
    m, s = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    for step in (1, 2, 3):
        part = windows[order[(step - 1) * lm_scoring.FIRST_BATCH : step * lm_scoring.FIRST_BATCH]]
        x = np.where(part == lm_scoring.PAD, 0, part).astype(np.int64)
        _, g = lm_scoring.gradients(w, pairs, x[:, :-1], x[:, 1:], part[:, 1:] != lm_scoring.PAD)
        for k in w:
            m[k], s[k] = 0.9 * m[k] + 0.1 * g[k], 0.99 * s[k] + 0.01 * g[k] ** 2
            w[k] = w[k] - lm_scoring.RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)
    assert all(np.allclose(trainer.w[k], w[k], atol=1e-4) for k in w)

"""Operators do the whole job: cases that earlier versions left out."""

import hashlib
import math
import re

import numpy as np
import pandas as pd
from test_llm import brute_links, brute_removed

from tallyframe.llm import fingerprints, lm_scoring, mixing, ngram_join, pii, quality_classifier, quality_rules, sentencepiece_codec, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stop_words_are_a_share_of_all_words(spark):
    r = np.random.default_rng(3)
    stops = quality_rules.STOP_WORDS["en"]
    prose = " ".join(str(r.choice(stops)) if r.random() < 0.25 else f"w{r.integers(0, 1 << 40)}" for _ in range(20_000))
    bare = " ".join(f"w{i}" for i in range(200)) + " the"
    got = quality_rules.apply_rules(spark.createDataFrame([(1, prose), (2, bare), (3, bare + " the" * 4)], "doc_id long, text string")).collect()
    for x in got:
        words = WORD.findall(x.text)
        n = sum(w in set(quality_rules.stop_word_list()) for w in words)
        assert x.n_stop_words == n and x.stop_ratio == n / len(words)
    assert {x.doc_id: x.kept for x in got} == {1: True, 2: False, 3: True}


class Shared:
    """Stands for a broadcast value."""

    def __init__(self, value):
        self.value = value


def test_the_model_learns_every_id_once():
    assert lm_scoring.WINDOW >= 32 and 2 * lm_scoring.OVERLAP >= lm_scoring.WINDOW
    texts = [" ".join(f"word{(i * k) % 50}" for i in range(40 * k)) for k in range(1, 30)]
    model = lm_scoring.classes({i: 1 for i in range(400)}, len(texts), lm_scoring.VOCABULARY)
    lists = [lm_scoring.words(t) for t in texts]
    seq, starts = model.sequence(model.numbers(lists), np.array([len(ws) for ws in lists]))
    rows = pd.concat(lm_scoring.count_pairs(Shared(model))(iter([pd.DataFrame({"text": texts})])))
    windows = rows[rows["first"] < 0]
    held = np.concatenate([np.frombuffer(x, np.uint16).reshape(-1, lm_scoring.WINDOW + 1) for x in windows["data"]])
    targets = held[:, 1:][held[:, 1:] != lm_scoring.PAD]
    first = np.zeros(len(seq), bool)
    first[starts] = True
    assert np.array_equal(np.sort(targets), np.sort(seq[~first]))
    model.weights, model.pairs = lm_scoring.new_weights(), lm_scoring.output_bias(np.ones((lm_scoring.CLASSES, lm_scoring.CLASSES)))
    learned = 0
    for r in range(lm_scoring.ROUNDS):
        for out in lm_scoring.train_shard(Shared(model), r)(iter([windows[windows["first"] == -1 - r]])):
            learned += int(out["n"].iloc[0])
    assert learned == len(held)


def test_frequent_words_by_a_least_count(spark):
    rows = [(f"w{i}".encode(), 1 + i) for i in range(300)] + [(b"x" * 100, 5000)]
    df = spark.createDataFrame([(bytearray(w), c) for w, c in rows], "word binary, c long")
    table, _ = lm_scoring.frequent_words(df, 50)
    got = dict(zip(table["word"].to_pylist(), table["logs"].to_pylist()))
    assert 10 < len(got) <= 50 and lm_scoring.dictionary_key(b"x" * 100) in got
    least = min(got.values())
    assert all(lm_scoring.dictionary_key(w) in got for w, c in rows if np.log10(c + 1) >= least)
    assert len(lm_scoring.frequent_words(df, 1000)[0]) == 301


def repeated(spark):
    """Texts of over 400 bytes: rows that are repeated and the least of their class, null ids, near copies and others."""
    base = [f"word{i * i}" for i in range(120)]
    near = [*base[:60], "other", *base[61:]]
    more = [f"else{i * i}" for i in range(120)]
    rows = [(1, base), (1, base), (4, base), (7, near), (None, more), (None, more), (None, more), (9, [*more, "tail"]), (11, [f"x{i ** 3}" for i in range(200)])]
    rows = [(d, " ".join(ws)) for d, ws in rows]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_repeated_rows_are_cut_once(spark):
    rows, df = repeated(spark)
    want = brute_removed([t.encode() for _, t in rows])
    got = [(r.doc_id, r.text, bytes(r._kept), r._n_removed) for r in suffix_dedup.remove_repeats(df).collect()]
    assert sorted(map(repr, got)) == sorted(repr((d, t, k, len(t.encode()) - len(k))) for (d, t), k in zip(rows, want))


def test_repeated_rows_are_linked_once(spark):
    rows, df = repeated(spark)
    links, _ = brute_links([t for _, t in rows])
    assert sum(map(len, links)) > 20
    got = [(r.doc_id, r.n_links) for r in ngram_join.join(df).collect()]
    assert sorted(map(repr, got)) == sorted(repr((d, len(x))) for (d, _), x in zip(rows, links))


def test_equal_rows_are_taken_one_by_one(spark):
    rows = [(7, "w1 w2 w3 w4 w5 w6 w7", "a")] * 40 + [(8, "one two", "a"), (None, "x " * 30, "b"), (None, "x " * 30, "b"), ((1 << 60) + 1, "y " * 500, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    runs = []
    for _ in range(2):
        out = mixing.mix(df).collect()
        assert len(out) == len(rows) and all(r._taken in (0, r._size, 2 * r._size, 3 * r._size) for r in out)
        for s in ("a", "b", None):
            mine = [r for r in out if r.source == s]
            assert abs(sum(r._taken for r in mine) - mine[0]._target) <= max(r._size for r in mine)
        runs.append(sorted(repr((r.doc_id, r._taken)) for r in out))
    assert runs[0] == runs[1] and (1 << 60) + 1 in {r.doc_id for r in out}


def test_quotas_of_many_sources(spark):
    df = spark.range(1500).selectExpr("concat('s', id) as source", "id % 7 as n_units")
    got = mixing.quotas(df, 4).groupBy("source").sum("quota").join(df, "source")
    assert got.count() == 1500 and got.where("n_units <> `sum(quota)`").count() == 0
    shard = [r["q"] for r in mixing.quotas(df, 4).groupBy("shard").agg({"quota": "sum"}).withColumnRenamed("sum(quota)", "q").collect()]
    assert len(shard) == 4 and max(shard) - min(shard) <= 3


def test_large_ids_beside_null_ones(spark):
    """A key passes every operator as it is; nothing is lost that only looks like a copy of another."""
    import corpus_pipeline

    big = (1 << 60) + 1
    near = " ".join(f"word{i * i}" for i in range(120))
    rows = [(big, near), (big + 1, near.replace("word4 ", "other ")), (None, "a lone text of some words about nothing at all"), (big + 2, "write to ann.b7@mail.example.com today please"), (big + 2, "write to ann.b7@mail.example.com today please")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    ids = sorted(map(str, (d for d, _ in rows)))
    model = quality_classifier.fit(np.random.default_rng(0).random((8, quality_classifier.FEATURES)).astype(np.float32), np.array([4, 4]), np.array([0.0, 1.0]))
    outs = {
        "pii": pii.replace(df), "lm": lm_scoring.score(df), "join": ngram_join.join(df), "quality": quality_classifier.score_documents(df, model), "pieces": sentencepiece_codec.encode(df),
        "giants": sentencepiece_codec.encode(df, giant=20, chunk=17), "suffix": suffix_dedup.remove_repeats(df), "mix": mixing.mix(df.selectExpr("*", "'s' as source")),
    }
    for name, out in outs.items():
        assert sorted(str(r.doc_id) for r in out.collect()) == ids, name
    links = {r.doc_id: r.n_links for r in outs["join"].collect()}
    assert links[big] == links[big + 1] == 1 and links[big + 2] == 1 and links[None] == 0
    assert sorted(str(r.doc_id) for r in ngram_join.keep_one(df).collect()) == sorted([str(big), "None", str(big + 2)])
    full = df.selectExpr("doc_id", "text", "cast(null as string) as lang", "'s' as source", "cast(length(text) as long) as n_chars", "1 as score", "'x' as predicted", "2.5 as shard")
    kept = corpus_pipeline.near_duplicates(spark, full, "")
    assert kept.columns == full.columns and kept.count() == 3
    private = corpus_pipeline.private(spark, full, "")
    assert private.columns == full.columns and sorted(str(r.doc_id) for r in private.collect()) == ids
    mixed = corpus_pipeline.mixed(spark, full, "")
    assert mixed.columns == full.columns and {str(r.doc_id) for r in mixed.collect()} <= set(ids)


def test_pieces_against_an_independent_search():
    """Best sums over all segmentations, by a plain recursion on the vocabulary."""
    v = sentencepiece_codec.vocabulary()
    r = np.random.default_rng(5)
    letters = list("aeiourstnl") + ["é", "ж", "日", "▁", "x1"]
    words = ["".join(r.choice(letters, int(n))) for n in r.integers(1, 14, 400)] + ["y" * 80, "qz" * 60]

    def best(w):
        top = [(0, 0)]
        for end in range(1, len(w) + 1):
            arcs = [(top[s][0] + v.pieces[w[s:end]][1], end - s) for s in range(max(0, end - v.reach), end) if w[s:end] in v.pieces]
            if w[end - 1] not in v.pieces:
                arcs.append((top[end - 1][0] + v.unknown, 1))
            top.append(max(arcs))
        ids, at = [], len(w)
        while at:
            ids.append(w[at - top[at][1] : at])
            at -= top[at][1]
        return [i for p in ids[::-1] for i in v.ids(p)], top[-1][0]

    for w in words:
        ids, score = v.encode(w)
        assert (ids.tolist(), score) == best(" " + w)


def test_fingerprints_with_text_ids_and_their_likeness(spark, tmp_path):
    """The next document by text ids; likeness against sets that are made by hand from the returned prints."""
    r = np.random.default_rng(2)
    words = [f"w{i}" for i in range(400)]
    rows = [(f"id-{i:03d}" if i != 7 else None, " ".join(r.choice(words, int(r.integers(1, 700))))) for i in range(40)]
    spark.createDataFrame(rows, "doc_id string, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {x.doc_id: x for x in fingerprints.query(spark, str(tmp_path)).collect()}
    order = sorted(rows, key=lambda x: (x[0] is None, x[0] or ""))
    kinds = lambda p: [None if k == "-" else {h for h in k.split(".") if h} for k in p.split("|")]

    def like(a, b):
        for x, y in zip(kinds(a), kinds(b)):
            if x is not None and y is not None:
                return min(1.0, len(x & y) / (len(x) * len(y)) ** 0.5) if x and y else float(len(x) == len(y))
        return 0.0

    for i, (d, t) in enumerate(order):
        nxt, x = order[(i + 1) % len(order)], got[d]
        edited = t[: len(t) - len(t) // 4] + nxt[1][: len(t) // 4]
        assert x.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(x.near_next - like(x.fingerprint, got[nxt[0]].fingerprint)) < 1e-9
        assert abs(x.near_edited - like(x.fingerprint, x.edited_fingerprint)) < 1e-9


def test_scores_of_windows_by_plain_loops():
    """Windows are read by looked-up projections: the same as training's attention, and as loops over places of a whole text."""
    r = np.random.default_rng(3)
    w = {k: v + r.standard_normal(v.shape).astype(np.float32) * 0.1 for k, v in lm_scoring.new_weights().items()}
    model = lm_scoring.classes({i: 1 for i in range(400)}, 1, lm_scoring.VOCABULARY)
    model.weights, model.pairs = w, lm_scoring.output_bias(r.integers(0, 9, (lm_scoring.CLASSES, lm_scoring.CLASSES)).astype(float))
    seq = np.concatenate([[0], r.integers(1, 480, 75), [0], [0, 0]]).astype(np.uint16)
    x = seq[: lm_scoring.WINDOW][None].astype(np.int64)
    for start in (0, lm_scoring.OVERLAP):
        assert np.allclose(lm_scoring.Reader(w)(x, start), lm_scoring.attend(w, x)[0, start:], atol=1e-4)
    got, want = model.log_classes(seq, np.array([0, 77])), []
    for text in (seq[:77], seq[77:]):
        for i in range(len(text) - 1):
            # The first window shows the first places, each later one those after its overlap.
            first = max(0, (i - lm_scoring.OVERLAP) // (lm_scoring.WINDOW - lm_scoring.OVERLAP)) * (lm_scoring.WINDOW - lm_scoring.OVERLAP)
            h = [w["emb"][int(text[j])] + w["pos"][j - first] for j in range(first, i + 1)]
            a = [math.exp(float((h[-1] @ w["q"]) @ (v @ w["k"])) / lm_scoring.WIDTH**0.5) for v in h]
            h1 = h[-1] + sum(p * (v @ w["v"]) for p, v in zip(a, h, strict=True)) / sum(a) @ w["o"]
            h2 = h1 + np.maximum(h1 @ w["w1"] + w["b1"], 0) @ w["w2"]
            group, y, last = int(text[i + 1]) // lm_scoring.GROUP, int(text[i + 1]), int(text[i])
            one = h2 @ w["gout"] + w["gbias"] + model.pairs[0][last]
            span = slice(group * lm_scoring.GROUP, (group + 1) * lm_scoring.GROUP)
            two = h2 @ w["out"][:, span] + w["bias"][span] + model.pairs[1][last, span]
            want.append(one[group] - np.log(np.exp(one).sum()) + two[y - span.start] - np.log(np.exp(two).sum()))
    assert np.allclose(got, want, atol=1e-3)

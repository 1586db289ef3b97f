"""The training-data operators against brute force, and on rows that are odd in every way."""

import hashlib
import json
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import (
    chat_format, fingerprints, lm_scoring, mixing, ngram_join, pii, quality_classifier, quality_rules, queries, sentencepiece_codec, suffix_dedup,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i * i % 100_003}" for i in range(6000))
COPY = "the quick brown fox jumps over the lazy dog and runs far away from here today again " * 3
ODD = [
    (1, None, "a", 0), (2, "", "a", 0), (3, "   \n\t ", None, 0), (4, LONG, "b", 0), (5, COPY, "b", 0), (6, COPY, "b", 0), (6, COPY, "b", 0), (7, COPY + "tail words here", "c", 0),
    (8, "x", "", 0), (9, "naïve café ▁ 日本語 🙂 ▁▁ <| a@b.example.org", "d", 0), (None, "no id at all but some words to read", None, 0), (10, "tie tie tie tie tie tie", "d", 0),
]
SCHEMA = "doc_id long, text string, source string, n_words int"  # n_words: a name that operators use themselves


@pytest.fixture(scope="module")
def odd(spark):
    extra = {"label": F.lit("x"), "score": F.lit(1), "n": F.lit(2), "key": F.lit("k"), "kept": F.lit(None).cast("string"), "n_chars": F.lit(-1).cast("long")}
    return spark.createDataFrame(ODD, SCHEMA).withColumns(extra)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


# ---- rules ----------------------------------------------------------------------------------------------


def repeat_words(words):
    grams = defaultdict(list)
    for i in range(len(words) - 4):
        grams[tuple(words[i : i + 5])].append(i)
    return len({j for at in grams.values() if len(at) > 1 for i in at for j in range(i, i + 5)})


def test_rules(odd, none):
    out = quality_rules.apply_rules(odd).collect()
    assert len(out) == len(ODD)
    for r in out:
        words = WORD.findall(r.text or "")
        assert (r.n_words, r.word_chars) == (len(words), sum(map(len, words)))
        assert r.n_repeat_words == repeat_words(words)
        assert r.base_failed == (len(words) < 10 or 100 * r.n_repeat_words > 20 * len(words)) and not (r.base_failed and r.kept)
    assert quality_rules.apply_rules(none).count() == 0


def test_rules_are_one_projection(odd):
    plan = quality_rules.apply_rules(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Python|Join|Window", plan)


# ---- mixing ---------------------------------------------------------------------------------------------


def brute_targets(sizes, cap=3):
    keys = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(keys)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [k for k in keys if k not in fixed]
        rest, w = total - sum(fixed.values()), sum(weight[k] for k in free)
        over = [k for k in free if w and rest * weight[k] / w > cap * sizes[k] + 1e-9]
        if not over:
            return {k: fixed[k] if k in fixed else rest * weight[k] / w for k in keys}
        fixed |= {k: cap * sizes[k] for k in over}


def test_mixing_targets_and_limits(docs, odd, none):
    for df in (docs, odd):
        out = mixing.mix(df).collect()
        again = mixing.mix(df).collect()
        line = lambda r: (str(r.doc_id), r.text or "", r._taken, [tuple(p) for p in r._passes])
        assert sorted(map(line, out)) == sorted(map(line, again)) and len(out) == df.count()
        sizes, taken = Counter(), Counter()
        for r in out:
            size = len(WORD.findall(r.text or ""))
            assert r._size == size and 0 <= r._taken <= 3 * size and r._taken == size * len(r._passes)
            sizes[r.source] += size
            taken[r.source] += r._taken
        want = brute_targets(sizes)
        for r in out:
            assert r._source_size == sizes[r.source] and math.isclose(r._target, want[r.source], rel_tol=1e-9, abs_tol=1e-6)
        for s in sizes:
            assert abs(taken[s] - want[s]) <= max([r._size for r in out if r.source == s] or [0])
    assert mixing.mix(none).count() == 0


def test_shards_hold_every_copy(docs):
    m = mixing.mix(docs)
    assert mixing.shard_rows(m).count() == m.agg(F.sum(F.size("_passes"))).first()[0]


def test_quotas_are_exact_and_balanced(spark):
    units = spark.createDataFrame([("a", 100), ("b", 37), (None, 3)], "source string, n_units long")
    got = mixing.quotas(units, 5).collect()
    by_source, by_shard = Counter(), Counter()
    for r in got:
        assert r.quota >= 0
        by_source[r.source] += r.quota
        by_shard[r.shard] += r.quota
    assert by_source == {"a": 100, "b": 37, None: 3} and max(by_shard.values()) - min(by_shard.values()) <= 2


def test_draws_follow_the_hypergeometric_distribution(spark):
    df = spark.range(4000).select(mixing.hypergeometric(F.lit(20).cast("long"), F.lit(8).cast("long"), F.lit(10).cast("long"), F.xxhash64("id")).alias("x"))
    x = np.array([r.x for r in df.collect()])
    assert abs(x.mean() - 4.0) < 0.1 and abs(x.var() - 10 * 0.4 * 0.6 * 10 / 19) < 0.15


# ---- fingerprints ---------------------------------------------------------------------------------------


def test_fingerprints_of_edited_texts(spark, sf_dir, texts):
    got = {r.doc_id: r for r in fingerprints.query(spark, sf_dir).collect()}
    ids = sorted(texts)
    assert sorted(got) == ids
    for i, d in enumerate(ids):
        t, nxt = texts[d], texts[ids[(i + 1) % len(ids)]]
        edited = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if len(t) > 200:
            assert r.near_edited > max(0.25, r.near_next)
    prints = defaultdict(set)
    for d in ids:
        prints[texts[d]].add(got[d].fingerprint)
    assert all(len(p) == 1 for p in prints.values())


def test_winnowing_guarantee_and_rightmost_ties(spark):
    shared = " ".join(f"s{i}" for i in range(6))
    a, b = "q " * 300 + shared + " r" * 300, "u v " * 200 + shared + " w z" * 200
    df = fingerprints.fingerprint(spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string"))
    x, y = ({h for h, _ in map(tuple, r.p)} for r in df.select(fingerprints.places_of("_own_words").alias("p")).collect())
    assert x & y  # k + w - 1 = 6 shared words
    k, w = fingerprints.BY_WORDS
    same = fingerprints.fingerprint(spark.createDataFrame([(1, "a " * 600)], "doc_id long, text string"))
    places = sorted(p for _, p in map(tuple, same.select(fingerprints.places_of("_own_words").alias("p")).first().p))
    assert places == list(range(w - 1, 600 - k + 1))


def test_fingerprints_of_odd_rows(odd, none, spark, tmp_path):
    out = fingerprints.fingerprint(odd).collect()
    assert len(out) == len(ODD) and fingerprints.fingerprint(none).count() == 0
    odd.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    assert fingerprints.query(spark, str(tmp_path)).count() == len(ODD)
    none.select("doc_id", "text").write.parquet(str(tmp_path / "e" / "documents.parquet"))
    assert fingerprints.query(spark, str(tmp_path / "e")).count() == 0


# ---- suffixes -------------------------------------------------------------------------------------------


def brute_removed(texts, n=400):
    seen = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        out.append(bytes(c for c, g in zip(t, gone) if not g))
    return out


def test_repeats_are_removed_exactly(spark, sf_dir, texts):
    ids = sorted(texts)
    want = dict(zip(ids, brute_removed([texts[d].encode() for d in ids])))
    for r in suffix_dedup.query(spark, sf_dir).collect():
        kept = want[r.doc_id]
        assert (r.n_bytes, r.n_removed) == (len(texts[r.doc_id].encode()), len(texts[r.doc_id].encode()) - len(kept))
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest() and (r.n_spans > 0) == (r.n_removed > 0)


def test_repeats_in_large_buckets_and_pieces(spark, odd, none, monkeypatch):
    r = np.random.default_rng(1)
    noise = lambda n: bytes(r.integers(97, 123, n, dtype=np.uint8)).decode()
    passage = noise(700)
    many = [noise(50 + i) + passage + noise(60) for i in range(40)] + ["ab" * 500, noise(2000), passage[:399], passage[:400]]
    many += [noise(40) + passage[:500] + many[i][700:] for i in range(12)] + [many[3][:600] + noise(30)] * 2
    monkeypatch.setattr(suffix_dedup, "PART", 8)
    df = spark.createDataFrame(list(enumerate(many)), "doc_id long, text string")
    for bands in ((301, 43, 7, 1), (43, 7, 1), (1,)):
        monkeypatch.setattr(suffix_dedup, "BANDS", bands)
        got = {x.doc_id: bytes(x._kept) for x in suffix_dedup.remove_repeats(df).collect()}
        assert [got[i] for i in range(len(many))] == brute_removed([t.encode() for t in many]), bands
    out = suffix_dedup.remove_repeats(odd).collect()
    assert len(out) == len(ODD) and suffix_dedup.remove_repeats(none).count() == 0
    assert {(x.doc_id, len(x.text or "") - len(x._kept) if x.doc_id in (4, 1, 2) else 0) for x in out if x.doc_id in (1, 2, 4)} == {(1, 0), (2, 0), (4, 0)}


# ---- near copies ----------------------------------------------------------------------------------------


def brute_links(rows):
    sets = []
    for t in rows:
        w = (t or "").encode().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    n = len(rows)
    like = lambda a, b: a == b or (bool(a | b) and len(a & b) / len(a | b) >= 0.8)
    links = [[j for j in range(n) if j != i and like(sets[i], sets[j])] for i in range(n)]
    group = list(range(n))
    for _ in range(n):
        for i in range(n):
            group[i] = min([group[i], *(group[j] for j in links[i])])
    return links, group


def test_join_finds_every_link(docs, texts):
    ids = sorted(texts)
    links, group = brute_links([texts[d] for d in ids])
    got = {r.doc_id: r for r in ngram_join.join(docs).collect()}
    for i, d in enumerate(ids):
        assert got[d].n_links == len(links[i]) and got[d].group_id == ids[group[i]]


def test_join_in_blocks_and_on_odd_rows(spark, odd, none, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    base = [f"k{i}" for i in range(120)]
    rows = [" ".join(base[:i] + ["zz"] + base[i + 1 :]) for i in range(30)] + [" ".join(base)] * 3
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    links, group = brute_links(rows)
    got = {r.doc_id: r for r in ngram_join.join(df).collect()}
    assert [got[i].n_links for i in range(len(rows))] == [len(x) for x in links] and [got[i].group_id for i in range(len(rows))] == group
    assert ngram_join.keep_one(df).count() == 1
    assert ngram_join.join(odd).count() == len(ODD) and ngram_join.join(none).count() == 0
    kept = ngram_join.keep_one(odd)
    links, group = brute_links([t for _, t, _, _ in ODD])
    assert kept.count() == len(set(group)) and kept.columns == odd.columns


def test_prefixes_reach_the_recall():
    assert ngram_join.shortest() == 5
    reach = [ngram_join.recall_of(k) for k in range(1, ngram_join.DEPTH + 1)]
    assert reach == sorted(reach, reverse=True) and reach[4] >= ngram_join.RECALL > reach[5] and 0.6 < ngram_join.LINK < 0.7


def test_chance_members_of_a_node_are_not_linked(spark):
    """Two signatures that share one path alone are candidates, and no link."""
    r = np.random.default_rng(3)
    a = r.integers(0, 256, ngram_join.TREES * ngram_join.DEPTH, dtype=np.uint8)
    b, c = r.integers(0, 256, a.size, dtype=np.uint8), a.copy()
    b[: ngram_join.DEPTH] = a[: ngram_join.DEPTH]
    c[100:120] = 255 - c[100:120]
    df = spark.createDataFrame([(1, bytearray(a.tobytes())), (2, bytearray(b.tobytes())), (3, bytearray(c.tobytes()))], "cid long, signature binary")
    assert {frozenset((x.a, x.b)) for x in ngram_join.forest_links(df).collect()} == {frozenset((1, 3))}


# ---- personal data --------------------------------------------------------------------------------------


def test_surrogates_keep_type_format_and_identity(spark, odd, none):
    text = "Mrs. Anna Berg wrote: ann.b7@mail.example.com, +1 (706) 555-3138, 4111 1111 1111 1111, 10.1.2.3; Mrs. Berg answered ANN.B7@mail.example.com. password = abcdef1234"
    df = spark.createDataFrame([(1, text), (2, "again 4111-1111-1111-1111 here"), (3, "г-жа Анна Петрова"), (4, None), (5, "")], "doc_id long, text string")
    out = {r.doc_id: r for r in pii.replace(df).collect()}
    new = out[1].text
    for secret in ("Anna", "Berg", "ann.b7", "555-3138", "4111", "10.1.2.3", "abcdef1234"):
        assert secret.lower() not in new.lower()
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", new) and len(re.findall(r"Mrs\. ([A-Z][a-z]+)", new)) == 2
    mails = re.findall(r"\S+@\S+?(?=[,.]?\s)", new)
    assert len(set(mails)) == 1 and len(mails) == 2
    family = re.findall(r"Mrs\. (?:\w+ )?(\w+) (?:wrote|answered)", new)
    assert family[0] == family[1]
    card = re.search(r"\d{4} \d{4} \d{4} \d{4}", new)[0]
    assert pii._luhn(card.replace(" ", "")) and card.replace(" ", "-") in out[2].text
    assert re.search("[а-я]", out[3].text) and "Петрова" not in out[3].text and out[4].text is None and out[5].text == ""
    got = pii.replace(odd).collect()
    assert len(got) == len(ODD) and pii.replace(none).count() == 0
    assert all(r.text == t for r, (d, t, _, _) in zip(sorted((r for r in got if r.doc_id == 4), key=str), [ODD[3]]))


def test_collisions_are_drawn_again(spark, monkeypatch):
    found = spark.createDataFrame([("email", e, "") for e in ("a", "bb", "cc", "ddd", "s3")], "kind string, entity string, gender string").coalesce(1)
    drawn = lambda key: lambda batches: (p.assign(new=[f"s{(len(e) + a) % 7}" for e, a in zip(p["entity"], p["attempt"])]) for p in batches)
    monkeypatch.setattr(pii, "_draw", drawn)
    got = {r.entity: r.new for r in pii.distinct_surrogates(found, b"key").collect()}
    assert len(got) == 5 and len(set(got.values())) == 5 and "s3" not in got.values()


def test_every_script_and_spelling(spark):
    rows = [
        (1, "write to a.иванов@mail.ru or jörg.müller@web.de"), (2, "Mr Παπαδόπουλος and my name is John Smith. Dr. Anna Berg"), (3, "+1 706 555 3138"), (4, "(706) 555-3138"),
        (5, "2001:db8::7 at 10:20:30"), (6, "2001:0DB8:0:0:0:0:0:7"), (7, "+49 30 1234567"), (8, "030 1234567"), (9, "Mrs Anna Berg"),
    ]
    got = {r.doc_id: r.text for r in pii.replace(spark.createDataFrame(rows, "doc_id long, text string"), key=b"k").collect()}
    for d, words in ((1, "иванов jörg müller"), (2, "Παπαδόπουλος John Smith Anna Berg"), (3, "706 3138"), (5, "2001:db8::7"), (7, "1234567")):
        assert not any(w in got[d] for w in words.split())
    assert re.search("[а-я]", got[1]) and re.search("[α-ω]", got[2]) and got[5].endswith(" at 10:20:30")
    assert re.sub(r"\D", "", got[3]) == "1" + re.sub(r"\D", "", got[4]) and got[3].startswith("+1 ")
    assert got[5].split()[0] == got[6] and got[7].startswith("+49 ") and re.sub(r"\D", "", got[7])[2:] == re.sub(r"\D", "", got[8])[1:]
    assert got[9].split()[1:] == got[2].split("Dr. ")[1].split()  # one person by either title
    other = {r.doc_id: r.text for r in pii.replace(spark.createDataFrame(rows, "doc_id long, text string"), key=b"other").collect()}
    assert other[3] != got[3]
    clash = spark.createDataFrame([(1, "x a@b.org", 1, 2, 3)], "doc_id long, text string, _th long, _text long, _n_entities int")
    row = pii.replace(clash).first()
    assert (row.doc_id, row._th, row._text, row._n_entities) == (1, 1, 2, 1) and "a@b.org" not in row.text


# ---- language model -------------------------------------------------------------------------------------


def test_base_scores_and_gain(spark, sf_dir, texts):
    got = {r.doc_id: r for r in lm_scoring.query(spark, sf_dir).collect()}
    words = {d: [w.decode() for w in t.encode().lower().split()] + [None] for d, t in texts.items()}
    c = Counter(w for d, ws in words.items() if zlib.crc32(str(d).encode()) % 7 != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    for d, ws in words.items():
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n) and r.held_out == (zlib.crc32(str(d).encode()) % 7 == 2)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9) and r.score < 0
    assert all(r.attention_score < 0 for r in got.values())


def test_held_out_texts_are_likelier_than_by_the_base(spark):
    """On 3 million training tokens; README says how smaller ones do, where the base gives each unknown word a share that no distribution has."""
    got = lm_scoring.query(spark, "/root/testdata/sf0.1").where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("attention_score"), F.sum("n_tokens")).first()
    assert got[0] > got[1] and got[2] > got[1]


def test_gradients_and_windows():
    w = lm_scoring.new_weights()
    pairs = lm_scoring.output_bias(np.ones((lm_scoring.CLASSES, lm_scoring.CLASSES)))
    r = np.random.default_rng(0)
    x, y = r.integers(0, 400, (3, lm_scoring.WINDOW)), r.integers(0, 400, (3, lm_scoring.WINDOW))
    valid = r.random(x.shape) < 0.8
    w64 = {k: v.astype(np.float64) for k, v in w.items()}
    _, g = lm_scoring.gradients(w64, pairs, x, y, valid)
    for name in ("q", "v", "w1", "gout", "emb", "pos"):
        at = np.unravel_index(np.argmax(np.abs(g[name])), g[name].shape)
        ends = []
        for e in (1e-4, -1e-4):
            moved = {k: v.copy() for k, v in w64.items()}
            moved[name][at] += e
            ends.append(lm_scoring.gradients(moved, pairs, x, y, valid)[0])
        assert math.isclose((ends[0] - ends[1]) / 2e-4, g[name][at], rel_tol=0.05, abs_tol=1e-5)
    classes = np.concatenate([[0], np.arange(1, 60), [0], [0, 0]]).astype(np.uint16)
    windows, doc, first = lm_scoring.cut(classes, np.array([0, 61]))
    scored = [int(c) for row, f in zip(windows, first) for i, c in enumerate(row[1:]) if i >= f and c != lm_scoring.PAD]
    assert scored == [*range(1, 60), 0, 0]  # each once, in order


def test_a_later_word_does_not_change_an_earlier_score():
    w = lm_scoring.new_weights()
    x = np.random.default_rng(1).integers(0, 400, (2, lm_scoring.WINDOW))
    x[1, :-1] = x[0, :-1]
    h = lm_scoring.attend(w, x)
    assert np.allclose(h[0, :-1], h[1, :-1], atol=1e-5)


def test_scores_of_odd_rows(odd, none):
    out = lm_scoring.score(odd).collect()
    assert len(out) == len(ODD) and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in out)
    assert {r.n_tokens for r in out if r.doc_id in (1, 2, 3)} == {1}
    assert lm_scoring.score(none).count() == 0


# ---- classifier -----------------------------------------------------------------------------------------


def test_held_out_quality(spark, odd, none):
    got = quality_classifier.query(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").collect()
    right = np.mean([r.predicted == r.quality for r in got])
    assert len(got) > 50 and right > 0.9
    model = quality_classifier.fit(np.random.default_rng(0).random((8, quality_classifier.FEATURES)).astype(np.float32), np.array([4, 4]), np.array([0.0, 1.0]))
    out = quality_classifier.score_documents(odd, model).collect()
    assert len(out) == len(ODD) and all(0 <= r._score <= 1 and r._predicted == int(r._score >= 0.7) and r.score == 1 for r in out)
    assert quality_classifier.score_documents(none, model).count() == 0
    assert {r._score for r in quality_classifier.score_documents(odd, None).collect()} == {0.5}


def test_passages_of_long_texts():
    long = "word " * 500_000
    group = [g for g in quality_classifier.bags([long, "", "a b"])]
    assert sum(len(x) for _, _, x, _ in group) == sum(int(c.sum()) for *_, c in group) and sum(len(c) for *_, c in group) == 3


# ---- pieces ---------------------------------------------------------------------------------------------


def test_pieces_round_trip_and_chunks(docs, odd, none):
    v = sentencepiece_codec.vocabulary()
    for _, t, _, _ in ODD:
        ids, score = v.encode(t or "")
        assert v.decode(ids) == (t or "") and (not t or score == v.cut(" " + t)[1])
    whole = {r.doc_id: (r._ids, r._score) for r in sentencepiece_codec.encode(docs).collect()}
    parts = {r.doc_id: (r._ids, r._score) for r in sentencepiece_codec.encode(docs, giant=3000, chunk=997).collect()}
    assert whole == parts
    out = sentencepiece_codec.encode(odd, giant=40, chunk=17, check=True).collect()
    assert len(out) == len(ODD) and all(r._exact for r in out) and sentencepiece_codec.encode(none).count() == 0
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(odd.select("doc_id", "text", "source"))).where("doc_id = 9").first()
    assert back._decoded == ODD[9][1]


def test_transfer_matrices_combine():
    v = sentencepiece_codec.vocabulary()
    text = " the committee responsible for  representation\nmet" + "x" * 30
    a, b = v.transfer(text[:25], 0), v.transfer(text[25 - v.reach : 60], v.reach)
    c = v.transfer(text[60 - v.reach :], v.reach)
    left, right = sentencepiece_codec.combine(sentencepiece_codec.combine(a, b), c), sentencepiece_codec.combine(a, sentencepiece_codec.combine(b, c))
    assert (left == right).all() and left[0, 0] == v.cut(text)[1]


# ---- chats ----------------------------------------------------------------------------------------------


def test_chats_on_odd_turns(spark):
    t = [
        (1, 0, "user", "hi"), (1, 1, "bot", "yo"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "bot", "yo"), (3, 2, "user", "<|end|> bye"), (4, 0, "user", "hi"), (4, 1, "bot", "no"),
        (5, None, None, None), (5, 1, "user", ""), (None, 0, "user", "lost"), (6, 0, "user", "twin"), (7, 0, "user", "twin"), (8, 9000, "bot", "late"), (8, 0, "user", "early"),
    ]
    df = spark.createDataFrame(t, "conv_id long, turn long, role string, text string").withColumn("block", F.lit("x"))
    got = {r.conv_id: r for r in chat_format.format_chats(df).collect()}
    assert set(got) == {3, 4, 5, None, 6, 8} and got[6].n_copies == 2 and got[3].n_turns == 3
    assert got[3].chat == "<|user|>\nhi<|end|>\n<|bot|>\nyo<|end|>\n<|user|>\n<\\|end|> bye<|end|>\n"
    assert got[5].chat == "<|user|>\n<|end|>\n<|unknown|>\n<|end|>\n" and got[8].chat.index("early") < got[8].chat.index("late")
    assert chat_format.format_chats(df.where("false")).count() == 0


# ---- the pipeline and the queries -------------------------------------------------------------------------


def test_pipeline(spark, sf_dir, docs, texts):
    import corpus_pipeline as p

    frame, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in p.STAGES:
        out = stage(spark, frame, sf_dir)
        seen[name] = [r.asDict() for r in out.collect()]
        if stage is not p.encoded:
            assert out.columns == frame.columns
            frame = spark.createDataFrame([tuple(r.values()) for r in seen[name]], frame.schema)
    first, second, third, fourth, last = seen.values()
    assert 0 < len(first) <= len(texts)
    _, group = brute_links([r["text"] for r in sorted(first, key=lambda r: r["doc_id"])])
    assert len(second) == len(set(group))
    assert {r["doc_id"] for r in third} == {r["doc_id"] for r in second}
    assert not any(pii.surrogate and "@mail" in r["text"] and "example.com" in r["text"] and texts[r["doc_id"]] == r["text"] for r in third)
    assert len(last) == len(fourth) and Counter(r["doc_id"] for r in last) == Counter(r["doc_id"] for r in fourth)
    assert max(Counter(r["doc_id"] for r in last).values()) <= 3
    v = sentencepiece_codec.vocabulary()
    by_id = {r["doc_id"]: r["text"] for r in fourth}
    assert all(v.decode(np.array(r["ids"])) == by_id[r["doc_id"]] for r in last)


def test_pipeline_on_an_empty_table(spark, sf_dir):
    import corpus_pipeline as p

    frame = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    for _, stage in p.STAGES:
        out = stage(spark, frame, sf_dir)
        assert out.count() == 0
        frame = frame if stage is p.encoded else out


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(name, spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    df = queries.QUERIES[name](spark, sf_dir)
    r = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    line = lambda get: json.dumps([get(n) for n in sorted(names)], default=str)
    assert sorted(line(lambda n, row=row: row[n]) for row in df.collect()) == sorted(line(lambda n, row=row: row[names.index(n)]) for row in r.fetchall())

"""Vector codes, whitening and byte-level BPE against brute force and the library."""

import base64
import hashlib
import itertools
import math

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tallyframe.llm import byte_bpe, vector_codes, whitening

NAN, INF = float("nan"), float("inf")


# ---- codes ----------------------------------------------------------------------------------------------


def brute_codes(rows):
    """rows: (id, vector, label); plain loops over Python's integers."""
    kept = [(i, [math.floor(256 * c) for c in v], label) for i, v, label in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = len(kept[0][1]) // 16
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(kept, key=lambda r: r[0])[:64]
    books = [[cut(v, p) for _, v, _ in first] for p in range(16)]

    def near(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e)), k) for k, e in enumerate(books[p]))

    for _ in range(2):
        to = [[near(v, p)[1] for p in range(16)] for _, v, _ in kept]
        books = [
            [[sum(c) // len(mine) for c in zip(*mine)] if (mine := [cut(v, p) for (_, v, _), t in zip(kept, to) if t[p] == k]) else e for k, e in enumerate(books[p])]
            for p in range(16)
        ]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out = [(i, "".join(f"{near(v, p)[1]:02x}" for p in range(16)), sum(near(v, p)[0] for p in range(16)), label) for i, v, label in kept]
    return sorted((i, code, e, sum(x[2] for x in out if x[3] == label), digest) for i, code, e, label in out)


def made(n, dims, seed, grid=None):
    r = np.random.default_rng(seed)
    v = r.normal(0, 0.2, (n, dims)) if grid is None else r.integers(-grid, grid + 1, (n, dims)) / 256
    return [(int(i), [float(c) for c in v[k]], None if k % 5 == 0 else int(k % 3)) for k, i in enumerate(r.permutation(n) * 3)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)


@pytest.mark.parametrize("n,dims,grid", [(300, 64, None), (200, 32, 1), (150, 16, 2), (20, 48, None), (1, 16, None)])
def test_codes_equal_plain_loops(spark, n, dims, grid):
    rows = made(n, dims, n + dims, grid)
    rows += [(10**12, None, 1), (10**12 + 1, [NAN] * dims, 1), (10**12 + 2, [None] + [0.5] * (dims - 1), 1), (10**12 + 3, [INF] * dims, None)]
    got = vector_codes.compress(frame(spark, rows)).select("vec_id", *vector_codes.ADDED).collect()
    assert sorted(map(tuple, got)) == brute_codes(rows)


def test_bounds_never_lose_the_nearest_entry():
    r = np.random.default_rng(5)
    for width, high in itertools.product((1, 2, 3, 4, 6, 8), (2, 200, 1 << 20, 1 << 27, 1 << 40)):
        x, entries = r.integers(-high, high, (200, width)), r.integers(-high, high, (64, width))
        entries[40:] = entries[:24]  # ties
        x[:20] = entries[5]
        at, far = vector_codes.nearest(x, entries)
        every = ((x.astype(object)[:, None] - entries.astype(object)[None]) ** 2).sum(2)
        assert at.tolist() == [int(np.argmin(e)) for e in every] and far.tolist() == [min(e) for e in every]


def test_codes_of_odd_rows(spark):
    rows = frame(spark, [(None, [0.1] * 20, None), (1, [0.1] * 20, None), (1, [0.2] * 20, 3), (2, [0.3] * 7, 3), (3, [], 1), (4, [1e300] * 20, 4), (5, [-1e300] * 20, 4)])
    rows = rows.withColumns({"code": F.lit("old"), "_v": F.lit(1), "_row": F.lit(2), "_label": F.lit("x"), "_": F.lit(0), "a.b": F.lit(7)})
    got = vector_codes.compress(rows).collect()
    assert len(got) == 5 and {r.vec_id for r in got} == {None, 1, 4, 5} and all(r["a.b"] == 7 and r._v == 1 and len(r.code) == 32 for r in got)
    assert all(r.error == 0 for r in got)
    for none in (rows.where("false"), rows.where("vec_id = 3")):
        assert not [r for r in vector_codes.compress(none).collect() if r.error]
    assert vector_codes.compress(rows.where("false")).columns == vector_codes.compress(rows).columns


def test_errors_of_frequent_and_rare_labels(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "FREQUENT", 4)
    rows = made(300, 16, 9)
    rows = [(i, v, None if k % 2 else k % 40) for k, (i, v, _) in enumerate(rows)]
    got = vector_codes.compress(frame(spark, rows)).select("vec_id", *vector_codes.ADDED).collect()
    assert sorted(map(tuple, got)) == brute_codes(rows)


def test_codes_equal_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{sf_dir}/embeddings.parquet')")
    want = con.execute(f"select vec_id, code, error, label_error, codebooks_sha256 from ({vector_codes.oracle()})").fetchall()
    got = vector_codes.query(spark, sf_dir).select("vec_id", *vector_codes.ADDED).collect()
    assert sorted(map(tuple, got)) == sorted(want)


# ---- whitening ------------------------------------------------------------------------------------------


def check_whitening(rows, got, components=4):
    kept = [(i, [math.floor(256 * c) for c in v]) for i, v, *_ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(v) for _, v in kept}), np.int64)
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    want = {}
    for i, v in kept:
        deviation = sum((n * int(a) - int(s)) ** 2 for a, s in zip(v, sums))
        for c in range(components):
            want[i, c + 1] = (n, deviation, float((np.array(v) - sums / n) @ axes[:, -1 - c] / math.sqrt(values[-1 - c])), values[-1 - c] / values.sum())
    assert sorted((r.vec_id, r.component) for r in got) == sorted(want) and len(got) == len(want)
    for c in range(1, components + 1):
        mine = [(r, want[r.vec_id, c]) for r in got if r.component == c]
        assert all((r.n, r.deviation) == w[:2] for r, w in mine)
        sign = np.sign(sum(r.whitened * w[2] for r, w in mine))
        assert max(abs(r.whitened - sign * w[2]) for r, w in mine) < 1e-9
        assert max(abs(r.explained / w[3] - 1) for r, w in mine) < 1e-9
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_whitening_equals_one_matrix(spark):
    rows = made(400, 12, 1)
    rows += [(10_000 + k, rows[0][1], 1) for k in range(150)] + [(20_000, None, 1), (20_001, [NAN] * 12, 2), (20_002, [None] * 12, 2), (20_003, [-INF] * 12, 2)]
    check_whitening(rows, whitening.whiten(frame(spark, rows)).collect())


def test_whitening_of_the_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check_whitening(rows, whitening.query(spark, sf_dir).collect())


def test_states_merge_in_any_order():
    x = np.random.default_rng(2).integers(-500, 500, (1000, 6)) + 10**6
    whole = whitening.State.of(x)
    for cuts in ([1, 2, 999], [500], [300, 301, 302]):
        parts = [whitening.State.of(p) for p in np.split(x, cuts)]
        for order in (parts, parts[::-1]):
            total = order[0]
            for p in order[1:]:
                total = total.merge(p)
            assert total.n == 1000 and (total.sums == x.sum(0)).all()
            assert np.allclose(total.scatter, whole.scatter, rtol=0, atol=1e-10 * whole.scatter.max()) and np.allclose(total.mean, whole.mean, rtol=1e-14)


def test_whitening_of_odd_rows(spark):
    rows = frame(spark, [(None, [0.1, 0.5, 0.25], 1), (1, [0.1, 0.5, 0.25], None), (1, [0.7, 0.5, 0.25], 3), (2, [0.3], 3), (3, [], 1)])
    rows = rows.withColumns({"n": F.lit("old"), "_v": F.lit(1), "_row": F.lit(2), "_x": F.lit("x"), "component": F.lit("y")})
    got = whitening.whiten(rows).collect()
    assert len(got) == 9 and {r.vec_id for r in got} == {None, 1} and all(r.n == 2 and r._v == 1 and r._x == "x" for r in got)
    assert all((r.whitened is not None) == (r.component == 1) for r in got) and got[0].identity_error < 1e-12
    alone = whitening.whiten(rows.where("vec_id = 2")).collect()
    assert len(alone) == 1 and alone[0].whitened is None and alone[0].explained == 0 and alone[0].deviation == 0 and alone[0].identity_error is None
    assert whitening.whiten(rows.where("false")).count() == 0 and whitening.whiten(rows.where("false")).columns == whitening.whiten(rows).columns
    huge = whitening.whiten(frame(spark, [(1, [1e300, 0.0], 1), (2, [-1e300, 0.5], 1), (3, [1.0, 1.0], 1)])).collect()
    assert len(huge) == 6 and all(r.deviation is None for r in huge if r.vec_id < 3)


# ---- bytes ----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    with open(byte_bpe.RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


#: What matching looks ahead for: white space before words, contractions, classes that differ between editions of Unicode.
BITS = ["a", "aa", " ", "  ", "\n", "\t", "'", "'s", "'re", "re", "l", "'ll", "7", "²", "é", "日本", "!", "?!", " ", "🙂", "՘", "₏", "Ɤ", "\x1c", "　", "-", "_", "́", "the", "▁"]


@pytest.mark.parametrize("seed", range(4))
def test_trees_of_any_depth_equal_the_library(library, seed):
    r, v = np.random.default_rng(seed), byte_bpe.vocabulary()
    texts = ["".join(r.choice(BITS, r.integers(0, 70))) for _ in range(500)]
    want = [library.encode_ordinary(t) for t in texts]
    for leaf in (1, 2, 3, 7, 50):
        assert [x.tolist() for x in v.encode(texts, leaf)] == want
    assert [v.decode(w, 3).decode() for w in want] == texts


def test_words_by_halves(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "LONG", 3)
    monkeypatch.setattr(byte_bpe, "HEAP", 5)
    r, v = np.random.default_rng(8), byte_bpe.Vocabulary()
    texts = ["".join(r.choice(["a", "aa", "b", "é", "the", "in", "日", "=", "ing"], r.integers(0, 90))) for _ in range(400)] + ["a" * n for n in range(60)]
    want = [library.encode_ordinary(t) for t in texts]
    for leaf in (1, 5, 17, 10_000):
        assert [x.tolist() for x in v.encode(texts, leaf)] == want


def test_every_token_is_its_own_encoding_and_windows_stop():
    v = byte_bpe.vocabulary()
    assert all(v.merge(w) == [t] for w, t in list(v.rank.items())[::7])
    data = b"internationalisation of straightforward words" * 40
    got = v.halves(data)
    assert got == v.merge(data) and all(v.stable(a, b) for a, b in zip(got, got[1:]))


def test_classes_follow_the_library(library):
    every = [chr(c) for c in (*range(0x250), *range(0x530, 0x590), *range(0x2070, 0x20A0), *range(0xA7C0, 0xA7E0), *range(0x11DE0, 0x11DEA), *range(0x1C80, 0x1C90))]
    texts = [f"x{c} {c}y7{c}" for c in every]
    assert [x.tolist() for x in byte_bpe.vocabulary().encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_bytes_of_all_texts(spark, sf_dir, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = byte_bpe.query(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_giants_in_chunks_and_odd_rows(spark, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "FAN", 3)
    long = "word and it's 'really  \n\n long 日本語 " * 40
    rows = [(1, None), (2, ""), (None, "x"), (3, long), (3, long), (4, "a" * 700), (5, " " * 300 + "x" + "\n" * 400), (6, "no id's \x1c՘")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_ids": F.lit(1), "_gid": F.lit("g"), "gid": F.lit(3), "_row": F.lit(4), "a.b": F.lit(None).cast("void")})
    out = byte_bpe.encode(docs, giant=50, chunk=31, leaf=5, digests=True)
    got = out.collect()
    key = lambda t: (t[0] is None, t)
    assert sorted([(r.doc_id, r._ids) for r in got], key=key) == sorted([(i, library.encode_ordinary(t or "")) for i, t in rows], key=key)
    assert all(r._ids_sha256 == hashlib.sha256(np.array(r._ids, "<u4").tobytes()).hexdigest() and r._gid == "g" and r._row == 4 for r in got)
    back = byte_bpe.decode(out).collect()
    assert sorted([(r.doc_id, bytes(r._decoded).decode()) for r in back], key=key) == sorted([(i, t or "") for i, t in rows], key=key)
    odd = byte_bpe.decode(spark.createDataFrame([(1, None), (2, []), (3, [None, 50_256, -1, 220])], "doc_id long, _ids array<int>")).collect()
    assert {r.doc_id: bytes(r._decoded) for r in odd} == {1: b"", 2: b"", 3: b" "}
    assert byte_bpe.encode(docs.where("false")).count() == 0 and byte_bpe.decode(out.where("false")).count() == 0

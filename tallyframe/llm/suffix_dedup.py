"""Removal of long strings that occur more than once, by blockwise suffix sorting with a cover sample.

Texts are bytes; every byte inside a 400-byte string that also starts anywhere else is removed.

Cover sample. A fixed difference cover modulo v would put one position in about sqrt(v) of v into the sample
(for 400-byte strings one in 17) and needs a pair's own shift to compare two suffixes. The cover used here is
chosen by content instead, so that equal strings have their sample position at the same shift: of the
``SPAN`` starts of ``GRAM``-byte grams in a 400-byte string, the one with the least rolling hash (the
rightmost of equal ones). Every 400-byte string so has one sample position, about one in 150 bytes is one, and
a string's sample rank (the gram's name) is a function of the string alone.

Blockwise construction. (1) One scan per text emits its sample positions, each with the run of string starts
it stands for. (2) Samples are counted by gram: a gram that occurs once cannot lie in a string that occurs
twice, so all suffixes of its run are done. The other samples are counted by their reach, the bytes that the strings
of their runs span (at most 700): one that occurs twice settles the whole run, and only one sample of each reach goes on,
if its gram has several. (3) Their suffixes are dealt into buckets by gram. A task sorts a few whole buckets at a time, by
two integers that name a string's 400 bytes, so no long tie is compared byte by byte and memory is bounded by the
buckets at hand. A bucket of over ``PART`` reaches is not sorted but counted by longer and longer grams: a string's
distance from its sample is a function of the string, so strings are put into bands by it. The bytes that all strings of
a band share (its core) and its reach are named and counted as before: a reach that occurs twice is settled, and where a
core has several, one sample of each goes on to bands of the next width, down to single strings. So a passage that
stands in very many texts costs a few rows for each sample.
(4) The runs of one text are merged, and the text is cut.

Names are rolling hashes of 64 bits; strings count as equal where two of them, seeded apart, agree.
A text's key is a 64-bit hash.

Defined results: a null text is empty; texts under 400 bytes lose nothing unless a longer string covers them
(it cannot); a text that occurs twice or more and has 400 bytes or more is removed whole; rows with equal ids
are judged each on their own; extra columns are kept by :func:`remove_repeats`, whose added columns begin with
an underscore; an empty table gives no rows. Strings never cross texts, and are judged on the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize, small_batches, text_of

LENGTH = 400
GRAM = 100
#: Buckets of more reaches than this are counted by bands.
PART = 1024
#: Widths of the bands, in starts; the last is a single string.
BANDS = (43, 7, 1)
#: Texts are scanned in pieces of this many bytes (with an overlap), so a task's arrays stay small.
PIECE = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    out[1:] = base
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


def _inverse(base: int) -> np.uint64:
    return np.uint64(pow(base, -1, 1 << 64))


_TABLE = {s: np.random.default_rng(s).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for s in (1, 2)}


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


class Hasher:
    """Rolling hashes of all grams of one length; the power tables are kept between calls."""

    def __init__(self, length: int, seed: int = 1):
        self.length, self.table, self.n = length, _TABLE[seed], 0
        self.base = _BASE if seed == 1 else np.uint64(0xD6E8FEB86659FD93)

    def __call__(self, data: np.ndarray) -> np.ndarray:
        """Hash of data[i:i+length] for every i."""
        m = len(data) - self.length + 1
        if m <= 0:
            return np.empty(0, np.uint64)
        with np.errstate(over="ignore"):
            if self.n < len(data):
                self.n = max(len(data), 2 * self.n)
                self.up, self.down = _powers(self.n, self.base), _powers(self.n, _inverse(int(self.base)))
            sums = np.empty(len(data) + 1, np.uint64)
            sums[0] = 0
            np.cumsum(self.table[data] * self.up[: len(data)], out=sums[1:])
            return _mix((sums[self.length :] - sums[:m]) * self.down[:m])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each window of width values, by running minima from block borders."""
    n = len(values)
    size = -(-n // width) * width
    block = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    block[:n] = values
    block = block.reshape(-1, width)
    left = np.minimum.accumulate(block, axis=1).ravel()
    right = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


_LOW = np.uint64((1 << 22) - 1)


def cover_sample(data: np.ndarray, hasher: Hasher, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(place, first, last, hash): sample places and the run of string starts that each stands for.

    data has fewer than 4 million bytes.
    """
    if len(data) < length:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    h = hasher(data)
    at = np.arange(len(h), dtype=np.uint64)
    # Upper bits of the hash, then the place counted from the right: the least is the rightmost of equals.
    least = sliding_least((h & ~_LOW) | (_LOW - at), length - gram + 1)
    place = (_LOW - (least & _LOW)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    last = np.concatenate((first[1:] - 1, [len(place) - 1]))
    place = place[first]
    return place, first, last, h[place]


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hasher = Hasher(GRAM)
    for pdf in batches:
        cols: list[list[np.ndarray]] = [[], [], [], [], []]

        def full() -> pd.DataFrame:
            key, gram, place, first, last = (np.concatenate(c) for c in cols)
            for c in cols:
                c.clear()
            return pd.DataFrame({"key": key, "gram": gram.view(np.int64), "place": place, "first": first, "last": last})

        rows = 0
        for key, text in zip(pdf["key"], pdf["text"], strict=True):
            raw = np.frombuffer(text.encode(), np.uint8)
            for start in range(0, max(1, len(raw) - LENGTH + 1), PIECE):
                place, first, last, h = cover_sample(raw[start : start + PIECE + LENGTH - 1], hasher)
                if len(place):
                    for c, v in zip(cols, (np.full(len(place), key), h, place + start, first + start, last + start), strict=True):
                        c.append(v)
                    rows += len(place)
                if rows > 50_000:
                    yield full()
                    rows = 0
        if rows:
            yield full()


def _reach(place: int, first: int, last: int, span: bytes) -> bytes:
    """The name of the bytes that a run of strings spans, by where they lie around their sample."""
    return xxhash.xxh3_128_digest(span, (place - first) * LENGTH + place - last)


def _contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bytes that a sample's strings reach, a row for each sample."""
    names = [c.split()[0] for c in CONTEXT.split(", ")]
    for pdf in batches:
        out: list[tuple] = []
        size = 0
        for key, text, samples in zip(pdf["key"], pdf["text"], pdf["samples"], strict=True):
            raw = text.encode()
            for s in samples:
                mine = raw[s["first"] : s["last"] + LENGTH]
                out.append((s["gram"], key, s["place"], s["first"], s["last"], _reach(s["place"], s["first"], s["last"], mine), mine))
                size += len(mine)
                if size > 4_000_000:
                    yield pd.DataFrame(out, columns=names)
                    out, size = [], 0
        if out:
            yield pd.DataFrame(out, columns=names)


CONTEXT = "gram bigint, key bigint, place bigint, first bigint, last bigint, reach binary, bytes binary"
SCANNED = "key bigint, gram bigint, place bigint, first bigint, last bigint"
FOUND = "key bigint, first bigint, last bigint"
BANDED = "key bigint, place bigint, first bigint, last bigint, core binary, reach binary"
_NAMERS: list[Hasher] = []


def _names(contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two names of every 400-byte string of the contexts, and each string's context and start in it."""
    if not _NAMERS:
        _NAMERS.extend((Hasher(LENGTH, 1), Hasher(LENGTH, 2)))
    sizes = np.array([len(c) for c in contexts], np.int64)
    raw = np.frombuffer(b"".join(contexts), np.uint8)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    counts = sizes - LENGTH + 1
    which = np.repeat(np.arange(len(contexts)), counts)
    inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at = starts[which] + inner
    return _NAMERS[0](raw)[at], _NAMERS[1](raw)[at], which, inner


def _runs(key: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive starts of one text."""
    order = np.lexsort((start, key))
    key, start = key[order], start[order]
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (start[1:] > start[:-1] + 1)))
    first = np.flatnonzero(new)
    return key[first], start[first], start[np.concatenate((first[1:] - 1, [len(start) - 1]))]


def _settle(keys: np.ndarray, firsts: np.ndarray, contexts: list[bytes]) -> pd.DataFrame | None:
    """Sorts the strings of whole buckets: runs of those found twice."""
    a, b, which, inner = _names(contexts)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    head = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    del a, b
    twice = order[~head | ~np.append(head[1:], True)]
    if not len(twice):
        return None
    key, first, last = _runs(keys[which[twice]], firsts[which[twice]] + inner[twice])
    return pd.DataFrame({"key": key, "first": first, "last": last})


def _buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole buckets, which arrive in order, gathered up to a megabyte."""
    held: list[pd.DataFrame] = []
    size = 0

    def settle(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        found = _settle(pdf["key"].to_numpy(), pdf["first"].to_numpy(), list(pdf["bytes"]))
        if found is not None:
            yield found

    for pdf in batches:
        held.append(pdf)
        size += int(pdf["bytes"].map(len).sum())
        if size < 1_000_000:
            continue
        pdf = pd.concat(held, ignore_index=True)
        same = pdf["gram"].to_numpy() == pdf["gram"].iloc[-1]
        cut = len(pdf) - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield from settle(pdf.iloc[:cut])
        held = [pdf.iloc[cut:]]
        size = int(held[0]["bytes"].map(len).sum())
    if held and sum(map(len, held)):
        yield from settle(pd.concat(held, ignore_index=True))


def _bands(width: int):
    """The bands of each sample's spans of starts (low to high), with the names of their cores and reaches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, place, first, spans, raw in zip(pdf["key"], pdf["place"], pdf["first"], pdf["spans"], pdf["bytes"], strict=True):
                for span in spans:
                    low, high = span["low"], span["high"]
                    for band in range((place - high) // width, (place - low) // width + 1):
                        near, far = band * width, min(band * width + width - 1, LENGTH - GRAM)
                        a, b = max(low, place - far), min(high, place - near)
                        core = xxhash.xxh3_128_digest(raw[place - near - first : place - far + LENGTH - first], band)
                        out.append((key, place, a, b, core, _reach(place, a, b, raw[a - first : b + LENGTH - first])))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in BANDED.split(", ")])

    return run


def runs_of_large_buckets(contexts: DataFrame) -> DataFrame:
    """(key, first, last) of the strings of large buckets that occur twice; see the module's text."""
    spans = contexts.select("key", "place", "first", "bytes", F.array(F.struct(F.col("first").alias("low"), F.col("last").alias("high"))).alias("spans"))
    settled = None
    for width in BANDS:
        bands = materialize(spans.mapInPandas(_bands(width), BANDED), "bands")
        spot = F.struct("key", "place", F.col("first").alias("low"), F.col("last").alias("high"))
        # Written out, so that Spark can split a very frequent name in the joins.
        classes = materialize(bands.groupBy("core", "reach").agg(F.count("*").alias("n"), F.min(spot).alias("spot")), "classes")
        here = bands.join(classes.where("n > 1").select("reach"), "reach", "left_semi").select("key", "first", "last")
        settled = here if settled is None else settled.unionByName(here)
        # One sample of each reach goes on, settled or not: the others may share strings with it.
        several = materialize(classes.groupBy("core").agg(F.count("*").alias("m")).where("m > 1").select("core"), "several")
        left = classes.join(several, "core", "left_semi").select("spot.*").groupBy("key", "place").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
        spans = contexts.select("key", "place", "first", "bytes").join(left, ["key", "place"])
    return settled


def repeated_runs(base: DataFrame) -> DataFrame:
    """(key, first, last): runs of starts of 400-byte strings that start elsewhere too; base: (key, text)."""
    scanned = base.select("key", "text").mapInPandas(_scan, SCANNED)
    samples = materialize(scanned.distinct(), "samples")
    # Written out, so that the join reads two plain exchanges and Spark can split a very frequent gram.
    shared = materialize(samples.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    kept = samples.join(shared.select("gram"), "gram")
    per_text = kept.groupBy("key").agg(F.collect_list(F.struct("gram", "place", "first", "last")).alias("samples"))
    # One row for each text, combined before the shuffle, so that copies cost nothing after it.
    texts = base.groupBy("key").agg(F.first("text").alias("text")).join(per_text, "key")
    contexts = materialize(texts.mapInPandas(_contexts, CONTEXT), "contexts")
    # Written out again, for the same reason.
    classes = materialize(contexts.groupBy("gram", "reach").agg(F.count("*").alias("n"), F.min(F.struct("key", "place")).alias("spot")), "classes")
    runs = contexts.join(classes.where("n > 1").select("gram", "reach"), ["gram", "reach"], "left_semi").select("key", "first", "last")
    several = materialize(classes.groupBy("gram").agg(F.count("*").alias("m")).where("m > 1").select("gram", (F.col("m") > PART).alias("large")), "several")
    chosen = classes.join(several, "gram").select("spot.key", "spot.place", "large")
    rest = materialize(contexts.drop("reach").join(chosen, ["key", "place"]), "rest")
    dealt = rest.where("not large").select("gram", "key", "first", "bytes").repartition("gram").sortWithinPartitions("gram")
    runs = runs.unionByName(materialize(dealt.mapInPandas(_buckets, FOUND), "found"))
    large = rest.where("large")
    if large.limit(1).count():
        runs = runs.unionByName(runs_of_large_buckets(large))
    return runs


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Removed runs of each text (byte offsets) and what is left."""
    for pdf in batches:
        out = []
        for key, text, runs in zip(pdf["key"], pdf["text"], pdf["runs"], strict=True):
            raw = text.encode()
            spans: list[list[int]] = []
            for first, last in sorted((r["first"], r["last"]) for r in runs):
                if spans and first <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], last + LENGTH)
                else:
                    spans.append([first, last + LENGTH])
            left, at = [], 0
            for first, end in spans:
                left.append(raw[at:first])
                at = end
            left.append(raw[at:])
            kept = b"".join(left)
            out.append((key, [{"first": f, "end": e} for f, e in spans], len(raw) - len(kept), kept))
        yield pd.DataFrame(out, columns=["key", "_spans", "_n_removed", "_kept"])


CUT = "key bigint, _spans array<struct<first:bigint,end:bigint>>, _n_removed bigint, _kept binary"


def texts_of(docs: DataFrame, text: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(id, key, text) of the texts long enough, and (key, n, bytes, id) by text."""
    base = docs.select(F.col(key).alias("id"), F.xxhash64(text_of(text), F.lit(17)).alias("key"), text_of(text).alias("text"))
    base = base.where(F.octet_length("text") >= LENGTH)
    return base, materialize(base.groupBy("key").agg(F.count("*").alias("n"), F.max(F.octet_length("text")).cast("long").alias("bytes"), F.min("id").alias("id")), "texts")


def repeats_by_text(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each different text with something to remove: key, _spans, _n_removed, _kept."""
    small_batches(docs.sparkSession)
    base, counted = texts_of(docs, text, key)
    runs = repeated_runs(base).groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    # A text that occurs twice or more is removed whole, by the same definition, and needs none of its rows: they may
    # have one id. Each of the others has one row.
    span = F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("bytes").alias("end")))
    whole = counted.where("n > 1").select("key", span.alias("_spans"), F.col("bytes").alias("_n_removed"), F.lit(b"").alias("_kept"))
    chosen = counted.where("n = 1").join(runs, "key")
    pairs = base.alias("t").join(chosen.alias("c"), (F.col("t.key") == F.col("c.key")) & F.col("t.id").eqNullSafe(F.col("c.id")))
    return pairs.select("t.key", "t.text", "c.runs").mapInPandas(_cut, CUT).unionByName(whole)


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The columns of docs and _spans (removed runs, byte offsets), _n_removed and _kept (bytes that are left)."""
    cut = repeats_by_text(docs, text, key).withColumnRenamed("key", "_key")
    out = docs.withColumn("_key", F.xxhash64(text_of(text), F.lit(17))).join(cut, "_key", "left").drop("_key")
    return out.withColumns({
        "_spans": F.coalesce("_spans", F.array().cast("array<struct<first:bigint,end:bigint>>")),
        "_n_removed": F.coalesce("_n_removed", F.lit(0).cast("long")),
        "_kept": F.coalesce("_kept", text_of(text).cast("binary")),
    })


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    cut = repeats_by_text(docs).select("key", "_n_removed", F.size("_spans").alias("_n_spans"), F.sha2("_kept", 256).alias("_sha"))
    rows = docs.select(
        "doc_id", F.xxhash64(text_of(), F.lit(17)).alias("key"), F.octet_length(text_of()).cast("long").alias("n_bytes"), F.sha2(text_of(), 256).alias("_own")
    )
    return rows.join(cut, "key", "left").select(
        "doc_id", "n_bytes", F.coalesce("_n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce(F.col("_n_spans").cast("long"), F.lit(0).cast("long")).alias("n_spans"), F.coalesce("_sha", "_own").alias("kept_sha256"),
    )

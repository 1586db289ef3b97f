"""Quality classifier: attention over passages, learned from labels of whole documents (multiple instances).

A text is a bag of passages of ``PASSAGE`` words. A passage is encoded from its characters alone: the shares of
pairs of character kinds (letters, capitals, digits, marks ...), and how often words repeat in it. Learned on
top: an encoding layer, gated attention weights (tanh times sigmoid, soft-maximum over the document's
passages) and a logistic score of the weighted mean, so a document is judged by the passages that tell.

Fitting uses labelled rows whose crc32(id) mod 4 is not 2, in the order of a hash of the id: at most ``FIT_ROWS``, and no more
than have ``FIT_BYTES`` of text together. All passages of these rows go to the driver, 522 bytes for each (the documented
bound: 137 MB where words have one letter, some 42 MB in prose). Scoring covers every row and every passage, inside Spark tasks; a very long text is encoded in groups of ``GROUP_BYTES``. The label, language, source and id are never inputs of a score.

Defined results: a null text is empty, and an empty text is one passage of zeros, scored like any other; rows
without a label or with a null one teach nothing; repeated rows are scored each; without any label all scores
are 0.5; a null id counts as the empty string in the division, and ids of any type pass as they are; an empty table
gives no rows; all columns are kept by :func:`score_documents`, except ones named like an added column (_held_out,
_score, _predicted).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, map_columns, small_batches, text_of

PASSAGE = 64
FIT_ROWS = 4000
FIT_BYTES = 32 << 20
KEEP_FROM = 0.7
KINDS = 16
ENCODED = 24
GATE = 12
EPOCHS = 40
#: Texts are encoded in groups of about this many bytes; a longer one is cut at white space.
GROUP_BYTES = 1 << 20

# Kinds of bytes.
_KIND_OF = {
    1: "aeiou", 2: "bcdfghjklmnpqrstvwxyz", 3: "ABCDEFGHIJKLMNOPQRSTUVWXYZ", 4: "0123456789", 5: " \t", 6: "\n\r\x0b\x0c", 7: ".,", 8: ";:?",
    9: "!", 10: "|", 11: "#*$%&<>", 12: "'\"", 13: "()[]{}", 14: "-_/\\=+@~^`",
}
_KIND = np.zeros(256, np.uint8)
_KIND[128:] = 15
for _k, _chars in _KIND_OF.items():
    for _c in _chars:
        _KIND[ord(_c)] = _k
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
FEATURES = KINDS * KINDS + 5


def pieces(text: str) -> list[bytes]:
    raw = text.encode("utf-8", "replace")
    out = []
    while len(raw) > GROUP_BYTES:
        at = max(raw.rfind(b" ", 0, GROUP_BYTES), raw.rfind(b"\n", 0, GROUP_BYTES)) + 1 or GROUP_BYTES
        out.append(raw[:at])
        raw = raw[at:]
    return [*out, raw]


def encode(group: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of the passages of some texts, and the number of passages of each; vectorised over the group."""
    raw = np.frombuffer(b" ".join([*group, b""]), np.uint8)
    lengths = np.array([len(g) + 1 for g in group])
    begin = np.cumsum(lengths) - lengths
    if not len(raw):
        return np.zeros((len(group), FEATURES), np.float32), np.ones(len(group), np.int64)
    space = _SPACE[raw]
    before = np.concatenate(([True], space[:-1]))
    start = np.flatnonzero(~space & before)
    end = np.flatnonzero(space & ~before)
    doc = np.searchsorted(begin, start, "right") - 1
    n_words = np.bincount(doc, minlength=len(group))
    n_passages = np.maximum(1, -(-n_words // PASSAGE))
    first_passage = np.cumsum(n_passages) - n_passages
    nth = np.arange(len(start)) - np.repeat(np.cumsum(n_words) - n_words, n_words)
    passage = first_passage[doc] + nth // PASSAGE
    total = int(n_passages.sum())
    out = np.zeros((total, FEATURES), np.float32)
    if not len(start):
        return out, n_passages
    word = np.cumsum(~space & before) - 1
    inside = word >= 0
    kind = _KIND[raw].astype(np.int64)
    pair = kind[:-1] * KINDS + kind[1:]
    code = passage[word[:-1]] * (KINDS * KINDS) + pair
    counts = np.bincount(code[inside[:-1]], minlength=total * KINDS * KINDS).reshape(total, -1)
    out[:, : KINDS * KINDS] = np.sqrt(counts / np.maximum(1, counts.sum(1, keepdims=True)))
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int((end - start).max()), 0x9E3779B97F4A7C15, np.uint64))
        at = np.arange(len(raw)) - start[np.maximum(word, 0)]
        mass = np.where(space | ~inside, np.uint64(0), (raw.astype(np.uint64) + np.uint64(1)) * powers[np.clip(at, 0, len(powers) - 1)])
        h = np.add.reduceat(mass, start)
        own = h * np.uint64(0xBF58476D1CE4E5B9) ^ (passage.astype(np.uint64) * np.uint64(0x94D049BB133111EB))
    size = np.bincount(passage, minlength=total)
    again = np.concatenate(([False], (h[1:] == h[:-1]) & (passage[1:] == passage[:-1])))
    _, where = np.unique(own, return_index=True)
    safe = np.maximum(1, size)
    base = KINDS * KINDS
    out[:, base] = np.bincount(passage, again, total) / safe
    out[:, base + 1] = np.bincount(passage[where], minlength=total) / safe
    out[:, base + 2] = np.bincount(passage, end - start, total) / safe / 10
    out[:, base + 3] = np.log1p(size) / 5
    # Share of words that are short, as function words are.
    out[:, base + 4] = np.bincount(passage, (end - start) <= 3, total) / safe
    return out, n_passages


def bags(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last text, features, number of passages of each): groups of whole texts."""
    at = 0
    while at < len(texts):
        group, owner, size, first = [], [], 0, at
        while at < len(texts) and (not group or size + len(texts[at]) <= GROUP_BYTES):
            for p in pieces(texts[at]):
                group.append(p)
                owner.append(at - first)
            size += len(texts[at])
            at += 1
        parts = []
        counts = np.zeros(at - first, np.int64)
        begin = 0
        while begin < len(group):  # one group is one call unless a text was cut
            stop, took = begin, 0
            while stop < len(group) and (stop == begin or took + len(group[stop]) <= 2 * GROUP_BYTES):
                took += len(group[stop])
                stop += 1
            x, n = encode(group[begin:stop])
            parts.append(x)
            np.add.at(counts, np.array(owner[begin:stop]), n)
            begin = stop
        yield first, at, np.concatenate(parts), counts


@dataclass
class Attention:
    mean: np.ndarray
    scale: np.ndarray
    w: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, counts: np.ndarray) -> tuple:
        first = np.cumsum(counts) - counts
        e = np.tanh(((x - self.mean) / self.scale) @ self.w["enc"] + self.w["enc_b"])
        t, g = np.tanh(e @ self.w["v"]), 1 / (1 + np.exp(-(e @ self.w["u"])))
        a = (t * g) @ self.w["a"]
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, first), counts))
        a /= np.repeat(np.add.reduceat(a, first), counts)
        z = np.add.reduceat(a[:, None] * e, first)
        y = 1 / (1 + np.exp(-np.clip(z @ self.w["c"] + self.w["c_b"], -30, 30)))
        return y, a, z, e, t, g

    def score(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.forward(x, counts)[0]


def fit(x: np.ndarray, counts: np.ndarray, labels: np.ndarray, seed: int = 5) -> Attention:
    """Adam over shuffled bags."""
    r = np.random.default_rng(seed)
    d, e, q = FEATURES, ENCODED, GATE
    w = {
        "enc": r.standard_normal((d, e)) * d**-0.5, "enc_b": np.zeros(e), "v": r.standard_normal((e, q)) * e**-0.5,
        "u": r.standard_normal((e, q)) * e**-0.5, "a": r.standard_normal(q) * q**-0.5, "c": r.standard_normal(e) * e**-0.5, "c_b": np.zeros(1),
    }
    model = Attention(x.mean(0), x.std(0) + 0.02, w)
    m, s = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    first = np.cumsum(counts) - counts
    step = 0
    for _ in range(EPOCHS):
        order = r.permutation(len(counts))
        for at in range(0, len(order), 64):
            pick = order[at : at + 64]
            n = counts[pick]
            rows = np.concatenate([np.arange(first[i], first[i] + counts[i]) for i in pick])
            xs = (x[rows] - model.mean) / model.scale
            y, a, z, enc, t, g = model.forward(x[rows], n)
            dy = (y - labels[pick]) / len(pick)
            grads = {"c": z.T @ dy, "c_b": np.array([dy.sum()])}
            dz = np.repeat(dy[:, None] * w["c"], n, 0)
            de = a[:, None] * dz
            da = (dz * enc).sum(1)
            start = np.cumsum(n) - n
            dl = a * (da - np.repeat(np.add.reduceat(a * da, start), n))
            tg = t * g
            grads["a"] = tg.T @ dl
            dtg = dl[:, None] * w["a"]
            dt, dg = dtg * g * (1 - t**2), dtg * t * g * (1 - g)
            grads["v"], grads["u"] = enc.T @ dt, enc.T @ dg
            de = (de + dt @ w["v"].T + dg @ w["u"].T) * (1 - enc**2)
            grads["enc"], grads["enc_b"] = xs.T @ de, de.sum(0)
            step += 1
            for k in w:
                gk = grads[k] + 1e-4 * w[k]
                m[k] += 0.1 * (gk - m[k])
                s[k] += 0.001 * (gk**2 - s[k])
                w[k] -= 4e-3 * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    return model


def is_held_out(key: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(4)) == 2


def _encode_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts = list(pdf["text"])
        labels = pdf["label"].to_numpy()
        for first, last, x, counts in bags(texts):
            bag = [x[e - c : e] for c, e in zip(counts, np.cumsum(counts), strict=True)]
            yield pd.DataFrame({"label": labels[first:last], "n": [len(b) for b in bag], "x": [b.astype(np.float16).tobytes() for b in bag]})


def train_on(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", rows: int = FIT_ROWS, size: int = FIT_BYTES) -> Attention | None:
    """The model of at most rows labelled rows with at most size bytes of text; labels: (key, label)."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~is_held_out(F.col(key))).select(F.col(key).alias("_id"), F.col(label).cast("int").alias("label"))
    chosen = known.join(docs.select(F.col(key).alias("_id")).distinct(), "_id", "left_semi").orderBy(F.xxhash64("_id", F.lit(3)), "_id").limit(rows)
    # At most rows rows: safe to send to every task, and to sum in one.
    texts = docs.select(F.col(key).alias("_id"), text_of(text).alias("text"))
    sized = texts.select("_id", F.octet_length("text").alias("size")).join(F.broadcast(chosen), "_id").groupBy("_id", "label").agg(F.sum("size").alias("size"))
    upto = F.sum("size").over(Window.orderBy(F.xxhash64("_id", F.lit(3)), "_id", "label").rowsBetween(Window.unboundedPreceding, 0))
    chosen = sized.withColumn("upto", upto).where(F.col("upto") <= size).select("_id", "label")
    pairs = texts.join(F.broadcast(chosen), "_id").select("text", "label")
    got = pairs.mapInPandas(_encode_rows, "label int, n bigint, x binary").collect()
    if not got:
        return None
    x = np.concatenate([np.frombuffer(g["x"], np.float16).reshape(-1, FEATURES) for g in got]).astype(np.float32)
    return fit(x, np.array([g["n"] for g in got]), np.array([float(g["label"] == 1) for g in got]))


def scorer(model: Attention | None) -> Callable:
    def prepare() -> Callable[[list[str]], dict[str, list]]:
        def run(texts: list[str]) -> dict[str, list]:
            out = np.full(len(texts), 0.5)
            if model is not None:
                for first, last, x, counts in bags(texts):
                    out[first:last] = model.score(x, counts)
            return {"_score": out}

        return run

    return prepare


def score_documents(docs: DataFrame, model: Attention | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The columns of docs and _held_out, _score (0 to 1) and _predicted (1 from KEEP_FROM on)."""
    small_batches(docs.sparkSession)
    docs = docs.drop("_held_out", "_score", "_predicted")
    wide = docs.withColumn("_scored_text", text_of(text))
    out = map_columns(wide, scorer(model), ["_scored_text"], "_score double", ("_scored_text",))
    return out.withColumns({"_held_out": is_held_out(F.col(key)), "_predicted": (F.col("_score") >= KEEP_FROM).cast("int")})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    small_batches(spark)
    model = train_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    # Only the id and the text go to the tasks, and the text does not come back.
    rows = docs.select("doc_id", text_of().alias("_text"))
    out = map_columns(rows, scorer(model), ["_text"], "_score double", ("_text",))
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= KEEP_FROM).cast("int").alias("predicted"))

"""Language-model scores: a causal self-attention model over subword classes, trained in numpy on Spark.

Tokens of the base: the words of the lower-cased (A-Z) text, then one end. The model reads the same words as
subword ids of a public byte-level vocabulary (each word with a space before it, so the ids give back the
words), then one end. An id's class (its group first, then the
class in it) is predicted by attention over the ids before it, the id itself within its
class by its share in the corpus: P(word) = product over its ids of P(class | ids before) * P(id | class).
Frequent ids are classes of their own, the others share classes; every id of the vocabulary has a probability,
so texts of any script are scored. A word of the training texts is also given ``1 - SHARE`` of its smoothed
share of all training tokens (words that they lack get nothing of that, so the mixture's sum stays below one).

What is gathered from the corpus, all of it growing with the input:
1. word counts of all training texts (counted inside each task, then summed by Spark);
2. id counts, from the table of words;
3. counts of class pairs over all training texts: the pairs' log shares are the model's output bias by the
   last class, so attention learns only what they lack;
4. training windows: the windows that tile every training text, so each of its ids is learned once. They are dealt
   into ``ROUNDS`` equal parts; in a round each task trains on its own windows of one part, by Adam from common
   weights with batches that grow from ``FIRST_BATCH`` to ``LAST_BATCH`` windows, and the weights are averaged.

Scoring cuts a text's ids into windows of ``WINDOW`` that overlap by ``OVERLAP``: masked attention runs over a
batch of windows, and each id is scored once, by the window that shows most of what comes before it; for ids of
a window that an earlier one scores, only what others attend to is computed.

The base's word counts: words of at least some count go to the tasks in one broadcast table. The least count is found
by an aggregate over powers of two to the quarter, such that at most ``FREQUENT`` words have it; a word of over 64
bytes goes as its hash. All other words are joined with the table of counts, in which no other word is more frequent.

Defined results: a null text is empty and has one token, its end; a null doc_id counts as the empty string in
the division into training and held-out rows, and ids of any type pass as they are; repeated rows are scored each; very
long texts are scored whole, a group of texts of ``GROUP_WORDS`` words (or one longer text) at a time; an empty table
gives no rows; a table without training rows gives uniform scores; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_columns, materialize, small_batches, text_of

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Words come one to a line, with a space before each; they hold neither.
PATTERN = r" [^ \n]+|\n"
CLASSES = 512
SINGLE = 480
GROUP = 32
GROUPS = CLASSES // GROUP
WIDTH = 24
PAD = 65535
HIDDEN = 32
WINDOW = 32
OVERLAP = 16
ROUNDS = 4
FIRST_BATCH = 16
LAST_BATCH = 64
#: A batch doubles after this many steps.
GROWS_AFTER = 64
RATE = 8e-3
SHARE = 0.5
FREQUENT = 100_000
CACHE = 300_000
#: Windows that are read at a time.
READ = 512
#: Words that a task counts at a time.
COUNTED = 1 << 21
SHARD = 16384
GROUP_WORDS = 100_000


def in_training(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(7)) != 2


def words(text: str) -> list[bytes]:
    """Words of a text, A-Z in lower case. Bytes know no other white space and no other case."""
    return text.encode("utf-8", "replace").lower().split()


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The same for an Arrow array of texts: all their words (binary) in order, and the number of words of each."""
    texts = pc.ascii_trim_whitespace(pc.ascii_lower(texts))
    lists = pc.ascii_split_whitespace(pc.if_else(pc.equal(texts, ""), pa.scalar(None, texts.type), texts))
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten().cast(pa.binary()), n


_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        _ENCODERS[path] = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), len(ranks)
    return _ENCODERS[path]


def lines_of(new: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words, a line end after each, and the places of those ends."""
    enc = encoder(path)[0]
    if not new:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    ids = np.array(enc.encode_ordinary("".join([f" {w.decode('utf-8', 'replace')}\n" for w in new])), np.int64)
    return ids, np.flatnonzero(ids == enc.encode_single_token(b"\n"))


# ---- the model -------------------------------------------------------------------------------------------


def new_weights(seed: int = 7) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    draw = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
    d, h = WIDTH, HIDDEN
    return {
        "emb": draw(CLASSES, d, scale=0.3), "pos": draw(WINDOW, d, scale=0.1), "q": draw(d, d, scale=d**-0.5), "k": draw(d, d, scale=d**-0.5),
        "v": draw(d, d, scale=d**-0.5), "o": draw(d, d, scale=0.5 * d**-0.5), "w1": draw(d, h, scale=d**-0.5), "b1": np.zeros(h, np.float32),
        "w2": draw(h, d, scale=0.5 * h**-0.5), "out": draw(d, CLASSES, scale=0.02), "bias": np.zeros(CLASSES, np.float32),
        "gout": draw(d, GROUPS, scale=0.02), "gbias": np.zeros(GROUPS, np.float32),
    }


def flat(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([v.ravel() for v in w.values()]).astype(np.float32)


def unflat(x: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, v in new_weights().items():
        out[k] = np.asarray(x[at : at + v.size], np.float32).reshape(v.shape).copy()
        at += v.size
    return out


_MASK = np.triu(np.full((WINDOW, WINDOW), -1e9, np.float32), 1)


def projections(w: dict[str, np.ndarray]) -> np.ndarray:
    """What a place attends with and gives, (WIDTH, 2 * WIDTH): queries (scaled) times keys, and values times outputs.

    Both products are of weights alone, so a place's input takes the part of its key and its value needs no output projection.
    """
    return np.concatenate((w["q"] @ w["k"].T * np.float32(WIDTH**-0.5), w["v"] @ w["o"]), 1)


def capped(z: np.ndarray) -> np.ndarray:
    """Logits, at most 60, in place. They hardly ever reach that, and a maximum is found faster than one is set."""
    if z.size and not z.max() <= 60:
        np.minimum(z, 60, out=z)
    return z


def after_attention(w: dict[str, np.ndarray], h1: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Hidden states of rows from their inputs and what they attend to (h1: the sum); with keep, a one beside each."""
    t = h1 @ w["w1"]
    # Rows by sixteen: numpy adds a long row faster than many short ones.
    wide = t.reshape(-1, 16 * HIDDEN)
    wide += np.tile(w["b1"], 16)
    np.maximum(wide, np.zeros(16 * HIDDEN, t.dtype), out=wide)
    if keep is None:
        h2 = t @ w["w2"]
        h2 += h1
        return h2
    keep.update(h1=h1, t=t)
    h2 = np.ones((len(h1), WIDTH + 1), h1.dtype)
    np.add(t @ w["w2"], h1, out=h2[:, :WIDTH])
    return h2


def attended(w: dict[str, np.ndarray], x: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Hidden states (rows, WIDTH; with keep, a one beside each) of a batch of windows (n, WINDOW) of classes; each place sees itself and those before it."""
    h0 = w["emb"].take(x, axis=0)
    h0 += w["pos"]
    rows, project = h0.reshape(-1, WIDTH), projections(w)
    made = (rows @ project).reshape(*x.shape, 2 * WIDTH)
    q, v = made[..., :WIDTH], made[..., WIDTH:]
    a = q @ h0.transpose(0, 2, 1)
    a += _MASK
    capped(a)
    np.exp(a, out=a)
    a /= (a.reshape(-1, WINDOW) @ np.ones(WINDOW, a.dtype)).reshape(*x.shape, 1)
    c = a @ v
    if keep is not None:
        keep.update(h0=h0, project=project, q=q, v=v, a=a, c=c)
    return after_attention(w, c.reshape(-1, WIDTH) + rows, keep)


def attend(w: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    return attended(w, x).reshape(*x.shape, WIDTH)


def blocks_of(w: dict[str, np.ndarray]) -> np.ndarray:
    """Output weights of each group's classes, the biases below them: (GROUPS, WIDTH + 1, GROUP)."""
    return np.concatenate((w["out"], w["bias"][None])).reshape(WIDTH + 1, GROUPS, GROUP).transpose(1, 0, 2).copy()


class Reader:
    """Hidden states of windows with fixed weights. What a place asks with and gives is the sum of what its class and its
    place do, so each is worked out once for all classes and places and then looked up.
    """

    def __init__(self, w: dict[str, np.ndarray], pairs: tuple[np.ndarray, np.ndarray] | None = None):
        self.w, project = w, projections(w)
        self.by_class, self.by_place = (
            (h, np.ascontiguousarray(h @ project[:, :WIDTH]), np.ascontiguousarray(h @ project[:, WIDTH:])) for h in (w["emb"], w["pos"])
        )
        # The output's biases go to the log shares of pairs.
        self.outer, self.blocks = w["gout"], np.ascontiguousarray(blocks_of(w)[:, :WIDTH])
        self.pairs = None if pairs is None else (pairs[0] + w["gbias"], pairs[1] + w["bias"])

    def __call__(self, x: np.ndarray, start: int) -> np.ndarray:
        """(rows, WIDTH) of windows (n, WINDOW) of classes, from place start on."""
        x = x.astype(np.intp)
        h0, q, v = (c.take(at, axis=0) for c, at in zip(self.by_class, (x, x[:, start:], x), strict=True))
        h0 += self.by_place[0]
        q += self.by_place[1][start:]
        v += self.by_place[2]
        a = q @ h0.transpose(0, 2, 1)
        a += _MASK[start:]
        capped(a)
        np.exp(a, out=a)
        h1 = (a @ v).reshape(-1, WIDTH)
        h1 /= (a.reshape(-1, WINDOW) @ np.ones(WINDOW, a.dtype))[:, None]
        h1 += h0[:, start:].reshape(-1, WIDTH)
        return after_attention(self.w, h1)


def exponentials(z: np.ndarray) -> np.ndarray:
    """Turns logits (at most 60), in place, into their exponentials; returns the sums. Logits are log shares plus small terms."""
    np.exp(z, out=z)
    return z @ np.ones(z.shape[1], z.dtype)


def log_shares(
    outer: np.ndarray, blocks: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], h: np.ndarray, at: np.ndarray, x: np.ndarray, y: np.ndarray,
    grad: dict[str, np.ndarray] | None = None,
) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log P(class y) for the rows at of hidden states h and of the last classes x, in two steps: group, then class.

    outer and blocks are the output weights, the biases below them where the states have a one beside them. With grad: puts the output weights' gradients
    of the summed loss into it and returns that of h too, nothing for the other rows.
    """
    y = y.take(at)
    order = np.argsort((y // GROUP).astype(np.uint8), kind="stable")
    ys, rows_of = y.take(order).astype(np.int64), at.take(order)
    group, xs = ys // GROUP, x.take(rows_of).astype(np.int64)
    n = len(ys)
    # Rows of a group follow one another.
    hs = h.take(rows_of, axis=0)
    p = hs @ outer
    p += pairs[0].take(xs, axis=0)
    ends = np.searchsorted(group, np.arange(GROUPS + 1)).tolist()
    spans = [(g, slice(ends[g], ends[g + 1])) for g in range(GROUPS) if ends[g] < ends[g + 1]]
    xs *= GROUPS
    xs += group
    r = np.empty((n, GROUP), hs.dtype)
    for g, span in spans:
        np.matmul(hs[span], blocks[g], out=r[span])
    r += pairs[1].reshape(-1, GROUP).take(xs, axis=0)
    mine, own = np.arange(0, n * GROUPS, GROUPS), np.arange(0, n * GROUP, GROUP)
    mine += group
    own += ys
    own -= group * GROUP
    got = capped(p).ravel().take(mine) + capped(r).ravel().take(own)
    sums, inner = exponentials(p), exponentials(r)
    got -= np.log(sums)
    got -= np.log(inner)
    out = np.empty_like(got)
    out[order] = got
    if grad is None:
        return out, None
    p /= sums[:, None]
    r /= inner[:, None]
    p.ravel()[mine] -= 1
    r.ravel()[own] -= 1
    # The last row is for rows without a loss.
    by_outer, of_blocks, ds = hs.T @ p, np.zeros_like(blocks), np.zeros((n + 1, WIDTH), r.dtype)
    for g, span in spans:
        np.matmul(hs[span].T, r[span], out=of_blocks[g])
        np.matmul(r[span], blocks[g, :WIDTH].T, out=ds[span])
    ds[:n] += p @ outer[:WIDTH].T
    flat_blocks = of_blocks.transpose(1, 0, 2).reshape(WIDTH + 1, CLASSES)
    grad["gout"], grad["gbias"], grad["out"], grad["bias"] = by_outer[:-1], by_outer[-1], flat_blocks[:-1], flat_blocks[-1]
    back = np.full(len(h), n)
    back[rows_of] = np.arange(n)
    return out, ds.take(back, axis=0)


def gradients(w: dict[str, np.ndarray], pairs: tuple[np.ndarray, np.ndarray], x: np.ndarray, y: np.ndarray, valid: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss over the valid places of a batch and its gradient."""
    m: dict = {}
    h2 = attended(w, x, m)
    at = np.flatnonzero(valid)
    n = np.float32(max(1, len(at)))
    g: dict[str, np.ndarray] = {}
    x_flat = x.ravel()
    logs, dh2 = log_shares(np.concatenate((w["gout"], w["gbias"][None])), blocks_of(w), pairs, h2, at, x_flat, y.ravel(), g)
    for k in g:
        g[k] /= n
    dh2 /= n
    g["w2"] = m["t"].T @ dh2
    dt = dh2 @ w["w2"].T
    dt *= m["t"] > 0
    g["w1"], g["b1"] = m["h1"].T @ dt, np.ones(len(dt), dt.dtype) @ dt
    dh1 = dt @ w["w1"].T
    dh1 += dh2
    dc = dh1.reshape(m["c"].shape)
    made = np.empty((*x.shape, 2 * WIDTH), dc.dtype)
    np.matmul(m["a"].transpose(0, 2, 1), dc, out=made[..., WIDTH:])
    ds = dc @ m["v"].transpose(0, 2, 1)
    ds -= ((dc * m["c"]).reshape(-1, WIDTH) @ np.ones(WIDTH, dc.dtype)).reshape(*x.shape, 1)
    ds *= m["a"]
    np.matmul(ds, m["h0"], out=made[..., :WIDTH])
    made = made.reshape(-1, 2 * WIDTH)
    project = m["h0"].reshape(-1, WIDTH).T @ made
    asked, given = project[:, :WIDTH] * np.float32(WIDTH**-0.5), project[:, WIDTH:]
    g["q"], g["k"], g["v"], g["o"] = asked @ w["k"], asked.T @ w["q"], given @ w["o"].T, w["v"].T @ given
    dh0 = made @ m["project"].T
    dh0 += dh1
    dh0 += (ds.transpose(0, 2, 1) @ m["q"]).reshape(-1, WIDTH)
    g["pos"] = dh0.reshape(*x.shape, WIDTH).sum(0)
    at_weight = (x_flat.astype(np.int64) * WIDTH)[:, None] + np.arange(WIDTH)
    g["emb"] = np.bincount(at_weight.ravel(), dh0.ravel(), CLASSES * WIDTH).reshape(CLASSES, WIDTH).astype(dh0.dtype)
    return -float(logs.mean()) if len(logs) else 0.0, g


class Trainer:
    """Adam over batches of windows (n, WINDOW + 1) of classes; PAD marks places after a text's end."""

    def __init__(self, w: dict[str, np.ndarray], pairs: tuple[np.ndarray, np.ndarray], seed: int, rate: float = RATE):
        self.pairs, self.rate, self.step = pairs, rate, 0
        # All weights in one array, and by name as parts of it.
        self.all = np.concatenate([v.ravel() for v in w.values()])
        ends = np.cumsum([v.size for v in w.values()])
        self.w = {k: self.all[end - v.size : end].reshape(v.shape) for (k, v), end in zip(w.items(), ends, strict=True)}
        self.m, self.s, self.room = np.zeros_like(self.all), np.zeros_like(self.all), np.empty_like(self.all)
        self.random = np.random.default_rng(seed)

    def learn(self, windows: np.ndarray) -> None:
        order, at = self.random.permutation(len(windows)), 0
        while at < len(order):
            size = min(LAST_BATCH, FIRST_BATCH << (self.step // GROWS_AFTER))
            part = windows[order[at : at + size]]
            at += size
            self.step += 1
            valid = part[:, 1:] != PAD
            part = np.where(part == PAD, 0, part).astype(np.int64)
            _, g = gradients(self.w, self.pairs, part[:, :-1], part[:, 1:], valid)
            g = np.concatenate([g[k].ravel() for k in self.w])
            # In place: all -= rate * (m / (1 - 0.9^step)) / (sqrt(s / (1 - 0.99^step)) + 1e-8).
            self.m *= 0.9
            self.m += np.multiply(g, 0.1, out=self.room)
            g *= g
            g *= 0.01
            self.s *= 0.99
            self.s += g
            scale = (1 - 0.99**self.step) ** 0.5
            np.sqrt(self.s, out=g)
            g += 1e-8 * scale
            np.divide(self.m, g, out=g)
            g *= self.rate * scale / (1 - 0.9**self.step)
            self.all -= g


def cut(classes: np.ndarray, starts: np.ndarray, overlap: int = OVERLAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of texts whose classes follow one another: (windows (n, WINDOW + 1), text, first scored place of each).

    A text's row begins and ends with class 0, the end; places after its last end are PAD.
    """
    stride = WINDOW - overlap
    n = np.diff(np.append(starts, len(classes))) - 1  # predictions of each text
    count = 1 + np.maximum(0, -(-(n - WINDOW) // stride))
    doc = np.repeat(np.arange(len(n)), count)
    last = np.cumsum(count) - 1
    nth = np.arange(len(doc)) - np.repeat(last - count + 1, count)
    padded = np.concatenate((classes, np.full(WINDOW + 1, PAD, np.uint16)))
    out = np.lib.stride_tricks.sliding_window_view(padded, WINDOW + 1)[starts[doc] + nth * stride]
    # Only a text's last window reaches past its end.
    tails = out[last]
    tails[np.arange(WINDOW + 1) > (n - nth[last] * stride)[:, None]] = PAD
    out[last] = tails
    return out, doc, np.where(nth > 0, overlap, 0)


def dictionary_key(word: bytes) -> bytes:
    """A word, or the hash of a long one; no word holds a line end."""
    return word if len(word) <= 64 else hashlib.md5(word).hexdigest().encode() + b"\n"


@dataclass
class Model:
    path: str
    class_of: np.ndarray  # by id; the last entry is the end
    log_id: np.ndarray  # natural log P(id | class), by id
    pairs: tuple[np.ndarray, np.ndarray] | None = None  # log shares of groups, and of classes in their group, by the last class
    weights: dict[str, np.ndarray] | None = None
    frequent: pa.Table | None = None  # word, logarithm of its count
    known: dict[bytes, float] | None = None  # the same as a dictionary, made in a task
    cache: dict[bytes, int] = field(default_factory=dict)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("sizes", "logs", "bases", "offsets", "pool", "used", "reader")} | {"cache": {}, "known": None}

    def learn(self, new: list[bytes]) -> None:
        """Puts words into the cache, all encoded in one call; what is known of them goes into arrays by their number."""
        if not self.cache:
            room = max(CACHE, len(new))  # one very long text may have more words than the cache
            self.sizes, self.offsets = np.zeros(room, np.int64), np.zeros(room, np.int64)
            self.logs, self.bases = np.zeros(room), np.zeros(room)
            self.pool, self.used = np.zeros(1 << 20, np.uint16), 0
        ids, ends = lines_of(new, self.path)
        logs = np.concatenate(([0.0], np.cumsum(self.log_id[ids])))
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(ends)]
        at = slice(len(self.cache), len(self.cache) + len(new))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        self.pool[self.used : self.used + len(ids)] = self.class_of[ids]
        self.sizes[at], self.offsets[at], self.logs[at] = ends - starts, starts + self.used, logs[ends] - logs[starts]
        if self.known is None:
            t = self.frequent
            self.known = {} if t is None else dict(zip(t["word"].to_pylist(), t["logs"].to_pylist(), strict=True))
        get = self.known.get
        self.bases[at] = [get(dictionary_key(w), np.nan) for w in new]
        self.used += len(ids)
        self.cache.update(zip(new, range(at.start, at.stop), strict=True))

    def numbers(self, texts: pa.Array | list[list[bytes]]) -> np.ndarray:
        """The cache's numbers of all words of some texts, in order."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(list(chain.from_iterable(texts)), pa.binary())
        coded = texts.dictionary_encode()
        different = coded.dictionary.to_pylist()
        known_as = np.fromiter(map(self.cache.get, different, repeat(-1)), np.int64, len(different))
        new = np.flatnonzero(known_as < 0)
        if len(self.cache) + len(new) > CACHE:
            self.cache.clear()
            new = np.arange(len(different))
        if len(new) or not self.cache:
            known_as[new] = np.arange(len(self.cache), len(self.cache) + len(new))
            self.learn([different[i] for i in new.tolist()])
        return known_as.take(coded.indices.to_numpy())

    def sequence(self, words: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Classes of the texts one after another, each between two ends, and where each begins."""
        size = self.sizes.take(words)
        doc = np.repeat(np.arange(len(n_words)), n_words)
        before = np.cumsum(size) - size
        total = int(size.sum())
        at = np.repeat(self.offsets.take(words) - before, size)
        at += np.arange(total)
        # A text's ids stand after two ends for each text before it, and its own first one.
        of_text = np.bincount(doc, size, len(n_words)).astype(np.int64)
        inside = np.ones(total + 2 * len(n_words), bool)
        inside[np.cumsum(of_text + 2) - 1] = inside[np.cumsum(of_text + 2) - of_text - 2] = False
        out = np.zeros(len(inside), np.uint16)
        out[inside] = self.pool.take(at)
        return out, np.cumsum(of_text + 2) - of_text - 2

    def log_classes(self, classes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Natural log P of each class of the texts in turn, each text's end included; batches of windows."""
        windows, doc, first = cut(classes, starts)
        lengths = np.diff(np.append(starts, len(classes))) - 1
        begin = (np.cumsum(lengths) - lengths)[doc]  # where the texts' predictions begin
        nth = np.arange(len(doc)) - np.searchsorted(doc, doc)
        out = np.empty(int(lengths.sum()), np.float64)
        if getattr(self, "reader", None) is None or self.reader.w is not self.weights:
            self.reader = Reader(self.weights, self.pairs)
        read = self.reader
        for start in (0, OVERLAP):
            own = np.flatnonzero(first == start)
            for at in range(0, len(own), READ):
                pick = own[at : at + READ]
                part = windows[pick]
                scored = np.flatnonzero(part[:, 1 + start :] != PAD)
                part = np.where(part == PAD, 0, part)
                h = read(part[:, :-1], start)
                place = (begin[pick] + nth[pick] * (WINDOW - OVERLAP))[:, None] + np.arange(start, WINDOW)
                last, following = part[:, start:-1].ravel(), part[:, 1 + start :].ravel()
                out[place.ravel().take(scored)] = log_shares(read.outer, read.blocks, read.pairs, h, scored, last, following)[0]
        return out


def classes(counts: dict[int, int], ends: int, path: str) -> Model:
    """Frequent ids are classes of their own; the others share the rest by rank, apart by a space in front."""
    enc, size = encoder(path)
    c = np.zeros(size + 1, np.int64)
    for i, n in counts.items():
        c[i] = n
    order = np.lexsort((np.arange(size), -c[:size]))
    class_of = np.zeros(size + 1, np.uint16)
    class_of[order[: SINGLE - 1]] = np.arange(1, SINGLE)
    spaced = np.zeros(size, bool)
    for token, i in enc._mergeable_ranks.items():
        spaced[i] = token[:1] == b" "
    rest, half = order[SINGLE - 1 :], (CLASSES - SINGLE) // 2
    for base, group in ((SINGLE, rest[spaced[rest]]), (SINGLE + half, rest[~spaced[rest]])):
        mass = np.cumsum(c[group] + 1.0)
        class_of[group] = base + np.minimum(half - 1, (mass / mass[-1] * half).astype(int))
    c[size] = ends
    total = np.bincount(class_of, c + 1.0, CLASSES)
    log_id = np.log((c + 1.0) / total[class_of])
    log_id[size] = 0.0
    # Class 0 is the end's alone.
    return Model(path, class_of, log_id)


# ---- the Spark side --------------------------------------------------------------------------------------


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Array] = []

    def counted() -> pa.RecordBatch:
        got = pa.concat_arrays(held).value_counts()
        held.clear()
        return pa.RecordBatch.from_arrays([got.field("values"), got.field("counts")], ["word", "c"])

    for batch in batches:
        held.append(split(batch.column(0))[0])
        if sum(map(len, held)) > COUNTED:
            yield counted()
    if held:
        yield counted()


def count_ids(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(encoder(path)[1], np.int64)
        for pdf in batches:
            if len(pdf):
                ids, ends = lines_of([bytes(w) for w in pdf["word"]], path)
                of_word = np.repeat(pdf["c"].to_numpy(np.int64), np.diff(np.concatenate(([-1], ends))))
                of_word[ends] = 0
                total += np.bincount(ids, of_word, len(total)).astype(np.int64)
        used = np.flatnonzero(total)
        yield pd.DataFrame({"id": used, "c": total[used]})

    return run


def count_pairs(shared):
    """Class pairs of all texts, a row for each first class, and all tiling windows, many in a row; first is -1 - round there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, block = shared.value, 0
        pairs = np.zeros(CLASSES * CLASSES, np.int64)
        for pdf in batches:
            if not len(pdf):
                continue
            of_texts, n_words = split(pa.array(pdf["text"], pa.string()))
            seq, starts = model.sequence(model.numbers(of_texts), n_words)
            first = seq[:-1].astype(np.int64) * CLASSES + seq[1:]
            pairs += np.bincount(first, minlength=CLASSES * CLASSES)
            pairs[0] -= len(starts) - 1  # a text's end and the next one's beginning, both class 0
            windows, _, _ = cut(seq, starts, 0)
            for at in range(0, len(windows), 256):
                part = windows[at : at + 256]
                yield pd.DataFrame({"first": [-1 - block % ROUNDS], "n": [len(part)], "data": [part.tobytes()]})
                block += 1
        table = pairs.reshape(CLASSES, CLASSES)
        used = np.flatnonzero(table.any(1))
        yield pd.DataFrame({"first": used, "n": table[used].sum(1), "data": [sparse(table[i]) for i in used]})

    return run


def output_bias(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log shares of groups and of classes within their group after each class, smoothed by the shares overall."""
    share = (pairs.sum(0) + 1) / (pairs.sum() + CLASSES)
    p = (pairs + 4 * share) / (pairs.sum(1, keepdims=True) + 4)
    groups = p.reshape(CLASSES, GROUPS, GROUP).sum(2)
    inner = p / np.repeat(groups, GROUP, 1)
    return np.log(groups).astype(np.float32), np.log(inner).astype(np.float32)


def sparse(counts: np.ndarray) -> bytes:
    at = np.flatnonzero(counts)
    return np.concatenate((at, counts[at])).astype(np.int64).tobytes()


def dense(data: bytes) -> np.ndarray:
    at, n = np.frombuffer(data, np.int64).reshape(2, -1)
    out = np.zeros(CLASSES, np.int64)
    out[at] = n
    return out


def sum_pairs(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(map(dense, pdf["data"]))
    return pd.DataFrame({"first": [pdf["first"].iloc[0]], "n": [int(total.sum())], "data": [sparse(total)]})


def train_shard(shared, seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        trainer, n, part = None, 0, 0

        def step() -> None:
            nonlocal trainer, n, part
            windows = np.concatenate(held)
            held.clear()
            if trainer is None:
                trainer, part = Trainer(shared.value.weights, shared.value.pairs, seed, RATE / (1 + seed)), int(windows[0].sum()) % 16
            trainer.learn(windows)
            n += len(windows)

        for pdf in batches:
            for x in pdf["data"]:
                held.append(np.frombuffer(x, np.uint16).reshape(-1, WINDOW + 1))
                if sum(map(len, held)) >= SHARD:
                    step()
        if held:
            step()
        if trainer is not None:
            yield pd.DataFrame({"part": [part], "n": [n], "data": [(flat(trainer.w).astype(np.float64) * n).tobytes()]})

    return run


def sum_weights(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x, np.float64) for x in pdf["data"])
    return pd.DataFrame({"part": [pdf["part"].iloc[0]], "n": [int(pdf["n"].sum())], "data": [total.tobytes()]})


def frequent_words(counts: DataFrame, most: int = FREQUENT) -> tuple[pa.Table, int]:
    """(word, logs) of all words of at least some count, at most so many; and the level of that count."""
    level = F.floor(F.log2("c") * 4 + 1e-9).cast("int")
    sizes = {r["level"]: r["n"] for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()}  # 256 rows at most
    least, total = 1 << 20, 0
    for at in sorted(sizes, reverse=True):
        total += sizes[at]
        if total > most:
            break
        least = at
    word = F.when(F.octet_length("word") <= 64, F.col("word")).otherwise(F.concat(F.md5("word"), F.lit("\n")).cast("binary"))
    return counts.where(level >= least).select(word.alias("word"), F.log10(F.col("c") + 1).alias("logs")).toArrow(), least


def fit(docs: DataFrame, path: str = VOCABULARY) -> tuple[Model, DataFrame, int, int, int]:
    """The trained model, the table of word counts (word, c), N, V and the number of texts; docs: training texts (text)."""
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    counts = docs.mapInArrow(count_words, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))
    counts = materialize(counts, "words")
    ends = docs.count()
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ids = counts.mapInPandas(count_ids(path), "id bigint, c bigint").groupBy("id").agg(F.sum("c").alias("c"))
    model = classes({r["id"]: r["c"] for r in ids.collect()}, ends, path)  # one row for each id of the vocabulary at most
    seen = materialize(docs.mapInPandas(count_pairs(share(model)), "first bigint, n bigint, data binary"), "windows")
    pairs = np.zeros((CLASSES, CLASSES))
    for r in seen.where("first >= 0").groupBy("first").applyInPandas(sum_pairs, seen.schema).collect():
        pairs[r["first"]] = dense(r["data"])
    model.pairs = output_bias(pairs)
    model.weights = new_weights()
    for r in range(ROUNDS):
        windows = seen.where(F.col("first") == -1 - r).select("data", "n")
        parts = windows.mapInPandas(train_shard(share(model), r), "part int, n bigint, data binary")
        sums = parts.groupBy("part").applyInPandas(sum_weights, parts.schema).collect()  # 16 rows at most
        if sums:
            total = sum(np.frombuffer(x["data"], np.float64) for x in sums)
            model.weights = unflat(total / sum(x["n"] for x in sums))
    model.frequent = frequent_words(counts)[0]
    return model, counts, int(n) + ends, int(v) + (1 if ends else 0), ends


SCORES = "n bigint, known bigint, base double, score double, own double, rare array<struct<word:binary,own:double>>"


def groups(sizes: list[int]) -> Iterator[slice]:
    """Runs of texts of about GROUP_WORDS words together."""
    at = 0
    while at < len(sizes):
        stop, total = at, 0
        while stop < len(sizes) and (stop == at or total + sizes[stop] <= GROUP_WORDS):
            total += sizes[stop]
            stop += 1
        yield slice(at, stop)
        at = stop


def score_texts(shared, ends: int, size: float):
    """Per row: number of tokens, the known words' part of the base and of the score, the attention's own score, and the words to look up.

    size is ln(N + V + 1).
    """
    end, half, other = float(np.log10(ends + 1)), np.log(SHARE), np.log(1 - SHARE)

    def score_group(model: Model, of_texts: pa.Array, n_words: np.ndarray) -> dict[str, np.ndarray | pa.Array]:
        known_as = model.numbers(of_texts)
        seq, starts = model.sequence(known_as, n_words)
        logs = model.log_classes(seq, starts)
        # An end after the words of each text.
        closing = np.cumsum(n_words + 1) - 1
        sizes = np.ones(int(closing[-1]) + 1, np.int64)
        is_word = np.ones(len(sizes), bool)
        is_word[closing] = False
        sizes[is_word] = model.sizes.take(known_as)
        owns = np.add.reduceat(logs, np.cumsum(sizes) - sizes)
        owns[is_word] += model.logs.take(known_as)
        bases = np.full(len(sizes), end)
        bases[is_word] = model.bases.take(known_as)
        known = ~np.isnan(bases)
        mixed = np.logaddexp(owns[known] + half, bases[known] * np.log(10) - size + other)
        n = len(n_words)
        doc = np.repeat(np.arange(n), n_words + 1)
        lost = np.flatnonzero(~known)
        # Before a word stand its text's number of ends.
        rare = pa.StructArray.from_arrays([of_texts.take(pa.array(lost - doc[lost])), pa.array(owns[lost])], ["word", "own"])
        ends_of = np.concatenate(([0], np.cumsum(np.bincount(doc[lost], minlength=n))))
        return {
            "n": n_words + 1, "known": np.bincount(doc[known], minlength=n) - (ends == 0), "base": np.bincount(doc[known], bases[known], n),
            "score": np.bincount(doc[known], mixed, n), "own": np.bincount(doc, owns, n), "rare": pa.ListArray.from_arrays(pa.array(ends_of, pa.int32()), rare),
        }

    def prepare():
        model = shared.value

        def run(texts: pa.Array) -> dict[str, pa.Array]:
            of_texts, n_words = split(texts)
            ends_at, parts = np.concatenate(([0], np.cumsum(n_words))).tolist(), []
            for at in groups(n_words.tolist()):
                parts.append(score_group(model, of_texts.slice(ends_at[at.start], ends_at[at.stop] - ends_at[at.start]), n_words[at]))
            return {k: pa.concat_arrays([p[k] if k == "rare" else pa.array(p[k]) for p in parts]) for k in parts[0]}

        return run

    return prepare


def score(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str = VOCABULARY) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and attention_score (the model's without the words' shares) of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(key).alias("doc_id"), (~in_training(F.col(key))).alias("held_out"), text_of(text).alias("text"))
    model, counts, n, v, ends = fit(rows.where(~F.col("held_out")).select("text"), path)
    size = float(np.log(n + v + 1))
    shared = spark.sparkContext.broadcast(model)
    scored = map_columns(rows, score_texts(shared, ends, size), ["text"], SCORES, ("text",), arrow=True).withColumn("rid", F.monotonically_increasing_id())
    scored = materialize(scored, "scored")
    rare = scored.select("rid", F.explode("rare").alias("r")).select("rid", "r.word", "r.own").join(counts, "word", "left")
    # A word of the training texts has a share of both; one that they lack has the attention's alone.
    of_word = F.when(F.col("c").isNull(), F.col("own") + float(np.log(SHARE))).otherwise(
        F.log(F.exp("own") * SHARE + (1 - SHARE) * (F.col("c") + 1) / float(n + v + 1))
    )
    rare = rare.groupBy("rid").agg(F.count("c").alias("more"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("logs"), F.sum(of_word).alias("scores"))
    out = scored.drop("rare").join(rare, "rid", "left")
    zero, ten = F.lit(0.0), float(np.log(10))
    return out.select(
        "doc_id", "held_out", F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("logs", zero) - F.col("n") * (size / ten)).alias("base_score"),
        ((F.col("score") + F.coalesce("scores", zero)) / ten).alias("score"), (F.col("own") / ten).alias("attention_score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir).select("doc_id", "text"))

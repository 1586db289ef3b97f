"""Byte-level BPE encoding and decoding by a tree of halves.

A text is matched into words by the vocabulary's pattern, and each word's bytes are merged, the pair of least rank first
(the leftmost of equals). Neither is done over a whole text at once: a text longer than a leaf is cut in halves, which
are encoded on their own and joined. Joining is associative, so a text of any length is a tree, and the chunks of a giant
one (over ``GIANT`` characters) are encoded in different tasks and joined ``FAN`` at a time, level by level.

Joining neighbours encodes a window about their border anew, which grows until nothing outside it can change:

* Words. A match looks no further than one character beyond its end, and three beyond its start (``'re``). So a word of
  the left half stands unless it ends at the border or begins within two characters of it; the window begins with the
  first that doesn't stand. No match looks back, so as soon as a match in the window begins where a word of the right half
  begins, all words from there on are the right half's.
* Tokens inside a word over the border. Tokens are the encoding of their bytes exactly if each two neighbours among them
  are the encoding of their own bytes: until a first merge crosses a border between two tokens, merges within these two
  come in the order in which they come for these two alone, where none crosses. So the window's tokens stay as soon as its
  first and last are stable beside the tokens next to the window; else that side of the window is doubled.

Decoding joins the bytes of halves up the same tree.

Defined results: a null text is empty and has no ids; null ids, and ids that the vocabulary has not, stand for no bytes;
decoded bytes need not be text, so they are binary; repeated rows are encoded each; an empty table gives no rows; extra
columns pass as they are, whatever their names, and an added column takes the place of one of its name.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_columns, materialize, packed, small_batches, text_of, unpacked

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Characters of a leaf, of a text that is spread over tasks, and of its chunks; chunks that one step joins.
LEAF, GIANT, CHUNK, FAN = 4096, 65_536, 32_768, 16
#: Longer words are not kept between rows, and are encoded by halves; longer windows are merged by a heap.
LONG, HEAP = 64, 64
CACHED = 1 << 19
NEVER = 1 << 40

#: Words and, for each, its tokens.
Span = tuple[list[str], list[tuple[int, ...]]]


@lru_cache(maxsize=1)
def _foreign() -> dict[int, str]:
    """Characters that the regex module's tables and those of the library put into different classes, each with one of the class
    that the library puts it into. The tables follow different editions of Unicode, so both are asked about every character.
    """
    every = "".join(chr(i) for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000)
    kinds: list[dict[str, str]] = [{}, {}]
    for pattern, like in ((r"\p{L}", "é"), (r"\p{N}", "²"), (r"\s", " ")):
        ask = tiktoken.Encoding("kind", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        for at in range(0, len(every), 1 << 16):
            part = every[at : at + (1 << 16)]
            kinds[0].update(dict.fromkeys(bytes(ask.encode_ordinary(part)).decode(), like))
            kinds[1].update(dict.fromkeys(regex.findall(pattern, part), like))
    return {ord(c): kinds[0].get(c, "§") for c in kinds[0].keys() | kinds[1].keys() if kinds[0].get(c) != kinds[1].get(c)}


def halves_of(text: str, leaf: int) -> list[str]:
    """The leaves of a text that is cut in halves until none is longer than leaf; 2 ** k of them."""
    parts = [text]
    while max(map(len, parts)) > max(leaf, 1):
        parts = [half for p in parts for half in (p[: len(p) // 2], p[len(p) // 2 :])]
    return parts


class Words(dict):
    """Tokens of each short word met so far."""

    def __init__(self, encode: Callable[[str], tuple[int, ...]]):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> tuple[int, ...]:
        got = self.encode(word)
        if len(word) <= LONG:
            if len(self) >= CACHED:
                self.clear()
            self[word] = got
        return got


class Vocabulary:
    def __init__(self, path: str = RANKS, pattern: str = public_tokenizers.PATTERN):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}
        self.bytes = {rank: word for word, rank in self.rank.items()}
        # Pairs of tokens that are a token together, as sorted keys, for words that are merged in arrays.
        pairs = {(a << 32) + b: r for w, r in self.rank.items() for k in range(1, len(w)) if (a := self.rank.get(w[:k])) is not None and (b := self.rank.get(w[k:])) is not None}
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.single = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        self.pattern = regex.compile(pattern)
        self.tokens = Words(self.word)
        self.stable = lru_cache(maxsize=1 << 16)(self._stable)

    # ---- tokens of a word -------------------------------------------------------------------------------

    def merge(self, data: bytes) -> list[int]:
        """Tokens by merges alone."""
        rank = self.rank
        if len(data) > HEAP:
            return self._merge_long(data)
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [rank.get(a + b, 1 << 30) for a, b in zip(parts, parts[1:])]
        while pairs and (least := min(pairs)) < 1 << 30:
            i = pairs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = rank.get(parts[i - 1] + parts[i], 1 << 30)
            if i < len(pairs):
                pairs[i] = rank.get(parts[i] + parts[i + 1], 1 << 30)
        return [rank[p] for p in parts]

    def _merge_long(self, data: bytes) -> list[int]:
        """The same in time n log n: a heap of pairs (rank, start), the starts of the parts as a chain."""
        n, rank = len(data), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ends = list(range(1, n + 1))  # 0: the part is gone
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            j = after[i]
            if not ends[i] or j >= n or ends[j] != end:
                continue
            ends[i], ends[j], after[i] = end, 0, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := rank.get(data[i : ends[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, ends[after[i]]))
            if (h := before[i]) >= 0 and (r := rank.get(data[h:end])) is not None:
                heapq.heappush(heap, (r, h, end))
        out, i = [], 0
        while i < n:
            out.append(rank[data[i : ends[i]]])
            i = after[i]
        return out

    def _stable(self, a: int, b: int) -> bool:
        return self.merge(self.bytes[a] + self.bytes[b]) == [a, b]

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        """Tokens of the joined bytes of two encodings."""
        if not left or not right:
            return left + right
        k = m = 1
        while True:
            window = self.merge(b"".join(self.bytes[t] for t in left[len(left) - k :] + right[:m]))
            firm = k == len(left) or self.stable(left[-k - 1], window[0]), m == len(right) or self.stable(window[-1], right[m])
            if all(firm):
                return left[: len(left) - k] + window + right[m:]
            k, m = k if firm[0] else min(2 * k, len(left)), m if firm[1] else min(2 * m, len(right))

    def halves(self, data: bytes) -> list[int]:
        if len(data) <= LONG:
            return self.merge(data)
        return self.join_tokens(self.halves(data[: len(data) // 2]), self.halves(data[len(data) // 2 :]))

    def word(self, word: str) -> tuple[int, ...]:
        """A word that is itself a token is that token, whatever the merges give."""
        data = word.encode()
        return (self.rank[data],) if data in self.rank else tuple(self.halves(data))

    def _together(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that each pair merges to, NEVER where it is none."""
        key = (a << 32) + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], NEVER)

    def learn(self, words: list[str]) -> None:
        """Tokens of many new words at once: in each round every word makes its next merge."""
        datas = [w.encode() for w in words]
        if len(self.tokens) + len(words) > CACHED:
            self.tokens.clear()
        self.tokens.update((w, (self.rank[d],)) for w, d in zip(words, datas) if d in self.rank)
        open_ = [(w, d) for w, d in zip(words, datas) if d not in self.rank]
        ids = self.single[np.frombuffer(b"".join(d for _, d in open_), np.uint8)]
        owner = np.repeat(np.arange(len(open_)), [len(d) for _, d in open_])
        pair = np.append(self._together(ids[:-1], ids[1:]), NEVER) if len(ids) else ids
        pair[np.flatnonzero(np.diff(owner, append=-1))] = NEVER
        while len(ids):
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            sizes = np.diff(starts, append=len(ids))
            least = np.minimum.reduceat(pair, starts)
            done = least == NEVER
            if done.any():
                ends = np.cumsum(sizes[done]).tolist()
                gone = np.repeat(done, sizes)
                flat = ids[gone].tolist()
                for k, a, b in zip(owner[starts[done]].tolist(), [0, *ends], ends):
                    self.tokens[open_[k][0]] = tuple(flat[a:b])
                ids, owner, pair, sizes, least = ids[~gone], owner[~gone], pair[~gone], sizes[~done], least[~done]
                if not len(ids):
                    break
            at = np.flatnonzero(pair == np.repeat(least, sizes))
            at = at[np.diff(owner[at], prepend=-1) != 0]  # the leftmost of a word
            ids[at] = pair[at]
            stays = np.ones(len(ids), bool)
            stays[at + 1] = False
            ids, owner, pair = ids[stays], owner[stays], pair[stays]
            at -= np.arange(len(at))  # one part has gone before each, for each word before
            last = np.append(owner[1:] != owner[:-1], True)
            for k in (at[~last[at]], (at - 1)[(at > 0) & (owner[at] == owner[at - 1])]):
                pair[k] = self._together(ids[k], ids[k + 1])
            pair[at[last[at]]] = NEVER

    # ---- words of a text --------------------------------------------------------------------------------

    def words(self, text: str) -> list[str]:
        if text.isascii() or _foreign().keys().isdisjoint(map(ord, set(text))):
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(_foreign()))]

    def leaf(self, words: list[str]) -> Span:
        return words, list(map(self.tokens.__getitem__, words))

    def join(self, left: Span, right: Span) -> Span:
        """The span of the joined texts. The lists of left are used up."""
        (words, ids), (after, after_ids) = left, right
        if not words or not after:
            return left if words else right
        last, last_ids, tail = words[-1], ids[-1], ""
        while words and (not tail or len(tail) + len(words[-1]) < 3):
            tail = words.pop() + tail
            ids.pop()
        m = 1
        while True:
            head = after[:m]
            text, begins, at = tail + "".join(head), {}, len(tail)
            for k, w in enumerate(head):
                begins[at] = k
                at += len(w)
            found, at, meets = [], 0, None
            for w in self.words(text):
                if at in begins:
                    meets = begins[at]
                    break
                if m < len(after) and (at + len(w) == len(text) or at + 3 > len(text)):
                    break
                found.append(w)
                at += len(w)
            else:
                meets = len(after)
            if meets is not None:
                break
            m = min(2 * m, len(after))
        at = 0
        for w in found:
            whole = len(w) > LONG and at == len(tail) - len(last) and len(w) == len(last) + len(after[0]) and w.encode() not in self.rank
            ids.append(tuple(self.join_tokens(list(last_ids), list(after_ids[0]))) if whole else self.tokens[w])
            words.append(w)
            at += len(w)
        words += after[meets:]
        ids += after_ids[meets:]
        return words, ids

    def tree(self, leaves: list[list[str]]) -> Span:
        if len(leaves) == 1:
            return self.leaf(leaves[0])
        return self.join(self.tree(leaves[: len(leaves) // 2]), self.tree(leaves[len(leaves) // 2 :]))

    def spans(self, texts: list[str], leaf: int = LEAF) -> list[Span]:
        """The texts' trees. New words of all leaves are merged first, together."""
        leaves = [[self.words(part) for part in halves_of(t, leaf)] for t in texts]
        new = set(chain.from_iterable(chain.from_iterable(leaves))) - self.tokens.keys()
        self.learn([w for w in new if len(w) <= LONG])
        return [self.tree(x) for x in leaves]

    def encode(self, texts: list[str], leaf: int = LEAF) -> list[np.ndarray]:
        return [np.fromiter(chain.from_iterable(ids), np.int32) for _, ids in self.spans(texts, leaf)]

    def decode(self, ids: list[int], leaf: int = LEAF) -> bytes:
        if len(ids) <= max(leaf, 1):
            return b"".join([self.bytes.get(i, b"") for i in ids])
        return self.decode(ids[: len(ids) // 2], leaf) + self.decode(ids[len(ids) // 2 :], leaf)


@lru_cache(maxsize=4)
def vocabulary(path: str = RANKS) -> Vocabulary:
    return Vocabulary(path)


def _digests(v: Vocabulary, ids: list[np.ndarray]) -> dict[str, list]:
    return {
        "_ids_sha256": [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids],
        "_decoded_sha256": [hashlib.sha256(v.decode(x.tolist())).hexdigest() for x in ids],
    }


def _encoder(path: str, digests: bool, leaf: int) -> Callable:
    def prepare() -> Callable[[list[str]], dict[str, list]]:
        v = vocabulary(path)

        def run(texts: list[str]) -> dict[str, list]:
            ids = v.encode(texts, leaf)
            return {"_ids": ids} | (_digests(v, ids) if digests else {})

        return run

    return prepare


def lists_of(column: pa.Array) -> list[np.ndarray]:
    """The lists of an Arrow column as arrays; null lists as empty ones, null items as -1."""
    at = column.offsets.to_numpy()
    values = column.values.fill_null(-1).to_numpy(zero_copy_only=False)
    return [values[a:b] if there else values[:0] for a, b, there in zip(at, at[1:], column.is_valid().to_pylist())]


def _pieces(path: str, leaf: int):
    """Each chunk's span: tokens in a row and how many each word has."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(path)
        for pdf in batches:
            for gid, c, (_, ids) in zip(pdf["gid"], pdf["c"], v.spans(pdf["piece"].tolist(), leaf), strict=True):
                yield _row(gid, c, ids)

    return run


def _row(gid: int, c: int, ids: list[tuple[int, ...]]) -> pd.DataFrame:
    return pd.DataFrame({"gid": [gid], "c": [c], "ids": [np.fromiter(chain.from_iterable(ids), np.int32)], "sizes": [np.fromiter(map(len, ids), np.int32)]})


def _span_of(v: Vocabulary, ids: np.ndarray, sizes: np.ndarray) -> Span:
    flat, ends = ids.tolist(), np.cumsum(sizes).tolist()
    tokens = [tuple(flat[e - n : e]) for e, n in zip(ends, sizes.tolist())]
    return [v.decode(t).decode() for t in tokens], tokens


def _joiner(path: str):
    """The spans of up to FAN neighbours joined in pairs of pairs."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v, pdf = vocabulary(path), pdf.sort_values("c")
        spans = [_span_of(v, i, s) for i, s in zip(pdf["ids"], pdf["sizes"], strict=True)]
        while len(spans) > 1:
            spans = [v.join(*spans[i : i + 2]) if i + 1 < len(spans) else spans[i] for i in range(0, len(spans), 2)]
        return _row(pdf["gid"].iloc[0], int(pdf["c"].iloc[0]) // FAN, spans[0][1])

    return run


def _cut(chunk: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for gid, text in zip(pdf["gid"], pdf["text"], strict=True):
                for c in range(-(-len(text) // chunk)):
                    yield pd.DataFrame({"gid": [gid], "c": [c], "piece": [text[c * chunk : (c + 1) * chunk]]})

    return run


def encode_giants(texts: DataFrame, path: str = RANKS, chunk: int = CHUNK, leaf: int = LEAF) -> DataFrame:
    """(gid, ids) of (gid, text): chunks are encoded where they fall and joined up a tree with FAN branches."""
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = texts.mapInPandas(_cut(chunk), "gid bigint, c int, piece string").repartition(tasks, "gid", "c")
    spans = materialize(chunks.mapInPandas(_pieces(path, leaf), schema := "gid bigint, c int, ids array<int>, sizes array<int>"), "spans")
    most = spans.agg(F.max("c")).first()[0] or 0
    while most:
        spans = spans.groupBy("gid", F.floor(F.col("c") / FAN).alias("block")).applyInPandas(_joiner(path), schema)
        most //= FAN
    return spans.select("gid", "ids")


def encode(docs: DataFrame, text: str = "text", path: str = RANKS, digests: bool = False, giant: int = GIANT, chunk: int = CHUNK, leaf: int = LEAF) -> DataFrame:
    """The columns of docs but the text, and _ids; with digests, _ids_sha256 (of the ids as little-endian 32-bit integers)
    and _decoded_sha256 (of the bytes that the ids decode to).
    """
    small_batches(docs.sparkSession)
    rows = docs.select(packed(docs, text).alias("_row"), text_of(text).alias("_text"))
    added = "_ids array<int>" + (", _ids_sha256 string, _decoded_sha256 string" if digests else "")
    names = [a.split()[0] for a in added.split(", ")]
    small = map_columns(rows.where(F.length("_text") <= giant), _encoder(path, digests, leaf), ["_text"], added, ("_text",))
    large = materialize(rows.where(F.length("_text") > giant).withColumn("_gid", F.monotonically_increasing_id()), "giants")
    if large.limit(1).count():
        big = encode_giants(large.select(F.col("_gid").alias("gid"), F.col("_text").alias("text")), path, chunk, leaf)
        big = large.select("_gid", "_row").join(big.select(F.col("gid").alias("_gid"), F.col("ids").alias("_ids")), "_gid")
        if digests:
            big = map_columns(big, lambda: lambda ids: _digests(vocabulary(path), lists_of(ids)), ["_ids"], ", ".join(added.split(", ")[1:]), arrow=True)
        small = small.unionByName(big.select(*small.columns))
    return unpacked(small, "_row", names)


def decode(rows: DataFrame, ids: str = "_ids", path: str = RANKS) -> DataFrame:
    """The columns of rows but the ids, and _decoded (binary)."""

    def prepare() -> Callable[[pa.Array], dict[str, list]]:
        v = vocabulary(path)
        return lambda lists: {"_decoded": [v.decode(x.tolist()) for x in lists_of(lists)]}

    small_batches(rows.sparkSession)
    held = rows.select(packed(rows, ids).alias("_row"), F.col(ids).cast("array<int>").alias("_ids"))
    return unpacked(map_columns(held, prepare, ["_ids"], "_decoded binary", ("_ids",), arrow=True), "_row", ["_decoded"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode(documents(spark, sf_dir).select("doc_id", "text"), digests=True)
    return out.select("doc_id", F.size("_ids").cast("long").alias("n_tokens"), F.col("_ids_sha256").alias("ids_sha256"), F.col("_decoded_sha256").alias("decoded_sha256"))

"""SentencePiece encoding and decoding: best segmentations by a max-plus scan.

A text, with a space put before it, is cut into pieces of a public vocabulary so that the sum of the pieces'
scores is largest (of equal sums, the longest last piece wins, from the end backwards). Characters without a
piece cost more than any piece and come out as byte pieces, and so does U+2581, which stands for a space
inside the vocabulary: decoding gives back every text exactly.

Ordinary texts are cut inside one task. No piece runs over the start of a word or a line end, so words are cut
apart, the new ones of a batch all at once in arrays, and their cuts are kept between rows. Giant texts (over ``GIANT`` characters) become chunks of ``CHUNK``:
1. every chunk yields a transfer matrix: how the best sums at the ``REACH`` places before its start carry over
   to the places before its end (max-plus; REACH is the longest piece);
2. matrices are combined associatively, in blocks and then across blocks, to the sums at every chunk's start;
3. with those, each chunk traces back on its own from every place where a piece may cross its end; the short
   tables of these are chained from the text's end, which fixes one crossing per border;
4. each chunk emits its pieces, and a text's chunks are put in order.

Defined results: a null text is empty; an empty text has no pieces and score 0; repeated rows are encoded each;
null ids and ids of any type pass as they are; an empty table gives no rows; extra columns are kept, except ones named like an added column (all begin with an underscore).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_columns, materialize, small_batches, text_of

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
GIANT = 65_536
CHUNK = 32_768
BLOCK = 256
CACHED = 300_000
#: Texts are cut in groups of about this many characters, new words in groups of this many; longer words one by one.
GROUP = 1 << 20
WORDS = 4096
LONG_WORD = 64
LOW = -(1 << 60)
_NEVER = -(1 << 55)
_LENGTHS = 64  # more than the longest piece has characters
_MAP_BITS = 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(r" *[^ \n]+| +|\n")


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - _MAP_BITS)).astype(np.int64)


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces: dict[str, tuple[int, int]] = {}
        self.raw: list[bytes] = []
        self.byte = [0] * 256
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte[value] = i
                self.raw.append(bytes([value]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.raw.append(b"")
            else:
                text = piece.replace("▁", " ")
                self.pieces[text] = (i, int(round(sp.get_score(i))))
                self.raw.append(text.encode())
        if any(" " in p.lstrip(" ") or "\n" in p for p in self.pieces):
            raise ValueError("a piece runs over the start of a word or a line end")
        self.reach = max(map(len, self.pieces))
        if self.reach >= _LENGTHS:
            raise ValueError("pieces are too long")
        self.unknown = min(s for _, s in self.pieces.values() if s > -(10**8)) * 4 - 10
        self.cache: dict[str, tuple[bytes, int]] = {}
        self._tables()

    # ---- look-ups of whole arrays: the pieces of each length by a 64-bit hash of their characters ----------

    def _tables(self) -> None:
        """By length: sorted hashes, ids and scores; and a bitmap of all hashes, which turns most places away."""
        self.maybe = np.zeros(1 << _MAP_BITS, bool)
        self.by_length: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.empty(0, np.uint64),) * 3] * (self.reach + 1)
        for k in range(1, self.reach + 1):
            pieces = [p for p in self.pieces if len(p) == k]
            h = np.zeros(len(pieces), np.uint64)
            codes = _codes("".join(pieces)).reshape(-1, k)
            with np.errstate(over="ignore"):
                for j in range(k):
                    h = h * _MULTIPLIER + codes[:, j] + np.uint64(1)
            order = np.argsort(h)
            found = np.array([self.pieces[pieces[i]] for i in order], np.int64).reshape(-1, 2)
            self.by_length[k] = h[order], found[:, 0], found[:, 1]
            self.maybe[_slot(h)] = True

    def matches(self, codes: np.ndarray, room: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(length, starts, ids, scores) of all pieces in an array of characters; room: how far a piece may run from each."""
        live, h = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        for k in range(1, self.reach + 1):
            keep = room[live] >= k
            live, h = live[keep], h[keep]
            if not len(live):
                return
            with np.errstate(over="ignore"):
                h = h * _MULTIPLIER + codes[live + (k - 1)] + np.uint64(1)
            keys, ids, scores = self.by_length[k]
            if not len(keys):
                continue
            hit = np.flatnonzero(self.maybe[_slot(h)])
            at = np.minimum(np.searchsorted(keys, h[hit]), len(keys) - 1)
            same = keys[at] == h[hit]
            yield k, live[hit[same]], ids[at[same]], scores[at[same]]

    def lattice(self, text: str, low: int = 0) -> list[list[tuple[int, int]]]:
        """For each place from low on: (start, score) of the pieces that end there, longest first.

        A piece by hash is a piece by its characters too: each is looked up.
        """
        codes = _codes(text)
        out: list[list[tuple[int, int]]] = [[] for _ in range(len(text) + 1)]
        found = [(np.full(len(s), k), s, score) for k, s, _, score in self.matches(codes, np.arange(len(codes), 0, -1))]
        for k, starts, scores in reversed(found):
            size = int(k[0]) if len(k) else 0
            for s, score in zip(starts.tolist(), scores.tolist(), strict=True):
                if s + size > low and text[s : s + size] in self.pieces:
                    out[s + size].append((s, score))
        for end in range(low + 1, len(text) + 1):
            if not out[end] or out[end][-1][0] != end - 1:
                out[end].append((end - 1, self.unknown))
        return out

    def ids(self, piece: str) -> list[int]:
        known = self.pieces.get(piece)
        return [known[0]] if known else [self.byte[b] for b in piece.encode()]

    def cut(self, text: str) -> tuple[list[int], int]:
        """Places of the best cuts of a text, and its score: the plain forward pass and trace back."""
        best, back = [0] * (len(text) + 1), [0] * (len(text) + 1)
        arcs = self.lattice(text)
        for end in range(1, len(text) + 1):
            best[end], back[end] = max((best[s] + score, -s) for s, score in arcs[end])
            back[end] = -back[end]
        ends, at = [], len(text)
        while at:
            ends.append(at)
            at = back[at]
        return ends[::-1], best[-1]

    def word(self, word: str) -> tuple[bytes, int]:
        ends, score = self.cut(word)
        ids, at = [], 0
        for e in ends:
            ids += self.ids(word[at:e])
            at = e
        return np.array(ids, np.int32).tobytes(), score

    def cut_words(self, words: list[str]) -> list[tuple[bytes, int]]:
        """Ids and score of each of many words: the same pass as in cut, one place of all words at a time."""
        lengths = np.array([len(w) for w in words])
        order = np.argsort(-lengths, kind="stable")
        words, lengths = [words[i] for i in order], lengths[order]
        codes = _codes("".join(words))
        first = np.cumsum(lengths) - lengths
        room = np.repeat(first + lengths, lengths) - np.arange(len(codes))
        # A sum and the length of its last piece in one number: of equal sums the longest piece is the largest.
        score = np.full((self.reach + 1, len(codes)), _NEVER, np.int64)
        piece = np.full((self.reach + 1, len(codes)), -1, np.int32)
        score[1] = self.unknown * _LENGTHS + 1
        for k, starts, ids, scores in self.matches(codes, room):
            score[k, starts], piece[k, starts] = scores * _LENGTHS + k, ids
        place = first + np.arange(len(words))  # a word has one place more than it has characters
        best, back = np.zeros(len(codes) + len(words), np.int64), np.zeros(len(codes) + len(words), np.int64)
        for end in range(1, int(lengths[0]) + 1):
            n = int(np.searchsorted(-lengths, -end, "right"))  # words of this length or more come first
            at, begin = place[:n] + end, first[:n] + end
            top = best[at - 1] + score[1, begin - 1]
            for k in range(2, min(end, self.reach) + 1):
                np.maximum(top, best[at - k] + score[k, begin - k], out=top)
            back[at] = top % _LENGTHS
            best[at] = top - back[at]
        best //= _LENGTHS
        at, live = lengths.copy(), np.flatnonzero(lengths > 0)
        chosen = np.full(len(best), -2, np.int32)
        while len(live):
            size = back[place[live] + at[live]]
            chosen[place[live] + at[live]] = piece[size, first[live] + at[live] - size]
            at[live] -= size
            live = live[at[live] > 0]
        used = np.flatnonzero(chosen > -2)
        ids = chosen[used]
        starts = np.searchsorted(used, place).tolist() + [len(used)]
        odd = np.zeros(len(words), bool)
        odd[np.searchsorted(place, used[ids < 0], "right") - 1] = True
        sums = best[place + lengths].tolist()
        data, raw = ids.tobytes(), self.raw
        out: list[tuple[bytes, int]] = [(b"", 0)] * len(words)
        # Hashes agreed; the characters decide. A best path of true pieces is best among true ones.
        known = [i >= 0 for i in ids.tolist()]
        spelled = b"".join([raw[i] for i, k in zip(ids.tolist(), known, strict=True) if k]) == self._spelling(words, used, ids, place)
        for i, w in enumerate(words):
            out[order[i]] = self.word(w) if odd[i] or not spelled else (data[4 * starts[i] : 4 * starts[i + 1]], sums[i])
        return out

    def _spelling(self, words: list[str], used: np.ndarray, ids: np.ndarray, place: np.ndarray) -> bytes:
        """The characters that known pieces stand for, in order: all but the single ones without a piece."""
        if (ids >= 0).all():
            return "".join(words).encode()
        text = "".join(words)
        gone = used[ids < 0]
        gone = gone - np.searchsorted(place, gone, "right")  # a place to the number of the character before it
        out, at = [], 0
        for g in gone.tolist():
            out.append(text[at:g])
            at = g + 1
        return "".join([*out, text[at:]]).encode()

    def encode_all(self, texts: list[str]) -> list[tuple[np.ndarray, int]]:
        """Ids and score of each text; words that the cache lacks are cut together."""
        out: list[tuple[np.ndarray, int]] = []
        at = 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (stop == at or size + len(texts[stop]) <= GROUP):
                size += len(texts[stop])
                stop += 1
            lists = [_WORD.findall(" " + t) if t else [] for t in texts[at:stop]]
            different = set(chain.from_iterable(lists))
            if len(self.cache) + len(different) > CACHED:
                self.cache.clear()
            new = [w for w in different if w not in self.cache]
            long = [w for w in new if len(w) > LONG_WORD]
            short = [w for w in new if len(w) <= LONG_WORD]
            begin = 0
            while begin < len(short):
                part = short[begin : begin + WORDS]
                self.cache.update(zip(part, self.cut_words(part), strict=True))
                begin += WORDS
            self.cache.update((w, self.word(w)) for w in long)
            get = self.cache.__getitem__
            for ws in lists:
                got = [get(w) for w in ws]
                out.append((np.frombuffer(b"".join([g[0] for g in got]), np.int32), sum([g[1] for g in got])))
            for w in long:  # not kept: nothing bounds their length
                del self.cache[w]
            at = stop
        return out

    def encode(self, text: str) -> tuple[np.ndarray, int]:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        raw = self.raw
        text = b"".join([raw[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text

    # ---- chunks: text holds up to reach characters before the chunk, low of them -------------------------

    def transfer(self, text: str, low: int) -> np.ndarray:
        """Max-plus matrix (reach, reach) from the places at and before the chunk's start to those before its end."""
        r = self.reach
        best = np.full((len(text) + 1, r), LOW, np.int64)
        for k in range(min(r, low + 1)):
            best[low - k, k] = 0
        arcs = self.lattice(text, low)
        for end in range(low + 1, len(text) + 1):
            for s, score in arcs[end]:
                np.maximum(best[end], best[s] + score, out=best[end])
        out = np.full((r, r), LOW, np.int64)
        for k in range(min(r, len(text) - low)):
            out[:, k] = best[len(text) - k]
        for k in range(len(text) - low, r):  # a chunk shorter than the reach: older places carry over
            if k - (len(text) - low) < r:
                out[k - (len(text) - low), k] = 0
        return np.maximum(out, LOW)

    def fill(self, text: str, low: int, entry: np.ndarray) -> tuple[list[int], list[int]]:
        """Best sums and back pointers, given the sums at the places at and before the chunk's start."""
        best, back = [LOW] * (len(text) + 1), [0] * (len(text) + 1)
        for k in range(min(self.reach, low + 1)):
            best[low - k] = int(entry[k])
        arcs = self.lattice(text, low)
        for end in range(low + 1, len(text) + 1):
            best[end], b = max((best[s] + score, -s) for s, score in arcs[end])
            back[end] = -b
        return best, back


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str = MODEL) -> Vocabulary:
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product: first a, then b."""
    return np.maximum((a[:, :, None] + b[None, :, :]).max(1), LOW)


def apply_to(v: np.ndarray, m: np.ndarray) -> np.ndarray:
    return np.maximum((v[:, None] + m).max(0), LOW)


def _matrix(data: bytes, reach: int) -> np.ndarray:
    return np.frombuffer(data, np.int64).reshape(reach, reach)


def _encode(path: str, check: bool) -> Callable:
    def prepare() -> Callable[[list[str]], dict[str, list]]:
        v = vocabulary(path)

        def run(texts: list[str]) -> dict[str, list]:
            got = v.encode_all(texts)
            out = {"_ids": [g[0] for g in got], "_score": [g[1] for g in got]}
            if check:
                out["_exact"] = [v.decode(g[0]) == t for g, t in zip(got, texts, strict=True)]
            return out

        return run

    return prepare


def _split(path: str, chunk: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reach = vocabulary(path).reach
        for pdf in batches:
            for gid, text in zip(pdf["_gid"], pdf["_text"], strict=True):
                whole = " " + text
                for c, at in enumerate(range(0, len(whole), chunk)):
                    low = min(at, reach)
                    yield pd.DataFrame({"gid": [gid], "c": [c], "low": [low], "piece": [whole[at - low : at + chunk]]})

    return run


def _transfer(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(path)
        for pdf in batches:
            yield pdf[["gid", "c"]].assign(m=[v.transfer(t, low).tobytes() for t, low in zip(pdf["piece"], pdf["low"], strict=True)])

    return run


def _product(reach: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("c")
        total = _matrix(pdf["m"].iloc[0], reach)
        for m in pdf["m"].iloc[1:]:
            total = combine(total, _matrix(m, reach))
        return pd.DataFrame({"gid": [pdf["gid"].iloc[0]], "block": [pdf["block"].iloc[0]], "m": [total.tobytes()]})

    return run


def _entries(reach: int, order: str):
    """Sums at the start of each block or chunk, from those at the group's start."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        v = np.frombuffer(pdf["v"].iloc[0], np.int64)
        out = []
        for m in pdf["m"]:
            out.append(v.tobytes())
            v = apply_to(v, _matrix(m, reach))
        return pdf[["gid", order]].assign(v=out)

    return run


def _crossings(path: str):
    """For each place before a chunk's end: where the best path through it crosses the chunk's start; the sum; and how long
    the piece is that ends at each place, a byte each, so that the last step traces without another pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(path)
        for pdf in batches:
            tables, sums, sizes = [], [], []
            for text, low, entry in zip(pdf["piece"], pdf["low"], pdf["v"], strict=True):
                best, back = v.fill(text, low, np.frombuffer(entry, np.int64))
                table = []
                for k in range(v.reach):
                    at = len(text) - k
                    while at > low:
                        at = back[at]
                    table.append(low - at)
                tables.append(table)
                sums.append(best[-1])
                sizes.append(bytes([e - b for e, b in enumerate(back[low + 1 :], low + 1)]))
            yield pdf[["gid", "c"]].assign(table=tables, total=sums, sizes=sizes)

    return run


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """One crossing per border, from the text's end backwards; the tables are a few numbers per chunk."""
    pdf = pdf.sort_values("c", ascending=False)
    right, out = 0, []
    for table in pdf["table"]:
        left = int(table[right])
        out.append((right, left))
        right = left
    return pdf[["gid", "c"]].assign(right=[r for r, _ in out], left=[x for _, x in out], score=int(pdf["total"].iloc[0]))


def _emit(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(path)
        for pdf in batches:
            out = []
            for text, low, sizes, right, left in zip(pdf["piece"], pdf["low"], pdf["sizes"], pdf["right"], pdf["left"], strict=True):
                ends, at = [], len(text) - right
                while at > low:
                    ends.append(at)
                    at -= sizes[at - low - 1]
                ids, at = [], low - left
                for e in ends[::-1]:
                    ids += v.ids(text[at:e])
                    at = e
                out.append(ids)
            yield pdf[["gid", "c", "score"]].assign(ids=out)

    return run


def encode_giants(texts: DataFrame, path: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """(_gid, _ids, _score) of (_gid, _text), by chunks. A Spark string makes at most BLOCK * BLOCK chunks."""
    reach = vocabulary(path).reach
    chunks = materialize(texts.select("_gid", "_text").mapInPandas(_split(path, chunk), "gid bigint, c int, low int, piece string"), "chunks")
    # With a number, so that the few but costly chunks stay spread.
    tasks = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    spread = chunks.repartition(tasks, "gid", "c")
    matrices = materialize(spread.mapInPandas(_transfer(path), "gid bigint, c int, m binary"), "matrices").withColumn("block", F.floor(F.col("c") / BLOCK).cast("int"))
    start = np.full(reach, LOW, np.int64)
    start[0] = 0
    blocks = matrices.groupBy("gid", "block").applyInPandas(_product(reach), "gid bigint, block int, m binary").withColumn("v", F.lit(start.tobytes()))
    blocks = blocks.groupBy("gid").applyInPandas(_entries(reach, "block"), "gid bigint, block int, v binary")
    entries = matrices.join(blocks, ["gid", "block"]).groupBy("gid", "block").applyInPandas(_entries(reach, "c"), "gid bigint, c int, v binary")
    entries = materialize(entries, "entries")
    ready = chunks.join(entries, ["gid", "c"]).repartition(tasks, "gid", "c")
    tables = materialize(ready.mapInPandas(_crossings(path), "gid bigint, c int, table array<int>, total bigint, sizes binary"), "tables")
    chained = tables.select("gid", "c", "table", "total").groupBy("gid").applyInPandas(_chain, "gid bigint, c int, right int, left int, score bigint")
    parts = chunks.join(tables.select("gid", "c", "sizes"), ["gid", "c"]).join(chained, ["gid", "c"]).mapInPandas(_emit(path), "gid bigint, c int, score bigint, ids array<int>")
    whole = parts.groupBy("gid").agg(F.array_sort(F.collect_list(F.struct("c", "ids"))).alias("parts"), F.first("score").alias("_score"))
    return whole.select(F.col("gid").alias("_gid"), F.flatten(F.transform("parts", lambda p: p["ids"])).alias("_ids"), "_score")


def encode(docs: DataFrame, text: str = "text", path: str = MODEL, giant: int = GIANT, chunk: int = CHUNK, check: bool = False) -> DataFrame:
    """The columns of docs but the text, and _ids, _score; with check, _exact: whether decoding gave the text back."""
    small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c != text]
    rows = docs.select(*names, text_of(text).alias("_text"))
    added = "_ids array<int>, _score bigint" + (", _exact boolean" if check else "")
    small = map_columns(rows.where(F.length("_text") <= giant), _encode(path, check), ["_text"], added, ("_text",))
    large = materialize(rows.where(F.length("_text") > giant).withColumn("_gid", F.monotonically_increasing_id()), "giants")
    if not large.limit(1).count():
        return small
    big = large.join(encode_giants(large, path, chunk), "_gid")
    if check:
        big = map_columns(big, _check(path), ["_ids", "_text"], "_exact boolean")
    return small.unionByName(big.select(*small.columns))


def _check(path: str) -> Callable:
    def prepare() -> Callable[[list, list[str]], dict[str, list]]:
        v = vocabulary(path)
        return lambda ids, texts: {"_exact": [v.decode(np.asarray(i, np.int64)) == t for i, t in zip(ids, texts, strict=True)]}

    return prepare


def decode(rows: DataFrame, ids: str = "_ids", path: str = MODEL) -> DataFrame:
    """The columns of rows but the ids, and _decoded; null ids are no ids, so they give the empty text."""

    def prepare() -> Callable[[list], dict[str, list]]:
        v = vocabulary(path)
        return lambda lists: {"_decoded": [v.decode(np.asarray([] if x is None else x, np.int64)) for x in lists]}

    return map_columns(rows, prepare, [ids], "_decoded string", (ids,))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode(documents(spark, sf_dir).select("doc_id", "text"), check=True)
    return out.select("doc_id", F.size("_ids").cast("long").alias("n_pieces"), F.col("_score").alias("score"), F.col("_exact").alias("round_trip"), F.col("_ids").alias("ids"))

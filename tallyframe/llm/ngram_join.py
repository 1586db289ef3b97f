"""N-gram Jaccard join: a MinHash LSH forest, its prefixes shortened until the target recall, and exact verification.

Sets. A text's set holds its 5-word shingles (a text of fewer words has one shingle, all its words; a text
without words has none). Texts with equal sets are one class, however many copies it has; from here on a
class is one row with its number of copies.

Forest. Each of ``TREES`` trees gives a class a path of ``DEPTH`` MinHash values, a byte each; the classes of one
prefix are a node of that tree's trie. The join starts at the leaves (whole paths) and shortens the prefix level by
level. At a level every member of a node meets the node's least member, and a candidate so found becomes a link of
the forest only if the two whole signatures (TREES * DEPTH values) agree in as many places as similarity ``LINK``
makes them expect, six standard errors below the threshold, so chance members of a node join nothing. After each level
the recall is estimated from the links at hand: a link of similarity s had the chance 1 - (1 - s^k)^TREES to share a
prefix of k values in some tree, so it stands for one over that many. The prefix is shortened until those found are
``RECALL`` of those that they stand for, or a chance of RECALL is reached at the threshold itself. Two members may be
alike where neither is like their node's least member, so at the last level, whose nodes hold those of all before, every
two members of a node that the links so far leave in different components meet as well: in pairs of blocks of a node, each
of which gives the links that span it, never its pairs.

Verification. Connected components of the forest's links bound where true links can be. Members of a component are
dealt into blocks by hash, and each pair of blocks is one unit of work: a task counts common shingles of a block pair
by one product of incidence matrices over the shingles that occur twice, so links are exact and counted, never emitted;
what leaves the task is one row per member: its number of links there and one link that spans its part. Nothing is
capped: a component of m members makes (m / BLOCK)^2 units, spread over the cluster.

Result: one row per document with class_id and group_id (least doc_id of equal sets, and of all that are
connected by links) and n_links, the number of other documents of similarity THRESHOLD or more, copies included.

Defined results: null text is empty; texts without words are copies of one another and link to nothing else;
repeated rows are separate documents; null ids come after all others, and ids of any type pass as they are; very long
texts are read whole; an empty table gives no rows; other columns are ignored by :func:`join` and kept by
:func:`keep_one`, whatever their names. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, map_columns, materialize, packed, small_batches, text_of, unpacked
from .graph import components

SHINGLE = 5
THRESHOLD = 0.8
TREES = 32
DEPTH = 8
RECALL = 0.99999
BLOCK = 192
#: Members of a node that meet in one piece of work, with as many others.
NODE_BLOCK = 1024
#: Similarity from which on signatures link: six standard errors of their estimate below the threshold.
LINK = THRESHOLD - 6 * (THRESHOLD * (1 - THRESHOLD) / (TREES * DEPTH)) ** 0.5

_R = np.random.default_rng(1234)
_MULT = _R.integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _R.integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64)
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_WORDS: dict[bytes, int] = {}


def recall_of(prefix: int, similarity: float = THRESHOLD, trees: int = TREES) -> float:
    """The probability that two sets of a similarity share a prefix in some tree."""
    return 1 - (1 - similarity**prefix) ** trees


def shortest(recall: float = RECALL) -> int:
    """The longest prefix that reaches the recall at the threshold: none shorter is ever needed."""
    return next((k for k in range(DEPTH, 0, -1) if recall_of(k) >= recall), 1)


def shingles(text: str) -> np.ndarray:
    """Sorted different hashes of a text's shingles."""
    words = text.encode("utf-8", "replace").split()
    if not words:
        return np.empty(0, np.uint64)
    if len(_WORDS) > 500_000:
        _WORDS.clear()
    get = _WORDS.get
    h = np.empty(len(words), np.uint64)
    h[:] = [get(w) or _WORDS.setdefault(w, xxhash.xxh3_64_intdigest(w) or 1) for w in words]
    n = max(1, len(words) - SHINGLE + 1)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for k in range(min(SHINGLE, len(words))):
            out += h[k : k + n] * _PLACE[k]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def signature(sets: np.ndarray) -> bytes:
    """TREES * DEPTH MinHash values of a byte each, tree by tree."""
    if not len(sets):
        return bytes(TREES * DEPTH)
    least = np.full(TREES * DEPTH, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(sets), 2048):
            part = sets[at : at + 2048]
            for k in range(0, TREES * DEPTH, 16):
                v = _MULT[k : k + 16, None] * part[None, :]
                v += _ADD[k : k + 16, None]
                np.minimum(least[k : k + 16], v.min(1), out=least[k : k + 16])
        least *= np.uint64(0x94D049BB133111EB)
    return (least >> np.uint64(56)).astype(np.uint8).tobytes()


def _sketch() -> Callable[[list[str]], dict[str, list]]:
    def run(texts: list[str]) -> dict[str, list]:
        sets = [shingles(t) for t in texts]
        return {"cid": [xxhash.xxh3_64_intdigest(s.tobytes(), 11) - (1 << 63) for s in sets], "signature": [signature(s) for s in sets]}

    return run


def _agree() -> Callable[[list[bytes], list[bytes]], dict[str, list]]:
    """Estimated similarity of two signatures; by chance, one byte in 256 agrees."""

    def run(a: list[bytes], b: list[bytes]) -> dict[str, list]:
        x, y = (np.frombuffer(b"".join(v), np.uint8).reshape(-1, TREES * DEPTH) for v in (a, b))
        return {"like": ((x == y).mean(1) * 256 - 1) / 255}

    return run


def sharing(classes: DataFrame, prefix: int) -> tuple[DataFrame, DataFrame]:
    """(cid, tree, path) of all paths that share a prefix of that length with another class, and (cid, signature) of those classes.

    Who shares no such prefix shares no longer one either, so the levels below need only these.
    """
    path = F.expr(f"substring(signature, tree * {DEPTH} + 1, {DEPTH})")
    spots = classes.select("cid", "signature", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")).select("cid", "tree", path.alias("path"))
    node = F.xxhash64("tree", F.substring("path", 1, prefix))
    nodes = spots.select(node.alias("node")).groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node")
    # Written out, so that the join reads two plain exchanges and Spark can split a very frequent prefix.
    spots = materialize(spots.withColumn("node", node).join(materialize(nodes, "nodes"), "node", "left_semi").drop("node"), "spots")
    return spots, materialize(classes.select("cid", "signature").join(spots.select("cid").distinct(), "cid", "left_semi"), "signatures")


def forest_links(classes: DataFrame) -> DataFrame:
    """(a, b): links between classes (cid, signature) whose signatures agree; see the module's text."""
    least = shortest()
    spots, signatures = sharing(classes, least)
    links = None
    for k in range(DEPTH, least - 1, -1):
        nodes = spots.select("cid", F.xxhash64("tree", F.substring("path", 1, k)).alias("node"))
        heads = nodes.groupBy("node").agg(F.count("*").alias("n"), F.min("cid").alias("head")).where("n > 1").select("node", "head")
        pairs = nodes.join(materialize(heads, "heads"), "node").where("cid <> head").select(F.col("cid").alias("a"), F.col("head").alias("b")).distinct()
        if links is not None:
            pairs = pairs.join(links, ["a", "b"], "left_anti")
        for end in "ab":
            pairs = pairs.join(signatures.select(F.col("cid").alias(end), F.col("signature").alias(f"s{end}")), end)
        found = materialize(map_columns(pairs, _agree, ["sa", "sb"], "like double", ("sa", "sb")).where(F.col("like") >= LINK), "links")
        links = found if links is None else links.unionByName(found)
        chance = 1 - F.pow(1 - F.pow(F.least("like", F.lit(1.0)), F.lit(k)), F.lit(TREES))
        n, stands_for = links.where(F.col("like") >= THRESHOLD).agg(F.count("*"), F.sum(1 / chance)).first()
        if n and n >= RECALL * stands_for:
            break
    links = links.select("a", "b")
    return links.unionByName(links_between(spots, signatures, links, k))


def links_between(spots: DataFrame, signatures: DataFrame, links: DataFrame, prefix: int) -> DataFrame:
    """(a, b): links between members of one node that other links leave in different components; of each unit's, those that span.

    A node's members are dealt into blocks by their ids, and each pair of blocks is one unit of work, so that pairs are
    neither joined nor emitted. Nodes of the same members are one.
    """
    parts = spots.join(components(links).withColumnRenamed("node", "cid"), "cid", "left")
    nodes = materialize(parts.select("cid", F.xxhash64("tree", F.substring("path", 1, prefix)).alias("node"), F.coalesce("label", "cid").alias("part")), "parts")
    both = [F.bit_xor(F.xxhash64("cid", F.lit(seed))).alias(f"x{seed}") for seed in (1, 2)]
    mixed = nodes.groupBy("node").agg(F.count("*").alias("n"), F.min("part").alias("least"), F.max("part").alias("most"), *both).where("least < most")
    mixed = mixed.groupBy("n", "x1", "x2").agg(F.min("node").alias("node")).select("node", F.ceil(F.col("n") / NODE_BLOCK).cast("int").alias("blocks"))
    members = nodes.join(materialize(mixed, "mixed"), "node").join(signatures, "cid")
    mine, other = F.pmod(F.col("cid"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    members = members.withColumns({"block": mine, "_other": other}).select("node", F.least("block", "_other").alias("i"), F.greatest("block", "_other").alias("j"), "block", "cid", "part", "signature")
    units = members.repartition("node", "i", "j").sortWithinPartitions("node", "i", "j", "cid")
    return materialize(units.mapInPandas(_between, "a bigint, b bigint"), "between").distinct()


def spanned(link: np.ndarray) -> np.ndarray:
    """The least index of each one's component, of a symmetric matrix of links."""
    n = len(link)
    root = np.arange(n)
    if link.any():  # least index over neighbours until nothing moves
        while True:
            new = np.minimum(root, np.where(link, root[None, :], n).min(1))
            new = new[new]
            if (new == root).all():
                break
            root = new
    return root


def meet(cids: np.ndarray, block: np.ndarray, part: np.ndarray, signatures: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """(a, b): links that span those between two blocks, or within one, of members of different parts whose signatures agree."""
    link = part[:, None] != part[None, :]
    if not same:
        link &= block[:, None] != block[None, :]
    least = ((LINK * 255 + 1) / 256 - 1e-12) * signatures.shape[1]
    step = max(1, 32_000_000 // max(1, signatures.size))
    for at in range(0, len(cids), step):
        link[at : at + step] &= (signatures[at : at + step, None, :] == signatures[None, :, :]).sum(2, dtype=np.int16) >= least
    return [(int(cids[k]), int(cids[r])) for k, r in enumerate(spanned(link)) if k != r]


def _between(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Units arrive in order, members of one after another."""
    held: list[tuple] = []
    key = None

    def done() -> list[tuple[int, int]]:
        cids, block, part, data = zip(*held, strict=True)
        signatures = np.frombuffer(b"".join(data), np.uint8).reshape(len(held), -1)
        return meet(np.array(cids), np.array(block), np.array(part), signatures, key[1] == key[2])

    out: list[tuple] = []
    for pdf in batches:
        for node, i, j, *member in zip(*(pdf[c] for c in ("node", "i", "j", "block", "cid", "part", "signature")), strict=True):
            if (node, i, j) != key:
                if len(held) > 1:
                    out += done()
                held, key = [], (node, i, j)
            block, cid, part, signature = member
            held.append((cid, block, part, signature))
        if out:
            yield pd.DataFrame(out, columns=["a", "b"])
            out = []
    if len(held) > 1 and (out := done()):
        yield pd.DataFrame(out, columns=["a", "b"])


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A member's shingles, once for each block pair that it takes part in."""
    for pdf in batches:
        out, size = [], 0
        for cid, comp, blocks, copies, text in zip(pdf["cid"], pdf["comp"], pdf["blocks"], pdf["copies"], pdf["text"], strict=True):
            data = shingles(text).tobytes()
            mine = (cid & 0x7FFFFFFFFFFFFFFF) % blocks
            for other in range(blocks):
                out.append((comp, min(mine, other), max(mine, other), mine, cid, copies, data))
                size += len(data)
                if size > 8_000_000:
                    yield pd.DataFrame(out, columns=MEMBER_NAMES)
                    out, size = [], 0
        if out:
            yield pd.DataFrame(out, columns=MEMBER_NAMES)


MEMBER = "comp bigint, i int, j int, block int, cid bigint, copies bigint, data binary"
MEMBER_NAMES = [c.split()[0] for c in MEMBER.split(", ")]
FOUND = "cid bigint, links bigint, other bigint"


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by incidence matrices over the shingles that occur twice or more."""
    n = len(sets)
    who = np.repeat(np.arange(n), [len(s) for s in sets])
    value = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    _, inverse, count = np.unique(value, return_inverse=True, return_counts=True)
    keep = count[inverse] > 1
    who, inverse = who[keep], inverse[keep]
    _, col = np.unique(inverse, return_inverse=True)
    out = np.zeros((n, n), np.float32)
    width = int(col.max()) + 1 if len(col) else 0
    order = np.argsort(col, kind="stable")
    who, col = who[order], col[order]
    for at in range(0, width, 4096):
        lo, hi = np.searchsorted(col, (at, at + 4096))
        m = np.zeros((n, min(4096, width - at)), np.float32)
        m[who[lo:hi], col[lo:hi] - at] = 1
        out += m @ m.T
    return out


def verify(cids: np.ndarray, block: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], same: bool) -> list[tuple]:
    """(class, number of linked documents, one linked class that spans) over the pairs of two blocks, or within one."""
    n = len(cids)
    sizes = np.array([len(s) for s in sets], np.float64)
    inter = common_counts(sets).astype(np.float64)
    union = sizes[:, None] + sizes[None, :] - inter
    link = (inter >= THRESHOLD * union - 1e-9) & (union > 0)
    np.fill_diagonal(link, False)
    if not same:
        link &= block[:, None] != block[None, :]
    links = link @ copies
    root = spanned(link)
    return [(int(cids[k]), int(links[k]), int(cids[root[k]])) for k in range(n) if links[k]]


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Block pairs arrive in order, members of one after another."""
    held: list[tuple] = []
    key = None

    def done() -> list[tuple]:
        cids, block, copies = (np.array(x) for x in list(zip(*held, strict=True))[:3])
        return verify(cids, block, copies, [np.frombuffer(x[3], np.uint64) for x in held], key[1] == key[2])

    out: list[tuple] = []
    for pdf in batches:
        for comp, i, j, block, cid, copies, data in zip(*(pdf[c] for c in MEMBER_NAMES), strict=True):
            if (comp, i, j) != key:
                if len(held) > 1:
                    out += done()
                held, key = [], (comp, i, j)
            held.append((cid, block, copies, data))
        if out:
            yield pd.DataFrame(out, columns=["cid", "links", "other"])
            out = []
    if len(held) > 1:
        out = done()
        if out:
            yield pd.DataFrame(out, columns=["cid", "links", "other"])


def join(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, _th, class_id, group_id, n_links), a row for each row of docs; _th is a hash of the text."""
    small_batches(docs.sparkSession)
    base = docs.select(F.col(key).alias("id"), F.xxhash64(text_of(text), F.lit(5)).alias("th"), text_of(text).alias("text"))
    sketch = materialize(map_columns(base, _sketch, ["text"], "cid bigint, signature binary", ("text",)), "sketch")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("rep")
    classes = materialize(sketch.groupBy("cid").agg(first, F.count("*").alias("copies"), F.first("signature").alias("signature")), "classes")

    comps = components(forest_links(classes))
    sizes = comps.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    inside = comps.join(sizes, "label").join(classes, F.col("node") == F.col("cid")).select("cid", F.col("label").alias("comp"), "blocks", "copies", "rep.id", "rep.th")
    texts = base.alias("t").join(inside.alias("m"), (F.col("t.th") == F.col("m.th")) & F.col("t.id").eqNullSafe(F.col("m.id")))
    # Repeated rows, and null ids of one text, are one member.
    texts = texts.select("m.cid", "m.comp", "m.blocks", "m.copies", "t.text").dropDuplicates(["cid"])
    members = texts.mapInPandas(_members, MEMBER).repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j", "cid")
    found = materialize(members.mapInPandas(_verify, FOUND), "found")

    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("cid").alias("a"), F.col("other").alias("b")))
    named = classes.select("cid", "copies", "rep").join(links, "cid", "left").join(groups.withColumnRenamed("node", "cid"), "cid", "left")
    named = named.withColumn("label", F.coalesce("label", "cid"))
    least = named.groupBy("label").agg(F.min("rep").alias("head"))
    named = named.join(least, "label").select(
        "cid", F.col("rep.id").alias("class_id"), F.col("head.id").alias("group_id"), F.col("head.th").alias("_head"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
    )
    out = sketch.select("id", "th", "cid").join(named, "cid")
    return out.select(F.col("id").alias(key), F.col("th").alias("_th"), "class_id", "group_id", "n_links", "_head")


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs that stay when one document of each group does: its first by key (one of equal rows)."""
    heads = join(docs, text, key).where(F.col(key).eqNullSafe(F.col("group_id")) & (F.col("_th") == F.col("_head"))).select(F.col(key).alias("_id"), "_th").distinct()
    rows = docs.select(packed(docs).alias("_row"), F.col(key).alias("_key"), F.xxhash64(text_of(text), F.lit(5)).alias("_own"))
    rows = rows.join(heads, (F.col("_own") == F.col("_th")) & F.col("_key").eqNullSafe(F.col("_id")))
    nth = F.row_number().over(Window.partitionBy("_th", "_id").orderBy(F.lit(1)))
    return unpacked(rows.withColumn("_nth", nth).where("_nth = 1"), "_row", [])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(documents(spark, sf_dir).select("doc_id", "text")).drop("_th", "_head")

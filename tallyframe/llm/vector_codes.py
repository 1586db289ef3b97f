"""Compression of vectors to codes: sixteen parts, each named by an entry of its part's codebook.

Components become integers (floor of 256 times each), so all distances are exact. A part's nearest entry is found from
coarse to fine. Cut both into segments: with their means and, in each segment, the norms of what is left after the mean,

    distance >= sum over segments of  width * (mean - mean')**2 + (norm - norm')**2

(the part along the mean and the part across it are orthogonal, and norms differ by no more than vectors do). With one
segment this costs two numbers for an entry; an entry stays only if its bound is not above the exact distance to the entry
of least bound. Those that stay are bounded again with segments half as wide, and so on; the last ones get exact integer
distances, ties to the lower index. Bounds are lowered by more than rounding can have raised them, so no nearest entry is lost.

Codebooks begin with the parts of the 64 least ids. A round assigns every part and sums, in each task, what falls to each
entry; Spark adds up those sums and the driver divides: 64 entries of a vector's length, whatever the rows.
``label_error`` joins each row with its label's sum: labels of more than a thousandth of the rows (so at most 1000) by a
broadcast, the others by a shuffle, where none of them is large.

Defined results: rows whose vector is null, or holds null or non-finite components, are dropped, and so are rows with a
vector of another length than most have (of equally frequent lengths the least counts). Vectors whose length sixteen does not
divide are taken as if zeros stood at their end. Null ids come last, and of equal ids the lesser vector comes first, among the
64 that begin. With fewer than 64 rows the codebooks are shorter. Integers end at +-2**62; an error beyond a long is null,
and so is the sum of its label. An empty table gives no rows. Extra columns pass as they are; an added one takes the place of one of its name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_columns, materialize, small_batches, unpacked
from .whitening import integers, kept_vectors, matrix

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: A label of more than this share of the rows is joined by a broadcast; there are at most as many as the divisor.
FREQUENT = 1000
#: Rows that are compared with all entries at a time.
BLOCK = 4096
#: Below this size of components, 64 bits hold every distance.
SMALL = 1 << 28
ADDED = ["code", "error", "label_error", "codebooks_sha256"]


def _segments(x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and remaining norms of each row's segments."""
    cut = x.astype(float).reshape(len(x), -1, width)
    mean = cut.mean(2)
    return mean, np.sqrt(((cut - mean[:, :, None]) ** 2).sum(2))


def _widths(width: int) -> list[int]:
    """From the whole part down, halved while that is even; exact distances follow where segments would be single numbers."""
    out = [width]
    while out[-1] % 2 == 0 and out[-1] > 2:
        out.append(out[-1] // 2)
    return out


def _bounds(x: np.ndarray, entries: np.ndarray, width: int, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """What the squared distance of each row and entry is at least, lowered by more than the rounding of floats."""
    (mean, norm), (mean2, norm2) = _segments(x, width), _segments(entries, width)
    largest = max(float(np.abs(x).max(initial=0)), float(np.abs(entries).max(initial=0)), 1.0)
    low = (width * (mean[rows] - mean2[at]) ** 2 + (norm[rows] - norm2[at]) ** 2).sum(1)
    return low - 1e-12 * (largest * largest * x.shape[1] + low)


def _exact(x: np.ndarray, entries: np.ndarray, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((x[rows] - entries[at]) ** 2).sum(1)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row its nearest entry and the exact squared distance."""
    if max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0))) >= SMALL:
        x, entries = x.astype(object), entries.astype(object)
    n, k = len(x), len(entries)
    rows, at = np.repeat(np.arange(n), k), np.tile(np.arange(k), n)
    bound = None
    for width in _widths(x.shape[1]):
        low = _bounds(x, entries, width, rows, at)
        if bound is None:
            bound = _exact(x, entries, np.arange(n), low.reshape(n, k).argmin(1))
        stays = low <= bound[rows]
        rows, at = rows[stays], at[stays]
    far = _exact(x, entries, rows, at)
    order = np.lexsort((at, far, rows))
    first = order[np.append(True, rows[order][1:] != rows[order][:-1])] if len(order) else order
    return at[first], far[first]


def _parts(v: pa.Array, length: int) -> np.ndarray:
    """(rows, parts, width) of integers."""
    x = integers(matrix(v, length))
    short = -length % PARTS
    return np.pad(x, ((0, 0), (0, short))).reshape(len(x), PARTS, -1)


def _sums(books: np.ndarray, length: int):
    """For each part and entry that something falls to: how many parts, and their sums, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, k, width = books.shape
        counts, sums = np.zeros((PARTS, k), np.int64), np.zeros((PARTS, k, width), object)
        for batch in batches:
            x = _parts(batch.column("_v"), length)
            for block in (x[i : i + BLOCK] for i in range(0, len(x), BLOCK)):
                for p in range(PARTS):
                    to, _ = nearest(block[:, p], books[p])
                    for e in np.unique(to):
                        mine = block[to == e, p]
                        counts[p, e] += len(mine)
                        sums[p, e] += mine.astype(object).sum(0) if np.abs(mine).max() >= SMALL else mine.sum(0)
        part, entry = np.nonzero(counts)
        flat = [[Decimal(int(s)) for s in sums[p, e]] for p, e in zip(part, entry)]
        arrays = [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(counts[part, entry]), pa.array(flat, pa.list_(pa.decimal128(38, 0)))]
        yield pa.RecordBatch.from_arrays(arrays, names=["part", "entry", "n", "sums"])

    return run


def _next_books(held: DataFrame, books: np.ndarray, length: int) -> np.ndarray:
    width = books.shape[2]
    sums = held.select("_v").mapInArrow(_sums(books, length), "part int, entry int, n bigint, sums array<decimal(38,0)>")
    totals = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)))
    out = books.copy()
    for r in totals.collect():  # PARTS * ENTRIES rows at most
        out[r["part"], r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(width)]
    return out


def first_books(held: DataFrame, length: int) -> np.ndarray:
    """(parts, entries, width): the parts of the least ids' vectors."""
    least = held.orderBy(F.col("_id").asc_nulls_last(), "_v").limit(ENTRIES).select("_v").collect()
    x = pa.array([r["_v"] for r in least], pa.list_(pa.float64()))
    return _parts(x, length).transpose(1, 0, 2).copy()


def codebooks(held: DataFrame, length: int, rounds: int = ROUNDS) -> np.ndarray:
    books = first_books(held, length)
    for _ in range(rounds):
        books = _next_books(held, books, length)
    return books


def _assign(books: np.ndarray, length: int):
    def prepare():
        def run(v: pa.Array) -> dict[str, list]:
            x = _parts(v, length)
            codes, errors = np.zeros((len(x), PARTS), np.uint8), np.zeros(len(x), object)
            for i in range(0, len(x), BLOCK):
                for p in range(PARTS):
                    codes[i : i + BLOCK, p], far = nearest(x[i : i + BLOCK, p], books[p])
                    errors[i : i + BLOCK] += far.astype(object)
            return {"_code": [c.tobytes().hex() for c in codes], "_error": [int(e) if e < 1 << 63 else None for e in errors]}

        return run

    return prepare


def with_totals(rows: DataFrame) -> DataFrame:
    """rows (_label, _error and others) with _total, the sum of the errors of equal labels, nulls together."""
    sums = rows.groupBy("_label").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col("_error").cast("decimal(38,0)")).alias("_sum"), F.count("_error").alias("_there"))
    fits = (F.col("_n") == F.col("_there")) & (F.col("_sum") < F.lit(Decimal(1 << 63)))
    sums = sums.select(F.col("_label").alias("_same"), "_n", F.when(fits, F.col("_sum").cast("bigint")).alias("_total"))
    sums = materialize(sums, "label_sums")
    n = sums.agg(F.sum("_n")).first()[0] or 0
    often = sums.where(F.col("_n") * FREQUENT > n).select("_same", "_total", F.lit(True).alias("_often"))
    seldom = sums.where(F.col("_n") * FREQUENT <= n).select("_same", "_total")
    found = rows.join(F.broadcast(often), F.col("_label").eqNullSafe(F.col("_same")), "left")
    names = [*rows.columns, "_total"]
    rest = found.where("_often is null").select(*rows.columns).join(seldom, F.col("_label").eqNullSafe(F.col("_same")))
    return found.where("_often").select(*names).unionByName(rest.select(*names))


def compress(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """The columns of each row that counts, and code (two hex digits a part), error, label_error, codebooks_sha256."""
    small_batches(rows.sparkSession, rows=BLOCK)
    held, length = kept_vectors(rows, vector, F.col(key).alias("_id"), F.col(label).alias("_label"))
    if not length:
        kinds = zip(ADDED, ("string", "bigint", "bigint", "string"), strict=True)
        return unpacked(held.selectExpr("_row", *(f"cast(null as {k}) as {a}" for a, k in kinds)), "_row", ADDED).where("false")
    books = codebooks(held, length, rounds)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = map_columns(held, _assign(books, length), ["_v"], "_code string, _error bigint", ("_v", "_id"), arrow=True)
    out = with_totals(materialize(coded, "codes"))
    out = out.select("_row", F.col("_code").alias("code"), F.col("_error").alias("error"), F.col("_total").alias("label_error"), F.lit(digest).alias("codebooks_sha256"))
    return unpacked(out, "_row", ADDED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).select("vec_id", *ADDED)


def oracle() -> str:
    """Two rounds and a last assignment, by comparing every part with every entry; distance and index in one number."""
    assign = """select vec_id, label, p, least // 64 far, least % 64 e, v from (
        select a.vec_id, a.label, a.p, a.v, min(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::hugeint * 64 + b.e) least
        from parts a join {book} b on a.p = b.p group by all)"""
    move = """select b.p, b.e, coalesce(n.v, b.v) v from {book} b left join (
        select p, e, list(m order by pos) v from (
            select p, e, pos, floor(sum(x)::double / count(*))::bigint m from (select p, e, unnest(v) x, generate_subscripts(v, 1) pos from {near}) group by p, e, pos)
        group by p, e) n on n.p = b.p and n.e = b.e"""
    return f"""
    with kept as (
        select vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) x from embeddings
        where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    parts as (select vec_id, label, p, x[(p * (len(x) // 16) + 1):((p + 1) * (len(x) // 16))] v from kept, (select unnest(range(16)) p)),
    book0 as (select p, row_number() over (partition by p order by vec_id) - 1 e, v from parts where vec_id in (select vec_id from kept order by vec_id limit 64)),
    near0 as materialized ({assign.format(book="book0")}), book1 as materialized ({move.format(book="book0", near="near0")}),
    near1 as materialized ({assign.format(book="book1")}), book2 as materialized ({move.format(book="book1", near="near1")}),
    near2 as materialized ({assign.format(book="book2")}),
    coded as (select vec_id, label, string_agg(printf('%02x', e::int), '' order by p) code, sum(far)::bigint error from near2 group by vec_id, label)
    select vec_id, code, error, sum(error) over (partition by label)::bigint label_error,
        (select sha256(string_agg(array_to_string(v, ','), ',' order by p, e)) from book2) codebooks_sha256
    from coded"""

"""Document fingerprints by winnowing, with built-in functions only.

A text becomes tokens; every k tokens give a rolling hash (a cyclic polynomial: the tokens' hashes, rotated by
their place and joined by exclusive or); of each window of w hashes the least is kept, the rightmost of equal
ones, with its position. Any run of w + k - 1 tokens that two texts share gives both a common hash.

Tokens are words, in pieces of ``PIECE`` code points at most (so text without spaces has tokens too). Texts
under ``SHORT`` code points use single code points as tokens instead; texts from ``SHORT / 2`` to ``SHORT``
carry both, so two texts of about one length always have a kind in common. A text of fewer than k tokens gives
one hash of all of them, an empty one none.

Likeness is the number of common hashes over the geometric mean of both numbers of hashes (so a repetitive text
keeps its likeness when a richer passage is put in), by words where both texts have them, else by code points; two texts without hashes are alike (1), one with and one without are not (0), as are two
texts that have no kind in common (their lengths then differ by half or more).

Neighbours: the next document by ascending key comes from a window inside key ranges: of numbers taken from their
quantiles, of other keys from a sample of whole keys by hash (``SAMPLED`` a range at most come to the driver); the first documents of each range also go, marked, into the range before it (the first range's
into the last), so no window spans the table and each text is shuffled once.

Defined results: a null text is empty; equal keys are ordered by text, null keys come last, keys may be numbers or texts; the last document's
next is the first, a single document's next is itself; rows that are equal in all are interchangeable; extra
columns are kept unless named like an added one (all begin with an underscore); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .common import documents, text_of

PIECE = 12
SHORT = 1000
#: (k, w) by words and by code points.
BY_WORDS = (3, 4)
BY_CHARS = (3, 4)
PLACE_BITS = 28
RANGE_ROWS = 64
SAMPLED = 16
COARSE = 64


def rotated(h: Column, bits: int) -> Column:
    return F.shiftleft(h, bits).bitwiseOR(F.shiftrightunsigned(h, 64 - bits)) if bits else h


def rolling(hashes: Column, n: Column, k: int) -> Column:
    """Rolling hash of every k tokens; fewer tokens than k give one hash of them all."""

    def gram(i: Column) -> Column:
        out = rotated(F.get(hashes, i), 7 * (k - 1))
        for j in range(1, k):
            out = out.bitwiseXOR(rotated(F.get(hashes, i + j), 7 * (k - 1 - j)))
        return out

    return (
        F.when(n >= k, F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), gram))
        .when(n > 0, F.array(F.xxhash64(hashes)))
        .otherwise(F.array().cast("array<bigint>"))
    )


def packed(grams: Column) -> Column:
    """35 bits of the hash above the place, counted from the right so that the least of equal hashes is rightmost."""
    top = F.lit((1 << PLACE_BITS) - 1)
    return F.transform(
        grams, lambda h, i: F.shiftleft(F.shiftrightunsigned(h, PLACE_BITS + 1), PLACE_BITS).bitwiseOR(top - i.cast("long"))
    )


def least_of_windows(values: str, w: int) -> Column:
    n = F.size(values)
    pick = lambda j: F.least(*[F.get(values, j + i) for i in range(w)])
    return (
        F.when(n > w, F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(n - w, F.lit(0))), pick)))
        .when(n > 0, F.array(F.array_min(values)))
        .otherwise(F.array().cast("array<bigint>"))
    )


def winnow(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds out + '_words' and out + '_chars': kept hashes with their places, packed; null where the text has not that kind."""
    length = F.length(text)
    plans = (
        ("_words", length >= SHORT // 2, rf"[^\x20\x09-\x0D]{{1,{PIECE}}}", BY_WORDS),
        ("_chars", length < SHORT, r"(?s).", BY_CHARS),
    )
    for suffix, wanted, token, (k, w) in plans:
        tokens, grams = f"{out}{suffix}_t", f"{out}{suffix}_g"
        hashes = F.transform(F.regexp_extract_all(F.col(text), F.lit(token), F.lit(0)), lambda t: F.xxhash64(t))
        df = df.withColumn(tokens, F.when(wanted, hashes))
        df = df.withColumn(grams, packed(rolling(F.col(tokens), F.size(tokens), k)))
        df = df.withColumn(f"{out}{suffix}", F.when(F.col(tokens).isNotNull(), least_of_windows(grams, w))).drop(tokens, grams)
    return df


def hashes_of(prints: str) -> Column:
    return F.array_distinct(F.transform(prints, lambda x: F.shiftrightunsigned(x, PLACE_BITS)))


def places_of(prints: str) -> Column:
    """(hash, place) of every kept hash."""
    mask = F.lit((1 << PLACE_BITS) - 1)
    return F.transform(prints, lambda x: F.struct(F.shiftrightunsigned(x, PLACE_BITS).alias("hash"), (mask - x.bitwiseAND(mask)).alias("place")))


def likeness(a: str, b: str) -> Column:
    """Of two texts whose hash sets are in columns a + '_words', a + '_chars' and so on."""

    def share(x: str, y: str) -> Column:
        both = F.size(x).cast("double") * F.size(y)
        return F.when(both > 0, F.least(F.lit(1.0), F.size(F.array_intersect(x, y)) / F.sqrt(both))).otherwise((F.size(x) == F.size(y)).cast("double"))

    words, chars = (f"{a}_words", f"{b}_words"), (f"{a}_chars", f"{b}_chars")
    both = lambda p: F.col(p[0]).isNotNull() & F.col(p[1]).isNotNull()
    return F.when(both(words), share(*words)).when(both(chars), share(*chars)).otherwise(F.lit(0.0))


def as_string(a: str) -> Column:
    """The kept hashes with their places, in text order, as hexadecimal hash:place: words, a bar, code points."""
    mask = F.lit((1 << PLACE_BITS) - 1)
    one = lambda x: F.concat(F.hex(F.shiftrightunsigned(x, PLACE_BITS)), F.lit(":"), F.hex(mask - x.bitwiseAND(mask)))
    part = lambda c: F.coalesce(F.array_join(F.transform(c, one), "."), F.lit("-"))
    return F.concat(part(f"{a}_words"), F.lit("|"), part(f"{a}_chars"))


def bounds_of(docs: DataFrame, key: str) -> list:
    """Sorted first keys of ranges with about RANGE_ROWS rows, at most COARSE * COARSE of them; none where all keys are null."""
    most = COARSE * COARSE
    if isinstance(docs.schema[key].dataType, NumericType):
        got = docs.agg(F.count("*").alias("n"), F.min(key).alias("least"), F.percentile_approx(F.col(key), [i / most for i in range(most)], 100_000).alias("b")).first()
        points = max(1, min(most, got["n"] // RANGE_ROWS))
        return sorted({got["least"], *(got["b"][i * most // points] for i in range(points))}) if got["b"] else []
    n, least = docs.agg(F.count("*"), F.min(key)).first()
    if least is None:
        return []
    points = max(1, min(most, n // RANGE_ROWS))
    some = docs.select(key).where(F.col(key).isNotNull() & (F.pmod(F.xxhash64(key, F.lit(29)), F.lit(max(1, n // (points * SAMPLED)))) == 0))
    keys = sorted(r[0] for r in some.limit(2 * SAMPLED * points).collect())
    return sorted({least, *(keys[i * len(keys) // points] for i in range(points) if keys)})


def with_ranges(docs: DataFrame, key: str) -> DataFrame:
    """Adds _range and _guest; the first documents of a range stand in the range before it as guests."""
    bounds = bounds_of(docs, key)
    if not bounds:
        return docs.withColumns({"_range": F.lit(0), "_guest": F.explode(F.array(F.lit(0), F.lit(1)))})
    all_bounds = F.array(*[F.lit(b) for b in bounds])
    heads = F.array(*[F.lit(b) for b in bounds[::COARSE]])
    last = len(bounds) - 1
    coarse = F.size(F.filter(heads, lambda b: b <= F.col(key)))
    fine = F.size(F.filter(F.slice(all_bounds, (coarse - 1) * COARSE + 1, COARSE), lambda b: b <= F.col(key)))
    at = F.when(F.col(key).isNull(), F.lit(last)).otherwise((coarse - 1) * COARSE + fine - 1)
    docs = docs.withColumn("_range", at.cast("int"))
    first = F.coalesce(F.get(all_bounds, F.col("_range")) == F.col(key), F.lit(False))
    before = F.when(F.col("_range") == 0, F.lit(last)).otherwise(F.col("_range") - 1)
    own = F.struct(F.col("_range").alias("r"), F.lit(0).alias("g"))
    spots = F.when(first, F.array(own, F.struct(before.alias("r"), F.lit(1).alias("g")))).otherwise(F.array(own))
    return docs.withColumn("_spot", F.explode(spots)).withColumns({"_range": F.col("_spot.r"), "_guest": F.col("_spot.g")}).drop("_spot")


def fingerprint(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The columns of docs and _own_words, _own_chars: kept hashes with places, packed (see places_of)."""
    return winnow(docs.withColumn("_text", text_of(text)), "_text", "_own").drop("_text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_ranges(documents(spark, sf_dir).select("doc_id", text_of().alias("_text")), "doc_id")
    order = Window.partitionBy("_range").orderBy("_guest", F.col("doc_id").asc_nulls_last(), "_text")
    docs = docs.withColumn("_next", F.lead("_text").over(order)).withColumn("n_chars", F.length("_text").cast("long"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring("_text", F.lit(1), F.col("n_chars").cast("int") - quarter), F.substring(F.coalesce("_next", F.lit("")), F.lit(1), quarter))
    docs = docs.withColumn("_edited", edited).drop("_next")
    docs = winnow(winnow(docs, "_text", "_o"), "_edited", "_e")
    docs = docs.withColumns({f"_n{b}": F.lead(f"_o{b}").over(order) for b in ("_words", "_chars")}).where("_guest = 0")
    strings = {"fingerprint": as_string("_o"), "edited_fingerprint": as_string("_e")}
    docs = docs.select("doc_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), *(c.alias(n) for n, c in strings.items()), *(hashes_of(f"{a}{b}").alias(f"{a}{b}") for a in ("_o", "_e", "_n") for b in ("_words", "_chars")))
    return docs.select("doc_id", "n_chars", "edited_sha256", *strings, likeness("_o", "_e").alias("near_edited"), likeness("_o", "_n").alias("near_next"))

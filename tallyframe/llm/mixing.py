"""Mixing sources to target weights, by a multivariate-hypergeometric splitting tree. Built-in functions only.

Targets. Sources in code-point order (null last) weigh 5, 2, 1, repeating, and share the words of the whole
table; a target stops at ``CAP`` times its source's words and the excess is shared anew by weight.

Blocks. Every row has a keyed hash that permutes its source (rows that are equal in id and text are numbered first, so
each has a hash of its own); the hash's leading bits deal the source into ``BLOCKS`` blocks. A mix takes whole passes
over a source (``floor(target / size)``), then blocks in order, and of one last block the documents that bring the sum
nearest the target. So each block of each pass is one unit. The cut inside the last block is found by the hash's next
bits, ``CUT_BITS`` at a time: sums of finer and finer parts, until the last part is 2^-30 of a source; only its rows
are put in order.

Shards. The units are split among the output shards by a binary tree: at each node every source's quota is divided by
a hypergeometric draw until the leaves hold exact quotas. The draws of a node are made down a tree of sources with
``FAN`` branches: first for groups of groups, then inside each group, so that no row holds more than ``FAN`` sources
and every level is one pass over all nodes; together they are multivariate hypergeometric. A leaf then takes the next
units of the source's block permutation, so shards are disjoint; inside a shard, rows are ordered by a second hash. All
draws come from a seed: reruns agree.

Defined results: a null or empty text has size 0 and is never taken; a source without words has target 0;
null is a source of its own, apart from the empty string; rows that are equal in id, text and source are separate
rows, of which any may be taken; a very long text is one row and never cut; ids of any type and null ones are allowed; an
empty table gives no rows; other columns are kept by :func:`mix` and may have any name that does not
begin with an underscore.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialize, text_of, words_of

CAP = 3
BLOCKS = 64
CUT_BITS = (12, 12)
FAN = 256
SHARDS = 16
SEED = 20240229
WEIGHTS = (5, 2, 1)


def targets(sizes: DataFrame, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) to also weight and target: shares by weight, none above cap times its size.

    Filling in order of size / weight: the sources that stop at their cap come first, so running sums over
    the short table of sources find the level at which the others stand.
    """
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rank = F.row_number().over(Window.partitionBy().orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int"))
    out = sizes.withColumn("weight", weight)
    out = out.withColumn("_cap", F.col("source_size") * F.lit(float(cap))).withColumn("_level", F.col("_cap") / F.col("weight"))
    by_level = Window.partitionBy().orderBy("_level", F.col("source").asc_nulls_last())
    before, after = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    rest = total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    out = out.withColumn("_fair", rest / F.sum("weight").over(after))
    # The first source in this order whose fair level lies below its cap sets the level for all.
    out = out.withColumn("_water", F.min(F.when(F.col("_fair") <= F.col("_level"), F.struct("_level", "_fair"))).over(everything)["_fair"])
    target = F.least(F.col("_cap"), F.coalesce(F.col("_water") * F.col("weight"), F.col("_cap")))
    return out.select("source", F.col("source_size").cast("long").alias("source_size"), "weight", target.cast("double").alias("target"))


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from a hash."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) + 0.5) / float(1 << 52)


# Ln k! of small k.
_SMALL = [math.lgamma(k + 1) for k in range(16)]


def log_factorial(k: Column) -> Column:
    """ln k!, by Stirling's series from 16 on (its error is below 1e-11 there)."""
    x = F.greatest(k, F.lit(1)).cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(k < len(_SMALL), F.get(F.array(*map(F.lit, _SMALL)), k.cast("int"))).otherwise(series)


def hypergeometric(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """How many of drawn units out of total are of the good ones.

    The likeliest by weight plus Gumbel noise, which has the same distribution. Looked at are the values within 12
    standard deviations of the mean: all others together have less than 1e-30.
    """
    low, high = F.greatest(F.lit(0), drawn - (total - good)), F.least(good, drawn)
    share = good / F.greatest(total, F.lit(1))
    mean = drawn * share
    spread = 12 * F.sqrt(mean * (1 - share) + 1) + 2
    low, high = F.greatest(low, F.floor(mean - spread)).cast("long"), F.least(high, F.ceil(mean + spread)).cast("long")
    noise = lambda x: -F.log(-F.log(uniform(u, x)))
    weigh = F.transform(
        F.sequence(low, F.greatest(low, high)),
        lambda x: F.struct(
            (noise(x) - log_factorial(x) - log_factorial(good - x) - log_factorial(drawn - x) - log_factorial(total - good - drawn + x)).alias("w"), x.alias("x")
        ),
    )
    return F.array_max(weigh)["x"]


def draw_children(nodes: DataFrame, level: int, seed: int) -> DataFrame:
    """(low, path, room, k: array of (part, n)) to one row for each part: (low, part, n, room), room the part's draw."""

    def step(acc: Column, s: Column) -> Column:
        u = F.xxhash64(F.lit(seed), F.lit(level), F.col("low"), F.col("path"), s["part"])
        got = hypergeometric(acc["total"], s["n"], acc["room"], u)
        return F.struct((acc["total"] - s["n"]).alias("total"), (acc["room"] - got).alias("room"), F.concat(acc["got"], F.array(got)).alias("got"))

    total = F.aggregate("k", F.lit(0).cast("long"), lambda a, s: a + s["n"])
    start = F.struct(total.alias("total"), F.col("room").alias("room"), F.array().cast("array<bigint>").alias("got"))
    drawn = nodes.withColumn("got", F.aggregate("k", start, step, lambda a: a["got"]))
    parts = F.transform("k", lambda s, i: F.struct(s["part"].alias("part"), s["n"].alias("n"), F.get("got", i).alias("room")))
    return drawn.select("low", F.inline(parts))


def quotas(units: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(source, n_units) to (source, shard, quota): a splitting tree over the shards; no document is seen here."""
    numbered = units.select("source", F.col("n_units").cast("long").alias("n"), (F.row_number().over(Window.partitionBy().orderBy(F.col("source").asc_nulls_last())) - 1).cast("long").alias("at"))
    numbered = materialize(numbered, "numbered")  # one row for each source
    most = numbered.agg(F.coalesce(F.max("at"), F.lit(0))).first()[0]
    tiers = [1]  # sources in a part of each tier, the finest first
    while tiers[-1] * FAN <= most:
        tiers.append(tiers[-1] * FAN)
    nodes = numbered.select("at", "n", F.lit(0).alias("low"), F.lit(shards).alias("width"))
    for level in range(max(0, math.ceil(math.log2(shards)))):
        nodes = nodes.withColumn("half", F.ceil(F.col("width") / 2).cast("int"))
        rooms = nodes.groupBy("low", "width", "half").agg(F.sum("n").alias("total"))
        above = rooms.select("low", F.lit(0).cast("long").alias("path"), F.floor(F.col("total") * F.col("half") / F.col("width")).cast("long").alias("room"))
        for tier in reversed(tiers):
            # The parts of this tier, gathered by the part of the tier above.
            own, up = F.floor(F.col("at") / tier).cast("long"), F.floor(F.col("at") / (tier * FAN)).cast("long")
            parts = nodes.groupBy("low", up.alias("path"), own.alias("part")).agg(F.sum("n").alias("n"))
            gathered = parts.groupBy("low", "path").agg(F.array_sort(F.collect_list(F.struct("part", "n"))).alias("k"))
            # Draws follow from the seed and the node, so nothing need be kept between tiers.
            above = draw_children(gathered.join(above, ["low", "path"]), level * 64 + tiers.index(tier), seed).select("low", F.col("part").alias("path"), "room")
        split = nodes.join(above.withColumnRenamed("path", "at"), ["low", "at"])
        halves = F.array(
            F.struct(F.col("low").alias("low"), F.col("half").alias("width"), F.col("room").alias("n")),
            F.struct((F.col("low") + F.col("half")).alias("low"), (F.col("width") - F.col("half")).alias("width"), (F.col("n") - F.col("room")).alias("n")),
        )
        nodes = materialize(split.select("at", F.inline(halves)).where("width > 0"), "nodes")
    return nodes.join(numbered.select("at", "source"), "at").select("source", F.col("low").alias("shard"), F.col("n").alias("quota"))


def same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def weigh(docs: DataFrame, text: str, source: str, key: str, blocks: int, seed: int) -> DataFrame:
    """Adds _source, _size, _hash (its place in the source's permutation) and _block.

    Rows that are equal in id, text and source get numbers, counted in each partition and then across partitions, so
    that no window holds all of them.
    """
    out = docs.withColumns({
        "_size": F.size(words_of(text_of(text))).cast("long"),
        "_source": F.col(source).cast("string"),
        "_hash": F.xxhash64(F.lit(seed), F.col(key), F.col(text), F.col(source)),
    })
    several = materialize(out.groupBy("_hash").agg(F.count("*").alias("_n")).where("_n > 1").select("_hash"), "equal")
    if several.limit(1).count():
        # Partition and row numbers are kept with the rows, as another reading could give others.
        out = materialize(out.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "rows")
        equal = out.select("_hash", "_part", "_row").join(several, "_hash", "left_semi")
        inside = F.row_number().over(Window.partitionBy("_hash", "_part").orderBy("_row"))
        before = F.sum("m").over(Window.partitionBy("_hash").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
        parts = equal.groupBy("_hash", "_part").agg(F.count("*").alias("m")).select("_hash", "_part", F.coalesce(before, F.lit(0)).alias("before"))
        numbers = equal.withColumn("inside", inside).join(parts, ["_hash", "_part"]).select("_row", (F.col("before") + F.col("inside")).alias("_nth"))
        out = out.join(numbers, "_row", "left").withColumn("_hash", F.when(F.col("_nth") > 1, F.xxhash64("_hash", "_nth")).otherwise(F.col("_hash")))
        out = out.drop("_part", "_row", "_nth")
    return out.withColumn("_block", F.pmod(F.shiftrightunsigned("_hash", 40), F.lit(blocks)).cast("int"))


def cut_points(light: DataFrame, cut: DataFrame) -> DataFrame:
    """(_s, _b, _cut): of each block of cut (_s, _b, left), the hash up to which documents bring the sum nearest left."""
    inside = light.where("_size > 0").join(cut, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b")))
    inside = materialize(inside.select("_s", "_b", "_hash", "_size", "left"), "inside")
    done, keys = None, ["_s", "_b"]
    # Order inside a block: the hash's low 40 bits, which the block does not use; the finest part is put in order itself.
    place = F.col("_hash").bitwiseAND(F.lit((1 << 40) - 1))
    inside, shift = inside.withColumn("place", place), 40
    for bits in CUT_BITS:
        shift -= bits
        part = F.shiftrightunsigned("place", shift)
        sums = inside.groupBy(*keys, "left", part.alias("part")).agg(F.sum("_size").alias("words"))
        run = F.sum("words").over(Window.partitionBy(*keys).orderBy("part"))
        sums = sums.withColumn("before", run - F.col("words"))
        # The part in which the sum passes what is left; all before it go in whole.
        at = sums.where("before <= left and before + words > left").select(*keys, F.col("part").alias("at"), (F.col("left") - F.col("before")).alias("rest"))
        at = at.withColumnsRenamed({k: f"k{k}" for k in keys})
        same_block = F.col("_s").eqNullSafe(F.col("k_s")) & (F.col("_b") == F.col("k_b"))
        whole = inside.join(at, same_block & (part < F.col("at"))).groupBy("_s", "_b").agg(F.max("place").alias("_cut"))
        done = whole if done is None else done.unionByName(whole)
        inside = materialize(inside.join(at, same_block & (part == F.col("at"))).select("_s", "_b", "_hash", "_size", F.col("rest").alias("left"), "place"), "inside")
    run = F.sum("_size").over(Window.partitionBy("_s", "_b").orderBy("place", "_hash")) - F.col("_size")
    last = inside.withColumn("run", run).where(F.col("run") + F.col("_size") / 2 <= F.col("left")).groupBy("_s", "_b").agg(F.max("place").alias("_cut"))
    return done.unionByName(last).groupBy("_s", "_b").agg(F.max("_cut").alias("_cut"))


def plan_blocks(light: DataFrame, cap: int, shards: int, seed: int) -> DataFrame:
    """One row per source and block: what the mix takes of it, and to which shard each pass goes."""
    per_block = materialize(light.groupBy("_source", "_block").agg(F.sum("_size").alias("words")), "blocks")
    plan = targets(per_block.groupBy(F.col("_source").alias("source")).agg(F.sum("words").alias("source_size")), cap)
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    plan = plan.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    plan = plan.withColumnRenamed("source", "_plan_source")

    # A block's place in its source's permutation; the words before it; what the last pass still needs of it.
    order = Window.partitionBy("_source").orderBy(F.xxhash64(F.lit(seed), F.lit("block"), "_source", "_block"), "_block")
    placed = per_block.select(
        "_source", "_block", "words",
        (F.row_number().over(order) - 1).cast("long").alias("nth"),
        F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.count("*").over(Window.partitionBy("_source")).alias("n_blocks"),
    )
    placed = placed.join(plan, same("_source", "_plan_source")).drop("_plan_source")
    placed = placed.withColumn("left", F.greatest(F.lit(0.0), F.col("rest") - F.col("before"))).withColumn("partial", (F.col("left") > 0).cast("long"))
    placed = materialize(placed, "placed")

    # Of a block that is neither full nor empty: the hash up to which documents bring the sum nearest.
    cut = placed.where("left > 0 and left < words").select(F.col("_source").alias("_s"), F.col("_block").alias("_b"), "left")
    inside = cut_points(light, cut)
    placed = placed.join(inside, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b")), "left").drop("_s", "_b")

    units = placed.groupBy(F.col("_source").alias("source")).agg(F.sum(F.col("whole") + F.col("partial")).alias("n_units"))
    leaf = quotas(units, shards, seed)
    leaf = leaf.withColumn("upto", F.sum("quota").over(Window.partitionBy("source").orderBy("shard")))
    leaf = leaf.groupBy(F.col("source").alias("_leaf_source")).agg(F.array_sort(F.collect_list(F.struct("upto", "shard"))).alias("leaves"))

    # Unit number of a block in a pass: passes follow one another, the last, partial one at the end.
    passes = F.transform(
        F.filter(F.sequence(F.lit(0).cast("long"), F.lit(cap).cast("long")), lambda p: p < F.col("whole") + F.col("partial")),
        lambda p: F.struct(p.alias("pass"), (p * F.col("n_blocks") + F.col("nth")).alias("unit")),
    )
    where = F.transform(
        passes,
        lambda p: F.struct(p["pass"].alias("pass"), F.get(F.filter("leaves", lambda s: s["upto"] > p["unit"]), F.lit(0))["shard"].alias("shard")),
    )
    full = F.col("left") >= F.col("words")
    out = placed.join(leaf, same("_source", "_leaf_source"), "left").select(
        F.col("_source").alias("_s"), F.col("_block").alias("_b"), F.col("whole").alias("_whole"),
        # Documents up to this place (the low bits of the hash) are in the last pass as well.
        F.when(F.col("left") <= 0, F.lit(None)).when(full, F.lit(1 << 40)).otherwise(F.col("_cut")).cast("long").alias("_upto"),
        F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), where.alias("_where"),
    )
    plan = materialize(out, "plan")

    # What a source is still short of or over, and the one document whose size comes nearest to it: it is put
    # in or left out, so even a source of few, long documents ends near its target.
    rows = light.join(plan, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b"))).where("_size > 0")
    rows = rows.withColumn("last", in_last_pass())
    gap = rows.groupBy(F.col("_s").alias("_gap_source")).agg(
        (F.first("_target") - F.sum(F.col("_size") * (F.col("_whole") + F.col("last").cast("long")))).alias("gap")
    )
    off = F.abs(F.abs("gap") - F.col("_size"))
    rows = rows.join(gap, same("_s", "_gap_source")).where((off < F.abs("gap")) & ((F.col("gap") > 0) != F.col("last")) & (F.col("_whole") < cap))
    flip = rows.groupBy(F.col("_s").alias("_flip_source")).agg(F.min(F.struct(off, "_hash"))["_hash"].alias("_flip"))
    return materialize(plan.join(flip, same("_s", "_flip_source"), "left").drop("_flip_source"), "flipped")


def in_last_pass() -> Column:
    return F.coalesce(F.col("_hash").bitwiseAND(F.lit((1 << 40) - 1)) <= F.col("_upto"), F.lit(False))


def decide(rows: DataFrame, plan: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Adds what the mix takes of each row. The plan has one row per block: Spark broadcasts it while it is small."""
    out = rows.join(plan, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b")))
    last = in_last_pass() != F.coalesce(F.col("_hash") == F.col("_flip"), F.lit(False))
    out = out.withColumn("_times", F.when(F.col("_size") > 0, F.col("_whole") + last.cast("long")).otherwise(F.lit(0)).cast("int"))
    # A copy beyond the block's units (the one that is put in by itself) goes where the block's last unit does, or by hash.
    after = F.coalesce(F.get("_where", F.size("_where") - 1)["shard"], F.pmod("_hash", F.lit(shards)).cast("int"))
    extra = F.struct(F.col("_whole").alias("pass"), after.alias("shard"))
    spots = F.transform(
        F.slice(F.concat("_where", F.array(extra)), F.lit(1), F.col("_times")),
        lambda w: F.struct(w["pass"].alias("pass"), w["shard"].alias("shard"), F.xxhash64(F.lit(seed), w["pass"], w["shard"], F.col("_hash")).alias("place")),
    )
    out = out.withColumn("_taken", F.col("_size") * F.col("_times")).withColumn("_passes", spots)
    return out.drop("_source", "_hash", "_block", "_s", "_b", "_whole", "_upto", "_flip", "_where", "_times")


def mix(
    docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", cap: int = CAP, blocks: int = BLOCKS, shards: int = SHARDS, seed: int = SEED
) -> DataFrame:
    """One row per document: its columns, and _size, _source_size, _target, _taken and _passes.

    _passes is an array of (pass, shard, place): where each copy goes; place orders a shard.
    """
    rows = weigh(docs, text, source, key, blocks, seed)
    plan = plan_blocks(materialize(rows.select("_source", "_size", "_hash", "_block"), "light"), cap, shards, seed)
    return decide(rows, plan, shards, seed)


def shard_rows(mixed: DataFrame, shard: str = "shard") -> DataFrame:
    """The mix itself: one row per copy with its shard (in a column of that name), each shard shuffled within.

    A shard is dealt into pieces by place, so that all of them are as many as the cluster's shuffle partitions, eight at least.
    """
    tasks = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = max(8, -(-tasks // SHARDS))
    keep = [c for c in mixed.columns if c not in ("_size", "_source_size", "_target", "_taken", "_passes", shard)]
    rows = mixed.select(*keep, F.explode("_passes").alias("_p")).select(*keep, F.col("_p.shard").alias(shard), F.col("_p.place").alias("_place"))
    return rows.repartition(shard, F.pmod("_place", F.lit(pieces))).sortWithinPartitions(shard, "_place").drop("_place")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    # Only numbers are returned, so the sizes are counted once and kept.
    rows = materialize(weigh(docs, "text", "source", "doc_id", BLOCKS, SEED).drop("text", "source"), "light")
    return decide(rows, plan_blocks(rows, CAP, SHARDS, SEED)).select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        F.col("_taken").alias("taken"), F.transform("_passes", lambda p: p["shard"]).alias("shards"),
    )

"""Chat formatting: logged conversations that are the beginning of a longer one collapse into it, then rendering.

Chat logs often hold a snapshot per turn. Every turn gets a rolling hash of its conversation up to that turn: a
running sum of position-bound digests in four lanes of 40 bits, so the sum after k turns names the first k
turns in their order. A conversation whose last hash is some other conversation's hash before its end is a
snapshot of it; an anti-join drops all of those, and of equal conversations the one with the least id stays.

Running sums go over blocks of ``BLOCK`` turn numbers, and over the blocks' sums, so one huge conversation does
not sit in one window. Hashes are grouped before they are joined, so a first turn or a conversation that
everyone shares is one row.

Rendering: ``<|role|>``, a line end, the text, ``<|end|>`` and a line end for each turn; ``<|`` inside a text
becomes ``<\\|``, so no text can pose as a marker.

Defined results: turns are ordered by turn, then role, then text (equal turns keep their number); a null turn
comes last, a null role renders as ``unknown``, a null text as an empty one (but differs from it in the hash);
rows with a null conv_id form one conversation; repeated rows are turns of their own; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

BLOCK = 4096
LANES = 4


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, role, text, nth, total, prefix) of every turn; nth counts from 0, prefix names the turns up to it."""
    block = F.floor(F.coalesce(F.col("turn").cast("double"), F.lit(1e18)) / BLOCK).cast("long")
    rows = turns.select("conv_id", F.col("turn").alias("at"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), block.alias("block"))
    counts = rows.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    over = Window.partitionBy("conv_id")
    counts = counts.select("conv_id", "block", F.sum("n").over(over).alias("total"), (F.sum("n").over(over.orderBy("block")) - F.col("n")).alias("before"))
    order = Window.partitionBy("conv_id", "block").orderBy(F.col("at").asc_nulls_last(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = rows.withColumn("inner", F.row_number().over(order) - 1)
    rows = joined(rows, counts).withColumn("nth", F.col("before") + F.col("inner"))
    digest = F.sha2(F.to_json(F.struct("nth", "role", "text")), 256)
    rows = rows.withColumn("digest", digest)
    lane = lambda i: F.conv(F.substring("digest", 1 + 10 * i, 10), 16, 10).cast("long")
    rows = materialize(rows.select("conv_id", "block", "role", "text", "nth", "total", *[lane(i).alias(f"l{i}") for i in range(LANES)]), "turns")
    sums = rows.groupBy("conv_id", "block").agg(*[F.sum(f"l{i}").alias(f"l{i}") for i in range(LANES)])
    sums = sums.select("conv_id", "block", *[(F.sum(f"l{i}").over(over.orderBy("block")) - F.col(f"l{i}")).alias(f"b{i}") for i in range(LANES)])
    run = Window.partitionBy("conv_id", "block").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    rows = joined(rows.withColumns({f"l{i}": F.sum(f"l{i}").over(run) for i in range(LANES)}), sums)
    prefix = F.concat_ws("-", "nth", *[(F.col(f"l{i}") + F.col(f"b{i}")).cast("string") for i in range(LANES)])
    return rows.select("conv_id", "role", "text", "nth", "total", prefix.alias("prefix"))


def joined(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    a, b = rows.alias("a"), blocks.withColumnsRenamed({"conv_id": "_conv", "block": "_block"}).alias("b")
    return a.join(b, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block"))).drop("_conv", "_block")


def maximal(hashed: DataFrame) -> DataFrame:
    """(conv_id, n_copies) of the conversations that begin no other one; equal ones count as copies."""
    ends = hashed.where(F.col("nth") + 1 == F.col("total"))
    ends = ends.groupBy("prefix").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    inside = hashed.where(F.col("nth") + 1 < F.col("total")).select("prefix").distinct()
    return ends.join(inside, "prefix", "left_anti").select("conv_id", "n_copies")


def rendered(role: Column, text: Column) -> Column:
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("<\\|"))
    return F.concat(F.lit("<|"), safe(F.coalesce(role, F.lit("unknown"))), F.lit("|>\n"), safe(F.coalesce(text, F.lit(""))), F.lit("<|end|>\n"))


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, chat) of every maximal conversation; turns: conv_id, turn, role, text."""
    hashed = materialize(prefix_hashes(turns), "hashed")
    kept = maximal(hashed).withColumnRenamed("conv_id", "_conv")
    rows = hashed.join(kept, F.col("conv_id").eqNullSafe(F.col("_conv")))
    lines = F.array_sort(F.collect_list(F.struct("nth", rendered(F.col("role"), F.col("text")).alias("line"))))
    chats = rows.groupBy("conv_id", "n_copies").agg(lines.alias("lines"))
    chat = F.array_join(F.transform("lines", lambda x: x["line"]), "")
    return chats.select("conv_id", F.size("lines").cast("long").alias("n_turns"), "n_copies", chat.alias("chat"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE = r"""
with t as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls last, role nulls first, text nulls first) as nth, role, text from conversations),
c as (
  select conv_id, count(*) as n, list(struct_pack(role := role, text := text) order by nth) as turns,
    string_agg('<|' || replace(coalesce(role, 'unknown'), '<|', '<\|') || '|>' || chr(10) || replace(coalesce(text, ''), '<|', '<\|') || '<|end|>' || chr(10), '' order by nth) as chat
  from t group by conv_id),
p as (select c.turns[1:k] as part from c, unnest(range(1, c.n)) as r(k)),
e as (select min(conv_id) as conv_id, count(*) as n_copies, turns from c group by turns)
select c.conv_id, c.n as n_turns, e.n_copies, c.chat
from e join c using (conv_id) where not exists (select 1 from p where p.part = e.turns)"""

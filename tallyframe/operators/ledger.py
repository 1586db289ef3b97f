"""Work that is done once: digests with a ledger of what was sent, branches of a state merged by what each has touched, and names
matched again only for a newer matcher.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.kept import kept
from .names import match_names

# Trades that one digest shows, tries to write down that it was sent, and the matcher's version.
SHOWN, TRIES, MATCHER_VERSION = 80, 3, 3


def digest_states(trades: DataFrame, sent: DataFrame, since, shown: int = SHOWN) -> DataFrame:
    """(id, state) of trades (id, created, disclosed, pending): historical (first stored before since, so never sent), sent (in the ledger),
    due (the newest disclosed, at most shown), waiting (pending beyond those) or none.

    sent: (id), any number of times. A trade given twice has one state: that of its latest row, of equal ones a pending one.
    """
    x = trades.groupBy("id").agg(F.max(F.struct("created", "pending", "disclosed")).alias("t")).select("id", "t.*")
    x = x.join(sent.select("id", F.lit(True).alias("_sent")).distinct(), "id", "left")
    open_ = F.col("_sent").isNull() & (F.col("created") >= F.lit(since)) & F.coalesce("pending", F.lit(False))
    due = x.where(open_).orderBy(F.col("disclosed").desc_nulls_last(), F.desc("id")).limit(shown).select("id", F.lit(True).alias("_due"))
    x = x.join(F.broadcast(due), "id", "left")  # at most shown rows
    return x.select("id", F.when(F.col("_sent").isNotNull(), "sent").when(F.col("created") < F.lit(since), "historical").when(F.col("_due").isNotNull(), "due").when(open_, "waiting").otherwise("none").alias("state"))


def read_ledger(spark, path: str) -> DataFrame:
    """(id, run) of all that was sent; makes the ledger where there is none."""
    empty = spark.sql("select cast(null as string) id, cast(null as string) run where false")
    empty.write.mode("append").parquet(path)
    return spark.read.schema(empty.schema).parquet(path)


def append_ids(ids: DataFrame, path: str) -> None:
    ids.write.mode("append").parquet(path)


def send_digest(trades: DataFrame, path: str, run: str, since, send: Callable[[DataFrame], bool], shown: int = SHOWN, write: Callable[[DataFrame, str], None] = append_ids) -> tuple[str, int]:
    """(outcome, tries to write it down): sends what is due, then writes its ids to the ledger, with up to three tries.

    At least once: where every try fails ("unmarked"), the rows stay due and are sent again by the next run. Where the
    ledger was written, a run that is repeated finds nothing due ("nothing"). "refused": send returned false; nothing is marked.
    """
    states = digest_states(trades, read_ledger(trades.sparkSession, path), since, shown)
    due = kept(states.where("state = 'due'").select("id"), "due")
    if not due.limit(1).count():
        return "nothing", 0
    if not send(trades.join(F.broadcast(due), "id", "left_semi")):
        return "refused", 0
    for n in range(1, TRIES + 1):
        try:
            write(due.select(F.col("id").cast("string").alias("id"), F.lit(run).alias("run")).coalesce(1), path)
            return "sent", n
        except Exception as e:  # noqa: BLE001  whatever the store throws, the digest has gone out
            print(f"digest {run}: try {n} to mark {e.__class__.__name__}: {str(e)[:200]}")
    return "unmarked", TRIES


def merge_branches(base: DataFrame, ours: DataFrame, theirs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, conflict): two states that began as base, merged by what each has touched: added, changed or deleted.

    What only one of them touched is as that one has it, so branches that touch different keys merge to the same state in
    either order. Where both did, and not alike, theirs stands and conflict is true, also in a row with a null value where they deleted it.
    """
    side = lambda df, n: df.select(*keys, F.struct(F.col(value).alias("v")).alias(n))
    x = side(base, "_b").join(side(ours, "_o"), keys, "full_outer").join(side(theirs, "_t"), keys, "full_outer")
    ours_did, theirs_did = ~F.col("_o").eqNullSafe(F.col("_b")), ~F.col("_t").eqNullSafe(F.col("_b"))
    now = F.when(theirs_did, F.col("_t")).otherwise(F.col("_o"))
    x = x.withColumns({"_now": now, "conflict": ours_did & theirs_did & ~F.col("_o").eqNullSafe(F.col("_t"))})
    return x.where("_now is not null or conflict").select(*keys, F.col("_now.v").alias(value), "conflict")


def merge_slices(current: DataFrame, local: DataFrame, touched: dict[str, str], now) -> DataFrame:
    """(source, part, key, value, until): the stored state after a run that worked on some sources.

    Both: one row for each source and part ("state", or "wait" with until), and for waits of single documents (part "document",
    with their key). touched: by source, "state" (its state, where there is one, and its wait are the run's) or "wait" (only its wait). Waits of
    documents come from both, the run's first, and go when they have passed.
    """
    both = lambda kinds: [s for s, k in touched.items() if k in kinds]
    w = local.where(F.col("source").isin(both(("state", "wait")) or [""]) & (F.col("part") == "wait"))
    s = local.where(F.col("source").isin(both(("state",)) or [""]) & (F.col("part") == "state"))
    kept_waits = current.where((F.col("part") == "wait") & ~F.col("source").isin(both(("state", "wait")) or [""]))
    kept_states = current.where(F.col("part") == "state").join(s.select("source"), "source", "left_anti")
    mine = local.where("part = 'document'")
    documents = mine.unionByName(current.where("part = 'document'").join(mine.select("source", "key"), ["source", "key"], "left_anti")).where(F.col("until") > F.lit(now))
    out = kept_waits.unionByName(w).unionByName(kept_states).unionByName(s).unionByName(documents)
    return out.select("source", "part", "key", "value", "until")


def due_for_rematch(rows: DataFrame, fetched, version: int = MATCHER_VERSION) -> DataFrame:
    """Rows (id, asset, ticker, ticker_source, matched_at, matched_by) without a ticker, not told so by the filing, that were last matched
    before the catalog was fetched or by an older matcher.
    """
    never = F.col("ticker").isNull() & (F.coalesce("ticker_source", F.lit("")) != "filing")
    return rows.where(never & (F.col("matched_at").isNull() | (F.col("matched_at") < F.lit(fetched)) | (F.coalesce("matched_by", F.lit(0)) < version)))


def rematched(rows: DataFrame, fetched, version: int = MATCHER_VERSION, **catalog: DataFrame) -> DataFrame:
    """Rows as they are after matching what is due; all others as they were. Run again, it changes nothing."""
    due = due_for_rematch(rows, fetched, version)
    found = match_names(due.select("id", F.col("asset").alias("name")), **catalog).select("id", F.col("ticker").alias("_ticker"), F.col("confidence").alias("_confidence"), F.lit(True).alias("_done"))
    x = rows.join(found, "id", "left")
    done, hit = F.coalesce("_done", F.lit(False)), F.col("_ticker").isNotNull()
    return x.withColumns({
        "ticker": F.coalesce("ticker", "_ticker"), "ticker_source": F.when(hit, "name_match").otherwise(F.col("ticker_source")), "confidence": F.when(done, F.col("_confidence")).otherwise(F.col("confidence")),
        "matched_at": F.when(done, F.lit(fetched)).otherwise(F.col("matched_at")), "matched_by": F.when(done, F.lit(version)).otherwise(F.col("matched_by")),
    }).select(*rows.columns)


def rematch_table(spark, path: str, by: str, fetched, version: int = MATCHER_VERSION, **catalog: DataFrame) -> int:
    """How many rows were due in the table at path, partitioned by a column: only partitions with such rows are written again."""
    rows = spark.read.parquet(path)
    touched = kept(due_for_rematch(rows, fetched, version).groupBy(by).count(), "touched")
    n = touched.agg(F.sum("count")).first()[0] or 0
    if n:
        new = kept(rematched(rows.join(touched.select(by), by, "left_semi"), fetched, version, **catalog), "rematched")
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    return n

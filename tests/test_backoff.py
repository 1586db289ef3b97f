"""Waits after misses on a stream: equal to the replay, and kept over a restart."""

import shutil
import tempfile
from datetime import datetime, timedelta

import pytest

from tallyframe.plans.failures import price_attempts
from tallyframe.sources.tables import Tables
from tallyframe.streaming import backoff

STORE = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture()
def rocks(spark):
    old = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set(STORE, old)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def stream(spark, files, base, policy):
    """Appends the rows to the input, one file a call, and lets the query that keeps its checkpoint take what is new."""
    for rows in files:
        spark.createDataFrame(rows, backoff.ATTEMPT).coalesce(1).write.mode("append").parquet(f"{base}/in")
        source = spark.readStream.schema(backoff.ATTEMPT).parquet(f"{base}/in")
        q = backoff.watch(source, policy).writeStream.option("checkpointLocation", f"{base}/check").format("parquet").option("path", f"{base}/out").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(backoff.STEP).parquet(f"{base}/out")


def test_restarted_stream_equals_the_replay(rocks, sf_dir):
    """Half the attempts before a restart, half after it; strikes and waits go on."""
    rows = [tuple(r) for r in price_attempts(Tables(rocks, sf_dir)).where("cast(key as int) < 6").orderBy("ts").collect()]
    base = tempfile.mkdtemp(prefix="tallyframe-test-")
    out = stream(rocks, [rows[: len(rows) // 2], rows[len(rows) // 2 :]], base, backoff.PRICES)
    steps = out.where("action <> 'ready'")
    want = backoff.replay(rocks.createDataFrame(rows, backoff.ATTEMPT)).collect()
    assert sorted(map(str, steps.collect())) == sorted(map(str, want)) and {r.action for r in want} == {"ok", "miss", "skipped"}
    ready = {(r.key, r.until) for r in out.where("action = 'ready'").collect()}
    assert ready and ready <= {(r.key, r.until) for r in want if r.action == "miss"}
    shutil.rmtree(base)


def test_ladders_of_both_policies():
    minute = backoff.MINUTE
    until, strikes, reason, waits = None, 0, None, []
    for _ in range(6):
        ts = until or 0
        _, until, strikes, reason = backoff.next_state(backoff.PRICES, until, strikes, reason, ts, "rate-limit", True, None)
        waits.append((until - ts) // minute)
    assert waits == [20, 40, 80, 160, 180, 180] and strikes == 6
    assert backoff.next_state(backoff.PRICES, until, strikes, reason, until - 1, None, True, None)[0] == "skipped"
    assert backoff.next_state(backoff.PRICES, until, strikes, reason, until, None, True, None) == ("ok", None, 0, None)
    assert backoff.next_state(backoff.PRICES, None, 3, None, 0, "rate-limit", False, None) == ("miss", 30 * minute, 4, "rate-limit")
    assert backoff.next_state(backoff.PRICES, None, 3, None, 0, backoff.ALL_WAIT, True, 7 * minute) == ("miss", 7 * minute, 3, backoff.ALL_WAIT)
    assert backoff.next_state(backoff.SOURCES, None, 1, None, 0, "429", True, None) == ("miss", 30 * minute, 2, "429")
    assert backoff.next_state(backoff.SOURCES, None, 4, None, 0, "blocked", True, None) == ("miss", 720 * minute, 0, "blocked")


@pytest.mark.parametrize("policy", [backoff.PRICES, backoff.SOURCES])
def test_replay_equals_a_loop(spark, policy):
    at = datetime(2024, 3, 9, 1)
    reasons = [None, "rate-limit", "429", "blocked", "not-found", backoff.ALL_WAIT]
    rows = [(f"k{k}", at + timedelta(minutes=(i * i * (k + 3)) % 1900), reasons[(i * 7 + k) % 6], [True, False, None][i % 3], at + timedelta(minutes=40 * i) if i % 2 else None) for k in range(5) for i in range(40)]
    got = backoff.replay(spark.createDataFrame(rows, backoff.ATTEMPT), policy).collect()
    want = []
    epoch = datetime(1970, 1, 1)
    micros = lambda t: None if t is None else (t - epoch) // timedelta(microseconds=1)
    time = lambda x: None if x is None else epoch + timedelta(microseconds=x)
    for key in {r[0] for r in rows}:
        until, strikes, held = None, 0, None
        mine = [(micros(ts), r, k is not False, micros(m)) for name, ts, r, k, m in rows if name == key]
        for ts, reason, known, resumes in sorted(mine, key=lambda a: tuple((x is not None, x) for x in a)):
            action, until, strikes, held = backoff.next_state(policy, until, strikes, held, ts, reason, known, resumes)
            want.append((key, time(ts), action, time(until), strikes, held))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)

"""Whitening of embeddings by merged covariances.

Components become integers (floor of 256 times each), and each different vector counts once in the fit. Every partition
computes a state of its part: how many vectors, their exact sums, their mean, and their scatter centred on that mean. Two
states are merged by Chan's formula: with d the difference of the means, the scatters add up to that of the union but for
``outer(d, d) * n * m / (n + m)``. treeReduce merges them pair by pair, the driver takes eigenvectors of one matrix of the
vectors' length, and a second pass over the fit list measures how far the whitened vectors' covariance, merged in the same
way, is from the identity.

What is bounded: a state has length ** 2 numbers (32 kB for 64 dimensions), whatever the rows. Different vectors are found
by a shuffle with map-side combine, so a vector that a third of the rows share costs one row a task.

Defined results: rows whose vector is null, or holds null or non-finite components, are dropped, and so are rows with a
vector of another length than most have (of equally frequent lengths the least counts). Null and equal ids pass, one result
each. Integers end at +-2**62. A deviation beyond a long is null. Where a component's variance is nothing beside the
largest (as when there are fewer different vectors than components), whitened is null and the identity has no entry for
it. An empty table gives no rows. Extra columns pass as they are; an added one takes the place of one of its name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_columns, materialize, packed, small_batches, unpacked

COMPONENTS = 4
#: Rows of a vector are read in blocks of about this many numbers.
BLOCK = 1 << 20
#: An eigenvalue below this share of the largest is nothing.
NOTHING = 1e-12
END = 1 << 62
ADDED = ["component", "n", "deviation", "whitened", "explained", "identity_error"]


@dataclass
class State:
    """How many vectors, their exact sums, their mean, and the scatter about it."""

    n: int
    sums: np.ndarray  # of Python's integers
    mean: np.ndarray
    scatter: np.ndarray

    @classmethod
    def of(cls, block: np.ndarray) -> State:
        """Of vectors as rows; sums are exact for integers."""
        whole = block.astype(object) if block.dtype == np.int64 and np.abs(block).max(initial=0) > END // max(len(block), 1) else block
        sums = whole.sum(0).astype(object)
        mean = (sums / len(block)).astype(float)
        centred = block.astype(float) - mean
        return cls(len(block), sums, mean, centred.T @ centred)

    def merge(self, other: State) -> State:
        if not self.n or not other.n:
            return self if self.n else other
        n, apart = self.n + other.n, other.mean - self.mean
        mean = self.mean + apart * (other.n / n)
        return State(n, self.sums + other.sums, mean, self.scatter + other.scatter + np.outer(apart, apart) * (self.n * (other.n / n)))


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def kept_vectors(rows: DataFrame, vector: str, *more: Column) -> tuple[DataFrame, int]:
    """(_row, _v, more) of the rows that count, and the length that their vectors have (0: there are none)."""
    held = rows.select(packed(rows).alias("_row"), F.col(vector).cast("array<double>").alias("_v"), *more).where(usable(F.col("_v")))
    first = held.groupBy(F.size("_v").alias("_size")).count().orderBy(F.desc("count"), "_size").first()
    length = first["_size"] if first else 0
    return held.where(F.size("_v") == length), length


def integers(flat: np.ndarray) -> np.ndarray:
    """Floors of 256 times each number, as int64."""
    return np.clip(np.floor(256.0 * flat), -END, END).astype(np.int64)


def matrix(column: pa.Array, length: int) -> np.ndarray:
    """The vectors of an Arrow column of lists, all of one length, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def blocks(batches: Iterator[pa.RecordBatch], name: str, length: int) -> Iterator[np.ndarray]:
    step = max(BLOCK // length, 1)
    for batch in batches:
        rows = matrix(batch.column(name), length)
        yield from (rows[at : at + step] for at in range(0, len(rows), step))


def merged(df: DataFrame, name: str, length: int, project=lambda x: x) -> State:
    """The state of all vectors in a column: one per partition, merged up a tree. project: what is made of a block of rows first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for block in blocks(batches, name, length):
            part = State.of(project(block))
            state = part if state is None else state.merge(part)
        if state is not None:
            packed_state = [[state.n], [[str(s) for s in state.sums]], [state.mean.tolist()], [state.scatter.ravel().tolist()]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in packed_state], names=["n", "sums", "mean", "scatter"])

    def state(row) -> State:
        mean = np.array(row["mean"])
        return State(row["n"], np.array([int(float(s)) if "." in s or "e" in s else int(s) for s in row["sums"]], object), mean, np.array(row["scatter"]).reshape(len(mean), len(mean)))

    states = df.select(name).mapInArrow(run, "n bigint, sums array<string>, mean array<double>, scatter array<double>")
    return states.rdd.map(state).treeReduce(State.merge)


@dataclass
class Whitening:
    n: int
    sums: np.ndarray
    mean: np.ndarray
    axes: np.ndarray  # a column for each component
    scale: np.ndarray  # roots of the eigenvalues, nan where there is no variance
    explained: np.ndarray
    identity_error: float | None = None

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x.astype(float) - self.mean) @ self.axes / self.scale


def fit(different: DataFrame, name: str, length: int, components: int = COMPONENTS) -> Whitening:
    """Of a column of different integer vectors, at least one."""
    state = merged(different, name, length)
    values, axes = np.linalg.eigh(state.scatter / state.n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)  # one sign on every run
    trace = float(np.trace(state.scatter)) / state.n
    there = values > max(values.max(initial=0.0), 0.0) * NOTHING
    scale = np.where(there, np.sqrt(np.maximum(values, 0.0)), np.nan)
    out = Whitening(state.n, state.sums, state.mean, axes, scale, values / trace if trace else np.zeros(len(values)))
    if there.any():
        live = Whitening(out.n, out.sums, out.mean, axes[:, there], scale[there], out.explained)
        second = merged(different, name, length, live.project)
        out.identity_error = float(np.abs(second.scatter / second.n - np.eye(int(there.sum()))).max())
    return out


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Exact sums of squares: in 64 bits where all of them fit, else in Python's integers."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if most < 1 << 62 and most * most * max(x.shape[1], 1) < 1 << 62:
        return ((n * x - sums.astype(np.int64)) ** 2).sum(1).tolist()
    exact = ((n * x.astype(object) - sums) ** 2).sum(1)
    return [int(d) if d < 1 << 63 else None for d in exact]


def whiten(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each row that counts and each component (at most as many as the vectors are long): the row's columns,
    component (from 1), n, deviation, whitened, explained, identity_error.
    """
    small_batches(rows.sparkSession, rows=4096)
    held, length = kept_vectors(rows, vector)
    added = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if not length:
        return unpacked(held.selectExpr("_row", *(f"cast(null as {a.split()[1]}) as {a.split()[0]}" for a in added.split(", "))), "_row", ADDED).where("false")

    def to_integers():
        return lambda v: {"_x": list(integers(matrix(v, length)))}

    x = materialize(map_columns(held.select("_v"), to_integers, ["_v"], "_x array<bigint>", ("_v",), arrow=True).distinct(), "fit")
    model = fit(x, "_x", length, components)

    def results():
        def run(v: pa.Array) -> dict[str, list]:
            block = integers(matrix(v, length))
            return {"_deviation": _deviations(block, model.n, model.sums), "_whitened": list(model.project(block))}

        return run

    out = map_columns(held, results, ["_v"], "_deviation bigint, _whitened array<double>", ("_v",), arrow=True)
    explained = F.array(*(F.lit(float(e)) for e in model.explained))
    out = out.select("_row", "_deviation", F.posexplode("_whitened").alias("_at", "_w")).select(
        "_row", (F.col("_at") + 1).cast("int").alias("component"), F.lit(model.n).cast("bigint").alias("n"), F.col("_deviation").alias("deviation"),
        F.when(~F.isnan("_w"), F.col("_w")).alias("whitened"), explained[F.col("_at")].alias("explained"), F.lit(model.identity_error).cast("double").alias("identity_error"),
    )
    return unpacked(out, "_row", ADDED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")).select("vec_id", *ADDED)

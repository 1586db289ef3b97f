"""Shared helpers of the training-data operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: White space of the operators' contracts: space and U+0009 to U+000D, nothing else.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(name: str = "text") -> Column:
    """The text, a null one as the empty string."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text (no null, no empty word; an empty array for an empty text)."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def small_batches(spark: SparkSession, rows: int = 256, size: str = "16m") -> None:
    """Rows and bytes per Arrow batch, so that a batch of long texts stays small beside an executor's memory.

    These are settings of the caller's session and stay in it: lazy results read them when they run.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def packed(df: DataFrame, *without: str) -> Column:
    """The columns of df but some, as one struct: no name in it can clash with a name that an operator uses."""
    return F.struct(F.lit(True).alias("_"), *(F.col(quoted(c)).alias(c) for c in df.columns if c not in (*without, "_")))


def unpacked(df: DataFrame, row: str, added: list[str]) -> DataFrame:
    """The columns packed in row, but those that an added one has the name of, and the added ones."""
    taken = {a.lower() for a in added}
    names = [c for c in df.schema[row].dataType.names if c != "_" and c.lower() not in taken]
    return df.select(*(F.col(f"{row}.{quoted(c)}").alias(c) for c in names), *added)


def map_columns(
    df: DataFrame, prepare: Callable[[], Callable[..., dict[str, list]]], reads: list[str], adds: str, drops: tuple[str, ...] = (), arrow: bool = False
) -> DataFrame:
    """df without drops and with the columns of adds (DDL), which a function computes from the columns reads.

    prepare runs once in a task and gives that function: one list per column of reads in, one list per added
    column out, in the order of the rows. All other columns pass as Arrow arrays, so a key of any type and
    size comes out as it went in, beside nulls too. With arrow, the function gets Arrow arrays in place of lists.
    """
    added = StructType.fromDDL(adds)
    kept = [f for f in df.schema.fields if f.name not in drops and f.name not in added.names]
    schema = StructType([*kept, *added.fields])
    names, kinds = [f.name for f in kept], to_arrow_schema(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = prepare()
        for batch in batches:
            if batch.num_rows:
                got = compute(*(batch.column(r) if arrow else batch.column(r).to_pylist() for r in reads))
                added_arrays = [x.cast(k.type) if isinstance(x := got[k.name], pa.Array) else pa.array(x, k.type) for k in kinds]
                arrays = [batch.column(n) for n in names] + added_arrays
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return df.mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder that the cluster names.

    Where the session names none, a temporary folder is set for it on a single machine; on a cluster, whose
    executors would not see it, this raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='tallyframe-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tallyframe-{os.getpid()}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

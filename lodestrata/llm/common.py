"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.running import shared_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _delete(spark: SparkSession, path: str, later: bool = False) -> None:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.deleteOnExit(folder) if later else system.delete(folder, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage with a reliable copy, so that a lost executor costs a
    reread only.  The files go with ``discard``, or when the driver's JVM ends.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/lodestrata-{uuid.uuid4().hex}"
    df.write.parquet(f"{folder}/{name}")
    _delete(spark, folder, later=True)
    out = spark.read.schema(df.schema).parquet(f"{folder}/{name}")
    out._written_to = folder
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``materialize`` wrote, once all that is made of them is written too."""
    for df in tables:
        _delete(df.sparkSession, df._written_to)


def release(spark: SparkSession) -> None:
    """Lets Spark remove shuffle files of jobs whose results are written, and gives the driver's free memory back.

    Spark drops them when the driver collects its garbage, which a driver with
    little to do rarely does by itself; until then they take disk.  What the JVM has
    freed outside its heap stays with its allocator and adds up over a run's jobs.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    give_back()
    trim_jvm(spark)


def trim_jvm(spark: SparkSession) -> None:
    """Has the driver's JVM return free memory outside its heap to the system; one that has no such command keeps it."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway

    def array(kind: object, *values: object) -> object:
        out = gateway.new_array(kind, len(values))
        for i, v in enumerate(values):
            out[i] = v
        return out

    named = jvm.java.lang.Class.forName
    kinds = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
    # By the interface, for the server's own class isn't open.
    invoke = named("javax.management.MBeanServerConnection").getMethod("invoke", array(jvm.java.lang.Class, *map(named, kinds)))
    commands = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    given = array(jvm.Object, commands, "systemTrimNativeHeap", array(jvm.Object, array(jvm.String)), array(jvm.String, kinds[-1]))
    with contextlib.suppress(Py4JJavaError):  # a JVM before 17.0.9, or of another system
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, UPPER.lower())


def map_arrow(df: DataFrame, fn: Callable[[pa.Table], pa.Table | None], schema: str, rows: int = 2000) -> DataFrame:
    """``mapInArrow`` in slices of at most ``rows`` rows, so that memory is bounded by a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = fn(pa.Table.from_batches([batch.slice(at, rows)]))
                if out is not None:
                    yield from out.to_batches()
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Returns freed memory to the system: Python workers are kept for later tasks, and what they hold adds up."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def row_digest(*columns: str) -> Column:
    """128 bits that name a row by its values; null differs from every text, equal rows share it."""
    parts = [F.coalesce(F.concat(F.lit("1"), F.col(c).cast("string")), F.lit("0")) for c in columns]
    return F.unhex(F.md5(F.concat_ws("\u0001", *parts).cast("binary")))


def hash_unit(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the parts; the same in each run."""
    text = F.concat_ws("\u0001", *[F.coalesce(p.cast("string"), F.lit("\u0002")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""

    @F.arrow_udf("bigint")
    def count(data: pa.Array) -> pa.Array:
        return pa.array([len(b.split()) if b else 0 for b in data.to_pylist()], pa.int64())

    return count(text.cast("binary"))

"""Shared helpers: places that every executor sees, lineage cuts, Arrow maps, connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager, suppress
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

T = TypeVar("T")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local session without one gets a folder of its own."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place:
        return place.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    kept = spark.sparkContext._jsc.sc().getCheckpointDir()
    if kept.isDefined():
        return kept.get()
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sievewright-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


#: Spark's setting that removes a query's shuffle files when it ends.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Places of the tables that this process has cut and not removed, oldest first.
cuts: list[str] = []


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes within go as each ends; else they stay until the driver has collected its garbage."""
    before = spark.conf.get(TIDY, "false")
    spark.conf.set(TIDY, "true")
    try:
        yield
    finally:
        spark.conf.set(TIDY, before)


def cut(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write df as a Parquet table in the shared folder and read it back: the plan starts anew there."""
    spark, place = df.sparkSession, f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    cuts.append(place)
    with tidied(spark):
        df.write.parquet(place)
    return spark.read.schema(df.schema).parquet(place), place


def remove(spark: SparkSession, place: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if place in cuts:
        cuts.remove(place)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Removes the tables cut within it but for those whose places are put into the list that it gives. A result that
    reads them has to be written before it ends."""
    before, keep = set(cuts), []
    try:
        yield keep
    finally:
        for place in [p for p in cuts if p not in before and p not in keep]:
            remove(spark, place)


def release(spark: SparkSession) -> None:
    """Let go of finished jobs' shuffle files: Spark deletes them once the driver has collected what refers to them,
    which may otherwise take it longer than the jobs that follow."""
    gc.collect()
    spark._jvm.System.gc()


def struct(ddl: str) -> StructType:
    return _parse_datatype_string(ddl)


#: What this worker process holds beyond a task: the module that it belongs to, its key, and the object.
_held: list[tuple[str, tuple, object]] = []


def held(module: str, key: tuple, make: Callable[[], T]) -> T:
    """An object that a worker makes once and keeps for the tasks to come, until another operator's tasks run in it:
    workers are reused, and what several operators remember would add up."""
    if not _held or _held[0][:2] != (module, key):
        _held.clear()
        _held.append((module, key, make()))
    return _held[0][2]


def let_go(module: str) -> None:
    """Drops what another module's operator holds in this worker, and gives its memory back to the system. A function of
    its own, as one within another is sent to the workers with copies of the lists that it names."""
    if _held and _held[0][0] != module:
        _held.clear()
        gc.collect()
        with suppress(OSError, AttributeError):  # other C libraries have no such call
            ctypes.CDLL(None).malloc_trim(0)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[dict]], ddl: str) -> DataFrame:
    """mapInArrow for functions that yield dicts of columns in the order of ddl."""
    schema = struct(ddl)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(fn.__module__)
        for out in fn(batches):
            arrays = [pa.array(out[f.name], type=f.type) for f in arrow]
            if len(arrays[0]):
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)
        pa.default_memory_pool().release_unused()  # the worker stays, idle, beside what the next operator's tasks need

    return df.mapInArrow(run, schema)


def slices(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows at most: what Python holds of a batch is held a part at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """Connected components of edges (a long, b long): one row (node, root) per node in an edge; root is the
    smallest node of the component. Alternates large-star and small-star steps, each a grouped minimum (which
    combines before the shuffle) and a join, until the edges stay as they are. No link reaches the driver;
    only a count and a checksum do. Empty input gives an empty result; self-links are ignored."""
    spark = edges.sparkSession
    both = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
    now, place = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), tag)
    seen = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state.n == 0 or (state.n, state.h) == seen:
            break
        seen = (state.n, state.h)
        wide = now.select(F.explode(both).alias("e")).select("e.u", "e.v")
        least = wide.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = wide.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")
        ).select(F.col("e.v").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct()
        after, new = cut(small, tag)
        remove(spark, place)
        now, place = after, new
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

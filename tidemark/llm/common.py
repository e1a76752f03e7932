"""What the operators of this subpackage share: reading, cutting lineage, row checks, connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a table that may be broadcast; every broadcast here is preceded by a count against a bound below this.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local session without it gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Materialized tables of one computation, whose folders go once nothing will read them."""

    def __init__(self):
        self.folders: list[str] = []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        spark = df.sparkSession
        path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.folders.append(path)
        return spark.read.schema(df.schema).parquet(path)

    def clear(self, spark: SparkSession) -> None:
        for path in self.folders:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        self.folders = []


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run, which returns a task's memory to the system at its end: Python workers live on and serve other tasks."""

    def wrapped(batches: Iterator[pa.RecordBatch]):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return wrapped


def blocks(count: int, size: int) -> int:
    return max(1, -(-count // size))


def spread(n: int) -> Column:
    """A block number in 0..n-1 that no key can make uneven: it is taken from the row's place, not from its values."""
    return F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int")


def finite_vector(name: str) -> Column:
    """True where the array is neither null nor holds a null or non-finite component."""
    bad = F.exists(F.col(name), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.col(name).isNotNull() & ~F.coalesce(bad, F.lit(True))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for the undirected graph of edges; component is the smallest node reachable.

    Alternating large-star and small-star passes; each pass is two shuffles of the edges, which only shrink towards
    stars. The hub of a star is met through map-side minimums (partial aggregation), and neighbours are joined back
    by key, so that no list of a node's neighbours is ever collected.
    """
    cur = materialize(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges"
    )
    digest = [F.count("*"), F.sum(F.hash("u", "v").cast("long"))]
    total = cur.agg(*digest).first()
    while True:
        if not total[0]:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: each larger neighbour of u goes to the smallest node around u
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        small = materialize(small, "edges")
        before, total, cur = total, small.agg(*digest).first(), small
        if tuple(before) == tuple(total):
            return cur.select(F.col("u").alias("node"), F.col("v").alias("component"))

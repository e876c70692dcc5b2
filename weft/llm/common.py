"""Shared helpers: shared storage, local union-find, distributed components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares. Where spark.checkpoint.dir is unset, a local master gets a folder of its own (one
    machine runs all of it, as in tests); on a cluster that is an error."""
    sc = spark.sparkContext
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if set_dir is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        set_dir = "file://" + tempfile.mkdtemp(prefix="weft-")
        atexit.register(shutil.rmtree, set_dir.removeprefix("file://"), ignore_errors=True)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(set_dir)
    return set_dir


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Tables that this session's operators wrote and that their results may still read.
WRITTEN: list[str] = []


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint that outlives executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/weft-{name}-{uuid.uuid4().hex}"
    WRITTEN.append(path)
    return path


def delete_tables(spark: SparkSession) -> None:
    """Delete what operators wrote to the shared folder; call it when their results have been read."""
    while WRITTEN:
        delete_path(spark, WRITTEN[-1])


def held_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df, written to a table of the shared folder and read again, and the table's path."""
    spark, path = df.sparkSession, table_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if path in WRITTEN:
        WRITTEN.remove(path)
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A shared table. Texts are long, so smaller Arrow batches than Spark's default bound what a worker holds; a size that
    the session was given stays."""
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, "2000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, with as many underscores before them as it takes to differ from all those taken, in any case."""
    lower, out = {t.lower() for t in taken}, []
    for n in names:
        while n.lower() in lower:
            n = "_" + n
        lower.add(n.lower())
        out.append(n)
    return out


#: So many rows of a few ids and hashes are broadcast at most, some 20 MB; more are joined by a shuffle.
FEW = 500_000


def few(df: DataFrame) -> tuple[DataFrame, int]:
    """A checkpointed table of ids and hashes, to be broadcast if it has at most FEW rows, and its number of rows."""
    n = df.count()
    return (F.broadcast(df) if n <= FEW else df), n


def trim() -> None:
    """Give back what earlier tasks of this worker process have freed; workers live on from stage to stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index of the component of each of n nodes under the edges (i, j)."""
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        differ = a != b
        if not differ.any():
            break
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b), both long: rows (node, component), component the smallest node.

    Alternating large-star and small-star rounds until nothing changes: at most about log(n) squared of them (Kiveris et
    al., 2014), so there is no limit to set. Minima are pre-aggregated, and joined back by sort-merge joins that AQE may
    split, so a hub never has to fit one task. Each round's table is deleted once the next one is written; the last one
    stays for the result (delete_tables). Nodes without edges do not appear. Nulls and loops are ignored.
    """
    spark = edges.sparkSession
    e = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    (e, path), before = held_table(e, "edges"), None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e, new = held_table(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        delete_path(spark, path)
        path = new
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))

"""What the operators of this subpackage share: table access, shared storage, components."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: what ``spark.checkpoint.dir`` names.

    Where that is unset, a session whose executors are threads of the driver, as in tests, gets a
    folder of its own; any other has no folder that all of it sees, so this raises.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="cairn-checkpoint-"))
        found = sc.getCheckpointDir()
    return found


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back.

    The files outlive any executor, so a lost one costs a reread rather than a recomputation.
    ``release`` removes them once nothing reads them any more.
    """
    return written(df, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` as it is read from ``path``, where it is written to."""
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cairn_path = path
    return out


def release(df: DataFrame) -> None:
    """Remove the files of a materialized frame, and of those it is made of, that nothing reads any more."""
    path = getattr(df, "_cairn_path", None)
    for part in getattr(df, "_cairn_parts", ()):
        release(part)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting for as long as the jobs inside run."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


#: Bytes of an Arrow batch: what goes to and from Python workers at once, whatever the rows' sizes.
BATCH_BYTES = 4 << 20
#: Rows of a batch that are worked on at once; what a worker holds beside the batch is for these.
ROWS = 1024


def give_back() -> None:
    """Return freed memory to the system: a worker lives on beside tasks of other kinds."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


#: What this worker has learned that serves the next task of the same kind.
_learned: dict[str, object] = {}


def learned(name: str, make: Callable) -> object:
    """What ``make`` gives, kept by a Python worker for its next tasks until one comes that keeps nothing."""
    if name not in _learned:
        _learned[name] = make()
    return _learned[name]


def forget() -> None:
    """Drop what was learned, if anything was, and return its memory to the system."""
    if _learned:
        _learned.clear()
        gc.collect()
        give_back()


def map_arrow(df: DataFrame, run: Callable, schema: str, keeps: bool = False) -> DataFrame:
    """``mapInArrow`` with small batches, so that neither side holds much of a partition.

    Spark hands its idle workers to whatever task comes next, so a worker first drops what it has
    ``learned`` unless its task ``keeps`` that: else it would stay in memory beside all later steps.
    Spark reads the size when the job begins, after this returns, so it stays set for the session.
    """

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            forget()
        yield from run(batches)
        give_back()

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(tidy, schema)


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply ``f`` to slices of Arrow batches, one after the other; it keeps nothing between them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                yield f(b.slice(i, ROWS))

    return map_arrow(df, run, schema)


def connected_components(edges: DataFrame) -> DataFrame:
    """Label each node of ``edges(a, b)`` with the smallest node of its component.

    Alternates large-star and small-star steps until every edge leads straight to a least node: no
    node has two edges down, and none that an edge leads to has one. Each step is one minimum per
    node, combined before the shuffle, and an equi-join back to the edges, which adaptive execution
    may split where a node has very many edges. Edges never leave the executors. Returns
    ``(node, root)``; an edge from a node to itself, or one with a null, counts for nothing.
    """
    at = materialize(
        edges.where("a <> b").selectExpr("greatest(a, b) AS u", "least(a, b) AS v").distinct(), "edges"
    )
    while True:
        twice = at.groupBy("u").count().where("count > 1").select("u")
        passed = at.select("u").join(at.select(F.col("v").alias("u")).distinct(), "u", "left_semi")
        if twice.unionByName(passed).isEmpty():
            break
        both = at.unionByName(at.selectExpr("v AS u", "u AS v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) AS m")
        large = both.where("v > u").join(least, "u").selectExpr("v AS u", "m AS v").where("u <> v").distinct()
        # small star: every edge already points from the larger node to a smaller one
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u")
        small = (
            hung.selectExpr("v AS u", "m AS v")
            .unionByName(low.selectExpr("u", "m AS v"))
            .where("u <> v")
            .distinct()
        )
        now = materialize(small, "edges")
        release(at)
        at = now
    stars = at.selectExpr("u AS node", "v AS root")
    out = stars.unionByName(stars.select("root").distinct().selectExpr("root AS node", "root"))
    out._cairn_parts = (at,)
    return out

"""Shared storage, size-checked broadcasts and connected components."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A join side is broadcast only if its rows are counted and stay below this many bytes.
BROADCAST_BYTES = 32 << 20
#: Rows go to Python in Arrow batches of about this many bytes, so a worker's memory does not follow the texts' mean length.
ARROW_BYTES = 4 << 20
#: Edges that a task contracts at a time; more go through in further chunks.
CONTRACT_EDGES = 1 << 20

_written: list[tuple[SparkSession, str]] = []


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_batches(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow with batches of at most ARROW_BYTES (or one row); the session keeps a lower bound of its own."""
    conf = df.sparkSession.conf
    bound = conf.get("spark.sql.execution.arrow.maxBytesPerBatch").lower()
    if not bound.removesuffix("b").isdigit() or not 0 < int(bound.removesuffix("b")) <= ARROW_BYTES:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return df.mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. A local one only where the session names none and runs in one process (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[^,]*(,\d+)?\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = f"file://{tempfile.gettempdir()}/gaplens-checkpoints"
        spark.conf.set("spark.checkpoint.dir", where)
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(where)
    return where


def saved(df: DataFrame) -> DataFrame:
    """Cut lineage: write to the shared folder and read back, so lost executors cost a reread."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gaplens-{uuid.uuid4().hex}"
    df.write.option("compression", "lz4").parquet(path)
    if not _written:
        atexit.register(sweep)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def released(df: DataFrame | None) -> None:
    """Delete a saved table that no later step reads."""
    for path in df.inputFiles()[:1] if df is not None else ():
        folder = path.rsplit("/", 1)[0]
        _delete(df.sparkSession, folder)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def sweep() -> None:
    """Delete all saved tables that are left; call it before the session ends."""
    while _written:
        spark, path = _written.pop()
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may have ended already
            continue


def small(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """Mark for broadcast if the counted rows fit the bound; otherwise leave the shuffle join."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def _contracted(batches):
    """Edges of at most CONTRACT_EDGES at a time, each chunk as links from its nodes to their least connected node."""
    held, n = [], 0
    for batch in batches:
        held.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]))
        n += len(batch)
        if n >= CONTRACT_EDGES:
            yield _forest(np.concatenate(held, axis=1))
            held, n = [], 0
    if n:
        yield _forest(np.concatenate(held, axis=1))


def _forest(ends: np.ndarray) -> pa.RecordBatch:
    nodes, at = np.unique(ends, return_inverse=True)
    a, b = at.reshape(2, -1)
    root = np.arange(len(nodes))
    while (root[a] != root[b]).any():
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root = root[root]
    moved = root != np.arange(len(nodes))
    return pa.record_batch([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], names=["u", "v"])


def _is_settled(edges: DataFrame) -> bool:
    """Whether every node with a lesser one has that one only, and that one has none: one aggregation of the nodes."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("v").alias("n"), F.lit(0).alias("o"), F.lit(1).alias("i"))))
    nodes = edges.select(ends.alias("e")).groupBy("e.n").agg(F.sum("e.o").alias("o"), F.max("e.i").alias("i"))
    return nodes.agg(F.count_if((F.col("o") > 1) | ((F.col("o") == 1) & (F.col("i") == 1)))).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (src long, dst long): rows (node, component), component the least node.

    Each task first contracts its own edges in bounded chunks. Then large-star and small-star
    alternate; each needs a least neighbour (pre-aggregated, so a hot node costs no task) and a
    join. A round's edges are written to the shared folder. Isolated nodes are not listed.
    """
    edges = saved(
        edges.where("src <> dst")
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .mapInArrow(_contracted, "u long, v long")
        .distinct()
    )

    def linked_to_min(both: DataFrame, keep_larger: bool) -> DataFrame:
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = both.join(least, "u")
        if keep_larger:
            out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.selectExpr("u", "m as v"))
        return out.where("u <> v").distinct()

    while not _is_settled(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        fresh = saved(linked_to_min(linked_to_min(both, True), False).mapInArrow(_contracted, "u long, v long"))
        released(edges)
        edges = fresh
    found = edges.selectExpr("u as node", "v as component")
    return found.union(found.selectExpr("component as node", "component")).distinct()

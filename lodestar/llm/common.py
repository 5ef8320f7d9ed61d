"""Scratch tables, distributed components, prefix sums and worker helpers used by the operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of characters other than ASCII white space.
WORD_JAVA = r"[^\x20\x09-\x0D]+"
#: Spark removes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share. Only a local master may fall back to a temporary one."""
    conf = spark.sparkContext.getConf()
    if root := conf.get("spark.checkpoint.dir") or spark.conf.get("lodestar.scratch", None):
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor shares")
    root = "file://" + tempfile.mkdtemp(prefix="lodestar-")
    spark.conf.set("lodestar.scratch", root)
    return root


class Scratch:
    """Tables written to the shared folder: they cut lineage, survive lost executors and can be dropped early."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_root(spark)}/lodestar/{uuid.uuid4().hex}"
        atexit.register(self._clean)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def save(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        """Write df and read it back with the same columns. Shuffles of the write go as soon as it ends."""
        conf, before = self.spark.conf, self.spark.conf.get(CLEANUP, "false")
        conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").option("compression", compression).parquet(self.path(name))
        finally:
            conf.set(CLEANUP, before)
        return self.load(name, df.schema)

    def load(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.base)
            p.getFileSystem(conf).delete(p, True)

    def _clean(self) -> None:
        try:
            if self.spark._jsc is not None and self.spark._jsc.sc() is not None and not self.spark._jsc.sc().isStopped():
                self.drop("")
        except Exception:  # noqa: BLE001  the JVM may be gone when the process ends
            pass


def free(df: DataFrame, name: str) -> str:
    """A column name like _name that df doesn't use; Spark ignores case."""
    used, out = {c.lower() for c in df.columns}, f"_{name}"
    while out.lower() in used:
        out = "_" + out
    return out


def quoted(column: str) -> str:
    """A column's name for F.col, dots and back quotes included."""
    return "`" + column.replace("`", "``") + "`"


def text_batches(spark: SparkSession, rows: int = 400) -> None:
    """Bound what one Arrow batch of whole texts holds in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(6 << 20))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def unsigned_crc(ids: np.ndarray) -> int:
    """crc32 of ids as little-endian unsigned 32-bit integers."""
    import zlib

    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes()) & 0xFFFFFFFF


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


#: Rows of a few numbers each that may be sent to every executor, tens of megabytes at most.
BROADCAST_ROWS = 400_000


def small(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table, marked for broadcast if its count allows it; else joins exchange both sides."""
    return F.broadcast(table) if table.count() <= rows else table


def connected_components(edges: DataFrame, scratch: Scratch, tag: str = "cc") -> DataFrame:
    """(node, component) of every node of edges(a, b); component is the smallest node reachable.

    Rounds of: hook each node to its smallest neighbour, jump pointers, contract the edges.
    Every round is aggregates with map-side combine and joins of two freshly read tables, so that
    adaptive execution can split the edges of a star's centre; only edge counts reach the driver.
    An empty table of edges gives an empty result; loops and repeated edges are harmless.
    """
    cur = scratch.save(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{tag}_e0")
    levels: list[str] = []
    k = 0
    schema_p = None
    while not cur.isEmpty():
        both = cur.select("a", "b").unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up"))
        above = scratch.save(hook, f"{tag}_q{k}")
        schema_p = above.schema
        jump = above.join(above.select(F.col("node").alias("up"), F.col("up").alias("top")), "up", "left")
        parent = scratch.save(jump.select("node", F.coalesce("top", "up").alias("up")), f"{tag}_p{k}")
        levels.append(f"{tag}_p{k}")
        half = cur.join(parent.select(F.col("node").alias("a"), F.col("up").alias("ua")), "a")
        nxt = half.join(parent.select(F.col("node").alias("b"), F.col("up").alias("ub")), "b").where("ua <> ub")
        k += 1
        cur = scratch.save(nxt.select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct(), f"{tag}_e{k}")
        scratch.drop(f"{tag}_e{k - 1}", f"{tag}_q{k - 1}")
    if not levels:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    out = scratch.load(levels[0], schema_p).select("node", F.col("up").alias("component"))
    for i, level in enumerate(levels[1:]):
        above = scratch.load(level, schema_p).select(F.col("node").alias("component"), F.col("up").alias("top"))
        out = scratch.save(out.join(above, "component", "left").select("node", F.coalesce("top", "component").alias("component")), f"{tag}_r{i}")
    return out


def prefix_sums(df: DataFrame, group: str, order: str, value: str, out: str, scratch: Scratch, tag: str, leaf: int = 256) -> DataFrame:
    """Exclusive prefix sum of value within group, in ascending order of a roughly uniform long column.

    The order column's leading digits split each group into ranges of about `leaf` rows, whose totals are
    summed by the same rule one level up; no task ever holds a whole hot group. Equal keys of order need no
    rule here: callers give a total order by hashing the row's identity.
    """
    n = df.count()
    bits = max(0, int(np.ceil(np.log2(max(1, n / leaf)))))
    if bits == 0:
        from pyspark.sql import Window

        w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)))
    from pyspark.sql import Window

    df = df.withColumn("_range", F.shiftrightunsigned(F.col(order).bitwiseXOR(F.lit(-(1 << 63))), 64 - bits))
    totals = df.groupBy(group, "_range").agg(F.sum(value).alias("_total"))
    coarse = max(0, bits - 8)
    totals = totals.withColumn("_coarse", F.shiftright("_range", bits - coarse) if coarse else F.lit(0))
    upper = scratch.save(totals, f"{tag}_totals")
    top = upper.groupBy(group, "_coarse").agg(F.sum("_total").alias("_ct"))
    wt = Window.partitionBy(group).orderBy("_coarse").rowsBetween(Window.unboundedPreceding, -1)
    top = top.withColumn("_cb", F.coalesce(F.sum("_ct").over(wt), F.lit(0))).drop("_ct")
    wm = Window.partitionBy(group, "_coarse").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        upper.withColumn("_in", F.coalesce(F.sum("_total").over(wm), F.lit(0)))
        .join(top, [group, "_coarse"])
        .select(group, "_range", (F.col("_in") + F.col("_cb")).alias("_base"))
    )
    base = scratch.save(base, f"{tag}_base")
    wl = Window.partitionBy(group, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inner = df.withColumn("_local", F.coalesce(F.sum(value).over(wl), F.lit(0)))
    return inner.join(base, [group, "_range"]).withColumn(out, F.col("_local") + F.col("_base")).drop("_range", "_local", "_base")


def words_of(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_JAVA)), F.lit(0)).cast("long")

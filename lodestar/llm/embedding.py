"""Near-duplicate embeddings: sign hashing in several tables, exact cosine, connected components.

Equal vectors are one class. A class falls, in each table, into the bucket of the signs of its products with
random hyperplanes; the number of hyperplanes grows with the logarithm of the classes, so a bucket of unlike
vectors stays small, and the number of tables follows from the recall asked for at the threshold. A bucket is
cut into chunks of bounded size and every pair of chunks is a unit of work: one matrix product in double
precision. A pair is counted in the first table where it meets, so no pair is emitted to remove repeats. A unit
returns sums of links for each class and edges that span its components, no more than its rows.

Defined results: a vector that is null, zero or holds a null or a non-finite component links with nothing;
vectors of unlike length never link; repeated rows of one vec_id count each as a vector; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components, text_batches

COSINE, RECALL, CHUNK, BUCKET, SEED = 0.9, 0.995, 512, 512, 29


def plan_tables(n: int, cosine: float = COSINE, recall: float = RECALL, bucket: int = BUCKET) -> tuple[int, int]:
    """Hyperplanes of a table and tables for n vectors: a pair at the threshold meets with the asked probability."""
    bits = min(30, max(1, math.ceil(math.log2(max(2.0, n / bucket)))))
    meet = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def planes(size: int, bits: int, tables: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng([seed, size]).standard_normal((size, bits * tables))


def signatures(unit: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Bucket of each vector in each table."""
    sign = (unit @ planes(unit.shape[1], bits, tables) > 0).reshape(len(unit), tables, bits)
    return (sign * (1 << np.arange(bits, dtype=np.int64))).sum(2)


def _spanning(near: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a forest with the components of the links between rows and columns of a truth table."""
    kept: list[tuple[int, int]] = []
    row_left, column_left = near.any(1), near.any(0)
    while row_left.any():
        fresh_rows = np.array([int(row_left.argmax())])
        root = int(rows[fresh_rows[0]])
        row_left[fresh_rows] = False
        while len(fresh_rows):
            fresh_columns = np.flatnonzero(near[fresh_rows].any(0) & column_left)
            column_left[fresh_columns] = False
            kept += [(root, x) for x in columns[fresh_columns].tolist()]
            fresh_rows = np.flatnonzero(near[:, fresh_columns].any(1) & row_left)
            row_left[fresh_rows] = False
            kept += [(root, x) for x in rows[fresh_rows].tolist()]
    return [(x, y) for x, y in kept if x != y]


def links(vectors: DataFrame, scratch: Scratch, key: str = "vec_id", column: str = "embedding", cosine: float = COSINE, recall: float = RECALL, chunk: int = CHUNK) -> DataFrame:
    """(key, n_links, component_id) of every row."""
    spark = vectors.sparkSession
    text_batches(spark, 5000)
    raw = F.transform(F.col(column), lambda x: x.cast("double"))
    fit = F.coalesce(F.exists(raw, lambda x: x != 0) & ~F.exists(raw, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
    # Zeros of either sign are equal; NaN and null are out already.
    text = F.array_join(F.transform(raw, lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x).cast("string")), ",")
    rows = scratch.save(vectors.select(F.col(key).alias("id"), F.when(fit, raw).alias("v"), F.when(fit, F.sha2(text, 256)).alias("same")), "vectors")
    classes = rows.where(F.col("same").isNotNull()).groupBy("same").agg(F.min("id").alias("rep"), F.count("*").alias("size"), F.first("v").alias("v"))
    classes = scratch.save(classes, "classes")
    bits, tables = plan_tables(classes.count(), cosine, recall)

    raw_type = np.float32 if dict(vectors.dtypes)[column] == "array<float>" else np.float64

    def normal(values: np.ndarray) -> np.ndarray:
        unit = values.astype(np.float64)
        unit = unit / np.abs(unit).max(1, keepdims=True)
        return unit / np.linalg.norm(unit, axis=1, keepdims=True)

    def hash_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            reps, sizes = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            every = [np.array(x, raw_type) for x in b.column(2).to_pylist()]
            lengths = np.array([len(x) for x in every])
            for width in np.unique(lengths):
                at = np.flatnonzero(lengths == width)
                values = np.stack([every[i] for i in at])
                got = signatures(normal(values), bits, tables).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(reps[at]), pa.array(sizes[at]), pa.array(np.full(len(at), width, np.int32)), pa.array([x.tobytes() for x in values], pa.binary()), pa.array(list(got), pa.list_(pa.int32())), pa.array([x.tobytes() for x in got], pa.binary())],
                    names=["rep", "size", "width", "raw", "mark", "marks"])

    hashed = scratch.save(classes.select("rep", "size", "v").mapInArrow(hash_, "rep long, size long, width int, raw binary, mark array<int>, marks binary"), "hashed")
    # Buckets of more than one class, and the chunks each is cut into.
    counted = hashed.select("width", F.posexplode("mark").alias("table", "bucket")).groupBy("table", "width", "bucket").agg(F.count("*").alias("n")).where("n > 1")
    counted = scratch.save(counted.withColumn("chunks", F.ceil(F.col("n") / F.lit(float(chunk))).cast("int")), "buckets")
    spread = hashed.select("rep", "size", "width", "raw", "marks", F.posexplode("mark").alias("table", "bucket")).join(counted, ["table", "width", "bucket"])
    spread = spread.withColumn("mine", F.pmod(F.xxhash64("rep", F.lit("chunk")), F.col("chunks")).cast("int"))
    unitwork = spread.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    # Small buckets share a task's group, so a group is worth the call; a cut bucket's chunk pairs stand alone.
    lone = F.when(F.col("chunks") == 1, F.pmod(F.xxhash64("bucket", "width"), F.lit(max(1, (1 << bits) // 16)))).otherwise(F.xxhash64("bucket", "width"))
    unitwork = unitwork.select("table", lone.alias("cell"), F.least("mine", "with").alias("i"), F.greatest("mine", "with").alias("j"), "mine", "bucket", "width", "rep", "size", "raw", "marks")

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        out: dict[int, int] = {}
        edges: list[tuple[int, int]] = []
        table, i, j = int(g["table"].iloc[0]), int(g["i"].iloc[0]), int(g["j"].iloc[0])
        for (_, width), part in g.groupby(["bucket", "width"], sort=False):
            part = part.sort_values("rep", kind="stable")
            a = part if i == j else part[part["mine"] == i]
            b = part if i == j else part[part["mine"] == j]
            if not len(a) or not len(b):
                continue
            ua, ub = (normal(np.frombuffer(b"".join(x["raw"]), raw_type).reshape(-1, int(width))) for x in (a, b))
            near = ua @ ub.T >= cosine
            if i == j:
                near = np.triu(near, 1)
            if table and near.any():
                ma, mb = (np.frombuffer(b"".join(x["marks"]), np.int32).reshape(-1, tables) for x in (a, b))
                for t in range(table):
                    near &= ma[:, t, None] != mb[None, :, t]
            if not near.any():
                continue
            ra, rb, sa, sb = a["rep"].to_numpy(), b["rep"].to_numpy(), a["size"].to_numpy(), b["size"].to_numpy()
            for ids, n in ((ra, near @ sb), (rb, sa @ near)):
                for r, x in zip(ids[n > 0].tolist(), n[n > 0].tolist()):
                    out[r] = out.get(r, 0) + x
            edges += _spanning(near, ra, rb)
        got = [(r, None, n) for r, n in out.items()] + [(x, y, 0) for x, y in edges]
        return pd.DataFrame(got, columns=["a", "b", "n"]).astype({"a": "int64", "b": "Int64", "n": "int64"})

    found = scratch.save(unitwork.groupBy("table", "cell", "i", "j").applyInPandas(compare, "a long, b long, n long"), "found")
    component = connected_components(found.where("b is not null").select("a", "b"), scratch, "embed")
    sums = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    facts = classes.select("same", "rep", "size").join(sums.withColumnRenamed("a", "rep"), "rep", "left").join(component.withColumnRenamed("node", "rep"), "rep", "left")
    facts = scratch.save(facts.select("same", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "facts")
    return rows.select("id", "same").join(facts, "same", "left").select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))


def op5_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return links(vectors, Scratch(spark)).withColumn("kept", F.col("vec_id") == F.col("component_id"))

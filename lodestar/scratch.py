"""Tables written to the folder all executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN = "lodestar.rounds"
#: Spark removes the shuffle files of a query when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local master without one gets a temporary folder."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(_OWN, None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor shares")
        folder = "file://" + tempfile.mkdtemp(prefix="lodestar-")
        spark.conf.set(_OWN, folder)
    return folder


class Rounds:
    """Tables of an iterative job by name; what a later round no longer needs can be dropped early."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/rounds-{uuid.uuid4().hex}"
        atexit.register(self._end)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """df, written and read again. Shuffles of the write go as soon as it ends."""
        conf, before = self.spark.conf, self.spark.conf.get(_CLEANUP, "false")
        conf.set(_CLEANUP, "true")
        try:
            df.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        finally:
            conf.set(_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        conf = self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
            path.getFileSystem(conf).delete(path, True)

    def _end(self) -> None:
        try:
            if self.spark._jsc is not None and not self.spark._jsc.sc().isStopped():
                self.drop("")
        except Exception:  # noqa: BLE001  the JVM may be gone when the process ends
            pass

"""Tables that cut lineage between rounds, in the shared folder that the session names."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Workspace:
    def __init__(self, spark: SparkSession, name: str):
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            root = f"file://{tempfile.mkdtemp(prefix='attestor-')}"
            spark.sparkContext.setCheckpointDir(root)
        self.spark, self.path, self.tables = spark, f"{root.rstrip('/')}/attestor/{name}-{uuid.uuid4().hex}", 0
        atexit.register(self.drop)

    def keep(self, df: DataFrame) -> DataFrame:
        self.tables += 1
        path = f"{self.path}/{self.tables}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        try:
            sc = self.spark.sparkContext
            target = sc._jvm.org.apache.hadoop.fs.Path(self.path)
            target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session has ended
            return

"""Written tables between the steps of an iterative query, in the folder that all machines share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class Steps:
    """Tables of one query. A step's plan reads files, not the steps before it; what is no longer read is deleted."""

    def __init__(self, spark: SparkSession):
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
            at = spark.conf.get("spark.sql.warehouse.dir")
        self.spark, self.top, self.tables, self.n = spark, f"{at.rstrip('/')}/steps/{uuid.uuid4().hex}", [], 0

    def write(self, df: DataFrame) -> str:
        """The path of df, written."""
        self.n += 1
        df.write.parquet(at := f"{self.top}/{self.n}")
        self.tables.append(at)
        return at

    def read(self, *paths: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(*paths)

    def put(self, df: DataFrame) -> DataFrame:
        return self.read(self.write(df), like=df)

    def keep(self, *paths: str) -> None:
        """Deletes all tables but these."""
        jvm = self.spark.sparkContext._jvm
        for at in [t for t in self.tables if t not in paths]:
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            self.tables.remove(at)

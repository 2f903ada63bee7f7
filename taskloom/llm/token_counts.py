"""Token counts as rollups kept up by deltas.

A batch is a table of signed rows: inserts count plus, deletes minus, a revision both. It is summed by source, language
and tokenizer version, written under its id, and then entered in a ledger. Totals are the sums over the batches in the
ledger, each once: a batch that comes again, or whose writer was lost half-way, changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "version"]
DELTA = "source string, lang string, version string, n_docs bigint, n_tokens bigint"


def words(text: Column) -> Column:
    """Runs without white space (20, 09-0D); a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def pieces(text: Column) -> Column:
    """Runs of letters or digits, and each other character but white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]")), F.lit(0)).cast("long")


def signed(docs: DataFrame, version: str, tokens: Column, sign: int = 1) -> DataFrame:
    """Rows of one batch: each document's tokens with a sign. Null sources and languages are groups of their own, null texts
    have no tokens, very long ones are counted whole. Rows that repeat count each. No rows give no rows. Other columns are ignored."""
    return docs.select("source", "lang", F.lit(version).alias("version"), F.lit(sign).cast("long").alias("n_docs"), (F.lit(sign) * tokens).cast("long").alias("n_tokens"))


class Rollup:
    """Totals at `path`, a folder that all machines share. An empty batch is entered like any other; nothing written has no totals."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, what: str, schema: str) -> DataFrame:
        """No rows where nothing has been written yet; anything else that is wrong is an error."""
        at = f"{self.path}/{what}"
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(at)

    def committed(self) -> DataFrame:
        return self._read("ledger", "batch string, attempt string").groupBy("batch").agg(F.min("attempt").alias("attempt"))

    def commit(self, batch: str, rows: DataFrame) -> bool:
        """Adds a batch once; False if it was there. Sums first by task, so that no key gathers a batch's rows."""
        if not self.committed().where(F.col("batch") == batch).isEmpty():
            return False
        attempt = f"{batch}-{self.spark.sparkContext.applicationId}"
        summed = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        summed.withColumn("batch", F.lit(batch)).withColumn("attempt", F.lit(attempt)).write.mode("overwrite").parquet(f"{self.path}/deltas/{attempt}")
        one = self.spark.range(1).select(F.lit(batch).alias("batch"), F.lit(attempt).alias("attempt"))
        one.write.mode("overwrite").parquet(f"{self.path}/ledger/{attempt}")
        return True

    def sink(self, name: str):
        """For foreachBatch of a stream of signed rows."""
        return lambda rows, epoch: self.commit(f"{name}-{epoch}", rows) and None

    def totals(self) -> DataFrame:
        """source, lang, version, n_docs, n_tokens of what is left; groups at zero go."""
        deltas = self._read("deltas", f"{DELTA}, batch string, attempt string")
        left = deltas.join(self.committed(), ["batch", "attempt"], "left_semi")
        return left.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")

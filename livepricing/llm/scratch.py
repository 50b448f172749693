"""Written intermediate tables in the shared checkpoint folder.

A step that several later steps read is written once (lineage is cut, a lost executor costs
only the files it was writing) and dropped again as soon as no later step needs it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


def row_key() -> Column:
    """Names a row of documents by its id and text; equal rows share it, and nulls are values."""
    return F.xxhash64("doc_id", "text")


class Scratch:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, str] = {}

    def stage(self, df: DataFrame, name: str, by: tuple[str, ...] = (), compression: str = "snappy") -> DataFrame:
        path = scratch_path(self.spark, name)
        df.write.option("compression", compression).partitionBy(*by).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete staged tables that nothing reads any more, and let Spark's cleaner see that
        the shuffles behind them are garbage."""
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in frames:
            p = jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(df)))
            p.getFileSystem(conf).delete(p, True)
        jvm.System.gc()

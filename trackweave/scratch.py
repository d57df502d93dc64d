"""Tables written to the folder that the driver and the executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OPEN: dict[str, "Scratch"] = {}


class Scratch:
    """Writes a table and reads it again.

    The folder is ``spark.checkpoint.dir`` of the session; only where that is unset and
    all runs on one machine (tests) a temporary folder stands in, a cluster without it is
    an error.  A written table
    cuts the lineage and survives the loss of any executor.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir is not set: scratch tables need a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="trackweave-")
        self.root = f"{base.rstrip('/')}/trackweave-{uuid.uuid4().hex}"
        atexit.register(self._clear)

    def write(self, df: DataFrame, tag: str) -> DataFrame:
        path = f"{self.root}/{tag}-{uuid.uuid4().hex[:12]}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for table in tables:
            if path := getattr(table, "_scratch_path", None):
                self._delete(path)

    def _delete(self, path: str) -> None:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def _clear(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session may have ended before the interpreter
            pass


def scratch(spark: SparkSession) -> Scratch:
    """The scratch folder of this application."""
    app = spark.sparkContext.applicationId
    if app not in _OPEN:
        _OPEN[app] = Scratch(spark)
    return _OPEN[app]


def numbered(rows: DataFrame, by: list[str], column: str, after: int = -1) -> DataFrame:
    """``rows`` with their place in the order of ``by``, from ``after`` + 1 on.

    Rows are dealt out by ranges and written; counts of the ranges give each its offset, so
    no task sees all rows.
    """
    store = scratch(rows.sparkSession)
    dealt = store.write(rows.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = dealt.groupBy("_range").count().select(F.col("_range").alias("_of"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_range").orderBy(*by)
    placed = dealt.withColumn("_place", F.row_number().over(within)).join(F.broadcast(offsets), F.col("_range") == F.col("_of"))
    return placed.select(*rows.columns, (F.col("_offset") + F.col("_place") + after).cast("long").alias(column))

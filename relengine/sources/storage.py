"""Tables of materialised tuples, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` as a whole URI; a folder of our own where that is unset and all runs on this machine, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="relengine-")
        named = _own[app]
    path = spark._jvm.org.apache.hadoop.fs.Path(named)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


class Store:
    """Writes DataFrames as Parquet in the shared folder and reads them back, which cuts their lineage and outlives executors.

    The tables go when the application ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root, self.n = f"{shared_folder(spark)}/relengine-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        if not self.n:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
            fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
            fs.mkdirs(path)
            fs.deleteOnExit(path)
        self.n += 1
        path = f"{self.root}/{self.n:06d}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def is_small(self, df: DataFrame, of_pure: bool = False) -> bool:
        """Whether Spark holds a DataFrame for small enough to broadcast; with ``of_pure``, only if reading it twice gives the same."""
        plan = df._jdf.queryExecution().optimizedPlan()
        most = self.spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
        return int(str(plan.stats().sizeInBytes())) <= most and (not of_pure or plan.deterministic())

    def is_empty(self, table: DataFrame) -> bool:
        """Whether a table that was kept has no rows, by the counts that its files end with, which takes no job."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in table.inputFiles():
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
            reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(path, conf))
            try:
                if reader.getRecordCount():
                    return False
            finally:
                reader.close()
        return True

"""Written tables that cut lineage, in the folder all executors share.

The folder is the session's ``spark.checkpoint.dir``. Where that setting is absent, a local session (tests, notebooks)
uses a temporary folder of this machine and a cluster's is refused. A written table is read back from shared storage, so losing an executor
afterwards repeats no earlier work.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="priorframe-")
    return _LOCAL[app]


class Scratch:
    """A folder of written tables for one run of one operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        target = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(target)
        return self.spark.read.schema(df.schema).parquet(target)

    def _drop(self, wanted: Callable[[str], bool]) -> None:
        spark = self.spark
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        for table in fs.listStatus(folder) if fs.exists(folder) else []:
            if wanted(table.getPath().getName()):
                fs.delete(table.getPath(), True)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more; a later read of one fails."""
        self._drop(lambda name: name in names)

    def keep(self, *names: str) -> None:
        """Delete all tables but these."""
        self._drop(lambda name: name not in names)

    def parts(self) -> int:
        return int(self.spark.conf.get("spark.sql.shuffle.partitions"))

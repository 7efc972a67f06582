"""Tables in the shared folder of a cluster, which cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Shuffle files of an execution go when it ends; what it wrote is all that is read later.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that a Python worker gets at a time, and how many of those that hold whole texts: Spark's 10,000 are tens of MB, several times over on both sides.
BATCH, TEXTS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000

_made: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset on one machine (tests), a temporary one that is then set. A cluster must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = "file://" + tempfile.mkdtemp(prefix="cadenza-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session may have ended; scratch files then stay for the folder's owner
        pass


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        if spark._jsc is not None and spark.sparkContext._jsc is not None:
            _delete(spark, path)


class Scratch:
    """Tables of one run of an operator, under the shared folder.

    ``keep`` writes a frame as Parquet and returns it reread, which cuts its lineage: a lost executor
    costs a read of files, not a new run of what came before. ``drop`` deletes a table that no later
    step reads. What remains is deleted when the driver ends.
    """

    def __init__(self, spark: SparkSession, operator: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/cadenza-{operator}-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}
        _made.append((spark, self.root))

    def keep(self, df: DataFrame, name: str, narrow: bool = False, texts: bool = False) -> DataFrame:
        """Write and reread. A narrow table, of a few numbers a row, is written by an eighth of the shuffle partitions: they are sized for texts.

        ``texts``: Python workers read whole texts for it, ``TEXTS`` rows at a time or what the session has if that is fewer.
        """
        path = self.paths[name] = f"{self.root}/{name}"
        if narrow:
            df = df.coalesce(max(4, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // 8))
        during = {CLEANUP: "true"}
        if texts and not 0 < int(self.spark.conf.get(BATCH)) < TEXTS:
            during[BATCH] = str(TEXTS)
        before = {CLEANUP: self.spark.conf.get(CLEANUP, "false"), BATCH: self.spark.conf.get(BATCH)}
        try:
            for k, v in during.items():
                self.spark.conf.set(k, v)
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        finally:
            for k in during:
                self.spark.conf.set(k, before[k])
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        _delete(self.spark, self.paths.pop(name))

"""Tables cut from the lineage, written where every executor can read them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A written table replaces its query's shuffle files; smaller Arrow batches of whole texts keep Python workers and buffers small.
_WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}
#: Bytes of a file that a join may broadcast by itself in a Scratch that is ``bounded``: a written table is judged by its compressed files, which hold
#: ids and counts in a tenth of the memory that their rows take on the driver, and several such tables are there at once.
SMALL = 256 << 10
_THRESHOLDS = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: spark.checkpoint.dir, or a folder of our own where it is unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Written tables of one operator run; ``drop`` frees those that later rounds replaced. ``bounded``: joins of what is written send
    no table through the driver but SMALL ones, whatever Spark's threshold."""

    def __init__(self, spark: SparkSession, name: str, bounded: bool = False):
        self.spark = spark
        self.settings = dict.fromkeys(_THRESHOLDS, str(min(SMALL, spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()))) if bounded else {}
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def write(self, df: DataFrame, name: str) -> tuple[DataFrame, str]:
        at = self.path(name)
        self.save(df, at, settings=self.settings)
        return self.spark.read.schema(df.schema).parquet(at), at

    @staticmethod
    def save(df: DataFrame, at: str, *by: str, settings: dict[str, str] | None = None) -> None:
        """Writes ``df`` with the settings of working tables and ``settings``, in folders by the columns ``by``."""
        conf, settings = df.sparkSession.conf, _WHILE_WRITING | (settings or {})
        before = {k: conf.get(k, None) for k in settings}
        for k, v in settings.items():
            conf.set(k, v)
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(at, partitionBy=list(by) or None)
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)

    def drop(self, *tables: str | None) -> None:
        for at in tables:
            if at is not None:
                self._delete(at)

    def _delete(self, at: str) -> None:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(at)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

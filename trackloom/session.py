"""Reading tables, and cutting lineage through tables written to the shared folder."""

from __future__ import annotations

import atexit
import sys
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One table of a data directory, lazily; Catalyst prunes and pushes down."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir, or the folder set by setCheckpointDir. Without either a cluster fails; a local session takes a folder beside its own tables (spark.sql.warehouse.dir)."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and context._jsc.sc().getCheckpointDir().isDefined():
        folder = context._jsc.sc().getCheckpointDir().get()
    if folder is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-shared"
    return folder.rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage; they survive the loss of any executor.

    A table that a later one replaces goes at once (``drop``), the rest when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def _delete(self, path: str) -> None:
        context = self.spark.sparkContext
        if context._jsc is None or context._jsc.sc().isStopped():  # the session has ended; the cluster empties its own folder
            return
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        try:
            target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
        except Exception as e:  # a table left behind costs room, not results
            print(f"could not delete {path}: {e}", file=sys.stderr)

    def cut(self, df: DataFrame) -> DataFrame:
        """``df`` written and read again. ``_scratch_rows``: its number of rows, counted as they were written."""
        path, seen = f"{self.root}/{uuid.uuid4().hex}", Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._scratch_path, back._scratch_rows = path, seen.get["rows"]
        return back

    def drop(self, df: DataFrame | None) -> None:
        path = getattr(df, "_scratch_path", None)
        if path:
            self._delete(path)

    def close(self) -> None:
        """Deletes all tables: only when what was made of them is written itself."""
        self._delete(self.root)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.close()

"""Tables written to the folder that driver and executors share, to cut the lineage of iterative plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; only a local session (tests) may do without, and gets one that is then named there."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="ledgerline-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Folders that this process has made, by application.
_made: dict[str, list[str]] = {}


def new_folder(spark: SparkSession) -> str:
    """A path in the shared folder that nothing else uses; clear() removes it."""
    path = f"{shared_path(spark)}/ledgerline-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read back."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Remove the folders made in this application so far, and say how many; DataFrames that still read them can't be used any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    done = _made.pop(spark.sparkContext.applicationId, [])
    for folder in done:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
    return len(done)

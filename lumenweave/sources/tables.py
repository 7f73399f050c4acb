"""Tables written to the folder that the cluster shares, to cut a plan where it should be cut."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession) -> str:
    """A path of its own under spark.checkpoint.dir; only where a local session names none, as in tests, under a temporary folder."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='lumenweave-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{_application_folder(root.rstrip('/'), spark.sparkContext.applicationId)}/{uuid.uuid4().hex}"


@lru_cache(8)
def _application_folder(root: str, application: str) -> str:
    """The application's own folder, which goes when its JVM ends in order, whether or not the session was stopped before."""
    spark = SparkSession.getActiveSession()
    path = f"{root}/lw-{application}-{uuid.uuid4().hex[:8]}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    files.deleteOnExit(folder)
    return path


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in a new folder, so that a plan ends here and a lost executor costs no lineage."""
    spark, path = df.sparkSession, new_folder(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name

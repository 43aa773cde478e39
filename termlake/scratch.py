"""Tables in the shared folder of the session, which end a lineage so that lost executors cost no earlier work."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    """A folder of this application below spark.checkpoint.dir, deleted when it ends; only a local master may do without that setting."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            shared = "file://" + (own := tempfile.mkdtemp(prefix="termlake-"))
            atexit.register(shutil.rmtree, own, ignore_errors=True)
        _roots[app] = f"{shared.rstrip('/')}/termlake-steps/{app}"
        place, store = hadoop(spark, _roots[app])
        store.mkdirs(place)
        store.deleteOnExit(place)
    return _roots[app]


def stage(df: DataFrame, name: str) -> DataFrame:
    path = f"{root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hadoop(spark: SparkSession, path: str):
    """(path, its file system) as the session's JVM has them."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

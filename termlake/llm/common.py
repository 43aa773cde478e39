"""What the operators share: scratch tables, folds by checksum, and shipping code to executors."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts define it, as a Java and Python character class.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Keys that more than one row in so many has are hot: there are so many at most, so they may be broadcast.
HOT = 1000

_owner = ""
_written: dict[str, list[str]] = {}
_own_dirs: dict[str, str] = {}


def ship(name: str) -> None:
    """Functions of module `name` travel to executors by value, so executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


ship(__name__)


def scratch_root(spark: SparkSession) -> str:
    """A folder of this application in the shared folder of the session, deleted when the application ends. Only a local
    master may do without a shared folder and gets a temporary one."""
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = "file://" + (own := tempfile.mkdtemp(prefix="termlake-"))
            atexit.register(shutil.rmtree, own, ignore_errors=True)
        _own_dirs[app] = f"{root.rstrip('/')}/termlake/{app}"
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_dirs[app])
        store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        store.mkdirs(place)
        store.deleteOnExit(place)
    return _own_dirs[app]


def scratch_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new path in the application's folder. It is removed with that folder, and before that by release(), unless it is kept."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    if not keep:
        _written.setdefault(_owner, []).append(path)
    return path


@contextlib.contextmanager
def owned(owner: str) -> Iterator[None]:
    """Scratch tables that are made inside belong to `owner`."""
    global _owner
    before, _owner = _owner, owner
    try:
        yield
    finally:
        _owner = before


def stage_table(df: DataFrame, name: str, partition_by: list[str] | None = None, **options: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: the lineage ends there, and lost executors lose nothing."""
    path = scratch_path(df.sparkSession, name)
    writer = df.write.options(**({"compression": "zstd"} | options))
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed_table(df: DataFrame, name: str, key: str) -> DataFrame:
    """As stage_table, in buckets of key, as many as the session has shuffle partitions: grouping by key shuffles it no more."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = f"{name}_{path.rpartition('-')[2]}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.options(path=path, compression="zstd").bucketBy(n, key).saveAsTable(table)
    read = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the name only: the files are outside the warehouse, and `read` is resolved
    return read


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let the session hand at most so many rows at a time to Python: whole texts make wide rows, and a batch is in memory
    several times. A smaller setting of the session's own stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work for mapInArrow, whose worker gives its free memory back to the system at the end of each task: workers
    stay for later tasks, and what they hold meanwhile is not the executor's to use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        _give_back()

    return run


def lean_table(work: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """lean() for applyInArrow."""

    def run(table: pa.Table) -> pa.Table:
        out = work(table)
        _give_back()
        return out

    return run


def lean_pair(work: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """lean() for applyInArrow of cogroups."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = work(left, right)
        _give_back()
        return out

    return run


def _give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def release(spark: SparkSession, owner: str = "") -> None:
    """Delete the scratch tables of `owner` so far; for owners that have stored every result that reads them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in _written.pop(owner, []):
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)


def join_counted(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows joined with the stored table (key, n, ...), one row a key, n being the rows of that key. Hot keys, HOT at most,
    are broadcast, so no task gets all rows of one; the others are shuffled."""
    total = table.agg(F.sum("n").alias("total"))
    hot = table.crossJoin(F.broadcast(total)).where(F.col("n") * HOT > F.col("total")).drop("total")
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table, key)
    return cold.unionByName(rows.join(F.broadcast(hot), key))


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of doc_id as text, modulo parts; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts


def rows_of(df: DataFrame, **columns: Column) -> DataFrame:
    """Just these columns: whatever else df has, clashing names included, stays behind."""
    return df.select(*(column.alias(name) for name, column in columns.items()))


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores behind it as make it differ from all taken ones."""
    known, out = {x.lower() for x in taken}, []
    for name in names:
        while name in known:
            name += "_"
        out.append(name)
    return out

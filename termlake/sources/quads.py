"""Quads as a table: N-Quads in and out, digests, tables by version."""

from __future__ import annotations

import hashlib
import re
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termlake.scratch import hadoop
from termlake.sources.turtle import SCHEMA
from termlake.tasks import ship

ship(__name__)

#: Bytes of lines that are hashed at a time.
CHUNK = 1 << 20

QUAD = r'^(\S+)\s+(\S+)\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)\s*(<[^>]*>|_:\S+)?\s*\.\s*$'


def read_nquads(spark: SparkSession, path: str) -> DataFrame:
    """(subject, predicate, object, graph, lang, datatype) of N-Quads lines; blank lines and comments are skipped, a line that is
    no quad raises. A path where nothing is gives an empty table."""
    place, store = hadoop(spark, path)
    if not store.globStatus(place):
        return spark.createDataFrame([], SCHEMA)
    lines = spark.read.text(path).where("trim(value) <> '' and value not like '#%'")
    part = lambda i: F.regexp_extract("value", QUAD, i)
    checked = lines.where(F.when(F.col("value").rlike(QUAD), True).otherwise(F.raise_error(F.concat(F.lit("not a quad: "), "value")).cast("boolean")))
    return checked.select(part(1).alias("subject"), part(2).alias("predicate"), part(3).alias("object"), F.nullif(F.regexp_replace(part(4), "^<|>$", ""), F.lit("")).alias("graph"), F.nullif(F.regexp_extract("value", r'"@([A-Za-z0-9-]+)', 1), F.lit("")).alias("lang"), F.nullif(F.regexp_extract("value", r'"\^\^<([^>]*)>', 1), F.lit("")).alias("datatype"))


def quad_lines(quads: DataFrame) -> DataFrame:
    """Lines of N-Quads; a graph's name stands in the table without the brackets that it has in a line."""
    graph = F.when(F.col("graph").startswith("_:"), F.col("graph")).otherwise(F.concat(F.lit("<"), "graph", F.lit(">")))
    return quads.select(F.concat_ws(" ", "subject", "predicate", "object", graph, F.lit(".")).alias("line")).distinct()


def write_nquads(quads: DataFrame, path: str) -> None:
    """Sorted distinct lines; the files in order are the same bytes for the same quads."""
    quad_lines(quads).orderBy("line").write.text(path)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number, held, size = TaskContext.get().partitionId(), 0, [], 0
    row = lambda: pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "number": pa.array([number], pa.int64()), "lines": pa.array([b"".join(held)], pa.binary())})
    for batch in batches:
        for line in batch.column(0).to_pylist():
            held.append(line.encode() + b"\n")
            size += len(held[-1])
            if size >= CHUNK:
                yield row()
                number, held, size = number + 1, [], 0
    if held:
        yield row()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    whole = hashlib.sha256()
    for batch in batches:
        for lines in batch.column(0):
            whole.update(lines.as_py())
    yield pa.RecordBatch.from_pydict({"digest": [whole.hexdigest()]})


def digest(quads: DataFrame) -> str:
    """sha256 of the bytes that write_nquads() would write: distinct lines in order, each with its break.

    Ranges of lines are sorted and joined to chunks in many tasks. A hash of bytes in order is one sequence, so one task takes the
    chunks in their order, one in memory at a time; the driver gets the digest alone. An empty table has the digest of no bytes.
    """
    chunks = quad_lines(quads).orderBy("line").mapInArrow(_chunks, "part int, number bigint, lines binary")
    ordered = chunks.repartition(1).sortWithinPartitions("part", "number").select("lines")
    rows = ordered.mapInArrow(_hashed, "digest string").collect()
    return rows[0]["digest"] if rows else hashlib.sha256().hexdigest()


class VersionConflict(Exception):
    """Another writer published the version first."""


def current_version(spark: SparkSession, path: str) -> int:
    """The newest version below path, 0 if there is none."""
    place, store = hadoop(spark, f"{path}/versions/v*")
    return max((int(x.getPath().getName()[1:]) for x in store.globStatus(place) or []), default=0)


def version_path(spark: SparkSession, path: str, version: int) -> str:
    """The folder that holds a version: what its pointer says."""
    place, store = hadoop(spark, f"{path}/versions/v{version}")
    stream = store.open(place)
    try:
        return f"{path}/data/{bytes(stream.readAllBytes()).decode()}"
    finally:
        stream.close()


def publish(table: DataFrame, path: str, expected: int) -> int:
    """Write version expected + 1, or raise VersionConflict if it exists.

    The data go to a folder of their own; then a pointer is renamed into place, which fails if another writer's is there. So a
    version exists as a whole or not at all, and a writer that dies leaves only a folder that nothing points to.
    """
    spark = table.sparkSession
    name = uuid.uuid4().hex
    if current_version(spark, path) != expected:
        raise VersionConflict(str(expected + 1))
    table.write.parquet(f"{path}/data/{name}")
    return point(spark, path, expected, name)


def point(spark: SparkSession, path: str, expected: int, name: str) -> int:
    """Make data/name, which is written already, version expected + 1; if that exists, remove the data and raise VersionConflict."""
    jvm = spark.sparkContext._jvm
    pointer, store = hadoop(spark, f"{path}/versions/v{expected + 1}")
    waiting = jvm.org.apache.hadoop.fs.Path(f"{path}/waiting/{name}")
    out = store.create(waiting, False)
    out.write(name.encode())
    out.close()
    store.mkdirs(pointer.getParent())
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(pointer.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(waiting, pointer, none)
    except Exception as error:
        if store.exists(pointer):
            for orphan in (waiting, jvm.org.apache.hadoop.fs.Path(f"{path}/data/{name}")):
                store.delete(orphan, True)
            raise VersionConflict(str(expected + 1)) from error
        raise
    return expected + 1


class Cached:
    """A table that is loaded again when it is older than `ttl` seconds, or forgotten."""

    def __init__(self, load: Callable[[], DataFrame], ttl: float = 30.0, clock: Callable[[], float] = time.monotonic) -> None:
        self.load, self.ttl, self.clock = load, ttl, clock
        self.held: DataFrame | None = None
        self.at = 0.0

    def get(self) -> DataFrame:
        if self.held is None or self.clock() - self.at >= self.ttl:
            self.forget()
            self.held, self.at = self.load().cache(), self.clock()
        return self.held

    def forget(self) -> None:
        if self.held is not None:
            self.held.unpersist()
            self.held = None


class SeedRefused(Exception):
    """A seed over a store that holds more than the published graph."""


def seed(stored: DataFrame, fresh: DataFrame, force: bool = False) -> DataFrame:
    """stored with `fresh` as its published graph; every other graph stays. With facts or history there it is refused unless forced."""
    others = stored.where(~F.col("graph").eqNullSafe("published"))
    if not force and not others.isEmpty():
        raise SeedRefused("the store holds facts or history: seeding it again needs force")
    return others.unionByName(fresh.withColumn("graph", F.lit("published"))).distinct()


def matching(quads: DataFrame, **bound: str) -> DataFrame:
    """Quads whose columns have the values given; any subset may be bound, and filters reach the scan."""
    for name, value in bound.items():
        quads = quads.where(F.col(name) == value)
    return quads


def bind(query: str, **terms: object) -> tuple[str, dict[str, object]]:
    """A query and its arguments for spark.sql(), checked: every :name is given and every name given is used; values are text,
    numbers, truth values or Column literals of addresses, never parts of the query."""
    asked = set(re.findall(r"(?<!:):([a-z_]\w*)", re.sub(r"'(?:[^']|'')*'", "''", query)))
    if asked != set(terms):
        raise ValueError(f"not given: {sorted(asked - set(terms))}; not used: {sorted(set(terms) - asked)}")
    if wrong := [name for name, value in terms.items() if not isinstance(value, (str, int, float, bool))]:
        raise ValueError(f"neither text nor number: {wrong}")
    return query, terms


def records(rows: DataFrame) -> DataFrame:
    """Columns of terms as their lexical values: languages and datatypes dropped, addresses without their brackets."""
    return rows.select(*(lexical(F.col(name)).alias(name) for name in rows.columns))


def lexical(term):
    """The text of a literal, its escapes undone, or the address of an IRI."""
    inner = F.regexp_extract(term, r'(?s)^"((?:[^"\\]|\\.)*)"', 1)
    for escaped, plain in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t")):
        inner = F.regexp_replace(inner, r"(?<!\\)((?:\\\\)*)" + "\\" + escaped, "$1" + plain)
    return F.when(term.startswith('"'), F.regexp_replace(inner, r'\\(["\\])', "$1")).otherwise(F.regexp_replace(term, "^<|>$", ""))


def archive(quads: DataFrame, concept: str, history: str) -> DataFrame:
    """quads with all of a published concept moved to its history graph."""
    mine = (F.col("subject") == concept) & (F.col("graph") == "published")
    return quads.withColumn("graph", F.when(mine, history).otherwise(F.col("graph")))

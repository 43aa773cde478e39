"""Vectors of chunks by key: written, deleted, searched behind a filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termlake.operators.claims import upsert
from termlake.operators.resolution import dot

TOP = 5
SNIPPET = 1000
#: Parts that the vectors of one concept are dealt into, so that a concept of a third of all chunks is many tasks' work.
PARTS = 32


def chunk_vectors(chunks: DataFrame, vector: Column) -> DataFrame:
    """(key, source_file, doc_type, doc_version, line_range, snippet, concepts, vector) of chunks (source_file, doc_type, doc_version,
    start_line, end_line, text, concepts): keys name file and lines, snippets have SNIPPET characters, no concepts are an empty array."""
    lines = F.concat_ws("-", F.col("start_line").cast("string"), F.col("end_line").cast("string"))
    concepts = F.array_sort(F.array_distinct(F.coalesce("concepts", F.array().cast("array<string>"))))
    return chunks.select(F.concat_ws("#", "source_file", lines).alias("key"), "source_file", "doc_type", "doc_version", lines.alias("line_range"), F.substring("text", 1, SNIPPET).alias("snippet"), concepts.alias("concepts"), vector.alias("vector"))


def put(stored: DataFrame, new: DataFrame) -> DataFrame:
    """stored with the rows of new in place of those with equal keys."""
    return upsert(stored, new, ["key"], ["source_file", "line_range"])


def delete(stored: DataFrame, keys: DataFrame) -> DataFrame:
    """stored without the keys (key); keys that are not there are ignored."""
    return stored.join(keys.select("key").distinct(), "key", "left_anti")


def matching(concepts: list[str] | None = None, source_file: str | None = None) -> Column | None:
    """A filter on any of the concepts and on the file; None where nothing narrows, which is no filter and not an empty one."""
    clauses = []
    if concepts:
        clauses.append(F.arrays_overlap("concepts", F.array(*map(F.lit, concepts))))
    if source_file:
        clauses.append(F.col("source_file") == source_file)
    return None if not clauses else clauses[0] if len(clauses) == 1 else clauses[0] & clauses[1]


def nearest(stored: DataFrame, vector: list[float], k: int = TOP, where: Column | None = None) -> DataFrame:
    """The k rows nearest to one vector by 1 - dot product, ties by key: a top-k that no task sorts in whole."""
    rows = stored if where is None else stored.where(where)
    return rows.withColumn("distance", F.round(1 - dot(F.col("vector"), F.array(*map(F.lit, vector))), 6)).orderBy("distance", "key").limit(k)


def nearest_filtered(asked: DataFrame, rows: DataFrame, k: int = TOP, parts: int = PARTS) -> DataFrame:
    """(query_id, rank, key, distance) for asked (query_id, vector, concepts), a stated set of queries: the k nearest of rows (key, vector,
    concepts) that share a concept with the query, itself apart.

    Rows and queries meet by concept and part: a concept's rows are dealt into parts and its queries go to each. Each part keeps its k
    best, then the best of all parts and concepts are merged.
    """
    have = rows.select("key", "vector", F.explode(F.array_distinct("concepts")).alias("concept")).withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int"))
    want = asked.select("query_id", F.col("vector").alias("q"), F.explode(F.array_distinct("concepts")).alias("concept")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    met = want.join(have, ["concept", "part"]).where(F.col("query_id") != F.col("key"))
    scored = met.select("query_id", "part", "concept", "key", F.round(1 - dot(F.col("q"), F.col("vector")), 6).alias("distance"))
    best = F.row_number().over(Window.partitionBy("query_id", "concept", "part").orderBy("distance", "key"))
    few = scored.withColumn("nth", best).where(F.col("nth") <= k).select("query_id", "key", "distance").distinct()
    order = Window.partitionBy("query_id").orderBy("distance", "key")
    return few.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "key", "distance")

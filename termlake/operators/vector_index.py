"""An index of chunk vectors behind a filter: coarse cells, and postings by concept and cell.

A query probes the nearest cells only, and of these only the postings of concepts that it may see; what it meets is ranked by its exact
distance. All vectors are indexed; the cells alone come from a bounded sample, and any sample gives right distances.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termlake.operators.similarity import best_of
from termlake.scratch import stage
from termlake.tasks import ship

ship(__name__)

#: Bytes and rows of the sample that cells are fitted to, and cells, at most. A cell has the square root of the rows, about.
SAMPLE_BYTES, SAMPLE_ROWS, CELLS = 32 << 20, 20_000, 1024
STEPS = 10
#: Queries that the number of probes is tuned with, at most.
TUNED_WITH = 500
#: Rows of a part of a cell's postings, and of the queries that meet it, about; where all cells are met, bytes of its vectors.
PART_ROWS, PART_BYTES = 4096, 8 << 20
#: Parts that a query's finds are ranked in before all are.
PARTS = 16


def fit_cells(sample: np.ndarray, cells: int, steps: int = STEPS) -> np.ndarray:
    """Centres of unit length by k-means on directions, from rows spread over the sample; a cell that loses all its rows keeps its centre."""
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    points = unit(sample)
    centres = points[np.linspace(0, len(points) - 1, min(cells, len(points))).astype(int)]
    for _ in range(steps):
        own = np.argmax(points @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        filled = np.bincount(own, minlength=len(centres)) > 0
        centres = np.where(filled[:, None], unit(sums), centres)
    return centres


def _in_cells(centres: np.ndarray, probes: int):
    """Rows (..., vector) with `cells`, their nearest cells, the nearest first."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            lengths = pc.list_value_length(column).to_numpy()
            if (lengths != centres.shape[1]).any():
                raise ValueError(f"vectors of {centres.shape[1]} numbers expected")
            points = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, centres.shape[1])
            near = np.argsort(-(points @ centres.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
            cells = pa.ListArray.from_arrays(np.arange(len(near) + 1, dtype=np.int32) * near.shape[1], pa.array(near.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, cells], names=[*batch.schema.names, "cells"])

    return find


def with_cells(rows: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in rows.schema)
    return rows.mapInArrow(_in_cells(centres, probes), schema + ", cells array<int>")


@dataclass
class VectorIndex:
    """centres (CELLS rows at most), stored postings (concept, cell, part, key, vector) and sizes (concept, cell, n, parts), and how many
    cells a query probes: all, so that searches are exact, until tune() finds that fewer do."""

    centres: np.ndarray
    postings: DataFrame
    sizes: DataFrame
    probes: int

    @classmethod
    def build(cls, rows: DataFrame, path: str, cells: int | None = None) -> VectorIndex:
        """Index rows (key, vector, concepts) below `path`, which must be new. Rows without a vector or a concept cannot be found and are left out."""
        spark, found = rows.sparkSession, stage(rows.where("vector IS NOT NULL").select("key", F.array_distinct("concepts").alias("concepts"), F.col("vector").cast("array<double>").alias("vector")), "vectors")
        n, longest = found.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
        most = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * longest)))
        cells = cells or max(1, min(CELLS, int(n**0.5)))
        sample = found.select("vector").orderBy(F.xxhash64("key")).limit(most).collect() if cells > 1 else []
        centres = fit_cells(np.array([x["vector"] for x in sample], np.float64), cells) if sample else np.zeros((1, longest))
        placed = stage(with_cells(found, centres, 1).select(F.explode("concepts").alias("concept"), F.col("cells")[0].alias("cell"), "key", "vector"), "placed")
        placed.groupBy("concept", "cell").agg(F.count("*").alias("n"), F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts")).write.parquet(f"{path}/sizes")
        sizes = spark.read.parquet(f"{path}/sizes")
        dealt = placed.join(sizes, ["concept", "cell"]).select("concept", "cell", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"), "key", "vector")
        dealt.write.parquet(f"{path}/postings")
        spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
        return cls.read(spark, path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> VectorIndex:
        centres = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()  # CELLS rows at most
        return cls(np.array([x["centre"] for x in centres]), spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/sizes"), len(centres))

    def tune(self, queries: DataFrame, wanted: DataFrame, k: int, recall: float = 0.95) -> int:
        """Set and return the least number of probes with which queries (query_id, vector), TUNED_WITH of them at most, find a share of
        `recall` of their true k nearest. Those are sought once in all cells; how far down a query's cells each lies tells the rest."""
        some = stage(queries.orderBy(F.xxhash64("query_id")).limit(TUNED_WITH), "tuning")
        true = self.search(some, wanted, k, len(self.centres))
        order = with_cells(some.where("vector IS NOT NULL").select("query_id", F.col("vector").cast("array<double>").alias("vector")), self.centres, len(self.centres))
        cells = self.postings.select("key", "cell").distinct()
        depth = true.join(cells, "key").join(order, "query_id").select(F.array_position("cells", F.col("cell")).alias("depth"))
        found = sorted(x["depth"] for x in depth.collect())  # TUNED_WITH * k at most
        self.probes = int(found[int(np.ceil(recall * len(found))) - 1]) if found else len(self.centres)
        return self.probes

    def search(self, queries: DataFrame, wanted: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """(query_id, rank, key, distance): for queries (query_id, vector), a stated set, the k nearest of the postings whose concept is
        one of the query's in wanted (query_id, concept), ties by key. A query that wants nothing finds nothing.

        Queries and postings meet by concept, cell and part of a cell, both sides of bounded number, in a matrix product. Where all cells
        are probed they part nothing: a concept's postings are dealt by their number alone, and a query meets each part once.
        """
        probes = probes or self.probes
        vectors = queries.where("vector IS NOT NULL").select("query_id", F.col("vector").cast("array<double>").alias("q"))
        if probes < len(self.centres):
            asked, rows, sizes, postings = stage(with_cells(vectors, self.centres, probes), "asked"), PART_ROWS, self.sizes, self.postings
        else:
            asked, rows = stage(vectors.withColumn("cells", F.array(F.lit(0))), "asked"), max(1, PART_BYTES // (8 * self.centres.shape[1]))
            sizes = stage(self.sizes.groupBy("concept").agg(F.ceil(F.sum("n") / rows).cast("int").alias("parts")).withColumn("cell", F.lit(0)), "sizes")
            postings = self.postings.drop("cell", "part").join(sizes, "concept").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")).drop("parts")
        n = max(1, -(-asked.count() // rows))
        asked = asked.join(wanted.select("query_id", "concept").distinct(), "query_id").select("query_id", "concept", "q", F.explode("cells").alias("cell"))
        asked = asked.join(sizes, ["concept", "cell"]).select("query_id", "q", "concept", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("query_id"), F.lit(n)).cast("int").alias("asked"))
        known = postings.join(asked.select("concept", "cell").distinct(), ["concept", "cell"], "left_semi").withColumn("asked", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        by = ("concept", "cell", "part", "asked")
        schema = f"key {known.schema['key'].dataType.simpleString()}, query_id {asked.schema['query_id'].dataType.simpleString()}, score double"
        met = asked.groupBy(*by).cogroup(known.groupBy(*by)).applyInArrow(best_of("query_id", "q", "vector", ["key"], ["key"], None, k, 6), schema)
        return best(met.select("query_id", "key", F.round(1 - F.col("score"), 6).alias("distance")), k)


def best(scored: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, key, distance): each query's k nearest keys of scored (query_id, key, distance), a key once."""
    order = [F.col("distance"), F.col("key")]
    part = Window.partitionBy("query_id", F.pmod(F.xxhash64("key"), F.lit(PARTS))).orderBy(*order)
    few = scored.groupBy("query_id", "key").agg(F.min("distance").alias("distance")).withColumn("nth", F.row_number().over(part)).where(F.col("nth") <= k)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "key", "distance")

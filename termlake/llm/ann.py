"""Approximate nearest neighbours: a robust-pruned directed graph for each shard, searched with a beam.

Equal vectors are one node. Nodes hash into shards of bounded size. A shard's graph begins at random; in two passes
greedy searches from its medoid propose neighbours for each node, and pruning keeps a candidate only if no kept one
is nearer to it by the factor alpha. Queries stream past every shard; the best of all shards are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termlake.llm.common import rows_of, ship, stage_table

ship(__name__)

#: Nodes of a shard. Every query visits every shard, so shards should be as large as a task's memory allows: a node takes
#: 8 bytes a dimension, 4 bytes an edge, and some 300 bytes while it is built. Building takes about 1.3 ms a node.
SHARD = 32_768
DEGREE = 32
BUILD_BEAM = 48
SEARCH_BEAM = 192
ALPHA = 1.2
#: Nodes that are inserted, and queries that are searched, at a time.
TOGETHER = 256


def usable(vector: Column) -> Column:
    """Neither null nor zero, every component a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def beam_search(vectors: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances 1 - dot product) of the `beam` best nodes found for each query, best first; -1 where there are fewer.

    All queries take a step at a time: each opens its nearest unopened node and keeps the best of old and new ones.
    """
    n, rows = len(queries), np.arange(len(queries))
    ids = np.full((n, beam), -1, np.int64)
    far = np.full((n, beam), np.inf, np.float32)
    opened = np.ones((n, beam), bool)
    ids[:, 0], far[:, 0], opened[:, 0] = start, 1 - queries @ vectors[start], False
    seen = np.zeros((n, len(vectors) + 1), bool)  # the last column takes the padding
    seen[:, start], seen[:, -1] = True, True
    while True:
        at = np.argmin(opened, axis=1)
        live = np.flatnonzero(~opened[rows, at])
        if not len(live):
            return ids, far
        opened[live, at[live]] = True
        near = graph[ids[live, at[live]]]
        fresh = ~seen[live[:, None], near]
        seen[live[:, None], near] = True
        distance = 1 - np.einsum("qd,qkd->qk", queries[live], vectors[np.maximum(near, 0)])
        distance[~fresh] = np.inf
        all_far = np.concatenate([far[live], distance], axis=1)
        best = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
        line = np.arange(len(live))[:, None]
        far[live] = all_far[line, best]
        ids[live] = np.where(np.isinf(far[live]), -1, np.concatenate([ids[live], near], axis=1)[line, best])
        opened[live] = np.concatenate([opened[live], ~fresh], axis=1)[line, best] | np.isinf(far[live])


def robust_prune(vectors: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each node up to `degree` of its candidates (-1: none), nearest first, that no kept one is alpha times nearer to."""
    own = candidates == nodes[:, None]
    ordered = np.sort(np.where(own, -1, candidates), axis=1)
    repeated = np.concatenate([np.zeros((len(nodes), 1), bool), ordered[:, 1:] == ordered[:, :-1]], axis=1)
    candidates = np.where(repeated, -1, ordered)
    points = vectors[np.maximum(candidates, 0)]
    to_node = np.sqrt(np.maximum(2 - 2 * np.einsum("nd,ncd->nc", vectors[nodes], points), 0))
    to_node[candidates < 0] = np.inf
    order = np.argsort(to_node, axis=1, kind="stable")
    candidates, to_node = np.take_along_axis(candidates, order, axis=1), np.take_along_axis(to_node, order, axis=1)
    points = np.take_along_axis(points, order[:, :, None], axis=1)
    between = np.sqrt(np.maximum(2 - 2 * points @ points.transpose(0, 2, 1), 0))
    left = np.isfinite(to_node)
    out = np.full((len(nodes), degree), -1, np.int64)
    rows = np.arange(len(nodes))
    for k in range(degree):
        at = np.argmax(left, axis=1)
        some = left[rows, at]
        if not some.any():
            break
        out[some, k] = candidates[some, at[some]]
        left &= ~(some[:, None] & (alpha * between[rows, at] <= to_node))
        left[rows, at] = False
    return out


def build_graph(vectors: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 8) -> tuple[np.ndarray, int]:
    """(neighbours of each node, -1 where there are fewer; medoid) of unit vectors."""
    n = len(vectors)
    random = np.random.default_rng(seed)
    graph = random.integers(0, n, (n, degree))
    graph[graph == np.arange(n)[:, None]] = -1
    graph[:, degree // 2 :] = -1
    medoid = int(np.argmax(vectors @ vectors.mean(axis=0)))
    for factor in (1.0, alpha):
        order = random.permutation(n)
        for a in range(0, n, TOGETHER):
            nodes = order[a : a + TOGETHER]
            found, _ = beam_search(vectors, graph, medoid, vectors[nodes], beam)
            graph[nodes] = robust_prune(vectors, nodes, np.concatenate([found, graph[nodes]], axis=1), degree, factor)
            # each new edge also backwards: into a free place, or by pruning again
            source, target = np.repeat(nodes, degree), graph[nodes].reshape(-1)
            source, target = source[target >= 0], target[target >= 0]
            by = np.argsort(target, kind="stable")
            source, target = source[by], target[by]
            heads, first, counts = np.unique(target, return_index=True, return_counts=True)
            for b in range(0, len(heads), TOGETHER):
                some, most = heads[b : b + TOGETHER], int(counts[b : b + TOGETHER].max())
                back = np.full((len(some), most), -1, np.int64)
                places = first[b : b + TOGETHER, None] + np.arange(most)
                have = np.arange(most) < counts[b : b + TOGETHER, None]
                back[have] = source[places[have]]
                graph[some] = robust_prune(vectors, some, np.concatenate([graph[some], back], axis=1), degree, factor)
    return graph, medoid


INDEX = pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("n", pa.int32()), ("medoid", pa.int32()), ("vectors", pa.binary()), ("graph", pa.binary()), ("members", pa.list_(pa.list_(pa.int64())))])


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector times a power of two that brings its largest component near 1: cosines stay, squares neither overflow nor vanish."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors of scaled ones."""
    return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)


def _matrix(column: pa.Array) -> np.ndarray:
    return _scaled(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1))


def _build(table: pa.Table) -> pa.Table:
    vectors = _matrix(table.column("vector").combine_chunks())
    graph, medoid = build_graph(_unit(vectors))
    row = {"dim": [table.column("dim")[0].as_py()], "shard": [table.column("shard")[0].as_py()], "n": [len(vectors)], "medoid": [medoid], "vectors": [vectors.astype("<f8").tobytes()], "graph": [graph.astype("<i4").tobytes()], "members": [table.column("members").to_pylist()]}
    return pa.table(row, INDEX)


def build_index(vectors: DataFrame, k: int, shard: int = SHARD) -> DataFrame:
    """The stored index over vectors (vec_id, vector): one row a shard. Of equal vectors it keeps the k + 1 smallest ids,
    all that k neighbours of any query can be; the window keeps k + 1 a task before it shuffles them."""
    ranked = vectors.withColumn("nth", F.row_number().over(Window.partitionBy(F.xxhash64("vector"), "vector").orderBy("vec_id"))).where(F.col("nth") <= k + 1)
    nodes = stage_table(ranked.groupBy(F.xxhash64("vector").alias("hash"), "vector").agg(F.sort_array(F.collect_list("vec_id")).alias("members")), "ann-nodes")
    shards = nodes.count() // shard + 1
    dealt = nodes.select(F.size("vector").alias("dim"), F.pmod("hash", F.lit(shards)).cast("int").alias("shard"), F.col("vector").cast("array<double>").alias("vector"), "members")
    return stage_table(dealt.groupBy("dim", "shard").applyInArrow(_build, _INDEX), "ann-index")


FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
_INDEX = "dim int, shard int, n int, medoid int, vectors binary, graph binary, members array<array<bigint>>"


def _search(k: int, beam: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A shard, which comes first, and then the queries: for each the k nearest of the shard. The shard stays, queries stream past."""
        held: list = []
        for batch in batches:
            if not held:
                (row,) = batch.slice(0, 1).to_pylist()
                if row["graph"] is None:
                    return  # queries whose dimension has no shard
                vectors = np.frombuffer(row["vectors"], "<f8").reshape(row["n"], -1)
                graph = np.frombuffer(row["graph"], "<i4").reshape(row["n"], -1).astype(np.int64)
                held = [vectors, graph, row["medoid"], row["members"], _unit(vectors), np.linalg.norm(vectors, axis=1)]
                batch = batch.slice(1)
            vectors, graph, medoid, members, unit, norms = held
            for at in range(0, batch.num_rows, TOGETHER):
                some, out = batch.slice(at, TOGETHER), ([], [], [])
                asked = _matrix(some.column("vector"))
                ids, _ = beam_search(unit, graph, medoid, _unit(asked), beam)
                for query_id, query, nodes in zip(some.column("query_id").to_pylist(), asked, ids, strict=True):
                    nodes = nodes[nodes >= 0]
                    scores = (vectors[nodes] @ query / (norms[nodes] * np.linalg.norm(query))).tolist()
                    near = sorted((-s, m) for s, node in zip(scores, nodes.tolist(), strict=True) for m in members[node] if m != query_id)
                    for s, m in near[:k]:
                        for column, value in zip(out, (query_id, m, -s), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(x, kind.type) for x, kind in zip(out, FOUND, strict=True)], schema=FOUND)

    return search


def nearest(index: DataFrame, queries: DataFrame, k: int, beam: int = SEARCH_BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: up to k rows of the index for each row of queries (query_id, vector), itself apart.

    score is the cosine in double precision, ties go to the smaller vec_id. Every query meets every shard of its dimension: a
    task has a shard and streams the queries past it, so a shard is sent once, whatever the number of queries.
    """
    shards = F.broadcast(index.select("dim", "shard"))  # two integers a shard: 16 bytes for some ten thousand vectors
    asked = queries.select(F.size("vector").alias("dim"), "query_id", F.col("vector").cast("array<double>").alias("vector")).join(shards, "dim")
    met = index.withColumn("kind", F.lit(0)).unionByName(asked.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    met = met.repartition("dim", "shard").sortWithinPartitions("dim", "shard", "kind")
    found = met.groupBy("dim", "shard").applyInArrow(_search(k, beam), "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_embeddings(rows: DataFrame, is_query: Column, k: int, beam: int = SEARCH_BEAM, shard: int = SHARD) -> DataFrame:
    """nearest() for the rows of `rows` (vec_id, embedding) that is_query marks, against all others.

    Vectors that are null, zero or hold a null or a number that is not finite take no part, nor do null ids. Candidates have
    the query's dimension. A vec_id that occurs twice is two candidates with one id. Without candidates a query has no rows, and an
    empty table gives an empty result. Columns but vec_id and embedding stay behind. Finite components may be of any size.
    """
    good = rows_of(rows, vec_id=F.col("vec_id").cast("long"), vector=F.col("embedding"), query=is_query).where(usable(F.col("vector")) & F.col("vec_id").isNotNull())
    queries = good.where("query").select(F.col("vec_id").alias("query_id"), "vector")
    return nearest(build_index(good.select("vec_id", "vector"), k, shard), queries, k, beam)

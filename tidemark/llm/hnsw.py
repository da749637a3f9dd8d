"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard, kept as flat neighbour arrays.

Shards are random, bounded in size, and searched for every query; each gives its nearest with exact distances, and the
nearest of all shards are kept. Equal vectors are one node of the graph.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.frames import many, stored

#: Vectors of a shard on average, queries of a block.
SHARD, BLOCK = 4096, 512


class Graph:
    """vectors (n, d); layer l has the nodes of level l and above, with at most `width` neighbours (twice as many
    on layer 0) in row i of links[l], -1 where there are fewer."""

    def __init__(self, vectors: np.ndarray, width: int = 12, seed: int = 1):
        self.vectors, self.width = vectors, width
        n = len(vectors)
        levels = np.minimum((-np.log(np.random.default_rng(seed).uniform(1e-12, 1, n)) / np.log(width)).astype(int), 8)
        self.entry = int(levels.argmax()) if n else -1
        self.top = int(levels.max()) if n else 0
        self.levels = levels
        self.links = [np.full((n, 2 * width if layer == 0 else width), -1, np.int32) for layer in range(self.top + 1)]

    @classmethod
    def build(cls, vectors: np.ndarray, width: int = 12, effort: int = 64, seed: int = 1) -> Graph:
        graph = cls(vectors, width, seed)
        if len(vectors):
            order = [graph.entry, *[i for i in range(len(vectors)) if i != graph.entry]]
            for i in order[1:]:
                graph._insert(i, effort)
        return graph

    @classmethod
    def from_arrays(cls, vectors: np.ndarray, entry: int, links: list[np.ndarray]) -> Graph:
        graph = cls.__new__(cls)
        graph.vectors, graph.entry, graph.links, graph.top = vectors, entry, links, len(links) - 1
        return graph

    def _far(self, to: np.ndarray, nodes: np.ndarray | list[int]) -> np.ndarray:
        gap = self.vectors[nodes] - to
        return np.einsum("ij,ij->i", gap, gap)

    def _search(self, to: np.ndarray, starts: list[tuple[float, int]], effort: int, layer: int) -> list[tuple[float, int]]:
        """The nearest nodes found on a layer, at most `effort`, nearest first."""
        links = self.links[layer]
        seen = {i for _, i in starts}
        open_, best = list(starts), [(-d, i) for d, i in starts]
        heapq.heapify(open_)
        heapq.heapify(best)
        while open_:
            d, i = heapq.heappop(open_)
            if d > -best[0][0] and len(best) >= effort:
                break
            new = [j for j in links[i].tolist() if j >= 0 and j not in seen]
            if not new:
                continue
            seen.update(new)
            for far, j in zip(self._far(to, new).tolist(), new, strict=True):
                if len(best) < effort:
                    heapq.heappush(best, (-far, j))
                    heapq.heappush(open_, (far, j))
                elif far < -best[0][0]:
                    heapq.heapreplace(best, (-far, j))
                    heapq.heappush(open_, (far, j))
        return sorted((-d, i) for d, i in best)

    def _choose(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Neighbours in all directions: a node goes in unless one chosen before is nearer to it; then the nearest rest."""
        nodes = [i for _, i in found]
        points = self.vectors[nodes]
        square = np.einsum("ij,ij->i", points, points)
        between = square[:, None] + square[None, :] - 2 * points @ points.T
        kept: list[int] = []
        for k, (d, _) in enumerate(found):
            if len(kept) == most:
                break
            if not kept or between[k, kept].min() > d:
                kept.append(k)
        rest = [k for k in range(len(nodes)) if k not in set(kept)]
        return [nodes[k] for k in (kept + rest)[:most]]

    def _insert(self, i: int, effort: int) -> None:
        to, level = self.vectors[i], int(self.levels[i])
        near = [(float(self._far(to, [self.entry])[0]), self.entry)]
        for layer in range(self.top, level, -1):
            near = self._search(to, near, 1, layer)
        for layer in range(min(level, self.top), -1, -1):
            near = self._search(to, near, effort, layer)
            links = self.links[layer]
            most = links.shape[1]
            chosen = self._choose(near, self.width)
            links[i, : len(chosen)] = chosen
            for j in chosen:
                row = links[j]
                free = np.flatnonzero(row < 0)
                if len(free):
                    row[free[0]] = i
                else:
                    nodes = [*row.tolist(), i]
                    found = sorted(zip(self._far(self.vectors[j], nodes).tolist(), nodes, strict=True))
                    row[:] = self._choose(found, most)

    def nearest(self, to: np.ndarray, k: int, effort: int) -> list[int]:
        near = [(float(self._far(to, [self.entry])[0]), self.entry)]
        for layer in range(self.top, 0, -1):
            near = self._search(to, near, 1, layer)
        return [i for _, i in self._search(to, near, max(k, effort), 0)[:k]]


def usable(vector: Column) -> Column:
    """Not null, not all zero, and without null, infinite or undefined components."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & whole & F.exists(vector, lambda x: x != 0), F.lit(False))


def _distinct(rows: DataFrame, keep: int) -> DataFrame:
    """embedding, ids: each distinct vector with its `keep` smallest ids, which is all that a list of nearest can show.
    Ids are first ranked in parts of a vector, so that a frequent vector is not met by one task."""
    parts = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64)))
    by_part = Window.partitionBy("embedding", "part").orderBy("id")
    parts = parts.withColumn("rank", F.row_number().over(by_part)).where(F.col("rank") <= keep).select("embedding", "id")
    whole = Window.partitionBy("embedding").orderBy("id")
    few = parts.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= keep)
    return few.groupBy("embedding").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def build_index(vectors: DataFrame, shard: int = SHARD, keep: int = 11) -> DataFrame:
    """One stored row for each shard: dim, shard, the graph's arrays, vectors and ids. vectors: id, embedding (usable).

    Shards are dealt by a hash of the vector. There are some partitions more than shards, so that each shard is built by a
    task of its own as a rule."""
    nodes = stored(_distinct(vectors, keep))
    shards = max(1, -(-nodes.count() // shard))
    nodes = nodes.withColumns({"dim": F.size("embedding"), "shard": F.pmod(F.xxhash64("embedding"), F.lit(shards)).cast("int")})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ids", key=lambda c: c.map(lambda x: x[0]))
        exact = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
        graph = Graph.build(exact)
        ids = np.concatenate(pdf["ids"].to_numpy()).astype("<i8")
        sizes = pdf["ids"].map(len).to_numpy().astype("<i4")
        return pd.DataFrame(
            {
                "dim": [exact.shape[1]], "shard": [pdf["shard"].iloc[0]], "entry": [graph.entry], "vectors": [exact.tobytes()],
                "links": [[x.tobytes() for x in graph.links]], "widths": [[x.shape[1] for x in graph.links]], "ids": [ids.tobytes()], "sizes": [sizes.tobytes()],
            }
        )

    kind = "dim int, shard int, entry int, vectors binary, links array<binary>, widths array<int>, ids binary, sizes binary"
    dealt = nodes.repartition(_parts(nodes, shards), "dim", "shard")
    return stored(dealt.groupBy("dim", "shard").applyInPandas(run, kind))


def _parts(rows: DataFrame, shards: int) -> int:
    """Partitions for so many shards: four for each while they are few, which keeps most from meeting in one."""
    return max(many(rows.sparkSession), min(4 * shards, 1024))


def _blocks(queries: DataFrame) -> DataFrame:
    """dim, ids, vectors: queries of one dimension, packed, at most BLOCK in a row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, same in pdf.groupby(pdf["embedding"].map(len)):
                for at in range(0, len(same), BLOCK):
                    part = same.iloc[at : at + BLOCK]
                    vectors = np.stack(part["embedding"].to_numpy()).astype(np.float64)
                    yield pd.DataFrame({"dim": [dim], "ids": [part["id"].to_numpy("<i8").tobytes()], "vectors": [vectors.tobytes()]})

    return queries.select("id", "embedding").mapInPandas(run, "dim int, ids binary, vectors binary")


class Shard:
    """A stored shard, ready to be searched."""

    def __init__(self, row: dict):
        self.vectors = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"])
        links = [np.frombuffer(x, np.int32).reshape(len(self.vectors), w) for x, w in zip(row["links"], row["widths"], strict=True)]
        self.graph = Graph.from_arrays(self.vectors, row["entry"], links)
        self.ids, self.ends = np.frombuffer(row["ids"], "<i8"), np.cumsum(np.frombuffer(row["sizes"], "<i4"))
        self.starts = np.concatenate([[0], self.ends[:-1]])

    def nearest(self, query: int, to: np.ndarray, k: int, effort: int) -> list[tuple[int, int, float]]:
        nodes = self.graph.nearest(to, k + 1, effort)
        gap = self.vectors[nodes] - to
        score = np.sqrt((gap * gap).sum(1)).tolist()
        each = sorted((d, i) for d, node in zip(score, nodes, strict=True) for i in self.ids[self.starts[node] : self.ends[node]].tolist() if i != query)
        return [(query, i, d) for d, i in each[:k]]


def search(queries: DataFrame, index: DataFrame, k: int = 10, effort: int = 96) -> DataFrame:
    """query_id, vec_id, score: from each shard of the query's dimension the k nearest others that its graph finds, with
    distances in double precision. queries: id, embedding (usable).

    A shard is sent once, to the task that searches it; the queries stream past it in blocks behind it. Each shard meets
    each block, a stated set of queries against all rows; no task holds more than one shard and one block."""
    shards = index.groupBy("dim").agg(F.collect_list("shard").alias("shards"))
    asked = _blocks(queries).join(shards, "dim").select("dim", F.explode("shards").alias("shard"), "ids", "vectors", F.lit(1).alias("turn"))
    both = index.withColumn("turn", F.lit(0)).unionByName(asked, allowMissingColumns=True)
    both = both.repartition(_parts(index, index.count()), "dim", "shard").sortWithinPartitions("dim", "shard", "turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                if row["turn"] == 0:
                    shard = Shard(row)
                    continue
                ids, vectors = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"])
                out = [x for query, to in zip(ids.tolist(), vectors, strict=True) for x in shard.nearest(query, to, k, effort)]
                columns = list(zip(*out, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

    return both.mapInArrow(run, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest of all vectors but those of its own id, nearest first, ties to
    the smaller id. vectors, queries: id, embedding.

    Vectors that are null, zero or hold null or non-finite components take no part; nor do null ids. Vectors of different
    lengths are never compared. Rows that repeat an id with the same vector are one; other columns are not looked at; empty
    tables give no rows. Scores are computed from the vectors as they are, in double precision.
    """
    clean = lambda df: df.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("id").isNotNull() & usable(F.col("embedding"))).distinct()
    index = build_index(clean(vectors), shard, k + 1)
    found = search(stored(clean(queries)), index, k)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", F.row_number().over(order))
    return best.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

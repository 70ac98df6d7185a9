"""Exact top-k by inner product: a ball tree per shard, searched by branch and bound.

Vectors are scaled to integers, so scores are exact.  Rows are cut into shards
of about ``shard_rows`` by id hash.  Each query first searches the shard it
lives in; its k-th score there is a lower bound that every other shard starts
from, so most of their nodes are cut.  Queries meet the other shards in blocks
of about ``query_block``, so no task holds more than a shard and a block.

* Vectors that are null, or hold a null or non-finite component, and rows with
  a null id take no part.
* Of rows that share an id, the smallest vector (by array order) counts.
* A query meets only vectors of its own length; an empty vector has no score.
* Equal scores go to the smaller id; a query never finds its own id.
* A score outside 64 bits counts as the nearest number inside.
* An empty table, or a table without queries, gives an empty result.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphmill.session import written

FOUND = "query_id bigint, vec_id bigint, score bigint"


@dataclass(frozen=True)
class Params:
    k: int = 10
    scale: int = 1024
    leaf: int = 64
    shard_rows: int = 8192
    query_block: int = 1024


class Tree:
    """Nodes as flat arrays; ``rows`` is a permutation in which every node is a slice."""

    def __init__(self, x: np.ndarray, leaf: int):
        self.rows = np.arange(len(x))
        lo, hi, left, centre, radius = [], [], [], [], []
        todo = [(0, len(x))]
        for a, b in todo:  # grows while it is read: children come in pairs
            part = x[self.rows[a:b]]
            c = part.mean(axis=0)
            away = np.linalg.norm(part - c, axis=1)
            lo.append(a)
            hi.append(b)
            centre.append(c)
            radius.append(away.max())
            if b - a <= leaf or away.max() == 0:
                left.append(-1)
                continue
            one = part[away.argmax()]
            axis = part[np.linalg.norm(part - one, axis=1).argmax()] - one
            middle = (b - a) // 2
            self.rows[a:b] = self.rows[a:b][np.argpartition(part @ axis, middle)]
            left.append(len(todo))
            todo += [(a, a + middle), (a + middle, b)]
        self.lo, self.hi, self.left = lo, hi, left
        self.centre, self.radius = np.array(centre), np.array(radius)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Per query and node, a number that no inner product inside exceeds."""
        reach = np.linalg.norm(q, axis=1)[:, None]
        size = reach * (np.linalg.norm(self.centre, axis=1) + self.radius)
        return q @ self.centre.T + reach * self.radius + 1e-9 * size + 1


def search(ids, x, query_ids, queries, floors, p: Params) -> tuple[list, list, list]:
    """Up to k best rows of one shard for each query, none below the query's floor."""
    out: tuple[list, list, list] = ([], [], [])
    if not len(ids) or not len(query_ids) or not x.shape[1]:
        return out
    biggest = float(np.abs(x).max()) * float(np.abs(queries).max()) * x.shape[1]
    kind = np.float64 if biggest < 2**53 else object  # Python integers keep huge products exact
    approx = x.astype(np.float64)
    tree = Tree(approx, p.leaf)
    lowest, highest = -(2**63), 2**63 - 1
    bounds = np.maximum(tree.bounds(queries.astype(np.float64)), lowest)
    exact, exact_q = x.astype(kind)[tree.rows], queries.astype(kind)
    names = ids[tree.rows]
    for i, me in enumerate(query_ids):
        bound, kth = bounds[i], floors[i]
        best_s, best_n = np.zeros(0, kind), np.zeros(0, np.int64)
        heap = [(-bound[0], 0)]
        while heap and -heap[0][0] >= kth:
            node = heapq.heappop(heap)[1]
            child = tree.left[node]
            if child >= 0:
                for c in (child, child + 1):
                    if bound[c] >= kth:
                        heapq.heappush(heap, (-bound[c], c))
                continue
            a, b = tree.lo[node], tree.hi[node]
            s = exact[a:b] @ exact_q[i]
            if kind is object:
                s = np.array([min(max(v, lowest), highest) for v in s], object)
            keep = (s >= kth) & (names[a:b] != me)
            if keep.any():
                best_s, best_n = np.concatenate([best_s, s[keep]]), np.concatenate([best_n, names[a:b][keep]])
                order = np.lexsort((best_n, -best_s))[: p.k]
                best_s, best_n = best_s[order], best_n[order]
                if len(best_s) == p.k:
                    kth = max(kth, best_s[-1])
        out[0].extend([int(me)] * len(best_n))
        out[1].extend(best_n.tolist())
        out[2].extend(int(s) for s in best_s)
    return out


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy().reshape(len(flat), -1) if len(flat) else np.zeros((0, 0), np.int64)


def _table(found: tuple[list, list, list]) -> pa.Table:
    return pa.table(dict(zip(("query_id", "vec_id", "score"), (pa.array(c, pa.int64()) for c in found))))


def scaled(vectors: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """``id, v``: one row of integers per usable vector."""
    v = F.col(vector_column)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    usable = vectors.filter(F.col(id_column).isNotNull() & v.isNotNull() & ~bad)
    return usable.select(F.col(id_column).alias("id"), whole.alias("v")).groupBy("id").agg(F.min("v").alias("v"))


def top_k(
    vectors: DataFrame,
    is_query: Column,
    params: Params = Params(),
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best rows for each row where ``is_query`` (over ``id``) holds."""
    p = params
    base = scaled(vectors, id_column, vector_column, p.scale)
    base = written(base.withColumn("asks", F.coalesce(is_query, F.lit(False))), "vectors")
    n, n_queries = base.agg(F.count("*"), F.count_if("asks")).first()
    shards, blocks = max(1, -(-n // p.shard_rows)), max(1, -(-n_queries // p.query_block))
    rows = base.withColumn("dim", F.size("v")).withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))

    def at_home(part: pa.Table) -> pa.Table:
        ids, x, asks = part.column("id").to_numpy(), _matrix(part.column("v")), part.column("asks").to_numpy()
        return _table(search(ids, x, ids[asks], x[asks], [-np.inf] * int(asks.sum()), p))

    home = rows.groupBy("dim", "shard").applyInArrow(at_home, FOUND)
    home = written(home, "home-scores")
    floors = home.groupBy("query_id").agg(F.when(F.count("*") >= p.k, F.min("score")).alias("floor"))

    def elsewhere(part: pa.Table, asked: pa.Table) -> pa.Table:
        low = [-np.inf if f is None else f for f in asked.column("q_floor").to_pylist()]  # integers stay exact
        ids, x = part.column("id").to_numpy(), _matrix(part.column("v"))
        return _table(search(ids, x, asked.column("q_id").to_numpy(), _matrix(asked.column("q_v")), low, p))

    def up_to(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))

    asked = (
        rows.filter("asks")
        .join(floors, F.col("id") == F.col("query_id"), "left")
        .withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)))
        .select("id", "v", "dim", "floor", "block", F.col("shard").alias("lives"), up_to(shards).alias("shard"))
        .filter(F.col("shard") != F.col("lives"))
    )
    asked = asked.select(*[F.col(c).alias(f"q_{c}") for c in ("id", "v", "floor", "dim", "shard", "block")])
    offered = rows.select("id", "v", "dim", "shard", up_to(blocks).alias("block"))
    keys = ["dim", "shard", "block"]
    others = offered.groupBy(*keys).cogroup(asked.groupBy(*[f"q_{c}" for c in keys])).applyInArrow(elsewhere, FOUND)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        home.unionByName(others)
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= p.k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )

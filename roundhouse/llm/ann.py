"""Approximate nearest neighbours by adaptive dimension scan over inverted lists.

Vectors are normalised, rotated at random and dealt to the list of their
nearest centroid. A query scans its nearest lists block by block of rotated
dimensions: the partial distance over d of D dimensions estimates the whole,
and a hypothesis test abandons a candidate as soon as that is significantly
above the best k-th distance known. Survivors are scored exactly on the
original vectors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Written, map_batches
from .vectors import dimension, norms, packed, rotation, unpack

FIT_ROWS = 8192      # bound of the sample that fits centroids and the number of probes
LIST_ROWS = 512      # wanted rows per list
MAX_LISTS = 512
PROBE_QUANTILE = 0.99
BLOCK_ROWS = 4096    # rows of a list that one task scans
BLOCK_QUERIES = 1024
COLUMNS = 8          # dimensions added per step
EPSILON = 2.1        # width of the hypothesis test


class Index:
    """Centroids, rotation, probes and the fitting sample (all bounded)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rows: int, k: int, seed: int = 7,
                 list_rows: int = LIST_ROWS, max_lists: int = MAX_LISTS, quantile: float = PROBE_QUANTILE):
        d = vectors.shape[1]
        self.ids, self.vectors, self.d = ids, vectors, d
        self.turn = rotation(d, seed) if d else np.empty((0, 0))
        self.sample = self.place(vectors)
        n = len(ids)
        lists = int(min(max(1, rows // list_rows), max_lists, max(1, n // 16)))
        rng = np.random.default_rng(seed)
        centres = self.sample[rng.permutation(n)[:lists]]
        for _ in range(12):
            own = self._nearest(self.sample, centres, 1)[:, 0]
            total = np.zeros_like(centres)
            np.add.at(total, own, self.sample)
            count = np.bincount(own, minlength=len(centres))
            centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
        self.centres = centres
        self.probes = len(centres)
        if len(centres) > 1:  # how far down the list order true neighbours of sampled queries lie
            own = self._nearest(self.sample, centres, 1)[:, 0]
            q = rng.permutation(n)[:512]
            gap = self._gaps(self.sample[q], self.sample)
            gap[np.arange(len(q)), q] = np.inf
            true = np.argpartition(gap, min(k, n - 1) - 1, axis=1)[:, :k]
            rank = np.argsort(np.argsort(self._gaps(self.sample[q], centres), axis=1), axis=1)
            need = np.take_along_axis(rank, own[true], axis=1) + 1
            self.probes = int(np.ceil(np.quantile(need, quantile)))

    def place(self, x: np.ndarray) -> np.ndarray:
        return (x / norms(x)[:, None]) @ self.turn if len(x) else x

    @staticmethod
    def _gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)

    def _nearest(self, x: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
        gap = self._gaps(x, centres)
        return np.argsort(gap, axis=1, kind="stable")[:, :k]

    def lists_of(self, x: np.ndarray, k: int) -> np.ndarray:
        return np.concatenate([self._nearest(x[a:a + 4096], self.centres, k) for a in range(0, len(x), 4096)]
                              or [np.empty((0, k), dtype=np.int64)])


def fit(rows: DataFrame, d: int, k: int, fit_rows: int = FIT_ROWS, **options) -> Index:
    """Fits on the ``fit_rows`` rows of smallest seeded hash; every row is indexed later."""
    n = rows.count()
    sample = rows.orderBy(F.xxhash64("vec_id", F.lit("ann")), "vec_id", "packed").limit(fit_rows).toPandas()
    sample = sample.drop_duplicates("vec_id")
    return Index(sample["vec_id"].to_numpy(dtype=np.int64), unpack(sample["packed"], d), n, k, **options)


def adaptive_scan(columns: np.ndarray, query: np.ndarray, bound: float, k: int,
                  step: int = COLUMNS, epsilon: float = EPSILON, ids: np.ndarray | None = None,
                  own: int | None = None) -> np.ndarray:
    """Candidates (column indices) that survive the test within one block.

    ``columns`` is D x rows, rotated; ``bound`` a squared distance that the
    k-th neighbour is known not to exceed. Columns of equal ``ids`` are one
    neighbour, those of id ``own`` none.
    """
    d = columns.shape[0]
    alive = np.arange(columns.shape[1])
    partial = np.zeros(len(alive))
    for a in range(0, d, step):
        b = min(a + step, d)
        gap = columns[a:b, alive] - query[a:b, None] if len(alive) < columns.shape[1] \
            else columns[a:b] - query[a:b, None]
        partial = partial + np.einsum("ij,ij->j", gap, gap)
        limit = bound * (1 + 1e-9) + 1e-12
        if b < d:
            limit *= (b / d) * (1 + epsilon / np.sqrt(b)) ** 2
        keep = partial <= limit
        alive, partial = alive[keep], partial[keep]
        if not len(alive):
            break
    if ids is not None:
        other = ids[alive] != own
        alive, partial = alive[other], partial[other]
    if len(alive) > 4 * k:  # enough here: the k-th neighbour of them bounds the rest (ties stay)
        least = partial
        if ids is not None:
            order = np.lexsort((partial, ids[alive]))
            least = partial[order[np.unique(ids[alive][order], return_index=True)[1]]]
        if len(least) > k:
            alive = alive[partial <= np.partition(least, k - 1)[k - 1] + 1e-9]
    return alive


def cosines(x: np.ndarray, query: np.ndarray) -> np.ndarray:
    return (x * query).sum(axis=1) / (norms(x) * np.sqrt((query * query).sum()))


def search(emb: DataFrame, is_query: Column, k: int = 5, scratch: Written | None = None, **options) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each query row by cosine.

    Null, zero and non-finite vectors, those of another length than most, and
    rows without an id take no part. Rows that share a vec_id are one
    candidate (its best score), dealt over the parts of their lists; a query
    never finds its own vec_id. An empty table gives no row, a table of fewer rows gives all of them.
    """
    spark = emb.sparkSession
    scratch = scratch or Written(spark, "ann")
    schema = "query_id long, rank int, vec_id long, score double"
    d = dimension(emb)
    if d == 0:
        return spark.createDataFrame([], schema)
    rows = scratch.put(packed(emb, d).distinct(), "vectors")
    index = fit(rows, d, k, **options)
    shared = spark.sparkContext.broadcast(index)

    def assign(batch):
        x = unpack(batch.column("packed").to_pylist(), d)
        ix = shared.value
        return {"vec_id": batch.column("vec_id"), "packed": batch.column("packed"),
                "list": ix.lists_of(ix.place(x), 1)[:, 0]}

    indexed = scratch.put(map_batches(rows, "vec_id long, packed binary, list int", assign), "index")

    def probe(batch):
        """Each query's probed lists, its bound and its best rows of the fitting sample."""
        ix = shared.value
        ids = batch.column("vec_id").to_numpy()
        x = unpack(batch.column("packed").to_pylist(), d)
        turned = ix.place(x)
        lists = ix.lists_of(turned, ix.probes)
        bound = np.full(len(ids), np.inf)
        seeds: list[list[tuple]] = []
        for i in range(len(ids)):
            gap = ((ix.sample - turned[i]) ** 2).sum(axis=1)
            other = np.flatnonzero(ix.ids != ids[i])
            near = other[np.argsort(gap[other], kind="stable")[:k]]
            if len(near) == k:
                bound[i] = gap[near[-1]] + 1e-9
            score = cosines(ix.vectors[near], x[i])
            seeds.append([{"vec_id": int(v), "score": float(s)} for v, s in zip(ix.ids[near], score)])
        return {"query_id": ids, "packed": batch.column("packed"), "bound": bound,
                "lists": list(lists.tolist()), "seeds": seeds}

    queries = (rows.filter(is_query).groupBy("vec_id").agg(F.min("packed").alias("packed")))
    asked = scratch.put(map_batches(
        queries, "query_id long, packed binary, bound double, lists array<int>, "
                 "seeds array<struct<vec_id: long, score: double>>", probe), "queries")

    asks = asked.select("query_id", "packed", "bound", F.explode("lists").alias("list"))
    # tasks of at most about BLOCK_ROWS x BLOCK_QUERIES: the counts have one row per list (bounded)
    sizes = (indexed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("parts"))
             .join(asks.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("asks")),
                   "list"))
    sizes = F.broadcast(scratch.put(sizes, "sizes"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    blocks = (indexed.join(sizes, "list").withColumn("part", F.pmod(F.xxhash64("vec_id", "packed"), F.col("parts")).cast("int"))
              .select("list", "part", every("asks").alias("ask"), "vec_id", "packed"))
    asks = (asks.join(sizes, "list").withColumn("ask", F.pmod(F.xxhash64("query_id"), F.col("asks")).cast("int"))
            .select("list", every("parts").alias("part"), "ask", "query_id", "packed", "bound"))

    def scan(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if len(left) and len(right):
            ix = shared.value
            x = unpack(left["packed"], d)
            ids = left["vec_id"].to_numpy()
            columns = np.ascontiguousarray(ix.place(x).T)
            q = unpack(right["packed"], d)
            turned = ix.place(q)
            for i, (qid, bound) in enumerate(zip(right["query_id"].to_numpy(), right["bound"].to_numpy())):
                found = adaptive_scan(columns, turned[i], bound, k, ids=ids, own=qid)
                score = cosines(x[found], q[i])
                best = np.lexsort((ids[found], -score))
                best = best[np.sort(np.unique(ids[found][best], return_index=True)[1])[:k]]  # the best row of each id
                out["query_id"] += [qid] * len(best)
                out["vec_id"] += ids[found][best].tolist()
                out["score"] += score[best].tolist()
        return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    keys = ["list", "part", "ask"]
    scanned = blocks.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInPandas(
        scan, "query_id long, vec_id long, score double")
    seeds = asked.select("query_id", F.explode("seeds").alias("s")).select("query_id", "s.vec_id", "s.score")
    best = scanned.unionByName(seeds).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))

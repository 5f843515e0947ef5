"""Embedding near-duplicates by a subspace join of tiles.

Two unit vectors with cosine >= c are within squared distance 2 - 2c, and so
are their shadows in any subspace of a random rotation. Rows are sorted by a
grid over the first coordinates into tiles; two tiles meet unless their boxes
are further apart. A pair of rows is tested in the leading subspace first and
then exactly on the original vectors. Every row is stored in one tile, and the
tasks read the tiles that meet where they are written: nothing is shuffled or
copied per pair of tiles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, components, map_batches
from .vectors import dimension, norms, packed, rotation, unpack

THRESHOLD = 0.95
LEAD = 3 / 8         # share of the dimensions in the leading subspace
CELL_ROWS = 8192     # wanted rows per grid cell
GRID = 4             # most dimensions of the grid
CHUNK = 8192         # rows per tile
GUARD = 1e-4         # of squared distances, against rounding in single precision
VERIFY = 50_000      # pairs verified at once


class Subspace:
    """Rotation, leading subspace, budget and the grid."""

    def __init__(self, d: int, threshold: float, rows: int, cell_rows: int = CELL_ROWS):
        self.d, self.turn = d, rotation(d, 11)
        self.lead = max(1, int(np.ceil(LEAD * d)))
        self.budget = max(0.0, 2 - 2 * threshold) + GUARD
        # cells are a radius wide; about 3 of them hold a coordinate's spread
        self.grid = int(np.clip(np.ceil(np.log(max(rows / cell_rows, 1)) / np.log(3)), 1, min(self.lead, GRID)))

    def place(self, x: np.ndarray) -> np.ndarray:
        return (x / norms(x)[:, None]) @ self.turn[:, :self.lead]

    def cells(self, y: np.ndarray) -> np.ndarray:
        """The grid cell of every row; its coordinates in order are its number to the base 2**15."""
        at = np.floor(y[:, :self.grid] / np.sqrt(self.budget)).clip(-2 ** 14, 2 ** 14 - 1).astype(np.int64) + 2 ** 14
        return (at << (15 * np.arange(self.grid)[::-1])).sum(axis=1)

    def close(self, x: np.ndarray, p: np.ndarray, same: bool, high: int = 256, wide: int = 1024):
        """Index pairs (in x, in p) whose shadows may be within the budget (a superset), about
        ``VERIFY`` at a time. ``same``: x is p, and each pair comes once, without the rows themselves.

        One product in single precision gives the squared distances.
        """
        left = np.column_stack([-2 * x, (x ** 2).sum(1), np.ones(len(x))]).astype(np.float32)
        right = np.ascontiguousarray(np.column_stack([p, np.ones(len(p)), (p ** 2).sum(1)]).T.astype(np.float32))
        limit = np.float32(self.budget)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        number = 0
        for lo in range(0, len(x), high):
            part = left[lo:lo + high]
            for q in range(lo if same else 0, len(p), wide):
                other = right[:, q:q + wide]
                near = np.flatnonzero((part @ other <= limit).ravel())
                if not len(near):
                    continue
                i, j = lo + near // other.shape[1], q + near % other.shape[1]
                if same:
                    i, j = i[i < j], j[i < j]
                found.append((i, j))
                number += len(i)
                if number >= VERIFY:
                    yield tuple(np.concatenate(z) for z in zip(*found))
                    found, number = [], 0
        if number:
            yield tuple(np.concatenate(z) for z in zip(*found))


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index of each node's class under the links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        label = label[label]
        if (label == before).all():
            return label


def tiles_of(copies: DataFrame, space: Subspace, shared, chunk: int) -> DataFrame:
    """``copies`` (id, h, c, packed) sorted by grid cell, up to ``chunk`` rows in one row: the box of its
    grid coordinates (low, high) and the columns as bytes. Rows of one cell are dealt on by their hash."""
    d, g = space.d, space.grid

    def deal(batch):
        y = shared.value.place(unpack(batch.column("packed").to_pylist(), d))
        return {"cell": shared.value.cells(y), **{c: batch.column(c) for c in ("id", "h", "c", "packed")}}

    placed = map_batches(copies.select("id", "h", "c", "packed"), "cell long, id long, h long, c long, packed binary",
                         deal)
    sorted_rows = placed.repartitionByRange("cell", "h").sortWithinPartitions("cell", "h").drop("cell")
    names = ("id", "h", "c", "packed")
    kinds = {**{c: pa.binary() for c in names}, "low": pa.list_(pa.float64()), "high": pa.list_(pa.float64())}
    schema = pa.schema(list(kinds.items()))

    def tile(rows: pa.Table) -> pa.RecordBatch:
        vectors = rows.column("packed").to_pylist()
        y = shared.value.place(unpack(vectors, d))[:, :g]
        made = {**{c: [rows.column(c).to_numpy().astype("<i8").tobytes()] for c in names[:3]},
                "packed": [b"".join(vectors)], "low": [y.min(axis=0).tolist()], "high": [y.max(axis=0).tolist()]}
        return pa.RecordBatch.from_arrays([pa.array(made[c], type=k) for c, k in kinds.items()], schema=schema)

    def cut(batches):
        held = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            while held.num_rows >= chunk:
                yield tile(held.slice(0, chunk))
                held = held.slice(chunk)
        if held is not None and held.num_rows:
            yield tile(held)

    cut_rows = sorted_rows.select(*names).mapInArrow(
        cut, "id binary, h binary, c binary, packed binary, low array<double>, high array<double>")
    return cut_rows.withColumn("tile", F.monotonically_increasing_id())


def near_duplicates(emb: DataFrame, threshold: float = THRESHOLD, scratch: Written | None = None,
                    chunk: int = CHUNK, cell_rows: int = CELL_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept per row of ``emb``.

    Null, zero and non-finite vectors, and those of another length than most,
    link with nothing. Equal vectors travel once with their number. Rows that
    repeat a vec_id count as vectors of their own but are one node of the
    graph; a null vec_id links with nothing and has null component and kept.
    """
    spark = emb.sparkSession
    scratch = scratch or Written(spark, "neardup")
    d = dimension(emb)
    every = emb.select(F.col("vec_id").cast("long").alias("vec_id"))
    alone = lambda df: df.select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                 F.col("vec_id").alias("component_id"),
                                 F.col("vec_id").isNotNull().alias("kept"))
    if d == 0:
        return alone(every)
    rows = scratch.put(packed(emb, d), "vectors")
    copies = scratch.put(rows.groupBy("packed").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("c"))
                         .withColumn("h", F.xxhash64("packed")), "distinct")
    # rows of one vec_id are one node, equal vectors are linked; the vectors stay where they are
    digest = F.unhex(F.sha2("packed", 256)).alias("digest")
    links = scratch.put(rows.select("vec_id", digest).join(copies.select(digest, "id", "h", "c"), "digest")
                        .drop("digest"), "members")
    scratch.drop("vectors")
    space = Subspace(d, threshold, copies.count(), cell_rows)
    shared = spark.sparkContext.broadcast(space)
    tiles = scratch.put(tiles_of(copies, space, shared, chunk), "tiles")
    scratch.drop("distinct")

    side = lambda n: tiles.select(*[F.col(c).alias(f"{n}_{c}") for c in tiles.columns])
    apart = [F.greatest(F.col("x_low")[i] - F.col("p_high")[i], F.col("p_low")[i] - F.col("x_high")[i], F.lit(0.0))
             for i in range(space.grid)]
    meet = (F.col("x_tile") <= F.col("p_tile")) & (sum((a * a for a in apart), F.lit(0.0)) <= space.budget)
    # (the hint makes a product of the scans: each task reads one part of the tiles for either side)
    pairs = side("x").join(side("p").hint("shuffle_replicate_nl"), meet).select(
        "x_tile", "p_tile", *[f"{n}_{c}" for n in "xp" for c in ("id", "h", "c", "packed")])

    def read(batch, at: int, side: str):
        id_, h, c = (np.frombuffer(batch.column(f"{side}_{k}")[at].as_buffer(), dtype="<i8") for k in ("id", "h", "c"))
        flat = batch.column(f"{side}_packed")[at].as_buffer()
        kind = "<f4" if flat.size == 4 * d * len(id_) else "<f8"
        v = np.frombuffer(flat, dtype=kind).reshape(-1, d).astype(np.float64)
        return id_, h, c, v, shared.value.place(v), norms(v)

    def links_of(x, p, same: bool):
        """Of two tiles (or one): number of links per row, and a spanning forest of the links."""
        (_, _, cx, vx, yx, nx), (_, _, cp, vp, yp, np_) = x, p
        n, m = len(cx), 0 if same else len(cp)
        count = np.zeros(n + m, dtype=np.int64)
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        for i, j in shared.value.close(yx, yp, same):
            for at in range(0, len(i), VERIFY):
                u, v = i[at:at + VERIFY], j[at:at + VERIFY]
                cos = (vx[u] * vp[v]).sum(axis=1) / (nx[u] * np_[v])
                u, v = u[cos >= threshold], v[cos >= threshold]
                if len(u):  # only a spanning forest of the links leaves
                    w = v if same else v + n
                    np.add.at(count, u, cp[v])
                    np.add.at(count, w, cx[u])
                    ends.append(trees(u, w, n + m))
        if len(ends) > 1:
            ends = [trees(*(np.concatenate(z) for z in zip(*ends)), n + m)]
        return count, ends

    def trees(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        label = forest(a, b, n)
        node = np.unique(np.concatenate([a, b]))
        node = node[label[node] != node]
        return node, label[node]

    schema = pa.schema([(c, pa.int64()) for c in "abhn"])

    def join(batches):
        # links are added up over all pairs of a task, so a row leaves it once
        seen: dict[int, list] = {}  # of each tile: first node, ids, hashes, numbers of links
        ends, nodes, last, x = [], 0, None, None
        for batch in batches:
            numbers = {n: batch.column(f"{n}_tile").to_pylist() for n in "xp"}
            for at in range(batch.num_rows):
                if numbers["x"][at] != last:
                    x, last = read(batch, at, "x"), numbers["x"][at]
                other = numbers["p"][at]
                p = x if other == last else read(batch, at, "p")
                for number, rows_ in ((last, x), (other, p)):
                    if number not in seen:
                        seen[number] = [nodes, rows_[0].copy(), rows_[1].copy(), np.zeros(len(rows_[0]), dtype=np.int64)]
                        nodes += len(rows_[0])
                of_x, of_p = seen[last], seen[other]
                count, trees_ = links_of(x, p, other == last)
                n = len(x[0])
                of_x[3] += count[:n]
                of_p[3] += count[n:] if other != last else 0
                for e in trees_:
                    ends.append(tuple(np.where(z < n, z + of_x[0], z - n + of_p[0]) for z in e))
        if not ends:
            return
        ids, hashes, count = (np.concatenate([t[k] for t in seen.values()]) for k in (1, 2, 3))
        node, root = trees(*(np.concatenate(z) for z in zip(*ends)), nodes)
        n = np.flatnonzero(count)
        zero = np.zeros(len(node), dtype=np.int64)
        for columns in ((ids[n], ids[n], hashes[n], count[n]), (ids[node], ids[root], zero, zero)):
            yield pa.RecordBatch.from_arrays([pa.array(z, type=pa.int64()) for z in columns], schema=schema)

    found = scratch.put(pairs.mapInArrow(join, "a long, b long, h long, n long"), "found")
    scratch.drop("tiles")
    counts = found.filter("n > 0").groupBy(F.col("a").alias("id"), "h").agg(F.sum("n").alias("n"))
    edges = found.filter("n = 0").select("a", "b").distinct()
    comp = components(edges.unionByName(links.filter("vec_id <> id").select(
        F.col("vec_id").alias("a"), F.col("id").alias("b"))), scratch, "near")
    linked = (links.join(counts, ["id", "h"], "left").join(comp.withColumnRenamed("id", "vec_id"), "vec_id", "left")
              .select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("c") - 1).alias("n_links"),
                      F.coalesce("component_id", "vec_id").alias("component_id"))
              .withColumn("kept", F.col("vec_id") == F.col("component_id")))
    # rows whose vector cannot link: those that packing left out
    usable = links.groupBy("vec_id").agg(F.count(F.lit(1)).alias("u"))
    total = every.groupBy("vec_id").agg(F.count(F.lit(1)).alias("t"))
    # (a repeated vec_id may have both kinds of rows; its component is that of its usable rows)
    left = (total.join(usable, "vec_id", "left").withColumn("k", F.col("t") - F.coalesce("u", F.lit(0))).filter("k > 0")
            .join(comp.withColumnRenamed("id", "vec_id"), "vec_id", "left")
            .select("vec_id", F.lit(0).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
                    (F.col("vec_id") == F.coalesce("component_id", "vec_id")).alias("kept"),
                    F.explode(F.sequence(F.lit(1).cast("long"), "k")))
            .drop("col"))
    return linked.unionByName(left)

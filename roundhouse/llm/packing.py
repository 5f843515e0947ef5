"""Best-fit packing of token pieces under several capacities at once."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import Written, map_batches
from .tokens import encoder, tokenizer_path

CAPACITY = 4096
END_ID = 1
MAX_DOCS = 4096               # pieces per sequence
ATTENTION = CAPACITY ** 2     # sum of squared piece lengths per sequence
WEIGHTS = (1.0, 1e-3, 1e-3)   # tokens, pieces, attention cost
SHARD_ROWS = 20_000


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY,
           end_id: int = END_ID, keep: tuple = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """``keep`` columns, piece, start, length, ids_crc32 (and ids) of every document.

    A null or empty text is the end id alone. Only documents longer than
    ``capacity`` are cut.
    """
    path = tokenizer or tokenizer_path()
    kinds = dict(docs.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep]
                       + ["piece int", "start long", "length long", "ids_crc32 long"]
                       + ["ids array<int>"] * with_ids)

    def run(batch):
        import pyarrow as pa
        for lo, hi, buf, offsets in T.slices(batch.column("_text")):
            ids, bounds = encoder(path).encode(buf, offsets, end_id)
            size = np.diff(bounds)
            n = -(-size // capacity)
            row = np.repeat(np.arange(hi - lo), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(size[row] - start, capacity)
            begin = bounds[row] + start
            raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
            crc = [zlib.crc32(raw[4 * b:4 * (b + k)]) for b, k in zip(begin.tolist(), length.tolist())]
            made = {c: batch.column(c).take(pa.array(row + lo)) for c in keep}
            made |= {"piece": piece, "start": start, "length": length, "ids_crc32": crc}
            if with_ids:  # pieces lie one after another, so their ids are the whole array
                made["ids"] = pa.ListArray.from_arrays(
                    pa.array(np.append(begin, len(ids)), pa.int32()), pa.array(ids.view(np.int32)))
            yield made

    return map_batches(docs.select(*keep, F.col("text").alias("_text")), schema, run)


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY, max_docs: int = MAX_DOCS,
             attention: int = ATTENTION, weights=WEIGHTS, rule: str = "norm"):
    """(bin, offset in the bin, place in the bin) of each length.

    Pieces come longest first. Among the bins with room in every capacity, the
    rule "norm" takes the one whose weighted residual norm after placing is
    least, "dot" the one whose residual has the largest weighted dot product
    with the piece's demand; the first bin wins ties.
    """
    n = len(lengths)
    caps = np.array([capacity, max_docs, attention], dtype=float)
    w = np.asarray(weights, dtype=float)
    left = np.empty((3, max(n, 1)))
    used = np.zeros((2, max(n, 1)), dtype=np.int64)  # tokens and pieces so far
    number = np.empty(max(n, 1), dtype=np.int64)     # an open bin's own number
    open_bins = bins = 0
    where, offset, place = (np.empty(n, dtype=np.int64) for _ in range(3))
    order = np.argsort(-lengths, kind="stable")
    smallest = lengths.min() if n else 0
    for at, i in enumerate(order):
        k = int(lengths[i])
        demand = np.array([k, 1, float(k) * k])
        if (demand > caps).any():
            raise ValueError(f"a piece of {k} tokens exceeds a capacity by itself")
        if at % 256 == 0:  # full bins leave the search
            live = np.flatnonzero((left[0, :open_bins] >= smallest) & (left[1, :open_bins] >= 1))
            left[:, :len(live)], used[:, :len(live)] = left[:, live], used[:, live]
            number[:len(live)] = number[live]
            open_bins = len(live)
        room = left[:, :open_bins]
        fits = np.flatnonzero((room[0] >= k) & (room[1] >= 1) & (room[2] >= demand[2]))
        if len(fits):
            if rule == "dot":
                value = -((w * demand / caps ** 2) @ room[:, fits])
            else:
                rest = (room[:, fits] - demand[:, None]) / caps[:, None]
                value = w @ (rest * rest)
            b = fits[int(np.argmin(value))]
        else:
            b = open_bins
            left[:, b], used[:, b], number[b] = caps, 0, bins
            open_bins, bins = open_bins + 1, bins + 1
        where[i], offset[i], place[i] = number[b], used[0, b], used[1, b]
        left[:, b] -= demand
        used[:, b] += (k, 1)
    return where, offset, place


def pack(cut: DataFrame, capacity: int = CAPACITY, max_docs: int = MAX_DOCS, attention: int = ATTENTION,
         weights=WEIGHTS, rule: str = "norm", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The pieces with sequence_id, offset and place in the sequence.

    ``cut`` must be a stored table with a ``length`` column. Full pieces are
    sequences of their own; the others are dealt over shards of about
    ``shard_rows`` rows, packed on their own, so that at most a few sequences
    per shard stay partly empty.
    """
    full = cut.filter(F.col("length") >= capacity)
    rest = cut.filter(F.col("length") < capacity)
    shards = max(1, -(-rest.count() // shard_rows))
    alone = full.select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"),
                        F.lit(0).cast("long").alias("offset"), F.lit(0).cast("long").alias("place"))
    columns = cut.columns
    # by row, not by document: copies of one document are dealt out as well
    dealt = rest.withColumn("_shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        bins, offset, place = best_fit(pdf["length"].to_numpy(), capacity, max_docs, attention, weights, rule)
        return pdf[columns].assign(sequence_id=pdf["_shard"].to_numpy() * (1 << 32) + bins,
                                   offset=offset, place=place)

    kinds = dict(cut.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in columns] + ["sequence_id long", "offset long", "place long"])
    return alone.unionByName(dealt.groupBy("_shard").applyInPandas(fill, schema))


def packed_ids(packed: DataFrame) -> DataFrame:
    """sequence_id and its token ids, from pieces packed ``with_ids``."""
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return rows.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, keep: tuple = ("doc_id",),
                   scratch: Written | None = None, with_ids: bool = False, **options) -> DataFrame:
    """Tokenises, cuts and packs: one row per piece.

    Null and empty texts are one piece of one token. Rows that repeat a doc_id
    are packed as rows of their own; an empty table gives none; extra columns
    are ignored unless named in ``keep``.
    """
    scratch = scratch or Written(docs.sparkSession, "packing")
    capacity = options.get("capacity", CAPACITY)
    cut = scratch.put(pieces(docs, tokenizer, capacity, keep=keep, with_ids=with_ids), "pieces")
    return pack(cut, **options)

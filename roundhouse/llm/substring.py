"""Substring deduplication over word windows by super-k-mer partitioning.

Every window of ``window`` words has a minimiser: the least hash of its
``kmer``-word sequences. Consecutive windows with one minimiser form a
super-k-mer, which travels once, as one packed string, to its minimiser's
bucket; there its windows are sorted and compared. Equal windows have equal
minimisers, so a minimiser seen in one document only cannot hold a repeat and
its strings stay home.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import Written, map_batches

WINDOW = 50
KMER = 8
HOT_WINDOWS = 200_000  # a bucket with more windows sends them singly, combined before the shuffle
_SECOND = 0xA0761D6478BD642F


def super_kmers(buf: np.ndarray, offsets: np.ndarray, window: int, kmer: int):
    """(text index, first word, number of windows, minimiser) of every super-k-mer."""
    words, first, _, _ = T.word_hashes(buf, offsets)
    if len(words) < window:
        empty = np.empty(0, dtype=np.int64)
        return empty, empty, empty, empty.astype(np.uint64)
    least = T.sliding_min(T.windows_hash(words, kmer), window - kmer + 1)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    at = np.arange(len(least))
    at = at[at + window <= first[doc[:len(least)] + 1]]  # windows that end within their text
    least, doc = least[at], doc[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (least[1:] != least[:-1])
    begin = np.flatnonzero(new)
    return doc[begin], at[begin] - first[doc[begin]], np.diff(np.append(begin, len(at))), least[begin]


def runs(flags: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and end index of the maximal runs of True within one group."""
    edge = np.ones(len(flags) + 1, dtype=bool)
    edge[1:-1] = group[1:] != group[:-1]
    on = np.flatnonzero(flags & (edge[:-1] | ~np.append(False, flags[:-1])))
    off = np.flatnonzero(flags & (edge[1:] | ~np.append(flags[1:], False))) + 1
    return on, off


def _find(docs: DataFrame, window: int, kmer: int) -> DataFrame:
    def run(batch):
        docid, key = batch.column("doc_id"), batch.column("t")
        for lo, hi, buf, offsets in T.slices(batch.column("text")):
            doc, start, n, least = super_kmers(buf, offsets, window, kmer)
            row = pa.array(doc + lo)
            yield {"m": T.signed(least), "doc_id": docid.take(row), "t": key.take(row), "start": start, "n": n}
    return map_batches(docs, "m long, doc_id long, t long, start int, n int", run)


def _cut(docs: DataFrame, window: int) -> DataFrame:
    def run(batch):
        text, key, docid = batch.column("text"), batch.column("t"), batch.column("doc_id")
        spans = batch.column("spans")
        edge = spans.offsets.to_numpy()
        flat = spans.values
        m, start, n, hot = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("m", "start", "n", "hot"))
        for lo, hi, buf, offsets in T.slices(text):
            begins, ends, first = T.word_bounds(buf, offsets)
            part = slice(edge[lo], edge[hi])
            row = np.repeat(np.arange(lo, hi), np.diff(edge[lo:hi + 1]))
            a = begins[first[row - lo] + start[part]]
            b = ends[first[row - lo] + start[part] + n[part] + window - 2]
            size = b - a
            step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            data = buf[np.repeat(a, size) + step]
            where = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int64())
            packed = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(size), [None, where.buffers()[1], pa.py_buffer(data)])
            take = pa.array(row)
            yield {"m": m[part], "hot": hot[part], "doc_id": docid.take(take), "t": key.take(take),
                   "start": start[part], "n": n[part], "packed": packed}
    return map_batches(docs, "m long, hot boolean, doc_id long, t long, start int, n int, packed binary", run)


def _windows(packed: pa.Array, window: int):
    """(row, window in the row, 128-bit hash) of all windows of packed strings."""
    for lo, hi, buf, offsets in T.slices(packed):
        words, first, _, _ = T.word_hashes(buf, offsets)
        a, b = T.windows_hash(words, window), T.windows_hash(words, window, _SECOND)
        n = np.diff(first) - window + 1
        row = np.repeat(np.arange(hi - lo), n)
        inner = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        at = first[row] + inner
        yield row + lo, inner, a[at], b[at]


def _count(strings: DataFrame, window: int, batch_bytes: int = 8 << 20) -> DataFrame:
    """Removed word ranges [a, b) from packed strings sorted by minimiser."""
    names = ["m", "doc_id", "t", "start", "packed"]

    def solve(rows: pa.Table):
        m = rows["m"].to_numpy()
        doc = rows["doc_id"].to_numpy()
        start = rows["start"].to_numpy()
        key = rows["t"].to_numpy()
        parts = list(_windows(rows["packed"].combine_chunks(), window))
        row, inner, a, b = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((doc[row], b, a, m[row]))
        r, x, y = row[order], a[order], b[order]
        new = np.ones(len(r), dtype=bool)
        new[1:] = (m[r][1:] != m[r][:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        group = np.cumsum(new) - 1
        least = doc[r][new][group]  # rows of a group are sorted by document
        removed = np.empty(len(r), dtype=bool)
        removed[order] = least < doc[r]
        on, off = runs(removed, row)
        return {"doc_id": doc[row[on]], "t": key[row[on]], "a": start[row[on]] + inner[on],
                "b": start[row[on]] + inner[off - 1] + window}

    schema = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column("packed").nbytes
            if size >= batch_bytes:
                rows = pa.Table.from_batches(held)
                m = rows["m"].to_numpy()
                cut = int(np.searchsorted(m, m[-1]))  # the last bucket may go on
                if cut:
                    made = solve(rows.slice(0, cut))
                    yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in schema], schema=schema)
                    held = rows.slice(cut).combine_chunks().to_batches()
                    size = sum(x.column("packed").nbytes for x in held)
        if held and sum(x.num_rows for x in held):
            made = solve(pa.Table.from_batches(held))
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in schema], schema=schema)

    dealt = strings.select(*names).repartition("m").sortWithinPartitions("m")
    return dealt.mapInArrow(run, "doc_id long, t long, a int, b int")


def _single(strings: DataFrame, window: int, scratch: Written) -> DataFrame:
    """The same for buckets that are too large for one task: windows travel singly.

    The minima are written first, so that the join has two plain shuffles and
    adaptive execution can split a window that very many rows hold.
    """
    def run(batch):
        docid, key, start = (batch.column(c) for c in ("doc_id", "t", "start"))
        for row, inner, a, b in _windows(batch.column("packed"), window):
            take = pa.array(row)
            yield {"x": T.signed(a), "y": T.signed(b), "doc_id": docid.take(take), "t": key.take(take),
                   "a": start.to_numpy()[row] + inner}
    each = map_batches(strings.select("doc_id", "t", "start", "packed"),
                       "x long, y long, doc_id long, t long, a int", run)
    least = scratch.put(each.groupBy("x", "y").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("m"))
                        .filter("least < m").drop("m"), "least")
    return (each.join(least, ["x", "y"]).filter("least < doc_id")
            .select("doc_id", "t", "a", (F.col("a") + window).alias("b")))


def repeated_ranges(docs: DataFrame, scratch: Written, window: int = WINDOW, kmer: int = KMER,
                    hot_windows: int = HOT_WINDOWS, originals: DataFrame | None = None) -> DataFrame:
    """Word ranges of ``docs`` (doc_id, t, text) that repeat a smaller document's window.

    ``originals`` (doc_id, t) names each distinct text under its smallest doc_id; only
    those make strings (their windows have the smallest documents of all). Rows that
    repeat one are combined where they lie, so g of them make the strings of one.
    """
    found = _find(docs, window, kmer)
    if originals is not None:
        found = found.join(originals, ["doc_id", "t"], "left_semi")
    found = scratch.put(found.distinct(), "superkmers")
    shared = scratch.put(
        found.groupBy("m").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.sum("n").alias("n"))
        .filter("lo < hi").select("m", (F.col("n") > hot_windows).alias("hot")), "shared")
    spans = (found.join(shared, "m").groupBy("doc_id", "t")
             .agg(F.collect_list(F.struct("m", "start", "n", "hot")).alias("spans")))
    once = docs.groupBy("doc_id", "t").agg(F.any_value("text").alias("text"))
    source = once.join(spans, ["doc_id", "t"]).select("doc_id", "t", "text", "spans")
    strings = scratch.put(_cut(source, window), "strings")
    scratch.drop("superkmers")
    return _count(strings.filter("not hot"), window).unionByName(_single(strings.filter("hot"), window, scratch))


def deduplicate(docs: DataFrame, window: int = WINDOW, kmer: int = KMER, hot_windows: int = HOT_WINDOWS,
                with_text: bool = False, scratch: Written | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and the kept text) per document.

    A word goes if a window over it also starts in a document with a smaller
    doc_id. Null and empty texts have no words; a null doc_id counts as the
    largest. Rows that repeat a doc_id stay rows of their own and never remove
    each other's words. Texts that are copies of a smaller document's travel
    no further: all their words are repeats if there are ``window`` of them.
    """
    scratch = scratch or Written(docs.sparkSession, "substring")
    last = (1 << 63) - 1
    rows = docs.select(F.coalesce("doc_id", F.lit(last)).cast("long").alias("doc_id"), "text",
                       F.xxhash64("text").alias("t"), F.xxhash64(F.lit(7), "text").alias("t2"))
    keys = scratch.put(rows.select("doc_id", "t", "t2").distinct(), "keys")
    least = keys.groupBy("t", "t2").agg(F.min("doc_id").alias("least"))
    keys = scratch.put(keys.join(least, ["t", "t2"]).select("doc_id", "t", (F.col("doc_id") > F.col("least"))
                                                            .alias("copy")), "copies")
    ranges = scratch.put(repeated_ranges(rows.select("doc_id", "t", "text"), scratch, window, kmer, hot_windows,
                                         keys.filter("NOT copy").select("doc_id", "t")), "ranges")
    scratch.drop("strings", "shared")
    per = ranges.groupBy("doc_id", "t").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
    source = (rows.select("doc_id", "t", "text").join(keys, ["doc_id", "t"]).join(per, ["doc_id", "t"], "left")
              .select("doc_id", "text", "copy", "ranges"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text

    def run(batch):
        copy = batch.column("copy").to_numpy(zero_copy_only=False)
        lists = batch.column("ranges")
        edge, flat = lists.offsets.to_numpy(), lists.values
        ra, rb = flat.field("a").to_numpy(), flat.field("b").to_numpy()
        docid = batch.column("doc_id")
        for lo, hi, buf, offsets in T.slices(batch.column("text")):
            begins, ends, first = T.word_bounds(buf, offsets)
            n = np.diff(first)
            change = np.zeros(len(begins) + 1, dtype=np.int64)
            row = np.repeat(np.arange(hi - lo), np.diff(edge[lo:hi + 1]))
            part = slice(edge[lo], edge[hi])
            np.add.at(change, first[row] + ra[part], 1)
            np.add.at(change, first[row] + rb[part], -1)
            gone = np.cumsum(change[:-1]) > 0
            gone |= np.repeat(copy[lo:hi] & (n >= window), n)
            kept = np.flatnonzero(~gone)
            # the kept words of all texts, one space after each
            size = ends[kept] - begins[kept] + 1
            step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            at = np.repeat(begins[kept], size) + step
            data = np.where(step == np.repeat(size - 1, size), np.uint8(0x20),
                            buf[np.minimum(at, max(len(buf) - 1, 0))] if len(buf) else np.uint8(0x20))
            end = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(kept, first)]
            raw = data.tobytes()
            texts = [raw[a:max(a, b - 1)] for a, b in zip(end[:-1].tolist(), end[1:].tolist())]
            removed = np.concatenate([[0], np.cumsum(gone)])[first]
            made = {"doc_id": docid.slice(lo, hi - lo), "n_words": n, "n_removed": np.diff(removed),
                    "kept_sha256": [hashlib.sha256(x).hexdigest() for x in texts]}
            if with_text:
                made["kept"] = [x.decode("utf-8") for x in texts]
            yield made

    out = map_batches(source, schema, run)
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(last)))

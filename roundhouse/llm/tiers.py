"""Hierarchical packing: windows of several lengths, long ones filled up from shorter tiers.

Documents are routed by length to the smallest window (tier) that holds them;
whole top-tier windows of long documents stand alone. Tiers are packed from the
longest to the shortest: the longest piece of a tier opens a window, the longest
pieces of shorter tiers that still fit fill its gap, and what no whole piece
fills is filled by cutting the shortest piece that is longer; its rest goes back
to the tier of its length. So every window is full but a shard's last one, whose
ids become windows of powers of two. Windows are then dealt to step groups of
equal token counts and near equal attention cost.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import Written, _arrow_schema, map_batches
from .tokens import WordEncoder, tokenizer_path

TIERS = (2048, 1024, 512, 256)
END_ID = 1
STEP_TOKENS = 1 << 16        # ids of a step group
SHARD_TOKENS = 16 << 20      # ids and rows packed by one task
SHARD_ROWS = 20_000
MAX_CACHED_IDS = 16 << 20    # the encoder's cache starts anew beyond it

_PLAIN = np.zeros(256, dtype=bool)
_PLAIN[0x21:0x7F] = True     # ASCII other than white space and controls


def chunk_starts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where texts can be cut without a change of their byte-level BPE ids.

    The pre-tokenizer never merges across these places: a space or line break
    after a plain ASCII character, a space between any non-ASCII byte and a
    plain character, and a plain character after a line break that stands
    alone. Its look at what follows white space sees the same on both sides.
    """
    n = len(buf)
    plain = _PLAIN[buf]
    head = np.zeros(n + 1, dtype=bool)
    head[offsets] = True                       # texts begin here
    inner = ~head[:n]
    before = np.zeros(n, dtype=bool)           # plain before, in the same text
    before[1:] = plain[:-1]
    before &= inner
    after = np.zeros(n, dtype=bool)            # plain after, in the same text
    after[:-1] = plain[1:] & inner[1:]
    high = np.zeros(n, dtype=bool)
    high[1:] = buf[:-1] >= 0x80
    high &= inner
    line = buf == 0x0A
    cut = (buf == 0x20) & (before | (high & after)) | line & before
    cut[1:] |= plain[1:] & inner[1:] & (line & before)[:-1]
    cut |= head[:n]
    return np.flatnonzero(cut)


class ByteEncoder(WordEncoder):
    """Byte-level BPE ids of whole texts; each distinct chunk of a worker is encoded once."""

    def encode(self, buf: np.ndarray, offsets: np.ndarray, end_id: int | None = None):
        """(ids of all texts, first id of each text); ``end_id`` closes every text."""
        starts = chunk_starts(buf, offsets)
        ends = np.append(starts[1:], len(buf))
        hashes = T.span_hash(buf, starts, ends)
        if len(self.ids) > MAX_CACHED_IDS:
            self.clear()
        distinct, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        new = np.append(self.known, np.uint64(0))[at] != distinct
        new |= at == len(self.known)
        if new.any():
            raw = buf.tobytes()
            self._learn(at[new], distinct[new], [raw[starts[i]:ends[i]].decode("utf-8") for i in where[new]])
            at = np.searchsorted(self.known, distinct)
        chunk = self.place[at][inverse]
        size = self.start[chunk + 1] - self.start[chunk]
        before = np.concatenate([[0], np.cumsum(size)])
        closing = 0 if end_id is None else 1
        first = np.searchsorted(starts, offsets)            # each text's first chunk
        bounds = before[first] + closing * np.arange(len(offsets))
        out = np.empty(int(bounds[-1]), dtype=np.uint32)
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        step = np.arange(int(before[-1])) - np.repeat(before[:-1], size)
        out[np.repeat(before[:-1] + closing * text, size) + step] = self.ids[
            np.repeat(self.start[chunk], size) + step]
        if closing:
            out[bounds[1:] - 1] = end_id
        return out, bounds


_encoders: dict[str, ByteEncoder] = {}


def encoder(path: str) -> ByteEncoder:
    """One encoder per worker and file."""
    if path not in _encoders:
        _encoders[path] = ByteEncoder(path)
    return _encoders[path]


def crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4"))


def route(docs: DataFrame, tokenizer: str | None = None, top: int = TIERS[0], end_id: int = END_ID,
          keep: tuple = ("doc_id",)) -> DataFrame:
    """``keep`` columns, start, length, ids_crc32, doc_tokens, ids of every document.

    Whole windows of ``top`` ids come without ids but with their crc; the rest
    of a document, shorter than ``top``, carries its ids (little-endian, two
    bytes each where the vocabulary allows).
    """
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")
    kinds = dict(docs.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep]
                       + ["start long", "length long", "ids_crc32 long", "doc_tokens long", "ids binary"])

    def run(batch):
        code = encoder(path)
        kind = "<u2" if code.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        for lo, hi, buf, offsets in T.slices(batch.column("_text")):
            ids, bounds = code.encode(buf, offsets, end_id)
            size = np.diff(bounds)
            n = -(-size // top)
            row = np.repeat(np.arange(hi - lo), n)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * top
            length = np.minimum(size[row] - start, top)
            begin = bounds[row] + start
            whole = length == top
            raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
            crc = [zlib.crc32(raw[4 * b:4 * (b + top)]) if w else None
                   for b, w in zip(begin.tolist(), whole.tolist())]
            short = ids.astype(kind)
            width = short.itemsize
            raw = memoryview(short).cast("B")
            held = [None if w else bytes(raw[width * b:width * (b + k)])
                    for b, k, w in zip(begin.tolist(), length.tolist(), whole.tolist())]
            made = {c: batch.column(c).take(pa.array(row + lo)) for c in keep}
            yield made | {"start": start, "length": length, "ids_crc32": pa.array(crc, pa.int64()),
                          "doc_tokens": size[row], "ids": pa.array(held, pa.binary())}

    return map_batches(docs.select(*keep, F.col("text").alias("_text")), schema, run)


class _Pool:
    """Pieces (row, first, length) by length; the longest or shortest within bounds in one step."""

    def __init__(self):
        self.there, self.stacks = 0, {}

    def put(self, row: int, first: int, length: int) -> None:
        self.stacks.setdefault(length, []).append((row, first))
        self.there |= 1 << length

    def _take(self, length: int) -> tuple[int, int, int]:
        stack = self.stacks[length]
        row, first = stack.pop()
        if not stack:
            self.there ^= 1 << length
        return row, first, length

    def longest(self, most: int, above: int = 0):
        """The longest piece of length <= most, if it is > above."""
        length = (self.there & ((2 << most) - 1)).bit_length() - 1
        return self._take(length) if length > above else None

    def shortest(self, least: int):
        rest = self.there >> least
        return self._take(least + (rest & -rest).bit_length() - 1) if rest else None


def pack_tiers(lengths, tiers: tuple = TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Windows (size, [(row, first, length)]) that hold every id of rows shorter than the top tier.

    Sizes are tiers, but for the last ids of all, which make smaller powers of two.
    """
    pool = _Pool()
    for i in np.argsort(lengths, kind="stable").tolist():
        if lengths[i]:
            pool.put(i, 0, int(lengths[i]))
    windows = []
    for size, below in zip(tiers, (*tiers[1:], 0)):
        while (piece := pool.longest(size, below)) is not None:
            held, gap = [piece], size - piece[2]
            while gap:
                piece = pool.longest(min(gap, below or gap))
                if piece is None and (piece := pool.shortest(gap + 1)) is not None:
                    row, first, length = piece
                    pool.put(row, first + gap, length - gap)
                    piece = (row, first, gap)
                if piece is None:
                    break
                held.append(piece)
                gap -= piece[2]
            windows.extend([(size, held)] if not gap else _powers_of_two(held, size - gap))
    return windows


def _powers_of_two(held: list[tuple[int, int, int]], total: int) -> list:
    """The pieces cut into windows of the powers of two that add up to ``total``."""
    out, held = [], held[::-1]
    for bit in reversed(range(total.bit_length())):
        if not total >> bit & 1:
            continue
        room, window = 1 << bit, []
        while room:
            row, first, length = held.pop()
            if length > room:
                held.append((row, first + room, length - room))
                length = room
            window.append((row, first, length))
            room -= length
        out.append((1 << bit, window))
    return out


def step_groups(sizes: np.ndarray, costs: np.ndarray, step_tokens: int = STEP_TOKENS) -> np.ndarray:
    """The step group of each window: longest windows first, dearest first among equal ones,
    each to the group with the fewest ids so far (then the least attention cost)."""
    groups = max(1, round(int(sizes.sum()) / step_tokens))
    heap = [(0, 0, g) for g in range(groups)]
    out = np.empty(len(sizes), dtype=np.int64)
    for i in np.lexsort((-costs, -sizes)).tolist():
        tokens, cost, g = heap[0]
        out[i] = g
        heapq.heapreplace(heap, (tokens + int(sizes[i]), cost + int(costs[i]), g))
    return out


def pack(routed: DataFrame, tiers: tuple = TIERS, step_tokens: int = STEP_TOKENS,
         shard_tokens: int = SHARD_TOKENS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The pieces of ``routed`` (a stored table) with sequence_id, offset, tier and step_id.

    ``tiers`` are descending powers of two. Rows are dealt by their place, not by
    document, over shards of about ``shard_tokens`` ids and ``shard_rows`` rows; a
    shard leaves at most one window short of its tier. ``tier`` is the length of
    the window, which its pieces fill.
    """
    sums = routed.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("t")).first()
    shards = max(1, -(-sums["n"] // shard_rows), -(-(sums["t"] or 0) // shard_tokens))
    columns = [c for c in routed.columns if c not in ("start", "length", "ids_crc32", "ids")]
    kinds = dict(routed.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in columns] + [
        "start long", "length long", "ids_crc32 long", "sequence_id long", "offset long", "tier int", "step_id long"])
    arrow = _arrow_schema(routed.sparkSession, schema)
    dealt = routed.withColumn("_shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))

    def fill(table: pa.Table) -> pa.Table:
        shard = table.column("_shard")[0].as_py()
        ids = table.column("ids").combine_chunks()
        start, length = (table.column(c).to_numpy() for c in ("start", "length"))
        known = table.column("ids_crc32").to_pylist()
        tails = np.flatnonzero(pc.is_valid(ids).to_numpy(zero_copy_only=False))
        windows = [(tiers[0], [(i, 0, tiers[0])]) for i, c in enumerate(known) if c is not None]
        windows += [(size, [(int(tails[r]), a, k) for r, a, k in held])
                    for size, held in pack_tiers(length[tails], tiers)]
        sizes = np.array([w[0] for w in windows])
        step = step_groups(sizes, np.array([sum(k * k for _, _, k in w[1]) for w in windows]), step_tokens)
        rows, starts, lengths, crcs, sequence, offset, tier, steps = ([] for _ in range(8))
        for w, (size, held) in enumerate(windows):
            at = 0
            for i, a, k in held:
                crc = known[i]
                if crc is None:
                    raw = ids[i].as_buffer()
                    crc = crc_of(np.frombuffer(raw, "<u2" if len(raw) == 2 * length[i] else "<u4")[a:a + k])
                for values, x in zip((rows, starts, lengths, crcs, sequence, offset, tier, steps),
                                     (i, start[i] + a, k, crc, (shard << 32) + w, at, size, (shard << 32) + step[w])):
                    values.append(x)
                at += k
        made = [table.column(c).take(pa.array(rows, pa.int64())).combine_chunks() for c in columns]
        made += [pa.array(v, type=arrow.field(c).type) for c, v in zip(
            arrow.names[len(columns):], (starts, lengths, crcs, sequence, offset, tier, steps))]
        return pa.Table.from_arrays(made, schema=arrow)

    return dealt.groupBy("_shard").applyInArrow(fill, schema)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, keep: tuple = ("doc_id",),
                   tiers: tuple = TIERS, scratch: Written | None = None, **options) -> DataFrame:
    """Tokenises, routes and packs: one row per piece.

    A null or empty text is the end id alone. Rows that repeat a doc_id are
    packed as rows of their own (their pieces differ by sequence and offset); a
    null doc_id is kept; an empty table gives no rows; extra columns are ignored
    unless named in ``keep``.
    """
    scratch = scratch or Written(docs.sparkSession, "tiers")
    return pack(scratch.put(route(docs, tokenizer, tiers[0], keep=keep), "routed"), tiers, **options)

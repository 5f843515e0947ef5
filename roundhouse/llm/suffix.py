"""Exact byte-substring deduplication with a difference-cover suffix sort.

Only runs of windows whose minimiser occurs elsewhere are sorted: a string of
``length`` bytes that occurs twice has equal minimisers at equal places. A run
travels once, with its bytes, to the other runs of its minimiser; runs that are
equal as a whole are sorted once. What meets is ordered there: positions whose
residue modulo 21 lies in the difference cover {0, 1, 6, 8, 18} are sampled, so
that any two positions have a common shift below 21 that makes both sampled.
Sampled triples (of 7-byte words) are ranked, the ranks' triples are ranked
again by recursion, and the remaining positions are merged by their up to 20
bytes before a sampled position.

Minimisers of more than ``HOT`` runs are dealt out: equal runs are combined first,
and where more different ones remain, they are cut into ever shorter ones, keyed
by the bytes that all their windows share, until few meet.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as T
from .common import Written, map_batches
from .substring import runs

LENGTH = 200
GRAM = 64
PERIOD = 21
COVER = np.array([0, 1, 6, 8, 18])
DEEPEST = 8 * PERIOD  # bytes that the ranks of a sampled position cover
HOT = 4096            # different runs of a key that one task may sort together
SORTED = 1 << 20      # bytes sorted at once
_CHUNK = 1 << 17      # windows hashed at once
_PLACE = 18           # bits of a place in a chunk
_PIECE = "k1 long, k2 long, c1 long, c2 long, t long, t2 long, starts array<long>, n int, s int, bytes binary"
_FOUND = "t long, t2 long, starts array<long>, start long, n int"


def _runs(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Runs of windows with one place of their minimiser: (m, t, t2, pos).

    ``pos`` holds the start of the first window, the number of windows (n) and the
    minimiser's place in the first one (s). The least gram counts, the leftmost of equal ones.
    """
    wide = length - gram + 1
    low = np.uint64((1 << _PLACE) - 1)
    assert wide < 1 << 10 and _CHUNK + wide < 1 << _PLACE

    def run(batch):
        k1, k2 = batch.column("t"), batch.column("t2")
        for lo, _, buf, offsets in T.slices(batch.column("text"), 1 << 20):
            for o in range(0, len(buf) - length + 1, _CHUNK):
                part = buf[o:o + _CHUNK + length - 1]
                up, down = T.powers(T._BASE, _CHUNK + length)
                total = np.zeros(len(part) + 1, dtype=np.uint64)
                np.cumsum(T._BYTE[part] * up[:len(part)], out=total[1:])
                grams = T.mix((total[gram:] - total[:-gram]) * down[:len(part) - gram + 1])
                least = T.sliding_min(grams & ~low | np.arange(len(grams), dtype=np.uint64), wide)
                place = (least & low).astype(np.int64)
                # texts that have windows here, and where these begin and end
                first = int(np.searchsorted(offsets, o, side="right")) - 1
                last = int(np.searchsorted(offsets, o + len(place), side="left"))
                begins = np.maximum(offsets[first:last] - o, 0)
                ends = np.minimum(offsets[first + 1:last + 1] - length + 1 - o, len(place))
                some = np.flatnonzero(ends > begins)
                begin = np.union1d(np.flatnonzero(place[1:] != place[:-1]) + 1, begins[some])
                at = np.searchsorted(begins[some], begin, side="right") - 1
                inside = at >= 0
                begin, at = begin[inside], some[at[inside]]
                n = np.minimum(np.append(begin[1:], len(place)), ends[at]) - begin
                use = n > 0
                begin, at, n = begin[use], at[use], n[use]
                row = pa.array(first + at + lo)
                pos = (begin + o - offsets[first + at] << 20) + (n << 10) + place[begin] - begin
                yield {"m": T.signed(grams[place[begin]]), "t": k1.take(row), "t2": k2.take(row), "pos": pos}
    return map_batches(docs, "m long, t long, t2 long, pos long", run)


def _digest(data: bytes, salt: int = 0) -> bytes:
    return hashlib.blake2b(data, digest_size=16, salt=salt.to_bytes(16, "little")).digest()


def _longs(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _cut(texts: DataFrame, length: int) -> DataFrame:
    """The runs of every text with their bytes, keyed by their minimiser; equal ones of a text are one row."""
    def run(batch):
        lists = batch.column("spans")
        edge, flat = lists.offsets.to_numpy(), lists.flatten()
        edge = edge - edge[0]
        pos, m = flat.field("pos").to_numpy(), flat.field("m").to_numpy()
        start, n, s = pos >> 20, pos >> 10 & 1023, pos & 1023
        end = start + n + length - 1
        raw = batch.column("text").cast(pa.binary())
        row, first, starts, keys, data, size = [], [], [], [], [], 0

        def made():
            at, take = np.array(first, dtype=np.int64), pa.array(row, pa.int64())
            c1, c2 = _longs(keys)
            return {"k1": m[at], "k2": np.zeros(len(at), np.int64), "c1": c1, "c2": c2, "t": batch.column("t").take(take),
                    "t2": batch.column("t2").take(take), "starts": pa.array(starts, pa.list_(pa.int64())),
                    "n": n[at], "s": s[at], "bytes": pa.array(data, pa.binary())}

        for i in range(batch.num_rows):
            text, seen = raw[i].as_py(), {}
            lo, hi = int(edge[i]), int(edge[i + 1])
            for k, a, b in zip(range(lo, hi), start[lo:hi].tolist(), end[lo:hi].tolist()):
                piece = text[a:b]
                key = _digest(piece)
                have = seen.get(key)
                if have is None:
                    seen[key] = have = []
                    row.append(i)
                    first.append(k)
                    starts.append(have)
                    keys.append(key)
                    data.append(piece)
                    size += b - a
                have.append(a)
            if size >= 4 * SORTED:
                yield made()
                row, first, starts, keys, data, size = [], [], [], [], [], 0
        if row:
            yield made()
    return map_batches(texts, _PIECE, run)


def _shorter(pieces: DataFrame, length: int, width: int) -> DataFrame:
    """Pieces (t, t2, n, s, bytes) cut to at most ``width`` windows, keyed by the bytes that all of them share.

    Windows with one minimiser belong together only if it has the same place in them.
    """
    def run(batch):
        n, s = (batch.column(k).to_numpy().astype(np.int64) for k in ("n", "s"))
        row, at, many, places, keys, data = [], [], [], [], [], []
        for i, raw in enumerate(batch.column("bytes").to_pylist()):
            for block in range((int(s[i]) - int(n[i]) + 1) // width, int(s[i]) // width + 1):
                a = max(int(s[i]) - (block + 1) * width + 1, 0)
                b = min(int(s[i]) - block * width + 1, int(n[i]))
                core = int(s[i]) - block * width  # the last window that the block can have
                row.append(i)
                at.append([a])
                many.append(b - a)
                places.append(int(s[i]) - a)
                keys.append(_digest(raw[core:core - width + 1 + length], block + 1))
                data.append(raw[a:b + length - 1])
        k1, k2 = _longs(keys)
        c1, c2 = _longs([_digest(x) for x in data])
        take = pa.array(row, pa.int64())
        yield {"k1": k1, "k2": k2, "c1": c1, "c2": c2, "t": batch.column("t").take(take),
               "t2": batch.column("t2").take(take), "starts": pa.array(at, pa.list_(pa.int64())), "n": many, "s": places,
               "bytes": pa.array(data, pa.binary())}
    return map_batches(pieces.select("t", "t2", "n", "s", "bytes"), _PIECE, run)


def _rank(*columns: np.ndarray) -> np.ndarray:
    """Ranks from 0 of the distinct rows, in their order."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), dtype=bool)
    for c in columns:
        c = c[order]
        new[1:] |= c[1:] != c[:-1]
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(new)
    return out


def repeated_starts(pieces: list[bytes], length: int = LENGTH) -> np.ndarray:
    """Whether the string at every byte of the joined pieces starts elsewhere in them, too.

    A string lies within one piece. ``length`` must be at least 188.
    """
    before, after = PERIOD - 1, length - DEEPEST
    assert after >= before
    size = np.array([len(x) for x in pieces])
    buf = np.frombuffer(b"".join([b"\0" * before, *pieces, b"\0" * length]), dtype=np.uint8)
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    left = np.repeat(size, size) - place
    repeated = np.zeros(len(place), dtype=bool)
    words = np.zeros(len(place) + PERIOD, dtype=np.int64)  # of 7 bytes
    for k in range(7):
        words = words << 8 | buf[before + k:before + k + len(words)]
    sampled = np.isin(np.arange(PERIOD), COVER)[place % PERIOD]
    p = np.flatnonzero(sampled & (left >= PERIOD))
    of = np.empty(len(place), dtype=np.int64)  # where a position's rank is
    of[p] = np.arange(len(p))
    one = _rank(words[p], words[p + 7], words[p + 14])
    p = p[left[p] >= 3 * PERIOD]
    of_three = np.empty(len(place), dtype=np.int64)
    of_three[p] = np.arange(len(p))
    three = _rank(*(one[of[p + k * PERIOD]] for k in range(3)))
    p = p[left[p] >= length - before]
    deep = _rank(three[of_three[p]], three[of_three[p + 3 * PERIOD]], one[of[p + 6 * PERIOD]], one[of[p + 7 * PERIOD]])
    met = np.bincount(deep, minlength=1)[deep] > 1
    p, deep = p[met], deep[met]
    if not len(p):
        return repeated

    def ordered(columns, bytes_of):
        """Sorted order of the positions and how many bytes each shares with the one before."""
        n = columns.shape[1]
        x = np.zeros((len(p), -(-n // 8) * 8), dtype=np.uint8)
        x[:, :n] = columns
        order = np.lexsort([*x.view(">u8").T[::-1].astype(np.uint64), *bytes_of])
        x = x[order, :n]
        differ = x[1:] != x[:-1]
        agree = np.where(differ.any(axis=1), differ.argmax(axis=1), n)
        for c in bytes_of:
            agree[c[order[1:]] != c[order[:-1]]] = -1
        return order, agree

    view = np.lib.stride_tricks.sliding_window_view
    right, r_agree = ordered(view(buf, after)[p + before + DEEPEST], [deep])
    back, b_agree = ordered(view(buf, before)[p][:, ::-1], [])
    a, b = np.empty(len(p), dtype=np.int64), np.empty(len(p), dtype=np.int64)
    for shift in range(PERIOD):
        a[right] = np.append(0, np.cumsum(r_agree < after - shift))
        b[back] = np.append(0, np.cumsum(b_agree < shift))
        use = np.flatnonzero((place[p] >= shift) & (left[p] + shift >= length))
        _, inverse, count = np.unique(a[use] * len(p) + b[use], return_inverse=True, return_counts=True)
        repeated[p[use[count[inverse] > 1]] - shift] = True
    return repeated


def _sorted(pieces: DataFrame, length: int) -> DataFrame:
    """(t, t2, starts, start, n): windows of the pieces that others of the same key have, too.

    ``start`` is the first window's place in the piece, which begins at each of ``starts``.
    """
    columns = ["k1", "k2", "c1", "c2"]
    schema = pa.schema([("t", pa.int64()), ("t2", pa.int64()), ("starts", pa.list_(pa.int64())),
                        ("start", pa.int64()), ("n", pa.int32())])

    def solve(rows: pa.Table) -> pa.RecordBatch:
        key = np.stack([rows[c].to_numpy() for c in columns])
        new_key, new = (np.append(True, (key[:k, 1:] != key[:k, :-1]).any(axis=0)) for k in (2, 4))
        own = np.cumsum(new) - 1                                    # the distinct piece of a row
        group = (np.cumsum(new_key) - 1)[new]                       # the key of a distinct piece
        places = np.diff(rows["starts"].combine_chunks().offsets.to_numpy())
        first, owners = np.flatnonzero(new), np.bincount(own, weights=places)
        n = rows["n"].to_numpy().astype(np.int64)[first]
        several = np.flatnonzero(np.bincount(group)[group] > 1)     # pieces that meet different ones
        data = rows["bytes"].take(pa.array(first[several])).to_pylist()
        hit = repeated_starts(data, length) if data else np.zeros(0, dtype=bool)
        end = np.cumsum([len(x) for x in data]).astype(np.int64)
        a, b = runs(hit, np.zeros(len(hit)))                        # no string begins near the end of a piece
        at = np.searchsorted(end, a, side="right")
        once = owners[several[at]] == 1
        a, b, at = a[once], b[once], at[once]
        whole = np.flatnonzero(owners[own] > 1)
        piece = np.concatenate([first[several[at]], whole])
        start = np.concatenate([a - np.append(0, end)[at], np.zeros(len(whole), np.int64)])
        many = np.concatenate([b - a, n[own[whole]]])
        return pa.RecordBatch.from_arrays(
            [pa.array(rows["t"].to_numpy()[piece]), pa.array(rows["t2"].to_numpy()[piece]),
             rows["starts"].combine_chunks().take(pa.array(piece)), pa.array(start), pa.array(many, pa.int32())], schema=schema)

    def keys(rows: pa.Table) -> list[slice]:
        """Whole keys of about SORTED bytes together."""
        key = np.stack([rows[c].to_numpy() for c in columns[:2]])
        first = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0)))
        total = np.cumsum(rows["n"].to_numpy().astype(np.int64) + length - 1)[first]
        edge = np.append(first[np.diff(total // SORTED, prepend=-1) > 0], rows.num_rows).tolist()
        return [slice(a, b) for a, b in zip(edge[:-1], edge[1:])]

    def run(batches):
        held: list = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.column("bytes").nbytes
            if size >= 2 * SORTED:
                rows = pa.Table.from_batches(held)
                *full, rest = keys(rows)
                for x in full:
                    yield solve(rows.slice(x.start, x.stop - x.start))
                held = rows.slice(rest.start).combine_chunks().to_batches()
                size = sum(x.column("bytes").nbytes for x in held)
        if size:
            rows = pa.Table.from_batches(held)
            for x in keys(rows):
                yield solve(rows.slice(x.start, x.stop - x.start))

    return (pieces.select(*columns, "t", "t2", "starts", "n", "bytes").repartition("k1", "k2").sortWithinPartitions(*columns)
            .mapInArrow(run, _FOUND))


def _dealt(pieces: DataFrame, length: int, width: int, hot: int, scratch: Written) -> DataFrame:
    """``_sorted`` for keys of any number of pieces. ``pieces`` (stored) have at most ``width`` windows."""
    first = [F.first(c).alias(c) for c in ("n", "s", "bytes")]
    different = scratch.put(pieces.groupBy("k1", "k2", "c1", "c2").agg(F.sum(F.size("starts")).alias("owners"), *first),
                            f"different-{width}")
    crowd = different.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("d")).filter("d > 1")
    met = different.join(crowd, ["k1", "k2"]).withColumns(
        {"t": F.col("c1"), "t2": F.col("c2"), "starts": F.array(F.lit(0).cast("long"))})
    found = _sorted(met.filter(F.col("d") <= hot), length)
    many = met.filter(F.col("d") > hot)
    if width > 1 and not many.isEmpty():
        width = -(-width // 4)
        shorter = scratch.put(_shorter(many, length, width), f"shorter-{width}")
        found = found.union(_dealt(shorter, length, width, hot, scratch))
    inside = found.select("t", "t2", F.explode(F.transform("starts", lambda x: x + F.col("start"))).alias("start"), "n")
    several = different.filter("owners > 1").select("c1", "c2", F.lit(0).cast("long"), "n")
    ranges = inside.union(several).groupBy(F.col("t").alias("c1"), F.col("t2").alias("c2")).agg(
        F.collect_set(F.struct("start", "n")).alias("ranges"))
    return (pieces.select("c1", "c2", "t", "t2", "starts").join(ranges, ["c1", "c2"])
            .select("t", "t2", "starts", F.inline("ranges")))


def _repeated(texts: DataFrame, length: int, gram: int, hot: int, scratch: Written) -> DataFrame:
    """Found windows (as of ``_sorted``) that start elsewhere, too. ``texts`` (stored): t, t2, text, spans."""
    def only(choose):
        return texts.withColumn("spans", F.filter("spans", choose)).filter(F.size("spans") > 0)

    found = _sorted(_cut(only(lambda x: x["size"] <= hot), length), length)
    crowded = only(lambda x: x["size"] > hot)
    if not crowded.isEmpty():
        found = found.union(_dealt(scratch.put(_cut(crowded, length), "crowded"), length, length - gram + 1, hot, scratch))
    return found


def deduplicate(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, scratch: Written | None = None,
                with_bytes: bool = False, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes) per document.

    A byte goes if a ``length``-byte string over it starts anywhere else too,
    in the same document or another. Null and empty texts have no byte.
    Equal texts are sorted once; all of their strings occur elsewhere. Rows
    that repeat a doc_id stay rows of their own; extra columns are ignored.
    """
    scratch = scratch or Written(docs.sparkSession, "suffix")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "t", F.xxhash64("text")).withColumn("t2", F.xxhash64(F.lit(7), "text"))
    texts = rows.select("text", "t", "t2")
    shared = (_runs(texts, length, gram).repartition("m")
              .withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("m"))).filter("c > 1"))
    spans = (shared.groupBy("m", "t", "t2", "pos").agg(F.first("c").alias("size"))
             .groupBy("t", "t2").agg(F.collect_list(F.struct("m", "pos", "size")).alias("spans")))
    # one row of each text: equal rows of a task are combined before the shuffle
    one = texts.groupBy("t", "t2").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    met = scratch.put(one.join(spans, ["t", "t2"]), "texts")
    found = _repeated(met, length, gram, hot, scratch)
    per = found.groupBy("t", "t2").agg(F.collect_list(F.struct("starts", "start", "n")).alias("hits"))
    source = met.drop("spans").join(per, ["t", "t2"], "left").filter("copies > 1 or hits is not null")

    def finish(batch):
        lists = batch.column("hits")
        edge, flat = lists.offsets.to_numpy(), lists.flatten()
        edge = edge - edge[0]
        places = flat.field("starts")
        times = np.diff(places.offsets.to_numpy())
        edge = np.append(0, np.cumsum(times))[edge]
        start = places.flatten().to_numpy() + np.repeat(flat.field("start").to_numpy(), times)
        n = np.repeat(flat.field("n").to_numpy(), times)
        copied = batch.column("copies").to_numpy() > 1
        out = {k: [] for k in ("n_removed", "n_spans", "kept_sha256", "kept")}
        for i, text in enumerate(batch.column("text").cast(pa.binary())):
            b = np.frombuffer(text.as_py(), dtype=np.uint8)
            steps = np.zeros(len(b) + 1, dtype=np.int64)
            here = slice(int(edge[i]), int(edge[i + 1]))
            np.add.at(steps, start[here], 1)
            np.add.at(steps, start[here] + n[here] + length - 1, -1)
            gone = np.cumsum(steps)[:-1] > 0
            if copied[i]:
                gone[:] = len(b) >= length
            kept = b[~gone].tobytes()
            out["n_removed"].append(int(gone.sum()))
            out["n_spans"].append(len(runs(gone, np.zeros(len(b)))[0]) if len(b) else 0)
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept"].append(kept)
        if not with_bytes:
            del out["kept"]
        return {"t": batch.column("t"), "t2": batch.column("t2"), **out}

    changed = map_batches(source, "t long, t2 long, n_removed long, n_spans long, kept_sha256 string"
                          + ", kept binary" * with_bytes, finish)
    raw = F.col("text").cast("binary")
    # texts without a repeated string stay as they are and need not travel
    plain = rows.select("doc_id", "t", "t2", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("sha"),
                        *[raw.alias("raw")] * with_bytes)
    zero = F.lit(0).cast("long")
    return plain.join(changed, ["t", "t2"], "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"), *[F.coalesce("kept", "raw").alias("kept")] * with_bytes)

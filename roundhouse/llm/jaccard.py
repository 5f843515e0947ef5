"""Exact Jaccard self-join of word-shingle sets by partitioning the universe.

Sets within a size band hash their shingles into the band's segments. Two sets
with Jaccard similarity >= 0.8 differ in at most H shingles, so if a set's
segments are given one unit each for an equal segment subset and one more for
a subset within one deletion, and the units reach H + 1, some segment must
match within its allowance. Which segments get units is chosen by cost:
subsets with few shingles are common and taken last, one-deletion
neighbourhoods are indexed on every ``DELETIONS``-th segment only and used
where they are cheaper. Candidates pass an exact-safe parity sketch and are
then verified on the whole sets.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import Written, components, map_batches

SHINGLE = 5
BAND = 1.5        # upper to lower size of a band
SLACK = 1.12      # segments over the needed H + 1
DELETIONS = 32    # every so-manieth segment also indexes its one-deletion neighbourhood
SMALL_BUCKET = 8  # buckets up to this size pair directly, larger ones around a centre first
GROUP = 256       # partners of a centre that are verified in one task
FIRST_KEYS = 16   # smallest keys a set carries, so that a pair is made once and not in every bucket it shares
SKETCH = 8        # 64-bit words of the parity sketch
SID_BITS = 40


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, n: int = SHINGLE):
    """(sorted distinct shingle hashes of all texts, first one of each text)."""
    words, first, _, _ = T.word_hashes(buf, offsets, lower=True)
    count = np.diff(first)
    grams = T.windows_hash(words, n)
    doc = np.repeat(np.arange(len(count)), count)
    whole = np.arange(len(grams)) + n <= first[doc[:len(grams)] + 1]
    grams, gram_doc = grams[whole], doc[:len(grams)][whole]
    short = np.flatnonzero((count > 0) & (count < n))  # the whole sequence as one
    if len(short):
        one = count[short].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        for j in range(n - 1):
            has = count[short] > j
            one[has] += words[first[short[has]] + j] * np.uint64(pow(0x9FB21C651E98DF25, j + 1, 1 << 64))
        grams, gram_doc = np.concatenate([grams, T.mix(one)]), np.concatenate([gram_doc, short])
        order = np.argsort(gram_doc, kind="stable")
        grams, gram_doc = grams[order], gram_doc[order]
    start = np.searchsorted(gram_doc, np.arange(len(count) + 1))
    for a, b in zip(start[:-1].tolist(), start[1:].tolist()):
        grams[a:b].sort()
    new = np.ones(len(grams), dtype=bool)
    new[1:] = (grams[1:] != grams[:-1]) | (gram_doc[1:] != gram_doc[:-1])
    return grams[new], np.concatenate([[0], np.cumsum(new)])[start]


def _sums(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values, out=total[1:])
    return total[start[1:]] - total[start[:-1]]


def identities(grams: np.ndarray, start: np.ndarray):
    """Two independent 64-bit digests of every set."""
    return _sums(T.mix(grams), start), T.mix(_sums(T.mix(grams ^ np.uint64(0xA5A5A5A55A5A5A5A)), start))


def sketches(grams: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Parity of the shingles per bit: two sets differ in at least as many shingles as bits."""
    bits = 64 * SKETCH
    doc = np.repeat(np.arange(len(start) - 1), np.diff(start))
    at = doc * bits + (T.mix(grams) >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)
    odd = (np.bincount(at, minlength=(len(start) - 1) * bits) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(-1, bits), axis=1).view(np.int64)


def band_of(size: np.ndarray) -> np.ndarray:
    """Index of the size band: band k ends at ``band_end(k)``."""
    return np.searchsorted(_ENDS, size)


def _ends() -> np.ndarray:
    out = [4]
    while out[-1] < 1 << 40:
        out.append(int(out[-1] * BAND) + 1)
    return np.array(out, dtype=np.int64)


_ENDS = _ends()


def segments_of(end: np.ndarray) -> np.ndarray:
    """Number of segments of a band with sizes up to ``end``."""
    most = 2 * end // 9  # the largest difference of two linked sets
    return np.where(most == 0, 1, np.ceil(SLACK * (most + 1)).astype(np.int64) + 1)


# cost per unit: an equal subset by its number of shingles, a one-deletion neighbourhood
_EQUAL = np.array([90, 60, 6, 2, 1], dtype=np.int64)
_DELETED = np.array([99, 95, 70, 12, 8], dtype=np.int64)


def signatures(grams: np.ndarray, start: np.ndarray, band: np.ndarray, partner: np.ndarray, index: bool):
    """(set index, key) of all signatures under each set's given band.

    ``partner`` is the largest size a partner may have there. With ``index``
    every segment is emitted (and some neighbourhoods), marked in the lowest
    bit if the allocation also probes it; else only what the set probes.
    """
    size = np.diff(start)
    m = segments_of(_ENDS[band])
    base = np.concatenate([[0], np.cumsum(m)])
    doc = np.repeat(np.arange(len(size)), size)
    # shingles are sorted, so segments cut by the leading bits are contiguous
    seg = base[doc] + (((grams >> np.uint64(32)) * m[doc].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
    count = np.bincount(seg, minlength=base[-1])
    edge = np.concatenate([[0], np.cumsum(count)])
    token = T.mix(grams ^ np.uint64(0x3C6EF372FE94F82B))
    total = _sums(token, edge)
    owner = np.repeat(np.arange(len(size)), m)
    local = np.arange(base[-1]) - base[owner]
    place = T.mix(local.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                  + band[owner].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    # units by cost until H + 1
    deletable = local % DELETIONS == 0
    c = np.minimum(count, 4)
    unit_seg = np.concatenate([np.arange(base[-1]), np.flatnonzero(deletable)])
    cost = np.concatenate([_EQUAL[c], _DELETED[c[deletable]]])
    order = np.argsort(owner[unit_seg] * 128 + cost, kind="stable")
    need = (size + partner) // 9 + 1
    per = np.bincount(owner[unit_seg], minlength=len(size))
    rank = np.arange(len(order)) - np.repeat(np.cumsum(per) - per, per)
    taken = np.zeros(len(order), dtype=bool)
    taken[order] = rank < need[owner[unit_seg[order]]]
    equal, near = taken[:base[-1]], np.zeros(base[-1], dtype=bool)
    near[deletable] = taken[base[-1]:]
    at_token = np.flatnonzero(near[seg]) if not index else np.flatnonzero(deletable[seg])
    e_key = T.mix(total + place)
    d_key = T.mix(total[seg[at_token]] - token[at_token] + place[seg[at_token]])
    deleted = np.uint64(0xFF51AFD7ED558CCD)  # the key space of the neighbourhoods
    one = np.uint64(1)
    if index:
        probing = near[seg[at_token]]
        sets = [owner, owner[seg[at_token]], owner[seg[at_token[probing]]], owner[near]]
        keys = [e_key & ~one | equal.astype(np.uint64),
                T.mix(d_key ^ deleted) & ~one,             # found by a partner without that shingle
                d_key[probing] | one,                      # finds a partner without that shingle
                T.mix(e_key[near] ^ deleted) | one]        # finds a partner with one shingle more
    else:
        sets = [owner[equal], owner[seg[at_token]], owner[near]]
        keys = [e_key[equal] | one, d_key | one, T.mix(e_key[near] ^ deleted) | one]
    return np.concatenate(sets), np.concatenate(keys)


def _sid(digest: np.ndarray) -> np.ndarray:
    return (digest >> np.uint64(64 - SID_BITS)).astype(np.int64)


def describe(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n, s1, s2, sid and the sketch of every document."""
    def run(batch):
        docid = batch.column("doc_id")
        for lo, hi, buf, offsets in T.slices(batch.column("text")):
            grams, start = shingle_sets(buf, offsets, shingle)
            s1, s2 = identities(grams, start)
            k = sketches(grams, start)
            yield {"doc_id": docid.slice(lo, hi - lo), "n": np.diff(start), "s1": T.signed(s1),
                   "s2": T.signed(s2), "sid": _sid(s1), **{f"k{i}": k[:, i] for i in range(SKETCH)}}
    return map_batches(docs, "doc_id long, n long, s1 long, s2 long, sid long, "
                       + ", ".join(f"k{i} long" for i in range(SKETCH)), run)


def _signature_rows(docs: DataFrame, shingle: int) -> DataFrame:
    """key, sid of each distinct set of a task: copies are combined before the shuffle."""
    schema = pa.schema([("key", pa.int64()), ("sid", pa.int64())])

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            for lo, hi, buf, offsets in T.slices(batch.column("text"), 2 << 20):
                grams, start = shingle_sets(buf, offsets, shingle)
                s1, s2 = identities(grams, start)
                both = np.column_stack([s1, s2])
                fresh = np.zeros(hi - lo, dtype=bool)
                for i in np.flatnonzero(np.diff(start)).tolist():
                    name = both[i].tobytes()
                    if name not in seen:
                        seen.add(name)
                        fresh[i] = True
                size = np.diff(start)
                grams, size = grams[np.repeat(fresh, size)], size[fresh]
                begin = np.concatenate([[0], np.cumsum(size)])
                sid = _sid(s1[fresh])
                band = band_of(size)
                most = size * 5 // 4
                own = signatures(grams, begin, band, np.minimum(most, _ENDS[band]), True)
                wide = np.flatnonzero(most > _ENDS[band])  # partners may lie in the next band
                inner = np.repeat(most > _ENDS[band], size)
                up = signatures(grams[inner], np.concatenate([[0], np.cumsum(size[wide])]),
                                band[wide] + 1, most[wide], False)
                for sets, keys in ((sid[own[0]], own[1]), (sid[wide][up[0]], up[1])):
                    for a in range(0, len(keys), 1 << 18):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(T.signed(keys[a:a + (1 << 18)])), pa.array(sets[a:a + (1 << 18)])],
                            schema=schema)
    return docs.select("text").mapInArrow(run, "key long, sid long")


def _buckets(rows: DataFrame, small: int = SMALL_BUCKET) -> DataFrame:
    """Pairs of every bucket: key (null in small buckets), a, b.

    Small buckets pair every prober with every member at once; larger ones
    pair their smallest member with the others and keep their key, so that
    the rest can be resolved later. Rows arrive sorted, so a bucket of any
    size streams through with only its centre held.
    """
    schema = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("probe", pa.bool_()),
                        ("centre_probe", pa.bool_())])

    def batch_of(key, a, b, p, q):
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) if not isinstance(x, pa.Array) else x
                                           for x, f in zip((key, a, b, p, q), schema)], schema=schema)

    def run(batches):
        held_k, held_s, held_p = [], [], []
        rows_held = 0
        carry = None  # (key, centre, its flag, last member) of a large bucket that goes on

        def solve(k, s, p, last):
            nonlocal carry
            new = np.ones(len(k), dtype=bool)
            new[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
            begin = np.flatnonzero(new)
            p = np.logical_or.reduceat(p, begin)
            k, s = k[begin], s[begin]
            out = []
            if carry is not None:
                on = np.searchsorted(k, carry[0], side="right")
                if on:
                    keep = s[:on] != carry[3]
                    out.append(batch_of(k[:on][keep], np.full(keep.sum(), carry[1]), s[:on][keep], p[:on][keep],
                                        np.full(keep.sum(), carry[2])))
                    if on == len(k) and not last:
                        carry = (*carry[:3], s[-1])
                        return out
                    k, s, p = k[on:], s[on:], p[on:]
                carry = None
            if not len(k):
                return out
            first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            size = np.diff(np.append(first, len(k)))
            probed = np.logical_or.reduceat(p, first)
            goes_on = np.zeros(len(first), dtype=bool)
            if not last:
                goes_on[-1] = True
                carry = (k[first[-1]], s[first[-1]], p[first[-1]], s[-1])
            for g in range(2, small + 1):
                at = first[(size == g) & probed & ~goes_on]
                for i in range(g):
                    for j in range(i + 1, g):
                        use = at[p[at + i] | p[at + j]]
                        out.append((s[use + i], s[use + j]))
            pairs = [x for x in out if isinstance(x, tuple)]
            out = [x for x in out if not isinstance(x, tuple)]
            if pairs:
                a, b = (np.concatenate(x) for x in zip(*pairs))
                order = np.lexsort((b, a))
                a, b = a[order], b[order]
                one = np.ones(len(a), dtype=bool)
                one[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
                a, b = a[one], b[one]
                yes = np.ones(len(a), dtype=bool)
                out.append(batch_of(pa.nulls(len(a), pa.int64()), a, b, yes, yes))
            big = ((size > small) & probed) | goes_on
            centre = np.repeat(first, size)
            use = np.flatnonzero(np.repeat(big, size) & (np.arange(len(k)) != centre))
            out.append(batch_of(k[use], s[centre[use]], s[use], p[use], p[centre[use]]))
            return out

        for batch in batches:
            key = batch.column("key").to_numpy()
            held_k.append(key >> 1)
            held_p.append((key & 1).astype(bool))
            held_s.append(batch.column("sid").to_numpy())
            rows_held += len(key)
            if rows_held >= 400_000:
                k, s, p = np.concatenate(held_k), np.concatenate(held_s), np.concatenate(held_p)
                cut = int(np.searchsorted(k, k[-1]))
                if cut == 0:  # one bucket fills the buffer: it streams
                    yield from solve(k, s, p, False)
                    held_k, held_s, held_p, rows_held = [], [], [], 0
                else:
                    yield from solve(k[:cut], s[:cut], p[:cut], True)
                    held_k, held_s, held_p = [k[cut:]], [s[cut:]], [p[cut:]]
                    rows_held = len(k) - cut
        if rows_held:
            yield from solve(np.concatenate(held_k), np.concatenate(held_s), np.concatenate(held_p), True)

    bucket = F.shiftright("key", 1)
    dealt = rows.repartition(bucket).sortWithinPartitions(bucket, "sid")
    return dealt.mapInArrow(run, "key long, a long, b long, probe boolean, centre_probe boolean")


def _possible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Node pairs (a, b, na, nb) of set pairs that sizes and sketches allow."""
    cols = ["sid", "node", "n"] + [f"k{i}" for i in range(SKETCH)]
    left = sets.select(*[F.col(c).alias(f"l_{c}") for c in cols])
    right = sets.select(*[F.col(c).alias(f"r_{c}") for c in cols])
    differ = sum((F.bit_count(F.col(f"l_k{i}").bitwiseXOR(F.col(f"r_k{i}"))) for i in range(1, SKETCH)),
                 F.bit_count(F.col("l_k0").bitwiseXOR(F.col("r_k0"))))
    both = pairs.join(left, pairs["a"] == left["l_sid"]).join(right, pairs["b"] == right["r_sid"])
    return (both.withColumn("maybe", (differ <= F.floor((F.col("l_n") + F.col("r_n")) / 9))
                            & (F.col("l_node") != F.col("r_node")))
            .select("a", "b", F.col("l_node").alias("node_a"), F.col("r_node").alias("node_b"), "maybe"))


def _open_pairs(pairs: DataFrame, first: DataFrame, sets: DataFrame, comp: DataFrame, scratch: Written,
                carried: int = FIRST_KEYS) -> DataFrame:
    """Distinct node pairs (a, b) of different classes that large buckets still hold and sketches allow.

    Sets that are similar but not linked share most of their buckets, so a
    pair would be made once per shared bucket. Each set carries the
    ``carried`` smallest of the open keys it probes: a bucket leaves a pair out
    if both carry the same smaller key, whose bucket makes it. The pair's
    smallest shared key is never left out, so no pair is lost.
    """
    classes = comp.select(F.col("id").alias("node"), "component_id")
    of = lambda side: classes.select(F.col("node").alias(f"node_{side}"),
                                     F.col("component_id").alias(f"class_{side}"))
    open_pairs = (first.join(of("a"), "node_a", "left").join(of("b"), "node_b", "left")
                  .filter(F.coalesce("class_a", "node_a") != F.coalesce("class_b", "node_b"))
                  .select("a", "b").distinct())
    large = pairs.filter("key is not null")
    open_keys = large.join(open_pairs, ["a", "b"], "left_semi").select("key").distinct()
    rest = large.join(open_keys, "key", "left_semi")
    members = scratch.put(
        rest.select("key", F.col("b").alias("sid"), "probe")
        .unionByName(rest.select("key", F.col("a").alias("sid"), F.col("centre_probe").alias("probe")))
        .groupBy("key", "sid").agg(F.max("probe").alias("probe")), "members")
    told = members.groupBy("sid").agg(F.slice(F.array_sort(F.collect_list(F.when(F.col("probe"), F.col("key")))),
                                              1, carried).alias("early"))
    told = (sets.join(told, "sid").join(classes, "node", "left")
            .withColumn("component_id", F.coalesce("component_id", "node")))
    wide = scratch.put(members.join(told, "sid"), "open")
    cols = ["key", "probe", "early", "component_id", "node", "n"] + [f"k{i}" for i in range(SKETCH)]
    x, y = (wide.select(*[F.col(c).alias(f"{p}_{c}") for c in cols]) for p in "xy")
    differ = sum((F.bit_count(F.col(f"x_k{i}").bitwiseXOR(F.col(f"y_k{i}"))) for i in range(1, SKETCH)),
                 F.bit_count(F.col("x_k0").bitwiseXOR(F.col("y_k0"))))
    made_before = F.coalesce(F.array_min(F.array_intersect("x_early", "y_early")) < F.col("x_key"), F.lit(False))
    made = x.join(y, (F.col("x_key") == F.col("y_key")) & (F.col("x_node") < F.col("y_node"))
                  & (F.col("x_probe") | F.col("y_probe")) & (F.col("x_component_id") != F.col("y_component_id"))
                  & (5 * F.col("x_n") >= 4 * F.col("y_n")) & (5 * F.col("y_n") >= 4 * F.col("x_n"))
                  & (differ <= F.floor((F.col("x_n") + F.col("y_n")) / 9)) & ~made_before)
    return made.select(F.col("x_node").alias("a"), F.col("y_node").alias("b")).distinct()


def verify(pairs: DataFrame, docs: DataFrame, shingle: int = SHINGLE, group: int = GROUP) -> DataFrame:
    """Those of the distinct node pairs (a, b) whose whole sets have Jaccard >= 0.8.

    Partners of a centre are dealt into groups of about ``group``; the
    centre's text travels once to each of them.
    """
    many = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("c"))
    dealt = pairs.join(many, "a").select(
        "a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("c") / group)).cast("int").alias("g"))
    need = (dealt.select("a", "g", F.col("b").alias("node"))
            .unionByName(dealt.select("a", "g", F.col("a").alias("node")).distinct()))
    rows = need.join(docs.select(F.col("doc_id").alias("node"), "text"), "node")

    def check(pdf: pd.DataFrame) -> pd.DataFrame:
        a = int(pdf["a"].iloc[0])
        found = []
        centres, others = pdf[pdf["node"] == a], pdf[pdf["node"] != a]
        sets = []
        for x in centres["text"]:
            for _, _, buf, offsets in T.slices(pa.array([x], pa.large_string())):
                sets.append(shingle_sets(buf, offsets, shingle)[0])
        node = others["node"].to_numpy()
        for lo, hi, buf, offsets in T.slices(pa.array(others["text"], pa.large_string())):
            grams, start = shingle_sets(buf, offsets, shingle)
            size = np.diff(start)
            for s in sets:
                if not len(s):
                    continue
                at = np.minimum(np.searchsorted(s, grams), len(s) - 1)
                hit = np.concatenate([[0], np.cumsum(s[at] == grams)])
                same = hit[start[1:]] - hit[start[:-1]]
                found.append(node[lo:hi][(9 * same >= 4 * (size + len(s))) & (size > 0)])
        b = np.unique(np.concatenate(found)) if found else np.empty(0, dtype=np.int64)
        return pd.DataFrame({"a": np.full(len(b), a), "b": b})

    return rows.groupBy("a", "g").applyInPandas(check, "a long, b long").distinct()


def similar_components(docs: DataFrame, shingle: int = SHINGLE, scratch: Written | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id per document: classes linked by Jaccard >= 0.8.

    Null and empty texts have no shingle and link with nothing. Copies (equal
    sets) are one node under their smallest doc_id. Rows that repeat a doc_id
    are one document in the graph (each keeps its own row); a null doc_id
    counts as the largest and comes back null. Extra columns are ignored.
    """
    spark = docs.sparkSession
    scratch = scratch or Written(spark, "jaccard")
    last = (1 << 63) - 1
    docs = docs.select(F.coalesce("doc_id", F.lit(last)).cast("long").alias("doc_id"), "text")
    told = scratch.put(describe(docs, shingle), "documents")
    keep = ["sid", *[f"k{i}" for i in range(SKETCH)]]
    sets = scratch.put(told.filter("n > 0").groupBy("n", "s1", "s2")
                       .agg(F.min("doc_id").alias("node"), *[F.min(c).alias(c) for c in keep]), "sets")
    pairs = scratch.put(_buckets(_signature_rows(docs, shingle)), "buckets")
    # different sets of one sid are candidates as well
    clash = sets.groupBy("sid").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(
        F.col("sid").alias("a"), F.col("sid").alias("b"))
    first = scratch.put(_possible(pairs.select("a", "b").distinct().union(clash), sets), "possible")
    ordered = lambda df: df.select(F.least("node_a", "node_b").alias("a"),
                                   F.greatest("node_a", "node_b").alias("b")).distinct()
    tested = ordered(first.filter("maybe"))
    links = scratch.put(verify(tested, docs, shingle), "links")
    # sets of one doc_id are one document
    per = (told.filter("n > 0").join(sets.select("n", "s1", "s2", "node"), ["n", "s1", "s2"])
           .select("doc_id", "node"))
    same = per.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("m")).filter("a <> m")
    same = same.join(per, "doc_id").filter("node <> a").select("a", F.col("node").alias("b"))
    links = links.unionByName(same)
    comp = components(links, scratch, "near")
    second = scratch.put(_open_pairs(pairs, first, sets, comp, scratch).join(tested, ["a", "b"], "left_anti"), "second")
    if not second.isEmpty():
        more = scratch.put(verify(second, docs, shingle), "more")
        comp = components(links.unionByName(more), scratch, "all")
    node = sets.select("n", "s1", "s2", "node").join(comp.withColumnRenamed("id", "node"), "node", "left") \
        .select("n", "s1", "s2", F.coalesce("component_id", "node").alias("component_id"))
    out = told.select("doc_id", "n", "s1", "s2").join(node, ["n", "s1", "s2"], "left")
    return out.select(F.nullif("doc_id", F.lit(last)).alias("doc_id"), F.col("n").alias("n_shingles"),
                      F.nullif(F.coalesce("component_id", "doc_id"), F.lit(last)).alias("component_id"))

"""Spelling variants: words one edit apart, found through pivotal grams.

Two words within one edit of each other agree outside the edited place. Of any
two disjoint bigrams of a word an edit leaves one as it is, so:

* bigrams are ordered by how many words hold them, rarest first;
* a word's *prefix* is its three rarest bigrams (and what ties with the third);
  its *pivots* are the two disjoint bigrams of the prefix that are rarest
  together, chosen by dynamic programming;
* of two words within one edit, a pivot of the one whose prefix ends earlier in
  the order lies in the prefix of the other one;
* position limit: the edit lies on one side of the surviving pivot, so that on
  the other side the words are equal up to their start (the pivot stands at the
  same place) or up to their end (at the same place from there). Index and
  probes are keyed by exactly that: the side, the equal part, the length.

Candidates are verified by the edit distance itself.
"""

from __future__ import annotations

import math
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import Written, map_batches

LETTERS = "A-Za-zÀ-ÿ"
MIN_LENGTH = 7
MIN_COUNT = 2
RATIO = 10          # a form is at least this many times as frequent as its word
PREFIX = 3          # bigrams: width * edits + 1
SHORT = 5           # code points; a shorter equal part is not selective enough as a key
BUCKETS = 1 << 16   # classes of bigrams; the table of their counts has at most so many rows
_BASE = 0xC2B2AE3D27D4EB4F | 1


def count_words(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT,
                delete_every: int | None = None) -> DataFrame:
    """(word, n): letter runs of whole texts, A-Z lower-cased, with their occurrences.

    ``delete_every`` plants misspellings: where it divides the crc32 of
    ``<doc_id>:<run>``, the run loses its code point crc32 % length. Null texts
    have no words; runs of rows without a doc_id stay as they are. Repeated rows
    count as often as they occur.
    """
    runs = docs.select("doc_id", F.explode(
        F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0))).alias("run"))
    plain = F.octet_length("run") == F.length("run")
    low = F.when(plain, F.lower("run")).otherwise(
        F.translate("run", string.ascii_uppercase, string.ascii_lowercase))
    runs = runs.select("doc_id", low.alias("word"))
    if delete_every:
        h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("word")).cast("binary"))
        at = F.pmod("_h", F.length("word")).cast("int")
        cut = F.concat(F.substr("word", F.lit(1), at), F.substr("word", at + 2))
        runs = runs.withColumn("_h", h).select(
            F.when(F.pmod("_h", F.lit(delete_every)) == 0, cut).otherwise(F.col("word")).alias("word"))
    return (runs.filter(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") >= min_count))


def _codes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words one after another, and where each word begins."""
    codes = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), dtype=np.uint32)
    size = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    return codes, np.concatenate([[0], np.cumsum(size)]).astype(np.int64)


def _grams(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, place of the first code point, index of the word) of every bigram."""
    size = np.diff(offsets)
    many = np.maximum(size - 1, 0)
    word = np.repeat(np.arange(len(size)), many)
    place = np.arange(len(word)) - np.repeat(np.cumsum(many) - many, many) + offsets[word]
    both = codes[place].astype(np.uint64) << np.uint64(32) | codes[place + 1].astype(np.uint64)
    return (T.mix(both) & np.uint64(BUCKETS - 1)).astype(np.int64), place, word


def gram_counts(words: DataFrame) -> np.ndarray:
    """How many bigrams of the distinct words fall into each class (at most ``BUCKETS`` rows)."""
    def run(batch):
        gram = _grams(*_codes(batch.column("word")))[0]
        n = np.bincount(gram, minlength=BUCKETS)
        there = np.flatnonzero(n)
        return {"gram": there, "n": n[there]}

    out = np.zeros(BUCKETS, dtype=np.int64)
    for row in map_batches(words.select("word"), "gram int, n long", run).groupBy("gram").agg(
            F.sum("n").alias("n")).collect():
        out[row["gram"]] = row["n"]
    return out


def pivots(places: list[int], costs: list[int], count: int = 2, width: int = 2) -> list[int]:
    """Indices of ``count`` grams that do not overlap, of least total cost.

    ``places`` ascend. ``best[j]`` is the cheapest choice of j grams among those
    that end before the present one; ties go to the earlier places.
    """
    best: list = [(0, ())] + [None] * count
    waiting: list = []       # choices that may be extended once they lie ``width`` behind
    at = 0
    for i, p in enumerate(places):
        while at < len(waiting) and waiting[at][0] <= p - width:
            _, j, choice = waiting[at]
            if best[j] is None or choice[0] < best[j][0]:
                best[j] = choice
            at += 1
        for j in range(count):
            if best[j] is not None:
                waiting.append((p, j + 1, (best[j][0] + costs[i], best[j][1] + (i,))))
    for _, j, choice in waiting[at:]:
        if best[j] is None or choice[0] < best[j][0]:
            best[j] = choice
    return list(best[count][1])


def _keys(size: np.ndarray, e_left: np.ndarray, e_right: np.ndarray, target: np.ndarray, prefix, suffix):
    """(keys, which of them exist), up to four for each gram, against partners of ``target`` code points.

    Two assume that the edit lies right of the gram (equal up to ``e_left``), two
    that it lies left of it (equal for the last ``e_right``). Where the equal part is
    shorter than ``SHORT``, the rest of the partner is halved: the edit leaves one
    half as it is, and the key takes that half in, too.
    """
    keys, there = [], []
    for side, e in ((0, e_left), (1, e_right)):
        rest = target - e
        half = np.where(e < SHORT, np.maximum(rest, 0) // 2, 0)
        for far in (0, 1):
            near, other = (e, rest - half) if far else (e + half, np.zeros_like(e))
            use = (rest >= 0) & (np.maximum(near, other) <= size)
            if far:
                use &= e < SHORT
            a, b = (other, near) if side else (near, other)
            a, b = np.where(use, a, 0), np.where(use, b, 0)
            tag = (target * 4 + side * 2 + far).astype(np.uint64) << np.uint64(32) | e.astype(np.uint64)
            keys.append(T.mix(T.mix(prefix(a) ^ T.mix(tag)) + suffix(b)))
            there.append(use)
    return np.stack(keys, axis=1), np.stack(there, axis=1)


def signatures(words: DataFrame, counts: np.ndarray) -> DataFrame:
    """(word, n, last, index, probes): the place in the gram order where the word's prefix
    ends, the keys of its prefix grams and those of its pivots.

    A key is a 64-bit hash (its collisions only cost a verification).
    """
    order = np.empty(BUCKETS, dtype=np.int64)
    order[np.lexsort((np.arange(BUCKETS), counts))] = np.arange(BUCKETS)

    def run(batch):
        codes, offsets = _codes(batch.column("word"))
        gram, place, word = _grams(codes, offsets)
        rank = order[gram]
        by = np.lexsort((rank, word))
        first = np.searchsorted(word, np.arange(len(offsets) - 1))
        last = rank[by][first + PREFIX - 1]
        use = np.flatnonzero(rank <= last[word])
        gram, place, word = gram[use], place[use], word[use]
        up, down = T.powers(_BASE, len(codes) + 1)
        total = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum(T.mix(codes.astype(np.uint64)) * up[:len(codes)], out=total[1:])

        def made(of: np.ndarray, targets: tuple) -> pa.Array:
            w, p = word[of], place[of]
            begin, end = offsets[w], offsets[w + 1]
            span = lambda a, b: T.mix((total[b] - total[a]) * down[a])
            parts = [_keys(end - begin, p - begin + 2, end - p, end - begin + d,
                           lambda k: span(begin, begin + k), lambda k: span(end - k, end)) for d in targets]
            keys, there = (np.concatenate(x, axis=1) for x in zip(*parts))
            n = np.bincount(w, weights=there.sum(axis=1), minlength=len(offsets) - 1).astype(np.int64)
            return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()),
                                            pa.array(T.signed(keys[there])))

        cost, at = counts[gram], np.searchsorted(word, np.arange(len(offsets)))
        chosen = np.fromiter((at[w] + i for w in range(len(offsets) - 1) for i in pivots(
            place[at[w]:at[w + 1]].tolist(), cost[at[w]:at[w + 1]].tolist())), dtype=np.int64)
        return {"word": batch.column("word"), "n": batch.column("n"), "last": last,
                "index": made(np.arange(len(word)), (0,)),
                "probes": made(chosen, (-1, 0, 1))}  # the partner is as long, or one code point off

    return map_batches(words.select("word", "n"),
                       "word string, n long, last int, index array<long>, probes array<long>", run)


def near_pairs(words: DataFrame, scratch: Written) -> DataFrame:
    """(a, na, b, nb), a < b: all pairs of ``words`` (word, n; distinct, stored) at edit distance 1.

    Every word needs at least 4 code points, so that three bigrams exist.
    """
    signed = scratch.put(signatures(words, gram_counts(words)), "signatures")
    probe = signed.select(F.col("word").alias("a"), F.col("n").alias("na"), F.col("last").alias("la"),
                          F.explode("probes").alias("key"))
    index = signed.select(F.col("word").alias("b"), F.col("n").alias("nb"), F.col("last").alias("lb"),
                          F.explode("index").alias("key"))
    found = (probe.join(index, "key")
             .filter((F.col("lb") >= F.col("la")) & (F.col("a") != F.col("b"))
                     & (F.levenshtein("a", "b", 1) == 1)))
    one, two = F.struct(F.col("a").alias("w"), F.col("na").alias("n")), F.struct(
        F.col("b").alias("w"), F.col("nb").alias("n"))
    pair = found.select(F.least(one, two).alias("x"), F.greatest(one, two).alias("y")).distinct()
    return pair.select(F.col("x.w").alias("a"), F.col("x.n").alias("na"),
                       F.col("y.w").alias("b"), F.col("y.n").alias("nb"))


def roots(forms: DataFrame, most: int, scratch: Written, ratio: int = RATIO) -> DataFrame:
    """(word, root): the last word reached from each word that has a form.

    A form is ``ratio`` times as frequent as its word, so a chain has at most
    log(most) steps; every round doubles how far each pointer reaches.
    """
    steps = max(1, math.floor(math.log(max(most, 2), ratio)) + 1)
    now = forms.select("word", F.col("form").alias("root"))
    for i in range(max(1, math.ceil(math.log2(steps)))):
        now = scratch.put(now.join(now.select(F.col("word").alias("root"), F.col("root").alias("_next")),
                                   "root", "left")
                          .select("word", F.coalesce("_next", "root").alias("root")), f"roots-{i}")
    return now


def group_variants(words: DataFrame, ratio: int = RATIO, scratch: Written | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``words`` (word, n).

    ``form``: the near word (edit distance 1) of largest n, ties to the
    smallest in code-point order, if that n >= ``ratio`` * the word's own. Words
    must be distinct; a row whose word is null, or has fewer than 4 code
    points, or whose n is null takes no part. An empty table gives none.
    """
    scratch = scratch or Written(words.sparkSession, "variants")
    words = scratch.put(words.filter(F.length("word") > PREFIX).filter("n IS NOT NULL")
                        .select("word", F.col("n").cast("long").alias("n")), "words")
    pairs = scratch.put(near_pairs(words, scratch), "pairs")
    sides = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("o"), F.col("nb").alias("m")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("o"), F.col("na").alias("m")))).alias("s")).select("s.*")
    near = sides.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"),
                                     F.min(F.struct((-F.col("m")).alias("m"), "o")).alias("best"))
    taken = -F.col("best.m") >= ratio * F.col("n")
    whole = scratch.put(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(taken, F.col("best.o")).alias("form"), F.when(taken, -F.col("best.m")).alias("form_n")), "forms")
    most = whole.agg(F.max("n")).first()[0] or 1
    last = roots(whole.filter("form IS NOT NULL"), most, scratch, ratio)
    return whole.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

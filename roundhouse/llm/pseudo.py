"""Masked pseudo-likelihood scores from a small bidirectional window network.

Every word of the corpus is counted. Words of at least ``least`` occurrences
are leaves of their own, rarer ones are dealt by hash to leaves of about as
many occurrences, so the leaves grow with the corpus. The leaves, the most
frequent first, hang on a binary tree. The network sees two words on either
side of a position and predicts the word there by the turns on the way to its
leaf:

    log odds of a right turn = log(count right / count left) + network(both sides) . vector of the turn
    log p(word | both sides) = sum of its turns + log(count of word / count of leaf)

so an untrained network gives every word its share of the corpus, and what it
learns moves every leaf. Each turn is normalised by itself: no sum over a
vocabulary is needed, neither in training nor in scoring.

The texts are encoded once. Documents are dealt to shards by a hash of their
id and text and trained in the order of that hash, in numpy; the shards'
weights are summed by Spark as integers, row by row. So the model does not
depend on how the input is partitioned. The most frequent leaves, as many as
the square root of the corpus, have an embedding each; the others share. With
the square root of the corpus as the number of shards, too, the rows that all
shards return grow in proportion to the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import Written, map_batches

WORDS = 4096             # so many words are leaves of their own in a small corpus, too
MIN_COUNT = 256          # occurrences of a leaf, at least
MAX_LEAVES = 1 << 20     # beyond MIN_COUNT * MAX_LEAVES words of text, a leaf's occurrences grow instead
LOOKUP = 1 << 18         # counts held by each task; those of rarer words are joined (same result)
SPREAD = 256             # the square root of the words of a corpus over the number of its training shards
CHUNK = 1 << 17          # words held at once
SIDE, EMBED, HIDDEN = 2, 8, 16
TOP, FOLD = 5, 4         # every turn of TOP levels has a vector, lower levels FOLD vectors each
ROUNDS = 2
RATE = 0.05
BATCH, SCORE_BATCH = 512, 4096
UNIT = 1 << 24           # weights are summed in these fractions


def word_counts(docs: DataFrame) -> DataFrame:
    """(w, n): the hash of every word of the texts and how often it occurs."""
    def count(batch):
        for _, _, buf, offsets in T.slices(batch.column("text"), 8 << 20):
            word, n = np.unique(T.word_hashes(buf, offsets)[0], return_counts=True)
            yield {"w": T.signed(word), "n": n}
    return map_batches(docs.select("text"), "w long, n long", count).groupBy("w").agg(F.sum("n").alias("n"))


class Vocabulary:
    """The leaf of every word, and how often each leaf occurs."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, hashed: np.ndarray):
        """``words``: unsigned hashes with a leaf of their own; ``hashed``: counts of the 2**k leaves of all others."""
        order = np.lexsort((words, -counts))
        leaf = np.empty(len(words), dtype=np.int32)
        leaf[order] = np.arange(len(words))
        by_hash = np.argsort(words)
        self.words, self.leaf, self.own = words[by_hash], leaf[by_hash], len(words)
        self.mass = np.concatenate([counts[order], hashed]).astype(float)
        self.hashed = np.uint64(len(hashed) - 1)
        self.leaves = len(self.mass)
        # embeddings: of the most frequent leaves, shared by the others, and the pad beyond a text's ends
        self.known = min(self.leaves, max(WORDS, int(self.mass.sum() ** 0.5)))
        self.shared = min(self.leaves - self.known, self.known // 4)
        self.pad = self.known + self.shared
        # a place for most words, so that few are searched
        self.slots = np.uint64((1 << (4 * len(words) + 1).bit_length()) - 1)
        self.place = np.zeros(int(self.slots) + 1, dtype=np.int32)
        self.place[(self.words & self.slots).astype(np.int64)] = np.arange(len(words))

    def leaves_of(self, hashes: np.ndarray) -> np.ndarray:
        out = (self.own + (hashes & self.hashed).astype(np.int64)).astype(np.int32)
        if self.own and len(hashes):
            at = self.place[(hashes & self.slots).astype(np.int64)]
            hit = self.words[at] == hashes
            out[hit] = self.leaf[at[hit]]
            rest = np.flatnonzero(~hit)
            at = np.minimum(np.searchsorted(self.words, hashes[rest]), self.own - 1)
            same = self.words[at] == hashes[rest]
            out[rest[same]] = self.leaf[at[same]]
        return out


    def seen_as(self, leaf: np.ndarray) -> np.ndarray:
        """The embedding of each leaf."""
        if not self.shared:
            return leaf
        return np.where(leaf < self.known, leaf, self.known + leaf % self.shared)


def vocabulary(counts: DataFrame, words: int = WORDS, least: int = MIN_COUNT, most: int = MAX_LEAVES) -> Vocabulary:
    """Leaves from all counts: at most ``most`` + ``words`` of single words and ``most`` hashed ones."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(least, -(-total // most))
    top = counts.orderBy(F.desc("n"), "w").limit(words)
    own = counts.filter(F.col("n") >= least).unionByName(top).distinct().toPandas()
    rare = max(total - int(own["n"].sum()), 0)
    leaves = 1 << max((rare // least).bit_length() - 1, 0)
    hashed = np.zeros(leaves)
    # of words without a leaf of their own: those below ``least`` that are not in ``top``
    rest = counts.filter(F.col("n") < least).join(top.select("w"), "w", "left_anti")
    some = rest.groupBy(F.expr(f"w & {leaves - 1}").alias("leaf")).agg(F.sum("n").alias("n")).toPandas()
    hashed[some["leaf"].to_numpy(dtype=np.int64)] = some["n"].to_numpy(dtype=float)
    return Vocabulary(own["w"].to_numpy(dtype=np.int64).view(np.uint64), own["n"].to_numpy(dtype=np.int64), hashed)


class Tree:
    """Leaves in order below a complete binary tree; node 1 is the root, 2k and 2k + 1 are below k."""

    def __init__(self, mass: np.ndarray):
        self.depth = max(1, (len(mass) - 1).bit_length())
        sums = np.zeros(2 << self.depth)
        sums[1 << self.depth:(1 << self.depth) + len(mass)] = mass
        for d in range(self.depth - 1, -1, -1):
            k = np.arange(1 << d, 2 << d)
            sums[k] = sums[2 * k] + sums[2 * k + 1]
        logs = np.log(np.maximum(sums, 1e-9))
        self.odds = (logs[1::2] - logs[0::2])[:1 << self.depth].clip(-30, 30).astype(np.float32)  # of a right turn, by node
        levels = np.arange(self.depth, dtype=np.int32)
        self.shift, self.first = self.depth - levels, (1 << levels).astype(np.int32)
        top = min(TOP, self.depth)
        self.columns = (1 << top) + FOLD * (self.depth - top)
        self.mask = np.where(levels < top, (1 << top) - 1, FOLD - 1).astype(np.int32)
        self.base = np.where(levels < top, 0, (1 << top) + FOLD * (levels - top)).astype(np.int32)

    def turns(self, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """On the way to each leaf: signs of the turns (right is 1), their log odds, columns of their vectors."""
        below = leaf[:, None].astype(np.int32) >> (self.shift - 1)
        node = (below >> 1) + self.first
        return (((below & 1) << 1) - 1).astype(np.float32), self.odds[node], (node & self.mask) + self.base


STEPS = np.array([s for s in range(-SIDE, SIDE + 1) if s])


def padded(ids: np.ndarray, first: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts' ids with ``pad`` beyond each end, and the place of every position in them:
    ``padded[place + STEPS]`` are the words around it."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    place = np.arange(len(ids)) + SIDE * (doc + 1)
    out = np.full(len(ids) + SIDE * len(first), pad, dtype=np.int64)
    out[place] = ids
    return out, place


class Network:
    """Weights: embeddings (the last of the pad), hidden layer, vectors of the turns."""

    def __init__(self, pad: int, columns: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        put = lambda n, *s: (rng.normal(size=s) / np.sqrt(n)).astype(np.float32)
        self.parts = [put(EMBED, pad + 1, EMBED), put(2 * SIDE * EMBED, 2 * SIDE * EMBED, HIDDEN),
                      np.zeros(HIDDEN, np.float32), put(HIDDEN, HIDDEN, columns), np.zeros(columns, np.float32)]

    def copy(self) -> Network:
        out = Network.__new__(Network)
        out.parts = [p.copy() for p in self.parts]
        return out

    def dense(self) -> np.ndarray:
        """All but the embeddings, as rows of their width."""
        flat = np.concatenate([p.ravel() for p in self.parts[1:]])
        return np.pad(flat, (0, -len(flat) % EMBED)).reshape(-1, EMBED)

    def load_dense(self, rows: np.ndarray) -> None:
        at, flat = 0, rows.ravel()
        for i, p in enumerate(self.parts[1:], 1):
            self.parts[i] = flat[at:at + p.size].reshape(p.shape).astype(np.float32)
            at += p.size

    def forward(self, ctx: np.ndarray, turns) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Inputs, hidden layer, places of the turns in a (positions, columns) array, and their signed log odds."""
        e, w, b, v, c = self.parts
        sign, odds, column = turns
        x = e.take(ctx, axis=0).reshape(len(ctx), -1)
        h = np.tanh(x @ w + b)
        z = h @ v
        z += c
        at = column + (np.arange(len(ctx)) * len(c))[:, None]
        return x, h, at, (z.ravel().take(at) + odds) * sign

    def log_probs(self, ctx: np.ndarray, turns) -> np.ndarray:
        t = self.forward(ctx, turns)[3]
        low = np.minimum(t, -80) + 80  # so far below, log p is the log odds themselves
        u = np.exp(-np.maximum(t, -80))
        u += 1
        return low.sum(axis=1, dtype=float) - np.log(u, out=u) @ np.ones(t.shape[1], np.float32)

    def step(self, ctx: np.ndarray, turns, sums: list[np.ndarray], slot: np.ndarray, rate: float) -> None:
        """One Adagrad step on a batch; ``slot``: an int per embedding, for use in here."""
        e, w, b, v, c = self.parts
        x, h, at, t = self.forward(ctx, turns)
        g = np.zeros((len(ctx), len(c)), dtype=np.float32)
        g.ravel()[at] = -turns[0] / (1 + np.exp(np.minimum(t, 80)))  # a position has each column once
        gh = (g @ v.T) * (1 - h * h)
        gx = gh @ w.T
        ones = np.ones(len(ctx), np.float32)
        for p, s, d in zip(self.parts[1:], sums[1:], (x.T @ gh, ones @ gh, h.T @ g, ones @ g)):
            d /= np.float32(len(ctx))
            s += d * d
            p -= rate * d / (np.sqrt(s) + 1e-6)
        # only the embeddings of words in the batch move: one place of each stands for all of its places
        flat = ctx.ravel()
        places = np.arange(len(flat))
        slot[flat] = places
        chief = slot[flat]
        ge = np.bincount((chief[:, None] * EMBED + np.arange(EMBED)).ravel(), weights=gx.ravel(),
                         minlength=len(flat) * EMBED).reshape(-1, EMBED)
        at = np.flatnonzero(chief == places)
        word, ge = flat[at], ge[at].astype(np.float32)
        s = sums[0][word] + ge * ge
        sums[0][word] = s
        e[word] -= rate * ge / np.sqrt(s)


class Counts:
    """Logarithms of the counts of the most frequent words that have no leaf of their own."""

    def __init__(self, words: np.ndarray, n: np.ndarray):
        order = np.argsort(words)
        self.words, self.logs = words[order], np.log(n[order].astype(float))

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The logarithm of each word's count where it is held (else 0), and whether it is."""
        if not len(self.words):
            return np.zeros(len(hashes)), np.zeros(len(hashes), dtype=bool)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        held = self.words[at] == hashes
        return np.where(held, self.logs[at], 0.0), held


def held_counts(counts: DataFrame, vocab: Vocabulary, lookup: int = LOOKUP) -> Counts:
    """Counts of at most ``lookup`` words, the most frequent of those below the vocabulary."""
    least = vocab.mass[vocab.own - 1] if vocab.own else 1 << 62
    rest = counts.filter(F.col("n") <= int(least))
    sizes = rest.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).toPandas()
    sizes = sizes[sizes["words"].cumsum() <= lookup]
    some = rest.filter(F.col("n") >= (int(sizes["n"].min()) if len(sizes) else 1 << 62)).toPandas()
    return Counts(some["w"].to_numpy(dtype=np.int64).view(np.uint64), some["n"].to_numpy(dtype=np.int64))


def encode(docs: DataFrame, vocab: Vocabulary, known: Counts, shards: int) -> DataFrame:
    """doc_id, the leaves of each text's words, ``share``: the sum of log(count of word / count of leaf)
    but for the counts of the words in ``rare``, and the document's place in training (shard, turn)."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)["doc_id"]
    shared = spark.sparkContext.broadcast((vocab, known))

    def run(batch):
        vocab, known = shared.value
        log_mass = np.log(np.maximum(vocab.mass, 1))
        for lo, hi, buf, offsets in T.slices(batch.column("text")):
            hashes, first, _, _ = T.word_hashes(buf, offsets)
            leaf = vocab.leaves_of(hashes)
            other = np.flatnonzero(leaf >= vocab.own)
            log, held = known.of(hashes[other])
            share = np.zeros(len(hashes) + 1)
            share[other + 1] = log - log_mass[leaf[other]]
            share = np.cumsum(share)
            more = other[~held]
            yield {"doc_id": batch.column("doc_id")[lo:hi], "turn": batch.column("turn")[lo:hi],
                   "leaves": pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(leaf)),
                   "share": share[first[1:]] - share[first[:-1]],
                   "rare": pa.ListArray.from_arrays(pa.array(np.searchsorted(more, first).astype(np.int32)),
                                                    pa.array(T.signed(hashes[more])))}

    out = map_batches(docs.select("doc_id", "text", F.xxhash64(F.col("doc_id").cast("string"), "text").alias("turn")),
                      f"doc_id {kind}, turn long, leaves array<int>, share double, rare array<long>", run)
    return out.withColumn("shard", F.pmod("turn", F.lit(shards)).cast("int")).withColumn(
        "row", F.monotonically_increasing_id())


def chunks(column: pa.ListArray, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, values, offsets) of runs of lists of about ``most`` values; a longer list is its own."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    values, lo = column.values.to_numpy(zero_copy_only=False), 0
    while lo < len(column):
        hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
        hi = min(max(hi, lo + 1), len(column))
        yield lo, hi, values[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def train(texts: DataFrame, vocab: Vocabulary, tree: Tree, shards: int, rounds: int = ROUNDS) -> Network:
    """Each round trains every shard on all its positions and averages the weights over the shards
    (an embedding: over the shards that hold one of its words)."""
    net = Network(vocab.pad, tree.columns)
    names = [f"w{i}" for i in range(EMBED)]
    schema = ", ".join(["id int"] + [f"{c} int" for c in names])
    dealt = texts.select("shard", "turn", "leaves").filter(F.size("leaves") > 0).repartitionById(
        shards, "shard").sortWithinPartitions("turn")

    def fit(shared):
        def run(batches):
            vocab, tree, net = shared.value
            own = net.copy()
            sums = [np.full(p.shape, 0.1 if i == 0 else 1e-4, dtype=np.float32) for i, p in enumerate(own.parts)]
            slot = np.empty(vocab.pad + 1, dtype=np.int64)
            met = np.zeros(vocab.pad + 1, dtype=bool)
            for batch in batches:
                for _, _, leaf, first in chunks(batch.column("leaves")):
                    wide, place = padded(vocab.seen_as(leaf), first, vocab.pad)
                    met[wide] = True
                    for a in range(0, len(leaf), BATCH):
                        now = slice(a, a + BATCH)
                        own.step(wide[place[now, None] + STEPS], tree.turns(leaf[now]), sums, slot, RATE)
            if met.any():
                word, dense = np.flatnonzero(met), own.dense()
                ids = np.concatenate([word, -1 - np.arange(len(dense))]).astype(np.int32)
                rows = np.concatenate([own.parts[0][word], dense]).clip(-100, 100)
                rows = np.rint(rows * UNIT).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(ids)] + [pa.array(rows[:, i].copy()) for i in range(EMBED)],
                                                 names=["id"] + names)
        return run

    for _ in range(rounds):
        shared = texts.sparkSession.sparkContext.broadcast((vocab, tree, net))
        rows = dealt.select("leaves").mapInArrow(fit(shared), schema).groupBy("id").agg(
            F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in names]).toPandas()  # one row per embedding
        ids = rows["id"].to_numpy()
        means = (rows[names].to_numpy(dtype=float) / rows["n"].to_numpy(dtype=float)[:, None] / UNIT).astype(np.float32)
        word = ids >= 0
        net = net.copy()
        net.parts[0][ids[word]] = means[word]
        dense = net.dense()
        dense[-1 - ids[~word]] = means[~word]
        net.load_dense(dense)
    return net


def score(docs: DataFrame, words: int = WORDS, rounds: int = ROUNDS, scratch: Written | None = None,
          least: int = MIN_COUNT, lookup: int = LOOKUP, spread: int = SPREAD) -> DataFrame:
    """doc_id, n_tokens, log_likelihood, mean_log_likelihood of every document.

    Null and empty texts have 0 tokens, log-likelihood 0 and a null mean.
    Repeated rows are trained and scored each; extra columns are ignored. The
    model is the same however the rows are partitioned (scores then differ by
    the rounding of floats only).
    """
    scratch = scratch or Written(docs.sparkSession, "pseudo")
    counts = scratch.put(word_counts(docs), "counts")
    vocab = vocabulary(counts, words, least)
    tree = Tree(vocab.mass)
    shards = int(vocab.mass.sum() ** 0.5) // spread + 1
    texts = scratch.put(encode(docs, vocab, held_counts(counts, vocab, lookup), shards), "texts")
    net = train(texts, vocab, tree, shards, rounds)
    shared = docs.sparkSession.sparkContext.broadcast((vocab, tree, net))

    def run(batch):
        vocab, tree, net = shared.value
        total = batch.column("share").to_numpy().copy()
        n = np.zeros(batch.num_rows, dtype=np.int64)
        for lo, hi, leaf, first in chunks(batch.column("leaves")):
            wide, place = padded(vocab.seen_as(leaf), first, vocab.pad)
            sums = np.zeros(len(leaf) + 1)
            for a in range(0, len(leaf), SCORE_BATCH):
                now = slice(a, a + SCORE_BATCH)
                sums[1:][now] = net.log_probs(wide[place[now, None] + STEPS], tree.turns(leaf[now]))
            sums = np.cumsum(sums)
            n[lo:hi] = np.diff(first)
            total[lo:hi] += sums[first[1:]] - sums[first[:-1]]
        return {"row": batch.column("row"), "doc_id": batch.column("doc_id"), "n_tokens": n, "log_likelihood": total}

    kind = dict(docs.dtypes)["doc_id"]
    out = map_batches(texts.select("row", "doc_id", "leaves", "share"),
                      f"row long, doc_id {kind}, n_tokens long, log_likelihood double", run)
    # the counts of words that no task holds; once is log 1 = 0
    more = (texts.select("row", F.explode("rare").alias("w")).join(counts.filter("n > 1"), "w")
            .groupBy("row").agg(F.sum(F.log("n")).alias("more")))
    out = out.join(more, "row", "left").withColumn(
        "log_likelihood", F.col("log_likelihood") + F.coalesce("more", F.lit(0.0))).drop("row", "more")
    return out.withColumn("mean_log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))

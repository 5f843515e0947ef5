"""Difference-cover deduplication: what is sorted, groups that are dealt out, brute force."""

import collections
import hashlib
import random

from roundhouse.llm import suffix
from roundhouse.llm.common import Written


def by_brute_force(texts):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[k:k + 200] for b in raw for k in range(len(b) - 199))
    for b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if seen[b[k:k + 200]] > 1:
                gone[k:k + 200] = b"\1" * 200
        kept = bytes(x for x, y in zip(b, gone) if not y)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        yield len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()


def check(spark, texts, **more):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: tuple(r)[1:5] for r in suffix.deduplicate(docs, **more).collect()}
    assert got == dict(enumerate(by_brute_force(texts)))


def letters(rnd, n):
    return "".join(rnd.choice("abcdefgh ") for _ in range(n))


def near_copies(rnd, many):
    """Copies of one text with changed bytes, shared passages in different places, periodic texts."""
    base, passage = letters(rnd, 1500), letters(rnd, 330)
    out = []
    for i in range(many):
        t = list(base)
        for _ in range(rnd.randint(0, 4)):
            t[rnd.randrange(len(t))] = "Z"
        out.append("".join(t))
        cut = rnd.randrange(60)
        out.append(letters(rnd, rnd.randint(0, 250)) + passage[cut:] + letters(rnd, rnd.randint(0, 250)))
    return out + ["ab " * 400, "ab " * 300, "q" * 900, "q" * 200, "q" * 199, "\0" * 500, "é" * 300, base, base, None, ""]


def test_large_groups_are_dealt_out(spark):
    """Runs of one minimiser beyond the bound are cut into shorter ones, at every width down to one window."""
    texts = near_copies(random.Random(5), 60)
    check(spark, texts, hot=8)
    check(spark, texts, hot=1)
    check(spark, texts)


def test_parts_of_a_task_and_of_a_long_text(spark, monkeypatch):
    """Runs that end where a task's piece of work ends still meet."""
    rnd = random.Random(6)
    long = letters(rnd, 9000)
    texts = [long, long[100:5000] + "x" + long[5000:], letters(rnd, 700), long[8000:] + "q" * 3000, "q" * 700]
    docs = spark.createDataFrame([(t, i, i) for i, t in enumerate(texts)], "text string, t long, t2 long")
    whole = suffix._runs(docs, 200, 64).count()
    monkeypatch.setattr(suffix, "_CHUNK", 256)
    monkeypatch.setattr(suffix, "SORTED", 2000)
    assert suffix._runs(docs, 200, 64).count() > whole
    check(spark, texts)


class Counted(Written):
    def __init__(self, *a):
        super().__init__(*a)
        self.rows = 0

    def put(self, df, name, compression="zstd"):
        out = super().put(df, name, compression)
        self.rows += out.count()
        return out


def test_sampled_positions_are_not_stored(spark):
    """What is written has a row for each text, not rows for each sampled position."""
    texts = near_copies(random.Random(7), 40)
    scratch = Counted(spark, "test-suffix")
    check(spark, texts, scratch=scratch)
    assert scratch.rows <= len(texts)


def test_local_sort_against_brute_force():
    rnd = random.Random(8)
    base = bytes(rnd.randrange(256) for _ in range(3000))
    pieces = [b"\0" * 336, b"\0" * 210, b"ab" * 120, b"x" * 199, b"abc" * 100, b"\xff" * 250]
    for _ in range(200):
        a = rnd.randrange(2600)
        x = bytearray(base[a:a + rnd.randint(200, 336)])
        if rnd.random() < 0.7:
            x[rnd.randrange(len(x))] ^= 1
        pieces.append(bytes(x))
    seen = collections.Counter(x[k:k + 200] for x in pieces for k in range(len(x) - 199))
    want = [k + 200 <= len(x) and seen[x[k:k + 200]] > 1 for x in pieces for k in range(len(x))]
    assert suffix.repeated_starts(pieces).tolist() == want

"""Spelling variants, tiered packing and the Merkle manifest against brute force."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from roundhouse.llm import merkle, queries, tiers, variants

SMALL = "/root/testdata/sf0.001"
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, tree string, block long, " \
           "digest string, root string, word string, n long, key long, ids string, _shard long, pos long"


def clashing(spark, rows):
    """Documents (doc_id, text, lang, source, n_chars) with extra columns of names used inside."""
    return spark.createDataFrame([(*r, "t", 1, "d", "r", "w", 2, 3, "i", 4, 5) for r in rows], CLASHING).repartition(4)


# ---- spelling variants

def plain_words(rows):
    count = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                count[run] += 1
    return {w: n for w, n in count.items() if n >= 2}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    a, b = sorted((a, b), key=len)
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)):] == b[k + 1:]


def plain_variants(words, ratio=10):
    near = collections.defaultdict(list)
    holes = collections.defaultdict(set)    # words by what is left without one code point
    for w in words:
        for x in {w, *(w[:k] + w[k + 1:] for k in range(len(w)))}:
            holes[x].add(w)
    for group in holes.values():
        for a, b in itertools.permutations(group, 2):
            if one_edit(a, b):
                near[a].append(b)
    out = {}
    for w, n in words.items():
        others = sorted(set(near[w]), key=lambda o: (-words[o], o))
        form = others[0] if others and words[others[0]] >= ratio * n else None
        out[w] = [form, None, n, len(others), words.get(form)]
    for w, row in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        row[1] = root
    return {w: tuple(r) for w, r in out.items()}


def got_variants(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def variant_texts():
    rnd = random.Random(5)
    base = ["accommodate", "réceptions", "aaaaaaaa", "aaaaaaaaa", "abababab", "babababa", "überfälle", "ÀÿÀÿÀÿÀ"]
    base += ["".join(rnd.choice("abcde") for _ in range(rnd.randint(7, 10))) for _ in range(60)]
    rows = [(i, " ".join(rnd.choice(base) for _ in range(60)) + "\n123,") for i in range(60)]
    for i in range(60, 100):
        w = []
        for _ in range(20):
            x = rnd.choice(base)
            k = rnd.randrange(len(x))
            w.append(x[:k] + rnd.choice(["", "q", "é", x[k] + "e", x[k] + x[k]]) + x[k + 1:])
        rows.append((i, "-".join(w + w[:7])))
    rows += [(100, None), (101, ""), (None, "seventy seventy SEVENTY"), (7, "repeated repeated"),
             (7, "repeated repeated"), (102, "z" * 3000 + " " + "z" * 2999 + "y " + ("z" * 3000)),
             (103, "z" * 2999 + "y"), (104, "Straße ×÷×÷×÷× ×÷×÷×÷×")]
    return rows


def test_variants_equal_brute_force(spark):
    rows = variant_texts()
    docs = clashing(spark, [(i, t, "en", "s", 1) for i, t in rows])
    words = plain_words(rows)
    counted = variants.count_words(docs, delete_every=31)
    assert {r["word"]: r["n"] for r in counted.collect()} == words
    want = plain_variants(words)
    assert sum(r[3] > 0 for r in want.values()) > 40 and any(r[0] for r in want.values())
    assert got_variants(variants.group_variants(counted)) == want


def test_variants_chain_ties_and_edges(spark):
    words = {"seventy": 30_000, "sevenly": 3_000, "sevenlyx": 300, "sevenlyxy": 20, "twinned": 50, "twinnes": 50,
             "twinner": 5, "lonesome": 9, "abcdefg": 9, "abcdegf": 900}
    df = spark.createDataFrame([*words.items(), (None, 5), ("abc", 90), ("abcd", 9), ("abce", 99)], "word string, n long")
    want = plain_variants({**words, "abcd": 9, "abce": 99})
    assert want["sevenlyxy"][1] == "seventy" and want["twinner"][0] == "twinned" and want["abcdefg"][3] == 0
    assert got_variants(variants.group_variants(df)) == want
    assert variants.group_variants(df.limit(0)).count() == 0


def test_pivots_are_the_cheapest_disjoint_grams():
    rnd = random.Random(3)
    for _ in range(400):
        places = sorted(rnd.sample(range(14), rnd.randint(3, 8)))
        costs = [rnd.randint(0, 9) for _ in places]
        for count in (1, 2, 3):
            free = [c for c in itertools.combinations(range(len(places)), count)
                    if all(places[b] - places[a] >= 2 for a, b in zip(c, c[1:]))]
            if free:
                chosen = variants.pivots(places, costs, count)
                assert tuple(chosen) in free
                assert sum(costs[i] for i in chosen) == min(sum(costs[i] for i in c) for c in free)


def test_variant_query_on_its_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert got_variants(queries.QUERIES["op11_pivotal_variants"](spark, SMALL)) == plain_variants(plain_words(rows))


# ---- tiered packing

def check_packing(rows, pieces, cut=None):
    """Every id of every row lies in one piece; windows are gapless, full and powers of two."""
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(tiers.tokenizer_path("byte_bpe_50k.json"))
    want = collections.Counter()
    ids = {}
    for i, t in rows:
        x = plain.encode(t or "", add_special_tokens=False).ids + [1]
        want[i] += len(x)
        ids.setdefault(i, []).append(np.array(x, dtype="<u4"))
    held, per_doc = collections.defaultdict(list), collections.Counter()
    for p in pieces:
        fits = [x for x in ids[p["doc_id"]] if len(x) == p["doc_tokens"] and zlib.crc32(
            x[p["start"]:p["start"] + p["length"]].tobytes()) == p["ids_crc32"]]
        assert fits and 0 < p["length"] and p["start"] + p["length"] <= p["doc_tokens"]
        per_doc[p["doc_id"]] += p["length"]
        held[p["sequence_id"]].append(p)
    assert per_doc == want
    for i in ids:
        if len(ids[i]) == 1:
            spans = sorted((p["start"], p["length"]) for p in pieces if p["doc_id"] == i)
            assert [a for a, _ in spans] == list(np.cumsum([0] + [k for _, k in spans])[:-1])
    for ps in held.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert {p["tier"] for p in ps} == {at} and at <= 2048 and at & (at - 1) == 0
        assert len({p["step_id"] for p in ps}) == 1
    return held


AWKWARD = ["a\n\nb", "a\n b", "a \nb", "x  y", "x  y", "x    y", "don't we'll\n'tis", "\n", " ", "  a  b ",
           "a <|endoftext|> b", "<|endoftext|>", "日本語 text 日本 語\n本", "é à\né  à", "tab\tand\r\nline\n\n\nend\n",
           "x y  z  w", "a\x1c b\x1c\nc", "1 2 33\n4", "🙂 🙂\n🙂", "a\n", "\na", "\n\na", "a\n\x00b", "é\nb"]


def test_chunks_keep_the_ids():
    from tokenizers import Tokenizer
    path = tiers.tokenizer_path("byte_bpe_50k.json")
    plain, code = Tokenizer.from_file(path), tiers.ByteEncoder(path)
    rnd = random.Random(2)
    atoms = ["a", "B", "'s", " ", " ", "\n", "\n", "é", " ", "　", "1", "!", "\t", "日", "\r", "-", "<|endoftext|>"]
    texts = AWKWARD + ["".join(rnd.choice(atoms) for _ in range(rnd.randint(0, 14))) for _ in range(4000)]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    ids, bounds = code.encode(np.frombuffer(b"".join(raw), np.uint8), offsets, 1)
    for k, t in enumerate(texts):
        assert ids[bounds[k]:bounds[k + 1]].tolist() == plain.encode(t, add_special_tokens=False).ids + [1], t


def test_tiered_packing(spark):
    rnd = random.Random(8)
    texts = AWKWARD + [None, "", ""] + [" ".join(f"w{rnd.randrange(999)}" for _ in range(rnd.randint(0, 900)))
                                        for _ in range(120)] + ["long " * 30_000, "y" * 20_000]
    rows = list(enumerate(texts)) + [(None, "no id"), (5, texts[5]), (5, "other text of the same id")]
    docs = clashing(spark, [(i, t, "en", None, 1) for i, t in rows])
    for options in ({}, {"shard_rows": 20, "step_tokens": 8192}):
        held = check_packing(rows, tiers.pack_documents(docs, **options).collect())
        shards = {s >> 32 for s in held}
        small = [s for s, ps in held.items() if ps[0]["tier"] < tiers.TIERS[-1]]
        assert len(small) <= 8 * len(shards)
    steps = collections.Counter()
    for ps in held.values():
        steps[ps[0]["step_id"]] += ps[0]["tier"]
    by_shard = collections.defaultdict(list)
    for s, t in steps.items():
        by_shard[s >> 32].append(t)
    assert all(max(v) - min(v) <= 2048 for v in by_shard.values())
    assert tiers.pack_documents(docs.limit(0)).count() == 0


def test_windows_of_any_lengths():
    rnd = random.Random(6)
    for most in (1, 3, 256, 300, 1025, 2047):
        for n in (0, 1, 2, 50):
            lengths = np.array([rnd.randint(1, most) for _ in range(n)], dtype=np.int64)
            got = collections.defaultdict(list)
            for size, held in tiers.pack_tiers(lengths):
                assert sum(k for _, _, k in held) == size and size & (size - 1) == 0
                for row, a, k in held:
                    got[row].append((a, k))
            for i, total in enumerate(lengths):
                at = 0
                for a, k in sorted(got[i]):
                    assert a == at and k > 0
                    at += k
                assert at == total


def test_packing_query_on_its_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    check_packing(rows, queries.QUERIES["op12_tiered_packing"](spark, SMALL).collect())


# ---- Merkle manifest

def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_manifest(rows, fanout=3):
    def leaf(r):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}"
                           for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"])))

    def tree(nodes):
        """(root, steps [(left, right)] of every leaf)."""
        steps, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for i, k in enumerate(at):
                lo = k - k % fanout
                steps[i].append(("".join(nodes[lo:k]), "".join(nodes[k + 1:lo + fanout])))
            nodes = [sha("".join(nodes[k:k + fanout])) for k in range(0, len(nodes), fanout)]
            at = [k // fanout for k in at]
        return nodes[0], steps

    def fold(node, steps):
        for left, right in steps:
            node = sha(left + node + right)
        return node

    groups = collections.defaultdict(list)
    for r in rows:
        groups[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs = {}
    for s in names:
        groups[s].sort(key=lambda x: x[:3])
        subs[s] = tree([x[2] for x in groups[s]])
    root, above = tree([subs[s][0] for s in names])
    out = []
    for s, up in zip(names, above):
        for (known, i, h, r), steps in zip(groups[s], subs[s][1]):
            steps = steps + up
            other = dict(r)
            if known and zlib.crc32(str(i).encode()) % 2 == 0 and r["text"] is not None:
                other["text"] = r["text"].replace("\n", "")
            folded = fold(leaf(other), steps)
            out.append((r["doc_id"], h, subs[s][0], root, sha("".join(a + b for a, b in steps)), folded, folded == root))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def told(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_manifest_equals_brute_force(spark, monkeypatch, levels):
    rnd = random.Random(levels)
    sizes = {None: 5, "": 1, "a": 1, "b": 2, "Z": 3, "é": 4, "hot": 200, "c": 10, "d": 27, "e": 28, "f": 82}
    rows = []
    for s, n in sizes.items():
        for _ in range(n):
            t = rnd.choice([None, "", "x\ny", "plain", "é\n\n😀", "same"])
            rows.append((rnd.choice([None, 7, 7, *range(10 * len(rows), 10 * len(rows) + 20)]), t,
                         rnd.choice([None, "en"]), s, rnd.choice([None, 3])))
    rows += [(i, "many groups", "en", f"g{i}", 1) for i in range(60)]
    docs = clashing(spark, rows + rows[:9])
    want = plain_manifest([r.asDict() for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()])
    assert {r[-1] for r in want} == {True, False}
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", levels)
    plain = merkle.manifest
    monkeypatch.setattr(merkle, "manifest", lambda d, **k: plain(d, levels=levels, **k))
    assert told(merkle.manifest_digests(docs)) == want
    assert merkle.manifest_digests(docs.limit(0)).count() == 0


def test_manifest_proofs_and_other_fanout(spark):
    docs = clashing(spark, [(i, f"t{i}", "en", f"s{i % 3}", i) for i in range(100)])
    made = merkle.manifest(docs, fanout=2, levels=2, fields=("doc_id", "text"), group="source")
    rows = made.withColumn("again", merkle.fold(F.col("leaf"), F.col("proof"))).collect()
    assert len(rows) == 100 and len({r["root"] for r in rows}) == 1 and {r["source"] for r in rows} == {"s0", "s1", "s2"}
    assert all(r["again"] == r["root"] for r in rows)
    assert {len(r["proof"]) for r in rows} == {8}  # 33 or 34 leaves, then 3 groups


def test_manifest_query_on_its_table(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert told(queries.QUERIES["op13_butterfly_manifest"](spark, SMALL)) == plain_manifest(rows)


# ---- repeated rows and clashing names in earlier operators and stages

def test_repeated_rows_make_the_strings_of_one(spark):
    """g rows of one document and c copies of its text: packed strings do not grow with either."""
    from roundhouse.llm import substring
    from roundhouse.llm.common import Written
    rnd = random.Random(1)
    text = lambda n: " ".join(f"w{rnd.randrange(9999)}" for _ in range(n))
    a, b = text(300), text(200)
    both = f"{b} {' '.join(a.split()[40:240])}"
    made = {}
    for g in (1, 60):
        rows = [(1, a)] * g + [(2, both)] * g + [(3 + i, a) for i in range(g)] + [(None, b)] * g
        scratch = Written(spark, "strings")
        drop, scratch.drop = scratch.drop, lambda *names: drop(*[n for n in names if n != "strings"])
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = substring.deduplicate(docs, scratch=scratch).collect()
        made[g] = spark.read.parquet(f"{scratch.base}/strings").count()
        removed = {r["doc_id"]: {x["n_removed"] for x in got if x["doc_id"] == r["doc_id"]} for r in got}
        assert removed[1] == {0} and removed[2] == {200} and removed[3] == {300} and removed[None] == {200}
        assert len(got) == len(rows)
    assert made[1] == made[60] > 0


STAGE_COLUMNS = ("doc_id long, text string, lang string, source string, n_chars long, spans string, base string, "
                 "score string, _text string, copies string, _row long, _copy string, u_0 string, u string, row long")


def test_pipeline_stages_keep_columns_of_any_name(spark, tmp_path):
    import corpus_pipeline as P
    rnd = random.Random(2)
    good, bad = ["the", "river", "was", "quiet", "and", "old"], ["click", "WIN", "$$$", "free", "now", "!!!"]
    texts = [" ".join(rnd.choice(good if i % 2 else bad) for _ in range(60)) + f" id{i}" for i in range(60)]
    texts[3] = "write to ann@example.org or +49 30 1234567 soon " + texts[3]
    rows = [(i if i else None, t, "en", f"s{i % 3}", len(t or ""), "sp", "ba", "sc", "te", "co", i, "cp", "u0", "u", i)
            for i, t in enumerate([None, "", *texts])]
    docs = spark.createDataFrame(rows + rows[5:7], STAGE_COLUMNS).repartition(3)
    spark.createDataFrame([(i, int(i % 2 == 1), 0) for i in range(2, 62)],
                          "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    extra = {(r[10], r[5:10] + r[11:]) for r in rows}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        found = out.collect()
        assert found and {(r["_row"], tuple(r)[5:10] + tuple(r)[11:]) for r in found} <= extra, name
        if name == "personal_data":
            assert "ann@example.org" not in "".join(r["text"] or "" for r in found) and len(found) == len(rows) + 2
        if name == "quality":
            odd = [r["doc_id"] % 2 for r in found if r["doc_id"] and r["doc_id"] > 1]
            assert sum(odd) > 0.8 * len(odd)
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert P.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= len(rows)


def test_pipeline_runs_on_its_table(spark):
    import corpus_pipeline as P
    out = P.run(spark, SMALL)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    per = out.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0]
    assert 0 < out.select("doc_id").distinct().count() < docs and per <= 4096
